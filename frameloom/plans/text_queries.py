"""Names: natural order, expressions, schemes, parameters, settings, search."""

from __future__ import annotations

from pyspark.sql import functions as F

from frameloom.functions import text
from frameloom.operators import search
from frameloom.operators.spread import number_rows, settle
from frameloom.plans.registry import query
from frameloom.plans.views import table, urls

# Natural order in SQL: a list of (digits first, length of the number, number or text).
_NATURAL = """list_transform(regexp_extract_all({0}, '([0-9]+|[^0-9]+)'), lambda t: CASE WHEN t SIMILAR TO '[0-9]+'
    THEN {{'k': 0, 'n': length(coalesce(nullif(ltrim(t, '0'), ''), '0')), 't': coalesce(nullif(ltrim(t, '0'), ''), '0')}}
    ELSE {{'k': 1, 'n': 0, 't': t}} END)"""


@query(
    "natural_sort",
    f"""SELECT l_suppkey, p_name || '/img' || l_partkey || '_' || l_orderkey || '.png' AS path,
        row_number() OVER (PARTITION BY l_suppkey ORDER BY {_NATURAL.format("p_name || '/img' || l_partkey || '_' || l_orderkey || '.png'")}, l_linenumber, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax) - 1 AS frame
        FROM lineitem JOIN part ON p_partkey = l_partkey""",
)
def natural_sort(spark, folder):
    """Names with numbers of different lengths, numbered per supplier in natural order."""
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    ties = ["l_linenumber", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax"]
    items = table(spark, folder, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", *ties)
    path = F.concat("p_name", F.lit("/img"), F.col("l_partkey").cast("string"), F.lit("_"), F.col("l_orderkey").cast("string"), F.lit(".png"))
    named = items.join(parts, "l_partkey").select("l_suppkey", path.alias("path"), *ties)
    # The key is costly and cutting into ranges reads its input twice (once to sample it).
    keyed = settle(named.withColumn("_key", text.natural_key("path")), "keyed")
    return number_rows(keyed, ["l_suppkey"], ["_key", *ties], keep=["path"]).select("l_suppkey", "path", "frame")


@query(
    "natural_sort_urls",
    f"SELECT page_id, url AS path, row_number() OVER (ORDER BY {_NATURAL.format('url')}, page_id) - 1 AS frame FROM pages",
)
def natural_sort_urls(spark, folder):
    keyed = urls(spark, folder).withColumn("_key", text.natural_key("path")).withColumn("_all", F.lit(0))
    return number_rows(keyed, ["_all"], ["_key", "page_id"]).select("page_id", "path", "frame")


_EXPRESSIONS = "(SELECT a.page_id, a.url || '::' || replace(b.url, 'https://', 's3://') || '::' || a.url AS e FROM pages a JOIN pages b ON b.page_id = a.page_id + 1)"


@query(
    "source_concat",
    f"""SELECT page_id, u.k::INT AS part_no, CASE WHEN starts_with(u.p, 's3://') THEN replace(u.p, 's3://', 's3a://') ELSE u.p END AS path
        FROM (SELECT page_id, unnest(string_split(e, '::')) AS p, generate_subscripts(string_split(e, '::'), 1) - 1 AS k FROM {_EXPRESSIONS}) u""",
)
def source_concat(spark, folder):
    """Expressions of three parts: order and duplicates kept, object-store addresses rewritten."""
    pages = urls(spark, folder)
    after = pages.select((F.col("page_id") - 1).alias("page_id"), F.regexp_replace("path", "https://", "s3://").alias("q"))
    made = pages.join(after, "page_id").select("page_id", F.concat_ws("::", "path", "q", "path").alias("expression"))
    parts = made.select("page_id", F.posexplode(text.sources_of("expression")).alias("part_no", "_p"))
    return parts.select("page_id", "part_no", text.readable_path("_p").alias("path"))


@query(
    "scheme_rewrite",
    """SELECT page_id, CASE WHEN starts_with(p, 's3://') THEN replace(p, 's3://', '/vsis3/') WHEN starts_with(p, 'https://') THEN replace(p, 'https://', '/vsicurl/https://')
       WHEN starts_with(p, 'http://') THEN replace(p, 'http://', '/vsicurl/http://') ELSE p END AS path
       FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN replace(url, 'http://', 's3://') WHEN 1 THEN url ELSE url || '?u=' || url END AS p FROM pages)""",
)
def scheme_rewrite(spark, folder):
    kind = F.col("page_id") % 3
    stored = F.when(kind == 0, F.replace("path", F.lit("http://"), F.lit("s3://")))
    mixed = stored.when(kind == 1, F.col("path")).otherwise(F.concat("path", F.lit("?u="), "path"))
    return urls(spark, folder).select("page_id", text.virtual_path(mixed).alias("path"))


@query(
    "prefix_suffix",
    """SELECT page_id, starts_with(url, 'https://m.') AS is_mobile, ends_with(url, '.html') AS is_html,
       len(string_split_regex(url, '[/?#]')) AS pieces FROM pages""",
)
def prefix_suffix(spark, folder):
    path = F.col("path")
    return urls(spark, folder).select(
        "page_id",
        path.startswith("https://m.").alias("is_mobile"),
        path.endswith(".html").alias("is_html"),
        F.size(F.split(path, "[/?#]")).cast("bigint").alias("pieces"),
    )


@query(
    "program_params",
    """SELECT p_partkey, 3 AS parameters,
       replace(replace(replace(p_name || ' $1 * $2 + $10 - $3 $5', '$1', printf('%.6f', p_retailprice)), '$2', printf('%.6f', p_size::DOUBLE)), '$3', printf('%.6f', 0.5::DOUBLE)) AS program FROM part""",
)
def program_params(spark, folder):
    """Three parameters without a gap; ``$5`` stays and ``$10`` is taken for ``$1`` and a 0."""
    parts = table(spark, folder, "part").withColumn("_p", F.concat("p_name", F.lit(" $1 * $2 + $10 - $3 $5")))
    values = [F.col("p_retailprice"), F.col("p_size"), F.lit(0.5), F.lit(9.0), F.lit(9.0)]
    return parts.select(
        "p_partkey", text.parameter_count("_p").alias("parameters"), text.fill_parameters("_p", values).alias("program")
    )


@query(
    "name_placeholders",
    """SELECT page_id, replace(replace('diff #1 #2 #3 #12 -o out' || page_id, '#2', url || '2'), '#1', url) AS command FROM pages""",
)
def name_placeholders(spark, folder):
    command = F.concat(F.lit("diff #1 #2 #3 #12 -o out"), F.col("page_id").cast("string"))
    names = [F.col("path"), F.concat("path", F.lit("2"))]
    return urls(spark, folder).select("page_id", text.fill_names(command, names).alias("command"))


@query(
    "band_setting",
    """SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN NULL ELSE p_size END AS b0,
         CASE WHEN p_partkey % 5 = 4 THEN NULL WHEN p_partkey % 5 IN (1, 2) THEN -2 ELSE -1 END AS b1,
         CASE WHEN p_partkey % 5 = 4 THEN NULL WHEN p_partkey % 5 = 2 THEN 7 ELSE -1 END AS b2 FROM part""",
)
def band_setting(spark, folder):
    """Band settings with one, two and three numbers, and other text."""
    kind = F.col("p_partkey") % 5
    size = F.col("p_size").cast("string")
    told = (
        F.when(kind == 1, F.concat(F.lit("c:bands:"), size, F.lit(",-2")))
        .when(kind == 2, F.concat(F.lit("c:bands:"), size, F.lit(",-2,7")))
        .when(kind == 4, F.concat(F.lit("p:fps:"), size))
        .otherwise(F.concat(F.lit("c:bands:"), size))
    )
    parsed = table(spark, folder, "part").select("p_partkey", text.band_setting(told).alias("_b"))
    return parsed.select("p_partkey", *[F.col("_b")[k].alias(f"b{k}") for k in range(3)])


@query(
    "view_player_setting",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'zoom' WHEN 1 THEN 'center' WHEN 2 THEN 'fps' END AS name,
       CASE p_partkey % 4 WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN p_size::DOUBLE WHEN 2 THEN -p_size::DOUBLE END AS value FROM part""",
)
def view_player_setting(spark, folder):
    """Zoom, center and rate settings; a frame number below 1 is not accepted."""
    kind, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    told = (
        F.when(kind == 0, F.concat(F.lit("v:zoom:"), size))
        .when(kind == 1, F.concat(F.lit("v:center:"), size, F.lit(",-3.5")))
        .when(kind == 2, F.concat(F.lit("p:fps:-"), size))
        .otherwise(F.concat(F.lit("p:frame:-"), size))
    )
    parsed = table(spark, folder, "part").select("p_partkey", text.view_setting(told).alias("_v"), text.playback_setting(told).alias("_p"))
    return parsed.select(
        "p_partkey",
        F.coalesce("_v.name", "_p.name").alias("name"),
        F.coalesce("_v.x", "_p.value").alias("value"),
    )


@query("fuzzy_topk")
def fuzzy_topk(spark, folder):
    """The 50 best paths for a pattern, after skipping 5."""
    found = search.find_paths(urls(spark, folder), "exhtml", 5, 50)
    return found.select("page_id", "path", "score", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@query(
    "fuzzy_empty_pattern",
    f"SELECT page_id, url AS path, 0::BIGINT AS score FROM pages ORDER BY {_NATURAL.format('url')}, url, page_id LIMIT 40 OFFSET 3",
)
def fuzzy_empty_pattern(spark, folder):
    """An empty pattern lists all paths in natural order."""
    listed = search.scored(urls(spark, folder), "path", "")
    ranked = listed.orderBy(F.desc("score"), text.natural_key("path"), "path", "page_id").offset(3).limit(40)
    return ranked.select("page_id", "path", "score")


@query(
    "fuzzy_matching_names",
    "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, 'r.*d.*g', 'i')",
)
def fuzzy_matching_names(spark, folder):
    """Which names match at all: the pattern's letters occur in order."""
    return search.scored(table(spark, folder, "part"), "p_name", "rdg").select("p_partkey", "p_name")


@query("fuzzy_list")
def fuzzy_list(spark, folder):
    """All matches of an indexed list, best first, equal scores by index."""
    parts = table(spark, folder, "part").select("p_partkey", "p_name")
    return search.find_in_list(parts, "rng", "p_name", "p_partkey").select("p_partkey", "p_name", "score")
