"""Allow or block URLs: given rules on host and path first, rules mined from labelled URLs for all others.

FP-growth finds the token combinations that are frequent together with a label. A combination with enough support and
confidence becomes a rule ``tokens -> verdict``. Rules that a shorter one beats are pruned; the rest is an inverted index
under the rarest token of each, which distinct token sets are looked up in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.operators.spread import join_keys, settle

MIN_SUPPORT = 0.02  # share of the labelled URLs that hold a rule's tokens and its label
MIN_CONFIDENCE = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOST_LABELS = (1, 2, 3)  # ends of a host that are tokens, besides the whole host


def _part(url: str, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract(F.col(url), "(?s)" + pattern, 1), F.lit(""))


def host_of(url: str) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lowered; empty without ``://``."""
    return F.translate(_part(url, r"^.*?://([^/?#]*)"), UPPER, LOWER)


def path_of(url: str) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return _part(url, r"^.*?://[^/?#]*([^?#]*)")


def url_tokens(url: str) -> Column:
    """Distinct tokens of a URL: scheme, ends and words of the host, words of the path, parameters of the query.

    Words are runs of a-z and 0-9 after lowering A-Z; numbers are one token. An empty or NULL URL has only ``s:``.
    """
    host = host_of(url)
    labels = F.split(host, r"\.")
    ends = F.filter(F.array(*[F.when(F.size(labels) >= n, F.array_join(F.slice(labels, -n, n), ".")) for n in HOST_LABELS], host), lambda e: e.isNotNull() & (e != ""))
    words = lambda text: F.filter(F.split(F.translate(text, UPPER, LOWER), "[^a-z0-9]+"), lambda w: w != "")
    short = lambda w: F.when(w.rlike("^[0-9]+$"), F.lit("0")).otherwise(w)
    asked = F.filter(F.split(_part(url, r"^.*?://[^?#]*\?([^#]*)"), "&"), lambda q: q != "")
    named = lambda mark, items, as_is=lambda x: x: F.transform(items, lambda x: F.concat(F.lit(mark), as_is(x)))
    return F.array_distinct(
        F.concat(
            F.array(F.concat(F.lit("s:"), _part(url, r"^(.*?)://"))), named("h:", ends), named("w:", words(host), short),
            named("p:", words(path_of(url)), short), named("q:", asked),
        )
    )


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest of the given ``(verdict, rule)`` that fits a host or a domain above it and the start of the path, as a
    struct of ``rule, verdict``; NULL if none does.
    """
    found = F.lit(None).cast("struct<rule:string, verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        at = rule.index("/")
        name, start = rule[:at], rule[at:]
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def token_items(labelled: DataFrame, min_count: int) -> DataFrame:
    """``labelled(row, tokens)`` -> ``(token, item, n)`` of the tokens that at least ``min_count`` rows hold.

    Tokens that occur in just the same rows are one item, so that copies of a URL do not multiply combinations. A row is
    told by two sums of hashes over its rows; an item is named by its smallest token.
    """
    held = labelled.select("row", F.explode("tokens").alias("token")).groupBy("token").agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64(F.lit(1), "row").cast("decimal(38,0)")).alias("s1"), F.sum(F.xxhash64(F.lit(2), "row").cast("decimal(38,0)")).alias("s2"),
    ).where(F.col("n") >= min_count)
    items = held.groupBy("n", "s1", "s2").agg(F.min("token").alias("item"))
    return held.join(items, ["n", "s1", "s2"]).select("token", "item", "n")


def item_sets(urls: DataFrame, items: DataFrame) -> DataFrame:
    """``urls(row, tokens)`` -> ``(row, items)``, the distinct items of each row in order; rows without any are left out."""
    listed = urls.select("row", F.explode("tokens").alias("token")).join(items.select("token", "item"), "token")
    return listed.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))


def mine_rules(labelled: DataFrame, items: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``labelled(row, tokens, label)`` -> ``(items, verdict, support, confidence)``, pruned.

    ``support`` is the number of labelled rows with the items and the label, ``confidence`` their share of the rows with the
    items. A rule goes if a part of its items gives a rule that comes before it (`_rank`), since it would never decide.
    """
    sets = labelled.select("row", "label").join(item_sets(labelled, items), "row", "left")
    baskets = sets.select(F.concat(F.coalesce("items", F.array().cast("array<string>")), F.array(F.concat(F.lit("="), "label"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(settle(baskets, "baskets"))
    is_label = lambda i: i.startswith("=")
    split = model.freqItemsets.select(
        F.array_sort(F.filter("items", lambda i: ~is_label(i))).alias("items"), F.get(F.filter("items", is_label), 0).alias("label"), F.col("freq").alias("n")
    ).where(F.size("items") > 0)
    frequent = settle(split, "frequent")
    with_label = frequent.where(F.col("label").isNotNull()).select("items", F.substr("label", F.lit(2)).alias("verdict"), F.col("n").alias("support"))
    alone = frequent.where(F.col("label").isNull()).select("items", F.col("n").alias("all"))
    rules = with_label.join(alone, "items").withColumn("confidence", F.col("support") / F.col("all")).drop("all").where(F.col("confidence") >= min_confidence)
    rules = settle(rules, "rules")
    index = rule_index(rules, items)
    better = look_up(rules.select("items"), index, proper=True).withColumnRenamed("best", "part")
    kept = rules.join(better, "items", "left").where(F.col("part").isNull() | (_rank() > F.col("part")))
    return settle(kept.drop("part"), "kept-rules")


def _rank() -> Column:
    """What decides between rules: confidence, support, and ``block`` before ``allow``."""
    return F.struct("confidence", "support", (F.col("verdict") == "block").alias("block"), "verdict")


def rule_index(rules: DataFrame, items: DataFrame) -> DataFrame:
    """Each rule under the rarest of its items."""
    sizes = items.where("token = item").select("item", "n")
    posted = rules.select("items", _rank().alias("rank"), F.explode("items").alias("item")).join(sizes, "item")
    return posted.groupBy("items", "rank").agg(F.min_by("item", F.struct("n", "item")).alias("item")).withColumnRenamed("items", "needs")


def look_up(sets: DataFrame, index: DataFrame, proper: bool = False) -> DataFrame:
    """``sets(items)`` -> ``(items, best)``: the highest rank of the rules whose items a set holds, for sets with any."""
    met = sets.distinct().select("items", F.explode("items").alias("item")).join(index, "item")
    fits = F.size(F.array_except("needs", "items")) == 0
    if proper:
        fits = fits & (F.size("needs") < F.size("items"))
    return met.where(fits).groupBy("items").agg(F.max("rank").alias("best"))


def judge_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str]], url: str = "url", labels: DataFrame | None = None,
    min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, default: str = "allow",
) -> tuple[DataFrame, DataFrame]:
    """``pages`` with ``host, path, rule, verdict`` -> also the mined rules ``(items, verdict, support, confidence)``.

    A URL that a given rule fits has that rule's verdict (the longest wins). All others have the verdict of the mined rule
    with the highest confidence, then support, then ``block``, among those whose items they hold; without any, the more
    frequent label, and ``default`` if there are no labels or as many of each. Rules are mined from ``labels(url, label)``
    or, without it, from all URLs that given rules fit.

    Every row is judged; repeated rows each. A NULL URL, or one without ``://``, has an empty host and path, fits no given
    rule and goes by mined rules. Columns of ``pages`` named like the added ones are replaced, others stay. An empty
    table stays empty. Very long URLs are read whole; tokens that few URLs hold play no part.
    """
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "row")]
    told = fitting_rule(host_of(url), path_of(url), rules)
    read = settle(pages.select(F.struct(*own).alias("page"), F.col(url).alias("url"), F.monotonically_increasing_id().alias("row")), "urls")
    judged = read.select("row", url_tokens("url").alias("tokens"), fitting_rule(host_of("url"), path_of("url"), rules).alias("told"))
    if labels is None:
        labelled = judged.where("told IS NOT NULL").select("row", "tokens", F.col("told.verdict").alias("label"))
    else:
        labelled = labels.where("label IS NOT NULL").select(F.monotonically_increasing_id().alias("row"), url_tokens(url).alias("tokens"), "label")
    labelled = settle(labelled, "labelled")
    sizes = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    total = sum(sizes.values())
    most = sorted(sizes, key=sizes.get, reverse=True)
    usual = default if not most or len(most) > 1 and sizes[most[0]] == sizes[most[1]] else most[0]
    items = settle(token_items(labelled, max(1, -int(-min_support * total // 1))), "items")
    mined = mine_rules(labelled, items, min_support, min_confidence)
    index = settle(rule_index(mined, items), "rule-index")
    sets = settle(item_sets(judged.where("told IS NULL"), items), "item-sets")
    decided = settle(look_up(sets.select("items"), index), "decided")
    verdicts = sets.join(decided, "items").select("row", F.col("best.verdict").alias("mined"))
    whole = read.withColumn("told", fitting_rule(host_of("url"), path_of("url"), rules)).join(verdicts, "row", "left")
    out = whole.select(
        *[F.col("page")[c].alias(c) for c in own], host_of("url").alias("host"), path_of("url").alias("path"),
        F.col("told.rule").alias("rule"), F.coalesce("told.verdict", "mined", F.lit(usual)).alias("verdict"),
    )
    return out, mined
