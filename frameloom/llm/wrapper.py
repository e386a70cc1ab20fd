"""Main text of web pages by wrappers inferred per host.

A page is read as nested elements. The pages of a host are aligned one after the other with what is known so far, as a
union-free regular expression: what occurs on one side only becomes optional, equal neighbours become a repeated group,
texts that differ become slots, and texts that never differ stay as template. The host's rules follow from its wrapper:
where the article is, what beside it differs from page to page as prose does, which texts are template although they stand
inside it, and which elements inside it are lists of links.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.llm.common import as_bytes
from frameloom.operators.spread import settle

TEMPLATE_PAGES = 4  # different pages that must agree on a text before it counts as template
MERGE_FAN_IN = 64
MOST_CHILDREN = 64  # children of a wrapper's node beyond which the optional ones become one group by element
BODY_SHARE = 0.7  # of a host's text, that the innermost article container must hold

# Fixed values of HTML: elements without content, inside a line of text, with raw content, and what closes by itself.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = set("script style textarea title noscript iframe template svg math".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

# What is never part of an article: by element, and by a word of class, id or role.
OUTSIDE = set("script style noscript template iframe svg math head title nav footer aside form button select textarea input label fieldset dialog menu object canvas audio video".split())
NAMED = set(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer sidebar aside widget ad ads advert adverts advertisement"
    " advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert newsletter subscribe"
    " subscription signup popup modal overlay share sharing social related recommended recommendations comment comments commentlist disqus reply"
    " replies respond discussion form search login toolbar pagination pager copyright legal skip hidden".split()
)
ARTICLE = "article", "main"
#: Names that also mark the layout around an article: they do not count if an article stands inside.
LAYOUT = set("nav navbar navigation menu header topbar sidebar aside banner hidden search skip notice alert login ad ads".split())
#: Names that an article may give to parts of its own text: inside an article they count only with the wrapper's evidence.
WEAK = set(
    "share sharing social related recommended recommendations reply discussion form search login notice notices notification alert legal"
    " copyright banner promo promotion skip pager pagination toolbar widget overlay modal masthead topbar".split()
)
DEPTH = 200  # elements nested deeper are read as part of the one at this depth

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S)
NAMES = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORDS = re.compile(r"[a-z]+")


class Element:
    __slots__ = ("tag", "key", "outside", "layout", "parent", "children")

    def __init__(self, tag: str, attributes: str, parent: Element | None):
        names: list[str] = []
        hidden = False
        for name, *values in NAMES.findall(attributes) if attributes else ():
            value = "".join(values).lower()
            if name.lower() in ("class", "id", "role"):
                names += WORDS.findall(value)
            else:
                hidden = hidden or name.lower() == "hidden" or (name.lower() == "aria-hidden" and value == "true") or "display:none" in value.replace(" ", "")
        article = parent is not None and ("/article" in parent.key or "/main" in parent.key)
        self.tag = tag
        self.key = f"{parent.key if parent else ''}/{'.'.join([tag, *names[:4]])}"
        told = {n for n in names if n in NAMED} if tag not in ("html", "body", *ARTICLE) else set()
        told -= {"header", *WEAK} if article else set()
        fixed = hidden or tag in OUTSIDE or (tag == "header" and not article)
        inherited = parent is not None and parent.outside
        self.outside = fixed or bool(told) or inherited
        self.layout = not fixed and told <= LAYOUT and (not inherited or parent.layout)  # outside by layout names only
        self.parent = parent
        if tag in ARTICLE and inherited and self.layout:
            above: Element | None = self
            while above is not None:
                above.outside, above = False, above.parent
        self.children: list[Element | str] = []


def parse(page: str) -> Element:
    """The elements of a page. Open paragraphs end at the next block, unknown ends are ignored; nothing fails."""
    root = Element("", "", None)
    root.key = ""
    stack = [root]
    raw = None
    for token in TOKEN.finditer(page):
        text = token[0]
        closing, tag = token[1], (token[2] or "").lower()
        if raw:
            if closing and tag == raw:
                raw = None
                stack.pop()
            continue
        if not tag:
            if text[0] != "<" or text == "<":
                stack[-1].children.append(text)
            continue
        if closing:
            for at in range(len(stack) - 1, 0, -1):
                if stack[at].tag == tag:
                    del stack[at:]
                    break
            continue
        ends = CLOSES.get(tag, ())
        if tag not in INLINE and tag not in RAW:
            for at in range(len(stack) - 1, 0, -1):
                if stack[at].tag == "p" or stack[at].tag in ends:
                    del stack[at:]
                    break
                if stack[at].tag not in INLINE:
                    break
        element = Element(tag, token[3], stack[-1])
        stack[-1].children.append(element)
        if tag not in VOID and not token[3].endswith("/") and (len(stack) < DEPTH or tag in RAW):
            stack.append(element)
            raw = tag if tag in RAW else None
    return root


def blocks(root: Element) -> Iterator[tuple[Element, str]]:
    """Text blocks outside of menus and the like, in page order, with the element that holds their beginning."""
    held: list[str] = []
    owner = root

    def flush() -> Iterator[tuple[Element, str]]:
        text = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        if text:
            yield owner, text

    todo: list[tuple[Element, int]] = [(root, 0)]
    while todo:
        node, at = todo.pop()
        if at == len(node.children):
            if node.tag not in INLINE:
                yield from flush()
            continue
        todo.append((node, at + 1))
        child = node.children[at]
        if isinstance(child, str):
            if not held:
                owner = node
            held.append(child)
        elif child.tag == "br":
            held.append(" ")
        elif not child.outside:
            if child.tag not in INLINE:
                yield from flush()
            todo.append((child, 0))
        elif child.tag not in INLINE and child.tag not in RAW:
            yield from flush()


# A wrapper node is [key, optional, repeated, text, words, children, pages]. text: None if there is none, a digest as long as
# all texts agreed, "*" for a slot. pages: digests of a few different pages that carried this very text, none for a slot.
# A wrapper is {"pages": digests of a few different pages, "root": node}.


def _digest(text: str) -> str:
    return xxhash.xxh64_hexdigest(text)


def _observed(node: Element, texts: dict[int, list[str]], page: str) -> list:
    own = texts.get(id(node), [])
    text = None if not own else _digest(own[0]) if len(own) == 1 else "*"
    children = [_observed(c, texts, page) for c in node.children if isinstance(c, Element) and not c.outside and c.tag != "br"]
    return [node.key, False, False, text, sum(t.count(" ") + 1 for t in own), _grouped(children), [page] if text not in (None, "*") else []]


def _grouped(nodes: list[list]) -> list[list]:
    """Equal neighbours become one repeated group."""
    out: list[list] = []
    for node in nodes:
        if out and out[-1][0] == node[0]:
            last = _aligned(out[-1], node)
            last[2] = True
            last[1] = out[-1][1] and node[1]
            out[-1] = last
        else:
            out.append(node)
    return out


def _aligned(a: list, b: list) -> list:
    """Align two nodes with the same key; what only one side has becomes optional."""
    text = a[3] if a[3] == b[3] else "*"
    pages = sorted({*a[6], *b[6]})[:TEMPLATE_PAGES] if text != "*" else []
    left, right = a[5], b[5]
    keys_a, keys_b = [n[0] for n in left], [n[0] for n in right]
    if keys_a == keys_b:
        children = [_aligned(x, y) for x, y in zip(left, right)]
    else:
        children = []
        for kind, i, j, k, m in SequenceMatcher(None, keys_a, keys_b, autojunk=False).get_opcodes():
            if kind == "equal":
                children += [_aligned(x, y) for x, y in zip(left[i:j], right[k:m])]
            else:
                children += [[n[0], True, *n[2:]] for n in left[i:j] + right[k:m]]
        children = _folded(_grouped(children), a[0])
    return [a[0], a[1] or b[1], a[2] or b[2], text, a[4] + b[4], children, pages]


def _folded(nodes: list[list], above: str) -> list[list]:
    """Beyond ``MOST_CHILDREN`` the optional nodes of an element are one repeated slot, so a wrapper grows with the template only."""
    if len(nodes) <= MOST_CHILDREN:
        return nodes
    out: list[list] = []
    slots: dict[str, list] = {}
    for node in nodes:
        tag = _tag(node)
        if not node[1] or _is_template(node):
            out.append(node)
        elif tag in slots:
            slots[tag][4] += _total(node)
        else:
            slots[tag] = [f"{above}/{tag}", True, True, "*", _total(node), [], []]
            out.append(slots[tag])
    return out


def observe(page: str) -> dict:
    root = parse(page)
    texts: dict[int, list[str]] = {}
    for owner, text in blocks(root):
        texts.setdefault(id(owner), []).append(text)
    own = _digest(page)
    return {"pages": [own], "root": _observed(root, texts, own)}


def align(a: dict, b: dict) -> dict:
    """What two wrappers of a host have in common; pages that are equal count once."""
    return {"pages": sorted({*a["pages"], *b["pages"]})[:TEMPLATE_PAGES], "root": _aligned(a["root"], b["root"])}


def expression(node: list) -> str:
    """The wrapper as a regular expression over elements; ``#`` is a text slot."""
    inner = ("#" if node[3] == "*" else "text" if node[3] else "") + "".join(expression(c) for c in node[5])
    name = node[0].rpartition("/")[2]
    body = f"<{name}>{inner}</{name}>" if name else inner
    mark = {(True, True): "*", (True, False): "?", (False, True): "+", (False, False): ""}[node[1], node[2]]
    return f"({body}){mark}" if mark else body


def _total(node: list) -> int:
    return node[4] + sum(map(_total, node[5]))


def _is_template(node: list) -> bool:
    return node[3] not in (None, "*") and len(node[6]) >= TEMPLATE_PAGES


def _fixed(node: list) -> int:
    return (node[4] if _is_template(node) else 0) + sum(map(_fixed, node[5]))


def _tag(node: list) -> str:
    return node[0].rpartition("/")[2].split(".")[0]


def _linked(node: list) -> int:
    """Words of blocks that begin inside a link."""
    return _total(node) if _tag(node) == "a" else sum(map(_linked, node[5]))


def _is_prose(node: list) -> bool:
    """A paragraph whose text differs from page to page."""
    return (_tag(node) == "p" and node[3] == "*") or any(map(_is_prose, node[5]))


def _inner(node: list) -> list | None:
    """The child that holds most of the text, if all text beside it is template."""
    total, fixed = _total(node), _fixed(node)
    for child in node[5]:
        held = _total(child)
        if child[5] and 2 * fixed < total and held >= BODY_SHARE * total and total - held == fixed - _fixed(child):
            return child
    return None


def rules(wrapper: dict) -> dict:
    """``{"inside": path or "", "beside": [path, ...], "links": [path, ...], "template": [[path, digest], ...]}`` for a host.

    The article is the first article or main element of the wrapper, else the innermost element that holds most of its
    text and has nothing but template beside it. Neighbours of an article element belong to it if they hold paragraphs that
    differ from page to page and are not mostly links. Elements with a ``WEAK`` name inside an article go if they are mostly
    links. Template is a text that enough different pages carry in that element, unless it would take most of the article
    with it: then the pages are copies of each other and nothing is template.
    """
    node, found, above = wrapper["root"], None, None
    todo: list[tuple[list, list | None]] = [(node, None)]
    while todo and found is None:
        top, parent = todo.pop(0)
        if _tag(top) in ARTICLE:
            found, above = top, parent
        todo += [(child, top) for child in top[5]]
    if found is None:
        found = node
        while inner := _inner(found):
            found = inner
    near = [n for n in above[5] if _tag(n) not in ARTICLE and _is_prose(n) and 2 * _linked(n) <= _total(n)] if above else []
    template: list = []
    links: list = []
    words = fixed = 0
    walk = [found, *near]
    while walk:
        top = walk.pop()
        words += top[4]
        if _is_template(top):
            template.append([top[0], top[3]])
            fixed += top[4]
        if WEAK & {*top[0].rpartition("/")[2].split(".")[1:]} and 2 * _linked(top) > _total(top):
            links.append(top[0])
        walk += top[5]
    kept = sorted(template) if 2 * fixed < words else []
    return {"inside": found[0], "beside": sorted({n[0] for n in near}), "links": sorted({*links}), "template": kept}


def _within(key: str, paths: list[str]) -> bool:
    return any(key == p or key.startswith(p + "/") for p in paths)


def extract(page: str, host: dict) -> str:
    """The article's blocks joined by line ends. Without the host's place on this page, all blocks outside of menus.

    A page's own article elements come before the host's place; a main element that holds at least half of their text
    stands for all of them, so that teasers beside it go.
    """
    found = [(owner.key, text) for owner, text in blocks(parse(page))]
    template = {(p, d) for p, d in host["template"]}
    beside, links = host.get("beside", []), host.get("links", [])
    article, main = (re.compile(rf"/(?:{names})(?:[./]|$)") for names in ("|".join(ARTICLE), "main"))
    marked = {i for i, (k, _) in enumerate(found) if article.search(k)}
    in_main = {i for i in marked if main.search(found[i][0])}
    if 2 * sum(len(found[i][1]) for i in in_main) >= sum(len(found[i][1]) for i in marked):
        marked = in_main or marked
    if marked:
        inside = [(k, t) for i, (k, t) in enumerate(found) if i in marked or _within(k, beside)]
    else:
        inside = [(k, t) for k, t in found if _within(k, [host["inside"]])] or found
    return "\n".join(t for k, t in inside if not _within(k, links) and (not template or (k, _digest(t)) not in template))


def _decoded(body: bytes) -> str:
    return body.decode("utf-8", "replace")


def host_of(url: str) -> Column:
    """Scheme, port and user left out, lower case; empty for NULL or without a host."""
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def wrappers(pages: DataFrame) -> DataFrame:
    """``pages(host, body)`` -> ``(host, wrapper)``, every page of a host aligned.

    A task aligns the pages it has into one wrapper per host, so what is shuffled is wrappers. They merge in two steps
    of a tree, by part and then by host: a host with a third of all pages has as many wrappers as there were tasks.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict] = {}
        for batch in batches:
            for host, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen = observe(_decoded(body))
                held[host] = align(held[host], seen) if host in held else seen
        part = TaskContext.get().partitionId() // MERGE_FAN_IN
        yield pa.RecordBatch.from_pydict(
            {"host": pa.array(list(held), pa.string()), "part": pa.array([part] * len(held), pa.int32()), "wrapper": pa.array([json.dumps(w) for w in held.values()], pa.string())}
        )

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        out: dict | None = None
        for text in sorted(rows["wrapper"]):
            seen = json.loads(text)
            out = align(out, seen) if out else seen
        return pd.DataFrame({"host": rows["host"].iloc[:1], "part": rows["part"].iloc[:1], "wrapper": [json.dumps(out)]})

    schema = "host string, part int, wrapper string"
    first = pages.select("host", "body").mapInArrow(partial, schema)
    second = first.groupBy("host", "part").applyInPandas(merged, schema)
    return second.groupBy("host").applyInPandas(merged, schema).select("host", "wrapper")


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page row: ``page_id, url, text``.

    NULL html is an empty page with an empty text. Pages without a host are aligned with each other. Repeated rows each
    keep theirs. Broken markup is read as far as it makes sense and never fails.
    """

    @F.pandas_udf("string")
    def ruled(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: json.dumps(rules(json.loads(t))))

    @F.pandas_udf("string")
    def text(bodies: pd.Series, hosts: pd.Series) -> pd.Series:
        known = {h: json.loads(h) for h in hosts.unique()}
        return pd.Series([extract(_decoded(b), known[h]) for b, h in zip(bodies, hosts)], dtype=object)

    named = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), host_of(url).alias("host"), as_bytes(html).alias("body"))
    known = settle(wrappers(named).select("host", ruled("wrapper").alias("rules")), "host-rules")
    return named.join(known, "host").select("page_id", "url", text("body", "rules").alias("text"))
