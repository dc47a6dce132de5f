"""Main text of web pages by equivalence-class template deduction over the pages of a host.

Tokens are elements with their path, and whole text blocks outside articles. Tokens with the same occurrence vector, their
counts on every page of the host, are one equivalence class. A class is valid where its tokens come in one order on its
pages; valid classes nest by the paths of their tokens into the host's template, whose slots hold what differs.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import arrow_rows, cut

#: Least share of a host's pages that a class occurs on, and of its pages that have its tokens in the commonest order.
SUPPORT, ORDERED = 0.3, 0.9
#: Different pages of a host that a text has to stand on, as on all others, to count as template text.
TEXT_PAGES = 3
#: Least share of the text in slots that the main slot holds where no article or main element marks it.
MAIN_SHARE = 0.6
#: Templates of up to this many bytes are broadcast; beyond it pages and templates are joined by host.
BROADCAST_BYTES = 8 << 20

# HTML element and class names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select "
    "summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
DROPPED = frozenset("head nav footer aside form button select option menu dialog svg object canvas audio video fieldset label input search".split())
HOLDERS = frozenset("article body center div main section table tbody td".split())
# what labels a slot as menu, header, footer, sidebar, notice, advert, form or readers' comments
SLOT_NAMES = (
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pager pagination footer sidebar side notice notices alert cookie cookies consent gdpr "
    "ad ads advert adverts advertisement sponsor sponsored promo banner form signup login subscribe newsletter comment comments respond reply replies disqus"
).split()
HEADER_NAMES = "header masthead topbar head".split()
# what a name may hold beside one of those: where it stands, what kind of box it is; any other word makes it a name of its own
PLACE_NAMES = (
    "site page main top bottom left right upper lower global primary secondary sub mini sticky fixed floating inline mobile desktop "
    "bar box block container wrapper wrap outer inner area section region panel widget list item items link links group holder slot unit popup modal overlay toggle button"
).split()
# readers' comments may be named after what they are on, and articles within these are comments
COMMENT_NAMES, COMMENTED_NAMES = "comment comments respond reply replies disqus".split(), "post entry article reader readers user blog".split()
TALK_NAMES = "discussion discussions thread threads responses feedback".split()

TAG = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>", re.S)
ATTR = re.compile(r"(?:^|\s)(class|id|role)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def label_of(name: str) -> str:
    """What a class or id labels a slot as: "slot", "header", "talk", or nothing.

    All words of the name have to be known: a telling one, and otherwise only words for places and boxes, or numbers. So
    site-footer, commentList and ad-box-2 label a slot; form-of-government, side-effects, ad-hoc and platform-notice do not.
    """
    words = [w.lower() for w in NAME_PART.findall(name)]
    other = {w for w in words if not w.isdigit()} - set(PLACE_NAMES)
    if other and other <= set(SLOT_NAMES) | set(HEADER_NAMES):
        return "slot" if other & set(SLOT_NAMES) else "header"
    if other & set(COMMENT_NAMES) and other <= {*COMMENT_NAMES, *COMMENTED_NAMES}:
        return "slot"
    return "talk" if other and other <= set(TALK_NAMES) else ""


class Node:
    """An open element: its name, the token of its path and its parent's, whether its label or an ancestor's is none of the article's, and whether articles in it are comments."""

    __slots__ = ("name", "token", "parent", "label", "dropped", "inside", "talk")

    def __init__(self, name: str, token: int, parent: int, label: str, dropped: bool, inside: bool, talk: bool):
        self.name, self.token, self.parent, self.label, self.dropped, self.inside, self.talk = name, token, parent, label, dropped, inside, talk


class Paths:
    """Path tokens of elements, kept for a task: most pages of a host share them."""

    def __init__(self):
        self.seen: dict[tuple, Node] = {}
        self.root = Node("", 0, 0, "", False, False, False)

    def child(self, parent: Node, name: str, attrs: str) -> Node:
        key = (parent.token, name, attrs if ("class" in attrs or "id" in attrs or "role" in attrs) else "")
        if (node := self.seen.get(key)) is not None:
            return node
        named = {k.lower(): a or b or c for k, a, b, c in ATTR.findall(attrs)} if attrs else {}
        label = f"{parent.label}/{name}" + (f".{named.get('class')}" if named.get("class") else "")
        inside = parent.inside or name in ("article", "main") or named.get("role") == "main"
        words = [] if name in ("html", "body", "article", "main") else " ".join(filter(None, (named.get("class"), named.get("id")))).split()
        labels = {label_of(w) for w in words}
        dropped = parent.dropped or name in DROPPED or "slot" in labels or (parent.talk and name == "article")
        dropped |= not inside and (name == "header" or "header" in labels)
        token = xxhash.xxh64_intdigest(label.encode("utf-8", "surrogatepass")) >> 1
        node = Node(name, token, parent.token, label, dropped, inside, parent.talk or "talk" in labels)
        if len(self.seen) > 200_000:
            self.seen.clear()
        self.seen[key] = node
        return node


def blocks(page: str, paths: Paths) -> tuple[list[tuple[list[Node], str]], dict[int, list]]:
    """The text blocks of a page as (open elements, text), in page order; and of each path token, in order of first occurrence, [node, times, length of the texts below that no label drops]."""
    stack, found, seen = [paths.root], [], {}
    run: list[str] = []
    at = 0

    def flush() -> None:
        if run:
            text = " ".join(entities.unescape("".join(run)).split())
            run.clear()
            if text:
                found.append((stack[1:], text))
                for node in stack[1:] if not stack[-1].dropped else ():
                    seen[node.token][2] += len(text)

    while m := TAG.search(page, at):
        if m.start() > at:
            run.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name in BLOCK or name == "br":
                flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    flush() if any(x.name in BLOCK for x in stack[k:]) else None
                    del stack[k:]
                    break
                if name not in BLOCK and stack[k].name in BLOCK:
                    break
            continue
        if name in BLOCK:
            flush()
            shut = CLOSES.get(name, ())
            for k in range(len(stack) - 1, 0, -1):
                open_ = stack[k].name
                if open_ == "p" or open_ in shut:
                    del stack[k:]
                    break
                if open_ in BLOCK and not (shut and open_ in ("p", "b")):
                    break
        elif name == "br":
            run.append(" ")
        attrs = m[3] or ""
        node = paths.child(stack[-1], name, attrs)
        entry = seen.setdefault(node.token, [node, 0, 0])
        entry[1] += 1
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            close = page.find(">", end.end()) if end else -1
            at = close + 1 if close >= 0 else len(page)
        elif name not in VOID and not attrs.rstrip().endswith("/"):
            stack.append(node)
    if at < len(page):
        run.append(page[at:])
    flush()
    return found, seen


def text_token(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


OCCURRENCES = "host string, page long, token long, parent long, label string, name string, times int, dropped boolean, chars long"
CLASSES = "host string, vector decimal(38,0), members array<long>"
ORDERS = "host string, vector decimal(38,0), shape long, n long"
TEMPLATE = "host string, main array<long>, static array<long>"


def _batch(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    paths = Paths()
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.int64()]
    for batch in batches:
        rows: list[tuple] = []
        for host, key, page in zip(*(batch.column(k).to_pylist() for k in range(3))):
            found, seen = blocks(page, paths)
            rows += [(host, key, t, node.parent, node.label, node.name, n, node.dropped, chars) for t, (node, n, chars) in seen.items()]
            texts = Counter(text_token(text) for nodes, text in found if not (nodes and (nodes[-1].inside or nodes[-1].dropped)))
            rows += [(host, key, t, 0, "", "#text", n, False, 0) for t, n in texts.items()]
        yield _batch(rows, types, ["host", "page", "token", "parent", "label", "name", "times", "dropped", "chars"])


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each class of a host has its path tokens in which order of first occurrence."""
    paths, counts = Paths(), Counter()
    for batch in batches:
        for host, page, vectors, members in zip(*(batch.column(k).to_pylist() for k in range(4))):
            _, seen = blocks(page, paths)
            place = {t: k for k, t in enumerate(seen)}
            for vector, tokens in zip(vectors or (), members or ()):
                here = sorted((t for t in tokens if t in place), key=place.__getitem__)
                if here:
                    counts[host, vector, xxhash.xxh64_intdigest(repr(here).encode()) >> 1] += 1
    rows = [(*k, n) for k, n in counts.items()]
    yield _batch(rows, [pa.string(), pa.decimal128(38, 0), pa.int64(), pa.int64()], ["host", "vector", "shape", "n"])


def template(tokens: pd.DataFrame) -> tuple[list[int], list[int]]:
    """(main slots, best first; template texts) of one host from its tokens in valid classes.

    tokens: vector, token, parent, label, name, dropped, chars, n_pages, total, pages, different. The nested template
    is made of the classes whose tokens all occur once on each of their pages; a slot is what an element of it holds
    beside the elements below that are in it too. The main slot is the article or main element in it with most text;
    else the innermost holder in it that keeps MAIN_SHARE of the text of its slots, so that what lies beside it falls away.
    """
    once = tokens[tokens.groupby("vector")["total"].transform("sum") == tokens.groupby("vector")["n_pages"].transform("sum")]
    paths = once[(once.name != "#text") & ~once.dropped & once.name.isin(HOLDERS)]
    marked = paths[paths.name.isin(["article", "main"])].sort_values(["chars", "label"], ascending=[False, True])
    above = dict(zip(tokens.token, tokens.parent))

    def depth(t: int) -> int:
        n = 0
        while t in above:
            t, n = above[t], n + 1
        return n

    held = paths[(paths.chars > 0) & (paths.chars >= MAIN_SHARE * (paths.chars.max() if len(paths) else 0))]
    held = held.assign(depth=[depth(t) for t in held.token]).sort_values(["depth", "chars", "label"], ascending=[False, False, True])
    main = list(dict.fromkeys([*marked.token.tolist(), *held.token.tolist()]))
    static = once[(once.name == "#text") & (once.n_pages == once.pages) & (once.different >= TEXT_PAGES)]
    return main, sorted(static.token.tolist())


def templates(pages: DataFrame) -> DataFrame:
    """(host, main tokens, static text tokens) from pages (host, page, html).

    The occurrence vector of a token is kept as a sum over pages of a hash of page and count, so a host of any size is
    aggregated map-side first; only tokens on SUPPORT of a host's pages go on, which are no more than a page has by a
    constant. A second reading of the pages counts the orders in which a class's tokens come.
    """
    vectors = pages.select("host", "page", "html").mapInArrow(_occurrences, OCCURRENCES).groupBy("host", "token", "parent", "label", "name", "dropped").agg(
        F.sum(F.xxhash64("page", "times").cast("decimal(20,0)")).cast("decimal(38,0)").alias("vector"), F.count("*").alias("n_pages"), F.sum("times").alias("total"), F.sum("chars").alias("chars")
    )
    sizes = pages.groupBy("host").agg(F.count("*").alias("pages"), F.count_distinct("page").alias("different"))
    tokens = cut(vectors.join(sizes, "host").where(F.col("n_pages") >= F.ceil(SUPPORT * F.col("pages"))))
    classes = tokens.where("name != '#text'").groupBy("host", "vector").agg(F.array_sort(F.collect_list("token")).alias("members"))
    by_host = cut(classes.groupBy("host").agg(F.collect_list("vector").alias("vectors"), F.collect_list("members").alias("members")))
    size = by_host.agg(F.coalesce(F.sum(F.length("host") + 16 * F.size("vectors") + 8 * F.size(F.flatten("members"))), F.lit(0))).first()[0]
    met = pages.select("host", "html").join(F.broadcast(by_host) if size <= BROADCAST_BYTES else by_host, "host", "left")
    orders = met.select("host", "html", "vectors", "members").mapInArrow(_orders, ORDERS).groupBy("host", "vector", "shape").agg(F.sum("n").alias("n"))
    mixed = orders.groupBy("host", "vector").agg((F.max("n") / F.sum("n")).alias("share")).where(F.col("share") < ORDERED)
    valid = tokens.join(mixed, ["host", "vector"], "left_anti")

    def of_host(rows: pd.DataFrame) -> pd.DataFrame:
        main, static = template(rows)
        return pd.DataFrame({"host": [rows.host.iloc[0]], "main": [main], "static": [static]})

    return valid.groupBy("host").applyInPandas(of_host, TEMPLATE)


def page_text(page: str, main: list[int], static: list[int], paths: Paths) -> str:
    """The blocks of the template's best main slot that the page has, one a line; of a page without, those of its own article or main element; else all but template texts. Labelled elements are out."""
    found, seen = blocks(page, paths)
    kept = [(nodes, text) for nodes, text in found if not (nodes and nodes[-1].dropped)]
    wanted, fixed = next((t for t in main or () if t in seen and seen[t][2]), None), set(static or ())
    slot = [(nodes, text) for nodes, text in kept if any(n.token == wanted for n in nodes)] if wanted is not None else []
    slot = slot or [(nodes, text) for nodes, text in kept if nodes and nodes[-1].inside]
    return "\n".join(text for _, text in slot or [(nodes, text) for nodes, text in kept if text_token(text) not in fixed])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    paths = Paths()
    for batch in batches:
        texts = [page_text(h, m, s, paths) for h, m, s in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page: its article without boilerplate, blocks joined by line breaks.

    The template of a page's host gives the main slot; names of elements and classes only label slots as menu, header,
    footer, sidebar, notice, advert, form or comments, never html, body, main or article, and only where all their words are known (label_of()).
    Articles within an element named as a discussion are comments. A host of one page has a
    template as well, in which every element that occurs once is one class.

    Null html is empty and gives an empty text. Pages with a null or odd url share one nameless host. Repeated
    pages count each in their host's template, as one page where different ones are counted, and each get a row; unclosed, cut or misnested markup is read
    as far as it goes; an empty table gives an empty result; other columns are ignored.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host")).withColumn("page", F.xxhash64("html"))
    arrow_rows(pages.sparkSession, 256)
    known = cut(templates(source))
    size = known.agg(F.coalesce(F.sum(F.length("host") + 8 * (F.size("main") + F.size("static"))), F.lit(0))).first()[0]
    joined = source.join(F.broadcast(known) if size <= BROADCAST_BYTES else known, "host", "left")
    return joined.select("page_id", "url", "html", "main", "static").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
