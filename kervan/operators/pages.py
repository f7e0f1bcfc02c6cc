"""HTML pages as a node table, parsed once; every page job is a query on it.

Node table: page_id, node_id (= pre, document order), parent_id, pre, post (pre of the last node inside), depth, tag,
cls, id, attrs, text (of text nodes, and of headings, titles, cells, labels, options, captions and links as a whole),
subtree_len, block (changes at block tags), cell (changes at table cells), table_no, row_no, col_no, starts and ends (pre
and post of the 1st to 4th ancestor). Texts are NFKC-normalised while parsing, so no later job needs a second Python stage. Node a holds node b if they are of one page and a.pre < b.pre <= a.post.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import extract as E
from ..functions import urls as U
from ..functions import vocabulary as V
from ..functions.text import fingerprint, first_line, lower_tr, match_key, strip_boilerplate, tidy
from ..session import broadcast_small

NODE_SCHEMA = (
    "page_id long, node_id int, parent_id int, pre int, post int, depth int, tag string, cls string, id string, attrs map<string,string>, text string, "
    "subtree_len int, block int, cell int, table_no int, row_no int, col_no int, starts array<int>, ends array<int>"
)
_VOID = {"br", "img", "input", "meta", "link", "hr", "area", "base", "col", "embed", "source", "track", "wbr"}
_WHOLE_TEXT = {"h1", "h2", "h3", "h4", "h5", "h6", "title", "td", "th", "caption", "label", "option", "a", "strong", "b", "dt", "span", "em"}
_RAW = {"script", "style"}
# Tags in their plainest form, which most are: read by one expression, with the same result as the library's several.
_PLAIN_START = re.compile(r'<([a-z][a-z0-9]*)((?: [a-z][a-z-]*="[^"&<>]*")*)>')
_PLAIN_ATTR = re.compile(r' ([a-z-]+)="([^"]*)"')
_PLAIN_END = re.compile(r"</([a-z][a-z0-9]*)>")
#: Nodes that are turned into one Arrow batch, beside those of the last page.
NODES_AT_ONCE = 4_000
_NO_ZERO_WIDTH = dict.fromkeys(map(ord, V.ZERO_WIDTH))

# Rules of the HTML standard for trees from tags that do not match.
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_CELLS = {"td", "th", "caption"}
_TABLE_PARTS = {"table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup", "col"}
_NOT_IN_TABLE = {"table", "thead", "tbody", "tfoot", "tr"}  # may hold no text of their own
_ALLOWED_IN_TABLE = _TABLE_PARTS | {"script", "style", "template", "form"}
_INLINE = {"a", "b", "big", "code", "em", "font", "i", "nobr", "s", "small", "span", "strike", "strong", "tt", "u"}
_CLOSES_P = {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "ul",
}
_BLOCKS = _CLOSES_P | {"li", "dt", "dd", "body"} | _TABLE_PARTS
#: Start tag: the elements that it ends, and those that it does not look beyond.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "table"} | _CELLS),
    "dt": ({"dt", "dd"}, {"dl", "table"} | _CELLS),
    "dd": ({"dt", "dd"}, {"dl", "table"} | _CELLS),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    **{tag: ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}) for tag in ("thead", "tbody", "tfoot")},
    **{tag: ({"p"}, {"button", "table"} | _CELLS) for tag in _CLOSES_P},
}


class _Element:
    __slots__ = ("attrs", "children", "ended", "parent", "tag", "text")

    def __init__(self, tag: str, attrs: dict, text: str | None = None):
        self.tag, self.attrs, self.text, self.children, self.parent, self.ended = tag, attrs, text, [], None, False


class _Tree(HTMLParser):
    """One page's elements. Start tags end what cannot hold them (list items, cells, paragraphs before blocks); an end tag
    does not reach out of a table cell; an inline end tag inside a block waits for the block's end; what a table may not hold
    goes before it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Element("", {})
        self.stack = [self.root]

    def _add(self, node: _Element) -> None:
        parent, place = self.stack[-1], None
        if parent.tag in _NOT_IN_TABLE and node.tag not in _ALLOWED_IN_TABLE and not (node.tag == "input" and node.attrs.get("type", "").lower() == "hidden"):
            table = next((x for x in reversed(self.stack) if x.tag == "table"), None)
            if table is not None:
                parent = table.parent
                place = max(k for k, x in enumerate(parent.children) if x is table)
        node.parent = parent
        parent.children.insert(len(parent.children) if place is None else place, node)

    def _cut(self, depth: int) -> None:
        del self.stack[depth:]
        while self.stack[-1].ended:
            self.stack.pop()

    def parse_starttag(self, i):
        plain = _PLAIN_START.match(self.rawdata, i)
        if plain is None or self.cdata_elem is not None or plain[1] in HTMLParser.CDATA_CONTENT_ELEMENTS:
            return super().parse_starttag(i)
        self.lasttag = plain[1]
        self.handle_starttag(plain[1], _PLAIN_ATTR.findall(plain[2]))
        return plain.end()

    def parse_endtag(self, i):
        plain = _PLAIN_END.match(self.rawdata, i)
        if plain is None or self.cdata_elem is not None:
            return super().parse_endtag(i)
        self.handle_endtag(plain[1])
        return plain.end()

    def handle_starttag(self, tag, attrs):
        ends, stops = _ENDS.get(tag, ((), ()))
        found = 0
        for k in range(len(self.stack) - 1, 0, -1) if ends else ():
            if self.stack[k].tag in stops:
                break
            if self.stack[k].tag in ends:
                found = k
        if found:
            self._cut(found)
        if tag in _HEADINGS and self.stack[-1].tag in _HEADINGS:
            self._cut(len(self.stack) - 1)
        node = _Element(tag, {k: v or "" for k, v in attrs})
        self._add(node)
        if tag not in _VOID:
            self.stack.append(node)

    def handle_endtag(self, tag):
        stops = () if tag == "table" or tag in ("body", "html") else {"table"} if tag in _TABLE_PARTS else {"table"} | _CELLS
        for k in range(len(self.stack) - 1, 0, -1):
            node = self.stack[k]
            if node.tag == tag:
                if tag in _INLINE and any(x.tag in _BLOCKS for x in self.stack[k + 1 :]):
                    node.ended = True
                else:
                    self._cut(k)
                return
            if node.tag in stops:
                return

    def handle_data(self, data):
        if not data.isascii():
            data = unicodedata.normalize("NFKC", data.translate(_NO_ZERO_WIDTH))
        if self.stack[-1].tag not in _RAW and data.strip():
            self._add(_Element("#text", {}, data))

    def finish(self) -> list[tuple]:
        self.close()
        return _numbered(self.root)


def _numbered(root: _Element) -> list[tuple]:
    """The rows of a tree in document order, as in NODE_SCHEMA without page_id."""
    rows: list[list] = []
    pieces: list[str] = []
    block = cell = tables = 0
    place: list[list[int]] = []  # table, row, column of the open tables
    open_rows: list[list] = []
    work = list(reversed(root.children))
    while work:
        node = work.pop()
        if node is None:  # the end of the last open element
            row = open_rows.pop()
            row[4] = len(rows) - 1
            if open_rows:
                open_rows[-1][10] += row[10]
            tag = row[5]
            if tag in _WHOLE_TEXT:
                row[9] = " ".join(" ".join(pieces[row[17] :]).split())
            if tag == "table":
                place.pop()
            block += tag in V.BLOCK_TAGS
            cell += tag in ("td", "th")
            continue
        tag, n = node.tag, len(rows)
        node.parent = None  # no cycles: the tree's memory goes with the tree
        block += tag in V.BLOCK_TAGS
        cell += tag in ("td", "th")
        if tag == "table":
            tables += 1
            place.append([tables, 0, 0])
        elif place and tag == "tr":
            place[-1][1] += 1
            place[-1][2] = 0
        elif place and tag in ("td", "th"):
            place[-1][2] += 1
        size = len(" ".join(node.text.split())) if tag == "#text" else 0
        a = node.attrs
        row = [n, open_rows[-1][0] if open_rows else None, n, len(open_rows), n, tag, a.get("class"), a.get("id"), a, node.text, size, block, cell, *(place[-1] if place else (None, None, None)), [x[0] for x in open_rows[-1:-5:-1]], len(pieces)]
        rows.append(row)
        if tag == "#text":
            pieces.append(node.text)
            if open_rows:
                open_rows[-1][10] += size
        elif tag not in _VOID:
            open_rows.append(row)
            work.append(None)
            work.extend(reversed(node.children))
    return [(r[0], r[1], r[2], r[4], r[3], *r[5:13], *r[13:16], r[16], [rows[u][4] for u in r[16]]) for r in rows]


def page_nodes(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", tags: tuple[str, ...] = (), columns: tuple[str, ...] = ()) -> DataFrame:
    """One row per element and non-blank text of each page; a null page has none. Jobs that look at some tags or columns alone
    name them, so that the other rows and cells are not made."""
    fields = [f for f in NODE_SCHEMA.split(", ") if not columns or f.split()[0] in columns]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, html in zip(batch.column(0), batch.column(1)):
                parser = _Tree()
                parser.feed(html.as_py() or "")
                key = key.as_py()
                out += [(key, *row) for row in parser.finish() if not tags or row[5] in tags]
                if len(out) > NODES_AT_ONCE:
                    yield _batch(out, fields)
                    out = []
            if out:
                yield _batch(out, fields)

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html")).mapInArrow(parse, ", ".join(fields))


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}


def _batch(rows: list[tuple], fields: list[str]) -> pa.RecordBatch:
    """Rows in the order of NODE_SCHEMA as an Arrow batch of the given fields."""
    names = [f.split()[0] for f in NODE_SCHEMA.split(", ")]
    asked = dict(f.split() for f in fields)
    cells = [(n, asked[n], c) for n, c in zip(names, zip(*rows)) if n in asked]
    return pa.record_batch([_maps(c) if kind.startswith("map") else pa.array(c, _ARROW[kind]) for _, kind, c in cells], [n for n, _, _ in cells])


def _maps(dicts: tuple[dict, ...]) -> pa.Array:
    ends = np.cumsum([0, *map(len, dicts)], dtype=np.int32)
    keys, values = (pa.array(list(chain.from_iterable(x)), pa.string()) for x in (dicts, (d.values() for d in dicts)))
    return pa.MapArray.from_arrays(pa.array(ends), keys, values)


def _page() -> Window:
    return Window.partitionBy("page_id")


def _upto_here(order: str = "pre") -> Window:
    return _page().orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def without_noise(nodes: DataFrame) -> DataFrame:
    """Nodes outside noise elements; forms are kept. Intervals nest, so a node lies in noise if the furthest end of the
    noise that began before it is not behind it: one running maximum per page."""
    body = F.max(F.when(F.col("tag") == "body", F.col("subtree_len"))).over(_page())
    whole = F.coalesce(body, F.max("subtree_len").over(_page()))
    structural = F.col("tag").isin(*V.STRUCTURE_NOISE) & (F.col("subtree_len") <= F.col("_whole") * V.STRUCTURE_MAX_RATIO)
    marked = F.concat_ws(" ", "cls", "id").rlike(f"(?iu){V.NOISE_ATTR}") & ~F.col("tag").isin("html", "body")
    noise = F.col("tag").isin(*V.ALWAYS_NOISE) | structural | marked
    reach = F.max(F.when(F.coalesce(noise, F.lit(False)), F.col("post"))).over(_upto_here())
    return nodes.withColumn("_whole", whole).withColumn("_reach", reach).filter("_reach IS NULL OR _reach < pre").drop("_whole", "_reach")


def main_content(nodes: DataFrame) -> DataFrame:
    """Nodes of the longest main-content element if it holds at least 30 % of the body's text, else of the body."""
    classes = F.split(F.coalesce("cls", F.lit("")), r"\s+")
    candidate = F.col("tag").isin(*V.MAIN_TAGS) | (F.col("attrs")["role"] == "main") | F.col("id").isin(*V.MAIN_IDS) | F.arrays_overlap(classes, F.array(*[F.lit(c) for c in V.MAIN_CLASSES]))
    span = F.struct("subtree_len", (-F.col("pre")).alias("first"), "pre", "post")
    best = F.max(F.when(candidate & (F.col("tag") != "#text"), span)).over(_page())
    body = F.max(F.when(F.col("tag") == "body", span)).over(_page())
    whole = F.coalesce(F.col("_body.subtree_len"), F.max("subtree_len").over(_page()))
    framed = nodes.withColumn("_best", best).withColumn("_body", body).withColumn("_whole", whole)
    use = F.when(F.col("_best.subtree_len") >= F.col("_whole") * V.MAIN_MIN_RATIO, F.col("_best")).otherwise(F.col("_body"))
    framed = framed.withColumn("_use", use)
    keep = F.col("_use").isNull() | ((F.col("pre") >= F.col("_use.pre")) & (F.col("pre") <= F.col("_use.post")))
    return framed.filter(keep).drop("_best", "_body", "_whole", "_use")


def clean_text(nodes: DataFrame, composed: bool = True) -> DataFrame:
    """page_id, clean_text: block tags break lines, table cells are set apart by ' | ', boilerplate lines go."""
    texts = nodes.filter("tag = '#text'").select("page_id", "block", "cell", "pre", F.trim(F.regexp_replace("text", r"(?U)\s+", " ")).alias("text"))
    ordered = lambda c, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", c))), lambda s: s[c]), sep)
    cells = texts.groupBy("page_id", "block", "cell").agg(ordered("text", " ").alias("text"), F.min("pre").alias("pre"))
    blocks = cells.groupBy("page_id", "block").agg(ordered("text", " | ").alias("text"), F.min("pre").alias("pre"))
    pages = blocks.groupBy("page_id").agg(ordered("text", "\n").alias("text"))
    return pages.select("page_id", strip_boilerplate(F.col("text"), composed).alias("clean_text"))


def page_titles(nodes: DataFrame, ignored: tuple[str, ...] = (), composed: bool = True) -> DataFrame:
    """page_id, title: first usable h1, else h2, else og:title, else title (the last two are not checked)."""
    key = lambda c: match_key(c, composed)
    rank = F.when(F.col("tag") == "h1", 1).when(F.col("tag") == "h2", 2).when((F.col("tag") == "meta") & (F.col("attrs")["property"] == "og:title"), 3).when(F.col("tag") == "title", 4)
    text = F.when(F.col("tag") == "meta", F.col("attrs")["content"]).otherwise(F.col("text"))
    rows = nodes.select("page_id", "pre", rank.alias("rank"), tidy(text).alias("title")).filter("rank IS NOT NULL AND title <> ''")
    usable = (F.length("title") >= 3) & ~F.col("title").rlike(V.TITLE_PLACEHOLDER) & ~lower_tr(F.col("title")).rlike(f"(?iuU){V.SECTION_HEADING}")
    if ignored:
        usable = usable & ~key(F.col("title")).isin(*ignored)
    rows = rows.filter((F.col("rank") >= 3) | usable)
    return rows.groupBy("page_id").agg(F.min_by("title", F.struct("rank", "pre")).alias("title"))


def table_cells(nodes: DataFrame) -> DataFrame:
    """page_id, table_no, row_no, col_no, text of every th and td in rows with any text."""
    cells = nodes.filter("tag IN ('td', 'th') AND table_no IS NOT NULL").select("page_id", "table_no", "row_no", "col_no", F.trim(F.coalesce("text", F.lit(""))).alias("text"))
    filled = F.max(F.length("text")).over(Window.partitionBy("page_id", "table_no", "row_no"))
    return cells.withColumn("_n", filled).filter("_n > 0").drop("_n")


_HEADING = "^h[1-6]$"


def section_anchors(nodes: DataFrame, wanted: Column | None = None) -> DataFrame:
    """page_id, pre, low, high, heading of headings (those that `wanted` is true of) with text behind them: the section is the text in
    (low, high]. It ends with the next heading, and with the parent of a block heading; an inline heading without text
    beside it looks in up to three more ancestors.

    What follows an anchor's end is found by one window per page over anchors (placed at their end), headings and texts,
    from the last to the first.
    """
    heading = F.col("tag").rlike(_HEADING)
    anchors = nodes.filter(heading | F.col("tag").isin("strong", "b", "dt", "span", "em")).withColumn("heading", lower_tr(tidy(F.col("text"))))
    anchors = anchors.filter("heading <> ''" if wanted is None else wanted)
    # A block heading reads its parent; an inline one climbs.
    ends = F.when(heading, F.slice("ends", 1, 1)).otherwise(F.slice("ends", 1, V.CLIMB_LIMIT + 1))
    none = F.lit(None)
    places = anchors.select("page_id", F.col("post").alias("at"), F.lit(0).alias("kind"), "pre", "heading", ends.alias("ends"))
    marks = nodes.filter(heading | (F.col("tag") == "#text")).select(
        "page_id", F.col("pre").alias("at"), F.when(heading, 1).otherwise(2).alias("kind"), "pre", none.cast("string").alias("heading"), none.cast("array<int>").alias("ends")
    )
    # At one place anchors come first, so that nothing at their own end counts as behind it.
    behind = _page().orderBy(F.desc("at"), "kind").rowsBetween(Window.unboundedPreceding, -1)
    nearest = lambda k: F.min(F.when(F.col("kind") == k, F.col("at"))).over(behind)
    seen = places.unionByName(marks).withColumn("_heading", nearest(1)).withColumn("_text", nearest(2)).filter("kind = 0")
    stop = F.coalesce(F.col("_heading"), F.lit(2**30)) - 1
    level = F.try_element_at(F.filter("ends", lambda e: e >= F.col("_text")), F.lit(1))
    held = seen.filter(F.col("_text") <= stop).withColumn("_level", level).filter("_level IS NOT NULL")
    return held.select("page_id", "pre", F.col("at").alias("low"), F.least("_level", stop).alias("high"), "heading")


def joined_texts(anchors: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, body of each anchor: the texts of its interval, those of one block in one line. Anchors meet texts by page."""
    texts = nodes.filter("tag = '#text'").select("page_id", F.col("pre").alias("at"), F.trim("text").alias("text"), "block")
    inside = anchors.hint("merge").join(texts, "page_id").filter("at > low AND at <= high")
    pieces = inside.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "text", "block"))).alias("p"))
    before = lambda i: F.get("p", i - 1)["block"]
    glue = lambda t, i: F.when(i == 0, "").when(before(i) == t["block"], " ").otherwise("\n")
    return pieces.select(*keys, F.array_join(F.transform("p", lambda t, i: F.concat(glue(t, i), t["text"])), "").alias("body"))


def section_texts(nodes: DataFrame, keywords: tuple[str, ...], composed: bool = True) -> DataFrame:
    """page_id, section: text under the first heading that contains a keyword, up to the next heading. The first heading
    with text wins."""
    wanted = "(?U)" + "|".join(f"(?:{k})" for k in keywords)
    anchors = section_anchors(nodes, F.col("heading").rlike(wanted))
    bodies = joined_texts(anchors, nodes, ["page_id", "pre"])
    sections = bodies.select("page_id", "pre", strip_boilerplate(F.col("body"), composed).alias("section")).filter("section <> ''")
    return sections.groupBy("page_id").agg(F.min_by("section", "pre").alias("section"))


def soft_404(text: Column, visible_title: Column, raw_title: Column) -> Column:
    """Pages that answer 200 but say 'not found', and empty pages."""
    titles = "(?U)" + "|".join(V.SOFT_404_TITLES)
    bodies = "(?U)" + "|".join(V.SOFT_404_BODIES)
    says = lambda c, p, n=None: F.coalesce(lower_tr(F.substring(c, 1, n) if n else c).rlike(p), F.lit(False))
    empty = F.coalesce(F.trim(text), F.lit("")) == ""
    return empty | says(visible_title, titles) | says(raw_title, titles) | says(text, bodies, V.SOFT_404_SCAN)


def catch_all_pages(pages: DataFrame, homes: DataFrame) -> DataFrame:
    """Pages of a site that serve its home page's content. pages: site, page_id, clean_text; homes: site, clean_text.
    Sites without a home page give nothing."""
    known = homes.select("site", fingerprint(F.col("clean_text")).alias("print")).filter("print <> ''").distinct()
    printed = pages.withColumn("print", fingerprint(F.col("clean_text")))
    return printed.join(known.hint("merge"), ["site", "print"], "left_semi").drop("print")


def table_captions(nodes: DataFrame) -> DataFrame:
    """page_id, table_no, caption: the caption element, else the nearest earlier text of 20 characters that is not a
    number, among the last 12 texts. Two windows per page, one looking back for texts and one ahead for captions, that
    each carry the last one seen."""
    kept = nodes.filter("tag IN ('#text', 'table', 'caption')").select("page_id", "tag", "pre", "post", tidy(F.col("text")).alias("line"))
    is_text = F.col("tag") == "#text"
    good = is_text & (F.length("line") >= V.CAPTION_MIN) & ~F.col("line").rlike(r"^[\d.,%\s]+$")
    numbered = kept.withColumn("_texts", F.count_if(is_text).over(_upto_here())).withColumn("table_no", F.count_if(F.col("tag") == "table").over(_upto_here()).cast("int"))
    near = F.last(F.when(good, F.struct("_texts", "line")), ignorenulls=True).over(_upto_here())
    # Captions between a table's start and its end: the first one behind its start tells.
    ahead = _page().orderBy(F.desc("pre")).rowsBetween(Window.unboundedPreceding, -1)
    own = F.last(F.when((F.col("tag") == "caption") & (F.col("line") != ""), F.struct("pre", "line")), ignorenulls=True).over(ahead)
    tables = numbered.withColumn("_near", near).withColumn("_own", own).filter("tag = 'table'")
    caption = F.when(F.col("_own.pre") <= F.col("post"), F.col("_own.line"))
    text = F.when(F.col("_texts") - F.col("_near._texts") < V.CAPTION_LOOKBACK, F.col("_near.line"))
    return tables.select("page_id", "table_no", F.coalesce(caption, text).alias("caption"))


def variant_of(caption: Column, composed: bool = True) -> Column:
    """Variant key of the first marker in the caption; null without one."""
    key = match_key(caption, composed)
    return F.coalesce(*[F.when(key.contains(marker), F.lit(value)) for marker, value in V.VARIANT_MARKERS])


def header_field(header: Column, composed: bool = True) -> Column:
    """Candidate fields of a header cell, in alias order."""
    key = match_key(header, composed)
    hits = [F.when(F.lit(False) if not names else _any(key, names), F.lit(field)) for field, names in V.COLUMN_ALIASES.items()]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def _any(key: Column, words: tuple[str, ...]) -> Column:
    test = key.contains(words[0])
    for w in words[1:]:
        test = test | key.contains(w)
    return test


def rate_tables(nodes: DataFrame, composed: bool = True) -> DataFrame:
    """Rows of tables that have a rate column and at least two values: term and the percentages, the table's caption and
    variant, and the row as evidence. Columns take the first field of theirs that no column to the left took."""
    cells = table_cells(nodes)
    first = F.min("row_no").over(Window.partitionBy("page_id", "table_no"))
    cells = cells.withColumn("_head", first)
    heads = cells.filter("row_no = _head").select("page_id", "table_no", "col_no", header_field(F.col("text"), composed).alias("fields"))
    columns = heads.groupBy("page_id", "table_no").agg(F.array_sort(F.collect_list(F.struct("col_no", "fields"))).alias("heads"))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))

    def take(done: Column, head: Column) -> Column:
        free = F.filter(head["fields"], lambda f: ~F.array_contains(F.map_keys(done), f))
        field = F.try_element_at(free, F.lit(1))
        return F.when(field.isNull(), done).otherwise(F.map_concat(done, F.map_from_arrays(F.array(field), F.array(head["col_no"]))))

    columns = columns.withColumn("fields", F.aggregate("heads", empty, take)).filter(F.map_contains_key("fields", "profit_rate_pct"))
    rows = cells.filter("row_no > _head").groupBy("page_id", "table_no", "row_no").agg(
        F.map_from_entries(F.collect_list(F.struct("col_no", "text"))).alias("cells"), F.array_sort(F.collect_list(F.struct("col_no", "text"))).alias("line")
    )
    joined = rows.join(columns.select("page_id", "table_no", "fields").hint("merge"), ["page_id", "table_no"])
    raw = lambda f: F.nullif(F.try_element_at("cells", F.try_element_at("fields", F.lit(f))), F.lit(""))
    pct = lambda f: E.rate(E.prepare(raw(f), composed)).cast("decimal(8,4)").alias(f)
    term_raw = raw("term_months")
    term = E.term_months(E.prepare(term_raw, composed))
    months = F.when(term_raw.rlike(r"^\s*\d+\s*$"), F.trim(term_raw).try_cast("int")).otherwise(F.coalesce(term["high"], term["low"]))
    named = [f for f in V.COLUMN_ALIASES if f != "term_months"]
    evidence = F.substring(F.array_join(F.filter(F.transform("line", lambda c: c["text"]), lambda t: t != ""), " | "), 1, 300)
    typed = joined.select("page_id", "table_no", "row_no", months.alias("term_months"), *[pct(f) for f in named], evidence.alias("evidence_text"))
    filled = sum((F.when(F.col(f).isNotNull(), 1).otherwise(0) for f in V.COLUMN_ALIASES), F.lit(0))
    typed = typed.filter(filled >= V.MIN_FILLED)
    captions = table_captions(nodes).withColumn("variant_key", variant_of(F.col("caption"), composed))
    return typed.join(captions.hint("merge"), ["page_id", "table_no"], "left").withColumn("variant_label", F.when(F.col("variant_key").isNotNull(), F.col("caption")))


def card_labels(nodes: DataFrame, label_class: str, levels: int = 3) -> DataFrame:
    """page_id, pre (of the anchor), label: the first label element of the nearest card around an anchor that has one, up to
    `levels` up. Cards are the anchor's ancestors, known by where they begin and end. One window per page, from the last
    node to the first, carries the next label to each card's beginning."""
    classes = F.split(F.coalesce("cls", F.lit("")), r"\s+")
    labels = nodes.filter(F.array_contains(classes, label_class)).select("page_id", F.col("pre").alias("at"), F.lit(1).alias("kind"), F.struct("pre", F.col("text").alias("label")).alias("next"))
    cards = nodes.filter("tag = 'a'").select("page_id", "pre", F.posexplode(F.arrays_zip(F.slice("starts", 1, levels).alias("start"), F.slice("ends", 1, levels).alias("end"))).alias("level", "card"))
    cards = cards.select("page_id", F.col("card.start").alias("at"), F.lit(0).alias("kind"), "pre", "level", F.col("card.end").alias("end"))
    behind = _page().orderBy(F.desc("at"), "kind").rowsBetween(Window.unboundedPreceding, -1)
    seen = cards.unionByName(labels, allowMissingColumns=True).withColumn("next", F.last("next", ignorenulls=True).over(behind))
    held = seen.filter("kind = 0 AND next.pre <= end")
    return held.groupBy("page_id", "pre").agg(F.min_by("next.label", "level").alias("label"))


def table_texts(nodes: DataFrame) -> DataFrame:
    """page_id, tables: the page's tables as text, a line per row with its cells between bars, a blank line between tables."""
    cells = table_cells(nodes).groupBy("page_id", "table_no", "row_no").agg(F.array_sort(F.collect_list(F.struct("col_no", "text"))).alias("c"))
    line = F.array_join(F.filter(F.transform("c", lambda x: x["text"]), lambda t: t != ""), " | ")
    tables = cells.select("page_id", "table_no", "row_no", line.alias("line")).groupBy("page_id", "table_no").agg(F.array_sort(F.collect_list(F.struct("row_no", "line"))).alias("r"))
    tables = tables.select("page_id", "table_no", F.array_join(F.transform("r", lambda x: x["line"]), "\n").alias("t"))
    whole = tables.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("table_no", "t"))).alias("t"))
    return whole.select("page_id", F.array_join(F.transform("t", lambda x: x["t"]), "\n\n").alias("tables"))


def with_tables(sections: DataFrame, tables: DataFrame) -> DataFrame:
    """Conditions with the page's tables appended; a page may have only one of the two."""
    both = sections.join(tables.hint("merge"), "page_id", "full_outer")
    return both.select("page_id", F.concat_ws("\n\n", "section", "tables").alias("section"))


def campaign_rows(
    pages: DataFrame, titles: DataFrame, texts: DataFrame, conditions: DataFrame, periods: DataFrame, exclusions: DataFrame, url_segment: Column, composed: bool = True
) -> DataFrame:
    """One campaign row per page: slug, title, description, conditions, exclusions, window, participation, segment and
    archive flag (the page's hint first, then the URL). Pages without a title, or of another doc_type, give no row.

    pages: page_id, url, segment_hint, archive_hint, doc_type; hints and doc_type may be null.
    """
    joined = (
        pages.filter(F.coalesce(F.col("doc_type") == "campaign", F.lit(True)))
        .join(titles.filter("title IS NOT NULL AND title <> ''").hint("merge"), "page_id")
        .join(texts.hint("merge"), "page_id", "left")
        .join(conditions.withColumnRenamed("section", "conditions_text").hint("merge"), "page_id", "left")
        .join(periods.withColumnRenamed("section", "period_text").hint("merge"), "page_id", "left")
        .join(exclusions.withColumnRenamed("section", "exclusions").hint("merge"), "page_id", "left")
    )
    windows = [E.validity_window(E.prepare(F.col(c), composed)) for c in ("period_text", "conditions_text", "clean_text")]
    joined = joined.withColumn("window", E.first_known_window(*windows))
    return joined.select("page_id", *_campaign_columns(F.col("window"), url_segment))


SITE_RULES = "site string, field string, keywords array<string>, min_chars int"
SOURCE_ORDER = "site string, source string, rank int"


def site_sections(nodes: DataFrame, sites: DataFrame, rules: DataFrame, composed: bool = True) -> DataFrame:
    """page_id, field, section: each field's first section by the rules of the page's site. sites: page_id, site. rules
    (SITE_RULES): headings with one of the keywords (lower case) open the field's section; sections of fewer than min_chars
    characters are passed over. Anchors are found once for all fields."""
    anchors = section_anchors(nodes).join(sites.select("page_id", "site").hint("merge"), "page_id")
    wanted = anchors.join(broadcast_small(rules), "site").filter(F.exists("keywords", lambda k: F.col("heading").contains(k)))
    bodies = joined_texts(wanted.select("page_id", "field", "pre", "min_chars", "low", "high"), nodes, ["page_id", "field", "pre", "min_chars"])
    sections = bodies.select("page_id", "field", "pre", "min_chars", strip_boilerplate(F.col("body"), composed).alias("section"))
    sections = sections.filter((F.col("section") != "") & (F.length("section") >= F.coalesce("min_chars", F.lit(0))))
    return sections.groupBy("page_id", "field").agg(F.min_by("section", "pre").alias("section"))


def site_windows(texts: DataFrame, sites: DataFrame, order: DataFrame, composed: bool = True) -> DataFrame:
    """page_id, window, source: the validity window of the first source, in the order of the page's site, that has a known
    one. texts: page_id, source, text. order (SOURCE_ORDER): sources that a site does not list are not asked. Pages
    without a known window give no row."""
    ranked = texts.join(sites.select("page_id", "site").hint("merge"), "page_id").join(broadcast_small(order), ["site", "source"])
    found = ranked.select("page_id", "source", "rank", E.validity_window(E.prepare(F.col("text"), composed)).alias("window")).filter("window.precision <> 'unknown'")
    best = found.groupBy("page_id").agg(F.min_by(F.struct("window", "source"), "rank").alias("b"))
    return best.select("page_id", "b.window", "b.source")


def site_campaign_rows(pages: DataFrame, nodes: DataFrame, rules: DataFrame, order: DataFrame, url_segment: Column, ignored_titles: tuple[str, ...] = (), composed: bool = True) -> DataFrame:
    """Campaign rows of pages of many sites, each by its own rules; as campaign_rows otherwise.

    pages: page_id, site, url, segment_hint, archive_hint, doc_type. rules: fields conditions, exclusions, period and, for
    its min_chars alone, description. order: sources period, conditions and body.
    """
    sites = pages.select("page_id", "site")
    sections = site_sections(nodes, sites, rules.filter("field <> 'description'"), composed)
    bodies = clean_text(main_content(without_noise(nodes)), composed)
    named = sections.filter("field IN ('period', 'conditions')").select("page_id", F.col("field").alias("source"), F.col("section").alias("text"))
    windows = site_windows(named.unionByName(bodies.select("page_id", F.lit("body").alias("source"), F.col("clean_text").alias("text"))), sites, order, composed)
    wide = sections.groupBy("page_id").agg(*[F.max(F.when(F.col("field") == f, F.col("section"))).alias(c) for f, c in (("conditions", "conditions_text"), ("exclusions", "exclusions"))])
    least = rules.filter("field = 'description'").groupBy("site").agg(F.max("min_chars").alias("_least"))
    joined = (
        pages.filter(F.coalesce(F.col("doc_type") == "campaign", F.lit(True)))
        .join(page_titles(nodes, ignored_titles, composed).filter("title <> ''").hint("merge"), "page_id")
        .join(bodies.hint("merge"), "page_id", "left")
        .join(wide.hint("merge"), "page_id", "left")
        .join(windows.hint("merge"), "page_id", "left")
        .join(broadcast_small(least), "site", "left")
    )
    return joined.select("page_id", "site", *_campaign_columns(F.col("window"), url_segment, F.coalesce("_least", F.lit(40))), F.col("source").alias("window_source"))


def _campaign_columns(window: Column, url_segment: Column, least: Column | int = 40) -> list[Column]:
    """Columns of a campaign row over url, title, clean_text, conditions_text, exclusions and the hints."""
    part = E.participation(F.coalesce("clean_text", F.lit("")))
    return [
        U.slug(F.col("url")).alias("external_slug"),
        F.col("title"),
        first_line(F.col("clean_text"), least, skip=F.array("title")).alias("description"),
        F.col("conditions_text"),
        F.col("exclusions"),
        F.coalesce("segment_hint", url_segment).alias("segment"),
        window["start"].alias("start_date"),
        window["end"].alias("end_date"),
        F.coalesce(window["precision"], F.lit("unknown")).alias("date_precision"),
        part["method"].alias("participation_method"),
        part["sms_keyword"].alias("sms_keyword"),
        part["sms_number"].alias("sms_number"),
        part["coupon_code"].alias("coupon_code"),
        F.col("url").alias("source_url"),
        (F.coalesce("archive_hint", F.lit(False)) | F.lower(F.col("url")).contains("isarchived=true")).alias("is_archived"),
    ]


def same_title_prefilter(html: Column) -> Column:
    """Raw <title> text by one cheap expression, before any parsing."""
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
