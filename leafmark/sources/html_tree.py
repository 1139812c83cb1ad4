"""Shred raw HTML into the node table.

The tokenizer below is the only code that looks at markup, one page per step: a regular
expression finds the tokens, a stack turns them into numbered rows. Everything else in the
package works on those rows with joins, windows and expressions. The rows of a page carry
enough about their place (`anc`, `trail`, ranges) that most later questions need no join.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leafmark.model import NODES_DDL
from leafmark.session import bucket_count, stage, stage_by_page, staging, tune

# HTML's elements without content, raw-text elements, and which open element a
# start tag ends.
VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
RAW_TEXT_TAGS = frozenset(["script", "style"])
ESCAPABLE_RAW_TEXT_TAGS = frozenset(["textarea", "title"])
HEAD_TAGS = frozenset("title meta link base script style noscript template".split())
_HEADINGS = "h1 h2 h3 h4 h5 h6"
_FONT_STYLES = "tt i b u s strike big small"
_ENDED_BY = {
    "p": f"p {_HEADINGS} {_FONT_STYLES}",
    "li": f"p {_HEADINGS} li",
    "dt": "p dt dd",
    "dd": "p dt dd",
    "tr": "p th td tr caption col colgroup",
    "td": "p th td span font a b u",
    "th": "p th td span font a b u",
    "thead": "p caption col colgroup",
    "tbody": "p th td tr caption col colgroup thead tfoot tbody",
    "tfoot": "p th td tr caption col colgroup thead tbody",
    "option": "option",
    "optgroup": "option optgroup",
    "a": "a",
    "table": f"p {_HEADINGS} pre a",
}
_BLOCK_STARTS = (
    "address article aside blockquote center details dialog dir div dl fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol pre section ul"
)
ENDS = {tag: frozenset(old.split()) for tag, old in _ENDED_BY.items()}
ENDS.update({tag: frozenset(["p"]) for tag in _BLOCK_STARTS.split()})
# An end tag never closes past an element that weighs more than its own.
WEIGHT = {"div": 1, "td": 2, "th": 2, "tr": 3, "tbody": 4, "thead": 4, "tfoot": 4, "table": 5}

# Rows and characters of a batch; ways from the root grow with the depth of a page.
ROWS_PER_BATCH, CHARS_PER_BATCH = 8192, 16_000_000

_TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:--!?>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[A-Za-z][^\s/>]*)"
    r"(?P<attrs>(?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*')?)*+)>"
    r"|<\?(?P<pi>[^>]*)>"
    r"|<!(?P<decl>[^>]*)>"
    r"|</(?P<junk>[^>]*)>",
    re.S,
)
_ATTR = re.compile(r"([^\s=/>\"'][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']\S*))?)?")
_SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/\Z")
_RAW_END = {
    tag: re.compile(rf"</{tag}(?=[\s/>])", re.I)
    for tag in RAW_TEXT_TAGS | ESCAPABLE_RAW_TEXT_TAGS
}

_COLUMNS = [c.split()[0] for c in NODES_DDL.split(", ")]
_ARROW = pa.schema([
    ("page_id", pa.int64()), ("node_id", pa.int32()), ("last_id", pa.int32()),
    ("parent_id", pa.int32()), ("prev_id", pa.int32()), ("depth", pa.int32()),
    ("kind", pa.string()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())),
    ("text", pa.string()), ("anc", pa.list_(pa.int32())), ("trail", pa.string()),
    ("text_from", pa.int32()), ("text_to", pa.int32()),
])


def _decode(text: str) -> str:
    return unescape(text) if "&" in text else text


@lru_cache(maxsize=4096)
def _attributes(source: str) -> list[tuple[str, str]]:
    """Names and values of a start tag. Most tags of a site repeat; callers leave the list as it is."""
    found: dict[str, str] = {}
    for name, double, single, bare in _ATTR.findall(source):
        found.setdefault(name.lower(), _decode(double or single or bare))
    return list(found.items())


class _Tree:
    """The rows of one page while it is read; columns are kept apart for Arrow."""

    def __init__(self, page_id: int):
        self.page_id = page_id
        self.rows: list[list] = []       # in the order of _COLUMNS
        self.open: list[int] = []        # ids of the open elements
        self.names: list[str] = []       # their tags
        self.trails = [""]               # their trails
        self.last_child = [None]         # last child id of each open element
        self.texts = 0
        self.has_head = self.has_body = False

    def add(self, kind: str, tag: str | None, attrs: list, text: str | None) -> int:
        node_id = len(self.rows) + 1
        depth = len(self.open) + 1
        trail = self.trails[-1]
        if kind == "el":
            css = ""
            for k, v in attrs:
                if k == "class":
                    css = v.replace("/", "\x01")
                    break
            trail = f"{trail}/{tag}|{css}"
        parent = self.open[-1] if self.open else None
        self.rows.append([
            self.page_id, node_id, node_id, parent, self.last_child[-1], depth, kind, tag,
            attrs, text, self.open[:], trail, self.texts, self.texts,
        ])
        self.last_child[-1] = node_id
        return node_id

    def start(self, tag: str, attrs: list) -> None:
        node_id = self.add("el", tag, attrs, None)
        if tag not in VOID_TAGS:
            self.open.append(node_id)
            self.names.append(tag)
            self.trails.append(self.rows[-1][11])
            self.last_child.append(None)

    def end(self) -> None:
        row = self.rows[self.open.pop() - 1]
        row[2] = len(self.rows)
        row[13] = self.texts
        self.names.pop()
        self.trails.pop()
        self.last_child.pop()

    def put_text(self, text: str) -> None:
        if self.rows and self.rows[-1][6] == "text" and self.last_child[-1] == len(self.rows):
            self.rows[-1][9] += text
            return
        self.add("text", None, [], text)
        self.texts += 1
        self.rows[-1][13] = self.texts

    def ensure(self, tag: str | None) -> None:
        """Open the html, head and body elements the next content needs."""
        if not self.names:
            self.start("html", [])
        if self.has_body:
            return
        if tag in HEAD_TAGS:
            if not self.has_head:
                self.start("head", [])
                self.has_head = True
            return
        self.start_body([])

    def start_body(self, attrs: list) -> None:
        while len(self.names) > 1:
            self.end()
        self.start("body", attrs)
        self.has_head = self.has_body = True

    def start_tag(self, tag: str, attrs: list) -> None:
        if not self.names:
            self.start("html", attrs if tag == "html" else [])
        if tag == "html":
            return
        if tag == "head":
            if not self.has_head:
                self.start("head", attrs)
                self.has_head = True
            return
        if tag == "body":
            if not self.has_body:
                self.start_body(attrs)
            return
        self.ensure(tag)
        ended = ENDS.get(tag, ())
        while len(self.names) > 2 and self.names[-1] in ended:
            self.end()
        self.start(tag, attrs)

    def end_tag(self, tag: str) -> None:
        if tag in ("html", "body") or tag in VOID_TAGS:
            return
        if self.names and self.names[-1] == tag:
            self.end()
            return
        if tag not in self.names:
            if tag == "p":
                self.start_tag("p", [])
                self.end()
            return
        limit = WEIGHT.get(tag, 0)
        for name in reversed(self.names):
            if name == tag:
                break
            if WEIGHT.get(name, 0) > limit:
                return
        while self.names[-1] != tag:
            self.end()
        self.end()

    def text(self, text: str) -> None:
        in_body = self.has_body or (self.names and self.names[-1] not in ("html", "head"))
        if not in_body:
            if not text.strip():
                return
            self.ensure(None)
        elif self.names[-1] == "html" and not text.strip():
            return
        self.put_text(text)


def _read_page(page_id: int, html: str) -> list[list]:
    tree = _Tree(page_id)
    html = html.replace("\x00", "")
    last_close = html.rfind(">") + 1     # no token ends later, so no search need go further
    at = 0
    while (token := _TOKEN.search(html, at, last_close)) is not None:
        if token.start() > at:
            tree.text(_decode(html[at:token.start()]))
        at = token.end()
        comment, close, tag, attrs, pi, _, _ = token.groups()
        if tag is not None:
            tag = tag.lower()
            if close:
                tree.end_tag(tag)
                continue
            tree.start_tag(tag, _attributes(attrs) if attrs else [])
            if attrs.endswith("/") and _SELF_CLOSED.search(attrs):
                tree.end_tag(tag)
            elif tag in _RAW_END:
                stop = _RAW_END[tag].search(html, at)
                until = stop.start() if stop else len(html)
                if until > at:
                    raw = html[at:until]
                    tree.put_text(raw if tag in RAW_TEXT_TAGS else _decode(raw))
                    at = until
        elif tree.names and comment is not None:
            tree.add("comment", None, [], comment)
        elif tree.names and pi is not None:
            tree.add("pi", None, [], pi)
    if at < len(html):
        tree.text(_decode(html[at:]))
    while tree.open:
        tree.end()
    return tree.rows


def _to_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def offsets(lists: tuple) -> pa.Array:
        return pa.array([0, *accumulate(map(len, lists))], pa.int32())

    def flush(rows: list[list]) -> pa.RecordBatch:
        """Columns of the rows; lists and maps from their flat items, which Arrow takes in one go."""
        columns = dict(zip(_COLUMNS, zip(*rows)))
        attrs, anc = columns["attrs"], columns["anc"]
        pairs = list(chain.from_iterable(attrs))
        made = {
            "attrs": pa.MapArray.from_arrays(
                offsets(attrs), pa.array([k for k, _ in pairs], pa.string()), pa.array([v for _, v in pairs], pa.string())),
            "anc": pa.ListArray.from_arrays(offsets(anc), pa.array(list(chain.from_iterable(anc)), pa.int32())),
        }
        return pa.RecordBatch.from_arrays(
            [made[f.name].cast(f.type) if f.name in made else pa.array(columns[f.name], type=f.type) for f in _ARROW], schema=_ARROW
        )

    rows: list[list] = []
    size = 0
    for batch in batches:
        for page_id, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for row in _read_page(page_id, html):
                rows.append(row)
                size += len(row[11]) + 4 * len(row[10]) + len(row[9] or "")
                if len(rows) >= ROWS_PER_BATCH or size >= CHARS_PER_BATCH:
                    yield flush(rows)
                    rows, size = [], 0
    if rows:
        yield flush(rows)


def shred_html(pages: DataFrame) -> DataFrame:
    """Node table of usable pages (page_id, html).

    Pages are dealt by page_id first: the source may have few splits (one big file, say), and
    html is far smaller than its nodes.
    """
    tune(pages.sparkSession)
    return pages.select("page_id", "html").repartition("page_id").mapInArrow(_to_batches, NODES_DDL)


def write_nodes(pages: DataFrame) -> DataFrame:
    """The node table, written once for all later steps, bucketed by page.

    The html is shuffled to the buckets and shredded there, so a task writes one bucket and
    the much larger node rows are never shuffled. Buckets are more than the session's shuffle
    partitions: pages that already come by page_id would else keep those, which the adaptive
    execution merges by the bytes of their html, a small part of the work on them. They grow
    with the html, so that the sorts of later steps stay small enough not to spill; its bytes
    are counted in a copy that is dropped again, since reading the source may be costly.
    """
    spark = tune(pages.sparkSession)
    with staging() as passing:
        html = stage(pages.select("page_id", "html"), "html")
    try:
        n_bytes = html.agg(F.sum(F.octet_length("html"))).first()[0] or 0
        buckets = bucket_count(spark, n_bytes)
        # Rows that lie in order are cheap to sort again, and html is far smaller than its nodes.
        dealt = html.repartition(buckets, "page_id").sortWithinPartitions("page_id")
        return stage_by_page(dealt.mapInArrow(_to_batches, NODES_DDL), "nodes", buckets)
    finally:
        passing.drop(spark)
