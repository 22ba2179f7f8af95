"""Main text of web pages: element subtrees are hashed and counted by host, and what recurs on many of a host's pages is cut out."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import Work, join_classes

#: A subtree is a host's template if it stands on so many pages of different main text, and on this share of the host's pages.
MIN_PAGES, MIN_SHARE = 3, 0.001

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
_ATTR = re.compile(r"([a-zA-Z][\w:-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PART = re.compile(r"[a-z0-9]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_RAW_ENDS = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in _RAW}
_BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre script search section select style summary table tbody td template textarea tfoot th thead title tr ul video".split()
)
#: Elements whose begin ends a paragraph that is still open.
_ENDS_P = _BLOCK - frozenset("br button caption iframe option optgroup script style select td template textarea th tr tbody thead tfoot title video noscript".split())
#: What a begin tag ends first, and what bounds the search for it.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tr", "td", "th", "thead", "tbody"), "body": ("head",)}
_BOUNDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "tbody": ("table",), "body": ()}
_SCOPE = frozenset("article aside body div footer form header main nav section table td th ul ol button".split())

#: Never part of a main text, wherever they stand.
_DROP = frozenset("head script style noscript template nav footer aside form button select input textarea iframe svg canvas object embed audio video dialog menu map title search xmp noembed noframes".split())
_DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Words of class names and ids that mark menus, sidebars, notices, adverts, forms and comments.
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer gdpr login menu menus modal nav navbar "
    "navigation newsletter notice notices overlay pager pagination popup promo promoted promotion recommended related replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe "
    "subscription toolbar topbar widget widgets".split()
)
_HEADS = frozenset("header masthead".split())
_NOT_MARKS = frozenset("has with no without is show hide show".split())
#: Elements whose recurrence counts inside a main element too; prose there may well recur (quotations, copies) and stays.
_BOXES = frozenset("div section table ul ol dl figure details fieldset center".split())
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre address li dt dd td th tr tbody".split())
_MAIN = frozenset(("article", "main"))
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Page:
    """The elements of a page in order, each with its parent, its tag and what its attributes say; texts with their element and block.

    `parent`, `tag`, `marked` and `hashes` are by element; element 0 is the page. A begin tag ends open elements as HTML has it (paragraphs, list
    items, cells), an end tag ends what is open inside its element, and one without a begin is passed over.
    """

    def __init__(self, source: str) -> None:
        self.parent, self.tag, self.marked = [0], ["#page"], [""]
        self.texts: list[tuple[int, int, str]] = []  # element, block, decoded text
        self.hashes: list[int] = [0]
        self._states = [xxhash.xxh3_64()]
        self._open, self._block, self._paragraphs = [0], 0, 0
        at, end = 0, len(source)
        while at < end:
            m = _TOKEN.search(source, at)
            stop = m.start() if m else end
            if stop > at:
                self._text(source[at:stop])
            if not m:
                break
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name = name.lower()
            if m[1] or m[4]:
                self._end(name)
            else:
                self._begin(name, m[3] or m[6] or "")
                if name in _RAW:
                    found = _RAW_ENDS[name].search(source, at)
                    at = found.start() if found else end
        while len(self._open) > 1:
            self._pop()

    def _text(self, raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        self.texts.append((self._open[-1], self._block, text))
        flat = " ".join(text.split())
        if flat:
            self._states[self._open[-1]].update(b"t" + flat.encode("utf-8", "replace"))

    def _pop(self) -> None:
        e = self._open.pop()
        h = self._states[e].intdigest()
        self._states[e] = None
        self.hashes[e] = h - (1 << 64) if h >> 63 else h
        self._states[self._open[-1]].update(h.to_bytes(8, "big"))
        self._block += self.tag[e] in _BLOCK
        self._paragraphs -= self.tag[e] == "p"

    def _close(self, names: tuple[str, ...], bounds: frozenset | tuple) -> None:
        """End the innermost of `names` that is open within the bounds, with all that is open inside it."""
        for i in range(len(self._open) - 1, 0, -1):
            t = self.tag[self._open[i]]
            if t in names:
                while len(self._open) > i:
                    self._pop()
                return
            if t in bounds:
                return

    def _begin(self, name: str, attrs: str) -> None:
        if name in _ENDS_P and self._paragraphs:
            self._close(("p",), _SCOPE)
        if name in _CLOSES:
            self._close(_CLOSES[name], _BOUNDS[name])
        self._block += name in _BLOCK
        if name in _VOID:
            return
        e = len(self.tag)
        self.parent.append(self._open[-1])
        self.tag.append(name)
        self._paragraphs += name == "p"
        self.hashes.append(0)
        if attrs and not attrs.isspace():
            self.marked.append(_mark(name, attrs))
            state = xxhash.xxh3_64(f"{name} {' '.join(attrs.split())}".encode("utf-8", "replace"))
        else:
            self.marked.append("")
            state = xxhash.xxh3_64(name.encode("utf-8", "replace"))
        self._states.append(state)
        self._open.append(e)

    def _end(self, name: str) -> None:
        if name in _BLOCK:
            self._block += 1
        if self.tag[self._open[-1]] == name:
            self._pop()
        else:
            self._close((name,), () if name in ("body", "html") or name in _MAIN else ("article", "main", "table") if name not in ("div", "section") else ("article", "main"))

    # ------------------------------------------------------------ what is cut

    def survey(self) -> None:
        """Sums over subtrees: characters of text, and whether a main element or a heading stands inside."""
        n = len(self.tag)
        self.size, self.holds_main, self.holds_heading = [0] * n, [False] * n, [False] * n
        for e, _, text in self.texts:
            self.size[e] += len(text)
        for e in range(n - 1, 0, -1):
            p = self.parent[e]
            self.size[p] += self.size[e]
            self.holds_main[p] |= self.holds_main[e] or self.tag[e] in _MAIN
            self.holds_heading[p] |= self.holds_heading[e] or self.tag[e] in _HEADINGS
        self.cut, self.in_main = [False] * n, [False] * n
        for e in range(1, n):  # parents come first
            p = self.parent[e]
            self.in_main[e] = self.in_main[p] or self.tag[e] in _MAIN
            self.cut[e] = self.cut[p] or self._by_form(e)

    def _by_form(self, e: int) -> bool:
        """Cut for what the element is, not for its recurrence."""
        mark = self.marked[e]
        if self.tag[e] in _DROP or mark == "hidden":
            return True
        if self.tag[e] == "header" or mark == "head":
            return not self.holds_main[e] and not (self.in_main[e] and (self.holds_heading[e] or self.tag[e] in _HEADINGS))
        if mark == "main":
            self.in_main[e] = True
        # a marked element that holds the main one, or most of a page that has none, is its frame
        return mark == "cut" and self.tag[e] not in ("html", "body") and not self.holds_main[e] and (self.in_main[e] or any(self.holds_main) or 2 * self.size[e] <= self.size[0])

    def candidates(self) -> Iterator[int]:
        """Elements whose recurrence is counted: all of a block outside the main elements, boxes inside them; none that holds a main element."""
        for e in range(1, len(self.tag)):
            t = self.tag[e]
            if self.size[e] and not self.holds_main[e] and t in _BLOCK and t not in ("html", "body", "head", "script", "style", "title", "article", "main") and (not self.in_main[e] or t in _BOXES or (t not in _PROSE and t != "hgroup")):
                yield e

    def longest(self) -> int:
        """Hash of the three longest blocks (of the main elements, if there are any): pages that share them count as one page."""
        blocks: dict[int, list[str]] = {}
        some = any(self.in_main)
        for e, b, text in self.texts:
            if not self.cut[e] and (self.in_main[e] or not some):
                blocks.setdefault(b, []).append(text)
        best = sorted((" ".join("".join(x).split()) for x in blocks.values()), key=len)[-3:]
        h = xxhash.xxh3_64_intdigest("\n".join(best).encode("utf-8", "replace"))
        return h - (1 << 64) if h >> 63 else h

    def text(self, templates: frozenset[int] | set[int]) -> str:
        """Blocks in page order without the templates and what is cut by form; of a page with main elements, what stands in them."""
        cut = list(self.cut)
        known = {e for e in self.candidates() if self.hashes[e] in templates} if templates else set()
        for e in range(1, len(cut)):
            cut[e] = cut[e] or cut[self.parent[e]] or e in known
        kept = [(b, text, self.in_main[e]) for e, b, text in self.texts if not cut[e]]
        if any(m and not text.isspace() for _, text, m in kept):
            kept = [x for x in kept if x[2]]
        out, block, run = [], None, []
        for b, text, _ in kept:
            if b != block and run:
                out.extend("".join(run).split())
                run = []
            block = b
            run.append(text)
        out.extend("".join(run).split())
        return " ".join(out)


def _mark(name: str, attrs: str) -> str:
    """What an element's attributes say of it: "hidden", "cut", "head" (of a page or article), "main" or nothing."""
    if not attrs or name in ("html", "body"):
        return ""
    said = ""
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
            return "hidden"
        if key == "role":
            said = "cut" if value in _DROP_ROLES else "main" if value in ("main", "article") else said
        elif key == "itemprop" and value == "articlebody":
            said = "main"
        elif key in ("class", "id"):
            for word in value.split():
                parts = _PART.findall(word)
                if parts and parts[0] not in _NOT_MARKS:
                    if any(p in _MARKS for p in parts) and name not in _HEADINGS:
                        said = "cut"
                    elif not said and any(p in _HEADS for p in parts):
                        said = "head"
    return said


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple[int, list[int]]] = []
        for source in batch.column("html").to_pylist():
            page = Page(source or "")
            page.survey()
            out.append((page.longest(), list({page.hashes[e] for e in page.candidates()})))
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in ("k1", "k2", "host")], pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.list_(pa.int64()))], names=["k1", "k2", "host", "main", "trees"]
        )


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for source, trees in zip(batch.column("html").to_pylist(), batch.column("templates").to_pylist(), strict=True):
            page = Page(source or "")
            page.survey()
            texts.append(page.text(frozenset(trees or ())))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def host_of(url: Column) -> Column:
    """The lower-case host of a URL, empty if it has none."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))


def templates(sigs: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, tree, size): subtrees that recur on a host's pages; size: its pages that have it.

    sigs: one row per different page, host, main (of its longest blocks), size (equal pages) and trees. Pages of one main text count once, so that
    copies of an article are no template. Hosts without a name have none.
    """
    named = sigs.where("host <> ''")
    hosts = named.groupBy("host").agg(F.count_distinct("main").alias("pages"), F.count("*").alias("size"))
    seen = named.select("host", "main", F.explode("trees").alias("tree")).groupBy("host", "tree", "main").agg(F.count("*").alias("n"))
    counts = seen.groupBy("host", "tree").agg(F.count("*").alias("n_main"), F.sum("n").alias("n_pages")).where(F.col("n_main") >= min_pages)
    total = hosts.agg(F.sum("size")).first()[0] or 0
    found = join_classes(counts, hosts, ["host"], total).where(F.col("n_main") >= F.col("pages") * min_share)
    return found.select("host", "tree", F.col("n_pages").alias("size"))


def main_text(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(page_id, url, text): every page's main text, its blocks joined by one space, white space inside them made one space, references decoded.

    Every element's subtree is hashed (tag, attributes, texts and children) and counted by host; those that recur on many pages of a host are cut
    out. Left over are menus, sidebars, notices, adverts, forms and comments that a host shows too rarely: these go by tag, role or class name. Of
    a page with article or main elements only what stands in these is kept. In them, prose that recurs stays; boxes (div, section, lists, tables)
    do not. Null html or url: as empty; a page without a host loses nothing by recurrence. Equal pages are surveyed once; other columns are left out.
    """
    work = Work(pages.sparkSession, "html")
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), body.alias("html"), host_of(F.col("url").cast("string")).alias("host"))
    keyed = rows.withColumn("k1", F.xxhash64("host", "html")).withColumn("k2", F.xxhash64(F.lit(7), "html", "host"))
    surveyed = keyed.select("k1", "k2", "host", "html").mapInArrow(_survey, "k1 long, k2 long, host string, main long, trees array<long>")
    sigs = work.keep(surveyed.groupBy("k1", "k2").agg(F.count("*").alias("size"), *[F.first(c).alias(c) for c in ("host", "main", "trees")]), "sigs")
    found = work.keep(templates(sigs, min_pages, min_share), "templates")
    total = found.agg(F.sum("size")).first()[0] or 0
    hits = join_classes(sigs.where("host <> ''").select("k1", "k2", "host", F.explode("trees").alias("tree")), found, ["host", "tree"], total)
    cut = hits.groupBy("k1", "k2").agg(F.collect_list("tree").alias("templates"))  # a page's own subtrees, no more
    classes = work.keep(sigs.select("k1", "k2", "size").join(cut, ["k1", "k2"], "left"), "cut")
    pages_n = classes.agg(F.sum("size")).first()[0] or 0
    return join_classes(keyed, classes, ["k1", "k2"], pages_n).select("page_id", "url", "html", "templates").mapInArrow(_extract, _out_schema(rows))


def _out_schema(rows: DataFrame) -> str:
    return f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string"
