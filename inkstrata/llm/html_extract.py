"""Main text of web pages, with the templates of their sites removed.

Each page is parsed into element spans. The subtree of every block-level element outside the running text is hashed,
and Spark counts on how many pages with different content of one host each hash occurs; subtrees on at least MIN_PAGES
pages are its template and are deleted, however many pages the host has (inside an article, only those without prose
blocks, and only articles count that differ in the rest of their text: a copied article is not a template). What is left is cleaned by
meaning (navigation, headers, footers, asides, forms, scripts, notices, adverts, comments, by element, role or class),
so that hosts with few pages are served too: a name all of whose words are listed marks an element, one listed word in a
longer name only an element outside articles that is not mostly running text. A form around the article or most of the
page is kept. The text is that of the articles, else of `main`, else of the body; an article that is mostly links is a
teaser beside one that is not.
Prose blocks inside an article (paragraphs, headings, lists, tables, ...) are never template: copied articles stay whole.

Scale: tasks send each (host, hash, page content) once; the counting is two sums with map-side parts, so a host with a
third of the pages is no hot spot. The template's keys are broadcast only if a count shows at most MAX_BROADCAST of
them; beyond it every page gets the list of its own deleted subtrees by joins on keys, never by host.

Defined results: a null or empty html gives an empty text. A null or unreadable url has the host ''. Markup that ends
in the middle of an element ends it. Repeated rows each get a row. An empty table gives no rows. Extra columns are
ignored.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from functools import partial
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstrata.llm._common import map_arrow, slices, stored, table

MIN_PAGES = 5
MAX_BROADCAST = 500_000

# Element names of HTML by their role in parsing.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript script style template textarea title xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd table thead tbody tfoot tr td th caption figure figcaption hr br".split())
DROPPED = frozenset("nav footer aside form script style noscript template iframe head title svg math canvas audio video object button select textarea input dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words in a class or id that mark what is not the article.
CLASSES = frozenset(
    (
        "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promotion "
        "banner cookie cookies consent gdpr notice notices alert popup modal overlay sidebar aside widget widgets menu menus nav "
        "navbar navigation topnav breadcrumb breadcrumbs footer masthead comment comments commentlist disqus reply replies "
        "respond share sharing social related recommended newsletter subscribe subscription signup login search toolbar "
        "pagination pager skip copyright"
    ).split()
)
#: Those of them that mark what readers wrote, also as the first or last word of a longer name.
REMARKS = frozenset("comment comments commentlist disqus replies respond".split())
ROOTS = frozenset("html body article main".split())
#: Characters of running text (in paragraphs, outside links) that outweigh a listed word within a longer class or id.
MIN_PROSE = 200
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LIMITS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}

_MARKUP = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s>]+))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


class Page:
    """Elements of a page as parallel lists, parents first, and its text pieces in order."""

    __slots__ = ("items", "marks", "parent", "pieces", "tag")

    def __init__(self, source: str):
        self.tag: list[str] = ["#root"]
        self.parent, self.marks = [-1], [""]
        self.items: list[list[int | str]] = [[]]  # what each element has in it, in order: elements and texts
        self.pieces: list[tuple[int, str]] = []
        stack, at = [0], 0
        while found := _MARKUP.search(source, at):
            if found.start() > at:
                self._text(stack[-1], source[at : found.start()])
            at = found.end()
            name = found[2] or found[5]
            if not name:
                continue  # comment, doctype, processing instruction
            name = name.lower()
            if found[1] or found[4]:
                self._close(stack, name)
                continue
            self._imply(stack, name)
            marks = found[3] or found[6] or ""
            if name not in INLINE:
                self.pieces.append((stack[-1], " "))
            element = self._open(stack[-1], name, marks)
            if name in VOID:
                continue
            if name in RAW:
                closing = _ENDS[name].search(source, at)
                end = closing.start() if closing else len(source)
                self.items[element].append(source[at:end])
                at = end
            stack.append(element)
        if at < len(source):
            self._text(stack[-1], source[at:])

    def _text(self, owner: int, text: str) -> None:
        self.pieces.append((owner, text))
        self.items[owner].append(text)

    def _open(self, parent: int, name: str, marks: str) -> int:
        self.tag.append(name)
        self.parent.append(parent)
        self.marks.append(marks)
        self.items.append([])
        self.items[parent].append(len(self.tag) - 1)
        return len(self.tag) - 1

    def _close(self, stack: list[int], name: str) -> None:
        if name not in INLINE:
            self.pieces.append((stack[-1], " "))
        for depth in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[depth]]
            if tag == name:
                del stack[depth:]
                return
            if name in INLINE and tag not in INLINE:
                return  # a stray end tag does not close blocks
            if tag in ROOTS and name not in ROOTS:
                return

    def _imply(self, stack: list[int], name: str) -> None:
        """End what the start of `name` ends: paragraphs before blocks, list items and cells before their like."""
        if name not in INLINE and name not in VOID or name == "hr":
            for depth in range(len(stack) - 1, 0, -1):
                tag = self.tag[stack[depth]]
                if tag == "p":
                    del stack[depth:]
                    break
                if tag not in INLINE:
                    break
        if name in IMPLIED:
            for depth in range(len(stack) - 1, 0, -1):
                tag = self.tag[stack[depth]]
                if tag in IMPLIED[name]:
                    del stack[depth:]
                    break
                if tag in LIMITS[name] or tag in ROOTS:
                    break

    def inside(self, names: frozenset[str] | set[str]) -> list[bool]:
        """Whether each element is, or is inside, one of the named ones."""
        out = [False]
        for tag, parent in zip(self.tag[1:], self.parent[1:], strict=True):
            out.append(tag in names or out[parent])
        return out


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def digests(page: Page, seed: int) -> list[int]:
    """A hash of each element's subtree, from those of what is in it, white space aside; each text is read once."""
    out = [0] * len(page.tag)
    for i in range(len(page.tag) - 1, 0, -1):  # children come after parents
        parts = [page.tag[i].encode("utf-8", "surrogatepass"), " ".join(page.marks[i].split()).encode("utf-8", "surrogatepass")]
        for item in page.items[i]:
            if isinstance(item, int):
                parts.append(b"\x01" + out[item].to_bytes(8, "little"))
            elif text := " ".join(item.split()):
                parts.append(b"\x02" + xxhash.xxh3_64_digest(text.encode("utf-8", "surrogatepass")))
        out[i] = xxhash.xxh3_64_intdigest(b"\0".join(parts), seed=seed)
    return out


def subtrees(page: Page, host: str) -> list[tuple[int, int]]:
    """(element, key) of the subtrees that may be template.

    The key hashes host and markup, white space aside; its last bit is set inside an article.
    """
    within, out = page.inside({"article"}), []
    hashed = digests(page, xxhash.xxh3_64_intdigest(host.encode()))
    prose = [tag in PROSE and inner for tag, inner in zip(page.tag, within, strict=True)]
    for i in range(len(prose) - 1, 0, -1):  # parents come before children
        prose[page.parent[i]] = prose[page.parent[i]] or prose[i]
    for i in range(1, len(page.tag)):
        tag = page.tag[i]
        if tag in INLINE or tag in ROOTS or tag in VOID or (within[i] and prose[i]):
            continue
        key = hashed[i] & ~1 | within[i]
        out.append((i, key - (1 << 64) if key >> 63 else key))
    return out


def sizes(page: Page) -> tuple[list[int], list[int], list[int]]:
    """Of each subtree, the characters of its text, of its text in links, and of running text in paragraphs outside links."""
    links, paragraphs = page.inside({"a"}), page.inside({"p"})
    whole, linked, prose = ([0] * len(page.tag) for _ in range(3))
    for owner, text in page.pieces:
        n = len(text.strip())
        whole[owner] += n
        if links[owner]:
            linked[owner] += n
        elif paragraphs[owner]:
            prose[owner] += n
    for count in (whole, linked, prose):
        for i in range(len(count) - 1, 0, -1):
            count[page.parent[i]] += count[i]
    return whole, linked, prose


def rests(page: Page, elements: list[int]) -> dict[int, int]:
    """For each of the elements, all within articles, a hash of its outermost article's text without its own."""
    own = [0] * len(page.tag)
    for owner, text in page.pieces:
        if text := " ".join(text.split()):
            own[owner] += xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    article = [0] * len(page.tag)
    for i in range(1, len(page.tag)):
        article[i] = article[page.parent[i]] or (i if page.tag[i] == "article" else 0)
    for i in range(len(own) - 1, 0, -1):  # parents come before children
        own[page.parent[i]] += own[i]
    return {i: (own[article[i]] - own[i]) & ((1 << 64) - 1) for i in elements}


#: How an element is marked: as what readers wrote, as no part of the article, or by one word of a longer name.
REMARK, STRONG, WEAK = 3, 2, 1


def _mark(marks: str) -> tuple[int, int]:
    """The strongest mark of an element's class and other attributes, and that of its id."""
    by_class = by_id = 0
    for name, value in _ATTRIBUTE.findall(marks):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "role" and value.lower() in ROLES):
            by_class = max(by_class, STRONG)
        elif name in ("class", "id"):
            found = 0
            for token in value.split():
                words = [x.lower() for x in _WORD.findall(token)] or [token.lower()]
                if words[0] in REMARKS or words[-1] in REMARKS:
                    found = REMARK
                elif token.lower() in CLASSES or CLASSES.issuperset(words) or words == ["header"]:
                    found = max(found, STRONG)
                elif "header" in words or not CLASSES.isdisjoint(words):
                    found = max(found, WEAK)
            if name == "class":
                by_class = max(by_class, found)
            else:
                by_id = found
    return by_class, by_id


def removed(page: Page) -> list[bool]:
    """Which elements are, or are inside, what is no part of the article."""
    article, (whole, linked, prose) = page.inside({"article"}), sizes(page)
    holds = [False] * len(page.tag)
    for i in range(len(page.tag) - 1, 0, -1):
        holds[page.parent[i]] = holds[page.parent[i]] or holds[i] or page.tag[i] in ("article", "main")
    plain = any(tag == "article" and not max(_mark(marks)) >= STRONG for tag, marks in zip(page.tag, page.marks, strict=True))
    gone = [False] * len(page.tag)
    for i in range(1, len(page.tag)):
        tag = page.tag[i]
        if gone[page.parent[i]]:
            gone[i] = True
        elif tag == "form":
            gone[i] = not (holds[i] or 2 * (whole[i] - linked[i]) > whole[0] - linked[0])
        elif tag in DROPPED or (tag == "header" and not article[page.parent[i]]):
            gone[i] = True
        elif page.marks[i] and tag not in ("html", "body", "main"):
            by_class, by_id = _mark(page.marks[i])
            if tag == "article":
                gone[i] = by_class == REMARK or (by_class == STRONG and plain)
            elif article[i]:  # there, ids name sections and words of a class may be the subject's
                gone[i] = by_class >= STRONG or (by_id == REMARK and tag not in PROSE)
            else:
                gone[i] = max(by_class, by_id) >= STRONG or (max(by_class, by_id) == WEAK and (prose[i] < MIN_PROSE or 2 * prose[i] < whole[i]))
    tops = [i for i, tag in enumerate(page.tag) if tag == "article" and not article[page.parent[i]] and not gone[i]]
    teasers = {i for i in tops if 2 * linked[i] > whole[i]}
    if teasers and len(teasers) < len(tops):
        for i in range(1, len(page.tag)):
            gone[i] = gone[i] or i in teasers or gone[page.parent[i]]
    return gone


def extract(source: str | None, deleted: set[int] | frozenset[int] = frozenset(), host: str = "") -> str:
    """The main text of a page; `deleted` has the keys of template subtrees."""
    if not source:
        return ""
    page = Page(source)
    gone = removed(page)
    if deleted:
        for i, key in subtrees(page, host):
            gone[i] = gone[i] or key in deleted
        for i in range(1, len(gone)):
            gone[i] = gone[i] or gone[page.parent[i]]
    main = None
    for wanted in ("article", "main"):
        if any(tag == wanted and not out for tag, out in zip(page.tag, gone, strict=True)):
            main = page.inside({wanted})
            break
    kept = [_html.unescape(text) for owner, text in page.pieces if not gone[owner] and (main is None or main[owner])]
    return " ".join("".join(kept).split())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, key, content) once per page; the content of what is inside an article is the rest of that."""
    for part in slices(batches, "html"):
        hosts, keys, contents = [], [], []
        for url, source in zip(part.column("url").to_pylist(), part.column("html").to_pylist(), strict=True):
            if not source:
                continue
            host = host_of(url)
            name = np.uint64(xxhash.xxh3_64_intdigest(host.encode())).astype(np.int64).item()
            content = np.uint64(xxhash.xxh3_64_intdigest(source.encode("utf-8", "surrogatepass"))).astype(np.int64).item()
            page = Page(source)
            every = subtrees(page, host)
            rest = rests(page, [i for i, key in every if key & 1])
            found = {(key, np.uint64(rest[i]).astype(np.int64).item() if key & 1 else content) for i, key in every}
            hosts += [name] * len(found)
            keys += [key for key, _ in found]
            contents += [of for _, of in found]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (hosts, keys, contents)], ["host", "key", "content"])


def templates(pages: DataFrame) -> DataFrame:
    """(key): subtrees that recur on many pages of their host; stored."""
    seen = map_arrow(pages.select("url", "html"), _count, "host long, key long, content long")
    times = seen.distinct().groupBy("host", "key").agg(F.count("*").alias("n"))
    return stored(times.where(F.col("n") >= MIN_PAGES).select("key").distinct(), "templates")


OUT = "page_id long, url string, text string, n_chars long"


def _texts(batches: Iterator[pa.RecordBatch], deleted: bytes | None) -> Iterator[pa.RecordBatch]:
    keys = frozenset(np.frombuffer(deleted, np.int64).tolist()) if deleted is not None else None
    for part in slices(batches, "html"):
        own = part.column("keys").to_pylist() if keys is None else [keys] * len(part)
        texts = [extract(h, frozenset(k or ()), host_of(u)) for u, h, k in zip(part.column("url").to_pylist(), part.column("html").to_pylist(), own, strict=True)]
        columns = [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])


def _own_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, keys = [], []
        for row, url, source in zip(*(batch.column(c).to_pylist() for c in ("row", "url", "html")), strict=True):
            if source:
                found = {key for _, key in subtrees(Page(source), host_of(url))}
                rows += [row] * len(found)
                keys += found
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(keys, pa.int64())], ["row", "key"])


def main_texts(pages: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of `pages` (page_id, url, html)."""
    pages, template = pages.select("page_id", "url", "html"), templates(pages)
    if template.limit(max_broadcast + 1).count() <= max_broadcast:
        keys = template.toArrow().column("key").to_numpy().astype(np.int64).tobytes()
        return map_arrow(pages, partial(_texts, deleted=keys), OUT)
    pages = pages.withColumn("row", F.xxhash64("url", "html"))  # ids may be null or repeat
    own = map_arrow(pages, _own_keys, "row long, key long").distinct().join(template, "key", "left_semi")
    listed = own.groupBy("row").agg(F.collect_set("key").alias("keys"))  # at most a page's elements
    return map_arrow(pages.join(listed, "row", "left"), partial(_texts, deleted=None), OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages", "page_id", "url", "html"))
