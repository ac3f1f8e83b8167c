"""HTML extraction: what recurs on many pages of a host is its template; the article without it is the text.

Two narrow passes over the pages. The first hashes element subtrees and counts them per host in Spark, partial
counts first. A block-level subtree on at least a fifth of a host's distinct pages is template, so a host keeps a
bounded list of hashes; what holds prose in the main content is spared. That small table is written; the planner broadcasts it if its size allows and else joins by host. The
second pass deletes those subtrees and page furniture and writes out the blocks of the article.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmaforge.session import cut_lineage

LEAST_PAGES = 5
LEAST_SHARE = 0.2

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADINGS | frozenset("p li blockquote pre table tr td th dl dt dd figcaption caption".split())
BLOCKS = PROSE - {"td", "th"} | frozenset(
    "address article aside body center details dialog div fieldset figure footer form head header hgroup hr html"
    " legend main menu nav ol option optgroup section summary ul".split()
)
CLOSES_P = BLOCKS - frozenset("body head html option optgroup tr caption legend summary dt dd li".split())
# Tags that close an open one of their own kind, and the tags beyond which they do not look.
SAME = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "option": ({"option"}, {"select"})}
FURNITURE_TAGS = frozenset("nav footer aside form button select dialog menu template svg math canvas object head".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
FURNITURE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie"
    " cookies disqus footer gdpr login menu menus modal nav navbar navigation newsletter notice notices pagination popup"
    " promo promoted promotion related replies reply respond share sharing sidebar signup social sponsor sponsored"
    " subscribe toolbar widget".split()
)
HEADER_NAMES = frozenset(["header", "masthead"])

_RAW = "script|style|noscript|textarea|title|iframe|xmp|noembed|noframes"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)(?:>|\Z)",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_WORD = re.compile(r"[a-z0-9]+")


@lru_cache(10_000)
def _is_named(names: str) -> bool:
    return any(w in FURNITURE_NAMES for w in _WORD.findall(names))


@lru_cache(10_000)
def _is_called(names: str) -> bool:
    """Whether a whole class or id, not a part of one, is a name of furniture."""
    return any(w in FURNITURE_NAMES for w in names.split())


@lru_cache(10_000)
def _kind(tag: str, names: str, flags: str) -> str:
    """What a tag and its attributes call an element: drop, part (only a part of a name does), header or keep.

    An article's own header is kept, and so is what holds most of the prose, unless more than a part of a name speaks
    against it.
    """
    if tag in ("html", "body"):
        return "keep"
    if tag == "header" or any(w in HEADER_NAMES for w in _WORD.findall(names)):
        return "header"
    shown = flags.replace(" ", "")
    hidden = "hidden=" in shown.replace("aria-hidden=", "") or "aria-hidden=true" in shown or "display:none" in shown
    role = re.search(r"role=(\S+)", flags)
    if hidden or tag in FURNITURE_TAGS or role and role[1] in FURNITURE_ROLES or _is_called(names):
        return "drop"
    return "part" if _is_named(names) else "keep"


class Page:
    """Elements of a page in order of their start, with the texts and breaks between them.

    Implied end tags of paragraphs, list items, table parts and definitions are followed; an end tag without an
    open element is passed over; what is open at the end closes there.
    """

    def __init__(self, html: str) -> None:
        self.tags, self.parent, self.names, self.flags = ["#root"], [-1], [""], [""]
        # (element, text) in page order; a text of None is the edge of a block
        self.flow: list[tuple[int, str | None]] = []
        stack, last, flow = [0], 0, self.flow
        for m in _TOKEN.finditer(html):
            if m.start() > last:
                flow.append((stack[-1], html[last : m.start()]))
            last = m.end()
            tag = m[3]
            if tag is None:
                continue
            tag = tag.lower()
            if m[2]:
                self._end(tag, stack)
                continue
            if tag in CLOSES_P:
                self._close({"p"}, {"table", "td", "th", "button", "article", "body", "div", "section"}, stack)
            if tag in SAME:
                self._close(*SAME[tag], stack)
            if tag in BLOCKS:
                flow.append((stack[-1], None))
            elif tag in ("br", "td", "th"):
                flow.append((stack[-1], " "))
            if tag in VOID:
                continue
            held = _NAMES.findall(m[4]) if m[4] else ()
            self.parent.append(stack[-1])
            self.tags.append(tag)
            self.names.append(" ".join(v.strip("\"'").lower() for k, v in held if k.lower() in ("class", "id")))
            self.flags.append(" ".join(f"{k.lower()}={v.strip(chr(34) + chr(39)).lower()}" for k, v in held if k.lower() not in ("class", "id")))
            if m[4] and m[4].endswith("/") and tag in ("svg", "path", "circle", "rect"):
                continue
            stack.append(len(self.tags) - 1)
        if last < len(html):
            flow.append((stack[-1], html[last:]))
        self._places()

    def _end(self, tag: str, stack: list[int]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if self.tags[stack[i]] == tag:
                del stack[i:]
                break
        if tag in BLOCKS:
            self.flow.append((stack[-1], None))

    def _close(self, kinds: set[str], bounds: set[str], stack: list[int]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            tag = self.tags[stack[i]]
            if tag in kinds:
                del stack[i:]
                if tag in BLOCKS:
                    self.flow.append((stack[-1], None))
                return
            if tag in bounds:
                return

    def _places(self) -> None:
        """The content roots, and for each element whether it stands in one, above one, and holds prose or a heading."""
        n = len(self.tags)
        by = lambda test: [i for i in range(1, n) if test(i)]
        article = lambda i: self.tags[i] == "article" and not _is_called(self.names[i])
        # an article with a part of such a name is a comment or an advert beside others, and the article where it is alone
        roots = by(lambda i: article(i) and not _is_named(self.names[i])) or by(article)
        roots = roots or by(lambda i: self.tags[i] == "main" or "role=main" in self.flags[i])
        self.inside, self.above, self.prose, self.heading = [False] * n, [False] * n, [False] * n, [False] * n
        for r in roots:
            self.inside[r] = True
            at = r
            while at >= 0:
                self.above[at] = True
                at = self.parent[at]
        self.whole = not roots
        for i in range(1, n):
            self.inside[i] = self.inside[i] or self.inside[self.parent[i]]
        for i in range(n - 1, 0, -1):
            up = self.parent[i]
            self.prose[i] = self.prose[i] or self.tags[i] in PROSE
            self.heading[i] = self.heading[i] or self.tags[i] in HEADINGS
            self.prose[up] = self.prose[up] or self.prose[i]
            self.heading[up] = self.heading[up] or self.heading[i]
        self._sizes()
        if self.whole:
            self._main()

    def _sizes(self) -> None:
        """Which elements hold more than half of the letters of the main content (of the page, without roots) outside links."""
        n = len(self.tags)
        linked, size = [False] * n, [0] * n
        for i in range(1, n):
            linked[i] = linked[self.parent[i]] or self.tags[i] == "a"
        for i, text in self.flow:
            if text and not linked[i] and (self.whole or self.inside[i]):
                size[i] += len("".join(text.split()))
        for i in range(n - 1, 0, -1):
            size[self.parent[i]] += size[i]
        self.most = [2 * s > size[0] for s in size]

    def _main(self) -> None:
        """The main content of a page without roots: the innermost element that holds most of the text in prose tags
        outside links and furniture. There, lists of nothing but links are not prose."""
        n = len(self.tags)
        linked, off, told, size = [False] * n, [False] * n, [False] * n, [0] * n
        for i in range(1, n):
            up = self.parent[i]
            linked[i] = linked[up] or self.tags[i] == "a"
            off[i] = off[up] or self.is_furniture(i)
            told[i] = told[up] or self.tags[i] in PROSE
        for i, text in self.flow:
            if text and told[i] and not linked[i] and not off[i]:
                size[i] += len("".join(text.split()))
        for i in range(n - 1, 0, -1):
            size[self.parent[i]] += size[i]
        main = 0
        for i in range(1, n):
            # children come after their parents, so this walks down
            if self.parent[i] == main and self.tags[i] not in PROSE and 2 * size[i] > size[0]:
                main = i
        self.prose = [told[i] and size[i] > 0 for i in range(n)]
        for i in range(n - 1, 0, -1):
            self.prose[self.parent[i]] = self.prose[self.parent[i]] or self.prose[i]
        self.main = [False] * n
        self.main[main] = True
        for i in range(main + 1, n):
            self.main[i] = self.main[self.parent[i]]
        at = main
        while at >= 0:
            self.main[at] = True
            at = self.parent[at]

    def is_furniture(self, i: int) -> bool:
        """Menus, footers, sidebars, notices, adverts, forms, comments and hidden parts, by what the page calls them."""
        if self.above[i]:
            return False
        kind = _kind(self.tags[i], self.names[i], self.flags[i])
        return kind == "drop" or kind == "part" and not self.most[i] or kind == "header" and not (self.inside[i] and self.heading[i])

    def hashes(self) -> list[int]:
        """For each element the hash of its subtree, 0 where it cannot be template: roots, what holds them, inline
        elements, and what holds prose or stands in it in the main content, because an article may quote what other
        articles say."""
        n = len(self.tags)
        main = self.main if self.whole else self.inside
        wanted = [i > 0 and not self.above[i] and self.tags[i] not in ("html", "body") and not (main[i] and self.prose[i]) for i in range(n)]
        block = [t in BLOCKS or t in PROSE for t in self.tags]
        for i in range(1, n):
            # what stands in a paragraph of the main content is a part of it
            up = self.parent[i]
            block[i] = block[i] and not (main[i] and self.tags[up] in PROSE and self.prose[up] and not wanted[up])
        parts: list[list[bytes]] = [[] for _ in range(n)]
        for i, text in self.flow:
            if text and wanted[i]:
                parts[i].append(" ".join(text.split()).encode())
        out = [0] * n
        for i in range(n - 1, 0, -1):
            if wanted[i]:
                held = b"\x00".join([self.tags[i].encode(), self.names[i].encode(), *parts[i]])
                out[i] = xxhash.xxh3_64_intdigest(held) >> 1 or 1
                if wanted[self.parent[i]]:
                    parts[self.parent[i]].append(out[i].to_bytes(8, "big"))
        return [h if b else 0 for h, b in zip(out, block)]

    def text(self, template: frozenset[int]) -> str:
        """Blocks of the content roots without furniture and without subtrees whose hash is in `template`."""
        hashes = self.hashes() if template else None
        dropped = [False] * len(self.tags)
        for i in range(1, len(dropped)):
            dropped[i] = dropped[self.parent[i]] or bool(hashes and hashes[i] in template) or self.is_furniture(i)
        blocks, block = [], []
        for i, text in self.flow:
            if text is None:
                blocks.append(block)
                block = []
            elif not dropped[i] and (self.whole or self.inside[i]):
                block.append(entities.unescape(text) if "&" in text else text)
        joined = (" ".join("".join(b).split()) for b in [*blocks, block] if b)
        return "\n\n".join(b for b in joined if b)


def template_hashes(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """Per host, the hashes of element subtrees on at least `least_pages` pages and `least_share` of them.

    Reads `_host` and `html`. A page counts a hash once, and equal pages of a host count once for its share: each of
    n counts one n-th. Blocks in an article need `least_pages` distinct pages, or all where a host has fewer; pages
    without an article always need that many.
    """
    keyed = pages.select("_host", "html", F.xxhash64("html").alias("_page"))
    rows = cut_lineage(keyed.groupBy("_host", "_page").agg(F.count("*").alias("_rows")))
    copied = rows.where("_rows > 1")
    total = rows.groupBy("_host").agg(F.count("*").alias("_pages"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [Page(t.as_py() or "") for t in batch.column(1)]
            found = [sorted({*p.hashes()} - {0}) for p in read]
            sizes = [len(f) for f in found]
            whole = pa.array(np.repeat(np.array([p.whole for p in read], bool), sizes))
            at = pa.array(np.repeat(np.arange(len(found)), sizes))
            flat = pa.array([h for f in found for h in f], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), flat, batch.column(2).take(at), whole], names=["_host", "_hash", "_page", "_whole"]
            )

    # only hashes move: pages are read first, and their rows are weighed after that
    seen = keyed.mapInArrow(run, "_host string, _hash bigint, _page bigint, _whole boolean")
    seen = seen.join(copied, ["_host", "_page"], "left").withColumn("_part", F.coalesce(1 / F.col("_rows"), F.lit(1.0)))
    counts = seen.groupBy("_host", "_hash").agg(F.count("*").alias("count"), F.round(F.sum("_part"), 3).alias("_distinct"), F.bool_or("_whole").alias("_whole"))
    counts = cut_lineage(counts.where(F.col("count") >= least_pages))
    least = F.when(F.col("_whole"), least_pages).otherwise(F.least(F.lit(least_pages), F.col("_pages")))
    many = counts.join(total, "_host").where((F.col("_distinct") >= least) & (F.col("_distinct") >= least_share * F.col("_pages")))
    return many.groupBy("_host").agg(F.collect_list("_hash").alias("_template"))


def extract_articles(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """One row per page: `page_id`, `url` and `text`, the article's blocks parted by an empty line.

    The article is every `article` element, else `main`, else the body. Null and empty pages give an empty text;
    repeated rows each get their row and count as one page; null URLs share the host ''. Other columns are not read.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^.*?://([^/?#]*)", 1)), F.lit(""))
    picked = pages.select("page_id", "url", "html", host.alias("_host"))
    known = cut_lineage(template_hashes(picked, least_pages, least_share))
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = zip(batch.column(2), batch.column(3))
            texts = [Page(t.as_py() or "").text(frozenset(k.as_py() or ())) for t, k in held]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    joined = picked.join(known, "_host", "left").select("page_id", "url", "html", "_template")
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string")
