"""Main text of web pages by consensus host paths.

Each page is parsed once into blocks of text and the containers that hold them. A container
scores the length of the good text below it (no boilerplate, few links), and the page votes for
the path of the deepest container with most of that text: tags and first classes from the root,
with digits generalised. Votes are counted per host in Spark. Each page is then parsed again
and its text is taken around all containers on its host's winning path, or around its own
deepest one if it has none of them: what the article or main element around them holds or,
without one, the highest container below body. There, good blocks that stand in body itself
belong to the text, too; containers beside the winning one in body don't.

Left out: menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles,
markup and reader comments, by element or by a name in class, id or role. A name marks if it is
made of MARKS and PARTS only (ad-box, but not notice-period); words as in has-sidebar or
comments-open don't, and no name does on article and main elements, beside a name of CONTENT, or
on an element with most of the page's text, but for reader comments and consent. Character
references are decoded, white space within a block becomes one space, blocks are joined by
one space in page order, and nothing else is dropped or capped.

A null or empty html gives an empty text; a page without markup is one block. A tag that the
page's end cuts off is dropped, open elements then end. A null url, or one without "://",
has the empty host and votes there. Repeated rows are pages of their own and each votes.
Ties: of paths with equal votes the smaller wins, of containers with equal text the deeper one.
Empty tables give empty results. Columns that aren't kept don't matter, and one named like the
output is replaced. Very long pages are read whole, in linear time.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import broadcast_if_small, cut, for_python, table
from quillon.llm.url_filter import url_host

#: The share of a page's good text that its chosen container holds at least.
MOST = 0.8
#: Elements that hold a page's main text as a whole, and those that are the page itself.
MAIN, WHOLE = ("article", "main"), ("", "html", "body")
#: Blocks with a larger share of their text in links are no good text.
LINKS = 0.5
#: Winning paths are broadcast up to so many hosts (some 100 bytes each).
BROADCAST_HOSTS = 100_000
#: Longer paths go on as a digest, so deeply nested pages stay linear.
PATH = 400

# Fixed sets of HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
DROPPED = frozenset(
    "nav header footer aside form button select dialog menu svg math object audio video canvas head".split()
)
CONTAINERS = frozenset(
    "html body div article section main td table tbody thead tfoot tr center blockquote figure ul ol dl li dd dt "
    "details fieldset".split()
)
BLOCKS = CONTAINERS | DROPPED | frozenset(
    "p h1 h2 h3 h4 h5 h6 pre th caption figcaption address summary hr legend option hgroup".split()
)
#: What a start tag ends, if it is open: the element, up to any of the others.
ENDS = {
    "li": ("li", {"ul", "ol"}), "dt": ("dd", {"dl"}), "dd": ("dt", {"dl"}), "tr": ("tr", {"table"}),
    "td": ("td", {"tr", "table"}), "th": ("td", {"tr", "table"}),
}
#: Words that turn a mark after or before them into a property of something else.
BEFORE, AFTER = frozenset("has no with without".split()), frozenset("open closed".split())
#: Marks that hold however much of a page's text they have.
ALWAYS = frozenset("comment comments commentlist disqus respond replies cookie cookies consent gdpr".split())
#: Words of class, id or role that mark boilerplate.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav "
    "navbar navigation sidenav submenu menubar topbar subnav mainnav aside footer header masthead adsense adsbygoogle comment comments commentlist disqus respond replies cookie cookies consent gdpr "
    "notice alert popup modal overlay share sharing social related recommended breadcrumb breadcrumbs newsletter "
    "subscribe signup login toolbar pagination pager search complementary contentinfo".split()
)
#: Words that may stand beside a mark in one name without making something else of it.
PARTS = frozenset(
    "box boxes list container wrapper wrap block section area widget widgets panel bar region slot unit zone module group "
    "row col column card tile teaser inner outer top bottom left right first second last side site page global main primary "
    "secondary mobile desktop mega dropdown hamburger off canvas sticky fixed floating wide large medium small leaderboard "
    "rectangle x link links button buttons tab tabs icon icons logo form message text info warning danger success error "
    "dismissible dialog media post posts article articles story stories news topics tags content contents title heading label "
    "body meta copyright trail prev previous next thread user users reader readers author reply facebook fb google email law "
    "policy preferences toggle trigger template this you your by on of the and to for us js is cta".split()
)
#: Names of what holds a page's text, whatever stands beside them.
CONTENT = frozenset("content entry post article story body text main maincontent".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')|=)*+)(>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"(?:\A|[\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
ENDING = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in RAW}
DIGITS = re.compile(r"[0-9]+")


def marks(value: str) -> set[str]:
    """The words of an attribute's value that mark boilerplate."""
    found, spared = set(), False
    for name in value.split():
        words = [w.lower() for w in WORD.findall(name)]
        spared = spared or (bool(words) and CONTENT.issuperset(words))
        own = set()
        for before, word, after in zip(["", *words], words, [*words[1:], ""]):
            if word in MARKS and before not in BEFORE and after not in AFTER:
                own.add(word)
            elif word not in PARTS and word not in MARKS:
                break
        else:
            found |= own
    return found & ALWAYS if spared else found


class Page:
    """blocks: (container, text pieces, whether it is good text); containers: path, parent, tag."""

    def __init__(self, source: str):
        spared = self._read(source, frozenset())
        if spared:
            self._read(source, spared)

    def _read(self, source: str, spared: frozenset) -> frozenset:
        """Reads the page; numbers of marked elements that are no boilerplate, as they hold most of it."""
        self.blocks: list[tuple[int, list[str], bool]] = []
        self.paths, self.parents, self.tags = [""], [0], [""]
        stack: list[tuple[str, int, int, int]] = []  # tag; container, depth of dropping, marked element before it
        # of marked elements: text, linked text, the one around, whether always dropped, number
        held: list[list[int]] = []
        number = kept = 0
        mark = -1  # the marked element that text is in, if nothing else drops it
        count: Counter = Counter()
        container = dropping = 0
        pieces: list[str] = []
        linked = length = 0
        in_link = False
        at = 0

        def flush():
            nonlocal pieces, linked, length, in_link
            if pieces:
                self.blocks.append((container, pieces, linked <= LINKS * length))
                pieces = []
            linked = length = 0
            in_link = False

        def pop():
            nonlocal container, dropping, mark
            tag, container, dropping, mark = stack.pop()
            count[tag] -= 1
            return tag

        def text(part):
            nonlocal linked, length, kept
            if not dropping and part:
                pieces.append(part)
                length += (n := len(part.strip()))
                linked += n * in_link
                kept += n
            elif mark >= 0 and part:
                held[mark][0] += (n := len(part.strip()))
                held[mark][1] += n * in_link

        for_token = TOKEN.search
        while True:
            m = for_token(source, at)
            if not m:
                text(source[at:])
                break
            text(source[at : m.start()])
            at, name = m.end(), m.group(2)
            if name is None or not m.group(4):
                continue
            tag = name.lower()
            if m.group(1):
                if tag == "a":
                    in_link = False
                if count[tag]:
                    if tag in BLOCKS:
                        flush()
                    while pop() != tag:
                        pass
                elif tag in BLOCKS:
                    flush()
                continue
            if tag in RAW:
                end = ENDING[tag].search(source, at)
                at = end.start() if end else len(source)
                continue
            if tag == "br":
                text(" ")
                continue
            block = tag in BLOCKS
            if block:
                flush()
                if count["p"]:
                    while pop() != "p":
                        pass
                if tag in ENDS:
                    other, within = ENDS[tag]
                    for tag_of, *_ in reversed(stack):
                        if tag_of in within:
                            break
                        if tag_of in (tag, other):
                            while pop() != tag_of:
                                pass
                            break
            if tag == "a":
                in_link = True
            if tag in VOID:
                continue
            attributes = m.group(3)
            marked, first, words = tag in DROPPED, "", set()
            if "=" in attributes:
                for a in ATTRIBUTE.finditer(attributes):
                    value = a.group(2) or a.group(3) or a.group(4) or ""
                    if not marked and tag not in ("html", "body"):
                        words |= marks(value)
                    if a.group(1).lower() == "class" and value.split():
                        first = "." + DIGITS.sub("#", value.split()[0].lower())
            if tag in ("article", "main"):
                words &= ALWAYS
            number += bool(words)
            by_words = bool(words) and number not in spared
            if not block and not marked and not by_words:
                continue
            stack.append((tag, container, dropping, mark))
            count[tag] += 1
            if marked:
                dropping, mark = dropping + 1, -1
            elif by_words:
                if not dropping or mark >= 0:
                    held.append([0, 0, mark, bool(words & ALWAYS) or (mark >= 0 and held[mark][3]), number])
                    mark = len(held) - 1
                dropping += 1
            elif tag in CONTAINERS and not dropping:
                path = f"{self.paths[container]}/{tag}{first}"
                if len(path) > PATH:
                    path = xxhash.xxh64_hexdigest(path)
                self.paths.append(path)
                self.parents.append(container)
                self.tags.append(tag)
                container = len(self.paths) - 1
        flush()
        whole = kept + sum(h[0] for h in held if not h[3])
        for h in reversed(held):  # the one around stands before
            if h[2] >= 0 and not h[3]:
                held[h[2]][0] += h[0]
                held[h[2]][1] += h[1]
        large = [h for h in held if not h[3] and h[0] >= MOST * whole > 0 and h[1] <= LINKS * h[0]]
        return frozenset(h[4] for h in large)

    def core(self) -> int:
        """The deepest container with most of the good text."""
        held = [0] * len(self.paths)
        for container, pieces, good in self.blocks:
            if good:
                held[container] += sum(len(p.strip()) for p in pieces)
        for c in range(len(held) - 1, 0, -1):  # a parent stands before its children
            held[self.parents[c]] += held[c]
        return max((c for c in range(len(held)) if held[c] >= MOST * held[0]), default=0) if held[0] else 0

    def around(self, at: int) -> int:
        """What holds a container's page text: article, else main, else the highest below body."""
        highest, main = at, None
        while at:
            if self.tags[at] in MAIN:
                main = at
                if self.tags[at] == "article":
                    break
            if self.tags[at] not in WHOLE:
                highest = at
            at = self.parents[at]
        return highest if main is None else main

    def path(self) -> tuple[str, int]:
        """The voted path and whether there is any text to vote with."""
        return self.paths[self.core()], bool(self.blocks)

    def main_text(self, winner: str | None) -> str:
        """The text around the containers on the winning path, else around the page's own."""
        cores = {c for c, p in enumerate(self.paths) if p == winner} or {self.core()}
        chosen = {self.around(c) for c in cores}
        n = len(self.paths)
        inside, deep, main = [False] * n, [False] * n, [False] * n
        for c in range(n):
            up = self.parents[c]
            inside[c] = c in chosen or (c > 0 and inside[up])
            deep[c] = c in cores or (c > 0 and deep[up])
            main[c] = self.tags[c] in MAIN or (c > 0 and main[up])
        # Around the winning containers, blocks of links are no part of the text, and titles
        # and leads that stand in the page itself are one.
        lifted = not any(main[c] for c in chosen)
        found = []
        for container, pieces, good in self.blocks:
            if inside[container]:
                taken = good or deep[container] or not lifted
            else:
                taken = good and lifted and self.tags[container] in WHOLE
            if taken:
                # references are decoded piece by piece, as no reference spans a tag
                words = "".join(references.unescape(p) if "&" in p else p for p in pieces).split()
                if words:
                    found.append(" ".join(words))
        return " ".join(found)


def votes(pages: DataFrame) -> DataFrame:
    """host and path of every page that has text."""

    def run(batches):
        for batch in batches:
            got = [Page(h.as_py() or "").path() for h in batch.column(1)]
            paths = pa.array([p if ok else None for p, ok in got], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), paths], names=["host", "path"])

    return for_python(pages.select("host", "html")).mapInArrow(run, "host string, path string").filter("path is not null")


def winners(pages: DataFrame) -> DataFrame:
    """host and winner, its path of most votes (ties: the smaller path)."""
    counted = votes(pages).groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("less"), "path"))
    return counted.groupBy("host").agg(best.alias("best")).select("host", F.col("best.path").alias("winner"))


def extract(pages: DataFrame, keep: list[str], name: str = "main_text") -> DataFrame:
    """The columns of keep and, under name, the main text."""
    keep = [c for c in keep if c.lower() != name.lower()]
    hosted = pages.select(*keep, F.coalesce(url_host(F.col("url")), F.lit("")).alias("__qn_host"), F.col("html").alias("__qn_html"))
    known = cut(winners(hosted.select(F.col("__qn_host").alias("host"), F.col("__qn_html").alias("html"))))
    side = broadcast_if_small(known, BROADCAST_HOSTS).select(F.col("host").alias("__qn_of"), F.col("winner").alias("__qn_winner"))
    joined = hosted.join(side, F.col("__qn_host") == F.col("__qn_of"), "left").select(*keep, "__qn_html", "__qn_winner")
    schema = T.StructType([pages.schema[c] for c in keep]).add(name, T.StringType())
    n = len(keep)

    def run(batches):
        for batch in batches:
            rows = zip(batch.column(n), batch.column(n + 1))
            texts = [Page(h.as_py() or "").main_text(w.as_py()) for h, w in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(texts, pa.string())], names=[*keep, name])

    return for_python(joined).mapInArrow(run, schema)


def op1_html_extract(spark, sf_dir):
    """The main text of every page and its code points; see the module for odd rows."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, ["page_id", "url"]).select(
        "page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars")
    )
