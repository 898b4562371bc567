"""Main text of pages with a site style tree.

The element trees of all pages of a host are merged: elements with the same chain of
names and classes are one style node. On each page a node has a presentation (the names
of its children) and a content (the texts below it); over the host's pages the entropy
of both says how much the node varies. A node that looks and reads the same everywhere
is of low importance, and its branch is removed from each page. Pages with the same text
count once, and a node counts on the pages where it holds text. Branches inside of an
article or main element go as well, unless they hold more than half of its text: then it
is a copy of an article that other pages have too, and no template.

Elements that declare themselves as menus, footers, adverts and the like are removed as
well, since their content often changes from page to page, which entropy cannot catch. A
name that says so by its class, role or as a form is not believed on a page without any
other article or main element if it holds one, or most of the page's text.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewarden.llm.common import columns_of, stored

# Element and class names
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split()
)
SPACED = frozenset("br td th img input select button".split())
DROPPED = frozenset(
    "head script style template noscript svg math canvas iframe object audio video map nav footer aside menu dialog form button select textarea "
    "fieldset datalist title noembed noframes search".split()
)
LANDMARKS = frozenset(["article", "main"])
DOUBTFUL = frozenset("form fieldset dialog aside menu search header".split())
SILENT = frozenset("head script style template noscript svg math canvas iframe object audio video map textarea title noembed noframes datalist".split())
CLOSED_BY_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
NOISE = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header login "
    "masthead menu modal nav navbar navigation newsletter notice notices popup promo promotion related respond search share sharing sidebar signup "
    "social sponsor sponsored subscribe toolbar".split()
)
NOISE_STARTS = frozenset("ad ads advert breadcrumb comment comments cookie disqus footer nav navbar newsletter promo sidebar sponsor sponsored".split())
NOISE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
QUOTE = re.compile("[\"']")
ATTRIBUTE = re.compile(r"""\s(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$)""", re.I)
RAW_END = {name: re.compile(f"</{name}(?=[\\s/>])", re.I) for name in RAW}


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text" | "open" | "close", name or text, attributes) in one pass over the page.

    A quote without an end is looked for once, so broken tags cost no more than others.
    """
    at, n = 0, len(page)
    lost: set[str] = set()
    while at < n:
        tag = page.find("<", at)
        if tag < 0:
            yield "text", page[at:], ""
            return
        if tag > at:
            yield "text", page[at:tag], ""
        if page.startswith("<!--", tag):
            end = page.find("-->", tag + 4)
            at = n if end < 0 else end + 3
            continue
        close = page.startswith("</", tag)
        name = NAME.match(page, tag + 1 + close)
        if name is None:
            if close or page.startswith(("<!", "<?"), tag):
                end = page.find(">", tag)
                at = n if end < 0 else end + 1
            else:
                yield "text", "<", ""
                at = tag + 1
            continue
        start, look = name.end(), name.end()
        end = page.find(">", look)
        while end >= 0 and (q := QUOTE.search(page, look, end)) is not None:
            mark = q.group()
            shut = -1 if mark in lost else page.find(mark, q.end())
            if shut < 0:
                lost.add(mark)
                look = q.end()
                continue
            look = shut + 1
            if look > end:
                end = page.find(">", look)
        at = n if end < 0 else end + 1
        word = name.group().lower()
        yield ("close" if close else "open"), word, page[start : n if end < 0 else end]
        if not close and word in RAW:
            stop = RAW_END[word].search(page, at)
            body = page[at : stop.start() if stop else n]
            if body:
                yield "text", body, ""
            at = stop.start() if stop else n


@dataclass(slots=True)
class Element:
    name: str
    path: int
    own: bool  # has a style node of its own
    noise: bool  # it or an element around it is left out
    inside: bool  # an article or main element, or below one
    silent: bool  # scripts, styles and the like, or below one
    number: int = 0
    doubted: bool = False  # left out for a name that may be wrong
    tree: bool = False  # in a branch that the tree removes
    whole: bool = False  # in an article or main element that the tree leaves alone
    texts: int = 0  # sums of hashes when it was opened
    chars: int = 0  # and characters
    landmarks: int = 0  # and landmarks
    gone: int = 0  # and characters that the tree removes
    children: int = 0


def _declared(name: str, attributes: str, inside: bool) -> tuple[bool, bool, str]:
    """Whether the element says of itself that it is no main text; whether by a doubtful name; its first class."""
    by_name = name in DROPPED or (name == "header" and not inside)
    sure, doubt, first = by_name and name not in DOUBTFUL, by_name and name in DOUBTFUL, ""
    if attributes:
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key == "class":
                first = value.split()[0] if value.split() else ""
            if key in ("class", "id"):
                doubt = doubt or any(t in NOISE or re.split("[-_]", t)[0] in NOISE_STARTS for t in value.split())
            elif key == "role":
                doubt = doubt or value in NOISE_ROLES
            else:
                sure = sure or (key == "hidden" or value == "true")
    free = name in LANDMARKS or name in ("html", "body")
    return (sure or doubt) and not free, not sure, first


@dataclass
class Page:
    """Blocks of a page without the noise, and the features of the nodes that the tree judges."""

    removed: frozenset[int] = frozenset()
    features: bool = False
    blocks: list[str] = field(default_factory=list)
    content: Counter = field(default_factory=Counter)
    shape: Counter = field(default_factory=Counter)

    def read(self, page: str) -> Page:
        believed = self._read(page, frozenset())
        if believed:  # some names are not to be believed
            self.blocks.clear()
            self.content.clear()
            self.shape.clear()
            self._read(page, believed)
        return self

    def _read(self, page: str, spared: frozenset[int]) -> frozenset[int]:
        """Read the page; gives the numbers of the elements whose name should not have counted,
        and of the articles that the tree has to leave alone."""
        stack = [Element("", 0, False, False, False, False)]
        opened: Counter = Counter()
        held: list[str] = []
        doubted: list[tuple[int, int, int]] = []
        copied: list[int] = []
        sums = chars = landmarks = plain = number = gone = 0
        hashed = xxhash.xxh64_intdigest

        def flush() -> None:
            if held:
                text = " ".join(entities.unescape("".join(held)).split())
                if text:
                    self.blocks.append(text)
                held.clear()

        def pop() -> None:
            e = stack.pop()
            opened[e.name] -= 1
            if e.doubted:
                doubted.append((e.number, chars - e.chars, landmarks - e.landmarks))
            if e.name in LANDMARKS and 2 * (gone - e.gone) > chars - e.chars:
                copied.append(e.number)
            if self.features and e.own and sums != e.texts and e.name not in LANDMARKS and e.name not in ("html", "body"):
                self.content[e.path] = (self.content[e.path] + sums - e.texts) & (2**64 - 1)
                self.shape[e.path] = (self.shape[e.path] + e.children) & (2**64 - 1)

        for kind, value, attributes in tokens(page):
            top = stack[-1]
            if kind == "text":
                if not top.noise:
                    held.append(value)
                if not top.silent and (text := value.strip()):
                    chars += len(text)
                    gone += len(text) if top.tree else 0
                    if self.features:
                        sums = (sums + hashed(text)) & (2**64 - 1)
                continue
            if value in BLOCKS:
                flush()
            elif value in SPACED and not top.noise:
                held.append(" ")
            if kind == "open":
                if value in VOID:
                    continue
                if value in BLOCKS and opened["p"] > 0:
                    depth = len(stack) - 1
                    while depth and stack[depth].name not in BLOCKS:
                        depth -= 1
                    if stack[depth].name == "p":
                        while len(stack) > depth:
                            pop()
                shut = CLOSED_BY_SAME.get(value, ())
                while shut and stack[-1].name in shut:
                    pop()
                top = stack[-1]
                number += 1
                noise, doubt, first = _declared(value, attributes, top.inside)
                noise = noise and number not in spared
                path, own = top.path, value in BLOCKS or value == "a"
                if own:
                    path = hashed(f"{top.path:x}/{value}.{first}")
                    top.children = (top.children + hashed(f"{value}.{first}")) & (2**64 - 1)
                if value in LANDMARKS:
                    landmarks += 1
                    plain += not top.noise
                low = own and path in self.removed and value not in LANDMARKS and value not in ("html", "body") and not top.whole
                if noise or low:
                    flush()
                e = Element(value, path, own, top.noise or noise or low, top.inside or value in LANDMARKS, top.silent or value in SILENT, number, noise and doubt and not low)
                e.texts, e.chars, e.landmarks, e.gone = sums, chars, landmarks, gone
                e.tree, e.whole = top.tree or low, top.whole or (value in LANDMARKS and number in spared)
                stack.append(e)
                opened[value] += 1
            elif opened[value] > 0:
                depth = len(stack) - 1
                block = value in BLOCKS
                while depth and stack[depth].name != value and (block or stack[depth].name not in BLOCKS):
                    depth -= 1
                if depth and stack[depth].name == value:
                    while len(stack) > depth:
                        pop()
        flush()
        while len(stack) > 1:
            pop()
        if spared:
            return frozenset()
        wrong = [] if plain else [n for n, size, marks in doubted if marks or 2 * size > chars]
        return frozenset([*wrong, *copied])


HOST = r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)"


def host_of(url: str | None) -> str:
    m = re.match(HOST, url or "")
    return m[1].lower() if m else ""


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, digest, features) of the pages with style nodes; the digest is that of the page's text without the noise."""
    names = ["host", "digest", "path", "content", "shape"]
    for batch in batches:
        rows = {}
        for url, page in zip(*columns_of(batch, "url", "html"), strict=True):
            seen = Page(features=True).read(page)
            if seen.content:
                key = host_of(url), xxhash.xxh3_128_digest("\n".join(seen.blocks))
                rows[key] = [[_signed(x) for x in c] for c in (seen.content, seen.content.values(), map(seen.shape.get, seen.content))]
        columns = [pa.array([k[0] for k in rows], pa.string()), pa.array([k[1] for k in rows], pa.binary())]
        columns += [pa.array([r[i] for r in rows.values()], pa.list_(pa.int64())) for i in range(3)]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def style_tree(pages: DataFrame, presentation: float = 0.1) -> DataFrame:
    """(host, path, pages, importance) of every style node, over the distinct pages of each host.

    Pages of a host with the same text count once, so copies do not make what they hold
    look like a template.
    Importance is the entropy of content over pages, as a share of its maximum, with the
    presentation's entropy weighted by ``presentation``; a node of one page has 1.
    """
    seen = pages.mapInArrow(_collect, "host string, digest binary, path array<bigint>, content array<bigint>, shape array<bigint>")
    once = seen.groupBy("host", "digest").agg(F.min(F.struct("path", "content", "shape")).alias("f"))
    nodes = once.select("host", F.explode(F.arrays_zip("f.path", "f.content", "f.shape")).alias("x")).select("host", "x.*")
    features = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("feature")) for k, c in enumerate(("content", "shape"))))
    values = nodes.select("host", "path", F.inline(features)).groupBy("host", "path", "kind", "feature").agg(F.count("*").alias("n"))
    nodes = values.groupBy("host", "path", "kind").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("s"))
    share = F.when(F.col("m") > 1, (F.log("m") - F.col("s") / F.col("m")) / F.log("m")).otherwise(F.lit(1.0))
    weight = F.when(F.col("kind") == 0, F.lit(1 - presentation)).otherwise(F.lit(presentation))
    return nodes.groupBy("host", "path").agg(F.max("m").alias("pages"), F.sum(share * weight).alias("importance"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for page, removed in zip(*columns_of(batch, "html", "removed"), strict=True):
            drop = frozenset(x & (2**64 - 1) for x in removed or ())
            texts.append("\n".join(Page(removed=drop).read(page).blocks))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_text(
    pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = 4, threshold: float = 0.3,
) -> DataFrame:
    """page_id, url, text and n_chars of every page; blocks of text are lines.

    A node is removed where its host has it on ``min_pages`` pages at least and its
    importance is below ``threshold``; hosts with fewer pages keep what does not declare
    itself as noise. Null html is an empty page with an empty text; pages without a host
    in their url form one site; rows that repeat an id are pages each; an empty table gives
    no rows.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    low = stored(low_nodes(rows, min_pages, threshold), "style-tree").groupBy("host").agg(F.collect_list("path").alias("removed"))
    # a host's nodes meet its pages in one join: the table of nodes is small and no row of it repeats
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1))
    with_removed = rows.withColumn("host", host).join(low, "host", "left")
    kind = pages.schema[id_col].dataType.simpleString()
    return with_removed.select("page_id", "url", "html", "removed").mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars bigint")


def low_nodes(pages: DataFrame, min_pages: int = 4, threshold: float = 0.3) -> DataFrame:
    """(host, path) of the style nodes whose branches go, of pages (url, html)."""
    judged = style_tree(pages.select("url", "html"))
    return judged.filter((F.col("pages") >= min_pages) & (F.col("importance") < threshold)).select("host", "path")
