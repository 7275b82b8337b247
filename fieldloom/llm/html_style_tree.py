"""Main-text extraction with site style trees.

The pages of a host are merged into one tree of element nodes (paths of tag, class and id), each with the styles (sequences
of children) and the contents (texts) that pages have there. Pages count by their originality, the share of their text that
other pages of the host lack, so that copies and near copies of one page weigh as one.

- A node's presentation importance is the entropy of its styles over the pages that have it.
- A content's importance is one minus the entropy of the pages that hold it: what stands on all pages alike counts nothing.
- A node's content importance is the mean over its contents. Outside <article> and <main>, where adverts and menus rotate
  through many variants, a content's share of it is one over the perplexity of its pages instead.
- A branch's composite importance weighs the presentation and the contents of all its nodes; it is no less than the content
  importance of any one node below, so that what holds an important node stays.

From each page go the contents and whole branches of low importance first. A heading, list item or cell inside <article> or
<main> goes only with what it is in. What the tree has left is held against lists: kinds of elements that are never main text, whole class
tokens and ids (not on what holds an article or <main>; under names that a text's own sections have too only the importance
decides), and, where a page has <article> or <main>, all that is outside.

The statistics are counts by (host, path, feature), so a large host is spread over all tasks. A null or empty html has
the text ''; a page with a null or odd url belongs to the host ''; repeated rows are extracted alike, each for itself, and
count once; very long pages are parsed whole; on a host with few pages nothing is of low importance; an importance just at
the limit stays; an empty table gives no rows; columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.storage import materialize

#: Branches and single contents below this importance go (a content at 0.1 is on about half of a large host's pages); pages
#: that are added to those seen, so that a few prove little; weight of presentation in a branch.
LEAST_BRANCH, LEAST_CONTENT, UNSEEN_PAGES, PRESENTATION = 0.3, 0.1, 2, 0.3
#: The limit of branches that neither are in an <article> or <main> nor hold one: about two pages for each of its contents. What is only once on a host
#: has an importance of 0.7 there at least.
LEAST_OUTSIDE = 0.6
#: Elements farther down than this are one tree node with the element at this level, so that a node's line has an end.
DEEPEST = 64

# HTML elements by their role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
RAW = set("script style textarea title noscript template iframe noembed noframes xmp svg math".split())
TEXTLESS = set("head form button select option label input object audio video canvas script style textarea title noscript template iframe noembed noframes xmp svg math".split())
NEVER = TEXTLESS | set("nav header footer aside menu dialog".split())
HEADINGS, ITEMS = set("h1 h2 h3 h4 h5 h6".split()), set("h1 h2 h3 h4 h5 h6 li dt dd td th caption".split())
# Whole class tokens and ids that name what is never main text, and those that a text's own parts may have as well.
NOISE = re.compile(
    r"(?:(?:site|page|main|global|top|bottom|left|right|primary|secondary)[-_])?(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu|breadcrumbs?|masthead|footer|side(?:bar|nav)|widgets?|cookies?|gdpr|popup|modal|overlay|newsletter|subscribe|signup|login|comments?|disqus|share|pagination|pager|toolbar|copyright)"
    r"(?:[-_](?:ads?|area|banner|bar|block|body|box|buttons?|consent|container|form|inner|items?|links?|lists?|menu|notice|popup|section|widget|wrap(?:per)?))?",
    re.I,
)
DOUBTFUL = re.compile(r"(?:.*[-_])?(?:header|foot\w*|side\w*|consent|notice\w*|repl(?:y|ies)|respond|responses?|feedback|discussion|social|related|recommend\w*|search\w*|legal|disclaimer|alert\w*)(?:[-_].*)?", re.I)
ROLES = set("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "dl", "table", "article", "section", "div", "main", "body", "html"}

# A quote opens a value only after an equals sign; elsewhere it is a sign like others. A tag that is not closed before the next
# one begins is text, so that no search goes on to the end of the page.
_MARKUP = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'<>][^\s<>]*+)|[^<>])*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


@lru_cache(maxsize=1 << 16)
def path_key(parent: int, tag: str, style: str) -> int:
    return text_key(f"{parent}/{tag}.{style}")


def text_key(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


@lru_cache(maxsize=1 << 16)
def traits(tag: str, attributes: str) -> tuple[str, bool, bool, bool, bool]:
    """What a start tag says by itself: style, whether its role is main text or never such, and whether its names are noise or
    doubtful. A heading's id doesn't count."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    role, classes, name = found.get("role", "").lower(), found.get("class", ""), found.get("id", "").strip()
    names = classes.split() + ([] if tag in HEADINGS else [name])
    style = re.sub(r"\d+", "0", f"{classes} {name}").strip()
    return style, tag in ("article", "main") or role == "main", tag in NEVER or role in ROLES, any(map(NOISE.fullmatch, names)), any(map(DOUBTFUL.fullmatch, names))


class Element:
    __slots__ = ("anchor", "article", "children", "depth", "doubtful", "holds", "main", "mute", "named", "never", "noise", "parent", "path", "tag", "textless", "up")

    def __init__(self, tag: str, attributes: str, parent: Element | None):
        style, main, never, named, doubtful = traits(tag, attributes)
        inside, article = (parent.main, parent.article) if parent else (False, False)
        self.tag, self.parent, self.children, self.holds, self.noise = tag, parent, [], False, False
        self.depth = parent.depth + 1 if parent else 0
        if parent is not None and self.depth > DEEPEST:
            self.path, self.anchor, self.up = parent.path, parent.anchor, parent.up
        else:
            self.path, self.anchor = path_key(parent.path if parent else 0, tag, style), self
            self.up = (self.path, *parent.up) if parent else (self.path,)
        self.main, self.article = inside or main, article or tag == "article"
        self.mute = tag in TEXTLESS and tag not in BLOCKS
        self.textless = tag in TEXTLESS or (parent is not None and parent.textless)
        heading = tag == "header" and inside
        self.never = never and not heading
        # Names count neither on the outermost article nor on whatever holds it.
        unnamed = heading or tag in ("body", "html", "main") or (tag == "article" and not inside)
        self.named = named and not unnamed
        self.doubtful = (doubtful and not unnamed and tag != "article") or (parent is not None and parent.doubtful)
        if main and not article and not self.named:
            while parent is not None and not parent.holds:
                parent.holds = True
                parent = parent.parent

    def line(self) -> Iterator[Element]:
        """The tree nodes that the element is in, its own or the deepest one first: DEEPEST and one at most."""
        element: Element | None = self.anchor
        while element is not None:
            yield element
            element = element.parent

    @property
    def bound(self) -> bool:
        """Whether the element and its contents go only with a branch around them."""
        return self.main and not self.doubtful and self.tag in ITEMS


class Open:
    """The elements that are open, with the places of each tag, of block elements and of those that end a search for a tag."""

    def __init__(self, root: Element):
        self.stack, self.tags, self.blocks, self.scopes, self.muted = [root], {}, [], [], 0

    def push(self, element: Element) -> None:
        place = len(self.stack)
        self.stack.append(element)
        self.tags.setdefault(element.tag, []).append(place)
        if element.tag in BLOCKS:
            self.blocks.append(place)
        if element.tag in SCOPES:
            self.scopes.append(place)
        self.muted += element.mute

    def last(self, tag: str) -> int:
        """The place of the innermost element with a tag, 0 if there is none."""
        return places[-1] if (places := self.tags.get(tag)) else 0

    def cut(self, place: int) -> None:
        """Close the element at a place and all within it."""
        while len(self.stack) > place:
            element = self.stack.pop()
            self.tags[element.tag].pop()
            if element.tag in BLOCKS:
                self.blocks.pop()
            if element.tag in SCOPES:
                self.scopes.pop()
            self.muted -= element.mute

    @property
    def block(self) -> Element:
        return self.stack[self.blocks[-1]] if self.blocks else self.stack[0]


def blocks(html: str) -> list[tuple[Element, str]]:
    """The page's text blocks in order, each with its innermost block element; the time grows with the page, however deep it is."""
    root = Element("", "", None)
    opened, every, out, words, at, skipped = Open(root), [root], [], [], 0, ""

    def close() -> None:
        if words:
            text = " ".join("".join(words).split())
            if text:
                out.append((opened.block, text))
            words.clear()

    for m in _MARKUP.finditer(html):
        ending, tag, attributes = m.groups()
        if skipped:
            if not (ending and tag.lower() == skipped):
                continue
            skipped, at = "", m.start()
        if m.start() > at and not opened.muted:
            text = html[at : m.start()]
            words.append(unescape(text) if "&" in text else text)
        at = m.end()
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            words.append(" ")
        elif ending:
            place, inner = opened.last(tag), opened.blocks[-1] if opened.blocks else 0
            if tag == "p" and not place:
                close()
            if place and (tag in BLOCKS or inner < place):
                if inner >= place:
                    close()
                opened.cut(place)
        else:
            if tag in BLOCKS:
                close()
                place = max(map(opened.last, ("p", *CLOSED_BY.get(tag, ()))))
                if place > (opened.scopes[-1] if opened.scopes else 0):
                    opened.cut(place)
            element = Element(tag, attributes, opened.stack[-1])
            every.append(element)
            opened.stack[-1].anchor.children.append(element.path)
            if tag not in VOID and not attributes.endswith("/"):
                if tag in RAW:
                    end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(html, at)
                    if end is None:
                        at = len(html)
                        break
                    skipped = tag
                else:
                    opened.push(element)
    if not skipped and not opened.muted:
        words.append(unescape(html[at:]))
    close()
    for e in every:
        e.noise = e.never or (e.named and not e.holds) or (e.parent is not None and e.parent.noise)
    return [(e, t) for e, t in out if not e.textless]


def host_of(url: Column) -> Column:
    """The host of a url in lower case; '' where there is none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*[a-zA-Z][\w+.-]*://([^/?#\s]*)", 1)
    return F.lower(F.regexp_replace(found, "^.*@", ""))


def features(pages: DataFrame) -> DataFrame:
    """(page_id, url, tag, host, size, contents, nodes): hashes of the page and its host, the letters of its text, its contents
    with their path, and the elements around them with the hash of their style, the contents of their own and the paths of
    all that they are in."""
    kind = pages.schema["page_id"].dataType.simpleString()
    content = pa.list_(pa.struct([("path", pa.int64()), ("feature", pa.int64()), ("size", pa.int32())]))
    node = pa.list_(pa.struct([("path", pa.int64()), ("style", pa.int64()), ("own", pa.int32()), ("main", pa.bool_()), ("bound", pa.bool_()), ("up", pa.list_(pa.int64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, contents, nodes = [], [], []
            for html in batch.column(4).to_pylist():
                found, elements, own = blocks(html or ""), {}, {}
                for element, _ in found:
                    own[element.path] = own.get(element.path, 0) + 1
                    elements.update((e.path, e) for e in element.line())
                size.append(sum(len(t) for _, t in found))
                contents.append([{"path": e.path, "feature": text_key(t), "size": len(t)} for e, t in found])
                nodes.append([{"path": p, "style": text_key(str(list(dict.fromkeys(e.children)))), "own": own.get(p, 0), "main": e.main and not e.doubtful, "bound": e.bound, "up": list(e.up)} for p, e in elements.items()])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(size, pa.int64()), pa.array(contents, content), pa.array(nodes, node)],
                names=["page_id", "url", "tag", "host", "size", "contents", "nodes"],
            )

    schema = f"page_id {kind}, url string, tag long, host long, size long, contents array<struct<path: bigint, feature: bigint, size: int>>, nodes array<struct<path: bigint, style: bigint, own: int, main: boolean, bound: boolean, up: array<bigint>>>"
    return tagged(pages).select("page_id", "url", "tag", "host", "html").mapInArrow(run, schema)


def tagged(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with hashes of the row and of its host."""
    return pages.select("page_id", "url", "html", F.xxhash64("page_id", "url", "html").alias("tag"), F.xxhash64(host_of(F.col("url"))).alias("host"))


def importance(featured: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Importance of the contents that several pages of a host have, (host, path, feature, bound, importance), and of all
    branches, (host, path, bound, main, importance), where main says that an article or <main> is in or around the branch. `featured` is read several times and should be a written table."""
    held = featured.select("tag", "host", F.explode(F.array_distinct("contents")).alias("x")).select("tag", "host", "x.*")
    several = featured.select("host", F.explode(F.array_distinct("contents.feature")).alias("feature")).groupBy("host", "feature").agg(F.count("*").alias("n")).where("n > 1")
    repeated = materialize(held.join(several, ["host", "feature"]), "repeated")
    # A page's originality: each text counts for one page in as many as have it; so do repeated rows, which share a tag.
    spent = repeated.groupBy("tag", "feature").agg((F.max("size") * (1 - 1 / F.max("n"))).alias("less")).groupBy("tag").agg(F.sum("less").alias("less"))
    weights = featured.select("tag", "size").distinct().join(spent, "tag", "left")
    weights = weights.select("tag", F.when(F.col("size") > 0, F.greatest(F.lit(0.0), 1 - F.coalesce("less", F.lit(0.0)) / F.col("size"))).otherwise(0.0).alias("weight"))
    weights = materialize(weights, "weights")

    rows = featured.select("tag", "host", F.explode("nodes").alias("x")).join(weights, "tag").select("host", "weight", "x.*")
    marks = [F.max("main").alias("main"), F.max("bound").alias("bound"), F.first("up").alias("up")]
    styles = rows.groupBy("host", "path", "style").agg(F.sum("weight").alias("part"), F.sum(F.col("weight") * F.col("own")).alias("own"), *marks)
    # The entropy of shares p / m is log m - sum(p log p) / m.
    m, logs = F.sum("part"), F.sum(F.when(F.col("part") > 0, F.col("part") * F.log("part")).otherwise(0.0))
    looks = F.when(m > 1.0001, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.log(m) - logs / m) / F.log(m)))).otherwise(1.0)
    nodes = materialize(styles.groupBy("host", "path").agg(m.alias("pages"), looks.alias("presentation"), F.sum("own").alias("own"), *marks), "nodes")

    counts = repeated.join(weights, "tag").groupBy("host", "path", "feature").agg(F.sum("weight").alias("n"))
    own = 1 - F.log(F.greatest(F.lit(1.0), F.col("n"))) / F.log(F.col("pages") + UNSEEN_PAGES)
    rated = counts.join(nodes.select("host", "path", "pages", "main", "bound"), ["host", "path"]).withColumn("importance", own)
    rated = materialize(rated, "contents")

    share = F.when(F.col("main"), F.col("importance")).otherwise(1 / F.greatest(F.lit(1.0), F.col("n")))
    lost = rated.groupBy("host", "path").agg(F.sum(F.col("n") * (1 - share)).alias("lost"))
    below = nodes.join(lost, ["host", "path"], "left").withColumn("lost", F.coalesce("lost", F.lit(0.0)))
    below = below.select("host", F.explode("up").alias("path"), "presentation", "own", "lost", "main", F.when(F.col("own") > 0, 1 - F.col("lost") / F.col("own")).alias("alone"))
    composite = PRESENTATION * F.avg("presentation") + (1 - PRESENTATION) * (1 - F.sum("lost") / F.sum("own"))
    branches = below.groupBy("host", "path").agg(F.when(F.sum("own") > 0, F.greatest(composite, F.max("alone"))).otherwise(1.0).alias("importance"), F.max("main").alias("main"))
    branches = branches.join(nodes.select("host", "path", "bound"), ["host", "path"])
    return rated.select("host", "path", "feature", "bound", "importance"), branches


def sorted_out(html: str, low: set[tuple[int, int]], branches: set[int] | frozenset[int] = frozenset(), lists: bool = True) -> tuple[list[str], int, int]:
    """The page's main text block by block, and how many blocks the tree and the lists have taken.

    The tree decides first: contents (path, feature) in `low` and all within the branches at the paths in `branches` go. The
    lists are asked only about what it has left.
    """
    found = blocks(html)
    cut = {e.anchor for e, _ in found if not branches.isdisjoint(e.up)} if branches else set()
    left = [(e, t) for e, t in found if e.anchor not in cut and (e.path, text_key(t)) not in low]
    kept = [(e, t) for e, t in left if not (lists and e.noise)]
    if lists and any(e.main for e, _ in found if not e.noise):
        kept = [(e, t) for e, t in kept if e.main]
    return [t for _, t in kept], len(found) - len(left), len(left) - len(kept)


def main_text(html: str, low: set[tuple[int, int]], branches: set[int] | frozenset[int] = frozenset(), lists: bool = True) -> str:
    """The page's main text; without `lists`, what the tree leaves."""
    return "\n".join(sorted_out(html, low, branches, lists)[0])


def extract(pages: DataFrame, lists: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars, n_by_tree, n_by_lists) of every row of pages (page_id, url, html), with the numbers of blocks
    that the tree and the lists have taken; without `lists`, by the tree alone."""
    featured = materialize(features(pages), "features")
    contents, branches = importance(featured)
    # What goes from a host's pages is a short list: a content of low importance is on about half of them, and branches are
    # those of the tree. So the pages need not be shuffled to meet it, unless there are very many hosts.
    low = contents.where((F.col("importance") < LEAST_CONTENT) & ~F.col("bound")).select("host", "path", "feature")
    high = branches.where((F.col("importance") < F.when(F.col("main"), LEAST_BRANCH).otherwise(LEAST_OUTSIDE)) & ~F.col("bound")).select("host", "path", F.lit(None).cast("long").alias("feature"))
    gone = low.union(high).groupBy("host").agg(F.collect_set(F.struct("path", "feature")).alias("low"))
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, taken, known = [], [], {}
            for html, host, low in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4)):
                if host not in known:
                    marks = low.as_py() or []
                    known[host] = {(x["path"], x["feature"]) for x in marks}, {x["path"] for x in marks if x["feature"] is None}
                kept, *by = sorted_out(html or "", *known[host], lists)
                texts.append("\n".join(kept))
                taken.append(by)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), *(pa.array([by[i] for by in taken], pa.int64()) for i in (0, 1))], names=["page_id", "url", "text", "n_chars", "n_by_tree", "n_by_lists"])

    wide = tagged(pages).join(materialize(gone, "low"), "host", "left")
    return wide.select("page_id", "url", "html", "host", "low").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long, n_by_tree long, n_by_lists long")
