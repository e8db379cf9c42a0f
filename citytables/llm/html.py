"""Main text of web pages by a site style tree.

The pages of a host are merged: elements with the same path (tags, classes and ids from the root, runs
of digits alike) are one node of the host's tree. Every node has a presentation (the sequence of child
elements it shows) and a content (its own words, without those of elements in it). Over the m different
pages that have a node

  presentation = H(presentations) / log m        0: always the same, 1: never twice the same
  content      = exp(H(contents)) / m            how many different contents there are, in effect, for each page
  repeats      = m * (1 - content)

A node's presentation and content in the tree of its host are mixed with those in the tree of all hosts, which
count as host_weight pages, so that hosts of a few pages lean on the others; repeats are added. The content of a
page's element has the importance

  (prior * prior_weight + min(prior, content) * repeats) / (prior_weight + repeats)

or its prior alone, if no other page says the same there: that contents differ says little, as adverts and
comments differ too, but what many pages repeat is no article. The prior is what tags and names suggest (see
prior_of); it weighs as much as prior_weight repeats. An element's importance combines both kinds up
the page's tree: with g = 0.9, (1 - g) * presentation + g * (the mean of its own content and of its
children's importance, by length of text); of one without children, its content's alone. An element's own text
is worth 0.7 of its content's importance and 0.3 of the element's, and goes if that is below `low`; so branches
of low importance go whole, with what stands among them.

Copies of a page are one page in these counts, as they say nothing of what the host repeats: pages are
the same if their articles are, or, without an article element, all that isn't suggested to be noise.

Only hashes of nodes, one for each path of a page, are shuffled, and summed on the map side first. Of the
tree those contents count that come again. If they are broadcast_rows at most they are broadcast; else they are
joined to the elements of each page, those of more than hot_pages pages (few) by broadcast. Both ways
give the same.

Null or empty html gives an empty text. Broken markup (unclosed or stray tags) is read as far as
it goes, in linear time. A null url counts as a host of its own; repeated rows are rows of their own, whatever
their ids; ties don't matter. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citytables.llm.common import dropped, lookup, pieces, tidy, written

#: Element kinds of the HTML standard, and names that say what a branch is for.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul figure figcaption".split())
SCOPE = frozenset("ul ol dl table select div article section body td blockquote nav footer header aside form main".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
NOISE_TAGS = frozenset("nav footer aside form template button select input svg head menu object embed canvas dialog option label fieldset".split())
NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner promo sponsored sidebar side footer header navbar nav navigation menu breadcrumb breadcrumbs comment comments "
    "respond reply replies cookie cookies consent notice notices alert popup modal overlay newsletter subscribe subscription share sharing social related recommended widget login".split()
)
PARTS = frozenset("area bar block bottom box container count form group inner item items left link links list right section top wrap wrapper".split())
MAIN_TAGS = frozenset(["article", "main"])

#: Priors: an element meant as noise or beside the page's article; one with a name that holds such a word; any other; one in an article.
NOISE, HINTED, PLAIN, MAIN = 0.05, 0.3, 0.7, 0.95
HINTED_IN_MAIN = 0.7
SHARE_BELOW = 0.9
OWN_SHARE = 0.7

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"[0-9]+")


@lru_cache(1 << 16)
def _names(attributes: str) -> tuple[str, ...]:
    found = {w for m in _NAMED.finditer(attributes) for w in (m[2] or m[3] or m[4] or "").lower().split()}
    return tuple(sorted({_DIGITS.sub("#", w) for w in found}))


@lru_cache(1 << 14)
def _names_noise(name: str) -> bool:
    """Whether a name is, or ends in, a noise word (user-comments), apart from words for parts behind it (comment-list)."""
    words = _WORDS.findall(name)
    while len(words) > 1 and words[-1] in PARTS:
        words.pop()
    return bool(words) and words[-1] in NOISE_NAMES


def prior_of(tag: str, names: tuple[str, ...], above: float, in_main: bool) -> float:
    """What an element's tag and names suggest, below an element of the prior above."""
    if above <= HINTED:  # all of a noisy branch is
        return above
    if tag in MAIN_TAGS:
        return MAIN
    if tag in NOISE_TAGS or (tag == "header" and not in_main):
        return NOISE
    if tag in ("html", "body"):
        return above
    if any(_names_noise(n) for n in names):
        return NOISE
    if any(w in NOISE_NAMES for n in names for w in _WORDS.findall(n)):
        return HINTED_IN_MAIN if in_main else HINTED
    return above


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


_NO_TEXT = _hash("")


@lru_cache(1 << 16)
def _path(parent: int, tag: str, names: tuple[str, ...]) -> int:
    return _hash(f"{parent}/{tag}.{'.'.join(names)}")


class Page:
    """The elements of a page (path, parent, prior, whether in an article, sequence of children) and its blocks (element, text)."""

    def __init__(self, page: str | None):
        self.path: list[int] = [0]
        self.parent: list[int] = [-1]
        self.prior: list[float] = [PLAIN]
        self.in_main: list[bool] = [False]
        self.shows: list[list[str]] = [[]]
        self.blocks: list[tuple[int, str]] = []
        self._read(page or "")
        self.has_main = any(self.in_main[n] for n, _ in self.blocks)

    def _read(self, page: str) -> None:
        stack: list[tuple[str, int]] = [("", 0)]  # tag, element: for inline tags that around them
        open_ = Counter()
        held: list[str] = []
        spot = 0

        def flush():
            if not held:
                return
            text = " ".join("".join(held).split())
            if text:
                self.blocks.append((spot, text))
            held.clear()

        def cut(i):
            for t, _ in stack[i:]:
                open_[t] -= 1
            del stack[i:]

        at = 0
        while True:
            m = _TAG.search(page, at)
            text = page[at : m.start() if m else len(page)]
            if text:
                if not held:
                    spot = stack[-1][1]
                held.append(entities.unescape(text))
            if not m:
                break
            at = m.end()
            if m[2] is None:  # a comment or a declaration
                continue
            tag = m[2].lower()
            if m[1]:
                if tag not in INLINE:
                    flush()
                if open_[tag]:
                    i = len(stack) - 1
                    while stack[i][0] != tag:
                        i -= 1
                    if tag in INLINE and any(t not in INLINE for t, _ in stack[i:]):
                        flush()
                    cut(i)
                continue
            if tag == "br":
                if held:
                    held.append(" ")
                continue
            if tag not in INLINE or tag in NOISE_TAGS:
                flush()
            if tag in VOID:
                continue
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
                continue
            closed = CLOSED_BY.get(tag, ("p",) if tag in CLOSES_P else ())
            if closed and any(map(open_.__getitem__, closed)):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in closed:
                        cut(i)
                        break
                    if stack[i][0] in SCOPE:
                        break
            above = stack[-1][1]
            if tag in INLINE and tag not in NOISE_TAGS:
                stack.append((tag, above))
            else:
                names = _names(m[3]) if m[3] else ()
                self.path.append(_path(self.path[above], tag, names))
                self.prior.append(prior_of(tag, names, self.prior[above], self.in_main[above]))
                self.in_main.append(self.in_main[above] or tag in MAIN_TAGS)
                self.shows.append([])
                if not self.shows[above] or self.shows[above][-1] != tag:
                    self.shows[above].append(tag)
                self.parent.append(above)
                stack.append((tag, len(self.path) - 1))
            open_[tag] += 1
        flush()

    def priors(self) -> np.ndarray:
        """The prior of each element; beside the page's article there is noise."""
        prior, inside = np.array(self.prior), np.array(self.in_main)
        return np.where(inside | (not self.has_main), prior, np.minimum(prior, NOISE))

    def key(self) -> int:
        """The same for pages that say the same."""
        prior = self.priors()
        return _hash("\n".join(t for n, t in self.blocks if prior[n] > HINTED))

    def evidence(self) -> dict[int, tuple[int, int]]:
        """Hash of the own text and of the presentation, for each path that has text in or below it."""
        words: dict[int, list[str]] = {}
        shown: dict[int, list[str]] = {}
        needed = set()
        for n, text in self.blocks:
            words.setdefault(self.path[n], []).append(text)
            while n >= 0 and n not in needed:
                needed.add(n)
                n = self.parent[n]
        for n in sorted(needed):
            shown.setdefault(self.path[n], []).append(" ".join(self.shows[n]))
        return {p: (_hash("\n".join(words.get(p, ()))), _hash("\n".join(s))) for p, s in shown.items()}

    def contents(self) -> dict[int, int]:
        """Hash of the own text, for each path that has text in or below it; the same as in evidence."""
        words: dict[int, list[str]] = {}
        needed: set[int] = set()
        for n, text in self.blocks:
            words.setdefault(self.path[n], []).append(text)
            while n >= 0 and n not in needed:
                needed.add(n)
                n = self.parent[n]
        return {p: _hash("\n".join(words[p])) if p in words else _NO_TEXT for p in {self.path[n] for n in needed}}

    def importance(self, content: np.ndarray, style: np.ndarray) -> np.ndarray:
        """The combined importance of each element, from its content's and its presentation's."""
        n = len(self.path)
        length, total = np.zeros(n), np.zeros(n)  # of the text in and below; times importance
        for i, text in self.blocks:
            length[i] += len(text)
        total[:] = length * content
        children = np.zeros(n, dtype=bool)
        out = content.copy()
        for i in range(n - 1, -1, -1):  # children stand behind their parents
            if length[i]:
                mean = total[i] / length[i]
                out[i] = (1 - SHARE_BELOW) * style[i] + SHARE_BELOW * mean if children[i] else mean
                p = self.parent[i]
                if p >= 0:
                    length[p] += length[i]
                    total[p] += length[i] * out[i]
                    children[p] = True
        return out


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)", url or "")
    return m[1].rpartition("@")[2].partition(":")[0].lower() if m else ""


_NODES = "host string, path bigint, page bigint, content bigint, style bigint"


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, "html"):
        out: list[list] = [[], [], [], [], []]
        for url, page in zip(b.column("url").to_pylist(), b.column("html").to_pylist(), strict=True):
            own = Page(page)
            found = own.evidence()
            for column, values in zip(out, ([host_of(url)] * len(found), found, [own.key()] * len(found), (c for c, _ in found.values()), (s for _, s in found.values())), strict=True):
                column.extend(values)
        yield pa.record_batch([pa.array(c, pa.string() if i == 0 else pa.int64()) for i, c in enumerate(out)], names=["host", "path", "page", "content", "style"])


def _entropies(nodes: DataFrame, by: list[str]) -> DataFrame:
    """Per key: pages, content and presentation as the module's docstring has them."""

    def entropy(feature):
        counts = nodes.groupBy(*by, feature).agg(F.count("*").alias("c"))
        sums = counts.groupBy(*by).agg(F.sum("c").alias("pages"), F.sum(F.col("c") * F.log("c")).alias("clogc"))
        return sums.select(*by, "pages", (F.log("pages") - F.col("clogc") / F.col("pages")).alias("h"))

    content = entropy("content").select(*by, "pages", (F.exp("h") / F.col("pages")).alias("varied"))
    style = entropy("style").select(*by, F.when(F.col("pages") > 1, F.col("h") / F.log("pages")).otherwise(1.0).alias("style"))
    return content.join(style, by)


def different(nodes: DataFrame) -> DataFrame:
    """One row of each path of each different page of a host."""
    return nodes.groupBy("host", "path", "page").agg(F.min(F.struct("content", "style")).alias("n")).select("host", "path", "n.content", "n.style")


def style_tree(nodes: DataFrame, host_weight: float = 20.0, hot_pages: int = 50_000) -> DataFrame:
    """host, path, content (its hash), varied (the measure of contents), style, repeats, and same (pages of the host that say it),
    for the contents that come more than once on any host."""
    one = written(different(nodes), "page-nodes")
    own = _entropies(one, ["host", "path"]).withColumnRenamed("pages", "own_pages")
    every = written(_entropies(one, ["path"]).select("path", "pages", F.col("varied").alias("all_varied"), F.col("style").alias("all_style")), "common-tree")
    both = lookup(own, every, ["path"], "pages", hot_pages)
    mixed = lambda a, b: (F.col("own_pages") * F.col(a) + host_weight * F.col(b)) / (F.col("own_pages") + host_weight)
    repeats = F.col("own_pages") * (1 - F.col("varied")) + F.col("pages") * (1 - F.col("all_varied"))
    paths = written(both.select("host", "path", "own_pages", mixed("varied", "all_varied").alias("varied"), mixed("style", "all_style").alias("style"), repeats.alias("repeats")), "style-trees")
    same = written(one.groupBy("host", "path", "content").agg(F.count("*").alias("same")), "contents")
    again = written(same.groupBy("path", "content").agg(F.sum("same").alias("all_same")).where("all_same > 1"), "repeated")
    repeated = lookup(same, again, ["path", "content"], "all_same", hot_pages).drop("all_same")
    tree = written(lookup(repeated, paths, ["host", "path"], "own_pages", hot_pages).select("host", "path", "content", "varied", "style", "repeats", "same"), "content-nodes")
    for done in (one, every, paths, same, again):
        dropped(done)
    return tree


def content_importance(prior: np.ndarray, varied: np.ndarray, repeats: np.ndarray, prior_weight: float) -> np.ndarray:
    return (prior * prior_weight + np.minimum(prior, varied) * repeats) / (prior_weight + repeats)


def _node_key(host: int, path: int, content: int) -> int:
    return hash((host, path, content)) & 0xFFFFFFFFFFFFFFFF


@lru_cache(1 << 12)
def _host_hash(host: str) -> int:
    return _hash(host)


def _kept(sent, low, prior_weight):
    """The text of each page; the tree comes by broadcast, or as a list with the page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "html"):
            out = []
            urls = b.column("url").to_pylist()
            own_trees = [None] * len(urls) if sent is not None else b.column("tree").to_pylist()
            for url, page, own_tree in zip(urls, b.column("html").to_pylist(), own_trees, strict=True):
                p = Page(page)
                if not p.blocks:
                    out.append("")
                    continue
                nodes = p.contents()
                known = {}
                if sent is None:
                    known = {t["path"]: (t["varied"], t["style"], t["repeats"]) for t in own_tree or ()}
                elif len(sent.value[0]):
                    keys, values = sent.value
                    host = _host_hash(host_of(url))
                    wanted = np.array([_node_key(host, x, c) for x, c in nodes.items()], dtype=np.uint64)
                    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                    known = {x: values[i] for x, i, found in zip(nodes, at.tolist(), (keys[at] == wanted).tolist(), strict=True) if found}
                varied, style, repeats = np.array([known.get(x, (1.0, 1.0, 0.0)) for x in p.path]).T
                content = content_importance(p.priors(), varied, repeats, prior_weight)
                value = OWN_SHARE * content + (1 - OWN_SHARE) * p.importance(content, style)
                out.append("\n".join(t for n, t in p.blocks if value[n] >= low))
            yield pa.record_batch([b.column("page_id").cast(pa.int64()), b.column("url").cast(pa.string()), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    return run


def extract(
    pages: DataFrame, low: float = 0.5, prior_weight: float = 5.0, host_weight: float = 20.0, broadcast_rows: int = 100_000, hot_pages: int = 50_000, tree: bool = True
) -> DataFrame:
    """page_id, url, text: the article of every page (see the module's docstring). Without tree, the priors alone decide."""
    pages = pages.select("page_id", "url", "html")
    spark = pages.sparkSession
    result = "page_id bigint, url string, text string"
    keys, values = np.zeros(0, dtype=np.uint64), []
    if tree:
        nodes = written(pages.select("url", "html").mapInArrow(tidy(_nodes), _NODES), "nodes")
        trees = style_tree(nodes, host_weight, hot_pages)
        dropped(nodes)
        if trees.count() > broadcast_rows:
            numbered = written(pages.withColumn("row", F.monotonically_increasing_id()), "pages")
            of_pages = numbered.select("row", "url", "html").mapInArrow(tidy(_page_nodes), "row bigint, host string, path bigint, content bigint")
            found = lookup(of_pages, trees, ["host", "path", "content"], "same", hot_pages).groupBy("row").agg(F.collect_list(F.struct("path", "varied", "style", "repeats")).alias("tree"))
            return numbered.join(found, "row", "left").select("page_id", "url", "html", "tree").mapInArrow(tidy(_kept(None, low, prior_weight)), result)
        rows = {_node_key(_hash(r["host"]), r["path"], r["content"]): (r["varied"], r["style"], r["repeats"]) for r in trees.toLocalIterator()}
        keys = np.array(sorted(rows), dtype=np.uint64)
        values = [rows[k] for k in sorted(rows)]
    return pages.mapInArrow(tidy(_kept(spark.sparkContext.broadcast((keys, values)), low, prior_weight)), result)


def _page_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, "html"):
        rows = [(row, host_of(url), p, c) for row, url, page in zip(*(b.column(c).to_pylist() for c in ("row", "url", "html")), strict=True) for p, c in Page(page).contents().items()]
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        yield pa.record_batch([pa.array(list(c), pa.string() if i == 1 else pa.int64()) for i, c in enumerate(columns)], names=["row", "host", "path", "content"])
