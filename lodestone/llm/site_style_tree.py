"""HTML extraction with a site style tree.

The DOMs of a host's pages are merged: an element node of the tree stands for
the same place on many pages, and holds the presentation styles (sequences of
child elements) that pages have there. The node importance is the entropy, to
the base of its number of pages, of its styles; the importance of content is one
less the mean entropy of its features (text runs, link targets, images) over the
pages. The composite importance of a node mixes its own with that of what lies
below, and a branch is noise where it and all below it are under a threshold.
Such branches are cut from every page, and the text of the rest is returned.

The tree is never in one place: its nodes are rows, told apart by a hash of host
and path, counted by grouped aggregation; importance is worked out from the
deepest level up. A node that a single page has is important by definition, and
so is all below it: such rows are dropped before.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.durable import durable

#: Importance below which a branch is noise, and the weight that passes from a node to its styles (per style).
THRESHOLD, GAMMA = 0.35, 0.9
#: Elements nested deeper than this count as children of the element at this depth.
MAX_DEPTH = 64
#: Open elements that are looked through for one that an opening tag ends.
MAX_OPEN = 256
#: Noisy nodes up to which they are sent to every task (8 bytes each); beyond, they are joined to the pages by a shuffle.
BROADCAST_NODES = 2_000_000

_TAG = re.compile(r"<(/?)([a-z][a-z0-9:-]*)([^<>\"']*+)(>|[<\"'])?", re.I)
#: Elements whose content is no text of the page.
_RAW = frozenset("script style title noscript template iframe".split())
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in _RAW}
_ATTRIBUTE = re.compile(r"(class|id|style|align|width|height|bgcolor|href|src)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_VOID = frozenset("area base br col embed hr input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body br dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that an opening tag ends, and those beyond which it doesn't look for them.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_CLOSES_P = _BLOCK - {"br", "html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "option"}
_WALLS = frozenset("ul ol dl table td th tr div article section main body html select nav header footer aside form".split())


class _Tokens:
    """The tags of a page, in time that grows with its length: what is known not to follow isn't looked for again."""

    def __init__(self, source: str):
        self.source = source
        self.missing: set[str] = set()

    def _find(self, what: str, at: int) -> int:
        if what in self.missing:
            return -1
        found = self.source.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def _end_of_tag(self, at: int) -> int:
        """The place of the > that ends a tag, from a place in it outside quotes; -1 where there is none."""
        source, n = self.source, len(self.source)
        while at < n:
            c = source[at]
            if c == ">":
                return at
            if c in "\"'":
                at = self._find(c, at + 1)
                if at < 0:
                    return -1
            at += 1
        return -1

    def __iter__(self) -> Iterator[tuple[int, int, bool, str, str]]:
        """(start, end, whether it closes, name, attributes); no name for what is skipped."""
        source, at, unended = self.source, 0, False
        while (start := source.find("<", at)) >= 0:
            at = start + 1
            if source.startswith("<!--", start):
                end = self._find("-->", start + 4)
                if end >= 0:
                    at = end + 3
                    yield start, at, False, "", ""
                    continue
            if source.startswith(("<!", "<?"), start):
                end = self._find(">", start)
                if end >= 0:
                    at = end + 1
                    yield start, at, False, "", ""
                continue
            m = _TAG.match(source, start)
            if not m:
                continue
            if m[4] == ">":
                end = m.end() - 1
            else:
                # beyond an attribute in quotes; once no > follows from somewhere, none follows from further on but within quotes
                end = -1 if unended else self._end_of_tag(m.end(3))
                if end < 0:
                    unended = self._find(">", start) < 0
                    if "\"" in self.missing or "'" in self.missing:
                        end = self._find(">", start)
                    if end < 0:
                        continue
            name, at = m[2].lower(), end + 1
            if name in _RAW and not m[1] and f"</{name}" not in self.missing:
                over = _RAW_END[name].search(source, at)
                if over:
                    at = over.end()
                    yield start, at, False, "", ""
                    continue
                self.missing.add(f"</{name}")
            yield start, at, bool(m[1]), name, source[m.start(3) : end]


class Page:
    """The element nodes of a page in document order, with their places in the host's style tree."""

    __slots__ = ("parent", "sign", "kids", "depth", "text", "broken", "features", "node", "style")

    def __init__(self, host: str, source: str):
        self.parent, self.sign, self.kids, self.depth = [-1], ["#page"], [[]], [0]
        self.text: list[str | None] = [None]
        self.broken, self.features = [False], [()]
        self._parse(source)
        self._place(host)

    def _add(self, parent: int, sign: str, text: str | None = None, broken: bool = False, features: tuple = ()) -> int:
        k = len(self.sign)
        self.parent.append(parent)
        self.sign.append(sign)
        self.kids.append([])
        self.depth.append(self.depth[parent] + 1)
        self.text.append(text)
        self.broken.append(broken)
        self.features.append(features)
        self.kids[parent].append(k)
        return k

    def _parse(self, source: str) -> None:
        # name, node and the link around: its own, or that of the element above
        stack: list[tuple[str, int, str]] = [("", 0, "")]
        open_names: dict[str, int] = {}
        broken, last = False, 0

        def cut(i: int) -> None:
            for name, _, _ in stack[i:]:
                open_names[name] -= 1
            del stack[i:]

        def run(text: str) -> None:
            nonlocal broken
            if text.isspace() or not text:
                if text and self.text[-1] and not self.text[-1].endswith(" "):
                    self.text[-1] += " "
                return
            squeezed = " ".join(text.split())
            shown = entities.unescape(squeezed) if "&" in squeezed else squeezed
            shown = (" " if text[0].isspace() else "") + shown + (" " if text[-1].isspace() else "")
            link = stack[-1][2]
            self._add(stack[-1][1], "#text", shown, broken, (squeezed, f"href:{link}") if link else (squeezed,))
            broken = False

        for start, end, closes, name, attributes in _Tokens(source):
            if start > last:
                run(source[last:start])
            last = end
            if not name:
                continue
            if name in _BLOCK:
                broken = True
            if closes:
                if open_names.get(name):
                    i = len(stack) - 1
                    while stack[i][0] != name:
                        i -= 1
                    cut(i)
                continue
            if name in _VOID:
                continue
            ends = _ENDS.get(name)
            if ends is None and name in _CLOSES_P:
                ends = {"p"}
            if ends and any(open_names.get(x) for x in ends):
                # no further up than an element may be left open by the page's author
                for i in range(len(stack) - 1, max(0, len(stack) - 1 - MAX_OPEN), -1):
                    if stack[i][0] in ends:
                        cut(i)
                        break
                    if stack[i][0] in _WALLS:
                        break
            sign, link, image = name, "", ""
            if attributes:
                shown = []
                for a in _ATTRIBUTE.finditer(attributes):
                    key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                    if key == "href":
                        link = value
                    elif key == "src":
                        image = value
                    else:
                        shown.append(f"{key}={value}")
                if shown:
                    sign = name + "|" + "|".join(sorted(shown))
            if name == "img":
                self._add(stack[-1][1], sign, None, False, (f"src:{image}",) if image else ())
                continue
            above = stack[-1][1]
            k = self._add(above, sign) if self.depth[above] < MAX_DEPTH else above
            if not attributes.endswith("/"):
                stack.append((name, k, link or stack[-1][2]))
                open_names[name] = open_names.get(name, 0) + 1
        if last < len(source):
            run(source[last:])

    def _place(self, host: str) -> None:
        digest = xxhash.xxh64_intdigest
        n = len(self.sign)
        self.node, self.style = [0] * n, [0] * n
        self.node[0] = digest(host.encode("utf-8", "surrogatepass"))
        sign, kids, node, style = self.sign, self.kids, self.node, self.style
        for k in range(n):
            if own := kids[k]:
                at = style[k] = digest(f"{node[k]}:{','.join([sign[j] for j in own])}".encode("utf-8", "surrogatepass"))
                for i, j in enumerate(own):
                    node[j] = digest(f"{at}/{i}".encode())

    def pruned(self, noisy: "_Noisy") -> tuple[str, int]:
        """The text without noisy branches, and how many branches went."""
        gone, removed, broken, out = [False] * len(self.sign), 0, False, []
        bad = noisy.of(self.node)
        for k in range(len(self.sign)):
            above = self.parent[k]
            if above >= 0 and gone[above]:
                gone[k] = True
            elif bad[k]:
                gone[k] = True
                removed += 1
            broken |= self.broken[k]
            if (text := self.text[k]) is not None and not gone[k]:
                if broken:
                    out.append("\n")
                broken = False
                out.append(text)
        return re.sub(r" *\n *", "\n", re.sub(" {2,}", " ", "".join(out))).strip(), removed


class _Noisy:
    def __init__(self, ids: np.ndarray):
        self.ids = np.sort(ids)

    def of(self, nodes: list[int]) -> list[bool]:
        if not len(self.ids):
            return [False] * len(nodes)
        x = np.array(nodes, np.uint64).view(np.int64)
        place = np.minimum(np.searchsorted(self.ids, x), len(self.ids) - 1)
        return (self.ids[place] == x).tolist()


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and a leading www.; "" where there is none."""
    low = F.lower(F.coalesce(url, F.lit("")))
    return F.regexp_replace(F.regexp_extract(low, r"^[a-z][a-z0-9+.-]*://([^/?#]*@)?([^/?#:]*)", 2), r"^www\.", "")



def _emit_tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each node and each feature of a page. what: 0 a style with k children, 1 that the node is a leaf, 2 a feature of it."""
    digest = xxhash.xxh64_intdigest
    for batch in batches:
        rows: list[list] = [[], [], [], [], [], []]
        nodes, parents, depths, whats, keys, ks = rows
        for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            page = Page(host, source or "")
            for k in range(len(page.sign)):
                above = page.style[page.parent[k]] if k else 0
                own = page.kids[k]
                found = [(0, page.style[k])] if own else [(1, 0), *((2, digest(f.encode("utf-8", "surrogatepass"))) for f in dict.fromkeys(page.features[k]))]
                for what, key in found:
                    nodes.append(page.node[k])
                    parents.append(above)
                    depths.append(page.depth[k])
                    whats.append(what)
                    keys.append(key)
                    ks.append(len(own))
        wide = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, parents, keys)]
        small = [pa.array(x, pa.int32()) for x in (depths, whats, ks)]
        yield pa.RecordBatch.from_arrays([wide[0], wide[1], small[0], small[1], wide[2], small[2]], ["node", "parent", "depth", "what", "key", "k"])


def _entries(pages: DataFrame) -> DataFrame:
    """(page_id, host, html) of the pages that have an id."""
    return pages.where("page_id is not null").select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))


def style_tree(pages: DataFrame, threshold: float = THRESHOLD, gamma: float = GAMMA) -> DataFrame:
    """(node, parent, depth, pages, styles, importance, composite, noisy): the nodes that two or more pages of a host have.

    parent is the style that the node belongs to; importance is the node's own
    (of its styles, or of its content where it is a leaf).
    """
    rows = _entries(pages).select("host", "html").mapInArrow(_emit_tree, "node long, parent long, depth int, what int, key long, k int")
    counted = rows.groupBy("node", "parent", "depth", "what", "key", "k").agg(F.count("*").alias("n"))
    style = F.col("what") == 0
    feature = F.col("what") == 2
    merged = counted.groupBy("node", "parent", "depth").agg(
        F.sum(F.when(~feature, F.col("n"))).alias("pages"),
        F.count(F.when(style, 1)).alias("styles"),
        F.sum(F.when(style, F.col("n") * F.ln("n"))).alias("nln"),
        F.count(F.when(feature, 1)).alias("features"),
        F.sum(F.when(feature, F.ln("n"))).alias("spread"),
        F.collect_list(F.when(style & (F.col("n") > 1), F.struct("key", "n", "k"))).alias("shared"),
    )
    own = F.when(F.col("styles") > 0, 1 - F.col("nln") / (F.col("pages") * F.ln("pages"))).when(
        F.col("features") > 0, 1 - F.col("spread") / F.ln("pages") / F.col("features")
    )
    nodes = durable(
        merged.where("pages > 1").select(
            "node", "parent", "depth", "pages", "styles", "shared", F.greatest(F.lit(0.0), F.coalesce(own, F.lit(0.0))).alias("importance")
        )
    )
    deepest = nodes.agg(F.max("depth")).first()[0]
    plain = ["node", "parent", "depth", "pages", "styles", "importance"]
    leaf = nodes.where("styles = 0").select(*plain, F.col("importance").alias("composite"), (F.col("importance") < threshold).alias("noisy"))
    whole = leaf
    inner = nodes.where("styles > 0")
    below = None
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        at_leaf = leaf.where(F.col("depth") == depth)
        if below is None:
            below = at_leaf.select("parent", "composite", "noisy")
            continue
        kids = below.groupBy(F.col("parent").alias("key")).agg(F.sum("composite").alias("sum"), F.min("noisy").alias("all_noisy"))
        here = inner.where(F.col("depth") == depth).select(*plain, F.explode_outer("shared").alias("s"))
        here = here.select(*plain, "s.key", "s.n", "s.k").join(kids, "key", "left")
        # pages with a style that no other page has count as fully important
        share = F.coalesce(F.sum("n"), F.lit(0))
        mean = (F.coalesce(F.sum(F.col("n") * F.col("sum") / F.col("k")), F.lit(0.0)) + F.col("pages") - share) / F.col("pages")
        passed = F.pow(F.lit(gamma), F.col("styles"))
        level = here.groupBy(*plain).agg(
            ((1 - passed) * F.col("importance") + passed * mean).alias("composite"), (F.min(F.coalesce("all_noisy", F.lit(False))) & (share == F.col("pages"))).alias("all_noisy")
        )
        level = durable(level.select(*plain, "composite", (F.col("all_noisy") & (F.col("composite") < threshold)).alias("noisy")))
        whole = whole.union(level)
        below = at_leaf.union(level).select("parent", "composite", "noisy")
    return whole


def _prune(noisy_of):
    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hosts, sources = (batch.column(c) for c in ("page_id", "host", "html"))
            out: list[tuple] = []
            for i, (host, source) in enumerate(zip(hosts.to_pylist(), sources.to_pylist())):
                page = Page(host, source)
                text, removed = page.pruned(noisy_of(batch, i))
                out.append((len(page.sign), removed, text))
            n, removed, text = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([ids, hosts, pa.array(n, pa.int32()), pa.array(removed, pa.int32()), pa.array(text, pa.string())], ["page_id", "host", "n_nodes", "n_removed", "text"])

    return prune


def _emit_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, nodes = [], []
        for page_id, host, source in zip(*(batch.column(c).to_pylist() for c in ("page_id", "host", "html"))):
            page = Page(host, source)
            ids += [page_id] * len(page.node)
            nodes += page.node
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.array(nodes, np.uint64).view(np.int64))], ["page_id", "node"])


PRUNED = "page_id long, host string, n_nodes int, n_removed int, text string"


def extract(pages: DataFrame, threshold: float = THRESHOLD, gamma: float = GAMMA, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """(page_id, host, n_nodes, n_removed, text) of every page, without the branches of low importance.

    n_removed counts branches, not all nodes in them. A page that is alone on its
    host loses none. Scripts, styles, titles and comments are never text. Null or
    empty html gives an empty text; null URLs count as one host "". Rows with a
    null page_id are left out; repeated rows are answered one by one and count as
    so many pages. Broken markup is mended as a browser would (open elements are
    ended by the next of their kind). An empty table gives an empty result. Other
    columns, whatever their names, don't matter.
    """
    rows = _entries(pages)
    noisy = durable(style_tree(pages, threshold, gamma).where("noisy").select("node"))
    if noisy.count() <= broadcast_nodes:
        sent = pages.sparkSession.sparkContext.broadcast(noisy.toPandas()["node"].to_numpy(np.int64))

        def everywhere(_batch, _i, kept=[]):  # noqa: B006
            if not kept:
                kept.append(_Noisy(sent.value))
            return kept[0]

        return rows.mapInArrow(_prune(everywhere), PRUNED)
    marks = rows.mapInArrow(_emit_nodes, "page_id long, node long").join(noisy, "node").groupBy("page_id").agg(F.collect_set("node").alias("noisy"))

    def of_page(batch, i):
        return _Noisy(np.array(batch.column("noisy")[i].as_py() or [], np.int64))

    return rows.join(marks, "page_id", "left").mapInArrow(_prune(of_page), PRUNED)


def op2_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extracted text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op2_site_style_tree": op2_site_style_tree}
