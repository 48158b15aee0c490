"""Operator 6: main text of web pages by boosted trees over DOM nodes."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bound of training: labelled pages, those that mark their content, the first by hash of the id.
PAGES = 400
TREES, DEPTH, RATE, BINS = 40, 3, 0.25, 32

_MARKS = r"(?i)<(article|main)[\s/>]"
_NAME, _TAG_END = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)"), re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"(?:^|\s)(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_BLOCK = frozenset("html body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in "script style noscript template svg iframe object textarea title".split()}
_IN_HEAD = frozenset("head html base basefont bgsound link meta title script style noscript template noframes".split())
_CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"})}
_CONTENT, _AROUND = frozenset(("article", "main")), frozenset(("nav", "footer", "aside", "header"))
_HEADINGS, _LISTS, _TABLES = frozenset("h1 h2 h3 h4 h5 h6".split()), frozenset("ul ol li dl dt dd".split()), frozenset("table tbody thead tfoot tr td th".split())
NAMES = (
    "depth", "chars", "link_share", "tags", "density", "punctuation", "word_length", "text_share", "position", "siblings", "index", "alike", "sibling_chars", "before", "after",
    "parent_density", "is_text", "is_heading", "is_paragraph", "is_list", "is_table", "is_division", "is_content", "is_around", "attributes", "path_attributes", "under_around",
)


@dataclass
class Tree:
    """Nodes in document order, parents first: block elements, and '#text' for each run of text in one, inline elements within it included."""

    tags: list[str] = field(default_factory=lambda: ["#root"])
    parents: list[int] = field(default_factory=lambda: [-1])
    tokens: list[tuple[str, ...]] = field(default_factory=lambda: [()])
    texts: list[str] = field(default_factory=lambda: [""])
    links: list[int] = field(default_factory=lambda: [0])
    inline: list[int] = field(default_factory=lambda: [0])

    def add(self, tag: str, parent: int, tokens: tuple[str, ...] = (), text: str = "", links: int = 0, inline: int = 0) -> int:
        for column, value in zip((self.tags, self.parents, self.tokens, self.texts, self.links, self.inline), (tag, parent, tokens, text, links, inline)):
            column.append(value)
        return len(self.tags) - 1


def _clean(text: str) -> str:
    text = entities.unescape(text) if "&" in text else text
    return "\n".join(line for line in (" ".join(x.split()) for x in text.split("\0")) if line)


class _Tags:
    """Tags of a page in order: next(at) gives (start, end, end tag or not, name, attributes) of the first that begins at or after at; name is empty for comments and declarations.

    A tag ends at the first > outside quotes or, where a quote isn't closed in the rest of the page, at the first >. No place is looked at more than a few times, whatever the page:
    what isn't found once up to the page's end isn't looked for again.
    """

    def __init__(self, page: str):
        self.page, self.last, self.loose = page, page.rfind(">"), False

    def _end(self, at: int) -> int:
        """Where the tag that begins at at ends, past its >."""
        page = self.page
        i = at
        while not self.loose:
            m = _TAG_END.search(page, i)
            if m is None:
                self.loose = True
            elif m[0] == ">":
                return m.end()
            else:
                close = page.find(m[0], m.end())
                if close < 0:
                    self.loose = True
                i = close + 1
        return page.find(">", at) + 1

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        page = self.page
        while True:
            at = page.find("<", at)
            if at < 0 or (at >= self.last and not page.startswith("<!--", at)):
                return None
            c = page[at + 1 : at + 2]
            if c == "!" and page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                return at, len(page) if end < 0 else end + 3, False, "", ""
            if c in ("!", "?"):
                return at, page.find(">", at) + 1, False, "", ""
            if m := _NAME.match(page, at + 1):
                end = self._end(m.end())
                return at, end, bool(m[1]), m[2].lower(), page[m.end() : end - 1]
            at += 1


def parse(page: str) -> Tree:
    """A tree from any text: end tags that fit nothing are skipped, elements left open end with their parent, and a block ends an open paragraph. A head left open ends at the first text or tag that may not stand in it. Head, scripts, styles and comments have no nodes.

    Time grows with the length of the page alone, however it is malformed.
    """
    page = page.replace("\0", " ")
    tree, stack, run, at, tags = Tree(), [0], [], 0, _Tags(page)
    places: dict[str, list[int]] = {}  # by tag, where in the stack its open elements are
    link_depth = links = inline = 0
    head, unclosed = False, set()

    def flush() -> None:
        nonlocal links, inline
        if run:
            text = _clean("".join(run))
            if text:
                tree.add("#text", stack[-1], (), text, min(links, len(text)), inline)
            run.clear()
        links = inline = 0

    def shut_from(i: int) -> None:
        for node in reversed(stack[i:]):
            places[tree.tags[node]].pop()
        del stack[i:]

    def nearest(names) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=0)

    while True:
        found = tags.next(at)
        between = page[at : found[0]] if found else page[at:]
        if head and between.strip():
            head = False
        if between and not head:
            run.append(between)
            if link_depth:
                links += len(between.strip())
        if not found:
            break
        _, at, end, tag, attributes = found
        if not tag:
            continue
        if tag == "head":
            head = not end
            continue
        if head and tag not in _IN_HEAD and (not end or tag == "body"):
            head = False
        if not end and tag in _RAW:
            if tag == "svg" and attributes.endswith("/"):
                continue
            close = None if tag in unclosed else _RAW[tag].search(page, at)
            if close:
                at = close.end()
            elif tag in ("script", "style"):
                at = len(page)
            else:
                unclosed.add(tag)  # only the tag is passed over
            continue
        if head:
            continue
        if tag not in _BLOCK:
            if tag == "a":
                link_depth = 0 if end else 1
            if tag == "br":
                run.append("\0")
            inline += not end
            continue
        flush()
        if end:
            if i := nearest((tag,)):
                shut_from(i)
            continue
        if tree.tags[stack[-1]] == "p":
            shut_from(len(stack) - 1)
        shut, within = _CLOSES.get(tag, ((), ()))
        if shut and (i := nearest(shut)) > nearest(within):
            shut_from(i)
        if tag in ("html", "body") and places.get(tag):
            continue
        tokens = ()
        if "=" in attributes:
            tokens = tuple(t.lower() for a in _ATTRIBUTE.findall(attributes) for t in _TOKEN.findall(a[0] or a[1] or a[2]))
        node = tree.add(tag, stack[-1], tokens)
        if tag not in _VOID:
            places.setdefault(tag, []).append(len(stack))
            stack.append(node)
    flush()
    return tree


def features(tree: Tree, weights: dict[str, float], plain: bool = False) -> np.ndarray:
    """A row of len(NAMES) numbers a node. ``plain`` looks at article, nav and their like as if they were div, for training on pages without them."""
    n = len(tree.tags)
    tags = ["div" if plain and t in _CONTENT | _AROUND else t for t in tree.tags]
    parents = tree.parents
    chars, links, inner, words, marks = ([0] * n for _ in range(5))
    starts, total = [0] * n, 0
    children: list[list[int]] = [[] for _ in range(n)]
    for i in range(n):
        starts[i] = total
        if i:
            children[parents[i]].append(i)
        if text := tree.texts[i]:
            chars[i], links[i], words[i] = len(text), tree.links[i], text.count(" ") + text.count("\n") + 1
            marks[i] = text.count(",") + text.count(".") + text.count(";") + text.count("!") + text.count("?")
            total += chars[i]
        inner[i] = 1 + tree.inline[i]
    for i in range(n - 1, 0, -1):
        p = parents[i]
        chars[p] += chars[i]
        links[p] += links[i]
        inner[p] += inner[i]
        words[p] += words[i]
        marks[p] += marks[i]
    depth, own, path, under = [0] * n, [0.0] * n, [0.0] * n, [0] * n
    index, siblings, alike, mean, before, after = [0.0] * n, [1] * n, [1.0] * n, [0.0] * n, [0] * n, [0] * n
    for i in range(1, n):
        p = parents[i]
        depth[i] = depth[p] + 1
        own[i] = sum(weights.get(t, 0.0) for t in tree.tokens[i]) if tree.tokens[i] else 0.0
        path[i] = path[p] + own[i]
        under[i] = under[p] or tags[i] in _AROUND
    for p in range(n):
        if own_children := children[p]:
            count, kinds, all_chars = len(own_children), Counter(tags[c] for c in own_children), sum(chars[c] for c in own_children)
            for k, c in enumerate(own_children):
                index[c], siblings[c], alike[c] = k / count, count, kinds[tags[c]] / count
                mean[c] = (all_chars - chars[c]) / max(count - 1, 1)
                before[c] = chars[own_children[k - 1]] if k else 0
                after[c] = chars[own_children[k + 1]] if k + 1 < count else 0
    x = np.zeros((n, len(NAMES)))
    c, t, w, total = np.array(chars, float), np.array(inner, float), np.maximum(words, 1), max(total, 1)
    density = np.log1p(c / t)
    kind = [(s == "#text", s in _HEADINGS, s == "p", s in _LISTS, s in _TABLES, s in ("div", "section"), s in _CONTENT, s in _AROUND) for s in tags]
    columns = [depth, np.log1p(c), np.array(links) / np.maximum(c, 1), np.log1p(t), density, np.array(marks) / w, c / w, c / total, np.array(starts) / total, np.log1p(siblings), index, alike, np.log1p(mean), np.log1p(before), np.log1p(after), density[np.maximum(parents, 0)]]
    x[:, :16] = np.column_stack(columns)
    x[:, 16:24] = kind
    x[:, 24], x[:, 25], x[:, 26] = own, path, under
    return x


@dataclass
class Boosted:
    """Trees of one depth: per tree the feature and cut of each inner node, then the leaves' values."""

    base: float
    splits: np.ndarray  # trees, inner nodes
    cuts: np.ndarray
    leaves: np.ndarray
    weights: dict[str, float]

    def probability(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        rows, depth = np.arange(len(x)), int(np.log2(self.leaves.shape[1])) if len(self.leaves) else 0
        for split, cut, leaf in zip(self.splits, self.cuts, self.leaves):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, split[node]] > cut[node])
            score += leaf[node - (len(split))]
        return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, penalty: float = 1.0) -> Boosted:
    """Gradient boosting for the logistic loss, with second-order gains over histograms."""
    if not len(x) or y.min() == y.max():
        return Boosted(0.0 if not len(x) else (4.0 if y[0] else -4.0), np.zeros((0, 0), int), np.zeros((0, 0)), np.zeros((0, 1)), {})
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    coded = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)])
    base = float(np.log(y.mean() / (1 - y.mean())))
    score, inner = np.full(len(x), base), (1 << depth) - 1
    splits, cuts, leaves = np.zeros((trees, inner), int), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h, node = p - y, np.maximum(p * (1 - p), 1e-6), np.zeros(len(x), np.int64)
        for k in range(inner):
            here = np.flatnonzero(node == k)
            if len(here):
                best, gs, hs = 1e-6, g[here].sum(), h[here].sum()
                for f in range(x.shape[1]):
                    if len(edges[f]):
                        code = coded[here, f]
                        lg = np.cumsum(np.bincount(code, g[here], len(edges[f]) + 1))[:-1]
                        lh = np.cumsum(np.bincount(code, h[here], len(edges[f]) + 1))[:-1]
                        gain = lg**2 / (lh + penalty) + (gs - lg) ** 2 / (hs - lh + penalty) - gs**2 / (hs + penalty)
                        if gain.max() > best:
                            best, splits[t, k], cuts[t, k] = gain.max(), f, edges[f][gain.argmax()]
                node[here] = 2 * k + 1 + (x[here, splits[t, k]] > cuts[t, k])
        leaf = node - inner
        sums = [np.bincount(leaf, v, inner + 1) for v in (g, h)]
        leaves[t] = -rate * sums[0] / (sums[1] + penalty)
        score += leaves[t][leaf]
    return Boosted(base, splits, cuts, leaves, {})


def decode(parents: list[int], p: np.ndarray) -> np.ndarray:
    """The likeliest choice of nodes in which every chosen node's ancestors are chosen too; ties choose."""
    n = len(parents)
    yes, no = np.log(np.clip(p, 1e-9, 1)).tolist(), np.log(np.clip(1 - p, 1e-9, 1)).tolist()
    for i in range(n - 1, 0, -1):
        yes[parents[i]] += max(yes[i], no[i])
        no[parents[i]] += no[i]
    chosen = np.zeros(n, bool)
    chosen[0] = True
    for i in range(1, n):
        chosen[i] = chosen[parents[i]] and yes[i] >= no[i]
    return chosen


def marked(tree: Tree) -> np.ndarray | None:
    """Labels from a page that says where its content is: 1 for nodes with text in article or main but not in a nav, footer, aside or header there. None where it doesn't."""
    if not _CONTENT & set(tree.tags):
        return None
    n, inside = len(tree.tags), [False] * len(tree.tags)
    y = np.zeros(n)
    for i in range(1, n):
        tag = tree.tags[i]
        inside[i] = tag in _CONTENT or (inside[tree.parents[i]] and tag not in _AROUND)
        y[i] = inside[i] and tag == "#text"
    for i in range(n - 1, 0, -1):
        y[tree.parents[i]] = max(y[tree.parents[i]], y[i])
    return y


def fit(pages: list[str]) -> Boosted:
    """Train on the pages that mark their content. Each is seen twice: as it is, and with article, nav and their like taken for div, so that pages without them are read as well.

    Every attribute token has a weight, the log of its odds for content; a rare one's is drawn towards 0 by half for every three occurrences that it lacks.
    """
    examples = [(tree, y) for tree in map(parse, pages) if (y := marked(tree)) is not None]
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for tree, y in examples:
        for own, label in zip(tree.tokens, y):
            counts[int(label)].update(set(own))
    total = [1 + sum(int((y == label).sum()) for _, y in examples) for label in (0, 1)]
    weights = {}
    for w in sorted(counts[0] | counts[1]):
        n = counts[0][w] + counts[1][w]
        weights[w] = float(np.log((counts[1][w] + 1) / total[1]) - np.log((counts[0][w] + 1) / total[0])) * n * n / (n * n + 9)
    xs = [features(tree, weights, plain) for tree, _ in examples for plain in (False, True)]
    ys = [y for _, y in examples for _ in range(2)]
    model = boost(np.vstack(xs) if xs else np.zeros((0, len(NAMES))), np.concatenate(ys) if ys else np.zeros(0))
    model.weights = weights
    return model


def train(pages: DataFrame, sample: int = PAGES) -> Boosted:
    """fit() on at most ``sample`` pages that hold an article or main element, in any case of letters: the first by hash of page_id. Without any, every node is as likely as not and all text is kept.

    The ids are chosen first, then their pages fetched, so the driver never gets more than the sample. Of a page_id that repeats the least page counts; null ids and pages are no examples.
    """
    marking = pages.select("page_id", "html").where(F.col("page_id").isNotNull() & F.col("html").rlike(_MARKS))
    chosen = marking.select("page_id").distinct().sort(F.xxhash64("page_id"), "page_id").limit(sample)
    ids = [r.page_id for r in chosen.collect()]
    if not ids:
        return fit([])
    rows = marking.where(F.col("page_id").isin(ids)).groupBy("page_id").agg(F.min("html").alias("html")).sort(F.xxhash64("page_id"), "page_id")
    return fit([r.html for r in rows.collect()])


def extract_text(page: str, model: Boosted) -> tuple[str, int, int]:
    """(main text, runs of text, runs kept)"""
    return _decide([parse(page)], model)[0]


def _decide(trees: list[Tree], model: Boosted) -> list[tuple[str, int, int]]:
    x = [features(t, model.weights) for t in trees]
    p = model.probability(np.vstack(x))
    out, at = [], 0
    for tree in trees:
        n = len(tree.tags)
        chosen = decode(tree.parents, p[at : at + n])
        at += n
        runs = [i for i in range(n) if tree.texts[i]]
        kept = [tree.texts[i] for i in runs if chosen[i]]
        out.append(("\n".join(kept), len(runs), len(kept)))
    return out


def extract(pages: DataFrame, model: Boosted) -> DataFrame:
    """(page_id, text, n_runs, n_kept) of every page, in one pass without a shuffle.

    text joins the kept runs of text by line breaks. A null html gives a null text and counts, an empty one an empty text and 0. Pages are read whole
    and need not be well-formed. Repeated rows give repeated rows, a null id stays, an empty table gives none; further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 100):
                batch = whole.slice(at, 100)
                pages = batch.column(1).to_pylist()
                found = iter(_decide([parse(p) for p in pages if p is not None], model) if any(p is not None for p in pages) else ())
                rows = [(None, None, None) if p is None else next(found) for p in pages]
                text, runs, kept = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string()), pa.array(runs, pa.int32()), pa.array(kept, pa.int32())], ["page_id", "text", "n_runs", "n_kept"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "html").mapInArrow(run, f"page_id {kind}, text string, n_runs int, n_kept int")
