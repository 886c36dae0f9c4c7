"""Tree ensembles for many models at once, on quantile bins.

Features are binned once. Trees of many models then grow side by side in
rounds: every open node of every tree gets one histogram of its rows over
(feature, bin), the best cut of each is chosen, and the rows move on. There are
two ways to the same trees, and a test holds them to it:

* a table whose bins fit ``SMALL_BYTES`` is sent to all tasks once, and a task
  grows whole trees of some models (the search space is what is large then);
* any other table stays where it is: a round is one pass over its blocks, an
  aggregate over (tree, node, feature, bin) and a window over the bins.

Draws of rows and features are hashes of ids, trees and nodes, so neither way
depends on how rows are dealt to tasks.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS = 32
#: Bins of a table that is sent to every task; larger tables are never sent.
SMALL_BYTES = 64 << 20
#: Cells of histograms and entries of rows handled at a time inside a task.
CELLS, ENTRIES = 1 << 20, 1 << 21
#: Cells of histograms, and entries (rows of all trees), that a task holds at a time where it grows whole trees: they stay in its cache.
TASK_CELLS, TASK_ENTRIES = 1 << 15, 1 << 16
#: From so many entries a histogram is filled a candidate after the other.
LONG = 4096
#: Bytes of boosted trees' bins that a task keeps beside the table, an entry's features side by side.
OWN_BYTES = 16 << 20
#: Trees of one forest that a task grows side by side.
TREES_AT_ONCE = 64
#: Decimals of a relative gain: sums in another order still give the same cut.
DIGITS = 10
#: The increment and factors of the splitmix64 generator.
_STEP, _MIX = 0x9E3779B97F4A7C15, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


@dataclass(frozen=True)
class Spec:
    """How the trees of a model grow."""

    boost: bool
    trees: int
    depth: int | None = None          # None: no limit
    leaves: int | None = None         # best-first growth up to so many leaves
    min_leaf: int = 1                 # rows of a leaf
    min_weight: float = 0.0           # weight (or hessian) of a leaf
    penalty: float = 0.0              # added to the weight in scores and leaf values
    score: str = "gini"               # gini, entropy, newton (by hessian), variance (by weight)
    node_share: float | None = None   # share of features drawn for each node; 0: the square root
    tree_share: float = 1.0           # share of features drawn for each tree
    row_share: float = 1.0            # share of rows drawn for each tree (boosting)
    rate: float = 1.0


def spec_of(name: str, params: dict) -> Spec:
    """A model's growth from the names and values of its search space; what is not named has the usual default."""
    p = dict(params)
    depth = p.get("max_depth", {"GradientBoosting": 3, "XGBoost": 6}.get(name))
    depth = None if depth in (None, -1) else int(depth)
    trees, rate = p.get("n_estimators", 100), p.get("learning_rate", 0.1)
    if name == "RandomForest":
        share = p.get("max_features", "sqrt")
        return Spec(False, trees, depth, min_leaf=p.get("min_samples_leaf", 1), score=p.get("criterion", "gini"),
                    node_share=0.0 if share == "sqrt" else float(share))
    if name == "GradientBoosting":
        return Spec(True, trees, depth, score="variance", row_share=p.get("subsample", 1.0), rate=rate)
    if name == "XGBoost":
        return Spec(True, trees, depth, min_weight=1.0, penalty=1.0, score="newton", row_share=p.get("subsample", 1.0),
                    tree_share=p.get("colsample_bytree", 1.0), rate=rate)
    if name == "LightGBM":  # rows are drawn only every ``subsample_freq`` trees, by default never
        return Spec(True, trees, depth, leaves=p.get("num_leaves", 31), min_leaf=p.get("min_child_samples", 20), min_weight=1e-3,
                    score="newton", row_share=p.get("subsample", 1.0) if p.get("subsample_freq", 0) else 1.0,
                    tree_share=p.get("colsample_bytree", 1.0), rate=rate)
    raise ValueError(name)


# ------------------------------------------------------------------ hashes
def mixed(*parts) -> np.ndarray:
    """A 64-bit hash of some whole numbers (arrays are matched as numpy does)."""
    h = np.zeros((), np.uint64)
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h ^ np.asarray(p).astype(np.uint64)) + np.uint64(_STEP)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(_MIX[0])
            h = (h ^ (h >> np.uint64(27))) * np.uint64(_MIX[1])
            h = h ^ (h >> np.uint64(31))
    return h


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)


#: Chances of at most 0, 1, 2, ... copies of a row in a drawn sample of the table's size.
_COPIES = np.cumsum(np.exp(-1) / np.cumprod([1, *range(1, 12)]))


def drawn(spec: Spec, seeds: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """How often each tree (row of the result) draws each row of the table."""
    if not spec.boost:
        return np.searchsorted(_COPIES, _unit(mixed(seeds[:, None], 1, ids[None]))).astype(np.float64)
    if spec.row_share >= 1:
        return np.ones((len(seeds), len(ids)))
    return (_unit(mixed(seeds[:, None], 1, ids[None])) < spec.row_share).astype(np.float64)


def tree_features(spec: Spec, seeds: np.ndarray, features: list[np.ndarray]) -> np.ndarray:
    """The features each tree may use, in order; ``features`` are those of its model, of equal number."""
    all_of = np.sort(np.array(features, np.int64), axis=1)
    return _choose(all_of, mixed(seeds[:, None], 2, all_of), spec.tree_share)


def _choose(values: np.ndarray, h: np.ndarray, share: float) -> np.ndarray:
    k = values.shape[1]
    m = max(1, int(k ** 0.5 if share == 0 else k * share))
    if m >= k:
        return values
    return np.sort(np.take_along_axis(values, np.argpartition(h, m - 1, axis=1)[:, :m], axis=1), axis=1)


# ------------------------------------------------------------------ growth
def _parts(spec: Spec, g, d, xp=np):
    """A node's score from its sums ``g`` and ``d``; ``xp``: numpy, or Spark's functions for columns."""
    if spec.boost:
        return g * g / (d + spec.penalty)
    if spec.score == "gini":
        return (g * g + (d - g) * (d - g)) / d
    if xp is np:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(g > 0, g * np.log(g / d), 0) + np.where(d - g > 0, (d - g) * np.log((d - g) / d), 0)
    return (F.when(g > 0, g * F.log(g / d)).otherwise(0.0)
            + F.when(d - g > 0, (d - g) * F.log((d - g) / d)).otherwise(0.0))


@dataclass
class Growth:
    """Nodes of the trees that grow side by side; a tree's root has its tree's number."""

    spec: Spec
    features: np.ndarray                       # a row of features for each tree
    seeds: np.ndarray
    open: np.ndarray = field(init=False)

    def __post_init__(self):
        s = len(self.seeds)
        self.tree, self.depth = np.arange(s), np.zeros(s, np.int64)
        self.key = mixed(self.seeds, 3)
        self.feature, self.bin, self.left = np.full(s, -1), np.zeros(s, np.int64), np.full(s, -1)
        self.parent, self.gain = np.full(s, -1), np.full(s, -1.0)
        self.rows = np.zeros((s, 2), np.int64)  # on the left and right of a node's cut
        self.open = np.arange(s)

    @property
    def count(self) -> int:
        return len(self.seeds)

    def candidates(self, nodes: np.ndarray) -> np.ndarray:
        """Features among which each node's cut is sought, in order."""
        own = self.features[self.tree[nodes]]
        if self.spec.node_share is None:
            return own
        return _choose(own, mixed(self.key[nodes][:, None], own), self.spec.node_share)

    def record(self, nodes, feature, bin_, gain, weight, rows_left, rows):
        """Best cuts of open nodes: relative gain (not above 0: none), the node's weight, rows on the left and in all."""
        good = gain > 0
        self.feature[nodes] = np.where(good, feature, -1)
        self.bin[nodes] = bin_
        self.gain[nodes] = np.where(good, gain * weight, -1.0)
        self.rows[nodes, 0], self.rows[nodes, 1] = rows_left, rows - rows_left

    def expand(self) -> np.ndarray:
        """Cut what is to be cut now; their children become the open nodes. Returns the nodes cut."""
        if self.spec.leaves is None:
            cut = self.open[self.feature[self.open] >= 0]
        else:
            lists = self._lists()
            cut = np.array([i for s in range(len(self.seeds)) for i in self._best_first(s, lists)[1]], np.int64)
        new = len(self.tree) + np.arange(2 * len(cut))
        self.left[cut] = new[::2]
        double = lambda a: np.repeat(a[cut], 2)
        self.tree = np.append(self.tree, double(self.tree))
        self.depth = np.append(self.depth, double(self.depth) + 1)
        self.key = np.append(self.key, mixed(double(self.key), np.tile([1, 2], len(cut))))
        self.parent = np.append(self.parent, np.repeat(cut, 2))
        blank = np.full(len(new), -1)
        self.feature, self.left = np.append(self.feature, blank), np.append(self.left, blank)
        self.bin, self.gain = np.append(self.bin, blank * 0), np.append(self.gain, blank * 1.0)
        self.rows = np.append(self.rows, np.zeros((len(new), 2), np.int64), axis=0)
        deep = np.inf if self.spec.depth is None else self.spec.depth
        self.open = new[(self.rows[cut].ravel() >= max(2, 2 * self.spec.min_leaf)) & (self.depth[new] < deep)]
        return cut

    def _best_first(self, tree: int, lists: tuple[list, list, list]) -> tuple[list[int], list[int]]:
        """Cuts in order of gain until the leaves are used up, and those among them that are not carried out yet."""
        gain, feature, left = lists
        heap, taken, waiting = [(-gain[tree], tree)], [], []
        while heap and len(taken) < self.spec.leaves - 1:
            _, i = heapq.heappop(heap)
            if feature[i] < 0:
                continue
            taken.append(i)
            if left[i] < 0:
                waiting.append(i)
            else:
                for c in (left[i], left[i] + 1):
                    heapq.heappush(heap, (-gain[c], c))
        return taken, waiting

    def _lists(self) -> tuple[list, list, list]:
        """Gain, feature and left child of all nodes: a heap looks at single numbers, which arrays are slow at."""
        return self.gain.tolist(), self.feature.tolist(), self.left.tolist()

    def finish(self) -> np.ndarray:
        """Undo cuts that best-first growth did not take; returns the node that stands for each node."""
        stands = np.arange(len(self.tree))
        if self.spec.leaves is not None:
            taken, lists = np.zeros(len(self.tree), bool), self._lists()
            taken[[i for s in range(len(self.seeds)) for i in self._best_first(s, lists)[0]]] = True
            for i in range(len(self.seeds), len(stands)):  # parents come first
                up = self.parent[i]
                stands[i] = i if taken[up] and stands[up] == up else stands[up]
            self.feature[~taken] = -1
        self.left[self.feature < 0] = -1
        return stands


def histogram(bins: np.ndarray, rows: np.ndarray, node: np.ndarray, candidates: np.ndarray, d: np.ndarray, g: np.ndarray,
              n_bins: int, own: np.ndarray | None = None) -> np.ndarray:
    """``(3, nodes, features, bins)``: rows, sums of d and of g; entry i is row ``rows[i]`` in open node ``node[i]``.

    In memory the bins stand first, so that ``best_cuts`` adds up whole planes. ``own``: the entries' bins,
    a row for each candidate, where they are at hand.
    """
    nodes, m = candidates.shape
    flat, n = bins.T.reshape(-1), len(bins)  # a column after the other: no copy where ``bins`` is in Fortran order
    if len(rows) < LONG:
        if own is None:
            own = flat[candidates.T[:, node] * n + rows]
        cell = (own * np.int64(nodes * m) + (node * m + np.arange(m)[:, None])).ravel()
        size = nodes * m * n_bins
        sums = [np.bincount(cell, None if v is None else np.tile(v, m), size) for v in (None, d, g)]
        out = np.array(sums, np.float64).reshape(3, n_bins, nodes, m)
    else:
        out = np.zeros((3, n_bins, nodes, m))
        for at in range(0, len(rows), ENTRIES):
            r, j = rows[at:at + ENTRIES], node[at:at + ENTRIES]
            first, weights = j * n_bins, [None if v is None else v[at:at + ENTRIES] for v in (None, d, g)]
            for s in range(m):
                cell = first + (flat[(candidates[:, s] * n)[j] + r] if own is None else own[s, at:at + ENTRIES])
                for k, v in enumerate(weights):
                    out[k, :, :, s] += np.bincount(cell, v, nodes * n_bins).reshape(nodes, n_bins).T
    return np.moveaxis(out, 1, 3)


def best_cuts(spec: Spec, hist: np.ndarray, candidates: np.ndarray):
    """For each open node: feature, bin, relative gain, weight, rows left and in all (ties: smallest feature, then bin)."""
    cells = np.moveaxis(hist, 3, 1)
    until = np.empty(cells.shape)  # sums up to each bin, a plane of all nodes and features after the other
    until[:, 0] = cells[:, 0]
    for k in range(1, cells.shape[1]):
        np.add(until[:, k - 1], cells[:, k], out=until[:, k])
    n, d, g = until
    bins, nodes, m = n.shape
    nt, dt, gt = until[:, -1]
    ok = (cells[0] > 0) & (n < nt)  # a cut behind an empty bin is the one before it
    if spec.min_leaf > 1:
        ok &= (n >= spec.min_leaf) & (nt - n >= spec.min_leaf)
    if spec.min_weight > 0:
        ok &= (d >= spec.min_weight) & (dt - d >= spec.min_weight)
    with np.errstate(divide="ignore", invalid="ignore"):
        whole = _parts(spec, gt, dt)
        if 3 * np.count_nonzero(ok) > ok.size:
            gain = (_parts(spec, g, d) + _parts(spec, gt - g, dt - d) - whole) / dt
            gain[~(ok & np.isfinite(gain))] = 0.0
            gain = np.round(gain, DIGITS)
        else:  # few cells can be cut behind: only those are looked at
            at = np.flatnonzero(ok)
            column = at % (nodes * m)
            dl, gl, own_d, own_g = d.ravel()[at], g.ravel()[at], dt.ravel()[column], gt.ravel()[column]
            found = (_parts(spec, gl, dl) + _parts(spec, own_g - gl, own_d - dl) - whole.ravel()[column]) / own_d
            gain = np.zeros(ok.shape)
            gain.ravel()[at] = np.round(np.where(np.isfinite(found), found, 0.0), DIGITS)
    i = np.arange(nodes)
    f = gain.max(0).argmax(1)
    chosen = gain[:, i, f]
    b = chosen.argmax(0)
    return candidates[i, f], b, chosen[b, i], dt[:, 0], n[b, i, f], nt[:, 0]


def _weights(spec: Spec, w: np.ndarray, h: np.ndarray | None) -> np.ndarray:
    return h if spec.score == "newton" else w


def leaf_values(spec: Spec, w, g, h) -> np.ndarray:
    """Values of nodes from their sums: the share of class 1, or a Newton step."""
    with np.errstate(divide="ignore", invalid="ignore"):
        v = spec.rate * g / (h + spec.penalty) if spec.boost else g / w
    return np.nan_to_num(v, nan=0.0, posinf=0.0, neginf=0.0)


def _by_sibling(bins: np.ndarray, growth: Growth, known: dict, rows: np.ndarray, node: np.ndarray, candidates: np.ndarray,
                d: np.ndarray, g: np.ndarray, n_bins: int, own_bins: np.ndarray | None, entries: np.ndarray) -> np.ndarray:
    """``histogram`` of all open nodes: of two siblings the one with fewer rows is counted, the other is what their parent has beyond it.

    ``known``: histograms by node; the open nodes' ones are added and their parents' taken out. ``own_bins``: bins of
    all entries, of which ``entries`` are here.
    """
    nodes, place = growth.open, {i: k for k, i in enumerate(growth.open.tolist())}
    count = np.bincount(node, minlength=len(nodes))
    pairs = []  # place of the larger one, of the smaller one, and the parent
    for i, k in place.items():
        up = int(growth.parent[i])
        if up in known and i == growth.left[up] and (other := place.get(i + 1)) is not None:
            pairs.append((k, other, up) if count[k] >= count[other] else (other, k, up))
    counted = np.ones(len(nodes), bool)
    counted[[p[0] for p in pairs]] = False
    to = np.cumsum(counted) - 1
    own = counted[node]
    hist = np.moveaxis(np.empty((3, n_bins, len(nodes), candidates.shape[1])), 1, 3)
    here = None if own_bins is None else own_bins.take(entries[own], axis=1)
    hist[:, counted] = histogram(bins, rows[own], to[node[own]], candidates[counted], d[own], g[own], n_bins, here)
    for large, small, up in pairs:
        hist[:, large] = known[up] - hist[:, small]
    for up in {int(growth.parent[i]) for i in nodes}:
        known.pop(up, None)
    known.update((i, hist[:, k]) for i, k in place.items())
    return hist


def grow(bins: np.ndarray, growth: Growth, w: np.ndarray, g: np.ndarray, h: np.ndarray | None,
         n_bins: int = BINS, placed: bool = True, columns: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Grow trees inside a task; ``w, g, h`` have a row for each tree, a weight of 0 leaves a row out.

    Returns the nodes' values and, if ``placed``, the leaf of each (tree, row), rows left out included.
    ``columns``: the bins in Fortran order, where a caller grows more than one tree over them.
    """
    spec, mask, columns = growth.spec, w > 0, np.asfortranarray(bins) if columns is None else columns
    at, row = np.nonzero(mask)  # an entry for each row of each tree: its node, at first the root
    w, g, h = (x if x is None else x[mask] for x in (w, g, h))
    d, live = _weights(spec, w, h), np.arange(len(at))
    known = {}  # histograms of nodes that may still be cut, where a tree's nodes share their candidates
    own_bins = None
    if spec.node_share is None and len(at) * growth.features.shape[1] <= OWN_BYTES:  # looked up once, not in each round
        ends = np.searchsorted(at, np.arange(growth.count + 1))
        own_bins = np.concatenate([columns.T[f].take(row[a:b], axis=1) for f, a, b in zip(growth.features, ends, ends[1:], strict=False)], axis=1)
    while len(growth.open):
        moving = (growth.feature >= 0) & (growth.left < 0)  # nodes whose cut waits, and open ones
        moving[growth.open] = True
        live = live[moving[at[live]]]
        place = np.full(len(growth.tree), -1)
        place[growth.open] = np.arange(len(growth.open))
        local = place[at[live]]
        if not spec.boost:  # a node of one class has no cut that gains
            none, each, rows_of = (np.bincount(local, x, len(growth.open)) for x in (g[live] == 0, g[live] == d[live], None))
            both = (none < rows_of) & (each < rows_of)
            kept = both[local]
            live, local, growth.open = live[kept], (np.cumsum(both) - 1)[local[kept]], growth.open[both]
            if not len(live):
                break
        per = max(1, min(CELLS, CELLS if spec.node_share is None else TASK_CELLS) // (growth.candidates(growth.open[:1]).shape[1] * n_bins))
        for k in range(0, len(growth.open), per):
            nodes = growth.open[k:k + per]
            own = (local >= k) & (local < k + per)
            e, candidates, of = live[own], growth.candidates(nodes), local[own] - k
            if spec.node_share is None and len(nodes) == len(growth.open):
                hist = _by_sibling(columns, growth, known, row[e], of, candidates, d[e], g[e], n_bins, own_bins, e)
            else:
                hist = histogram(columns, row[e], of, candidates, d[e], g[e], n_bins)
            growth.record(nodes, *best_cuts(spec, hist, candidates))
        if not len(growth.expand()):
            break
        node = at[live]
        cut = growth.left[node] >= 0
        e, node = live[cut], node[cut]
        at[e] = growth.left[node] + (columns[row[e], growth.feature[node]] > growth.bin[node])
    at = growth.finish()[at]
    sums = [np.bincount(at, x, len(growth.tree)) if x is not None else None for x in (w, g, h)]
    return leaf_values(spec, *sums), descend(growth, bins) if placed else None


@dataclass
class Grown:
    """What is left of grown trees: ``count`` roots first, then the other nodes."""

    count: int
    left: np.ndarray
    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray


def descend(growth: Growth | Grown, bins: np.ndarray) -> np.ndarray:
    """The node of each (tree, row) in trees as far as they are grown; a row that has reached a leaf is not looked at again."""
    n, width = bins.shape
    flat, left = np.ascontiguousarray(bins).reshape(-1), growth.left
    at = np.repeat(np.arange(growth.count)[:, None], n, axis=1)
    step = max(1, TASK_ENTRIES // max(1, n))
    for k in range(0, growth.count, step):
        out = at[k:k + step].reshape(-1)  # a view
        live = np.flatnonzero(left[out] >= 0)
        node, first = out[live], live % max(1, n) * width
        while len(live):
            node = left[node] + (flat[first + growth.feature[node]] > growth.bin[node])
            inner = left[node] >= 0
            if not inner.all():
                out[live[~inner]] = node[~inner]
                live, node, first = live[inner], node[inner], first[inner]
    return at


def trees_at_once(rows: int) -> int:
    """How many trees of a forest grow side by side in a task: fewer over more rows, so its memory stays bounded."""
    return max(1, min(TREES_AT_ONCE, TASK_ENTRIES // max(1, rows)))


def _blocks(trees: int, rows: int) -> list[tuple[int, int]]:
    """A forest's trees in blocks for tasks: about 16 of them where the table is long."""
    step = min(TREES_AT_ONCE, max(trees_at_once(rows), -(-trees // 16)))
    return [(k, min(k + step, trees)) for k in range(0, trees, step)]


# ------------------------------------------------------------------ binned tables
@dataclass
class Binned:
    """Rows ``(id, fold, y, w, bins)`` and the features' edges: bin b holds values above edge b - 1 up to edge b."""

    rows: DataFrame
    edges: list[np.ndarray]
    n_rows: int

    @property
    def small(self) -> bool:
        return self.n_rows * (len(self.edges) + 32) <= SMALL_BYTES


def quantile_edges(rows: DataFrame, n_features: int, n_bins: int = BINS) -> list[np.ndarray]:
    """Edges at the quantiles of each value of ``x``, nulls and NaN left out (features x bins numbers come back)."""
    probs = F.array(*[F.lit(i / n_bins) for i in range(1, n_bins)])
    found = (rows.select(F.posexplode("x").alias("f", "v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
             .groupBy("f").agg(F.percentile_approx("v", probs, 10_000).alias("e")).collect())
    of = {r["f"]: np.unique(r["e"]) for r in found}
    return [of.get(i, np.empty(0)) for i in range(n_features)]


def bin_values(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bins of a matrix of values; NaN stands in the first bin."""
    out = np.zeros(x.shape, np.uint8)
    for f, e in enumerate(edges):
        out[:, f] = np.where(np.isnan(x[:, f]), 0, np.searchsorted(e, x[:, f], "left"))
    return out


def binned(rows: DataFrame, n_features: int, n_bins: int = BINS, edges: list[np.ndarray] | None = None) -> Binned:
    """``rows``: ``id long, x array<double>, y double, w double`` and a ``fold``; written once."""
    from horizonkit.session import written
    edges = edges or quantile_edges(rows, n_features, n_bins)

    def run(batches):
        for b in batches:
            x = np.asarray(b.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, n_features)
            bins = bin_values(x, edges)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), b.column(4),
                                              pa.array([v.tobytes() for v in bins], pa.binary())], ["id", "fold", "y", "w", "bins"])

    picked = rows.select(F.col("id").cast("long"), F.col("x").cast("array<double>"), F.col("fold").cast("int"),
                         F.col("y").cast("double"), F.coalesce(F.col("w").cast("double"), F.lit(1.0)).alias("w"))
    table = written(picked.where("x is not null and y is not null").mapInArrow(run, "id long, fold int, y double, w double, bins binary"), "binned")
    return Binned(table, edges, table.count())


def _block(b: pa.RecordBatch, n_features: int):
    """Arrays of an Arrow batch of binned rows; a missing fold is -1."""
    ids = np.asarray(b.column(0).fill_null(0))
    fold = np.asarray(b.column(1).fill_null(-1))
    y, w = np.asarray(b.column(2)), np.asarray(b.column(3))
    bins = np.frombuffer(b"".join(b.column(4).to_pylist()), np.uint8).reshape(-1, n_features)
    return ids, fold, y, w, bins


# ------------------------------------------------------------------ ensembles
@dataclass
class Ensemble:
    """Grown trees of one model, one after the other; boosted ones add up to ``start``."""

    spec: Spec
    start: float = 0.0
    groups: list[Grown] = field(default_factory=list)

    def margins(self, bins: np.ndarray, stages: bool = False) -> np.ndarray:
        """Sum of the trees' values for each row, or (``stages``) after each group of trees."""
        total, steps = np.full(len(bins), self.start), []
        for g in self.groups:
            total = total + g.value[descend(g, bins)].sum(0)
            if stages:
                steps.append(total)
        return np.array(steps) if stages else total

    def probability(self, bins: np.ndarray) -> np.ndarray:
        m = self.margins(bins)
        return 1 / (1 + np.exp(-np.clip(m, -700, 700))) if self.spec.boost else m / max(1, self.spec.trees)

    def packed(self, edges: list[np.ndarray]) -> bytes:
        """Trees and the features' edges as arrays in one compressed file."""
        import io
        import json
        out = io.BytesIO()
        parts = {k: np.concatenate([getattr(g, k) for g in self.groups] or [np.empty(0)]) for k in ("left", "feature", "bin", "value")}
        np.savez_compressed(out, start=self.start, counts=[g.count for g in self.groups], sizes=[len(g.left) for g in self.groups],
                            edges=np.concatenate(edges), edge_sizes=[len(e) for e in edges], spec=json.dumps(self.spec.__dict__), **parts)
        return out.getvalue()

    @staticmethod
    def unpacked(data: bytes) -> tuple[Ensemble, list[np.ndarray]]:
        import io
        import json
        f = np.load(io.BytesIO(data), allow_pickle=False)
        cuts = np.cumsum(f["sizes"])[:-1].astype(int)
        parts = [np.split(f[k], cuts) if len(f["sizes"]) else [] for k in ("left", "feature", "bin", "value")]
        groups = [Grown(int(c), left.astype(int), feature.astype(int), b.astype(int), v)
                  for c, left, feature, b, v in zip(f["counts"], *parts, strict=True)]
        edges = np.split(f["edges"], np.cumsum(f["edge_sizes"])[:-1].astype(int))
        return Ensemble(Spec(**json.loads(str(f["spec"]))), float(f["start"]), groups), edges


def tree_seeds(seed: int, draw: int, fold: int, trees: np.ndarray) -> np.ndarray:
    return mixed(seed, draw, fold, trees)


def first_margin(y: np.ndarray, w: np.ndarray) -> float:
    """Log-odds of class 1 by weight."""
    p = float(np.clip((w * y).sum() / w.sum(), 1e-12, 1 - 1e-12)) if w.sum() > 0 else 0.5
    return float(np.log(p / (1 - p)))


def fit_in_task(ids, y, w, bins, spec: Spec, features: list[np.ndarray], seeds_of, n_bins: int = BINS,
                trees: range | None = None) -> list[Ensemble]:
    """Models that differ in weights (rows of ``w``), features and seeds, grown side by side on rows at hand.

    ``seeds_of(trees)`` gives a row of seeds for each model. A forest grows ``trees`` alone, if given.
    """
    models, columns = [Ensemble(spec) for _ in w], np.asfortranarray(bins)  # turned round once, not for each tree
    if not spec.boost:
        trees = trees if trees is not None else range(spec.trees)
        step = trees_at_once(len(y))
        for k in range(trees.start, trees.stop, step):
            block = np.arange(k, min(k + step, trees.stop))
            for m, seeds in zip(range(len(w)), seeds_of(block), strict=True):
                weight = drawn(spec, seeds, ids) * w[m]
                growth = Growth(spec, tree_features(spec, seeds, [features[m]] * len(block)), seeds)
                values, _ = grow(bins, growth, weight, weight * y, None, n_bins, placed=False, columns=columns)
                models[m].groups.append(Grown(growth.count, growth.left, growth.feature, growth.bin, values))
        return models
    for m, model in enumerate(models):
        model.start = first_margin(y, w[m])
    margin = np.repeat(np.array([[m.start] for m in models]), len(y), axis=1)
    for t in range(spec.trees):
        seeds = seeds_of(np.array([t]))[:, 0]
        p = 1 / (1 + np.exp(-margin))
        weight = drawn(spec, seeds, ids) * w
        growth = Growth(spec, tree_features(spec, seeds, features), seeds)
        values, at = grow(bins, growth, weight, weight * (y - p), weight * p * (1 - p), n_bins, columns=columns)
        margin += values[at]
        for m, model in enumerate(models):
            model.groups.append(_alone(growth, values, m))
    return models


def _alone(growth: Growth, values: np.ndarray, tree: int) -> Grown:
    """One tree of several."""
    own = np.flatnonzero(growth.tree == tree)
    place = np.full(len(growth.tree) + 1, -1)  # its last row is for no child
    place[own] = np.arange(len(own))
    return Grown(1, place[growth.left[own]], growth.feature[own], growth.bin[own], values[own])


# ------------------------------------------------------------------ large tables: one aggregate a round
def split_gains(cells: DataFrame, spec: Spec) -> DataFrame:
    """Histogram ``(node, feature, bin, n, d, g)`` -> every admissible cut with its relative ``gain`` and ``n_left, n_all, weight``."""
    order = Window.partitionBy("node", "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("node", "feature")
    sums = cells.select("node", "feature", "bin", *[F.sum(c).over(order).alias(f"{c}l") for c in "ndg"],
                        *[F.sum(c).over(whole).alias(f"{c}t") for c in "ndg"])
    rest = {c: F.col(f"{c}t") - F.col(f"{c}l") for c in "ndg"}
    ok = ((F.col("nl") >= spec.min_leaf) & (rest["n"] >= max(1, spec.min_leaf)) & (F.col("dl") >= spec.min_weight)
          & (rest["d"] >= spec.min_weight) & (F.col("dl") + spec.penalty > 0) & (rest["d"] + spec.penalty > 0))
    gain = (_parts(spec, F.col("gl"), F.col("dl"), F) + _parts(spec, rest["g"], rest["d"], F)
            - _parts(spec, F.col("gt"), F.col("dt"), F)) / F.col("dt")
    return sums.where(ok).select("node", "feature", "bin", F.round(gain, DIGITS).alias("gain"), F.col("nl").cast("long").alias("n_left"),
                                 F.col("nt").cast("long").alias("n_all"), F.col("dt").alias("weight"))


def histogram_cells(table: Binned, growth: Growth, nodes: np.ndarray, sums_of, n_bins: int = BINS) -> DataFrame:
    """``(node, feature, bin, n, d, g)`` of open nodes: a task adds up its blocks, Spark the tasks' cells.

    ``sums_of(batch)`` gives the rows' ``w, g, h``, a row for each tree.
    """
    features, spec = len(table.edges), growth.spec
    place = np.full(len(growth.tree), -1)
    place[nodes] = np.arange(len(nodes))
    candidates = growth.candidates(nodes)
    sent = table.rows.sparkSession.sparkContext.broadcast((growth, place, candidates))

    def run(batches):
        growth, place, candidates = sent.value
        total = np.zeros((3, *candidates.shape, n_bins))
        for b in batches:
            bins = _block(b, features)[4]
            w, g, h = sums_of(b)
            local = place[descend(growth, bins)]
            t, r = np.nonzero((local >= 0) & (w > 0))
            total += histogram(bins, r, local[t, r], candidates, _weights(spec, w, h)[t, r], g[t, r], n_bins)
        j, m, b = np.nonzero(total[0])
        yield pa.RecordBatch.from_pydict({
            "node": pa.array(nodes[j], pa.int32()), "feature": pa.array(candidates[j, m], pa.int32()), "bin": pa.array(b, pa.int32()),
            **{k: pa.array(total[i][j, m, b]) for i, k in enumerate("ndg")}})

    return (table.rows.mapInArrow(run, "node int, feature int, bin int, n double, d double, g double")
            .groupBy("node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in "ndg"]))


def first_gains(table: Binned, spec: Spec, rounds: int, features: np.ndarray | None = None, n_bins: int = BINS) -> DataFrame:
    """All admissible cuts of one tree's nodes in its first rounds, no rows left out."""
    columns = np.arange(len(table.edges)) if features is None else np.asarray(features)
    growth, width, out = Growth(spec, columns[None], np.array([0], np.uint64)), len(table.edges), None

    def sums_of(b):
        _, _, y, w, _ = _block(b, width)
        return w[None], (w * y)[None], None

    for r in range(rounds):
        gains = split_gains(histogram_cells(table, growth, growth.open, sums_of, n_bins), spec)
        out = gains if out is None else out.unionByName(gains)
        if r < rounds - 1:
            _record_best(growth, growth.open, gains)
            growth.expand()
    return out


def _record_best(growth: Growth, nodes: np.ndarray, gains: DataFrame) -> None:
    """The cut of largest gain of each node (ties: smallest feature, then bin); a row for each node comes back."""
    best = {r["node"]: r["best"] for r in gains.groupBy("node").agg(F.min(F.struct(
        (-F.col("gain")).alias("loss"), "feature", "bin", "weight", "n_left", "n_all")).alias("best")).collect()}
    known = np.array([i for i in nodes.tolist() if i in best], np.int64)
    if len(known):
        cols = zip(*[(best[i]["feature"], best[i]["bin"], -best[i]["loss"], best[i]["weight"], best[i]["n_left"], best[i]["n_all"])
                     for i in known.tolist()], strict=True)
        growth.record(known, *[np.array(c) for c in cols])


def grow_by_rounds(table: Binned, growth: Growth, sums_of, n_bins: int = BINS) -> np.ndarray:
    """The trees of ``grow`` over a table that stays distributed; the best cut of each open node comes back.

    Open nodes are handled ``CELLS`` histogram cells at a time, as many jobs as that takes.
    """
    spec, features = growth.spec, len(table.edges)
    while len(growth.open):
        per = max(1, CELLS // (growth.candidates(growth.open[:1]).shape[1] * n_bins))
        for k in range(0, len(growth.open), per):
            nodes = growth.open[k:k + per]
            _record_best(growth, nodes, split_gains(histogram_cells(table, growth, nodes, sums_of, n_bins), spec))
        if not len(growth.expand()):
            break
    stands = growth.finish()
    sent = table.rows.sparkSession.sparkContext.broadcast((growth, stands))

    def sums(batches):
        growth, stands = sent.value
        total = np.zeros((3, len(stands)))
        for b in batches:
            w, g, h = sums_of(b)
            at = stands[descend(growth, _block(b, features)[4])]
            for i, x in enumerate((w, g, h)):
                if x is not None:
                    total[i] += np.bincount(at.ravel(), x.ravel(), len(stands))
        j = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_pydict({"node": pa.array(j, pa.int32()), **{k: pa.array(total[i][j]) for i, k in enumerate("wgh")}})

    rows = (table.rows.mapInArrow(sums, "node int, w double, g double, h double").groupBy("node")
            .agg(*[F.sum(c).alias(c) for c in "wgh"]).collect())  # a row for each node
    total = np.zeros((3, len(stands)))
    for r in rows:
        total[:, r["node"]] = r["w"], r["g"], r["h"]
    return leaf_values(spec, *total)


def fit_by_rounds(table: Binned, spec: Spec, features: list[np.ndarray], folds: list[int | None], seeds_of,
                  n_bins: int = BINS) -> list[Ensemble]:
    """Models over a distributed table, each without the rows of its held-out fold (None: of all rows).

    Boosted models carry their margins in the table, written again after each tree.
    """
    width, models = len(table.edges), [Ensemble(spec) for _ in folds]
    held = np.array([-2 if f is None else f for f in folds])

    def own_weights(b):
        _, fold, _, w, _ = _block(b, width)
        return np.where(held[:, None] == fold[None], 0.0, w[None])

    if not spec.boost:
        for k in range(0, spec.trees, TREES_AT_ONCE):
            block = np.arange(k, min(k + TREES_AT_ONCE, spec.trees))
            for m, seeds in enumerate(seeds_of(block)):
                growth = Growth(spec, tree_features(spec, seeds, [features[m]] * len(block)), seeds)

                def sums_of(b, m=m, seeds=seeds):
                    ids, _, y, _, _ = _block(b, width)
                    w = drawn(spec, seeds, ids) * own_weights(b)[m]
                    return w, w * y, None

                values = grow_by_rounds(table, growth, sums_of, n_bins)
                models[m].groups.append(Grown(growth.count, growth.left, growth.feature, growth.bin, values))
        return models
    from horizonkit.session import written
    shares = table.rows.groupBy("fold").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("g")).collect()  # a row a fold
    for m, model in enumerate(models):
        own = [r for r in shares if folds[m] is None or r["fold"] != folds[m]]
        w, g = sum(r["w"] for r in own), sum(r["g"] for r in own)
        model.start = first_margin(np.array([1.0, 0.0]), np.array([g, w - g]))
    starts = np.array([m.start for m in models])
    now = replace(table, rows=table.rows.withColumn("margin", F.lit(bytearray(starts.astype("<f8").tobytes()))))
    for t in range(spec.trees):
        seeds = seeds_of(np.array([t]))[:, 0]
        growth = Growth(spec, tree_features(spec, seeds, features), seeds)

        def sums_of(b, seeds=seeds):
            ids, _, y, _, _ = _block(b, width)
            w = drawn(spec, seeds, ids) * own_weights(b)
            p = 1 / (1 + np.exp(-_margins(b, len(folds)).T))
            return w, w * (y - p), w * p * (1 - p)

        values = grow_by_rounds(now, growth, sums_of, n_bins)
        sent = table.rows.sparkSession.sparkContext.broadcast((growth, values))

        def moved(batches, sent=sent):
            growth, values = sent.value
            for b in batches:
                m = _margins(b, len(folds)) + values[descend(growth, _block(b, width)[4])].T
                yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array([v.tobytes() for v in m.astype("<f8")], pa.binary())], b.schema.names)

        now = replace(now, rows=written(now.rows.mapInArrow(moved, now.rows.schema), "margins"))
        for m, model in enumerate(models):
            model.groups.append(_alone(growth, values, m))
    return models


def _margins(b: pa.RecordBatch, models: int) -> np.ndarray:
    return np.frombuffer(b"".join(b.column(5).to_pylist()), "<f8").reshape(-1, models)


# ------------------------------------------------------------------ fitting and searching
def fit(table: Binned, spec: Spec, features: np.ndarray | None = None, seed: int = 42, n_bins: int = BINS) -> Ensemble:
    """One model of all rows, its trees grown in tasks where the table is small and by rounds where it is not."""
    spark, columns = table.rows.sparkSession, [np.arange(len(table.edges)) if features is None else np.asarray(features)]
    seeds_of = lambda trees: tree_seeds(seed, 0, 0, trees)[None]
    if not table.small:
        return fit_by_rounds(table, spec, columns, [None], seeds_of, n_bins)[0]
    sent = spark.sparkContext.broadcast(at_hand(table))
    jobs = [(0, spec.trees)] if spec.boost else _blocks(spec.trees, table.n_rows)
    edges = table.edges

    def run(batches):
        ids, _, y, w, bins = sent.value
        for b in batches:
            for first, end in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                made = fit_in_task(ids, y, w[None], bins, spec, columns, seeds_of, n_bins, range(first, end))[0]
                yield pa.RecordBatch.from_pydict({"first": pa.array([first], pa.int32()), "trees": pa.array([made.packed(edges)], pa.binary())})

    rows = spark.createDataFrame(jobs, "first int, end int").repartition(len(jobs)).mapInArrow(run, "first int, trees binary").collect()
    parts = [Ensemble.unpacked(bytes(r["trees"]))[0] for r in sorted(rows, key=lambda r: r["first"])]  # the model's size
    return replace(parts[0], groups=[g for p in parts for g in p.groups])


def at_hand(table: Binned):
    """A small table's arrays; its size is checked first."""
    if not table.small:
        raise ValueError("the table is too large to be sent to tasks")
    batches = table.rows.select("id", "fold", "y", "w", "bins").toArrow().combine_chunks().to_batches()
    parts = [_block(b, len(table.edges)) for b in batches]
    arrays = [np.concatenate(x) for x in zip(*parts, strict=True)]
    order = np.argsort(arrays[0], kind="stable")
    return tuple(a[order] for a in arrays)


def _counted(y: np.ndarray, p: np.ndarray) -> tuple[int, int, int, int]:
    """True and false positives, false and true negatives at the default cut (a tie is class 0)."""
    said, true = p > 0.5, y == 1
    return int((said & true).sum()), int((said & ~true).sum()), int((~said & true).sum()), int((~said & ~true).sum())


def search_counts(table: Binned, name: str, draws: list[dict], ranked: list[list[int]], seed: int = 42, n_bins: int = BINS) -> DataFrame:
    """Cross-validated counts of every draw: ``draw, fold, tp, fp, fn, tn`` of the held-out rows.

    ``draws``: parameters of model ``name`` and ``k``; ``ranked[f]`` lists the columns
    by falling score on the rows outside fold f, the first k of which a model uses.
    """
    spark, folds = table.rows.sparkSession, len(ranked)
    schema = "draw int, fold int, tp long, fp long, fn long, tn long"
    plan = [(spec_of(name, {k: v for k, v in d.items() if k != "k"}), [np.sort(np.array(r[:d["k"]])) for r in ranked]) for d in draws]
    if not table.small:
        return _search_by_rounds(table, plan, folds, schema, seed, n_bins)
    sent, sums = _held_out_sums(table, plan, folds, seed, n_bins)

    def count(key, t):
        (_, fold, y, _, _), plan = sent.value
        i, f = key[0].as_py(), key[1].as_py()
        return pa.table([[v] for v in (i, f, *_counted(y[fold == f], _from_sums(plan[i][0], t)))], schema=_COUNTS)

    return sums.groupBy("draw", "fold").applyInArrow(count, schema)


def _from_sums(spec: Spec, t: pa.Table) -> np.ndarray:
    """Probabilities from the parts of a model's sums (a few parts of one forest, or a boosted model's whole)."""
    total = np.sum([np.frombuffer(x, "<f8") for x in t["sums"].to_pylist()], axis=0)
    return 1 / (1 + np.exp(-np.clip(total, -700, 700))) if spec.boost else total / spec.trees


def _held_out_sums(table: Binned, plan: list, folds: int, seed: int, n_bins: int):
    """What was sent, and ``draw, fold, sums``: the trees' sums for the held-out rows, in the order of ``at_hand``."""
    spark = table.rows.sparkSession
    sent = spark.sparkContext.broadcast((at_hand(table), plan))
    jobs = [(i, f, k, min(k + TREES_AT_ONCE, spec.trees)) for i, (spec, _) in enumerate(plan) if not spec.boost
            for f in range(folds) for k in range(0, spec.trees, TREES_AT_ONCE)] if len(plan) >= 8 else [
        (i, f, *block) for i, (spec, _) in enumerate(plan) if not spec.boost for f in range(folds) for block in _blocks(spec.trees, table.n_rows)]
    jobs += [(i, f, 0, spec.trees) for i, (spec, _) in enumerate(plan) if spec.boost for f in (range(folds) if len(plan) < 8 else (-1,))]

    def run(batches):
        (ids, fold, y, w, bins), plan = sent.value
        for b in batches:
            for i, f, first, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
                spec, features = plan[i]
                own = list(range(folds)) if f < 0 else [f]
                weights = np.where(fold[None] == np.array(own)[:, None], 0.0, w[None])
                made = fit_in_task(ids, y, weights, bins, spec, [features[x] for x in own],
                                   lambda trees, own=own, i=i: np.array([tree_seeds(seed, i, x, trees) for x in own]), n_bins, range(first, end))
                for x, model in zip(own, made, strict=True):
                    part = model.margins(bins[fold == x])
                    yield pa.RecordBatch.from_pydict({"draw": pa.array([i], pa.int32()), "fold": pa.array([x], pa.int32()),
                                                      "sums": pa.array([part.astype("<f8").tobytes()], pa.binary())})

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-len(jobs) // 8))
    return sent, (spark.createDataFrame(jobs, "draw int, fold int, first int, last int").repartition(parts)
                  .mapInArrow(run, "draw int, fold int, sums binary"))


def held_out(table: Binned, spec: Spec, features: list[np.ndarray], seed: int = 42, n_bins: int = BINS) -> DataFrame:
    """``id, fold, label, p``: every row's probability by the model of the other folds, all folds' models side by side."""
    folds, schema = len(features), "id long, fold int, label int, p double"
    names = ["id", "fold", "label", "p"]
    if table.small:
        sent, sums = _held_out_sums(table, [(spec, features)], folds, seed, n_bins)

        def rows(key, t):
            (ids, fold, y, _, _), _ = sent.value
            own = fold == key[1].as_py()
            return pa.table([pa.array(ids[own]), pa.array(fold[own], pa.int32()), pa.array(y[own].astype(np.int32)), pa.array(_from_sums(spec, t))], names=names)

        return sums.groupBy("draw", "fold").applyInArrow(rows, schema)
    made = fit_by_rounds(table, spec, features, list(range(folds)), lambda trees: np.array([tree_seeds(seed, 0, f, trees) for f in range(folds)]), n_bins)
    models, width = table.rows.sparkSession.sparkContext.broadcast(made), len(table.edges)

    def score(batches):
        for b in batches:
            ids, fold, y, _, bins = _block(b, width)
            for f in range(folds):
                own = fold == f
                yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(fold[own], pa.int32()), pa.array(y[own].astype(np.int32)),
                                                  pa.array(models.value[f].probability(bins[own]))], names)

    return table.rows.mapInArrow(score, schema)


_COUNTS = pa.schema([("draw", pa.int32()), ("fold", pa.int32()), *[(c, pa.int64()) for c in ("tp", "fp", "fn", "tn")]])


def _search_by_rounds(table: Binned, plan: list, folds: int, schema: str, seed: int, n_bins: int) -> DataFrame:
    """The draws one after the other over a distributed table, the folds side by side; one scoring pass a draw."""
    spark, width, rows = table.rows.sparkSession, len(table.edges), []
    for i, (spec, features) in enumerate(plan):
        made = fit_by_rounds(table, spec, features, list(range(folds)),
                             lambda trees, i=i: np.array([tree_seeds(seed, i, f, trees) for f in range(folds)]), n_bins)
        sent = spark.sparkContext.broadcast(made)

        def score(batches, i=i, sent=sent):
            total = np.zeros((folds, 4), np.int64)
            for b in batches:
                _, fold, y, _, bins = _block(b, width)
                for f in range(folds):
                    total[f] += _counted(y[fold == f], sent.value[f].probability(bins[fold == f]))
            yield pa.RecordBatch.from_arrays([pa.array([i] * folds, pa.int32()), pa.array(range(folds), pa.int32()), *map(pa.array, total.T)],
                                             ["draw", "fold", "tp", "fp", "fn", "tn"])

        rows += table.rows.mapInArrow(score, schema).groupBy("draw", "fold").agg(
            *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")]).collect()  # a row for each fold
    return spark.createDataFrame(rows, schema)


def stage_losses(table: Binned, model: Ensemble) -> list[float]:
    """Mean log-loss of the rows after each tree of a boosted model (one pass, a number for each tree comes back)."""
    sent, width = table.rows.sparkSession.sparkContext.broadcast(model), len(table.edges)

    def run(batches):
        total, n = 0.0, 0
        for b in batches:
            _, _, y, _, bins = _block(b, width)
            m = sent.value.margins(bins, stages=True)
            total, n = total + (np.logaddexp(0, m) - y * m).sum(1), n + len(y)
        if n:
            yield pa.RecordBatch.from_pydict({"stage": pa.array(range(len(total)), pa.int32()), "loss": pa.array(total), "n": pa.array([n] * len(total))})

    rows = table.rows.mapInArrow(run, "stage int, loss double, n long").groupBy("stage").agg((F.sum("loss") / F.sum("n")).alias("v")).collect()
    return [r["v"] for r in sorted(rows)]
