"""Nearest neighbours through learned partitions.

A neighbour graph of a bounded sample is cut into balanced parts with few
edges between them. A small classifier learns the parts from the vectors,
places every row in its two most probable parts, and sends a query to its several
most probable ones, where exact distances decide.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from horizonkit.session import written

#: Rows that fit the index at most (those of smallest id hash), and neighbours of each in the graph.
SAMPLE, NEIGHBOURS = 8_192, 10
#: Parts: a quarter of the square root of the rows, each with so many rows of the sample at least.
ROWS_OF_PART = 32
#: Share of neighbours that the routing is to find among rows it has not seen, one in ``HELD_OUT`` of the sample.
RECALL, HELD_OUT = 0.93, 8
#: Rows and queries that meet in one task at most.
ROWS_AT_ONCE, QUERIES_AT_ONCE = 4_096, 1_024


def nearest_of_sample(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each row, by blocks."""
    square = (x * x).sum(1)
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 1024):
        d = square[None, :] - 2 * x[at:at + 1024] @ x.T
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        out[at:at + 1024] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.1) -> np.ndarray:
    """Cut the graph into parts of at most ``slack`` times the mean size.

    Starts from halving along the widest direction, then moves rows to the
    part that most of their neighbours are in, as long as it has room.
    """
    part = np.zeros(len(x), np.int64)
    groups = [(np.arange(len(x)), parts, 0)]
    while groups:
        rows, n, first = groups.pop()
        if n == 1 or len(rows) < 2:
            part[rows] = first
            continue
        centred = x[rows] - x[rows].mean(0)
        axis = np.linalg.svd(centred.T @ centred)[0][:, 0]
        order = rows[np.argsort(centred @ axis, kind="stable")]
        left = n // 2
        cut = len(rows) * left // n
        groups += [(order[:cut], left, first), (order[cut:], n - left, first + left)]
    room = int(np.ceil(slack * len(x) / parts))
    sizes = np.bincount(part, minlength=parts)
    both = [set(r) for r in graph.tolist()]
    for i, r in enumerate(graph.tolist()):
        for j in r:
            both[j].add(i)
    near = [np.fromiter(s, np.int64) for s in both]
    for _ in range(rounds):
        moved = 0
        for i, nb in enumerate(near):
            votes = np.bincount(part[nb], minlength=parts)
            own = part[i]
            votes[(sizes >= room) & (np.arange(parts) != own)] = -1
            best = int(votes.argmax())
            if votes[best] > votes[own]:
                sizes[own] -= 1
                sizes[best] += 1
                part[i] = best
                moved += 1
        if moved < len(x) // 500:
            break
    return part


@dataclass
class Router:
    """Softmax network from a vector to the parts."""

    shift: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.shift) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def fit_router(x: np.ndarray, target: np.ndarray, hidden: int = 128, epochs: int = 30, rate: float = 3e-3,
               batch: int = 256, seed: int = 3) -> Router:
    """Adam on the cross-entropy to ``target``, a share for each part."""
    rng = np.random.RandomState(seed)
    net = Router(x.mean(0), max(float(x.std()), 1e-12), rng.randn(x.shape[1], hidden) * np.sqrt(2 / x.shape[1]),
                 np.zeros(hidden), rng.randn(hidden, target.shape[1]) * np.sqrt(1 / hidden), np.zeros(target.shape[1]))
    z = (x - net.shift) / net.scale
    params = [net.w1, net.b1, net.w2, net.b2]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        rows = rng.permutation(len(x))
        for at in range(0, len(rows), batch):
            i = rows[at:at + batch]
            pre = z[i] @ params[0] + params[1]
            h = np.maximum(pre, 0)
            logits = h @ params[2] + params[3]
            p = np.exp(logits - logits.max(1, keepdims=True))
            err = (p / p.sum(1, keepdims=True) - target[i]) / len(i)
            back = (err @ params[2].T) * (pre > 0)
            t += 1
            for k, g in enumerate((z[i].T @ back, back.sum(0), h.T @ err, err.sum(0))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                step = rate * (1 - epoch / epochs)
                params[k] = params[k] - step * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params
    return net


def fit_index(x: np.ndarray, parts: int) -> Router:
    """Graph, parts and router of a sample; a row's target is where it and its neighbours are."""
    parts = max(1, min(parts, len(x)))
    k = min(NEIGHBOURS, len(x) - 1)
    graph = nearest_of_sample(x, k) if k else np.empty((len(x), 0), np.int64)
    part = balanced_parts(x, graph, parts) if k else np.zeros(len(x), np.int64)
    target = np.zeros((len(x), parts))
    target[np.arange(len(x)), part] = 1
    for j in range(k):
        np.add.at(target, (np.arange(len(x)), part[graph[:, j]]), 1)
    return fit_router(x, target / target.sum(1, keepdims=True))


@dataclass
class Routing:
    """A row stands in its ``spread`` most probable parts, a query opens its ``probes`` most probable ones."""

    router: Router
    spread: int
    probes: int


def by_probability(router: Router, x: np.ndarray, count: int) -> np.ndarray:
    return np.argsort(-router.logits(x), axis=1, kind="stable")[:, :count]


def fit_routing(x: np.ndarray, parts: int, recall: float = RECALL, share: float | None = None, spread: int | None = None) -> Routing:
    """Fit on most rows of a sample, then choose spread and probes by the neighbours that the rest find.

    A row and its neighbours in the sample are farther apart than in the whole table, so the recall there is
    rather higher. ``share`` and ``spread`` fix what would be chosen.
    """
    parts = max(1, min(parts, len(x)))
    held = np.arange(len(x)) % HELD_OUT == HELD_OUT - 1
    own, rest = x[~held], x[held]
    if share is not None or len(own) <= NEIGHBOURS or not len(rest):
        router = fit_index(x, parts)
        return Routing(router, spread or 2, max(1, int(np.ceil((1.0 if share is None else share) * len(router.b2)))))
    router = fit_index(own, parts)
    count = len(router.b2)
    square = (own * own).sum(1)
    near = np.concatenate([np.argpartition(square - 2 * rest[at:at + 512] @ own.T, NEIGHBOURS - 1, axis=1)[:, :NEIGHBOURS]
                           for at in range(0, len(rest), 512)])
    place = np.empty((len(rest), count), np.int64)  # of each part in a query's order
    np.put_along_axis(place, by_probability(router, rest, count), np.arange(count)[None], axis=1)
    best = None
    for s in (spread,) if spread else (1, 2):
        stands = by_probability(router, own, min(s, count))
        first = np.min([place[np.arange(len(rest))[:, None], stands[near, k]] for k in range(stands.shape[1])], axis=0)
        probes = 1 + int(np.quantile(first, recall, method="higher"))
        if best is None or s * probes < best.spread * best.probes:
            best = Routing(router, s, probes)
    return best


def closest(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """Exact (query, row, distance) of the k nearest rows of each query among these rows.

    Equal vectors are measured once and their smallest ids taken. A matrix
    product finds which can be among the nearest, with room for its rounding;
    these are then measured by differences.
    """
    unique, inverse = np.unique(x, axis=0, return_inverse=True)
    pairs = np.unique(np.column_stack((inverse.reshape(-1), ids)), axis=0)  # by vector, then id; repeated rows once
    ids = pairs[:, 1]
    starts = np.searchsorted(pairs[:, 0], np.arange(len(unique) + 1))
    vectors_of_an_id = int(np.unique(ids, return_counts=True)[1].max())
    square, qsquare = (unique * unique).sum(1), (q * q).sum(1)
    rough = square[None, :] + qsquare[:, None] - 2 * q @ unique.T
    want = min((k + 1) * vectors_of_an_id, len(unique))
    kth = np.partition(rough, want - 1, axis=1)[:, want - 1]
    room = 1e-9 * (qsquare + square.max())
    out = []
    for i, query in enumerate(query_ids.tolist()):
        some = np.flatnonzero(rough[i] <= kth[i] + room[i])
        d = np.sqrt(((unique[some] - q[i]) ** 2).sum(1))
        found: dict[int, float] = {}
        for dist, r in sorted((dist, r) for u, dist in zip(some.tolist(), d.tolist(), strict=True)
                              for r in ids[starts[u]:starts[u + 1]][:(k + 1) * vectors_of_an_id].tolist()):
            if r != query and r not in found:
                found[r] = dist
                if len(found) == k:
                    break
        out += [(query, r, dist) for r, dist in found.items()]
    return out


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, parts: int | None = None, share: float | None = None,
           spread: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE,
           recall: float = RECALL) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest rows found for each query, its own row aside.

    ``score`` is the Euclidean distance in double precision, ties go to the
    smaller id. ``queries`` has the same columns as ``vectors``. ``parts``: a quarter of the
    square root of the rows, each with ``ROWS_OF_PART`` of the sample at least, unless given. A row stands in its
    ``spread`` most probable ones, a query looks into ``share`` of them; what is not given
    is chosen for ``recall`` by ``fit_routing``. At most ``sample`` rows fit
    the index (more parts than that allows need a larger one); every row is in it.

    Vectors that are null, empty, all zero or hold null or non-finite
    components take no part, nor do null ids, nor vectors of another length
    than most (the longer of equally frequent ones). Rows of equal id count as one,
    at their nearest; a query id with several vectors uses the smallest.
    Other columns play no part; empty tables give an empty result.
    """
    spark = vectors.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    good = F.when(F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
                  & F.exists("v", lambda e: e != 0), True)

    def usable(df: DataFrame) -> DataFrame:
        part = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        return part.where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(good, F.lit(False)))

    rows, asked = usable(vectors), usable(queries)
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if sizes is None:
        return spark.createDataFrame([], out)
    dim, n = sizes["d"], sizes["n"]
    rows, asked = rows.where(F.size("v") == dim), asked.where(F.size("v") == dim)
    fit = [r["v"] for r in rows.orderBy(F.xxhash64("id"), "id", "v").limit(sample).collect()]
    wanted = parts or min(max(1, len(fit) // ROWS_OF_PART), int(np.ceil(np.sqrt(n) / 4)))
    routing = fit_routing(np.array(fit), wanted, recall, share, spread)
    router = spark.sparkContext.broadcast(routing.router)
    spread, probes = routing.spread, routing.probes

    def route(count: int):
        def run(batches):
            for b in batches:
                if b.num_rows:
                    x = np.array(b.column(1).flatten()).reshape(-1, dim)
                    top = by_probability(router.value, x, count)
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(top.tolist(), pa.list_(pa.int32()))], ["id", "v", "parts"])
        return run

    index = written(rows.mapInArrow(route(spread), "id long, v array<double>, parts array<int>")
                    .select("id", "v", F.explode("parts").alias("part")), "index")
    one = asked.groupBy("id").agg(F.min("v").alias("v"))
    routed = written(one.mapInArrow(route(probes), "id long, v array<double>, parts array<int>")
                     .select("id", "v", F.explode("parts").alias("part")), "routed")
    # blocks of rows and of queries, so that what meets in a task is bounded, however full a part is
    blocks = (index.groupBy("part").agg(F.ceil(F.count("*") / F.lit(ROWS_AT_ONCE)).alias("nb"))
              .join(routed.groupBy("part").agg(F.ceil(F.count("*") / F.lit(QUERIES_AT_ONCE)).alias("nq")), "part"))
    counts = {r["part"]: (r["nb"], r["nq"]) for r in blocks.collect()}  # a row per part
    if not counts:
        return spark.createDataFrame([], out)
    table = F.create_map(*[F.lit(x).cast("int") for p, (nb, _) in counts.items() for x in (p, nb)])
    asked_table = F.create_map(*[F.lit(x).cast("int") for p, (_, nq) in counts.items() for x in (p, nq)])
    dealt = lambda df, own, other, a, b: (
        df.where(F.col("part").isin(list(counts)))
        .withColumn(a, F.pmod(F.xxhash64("id"), own[F.col("part")]).cast("int"))
        .withColumn(b, F.explode(F.sequence(F.lit(0), other[F.col("part")] - 1))))
    left = dealt(index, table, asked_table, "rb", "qb").groupBy("part", "rb", "qb")
    right = dealt(routed, asked_table, table, "qb", "rb").groupBy("part", "rb", "qb")

    def rank(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            found = []
        else:
            x, q = (np.array(t["v"].combine_chunks().flatten()).reshape(-1, dim) for t in (a, b))
            found = closest(a["id"].to_numpy(), x, b["id"].to_numpy(), q, k)
        cols = list(zip(*found, strict=True)) or [[], [], []]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()),
                         "score": pa.array(cols[2], pa.float64())})

    near = left.cogroup(right).applyInArrow(rank, "query_id long, vec_id long, score double")
    near = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
