"""Networks with a choice of activation and penalty, trained by Adam on summed gradients.

One step needs the gradient of one batch: a sum over rows. Tasks add up the
gradients of their rows, Spark adds up the tasks' sums, and the weights and
Adam's moments stay with the driver; their size is that of the network, not of
the table. Training state can be saved and gone on with, and losses are taken
while training goes on.

As for trees there are two ways to the same weights: a small table is sent to
all tasks and a task trains whole networks of a search; for any other table a
step is a job over its blocks, all networks of the search side by side.
"""

from __future__ import annotations

import ctypes
import functools
import io
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from horizonkit.operators.trees import _COUNTS, SMALL_BYTES, _counted, mixed

#: A batch has about this many rows, an epoch at most so many batches (each is a pass over a large table).
BATCH, BATCHES = 200, 8
#: So many tasks' sums of a step come to the driver as they are.
TASK_SUMS = 64
#: Adam's decay rates and its guard against division by zero.
DECAY, GUARD = (0.9, 0.999), 1e-8


@dataclass(frozen=True)
class Net:
    """A network and its training: hidden layers, ``tanh`` or ``relu``, weight penalty, Adam's step."""

    hidden: tuple[int, ...] = (100,)
    activation: str = "relu"
    alpha: float = 1e-4
    rate: float = 1e-3
    epochs: int = 2000
    tolerance: float = 1e-4   # training ends when the loss fell less than this
    patience: int = 10        # in so many epochs on end


@functools.cache
def _one_thread() -> None:
    """BLAS of this Python process keeps to one thread: Spark has a task for every core already.

    Otherwise each task's OpenBLAS starts as many threads as there are cores, and they wait for one another.
    """
    try:
        with open("/proc/self/maps") as f:
            paths = sorted({line.split()[-1] for line in f if "openblas" in line})
    except OSError:
        return
    for path in paths:
        lib = ctypes.CDLL(path)  # loaded already by numpy
        for name in (f"{a}openblas_set_num_threads{b}" for a in ("scipy_", "") for b in ("64_", "")):
            if hasattr(lib, name):
                getattr(lib, name)(1)
                break


def net_of(params: dict) -> Net:
    """From the names of the search space. ``solver`` is Adam, under which ``learning_rate`` has no effect."""
    if params.get("solver", "adam") != "adam" or params.get("activation", "relu") not in ("tanh", "relu"):
        raise ValueError(f"no such network: {params}")
    return Net(tuple(params.get("hidden_layer_sizes", (100,))), params.get("activation", "relu"), params.get("alpha", 1e-4),
               epochs=params.get("max_iter", 2000))


def shapes(net: Net, inputs: int) -> list[tuple[int, int]]:
    sizes = [inputs, *net.hidden, 1]
    return list(zip(sizes, sizes[1:], strict=False))


def first_weights(net: Net, inputs: int, seed: int) -> np.ndarray:
    """Uniform within sqrt(6 / (inputs + outputs)) of each layer, weights then biases, as one vector."""
    rng = np.random.RandomState(seed % (1 << 32))
    return np.concatenate([rng.uniform(-1, 1, (a + 1) * b) * np.sqrt(6 / (a + b)) for a, b in shapes(net, inputs)])


def layers(weights: np.ndarray, net: Net, inputs: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in shapes(net, inputs):
        out.append((weights[at:at + a * b].reshape(a, b), weights[at + a * b:at + (a + 1) * b]))
        at += (a + 1) * b
    return out


class Room(dict):
    """Arrays of a training loop, used again in each step: new ones would be mapped and cleared page by page each time."""

    def of(self, name, *shape: int) -> np.ndarray:
        size = int(np.prod(shape))
        if name not in self or self[name].size < size:
            self[name] = np.empty(size + size // 8)
        return self[name][:size].reshape(shape)


def _forward(x: np.ndarray, parts: list, activation: str, room: Room | None = None) -> list[np.ndarray]:
    out, room = [x], Room() if room is None else room
    for i, (w, b) in enumerate(parts):
        z = np.matmul(out[-1], w, out=room.of(("layer", i), len(x), len(b)))
        z += b
        if i < len(parts) - 1:
            np.tanh(z, out=z) if activation == "tanh" else np.maximum(z, 0, out=z)
        out.append(z)
    return out


def logits(x: np.ndarray, weights: np.ndarray, net: Net) -> np.ndarray:
    return _forward(x, layers(weights, net, x.shape[1]), net.activation)[-1][:, 0]


def summed_loss(z: np.ndarray, y: np.ndarray) -> float:
    return float((np.logaddexp(0, z) - y * z).sum())


def summed_gradient(x: np.ndarray, y: np.ndarray, weights: np.ndarray, net: Net, room: Room | None = None) -> tuple[float, np.ndarray]:
    """Log-loss of the rows and its gradient, both summed over the rows, without the penalty."""
    room = Room() if room is None else room
    parts = layers(weights, net, x.shape[1])
    values = _forward(x, parts, net.activation, room)
    z = values[-1][:, 0]
    loss = summed_loss(z, y)
    back = (1 / (1 + np.exp(-np.clip(z, -700, 700))) - y)[:, None]
    out, end = np.empty_like(weights), len(weights)
    for i in range(len(parts) - 1, -1, -1):
        w, b = parts[i]
        first, middle = end - w.size - len(b), end - len(b)
        np.matmul(values[i].T, back, out=out[first:middle].reshape(w.shape))
        np.sum(back, axis=0, out=out[middle:end])
        end = first
        if i:
            slope = values[i]  # not needed any more
            if net.activation == "tanh":
                np.subtract(1, np.square(slope, out=slope), out=slope)
            else:
                slope = slope > 0
            # a single unit's pull is a product, not a sum
            to = room.of(("back", i), len(x), w.shape[0])
            back = np.multiply(back, w.T, out=to) if w.shape[1] == 1 else np.matmul(back, w.T, out=to)
            back *= slope
    return loss, out


@functools.lru_cache(64)
def _penalised(net: Net, inputs: int) -> np.ndarray:
    """1 for each weight, 0 for each bias."""
    return np.concatenate([np.append(np.ones(a * b), np.zeros(b)) for a, b in shapes(net, inputs)])


def penalty(weights: np.ndarray, net: Net, inputs: int) -> tuple[float, np.ndarray]:
    """Half of alpha times the squared weights (not biases), and its gradient."""
    own = _penalised(net, inputs) * weights
    return 0.5 * net.alpha * float(own @ own), net.alpha * own


@dataclass
class State:
    """Where a network's training stands."""

    net: Net
    inputs: int
    seed: int
    weights: np.ndarray
    first: np.ndarray
    second: np.ndarray
    steps: int = 0
    epoch: int = 0
    best: float = np.inf
    idle: int = 0
    losses: list = field(default_factory=list)   # (training loss, validation loss) of each epoch

    @property
    def done(self) -> bool:
        return self.epoch >= self.net.epochs or self.idle > self.net.patience

    def step(self, loss: float, gradient: np.ndarray, n: int) -> float:
        """Adam's step for the summed gradient of ``n`` rows; returns their loss with the penalty, summed."""
        if not n:
            return 0.0
        extra, pull = penalty(self.weights, self.net, self.inputs)
        g = (gradient + pull) / n
        self.steps += 1
        (a, b), t = DECAY, self.steps
        self.first = a * self.first + (1 - a) * g
        self.second = b * self.second + (1 - b) * g * g
        scale = self.net.rate * np.sqrt(1 - b ** t) / (1 - a ** t)
        self.weights = self.weights - scale * self.first / (np.sqrt(self.second) + GUARD)
        return loss + extra

    def end_epoch(self, loss: float, validation: float | None) -> None:
        self.epoch += 1
        self.idle = self.idle + 1 if loss > self.best - self.net.tolerance else 0
        self.best = min(self.best, loss)
        self.losses.append((loss, np.nan if validation is None else validation))

    def packed(self) -> bytes:
        out = io.BytesIO()
        n = self.net
        np.savez_compressed(out, weights=self.weights, first=self.first, second=self.second, losses=np.array(self.losses).reshape(-1, 2),
                            at=[self.inputs, self.seed, self.steps, self.epoch, self.idle], best=self.best, hidden=n.hidden,
                            activation=n.activation, numbers=[n.alpha, n.rate, n.tolerance], whole=[n.epochs, n.patience])
        return out.getvalue()

    @staticmethod
    def unpacked(data: bytes) -> State:
        f = np.load(io.BytesIO(data), allow_pickle=False)
        alpha, rate, tolerance = map(float, f["numbers"])
        net = Net(tuple(int(h) for h in f["hidden"]), str(f["activation"]), alpha, rate, int(f["whole"][0]), tolerance, int(f["whole"][1]))
        inputs, seed, steps, epoch, idle = map(int, f["at"])
        return State(net, inputs, seed, f["weights"], f["first"], f["second"], steps, epoch, float(f["best"]), idle,
                     [tuple(x) for x in f["losses"].tolist()])


def start(net: Net, inputs: int, seed: int) -> State:
    w = first_weights(net, inputs, seed)
    return State(net, inputs, seed, w, np.zeros_like(w), np.zeros_like(w))


def batch_of(ids: np.ndarray, seed: int, epoch: int, batches: int) -> np.ndarray:
    """The batch of each row in an epoch: a hash, so no row's place matters."""
    return (mixed(seed, epoch, ids) % np.uint64(batches)).astype(np.int64)


def batches_of(n: int) -> int:
    return max(1, min(-(-n // BATCH), BATCHES))


def train_in_task(state: State, ids, x, y, held=None, epochs: int | None = None) -> State:
    """Go on training on rows at hand; ``held``: ``(x, y)`` whose loss is taken after each epoch."""
    _one_thread()
    state = replace(state, losses=list(state.losses))
    until, batches, room = state.epoch + (epochs or state.net.epochs), batches_of(len(y)), Room()
    while not state.done and state.epoch < until:
        part, total = batch_of(ids, state.seed, state.epoch, batches), 0.0
        for b in range(batches):
            rows = np.flatnonzero(part == b)
            some = np.take(x, rows, axis=0, out=room.of("rows", len(rows), x.shape[1]), mode="clip")
            total += state.step(*summed_gradient(some, y[rows], state.weights, state.net, room), len(rows))
        after = None if held is None else summed_loss(logits(held[0], state.weights, state.net), held[1]) / max(1, len(held[1]))
        state.end_epoch(total / max(1, len(y)), after)
    return state


# ------------------------------------------------------------------ tables
@dataclass
class Matrix:
    """Rows ``(id, fold, y, x)``, x packed; ``moments``: ``n, mean, var`` of each fold's columns."""

    rows: DataFrame
    width: int
    moments: dict[int, tuple[float, np.ndarray, np.ndarray]]

    @property
    def n_rows(self) -> int:
        return int(sum(n for n, _, _ in self.moments.values()))

    @property
    def small(self) -> bool:
        return self.n_rows * (8 * self.width + 24) <= SMALL_BYTES

    def scale(self, left_out: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Mean and population standard deviation of the columns without one fold; constant columns have 1."""
        own = [m for f, m in self.moments.items() if f != left_out]
        n = sum(m[0] for m in own) or 1.0
        mean = sum((m[0] * m[1] for m in own), np.zeros(self.width)) / n
        var = sum((m[0] * (m[2] + (m[1] - mean) ** 2) for m in own), np.zeros(self.width)) / n
        return mean, np.where(var > 0, np.sqrt(var), 1.0)


def matrix(rows: DataFrame, width: int) -> Matrix:
    """``rows``: ``id long, x array<double>, y double, fold int``; written once. A null label or vector takes no part; a null component is 0."""
    from horizonkit.session import written

    def run(batches):
        for b in batches:
            x = np.nan_to_num(np.asarray(b.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, width))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array([v.tobytes() for v in x], pa.binary())],
                                             ["id", "fold", "y", "x"])

    picked = rows.select(F.col("id").cast("long"), F.col("x").cast("array<double>"), F.coalesce(F.col("fold").cast("int"), F.lit(-1)).alias("fold"),
                         F.col("y").cast("double")).where("x is not null and y is not null")
    table = written(picked.mapInArrow(run, "id long, fold int, y double, x binary"), "matrix")

    def sums(batches):
        total = {}
        for b in batches:
            _, fold, _, x = _rows(b, width)
            for f in np.unique(fold).tolist():
                own = x[fold == f]
                n, mean, var = total.get(f, (0, np.zeros(width), np.zeros(width)))
                total[f] = _joined((n, mean, var), (len(own), own.mean(0), own.var(0)))
        for f, (n, mean, var) in total.items():
            yield pa.RecordBatch.from_pydict({"fold": pa.array([f] * width, pa.int32()), "at": pa.array(range(width), pa.int32()),
                                              "n": pa.array([float(n)] * width), "mean": pa.array(mean), "var": pa.array(var)})

    parts = table.mapInArrow(sums, "fold int, at int, n double, mean double, var double")
    whole = parts.groupBy("fold", "at").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"))
    spread = F.sum(F.col("p.n") * (F.col("p.var") + (F.col("p.mean") - F.col("w.mean")) ** 2))
    found = (parts.alias("p").join(whole.alias("w"), ["fold", "at"]).groupBy("fold", "at").agg(
        F.first("w.n").alias("n"), F.first("w.mean").alias("mean"), (spread / F.first("w.n")).alias("var")).collect())  # folds x columns
    moments = {}
    for r in found:
        n, mean, var = moments.setdefault(r["fold"], (r["n"], np.zeros(width), np.zeros(width)))
        mean[r["at"]], var[r["at"]] = r["mean"], r["var"]
    return Matrix(table, width, moments)


def _joined(a, b):
    n = a[0] + b[0]
    mean = (a[0] * a[1] + b[0] * b[1]) / n
    return n, mean, (a[0] * (a[2] + (a[1] - mean) ** 2) + b[0] * (b[2] + (b[1] - mean) ** 2)) / n


def _rows(b: pa.RecordBatch, width: int):
    return (np.asarray(b.column(0).fill_null(0)), np.asarray(b.column(1)), np.asarray(b.column(2)),
            np.frombuffer(b"".join(b.column(3).to_pylist()), np.float64).reshape(-1, width))


def at_hand(table: Matrix):
    """A small table's arrays; its size is checked first."""
    if not table.small:
        raise ValueError("the table is too large to be sent to tasks")
    parts = [_rows(b, table.width) for b in table.rows.toArrow().to_batches() if b.num_rows]
    arrays = [np.concatenate(x) for x in zip(*parts, strict=True)]
    order = np.argsort(arrays[0], kind="stable")
    return tuple(a[order] for a in arrays)


@dataclass
class Job:
    """A network to train: its columns, the fold it leaves out (and is judged on), and the columns' scale."""

    state: State
    columns: np.ndarray
    left_out: int | None
    mean: np.ndarray
    std: np.ndarray

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return (x[:, self.columns] - self.mean) / self.std


def job(table: Matrix, net: Net, columns, left_out: int | None, seed: int = 42) -> Job:
    columns = np.sort(np.asarray(columns, np.int64))
    mean, std = table.scale(left_out)
    return Job(start(net, len(columns), seed), columns, left_out, mean[columns], std[columns])


def added(rows: DataFrame, keys: list[str], parts: int = 64) -> DataFrame:
    """``(keys, part int, n long, loss double, g binary)``: sums by key, first within groups of tasks, then of those."""
    def total(key, t):
        g = sum((np.frombuffer(v, "<f8") for v in t["g"].to_pylist()), 0.0)
        head = {k: [v.as_py()] for k, v in zip(keys, key, strict=False)}
        return pa.table({**head, "part": [0], "n": [sum(t["n"].to_pylist())], "loss": [sum(t["loss"].to_pylist())], "g": [g.tobytes()]}).cast(shape)

    shape = pa.schema([*[(k, pa.int32()) for k in keys], ("part", pa.int32()), ("n", pa.int64()), ("loss", pa.float64()), ("g", pa.binary())])
    schema = rows.schema
    some = rows.withColumn("part", F.pmod("part", F.lit(parts)).cast("int")).groupBy(*keys, "part").applyInArrow(total, schema)
    return some.groupBy(*keys).applyInArrow(total, schema)


def gradients(table: Matrix, jobs: list[Job], batch: int = 0, batches: int = 1) -> DataFrame:
    """``(job, part, n, loss, g)``: sums over a batch of each job's own rows, at the job's weights."""
    return added(_task_sums(table, table.rows.sparkSession.sparkContext.broadcast(jobs), batch, batches), ["job"])


def _task_sums(table: Matrix, sent, batch: int, batches: int) -> DataFrame:
    """``(job, part, n, loss, g)`` of each task; ``sent``: the jobs."""
    from pyspark import TaskContext
    width = table.width

    def run(blocks):
        _one_thread()
        jobs, part = sent.value, TaskContext.get().partitionId()
        total = [[0, 0.0, np.zeros_like(j.state.weights)] for j in jobs]
        for b in blocks:
            ids, fold, y, x = _rows(b, width)
            for t, j in zip(total, jobs, strict=True):
                own = fold != (-2 if j.left_out is None else j.left_out)
                if batches > 1:
                    own = own & (batch_of(ids, j.state.seed, j.state.epoch, batches) == batch)
                loss, g = summed_gradient(j.inputs(x[own]), y[own], j.state.weights, j.state.net)
                t[0], t[1], t[2] = t[0] + int(own.sum()), t[1] + loss, t[2] + g
        yield pa.RecordBatch.from_pydict({
            "job": pa.array(range(len(jobs)), pa.int32()), "part": pa.array([part] * len(jobs), pa.int32()),
            "n": pa.array([t[0] for t in total], pa.int64()), "loss": pa.array([float(t[1]) for t in total]),
            "g": pa.array([t[2].tobytes() for t in total], pa.binary())})

    return table.rows.mapInArrow(run, "job int, part int, n long, loss double, g binary")


def _step_sums(table: Matrix, jobs: list[Job], batch: int, batches: int, parts: int) -> dict[int, tuple[int, float, np.ndarray]]:
    """``n, loss, g`` of each job. Sums of few tasks are added where they arrive, of many by Spark first."""
    sent = table.rows.sparkSession.sparkContext.broadcast(jobs)
    sums = _task_sums(table, sent, batch, batches)
    out = {}
    for r in sorted((sums if parts <= TASK_SUMS else added(sums, ["job"])).collect(), key=lambda r: r["part"]):  # a network's weights each
        n, loss, g = out.get(r["job"], (0, 0.0, 0.0))
        out[r["job"]] = n + r["n"], loss + r["loss"], g + np.frombuffer(r["g"], "<f8")
    sent.unpersist()
    return out


def unpacked_sums(col: str, n: int):
    """The ``n`` numbers of a packed sum as an array column."""
    @F.pandas_udf("array<double>")
    def numbers(packed: pd.Series) -> pd.Series:
        return packed.map(lambda b: np.frombuffer(b, "<f8", n))

    return numbers(col)


def scores(table: Matrix, jobs: list[Job]) -> DataFrame:
    """``job, n, loss, tp, fp, fn, tn`` of the rows each job left out (all rows, if none)."""
    sent, width = table.rows.sparkSession.sparkContext.broadcast(jobs), table.width

    def run(blocks):
        _one_thread()
        total = np.zeros((len(sent.value), 6))
        for b in blocks:
            _, fold, y, x = _rows(b, width)
            for t, j in zip(total, sent.value, strict=True):
                own = np.ones(len(y), bool) if j.left_out is None else fold == j.left_out
                z = logits(j.inputs(x[own]), j.state.weights, j.state.net)
                t += (own.sum(), summed_loss(z, y[own]), *_counted(y[own], 0.5 + (z > 0)))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), *map(pa.array, total.T)],
                                         ["job", "n", "loss", "tp", "fp", "fn", "tn"])

    names = ["n", "loss", "tp", "fp", "fn", "tn"]
    return (table.rows.mapInArrow(run, "job int, " + ", ".join(f"{c} double" for c in names)).groupBy("job")
            .agg(*[F.sum(c).alias(c) for c in names]))


def train_by_steps(table: Matrix, jobs: list[Job], epochs: int | None = None, watch: bool = False) -> list[Job]:
    """Go on training over a distributed table: one job of Spark a batch, all networks that are not done side by side.

    ``watch``: after each epoch the loss on the left-out rows is taken.
    """
    table = replace(table, rows=table.rows.persist())  # read once for all steps
    parts = table.rows.rdd.getNumPartitions()
    jobs, until = list(jobs), [j.state.epoch + (epochs or j.state.net.epochs) for j in jobs]
    batches = {i: batches_of(int(sum(m[0] for f, m in table.moments.items() if f != j.left_out))) for i, j in enumerate(jobs)}
    while active := [i for i, j in enumerate(jobs) if not j.state.done and j.state.epoch < until[i]]:
        loss, n, most = dict.fromkeys(active, 0.0), dict.fromkeys(active, 0), max(batches[i] for i in active)
        for b in range(most):
            for count in sorted({batches[i] for i in active if b < batches[i]}):
                now = [i for i in active if batches[i] == count]
                for k, (rows, lost, g) in _step_sums(table, [jobs[i] for i in now], b, count, parts).items():
                    i = now[k]
                    loss[i] += jobs[i].state.step(lost, g, rows)
                    n[i] += rows
        held = {r["job"]: r["loss"] / max(1.0, r["n"]) for r in scores(table, [jobs[i] for i in active]).collect()} if watch else {}
        for k, i in enumerate(active):
            jobs[i].state.end_epoch(loss[i] / max(1, n[i]), held.get(k))
    table.rows.unpersist()
    return jobs


def train(table: Matrix, jobs: list[Job], epochs: int | None = None, watch: bool = False) -> list[Job]:
    """Train networks further, in tasks where the table is small and by steps where it is not."""
    if not table.small:
        return train_by_steps(table, jobs, epochs, watch)
    spark = table.rows.sparkSession
    sent = spark.sparkContext.broadcast((at_hand(table), jobs))

    def run(batches):
        (ids, fold, y, x), jobs = sent.value
        for b in batches:
            for i in b.column(0).to_pylist():
                j = jobs[i]
                own = fold != (-2 if j.left_out is None else j.left_out)
                held = (j.inputs(x[~own]), y[~own]) if watch and j.left_out is not None else None
                state = train_in_task(j.state, ids[own], j.inputs(x[own]), y[own], held, epochs)
                yield pa.RecordBatch.from_pydict({"job": pa.array([i], pa.int32()), "state": pa.array([state.packed()], pa.binary())})

    rows = _dealt(spark, len(jobs)).mapInArrow(run, "job int, state binary").collect()  # a network each
    states = {r["job"]: State.unpacked(bytes(r["state"])) for r in rows}
    return [replace(j, state=states[i]) for i, j in enumerate(jobs)]


def _dealt(spark: SparkSession, n: int) -> DataFrame:
    return spark.createDataFrame([(i,) for i in range(n)], "job int").repartition(min(n, max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 4)))


def search_counts(table: Matrix, draws: list[dict], ranked: list[list[int]], seed: int = 42) -> DataFrame:
    """Cross-validated counts of every draw, ``draw, fold, tp, fp, fn, tn``, as ``trees.search_counts``.

    Draws that make the same network are trained once.
    """
    spark, folds = table.rows.sparkSession, len(ranked)
    keys = [(net_of({k: v for k, v in d.items() if k != "k"}), min(d["k"], len(ranked[0]))) for d in draws]
    same = {k: i for i, k in reversed(list(enumerate(keys)))}
    plan = [(i, f) for i, k in enumerate(keys) if same[k] == i for f in range(folds)]
    jobs = [job(table, keys[i][0], ranked[f][:keys[i][1]], f, seed) for i, f in plan]
    if table.small:
        sent = spark.sparkContext.broadcast((at_hand(table), jobs, plan))

        def run(batches):
            (ids, fold, y, x), jobs, plan = sent.value
            for b in batches:
                for n in b.column(0).to_pylist():
                    j, (i, f) = jobs[n], plan[n]
                    own = fold != f
                    state = train_in_task(j.state, ids[own], j.inputs(x[own]), y[own])
                    z = logits(j.inputs(x[~own]), state.weights, state.net)
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(
                        (i, f, *_counted(y[~own], 0.5 + (z > 0))), _COUNTS.types, strict=True)], names=_COUNTS.names)

        found = _dealt(spark, len(jobs)).mapInArrow(run, "draw int, fold int, tp long, fp long, fn long, tn long")
    else:
        rows = scores(table, train_by_steps(table, jobs)).collect()  # a row for each network
        found = spark.createDataFrame([(*plan[r["job"]], *(int(r[c]) for c in ("tp", "fp", "fn", "tn"))) for r in rows],
                                      "draw int, fold int, tp long, fp long, fn long, tn long")
    of = spark.createDataFrame([(i, same[k]) for i, k in enumerate(keys)], "draw int, trained int")
    return of.join(found.withColumnRenamed("draw", "trained"), "trained").drop("trained")


def held_out(table: Matrix, net: Net, columns: list, seed: int = 42) -> DataFrame:
    """``id, fold, label, p``: every row's probability by the network of the other folds, all folds trained side by side."""
    made, width = train(table, [job(table, net, c, f, seed) for f, c in enumerate(columns)]), table.width
    sent = table.rows.sparkSession.sparkContext.broadcast(made)

    def score(blocks):
        for b in blocks:
            ids, fold, y, x = _rows(b, width)
            for j in sent.value:
                own = fold == j.left_out
                z = np.clip(logits(j.inputs(x[own]), j.state.weights, j.state.net), -700, 700)
                yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(fold[own], pa.int32()), pa.array(y[own].astype(np.int32)),
                                                  pa.array(1 / (1 + np.exp(-z)))], ["id", "fold", "label", "p"])

    return table.rows.mapInArrow(score, "id long, fold int, label int, p double")
