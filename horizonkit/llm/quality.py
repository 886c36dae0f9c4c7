"""Quality classifier: random-indexing word vectors, pooled, and a small network.

Every word has a sparse index vector of +1 and -1 entries; its word vector is the
sum of the index vectors of its neighbours over the whole corpus. Each word has a
vector of its own: tasks add up the sums of the words they meet, the sums of a
bucket of words are added up and written to files of the shared folder, and the
vectors of a document's words are looked up there. A document is the mean and
spread of its words' vectors, and a two-layer network, calibrated by one
temperature, scores it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from horizonkit.llm.common import as_bytes, slices
from horizonkit.llm.token_files import _array, _Output
from horizonkit.session import scratch_path

#: Words whose sums a task holds; beyond them it hands on all but the ``WORDS // 2`` met most often.
WORDS = 1 << 18
#: Size of the vectors, +-1 entries of an index vector, neighbours on each side.
DIM, ENTRIES, REACH = 32, 4, 2
#: Characters of text whose words' sums make a bucket, and words of texts taken at a time.
BUCKET_CHARS, AT_ONCE = 16_000_000, 1 << 17
#: At most this many labelled rows fit the classifier (those with the smallest hash of their id).
MAX_LABELLED = 20_000
#: In the files, sums that fit a byte take one.
KINDS = "<i1", "<i8"
#: Stands between documents; no word has it.
APART = -1
_WORD = re.compile(rb"[a-z\x80-\xff']+|[0-9]+|[^\sa-z0-9\x80-\xff']+")


def word_ids(text: bytes) -> np.ndarray:
    """63-bit hashes of a text's words: runs of letters, digits, or other signs, in small letters."""
    words = _WORD.findall(text.lower())
    return (np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) >> np.uint64(1)).view(np.int64)


def index_vectors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns and signs of the words' entries, from the low bits of their hashes."""
    bits = DIM.bit_length() - 1
    at = np.arange(ENTRIES)
    return (words[:, None] >> bits * at) & (DIM - 1), 1.0 - 2 * ((words[:, None] >> bits * ENTRIES + at) & 1)


def by_word(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word once, the rows in the words' order, and the last of each word's places there."""
    order = np.argsort(words)
    ordered = words[order]
    last = np.flatnonzero(np.append(ordered[1:] != ordered[:-1], True)) if len(words) else order
    return ordered[last], order, last


def totals(rows: np.ndarray, order: np.ndarray, last: np.ndarray, kind: type) -> np.ndarray:
    """Sums of each word's rows, added in ``kind``; the rows themselves stay as wide as they are."""
    if not len(last):
        return np.empty((0, rows.shape[1]), kind)
    return np.add.reduceat(rows[order], np.append(0, last[:-1] + 1), axis=0, dtype=kind)


class ContextSums:
    """Sums of neighbours' index vectors by word; ``surplus`` takes out what a task need not hold."""

    def __init__(self):
        self.words, self.sums, self.met = np.empty(0, np.int64), np.empty((0, DIM), np.int32), np.empty(0, np.int64)
        self.last = np.full(REACH, APART)  # as long as the reach
        self.waiting, self.size = [], 0

    def add(self, ids: np.ndarray) -> None:
        """A document's words; a cut of a long one keeps the words that reach over it."""
        for k in range(0, len(ids), AT_ONCE):
            self.waiting.append(ids[k:k + AT_ONCE])
            self.size += len(self.waiting[-1])
            if self.size >= AT_ONCE:
                self.flush()
        self.waiting.append(np.full(REACH, APART))

    def flush(self) -> None:
        """Count the pairs that end in the words waiting; the last words stay for the next ones' pairs."""
        ids = np.concatenate([self.last, *self.waiting])
        new = len(self.last)
        words, order, last = by_word(ids)
        at = np.empty(len(ids), np.int64)
        at[order] = np.repeat(np.arange(len(words)), np.diff(last, prepend=-1))
        columns, signs = index_vectors(words)
        own = np.zeros((len(words), DIM), np.int8)
        for j in range(ENTRIES):
            own[np.arange(len(words)), columns[:, j]] += signs[:, j].astype(np.int8)
        own[words == APART] = 0
        own, near = own[at], np.zeros((len(ids), DIM), np.int8)  # at most 2 * REACH * ENTRIES
        for d in range(1, REACH + 1):
            near[new:] += own[new - d:-d]
            near[new - d:-d] += own[new:]
        counts = np.diff(last, prepend=-1)
        known = words != APART
        self._add(words[known], totals(near, order, last, np.int32)[known], counts[known])
        self.last, self.waiting, self.size = ids[-REACH:], [], 0

    def _add(self, words: np.ndarray, sums: np.ndarray, met: np.ndarray) -> None:
        """Each of ``words`` once; new ones are put in their places."""
        at = np.searchsorted(self.words, words)
        old = np.zeros(len(words), bool)
        old[at < len(self.words)] = self.words[at[at < len(self.words)]] == words[at < len(self.words)]
        self.sums[at[old]] += sums[old]
        self.met[at[old]] += met[old]
        self.words, self.sums, self.met = (np.insert(a, at[~old], b[~old], axis=0) for a, b in (
            (self.words, words), (self.sums, sums), (self.met, met)))

    def surplus(self) -> tuple[np.ndarray, np.ndarray] | None:
        """Words and sums to hand on, if more than ``WORDS`` are held."""
        if len(self.words) <= WORDS:
            return None
        stay = np.zeros(len(self.words), bool)
        stay[np.argpartition(self.met, -(WORDS // 2))[-(WORDS // 2):]] = True
        out = self.words[~stay], self.sums[~stay]
        self.words, self.sums, self.met = self.words[stay], self.sums[stay], self.met[stay] // 2
        return out

    def rest(self) -> tuple[np.ndarray, np.ndarray]:
        self.flush()
        return self.words, self.sums


def bucket_of(words: np.ndarray, buckets: int) -> np.ndarray:
    return (words >> 32) % buckets


class Vectors:
    """Unit word vectors by their sums in files of the shared folder: for each bucket its words in order, by the width of their sums."""

    def __init__(self, folder: str, buckets: int, written: set[int]):
        self.folder, self.buckets, self.written, self.mapped = folder, buckets, written, {}

    def bucket(self, b: int) -> list[tuple[np.ndarray, np.ndarray]]:
        if b in self.mapped:
            return self.mapped[b]
        parts = [(_array(self.folder, f"{b:05d}.words{kind[-1]}", "<i8"),
                  _array(self.folder, f"{b:05d}.sums{kind[-1]}", kind).reshape(-1, DIM)) for kind in KINDS]
        if any(isinstance(w, np.memmap) for w, _ in parts):  # what is read whole does not stay
            self.mapped[b] = parts
        return parts

    def of(self, words: np.ndarray) -> np.ndarray:
        """A row for each word; zeros for one that the corpus has not."""
        out = np.zeros((len(words), DIM), np.float32)
        bucket = bucket_of(words, self.buckets)
        order = np.argsort(bucket, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            if len(rows) and (b := int(bucket[rows[0]])) in self.written:
                for known, sums in self.bucket(b):
                    if len(known):
                        at = np.minimum(np.searchsorted(known, words[rows]), len(known) - 1)
                        hit = known[at] == words[rows]
                        found = sums[at[hit]].astype(np.float64)
                        length = np.linalg.norm(found, axis=1, keepdims=True)
                        out[rows[hit]] = found / np.where(length > 0, length, 1)
        return out


def added_up(blobs: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Packed words and sums (a byte or four each) -> each word once, in order, and its total."""
    words = np.frombuffer(b"".join(w for w, _ in blobs), "<i8")
    small = [len(s) == len(w) // 8 * DIM for w, s in blobs]
    rows = np.repeat(small, [len(w) // 8 for w, _ in blobs])
    parts = []
    for kind, chosen in (("i1", True), ("<i4", False)):  # sums stay as wide as they came
        sums = np.frombuffer(b"".join(s for (_, s), is_small in zip(blobs, small, strict=True) if is_small == chosen), kind)
        own, order, last = by_word(words[rows == chosen])
        parts.append((own, totals(sums.reshape(-1, DIM), order, last, np.int64)))
    (words, total), (wide, more) = parts
    at = np.searchsorted(words, wide)
    old = np.zeros(len(wide), bool)
    old[at < len(words)] = words[at[at < len(words)]] == wide[at < len(words)]
    total[at[old]] += more[old]
    return np.insert(words, at[~old], wide[~old]), np.insert(total, at[~old], more[~old], axis=0)


def word_vectors(docs: DataFrame, text_col: str = "text") -> Vectors:
    """Unit word vectors from all texts, one for each word, in as many buckets as the texts' length asks for."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    chars = texts.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0  # one number
    folder, buckets = scratch_path(spark, "words"), 1 + chars // BUCKET_CHARS

    def handed_on(words, sums):
        """Rows of a bucket's words, those with small sums in a byte each."""
        bucket = bucket_of(words, buckets)
        wide = np.abs(sums).max(1, initial=0) > 127
        for kind, rows in (("<i4", np.flatnonzero(wide)), ("i1", np.flatnonzero(~wide))):
            rows = rows[np.argsort(bucket[rows], kind="stable")]
            parts = [r for r in np.split(rows, np.flatnonzero(np.diff(bucket[rows])) + 1) if len(r)]
            if parts:
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array([int(bucket[r[0]]) for r in parts], pa.int32()),
                    "words": pa.array([words[r].astype("<i8").tobytes() for r in parts], pa.binary()),
                    "sums": pa.array([sums[r].astype(kind).tobytes() for r in parts], pa.binary())})

    def run(batches):
        acc = ContextSums()
        for b in slices(batches, 64):
            for text in as_bytes(b.column(0)):
                acc.add(word_ids(text))
                if (out := acc.surplus()) is not None:
                    yield from handed_on(*out)
        yield from handed_on(*acc.rest())

    def write(t: pa.Table) -> pa.Table:
        words, total = added_up(list(zip(t["words"].to_pylist(), t["sums"].to_pylist(), strict=True)))
        b, small = t["bucket"][0].as_py(), np.abs(total).max(1) <= 127
        for kind, rows in zip(KINDS, (small, ~small), strict=True):
            for name, values in (("words", words[rows].astype("<i8")), ("sums", total[rows].astype(kind))):
                f = _Output(folder, f"{b:05d}.{name}{kind[-1]}")
                f.write(values.tobytes())
                f.close()
        return pa.table({"bucket": t["bucket"][:1]})

    written = (texts.mapInArrow(run, "bucket int, words binary, sums binary").repartition(buckets, "bucket").groupBy("bucket")
               .applyInArrow(write, "bucket int").collect())  # a number for each bucket
    return Vectors(folder, buckets, {r["bucket"] for r in written})


def pooled(texts: list[bytes], vectors: Vectors) -> np.ndarray:
    """A row for each text: mean and standard deviation of its word vectors; zeros without words."""
    out, many, size = [], [], 0
    for k, text in enumerate(texts):
        many.append(word_ids(text))
        size += len(many[-1])
        if size >= AT_ONCE or k == len(texts) - 1:
            words, at = np.unique(np.concatenate(many), return_inverse=True)
            rows, start = vectors.of(words), 0
            for ids in many:
                out.append(_mean_and_spread(at[start:start + len(ids)], rows))
                start += len(ids)
            many, size = [], 0
    return np.array(out).reshape(len(texts), 2 * DIM)


def _mean_and_spread(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    first, second = np.zeros(DIM), np.zeros(DIM)
    for at in range(0, len(ids), AT_ONCE):
        v = vectors[ids[at:at + AT_ONCE]]
        first += v.sum(0, dtype=np.float64)
        second += np.einsum("ij,ij->j", v, v, dtype=np.float64)
    n = max(1, len(ids))
    mean = first / n
    return np.concatenate((mean, np.sqrt(np.maximum(second / n - mean * mean, 0))))


@dataclass
class Network:
    """Two layers on standardised inputs; logits are divided by ``temperature``."""

    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.shift) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, rate: float = 0.01,
                batch: int = 256, decay: float = 1e-4, seed: int = 5) -> Network:
    """Adam on the cross-entropy of four fifths of the rows; the temperature from the rest."""
    rng = np.random.RandomState(seed)
    order = rng.permutation(len(x))
    held, own = order[:len(x) // 5], order[len(x) // 5:]
    scale = x[own].std(0)
    net = Network(x[own].mean(0), np.where(scale > 1e-9, scale, 1.0), rng.randn(x.shape[1], hidden) / np.sqrt(x.shape[1]),
                  np.zeros(hidden), rng.randn(hidden) / np.sqrt(hidden), 0.0)
    z = (x - net.shift) / net.scale
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        rows = rng.permutation(own)
        for at in range(0, len(rows), batch):
            i = rows[at:at + batch]
            h = np.tanh(z[i] @ params[0] + params[1])
            err = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -60, 60))) - y[i]) / len(i)
            back = np.outer(err, params[2]) * (1 - h * h)
            t += 1
            for k, g in enumerate((z[i].T @ back, back.sum(0), h.T @ err, err.sum(keepdims=True))):
                g = g + decay * params[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                params[k] = params[k] - step * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    if len(held):
        logits = net.logits(x[held])

        def loss(temperature: float) -> float:
            s = logits / temperature
            return float(np.mean(np.logaddexp(0, s) - y[held] * s))

        net.temperature = float(min(np.geomspace(0.25, 8, 81), key=loss))
    return net


def labelled_vectors(docs: DataFrame, labels: DataFrame, vectors: Vectors, id_col: str, text_col: str,
                     limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Pooled vectors and labels of at most ``limit`` labelled documents; ``labels`` is ``(id, y)``."""
    chosen = (labels.where("id is not null and y is not null").groupBy("id").agg(F.min("y").alias("y"))
              .orderBy(F.xxhash64("id"), "id").limit(limit))  # at most ``limit`` rows of two numbers
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(vectors)

    def run(batches):
        for b in slices(batches):
            x = pooled(as_bytes(b.column(2)), sent.value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["id", "y", "x"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = (texts.join(F.broadcast(chosen), "id").select("id", F.col("y").cast("double").alias("y"), "text")
            .mapInArrow(run, "id long, y double, x array<double>")
            .groupBy("id", "y").agg(F.min("x").alias("x")).orderBy("id").collect())
    return np.array([r["x"] for r in rows]).reshape(len(rows), 2 * DIM), np.array([r["y"] for r in rows])


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  max_labelled: int = MAX_LABELLED, out: str = "score") -> DataFrame:
    """``docs`` with a column: the calibrated probability of label 1.

    ``labels``: ``(id, y)`` rows to learn from; of several labels of an id the
    smallest counts, of several rows of an id one text. Word vectors come from all texts.
    At most ``max_labelled`` labelled documents, those of smallest hash, fit the network.

    A null text counts as empty; an empty one is scored from zero vectors. Without any
    labelled document every score is 0.5; if all labels agree, the score is
    that label. Repeated rows get equal scores. All columns of ``docs`` stay, in order.
    """
    from pyspark.sql import types as T

    from horizonkit.llm.common import added
    vectors = word_vectors(docs, text_col)
    x, y = labelled_vectors(docs, labels, vectors, id_col, text_col, max_labelled)
    if len(set(y)) < 2:
        value = float(y[0]) if len(y) else 0.5
        plain, _, _ = added(docs, [])
        return plain.withColumn("s", F.lit(value)).toDF(*docs.columns, out)
    sent = docs.sparkSession.sparkContext.broadcast((vectors, fit_network(x, y)))
    plain, schema, old = added(docs, [T.StructField("s", T.DoubleType())])
    at = list(old).index(text_col)

    def run(batches):
        vectors, net = sent.value
        for b in slices(batches):
            x = pooled(as_bytes(b.column(at)), vectors)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(net.score(x))], [*b.schema.names, "s"])

    return plain.mapInArrow(run, schema).toDF(*docs.columns, out)


def keep_predicted(score: Column, threshold: float = 0.3) -> Column:
    return (score >= F.lit(threshold)).cast("int")
