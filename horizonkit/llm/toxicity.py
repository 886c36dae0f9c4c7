"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other, and each later model also gets
the probabilities of the earlier ones. To learn what it will see in use, it
is trained with out-of-fold probabilities: those of models that did not train on the row.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from horizonkit.llm.common import added, as_bytes, slices

#: Hashed words (presence), the lengths of beginnings in bytes, and the least z-score of a word that a model reads.
WORDS, STEMS, LEAST_Z = 1 << 19, (4, 5, 7), 3.0
#: At most this many labelled rows fit the chain (those with the smallest hash of their id).
MAX_LABELLED = 8_000
FOLDS = 3
_WORD = re.compile(rb"[a-z\x80-\xff]+")


def word_set(text: bytes) -> np.ndarray:
    """Sorted hashes of the words a text holds, and of their beginnings, which inflected forms share."""
    words = set(_WORD.findall(text.lower()))
    stems = {b"^" + w[:n] for w in words for n in STEMS if len(w) > n}
    hashed = np.fromiter(map(zlib.crc32, words | stems), np.int64, len(words) + len(stems))
    return np.unique(hashed & (WORDS - 1)).astype(np.int32)


@dataclass
class Rows:
    """Rows of present words, one after the other, and dense columns beside them."""

    words: np.ndarray
    starts: np.ndarray
    dense: np.ndarray

    @staticmethod
    def of(sets: list[np.ndarray], dense: np.ndarray) -> Rows:
        n = np.array([len(s) for s in sets], np.int64)
        return Rows(np.concatenate([*sets, np.empty(0, np.int32)]), np.concatenate(([0], np.cumsum(n))), dense)

    def sums(self, weights: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0.0], np.cumsum(weights[self.words])))
        return total[self.starts[1:]] - total[self.starts[:-1]]

    def back(self, err: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.words, np.repeat(err, np.diff(self.starts)), size)

    def only(self, words: np.ndarray) -> Rows:
        """The rows with these words alone."""
        keep = words[self.words]
        return Rows(self.words[keep], np.concatenate(([0], np.cumsum(keep)))[self.starts], self.dense)

    def take(self, keep: np.ndarray) -> Rows:
        n = np.diff(self.starts)
        return Rows(self.words[np.repeat(keep, n)], np.concatenate(([0], np.cumsum(n[keep]))), self.dense[keep])


@dataclass
class Linear:
    words: np.ndarray
    dense: np.ndarray
    bias: float

    def score(self, rows: Rows) -> np.ndarray:
        z = rows.sums(self.words) + rows.dense @ self.dense + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def evidence(rows: Rows, y: np.ndarray, size: int) -> np.ndarray:
    """Log-odds of each word between the classes, 0 where chance explains it.

    Weighing presence by it keeps the thousands of indifferent words of a
    long text from drowning the few that tell.
    """
    bad, good = rows.back(y, size) + 0.5, rows.back(1 - y, size) + 0.5
    odds = np.log(bad / (y.sum() + 1)) - np.log(good / (len(y) - y.sum() + 1))
    z = odds / np.sqrt(1 / bad + 1 / good)
    return np.where(np.abs(z) >= LEAST_Z, odds, 0.0)


def fit_linear(rows: Rows, y: np.ndarray, steps: int = 60, rate: float = 0.3, decay: float = 1e-4, size: int = WORDS) -> Linear:
    """Logistic regression on the words with evidence, both classes of equal weight; Adagrad."""
    odds = evidence(rows, y, size)
    used = np.flatnonzero(odds)
    place = np.zeros(size, np.int64)
    place[used] = np.arange(len(used))
    rows = rows.only(odds != 0)
    rows = Rows(place[rows.words], rows.starts, rows.dense)
    scale = odds[used]
    share = y.mean()
    weight = np.where(y > 0, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9)) / len(y)
    w, d, b = np.zeros(len(used)), np.zeros(rows.dense.shape[1]), 0.0
    gw, gd, gb = np.full(len(used), 1e-8), np.full(len(d), 1e-8), 1e-8
    for _ in range(steps):
        err = (1 / (1 + np.exp(-np.clip(rows.sums(w * scale) + rows.dense @ d + b, -60, 60))) - y) * weight
        g, k, c = rows.back(err, len(used)) * scale + decay * w, rows.dense.T @ err + decay * d, err.sum()
        gw, gd, gb = gw + g * g, gd + k * k, gb + c * c
        w, d, b = w - rate * g / np.sqrt(gw), d - rate * k / np.sqrt(gd), b - rate * c / np.sqrt(gb)
    out = np.zeros(size)
    out[used] = w * scale
    return Linear(out, d, float(b))


@dataclass
class Chain:
    """Models of the categories in order; each but the first also reads the earlier ones' probabilities."""

    names: list[str]
    models: list[Linear] = field(default_factory=list)

    def score(self, sets: list[np.ndarray]) -> np.ndarray:
        out = np.empty((len(sets), 0))
        for model in self.models:
            out = np.column_stack((out, model.score(Rows.of(sets, out))))
        return out


def fit_chain(sets: list[np.ndarray], toxic: np.ndarray, folds: int = FOLDS) -> Chain:
    """The chain of ``categories``. A row's out-of-fold probabilities come from models, and from targets, that never saw its fold."""
    fold = np.arange(len(sets)) % folds
    names, targets = categories(sets, toxic, fold >= 0)
    others = [categories(sets, toxic, fold != f)[1] if (fold != f).any() else targets for f in range(folds)]
    chain, earlier = Chain(names), np.empty((len(sets), 0))
    for k in range(len(names)):
        rows = Rows.of(sets, earlier)
        chain.models.append(fit_linear(rows, targets[:, k]))
        unseen = np.empty(len(sets))
        for f in range(folds):
            held = fold == f
            own = fit_linear(rows.take(~held), others[f][~held, k]) if (~held).any() else chain.models[-1]
            unseen[held] = own.score(rows.take(held))
        earlier = np.column_stack((earlier, unseen))
    return chain


def lexicon(sets: list[np.ndarray], toxic: np.ndarray, least: int = 10, times: float = 20.0) -> np.ndarray:
    """Words of at least ``least`` toxic rows and ``times`` as frequent in them as in others."""
    rows = Rows.of(sets, np.empty((len(sets), 0)))
    bad = rows.back(toxic, WORDS)
    good = rows.back(1 - toxic, WORDS)
    odds = (bad / max(1.0, toxic.sum())) / ((good + 0.5) / max(1.0, (1 - toxic).sum()))
    return (bad >= least) & (odds >= times)


def categories(sets: list[np.ndarray], toxic: np.ndarray, learn: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Targets of the chain from one label: wording that marks toxic texts, several such words, the label.

    The first two are derived: a text holds a word of the ``lexicon`` of the rows ``learn``, or three of them.
    """
    bad = lexicon([s for s, own in zip(sets, learn, strict=True) if own], toxic[learn])
    hits = np.array([bad[s].sum() for s in sets])
    return ["insult", "severe", "toxic"], np.column_stack((hits >= 1, hits >= 3, toxic > 0)).astype(float)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   max_labelled: int = MAX_LABELLED, out: str = "toxicity") -> DataFrame:
    """``docs`` with a column of probabilities by category, the last one the label's.

    ``labels``: ``(id, y)`` rows to learn from; of several labels of an id the largest
    counts, of several rows of an id one text. At most ``max_labelled`` labelled
    documents, those of smallest hash, fit the chain. Every word of a text counts, whatever its length.

    A null text counts as empty. Without labelled documents of both kinds all
    probabilities are 0. Repeated rows get equal scores. All columns of
    ``docs`` stay, in order. An empty table gives an empty result.
    """
    names = ["insult", "severe", "toxic"]
    kind = T.StructType([T.StructField(x, T.DoubleType()) for x in names])
    chosen = (labels.where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
              .orderBy(F.xxhash64("id"), "id").limit(max_labelled))  # at most that many rows of two numbers

    def sets_of(batches):
        for b in slices(batches):
            sets = [word_set(t) for t in as_bytes(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "y", "words"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = (texts.join(F.broadcast(chosen), "id").select("id", F.col("y").cast("double").alias("y"), "text")
            .mapInArrow(sets_of, "id long, y double, words binary")
            .groupBy("id", "y").agg(F.min("words").alias("words")).orderBy("id").collect())
    sets, y = [np.frombuffer(r["words"], np.int32) for r in rows], np.array([float(r["y"] > 0) for r in rows])
    plain, schema, old = added(docs, [T.StructField("p", kind)])
    if len(set(y)) < 2:
        return plain.withColumn("p", F.struct(*[F.lit(0.0).alias(n) for n in names])).toDF(*docs.columns, out)
    sent = docs.sparkSession.sparkContext.broadcast(fit_chain(sets, y))
    at = list(old).index(text_col)

    def run(batches):
        for b in slices(batches):
            p = sent.value.score([word_set(t) for t in as_bytes(b.column(at))])
            fields = pa.StructArray.from_arrays([pa.array(p[:, k]) for k in range(len(names))], names)
            yield pa.RecordBatch.from_arrays([*b.columns, fields], [*b.schema.names, "p"])

    return plain.mapInArrow(run, schema).toDF(*docs.columns, out)
