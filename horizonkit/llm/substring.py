"""Substring dedup: windows of words that an earlier document has too.

Every window of ``width`` words gets two Rabin-Karp hashes (from prefix sums
of powers, so a whole batch takes a few array operations): one deals windows
to buckets, one is compared there. A task sends each hash once, with the
smallest document that has it; windows of its other documents are already
known to repeat. Buckets are blobs of packed arrays, 7 bytes a window and a few
tenths more, because 8-byte columns of every window would cost several times
the input in shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from horizonkit.llm.common import as_bytes, slices

#: Two odd bases of the rolling hashes, modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Windows gathered in a task before they are sent.
CHUNK_WINDOWS = 1 << 20
#: Characters of text a bucket is meant to hold the windows of.
BUCKET_CHARS = 16_000_000
#: Stands for a null id: no id is larger.
NO_ID = np.iinfo(np.int64).max
HASH_BYTES = 7


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n - 1), modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def window_hashes(words: np.ndarray, width: int, base: int) -> np.ndarray:
    """Rabin-Karp hash of every ``width`` consecutive values, modulo 2**64.

    With P[i] the sum of x[t] * base**-t below i, the window at i is
    (P[i + width] - P[i]) * base**i.
    """
    n = len(words)
    if n < width:
        return np.empty(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * powers(pow(base, -1, 1 << 64), n), dtype=np.uint64, out=sums[1:])
    return (sums[width:] - sums[:-width]) * powers(base, n - width + 1)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread a hash whose low bits are weak over all 64 bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def covered(flags: np.ndarray, n_words: int, width: int) -> np.ndarray:
    """Words that a flagged window covers."""
    steps = np.zeros(n_words + 1, np.int64)
    at = np.flatnonzero(flags)
    steps[at] += 1
    np.subtract.at(steps, at + width, 1)
    return np.cumsum(steps[:-1]) > 0


def intervals(mask: np.ndarray) -> list[dict]:
    """Maximal runs of true values as start and end (exclusive)."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]


def planes(a: np.ndarray, size: int) -> bytes:
    """The low ``size`` bytes of each value, byte by byte: zero bytes stand together and compress."""
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def from_planes(b: bytes, size: int) -> np.ndarray:
    a = np.frombuffer(b, np.uint8).reshape(size, -1)
    out = np.zeros((a.shape[1], 8), np.uint8)
    out[:, :size] = a.T
    return out.reshape(-1).view("<u8")


class _Chunk:
    """Windows of some documents: the smallest document of each hash, and who else has it."""

    def __init__(self, width: int, buckets: int):
        self.width, self.buckets = width, buckets
        self.clear()

    def clear(self) -> None:
        self.ids, self.keys, self.hashes, self.deal, self.size, self.seen = [], [], [], [], 0, set()

    def add(self, doc: int | None, key: int, text: bytes) -> None:
        if (doc, key) in self.seen:  # a repeated row adds nothing
            return
        x = word_hashes(text.split())
        if len(x) >= self.width:
            self.seen.add((doc, key))
            a, b = (window_hashes(x, self.width, base) for base in BASES)
            self.ids.append(NO_ID if doc is None else doc)
            self.keys.append(key)
            self.hashes.append(mixed(a) >> np.uint64(8 * (8 - HASH_BYTES)))
            self.deal.append((mixed(b) % np.uint64(self.buckets)).astype(np.int32))
            self.size += len(a)

    def rows(self) -> pa.RecordBatch | None:
        """A row per bucket: hashes, their documents' places in ``ids``, their positions; then what is known to repeat."""
        if not self.size:
            return None
        n = np.array([len(x) for x in self.hashes])
        h, deal = np.concatenate(self.hashes), np.concatenate(self.deal)
        ids, keys = np.array(self.ids, np.int64), np.array(self.keys, np.int64)
        doc = np.repeat(np.arange(len(n), dtype=np.int64), n)
        pos = np.arange(len(h), dtype=np.int64) - np.repeat(np.cumsum(n) - n, n)
        # the order of documents by id, so that the smallest comes first within a hash
        rank = np.empty(len(ids), np.int64)
        rank[np.lexsort((keys, ids))] = np.arange(len(ids))
        order = np.argsort(h)
        same = h[order][1:] == h[order][:-1]
        twin = np.zeros(len(h), bool)
        twin[1:] |= same
        twin[:-1] |= same
        some = order[twin]
        some = some[np.lexsort((pos[some], rank[doc[some]], deal[some], h[some]))]
        send, known = np.ones(len(h), bool), np.zeros(len(h), bool)
        if len(some):
            hs, ds = h[some], doc[some]
            head = np.concatenate(([True], (hs[1:] != hs[:-1]) | (deal[some][1:] != deal[some][:-1])))
            first = some[np.maximum.accumulate(np.where(head, np.arange(len(some)), 0))]
            known[some] = ids[doc[first]] < ids[ds]
            # of the smallest id: each document once, at its first position
            again = np.concatenate(([False], ~head[1:] & (ds[1:] == ds[:-1])))
            send[some] = ~known[some] & ~again
        out = []
        at = np.flatnonzero(send)
        at = at[np.argsort(deal[at], kind="stable")]
        cuts = np.searchsorted(deal[at], np.arange(self.buckets + 1))
        for b in range(self.buckets):
            if len(part := at[cuts[b]:cuts[b + 1]]):
                own, where = np.unique(doc[part], return_inverse=True)
                out.append((b, planes(h[part], HASH_BYTES), planes(np.diff(where, prepend=0), 4), planes(pos[part], 4),
                            ids[own].tobytes(), keys[own].tobytes(), False))
        at = np.flatnonzero(known)
        if len(at):
            own, where = np.unique(doc[at], return_inverse=True)
            out.append((int(deal[at[0]]), b"", planes(np.diff(where, prepend=0), 4), planes(pos[at], 4),
                        ids[own].tobytes(), keys[own].tobytes(), True))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _SENT.values(), strict=True)],
                                          list(_SENT))


_SENT = {"bucket": pa.int32(), "h": pa.binary(), "doc": pa.binary(), "pos": pa.binary(), "ids": pa.binary(),
         "keys": pa.binary(), "known": pa.bool_()}
_SENT_SQL = "bucket int, h binary, doc binary, pos binary, ids binary, keys binary, known boolean"


def _flagged(table: pa.Table, groups: int) -> pa.Table:
    """A bucket's rows -> the positions of windows that a smaller id has too, a row for each group of documents."""
    h, ids, keys, pos, known = [], [], [], [], []
    for r in table.select(["h", "doc", "pos", "ids", "keys", "known"]).to_batches():
        for x in r.to_pylist():
            own = np.cumsum(from_planes(x["doc"], 4)).astype(np.int64)
            ids.append(np.frombuffer(x["ids"], np.int64)[own])
            keys.append(np.frombuffer(x["keys"], np.int64)[own])
            pos.append(from_planes(x["pos"], 4).astype(np.int64))
            known.append(np.full(len(own), x["known"]))
            h.append(np.zeros(len(own), np.uint64) if x["known"] else from_planes(x["h"], HASH_BYTES))
    h, ids, keys, pos, known = map(np.concatenate, (h, ids, keys, pos, known))
    at = np.flatnonzero(~known)
    order = at[np.argsort(h[at])]
    same = h[order][1:] == h[order][:-1]
    twin = np.zeros(len(order), bool)
    twin[1:] |= same
    twin[:-1] |= same
    some = order[twin]
    flag = known
    if len(some):
        some = some[np.lexsort((ids[some], h[some]))]
        head = np.concatenate(([True], h[some][1:] != h[some][:-1]))
        first = some[np.maximum.accumulate(np.where(head, np.arange(len(some)), 0))]
        flag[some] = ids[first] < ids[some]
    at = np.flatnonzero(flag)
    group = (mixed(ids[at].view(np.uint64) ^ keys[at].view(np.uint64)) % np.uint64(groups)).astype(np.int32)
    order = np.argsort(group, kind="stable")
    at, group = at[order], group[order]
    cuts = np.flatnonzero(np.diff(group, prepend=-1))
    out = [(int(group[c]), *_packed(ids[part], keys[part], pos[part])) for c, part in
           zip(cuts.tolist(), np.split(at, cuts[1:]) if len(cuts) else [], strict=True)]
    cols = list(zip(*out, strict=True)) or [()] * 5
    return pa.table([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["part", "ids", "keys", "n", "pos"])


def _packed(ids: np.ndarray, keys: np.ndarray, pos: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
    """Documents, their number of positions, and the positions."""
    order = np.lexsort((pos, keys, ids))
    ids, keys, pos = ids[order], keys[order], pos[order]
    head = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1]))))
    return ids[head].tobytes(), keys[head].tobytes(), planes(np.diff(head, append=len(ids)), 4), planes(pos, 4)


def _marks(table: pa.Table) -> pa.Table:
    """All buckets' positions of some documents -> a row per document."""
    ids, keys, pos = [], [], []
    for x in table.select(["ids", "keys", "n", "pos"]).to_pylist():
        n = from_planes(x["n"], 4).astype(np.int64)
        ids.append(np.repeat(np.frombuffer(x["ids"], np.int64), n))
        keys.append(np.repeat(np.frombuffer(x["keys"], np.int64), n))
        pos.append(from_planes(x["pos"], 4).astype("<u4"))
    ids, keys, pos = map(np.concatenate, (ids, keys, pos))
    order = np.lexsort((pos, keys, ids))
    ids, keys, pos = ids[order], keys[order], pos[order]
    head = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1]))))
    return pa.table({"id": pa.array(ids[head], pa.int64(), mask=ids[head] == NO_ID), "key": pa.array(keys[head]),
                     "pos": pa.array([p.tobytes() for p in np.split(pos, head[1:])], pa.binary())})


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50,
                   buckets: int | None = None) -> DataFrame:
    """Cut words covered by a ``width``-word window that starts in a document of smaller id too.

    Per row: ``id, n_words, n_removed, removed`` (array of word intervals, end
    exclusive), ``kept`` (the other words, joined by one space). Windows are
    judged on the input. Words are what stands between bytes 0x20, 0x09-0x0D.

    A null or blank text has no words and an empty ``kept``. A null id counts
    as larger than any other, and equal ids do not cut each other, so repeated
    rows stay alike. Texts shorter than a window stay whole; long ones are
    taken whole. Other columns play no part; an empty table gives an empty
    result. ``buckets``: shuffle groups of windows; by default one for each
    ``BUCKET_CHARS`` characters of the input, at least as many as shuffle partitions.
    """
    spark = docs.sparkSession
    part = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    if buckets is None:
        chars = part.agg(F.sum(F.length("text"))).first()[0] or 0
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // BUCKET_CHARS))
    groups = 1 + buckets // 4
    keyed = part.withColumn("key", F.xxhash64("text"))

    def send(batches):
        chunk = _Chunk(width, buckets)
        for b in slices(batches):
            for doc, text, key in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), b.column(2).to_pylist(), strict=True):
                chunk.add(doc, key, text)
                if chunk.size >= CHUNK_WINDOWS:
                    yield chunk.rows()
                    chunk.clear()
        if chunk.size:
            yield chunk.rows()

    marks = (keyed.mapInArrow(send, _SENT_SQL).groupBy("bucket")
             .applyInArrow(lambda t: _flagged(t, groups), "part int, ids binary, keys binary, n binary, pos binary")
             .groupBy("part").applyInArrow(_marks, "id long, key long, pos binary"))

    def cut(batches):
        for b in slices(batches):
            out = []
            for doc, text, marked in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), b.column(2).to_pylist(), strict=True):
                words = text.split()
                if not marked:
                    out.append((doc, len(words), 0, [], b" ".join(words).decode()))
                    continue
                at = np.frombuffer(marked, "<u4")
                h = window_hashes(word_hashes(words), width, BASES[0])
                mask = covered(np.isin(h, h[at]), len(words), width)
                kept = [words[i] for i in np.flatnonzero(~mask)]
                out.append((doc, len(words), int(mask.sum()), intervals(mask), b" ".join(kept).decode()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _CUT.values(), strict=True)], list(_CUT))

    joined = keyed.join(marks.select(F.col("id").alias("i"), F.col("key").alias("k"), "pos"),
                        F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")), "left")
    return joined.select("id", "text", "pos").mapInArrow(cut, T.StructType.fromDDL(_CUT_SQL))


_CUT = {"id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(),
        "removed": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), "kept": pa.string()}
_CUT_SQL = "id long, n_words long, n_removed long, removed array<struct<start: long, end: long>>, kept string"
