"""Sum-of-squares packing of tokenized documents into sequences.

Each piece goes where the sum over residual gaps of (open sequences with that
gap) squared becomes smallest. The open sequences of one gap are alike, so a
step looks at the gaps' counts alone. Pieces are dealt at random into blocks
of bounded size that are packed apart; a block loses a few sequences that
stay open at its end.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from horizonkit.llm.common import as_bytes, slices
from horizonkit.llm.encode import encoder
from horizonkit.session import written

#: Pieces packed together; bounds a task's memory and its steps.
BLOCK = 1 << 13


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each length, longest first.

    Moving a bin from gap g to g - s changes the sum by
    2 * (N[g - s] - N[g]) + 2; a full bin (gap 0) isn't open and counts 0. Ties
    go to the smallest gap, an open bin before a new one.
    """
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    used = 0
    none = np.int64(1) << 40
    for at in np.argsort(-lengths, kind="stable").tolist():
        s = int(lengths[at])
        gain = 2 * (count[:capacity - s + 1] - count[s:]) + 2  # by gap, from s to capacity
        gain[0] = 1 - 2 * count[s]
        gain[count[s:] == 0] = none
        gain[-1] = 2 * count[capacity - s] + 1 if s < capacity else 0  # a new bin
        g = s + int(gain.argmin())
        if g == capacity:
            b, used = used, used + 1
        else:
            b = open_bins[g].pop()
            count[g] -= 1
        bins[at], offsets[at] = b, capacity - g
        if g > s:
            open_bins[g - s].append(b)
            count[g - s] += 1
    return bins, offsets


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Tokenize and cut: ``row, id, piece, start, length, ids_crc32``; ``row`` tells equal rows apart."""
    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for b in slices(batches):
            out = []
            enc = encoder(vocabulary)
            for doc, text in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
                ids = enc.encode(text) + int(end_id).to_bytes(4, "little")
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    out.append((row, doc, piece, at // 4, len(part) // 4, zlib.crc32(part)))
                    row += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)],
                                             ["row", "id", "piece", "start", "length", "ids_crc32"])

    part = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return part.mapInArrow(run, "row long, id long, piece long, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id",
         text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Tokenize every text, end it with ``end_id`` and pack it into sequences of ``capacity`` ids.

    Per piece: ``id, piece, start, length, ids_crc32, sequence_id, offset``.
    Only documents longer than a sequence are cut, into full pieces and a rest.

    A null or empty text is a document of the end id alone. Repeated rows and
    null ids are packed like any other row. Texts are tokenized whole; other columns
    play no part; an empty table gives an empty result.
    """
    pieces = written(token_pieces(docs, vocabulary, capacity, end_id, id_col, text_col), "pieces")
    blocks = max(1, -(-pieces.count() // block))
    step = (1 << 62) // blocks

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("row")
        bins, offsets = sum_of_squares(t["length"].to_numpy(), capacity)
        ids = bins + t["block"][0].as_py() * (1 << 32)
        return t.drop_columns(["row", "block"]).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets))

    dealt = pieces.withColumn("block", F.floor(F.shiftrightunsigned(F.xxhash64("row"), 2) / F.lit(step)).cast("long"))
    dealt = dealt.withColumn("block", F.least("block", F.lit(blocks - 1)))
    out = "id long, piece long, start long, length long, ids_crc32 long, sequence_id long, offset long"
    packed = dealt.groupBy("block").applyInArrow(run, out)
    return packed.withColumn("piece", F.col("piece").cast("int"))
