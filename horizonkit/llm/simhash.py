"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into ``radius // 2 + 1`` segments. Two
fingerprints within ``radius`` bits then have a segment that differs in at
most one bit, so they share a variant of that segment with one bit
wildcarded. The variants of the distinct fingerprints are joined on equality
and each pair is verified by its bit distance.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from horizonkit.llm.common import as_bytes, slices, unused
from horizonkit.llm.components import connected_components
from horizonkit.session import written

BITS = 64
#: Shingles hashed at a time; bounds the memory that one long text takes.
SHINGLES_AT_ONCE = 1 << 16
#: Rows of one variant beyond which it is cut further (see ``near_pairs``).
HOT_VARIANT = 512


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned fingerprint of a text; 0 for a text without words."""
    words = text.lower().split()  # bytes: A-Z only, and exactly 0x20 and 0x09-0x0D
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, SHINGLES_AT_ONCE):
        part = words[at:at + SHINGLES_AT_ONCE + shingle - 1]
        rows = [b" ".join(part)] if len(words) < shingle else map(
            b" ".join, zip(*(part[i:] for i in range(shingle)), strict=False))
        h = np.array(list(map(xxhash.xxh64_intdigest, rows, repeat(seed))), dtype="<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = 3, seed: int = 42) -> DataFrame:
    """``(id, content, fp)`` per row: fp has the fingerprint's bits as a signed long, content hashes the text."""
    def run(batches):
        for b in slices(batches):
            fp = np.array([fingerprint(t, shingle, seed) for t in as_bytes(b.column(2))], dtype="<u8")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view("<i8"))], ["id", "content", "fp"])

    part = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("content"),
                       F.col(text_col).cast("string").alias("text"))
    return part.mapInArrow(run, "id long, content long, fp long")


def _segments(radius: int) -> list[tuple[int, int]]:
    """(offset, width) of the segments: two at least, so that none is wider than 32 bits."""
    n = max(2, radius // 2 + 1)
    cuts = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _bits(fp: Column, off: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, off).bitwiseAND(F.lit((1 << width) - 1))


def _outside(fp: Column, off: int, width: int, n: int) -> Column:
    """The bits outside a segment as ``n`` pieces, each marked with its number."""
    low = _bits(fp, 0, off) if off else F.lit(0).cast("long")
    top = off + width
    rest = low if top == BITS else F.shiftleft(F.shiftrightunsigned(fp, top), off).bitwiseOR(low)
    cuts = [(BITS - width) * i // n for i in range(n + 1)]
    return F.array(*[_bits(rest, a, b - a) + F.lit(j << 33) for j, (a, b) in
                     enumerate(zip(cuts, cuts[1:], strict=False))])


def near_pairs(fps: DataFrame, radius: int = 3, hot: int = HOT_VARIANT) -> DataFrame:
    """Distinct fingerprints ``(fp)`` -> every pair ``(u, v)``, u < v, within ``radius`` bits, once.

    A pair counts only at its first segment of at most one differing bit and
    under the lowest variant it shares there. A variant with more than ``hot``
    fingerprints is cut further: outside its segment a pair differs in at most
    ``radius`` bits, so of ``radius + 1`` pieces of the rest one is equal; a
    join on that piece as well finds the same pairs with fewer comparisons.
    """
    if not 0 <= radius <= 15:
        raise ValueError("radius: 0 to 15 bits")
    segs = _segments(radius)
    seg = F.array(*[F.lit(s) for s, (_, w) in enumerate(segs) for _ in range(w)])
    off = F.array(*[F.lit(o) for o, w in segs for _ in range(w)])
    mask = F.array(*[F.lit(((1 << w) - 1) & ~(1 << p)).cast("long") for _, w in segs for p in range(w)])
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a table of its own: the scan deals the few bytes before the variants to all cores, adaptive coalescing would not
    fps = written(fps.select("fp").repartition(n), "distinct")
    keys = (fps.select("fp", seg.alias("s"), off.alias("o"), mask.alias("m"))
            .select("fp", F.expr("explode(transform(sequence(0, 63), i -> struct(i AS i, s[i] AS s, "
                                 "shiftrightunsigned(fp, o[i]) & m[i] AS bits)))").alias("k"))
            .select("fp", "k.*"))
    many = keys.groupBy("i", "bits").agg(F.count("*").alias("n")).where("n > 1")
    pieces = F.array(*[_outside(F.col("fp"), o, w, radius + 1) for o, w in segs])
    # merge: Spark sizes these sides by the few bytes before the explode, or by Parquet files that repeat
    # their values, and would collect millions of rows to broadcast them
    keyed = keys.hint("merge").join(many, ["i", "bits"]).select(
        "fp", "i", "bits", F.explode(F.when(F.col("n") > hot, F.element_at(pieces, F.col("s") + 1))
                                     .otherwise(F.array(F.lit(-1).cast("long")))).alias("piece"))
    keyed = written(keyed, "variants")
    a, b = (keyed.select(F.col("fp").alias(x), "i", "bits", "piece") for x in ("u", "v"))
    x = F.col("u").bitwiseXOR(F.col("v"))
    first = F.coalesce(*[F.when(F.bit_count(d) <= 1, F.lit(o) + F.when(d == 0, 0).otherwise(F.bit_count(d - 1)))
                         for o, d in ((o, _bits(x, o, w)) for o, w in segs)])
    return (a.hint("merge").join(b, ["i", "bits", "piece"])
            .where((F.col("u") < F.col("v")) & (F.bit_count(x) <= radius) & (F.col("i") == first))
            .select("u", "v").distinct())


def _groups(fps: DataFrame, radius: int) -> DataFrame:
    """``(fp, root)``: fingerprints of one group have one root."""
    distinct = fps.select("fp").distinct()
    roots = connected_components(near_pairs(distinct, radius)).withColumnRenamed("node", "fp")
    return distinct.join(roots.hint("merge"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       shingle: int = 3, radius: int = 3) -> DataFrame:
    """Near-duplicate groups: ``(id, fp, component)`` for every row of ``docs``.

    Rows link when their fingerprints differ in at most ``radius`` bits;
    component is the smallest id reachable over links, a row's own included.

    Null or blank texts have fingerprint 0 and link like any other. Rows with
    a null id get the component of the others in their group, or null if
    there is none. Repeated rows stay, with equal results. Texts of any length
    are hashed whole. Other columns of ``docs`` play no part; an empty table
    gives an empty result.
    """
    fps = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    least = fps.groupBy("fp").agg(F.min("id").alias("least"))
    group = least.join(_groups(fps, radius), "fp")
    smallest = group.groupBy("root").agg(F.min("least").alias("component"))
    of = group.join(smallest, "root").select("fp", "component")
    return fps.join(of, "fp").select("id", "fp", "component")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      shingle: int = 3, radius: int = 3) -> DataFrame:
    """``docs`` without near-duplicates: of each group the row of smallest id stays.

    Of several rows of that id the one of smallest text hash stays, of equal rows
    one; null ids come after all others. Columns and their order stay.
    """
    fps = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    first = fps.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "content")).alias("least"))
    key = [unused(docs, "__k"), unused(docs, "__c")]
    stay = (first.join(_groups(fps, radius), "fp").groupBy("root").agg(F.min("least").alias("least"))
            .select(F.xxhash64("least.none", "least.id").alias(key[0]), F.col("least.content").alias(key[1])).distinct())
    number = F.col(id_col).cast("long")
    plain = docs.withColumns({key[0]: F.xxhash64(number.isNull(), number), key[1]: F.xxhash64(F.col(text_col).cast("string"))})
    return plain.join(stay, key).dropDuplicates(key).select(*docs.columns)


def hex_fingerprint(fp: Column) -> Column:
    """16 lowercase hex digits of a fingerprint's bits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
