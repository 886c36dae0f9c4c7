"""Reproducible shuffle into shards by a Feistel permutation of row numbers.

Rows get global numbers in id order, the numbers are permuted by a Feistel
network with cycle walking, and the permuted number names both the shard and
the slot. Everything is DataFrame functions; nothing depends on how Spark
split the input.
"""

from __future__ import annotations

import hashlib
from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from horizonkit.session import written

ROUNDS = 6


def halves(n: int) -> tuple[int, int]:
    """a * b >= n with a and b near the square root: the network's two halves."""
    a = max(1, isqrt(n) + (isqrt(n) ** 2 < n))
    return a, max(1, -(-n // a))


def _round_value(seed: int, i: int, half: int) -> int:
    return int(hashlib.md5(f"{seed}-{i}-{half}".encode()).hexdigest()[:12], 16)


def permuted(x: int, n: int, seed: int) -> int:
    """One pass of the network over 0 .. a * b - 1 (may leave 0 .. n - 1)."""
    a, b = halves(n)
    left, right = divmod(x, b)
    for i in range(ROUNDS):
        if i % 2:
            right = (right + _round_value(seed, i, left)) % b
        else:
            left = (left + _round_value(seed, i, right)) % a
    return left * b + right


def longest_walk(n: int, seed: int) -> int:
    """Passes after which every number below n has come back below n, exactly.

    Only the fewer than a = ceil(sqrt(n)) numbers from n to a * b - 1 make a
    walk longer, so walking those alone gives the bound.
    """
    a, b = halves(n)
    steps: dict[int, int] = {}

    def passes(x: int) -> int:
        chain = []
        while x >= n and x not in steps:
            chain.append(x)
            x = permuted(x, n, seed)
        k = 0 if x < n else steps[x]
        for x in reversed(chain):
            steps[x] = k = k + 1
        return k

    return 1 + max((passes(x) for x in range(n, a * b)), default=0)


def _pass(x: Column, n: int, seed: int) -> Column:
    """The same pass as ``permuted``, as a column expression."""
    a, b = halves(n)

    def value(i: Column, half: Column) -> Column:
        text = F.concat_ws("-", F.lit(str(seed)), i.cast("string"), half.cast("string"))
        return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")

    def step(s: Column, i: Column) -> Column:
        even = F.struct(((s["l"] + value(i, s["r"])) % F.lit(a)).alias("l"), s["r"].alias("r"))
        odd = F.struct(s["l"].alias("l"), ((s["r"] + value(i, s["l"])) % F.lit(b)).alias("r"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    start = F.struct(F.floor(x / F.lit(b)).cast("long").alias("l"), (x % F.lit(b)).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["l"] * F.lit(b) + s["r"])


def permute_column(x: Column, n: int, seed: int) -> Column:
    """Row number below ``n`` -> its place below ``n``: cycle walking until it is below n again."""
    walks = longest_walk(n, seed)
    first = _pass(x, n, seed)
    if walks == 1:
        return first
    return F.aggregate(F.sequence(F.lit(2), F.lit(walks)), first,
                       lambda y, _: F.when(y < F.lit(n), y).otherwise(_pass(y, n, seed)))


def numbered(rows: DataFrame, order: list[str], out: str = "row") -> tuple[DataFrame, int]:
    """Global row numbers from 0 in ``order``, and how many rows there are.

    Rows are sorted into ranges, written with their range and place, and a
    range's first number is the count of the ranges before it; ``order`` is
    ended by a tie-breaker so that equal rows spread over ranges.
    """
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tied = rows.withColumn("__tie", F.monotonically_increasing_id())
    ranged = tied.repartitionByRange(n, *order, "__tie").sortWithinPartitions(*order, "__tie").drop("__tie")
    # the id holds the partition in its upper bits and the place in the lower 33
    placed = written(ranged.withColumn("__at", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("__at", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n")).collect()  # a row per range
    base, total = {}, 0
    for r in sorted(sizes, key=lambda r: r["__part"]):
        base[r["__part"]] = total
        total += r["__n"]
    table = F.array(*[F.lit(base.get(i, 0)).cast("long") for i in range(n)])
    place = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn(out, F.element_at(table, part.cast("int") + 1) + place).drop("__at"), total


def shard_rows(docs: DataFrame, shards: int = 16, seed: int = 7, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """Deal rows to shards so that counts differ by one at most (law ``rows``).

    Per row: ``id, size`` (UTF-8 bytes + 1), ``text_crc32, law, shard, slot``,
    ``row`` (its number in id order), ``grown_shard`` (null: this law moves rows
    when shards are added). Slots of a shard run from 0 without gaps.

    A null text counts as empty; null ids come first. Equal ids are ordered by
    size and checksum, and rows equal in all three are interchangeable. Equal
    texts are not kept together: the law deals rows one by one. Other columns play no
    part; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))
    rows, n = numbered(rows, ["id", "size", "text_crc32"])
    place = permute_column(F.col("row"), n, seed) if n else F.col("row")
    return (rows.withColumn("__to", place)
            .select("id", "size", "text_crc32", F.lit("rows").alias("law"),
                    (F.col("__to") % shards).cast("int").alias("shard"),
                    F.floor(F.col("__to") / F.lit(shards)).cast("long").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard"), "row"))
