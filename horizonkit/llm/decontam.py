"""Benchmark decontamination by pigeonhole pieces and bit-parallel edit distance.

A test item may occur with up to ``rate`` of its length (in characters) in edits. Cut into one
piece more than that, at least one piece stands unchanged where the item
occurs. One automaton finds the pieces of all items of a block, and around
each hit Myers' bit-parallel distance tells whether the item is there.
"""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from horizonkit.llm.common import added, as_bytes, slices

#: Bytes of test items sent to the executors at a time; larger sets go in more blocks.
BLOCK_BYTES = 4_000_000
#: Punctuation, signs and white space, of ASCII and of all of Unicode.
_ASCII_APART = bytes.maketrans(bytes(c for c in range(28, 127) if not chr(c).isalnum()),
                               b" " * sum(not chr(c).isalnum() for c in range(28, 127)))


@cache
def _apart() -> np.ndarray:
    """For each code point, what stands for it: itself, or a space."""
    codes = np.arange(sys.maxunicode + 1, dtype="<u4")
    apart = [c.isspace() or unicodedata.category(c)[0] in "PSZ" for c in map(chr, codes.tolist())]
    codes[apart] = ord(" ")
    return codes


def normal(text: bytes) -> bytes:
    """Composed characters, case folded; punctuation, signs and white space as single spaces."""
    if text.isascii():
        return b" ".join(text.lower().translate(_ASCII_APART).split())
    t = text.decode(errors="surrogateescape")  # what is no UTF-8 stays as it is
    t = unicodedata.normalize("NFC", unicodedata.normalize("NFC", t).casefold())
    codes = _apart()[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4")]
    return " ".join(codes.tobytes().decode("utf-32-le", "surrogatepass").split()).encode(errors="surrogateescape")


def letters(text: bytes) -> str:
    """The normal form as characters, in which lengths and distances count."""
    return normal(text).decode(errors="surrogateescape")


def budget_of(length: int, rate: float) -> int:
    return int(length * rate)


@dataclass(frozen=True)
class Item:
    item_id: int | None
    text: str  # normal form
    budget: int
    peq: dict[str, int]


def nearest(item: Item, text: str) -> tuple[int, int]:
    """Least edit distance of the item to any part of ``text``, and where the first such part ends.

    Myers' algorithm with the whole item in one integer: a step takes a few
    operations on integers of the item's length.
    """
    m = len(item.text)
    full, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score = full, 0, m
    best, end = m, 0
    get = item.peq.get
    for j, c in enumerate(text, 1):
        eq = get(c, 0)
        d = (((eq & vp) + vp) ^ vp) | eq | vn
        hp = vn | ~(d | vp)
        hn = vp & d
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp <<= 1
        vp = ((hn << 1) | ~(d | hp)) & full
        vn = hp & d & full
        if score < best:
            best, end = score, j
            if not best:
                break
    return best, end


class Matcher:
    """Finds a block of items in texts."""

    def __init__(self, items: list[tuple[int | None, bytes]], rate: float):
        self.items, pieces = [], {}
        for item_id, text in items:
            t = letters(text)
            if not t:
                continue  # an item without words occurs nowhere
            k = budget_of(len(t), rate)
            peq: dict[str, int] = {}
            for i, c in enumerate(t):
                peq[c] = peq.get(c, 0) | 1 << i
            cuts = [len(t) * i // (k + 1) for i in range(k + 2)]
            for a, z in zip(cuts, cuts[1:], strict=False):
                pieces.setdefault(t[a:z], []).append((len(self.items), a))
            self.items.append(Item(item_id, t, k, peq))
        self.automaton = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.automaton.add_word(piece, (len(piece), where))
        if pieces:
            self.automaton.make_automaton()

    def find(self, text: bytes) -> list[dict]:
        """Items that occur in the text: the least distance of each, and the end of its place in the normal form."""
        if not self.items:
            return []
        t = letters(text)
        windows: dict[int, list[tuple[int, int]]] = {}
        for last, (length, where) in self.automaton.iter(t):
            for n, a in where:
                item = self.items[n]
                start = last + 1 - length - a
                lo, hi = max(0, start - item.budget), start + len(item.text) + item.budget
                spans = windows.setdefault(n, [])
                if spans and spans[-1][0] <= lo <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], max(hi, spans[-1][1]))
                else:
                    spans.append((lo, hi))
        out = []
        for n, spans in windows.items():
            item = self.items[n]
            best = None
            for lo, hi in sorted(set(spans)):
                d, end = nearest(item, t[lo:hi])
                if d <= item.budget and (best is None or d < best[0]):
                    best = d, lo + end
                    if not d:
                        break
            if best:
                out.append({"item_id": item.item_id, "distance": best[0], "end": best[1]})
        return sorted(out, key=lambda x: (x["item_id"] is None, x["item_id"], x["distance"], x["end"]))


_LEAKS = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int64()), ("end", pa.int64())]))
_LEAKS_SQL = T.ArrayType(T.StructType([T.StructField(x, T.LongType()) for x in ("item_id", "distance", "end")]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text", rate: float = 0.08, block_bytes: int = BLOCK_BYTES,
               out: str = "leaks") -> DataFrame:
    """``docs`` with a column of the test items each text contains: ``(item_id, distance, end)``.

    Texts and items are compared in normal form (``normal``); an item counts
    where an edit distance of at most ``rate`` of its length is reached, and is reported
    with its least distance in the text.

    Null and blank texts contain nothing; null or blank items occur nowhere.
    Repeated items are reported each, by id; repeated rows get equal results. All columns of
    ``docs`` stay, in order. An empty table gives an empty result, an empty
    benchmark empty lists. Items beyond ``block_bytes`` go in blocks of about
    that size, so what is sent at once is bounded.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).cast("string").alias("t"))
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    plain, schema, old = added(docs, [T.StructField("leaks", _LEAKS_SQL)])
    at = list(old).index(text_col)
    found = plain.withColumn("leaks", F.array().cast(_LEAKS_SQL))
    for k in range(blocks):
        some = [(r["i"], (r["t"] or "").encode()) for r in
                items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).orderBy("i", "t").collect()]
        sent = docs.sparkSession.sparkContext.broadcast(some)

        def run(batches, sent=sent):
            matcher = Matcher(sent.value, rate)
            for b in slices(batches):
                leaks = [a + matcher.find(t) for a, t in zip(b.column(len(old)).to_pylist(), as_bytes(b.column(at)), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(leaks, _LEAKS)], b.schema.names)

        found = found.mapInArrow(run, schema)
    return found.toDF(*docs.columns, out)
