"""Spelling variants: words one edit apart, found by blocked Gram matrices.

Words are vectors of letter counts. One inserted or deleted letter puts two
words at squared distance 1, a replaced one at 2, so the product of a block's
count matrix with its transpose names all candidates of the block at once;
those at most two apart are verified letter by letter. A block holds words of
two adjacent lengths that agree in a half: an edit leaves the other half of the
shorter word whole. Blocks of very many words are cut once more by the counts
of a third of the letters (two letters at most differ, so one third agrees),
and what is still large is dealt to pairs of tiles.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from horizonkit.llm.common import as_bytes, slices
from horizonkit.session import written

#: Code points of a word at least, and its occurrences at least.
LENGTH, OCCURRENCES = 6, 5
#: A form occurs at least so many times as often as the word it stands for.
RATIO = 5
#: One run in so many loses a letter.
SLIP = 199
#: Different words that a task counts before it hands them on.
HELD = 1 << 17
#: Rows of one matrix product; words of a block beyond which it is cut further.
TILE, HOT = 512, 4096
#: Letters of a tile's words together; words beyond ``PADDED`` letters are compared one by one.
TILE_LETTERS, PADDED = 1 << 22, 256
#: Places of the letters a-z and U+00C0 to U+00FF in a count vector.
_PLACE = np.zeros(256, np.int64)
_PLACE[ord("a"):ord("z") + 1] = np.arange(26)
_PLACE[0xC0:] = np.arange(26, 90)
LETTERS = 90


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                slip: int = SLIP) -> DataFrame:
    """``(word, n)``: words of at least ``length`` letters of all texts and how often they occur.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF with A-Z in small
    letters. A run whose checksum, with its document's id, ``slip`` divides loses one letter.
    """
    runs = re.compile(f"[a-zÀ-ÿ]{{{length},}}")

    def of(text: bytes, start: int):
        for run, n in Counter(runs.findall(text.lower().decode(errors="replace"))).items():  # bytes: A-Z only
            h = zlib.crc32(run.encode(), start)
            if h % slip == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
                if len(run) < length:
                    continue
            yield run, n

    def taken(held: dict[str, int]) -> pa.RecordBatch:
        out = pa.RecordBatch.from_pydict({"word": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})
        held.clear()
        return out

    def run(batches):
        held: Counter[str] = Counter()
        for b in slices(batches):
            for doc, text in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
                for word, n in of(text, zlib.crc32(f"{'' if doc is None else doc}:".encode())):
                    held[word] += n
                    if len(held) >= HELD:
                        yield taken(held)
        yield taken(held)

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def blocks(words: DataFrame) -> DataFrame:
    """Each word once for each block: ``len`` (of the block's short words), ``half``, ``piece``, and whether it is a long word there."""
    size = F.char_length("word")

    def places(short, is_long: bool):
        head = F.floor(short / 2).cast("int")
        return [F.struct(short.alias("len"), F.lit(half).alias("half"), piece.alias("piece"), F.lit(is_long).alias("long"))
                for half, piece in ((0, F.substring("word", F.lit(1), head)), (1, F.right("word", short - head)))]

    return words.select("word", "n", F.explode(F.array(*places(size, False), *places(size - 1, True))).alias("b")).select("word", "n", "b.*")


def _third(word, g: int):
    """The letters of the g-th third of the alphabet that a word holds, in order."""
    kept = [chr(c) for c in (*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)) if _PLACE[c] % 3 == g]
    return F.array_join(F.array_sort(F.split(F.regexp_replace(word, f"[^{''.join(kept)}]", ""), "")), "")


def dealt(words: DataFrame, hot: int = HOT) -> DataFrame:
    """``blocks`` with ``cut`` (-1, or the third of the alphabet whose letters ``same`` holds) and the pair of tiles ``a <= b``.

    A block of at most ``hot`` words has one tile. A larger one is cut by
    thirds; a part that is still larger has as many tiles as it needs, and its
    words go to every pair that holds their own tile ``tile``.
    """
    all_of = blocks(words)
    key = ["len", "half", "piece"]
    large = all_of.groupBy(*key).agg(F.count("*").alias("m")).where(F.col("m") > hot).select(*key)
    large = written(large, "large_blocks")
    whole = F.struct(F.lit(-1).alias("cut"), F.lit("").alias("same"))
    one = (all_of.join(large, key, "left_anti").select("*", whole.alias("c")).select(*all_of.columns, "c.*")
           .withColumns({"tile": F.lit(0), "a": F.lit(0), "b": F.lit(0)}))
    thirds = F.array(*[F.struct(F.lit(g).alias("cut"), _third(F.col("word"), g).alias("same")) for g in range(3)])
    parts = written(all_of.join(large, key, "left_semi").select("*", F.explode(thirds).alias("c")).select(*all_of.columns, "c.*"), "cut_blocks")
    key = [*key, "cut", "same"]
    tiles = parts.groupBy(*key).agg(F.ceil(F.count("*") / F.lit(hot)).cast("int").alias("tiles"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    many = (parts.join(tiles, key).withColumn("tile", F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int"))
            .withColumn("other", other).withColumns({"a": F.least("tile", "other"), "b": F.greatest("tile", "other")})
            .drop("tiles", "other"))
    return one.unionByName(many)


def letter_counts(words: list[str]) -> np.ndarray:
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    letters = _PLACE[np.frombuffer("".join(words).encode("latin-1"), np.uint8)]
    rows = np.repeat(np.arange(len(words)), sizes)
    return np.bincount(rows * LETTERS + letters, minlength=len(words) * LETTERS).reshape(len(words), LETTERS)


def one_edit(a: str, b: str) -> bool:
    """Whether ``b``, as long as ``a`` or one letter longer, is one edit away."""
    same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a != b and a[same + (len(a) == len(b)):] == b[same + 1:]


def _edits(words: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``one_edit`` of the pairs (i, j) of ``words``; a pair's second word is as long as its first or one letter longer."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    width = int(sizes.max(initial=0))
    if width > PADDED:
        return np.array([one_edit(words[a], words[b]) for a, b in zip(i.tolist(), j.tolist(), strict=True)], bool)
    letters = np.zeros((len(words), width + 1), np.uint8)
    letters[np.arange(width + 1) < sizes[:, None]] = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    out = np.empty(len(i), bool)
    for at in range(0, len(i), 1 << 14):
        a, b = letters[i[at:at + (1 << 14)]], letters[j[at:at + (1 << 14)]]
        grown = sizes[i[at:at + (1 << 14)]] < sizes[j[at:at + (1 << 14)]]
        differ = a != b
        first = differ.argmax(1)  # the two words of a pair are never equal
        after = np.arange(width) >= first[:, None]
        moved = ((a[:, :-1] != b[:, 1:]) & after).any(1)
        out[at:at + (1 << 14)] = np.where(grown, ~moved, differ.sum(1) == 1)
    return out


class _Tile:
    """Rows of whole groups, compared by one product when there are enough of them."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.words, self.n, self.group, self.long, self.tile, self.key, self.keys = [], [], [], [], [], None, []

    def add(self, key: tuple, word: str, n: int, is_long: bool, tile: int) -> None:
        if key != self.key:
            self.key = key
            self.keys.append(key)
        self.words.append(word)
        self.n.append(n)
        self.group.append(len(self.keys) - 1)
        self.long.append(is_long)
        self.tile.append(tile)

    def full(self, key: tuple) -> bool:
        return key != self.key and (len(self.words) >= TILE or len(self.words) * (key[0] + 1) > TILE_LETTERS)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words one edit apart, the short one first, each pair once."""
        counts = letter_counts(self.words).astype(np.float64)
        squares = (counts * counts).sum(1)
        group, is_long, tile = np.array(self.group), np.array(self.long), np.array(self.tile)
        length, half, _, cut, _, a, b = (np.array(x, object) for x in zip(*self.keys, strict=True))
        apart = (a != b)[group].astype(bool)
        ends = np.searchsorted(group, group, "right")
        found = []
        for at in range(0, len(group), TILE):
            rows = np.arange(at, min(at + TILE, len(group)))
            until = ends[rows[-1]]
            first = np.searchsorted(group, group[at], "left")
            cols = np.arange(first, until)
            near = squares[rows, None] + squares[cols] - 2 * (counts[rows] @ counts[cols].T) <= 2
            near &= (group[rows, None] == group[cols]) & ~is_long[rows, None]
            # short words meet each other once, and every long word of the group
            near &= is_long[cols] | (rows[:, None] < cols)
            near &= ~apart[rows, None] | (tile[rows, None] != tile[cols])
            i, j = np.nonzero(near)
            found.append((rows[i], cols[j]))
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        keep = _edits(self.words, i, j)
        i, j = i[keep], j[keep]
        # a pair counts in one block: the first half if both agree, the first third that agrees
        once = np.ones(len(i), bool)
        for k in np.flatnonzero(half[group[i]].astype(bool) & is_long[j]).tolist():
            head = length[group[i[k]]] // 2
            once[k] = self.words[i[k]][:head] != self.words[j[k]][:head]
        for k in np.flatnonzero(cut[group[i]].astype(int) > 0).tolist():
            g = cut[group[i[k]]]
            differ = np.flatnonzero(counts[i[k]] != counts[j[k]]) % 3
            once[k] &= all((differ == lower).any() for lower in range(g))
        return i[once], j[once]

    def rows(self) -> pa.RecordBatch:
        """For each word with near ones: how many, and the one of largest ``n``, the smallest of those."""
        i, j = self.pairs()
        i, j = np.concatenate((i, j)), np.concatenate((j, i))
        n = np.array(self.n)
        place = np.empty(len(n), np.int64)
        place[sorted(range(len(n)), key=self.words.__getitem__)] = np.arange(len(n))
        order = np.lexsort((place[j], -n[j], i))
        i, j = i[order], j[order]
        head = np.flatnonzero(np.diff(i, prepend=-1))
        many = np.diff(np.append(head, len(i)))
        return pa.RecordBatch.from_pydict({
            "word": pa.array([self.words[k] for k in i[head]], pa.string()), "n_near": pa.array(many, pa.int64()),
            "best_n": pa.array(n[j[head]], pa.int64()), "best": pa.array([self.words[k] for k in j[head]], pa.string())})


def near_words(words: DataFrame, hot: int = HOT) -> DataFrame:
    """Distinct ``(word, n)`` -> ``(word, n_near, best_n, best)`` of the words that have near ones.

    ``best`` is the near word of largest n, of those the smallest in code-point order.
    """
    key = ["len", "half", "piece", "cut", "same", "a", "b"]
    rows = dealt(words, hot).select(*key, "word", "n", "long", "tile")
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        tile = _Tile()
        for b in slices(batches, 4096):
            cols = [c.to_pylist() for c in b.columns]
            for *k, word, n, is_long, own in zip(*cols, strict=True):
                k = tuple(k)
                if tile.words and tile.full(k):
                    yield tile.rows()
                    tile.clear()
                tile.add(k, word, n, is_long, own)
        if tile.words:
            yield tile.rows()

    found = (rows.repartition(parts, *key).sortWithinPartitions(*key)
             .mapInArrow(run, "word string, n_near long, best_n long, best string"))
    least = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("best"))).alias("least")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), least).select(
        "word", "n_near", (-F.col("least.n")).alias("best_n"), F.col("least.best").alias("best"))


def roots(forms: DataFrame, steps: int) -> DataFrame:
    """``(word, form)`` -> ``(word, root)``: forms followed to the last, chains of at most ``steps``; each round doubles the reach."""
    reach = 1
    while reach < steps:
        ends = forms.select(F.col("word").alias("form"), F.col("form").alias("next"))
        forms = written(forms.join(ends, "form", "left").select("word", F.coalesce("next", "form").alias("form")), "forms")
        reach *= 2
    return forms.withColumnRenamed("form", "root")


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                    occurrences: int = OCCURRENCES, ratio: int = RATIO, slip: int = SLIP, hot: int = HOT) -> DataFrame:
    """Words of ``docs`` and the more frequent spelling one edit away, if any.

    Columns ``word, n`` (occurrences), ``n_near`` (near words), ``form`` (the near
    word of largest n, if that is at least ``ratio`` times n), ``form_n, root`` (the
    last form of forms, or the word).

    Null and empty texts have no words; a null id counts as an empty one in the
    checksums. Repeated rows count each. Words and texts of any length are
    taken whole. Of forms of equal n the smallest in code-point order counts.
    Other columns play no part, whatever their names; a table without such
    words gives an empty result.
    """
    if ratio < 2:
        raise ValueError("ratio: 2 at least, so that forms grow rarer along a chain")
    words = written(word_counts(docs, id_col, text_col, length, slip).where(F.col("n") >= occurrences), "words")
    near = near_words(words, hot)
    fits = F.col("best_n") >= F.lit(ratio) * F.col("n")
    table = written(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(fits, F.col("best")).alias("form"), F.when(fits, F.col("best_n")).alias("form_n")), "forms")
    most = table.agg(F.max("n")).first()[0] or 0  # one number
    steps, n = 0, occurrences
    while n * ratio <= most:  # n grows by the ratio with every form
        steps, n = steps + 1, n * ratio
    found = roots(table.where("form is not null").select("word", "form"), steps)
    return table.join(found, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
