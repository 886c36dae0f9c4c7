"""Secret scan: three patterns, and a battery of randomness tests.

Tokens of key-like characters get their encoding inferred (the smallest usual alphabet that
holds them) and three tests of being uniformly random in it: chi-squared over
the alphabet, runs about its middle, serial correlation. Their weighted normal
scores make one p-value, which is uniform for a random token and near 0 for
most ordinary ones; letters tell names from keys far better than order does.

How far ordinary tokens reach up is learnt from the corpus: of all of each text's own
words names are made up as people make them (camel case, snake case, paths, with
numbers), for every length class, and run through the same battery; some names of
common words are always among them. A token's second p-value, that an ordinary
name of its encoding and length reaches so high, goes through Benjamini and
Hochberg's procedure over all tokens, so among the tokens reported the expected
share of ordinary names stays below ``fdr``.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from horizonkit.llm.common import added, as_bytes, slices

#: The base patterns, their least lengths and their order.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
HEX_RUN = re.compile(rb"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")

#: Tokens that are tested; what stands in for padding at the end is left out of the tests.
TOKEN = re.compile(rb"[A-Za-z0-9+/_-]{20,}")
#: Alphabets from the smallest. Letters stand by how common they are in texts, so that
#: neighbours, which share a cell of the chi-squared test, are common or rare together.
_DIGITS, _LOWER = b"0123456789", b"etaoinsrhldcumfpgwybvkxjqz"
_UPPER = _LOWER.upper()
ALPHABETS = (
    ("hex", _DIGITS + b"abcdef"), ("hex_upper", _DIGITS + b"ABCDEF"), ("base32", _UPPER + b"234567"),
    ("base36", _DIGITS + _LOWER), ("base36_upper", _DIGITS + _UPPER), ("base62", _DIGITS + _UPPER + _LOWER),
    ("base64", _UPPER + _LOWER + _DIGITS + b"+/"), ("base64url", _UPPER + _LOWER + _DIGITS + b"-_"),
)
#: Least lengths of the classes within which false discoveries are controlled.
LENGTHS = (20, 28, 40, 64, 128)
#: Weights of the chi-squared, runs and serial tests' normal scores.
WEIGHTS = (4, 1, 1)
_NORMAL = NormalDist()
#: Steps of the p-values' histogram.
STEPS = 50
_NAME_WORD = re.compile(rb"[A-Za-z]{2,}")
#: Common words of programs and files, and how many texts are made of them.
COMMON = (b"account address array base build byte cache call change check class client code config content context count create data date "
          b"default delete device document enable error event field file filter first format group handler header image index info init input "
          b"item key last length level link list load local log main manager map max message method min mode model module name network new node "
          b"number object option order output page param parent path point port process query queue read record report request reset response "
          b"result return root row save schema search send server service session set size source start state status string system table target "
          b"task test text thread time token type update upload user util value version view window world write").split()
COMMON_TEXTS = 2400
#: Made-up names that go through the battery together.
NAMES_AT_ONCE = 2048


def _codes(alphabet: bytes) -> np.ndarray:
    table = np.full(256, -1, np.int16)
    table[np.frombuffer(alphabet, np.uint8)] = np.arange(len(alphabet))
    return table


_TABLES = [(name, len(a), _codes(a)) for name, a in ALPHABETS]
_NUMBER = {name: i for i, (name, _) in enumerate(ALPHABETS)}


def infer(token: bytes) -> tuple[str, int, np.ndarray] | None:
    """Encoding, alphabet size and symbol numbers; None without two of digits, capitals, small letters."""
    if token.isdigit() or (token.isalpha() and (token.islower() or token.isupper() or token[1:].islower())):
        return None
    if not any(48 <= c <= 57 for c in token) and (token.islower() or token.isupper()):
        return None
    raw = np.frombuffer(token, np.uint8)
    for name, size, table in _TABLES:
        codes = table[raw]
        if codes.min() >= 0:
            return name, size, codes.astype(np.float64)
    return None


def chi_squared_p(codes: np.ndarray, size: int) -> float:
    """Uniformity over the alphabet, in as many even cells as leave three expected each."""
    n = len(codes)
    cells = int(max(2, min(size, n // 3)))
    cell = (codes * cells // size).astype(np.int64)
    expected = np.bincount(np.arange(size) * cells // size, minlength=cells) * (n / size)
    x = float((((np.bincount(cell, minlength=cells) - expected) ** 2) / expected).sum())
    df = cells - 1
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))  # Wilson and Hilferty
    return 0.5 * math.erfc(z / math.sqrt(2))


def runs_p(codes: np.ndarray, size: int) -> float:
    """Number of runs below and above the alphabet's middle, two-sided."""
    high = codes * 2 >= size
    n1 = int(high.sum())
    n2 = len(codes) - n1
    if not n1 or not n2:
        return 0.5 ** (len(codes) - 1)
    n = n1 + n2
    mean = 2 * n1 * n2 / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    return math.erfc(abs(1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(2 * var)) if var > 0 else 1.0


def serial_p(codes: np.ndarray) -> float:
    """Correlation of a symbol with the next one, two-sided."""
    c = codes - codes.mean()
    total = float((c * c).sum())
    if total == 0:
        return 0.0
    n = len(codes)
    r = float((c[1:] * c[:-1]).sum()) / total
    return math.erfc(abs(r + 1 / n) * math.sqrt(n / 2))


def randomness_p(token: bytes) -> tuple[int, float] | None:
    """The encoding's number and the battery's combined p-value; None where no encoding fits."""
    if (found := infer(token)) is None:
        return None
    name, size, codes = found
    ps = (chi_squared_p(codes, size), runs_p(codes, size), serial_p(codes))
    z = sum(w * _NORMAL.inv_cdf(min(max(p, 1e-15), 1 - 1e-15)) for w, p in zip(WEIGHTS, ps, strict=True))
    return _NUMBER[name], _NORMAL.cdf(z / math.sqrt(sum(w * w for w in WEIGHTS)))


#: For each byte a bit for each alphabet that holds it, and bits for digits, small letters, capitals and all others.
_HELD = sum(((table >= 0).astype(np.uint8) << i for i, (_, _, table) in enumerate(_TABLES)), np.zeros(256, np.uint8))
_SORT = np.array([1 if 48 <= c <= 57 else 2 if 97 <= c <= 122 else 4 if 65 <= c <= 90 else 8 for c in range(256)], np.uint8)
_SIZES = np.array([size for _, size, _ in _TABLES])
_CODES = np.array([table for _, _, table in _TABLES])
#: Symbols in each cell of the chi-squared test, by alphabet and number of cells.
_IN_CELL = np.zeros((len(_TABLES), _SIZES.max() + 1, _SIZES.max()))
for _e, _size in enumerate(_SIZES.tolist()):
    for _cells in range(2, _size + 1):
        _IN_CELL[_e, _cells, :_cells] = np.bincount(np.arange(_size) * _cells // _size, minlength=_cells)


def randomness_ps(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``randomness_p`` of many tokens at once: numbers of the encodings (-1: none fits) and combined p-values."""
    encoding, p = np.full(len(tokens), -1), np.zeros(len(tokens))
    if not tokens:
        return encoding, p
    n = np.array([len(t) for t in tokens])
    raw, at = np.frombuffer(b"".join(tokens), np.uint8), np.concatenate(([0], np.cumsum(n)[:-1]))
    sorts, held = np.bitwise_or.reduceat(_SORT[raw], at), np.bitwise_and.reduceat(_HELD[raw], at)
    one_case = ((sorts & 6) == 2) | ((sorts & 6) == 4)
    capitals = np.add.reduceat((_SORT[raw] == 4).astype(np.int64), at)
    name_like = ((sorts & 9) == 0) & (one_case | ((capitals == 1) & (_SORT[raw[at]] == 4)))
    good = (held > 0) & (sorts != 1) & ~name_like & ~(((sorts & 1) == 0) & one_case)
    if not good.any():
        return encoding, p
    raw, n = raw[np.repeat(good, n)], n[good]
    own, e = np.repeat(np.arange(len(n)), n), np.log2(held[good] & -held[good].astype(np.int64)).astype(np.int64)
    at, size = np.concatenate(([0], np.cumsum(n)[:-1])), _SIZES[e]
    codes = _CODES[e[own], raw].astype(np.int64)
    erfc = lambda x: np.array([math.erfc(v) for v in x.tolist()])

    cells = np.maximum(2, np.minimum(size, n // 3))
    first = np.concatenate(([0], np.cumsum(cells)[:-1]))
    of = np.repeat(np.arange(len(n)), cells)
    expected = _IN_CELL[e[of], cells[of], np.arange(len(of)) - first[of]] * (n / size)[of]
    count = np.bincount(first[own] + codes * cells[own] // size[own], minlength=len(of))
    x, df = np.add.reduceat((count - expected) ** 2 / expected, first), cells - 1
    chi = 0.5 * erfc(((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / np.sqrt(2 / (9 * df)) / math.sqrt(2))

    inside = (own[1:] == own[:-1])
    high = codes * 2 >= size[own]
    n1 = np.bincount(own[high], minlength=len(n))
    n2 = n - n1
    turns = np.bincount(own[1:][inside & (high[1:] != high[:-1])], minlength=len(n))
    mean = 2 * n1 * n2 / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    runs = np.where(var > 0, erfc(np.abs(1 + turns - mean) / np.sqrt(2 * np.where(var > 0, var, 1.0))), 1.0)
    runs = np.where((n1 == 0) | (n2 == 0), 0.5 ** (n - 1.0), runs)

    c = codes - (np.add.reduceat(codes, at) / n)[own]
    total = np.add.reduceat(c * c, at)
    follow = np.bincount(own[1:][inside], (c[1:] * c[:-1])[inside], len(n))
    serial = np.where(total > 0, erfc(np.abs(follow / np.where(total > 0, total, 1.0) + 1 / n) * np.sqrt(n / 2)), 0.0)

    z = sum(w * np.array([_NORMAL.inv_cdf(v) for v in np.clip(q, 1e-15, 1 - 1e-15).tolist()])
            for w, q in zip(WEIGHTS, (chi, runs, serial), strict=True)) / math.sqrt(sum(w * w for w in WEIGHTS))
    encoding[good], p[good] = e, 0.5 * erfc(-z / math.sqrt(2))
    return encoding, p


def length_class(n: int) -> int:
    return sum(n >= x for x in LENGTHS) - 1


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(kind, start, end) in bytes: leftmost non-overlapping matches of each kind that are long enough."""
    out = [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    out += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(2, m.start(), m.end()) for m in HEX_RUN.finditer(text)]  # a run of HEX is as long as it can be
    return out


def tested(text: bytes, base: list[tuple[int, int, int]]) -> list[tuple[int, int, tuple[int, float]]]:
    """(start, end, encoding and p) of tokens that no base span touches and that have an encoding."""
    out, spans, at, reach = [], sorted((s, e) for _, s, e in base), 0, -1
    for m in TOKEN.finditer(text):
        a, z = m.span()
        while at < len(spans) and spans[at][0] < z:  # of the spans that start before z, how far the furthest reaches
            reach = max(reach, spans[at][1])
            at += 1
        if reach <= a and (p := randomness_p(m.group())) is not None:
            out.append((a, z, p))
    return out


def made_up_names(text: bytes, classes: range = range(len(LENGTHS))) -> list[bytes]:
    """Names of all of a text's own words, one after the other, in styles that its checksum picks.

    The text's distinct words are dealt to names in their order: a name takes as many as its length asks for, the
    lengths go round the ``classes``, and the last name of each class closes with words from the start. Words of tokens
    that are long enough to be tested are left out, and a name has no word twice; a text of too few words makes no
    name of that length.
    """
    words = list(dict.fromkeys(_NAME_WORD.findall(TOKEN.sub(b" ", text).lower())))
    seed = zlib.crc32(text)
    out, first, n = [], 0, 0
    while first < len(words) or n < len(classes):
        least = LENGTHS[classes[n % len(classes)]]
        pick = zlib.crc32(b"%d" % n, seed)
        style = pick % 8
        until = least + pick // 64 % 8 + (2 <= style != 4)  # the last word has no separator behind it
        parts, size = [], 0
        while size < until and len(parts) < len(words):
            word = words[(first + len(parts)) % len(words)]
            if style in (3, 4, 5, 7) and len(parts) % 4 == 3:
                word += str(pick // 512 % 100).encode()  # numbers inside or at the end
            parts.append(word.capitalize() if style in (0, 4, 6) or (style == 1 and parts) else word.upper() if style == 5 else word)
            size += len(word) + (2 <= style != 4)
        first, n = first + len(parts), n + 1
        name = (b"", b"", b"_", b"-", b"", b"_", b"/", b"/")[style].join(parts)
        if style < 4 and pick // 1024 % 2:
            name += str(pick // 2048 % 100).encode()
        if len(name) >= least:
            out.append(name)
    return out


def common_names() -> list[bytes]:
    """Names of common words, always the same."""
    out = []
    for i in range(COMMON_TEXTS):
        order = sorted(COMMON, key=lambda w: zlib.crc32(w, i))
        out += made_up_names(b" ".join(order), range(len(LENGTHS)))
    return out


@dataclass(frozen=True)
class Bounds:
    """Least p-value of a secret, by encoding and length class (over 1: none qualifies)."""

    by_class: tuple[tuple[float, ...], ...]

    def holds(self, size: int, found: tuple[int, float]) -> bool:
        return found[1] >= self.by_class[found[0]][length_class(size)]


def bounds_of(tokens: np.ndarray, names: np.ndarray, fdr: float) -> Bounds:
    """Bounds from counts ``(encoding, length class, step of p)`` of the tokens and of made-up names.

    A token's second p-value is the share of names of its class that reach its step, taken as if one more
    did; a class without names goes by all names of its length. Over the tokens of all classes, the largest second p-value is
    taken at which n tokens times it are at most ``fdr`` of the tokens up to it.
    """
    above = lambda counts: counts[..., ::-1].cumsum(-1)[..., ::-1]
    known = above(names)
    known = np.where(known[..., :1] > 0, known, above(names.sum(0))[None])
    second = np.where(known[..., :1] > 0, (known + 1) / (known[..., :1] + 1), 2.0)
    level, place = np.unique(second, return_inverse=True)
    reached = np.bincount(place.ravel(), tokens.ravel(), len(level)).cumsum()
    fit = np.flatnonzero((reached > 0) & (tokens.sum() * level <= fdr * reached))
    if not len(fit):
        return Bounds(((2.0,) * tokens.shape[1],) * tokens.shape[0])
    good = second <= level[fit[-1]]
    return Bounds(tuple(map(tuple, np.where(good.any(-1), good.argmax(-1) / STEPS, 2.0).tolist())))


def name_counts(names: list[bytes]) -> np.ndarray:
    """How many of the names have each encoding, length class and step of p."""
    e, p = randomness_ps(names)
    size = np.searchsorted(LENGTHS, [len(x) for x in names], "right") - 1
    cell = ((e * len(LENGTHS) + size) * STEPS + np.minimum(STEPS - 1, (p * STEPS).astype(np.int64)))[e >= 0]
    shape = (len(ALPHABETS), len(LENGTHS), STEPS)
    return np.bincount(cell, minlength=math.prod(shape)).reshape(shape)


def fit_bounds(docs: DataFrame, text_col: str = "text", fdr: float = 0.05) -> Bounds:
    """One pass over all texts; a task sends two small histograms, so what is gathered does not grow with them."""
    shape = (2, len(ALPHABETS), len(LENGTHS), STEPS)

    def run(batches):
        counts, names = np.zeros(shape, np.int64), []
        for b in slices(batches):
            for text in as_bytes(b.column(0)):
                for a, z, (e, p) in tested(text, base_spans(text)):
                    counts[0, e, length_class(z - a), min(STEPS - 1, int(p * STEPS))] += 1
                names += made_up_names(text)
                if len(names) >= NAMES_AT_ONCE:
                    counts[1] += name_counts(names)
                    names = []
        counts[1] += name_counts(names)
        at = np.flatnonzero(counts)
        if len(at):
            yield pa.RecordBatch.from_pydict({"at": at, "n": counts.ravel()[at]})

    counts = np.zeros(shape, np.int64)
    part = docs.select(F.col(text_col).cast("string").alias("text"))
    for r in part.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # a row a cell at most
        counts.ravel()[r["at"]] = r["n"]
    counts[1] += name_counts(common_names())
    return bounds_of(counts[0], counts[1], fdr)


def spans_of(text: bytes, bounds: Bounds) -> list[tuple[int, int, int]]:
    """All spans in bytes, by start and then kind."""
    base = base_spans(text)
    more = [(3, a, z) for a, z, found in tested(text, base) if bounds.holds(z - a, found)]
    return sorted(base + more, key=lambda s: (s[1], s[0]))


def in_code_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if not spans or text.isascii():
        return spans
    at = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    return [(k, int(at[a]), int(at[z])) for k, a, z in spans]


def redacted(text: bytes, spans: list[tuple[int, int, int]], mask: bytes) -> bytes:
    """The text with every maximal stretch of spans replaced by ``mask``."""
    out, at = [], 0
    for _, a, z in spans:
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, z)
    return b"".join([*out, text[at:]]) if spans else text


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_SPANS_SQL = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                                       T.StructField("end", T.LongType())]))


def find_secrets(docs: DataFrame, text_col: str = "text", fdr: float = 0.05, out: str = "secret_spans") -> DataFrame:
    """``docs`` with a column of spans ``(kind, start, end)``, in code points, end exclusive.

    Base spans always stay; ``random`` ones are added where no base span is. Null
    texts count as empty and have an empty list. Repeated rows get the same
    spans. All columns of ``docs`` stay, in order (a column named like ``out`` too). An
    empty table gives an empty result.
    """
    bounds = fit_bounds(docs, text_col, fdr)
    plain, schema, old = added(docs, [T.StructField("spans", _SPANS_SQL)])
    at = list(old).index(text_col)

    def run(batches):
        for b in slices(batches):
            found = []
            for text in as_bytes(b.column(at)):
                found.append([{"kind": KINDS[k], "start": a, "end": z} for k, a, z in in_code_points(text, spans_of(text, bounds))])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, _SPANS)], [*b.schema.names, "spans"])

    return plain.mapInArrow(run, schema).toDF(*docs.columns, out)


def redact_secrets(docs: DataFrame, text_col: str = "text", fdr: float = 0.05, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret's span replaced by ``mask``; texts without one, and nulls, stay as they are."""
    bounds = fit_bounds(docs, text_col, fdr)
    plain, schema, old = added(docs, [])
    at = list(old).index(text_col)

    def run(batches):
        for b in slices(batches):
            col = b.column(at)
            texts = [redacted(t, spans_of(t, bounds), mask.encode()).decode() if ok else None
                     for t, ok in zip(as_bytes(col), col.is_valid().to_pylist(), strict=True)]
            columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    return plain.mapInArrow(run, schema).toDF(*docs.columns)


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
