"""Exact dedup by recipes, spelling variants, centroid clustering: brute force and edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pytest
from pyspark.sql import functions as F

from horizonkit.llm import centroids, recipes, spelling

DOCS = "doc_id long, text string, id string, row string, part string, kept string, name string, n string, Word string"
LOWER = str.maketrans(ascii_uppercase, ascii_lowercase)
LONG = "".join(random.Random(1).choices("abcdefghij klmnop\n", k=400_000))


def docs(spark, rows, parts=3):
    """(doc_id, text) rows among columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, *"abcdefg") for i, t in rows], DOCS).repartition(parts)


# ---------------------------------------------------------------- exact dedup
ROWS = [(1, "Hello World"), (2, "hello world"), (3, "hello  world"), (4, "É"), (5, "é"), (6, None), (7, ""), (8, LONG), (9, LONG.upper()),
        (10, LONG + "x"), (11, LONG[:1000] + "!" + LONG[1000:]), (12, "hello world"), (12, "HELLO world"), (None, "hello world"), (None, "alone"),
        (13, "İstanbul ΑΣ"), (14, "İSTANBUL ΑΣ"), (15, "😀" * 3000), (16, "😀" * 3000), (17, "a" * 9000), (18, "a" * 9001)]


def check_groups(got, rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    assert len(got) == len(rows)
    want = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter((r["id"], r["keep_id"], r["group_size"], r["sha256"]) for r in got) == want
    kept = Counter(r["sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r["id"] == r["keep_id"] for r in got if r["kept"])


@pytest.mark.parametrize("name", ["plain", "weak"])
def test_equal_texts(spark, name):
    """With a hash of 5 values too: names that many chunks share are told apart by their texts."""
    by = F.xxhash64 if name == "plain" else lambda c: F.pmod(F.xxhash64(c), F.lit(5))
    got = recipes.equal_texts(docs(spark, ROWS), name=by).collect()
    check_groups(got, ROWS)
    assert any(r["ranks"] for r in got) == (name == "weak")
    assert recipes.equal_texts(docs(spark, [])).count() == 0


def test_equal_texts_of_a_hot_group(spark):
    rng = random.Random(3)
    rows = [(i, "The same text." if i % 3 == 0 else f"text {rng.randrange(400)}") for i in range(2000)]
    check_groups(recipes.equal_texts(docs(spark, rows, 7)).collect(), rows)


def test_chunks_follow_the_content(spark):
    """All of a text is cut, within the bounds, and a change in the middle changes few chunks."""
    a, b = LONG, LONG[:200_000] + "changed" + LONG[200_003:]
    rows = spark.createDataFrame([("a", a), ("b", b), ("c", ""), ("d", "x" * 10_000)], "k string, t string")
    cut = {r["k"]: r["c"] for r in rows.select("k", recipes.chunks(F.col("t")).alias("c")).collect()}
    assert "".join(cut["a"]) == a and "".join(cut["b"]) == b and cut["c"] == []
    assert all(recipes.LEAST <= len(c) <= recipes.MOST for c in cut["a"][:-1]) and len(cut["a"]) > 600
    assert len(set(cut["a"]) ^ set(cut["b"])) <= 6
    assert [len(c) for c in cut["d"]] == [4096, 4096, 1808]


def test_one_of_each_text(spark):
    frame = docs(spark, ROWS)
    got = recipes.one_of_each_text(frame)
    assert got.columns == frame.columns
    rows = [(r["doc_id"], r["text"]) for r in got.collect()]
    texts = [(t or "").translate(LOWER) for _, t in rows]
    assert len(set(texts)) == len(texts) == len({(t or "").translate(LOWER) for _, t in ROWS})
    assert (12, "hello  world") not in rows and {i for i, _ in rows} >= {3, 7, 9, 10, 11, 12, 14, 16, 17, 18, None}


# ---------------------------------------------------------------- spelling
def brute_words(rows, length=6, occurrences=5, slip=199):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % slip == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if c >= occurrences and len(w) >= length}


def edits(a, b):
    """Whether exactly one letter is inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_groups(words, ratio=5):
    out = {}
    for w, n in words.items():
        near = [v for v in words if edits(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        form = best if best is not None and words[best] >= ratio * n else None
        out[w] = (n, len(near), form, words[form] if form else None)
    full = {}
    for w in out:
        root = w
        while out[root][2]:
            root = out[root][2]
        full[w] = (*out[w], root)
    return full


def corpus(seed, n=60):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abcdeé", k=rng.randint(5, 9))) for _ in range(40)] + ["ßÿÀà×÷x", "straße"]
    rows = []
    for i in range(n):
        words = []
        for _ in range(150):
            w = rng.choice(base[:5] * 12 + base)
            if rng.random() < 0.4:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1:], w[:at] + rng.choice("abé") + w[at:], w[:at] + rng.choice("cd") + w[at + 1:]])
            words.append(w.upper() if rng.random() < 0.2 and w.isascii() else w)
        rows.append((i if i % 9 else None, rng.choice([" ", "-", "1", "。"]).join(words)))
    return rows


@pytest.mark.parametrize("hot", [4096, 12, 3])
def test_spelling_groups(spark, hot):
    """Blocks whole, cut by thirds of the alphabet, and dealt to pairs of tiles: the same groups."""
    rows = corpus(hot) + [(1, None), (2, ""), (3, "12 !?"), (70, "abcdefgh " * 40), (70, "abcdefgh " * 40), (71, "abcdefgi " * 6 + "abcdefghi " * 7),
                           (80, "chainlink " * 6 + "chainlinkk " * 40 + "chainlinkkk " * 300)]
    want = brute_groups(brute_words(rows))
    got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in spelling.spelling_groups(docs(spark, rows), hot=hot).collect()}
    assert got == want
    assert sum(v[2] is not None for v in want.values()) > 20 and any(v[2] and want[v[2]][2] for v in want.values())


def test_spelling_of_odd_tables(spark):
    assert spelling.spelling_groups(docs(spark, [])).count() == 0
    assert spelling.spelling_groups(docs(spark, [(1, None), (2, "a b c")])).count() == 0
    # words far longer than what is padded, next to each other
    long = "ab" * 30_000
    rows = [(i, f"{long} {long}a" if i < 30 else f"{long[:-1]}c x") for i in range(36)]
    want = brute_words(rows)
    got = {r["word"]: (r["n"], r["n_near"]) for r in spelling.spelling_groups(docs(spark, rows)).collect()}
    assert {w: n for w, (n, _) in got.items()} == want
    assert all(near == sum(edits(w, v) for v in want) for w, (_, near) in got.items()) and any(near for _, near in got.values())
    with pytest.raises(ValueError):
        spelling.spelling_groups(docs(spark, rows), ratio=1)


def test_letter_counts_and_edits():
    rng = random.Random(5)
    words = ["".join(rng.choices("abà", k=rng.randint(2, 4))) for _ in range(60)]
    counts = spelling.letter_counts(words)
    assert all(counts[i, spelling._PLACE[ord(c)]] == words[i].count(c) for i in range(60) for c in "abàz")
    pairs = [(i, j) for i in range(60) for j in range(60) if words[i] != words[j] and len(words[j]) - len(words[i]) in (0, 1)]
    got = spelling._edits(words, *(np.array(x) for x in zip(*pairs, strict=True)))
    for (i, j), g in zip(pairs, got, strict=True):
        assert g == edits(words[i], words[j]) == spelling.one_edit(words[i], words[j])
        if g:
            assert ((counts[i] - counts[j]) ** 2).sum() <= 2


# ---------------------------------------------------------------- centroids
def brute_clusters(rows, k, rounds, dim):
    kept = [(i, [int(np.floor(256 * float(v))) for v in x]) for i, x in rows
            if x is not None and len(x) == dim and all(v is not None and np.isfinite(v) for v in x)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [x for _, x in first]

    def nearest(x):
        d = [sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) for y in c]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        to = [nearest(x)[0] for _, x in kept]
        for j in range(len(c)):
            own = [x for (_, x), t in zip(kept, to, strict=True) if t == j]
            if own:
                c[j] = [sum(v) // len(own) for v in zip(*own, strict=True)]
    return Counter((i, *nearest(x)) for i, x in kept), c


VECTORS = "vec_id long, embedding array<float>, cluster string, x string, near string, h string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, x, *"abcd") for i, x in rows], VECTORS).repartition(3)


@pytest.mark.parametrize("seed", [0, 1])
def test_clusters(spark, seed):
    rng = np.random.RandomState(seed)
    mid = rng.randn(4, 8) * 3
    rows = [(i, [float(np.float32(v)) for v in mid[i % 4] + rng.randn(8) * (0.2 if seed else 2)]) for i in range(150)]
    rows += [(200, None), (201, [1.0] * 7), (202, [1.0] * 7 + [None]), (203, [float("nan")] + [0.0] * 7), (204, [float("inf")] + [0.0] * 7),
             (205, [0.0] * 8), (None, [0.5] * 8), (5, rows[5][1]), (5, rows[6][1]), (206, rows[7][1])]
    rows = [(i, x if x is None else [None if v is None else float(v) for v in x]) for i, x in rows]
    assigned, c = centroids.cluster(vectors(spark, rows), k=9, rounds=3, dim=8)
    want, plain = brute_clusters(rows, 9, 3, 8)
    assert c.tolist() == plain
    assert Counter(tuple(r) for r in assigned.collect()) == want
    out = centroids.with_inertia(spark, assigned, c).collect()
    total = sum(d * n for (_, _, d), n in want.items())
    assert {r["inertia"] for r in out} == {total} and sum({r["cluster"]: r["cluster_inertia"] for r in out}.values()) == total
    assert all(r["centroid_sha256"] == hashlib.sha256(",".join(map(str, plain[r["cluster"]])).encode()).hexdigest() for r in out)


def test_clusters_of_odd_tables(spark):
    for rows in ([], [(1, None), (2, [float("nan")] * 8)]):
        assigned, c = centroids.cluster(vectors(spark, rows), k=3, dim=8)
        assert assigned.count() == 0 and len(c) == 0 and centroids.with_inertia(spark, assigned, c).count() == 0
    same = [(i, [0.25] * 8) for i in range(20)]  # all in the first of equal centroids
    assigned, c = centroids.cluster(vectors(spark, same), k=3, dim=8)
    assert {(r["cluster"], r["distance"]) for r in assigned.collect()} == {(0, 0)} and len(c) == 3
    few, c = centroids.cluster(vectors(spark, [(1, [0.0] * 8), (2, [100_000.0] * 8)]), k=40, dim=8)
    assert few.count() == 2 and len(c) == 2
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster(vectors(spark, [(1, [0.0] * 8), (2, [1e30] * 8)]), k=2, dim=8)


def test_bounds_are_never_too_large():
    """Also for points in one line, where Ptolemy's inequality is an equality, and for huge values."""
    rng = np.random.RandomState(4)
    for scale, line in ((300, False), (1 << 26, False), (1 << 26, True), (5, True)):
        x = rng.randint(-scale, scale, (200, 64 if not line else 1)).astype(np.int64)
        c = rng.randint(-scale, scale, (12, x.shape[1])).astype(np.int64)
        pivots = centroids.choose_pivots(c)
        gaps = {p: float(np.sqrt(centroids.squared(pivots[[p[0]]], pivots[p[1]])[0])) for p in centroids.pivot_pairs(pivots)}
        near, own = (np.sqrt(centroids.all_squared(v, pivots).astype(float)) for v in (x, c))
        exact = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(u, v, strict=True)) for v in c] for u in x], object)
        low = centroids.lower_bounds(near, own, gaps)
        assert all(float(low[i, j]) ** 2 * (1 - 1e-15) <= float(exact[i, j]) for i in range(200) for j in range(12))
        to, distance, checked = centroids.nearest(x, near, c, own, gaps)
        assert [int(d) for d in distance] == [min(r) for r in exact.tolist()] and to.tolist() == [r.index(min(r)) for r in exact.tolist()]
        assert not line or checked < 200 * 12 / 2  # on a line the bounds are tight


# ---------------------------------------------------------------- nearest neighbours
def test_routing_opens_few_parts_where_vectors_cluster(spark):
    """Below a quarter of the rows compared for a query, and nine of ten neighbours found."""
    from horizonkit.llm import ann
    rng = np.random.RandomState(7)
    mid = rng.randn(60, 16) * 4
    x = (mid[rng.randint(60, size=6000)] + rng.randn(6000, 16)).astype(np.float32)
    frame = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    got = {}
    for r in ann.search(frame, frame.where("vec_id % 100 = 0")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    x = x.astype(float)
    hits = 0
    for q in range(0, 6000, 100):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(got[q] & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert hits >= 0.9 * 600
    routing = ann.fit_routing(x[:4096], 20)
    stands, opens = (ann.by_probability(routing.router, v, c) for v, c in ((x, routing.spread), (x[::100], routing.probes)))
    sizes = np.bincount(stands.ravel(), minlength=20)
    assert sizes[opens].sum(1).mean() < 0.25 * len(x)
    one = ann.fit_routing(x[:5], 3)
    assert one.probes == len(one.router.b2)  # too few rows to measure: every part is opened
