"""The registered queries on the small tables, against brute force."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"select doc_id, text from read_parquet('{SF}/documents.parquet') order by doc_id").fetchall()


def run(spark, name):
    return entry.queries()[name](spark, SF).collect()


def word_list(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def test_quality_held_out(spark):
    rows = {r["doc_id"]: r for r in run(spark, "op1_quality_classifier")}
    labels = dict(duckdb.sql(f"select doc_id, quality from read_parquet('{SF}/labels.parquet')").fetchall())
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(rows[i]["held_out"] for i in held) and all(0 <= r["score"] <= 1 for r in rows.values())
    pairs = [(rows[a]["score"], rows[b]["score"]) for a in held for b in held if labels[a] > labels[b]]
    assert np.mean([a > b for a, b in pairs]) > 0.9
    assert np.mean([rows[i]["predicted"] == labels[i] for i in held]) > 0.9


def test_simhash(spark, documents):
    def fingerprint(text):
        words = word_list(re.sub("[A-Z]", lambda m: m.group().lower(), text))
        shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        ones = [0] * 64
        for s in shingles:
            h = xxhash.xxh64_intdigest(s.encode(), 42)
            for k in range(64):
                ones[k] += h >> k & 1
        return sum(1 << k for k in range(64) if ones[k] * 2 > len(shingles))

    fps = {i: fingerprint(t) for i, t in documents}
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in run(spark, "op2_simhash_near_dedup")}
    assert got == {i: (f"{fps[i]:016x}", find(i)) for i in ids}
    assert len({c for _, c in got.values()}) < len(ids)


def test_decontamination(spark, documents):
    """Every exact copy of a test item (in normal form) is found, at distance 0, and nothing is reported beyond the budget."""
    from horizonkit.llm.decontam import normal
    items = duckdb.sql(f"select item_id, text from read_parquet('{SF}/benchmark.parquet')").fetchall()
    texts = {i: normal(t.encode()) for i, t in documents}
    exact = {(i, n) for i, t in texts.items() for n, x in items if normal(x.encode()) in t}
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in run(spark, "op3_benchmark_decontamination")}
    assert exact and {k for k, d in got.items() if d == 0} == exact

    def distance(pattern, text):  # plain dynamic programme, any start and end in the text
        row = np.arange(len(pattern) + 1)
        best, p = len(pattern), np.frombuffer(pattern, np.uint8)
        for c in text:
            low = np.minimum(row[:-1] + (p != c), row[1:] + 1)
            new = np.concatenate(([0], low))
            new = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
            row = new
            best = min(best, int(row[-1]))
        return best

    some = list(texts)[:40]
    for i in some:
        for n, x in items[:10]:
            pattern = normal(x.encode())
            d = distance(pattern, texts[i])
            assert got.get((i, n)) == (d if d <= int(len(pattern) * 0.08) else None)


def test_sharding_law(spark, documents):
    rows = run(spark, "op4_sharding")
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(s) for s in by.values()]
    assert set(by) == set(range(16)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    texts = dict(documents)
    assert all(r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) and r["size"] == len(texts[r["doc_id"]].encode()) + 1
               for r in rows)


def test_ann_recall(spark):
    rows = duckdb.sql(f"select vec_id, embedding from read_parquet('{SF}/embeddings.parquet') order by vec_id").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    got = {}
    for r in run(spark, "op5_ann"):
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == {i for i in ids.tolist() if i % 100 == 0}
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(1))
        best = sorted((dist, i) for dist, i in zip(d.tolist(), ids.tolist(), strict=True) if i != q)[:10]
        hits += len({i for _, i in best} & {i for i, _ in found.values()})
        assert sorted(found) == list(range(1, 11))
        assert [found[k] for k in sorted(found)] == sorted(found.values(), key=lambda v: (v[1], v[0]))
        assert all(abs(s - d[ids == i][0]) < 1e-9 for i, s in found.values())
    assert hits / (10 * len(got)) >= 0.9


def test_secret_base_spans(spark, documents):
    assign = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    want = {}
    for i, t in documents:
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m.group(1)) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 24]
        kinds = ("assign", "access", "hex")
        text = ",".join(f"{kinds[k]}:{a}:{z}" for a, k, z in sorted(spans))
        want[i] = (*(sum(k == n for _, k, _ in spans) for n in range(3)), hashlib.sha256(text.encode()).hexdigest())
    rows = run(spark, "op6_secret_scan")
    assert {r["doc_id"]: (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in rows} == want
    assert any(w[0] for w in want.values())
    for r in rows:  # the base spans are among all spans
        kept = [s for s in r["spans"].split(",") if s and not s.startswith("random")]
        assert hashlib.sha256(",".join(kept).encode()).hexdigest() == r["base_sha256"]


def whole_ids(documents, name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    encoded = t.encode_batch([text for _, text in documents], add_special_tokens=False)
    return {i: np.array([*e.ids, 0], "<u4") for (i, _), e in zip(documents, encoded, strict=True)}


def test_packing(spark, documents):
    ids = whole_ids(documents, "word_bpe_49k.json")
    got, bins = set(), {}
    for r in run(spark, "op7_sum_of_squares_packing"):
        got.add((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]))
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    want = {(i, k, k * 2048, len(x[k * 2048:(k + 1) * 2048]), zlib.crc32(x[k * 2048:(k + 1) * 2048].tobytes()))
            for i, x in ids.items() for k in range(-(-len(x) // 2048))}
    assert got == want
    for parts in bins.values():
        parts.sort()
        assert [a for a, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1].tolist()]
        assert sum(n for _, n in parts) <= 2048
    assert len(bins) <= 1.03 * -(-sum(map(len, ids.values())) // 2048)


def test_toxicity_held_out(spark):
    rows = {r["doc_id"]: r for r in run(spark, "op8_toxicity")}
    labels = dict(duckdb.sql(f"select doc_id, toxic from read_parquet('{SF}/labels.parquet')").fetchall())
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([rows[i]["predicted"] == labels[i] for i in held]) > 0.95


def test_token_files(spark, documents):
    ids, at, want = whole_ids(documents, "byte_bpe_50k.json"), 0, {}
    for i in sorted(ids):
        want[i] = (at, len(ids[i]), zlib.crc32(ids[i].tobytes()))
        at += len(ids[i])
    rows = run(spark, "op9_token_files")
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows} == want


def test_substring_dedup(spark, documents):
    first = {}
    for i, t in documents:
        w = word_list(t)
        for k in range(len(w) - 49):
            first.setdefault(" ".join(w[k:k + 50]), i)
    want = {}
    for i, t in documents:
        w = word_list(t)
        out = set()
        for k in range(len(w) - 49):
            if first[" ".join(w[k:k + 50])] < i:
                out.update(range(k, k + 50))
        kept = " ".join(x for k, x in enumerate(w) if k not in out)
        want[i] = (len(w), len(out), hashlib.sha256(kept.encode()).hexdigest())
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in run(spark, "op10_substring_dedup")}
    assert got == want and any(n for _, n, _ in want.values())


@pytest.mark.parametrize("name", ["op4_sharding", "op10_substring_dedup"])
def test_oracle(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    frame = entry.queries()[name](spark, SF)
    sql = con.sql(entry.oracle_sql()[name])
    assert sorted(sql.columns) == sorted(frame.columns)
    order = sorted(frame.columns)
    assert sorted(map(tuple, frame.select(*order).collect())) == sorted(sql.select(*order).fetchall())


def test_pipeline(spark, documents):
    import corpus_pipeline
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_near_dedup", "benchmark_decontamination",
                                                      "secret_scan", "best_fit_packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    from horizonkit.llm.decontam import normal
    from horizonkit.session import written
    stages = dict(corpus_pipeline.STAGES)
    rows = {r["doc_id"]: r["predicted"] for r in run(spark, "op1_quality_classifier")}
    one = written(stages["quality_classifier"](spark, docs, SF), "t1")
    assert one.columns == docs.columns and {r["doc_id"] for r in one.select("doc_id").collect()} == {i for i, p in rows.items() if p}
    from horizonkit.llm.simhash import simhash_components
    groups = {r["component"] for r in simhash_components(one).collect()}
    two = written(stages["simhash_near_dedup"](spark, one, SF), "t2")
    assert two.columns == docs.columns and sorted(r["doc_id"] for r in two.select("doc_id").collect()) == sorted(groups)
    three = written(stages["benchmark_decontamination"](spark, two, SF), "t3")
    left, items = three.collect(), [normal(r["text"].encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert three.columns == docs.columns and 0 < len(left) < two.count()
    assert not any(x in normal(r["text"].encode()) for r in left for x in items)
    four = written(stages["secret_scan"](spark, three, SF), "t4")
    assert four.columns == docs.columns and four.count() == len(left)
    masked = four.where("text like '%[SECRET]%'").collect()
    assert masked and all(r["n_chars"] == len(r["text"]) for r in masked)
    assert not any(re.search("[0-9a-f]{24}", r["text"]) for r in four.collect())
    five = stages["best_fit_packing"](spark, four, SF)
    assert {r["doc_id"] for r in five.collect()} == {r["doc_id"] for r in left}
