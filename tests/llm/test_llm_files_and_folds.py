"""Token files by ranges and by size; the toxicity chain's folds."""

import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyarrow import fs
from tokenizers import Tokenizer

from horizonkit.llm import token_files, toxicity
from horizonkit.session import scratch_path

BYTES = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("local", [True, False])
def test_checksums_by_ranges(tmp_path, monkeypatch, local):
    rng = np.random.default_rng(5)
    n = [1, 40, 1, 7, 64, 65, 200, 1, 30, 30, 3]
    ids = rng.integers(0, 1 << 16, sum(n)).astype("<u2")
    (tmp_path / "x.ids").write_bytes(ids.tobytes())
    (tmp_path / "none.ids").write_bytes(b"")
    at = np.concatenate(([0], np.cumsum(n)))
    want = [zlib.crc32(ids[a:z].astype("<u4").tobytes()) for a, z in zip(at, at[1:])]
    monkeypatch.setattr(token_files, "READ_IDS", 64)
    if not local:  # a file system without local paths
        monkeypatch.setattr(token_files, "_at", lambda folder: (fs.SubTreeFileSystem(folder, fs.LocalFileSystem()), ""))
    file = token_files._Input(str(tmp_path), "x.ids", "<u2")
    assert (file.mapped is not None) == local and file.size == sum(n)
    assert token_files.checksums(file, at) == want
    assert token_files.checksums(file, at[3:]) == want[3:]
    assert token_files._Input(str(tmp_path), "none.ids", "<u2").read(0, 0).size == 0


def test_files_follow_the_text(spark, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_BYTES", 1000)
    rows = [(i, "some words " * 10) for i in range(300)] + [(300, None), (None, "")]
    table = spark.createDataFrame(rows, "doc_id string, text string")  # an id of another type
    folder = scratch_path(spark, "tokens")
    parts = token_files.write_tokens(table, folder, BYTES)
    assert 20 <= parts.count() <= 34
    got = sorted((tuple(r) for r in token_files.read_tokens(spark, folder, parts).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, *range(301)]
    ids = Tokenizer.from_file(BYTES).encode("some words " * 10, add_special_tokens=False).ids
    assert {r[2:] for r in got[1:-1]} == {(len(ids) + 1, zlib.crc32(np.array([*ids, 0], "<u4").tobytes()))}
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1].tolist()]


def test_targets_come_from_the_rows_to_learn_from():
    a, b, common = (toxicity.word_set(w) for w in (b"aaaa", b"bbbb", b"common"))
    sets = [np.union1d(common, a)] * 20 + [np.union1d(common, b)] * 20 + [common] * 60
    toxic = np.array([1.0] * 40 + [0.0] * 60)
    everything = np.ones(100, bool)
    _, targets = toxicity.categories(sets, toxic, everything)
    assert targets[:, 0].tolist() == toxic.tolist()
    without_b = everything.copy()
    without_b[20:40] = False
    _, targets = toxicity.categories(sets, toxic, without_b)  # b is known from rows left out alone
    assert targets[:, 0].tolist() == [1.0] * 20 + [0.0] * 80 and targets[:, 2].tolist() == toxic.tolist()


def test_out_of_fold_rows_are_unseen(monkeypatch):
    """Every model that scores a fold was fitted on the other folds' rows, with targets of those rows' lexicon."""
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 50, 8)).astype(np.int32) for _ in range(90)]
    toxic = (np.arange(90) % 4 == 0).astype(float)
    learnt, fitted = [], []
    plain_lexicon, plain_fit = toxicity.lexicon, toxicity.fit_linear
    monkeypatch.setattr(toxicity, "lexicon", lambda s, y: learnt.append(len(s)) or plain_lexicon(s, y))
    monkeypatch.setattr(toxicity, "fit_linear", lambda rows, y: fitted.append((len(rows.dense), len(y), rows.dense.shape[1])) or plain_fit(rows, y))
    chain = toxicity.fit_chain(sets, toxic, folds=3)
    assert learnt == [90, 60, 60, 60]
    assert fitted == [(n, n, k) for k in range(3) for n in (90, 60, 60, 60)]
    assert chain.score(sets).shape == (90, 3)


def test_chain_is_as_right_as_a_single_model():
    """Held-out rows: as many right. The one label says nothing that a single model could not read, so its log loss is as low."""
    rows = duckdb.sql(f"""select d.text, l.toxic, l.doc_id from read_parquet('{SF}/documents.parquet') d
                          join read_parquet('{SF}/labels.parquet') l using (doc_id) order by l.doc_id""").fetchall()
    sets, y = [toxicity.word_set(t.encode()) for t, _, _ in rows], np.array([float(v > 0) for _, v, _ in rows])
    held = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for _, _, i in rows])
    own = [s for s, h in zip(sets, held) if not h]
    unseen = [s for s, h in zip(sets, held) if h]
    chain = toxicity.fit_chain(own, y[~held]).score(unseen)[:, -1]
    single = toxicity.fit_linear(toxicity.Rows.of(own, np.empty((len(own), 0))), y[~held]).score(
        toxicity.Rows.of(unseen, np.empty((len(unseen), 0))))
    assert np.mean((chain >= 0.5) == y[held]) >= np.mean((single >= 0.5) == y[held])
    assert np.mean((chain >= 0.5) == y[held]) > 0.9
