"""Registered text queries against DuckDB or brute force on the driver's smallest tables."""

import glob
import os
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from brineframe.llm import ctw, queries

from ..oracle import canonical, connect
from . import brute

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def docs():
    return [tuple(r) for r in zip(*pq.read_table(f"{SF_DIR}/documents.parquet", columns=["doc_id", "text"]).to_pydict().values())]


def rows(spark, name, *columns):
    found = queries.all_queries()[name](spark, SF_DIR)
    return sorted(tuple(r) for r in (found.select(*columns) if columns else found).collect())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, name):
    df = queries.QUERIES[name](spark, SF_DIR)
    got = [tuple(r) for r in df.collect()]
    cur = connect(SF_DIR).execute(queries.SQL[name])
    names = [c[0] for c in cur.description]
    assert canonical(got, df.columns) == canonical(cur.fetchall(), names)
    assert sorted(names) == sorted(df.columns)


def test_every_document_has_one_row(spark):
    n = len(docs())
    for name, run in queries.QUERIES.items():
        if name not in ("op11_angular_negatives", "op13_setm_collocations"):
            assert run(spark, SF_DIR).select("doc_id").distinct().count() == n, name


def test_secrets(spark):
    want = []
    for doc, text in docs():
        spans = brute.secret_spans(text)
        kinds = [k for k, _, _ in spans]
        want.append((doc, kinds.count("assign"), kinds.count("access"), kinds.count("hex"), brute.sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans))))
    assert rows(spark, "op3_secret_ownership", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == sorted(want)


def test_secret_counts_of_many_spans(spark, tmp_path):
    """Several spans of one kind in a text, in any order of kinds: counted by kind, not by place."""
    texts = ["password=abcdefgh " * 3, "a" * 32 + " token: abcdefgh1 " + "AKIA" + "A" * 12 + " " + "b" * 40, "AKIA" + "A" * 12, "x", "", None]
    spark.createDataFrame([(i, t, "s", "en") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op3_secret_ownership"](spark, str(tmp_path)).select("doc_id", "n_assign", "n_access", "n_hex").collect()
    assert sorted(map(tuple, got)) == [(0, 3, 0, 0), (1, 1, 1, 2), (2, 0, 1, 0), (3, 0, 0, 0), (4, 0, 0, 0), (5, 0, 0, 0)]


def test_scores(spark):
    got = rows(spark, "op6_context_tree_weighting", "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    want = sorted(brute.baseline(docs()))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)
    assert all(g[6] < 0 for g in got)


def test_scores_generalise(spark):
    """On held-out documents of a larger table the model is better than counting words."""
    larger = "/root/testdata/sf0.1"
    if not os.path.isdir(larger):
        pytest.skip("no larger table")
    held = ctw.scored(spark.read.parquet(f"{larger}/documents.parquet")).where("held_out")
    score, base = held.agg({"score": "sum", "base_score": "sum"}).select("sum(score)", "sum(base_score)").first()
    assert score > base


def test_scores_equal_a_tree_of_dictionaries(spark):
    some = [(i, (t or "")[:160]) for i, t in docs()[:60]]
    tree = brute.ContextTree(some, ctw.DEPTH)
    got = dict(ctw.scored(spark.createDataFrame(some, "doc_id long, text string"), chunk_bytes=2000).select("doc_id", "score").collect())
    assert np.allclose([got[i] for i, _ in some], [tree.score(t) for _, t in some], rtol=1e-8)


def library():
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.no_truncation()
    own.no_padding()
    return own


def test_codec(spark):
    own, want = library(), []
    for doc, text in docs():
        ids = own.encode(text or "", add_special_tokens=False).ids
        want.append((doc, len(ids), brute.sha(",".join(map(str, ids))), brute.sha(own.decode(ids, skip_special_tokens=False))))
    assert rows(spark, "op7_bpe_codec") == sorted(want)


def test_token_files(spark):
    own, want, start = library(), [], 0
    for doc, text in brute.by_id(docs()):
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert rows(spark, "op10_token_files") == want


def test_pipeline(spark):
    import corpus_pipeline

    left = [(doc, text) for doc, text in docs() if brute.passes(text)]
    left = [(d, t) for d, t, n, gone in brute.lone_line_dedup(left, 20) if not n or gone < n]
    group = {d: c for d, _, c in brute.similar(left, corpus_pipeline.SHINGLE, corpus_pipeline.SIMILAR)}
    left = [(d, t) for d, t in left if group[d] == d]
    items = [tuple(r) for r in zip(*pq.read_table(f"{SF_DIR}/benchmark.parquet", columns=["item_id", "text"]).to_pydict().values())]
    bad = {r[0] for r in brute.decontamination(left, items) if r[5]}
    own = library()
    want = sorted((d, t, own.encode(t, add_special_tokens=False).ids) for d, t in left if d not in bad)
    assert 0 < len(want) < len(docs())
    got = queries.all_queries()["pipeline"](spark, SF_DIR)
    assert sorted((r.doc_id, r.text, list(r.ids)) for r in got.collect()) == want


def test_token_file_layout(spark, tmp_path):
    from brineframe.llm import tokens

    tokens.write_tokens(spark.read.parquet(f"{SF_DIR}/documents.parquet"), str(tmp_path / "t"), public_tokenizers.path("byte_bpe_50k.json"))
    files = [pq.ParquetFile(f) for f in glob.glob(f"{tmp_path}/t/tokens/*.parquet")]
    group = next(f for f in files if f.metadata.num_rows).metadata.row_group(0)
    columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    ids = next(v for k, v in columns.items() if k.startswith("ids"))
    assert any("DICT" in e for e in ids.encodings)
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    assert columns["doc_id"].has_column_index and ids.has_offset_index
    some = tokens.read_tokens(spark, str(tmp_path / "t")).where("doc_id between 40 and 44").select("doc_id", "n_tokens")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1] and "GreaterThanOrEqual(doc_id" in plan
    assert some.count() == 5
