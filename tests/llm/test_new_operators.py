"""Hard negatives, tensored MinHash and collocations against brute force: nulls, ties, repeated rows, empty tables, clashing columns."""

import random
from math import inf, nan

import pytest
from pyspark.sql import functions as F

from brineframe.llm import negatives, phrases, tensor

from . import brute
from .test_text_edges import ROWS, prose


def vectors(seed, n, dim=6, kinds=4):
    r = random.Random(seed)
    centre = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(kinds)]
    out = []
    for i in range(n):
        label = r.randrange(kinds)
        out.append((i, label, [float(c + r.gauss(0, 0.4)) for c in centre[(label + r.randrange(2)) % kinds]]))
    return out


SHORT = "vec_id long, label int, embedding array<double>, rank string, block int, share double, n long"
ODD = [
    (1000, 1, None), (1001, None, [1.0] * 6), (None, 1, [1.0] * 6), (1003, 1, [1.0, None, 1.0]), (1004, 1, [nan] * 6), (1005, 2, [inf] + [0.0] * 5),
    (1100, 1, [0.0] * 6), (1007, 2, []), (1008, 2, [1.0, 2.0]), (1009, 3, [0.5] * 9), (1200, 3, [1.0, 2.0]), (1300, 77, [1.0] * 6), (1400, 1, []),
]


@pytest.mark.parametrize("block,anchors", [(8192, 512), (16, 4)])
def test_hard_negatives(spark, block, anchors):
    rows = vectors(1, 420) + ODD
    rows += [(2000 + i, i % 3, rows[5][2]) for i in range(40)] + rows[100:104] + [rows[200]]  # ties, repeated rows, a repeated anchor
    frame = spark.createDataFrame([(*x, "r", 1, 0.5, None) for x in rows], SHORT).repartition(3)
    got = negatives.hard_negatives(frame, block=block, anchors_per_block=anchors).collect()
    want = brute.hard_negatives(rows)
    assert sorted(tuple(r) for r in got) == sorted(want) and len(want) > 100
    assert negatives.hard_negatives(frame.limit(0)).count() == 0


def test_hard_negatives_of_large_components(spark):
    """Whole numbers beyond 2**53 stay exact."""
    rows = [(i, label, [x * 1e5 + i for x in v]) for i, label, v in vectors(3, 230)]
    got = negatives.hard_negatives(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute.hard_negatives(rows)) != []


def test_bounds_hold():
    import numpy as np

    r = np.random.default_rng(5)
    a, b = (np.floor(256 * r.normal(size=(n, 8)) * r.exponential(size=(n, 1))) for n in (40, 300))
    refs = negatives.directions((b / 256).tolist())
    angles, norms = negatives.angles_to(a, refs)
    theirs, lengths = negatives.angles_to(b, refs)
    theirs = theirs.astype(np.float32).astype(float)
    at = np.arange(0, 300, 20)
    low, high = negatives.score_bounds(angles, norms, np.minimum.reduceat(theirs, at), np.maximum.reduceat(theirs, at), np.minimum.reduceat(lengths, at), np.maximum.reduceat(lengths, at))
    scores = (a @ b.T).reshape(40, 15, 20)
    assert (low <= scores.min(axis=2)).all() and (high >= scores.max(axis=2)).all()
    assert (high - low < 2 * norms[:, None] * lengths.max()).any()


def test_near_duplicates(spark):
    names = "doc_id long, text string, n string, id int, key date, component string"
    frame = spark.createDataFrame([(*x, "n", 1, None, "c") for x in ROWS], names).repartition(3)
    found = tensor.near_duplicates(frame)
    want = [(d, n, c, d == c) for d, n, c in brute.similar(ROWS, 2, 80)]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == sorted(want, key=repr)
    assert tensor.near_duplicates(frame.limit(0)).count() == 0
    text = tensor.near_duplicates(frame.withColumn("doc_id", F.col("doc_id").cast("string"))).where("doc_id in ('9', '10', '11')").collect()
    assert {r.component_id for r in text} == {"10"}  # text ids: the first by text order


def test_near_duplicates_in_chains_and_crowds(spark):
    """Families of chained near copies, and a crowd whose members are near its centre but not all near each other."""
    r = random.Random(8)
    docs, words = [], [f"u{i}" for i in range(4000)]
    for _ in range(5):
        base = r.sample(words, 150)
        for _ in range(25):
            base = list(base)
            for _ in range(r.choice([1, 3, 6])):
                base[r.randrange(len(base))] = r.choice(words)
            docs.append((len(docs), " ".join(base)))
    centre = r.sample(words, 160)
    for _ in range(60):
        own = list(centre)
        for _ in range(r.randrange(1, 14)):
            own[r.randrange(len(own))] = r.choice(words)
        docs.append((len(docs), " ".join(own)))
    frame, want = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), sorted((d, n, c, d == c) for d, n, c in brute.similar(docs, 2, 80))
    for rounds, tile in ((3, 16 << 20), (1, 40_000)):
        assert sorted(tuple(r) for r in tensor.near_duplicates(frame, rounds=rounds, tile_bytes=tile).collect()) == want


def test_tables_find_pairs_at_the_threshold():
    """Of pairs whose similarity is just 0.8, at most a few in ten thousand share no table."""
    import numpy as np

    t, r = tensor.collections(), np.random.default_rng(4)
    assert 2 * (1 - 0.8 ** tensor.K) ** t <= tensor.MISSED
    missed = 0
    for _ in range(300):
        common, extra = r.integers(1, 2**63, 80, dtype=np.uint64), r.integers(1, 2**63, 20, dtype=np.uint64)
        distinct = np.sort(np.concatenate([common, extra]))
        a, b = (np.flatnonzero(~np.isin(distinct, drop)) for drop in (extra[:10], extra[10:]))
        sub = tensor.subkeys(np.concatenate([a, b]), distinct, np.array([0, len(a)]), tensor.K, t)
        keys = tensor.table_keys(sub, t)
        missed += not (keys[0] == keys[1]).any()
        assert ((sub[0, :t] == sub[1, :t]).sum() * (sub[0, t:] == sub[1, t:]).sum()) == (keys[0] == keys[1]).sum()
    assert missed <= 1


@pytest.mark.parametrize("chunk", [4 << 20, 400])
def test_collocations(spark, chunk):
    r = random.Random(2)
    vocabulary = [f"v{i}" for i in range(25)] + ["New York", "of the end", "Ünder", "ſ"]
    docs = [(" ".join(r.choice(vocabulary) + r.choice(["", "", "", ".", ",\n", "\t", "!"]) for _ in range(r.randrange(60))), r.choice(["en", "de", None, "und"])) for _ in range(120)]
    docs += [(t, "en") for _, t in ROWS if t is None or len(t) < 20_000] + [(None, None), ("", "fr"), (". , \n", "fr"), ("a b c d e f " * 50, "fr"), ("a b c d e f " * 50, "fr")]
    frame = spark.createDataFrame([(*x, "n", 1, "l", 0.5) for x in docs], "text string, lang string, n string, a int, phrase string, score double").repartition(3)
    for least, longest, top in ((2, 5, 2000), (4, 3, 7)):
        got = phrases.collocations(frame, top=top, least=least, longest=longest, chunk_bytes=chunk)
        assert sorted(tuple(x) for x in got.collect()) == sorted(brute.collocations(docs, least, longest, top)) != []
    assert phrases.collocations(frame.limit(0)).count() == 0


def test_collocation_passes_keep_answers_not_relations(spark, monkeypatch):
    """What the passes store beside the words is a small part of the text, and nothing stays cached."""
    r, kept, staged = random.Random(5), [], phrases.staged
    sentence = [" ".join(f"w{r.randrange(400)}" for _ in range(6)) for _ in range(300)]
    docs = [(" ".join(r.choice(sentence) for _ in range(400)), "en") for _ in range(40)]

    def spy(df, path):
        out = staged(df, path)
        if "words" not in path:
            sizes = [F.coalesce(F.sum(F.length(c)), F.lit(0)) for c, kind in out.dtypes if kind == "binary"]
            kept.append(sum(out.agg(*sizes).first()) if sizes else 0)
        return out

    monkeypatch.setattr(phrases, "staged", spy)
    cached = spark.sparkContext._jsc.getPersistentRDDs().size()
    got = phrases.collocations(spark.createDataFrame(docs, "text string, lang string"), least=20, chunk_bytes=100_000)
    assert sorted(tuple(x) for x in got.collect()) == sorted(brute.collocations(docs, 20, 5, 2000)) != []
    assert sum(kept) < 0.1 * sum(len(t) for t, _ in docs)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == cached


def test_scores_beyond_64_bits(spark):
    rows = [("x", "a b", 9 * 10**16, [(9 * 10**16 + 1, 10**17)], 10**18)]
    found = spark.createDataFrame(rows, "lang string, phrase string, a long, cuts array<struct<l:long,r:long>>, n long")
    cut = found.select(phrases.best_cut().alias("cut")).first().cut
    assert cut.score == 1000 * 9 * 10**16 * 10**18 // ((9 * 10**16 + 1) * 10**17)


def test_long_texts(spark):
    """A text longer than a chunk, and than a block of one pass."""
    text = prose(3, 250_000)
    docs = [(1, text), (2, text + " tail"), (3, "short one")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(tuple(r)[2] for r in tensor.near_duplicates(frame).collect()) == [1, 1, 3]
    got = phrases.collocations(frame.withColumn("lang", F.lit("en")), top=50, least=500)
    assert sorted(tuple(x) for x in got.collect()) == sorted(brute.collocations([(t, "en") for _, t in docs], 500, 5, 50))
