"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, against brute force."""

import random
import time

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st

from brineframe.llm import bpe, chunks, components, credentials, ctw, decontaminate, licenses, lines, repetition, similar, text as tx, tokens, windows

from . import brute

PATH = public_tokenizers.path("byte_bpe_50k.json")
VOCABULARY = [f"w{i}" for i in range(400)] + ["Über", "naïve", "日本", "x" * 300]


def prose(seed, n):
    r = random.Random(seed)
    return "".join(r.choice(VOCABULARY) + r.choice([" "] * 9 + ["\n"]) for _ in range(n))


LONG = prose(0, 30_000)
BASE = prose(1, 300)
NEAR = BASE.replace("w7 ", "w8 ", 1).replace("w9 ", "W10 ", 1)
PASSAGE = prose(2, 60)
ROWS = [
    (1, None), (2, ""), (3, " \n\t\f "), (4, "one"), (5, "one two three"), (6, "ONE Two three"), (7, LONG), (8, LONG), (8, LONG),
    (9, BASE), (10, NEAR), (11, BASE.upper()), (12, BASE + "\n" + PASSAGE), (13, prose(3, 90) + "\n" + PASSAGE + "\n" + prose(4, 80)),
    (14, PASSAGE + "\n" + PASSAGE), (15, "a a a a a a a a a a " * 30), (16, "line one here\nline two here\n\n line one here\nline two here \nlast"),
    (17, None), (None, BASE), (None, None), (None, "alone " + prose(5, 30)), (20, "same line\nother line\nsame line"), (21, "ß ＡＢ ſecret=abcdefghij \x1c\x85 end"),
    (22, "token: \"abcdefgh12\" Passwd=short secret=token=\"abcdefgh\" AKIAABCDEFGHIJKL AKIAAKIA1 " + "0123456789abcdef" * 2 + "f"),
    (23, "token: \"abcdefgh12\" and aB3dE5gH7jK9mN1pQ2rS"), (24, "x<|endoftext|>y  \n\n z"), (25, "é" * 5000), (26, "aaab" * 3000),
]
SCHEMA = "doc_id long, text string, source string, lang string, n_words string, hits string, removed double, ids string, licenses int, spans date"


@pytest.fixture(scope="module")
def table(spark):
    full = [(d, t, f"s{i % 3}" if i % 5 else None, "en" if i % 4 else None, None, "h", None, "i", 3, None) for i, (d, t) in enumerate(ROWS)]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def some(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_decontamination(spark, table, empty):
    items = [(1, " ".join(PASSAGE.split()[10:40])), (2, "One, two"), (None, "line two"), (3, None), (4, ""), (1, "é" * 5000), (5, "last"), (6, "last")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    for part in (8 << 20, 300):  # one pass, then several
        found = decontaminate.decontaminated(table, frame, part_bytes=part)
        got = sorted(((r.doc_id, r.n_words, sum(h.end - h.start for h in r.hits), len(r["items"]), brute.sha(",".join(r["items"])), bool(r.hits)) for r in found.collect()), key=repr)
        assert got == sorted(brute.decontamination(ROWS, items), key=repr)
    assert decontaminate.decontaminated(empty, frame).count() == 0
    clean = decontaminate.clean_only(table, frame.limit(0))
    assert clean.schema == table.schema and clean.count() == len(ROWS)


def test_repetition(table, empty):
    short = [(d, t) for d, t in ROWS if t is None or len(t.split()) < 700]
    got = some(repetition.measures(table).where("text is null or size(split(text, '[ \n]')) < 800"), "doc_id", *[c for c in repetition.RESULT if c != "repeats"])
    assert got == sorted(((d, *brute.repeats(t)) for d, t in short), key=repr)
    long = repetition.measures(table).where("doc_id in (7, 8)").collect()
    assert len(long) == 3 and {r.n_words for r in long} == {len(LONG.split())}
    kept = repetition.kept_only(table)
    assert kept.schema == table.schema and kept.where("doc_id = 9").count() == 1 and kept.where("doc_id in (1, 2, 3, 4, 15)").count() == 0
    assert repetition.judged(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=24), min_size=1, max_size=4))
def test_longest_repeats(texts):
    got = repetition.longest_repeats(np.array([x for t in texts for x in t], np.int64), np.repeat(np.arange(len(texts)), [len(t) for t in texts])).tolist()
    want = []
    for t in texts:
        for i in range(len(t)):
            want.append(max((next((n for n in range(len(t) - max(i, j) + 1) if max(i, j) + n == len(t) or t[i + n] != t[j + n]), 0) for j in range(len(t)) if j != i), default=0))
    assert got == want


def test_secrets(spark, table, empty):
    docs = table.select("doc_id", "text", "source", "lang")
    found = credentials.secrets(docs)
    for d, t in ROWS:
        if d is not None and d != 8:
            spans = found.where(f"doc_id = {d}").first().spans
            assert [(credentials.KINDS[s.kind], s.start, s.end) for s in spans if s.kind < 3] == brute.secret_spans(t)
    live = found.where("doc_id = 23").first().spans
    assert [(s.kind, s.owners) for s in live] == [(0, 2), (3, 1)]
    assert credentials.secrets(empty.select("doc_id", "text", "source", "lang")).count() == 0
    many = spark.createDataFrame([(i, "key aB3dE5gH7jK9mN1pQ2rS", f"s{i}", "en") for i in range(4)], "doc_id long, text string, source string, lang string")
    assert {len(r.spans) for r in credentials.secrets(many).collect()} == {0}  # four owners: a copied example


@pytest.mark.parametrize("chunk", [None, 500])
def test_lines(table, empty, chunk):
    found = lines.without_repeated_runs(table, chunk_bytes=chunk)
    assert some(found, "doc_id", "text", "n_lines", "n_removed") == sorted(brute.line_dedup(ROWS), key=repr)
    assert lines.cleaned(table).schema == table.schema
    assert lines.without_repeated_runs(empty).count() == 0


@pytest.mark.parametrize("chunk", [None, 500])
def test_lone_lines(spark, chunk):
    passage, other = " ".join(f"p{i}" for i in range(60)), " ".join(f"q{i}" for i in range(19))
    docs = [(1, f"head a\n{passage}\ntail a"), (2, f"head b\n  {passage} \n\ntail b"), (3, passage), (4, "short only"), (5, "short only"),
            (6, f"{other}\nx\n{other}\ny\n{other} end\nz\n{other} end"), (7, "short only\nmore"), (8, None), (9, "\n \n")] + [(i + 20, t) for i, (_, t) in enumerate(ROWS)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = lines.without_repeated_runs(frame, chunk_bytes=chunk, lone=lines.LONE)
    got = some(found, "doc_id", "text", "n_lines", "n_removed")
    assert got == sorted(brute.lone_line_dedup(docs, lines.LONE), key=repr)
    removed = {r[0]: r[3] for r in got}
    assert [removed[i] for i in range(1, 10)] == [0, 1, 1, 0, 1, 1, 0, 0, 0]
    assert {r.n_removed for r in lines.without_repeated_runs(frame.where("doc_id < 10")).collect()} == {0}  # runs of two find none of them
    left = {r.doc_id for r in lines.cleaned(frame.where("doc_id < 10"), lone=lines.LONE).collect()}
    assert left == {1, 2, 4, 6, 7, 8, 9}


@pytest.mark.parametrize("chunk", [None, 500])
def test_windows(table, empty, chunk):
    found = windows.repeated_windows_removed(table, chunk_bytes=chunk)
    assert some(found, "doc_id", "n_words", "n_removed", "kept_text") == sorted(brute.window_dedup(ROWS), key=repr)
    assert windows.repeated_windows_removed(empty).count() == 0


@pytest.mark.parametrize("chunk", [None, 500])
def test_similar(table, empty, chunk):
    layout = similar.Layout(table, **({"chunk_bytes": chunk} if chunk else {}))
    found = similar.similar_groups(table, layout=layout)
    assert some(found, "doc_id", "n_shingles", "component_id") == sorted(brute.similar(ROWS), key=repr)
    assert found.where("first").count() == found.select("component").distinct().count()
    kept = similar.one_of_each(table, chunk_bytes=chunk)
    assert kept.schema == table.schema and kept.where("doc_id = 8 or doc_id in (10, 11)").count() == 0 and kept.where("doc_id in (7, 9)").count() == 2
    assert similar.similar_groups(empty).count() == 0 and similar.one_of_each(empty).count() == 0


def test_near_duplicates_of_the_pipeline(spark):
    """Five words and 0.8: a fifth appended, a block of seven changed words; a third appended is another text."""
    import corpus_pipeline

    base = [f"u{i}" for i in range(105)]
    other = [f"v{i}" for i in range(105)]
    docs = [(1, " ".join(base)), (2, " ".join(base + [f"x{i}" for i in range(21)])), (3, " ".join(base + [f"y{i}" for i in range(35)])),
            (4, " ".join(other)), (5, " ".join(other[:50] + [f"z{i}" for i in range(7)] + other[57:]))]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(docs, "doc_id long, text string"), "")
    want = sorted(d for d, _, c in brute.similar(docs, 5, 80) if d == c)
    assert sorted(r.doc_id for r in kept.collect()) == want == [1, 3, 4]
    assert [d for d, _, c in brute.similar(docs) if d == c] == [1, 2, 3, 4, 5]  # the terms of op9 link none of them


def test_similar_links_across_lists(spark):
    """Chains of near copies: every link between different texts counts, although lists are linked to leaders first."""
    r = random.Random(5)
    docs, words = [], [f"u{i}" for i in range(3000)]
    for family in range(6):
        base = r.sample(words, 120)
        for step in range(25):
            base = list(base)
            for _ in range(r.choice([1, 2, 4])):
                base[r.randrange(len(base))] = r.choice(words)
            docs.append((len(docs), " ".join(base)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert some(similar.similar_groups(frame), "doc_id", "n_shingles", "component_id") == sorted(brute.similar(docs), key=repr)


def test_components(spark):
    r = random.Random(3)
    links = [(r.randrange(400), r.randrange(400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(120)] + [(5000, 6000 + i) for i in range(200)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = dict(components.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {x: find(x) for x in root}


def test_scores(table, empty):
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in ctw.scored(table, chunk_bytes=50_000).collect()), key=repr)
    assert got == sorted(((*w[:5], round(w[5], 6)) for w in brute.baseline(ROWS)), key=repr)
    assert ctw.scored(empty).count() == 0
    alone = ctw.scored(table.where("doc_id = 4")).first()
    assert alone.held_out == brute.held_out(4)


def test_probabilities_sum_to_one(spark):
    """Over all next bytes after a context, seen or not."""
    keys = np.concatenate([ctw.grams([t], 3)[0] for t in (b"abcabcabd", b"abd xyz")])
    train, counts = ctw.counted(keys)
    for context in (int(train[3]) >> 8, 0x616263, 0x7A7A7A):
        full, weight = ctw.counted(np.concatenate([train, (np.uint64(context << 8) | np.arange(256, dtype=np.uint64))]), np.concatenate([counts, np.zeros(256)]))
        forest = ctw.Forest(full, weight, 3, top=0)
        logs = forest.log_probability(3, [], full)
        assert abs(np.exp(logs[full >> np.uint64(8) == context]).sum() - 1) < 1e-9


def plain_grams(texts, depth):
    for number, t in enumerate(texts):
        past = b"\xff" * depth
        for byte in t.lower() + b"\xff":
            yield int.from_bytes(past + bytes([byte])), number
            past = (past + bytes([byte]))[1:]


def test_grams_with_their_texts():
    """Texts shorter than the context, empty ones and a long one, in several blocks."""
    texts = [b"", b"Ab", b"", b"abcabcabd", LONG.encode(), b"\x00\xc3\xa9", *[b"x y"] * 300, LONG.encode(), b""]
    for depth in (2, 3, 5):
        want = list(plain_grams(texts, depth))
        assert list(zip(*(x.tolist() for x in ctw.grams(texts, depth)))) == want
        found, often, owner = ctw.owned_grams(texts, depth)
        assert list(zip(np.repeat(found, often).tolist(), owner.tolist())) == sorted(want)
        assert (np.diff(found.astype(np.int64)) > 0).all()
        assert ctw.distinct_grams(texts, depth).tolist() == sorted({g for g, _ in want})


def test_counts_folded_often(monkeypatch):
    keys = [np.random.default_rng(i).integers(0, 500, n).astype(np.uint64) for i, n in enumerate((0, 1, 700, 90, 3000, 5))]
    distinct, counts = np.unique(np.concatenate(keys), return_counts=True)
    for raw, flush in ((0, 0), (50, 100), (1000, 10**6)):
        monkeypatch.setattr(ctw, "RAW", raw)
        monkeypatch.setattr(ctw, "FLUSH", flush)
        counter = ctw.Counter()
        for k in keys:
            counter.add(k)
        got = counter.result()
        assert got[0].tolist() == distinct.tolist() and got[1].tolist() == counts.tolist()
    assert [len(x) for x in ctw.Counter().result()] == [0, 0]


def test_distinct_grams_cost_a_sort():
    """CPU time of counting and of collecting n-grams, which is most of the operator's, against that of a sort alone."""
    keys = ctw.grams([prose(i, 30_000).encode() for i in range(10)])[0]

    def cost(step):
        took = []
        for _ in range(5):
            start = time.process_time()
            step()
            took.append(time.process_time() - start)
        return min(took)

    sort = cost(lambda: np.sort(keys))
    assert cost(lambda: ctw.counted(keys)) < 3 * sort
    assert cost(lambda: ctw.together([keys])) < 3 * sort


@pytest.mark.parametrize("depth", [3, 6, 7])
def test_scores_of_other_depths(spark, depth):
    """Deeper n-grams leave fewer bits for the texts' numbers, so a chunk is scored in parts."""
    some = [(i, f"{prose(i, 3)[:12]} Ä") for i in range(300)]
    tree = brute.ContextTree(some, depth)
    got = dict(ctw.scored(spark.createDataFrame(some, "doc_id long, text string"), depth).select("doc_id", "score").collect())
    assert np.allclose([got[i] for i, _ in some], [tree.score(t) for _, t in some], rtol=1e-8)


def test_codec(table, empty):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(PATH)
    found = bpe.decoded(bpe.encoded(table, PATH), PATH)
    for r in found.collect():
        want = own.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == own.decode(want, skip_special_tokens=False)
    assert bpe.encoded(empty, PATH).count() == 0 and "ids_in" in bpe.encoded(empty, PATH).columns


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_codec_equals_library(text):
    from tokenizers import Tokenizer

    own = test_codec_equals_library.__dict__.setdefault("own", (bpe.Codec(open(PATH, encoding="utf-8").read()), Tokenizer.from_file(PATH), bpe.Decoder(open(PATH, encoding="utf-8").read())))
    text = text.encode("utf-8", "ignore").decode()
    ids, at = own[0].encode([text])
    assert ids.tolist() == own[1].encode(text, add_special_tokens=False).ids and own[2].decode(ids.tolist()) == text
    piece = text.encode()
    if piece:
        flat, start, size = own[0].merger.many([piece])
        assert own[0].merger.one(piece).tolist() == flat[start[0]:start[0] + size[0]].tolist()


def test_licenses(spark, empty):
    r = random.Random(11)
    docs, want = [(0, None), (1, ""), (2, "all rights")], {0: [], 1: [], 2: []}
    for i, (name, text) in enumerate(licenses.TEMPLATES.items(), 3):
        words = text.split()
        if len(words) > 40:  # a few words changed
            words[len(words) // 2] = "changed"
        docs.append((i, f"{prose(i, r.randrange(200))} {' '.join(words)} {prose(i + 50, 70)}"))
        want[i] = [name, "Apache-2.0-line"] if name == "Apache-2.0" else [name]  # the notice holds the line
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {x.doc_id: sorted({m.license for m in x.licenses}) for x in licenses.licensed(frame).collect()}
    assert got == want
    assert licenses.licensed(empty).count() == 0 and licenses.licensed(frame.withColumnRenamed("doc_id", "n_words")).count() == len(docs)
    for c in licenses.classes(licenses.TEMPLATES):
        assert (1 - c.least_similarity) ** c.bands <= licenses.MISSED


def test_license_table(spark):
    """Every template of the table is found as its license, notices also reworded; two in one window stay two."""
    known, docs, want = licenses.known(), [], {}
    for i, (name, text) in enumerate(known.items()):
        docs.append((i, f"{prose(i, 40)} {text} {prose(i + 90, 40)}"))
        want[i] = name
    reworded = {
        "GPL-2.0": "This package is free software; you may redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, you can obtain one at https://mozilla.org/MPL/2.0/.",
        "ISC": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "BSD-3-Clause": known["BSD-3-Clause"].replace("the copyright holder", "Example Inc."),
    }
    for name, text in reworded.items():
        want[len(docs)] = name
        docs.append((len(docs), f"{prose(7, 50)} {text} {prose(8, 60)}"))
    docs += [(1000, known["MIT-line"] + " and also " + known["MIT-line"]), (1001, known["GPL-2.0"] + " " + known["GPL-3.0"])]
    rows = licenses.licensed(spark.createDataFrame(docs, "doc_id long, text string"), known).collect()
    got = {r.doc_id: [m.license for m in r.licenses] for r in rows}
    assert {i: (n, got[i]) for i, n in want.items() if n not in got[i]} == {}
    short = {i: n for i, n in want.items() if not n.endswith("-text")}  # a whole text quotes others
    assert {i: (n, got[i]) for i, n in short.items() if {licenses.family(g) for g in got[i]} - {licenses.family(n), "all-rights-reserved"}} == {}
    assert got[1000] == ["MIT-line"] * 2 and got[1001] == ["GPL-2.0", "GPL-3.0"]


def test_token_files(spark, table, empty, tmp_path):
    for n, frame in enumerate((table, empty)):
        tokens.write_tokens(frame, str(tmp_path / str(n)), PATH)
    back = tokens.read_tokens(spark, str(tmp_path / "0")).orderBy("start").collect()
    assert [r.doc_id for r in back] == [d for d, _ in brute.by_id(ROWS)]
    assert [r.start for r in back] == np.concatenate([[0], np.cumsum([r.n_tokens for r in back])[:-1]]).tolist()
    assert tokens.read_tokens(spark, str(tmp_path / "1")).count() == 0


def test_word_hashes():
    texts = [(t or "").encode() for _, t in ROWS]
    hashes, counts = tx.word_hashes(texts)
    words = [w for t in texts for w in t.split()]
    assert counts.tolist() == [len(t.split()) for t in texts]
    known = {}
    for w, h in zip(words, hashes.tolist()):
        assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


def test_clashing_names(spark):
    """Columns named like results, and like their new names."""
    names = ["n_words", "n_words_in", "hits", "hits_in", "n_lines", "n_lines_in", "kept", "kept_in", "kept_in_in", "ids", "ids_in", "licenses", "licenses_in"]
    frame = spark.createDataFrame([(1, BASE, *names), (2, None, *names)], ["doc_id", "text", *names])
    items = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    for left in (repetition.kept_only(frame), decontaminate.clean_only(frame, items), lines.cleaned(frame)):
        assert left.columns == frame.columns and left.where("doc_id = 1").select(*names).collect() == [tuple(names)]
    for found in (licenses.licensed(frame), bpe.recoded(frame, PATH), bpe.encoded(frame, PATH)):
        assert len(set(found.columns)) == len(found.columns) > len(frame.columns) and found.where("doc_id = 1").count() == 1


def test_character_classes():
    """Every code point splits as in the tokenizers library."""
    from tokenizers import pre_tokenizers

    codec = bpe.Codec(open(PATH, encoding="utf-8").read())
    split = pre_tokenizers.ByteLevel(add_prefix_space=False)
    for first in ("a", "1"):
        text = "".join(f"{first}{chr(i)}\n" for i in range(0x110000) if not 0xD800 <= i < 0xE000)
        chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        starts = np.flatnonzero(bpe.piece_starts(np.append(chars, 0), np.append(bpe.char_kinds()[chars], np.uint8(bpe.END))))[:-1]
        want = [a for _, (a, _) in split.pre_tokenize_str(text)]
        assert np.array_equal(starts, want)
    with pytest.raises(ValueError):
        bpe.checked({"pre_tokenizer": {"type": "Whitespace"}, "model": {}})
    assert codec.added


def test_recoded(table, empty):
    both = {(r.doc_id, r.text or ""): (r.ids, r.decoded) for r in bpe.decoded(bpe.encoded(table, PATH), PATH).collect()}
    for r in bpe.recoded(table, PATH).collect():
        assert both[r.doc_id, r.text] == (r.ids, r.text)
    assert bpe.recoded(empty, PATH).count() == 0


def test_a_group_leaves_no_powers_behind():
    """A worker waiting for its next group must not hold the last one's tables; hashes stay the same."""
    words = np.arange(1 << 18, dtype=np.uint64)
    want = tx.windows(words, 5)
    assert (chunks.lean(lambda: tx.windows(words, 5)) == want).all()
    assert sum(p.up.nbytes + p.down.nbytes for p in tx._POWERS) < 1 << 10
    assert (tx.windows(words, 5) == want).all()
