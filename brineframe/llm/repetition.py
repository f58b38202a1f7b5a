"""Quality rules on repetition inside a text, by suffix array.

The suffixes of a text's words are sorted by prefix doubling (all texts of a block together;
only suffixes that still tie take part in the next round). Neighbours in the suffix array
give the longest common prefixes: a suffix's larger neighbour value is the longest repeated
run that starts there, which is the widest LCP interval it lies in. Runs of ``min_run`` words
or more are the repeats; the union of their spans over all occurrences is the covered part.
The verdict limits the covered share of the word characters and the longest repeat.

A text is judged whole, wherever it is long: the rounds grow with the logarithm of the
longest repeat. Nothing is shuffled.

Defined cases: a null, empty or word-free text has zero in every count, fails the base rule
(too few words) and is not kept. Column names that the result also has are renamed first
(``x`` -> ``x_in``, or further ``_in`` if that is taken).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import text as tx

MIN_WORDS = 20
WINDOW = 8                 # words of a base window
WINDOW_LIMIT = 30          # percent of words inside repeated base windows
MIN_RUN = 6                # words of the shortest repeat that counts
COVERED_LIMIT = 0.40       # share of word characters inside repeats
LONGEST_LIMIT = 100        # words of the longest repeat
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
RESULT = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "covered_chars": "long", "longest_repeat": "long", "repeats": "array<struct<start:int,end:int>>"}


def suffix_ranks(symbols: np.ndarray, owner: np.ndarray) -> list[np.ndarray]:
    """Ranks of all positions by their first 1, 2, 4, ... symbols within the owner's text; the last list is a permutation."""
    n = len(symbols)
    _, inverse = np.unique(symbols, return_inverse=True)
    key = owner.astype(np.int64) * (n + 1) + inverse
    active, levels, rank, k = np.arange(n), [], np.zeros(n, np.int64), 1
    while True:
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
        at = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
        old = rank[active[order]]
        group = np.concatenate([[True], old[1:] != old[:-1]]) if levels else np.arange(len(order)) == 0
        base = np.maximum.accumulate(np.where(group, np.arange(len(order)), 0))
        rank = rank.copy()
        rank[active[order]] = old + at - base
        levels.append(rank)
        single = fresh & np.concatenate([fresh[1:], [True]])
        active = np.sort(active[order[~single]])
        if not len(active):
            return levels
        ahead = active + k
        inside = np.minimum(ahead, n - 1)
        follow = np.where((ahead < n) & (owner[inside] == owner[active]), rank[inside] + 1, 0)
        key = rank[active] * (n + 2) + follow
        k *= 2


def longest_repeats(symbols: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest run from there that occurs elsewhere in the same text."""
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    levels = suffix_ranks(symbols, owner)
    array = np.empty(n, np.int64)
    array[levels[-1]] = np.arange(n)
    a, b = array[:-1], array[1:]
    near = np.flatnonzero(levels[0][a] == levels[0][b])  # same text and first word
    a, b = a[near], b[near]
    common = np.zeros(len(a), np.int64)
    for p in range(len(levels) - 1, -1, -1):
        i, j = a + common, b + common
        ok = (np.maximum(i, j) < n)
        same = np.zeros(len(a), bool)
        rank = levels[p]
        i, j = i[ok], j[ok]
        same[ok] = (rank[i] == rank[j]) & (owner[i] == owner[a[ok]]) & (owner[j] == owner[b[ok]])
        common += same.astype(np.int64) << p
    best = np.zeros(n, np.int64)
    np.maximum.at(best, a, common)
    np.maximum.at(best, b, common)
    return best


def spans_of(best: np.ndarray, least: int) -> np.ndarray:
    """Mask of the positions inside a repeat of ``least`` or more."""
    step = np.zeros(len(best) + 1, np.int64)
    at = np.flatnonzero(best >= least)
    np.add.at(step, at, 1)
    np.subtract.at(step, at + best[at], 1)
    return np.cumsum(step[:-1]) > 0


def measured(texts: list[bytes], min_run: int = MIN_RUN) -> dict[str, list]:
    """The columns of RESULT for a few MB of texts."""
    out: dict[str, list] = {name: [] for name in RESULT}
    for first, last in tx.blocks(texts):
        joined, at = tx.join(texts[first:last])
        buf = np.frombuffer(joined, np.uint8)
        start, end = tx.spans(buf, tx.NOT_WHITE)
        counts = np.diff(np.searchsorted(start, at))
        owner = np.repeat(np.arange(len(counts)), counts)
        head = np.concatenate([[0], np.cumsum(tx.NOT_WHITE[buf] & ((buf & 0xC0) != 0x80))])  # code points before a byte
        chars = head[end] - head[start]
        total = lambda v: np.bincount(owner, v, len(counts)).astype(np.int64)
        signs = np.concatenate([[0], np.cumsum(SYMBOLS[buf])])
        a, b = tx.spans(buf, np.arange(256) != 10)
        solid = np.concatenate([[0], np.cumsum(tx.NOT_WHITE[buf])])
        full = solid[b] > solid[a]
        a, b = a[full], b[full]
        line_owner = np.searchsorted(at, a, side="right") - 1
        lines = tx.mix(tx.span_hashes(buf, a, b)) + line_owner.astype(np.uint64)  # equal only within a text
        _, seen = np.unique(lines, return_index=True)
        dup = np.bincount(line_owner, minlength=len(counts)) - np.bincount(line_owner[seen], minlength=len(counts))
        best = longest_repeats(tx.span_hashes(buf, start, end), owner)
        run = spans_of(best, min_run)
        longest = np.zeros(len(counts), np.int64)
        np.maximum.at(longest, owner, best)
        out["n_words"] += counts.tolist()
        out["word_chars"] += total(chars).tolist()
        out["n_symbols"] += (signs[at[1:]] - signs[at[:-1]]).tolist()
        out["n_dup_lines"] += dup.tolist()
        out["n_repeat_words"] += total(spans_of(best, WINDOW)).tolist()
        out["covered_chars"] += total(np.where(run, chars, 0)).tolist()
        out["longest_repeat"] += longest.tolist()
        # runs of covered words, cut at text ends
        place = np.concatenate([[0], np.cumsum(counts)])
        inner = np.concatenate([[0], owner])[:-1] != owner if len(owner) else np.zeros(0, bool)
        opening = run & (inner | ~np.concatenate([[False], run[:-1]]))
        closing = run & (np.concatenate([inner[1:], [True]]) | ~np.concatenate([run[1:], [False]])) if len(owner) else run
        s, e = np.flatnonzero(opening), np.flatnonzero(closing) + 1
        cut = np.searchsorted(s, place)
        for d in range(len(counts)):
            lo, hi = cut[d], cut[d + 1]
            out["repeats"].append([{"start": int(x - place[d]), "end": int(y - place[d])} for x, y in zip(s[lo:hi], e[lo:hi])])
    return out


TAKEN = (*RESULT, "base_failed", "kept")


def measures(docs: DataFrame, text: str = "text", min_run: int = MIN_RUN) -> DataFrame:
    """``docs`` with the repetition measures of every text."""
    docs = tx.renamed(docs, RESULT)
    schema = docs.schema
    more = T._parse_datatype_string(", ".join(f"{k} {v}" for k, v in RESULT.items()))
    full = T.StructType(schema.fields + more.fields)

    def run(batches):
        tx.release_memory()
        kinds = {"repeats": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))}
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                batch = whole.slice(i, 512)
                found = measured([b"" if t is None else t for t in batch.column(text).cast(pa.binary()).to_pylist()], min_run)
                new = [pa.array(found[k], kinds.get(k, pa.int64())) for k in RESULT]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *RESULT])

    return docs.mapInArrow(run, full)


def judged(docs: DataFrame, text: str = "text", covered_limit: float = COVERED_LIMIT, longest_limit: int = LONGEST_LIMIT, min_run: int = MIN_RUN) -> DataFrame:
    """``docs`` with the measures, base_failed and kept."""
    docs = tx.renamed(docs, TAKEN)
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > WINDOW_LIMIT * F.col("n_words"))
    quiet = (F.col("covered_chars") <= F.lit(covered_limit) * F.col("word_chars")) & (F.col("longest_repeat") <= longest_limit)
    return measures(docs, text, min_run).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & quiet)


def kept_only(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that pass, columns unchanged."""
    return tx.original(judged(docs, text).where(F.col("kept")), docs, TAKEN)
