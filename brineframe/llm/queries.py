"""The registered queries of the text operators: thin digests of what the operators return, and their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, credentials, ctw, decontaminate, licenses, lines, negatives, phrases, repetition, similar, tensor, tokens, windows
from ..session import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower(column: str) -> str:
    return f"translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query
def op1_benchmark_decontamination(spark, sf_dir):
    """Words of every document inside benchmark windows, and the items they come from."""
    found = decontaminate.decontaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + h["end"] - h["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


SQL["op1_benchmark_decontamination"] = rf"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all({lower('text')}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM benchmark WHERE text IS NOT NULL
), patterns AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)
), doc_words AS (
  SELECT doc_id, coalesce(regexp_extract_all({lower('text')}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+'), []) AS w FROM documents
), windows AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS p
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc_words, (SELECT DISTINCT k FROM patterns) WHERE len(w) >= k)
), hits AS (
  SELECT doc_id, windows.k, i, item_id FROM windows JOIN patterns ON windows.p = patterns.p AND windows.k = patterns.k
), words_hit AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hits) GROUP BY doc_id
), items_hit AS (
  SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, coalesce(CAST(item_id AS VARCHAR), '') AS s FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN words_hit h USING (doc_id) LEFT JOIN items_hit i USING (doc_id)
"""


@query
def op2_repetition_rules(spark, sf_dir):
    """Repetition measures and verdict of every document."""
    found = repetition.judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_chars")


SQL["op2_repetition_rules"] = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), lines AS (
  SELECT r, count(*) - count(DISTINCT line) AS n
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), windows AS (
  SELECT r, k, i, hash(array_to_string(w[i:i + k - 1], ' ')) AS p
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (VALUES ({repetition.WINDOW}), ({repetition.MIN_RUN}), ({repetition.LONGEST_LIMIT + 1})) t(k) WHERE len(w) >= k)
), repeated AS (
  SELECT r, k, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, k, p) > 1
), covered AS (
  SELECT DISTINCT r, k, unnest(range(i, i + k)) AS j FROM repeated
), sums AS (
  SELECT c.r, count(*) FILTER (k = {repetition.WINDOW}) AS n_repeat_words,
         sum(CASE WHEN k = {repetition.MIN_RUN} THEN length(w[j]) ELSE 0 END) AS covered_chars,
         bool_or(k = {repetition.LONGEST_LIMIT + 1}) AS long_repeat
  FROM covered c JOIN docs USING (r) GROUP BY c.r
), facts AS (
  SELECT docs.r, doc_id, len(w) AS n_words, CAST(coalesce(length(array_to_string(w, '')), 0) AS BIGINT) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(coalesce(covered_chars, 0) AS BIGINT) AS covered_chars, coalesce(long_repeat, false) AS long_repeat
  FROM docs LEFT JOIN lines USING (r) LEFT JOIN sums USING (r)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, n_dup_lines, n_repeat_words,
       n_words < {repetition.MIN_WORDS} OR 100 * n_repeat_words > {repetition.WINDOW_LIMIT} * n_words AS base_failed,
       NOT (n_words < {repetition.MIN_WORDS} OR 100 * n_repeat_words > {repetition.WINDOW_LIMIT} * n_words)
         AND covered_chars <= {repetition.COVERED_LIMIT}::DOUBLE * word_chars AND NOT long_repeat AS kept, covered_chars
FROM facts
"""


@query
def op3_secret_ownership(spark, sf_dir):
    """Secrets in every document; values that many sources hold are told from owner-specific ones."""
    found = credentials.secrets(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    # one parameter only: a second one of the lambda, default or not, is the position in the array
    counts = [F.size(F.filter("spans", partial(credentials.is_kind, k))).cast("long").alias(f"n_{credentials.KINDS[k]}") for k in range(3)]
    return found.select(
        "doc_id", *counts, F.sha2(credentials.digest(base), 256).alias("base_sha256"), credentials.digest(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["copied"])).cast("long").alias("n_owner_specific"))


@query
def op4_line_winnowing(spark, sf_dir):
    """Lines of every document, how many of them repeat an earlier run, and what is left."""
    found = lines.without_repeated_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL["op4_line_winnowing"] = rf"""
WITH docs AS (
  SELECT row_number() OVER (ORDER BY doc_id, text) AS r, doc_id, coalesce(text, '') AS text FROM documents
), raw AS (
  SELECT r, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS no FROM docs
), solid AS (
  SELECT r, no, s, row_number() OVER (PARTITION BY r ORDER BY no) AS i
  FROM (SELECT r, no, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS s FROM raw) WHERE s <> ''
), runs AS (
  SELECT r, i, row_number() OVER (PARTITION BY h ORDER BY r, i) AS nth FROM (
    SELECT a.r, a.i, {' || chr(10) || '.join(f's{j}.s' if j else 'a.s' for j in range(lines.RUN))} AS h
    FROM solid a {' '.join(f'JOIN solid s{j} ON s{j}.r = a.r AND s{j}.i = a.i + {j}' for j in range(1, lines.RUN))})
), gone AS (
  SELECT DISTINCT r, unnest(range(i, i + {lines.RUN})) AS i FROM runs WHERE nth > 1
), marks AS (
  SELECT solid.r, solid.no, gone.i IS NOT NULL AS removed FROM solid LEFT JOIN gone ON solid.r = gone.r AND solid.i = gone.i
)
SELECT docs.doc_id, count(marks.no) AS n_lines, count(*) FILTER (marks.removed) AS n_removed,
       sha256(coalesce(string_agg(raw.line, chr(10) ORDER BY raw.no) FILTER (NOT coalesce(marks.removed, false)), '')) AS kept_sha256
FROM docs LEFT JOIN raw ON docs.r = raw.r LEFT JOIN marks ON raw.r = marks.r AND raw.no = marks.no GROUP BY docs.r, docs.doc_id
"""


@query
def op4_lone_lines(spark, sf_dir):
    """As op4_line_winnowing, with long lines and only lines as runs of their own."""
    found = lines.without_repeated_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), lone=lines.LONE)
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL["op4_lone_lines"] = rf"""
WITH docs AS (
  SELECT row_number() OVER (ORDER BY doc_id, text) AS r, doc_id, coalesce(text, '') AS text FROM documents
), raw AS (
  SELECT r, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS no FROM docs
), solid AS (
  SELECT r, no, s, row_number() OVER (PARTITION BY r ORDER BY no) AS i, count(*) OVER (PARTITION BY r) AS n
  FROM (SELECT r, no, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS s FROM raw) WHERE s <> ''
), runs AS (
  SELECT r, i, k, row_number() OVER (PARTITION BY k, h ORDER BY r, i) AS nth FROM (
    SELECT a.r, a.i, {lines.RUN} AS k, {' || chr(10) || '.join(f's{j}.s' if j else 'a.s' for j in range(lines.RUN))} AS h
    FROM solid a {' '.join(f'JOIN solid s{j} ON s{j}.r = a.r AND s{j}.i = a.i + {j}' for j in range(1, lines.RUN))}
    UNION ALL
    SELECT r, i, 1 AS k, s AS h FROM solid WHERE n = 1 OR len(regexp_extract_all(s, '[^\x20\x09-\x0D]+')) >= {lines.LONE})
), gone AS (
  SELECT DISTINCT r, unnest(range(i, i + k)) AS i FROM runs WHERE nth > 1
), marks AS (
  SELECT solid.r, solid.no, gone.i IS NOT NULL AS removed FROM solid LEFT JOIN gone ON solid.r = gone.r AND solid.i = gone.i
)
SELECT docs.doc_id, count(marks.no) AS n_lines, count(*) FILTER (marks.removed) AS n_removed,
       sha256(coalesce(string_agg(raw.line, chr(10) ORDER BY raw.no) FILTER (NOT coalesce(marks.removed, false)), '')) AS kept_sha256
FROM docs LEFT JOIN raw ON docs.r = raw.r LEFT JOIN marks ON raw.r = marks.r AND raw.no = marks.no GROUP BY docs.r, docs.doc_id
"""


@query
def op5_window_dedup(spark, sf_dir):
    """Words of every document, how many are removed as repeats, and what is left."""
    found = windows.repeated_windows_removed(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL["op5_window_dedup"] = rf"""
WITH docs AS (
  SELECT row_number() OVER (ORDER BY doc_id, text) AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT r, i, row_number() OVER (PARTITION BY h ORDER BY r, i) AS nth FROM (
    SELECT r, i, array_to_string(w[i:i + {windows.K} - 1], ' ') AS h
    FROM (SELECT r, w, unnest(range(1, len(w) - {windows.K} + 2)) AS i FROM docs WHERE len(w) >= {windows.K}))
), gone AS (
  SELECT DISTINCT r, unnest(range(i, i + {windows.K})) AS i FROM starts WHERE nth > 1
), words AS (
  SELECT docs.r, t.i, docs.w[t.i] AS word, gone.i IS NOT NULL AS removed
  FROM (SELECT r, unnest(range(1, len(w) + 1)) AS i FROM docs) t JOIN docs USING (r) LEFT JOIN gone ON gone.r = t.r AND gone.i = t.i
), kept AS (
  SELECT r, count(*) FILTER (removed) AS n, string_agg(word, ' ' ORDER BY i) FILTER (NOT removed) AS text FROM words GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
"""


def tokenizer_file() -> str:
    """The public vocabulary that the queries use; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op6_context_tree_weighting(spark, sf_dir):
    """Log probability of every document under the byte model, beside a word-count baseline."""
    return ctw.scored(table(spark, sf_dir, "documents"))


@query
def op7_bpe_codec(spark, sf_dir):
    """Token ids of every document, and the text they decode to."""
    path = tokenizer_file()
    found = bpe.recoded(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


@query
def op8_license_scan(spark, sf_dir):
    """License notices in every document."""
    found = licenses.licensed(table(spark, sf_dir, "documents").select("doc_id", "text"), licenses.known())
    names = F.array_join(F.array_sort(F.array_distinct("licenses.license")), ",")
    return found.select("doc_id", "n_words", F.size("licenses").cast("long").alias("n_matches"), names.alias("licenses"))


@query
def op9_prefix_join(spark, sf_dir):
    """Shingles of every document and the smallest document that links reach."""
    found = similar.similar_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


SQL["op9_prefix_join"] = rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(coalesce({lower('text')}, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + {similar.N} - 1], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {similar.N} + 1, 1) + 1)) AS i FROM docs WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= {similar.PERCENT} * (p.n + q.n - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM docs UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT docs.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(b) AS component_id
FROM docs LEFT JOIN sizes USING (doc_id) JOIN reach ON reach.a = docs.doc_id GROUP BY docs.doc_id
"""


@query
def op10_token_files(spark, sf_dir):
    """Token files written in the order of doc_id and read back."""
    path = shared_dir(spark, "tokens")
    tokens.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_file())
    return tokens.checksums(tokens.read_tokens(spark, path))


@query
def op11_angular_negatives(spark, sf_dir):
    """Hard negatives of every anchor and positive."""
    vectors = negatives.relabelled(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return negatives.hard_negatives(vectors).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


SQL["op11_angular_negatives"] = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= {negatives.POSITIVES}
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id) WHERE NOT same AND {negatives.LOW} * positive_score <= 100 * score AND 100 * score <= {negatives.HIGH} * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= {negatives.NEGATIVES}
"""


@query
def op12_tensored_minhash(spark, sf_dir):
    """Two-word shingles of every document, the smallest document that links reach, and whether it stays."""
    found = tensor.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


SQL["op12_tensored_minhash"] = rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(coalesce({lower('text')}, ''), '[^ 	-
]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + {tensor.N} - 1], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {tensor.N} + 1, 1) + 1)) AS i FROM docs WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= {tensor.PERCENT} * (p.n + q.n - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM docs UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT docs.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(b) AS component_id, docs.doc_id = min(b) AS kept
FROM docs LEFT JOIN sizes USING (doc_id) JOIN reach ON reach.a = docs.doc_id GROUP BY docs.doc_id
"""


@query
def op13_setm_collocations(spark, sf_dir):
    """The phrases of every language that occur together most."""
    return phrases.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


SQL["op13_setm_collocations"] = rf"""
WITH pieces AS (
  SELECT row_number() OVER () AS p, lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM (
    SELECT coalesce(lang, '{phrases.UNKNOWN}') AS lang, unnest(string_split_regex(coalesce({lower('text')}, ''), '[.,;:!?
-
]')) AS piece FROM documents)
), totals AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang
), f AS (
  SELECT lang, k, w[i:i + k - 1] AS phrase, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (SELECT unnest(range(1, {phrases.LONGEST + 1})) AS k) WHERE len(w) >= k)
  GROUP BY ALL HAVING count(*) >= {phrases.LEAST}
), candidates AS (
  SELECT lang, k, phrase, f AS a FROM f WHERE k > 1
), parts AS (
  SELECT lang, phrase[i:i + m - 1] AS phrase, max(a) AS longer
  FROM (SELECT lang, k, m, phrase, a, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM candidates)) GROUP BY ALL
), cuts AS (
  SELECT c.lang, c.phrase, a, j, l.f AS l, r.f AS r, n, CAST((1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM candidates) c JOIN totals ON totals.lang = c.lang
  JOIN f l ON l.lang = c.lang AND l.phrase = c.phrase[1:j] JOIN f r ON r.lang = c.lang AND r.phrase = c.phrase[j + 1:]
), best AS (
  SELECT c.* FROM cuts c LEFT JOIN parts p ON p.lang = c.lang AND p.phrase = c.phrase WHERE 100 * coalesce(p.longer, 0) < 100 * c.a
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, j) = 1
)
SELECT lang, row_number() OVER w AS rank, array_to_string(phrase, ' ') AS phrase, a, l, r, n, score FROM best
WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(phrase, ' ')) QUALIFY row_number() OVER w <= {phrases.TOP}
"""


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query of this subpackage, and the pipeline at the top of the repository."""
    import corpus_pipeline

    return QUERIES | {"pipeline": corpus_pipeline.run}


def all_sql() -> dict[str, str]:
    import corpus_pipeline

    return SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
