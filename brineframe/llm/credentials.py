"""Secret scans with corpus-wide ownership frequency.

Patterns find candidates in each text: assignments, access keys, long hexadecimal runs, and
other random-looking tokens. The hash of every candidate's value is counted over the corpus by
distinct owners and repositories. A value that many owners hold is a copied example; one that
few hold looks live. Candidates of the three named kinds are always reported; a random-looking
token is reported (kind ``live``) only if it is owner-specific.

Texts are scanned where they lie and not shuffled; only hashes are, reduced to distinct
(value, owner, repository) before the grouping. The scan is written once to the shared folder.

Defined cases: a null or empty text has no candidates; a null owner or repository counts as
"" ; spans are code points of the text, end exclusive; equal rows are kept apart.
"""

from __future__ import annotations

import hashlib
import re
from math import log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.tables import staged
from ..session import shared_dir

OWNERS = 2            # a value with more owners is a copied example
ENTROPY = 3.0         # bits per character of a random-looking token
KINDS = ("assign", "access", "hex", "live")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
FOUND = "rid long, doc_id long, owner string, repo string, found array<struct<kind:int,start:int,end:int,value:binary>>"


def entropy(token: str) -> float:
    n = len(token)
    return -sum(c / n * log2(c / n) for c in (token.count(x) for x in set(token)))


def random_looking(token: str) -> bool:
    return any(c.isdigit() for c in token) and any(c.isalpha() for c in token) and entropy(token) >= ENTROPY


def candidates(text: str | None) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) by start, then kind; random-looking tokens only outside the named kinds."""
    if not text:
        return []
    out = []
    if "=" in text or ":" in text:
        out = [(0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text)]
    out += [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    named = sorted((a, b) for _, a, b, _ in out)
    for m in TOKEN.finditer(text):
        if random_looking(m[0]) and not any(a < m.end() and m.start() < b for a, b in named):
            out.append((3, m.start(), m.end(), m[0]))
    return sorted(out, key=lambda x: (x[1], x[0]))


def scanned(docs: DataFrame, owner: Column, repo: Column) -> DataFrame:
    """One row per text with its candidates; values as 128-bit hashes."""
    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                rows.append([{"kind": k, "start": a, "end": b, "value": hashlib.blake2b(v.encode(), digest_size=16).digest()} for k, a, b, v in candidates(text)])
            kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.binary())]))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("rid", "doc_id", "owner", "repo")] + [pa.array(rows, kind)], names=["rid", "doc_id", "owner", "repo", "found"])

    none = F.lit("")
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(owner.cast("string"), none).alias("owner"),
                       F.coalesce(repo.cast("string"), none).alias("repo"), F.col("text"))
    return rows.mapInArrow(run, FOUND)


def ownership(found: DataFrame, owners: int = OWNERS) -> DataFrame:
    """(value, owners, repos, copied) of every candidate value."""
    seen = found.select("owner", "repo", F.explode("found.value").alias("value")).distinct()
    return seen.groupBy("value").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repo").alias("repos")).withColumn("copied", F.col("owners") > owners)


def secrets(docs: DataFrame, owner: Column | None = None, repo: Column | None = None, owners: int = OWNERS) -> DataFrame:
    """(doc_id, spans array<struct<kind,start,end,owners,repos,copied>>): reported spans by start, then kind."""
    spark = docs.sparkSession
    owner = F.col("source") if owner is None else owner
    repo = F.concat_ws("/", F.col("source"), F.col("lang")) if repo is None else repo
    found = staged(scanned(docs, owner, repo), shared_dir(spark, "secrets"))
    each = found.select("rid", F.explode("found").alias("f")).select("rid", "f.*")
    told = each.join(ownership(found, owners), "value").where(f"kind < {len(KINDS) - 1} OR NOT copied")
    spans = told.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "owners", "repos", "copied"))).alias("spans"))
    return found.select("rid", "doc_id").join(spans, "rid", "left").select("doc_id", F.coalesce("spans", F.array()).alias("spans"))


def is_kind(kind: int, span: Column) -> Column:
    return span["kind"] == kind


def digest(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
