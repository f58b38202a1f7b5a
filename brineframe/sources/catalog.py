"""Item catalog: upsert by id, stable order."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def upsert(old: DataFrame, new: DataFrame, key: str, generation: str = "generation") -> DataFrame:
    """Replace items in place, append unknown ones.

    The order of a catalog is (generation, key): a replaced item keeps the generation
    in which it first appeared, appended items share the next one. No row has to be
    numbered globally, so the order costs no single-task window. ``new`` holds each key
    once.
    """
    columns = [c for c in new.columns if c != generation]
    following = F.coalesce(old.select(F.max(generation)).scalar(), F.lit(-1)) + 1
    kept = old.join(new.select(key), key, "left_anti")
    current = new.select(*columns).join(old.select(key, generation), key, "left")
    placed = current.withColumn(generation, F.coalesce(generation, following.cast("int")))
    return kept.select(*columns, generation).unionByName(placed.select(*columns, generation))
