"""Query registry: name -> (Spark callable, equivalent DuckDB SQL, survey ids)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

MODULES = (
    "grid_queries", "selection_queries", "feature_queries", "match_queries",
    "quality_queries", "training_queries", "evaluation_queries", "indicator_queries",
    "source_queries", "model_queries", "boosting_queries",
)


@dataclass(frozen=True)
class Query:
    name: str
    ids: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


# Means of decimals often end exactly on half a unit of the last digit, where summation
# order decides the rounding; both engines shift by this before rounding.
NUDGE = 3e-10

_REGISTRY: dict[str, Query] = {}


def finish(df: DataFrame, digits: int = 6) -> DataFrame:
    """Result form both engines share: rounded doubles, dates and times as text, flags as 0/1."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.round(c.cast("double") + F.lit(NUDGE), digits) + F.lit(0.0)
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        elif isinstance(f.dataType, T.BooleanType):
            c = c.cast("int")
        out.append(c.alias(f.name))
    return df.select(*out)


def finish_sql(body: str, doubles: str = "", texts: str = "", flags: str = "", digits: int = 6) -> str:
    parts = [f"round(CAST({c} AS DOUBLE) + {NUDGE:.1e}, {digits}) + 0.0 AS {c}" for c in doubles.split()]
    parts += [f"CAST({c} AS VARCHAR) AS {c}" for c in texts.split()]
    parts += [f"CAST({c} AS INTEGER) AS {c}" for c in flags.split()]
    replace = f" REPLACE ({', '.join(parts)})" if parts else ""
    return f"WITH result AS ({body.strip()}) SELECT *{replace} FROM result"


def query(name: str, ids: str, sql: str | None = None, doubles: str = "", texts: str = "", flags: str = "", digits: int = 6):
    """Register a query; ``sql`` is its DuckDB form before the shared result form."""
    def register(fn):
        if name in _REGISTRY:
            raise ValueError(f"query {name!r} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return finish(fn(spark, sf_dir), digits)

        full = finish_sql(sql, doubles, texts, flags, digits) if sql else None
        _REGISTRY[name] = Query(name, ids, run, full)
        return fn

    return register


def all_queries() -> dict[str, Query]:
    for module in MODULES:
        import_module(f"brineframe.plans.{module}")
    return dict(_REGISTRY)
