"""Column roles taken from column names: depth bins, wavelengths, prefixes."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from .missing import as_col


def numbered_columns(columns: list[str], prefix: str) -> list[str]:
    """Columns that start with ``prefix`` and end in a digit, in table order."""
    return [c for c in columns if c.startswith(prefix) and c[-1:].isdigit()]


def parse_depth_label(label: str) -> tuple[float, float] | None:
    """``NAME_a_b`` -> (a, b); None where the name does not parse."""
    tokens = label.split("_")
    if len(tokens) < 3:
        return None
    try:
        return float(tokens[-2]), float(tokens[-1])
    except ValueError:
        return None


def depth_bounds(label: Column | str) -> dict[str, Column]:
    """z_start, z_end and z_center columns parsed from a label column."""
    tokens = F.split(as_col(label), "_")
    enough = F.size(tokens) >= 3
    start = F.when(enough, F.get(tokens, F.size(tokens) - 2).try_cast("double"))
    end = F.when(enough, F.get(tokens, F.size(tokens) - 1).try_cast("double"))
    both = start.isNotNull() & end.isNotNull()
    return {
        "z_start": F.when(both, start),
        "z_end": F.when(both, end),
        "z_center": F.when(both, (start + end) / 2),
    }


def sort_by_depth(labels: list[str]) -> list[str]:
    return sorted(labels, key=lambda c: parse_depth_label(c) or (float("inf"), float("inf")))


def wavelengths(columns: list[str]) -> list[float]:
    """Wavelength encoded in the last underscore-separated token of each name."""
    out = []
    for name in columns:
        token = name.rsplit("_", 1)[-1]
        if not re.fullmatch(r"\d+(\.\d+)?", token):
            raise ValueError(f"no wavelength in column name {name!r}")
        out.append(float(token))
    return out


def check_wavelengths(feature_cols: list[str], axis: list[float], consts: dict | None = None, atol: float = 0.01) -> list[str]:
    """Non-constant features, after checking that they line up with the wavelength axis."""
    spectral = [c for c in feature_cols if c not in (consts or {})]
    if len(spectral) != len(axis):
        raise ValueError(f"{len(spectral)} spectral features for {len(axis)} wavelengths")
    for name, named, actual in zip(spectral, wavelengths(spectral), axis):
        if abs(named - actual) > atol + 1e-5 * abs(actual):
            raise ValueError(f"feature {name!r} does not match wavelength {actual}")
    return spectral
