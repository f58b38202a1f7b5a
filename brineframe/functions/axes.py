"""Coordinate axes: regular latitude/longitude grids, depth bins, tiles.

Axis labels are floats, so tables are always joined on the integer index; the
label is derived from it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from .missing import as_col
from .names import parse_depth_label

# Fixed values of the published product grid.
PRODUCT_STEP = 0.041666668
PRODUCT_NLAT = 4320
PRODUCT_NLON = 8640
PRODUCT_NZ = 20
PRODUCT_BIN_M = 10.0
TILE_EDGE = 480


@dataclass(frozen=True)
class RegularAxis:
    """``label = origin + idx * step``; a negative step is a descending axis.

    ``size`` may be a Column (a scalar subquery) when it is known only from data.
    """

    origin: float
    step: float
    size: int | Column

    def label(self, idx: Column | str) -> Column:
        return F.lit(self.origin) + as_col(idx) * F.lit(self.step)

    def nearest(self, q: Column | str, tie: str = "larger") -> Column:
        """Index of the nearest label, clamped to the axis.

        tie="larger": the larger label wins; tie="left": the earlier position wins.
        """
        pos = (as_col(q).cast("double") - F.lit(self.origin)) / F.lit(self.step)
        if tie == "left" or (tie == "larger" and self.step < 0):
            idx = F.ceil(pos - F.lit(0.5))
        elif tie == "larger":
            idx = F.floor(pos + F.lit(0.5))
        else:
            raise ValueError(f"unknown tie rule {tie!r}")
        last = self.size - 1 if isinstance(self.size, Column) else F.lit(self.size - 1)
        return F.greatest(F.lit(0), F.least(last, idx)).cast("int")

    def within(self, idx: Column | str, lo: float, hi: float) -> Column:
        """Label range, inclusive at both ends, stated on the index.

        A plain comparison on the stored index column reaches the Parquet scan.
        """
        first, last = sorted(((lo - self.origin) / self.step, (hi - self.origin) / self.step))
        eps = 1e-9
        return as_col(idx).between(F.lit(_ceil(first - eps)), F.lit(_floor(last + eps)))


def _ceil(x: float) -> int:
    return -int(-x // 1)


def _floor(x: float) -> int:
    return int(x // 1)


@dataclass(frozen=True)
class DepthAxis:
    """Ordered depth bins. At most a few dozen entries, so expressions unroll over it."""

    starts: tuple[float | None, ...]
    ends: tuple[float | None, ...]
    centers: tuple[float | None, ...]

    @classmethod
    def uniform(cls, n: int = PRODUCT_NZ, width: float = PRODUCT_BIN_M) -> DepthAxis:
        starts = tuple(width * i for i in range(n))
        ends = tuple(s + width for s in starts)
        return cls(starts, ends, tuple((a + b) / 2 for a, b in zip(starts, ends)))

    @classmethod
    def from_labels(cls, labels: list[str], centers: list[float] | None = None) -> DepthAxis:
        bounds = [parse_depth_label(label) or (None, None) for label in labels]
        if centers is not None and len(centers) != len(labels):
            raise ValueError(f"{len(centers)} centers given for {len(labels)} labels")
        mids = tuple(centers) if centers is not None else tuple(
            None if a is None else (a + b) / 2 for a, b in bounds
        )
        return cls(tuple(a for a, _ in bounds), tuple(b for _, b in bounds), mids)

    def __len__(self) -> int:
        return len(self.centers)

    @property
    def thickness(self) -> tuple[float, ...]:
        """Bin thickness; a bin without bounds counts as the nominal 10 m."""
        return tuple(
            PRODUCT_BIN_M if a is None or b is None else b - a for a, b in zip(self.starts, self.ends)
        )

    def nearest_start(self, q: float) -> int:
        """Position of the bin whose lower bound is nearest; the first wins a tie."""
        known = [(abs(s - q), i) for i, s in enumerate(self.starts) if s is not None]
        if not known:
            raise ValueError("the axis has no lower bounds")
        return min(known)[1]

    def literal(self, values: tuple[float | None, ...] | None = None) -> Column:
        """The bin centres (or other per-bin values) as an array constant."""
        items = ("double(null)" if v is None else f"{float(v)!r}D" for v in (values or self.centers))
        return F.expr(f"array({', '.join(items)})")


def tile_id(lat_idx: Column | str, lon_idx: Column | str, edge: int = TILE_EDGE, n_lon: int = PRODUCT_NLON) -> Column:
    """Row-major tile number; the range key of the cube layout."""
    per_row = -(-n_lon // edge)
    row = F.floor(as_col(lat_idx) / F.lit(edge))
    col = F.floor(as_col(lon_idx) / F.lit(edge))
    return (row * F.lit(per_row) + col).cast("int")


def morton_key(lat_idx: Column | str, lon_idx: Column | str) -> Column:
    """Interleaved bits of two cell indices (up to 65,535 each): neighbours in the grid lie close in this order."""
    def spread(x: Column) -> Column:
        x = as_col(x).cast("long")
        for shift, keep in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(keep).cast("long"))
        return x

    return F.shiftleft(spread(lat_idx), 1).bitwiseOR(spread(lon_idx))


def fold_lon(lon: Column | str) -> Column:
    """Fold degrees east to [-180, 180)."""
    return F.pmod(as_col(lon) + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)
