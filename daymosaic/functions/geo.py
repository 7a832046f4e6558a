"""Grid cells and the ellipsoidal cylindrical equal-area projection.

Formulas: Snyder, "Map Projections: A Working Manual" (1987), section 10.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS 84 semi-major axis (m), inverse flattening, and the standard
# parallel of the global equal-area grid.
SEMI_MAJOR = 6378137.0
INVERSE_FLATTENING = 298.257223563
STANDARD_PARALLEL = 30.0

_F = 1.0 / INVERSE_FLATTENING
E2 = 2.0 * _F - _F * _F
E1 = math.sqrt(E2)
_S = math.sin(math.radians(STANDARD_PARALLEL))
K0 = math.cos(math.radians(STANDARD_PARALLEL)) / math.sqrt(1.0 - E2 * _S * _S)


def _q_number(s: float) -> float:
    return (1.0 - E2) * (s / (1.0 - E2 * s * s)
                         - math.log((1.0 - E1 * s) / (1.0 + E1 * s)) / (2.0 * E1))


Q_POLE = _q_number(1.0)
X_SCALE = SEMI_MAJOR * K0 * math.pi / 180.0
Y_SCALE = SEMI_MAJOR / (2.0 * K0)
# Series coefficients of the authalic to geodetic latitude.
A2 = E2 / 3.0 + 31.0 * E2 ** 2 / 180.0 + 517.0 * E2 ** 3 / 5040.0
A4 = 23.0 * E2 ** 2 / 360.0 + 251.0 * E2 ** 3 / 3780.0
A6 = 761.0 * E2 ** 3 / 45360.0


def metric_x(lon: Column) -> Column:
    """Easting in metres."""
    return lon * F.lit(X_SCALE)


def metric_y(lat: Column) -> Column:
    """Northing in metres."""
    s = F.sin(F.radians(lat))
    q = F.lit(1.0 - E2) * (
        s / (F.lit(1.0) - F.lit(E2) * s * s)
        - F.ln((F.lit(1.0) - F.lit(E1) * s) / (F.lit(1.0) + F.lit(E1) * s)) / F.lit(2.0 * E1))
    return F.lit(Y_SCALE) * q


def latitude_of(y: Column) -> Column:
    """Inverse of metric_y, in degrees."""
    b = F.asin(y / F.lit(Y_SCALE) / F.lit(Q_POLE))
    return F.degrees(b + F.lit(A2) * F.sin(F.lit(2.0) * b) + F.lit(A4) * F.sin(F.lit(4.0) * b)
                     + F.lit(A6) * F.sin(F.lit(6.0) * b))


def grid_index(x: Column, resolution: float) -> Column:
    return F.floor(x / F.lit(resolution)).cast("bigint")


def cell_id(region: Column, gx: Column, gy: Column) -> Column:
    """Region-scoped cell name: the same square in two regions is two cells."""
    return F.concat_ws("|", region, gx.cast("string"), gy.cast("string"))


def cell_box(gx: Column, gy: Column, resolution: float) -> dict[str, Column]:
    r = F.lit(resolution)
    return {"x0": gx * r, "y0": gy * r, "x1": (gx + 1) * r, "y1": (gy + 1) * r}


def cell_centroid(gx: Column, gy: Column, resolution: float) -> tuple[Column, Column]:
    """Centre of the cell in the metric plane, given back as lon, lat."""
    box = cell_box(gx, gy, resolution)
    mid_y = (metric_y(box["y0"]) + metric_y(box["y1"])) / 2
    return (box["x0"] + box["x1"]) / 2, latitude_of(mid_y)
