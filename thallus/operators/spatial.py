"""Sampling areas."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import utm


def project_utm(points: DataFrame, zone: int = 12, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Adds ``x`` and ``y`` in metres."""
    east, north = utm(F.col(lon), F.col(lat), zone)
    return points.withColumns({"x": east, "y": north})


def _hull(xy: np.ndarray) -> np.ndarray:
    """Corner points counter-clockwise from the lowest-left one (monotone chain)."""
    points = np.unique(xy, axis=0)
    if len(points) < 3:
        return points

    def half(rows) -> list:
        chain: list = []
        for p in rows:
            while len(chain) > 1:
                (ax, ay), (bx, by) = chain[-2], chain[-1]
                if (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax) > 0:
                    break
                chain.pop()
            chain.append(p)
        return chain[:-1]

    return np.array(half(points) + half(points[::-1]))


def convex_hull(df: DataFrame, x: str = "x", y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """Hull corners ``(by, vertex, x, y)`` in order.

    A point inside the hull of any part of its group is inside the group's hull, so every
    batch of a scan is reduced to its corners before anything is shuffled, and again in
    sixteen parts per group before the last step.
    """
    used = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    head = [c for c in used.columns if c in by]
    kinds = dict(used.dtypes)
    keys = "".join(f"`{c}` {kinds[c]}, " for c in head)

    def corners(pdf: pd.DataFrame) -> pd.DataFrame:
        if not head:
            return pd.DataFrame(_hull(pdf[["x", "y"]].to_numpy()), columns=["x", "y"])
        parts = []
        for _, group in pdf.groupby(head, dropna=False, sort=False):
            part = pd.DataFrame(_hull(group[["x", "y"]].to_numpy()), columns=["x", "y"])
            for position, c in enumerate(head):
                part.insert(position, c, [group[c].iloc[0]] * len(part))
            parts.append(part)
        return pd.concat(parts) if parts else pdf.iloc[:0]

    def per_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield corners(pdf)

    def numbered(pdf: pd.DataFrame) -> pd.DataFrame:
        out = corners(pdf)
        out.insert(len(head), "vertex", np.arange(1, len(out) + 1))
        return out

    local = used.mapInPandas(per_batch, keys + "x double, y double")
    spread = local.withColumn("_part", F.pmod(F.xxhash64("x", "y"), F.lit(16)))
    merged = spread.groupBy(*head, "_part").applyInPandas(lambda pdf: corners(pdf[[*head, "x", "y"]]), keys + "x double, y double")
    return merged.groupBy(*head).applyInPandas(numbered, keys + "vertex long, x double, y double")


def hull_area(hull: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area in m² and ha, two decimals, by the shoelace formula over the corner order."""
    around = Window.partitionBy(*by).orderBy("vertex")
    whole = Window.partitionBy(*by).orderBy("vertex").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # relative to one corner: grid coordinates are large against the area
    local = hull.withColumns({"_x": F.col("x") - F.first("x").over(whole), "_y": F.col("y") - F.first("y").over(whole)})
    turned = local.withColumns({
        "_nx": F.coalesce(F.lead("_x").over(around), F.lit(0.0)), "_ny": F.coalesce(F.lead("_y").over(around), F.lit(0.0)),
    })
    area = F.abs(F.sum(F.col("_x") * F.col("_ny") - F.col("_nx") * F.col("_y"))) / 2
    return turned.groupBy(*by).agg(F.round(area, 2).alias("area_m2"), F.round(area / 10000, 2).alias("area_ha"))
