"""Rectangles as structs of x0, y0, x1, y1 (doubles); all functions are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(r: Column) -> Column:
    return (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])


def intersection(a: Column, b: Column) -> Column:
    """Area that two rectangles share; 0 if they only touch."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def overlap_ratio(a: Column, b: Column) -> Column:
    """Share of a that b covers; 0 if a has no area."""
    return F.when(area(a) > 0, intersection(a, b) / area(a)).otherwise(0.0)


def gaps(a: Column, b: Column) -> tuple[Column, Column]:
    zero = F.lit(0.0)
    dx = F.greatest(zero, F.greatest(a["x0"], b["x0"]) - F.least(a["x1"], b["x1"]))
    dy = F.greatest(zero, F.greatest(a["y0"], b["y0"]) - F.least(a["y1"], b["y1"]))
    return dx, dy


def chebyshev_gap(a: Column, b: Column) -> Column:
    """Larger of the two distances between rectangles."""
    return F.greatest(*gaps(a, b))


def euclidean_gap(a: Column, b: Column) -> Column:
    """Least distance between rectangles."""
    return F.hypot(*gaps(a, b))


def x_overlap(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))


def union(a: Column, b: Column) -> Column:
    return F.struct(
        F.least(a["x0"], b["x0"]).alias("x0"), F.least(a["y0"], b["y0"]).alias("y0"),
        F.greatest(a["x1"], b["x1"]).alias("x1"), F.greatest(a["y1"], b["y1"]).alias("y1"),
    )


def union_agg(r: str) -> Column:
    """Aggregate: the rectangle around all of a group."""
    return F.struct(
        F.min(f"{r}.x0").alias("x0"), F.min(f"{r}.y0").alias("y0"), F.max(f"{r}.x1").alias("x1"), F.max(f"{r}.y1").alias("y1")
    )


def center_inside(line: Column, figure: Column, mx: float = 2.0, my: float = 2.0) -> Column:
    cx, cy = (line["x0"] + line["x1"]) * 0.5, (line["y0"] + line["y1"]) * 0.5
    return cx.between(figure["x0"] - mx, figure["x1"] + mx) & cy.between(figure["y0"] - my, figure["y1"] + my)


def clusters_1d(xs: Column, tol: float) -> Column:
    """Means of chains of sorted values whose neighbours are at most ``tol`` apart (W07). array<double>."""
    start = F.array().cast("array<struct<last:double,total:double,n:int>>")

    def step(acc: Column, x: Column) -> Column:
        return F.when(
            (F.size(acc) > 0) & (x - F.try_element_at(acc, F.lit(-1))["last"] <= tol),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(F.struct(x.alias("last"), (F.try_element_at(acc, F.lit(-1))["total"] + x).alias("total"), (F.try_element_at(acc, F.lit(-1))["n"] + 1).alias("n"))),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(x.alias("last"), x.alias("total"), F.lit(1).alias("n")))))

    return F.transform(F.aggregate(F.array_sort(xs), start, step), lambda c: c["total"] / c["n"])
