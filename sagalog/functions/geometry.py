"""Affine maps, boxes, panel adjacency and colour arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Matrix = tuple[Column, Column, Column, Column, Column, Column]
TOLERANCE = 2.0


def concat_affine(m: Matrix, n: Matrix) -> Matrix:
    """m applied first, then n."""
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return (a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u)


def unit_box(m: Matrix) -> dict[str, Column]:
    """Bounding box of the unit square's image."""
    a, b, c, d, e, f = m
    xs, ys = (e, a + e, c + e, a + c + e), (f, b + f, d + f, b + d + f)
    x, y = F.least(*xs), F.least(*ys)
    return {"bbox_x": x, "bbox_y": y, "bbox_w": F.greatest(*xs) - x, "bbox_h": F.greatest(*ys) - y}


def _near(a: Column, b: Column, tol: float) -> Column:
    return F.abs(a - b) <= tol


def adjacency(a: str, b: str, tol: float = TOLERANCE) -> Column:
    """"vertical", "horizontal" or null for two boxes with the column prefixes ``a`` and ``b``."""
    ax, ay, aw, ah = (F.col(f"{a}bbox_{k}") for k in "xywh")
    bx, by, bw, bh = (F.col(f"{b}bbox_{k}") for k in "xywh")
    x_same = _near(ax, bx, tol) & _near(ax + aw, bx + bw, tol)
    y_same = _near(ay, by, tol) & _near(ay + ah, by + bh, tol)
    y_abut = _near(ay, by + bh, tol) | _near(by, ay + ah, tol)
    x_abut = _near(ax, bx + bw, tol) | _near(bx, ax + aw, tol)
    return F.when(x_same & y_abut, "vertical").when(y_same & x_abut, "horizontal")


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> dict[str, Column]:
    """Integer approximation on 0 .. 255."""
    return {n: F.floor((255 - v) * (255 - k) / 255).cast("int") for n, v in (("r", c), ("g", m), ("b", y))}
