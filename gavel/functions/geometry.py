"""Boxes in [0, 1] as structs of x, y, width and height."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), width.alias("width"), height.alias("height"))


def _finite(*cs: Column) -> Column:
    out = F.lit(True)
    for c in cs:
        out = out & c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return out


def valid_bbox(b: Column) -> Column:
    """Finite, of positive size, inside the page."""
    x, y, w, h = (b[k] for k in ("x", "y", "width", "height"))
    return _finite(x, y, w, h) & (x >= 0) & (y >= 0) & (w > 0) & (h > 0) & (x + w <= 1) & (y + h <= 1)


def valid_xyxy(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return _finite(x1, y1, x2, y2) & (x1 >= 0) & (y1 >= 0) & (x2 > x1) & (y2 > y1) & (x2 <= 1) & (y2 <= 1)


def bbox_iou(a: Column, b: Column) -> Column:
    """Intersection over union."""
    w = F.greatest(F.lit(0.0), F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"]))
    h = F.greatest(F.lit(0.0), F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"]))
    return w * h / (a["width"] * a["height"] + b["width"] * b["height"] - w * h)


def bbox_edge_distance(a: Column, b: Column) -> Column:
    """Gap between the edges over the square root of 2; 0 if they touch."""
    dx = F.greatest(F.lit(0.0), a["x"] - (b["x"] + b["width"]), b["x"] - (a["x"] + a["width"]))
    dy = F.greatest(F.lit(0.0), a["y"] - (b["y"] + b["height"]), b["y"] - (a["y"] + a["height"]))
    return F.hypot(dx, dy) / F.sqrt(F.lit(2.0))


def same_area(a: Column, b: Column, most: float) -> Column:
    """Regions (``document_id, document_hash, page, box``) of one page within a gap."""
    return (a["document_id"] == b["document_id"]) & (a["document_hash"] == b["document_hash"]) & (a["page"] == b["page"]) & (bbox_edge_distance(a["box"], b["box"]) <= most)
