"""Boxes: parsing, normalising, IoU, best detection, GeoJSON."""

from pyspark.sql import functions as F

from geoquarry.functions.geo import ring
from geoquarry.operators.spatial import BOUND, CORNERS, sweep_pairs

GRID = 100.0
LABEL = "Detected Region"


def clean_label(label, fallback):
    """The fallback for a missing, blank or all-digit label."""
    text = F.trim(label.cast("string"))
    return F.when(label.isNull() | (text == "") | text.rlike("^[0-9]+$"), fallback).otherwise(text)


def norm_boxes(rows, fallback):
    """[ymin, xmin, ymax, xmax] with ordered corners and a usable label."""
    return rows.select(
        "image_id", "ord", "item",
        clean_label(F.col("label"), fallback).alias("label"),
        F.least("ymin", "ymax").alias("ymin"), F.least("xmin", "xmax").alias("xmin"),
        F.greatest("ymin", "ymax").alias("ymax"), F.greatest("xmin", "xmax").alias("xmax"),
        F.coalesce("score", F.lit(0.0)).alias("confidence"),
    )


def parse_ref_box(raw, w, h):
    """Grid text ``{<x1><y1><x2><y2>}`` as a pixel struct, null unless four numbers."""
    v = F.transform(F.regexp_extract_all(raw, F.lit("<([0-9]+)>"), F.lit(1)), lambda t: t.cast("double"))
    at = lambda i, size: v[i] / GRID * size
    return F.when(F.size(v) == 4, F.struct(
        at(1, h).alias("ymin"), at(0, w).alias("xmin"), at(3, h).alias("ymax"), at(2, w).alias("xmax")))


def iou(a, b):
    """Shared area over joined area, 0 when the joined area is not positive."""
    width = F.greatest(F.lit(0.0), F.least(a["xmax"], b["xmax"]) - F.greatest(a["xmin"], b["xmin"]))
    height = F.greatest(F.lit(0.0), F.least(a["ymax"], b["ymax"]) - F.greatest(a["ymin"], b["ymin"]))
    area = lambda s: (s["xmax"] - s["xmin"]) * (s["ymax"] - s["ymin"])
    shared = width * height
    union = area(a) + area(b) - shared
    return F.when(union > 0, shared / union).otherwise(0.0)


def corners(alias=""):
    return F.struct(*[F.col(f"{alias}{c}").alias(c) for c in ("ymin", "xmin", "ymax", "xmax")])


def box_iou(predicted, reference, keys=("image_id", "ord", "item")):
    """IoU of each predicted box with the reference box of the same item."""
    keys = list(keys)
    a = predicted.select(*keys, corners().alias("a"))
    b = reference.select(*keys, F.col("box").alias("b"))
    return a.join(b, keys).select(*keys, iou(F.col("a"), F.col("b")).alias("iou"))


def overlapping_boxes(detections, bound=BOUND, order=("ord", "item")):
    """All pairs of boxes of one image that share an area, with their IoU, by plane sweep.

    ``a`` and ``b`` are the ``order`` columns of both boxes as structs, ``a`` the
    lesser.  An image of more than ``bound`` boxes is swept in strips.  Boxes
    without extent or with a missing corner overlap none.
    """
    rows = detections.select("image_id", F.struct(*order).alias("id"), *CORNERS, F.lit(0).alias("role"))
    shared = (F.col("right") - F.col("left")) * (F.col("top") - F.col("bottom"))
    return sweep_pairs(rows, ["image_id"], bound).select(
        "image_id", "a", "b", (shared / (F.col("area_a") + F.col("area_b") - shared)).alias("iou")
    )


def best_box(detections, order=("ord", "item")):
    """Highest confidence per image, first one on a tie, and the box count (L2)."""
    first = F.struct((-F.col("confidence")).alias("c"), *order, "label", corners().alias("box"))
    return detections.groupBy("image_id").agg(F.min(first).alias("b"), F.count(F.lit(1)).alias("n")).select(
        "image_id", "n", (-F.col("b.c")).alias("confidence"), F.col("b.label").alias("label"), F.col("b.box").alias("box")
    )


def first_box(detections, order=("ord", "item")):
    """First detection per image, the one that is scored (L2)."""
    first = F.struct(*order, "label", "confidence", corners().alias("box"))
    return detections.groupBy("image_id").agg(F.min(first).alias("b")).select(
        "image_id", F.col("b.label").alias("label"), F.col("b.confidence").alias("confidence"), F.col("b.box").alias("box")
    )


def first_iou(detections, referring):
    """IoU of each image's first detection with its first referring box.

    Rows that tie in ``ord`` and ``item`` are taken by their corners, a missing box first.
    ``referring`` has ``image_id, ord, item, box``; an image whose first referring
    row has no usable box, or that has no detection, is left out.
    """
    first = referring.groupBy("image_id").agg(F.min(F.struct("ord", "item", "box")).alias("r")).select("image_id", F.col("r.box").alias("ref"))
    rows = first_box(detections).join(first.where("ref is not null"), "image_id")
    return rows.select("image_id", iou(F.col("box"), F.col("ref")).alias("iou"))


def to_geojson(x1, y1, x2, y2):
    """Feature text with a closed outline."""
    return F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit(LABEL).alias("label")).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring(x1, y1, x2, y2)).alias("coordinates")).alias("geometry"),
    ))


def write_geojson(features, path, column="feature"):
    """One feature per line."""
    features.select(F.col(column).alias("value")).write.mode("overwrite").text(path)
