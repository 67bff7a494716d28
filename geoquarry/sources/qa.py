"""Question, answer and annotation files."""

from pyspark.sql import functions as F


def read_split(spark, path, key, schema, whole_files=True):
    """Active entries of a wrapped file ``{"<key>": [...]}``.

    ``schema`` is the element type as DDL; a missing ``active`` counts as on.
    ``whole_files=False`` reads one wrapped object per line.
    """
    rows = spark.read.schema(f"{key} array<struct<{schema}>>").json(path, multiLine=whole_files)
    items = rows.select(F.explode(key).alias("item")).select("item.*")
    return items.where(F.coalesce("active", F.lit(True))) if "active" in items.columns else items


def read_annotations(spark, path, schema, whole_files=True):
    """Flat JSON arrays, or one object per line."""
    return spark.read.schema(schema).json(path, multiLine=whole_files)


def read_captions(spark, path):
    """Caption rows with the three columns they need."""
    return spark.read.parquet(path).where("type = 'captioning'").select("patch_id", "type", "output")


def read_patches(spark, path):
    """Patch metadata."""
    return spark.read.parquet(path)
