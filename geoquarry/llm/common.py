"""Helpers shared by the text operators: tables, words, labelled samples, running sums."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from geoquarry.session import reliable_checkpoint

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shuffle_partitions(spark):
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold_is(column, modulus, remainder):
    """Is crc32 of the id as text, modulo ``modulus``, ``remainder``?  A null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(modulus)) == remainder


def under_own_names(df, columns, run):
    """``run`` on ``df`` under column names that no operator uses, with the new names of ``columns``; the result has the given names again.

    So columns that an operator does not read may have any name.
    """
    safe = [f"given_{i}" for i in range(len(df.columns))]
    return run(df.toDF(*safe), *[safe[df.columns.index(c)] for c in columns]).toDF(*df.columns)


def same(left, right, names):
    """Join condition: equal or both null in every one of ``names``."""
    condition = F.lit(True)
    for name in names:
        condition = condition & left[name].eqNullSafe(right[name])
    return condition


def running_totals(df, group, order, sums):
    """Add ``before_<sum>``: the total of each of ``sums`` over earlier rows of the group.

    Rows are range-partitioned by group and order, so that a large group spans
    many partitions; each partition is summed by itself and shifted by the totals
    of the partitions before it.  The placement is checkpointed, because partition
    numbers must not be drawn twice.  ``group`` may be empty (one running total
    over everything): only one row per partition then meets in a single task.
    """
    placed = reliable_checkpoint(
        df.repartitionByRange(*[F.col(c) for c in (*group, *order)]).withColumn("_at", F.spark_partition_id())
    )
    earlier = Window.partitionBy(*group).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        placed.groupBy(*group, "_at")
        .agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
        .select(
            *[F.col(c).alias(f"_g_{c}") for c in group],
            F.col("_at").alias("_g__at"),
            *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_o_{c}") for c in sums],
        )
    )
    inside = Window.partitionBy(*group, "_at").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_l_{c}") for c in sums])
    match = local["_at"] == shifts["_g__at"]
    for c in group:
        match = match & local[c].eqNullSafe(shifts[f"_g_{c}"])
    return local.join(shifts, match).select(
        *[local[c] for c in df.columns], *[(F.col(f"_l_{c}") + F.col(f"_o_{c}")).alias(f"before_{c}") for c in sums]
    )


def labelled_sample(docs, labels, label, fold, per_class, id_col="doc_id", text_col="text"):
    """A bounded, repeatable sample of labelled whole texts: pandas columns ``text``, ``label``, ``weight``.

    Up to ``per_class`` rows of each of the labels 0 and 1, the first by hash of
    the id, none of them from the held-out ``fold`` (modulus, remainder).  Ids
    labelled twice count by their largest label.  ``weight`` is how many labelled
    rows a row stands for.  Only the chosen ids meet the
    documents, so the broadcast holds at most ``2 * per_class`` rows.
    """
    known = (
        labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_label"))
        .where(F.col("_label").isin(0, 1) & F.col("_id").isNotNull())
        .groupBy("_id").agg(F.max("_label").alias("_label"))
        .where(~fold_is("_id", *fold))
    )
    chosen = None
    for value in (0, 1):
        part = known.where(F.col("_label") == value).orderBy(F.xxhash64("_id"), "_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text"))
    rows = (
        texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))
        .where(F.col("text").isNotNull())
        .select("_id", "text", F.col("_label").alias("label"))
        .toPandas()
    )
    # repeated ids bring further rows: keep the bound, and an order that reruns share
    rows = rows.sort_values(["_id", "text"]).groupby("label").head(per_class)
    totals = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    rows["weight"] = rows["label"].map(lambda y: totals[y]) / rows.groupby("label")["label"].transform("count")
    return rows[["text", "label", "weight"]].reset_index(drop=True)
