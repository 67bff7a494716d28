"""Building blocks that keep the operators whole on skewed data.

One scene, label or query may hold a large part of all rows.  The helpers
here split such a key, combine before each shuffle, and never gather a key
of unknown size in one task.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from geoquarry.session import reliable_checkpoint

#: A group of up to this many values may be held by one exact percentile buffer.
PERCENTILE_ROWS = 2_000_000


def join_facts(left, right, keys, how="inner"):
    """Join many ``left`` rows per key to one ``right`` row per key.

    A hot key is cut by Spark's adaptive skew join, which needs no copies of the
    right side; the session switches it on.
    """
    return left.join(right, list(keys), how)


def running_sums(df, keys, order, sums, descending=False):
    """Running totals of ``sums`` along ``order`` within ``keys``, ties merged.

    Rows that share ``order`` become one row.  These are range-partitioned by keys
    and order, so a group spans as many partitions as its size asks for; each
    partition adds up by itself and is shifted by the totals of those before.
    Output: keys, order, the sums, and ``run_<sum>``.

    The placement is checkpointed, because partition numbers must not be drawn twice.
    """
    direction = F.desc if descending else F.asc
    merged = df.groupBy(*keys, order).agg(*[F.sum(c).alias(c) for c in sums])
    placed = reliable_checkpoint(merged.repartitionByRange(*keys, direction(order)).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each partition that a group reaches
    offsets = placed.groupBy(*keys, "_part").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums]).select(
        *keys, "_part", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums]
    )
    within = Window.partitionBy(*keys, "_part").orderBy(direction(order)).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.select("*", *[F.sum(c).over(within).alias(f"_l_{c}") for c in sums])
    return local.join(offsets, [*keys, "_part"]).select(
        *keys, order, *sums, *[(F.col(f"_l_{c}") + F.col(f"_o_{c}")).alias(f"run_{c}") for c in sums]
    )


def finite(value):
    """True for a number that is neither null, NaN nor infinite."""
    return (
        value.isNotNull()
        & ~F.isnan(value)
        & (F.abs(value) != F.lit(float("inf")))
    )


def block_quantiles(blocks, keys, qs, data="data", big=PERCENTILE_ROWS):
    """Exact interpolated quantiles of the finite values in ``data`` per key.

    Output: keys, ``n``, ``vmin``, ``vmax`` and ``q`` (array in the order of
    ``qs``).  Groups up to ``big`` values use one percentile buffer; larger ones
    go through :func:`running_sums`.
    """
    def unfold(rows):
        return rows.select(*keys, F.explode(data).alias("v")).where(finite(F.col("v")))

    def buffered(values):
        return values.groupBy(*keys).agg(
            F.count("v").alias("n"),
            F.min("v").alias("vmin"),
            F.max("v").alias("vmax"),
            F.percentile("v", F.array(*[F.lit(float(q)) for q in qs])).alias("q"),
        )

    # block sizes alone are read here; most tables have no large group at all
    sizes = blocks.groupBy(*keys).agg(F.sum(F.col("h") * F.col("w")).alias("_size")).where(F.col("_size") > big)
    if sizes.isEmpty():
        return buffered(unfold(blocks))
    tagged = join_facts(blocks, sizes, keys, "left")
    small = buffered(unfold(tagged.where(F.col("_size").isNull())))
    large = unfold(tagged.where(F.col("_size").isNotNull()))
    totals = large.groupBy(*keys).agg(
        F.count("v").alias("n"), F.min("v").alias("vmin"), F.max("v").alias("vmax")
    )
    runs = running_sums(large.withColumn("c", F.lit(1)), keys, "v", ["c"])
    ranked = join_facts(runs, totals, keys)

    def at(rank):
        inside = (F.col("run_c") - F.col("c") <= rank) & (rank < F.col("run_c"))
        return F.max(F.when(inside, F.col("v")))

    picks = []
    for i, q in enumerate(qs):
        position = F.lit(float(q)) * (F.col("n") - 1)
        picks += [at(F.floor(position)).alias(f"_l{i}"), at(F.ceil(position)).alias(f"_h{i}")]
    picked = ranked.groupBy(*keys, "n", "vmin", "vmax").agg(*picks)
    mixed = []
    for i, q in enumerate(qs):
        position = F.lit(float(q)) * (F.col("n") - 1)
        share = position - F.floor(position)
        mixed.append(F.col(f"_l{i}") * (1 - share) + F.col(f"_h{i}") * share)
    big_rows = picked.select(*keys, "n", "vmin", "vmax", F.array(*mixed).alias("q"))
    return small.unionByName(big_rows)


def global_rank(df, column, name="rank"):
    """0-based dense position of each distinct value of ``column`` in sort order.

    Range partitioning sorts the distinct values; the row index inside a
    partition plus the sizes of the partitions before it gives the position.
    The numbered rows are checkpointed because partition numbers must not be
    drawn twice.
    """
    low_bits = 33
    numbered = reliable_checkpoint(
        df.select(column)
        .distinct()
        .repartitionByRange(F.col(column))
        .sortWithinPartitions(column)
        .withColumn("_id", F.monotonically_increasing_id())
    )
    parts = numbered.withColumn("_part", F.shiftright("_id", low_bits))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition, so the unpartitioned window is small
    offsets = parts.groupBy("_part").count().select(
        "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset")
    )
    index = F.col("_id") - F.shiftleft(F.col("_part"), low_bits)
    return parts.join(offsets, "_part").select(
        column, (index + F.col("_offset")).cast("long").alias(name)
    )


def numbered(df, keys, order, name):
    """Add the 0-based number of each row within ``keys`` along ``order``, counted in many tasks.

    Rows are range-partitioned by keys and order, so a hot key spans partitions;
    each partition counts by itself and is shifted by the counts before it.  The
    placement is checkpointed because partition numbers must not be drawn twice.
    """
    placed = reliable_checkpoint(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_c"))
    # one row for each partition that a key reaches
    shifts = counts.select(*keys, "_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy(*keys, "_part").orderBy(*order)
    local = placed.withColumn(name, F.row_number().over(inside) - 1)
    return local.join(shifts, [*keys, "_part"]).withColumn(name, (F.col(name) + F.col("_shift")).cast("long")).select(*df.columns, name)
