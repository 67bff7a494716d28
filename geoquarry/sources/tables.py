"""Parquet table scans."""


def load(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(table, key):
    """Split a scan that arrives in fewer pieces than there are cores.

    Row-by-row work such as pattern matching would otherwise run in one task on
    a small file.  A scan of many files is returned as it is, without a shuffle.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores, key) if len(table.inputFiles()) < cores else table
