"""File listings, manifests and target lists."""

import hashlib
import re
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import functions as F

REQUIRED = ["dataset", "split", "tier", "root", "source_urls", "retrieved_utc"]
MANIFEST = (
    "dataset string, split string, tier string, root string, source_urls array<string>, retrieved_utc string, "
    "files array<struct<path:string,bytes:bigint,sha256:string>>, counts map<string,bigint>, notes string, "
    "schema_version int, file_count bigint, total_bytes bigint"
)


#: Files up to this size come whole through Spark's reader; larger ones are read in pieces of CHUNK bytes.
WHOLE, CHUNK = 256 << 20, 1 << 20


def list_files(spark, pattern, root=None, whole=WHOLE):
    """Path, size and SHA-256 of every matching file, of any size.

    ``root`` is a folder name; what is before and in it is cut from the paths.  The
    listing reads no content.  A file above ``whole`` bytes, which Spark's
    reader would hold in one row, is hashed in pieces by the task it falls to
    (:func:`digests`).
    """
    found = spark.read.format("binaryFile").load(pattern)
    small = found.where(F.col("length") <= whole).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    large = digests(found.where(F.col("length") > whole).select("path", F.col("length").alias("bytes")))
    # the index of all files is with the driver in any case
    every = spark.createDataFrame([(unquote(p),) for p in found.inputFiles()], "path string")
    same = lambda c: F.regexp_replace(c, "^([a-z]+):/*", "$1:/")
    seen = found.select(same("path").alias("seen"))
    empty = every.join(seen, same("path") == F.col("seen"), "left_anti").select(same("path").alias("path"), F.lit(0).cast("long").alias("bytes"), F.sha2(F.lit("").cast("binary"), 256).alias("sha256"))
    rows = small.unionByName(large).unionByName(empty)
    path = F.col("path") if root is None else F.regexp_replace("path", f"^.*{re.escape(root)}/", "")
    return rows.withColumn("path", path)


def digests(files, chunk=CHUNK):
    """Add ``sha256`` to files (``path, bytes``), each read through one running hash in pieces of ``chunk`` bytes.

    Files are dealt out by path, so large ones fall to different tasks.  Any store that Arrow's
    file systems open will do; a file whose size changed since the listing fails.
    """

    def run(batches):
        for batch in batches:
            sums = []
            for path, size in zip(batch.column("path").to_pylist(), batch.column("bytes").to_pylist()):
                seen, digest = 0, hashlib.sha256()
                with opened(path) as stream:
                    while piece := stream.read(chunk):
                        seen += len(piece)
                        digest.update(piece)
                if seen != size:
                    raise ValueError(f"{path} has {seen} bytes, {size} were listed")
                sums.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.string())], names=["path", "bytes", "sha256"])

    return files.select("path", "bytes").repartition("path").mapInArrow(run, "path string, bytes long, sha256 string")


def opened(path):
    """An input stream of a path as Spark lists it."""
    from pyarrow import fs

    if path.startswith("file:"):
        # listed paths are plain text, not encoded
        return fs.LocalFileSystem().open_input_stream(re.sub("^file:/*", "/", path))
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_stream(inner)


def write_manifests(header, files, path):
    """Headers as JSON lines and file entries as a table beside them.

    A dataset of any size is written by many tasks.
    """
    totals = files.groupBy("dataset").agg(F.count(F.lit(1)).alias("file_count"), F.sum("bytes").alias("total_bytes"))
    header.join(totals, "dataset", "left").write.mode("overwrite").json(f"{path}/headers")
    files.select("dataset", "path", "bytes", "sha256").write.mode("overwrite").parquet(f"{path}/files")


def parse_manifests(rows, text="value"):
    """Manifest structs from JSON text: unknown fields dropped, missing required
    ones named in ``error`` (S11)."""
    keys = F.json_object_keys(F.col(text))
    missing = F.array_except(F.array(*[F.lit(k) for k in REQUIRED]), keys)
    return rows.select(
        F.from_json(text, MANIFEST).alias("m"),
        F.when(F.size(missing) > 0, F.concat(F.lit("manifest missing required field(s): "), F.array_join(missing, ","))).alias("error"),
    ).select("m.*", "error")


def read_manifests(spark, path):
    """Headers and file entries of :func:`write_manifests`."""
    return parse_manifests(spark.read.text(f"{path}/headers")), spark.read.parquet(f"{path}/files")


def read_manifest_documents(spark, path):
    """Headers and file entries of one-document manifests, one file each."""
    headers = parse_manifests(spark.read.text(path, wholetext=True))
    return headers.drop("files"), headers.select("dataset", F.explode("files").alias("f")).select("dataset", "f.*")


def write_targets(targets, path):
    """Target rows in folder partitions with a count sidecar."""
    targets.repartitionByRange("s2_folder", "patch_id").sortWithinPartitions("s2_folder", "patch_id").write.mode(
        "overwrite").parquet(f"{path}/patches")
    targets.groupBy("s2_folder", "s1_folder").agg(F.count(F.lit(1)).alias("patches")).write.mode("overwrite").json(
        f"{path}/folders")


def read_targets(spark, path, root="images"):
    """Target rows with resolved folder paths."""
    side = lambda c, s: F.concat_ws("/", F.lit(f"{root}/BigEarthNet-{s}"), c)
    return spark.read.parquet(f"{path}/patches").withColumns(
        {"s2_path": side("s2_folder", "S2"), "s1_path": side("s1_folder", "S1")})


def write_metrics(metrics, path):
    """Metric rows by suite."""
    metrics.write.mode("overwrite").partitionBy("suite").parquet(path)
