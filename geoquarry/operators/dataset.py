"""Dataset assembly: folders, pairing, verification, summaries, manifests
(P15, P16, J5-J7, W1, A16, A19-A21, F15, F16, L5, U4)."""

from pyspark.sql import functions as F

from geoquarry.operators.scale import global_rank

# Bands, archive sizes, patch sizes, splits.
S2_BANDS = ["B01", "B02", "B03", "B04", "B05", "B06", "B07", "B08", "B8A", "B09", "B11", "B12"]
S1_BANDS = ["VV", "VH"]
S2_ARCHIVE_BYTES, S1_ARCHIVE_BYTES = 63_251_710_377, 54_439_153_171
S2_PATCH_BYTES, S1_PATCH_BYTES = 165_000, 116_000
SPLITS = ["train", "validation", "test"]
DEFAULT_K = 10


def s2_folder(patch_id):
    """Acquisition folder of a patch: without row and column."""
    return F.regexp_replace(patch_id, "(_[^_]*){2}$", "")


def s1_folder(name):
    """Acquisition folder of a radar patch: without tile, row and column."""
    return F.regexp_replace(name, "(_[^_]*){3}$", "")


def with_folders(patches):
    return patches.withColumns({"s2_folder": s2_folder(F.col("patch_id")), "s1_folder": s1_folder(F.col("s1_name"))})


def split_rows(rows, name):
    """Rows of one official split."""
    if name not in SPLITS:
        raise ValueError(f"split must be one of {SPLITS}; got {name!r}")
    return rows.where(F.col("split") == name)


def active_rows(rows):
    """Rows not switched off; a missing flag counts as on."""
    return rows.where(F.coalesce("active", F.lit(True)))


def filter_annotations(rows, **wanted):
    """Keep listed values per column; None keeps all."""
    for column, values in wanted.items():
        if values is not None:
            rows = rows.where(F.col(column).isin(list(values)))
    return rows


def folder_ranks(rows, column):
    """Alphabetical position of each distinct folder."""
    return global_rank(rows, column)


def first_folders(rows, column, k):
    """The first k folders by name; at most k rows."""
    return rows.select(column).distinct().orderBy(column).limit(k)


def _mark(rows, column, k, flag):
    chosen = first_folders(rows, column, k).withColumn(flag, F.lit(True))
    # k rows, so the broadcast is bounded by the parameter
    return rows.join(F.broadcast(chosen), column, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def mark_targets(patches, k=DEFAULT_K, k1=None):
    """Flag rows within the first folders of each archive."""
    k1 = k if k1 is None else k1
    return _mark(_mark(with_folders(patches), "s2_folder", k, "in_s2"), "s1_folder", k1, "in_s1")


def pair_targets(patches, k=DEFAULT_K, k1=None):
    """Rows selected on both sides."""
    return mark_targets(patches, k, k1).where(F.col("in_s2") & F.col("in_s1")).drop("in_s2", "in_s1")


def candidate_counts(patches, k=DEFAULT_K, k1=None):
    """Candidates per side and pairs."""
    count = lambda c: F.count(F.when(c, 1))
    return mark_targets(patches, k, k1).agg(
        count(F.col("in_s2")).alias("candidates_s2"), count(F.col("in_s1")).alias("candidates_s1"),
        count(F.col("in_s2") & F.col("in_s1")).alias("paired"),
    )


def expected_files(targets):
    """The fourteen band files of each patch (F16): (key, side, band, path)."""
    entry = lambda side, folder, name, band: F.struct(
        F.lit(side).alias("side"), F.lit(band).alias("band"),
        F.concat_ws("/", F.lit(f"BigEarthNet-{side}"), folder, name, F.concat(name, F.lit(f"_{band}.tif"))).alias("path"))
    c = F.col
    parts = [entry("S2", c("s2_folder"), c("patch_id"), b) for b in S2_BANDS]
    parts += [entry("S1", c("s1_folder"), c("s1_name"), b) for b in S1_BANDS]
    return targets.select("key", "patch_id", "s1_name", F.explode(F.array(*parts)).alias("f")).select(
        "key", "patch_id", "s1_name", "f.*"
    )


#: All bands of both sides; a folder's bands are a number with a bit for each.
BANDS = S2_BANDS + S1_BANDS


def _bits(bands):
    return sum(1 << BANDS.index(b) for b in bands)


def _band_sets(listing):
    """Bands found in each folder of files called like the folder: (dir, bands), one bit a band."""
    file = F.substring_index("path", "/", -1)
    rows = listing.select(file.alias("file"), F.expr("substring(path, 1, length(path) - length(substring_index(path, '/', -1)) - 1)").alias("dir"))
    name = F.substring_index("dir", "/", -1)
    found = rows.where(F.col("file").startswith(F.concat(name, F.lit("_"))) & F.col("file").endswith(".tif"))
    band = F.expr("substring(file, length(substring_index(dir, '/', -1)) + 2, length(file) - length(substring_index(dir, '/', -1)) - 5)")
    bit = F.expr("CASE band " + " ".join(f"WHEN '{b}' THEN {1 << i}" for i, b in enumerate(BANDS)) + " ELSE 0 END")
    return found.select("dir", band.alias("band")).select("dir", bit.alias("bit")).groupBy("dir").agg(F.bit_or("bit").alias("bands"))


def verify_pairs(targets, listing):
    """Missing files per side of each patch; kept when nothing is missing.

    The listing becomes a number per folder; a patch meets its two numbers, and
    no path of a file is made or shuffled for it.
    """
    sets = _band_sets(listing)
    place = lambda side, folder, name: F.concat_ws("/", F.lit(f"BigEarthNet-{side}"), folder, name)
    rows = targets.select(
        "key", "patch_id", "s1_name",
        place("S2", F.col("s2_folder"), F.col("patch_id")).alias("_d2"), place("S1", F.col("s1_folder"), F.col("s1_name")).alias("_d1"),
    )
    for side in "21":
        rows = rows.join(sets.select(F.col("dir").alias(f"_d{side}"), F.col("bands").alias(f"_b{side}")), f"_d{side}", "left")
    gone = lambda bands, have: F.bit_count(F.lit(_bits(bands)).bitwiseAND(F.bitwise_not(F.coalesce(have, F.lit(0))))).cast("long")
    return rows.select(
        "key", "patch_id", "s1_name", gone(S2_BANDS, F.col("_b2")).alias("missing_s2_bands"), gone(S1_BANDS, F.col("_b1")).alias("missing_s1_bands")
    ).withColumn("kept", (F.col("missing_s2_bands") + F.col("missing_s1_bands")) == 0)


def summarize(patches):
    """Counts per split and country, and classes covered."""
    counts = patches.groupingSets([["split"], ["country"]], "split", "country").agg(F.count(F.lit(1)).alias("n"))
    kind = F.when(F.col("split").isNotNull(), "split").otherwise("country")
    rows = counts.select(kind.alias("kind"), F.coalesce("split", "country").alias("name"), "n")
    classes = patches.select(F.explode("labels").alias("label")).groupBy("label").count()
    return rows.unionByName(classes.select(F.lit("class").alias("kind"), F.col("label").alias("name"), F.col("count").alias("n")))


#: Buckets of a kept distinct-count sketch, as a power of two; the relative error is about 1.04 / sqrt(buckets).
SKETCH_BITS = 12


def sketches(patches, values=("patch_id", "key")):
    """Row counts and mergeable distinct-count sketches per split and country.

    One row for each (kind, name): ``n`` and, for each of ``values``, a sketch as bytes,
    to be stored and merged with later ones by :func:`merged`.  Splits and
    countries come from one pass.
    """
    parts = patches.groupingSets([["split"], ["country"]], "split", "country").agg(
        F.count(F.lit(1)).alias("n"), *[F.hll_sketch_agg(v, SKETCH_BITS).alias(v) for v in values])
    kind = F.when(F.col("split").isNotNull(), "split").otherwise("country")
    return parts.select(kind.alias("kind"), F.coalesce("split", "country").alias("name"), "n", *values)


def merged(kept, batch, values=("patch_id", "key")):
    """Kept sketches with those of a new batch folded in; the rows behind the kept ones are not read."""
    both = kept.select("kind", "name", "n", *values).unionByName(batch.select("kind", "name", "n", *values))
    return both.groupBy("kind", "name").agg(F.sum("n").alias("n"), *[F.hll_union_agg(v).alias(v) for v in values])


def distinct_counts(kept, values=("patch_id", "key")):
    """Counts of kept sketches: ``n`` and the estimated distinct number of each of ``values``."""
    return kept.select("kind", "name", "n", *[F.hll_sketch_estimate(v).alias(v) for v in values])


def class_coverage(patches):
    """The union of all label lists (U4): a set as small as the vocabulary."""
    return patches.select(F.explode("labels").alias("label")).distinct().agg(
        F.array_sort(F.collect_list("label")).alias("classes")
    ).select(F.array_join("classes", "|").alias("classes_covered"), F.size("classes").alias("classes_covered_count"))


def project_bytes(patches, k=DEFAULT_K, k1=None):
    """Bytes streamed and stored for a choice of folders."""
    k1 = k if k1 is None else k1
    marked = mark_targets(patches, k, k1)
    sums = marked.agg(
        F.countDistinct("s2_folder").alias("n2"), F.countDistinct("s1_folder").alias("n1"),
        F.count(F.when(F.col("in_s2") & F.col("in_s1"), 1)).alias("paired"),
    )
    part = lambda k, n: F.least(F.lit(k), F.col(n)) / F.col(n)
    streamed = part(k, "n2") * S2_ARCHIVE_BYTES + part(k1, "n1") * S1_ARCHIVE_BYTES
    return sums.select(
        "paired", F.floor(streamed).alias("streamed_bytes"),
        (F.col("paired") * (S2_PATCH_BYTES + S1_PATCH_BYTES)).alias("stored_bytes"),
    )


def manifest_header(files, counts=None):
    """File count, bytes and free counts per dataset.

    ``counts`` has ``dataset, name, value``, a handful of rows per dataset.
    """
    header = files.groupBy("dataset").agg(F.count(F.lit(1)).alias("file_count"), F.sum("bytes").alias("total_bytes"))
    if counts is None:
        return header
    maps = counts.groupBy("dataset").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("counts"))
    return header.join(maps, "dataset", "left")


def verify_manifest(expected, actual, headers=None, fast=False):
    """PASS, FAIL or NOT_DOWNLOADED per dataset, with problem counts.

    ``fast`` skips hashes; ``headers`` (dataset, file_count, total_bytes) are
    compared with the sums of the entries.
    """
    a = expected.select("dataset", "path", "bytes", "sha256")
    b = actual.select("dataset", "path", F.col("bytes").alias("found_bytes"), F.col("sha256").alias("found_sha"))
    rows = a.join(b, ["dataset", "path"], "left")
    there = F.col("found_bytes").isNotNull()
    size_off = there & (F.col("found_bytes") != F.col("bytes"))
    hash_off = F.lit(False) if fast else there & ~size_off & (F.col("found_sha") != F.col("sha256"))
    count = lambda c: F.count(F.when(c, 1))
    sums = rows.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("files"), count(there).alias("present"),
        F.coalesce(F.sum("found_bytes"), F.lit(0)).alias("present_bytes"),
        count(size_off).alias("size_problems"), count(hash_off).alias("hash_problems"), F.sum("bytes").alias("entry_bytes"),
    )
    if headers is not None:
        h = headers.select("dataset", F.col("file_count").alias("h_files"), F.col("total_bytes").alias("h_bytes"))
        sums = sums.join(h, "dataset", "left")
        off = lambda a, b: F.when(F.col(a) != F.col(b), 1).otherwise(0)
        sums = sums.withColumn("header_problems", off("h_files", "files") + off("h_bytes", "entry_bytes"))
    else:
        sums = sums.withColumn("header_problems", F.lit(0))
    missing = F.col("files") - F.col("present")
    problems = F.col("size_problems") + F.col("hash_problems") + F.col("header_problems")
    status = (
        F.when((F.col("present") == 0) & (F.col("files") > 0), "NOT_DOWNLOADED")
        .when((missing > 0) | (problems > 0), "FAIL")
        .otherwise("PASS")
    )
    return sums.select(
        "dataset", status.alias("status"), "files", "present", "present_bytes", missing.alias("missing"),
        "size_problems", "hash_problems", "header_problems",
    )


def file_problems(expected, actual, fast=False):
    """One row per bad or missing file with its reason."""
    b = actual.select("dataset", "path", F.col("bytes").alias("got"), F.col("sha256").alias("sha"))
    rows = expected.join(b, ["dataset", "path"], "left")
    size = F.concat(F.lit("size mismatch (expected "), F.col("bytes").cast("string"), F.lit(", got "), F.col("got").cast("string"), F.lit(")"))
    problem = F.when(F.col("got").isNull(), F.lit("missing")).when(F.col("got") != F.col("bytes"), size)
    if not fast:
        problem = problem.when(F.col("sha") != F.col("sha256"), F.lit("sha256 mismatch"))
    return rows.select("dataset", "path", problem.alias("problem")).where(F.col("problem").isNotNull())


def attach(rows, external, keys):
    """Answers, boxes or captions computed elsewhere, joined by run key."""
    return rows.join(external, list(keys), "left")

