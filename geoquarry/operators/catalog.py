"""Scene catalogue: modality, input checks, pair checks, footprints
(P1, P2, P17-P22, J20, F17)."""

from pyspark.sql import functions as F

from geoquarry.functions.geo import pixel_to_map, with_lon_lat
from geoquarry.operators.scale import join_facts
from geoquarry.operators.spatial import BOUND, CORNERS, overlapping

# Keywords, domains and plausible band counts.
KEYWORDS = [
    ("sar", ["sar", "risat", "grd", "_vv", "vv_", "_vh", "vh_", "vv.", "vh.", "sentinel-1", "sentinel1",
             "s1_", "_s1", "radarsat", "backscatter", "polsar", "hh_", "_hh"]),
    ("optical", ["optical", "rgb", "panchromatic", "_pan", "pan_", "pan.", "true_color", "truecolor"]),
    ("msi", ["msi", "multispectral", "sentinel-2", "sentinel2", "s2_", "_s2", "cartosat_msi",
             "cartosat2s_msi", "bigearthnet", "ben_s2"]),
]
MODALITIES = ["optical", "msi", "sar", "unknown"]
EXPECTED_BANDS = [1, 2, 3, 4, 12, 13]
PLAUSIBLE_BANDS = {"optical": [1, 3, 4, 12, 13], "msi": [3, 4, 12, 13], "sar": [1, 2, 4]}
EXTENSIONS = ["bmp", "jp2", "jpeg", "jpg", "png", "tif", "tiff", "webp"]
OVERLAP_STRONG = 80.0
EDGE_POINTS = 21


def text(*parts):
    """Concatenate columns and plain strings."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def quoted(column):
    return text("'", column, "'")


def present(messages):
    """The messages that apply, in order."""
    return F.filter(F.array(*messages), lambda m: m.isNotNull())


def keyword_hit(words):
    """First (modality, keyword) found in the lower-case text of an SQL expression, or null."""
    tests = " ".join(
        f"WHEN contains({words}, '{k}') THEN named_struct('modality', '{m}', 'keyword', '{k}')"
        for m, keys in KEYWORDS
        for k in keys
    )
    return F.expr(f"CASE {tests} END")


def resolve_modality(scenes):
    """Add ``decision`` (modality, mechanism, reason) to each scene.

    An invalid override gives a decision with modality null and mechanism ``error``.
    """
    base = F.element_at(F.split("path", "/"), -1)
    blob = F.lower(F.array_join(F.transform(F.map_entries("tags"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " "))
    marked = scenes.withColumns({"_base": base, "_low": F.lower(base), "_tags": blob}).select(
        "*", keyword_hit("_low").alias("_name"), keyword_hit("_tags").alias("_meta")
    )
    name, meta, bands = F.col("_name"), F.col("_meta"), F.col("band_count")
    user = F.lower(F.trim("user_modality"))
    guess = F.when(bands == 3, "optical").when(bands.isin(4, 12, 13), "msi")

    def decide(modality, mechanism, reason):
        as_text = F.lit(modality) if isinstance(modality, str) else modality
        return F.struct(as_text.alias("modality"), F.lit(mechanism).alias("mechanism"), reason.alias("reason"))

    unset = F.lit(None).cast("string")
    decision = (
        F.when(
            F.col("user_modality").isNotNull() & ~user.isin(MODALITIES),
            decide(unset, "error", text("Invalid modality override ", quoted(F.col("user_modality")))),
        )
        .when(
            F.col("user_modality").isNotNull(),
            decide(user, "user", text("explicit user-supplied override: ", quoted(F.col("user_modality")))),
        )
        .when(
            name["modality"] == meta["modality"],
            decide(name["modality"], "metadata", text(
                "filename keyword ", quoted(name["keyword"]), " and metadata keyword ",
                quoted(meta["keyword"]), " agree on ", quoted(name["modality"]))),
        )
        .when(
            name.isNotNull() & meta.isNotNull(),
            decide("unknown", "metadata", text(
                "filename hint ", quoted(name["modality"]), " (matched ", quoted(name["keyword"]),
                ") conflicts with metadata hint ", quoted(meta["modality"]), " (matched ",
                quoted(meta["keyword"]), "); resolving to unknown rather than guess")),
        )
        .when(
            name.isNotNull(),
            decide(name["modality"], "filename", text(
                "filename keyword ", quoted(name["keyword"]), " in ", quoted(F.col("_base")),
                " indicates ", quoted(name["modality"]))),
        )
        .when(
            meta.isNotNull(),
            decide(meta["modality"], "metadata", text(
                "raster metadata tag keyword ", quoted(meta["keyword"]), " indicates ", quoted(meta["modality"]))),
        )
        .when(
            guess.isNotNull(),
            decide(guess, "band_count", text(
                "band count ", bands, " maps to ", quoted(guess), " with no other hint available")),
        )
        .otherwise(decide("unknown", "band_count", text(
            "band count ", bands, " is ambiguous and no filename/metadata hint was available; "
            "resolving to unknown rather than guess")))
    )
    return marked.withColumn("decision", decision).drop("_base", "_low", "_tags", "_name", "_meta")


def guard_modality(resolved):
    """Force ``unknown`` for unexpected band counts; keep the scaling choice."""
    odd = ~F.col("band_count").isin(EXPECTED_BANDS) & (F.col("decision.mechanism") != "user")
    return resolved.select(
        "*",
        F.when(odd, "unknown").otherwise(F.col("decision.modality")).alias("modality"),
        (F.col("decision.modality") == "sar").alias("is_sar"),
    )


def extension(path):
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def format_of(path):
    """Format label of a path."""
    ext = extension(path)
    return F.when(ext.isin("tif", "tiff"), "GeoTIFF").when(ext == "", "unknown").otherwise(F.upper(ext))


def supported(path):
    ext = extension(path)
    return (ext == "") | ext.isin(EXTENSIONS)


def py_list(values):
    return "[" + ", ".join(repr(v) for v in values) + "]"


def inspect(scenes):
    """Warnings and errors of each input with a guarded modality.

    A row whose ``path`` is null could not be read.
    """
    path, bands, modality = F.col("path"), F.col("band_count"), F.col("modality")
    odd = []
    for name, counts in PLAUSIBLE_BANDS.items():
        odd.append(F.when(
            (modality == name) & ~bands.isin(counts),
            text(path, ": ", bands, f"-band input is unusual for modality '{name}' (expected one of "
                 f"{counts}); encoder will fall back to band-count mapping for embedding"),
        ))
    warnings = present([
        F.when(~supported(path), text(path, ": extension '.", extension(path),
               f"' is not in the supported set ({py_list(EXTENSIONS)}); attempting decode anyway")),
        *odd,
        F.when(modality == "unknown", text(
            path, ": resolved modality is 'unknown' — a bare ", bands,
            "-band raster with no filename/metadata hint (this is exactly what real Cartosat PAN and "
            "RISAT products look like). Set an explicit modality in the UI if you know it; the run will "
            "proceed with the ambiguity recorded.")),
    ])
    errors = present([F.when(path.isNull(), text("scene ", F.col("scene"), ": could not be read"))])
    return scenes.select(
        "*",
        F.when(path.isNull(), F.array().cast("array<string>")).otherwise(warnings).alias("warnings"),
        errors.alias("errors"),
        format_of(path).alias("format"),
    )


def inspect_inputs(inputs, scenes):
    """Inspection of every input of every request; unknown scenes are errors."""
    facts = scenes.select("scene", "path", "band_count", "modality", "crs", "h", "w")
    return inspect(join_facts(inputs, facts, ["scene"], "left"))


def check_pairs(requests, inputs, scenes, extra=()):
    """Task-level compatibility of each request.

    ``requests`` has run_id, task, image_index and whatever else should be kept.
    Only the first two inputs and counts are kept per run, so a run of any length
    fits one row; ``extra`` adds aggregates over a run's inspected inputs.
    """
    seen = inspect_inputs(inputs, scenes)
    info = F.struct(
        F.coalesce("modality", F.lit("unknown")).alias("modality"),
        F.coalesce("h", F.lit(0)).alias("h"), F.coalesce("w", F.lit(0)).alias("w"), "crs",
    )
    per_run = seen.groupBy("run_id").agg(
        F.count(F.lit(1)).cast("int").alias("n"),
        F.max(F.when(F.col("ord") == 0, info)).alias("a"),
        F.max(F.when(F.col("ord") == 1, info)).alias("b"),
        F.sum(F.size("warnings")).cast("int").alias("input_warnings"),
        F.sum(F.size("errors")).cast("int").alias("input_errors"),
        *extra,
    )
    more = [c for c in per_run.columns if c not in ("run_id", "n", "a", "b", "input_warnings", "input_errors")]
    rows = requests.join(per_run, "run_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    task, n, idx = F.col("task"), F.col("n"), F.col("image_index")
    a, b = F.col("a"), F.col("b")
    two = task.isin("change", "fusion")
    low = F.when(two, 2).otherwise(1)
    change, fusion = (task == "change") & (n >= 2), (task == "fusion") & (n >= 2)
    mods = text("['", a["modality"], "', '", b["modality"], "']")
    shape = lambda s: text("[", s["h"], ", ", s["w"], "]")
    sar = (a["modality"] == "sar") | (b["modality"] == "sar")
    both_sar = (a["modality"] == "sar") & (b["modality"] == "sar")
    vague = (a["modality"] == "unknown") | (b["modality"] == "unknown")
    errors = present([
        F.when(n < low, text("task '", task, "' requires at least ", low, " image(s); got ", n)),
        F.when(n > 2, text("task '", task, "' accepts at most 2 image(s); got ", n)),
        F.when(~two & (n > 0) & ~((idx >= 0) & (idx < n)), text(
            "query selects image index ", idx, " for a single-image task, but only ", n,
            " image(s) were supplied")),
        F.when(fusion & ~sar & ~vague, text(
            "fusion requires two genuinely distinct modalities with a SAR input (R2); both inputs "
            "resolved as optical-family modalities ", mods, " — refusing the cross-modal run")),
    ])
    warnings = present([
        F.when(change & ((a["h"] != b["h"]) | (a["w"] != b["w"])), text(
            "change inputs differ in size (", shape(a), " vs ", shape(b),
            "); W4 registration will resample/crop — proceeding")),
        F.when(change & (a["crs"] != b["crs"]), text(
            "change inputs have different CRS (", a["crs"], " vs ", b["crs"], "); W4 will register — proceeding")),
        F.when(change & (a["crs"].isNull() != b["crs"].isNull()), F.lit(
            "only one change input is georeferenced, so co-registration cannot be skipped; W4 registration will run")),
        F.when(change & ~vague & (a["modality"] != b["modality"]), text(
            "change normally compares two dates of the SAME modality, but inputs resolved to ", mods,
            "; proceeding via registration, and consider fusion if the intent is cross-modal")),
        F.when(fusion & both_sar, text(
            "both fusion inputs resolved as SAR (", mods, "); fusion assumes an optical/non-SAR input as its "
            "optical side — proceeding with the first input as the optical channel")),
        F.when(fusion & sar & vague, text(
            "one fusion input resolved to 'unknown' (", mods, "); proceeding, but verify the pair really is optical + SAR")),
        F.when(fusion & ~sar & vague, text(
            "fusion inputs are ", mods, " — no input was confidently tagged SAR; proceeding but the "
            "cross-modal claim cannot be verified")),
    ])
    none = F.lit(0)
    checked = rows.select(
        *requests.columns, "n", "a", "b", *more,
        F.coalesce("input_warnings", none).alias("input_warnings"),
        F.coalesce("input_errors", none).alias("input_errors"),
        warnings.alias("warnings"), errors.alias("errors"),
    )
    return checked.withColumn("passed", (F.size("errors") == 0) & (F.col("input_errors") == 0))


def assign_roles(checked):
    """Optical and SAR input of each two-image request, with a note."""
    a, b = F.col("a.modality"), F.col("b.modality")
    both, first, second = (a == "sar") & (b == "sar"), a == "sar", b == "sar"
    optical = F.when(first, 1).otherwise(0)
    side = F.when(first, b).otherwise(a)
    note = (
        F.when(both, "both inputs tagged SAR; treating 2nd as the optical channel by upload order")
        .when(first | second, text("optical channel = input ", optical + 1, " (", side,
                                   "); SAR channel = input ", 2 - optical))
        .otherwise("no input confidently tagged SAR; using upload order (optical=1st, SAR=2nd)")
    )
    return checked.where((F.col("task") == "fusion") & (F.col("n") >= 2)).select(
        "run_id", optical.alias("optical_index"), (1 - optical).alias("sar_index"), note.alias("note")
    )


def with_sides(pairs, scenes):
    """Both catalogue rows of each pair as structs ``a`` and ``b``."""
    names = [c for c in scenes.columns if c != "scene"]
    side = lambda s, key: scenes.select(F.col("scene").alias(key), F.struct(*names).alias(s))
    first = join_facts(pairs, side("a", "scene0"), ["scene0"], "left")
    return join_facts(first, side("b", "scene1"), ["scene1"], "left")


def coregistered(pairs, scenes):
    """Same CRS, transform and shape on georeferenced inputs (P20)."""
    a, b = F.col("a"), F.col("b")
    same = (
        (a["crs"] == b["crs"]) & (a["transform"] == b["transform"])
        & (a["h"] == b["h"]) & (a["w"] == b["w"])
    )
    return with_sides(pairs, scenes).select(
        "pair", "scene0", "scene1", F.coalesce(same, F.lit(False)).alias("coregistered")
    )


def wgs84_bounds(scenes):
    """Geographic bounds from points along each edge; null without a CRS."""
    t = F.col("transform")
    left, top = t[2], t[5]
    right, bottom = t[2] + t[0] * F.col("w"), t[5] + t[4] * F.col("h")
    step = F.col("_i") / float(EDGE_POINTS + 1)
    along_x, along_y = left + (right - left) * step, bottom + (top - bottom) * step
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    rim = (
        scenes.select("scene", "crs", "transform", "h", "w", F.explode(F.sequence(F.lit(0), F.lit(EDGE_POINTS + 1))).alias("_i"))
        .select("scene", "crs", F.explode(F.array(
            point(along_x, bottom), point(along_x, top), point(left, along_y), point(right, along_y))).alias("p"))
    )
    return with_lon_lat(rim, F.col("p.x"), F.col("p.y")).groupBy("scene").agg(
        F.min("lon").alias("west"), F.min("lat").alias("south"),
        F.max("lon").alias("east"), F.max("lat").alias("north"),
    )


def overlap_percent(a, b):
    """Shared area over the smaller area, per cent."""
    left, bottom = F.greatest(a["west"], b["west"]), F.greatest(a["south"], b["south"])
    right, top = F.least(a["east"], b["east"]), F.least(a["north"], b["north"])
    area = lambda s: (s["east"] - s["west"]) * (s["north"] - s["south"])
    smaller = F.least(area(a), area(b))
    known = a["west"].isNotNull() & b["west"].isNotNull()
    return F.when(
        known,
        F.when((right <= left) | (top <= bottom) | (smaller == 0), 0.0)
        .otherwise((right - left) * (top - bottom) / smaller * 100),
    )


def footprint_overlap(pairs, scenes):
    """Footprint overlap of given scene pairs (J20): two equi joins."""
    return with_sides(pairs, wgs84_bounds(scenes)).select(
        "pair", "scene0", "scene1", overlap_percent(F.col("a"), F.col("b")).alias("overlap")
    )


def overlapping_footprints(footprints, bound=BOUND):
    """All pairs of footprints (``id, west, south, east, north``) that share an area.

    ``overlap`` is the shared area over the smaller one, per cent.  No pairs are
    given: footprints meet in the cells of a grid (:func:`spatial.overlapping`).
    Footprints without bounds or without extent overlap none.
    """
    rows = footprints.select("id", *[F.col(c).alias(n) for c, n in zip(("west", "south", "east", "north"), CORNERS)])
    shared = (F.col("right") - F.col("left")) * (F.col("top") - F.col("bottom"))
    return overlapping(rows, bound).select("a", "b", (shared / F.least("area_a", "area_b") * 100).alias("overlap"))


def overlapping_scenes(scenes, bound=BOUND):
    """All pairs of catalogue scenes whose geographic footprints share an area."""
    found = overlapping_footprints(wgs84_bounds(scenes).withColumnRenamed("scene", "id"), bound)
    return found.select(F.col("a").alias("scene0"), F.col("b").alias("scene1"), "overlap")


def validate_pair(pairs, scenes):
    """Same CRS, size and resolution, overlap and verdict of each pair."""
    facts = scenes.join(wgs84_bounds(scenes), "scene")
    a, b = F.col("a"), F.col("b")
    near = lambda p, q: F.abs(p - q) <= 1e-8 + 1e-5 * F.abs(q)
    res = lambda i: near(F.abs(a["transform"][i]), F.abs(b["transform"][i]))
    rows = with_sides(pairs, facts).select(
        "pair",
        a["crs"].eqNullSafe(b["crs"]).alias("same_crs"),
        ((a["h"] == b["h"]) & (a["w"] == b["w"])).alias("same_dimensions"),
        (res(0) & res(4)).alias("same_resolution"),
        overlap_percent(a, b).alias("overlap"),
    )
    verdict = (
        F.when(F.col("overlap") > OVERLAP_STRONG, "strong")
        .when(F.col("overlap") > 0, "partial")
        .when(F.col("overlap") == 0, "none")
    )
    return rows.withColumn("verdict", verdict)


def pixel_lon_lat(points, scenes):
    """Longitude and latitude of pixels (scene, x, y); errors as text."""
    facts = scenes.select("scene", "crs", "transform", "h", "w")
    rows = join_facts(points, facts, ["scene"])
    x, y = F.col("x"), F.col("y")
    error = F.when(F.col("crs").isNull(), "This TIFF contains no geographic CRS.").when(
        (x < 0) | (x >= F.col("w")) | (y < 0) | (y >= F.col("h")), "Pixel is outside the image."
    )
    placed = with_lon_lat(rows.withColumn("error", error), *pixel_to_map(F.col("transform"), x, y))
    known = F.col("error").isNull()
    return placed.select(
        "scene", "x", "y", "error", F.when(known, F.col("lon")).alias("lon"), F.when(known, F.col("lat")).alias("lat")
    )
