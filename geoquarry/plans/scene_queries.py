"""Scene catalogue queries."""

from pyspark.sql import functions as F

from geoquarry.functions.geo import pair_key
from geoquarry.operators import catalog
from geoquarry.plans import views as V
from geoquarry.plans.registry import query
from geoquarry.plans.sql import quote
from geoquarry.sources.blocks import scene_metadata


def guarded(spark, sf):
    return catalog.guard_modality(catalog.resolve_modality(V.scenes(spark, sf)))


def _hit(text):
    parts = [f"WHEN contains({text}, {quote(k)}) THEN {{'m': {quote(m)}, 'k': {quote(k)}}}"
             for m, keys in catalog.KEYWORDS for k in keys]
    return "CASE " + " ".join(parts) + " END"


_REASON = {
    "agree": "'filename keyword ''' || f.k || ''' and metadata keyword ''' || t.k || ''' agree on ''' || f.m || ''''",
    "clash": "'filename hint ''' || f.m || ''' (matched ''' || f.k || ''') conflicts with metadata hint ''' || t.m || "
             "''' (matched ''' || t.k || '''); resolving to unknown rather than guess'",
    "name": "'filename keyword ''' || f.k || ''' in ''' || base || ''' indicates ''' || f.m || ''''",
    "tag": "'raster metadata tag keyword ''' || t.k || ''' indicates ''' || t.m || ''''",
    "bands": "'band count ' || band_count || ' maps to ''' || g || ''' with no other hint available'",
    "vague": "'band count ' || band_count || ' is ambiguous and no filename/metadata hint was available; "
             "resolving to unknown rather than guess'",
    "user": "'explicit user-supplied override: ''' || user_modality || ''''",
}

#: Modality decision and guard in SQL.
EXTRA = {
    "v_decide": f"""
        SELECT *, CASE WHEN user_modality IS NOT NULL THEN 'user' WHEN f IS NOT NULL AND t IS NOT NULL THEN 'metadata'
                       WHEN f IS NOT NULL THEN 'filename' WHEN t IS NOT NULL THEN 'metadata' ELSE 'band_count' END AS mechanism,
               CASE WHEN user_modality IS NOT NULL THEN lower(trim(user_modality))
                    WHEN f IS NOT NULL AND t IS NOT NULL THEN CASE WHEN f.m = t.m THEN f.m ELSE 'unknown' END
                    WHEN f IS NOT NULL THEN f.m WHEN t IS NOT NULL THEN t.m ELSE coalesce(g, 'unknown') END AS decided,
               CASE WHEN user_modality IS NOT NULL THEN {_REASON['user']}
                    WHEN f IS NOT NULL AND t IS NOT NULL AND f.m = t.m THEN {_REASON['agree']}
                    WHEN f IS NOT NULL AND t IS NOT NULL THEN {_REASON['clash']}
                    WHEN f IS NOT NULL THEN {_REASON['name']} WHEN t IS NOT NULL THEN {_REASON['tag']}
                    WHEN g IS NOT NULL THEN {_REASON['bands']} ELSE {_REASON['vague']} END AS reason
        FROM (SELECT *, {_hit('lower(base)')} AS f, {_hit('lower(tags)')} AS t,
                     CASE WHEN band_count = 3 THEN 'optical' WHEN band_count IN (4, 12, 13) THEN 'msi' END AS g
              FROM (SELECT *, parse_filename(path) AS base FROM v_scene))""",
    "v_guard": """
        SELECT *, CASE WHEN band_count NOT IN (1, 2, 3, 4, 12, 13) AND mechanism <> 'user' THEN 'unknown' ELSE decided END AS modality,
               decided = 'sar' AS is_sar FROM v_decide""",
    "v_lonlat": """
        SELECT scene, min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north FROM (
          SELECT scene, CASE crs WHEN 'EPSG:4326' THEN mx WHEN 'EPSG:32633' THEN lon END AS lon,
                 CASE crs WHEN 'EPSG:4326' THEN my WHEN 'EPSG:32633' THEN lat END AS lat FROM v_geo)
        GROUP BY scene""",
    "v_rim": """
        SELECT scene, crs, unnest([l + (r - l) * i / 22.0::DOUBLE, l + (r - l) * i / 22.0::DOUBLE, l, r]) AS mx,
               unnest([b, t, b + (t - b) * i / 22.0::DOUBLE, b + (t - b) * i / 22.0::DOUBLE]) AS my
        FROM (SELECT scene, crs, tc AS l, tc + ta * w AS r, tf - ta * h AS b, tf AS t, unnest(range(0, 23)) AS i FROM v_scene)""",
}


def utm_sql(source):
    """Inverse transverse Mercator of zone 33 over (mx, my), in SQL."""
    e2 = "0.0066943799901413165"
    return f"""
        SELECT *, 15 + degrees((d - (1 + 2 * t1 + c1) * pow(d, 3) / 6 + (5 - 2 * c1 + 28 * t1 - 3 * c1 * c1 + 8 * ep2 + 24 * t1 * t1)
                    * pow(d, 5) / 120) / cos(phi)) AS lon,
               degrees(phi - (n1 * tan(phi) / r1) * (pow(d, 2) / 2 - (5 + 3 * t1 + 10 * c1 - 4 * c1 * c1 - 9 * ep2) * pow(d, 4) / 24
                    + (61 + 90 * t1 + 298 * c1 + 45 * t1 * t1 - 252 * ep2 - 3 * c1 * c1) * pow(d, 6) / 720)) AS lat
        FROM (SELECT *, tan(phi) * tan(phi) AS t1, ep2 * cos(phi) * cos(phi) AS c1,
                     6378137.0::DOUBLE / sqrt(1 - {e2}::DOUBLE * sin(phi) * sin(phi)) AS n1,
                     6378137.0::DOUBLE * (1 - {e2}::DOUBLE) / pow(1 - {e2}::DOUBLE * sin(phi) * sin(phi), 1.5) AS r1,
                     (mx - 500000.0::DOUBLE) / (6378137.0::DOUBLE / sqrt(1 - {e2}::DOUBLE * sin(phi) * sin(phi)) * 0.9996::DOUBLE) AS d
              FROM (SELECT *, mu + (3 * e1 / 2 - 27 * pow(e1, 3) / 32) * sin(2 * mu) + (21 * pow(e1, 2) / 16 - 55 * pow(e1, 4) / 32) * sin(4 * mu)
                              + (151 * pow(e1, 3) / 96) * sin(6 * mu) + (1097 * pow(e1, 4) / 512) * sin(8 * mu) AS phi
                    FROM (SELECT *, {e2}::DOUBLE / (1 - {e2}::DOUBLE) AS ep2,
                                 (1 - sqrt(1 - {e2}::DOUBLE)) / (1 + sqrt(1 - {e2}::DOUBLE)) AS e1,
                                 my / 0.9996::DOUBLE / (6378137.0::DOUBLE * (1 - {e2}::DOUBLE / 4 - 3 * pow({e2}::DOUBLE, 2) / 64
                                   - 5 * pow({e2}::DOUBLE, 3) / 256)) AS mu FROM {source})))"""


EXTRA["v_geo"] = utm_sql("v_rim")
_OVERLAP = """CASE WHEN a.west IS NULL OR b.west IS NULL THEN NULL
    WHEN least(a.east, b.east) <= greatest(a.west, b.west) OR least(a.north, b.north) <= greatest(a.south, b.south) THEN 0.0
    WHEN least((a.east - a.west) * (a.north - a.south), (b.east - b.west) * (b.north - b.south)) = 0 THEN 0.0
    ELSE (least(a.east, b.east) - greatest(a.west, b.west)) * (least(a.north, b.north) - greatest(a.south, b.south))
         / least((a.east - a.west) * (a.north - a.south), (b.east - b.west) * (b.north - b.south)) * 100 END"""


def six(name):
    return (F.round(name, 6) + 0.0).alias(name)


@query("s4_scene_metadata", """
    SELECT scene, w AS width, h AS height, band_count AS bands, crs, abs(ta) AS resolution_x, abs(ta) AS resolution_y,
           'float32' AS dtype, NULL::DOUBLE AS nodata, round(tc, 6) AS "left", round(tf - ta * h, 6) AS bottom,
           round(tc + ta * w, 6) AS "right", round(tf, 6) AS top FROM v_scene""")
def s4(spark, sf):
    rows = scene_metadata(V.scenes(spark, sf))
    return rows.select(*[c for c in rows.columns if c not in ("left", "bottom", "right", "top")],
                       *[six(c) for c in ("left", "bottom", "right", "top")])


@query("p1_resolve_modality", "SELECT scene, decided AS modality, mechanism, reason FROM v_decide", EXTRA)
def p1(spark, sf):
    return catalog.resolve_modality(V.scenes(spark, sf)).select("scene", "decision.*")


@query("p2_guard_modality", "SELECT scene, modality, is_sar FROM v_guard", EXTRA)
def p2(spark, sf):
    return guarded(spark, sf).select("scene", "modality", "is_sar")


@query("p17_format_of", """
    SELECT scene, CASE WHEN ext IN ('tif', 'tiff') THEN 'GeoTIFF' WHEN ext = '' THEN 'unknown' ELSE upper(ext) END AS format,
           ext = '' OR ext IN ('bmp', 'jp2', 'jpeg', 'jpg', 'png', 'tif', 'tiff', 'webp') AS supported
    FROM (SELECT scene, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS ext FROM v_scene)""")
def p17(spark, sf):
    return V.scenes(spark, sf).select(
        "scene", catalog.format_of(F.col("path")).alias("format"), catalog.supported(F.col("path")).alias("supported"))


_PLAUSIBLE = " ".join(
    f"WHEN modality = '{m}' AND band_count NOT IN ({', '.join(map(str, b))}) THEN path || ': ' || band_count || "
    + quote(f"-band input is unusual for modality '{m}' (expected one of {b}); encoder will fall back to band-count mapping for embedding")
    for m, b in catalog.PLAUSIBLE_BANDS.items())
_INSPECT = f"""
    SELECT i.run_id, i.ord, i.scene, s.modality, s.h, s.w, s.crs,
      list_filter([
        CASE WHEN lower(regexp_extract(path, '\\.([^./]+)$', 1)) NOT IN ('bmp', 'jp2', 'jpeg', 'jpg', 'png', 'tif', 'tiff', 'webp')
             THEN path || ': extension ''.' || lower(regexp_extract(path, '\\.([^./]+)$', 1)) ||
                  {quote("' is not in the supported set (" + catalog.py_list(catalog.EXTENSIONS) + "); attempting decode anyway")} END,
        CASE {_PLAUSIBLE} END,
        CASE WHEN modality = 'unknown' THEN path || ': resolved modality is ''unknown'' — a bare ' || band_count ||
             '-band raster with no filename/metadata hint (this is exactly what real Cartosat PAN and RISAT products look like). Set an explicit modality in the UI if you know it; the run will proceed with the ambiguity recorded.' END
      ], lambda m: m IS NOT NULL) AS warnings,
      CASE WHEN path IS NULL THEN ['scene ' || i.scene || ': could not be read'] ELSE [] END AS errors
    FROM v_input i LEFT JOIN v_guard s USING (scene)"""
EXTRA["v_inspect"] = _INSPECT


@query("p18_inspect_inputs", """
    SELECT run_id, ord, scene, coalesce(modality, 'none') AS modality,
           CASE WHEN modality IS NULL THEN '' ELSE array_to_string(warnings, ' | ') END AS warnings,
           array_to_string(errors, ' | ') AS errors FROM v_inspect""", EXTRA)
def p18(spark, sf):
    rows = catalog.inspect_inputs(V.request_inputs(spark, sf), guarded(spark, sf))
    return rows.select(
        "run_id", "ord", "scene", F.coalesce("modality", F.lit("none")).alias("modality"),
        F.array_join("warnings", " | ").alias("warnings"), F.array_join("errors", " | ").alias("errors"))


def checked_requests(spark, sf):
    """Requests checked as their gold task, with the second image chosen in some."""
    q = V.queries(spark, sf)
    requests = q.select(
        F.col("qid").alias("run_id"), F.col("gold_task").alias("task"),
        F.when(F.col("query").contains("second"), 1).otherwise(0).alias("image_index"))
    return catalog.check_pairs(requests, V.request_inputs(spark, sf), guarded(spark, sf))


_MODS = "('[''' || am || ''', ''' || bm || ''']')"
EXTRA["v_check"] = f"""
    SELECT run_id, task, n, am, bm, iw AS input_warnings, ie AS input_errors,
      list_filter([
        CASE WHEN n < lo THEN 'task ''' || task || ''' requires at least ' || lo || ' image(s); got ' || n END,
        CASE WHEN n > 2 THEN 'task ''' || task || ''' accepts at most 2 image(s); got ' || n END,
        CASE WHEN lo = 1 AND n > 0 AND idx >= n THEN 'query selects image index ' || idx || ' for a single-image task, but only ' || n || ' image(s) were supplied' END,
        CASE WHEN task = 'fusion' AND n >= 2 AND am <> 'sar' AND bm <> 'sar' AND am <> 'unknown' AND bm <> 'unknown'
             THEN 'fusion requires two genuinely distinct modalities with a SAR input (R2); both inputs resolved as optical-family modalities ' || {_MODS} || ' — refusing the cross-modal run' END
      ], lambda m: m IS NOT NULL) AS errors,
      list_filter([
        CASE WHEN task = 'change' AND n >= 2 AND (ah <> bh OR aw <> bw) THEN 'change inputs differ in size ([' || ah || ', ' || aw || '] vs [' || bh || ', ' || bw || ']); W4 registration will resample/crop — proceeding' END,
        CASE WHEN task = 'change' AND n >= 2 AND ac <> bc THEN 'change inputs have different CRS (' || ac || ' vs ' || bc || '); W4 will register — proceeding' END,
        CASE WHEN task = 'change' AND n >= 2 AND (ac IS NULL) <> (bc IS NULL) THEN 'only one change input is georeferenced, so co-registration cannot be skipped; W4 registration will run' END,
        CASE WHEN task = 'change' AND n >= 2 AND am <> 'unknown' AND bm <> 'unknown' AND am <> bm THEN 'change normally compares two dates of the SAME modality, but inputs resolved to ' || {_MODS} || '; proceeding via registration, and consider fusion if the intent is cross-modal' END,
        CASE WHEN task = 'fusion' AND n >= 2 AND am = 'sar' AND bm = 'sar' THEN 'both fusion inputs resolved as SAR (' || {_MODS} || '); fusion assumes an optical/non-SAR input as its optical side — proceeding with the first input as the optical channel' END,
        CASE WHEN task = 'fusion' AND n >= 2 AND (am = 'sar' OR bm = 'sar') AND (am = 'unknown' OR bm = 'unknown') THEN 'one fusion input resolved to ''unknown'' (' || {_MODS} || '); proceeding, but verify the pair really is optical + SAR' END,
        CASE WHEN task = 'fusion' AND n >= 2 AND am <> 'sar' AND bm <> 'sar' AND (am = 'unknown' OR bm = 'unknown') THEN 'fusion inputs are ' || {_MODS} || ' — no input was confidently tagged SAR; proceeding but the cross-modal claim cannot be verified' END
      ], lambda m: m IS NOT NULL) AS warnings
    FROM (SELECT q.qid AS run_id, q.gold_task AS task, q.n_inputs AS n,
                 CASE WHEN q.gold_task IN ('change', 'fusion') THEN 2 ELSE 1 END AS lo,
                 CASE WHEN contains(q.query, 'second') THEN 1 ELSE 0 END AS idx,
                 coalesce(a.modality, 'unknown') AS am, coalesce(b.modality, 'unknown') AS bm,
                 coalesce(a.h, 0) AS ah, coalesce(a.w, 0) AS aw, coalesce(b.h, 0) AS bh, coalesce(b.w, 0) AS bw,
                 a.crs AS ac, b.crs AS bc, s.iw, s.ie
          FROM v_query q
          LEFT JOIN v_inspect a ON a.run_id = q.qid AND a.ord = 0
          LEFT JOIN v_inspect b ON b.run_id = q.qid AND b.ord = 1
          LEFT JOIN (SELECT run_id, sum(CASE WHEN modality IS NULL THEN 0 ELSE len(warnings) END)::INT AS iw, sum(len(errors))::INT AS ie
                     FROM v_inspect GROUP BY 1) s ON s.run_id = q.qid)"""


@query("p19_check_pairs", """
    SELECT run_id, task, n, input_warnings, input_errors, array_to_string(warnings, ' | ') AS warnings,
           array_to_string(errors, ' | ') AS errors, len(errors) = 0 AND input_errors = 0 AS passed FROM v_check""", EXTRA)
def p19(spark, sf):
    return checked_requests(spark, sf).select(
        "run_id", "task", "n", "input_warnings", "input_errors", F.array_join("warnings", " | ").alias("warnings"),
        F.array_join("errors", " | ").alias("errors"), "passed")


@query("p20_coregistered", """
    SELECT pair, scene0, scene1, coalesce(a.crs = b.crs AND a.ta = b.ta AND a.tc = b.tc AND a.tf = b.tf AND a.h = b.h AND a.w = b.w, false) AS coregistered
    FROM v_scene_pair LEFT JOIN v_scene a ON a.scene = scene0 LEFT JOIN v_scene b ON b.scene = scene1""")
def p20(spark, sf):
    return catalog.coregistered(V.scene_pairs(spark, sf), V.scenes(spark, sf))


@query("p21_validate_pair", f"""
    SELECT pair, s.crs IS NOT DISTINCT FROM t.crs AS same_crs, s.h = t.h AND s.w = t.w AS same_dimensions,
           abs(s.ta - t.ta) <= 1e-8 + 1e-5 * abs(t.ta) AS same_resolution, round(overlap, 3) AS overlap,
           CASE WHEN overlap > 80 THEN 'strong' WHEN overlap > 0 THEN 'partial' WHEN overlap = 0 THEN 'none' END AS verdict
    FROM (SELECT pair, scene0, scene1, {_OVERLAP} AS overlap FROM v_scene_pair
          LEFT JOIN v_lonlat a ON a.scene = scene0 LEFT JOIN v_lonlat b ON b.scene = scene1)
    LEFT JOIN v_scene s ON s.scene = scene0 LEFT JOIN v_scene t ON t.scene = scene1""", EXTRA)
def p21(spark, sf):
    rows = catalog.validate_pair(V.scene_pairs(spark, sf), V.scenes(spark, sf))
    return rows.withColumn("overlap", F.round("overlap", 3) + 0.0)


@query("p22_assign_roles", """
    SELECT run_id, oi AS optical_index, 1 - oi AS sar_index,
      CASE WHEN am = 'sar' AND bm = 'sar' THEN 'both inputs tagged SAR; treating 2nd as the optical channel by upload order'
           WHEN am = 'sar' OR bm = 'sar' THEN 'optical channel = input ' || (oi + 1) || ' (' || CASE WHEN oi = 1 THEN bm ELSE am END || '); SAR channel = input ' || (2 - oi)
           ELSE 'no input confidently tagged SAR; using upload order (optical=1st, SAR=2nd)' END AS note
    FROM (SELECT *, CASE WHEN am = 'sar' THEN 1 ELSE 0 END AS oi FROM v_check WHERE task = 'fusion' AND n >= 2)""", EXTRA)
def p22(spark, sf):
    return catalog.assign_roles(checked_requests(spark, sf))


@query("j20_footprint_overlap", f"""
    SELECT pair, scene0, scene1, round({_OVERLAP}, 3) AS overlap FROM v_scene_pair
    LEFT JOIN v_lonlat a ON a.scene = scene0 LEFT JOIN v_lonlat b ON b.scene = scene1""", EXTRA)
def j20(spark, sf):
    rows = catalog.footprint_overlap(V.scene_pairs(spark, sf), V.scenes(spark, sf))
    return rows.withColumn("overlap", F.round("overlap", 3) + 0.0)


@query("j20_overlapping_scenes", f"""
    SELECT a.scene AS scene0, b.scene AS scene1, round({_OVERLAP}, 3) AS overlap FROM v_lonlat a JOIN v_lonlat b
      ON a.scene < b.scene AND a.west < b.east AND b.west < a.east AND a.south < b.north AND b.south < a.north""", EXTRA)
def j20_scenes(spark, sf):
    return catalog.overlapping_scenes(V.scenes(spark, sf)).withColumn("overlap", F.round("overlap", 3))


EXTRA["v_frame"] = """
    SELECT id, west, south, west + CASE WHEN id % 211 = 0 THEN 12.0::DOUBLE ELSE side END AS east,
           south + CASE WHEN id % 211 = 0 THEN 0.02::DOUBLE ELSE side END AS north
    FROM (SELECT event_id AS id, (event_id // 100) * 5.0::DOUBLE + (event_id * 37 % 400) * 0.01::DOUBLE AS west,
                 (event_id * 53 % 300) * 0.01::DOUBLE AS south, 0.05::DOUBLE + (event_id % 7) * 0.05::DOUBLE AS side FROM events)"""


@query("j20_overlapping_frames", f"""
    SELECT a.id AS a, b.id AS b, round({_OVERLAP}, 3) AS overlap FROM v_frame a JOIN v_frame b
      ON a.id < b.id AND a.west < b.east AND b.west < a.east AND a.south < b.north AND b.south < a.north""", EXTRA)
def j20_frames(spark, sf):
    return catalog.overlapping_footprints(V.frames(spark, sf)).withColumn("overlap", F.round("overlap", 3))


EXTRA["v_point"] = """
    SELECT s.scene, s.crs, i.x, i.y, s.h, s.w, ta * (i.x + 0.5) + tc AS mx, -ta * (i.y + 0.5) + tf AS my
    FROM (SELECT event_id, (event_id % n)::INT AS scene, (event_id % 18 - 1)::INT AS x, (event_id % 7)::INT AS y FROM events, (SELECT max(vec_id) // 4 + 1 AS n FROM embeddings)) i
    JOIN v_scene s USING (scene)"""
EXTRA["v_point_geo"] = utm_sql("v_point")


@query("f17_pixel_lon_lat", """
    SELECT scene, x, y,
      CASE WHEN crs IS NULL THEN 'This TIFF contains no geographic CRS.' WHEN x < 0 OR x >= w OR y < 0 OR y >= h THEN 'Pixel is outside the image.' END AS error,
      CASE WHEN x < 0 OR x >= w OR y < 0 OR y >= h THEN NULL WHEN crs = 'EPSG:4326' THEN round(mx, 6) WHEN crs = 'EPSG:32633' THEN round(lon, 6) END AS lon,
      CASE WHEN x < 0 OR x >= w OR y < 0 OR y >= h THEN NULL WHEN crs = 'EPSG:4326' THEN round(my, 6) WHEN crs = 'EPSG:32633' THEN round(lat, 6) END AS lat
    FROM v_point_geo""", EXTRA)
def f17(spark, sf):
    e = F.col("event_id")
    points = V.load(spark, sf, "events").select(
        (e % V.scene_count(spark, sf)).cast("int").alias("scene"), (e % 18 - 1).cast("int").alias("x"), (e % 7).cast("int").alias("y"))
    rows = catalog.pixel_lon_lat(points, V.scenes(spark, sf))
    return rows.withColumns({"lon": F.round("lon", 6) + 0.0, "lat": F.round("lat", 6) + 0.0})


@query("f21_pair_key", """
    SELECT pair, substr(sha1(a.path || '|' || b.path), 1, 12) AS key
    FROM v_scene_pair JOIN v_scene a ON a.scene = scene0 JOIN v_scene b ON b.scene = scene1""")
def f21(spark, sf):
    sides = catalog.with_sides(V.scene_pairs(spark, sf), V.scenes(spark, sf).select("scene", "path"))
    return sides.select("pair", pair_key(F.col("a.path"), F.col("b.path")).alias("key"))
