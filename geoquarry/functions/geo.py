"""Map coordinates: affine pixel centres, closed-form projections, rings."""

import math

from pyspark.sql import functions as F

# WGS84 and UTM constants (fixed values).
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257223563
UTM_SCALE = 0.9996
FALSE_EASTING = 500000.0
FALSE_NORTHING = 10000000.0


def pixel_to_map(transform, x, y):
    """Map position of a pixel centre."""
    a, b, c, d, e, f = (transform[i] for i in range(6))
    px, py = x + 0.5, y + 0.5
    return a * px + b * py + c, d * px + e * py + f


def with_lon_lat(df, x, y, crs="crs"):
    """Add ``lon`` and ``lat`` for EPSG:4326, EPSG:3857 and UTM codes, else null.

    The inverse projection is laid out in steps so that no step is computed
    twice.
    """
    e2 = FLATTENING * (2 - FLATTENING)
    ep2 = e2 / (1 - e2)
    e1 = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    code, col = F.col(crs), F.col
    south = F.substring(code, 6, 3) == "327"
    width = SEMI_MAJOR * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256)
    staged = df.withColumns({"_x": x, "_y": y, "_utm": code.rlike("^EPSG:32[67][0-9]{2}$")})
    staged = staged.withColumn(
        "_mu", F.when(col("_utm"), F.when(south, col("_y") - FALSE_NORTHING).otherwise(col("_y")) / UTM_SCALE / width)
    )
    mu = col("_mu")
    staged = staged.withColumn(
        "_phi",
        mu
        + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu)
        + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu)
        + (151 * e1**3 / 96) * F.sin(6 * mu)
        + (1097 * e1**4 / 512) * F.sin(8 * mu),
    )
    staged = staged.withColumns({"_sin": F.sin("_phi"), "_cos": F.cos("_phi"), "_tan": F.tan("_phi")})
    bend = 1 - e2 * col("_sin") * col("_sin")
    staged = staged.withColumns({
        "_n": SEMI_MAJOR / F.sqrt(bend), "_r": SEMI_MAJOR * (1 - e2) / F.pow(bend, F.lit(1.5)),
        "_t": col("_tan") * col("_tan"), "_c": ep2 * col("_cos") * col("_cos"),
    })
    staged = staged.withColumn("_d", (col("_x") - FALSE_EASTING) / (col("_n") * UTM_SCALE))
    d, t, c = col("_d"), col("_t"), col("_c")
    lat = col("_phi") - (col("_n") * col("_tan") / col("_r")) * (
        F.pow(d, F.lit(2)) / 2
        - (5 + 3 * t + 10 * c - 4 * c * c - 9 * ep2) * F.pow(d, F.lit(4)) / 24
        + (61 + 90 * t + 298 * c + 45 * t * t - 252 * ep2 - 3 * c * c) * F.pow(d, F.lit(6)) / 720
    )
    lon = (
        d
        - (1 + 2 * t + c) * F.pow(d, F.lit(3)) / 6
        + (5 - 2 * c + 28 * t - 3 * c * c + 8 * ep2 + 24 * t * t) * F.pow(d, F.lit(5)) / 120
    ) / col("_cos")
    zone = F.substring(code, 9, 2).try_cast("double")
    plain, web = code == "EPSG:4326", code == "EPSG:3857"
    return staged.withColumns({
        "lon": F.when(plain, col("_x")).when(web, F.degrees(col("_x") / SEMI_MAJOR))
        .when(col("_utm"), (zone - 1) * 6 - 180 + 3 + F.degrees(lon)),
        "lat": F.when(plain, col("_y")).when(web, F.degrees(2 * F.atan(F.exp(col("_y") / SEMI_MAJOR)) - math.pi / 2))
        .when(col("_utm"), F.degrees(lat)),
    }).drop("_x", "_y", "_utm", "_mu", "_phi", "_sin", "_cos", "_tan", "_n", "_r", "_t", "_c", "_d")


def ring(x1, y1, x2, y2):
    """Closed five-point outline of a pixel box."""
    corner = lambda x, y: F.array(x, y)
    return F.array(corner(x1, y1), corner(x2, y1), corner(x2, y2), corner(x1, y2), corner(x1, y1))


def pair_key(path0, path1):
    """First 12 hex digits of the SHA-1 of both paths."""
    return F.substring(F.sha1(F.concat_ws("|", path0, path1).cast("binary")), 1, 12)
