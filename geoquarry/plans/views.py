"""Scene, query, answer and dataset views derived from the driver's tables.

Nothing here is sampled: every view covers every row of the tables it reads.
"""

from pyspark.sql import functions as F

from geoquarry.functions.text import fixed, literal
from geoquarry.operators.rules import RULES, TASKS
from geoquarry.operators.slots import SLOTS
from geoquarry.plans.templates import PAYLOADS, TEMPLATES
from geoquarry.sources.blocks import to_pixels
from geoquarry.sources.tables import load, spread

SIDE = 8
BLOCK = 4


def _idiv(column, by):
    return F.floor(column / by).cast("int")


def _cut(rows, array, keep, size=BLOCK):
    """Cut an 8x8 array into blocks of ``size``."""
    steps = F.array(*[F.lit(i) for i in range(0, SIDE, size)])
    cut = rows.select(*keep, array, F.explode(steps).alias("by")).select(
        "*", F.explode(steps).alias("bx")
    )
    lines = F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)),
        lambda r: F.slice(array, (F.col("by") + r) * SIDE + F.col("bx") + 1, size),
    )
    return cut.select(
        *keep, "by", "bx", F.lit(size).alias("h"), F.lit(size).alias("w"), F.flatten(lines).alias("data")
    )


def band_blocks(spark, sf):
    """Four bands per scene; scene mod 25 = 0 is flat, = 1 has missing pixels."""
    rows = load(spark, sf, "embeddings").select(
        _idiv(F.col("vec_id"), 4).alias("scene"),
        (F.col("vec_id") % 4 + 1).cast("int").alias("band"),
        F.col("embedding").cast("array<double>").alias("e"),
    )
    kind = F.col("scene") % 25
    values = F.transform(
        "e",
        lambda v, i: F.when(kind == 0, F.lit(0.5))
        .when((kind == 1) & (i < 4), F.lit(float("nan")))
        .otherwise(v),
    )
    return _cut(rows.select("scene", "band", values.alias("e")), "e", ("scene", "band"))


def band_pixels(spark, sf):
    return to_pixels(band_blocks(spark, sf))


def _two_bands(spark, sf):
    """Blocks of band 1 and band 2 side by side, joined block to block."""
    blocks = band_blocks(spark, sf)
    first = blocks.where("band = 1").select("scene", "by", "bx", "h", "w", F.col("data").alias("a"))
    second = blocks.where("band = 2").select("scene", "by", "bx", F.col("data").alias("b"))
    return first.join(second, ["scene", "by", "bx"])


def sar_blocks(spark, sf, units="db"):
    """Dual-polarisation blocks: ``vv``, ``vh``."""

    def scaled(name, offset):
        return F.transform(
            name,
            lambda v: (offset + 40 * v) if units == "db" else F.pow(F.lit(10.0), (offset + 40 * v) / 10),
        )

    return _two_bands(spark, sf).select(
        "scene", "by", "bx", "h", "w", scaled("a", -13).alias("vv"), scaled("b", -18).alias("vh")
    )


def pair_blocks(spark, sf):
    """Two dates of a scene as grey levels ``g0``, ``g1`` and classes ``l0``, ``l1``.

    Date 1 carries a bright patch in even scenes.  Missing pixels are level 0.
    """

    def grey(v):
        level = F.floor((F.nanvl(v, F.lit(-0.5)) + 0.5) * 255)
        return F.greatest(F.lit(0), F.least(F.lit(255), level)).cast("int")

    def bumped(v, i):
        y = F.col("by") + F.floor(i / F.col("w"))
        x = F.col("bx") + i % F.col("w")
        inside = (F.col("scene") % 2 == 0) & y.between(2, 4) & x.between(2, 4)
        return F.least(F.lit(255), grey(v) + F.when(inside, 80).otherwise(0)).cast("int")

    rows = _two_bands(spark, sf).select(
        "scene", "by", "bx", "h", "w",
        F.transform("a", grey).alias("g0"),
        F.transform("b", bumped).alias("g1"),
    )
    classes = lambda name: F.transform(name, lambda g: F.floor(g / 43).cast("int"))
    return rows.select("*", classes("g0").alias("l0"), classes("g1").alias("l1"))


def mosaic_masks(spark, sf):
    """Change masks of 16 x 16 scenes, four vectors each as blocks of 8 x 8.

    By scene number: one large patch; one small; a large and a small one; none.
    Single pixels are set besides.
    """
    k = F.col("vec_id") % 4
    rows = load(spark, sf, "embeddings").select(
        _idiv(F.col("vec_id"), 4).alias("scene"), (F.floor(k / 2) * SIDE).cast("int").alias("by"), ((k % 2) * SIDE).cast("int").alias("bx"),
        F.col("embedding").cast("array<double>").alias("e"),
    )
    kind = F.col("scene") % 4

    def marked(v, i):
        y, x = F.col("by") + F.floor(i / SIDE), F.col("bx") + i % SIDE
        inside = lambda a, b, c, d: y.between(a, b) & x.between(c, d)
        patch = ((kind == 0) & inside(2, 13, 2, 13)) | ((kind == 1) & inside(1, 5, 1, 5)) | ((kind == 2) & (inside(0, 6, 0, 15) | inside(9, 13, 2, 6)))
        return F.when(patch | (v > 0.25), 255).otherwise(0)

    return rows.select("scene", "by", "bx", F.lit(SIDE).alias("h"), F.lit(SIDE).alias("w"), F.transform("e", marked).alias("data"))


def slot_blocks(spark, sf):
    """One 8x8 block per (scene, slot) of the 14-slot stack."""
    names = F.array(*[F.lit(s) for s in SLOTS])
    rows = load(spark, sf, "embeddings").select(
        _idiv(F.col("vec_id"), 14).alias("scene"),
        (F.col("vec_id") % 14).cast("int").alias("slot_ordinal"),
        F.col("embedding").cast("array<double>").alias("data"),
    )
    return rows.select(
        "scene", "slot_ordinal", F.element_at(names, F.col("slot_ordinal") + 1).alias("slot"),
        F.lit(0).alias("by"), F.lit(0).alias("bx"), F.lit(SIDE).alias("h"), F.lit(SIDE).alias("w"), "data",
    )


def scenes(spark, sf):
    """The scene catalogue."""
    rows = load(spark, sf, "embeddings").select(_idiv(F.col("vec_id"), 4).alias("scene")).distinct()
    s = F.col("scene")
    text = s.cast("string")
    pick = lambda values, n: F.element_at(F.array(*values), (s % n + 1).cast("int"))
    path = pick(
        [
            F.concat(F.lit("/data/scene_"), text, F.lit(".tif")),
            F.concat(F.lit("/data/risat_"), text, F.lit("_vv.tif")),
            F.concat(F.lit("/data/rgb_"), text, F.lit(".png")),
            F.concat(F.lit("/data/msi_"), text, F.lit(".tif")),
            F.concat(F.lit("/data/pan_"), text, F.lit(".xyz")),
            F.concat(F.lit("/data/s2_"), text, F.lit(".tif")),
            F.concat(F.lit("/data/Frame_"), text, F.lit(".JPG")),
        ],
        7,
    )
    none = F.create_map().cast("map<string,string>")
    tag = lambda k, v: F.create_map(F.lit(k), F.lit(v))
    tags = pick([none, tag("polarisation", "Backscatter"), tag("product", "Multispectral"),
                 tag("operator", "survey"), none], 5)
    geographic = s % 3 == 0
    a = F.when(s % 3 == 1, 10.0).otherwise(0.0001)
    c = F.when(s % 3 == 1, 500000.0 + (s % 50) * 30.0).otherwise(10.0 + (s % 50) * 0.0003)
    f = F.when(s % 3 == 1, 5500000.0 - (s % 50) * 20.0).otherwise(50.0 - (s % 50) * 0.0002)
    size = F.when(s % 9 == 0, 16).otherwise(8)
    return rows.select(
        "scene",
        path.alias("path"),
        pick([F.lit(n) for n in (1, 2, 3, 4, 4, 12, 13, 7)], 8).alias("band_count"),
        tags.alias("tags"),
        F.when(s % 11 == 0, F.lit(" SAR ")).alias("user_modality"),
        F.when(geographic, F.lit("EPSG:4326")).when(s % 3 == 1, F.lit("EPSG:32633")).alias("crs"),
        F.array(a, F.lit(0.0), c, F.lit(0.0), -a, f).alias("transform"),
        size.alias("h"),
        size.alias("w"),
        F.lit("float32").alias("dtype"),
        F.lit(None).cast("double").alias("nodata"),
    )


def frames(spark, sf):
    """Footprints of single acquisitions along a track: (id, west, south, east, north).

    Sizes differ by a factor of 240; every 211th is a long strip.
    """
    e = F.col("event_id")
    west = F.floor(e / 100) * F.lit(5.0) + (e * 37 % 400) * F.lit(0.01)
    south = (e * 53 % 300) * F.lit(0.01)
    side = F.lit(0.05) + (e % 7) * F.lit(0.05)
    strip = e % 211 == 0
    return load(spark, sf, "events").select(
        e.alias("id"), west.alias("west"), south.alias("south"),
        (west + F.when(strip, 12.0).otherwise(side)).alias("east"), (south + F.when(strip, 0.02).otherwise(side)).alias("north"),
    )


def scene_count(spark, sf):
    """How many scenes the catalogue has, as a scalar subquery."""
    return load(spark, sf, "embeddings").agg((_idiv(F.max("vec_id"), 4) + 1).alias("n")).scalar()


def scene_pairs(spark, sf):
    """Pairs of scenes named by events: (pair, scene0, scene1)."""
    e, n = F.col("event_id"), scene_count(spark, sf)
    return load(spark, sf, "events").select(
        e.alias("pair"),
        (e % n).cast("int").alias("scene0"),
        F.when(e % 10 == 0, (e % n).cast("int")).otherwise(((e * 7 + 3) % n).cast("int")).alias("scene1"),
    )


def queries(spark, sf):
    """English queries: (qid, ts, user_id, query, n_inputs, gold_task)."""
    return queries_of(spread(load(spark, sf, "events"), "event_id"))


def _texts(rows):
    """A constant table of (task, text) as one array."""
    parts = ", ".join(f"named_struct('task', '{t}', 'text', {literal(x)})" for t, x in rows)
    return F.expr(f"array({parts})")


def queries_of(events):
    """The query view over any event rows, batch or stream."""
    e = F.col("event_id")
    table = _texts(TEMPLATES)
    return (
        events
        .select("event_id", "ts", "user_id", "event_type", F.element_at(table, (e % len(TEMPLATES) + 1).cast("int")).alias("t"))
        .select(
            e.alias("qid"),
            "ts",
            "user_id",
            F.replace(F.col("t.text"), F.lit("{x}"), F.col("event_type")).alias("query"),
            F.when(e % 97 == 0, 3).when(e % 3 == 0, 1).otherwise(2).alias("n_inputs"),
            F.col("t.task").alias("gold_task"),
        )
    )


def exemplars(spark, sf):
    """A large example table, one text for each part: (example, task, text)."""
    p = F.col("p_partkey")
    text = F.concat_ws(" ", "p_name", "p_type", "p_brand", F.concat(F.lit("size"), F.col("p_size").cast("string")))
    tasks = F.array(*[F.lit(t) for t in TASKS])
    return load(spark, sf, "part").select(p.alias("example"), F.element_at(tasks, (p % len(TASKS) + 1).cast("int")).alias("task"), text.alias("text"))


def part_queries(spark, sf):
    """Queries of the words of two parts: (qid, query)."""
    part = load(spark, sf, "part")
    other = part.select((F.col("p_partkey") - 1).alias("k"), F.concat_ws(" ", "p_type", F.concat(F.lit("size"), F.col("p_size").cast("string"))).alias("rest"))
    rows = part.join(other.hint("merge"), F.col("p_partkey") == F.col("k"), "left")
    return rows.select(F.col("p_partkey").alias("qid"), F.concat_ws(" ", F.lit("show the"), "p_name", "p_name", F.lit("of"), "rest").alias("query"))


def rule_table(spark):
    """The routing rules as a table: (ordinal, task, name, pattern)."""
    return spark.createDataFrame([(i, *rule) for i, rule in enumerate(RULES)], "ordinal int, task string, name string, pattern string")


def request_inputs(spark, sf):
    """Inputs of each request: (run_id, ord, scene); three ids just past the
    catalogue do not exist, so some inputs cannot be read."""
    return inputs_of(queries(spark, sf), scene_count(spark, sf))


def inputs_of(requests, scenes):
    e, n = F.col("qid"), scenes + 3
    ids = F.array(e % n, (e * 7 + 3) % n, (e * 5 + 1) % n)
    return requests.select(
        e.alias("run_id"),
        F.posexplode(F.slice(ids, 1, F.col("n_inputs"))).alias("ord", "scene"),
    ).select("run_id", "ord", F.col("scene").cast("int").alias("scene"))


def answers(spark, sf):
    """Questions with gold and predicted answers:
    (qid, img_id, type, question, gold, prediction, active, file_name)."""
    e, v = F.col("event_id"), F.col("value")
    kind = (
        F.when(F.col("event_type") == "view", "presence")
        .when(F.col("event_type") == "click", "comp")
        .when(F.col("event_type") == "signup", "rural_urban")
        .otherwise("count")
    )
    odd = F.floor(F.round(v * 100)) % 2 == 1
    gold = (
        F.when(kind == "rural_urban", F.when(odd, "rural").otherwise("urban"))
        .when(kind == "count", F.floor(v).cast("string"))
        .otherwise(F.when(odd, "yes").otherwise("no"))
    )
    rows = load(spark, sf, "events").select(
        "event_id", "user_id", kind.alias("type"), gold.alias("gold"), "value"
    )
    said = (
        F.when(e % 4 == 0, F.upper("gold"))
        .when(e % 4 == 1, F.concat(F.lit("  "), F.col("gold"), F.lit(" ")))
        .when(e % 4 == 2, F.concat(F.lit("the answer is "), F.col("gold"), F.lit(" in the north_east")))
        .otherwise(F.lit("cannot tell"))
    )
    return rows.select(
        e.alias("qid"),
        (e % 300).cast("int").alias("img_id"),
        "type",
        F.concat(F.lit("question about "), F.col("type")).alias("question"),
        "gold",
        said.alias("prediction"),
        (F.col("value") >= 2.0).alias("active"),
        F.concat(F.lit("img_"), (F.col("user_id") % 40).cast("string"), F.lit(".png")).alias("file_name"),
    )


def qa_images(spark, sf):
    """Images of the answer benchmark; image ids 280.. are missing."""
    return answers(spark, sf).where("img_id < 280").select(
        "img_id", F.concat(F.lit("img_"), F.col("img_id").cast("string"), F.lit(".tif")).alias("path")
    ).distinct()


def captions(spark, sf):
    """Reference and candidate texts, whole: (id, image_id, ref, cand, ord)."""
    swapped = F.regexp_replace("text", " (the|and|of|la|de|und|der|el) ", " this ")
    return spread(load(spark, sf, "documents"), "doc_id").select(
        F.col("doc_id").alias("id"),
        _idiv(F.col("doc_id"), 2).alias("image_id"),
        F.col("text").alias("ref"),
        swapped.alias("cand"),
        F.col("doc_id").alias("ord"),
    )


def boxes(spark, sf):
    """Reference box text and predicted box per image:
    (image_id, ord, raw, label, score, w, h, xmin, ymin, xmax, ymax)."""
    x1 = F.col("l_quantity").cast("int")
    y1 = F.floor(F.round(F.col("l_discount") * 500)).cast("int")
    side = 1 + F.floor(F.round(F.col("l_tax") * 500)).cast("int")
    x2, y2 = F.least(F.lit(100), x1 + side), F.least(F.lit(100), y1 + side)
    n = F.col("l_linenumber")
    text = F.concat(*[part for c in (x1, y1, x2, y2) for part in (F.lit("<"), c.cast("string"), F.lit(">"))])
    key = F.col("l_orderkey") + F.col("l_partkey")
    raw = F.when(key % 13 == 0, F.lit("{<5><7>}")).otherwise(F.concat(F.lit("{"), text, F.lit("}")))
    label = F.when(n % 3 == 0, F.lit(" ")).when(n % 3 == 1, F.lit("17")).otherwise(F.col("l_returnflag"))
    return spread(load(spark, sf, "lineitem"), "l_orderkey").select(
        F.col("l_orderkey").alias("image_id"),
        n.alias("ord"),
        F.col("l_partkey").alias("item"),
        raw.alias("raw"),
        label.alias("label"),
        F.round(F.col("l_extendedprice") / 110000, 6).alias("score"),
        F.lit(512).alias("w"),
        F.lit(256).alias("h"),
        ((x2 + n) * 5.12).alias("xmin"),
        ((y1 + n) * 2.56).alias("ymin"),
        ((x1 + n) * 5.12).alias("xmax"),
        ((y2 + n) * 2.56).alias("ymax"),
    )


def patches(spark, sf):
    """Patch metadata: (patch_id, s1_name, labels, split, country, key)."""
    k = F.col("o_orderkey")
    month = F.date_format("o_orderdate", "yyyyMM")
    part = load(spark, sf, "part").select("p_partkey", "p_type")
    labels = (
        load(spark, sf, "lineitem")
        .select("l_orderkey", F.col("l_partkey").alias("p_partkey"))
        .join(part, "p_partkey")
        .groupBy("l_orderkey")
        .agg(F.array_sort(F.collect_set("p_type")).alias("labels"))
    )
    nation = load(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("country"))
    customer = load(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    rows = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", month.alias("m"))
    return (
        rows.join(customer, "o_custkey", "left")
        .join(nation, "c_nationkey", "left")
        .join(labels, rows["o_orderkey"] == labels["l_orderkey"], "left")
        .select(
            F.concat_ws("_", F.lit("S2A_MSIL2A"), "m", F.concat(F.lit("T"), F.col("o_custkey") % 5), k % 100, k % 90).alias("patch_id"),
            F.concat_ws("_", F.lit("S1A_IW"), "m", k % 3, F.lit("33UUP"), k % 100, k % 90).alias("s1_name"),
            F.coalesce("labels", F.array().cast("array<string>")).alias("labels"),
            F.element_at(F.array(*[F.lit(x) for x in ("train", "train", "validation", "test")]), (k % 4 + 1).cast("int")).alias("split"),
            "country",
            k.alias("key"),
        )
    )


def annotations(spark, sf):
    """Question and caption annotations of patches."""
    pick = lambda values, by: F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))
    item = F.col("l_partkey")
    return load(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("key"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
        pick(["captioning", "binary", "mcq", "bounding_box"], item).alias("type"),
        pick(["land", "water", "urban"], F.col("l_suppkey")).alias("category"),
        pick(["spring", "summer", "autumn", "winter"], F.month("l_shipdate")).alias("season"),
        pick(["boreal", "temperate"], F.year("l_shipdate")).alias("climate_zone"),
        F.concat(F.lit("caption "), F.col("l_partkey")).alias("output"),
    )


def files(spark, sf):
    """Expected and actual file listings: (expected, actual)."""
    p = F.col("page_id")
    dataset = F.concat(F.lit("set_"), (p % 5).cast("string"))
    rows = load(spark, sf, "pages").select(
        p.alias("page_id"),
        dataset.alias("dataset"),
        F.concat(F.lit("img/"), p.cast("string"), F.lit(".tif")).alias("path"),
        F.octet_length("html").cast("long").alias("bytes"),
        F.sha2(F.col("html").cast("binary"), 256).alias("sha256"),
    )
    gone = ((F.col("page_id") % 17 == 3) & (F.col("dataset") != "set_0")) | (F.col("dataset") == "set_4")
    clean = F.col("dataset") == "set_0"
    actual = rows.where(~gone).select(
        "dataset", "path",
        F.when((F.col("page_id") % 23 == 5) & ~clean, F.col("bytes") + 1).otherwise(F.col("bytes")).alias("bytes"),
        F.when((F.col("page_id") % 29 == 7) & ~clean, F.lit("changed")).otherwise(F.col("sha256")).alias("sha256"),
    )
    return rows.drop("page_id"), actual


def embeddings(spark, sf):
    """Unit scene vectors with labels: (vec_id, split, e, labels, label)."""
    v = F.col("vec_id")
    return load(spark, sf, "embeddings").select(
        "vec_id",
        F.when(v % 3 == 0, "test").otherwise("train").alias("split"),
        F.col("embedding").cast("array<double>").alias("e"),
        F.array_distinct(F.array(F.col("label"), ((F.col("label") + v % 3) % 10).cast("int"))).alias("labels"),
        "label",
    )


def text_vectors(spark, sf):
    """The paired text vector of each scene: 0.7 of its own plus 0.3 of the next.

    Every fiftieth scene has no text.
    """
    rows = load(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    following = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("n"))
    return rows.where("vec_id % 50 <> 7").join(following, "vec_id", "left").select(
        "vec_id",
        F.zip_with("e", F.coalesce("n", "e"), lambda a, b: a * 0.7 + b * 0.3).alias("t"),
    )


def class_vectors(spark, sf):
    """One vector per class, the mean of its members: (label, name, vec)."""
    rows = load(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("d", "v"))
    means = rows.groupBy("label", "d").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return means.groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda p: p["m"]).alias("vec")
    ).select("label", F.concat(F.lit("class_"), F.col("label").cast("string")).alias("name"), "vec")


def descriptors(spark, sf):
    """Keypoints with 4x64-bit descriptors of two images:
    (image, kp, x, y, d0..d3).  Image 1 is image 0 turned, scaled and shifted,
    with a few flipped bits."""
    v = F.col("vec_id")
    word = lambda i: (v * (40503 + 2 * i) + 12345 * (i + 1)) * (69069 + i) % 9007199254740881
    base = load(spark, sf, "embeddings").select(
        "vec_id",
        (v * 37 % 512).cast("double").alias("x"),
        (v * 91 % 389).cast("double").alias("y"),
        *[word(i).cast("long").alias(f"d{i}") for i in range(4)],
    )
    left = base.select(F.lit(0).alias("image"), v.alias("kp"), "x", "y", "d0", "d1", "d2", "d3")
    right = base.select(
        F.lit(1).alias("image"),
        v.alias("kp"),
        (0.9 * F.col("x") - 0.2 * F.col("y") + 5.0).alias("x"),
        (0.2 * F.col("x") + 0.9 * F.col("y") - 3.0).alias("y"),
        F.col("d0").bitwiseXOR(v % 8).alias("d0"),
        "d1", "d2", "d3",
    )
    return left.unionByName(right)


def tokens(spark, sf):
    """Token log-probabilities of generated answers: (run_id, pos, logprob)."""
    e = F.col("event_id")
    return load(spark, sf, "events").select(
        F.when(e % 101 == 0, F.lit(-1)).otherwise(F.col("user_id")).alias("run_id"),
        e.alias("pos"),
        F.when((e % 50 == 0) | (e % 101 == 0), F.lit(float("nan"))).otherwise(-F.col("value") / 100).alias("logprob"),
    )


def payloads(spark, sf):
    """Result payloads as JSON text, right and wrong: (rid, task, payload)."""
    e = F.col("event_id")
    table = _texts(PAYLOADS)
    return (
        spread(load(spark, sf, "events"), "event_id")
        .select("event_id", "value", F.element_at(table, (e % len(PAYLOADS) + 1).cast("int")).alias("t"))
        .select(
            e.alias("rid"),
            F.col("t.task").alias("task"),
            F.replace(
                F.replace(F.col("t.text"), F.lit("{id}"), e.cast("string")),
                F.lit("{v}"),
                fixed(F.col("value"), "0.00"),
            ).alias("payload"),
        )
    )
