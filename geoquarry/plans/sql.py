"""The views of :mod:`geoquarry.plans.views` as SQL, and a helper that puts the
ones a statement names in front of it."""

import re

from geoquarry.operators.slots import SLOTS
from geoquarry.plans.templates import PAYLOADS, TEMPLATES


def quote(text):
    return "'" + text.replace("'", "''") + "'"


def sql_list(values):
    return "[" + ", ".join(quote(v) if isinstance(v, str) else str(v) for v in values) + "]"


VIEWS = {
    "v_px": """
        SELECT scene, band, ((p - 1) // 8)::INT AS y, ((p - 1) % 8)::INT AS x,
               CASE WHEN scene % 25 = 0 THEN 0.5
                    WHEN scene % 25 = 1 AND p <= 4 THEN 'nan'::DOUBLE ELSE e::DOUBLE END AS v
        FROM (SELECT (vec_id // 4)::INT AS scene, (vec_id % 4 + 1)::INT AS band,
                     unnest(embedding) AS e, unnest(range(1, 65)) AS p FROM embeddings)""",
    "v_sar": """
        SELECT a.scene, a.y, a.x, -13 + 40 * a.v AS vv, -18 + 40 * b.v AS vh
        FROM v_px a JOIN v_px b USING (scene, y, x) WHERE a.band = 1 AND b.band = 2""",
    "v_lin": """
        SELECT a.scene, a.y, a.x, pow(10.0, (-13 + 40 * a.v) / 10) AS vv, pow(10.0, (-18 + 40 * b.v) / 10) AS vh
        FROM v_px a JOIN v_px b USING (scene, y, x) WHERE a.band = 1 AND b.band = 2""",
    "v_pair": """
        SELECT scene, y, x, g0, g1, (g0 // 43)::INT AS l0, (g1 // 43)::INT AS l1 FROM (
          SELECT scene, y, x, g0,
                 least(255, g1 + CASE WHEN scene % 2 = 0 AND y BETWEEN 2 AND 4 AND x BETWEEN 2 AND 4
                                      THEN 80 ELSE 0 END)::INT AS g1
          FROM (SELECT a.scene, a.y, a.x,
                  CASE WHEN isnan(a.v) THEN 0 ELSE greatest(0, least(255, floor((a.v + 0.5) * 255))) END::INT AS g0,
                  CASE WHEN isnan(b.v) THEN 0 ELSE greatest(0, least(255, floor((b.v + 0.5) * 255))) END::INT AS g1
                FROM v_px a JOIN v_px b USING (scene, y, x) WHERE a.band = 1 AND b.band = 2))""",
    "v_slot": f"""
        SELECT scene, slot_ordinal, ({sql_list(SLOTS)})[slot_ordinal + 1] AS slot,
               ((p - 1) // 8)::INT AS y, ((p - 1) % 8)::INT AS x, e::DOUBLE AS v
        FROM (SELECT (vec_id // 14)::INT AS scene, (vec_id % 14)::INT AS slot_ordinal,
                     unnest(embedding) AS e, unnest(range(1, 65)) AS p FROM embeddings)""",
    "v_scene": """
        SELECT scene,
          (['/data/scene_' || scene || '.tif', '/data/risat_' || scene || '_vv.tif', '/data/rgb_' || scene || '.png',
            '/data/msi_' || scene || '.tif', '/data/pan_' || scene || '.xyz', '/data/s2_' || scene || '.tif',
            '/data/Frame_' || scene || '.JPG'])[scene % 7 + 1] AS path,
          ([1, 2, 3, 4, 4, 12, 13, 7])[scene % 8 + 1] AS band_count,
          (['', 'polarisation=Backscatter', 'product=Multispectral', 'operator=survey', ''])[scene % 5 + 1] AS tags,
          CASE WHEN scene % 11 = 0 THEN ' SAR ' END AS user_modality,
          CASE scene % 3 WHEN 0 THEN 'EPSG:4326' WHEN 1 THEN 'EPSG:32633' END AS crs,
          CASE WHEN scene % 3 = 1 THEN 10.0::DOUBLE ELSE 0.0001::DOUBLE END AS ta,
          CASE WHEN scene % 3 = 1 THEN 500000.0::DOUBLE + (scene % 50) * 30.0::DOUBLE ELSE 10.0::DOUBLE + (scene % 50) * 0.0003::DOUBLE END AS tc,
          CASE WHEN scene % 3 = 1 THEN 5500000.0::DOUBLE - (scene % 50) * 20.0::DOUBLE ELSE 50.0::DOUBLE - (scene % 50) * 0.0002::DOUBLE END AS tf,
          CASE WHEN scene % 9 = 0 THEN 16 ELSE 8 END AS h, CASE WHEN scene % 9 = 0 THEN 16 ELSE 8 END AS w
        FROM (SELECT DISTINCT (vec_id // 4)::INT AS scene FROM embeddings)""",
    "v_scene_pair": """
        SELECT event_id AS pair, (event_id % n)::INT AS scene0,
               CASE WHEN event_id % 10 = 0 THEN (event_id % n)::INT ELSE ((event_id * 7 + 3) % n)::INT END AS scene1
        FROM events, (SELECT max(vec_id) // 4 + 1 AS n FROM embeddings)""",
    "v_query": f"""
        SELECT event_id AS qid, ts, user_id,
               replace(({sql_list([q for _, q in TEMPLATES])})[event_id % {len(TEMPLATES)} + 1], '{{x}}', event_type) AS query,
               CASE WHEN event_id % 97 = 0 THEN 3 WHEN event_id % 3 = 0 THEN 1 ELSE 2 END AS n_inputs,
               ({sql_list([t for t, _ in TEMPLATES])})[event_id % {len(TEMPLATES)} + 1] AS gold_task
        FROM events""",
    "v_input": """
        SELECT qid AS run_id, ord::INT AS ord, (([qid % n, (qid * 7 + 3) % n, (qid * 5 + 1) % n])[ord + 1])::INT AS scene
        FROM (SELECT qid, unnest(range(0, n_inputs)) AS ord FROM v_query), (SELECT max(vec_id) // 4 + 4 AS n FROM embeddings)""",
    "v_qa": """
        SELECT qid, img_id, type, 'question about ' || type AS question, gold,
               CASE qid % 4 WHEN 0 THEN upper(gold) WHEN 1 THEN '  ' || gold || ' '
                    WHEN 2 THEN 'the answer is ' || gold || ' in the north_east' ELSE 'cannot tell' END AS prediction,
               value >= 2.0 AS active, 'img_' || (user_id % 40) || '.png' AS file_name
        FROM (SELECT event_id AS qid, (event_id % 300)::INT AS img_id, user_id, value, type,
                CASE WHEN type = 'rural_urban' THEN CASE WHEN odd THEN 'rural' ELSE 'urban' END
                     WHEN type = 'count' THEN floor(value)::BIGINT::VARCHAR
                     ELSE CASE WHEN odd THEN 'yes' ELSE 'no' END END AS gold
              FROM (SELECT *, floor(round(value * 100))::BIGINT % 2 = 1 AS odd,
                      CASE event_type WHEN 'view' THEN 'presence' WHEN 'click' THEN 'comp'
                           WHEN 'signup' THEN 'rural_urban' ELSE 'count' END AS type FROM events))""",
    "v_image": """
        SELECT DISTINCT img_id, 'img_' || img_id || '.tif' AS path FROM v_qa WHERE img_id < 280""",
    "v_cap": """
        SELECT doc_id AS id, (doc_id // 2)::INT AS image_id, text AS ref,
               regexp_replace(text, ' (the|and|of|la|de|und|der|el) ', ' this ', 'g') AS cand, doc_id AS ord
        FROM documents""",
    "v_box": """
        SELECT image_id, ord, item,
               CASE WHEN (image_id + item) % 13 = 0 THEN '{<5><7>}'
                    ELSE '{<' || x1 || '><' || y1 || '><' || x2 || '><' || y2 || '>}' END AS raw,
               CASE ord % 3 WHEN 0 THEN ' ' WHEN 1 THEN '17' ELSE flag END AS label,
               score, 512 AS w, 256 AS h,
               (x2 + ord) * 5.12::DOUBLE AS xmin, (y1 + ord) * 2.56::DOUBLE AS ymin,
               (x1 + ord) * 5.12::DOUBLE AS xmax, (y2 + ord) * 2.56::DOUBLE AS ymax
        FROM (SELECT *, least(100, x1 + side) AS x2, least(100, y1 + side) AS y2 FROM (
          SELECT l_orderkey AS image_id, l_linenumber AS ord, l_partkey AS item, l_returnflag AS flag,
                 round(l_extendedprice / 110000, 6) AS score, l_quantity::INT AS x1,
                 floor(round(l_discount * 500))::INT AS y1, 1 + floor(round(l_tax * 500))::INT AS side
          FROM lineitem))""",
    "v_patch": """
        SELECT 'S2A_MSIL2A_' || m || '_T' || (o_custkey % 5) || '_' || (k % 100) || '_' || (k % 90) AS patch_id,
               'S1A_IW_' || m || '_' || (k % 3) || '_33UUP_' || (k % 100) || '_' || (k % 90) AS s1_name,
               coalesce(labels, []) AS labels, (['train', 'train', 'validation', 'test'])[k % 4 + 1] AS split,
               n_name AS country, k AS key
        FROM (SELECT o_orderkey AS k, o_custkey, strftime(o_orderdate, '%Y%m') AS m FROM orders)
        LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey
        LEFT JOIN (SELECT l_orderkey, list_sort(list(DISTINCT p_type)) AS labels
                   FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1) ON l_orderkey = k""",
    "v_folder": """
        SELECT *, regexp_replace(patch_id, '(_[^_]*){2}$', '') AS s2_folder,
               regexp_replace(s1_name, '(_[^_]*){3}$', '') AS s1_folder FROM v_patch""",
    "v_note": """
        SELECT l_orderkey AS key, l_orderkey * 8 + l_linenumber AS id,
               (['captioning', 'binary', 'mcq', 'bounding_box'])[l_partkey % 4 + 1] AS type,
               (['land', 'water', 'urban'])[l_suppkey % 3 + 1] AS category,
               (['spring', 'summer', 'autumn', 'winter'])[month(l_shipdate) % 4 + 1] AS season,
               (['boreal', 'temperate'])[year(l_shipdate) % 2 + 1] AS climate_zone,
               'caption ' || l_partkey AS output
        FROM lineitem""",
    "v_expected": """
        SELECT page_id, 'set_' || (page_id % 5) AS dataset, 'img/' || page_id || '.tif' AS path,
               strlen(html)::BIGINT AS bytes, sha256(html) AS sha256 FROM pages""",
    "v_actual": """
        SELECT dataset, path,
               CASE WHEN page_id % 23 = 5 AND dataset <> 'set_0' THEN bytes + 1 ELSE bytes END AS bytes,
               CASE WHEN page_id % 29 = 7 AND dataset <> 'set_0' THEN 'changed' ELSE sha256 END AS sha256
        FROM v_expected WHERE NOT ((page_id % 17 = 3 AND dataset <> 'set_0') OR dataset = 'set_4')""",
    "v_emb": """
        SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'test' ELSE 'train' END AS split, embedding::DOUBLE[] AS e,
               CASE WHEN vec_id % 3 = 0 THEN [label] ELSE [label, ((label + vec_id % 3) % 10)::INT] END AS labels, label
        FROM embeddings""",
    "v_text": """
        SELECT a.vec_id, list_transform(list_zip(a.e, coalesce(b.e, a.e)), lambda p: p[1] * 0.7::DOUBLE + p[2] * 0.3::DOUBLE) AS t
        FROM v_emb a LEFT JOIN v_emb b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 50 <> 7""",
    "v_class": """
        SELECT label, 'class_' || label AS name, list(m ORDER BY d) AS vec FROM (
          SELECT label, d, avg(v) AS m FROM (
            SELECT label, unnest(e) AS v, unnest(range(0, 64)) AS d FROM v_emb) GROUP BY label, d)
        GROUP BY label""",
    "v_score": """
        SELECT vec_id, split, labels, cls, name, CASE WHEN nx * ny = 0 THEN 0.0 ELSE dot / (nx * ny) END AS score
        FROM (SELECT vec_id, split, labels, v_class.label AS cls, name, list_dot_product(e, vec) AS dot,
                     sqrt(list_dot_product(e, e)) AS nx, sqrt(list_dot_product(vec, vec)) AS ny FROM v_emb, v_class)""",
    "v_desc": """
        WITH b AS (SELECT vec_id AS v, (vec_id * 37 % 512)::DOUBLE AS x, (vec_id * 91 % 389)::DOUBLE AS y,
            (vec_id * 40503 + 12345) * 69069 % 9007199254740881 AS d0,
            (vec_id * 40505 + 24690) * 69070 % 9007199254740881 AS d1,
            (vec_id * 40507 + 37035) * 69071 % 9007199254740881 AS d2,
            (vec_id * 40509 + 49380) * 69072 % 9007199254740881 AS d3 FROM embeddings)
        SELECT 0 AS image, v AS kp, x, y, d0, d1, d2, d3 FROM b UNION ALL
        SELECT 1, v, 0.9::DOUBLE * x - 0.2::DOUBLE * y + 5.0::DOUBLE, 0.2::DOUBLE * x + 0.9::DOUBLE * y - 3.0::DOUBLE,
               xor(d0, v % 8), d1, d2, d3 FROM b""",
    "v_tok": """
        SELECT CASE WHEN event_id % 101 = 0 THEN -1 ELSE user_id END AS run_id, event_id AS pos,
               CASE WHEN event_id % 50 = 0 OR event_id % 101 = 0 THEN 'nan'::DOUBLE ELSE -value / 100 END AS logprob
        FROM events""",
    "v_payload": f"""
        SELECT event_id AS rid, ({sql_list([t for t, _ in PAYLOADS])})[event_id % {len(PAYLOADS)} + 1] AS task,
               replace(replace(({sql_list([p for _, p in PAYLOADS])})[event_id % {len(PAYLOADS)} + 1],
                               '{{id}}', event_id::VARCHAR), '{{v}}', printf('%.2f', value)) AS payload
        FROM events""",
}


def with_views(statement, extra=None):
    """``statement`` preceded by the views it names, directly or through others."""
    known = {**VIEWS, **(extra or {})}
    order = []

    def visit(text):
        for name in known:
            if name not in order and re.search(rf"\b{name}\b", text):
                visit_name(name)

    def visit_name(name):
        body = known[name]
        for other in known:
            if other != name and other not in order and re.search(rf"\b{other}\b", body):
                visit_name(other)
        if name not in order:
            order.append(name)

    visit(statement)
    if not order:
        return statement
    heads = ", ".join(f"{n} AS ({known[n].strip()})" for n in order)
    return f"WITH {heads} {statement.strip()}"
