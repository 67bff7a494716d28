"""Centroid clustering in whole numbers, nearest centroids by a vantage-point tree."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from geoquarry.llm.common import table
from geoquarry.session import reliable_checkpoint

#: Components and scale of a vector; centroids; rounds; centroids in a leaf of the tree.
DIM, SCALE, CENTROIDS, ROUNDS, LEAF = 64, 256.0, 40, 5, 4
#: Whole components below this size have squared distances that fit a long.
LIMIT = 1 << 27
#: Vectors searched at once.
_ROWS = 4096


class VantageTree:
    """Centroids below balls: of a node's centroids the nearer half lies inside the ball of its vantage point.

    ``nodes`` holds, per inner node, (vantage number, nearer child, its squared
    radii, farther child, its squared radii) and, per leaf, the numbers in it.
    The radii are the least and the largest distance of a child's centroids from
    the vantage point, which is itself an entry of the nearer child.
    """

    def __init__(self, centroids, leaf=LEAF):
        self.centroids, self.nodes = np.asarray(centroids, np.int64), []
        self._grow(np.arange(len(self.centroids)), leaf)

    def _grow(self, members, leaf):
        at = len(self.nodes)
        self.nodes.append(members)
        if len(members) <= leaf:
            return at
        middle = self.centroids[members].mean(0)
        # a point at the rim splits better than one in the middle
        vantage = members[np.argmax(((self.centroids[members] - middle) ** 2).sum(1))]
        far = squared(self.centroids[members], self.centroids[vantage])
        order = np.argsort(far, kind="stable")
        half = (len(members) + 1) // 2
        near_part, far_part = order[:half], order[half:]
        sides = []
        for part in (near_part, far_part):
            sides += [self._grow(members[part], leaf), (int(far[part].min()), int(far[part].max()))]
        self.nodes[at] = (int(vantage), *sides)
        return at

    def nearest(self, vectors):
        """Number and squared distance of the nearest centroid of each row; of equally near ones the smallest number.

        Best first: a row always opens, of the nodes it has reached, the one with
        the smallest lower bound, until that bound is above its best distance.  A
        bound equal to it is still opened, so no tie is missed.  Bounds come from
        the triangle inequality in floating point and are lowered by a relative
        slack; distances are exact whole numbers.
        """
        n = len(vectors)
        best, number = np.full(n, np.iinfo(np.int64).max), np.full(n, len(self.centroids))
        bound = np.full((n, len(self.nodes)), np.inf)
        bound[:, 0] = 0.0
        open_rows = np.arange(n)
        while len(open_rows):
            at = bound[open_rows].argmin(1)
            low = bound[open_rows, at]
            on = low * low <= best[open_rows]
            open_rows, at, low = open_rows[on], at[on], low[on]
            bound[open_rows, at] = np.inf
            for node in np.unique(at):
                here = at == node
                rows = open_rows[here]
                inner = self.nodes[node]
                if isinstance(inner, np.ndarray):
                    for c in inner:
                        self._meet(vectors, rows, int(c), best, number)
                    continue
                vantage, *sides = inner
                away = np.sqrt(self._meet(vectors, rows, vantage, best, number).astype(np.float64))
                for child, (least, most) in (sides[:2], sides[2:]):
                    low_child = np.maximum(away - np.sqrt(float(most)), np.sqrt(float(least)) - away)
                    low_child -= 1e-9 * (away + np.sqrt(float(most)) + 1)
                    bound[rows, child] = np.maximum(low[here], np.maximum(low_child, 0.0))
        return number, best

    def _meet(self, vectors, rows, c, best, number):
        away = squared(vectors[rows], self.centroids[c])
        better = (away < best[rows]) | ((away == best[rows]) & (c < number[rows]))
        best[rows[better]], number[rows[better]] = away[better], c
        return away


def squared(vectors, point):
    """Exact squared distances of whole-number rows."""
    difference = vectors - point
    return np.einsum("ij,ij->i", difference, difference)


def whole_rows(column, dim=DIM, scale=SCALE):
    """(rows kept, their whole-number vectors) of an Arrow list column: ``dim`` components, none null or non-finite."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    fit = np.flatnonzero(size == dim)
    flat = column.take(pa.array(fit)).flatten().cast(pa.float64())
    # a null component reads as NaN
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    good = np.isfinite(x).all(1)
    whole = np.floor(x[good] * scale)
    if np.abs(whole).max(initial=0) >= LIMIT:
        raise ValueError(f"scaled components of {LIMIT} and more have distances beyond a long")
    return fit[good], whole.astype(np.int64)


def kept_rows(vectors, vector_col="embedding", dim=DIM):
    """The rows of ``vectors`` that take part."""
    x = F.col(vector_col)
    usable = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    return vectors.where(x.isNotNull() & (F.size(x) == dim) & usable)


def first_centroids(vectors, k=CENTROIDS, prefix="2:", id_col="vec_id", vector_col="embedding", dim=DIM, scale=SCALE):
    """The ``k`` whole-number vectors with the smallest SHA-256 of ``prefix`` and id, in that order.

    Rows of one id follow by their components; those without an id come last.
    """
    label = F.sha2(F.concat(F.lit(prefix), F.col(id_col).cast("string")), 256)
    rows = kept_rows(vectors, vector_col, dim).select(label.alias("h"), F.transform(vector_col, lambda v: F.floor(v.cast("double") * scale)).alias("x"))
    # bounded by the number of centroids
    chosen = rows.orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()
    return np.array([r["x"] for r in chosen], np.int64).reshape(-1, dim)


def nearest_centroids(vectors, centroids, id_col="vec_id", vector_col="embedding", scale=SCALE, leaf=LEAF):
    """``id``, ``cluster`` and ``distance`` (squared) of each row that takes part; the tree over ``centroids`` goes to every task."""
    tree = vectors.sparkSession.sparkContext.broadcast(VantageTree(centroids, leaf))
    kind, dim = vectors.schema[id_col].dataType.simpleString(), centroids.shape[1]

    def run(batches):
        for batch in batches:
            at, x = whole_rows(batch.column(1), dim, scale)
            for i in range(0, len(at), _ROWS):
                number, distance = tree.value.nearest(x[i : i + _ROWS])
                ids = batch.column(0).take(pa.array(at[i : i + _ROWS]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(number, pa.int32()), pa.array(distance)], names=["id", "cluster", "distance"])

    return vectors.select(id_col, vector_col).mapInArrow(run, f"id {kind}, cluster int, distance long")


def moved_centroids(vectors, centroids, vector_col="embedding", scale=SCALE, leaf=LEAF):
    """The centroids after one round: the floor of the exact mean of each one's vectors; without vectors it stays.

    A task adds up its own rows and sends one row of sums per centroid.
    """
    tree = vectors.sparkSession.sparkContext.broadcast(VantageTree(centroids, leaf))
    k, dim = centroids.shape

    def run(batches):
        total, count = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            _, x = whole_rows(batch.column(0), dim, scale)
            for i in range(0, len(x), _ROWS):
                number, _ = tree.value.nearest(x[i : i + _ROWS])
                np.add.at(total, number, x[i : i + _ROWS])
                count += np.bincount(number, minlength=k)
        some = np.flatnonzero(count)
        ends = pa.array(np.arange(len(some) + 1) * dim, pa.int32())
        sums = pa.ListArray.from_arrays(ends, pa.array(total[some].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[some]), sums], names=["cluster", "n", "sums"])

    parts = vectors.select(vector_col).mapInArrow(run, "cluster int, n long, sums array<long>")
    added = parts.groupBy("cluster").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i].cast("decimal(20,0)")) for i in range(dim)]).alias("sums")
    )
    moved = centroids.copy()
    # one row for each centroid
    for r in added.collect():
        moved[r["cluster"]] = [int(s) // r["n"] for s in r["sums"]]
    tree.unpersist()
    return moved


def cluster(vectors, k=CENTROIDS, rounds=ROUNDS, id_col="vec_id", vector_col="embedding", dim=DIM, scale=SCALE, leaf=LEAF):
    """(``id``, ``cluster``, ``distance`` of each vector, the final centroids), after ``rounds`` rounds and a last assignment.

    Each round builds a :class:`VantageTree` over the centroids and broadcasts it,
    ``k`` vectors in size; the driver sees ``k`` rows of sums a round.  Vectors that are null, of
    another length, or hold null or non-finite components take no part; scaled
    components of 2^27 and more fail, as their distances would not fit a long.
    Rows without an id are clustered like others and seed last; repeated rows count
    as often as they come; fewer than ``k`` vectors give fewer centroids, an empty
    table no rows; other columns are not read.
    """
    centroids = first_centroids(vectors, k, id_col=id_col, vector_col=vector_col, dim=dim, scale=scale)
    if not len(centroids):
        kind = vectors.schema[id_col].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"id {kind}, cluster int, distance long"), centroids
    for _ in range(rounds):
        centroids = moved_centroids(vectors, centroids, vector_col, scale, leaf)
    return nearest_centroids(vectors, centroids, id_col, vector_col, scale, leaf), centroids


def digest(centroid):
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def op12_centroids(spark, folder):
    found, centroids = cluster(table(spark, folder, "embeddings"))
    found = reliable_checkpoint(found)
    names = spark.createDataFrame([(i, digest(c)) for i, c in enumerate(centroids)], "cluster int, centroid_sha256 string")
    each = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    known = each.join(names, "cluster").crossJoin(each.agg(F.sum("cluster_inertia").alias("inertia")))
    # a row for each centroid
    return found.join(F.broadcast(known), "cluster").select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _sql(k=CENTROIDS, rounds=ROUNDS, dim=DIM, scale=int(SCALE)):
    steps = [f"""
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, [floor({scale} * x::DOUBLE)::BIGINT FOR x IN embedding] AS x
      FROM embeddings WHERE len(embedding) = {dim} AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, x) - 1 AS c, x
      FROM v QUALIFY c < {k})"""]
    nearest = """
a{i} AS (SELECT r, any_value(v.x) AS x, min((list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(v.x, o.x)])::BIGINT, o.c)) AS m
      FROM v, c{i} o GROUP BY r)"""
    for i in range(rounds):
        steps.append(nearest.format(i=i))
        steps.append(f"""
u{i} AS (SELECT m[2] AS c, d, floor_div(sum(x[d])::HUGEINT, count(*)) AS s FROM a{i}, range(1, {dim + 1}) t(d) GROUP BY 1, 2),
c{i + 1} AS (SELECT o.c, coalesce(n.x, o.x) AS x FROM c{i} o
      LEFT JOIN (SELECT c, list(s ORDER BY d) AS x FROM u{i} GROUP BY 1) n ON n.c = o.c)""")
    steps.append(nearest.format(i=rounds))
    text = ",".join(steps)
    # whole-number floor of a quotient, also below zero
    text = text.replace("floor_div(sum(x[d])::HUGEINT, count(*))", "((sum(x[d]) - ((sum(x[d]) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT")
    return text + f"""
SELECT v.vec_id, (m[2])::INTEGER AS cluster, m[1]::BIGINT AS distance, (sum(m[1]) OVER (PARTITION BY m[2]))::BIGINT AS cluster_inertia,
       (sum(m[1]) OVER ())::BIGINT AS inertia, sha256(array_to_string(o.x, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN c{rounds} o ON o.c = m[2]"""


SQL = _sql()
