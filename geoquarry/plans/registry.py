"""Named queries and the SQL that must give the same rows."""

from geoquarry.plans.sql import with_views

QUERIES, ORACLE = {}, {}


def query(name, sql=None, views=None, types=None):
    """Register a query function ``(spark, sf) -> DataFrame``.

    ``types`` casts result columns of the SQL whose inferred type is wider than
    Spark's, such as sums of whole numbers.
    """

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            text = sql
            if types:
                casts = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in types.items())
                text = f"SELECT * REPLACE ({casts}) FROM ({sql.strip()})"
            ORACLE[name] = with_views(text, views)
        return fn

    return add
