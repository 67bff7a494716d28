import collections

import corpus_pipeline
from geoquarry.llm import packing

from test_similar import brute_groups


def test_stages_on_the_small_tables(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = str(tmp_path / name)
        stage(spark, before, small).write.parquet(path)
        after = spark.read.parquet(path)
        assert after.columns == names, name
        was, now = (collections.Counter(r["doc_id"] for r in d.select("doc_id").collect()) for d in (before, after))
        assert set(now) <= set(was)
        if name == "near_duplicates":
            texts = [r["text"] for r in before.orderBy("doc_id").collect()]
            assert after.count() == len(set(brute_groups(texts))) and max(now.values()) == 1
        if name == "personal_data":
            assert now == was
        before = after
    got = corpus_pipeline.STAGES[-1][1](spark, before, small).toPandas()
    tokens = packing.ChunkTokens(packing.tokenizer_path())
    assert got["length"].sum() == sum(len(tokens.ids(r["text"] or "")) // 4 + 1 for r in before.collect())
    assert corpus_pipeline.run(spark, small).count() == len(got)


def test_queries_agree_with_their_sql(spark, small):
    import duckdb

    from geoquarry.llm import queries

    for name, sql in queries.ORACLE.items():
        base = duckdb.connect()
        for t in ("documents", "embeddings", "conversations"):
            base.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
        want, got = base.execute(sql).df(), queries.QUERIES[name](spark, small).toPandas()
        order = sorted(want.columns)
        assert sorted(got.columns) == order
        a, b = (d[order].convert_dtypes().sort_values(order).reset_index(drop=True).astype(str) for d in (got, want))
        assert a.equals(b), name


#: Names that the operators' own plans use.
CLASHES = ["spans", "_h", "_d", "_b", "_more", "_m_take", "_m_size", "_m_id", "_m_takes", "_r_n", "_r_id", "_r_own", "root", "node", "body", "fp", "sig", "par", "_key", "taken"]


def test_stages_pass_on_columns_of_any_name(spark, small):
    rows = [(1, "a b c d e f g one@example.org", "x"), (1, "a b c d e f g one@example.org", "x"), (2, None, None), (3, "", "y"), (None, "k l m n o p", "y")]
    names = ["doc_id", "text", "source", *CLASHES]
    docs = spark.createDataFrame([(*r, *(f"{c} {i}" for c in CLASHES)) for i, r in enumerate(rows)], "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in CLASHES))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for given in (docs, docs.limit(0)):
            out = stage(spark, given, small)
            assert out.columns == names, name
            kept = out.collect()
            assert all(r[c].startswith(f"{c} ") for r in kept for c in CLASHES), name
            if name == "personal_data":
                assert len(kept) == given.count() and all("@" not in (r["text"] or "") for r in kept)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count() == 5 and corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), small).count() == 0
