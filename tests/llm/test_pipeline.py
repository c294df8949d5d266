"""The pipeline's stages against their operators, and the registered queries against SQL, on the smallest given tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline as cp
from fluorite.llm import decontam, minhash, quality, queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables aren't here")


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert [n for n, _ in cp.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "packing"]
    one = cp.stage(cp.keep_quality(spark, docs, DATA))
    model = quality.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    assert ids(one) == ids(quality.score(docs, model).where("quality_score >= 0.3")) and one.columns == columns
    two = cp.stage(cp.keep_one_of_near_duplicates(spark, one, DATA))
    assert ids(two) == ids(minhash.near_duplicates(one).where("kept")) and two.columns == columns
    three = cp.stage(cp.drop_benchmark_leaks(spark, two, DATA))
    assert ids(three) == ids(two) - ids(decontam.contaminated(two, spark.read.parquet(f"{DATA}/benchmark.parquet"))) and three.columns == columns
    four = cp.stage(cp.redact_secrets(spark, three, DATA))
    assert ids(four) == ids(three) and four.columns == columns
    assert four.where("text rlike '(?i)token = \"[0-9a-f]{40}'").count() == 0
    five = cp.pack_sequences(spark, four, DATA)
    assert ids(five) == ids(four)


def test_stages_take_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, no rows, and columns with the names that the operators use."""
    d = f"file://{tmp_path}"
    good = [(k, f"The river near our town number {k} was calm and the people of the small village went home.", "en", f"s{k % 3}", 90) for k in range(40)]
    rows = [*good, (1, good[1][1], "en", "s1", 90), (100, None, None, None, None), (101, "", "en", "s1", 0), (102, "word " * 50_000, "en", "s0", 250_000), (None, good[2][1], "en", "s2", 90), (103, good[3][1], "de", "s2", 90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = ["quality_score", "secrets", "component_id", "kept", "h", "row", "found", "queue", "n", "ids", "node", "band"]
    docs = docs.select("*", *[F.lit(f"my {c}").alias(c) for c in clash])
    labels = spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(40)] + [(None, 1, 1), (100, None, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "a question of the benchmark that no document here has " * 2), (2, None), (None, "x")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs.write.parquet(f"{d}/documents.parquet")
    for start in (docs, docs.limit(0)):
        at = start
        for name, f in cp.STAGES[:-1]:
            out = cp.stage(f(spark, at, d))
            assert out.schema.simpleString() == at.schema.simpleString(), name
            assert {tuple(r[c] for c in clash) for r in out.collect()} <= {tuple(f"my {c}" for c in clash)}
            if name != "quality":  # the classifier may reject anything of this toy table
                kept = sorted(str(r.doc_id) for r in out.collect())
                assert kept == sorted(str(r.doc_id) for r in at.collect() if name != "near_duplicates" or r.doc_id != 103 or not any(x.doc_id == 3 for x in at.collect()))
            at = out if name != "quality" else start
        pieces = cp.pack_sequences(spark, at, d).collect()
        assert len({r.doc_id for r in pieces}) == at.select("doc_id").distinct().count()


def test_queries_against_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, DATA)
        got = con.execute(sql)
        names = [c[0] for c in got.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(got.fetchall()), name


def test_registered():
    names = set(__spark_entry__.queries())
    assert {"pipeline", *queries.queries()} <= names and set(__spark_entry__.oracle_sql()) <= names
