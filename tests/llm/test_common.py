"""What operators share."""

from pyspark.sql import functions as F

from canongraph.llm import chunkstore
from canongraph.llm.common import ROW, small


def _sent(df) -> bool:
    return "strategy=broadcast" in df._jdf.queryExecution().analyzed().toString()


def test_small_by_rows_and_bytes(spark):
    ids = spark.range(100).select("id", F.lit(None).cast("long").alias("x.y"))
    assert _sent(small(ids, 100)) and not _sent(small(ids, 99))
    assert _sent(small(ids, size=100 * (ROW + 16))) and not _sent(small(ids, size=100 * (ROW + 16) - 1))
    assert _sent(small(ids.limit(0), 0, 0))


def test_small_measures_values(spark):
    texts = spark.range(10).select("id", F.when(F.col("id") > 0, F.lit("x" * 1000)).alias("t"))
    assert _sent(small(texts, size=10_000)) and not _sent(small(texts, size=9_000))
    nested = texts.select(F.struct("id", F.struct("t").alias("u")).alias("s"), F.array("t").alias("a"))
    assert _sent(small(nested, size=30_000)) and not _sent(small(nested, size=18_000))
    assert sorted(small(texts, size=9_000).collect()) == sorted(texts.collect())


def test_chunks_are_kept_once(spark):
    one = ("chunk", b"a", 2, b"1234", None, None, None)
    rows = [one, ("recipe", b"c", None, None, 1, 2, [b"a"]), one, ("recipe", b"d", None, None, None, 2, [b"a"]), ("chunk", b"b", 2, b"5678", None, None, None), one]
    types = "kind string, address binary, n int, ids binary, doc_id long, n_tokens long, addresses array<binary>"
    got = chunkstore._once(spark.createDataFrame(rows, types).repartition(3))
    assert sorted((r.kind, bytes(r.address)) for r in got.collect()) == [("chunk", b"a"), ("chunk", b"b"), ("recipe", b"c"), ("recipe", b"d")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ArrowInPandas" not in plan and "MapInArrow" not in plan
