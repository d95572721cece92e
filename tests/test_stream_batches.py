"""Queries whose streams take their rows in many micro-batches."""

import pytest
from pyspark.sql import functions as F

from tests.test_oracles import SF, duck, plain  # noqa: F401
from tidemark.plans import registry, streams
from tidemark.streaming.streams import run_in_batches


@pytest.mark.parametrize("name,most", [("op_stream_running_median", 90)])
def test_many_batches_give_the_rows_of_the_sql(spark, duck, monkeypatch, tmp_path, name, most):  # noqa: F811
    at = str(tmp_path / "stream")
    monkeypatch.setattr(streams, "folder", lambda *_: at)
    frame = getattr(streams, name)(spark, SF, most=most)
    cursor = duck.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr) == sorted((tuple(map(plain, r)) for r in cursor.fetchall()), key=repr)
    sizes = spark.read.parquet(f"{at}/whole").groupBy("_batch").count().agg(F.count("*"), F.max("count")).first()
    assert sizes[0] > 5 and sizes[1] < 1.5 * most


def test_a_batch_is_many_files(spark, tmp_path):
    """A batch is written by as many tasks as have its rows, none of which takes it whole, and batches come in order."""
    rows = spark.range(0, 3000, 1, 6).select("id", (F.col("id") % 50).alias("k"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        out = run_in_batches(rows, F.when(F.col("id") % 4 < 3, F.col("id") % 4), lambda s: s.withColumn("t", F.current_timestamp()), str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = out.groupBy((F.col("id") % 4).alias("b")).agg(F.count("*").alias("n"), F.min("t").alias("a"), F.max("t").alias("z")).orderBy("b").collect()
    assert [(r["b"], r["n"]) for r in got] == [(b, 750) for b in range(3)] and got[0]["z"] < got[1]["a"] and got[1]["z"] < got[2]["a"]
    assert len(list((tmp_path / "parts").glob("*.parquet"))) > 6
