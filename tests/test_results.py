"""Committed results of streams, and models that change between micro-batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.operators.models import ModelStore, serve
from scanloom.sources.results import ResultSink, read_results


@pytest.fixture(scope="module")
def sinks(spark):
    spark.dataSource.register(ResultSink)
    return spark


def feed(spark, path, rows, kind="k long, v double"):
    spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(path)


def run(spark, tmp_path, keep, check, change=lambda s: s):
    s = change(spark.readStream.schema("k long, v double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    q = s.writeStream.format("scan_results").options(path=f"{tmp_path}/out-{keep}", keep=keep).option("checkpointLocation", f"{tmp_path}/{check}").trigger(availableNow=True).start()
    q.awaitTermination()


def test_latest_wins_or_none_is_dropped(sinks, tmp_path):
    for n in range(4):
        feed(sinks, f"{tmp_path}/in", [(n, float(i)) for i in range(3)])
        for keep in ("latest", "all"):
            run(sinks, tmp_path, keep, f"check-{keep}")
    feed(sinks, f"{tmp_path}/in", [])
    run(sinks, tmp_path, "latest", "check-latest")
    read = lambda keep: sorted(r["k"] for r in read_results(sinks, f"{tmp_path}/out-{keep}", "k long, v double", keep).collect())
    assert read("latest") == [3, 3, 3] and read("all") == [n for n in range(4) for _ in range(3)]
    files = [f.name for f in (tmp_path / "out-latest").iterdir() if not f.name.startswith(".")]
    assert sum(f.startswith("commit") for f in files) <= 2 and sum(f.startswith("part") for f in files) <= 2


def test_a_failed_batch_leaves_the_last_commit(sinks, tmp_path):
    feed(sinks, f"{tmp_path}/in", [(1, 1.0)])
    run(sinks, tmp_path, "latest", "check")
    feed(sinks, f"{tmp_path}/in", [(2, 2.0), (3, -1.0)])
    bad = lambda s: s.withColumn("v", F.when(F.col("v") < 0, F.raise_error(F.lit("no")).cast("double")).otherwise(F.col("v")))
    with pytest.raises(Exception):
        run(sinks, tmp_path, "latest", "check", bad)
    read = lambda: sorted(r["k"] for r in read_results(sinks, f"{tmp_path}/out-latest", "k long, v double", "latest").collect())
    assert read() == [1]
    run(sinks, tmp_path, "latest", "check")  # the batch runs again, sound this time
    assert read() == [2, 3]
    assert read_results(sinks, f"{tmp_path}/nothing", "k long, v double").count() == 0


def test_a_model_changes_between_batches_only(spark, tmp_path):
    def scaled(weights):
        import numpy

        return lambda batch: numpy.stack((batch * weights["by"], batch * 0), axis=1)

    models, got = ModelStore(f"{tmp_path}/models", "net", scaled), []
    models.put(9, by=np.array(1.0))

    def write(out, batch):
        models.put(10 + batch, by=np.array(10.0 + batch))  # a new version comes while the batch is under way
        got.append([(r["model_version"], r["amp"][0] / (r["frame_id"] + 1)) for r in out.collect()])

    for n in range(3):
        spark.range(n * 40, n * 40 + 40, numPartitions=4).select(F.col("id").alias("frame_id"), F.array(*[F.col("id") + 1.0] * 4).alias("amp")).write.mode("append").parquet(f"{tmp_path}/in/{n}")
        s = spark.readStream.schema("frame_id long, amp array<double>").parquet(f"{tmp_path}/in/*")
        s.writeStream.option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).foreachBatch(serve(models, 2, write)).start().awaitTermination()
    assert [sorted(set(b)) for b in got] == [[(9, 1.0)], [(10, 10.0)], [(11, 11.0)]] and [len(b) for b in got] == [40] * 3
    with pytest.raises(Exception, match="no version"):
        serve(ModelStore(f"{tmp_path}/none", "net", scaled), 2, write)(spark.range(1), 0)
