"""The stream and the table give the same windows."""

import datetime as dt
import zlib

from gaugeworks.streaming.churn import windowed_churn

SCHEMA = "repo_id string, ts timestamp, added int, deleted int"


def test_stream_equals_table(spark, tmp_path):
    rows = [("r", dt.datetime(2024, 1, 1 + d, h), d, h) for d in range(6) for h in (1, 13)]
    table = spark.createDataFrame(rows, SCHEMA)
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    query = windowed_churn(stream, "2 days", "1 day").writeStream.outputMode("complete").format("memory").queryName("churn").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    got = sorted(tuple(r) for r in spark.table("churn").collect())
    assert got == sorted(tuple(r) for r in windowed_churn(table, "2 days", "1 day").collect())
    assert len(got) == 7


def test_gaps_of_a_stream_equal_those_of_the_table(spark, tmp_path):
    """Changes out of order, ties and repeats, in batches with a restart between them."""
    import random

    from pyspark.sql import functions as F

    from gaugeworks.operators import temporal
    from gaugeworks.streaming.gaps import write_gaps

    schema = "repo_id string, path string, hash string, ts timestamp"
    rng = random.Random(6)
    start = dt.datetime(2024, 1, 1)
    rows = [(f"r{k % 2}", f"p{rng.randrange(3)}", f"h{rng.randrange(50)}", start + dt.timedelta(hours=6 * k + rng.randrange(-60, 60))) for k in range(160)]
    rows += rows[40:43] + [("r0", "p0", "x", rows[50][3]), ("r0", "p0", "a", rows[50][3]), ("r9", "alone", "h", rows[20][3])]
    rows.sort(key=lambda r: r[3] + dt.timedelta(hours=zlib.crc32(r[2].encode()) % 40))  # never later than the watermark allows
    batches = [rows[k : k + 55] for k in range(0, len(rows), 55)]
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)

    def run(some):
        for b in some:
            spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(folder)
            query = write_gaps(spark.readStream.schema(schema).parquet(folder), out, state, "5 days")
            query.processAllAvailable()
            query.stop()  # each batch is a restart

    try:
        run(batches)
        table = spark.createDataFrame(rows, schema)
        gaps = temporal.change_gaps(table)
        part = spark.read.parquet(out)
        assert 0 < part.count() < gaps.count()
        run([[("end", "end", "e", start + dt.timedelta(days=400))]])
    finally:
        spark.conf.set(provider, before)
    got = spark.read.parquet(out)
    plain = lambda df: sorted((r["repo_id"], r["path"], round(r["gap_days"], 9)) for r in df.collect())
    assert plain(got) == plain(gaps)
    repos = table.select("repo_id").distinct()
    steady = lambda df: {r["repo_id"]: r["commit_stability"] for r in df.collect()}
    assert steady(temporal.stability_of_gaps(repos, got)) == steady(temporal.commit_stability(table))
    assert steady(temporal.stability_of_gaps(repos, got))["r9"] == temporal.QUIET_DAYS
    assert got.where(F.col("gap_days") == 0).count() >= 3
