"""Streams over files give what the batch operators give."""

import pytest
from pyspark.sql import functions as F

from finloom.operators import balance as B
from finloom.sources import tables as S
from finloom.streaming import ledger as L


@pytest.fixture(scope="module")
def stream(spark, sf_dir, tmp_path_factory):
    base = tmp_path_factory.mktemp("stream")
    batch = B.with_running_balance(S.events(spark, sf_dir)).withColumn("ts", F.col("ts").cast("timestamp"))
    batch.orderBy("ts").coalesce(1).write.parquet(f"{base}/in")
    source = lambda: spark.readStream.schema(batch.schema).parquet(f"{base}/in")
    return batch.cache(), source, base


def run(df, base, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{base}/ck-{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_daily_close(stream):
    batch, source, base = stream
    got = run(L.daily_close(source()), base, "daily", "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, B.end_of_day(batch).select("account", "date", "eod_balance").collect()))


def test_activity_and_sessions(stream):
    batch, source, base = stream
    assert run(L.activity(source(), slide="12 hours"), base, "act", "complete").agg(F.sum("n_rows")).first()[0] == 2 * batch.count()
    assert run(L.sessions(source()), base, "sess", "append").count() > 0


def test_running_balance(stream):
    batch, source, base = stream
    got = run(L.running_balance(source()), base, "bal", "append")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.select("account", "row_ord", "balance").collect()))


def test_deduplicated(stream):
    batch, source, base = stream
    assert run(L.deduplicated(source(), ["account", "kind"], "60 days"), base, "dd", "append").count() == batch.select("account", "kind").distinct().count()


def test_returned_transfers(stream):
    batch, source, base = stream
    near = "c.account = d.account AND c.credit = d.debit AND c.ts >= d.ts AND c.ts <= d.ts + INTERVAL 9 DAYS"
    want = batch.where("debit > 0").alias("d").join(batch.where("credit > 0").alias("c"), F.expr(near)).count()
    assert run(L.returned_transfers(source()), base, "ret", "append").count() == want
