"""Upper medians come from counts of distinct values, not from one array per key."""

import random

from finloom.operators import balance, integrity


def test_upper_medians(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice([None, *range(-9, 9)])) for k in (0, 0, 1, 2, 2, 2, None) for _ in range(rng.randint(1, 30))] + [(7, 5), (8, None)]
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    got = {r.account: (r.m, r.n) for r in balance.upper_medians(spark.createDataFrame(rows, "account long, balance long"), "account", "balance", "m").collect()}
    assert got == {k: (sorted(v)[len(v) // 2], len(v)) for k, v in groups.items() if k is not None}


def test_no_array_per_key(spark):
    tx = spark.createDataFrame([(1, 1)], "account long, balance long")
    meta = spark.createDataFrame([("f", "b", 1, 1)], "file string, bank string, pages long, file_size long")
    for df in (balance.without_outliers(tx), integrity.batch_outliers(meta)):
        assert "collect_list" not in df._jdf.queryExecution().toString()
