from __future__ import annotations

import random
from itertools import accumulate

from pyspark.sql import functions as F

from fernwalk.operators import running


def test_sums_over_ranges(spark):
    r = random.Random(2)
    rows = [(i, r.choice([0.5, 1.0, None]), r.randint(0, 9) if i % 11 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, score double, v long").repartition(7)
    order = (("score", True), ("id", False))
    got = {x.id: x.used for x in running.running_sum(df, F.col("v"), order).collect()}
    ranked = sorted(rows, key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))
    want = dict(zip((x[0] for x in ranked), accumulate(x[2] or 0 for x in ranked), strict=True))
    assert got == want
    cut = running.running_sum(df, F.col("v"), order, 5000)
    assert {x.id: x.used for x in cut.collect()} == {k: v for k, v in want.items() if v <= 5000}
    assert cut.columns == ["id", "score", "v", "used"]


def test_only_the_sums_of_ranges_meet_in_one_place(spark):
    df = spark.range(1000).select("id", F.rand(1).alias("score"), F.lit("abc").alias("s"))
    plan = running.select_within_total(df, 30, keys=("id",))._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan  # the sums were written before; no row of the table goes through one task
    assert running.select_within_total(df, 30, keys=("id",)).count() == 10


def test_no_rows(spark):
    none = spark.createDataFrame([], "id long, score double, s string")
    assert running.select_within_total(none, 30, keys=("id",)).isEmpty()
