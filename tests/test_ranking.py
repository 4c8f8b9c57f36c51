"""Ordered operators against the plain window they replace, with hot keys and heavy ties."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from trustlake.operators import ranking


def _skewed(spark, n=6000):
    """Two thirds of the rows in key 0, a third of them at one single ts."""
    return spark.range(n).select(
        "id",
        F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id") % 7).alias("k"),
        F.when(F.col("id") % 3 == 0, 500).otherwise((F.col("id") * 7919) % 1009).cast("bigint").alias("ts"),
        ((F.col("id") * 31) % 17).alias("x"),
    )


def _rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_running_sums_equals_window(spark):
    df = _skewed(spark)
    got = ranking.running_sums(df, ["k"], ["ts", "id"], {"s": F.col("x")}, totals=True)
    w = Window.partitionBy("k").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("s", F.coalesce(F.sum("x").over(w), F.lit(0))).withColumn(
        "s_total", F.sum("x").over(Window.partitionBy("k"))
    )
    assert _rows(got, "id", "s", "s_total") == _rows(want, "id", "s", "s_total")


def test_running_sums_keeps_null_keys(spark):
    df = _skewed(spark, 300).withColumn("k", F.when(F.col("k") != 0, F.col("k")))
    got = ranking.global_rank(df, ["k"], ["ts", "id"])
    w = Window.partitionBy("k").orderBy("ts", "id")
    want = df.withColumn("rank0", F.row_number().over(w) - 1)
    assert _rows(got, "id", "rank0") == _rows(want, "id", "rank0")


def test_global_rank_without_key(spark):
    df = _skewed(spark)
    got = ranking.global_rank(df, [], [F.desc("ts"), "id"], totals=True)
    want = df.withColumn("rank0", F.row_number().over(Window.orderBy(F.desc("ts"), "id")) - 1)
    assert _rows(got, "id", "rank0") == _rows(want, "id", "rank0")
    assert got.select("rank0_total").distinct().collect()[0][0] == 6000


def test_strict_history_with_ties_over_many_slices(spark):
    df = _skewed(spark)
    got = ranking.strict_history(df, ["k"], "ts", "id", {"n": F.lit(1), "s": F.col("x")})
    w = Window.partitionBy("k").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("n", F.count("*").over(w)).withColumn("s", F.coalesce(F.sum("x").over(w), F.lit(0)))
    assert _rows(got, "id", "n", "s") == _rows(want, "id", "n", "s")


def test_strict_history_when_all_rows_are_peers(spark):
    df = spark.range(500).select("id", F.lit(1).alias("k"), F.lit(9).cast("bigint").alias("ts"))
    got = ranking.strict_history(df, ["k"], "ts", "id", {"n": F.lit(1)})
    assert got.filter("n <> 0").count() == 0 and got.count() == 500


def test_value_ranks(spark):
    df = _skewed(spark)
    got = ranking.value_ranks(df, ["k"], "ts")
    w = Window.partitionBy("k").orderBy("ts")
    want = (
        df.groupBy("k", "ts").agg(F.count("*").alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("n_total", F.sum("n").over(Window.partitionBy("k")))
    )
    cols = ("k", "ts", "n", "before", "n_total")
    assert _rows(got, *cols) == _rows(want, *cols)


def test_equal_frequency_bin_is_ntile(spark):
    for n in (3, 10, 97, 1000):
        df = spark.range(n).withColumn("t", F.lit(n).cast("bigint"))
        got = df.withColumn("b", ranking.equal_frequency_bin(F.col("id"), F.col("t"), 10))
        want = df.withColumn("b", F.ntile(min(10, n)).over(Window.orderBy("id")) - 1)
        assert _rows(got, "id", "b") == _rows(want, "id", "b")


def test_rolling_sum_over_blocks(spark):
    df = _skewed(spark)
    got = ranking.rolling_sum(df, ["k"], ["ts", "id"], F.col("x"), 100, "r", slices=24)
    w = Window.partitionBy("k").orderBy("ts", "id").rowsBetween(-99, 0)
    want = df.withColumn("r", F.sum("x").over(w))
    assert _rows(got, "id", "r") == _rows(want, "id", "r")


def test_last_rows(spark):
    df = _skewed(spark)
    order = [F.desc("ts"), F.desc("id")]
    got = ranking.last_rows(df, ["k"], order, 100, ["id"], salts=8)
    want = df.withColumn("position", F.row_number().over(Window.partitionBy("k").orderBy(*order))).filter("position<=100")
    assert _rows(got, "id", "position") == _rows(want, "id", "position")


def test_half_even_is_python_round(spark):
    df = spark.range(0, 400).withColumn("x", F.col("id") / 8.0)
    got = df.withColumn("r", ranking.half_even(F.col("x"))).collect()
    assert all(r["r"] == round(r["x"]) for r in got)


def test_many_slices_give_the_same_sums(spark):
    df = _skewed(spark)
    for order in (["ts", "id"], [F.desc("ts"), "id"], [F.col("ts") % 50, "id"]):
        got = ranking.running_sums(df, ["k"], order, {"s": F.col("x")}, totals=True, slices=24)
        w = Window.partitionBy("k").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        want = df.withColumn("s", F.coalesce(F.sum("x").over(w), F.lit(0)))
        assert _rows(got, "id", "s") == _rows(want, "id", "s")
    w = Window.partitionBy("k").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("n", F.count("*").over(w))
    assert _rows(ranking.strict_history(df, ["k"], "ts", "id", {"n": F.lit(1)}, slices=24), "id", "n") == _rows(want, "id", "n")


def test_slices_cut_equal_leading_values_and_nulls(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") % 5 > 0, 7).alias("ts"))
    for order in (["ts", "id"], [F.desc("ts"), F.desc("id")]):
        cut = ranking.slice_rows(df, order, slices=40)
        sizes = [r["count"] for r in cut.groupBy(ranking.SLICE).count().collect()]
        assert len(sizes) > 20 and max(sizes) < 800
        # slices follow the order
        wrong = cut.withColumn("before", F.lag(ranking.SLICE).over(Window.orderBy(*order))).filter(f"before > {ranking.SLICE}")
        assert wrong.count() == 0


def _exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning"), plan.count("Scan ExistingRDD") + plan.count("Scan parquet")


def test_ordered_plans_write_nothing_and_shuffle_the_rows_once(spark, tmp_path):
    _skewed(spark).write.parquet(f"{tmp_path}/rows")
    df = spark.read.parquet(f"{tmp_path}/rows")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        # with one slice a window needs the rows on their key, and what is carried forward is one row for each (key, slice)
        sums = ranking.running_sums(df, ["k"], ["ts", "id"], {"s": F.col("x")}, slices=4)
        hashed, _ = _exchanges(sums)
        assert hashed <= 3 and "RDD" not in sums._jdf.queryExecution().executedPlan().toString()
        rolled = ranking.rolling_sum(df, ["k"], ["ts", "id"], F.col("x"), 100, "r", slices=4)
        plan = rolled._jdf.queryExecution().executedPlan().toString()
        assert "WindowGroupLimit" in plan and "RDD" not in plan
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_rolling_sum_with_sparse_keys_and_slices(spark):
    df = spark.range(900).select("id", (F.col("id") % 300).alias("k"), (F.col("id") * 7919 % 1009).alias("ts"), F.lit(1).alias("x"))
    df = df.unionAll(spark.range(1000, 1400).select("id", F.lit(None).cast("bigint"), F.lit(5).cast("bigint"), F.lit(2)))
    for rows in (2, 3, 100):
        got = ranking.rolling_sum(df, ["k"], ["ts", "id"], F.col("x"), rows, "r", slices=30)
        want = df.withColumn("r", F.sum("x").over(Window.partitionBy("k").orderBy("ts", "id").rowsBetween(-(rows - 1), 0)))
        assert _rows(got, "id", "r") == _rows(want, "id", "r")


def test_select_at_is_exact(spark, monkeypatch):
    monkeypatch.setattr(ranking, "DIRECT", 20)
    monkeypatch.setattr(ranking, "PIVOTS", 16)
    df = _skewed(spark).withColumn("v", F.when(F.col("id") % 11 > 0, F.col("ts") / 3.0))
    everything = {k: [] for k in range(7)}
    for r in df.collect():
        everything[r.k].append((r.v, r.id))
    order = lambda key: (key[0] is not None, key[0] or 0, key[1])

    def places(n, _=None):
        return [0, n // 3, n // 2, n - 1, n]

    got = ranking.select_at(df, ["v", "id"], places, "k")
    assert set(got) == {k for k, rows in everything.items() if rows}
    for k, (n, keys) in got.items():
        rows = sorted(everything[k], key=order)
        assert n == len(rows) and keys == [rows[p] if p < n else None for p in places(n)]
    # one value only, many ties, and nothing at all
    only = ranking.select_at(df, ["v"], places)[None]
    values = sorted((x[:1] for rows in everything.values() for x in rows), key=lambda x: (x[0] is not None, x[0] or 0))
    assert only == (6000, [values[p] if p < 6000 else None for p in places(6000)])
    assert ranking.select_at(df.limit(0), ["v"], places) == {}


def test_cut_points_are_rows(spark):
    df = _skewed(spark)
    cuts = ranking.cut_points(df, ["ts", "id"], [F.floor(F.col("n_total") / 2), F.col("n_total")])
    rows = sorted((r.ts, r.id) for r in df.collect())
    assert cuts == [dict(zip(("ts", "id"), rows[3000])), None]
