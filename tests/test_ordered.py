"""Sliced operators give the results of plain windows, whatever the slice size."""

import datetime
import pickle
import random

import pytest
from pyspark.sql import Window, functions as F
from pyspark.sql import types as T

from cueweave.operators import ordered as od
from cueweave.operators.quantiles import exact_quantiles


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = [("hot" if rng.random() < 0.7 else rng.choice("abc"), float(rng.randrange(80)), i, rng.choice([None, 1, 2])) for i in range(400)]
    return spark.createDataFrame(data, "k string, ts double, id int, v int").cache()


def test_neighbours_and_sums(rows):
    w = Window.partitionBy("k").orderBy("ts", "id")
    want = rows.select("id", F.lag("v").over(w).alias("p"), F.lead("id").over(w).alias("n"), F.row_number().over(w).cast("long").alias("r"), F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).alias("s"))
    for size in (7, 1000):
        seq = od.sequence_of(rows, ["k"], ["ts", "id"], size)
        assert seq.cut == (size == 7)
        got = seq.previous(p=F.col("v")).next(n=F.col("id")).row_number("r").running_sum(s=F.col("v")).done().select("id", "p", "n", "r", "s")
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_fold_is_sequential_for_any_slice_size(rows):
    def fold(frame, state, last):
        total = pickle.loads(state) if state else 0
        out = []
        for row in od.rows_of(frame):
            total = (total * 3 + row["id"]) % 97 if row["ts"] != 40 else 0
            out.append({"id": row["id"], "total": total})
        return out, pickle.dumps(total)

    out = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("total", T.LongType())])
    results = [sorted(map(tuple, od.ordered_fold(rows.select("k", "ts", "id"), ["k"], ["ts", "id"], fold, out, size).collect())) for size in (30, 100_000)]
    assert results[0] == results[1] and len(results[0]) == 400


def test_fold_of_whole_keys_takes_many_keys_to_a_task(spark):
    big, seen = 1 << 60, spark.sparkContext.accumulator(0)
    data = [(big, 1, 2, "a"), (big, 0, None, "a"), (big + 1, 0, big + 3, "a"), (None, 0, 7, None), (None, 1, 8, None)]
    data += [(i, t, i, str(i)) for i in range(300) for t in range(3)]

    def fold(frame, state, last):
        seen.add(1)
        return [{"first": frame["v"].tolist()[0], "n": len(frame), "last": str(last and state is None)}], None

    out = T.StructType([T.StructField("first", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("last", T.StringType())])
    df = spark.createDataFrame(data, "k long, ts int, v long, s string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # keys stand across batches
    try:
        folded = od.ordered_fold(df, ["k", "s"], ["ts"], fold, out)
        got = sorted(map(tuple, folded.collect()), key=repr)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = [(big, "a", None, 2, "True"), (big + 1, "a", big + 3, 1, "True"), (None, None, 7, 2, "True"), *[(i, str(i), i, 3, "True") for i in range(300)]]
    assert got == sorted(want, key=repr) and seen.value == len(want)
    assert "MapInPandas" in folded._jdf.queryExecution().executedPlan().toString()


def test_quantiles(rows):
    wanted = {"m": ("linear", 0.5), "p": ("linear", 0.95), "n": ("nearest", 0.95), "z": ("nearest", 0.0)}
    want = {r[0]: tuple(r[1:]) for r in rows.groupBy("k").agg(F.percentile("ts", 0.5), F.percentile("ts", 0.95), F.expr("percentile_disc(0.95) within group (order by ts)"), F.min("ts")).collect()}
    for size in (5, 100_000):
        for r in exact_quantiles(rows, ["k"], "ts", wanted, size).collect():
            assert tuple(r[1:]) == pytest.approx(want[r.k])


def test_global_rank(spark):
    df = spark.range(300).select("id", F.sha2(F.col("id").cast("string"), 256).alias("h"))
    got = {r.id: r.place for r in od.global_rank(df, "h", ["id"], "place", 1).collect()}
    order = [r.id for r in df.orderBy("h").collect()]
    assert got == {identifier: i for i, identifier in enumerate(order, 1)}


def test_bunched_rows_are_cut_again(spark):
    """Nearly all rows of the hot key lie within a thousandth of its span."""
    data = [("hot", i / 1000.0, i) for i in range(300)] + [("hot", 1000.0, 300), ("cold", 1.0, 301)]
    df = spark.createDataFrame(data, "k string, ts double, id int")
    cut = od.sliced(df, ["k"], ["ts"], 20)
    assert cut.groupBy("k", od.SLICE).count().agg(F.max("count")).first()[0] <= 20
    w = Window.partitionBy("k").orderBy("ts", "id")
    want = {(r.id, r.p) for r in df.select("id", F.lag("id").over(w).alias("p")).collect()}
    got = od.sequence_of(df, ["k"], ["ts", "id"], 20).previous(p=F.col("id")).row_number("n").done().collect()
    assert {(r.id, r.p) for r in got} == want and sorted(r.n for r in got if r.k == "hot") == list(range(1, 302))


@pytest.mark.parametrize("kind", ["string", "date", "tied", "special"])
def test_any_order_column_on_both_sides_of_the_limit(spark, kind):
    """Strings, dates, ties of the first column, and NaN, infinite and null times."""
    times = {
        "string": lambda i: f"t{i:04d}", "date": lambda i: datetime.date(2020, 1, 1) + datetime.timedelta(days=i % 50), "tied": lambda i: 1.0 if i % 100 else 2.0,
        "special": lambda i: (float("nan"), float("inf"), float("-inf"), None, float(i))[i % 5],
    }
    data = [("hot" if i % 10 else None, times[kind](i), i) for i in range(300)]
    df = spark.createDataFrame(data, f"k string, ts {'string' if kind == 'string' else 'date' if kind == 'date' else 'double'}, id int")
    w = Window.partitionBy("k").orderBy("ts", "id")
    want = sorted(map(tuple, df.select("id", F.lag("id").over(w), F.lead("id").over(w), F.row_number().over(w).cast("long")).collect()))
    for size in (7, 1000):
        if size == 7:
            cut = od.sliced(df, ["k"], ["ts", "id"], size)
            assert cut.groupBy("k", od.SLICE).count().agg(F.max("count")).first()[0] <= size
        got = od.sequence_of(df, ["k"], ["ts", "id"], size).previous(p=F.col("id")).next(n=F.col("id")).row_number("r").done()
        assert sorted(map(tuple, got.select("id", "p", "n", "r").collect())) == want


def test_small_keys_are_not_written(spark):
    df = spark.createDataFrame([("hot", i, i) for i in range(50)] + [("cold", i, 100 + i) for i in range(5)], "k string, ts int, id int")
    slices = {(r.k, r[od.SLICE] == -1) for r in od.sliced(df, ["k"], ["ts"], 10).select("k", od.SLICE).distinct().collect()}
    assert slices == {("hot", False), ("cold", True)}
