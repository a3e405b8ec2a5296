import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gridquill.operators.distinct import unique_by
from gridquill.operators.projection import arrow_batches, batches, project
from gridquill.operators.scan import MissingColumn, Predicate, equals, gte, lte, num_rows, pick_ranges, scan, skip_ranges
from gridquill.operators.series import ChunkEngine
from gridquill.plans.promql import range_query
from gridquill.schema import label_columns, text_labels
from gridquill.sinks.writer import write_parts

CASES = [
    # values of A and B by row, predicates, rows that remain
    (["v1"] * 3, ["val1", "val2", "val3"], [equals("B", "val2")], [1]),
    (["val1", "val1", "val1", "val2", "val2"], ["val1", "val2", "val3", "val4", "val5"],
     [equals("A", "val2"), equals("B", "val5"), gte("A", "val1")], [4]),
    (["v"] * 4, ["val1", "val2", "val1", "val3"], [equals("B", "val1")], [0, 2]),
    (["val1"] * 3 + ["val2"] * 3, ["val1"] * 3 + ["val2"] * 3, [gte("A", "val2"), equals("B", "val2")], [3, 4, 5]),
    (["v"] * 9, ["a", "x", "x", "a", "a", "x", "x", "a", "x"], [equals("B", "x")], [1, 2, 5, 6, 8]),
    (["v"] * 3, ["a", "b", "c"], [lte("B", "b")], [0, 1]),
    (["v"] * 3, ["a", "b", "c"], [equals("B", "absent")], []),
    (["v"] * 3, ["a", None, ""], [equals("B", "")], [1, 2]),
    # a missing label is '', which no text is smaller than
    (["v"] * 4, ["a", None, "c", ""], [lte("B", "b")], [0, 1, 3]),
    (["v"] * 4, ["a", None, "c", ""], [gte("B", "b")], [2]),
    (["v"] * 4, ["a", None, "c", ""], [gte("B", "")], [0, 1, 2, 3]),
    (["v"] * 4, ["a", None, "c", ""], [lte("B", "")], [1, 3]),
    (["v"] * 3, ["a", None, ""], [Predicate("B", "!=", "")], [0]),
    (["v"] * 3, ["a", None, "b"], [Predicate("B", "!=", "a")], [1, 2]),
    (["v"] * 3, ["ab", "b", None], [Predicate("B", "=~", "a.*|")], [0, 2]),
    (["v"] * 3, ["ab", "xaby", None], [Predicate("B", "!~", "ab")], [1, 2]),
]


@pytest.mark.parametrize("a,b,predicates,expected", CASES)
def test_scan(spark, a, b, predicates, expected):
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(zip(a, b))], "rid long, A string, B string")
    assert sorted(r.rid for r in scan(df, predicates).collect()) == expected


def test_bounds_that_are_null_meet_nothing(spark):
    df = spark.createDataFrame([(1, 5), (2, None)], "rid long, __maxt long")
    for p in (lte("__maxt", 9), gte("__maxt", 1), equals("__maxt", 5)):
        assert [r.rid for r in scan(df, [p]).collect()] == [1]
    assert sorted(r.rid for r in scan(df, [Predicate("__maxt", "!=", 7)]).collect()) == [1, 2]
    with pytest.raises(ValueError):
        Predicate("a", "<", 1).condition()


def test_labels_stored_as_bytes(spark, tmp_path):
    """Files whose writer gave labels no text annotation; the payload stays as it is."""
    table = pa.table({"__series__id": [1, 2, 3], "__mint": [0, 0, 0], "__maxt": [9, 9, 9], "__chunk_bytes": pa.array([b"0:1", b"\xff", b""], pa.binary()),
                      "__name__": pa.array([b"m", b"m", b"n"], pa.binary()), "job": pa.array([b"a", None, "ö".encode()], pa.binary())})
    pq.write_table(table, f"{tmp_path}/t.parquet")
    df = spark.read.parquet(f"{tmp_path}/t.parquet")
    assert label_columns(df) == ["__name__", "job"]
    for p, expected in ((equals("job", "a"), [1]), (equals("job", ""), [2]), (lte("job", "b"), [1, 2]), (gte("job", "b"), [3]),
                        (Predicate("job", "=~", "a|ö"), [1, 3]), (Predicate("job", "!=", "a"), [2, 3])):
        assert sorted(r[0] for r in scan(df, [p]).select("__series__id").collect()) == expected, p
    plan = scan(df, [equals("job", "a")])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(job," in plan
    engine = ChunkEngine(df, 0, 10)
    assert {tuple(r) for r in engine.select_series([equals("__name__", "m")], ["job"]).collect()} == {("1", "a"), ("2", "")}
    assert {r[0] for r in engine.label_values("job").collect()} == {"a", "ö"} and {r[0] for r in engine.label_names().collect()} == {"__name__", "job"}
    assert sorted(tuple(r) for r in range_query(df, "count without (job) (m)", 0, 10, 20).collect()) == [(0, 2.0)]
    assert {bytes(r[0]) for r in text_labels(df).select("__chunk_bytes").collect()} == {b"0:1", b"\xff", b""}
    write_parts(df, f"{tmp_path}/parts", ["__name__", "job"])
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/parts").select("__series__id", "job").collect()} == {(1, "a"), (2, ""), (3, "ö")}


def test_missing_column_policies(spark):
    df = spark.createDataFrame([(1, "x")], "rid long, A string")
    assert scan(df, [equals("nope", "z")]).count() == 1
    assert scan(df, [equals("nope", "z")], "empty_string").count() == 0
    assert scan(df, [equals("nope", "")], "empty_string").count() == 1
    with pytest.raises(MissingColumn):
        scan(df, [equals("nope", "z")], "error")
    with pytest.raises(ValueError):
        scan(df, [equals("nope", "z")], "whatever")


@pytest.mark.parametrize("skips,expected", [
    ([], set(range(40))), ([(0, 10)], set(range(10, 40))), ([(5, 5)], set(range(40))),
    ([(2, 3), (5, 6), (0, 7)], set(range(7, 40))), ([(0, 20), (20, 40)], set()), ([(3, 9), (5, 7), (30, 50)], {*range(3), *range(9, 30)}),
])
def test_row_ranges(spark, skips, expected):
    df = spark.range(40)
    assert {r.id for r in skip_ranges(df, "id", skips).collect()} == expected
    assert {r.id for r in pick_ranges(df, "id", skips).collect()} == set(range(40)) - expected


def test_benchmark_anchor(spark):
    """One part of the published scan workload: 16,666 of 200,000 rows."""
    df = spark.range(200_000).select((F.col("id") % 4).cast("string").alias("A"), (F.col("id") % 3).cast("string").alias("B"))
    assert num_rows(scan(df, [equals("A", "2"), equals("B", "1")])).first().num_rows == 16_666


def test_filters_are_pushed_down(spark, tmp_path):
    spark.range(10).select("id", F.lit("x").alias("A"), F.lit(b"1").alias("wide")).write.parquet(f"{tmp_path}/t")
    df = scan(spark.read.parquet(f"{tmp_path}/t"), [equals("A", "x"), gte("id", 3)]).select("id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    bound = scan(spark.read.parquet(f"{tmp_path}/t"), [lte("A", "y")])
    assert "Or(LessThanOrEqual(A,y),IsNull(A))" in bound._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(A,x)" in plan and "GreaterThanOrEqual(id,3)" in plan and "wide" not in plan


def test_project_and_batches(spark):
    df = spark.createDataFrame([(i, str(i), None) for i in range(5)], "a long, b string, c string")
    assert project(df, ["b", "zzz", "a"]).columns == ["b", "a"]
    with pytest.raises(ValueError):
        project(df, ["zzz"])
    parts = list(batches(df.coalesce(1), 2))
    assert [p.num_rows for p in parts] == [2, 2, 1] and parts[0].column(0).to_pylist() == [0, 1]
    assert list(batches(df.limit(0), 2)) == []
    assert parts[0].schema.names == ["a", "b", "c"] and [x for p in parts for x in p.column(1).to_pylist()] == list("01234")
    # the published cases: batches of 2 and 3 rows over selected row ranges, one and two columns
    rows = spark.range(9).select("id", F.concat(F.lit("val"), F.col("id")).alias("A"), F.concat(F.lit("b"), F.col("id")).alias("B")).coalesce(1)
    picked = pick_ranges(rows, "id", [(0, 1), (3, 6), (8, 9)])
    assert [p.to_pydict() for p in batches(project(picked, ["B"]), 2)] == [{"B": ["b0", "b3"]}, {"B": ["b4", "b5"]}, {"B": ["b8"]}]
    assert [p.to_pydict() for p in batches(project(picked, ["A", "B"]), 3)] == [
        {"A": ["val0", "val3", "val4"], "B": ["b0", "b3", "b4"]}, {"A": ["val5", "val8"], "B": ["b5", "b8"]}]
    big = spark.range(25_000).coalesce(2)  # more than Arrow's own batches
    assert sorted(r.n_rows for r in arrow_batches(big, 9_000).collect()) == [3_500, 3_500, 9_000, 9_000]
    with pytest.raises(ValueError):
        arrow_batches(df, 0)


def test_unique_by(spark):
    df = spark.createDataFrame([("x", 2, None), ("x", 1, "b"), ("x", 1, "b"), (None, 5, "c"), ("y", None, "d")], "k string, o int, v string")
    assert {tuple(r) for r in unique_by(df, "k", ["o"]).collect()} == {("x", 1, "b"), (None, 5, "c"), ("y", None, "d")}
    assert unique_by(df.limit(0), "k").count() == 0
    assert unique_by(df.select("k"), "k").count() == 3
