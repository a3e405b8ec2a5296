import pytest

from gridquill.operators.scan import equals
from gridquill.operators.series import ChunkEngine, assign_series_ids
from gridquill.plans.promql import QueryError, parse, range_query
from gridquill.schema import chunk_schema, clustering_key, make_chunk_rows
from gridquill.sources.samples import samples_to_chunks
from gridquill.functions.payload import readings


def chunks(spark, series):
    """Three one-minute chunks per series, chunk-major."""
    rows = [(i, c * 60_000, (c + 1) * 60_000, b"", "queue_reads_total", job, inst)
            for c in range(3) for i, (job, inst) in enumerate(series)]
    return spark.createDataFrame(rows, "__series__id long, __mint long, __maxt long, __chunk_bytes binary, __name__ string, job string, instance string")


THREE = [("loader-a", "0"), ("loader-a", "1"), ("writer", "0")]


def test_sum_over_grid(spark):
    out = range_query(chunks(spark, THREE), "sum(queue_reads_total)", 0, 300_000, 60_000)
    assert sorted(tuple(r) for r in out.collect()) == [(t * 60_000, 3.0) for t in range(6)]


@pytest.mark.parametrize("query,expected", [
    ("sum by (job) (queue_reads_total)", {("loader-a", 2.0), ("writer", 1.0)}),
    ('count(queue_reads_total{job!="writer"}) by (instance)', {("0", 1.0), ("1", 1.0)}),
    ('max without (instance) ({job=~"loader.*"})', {("loader-a", 1.0)}),
    ('avg by (nope) (queue_reads_total{instance="1",})', {(1.0,)}),
])
def test_grouping(spark, query, expected):
    out = range_query(chunks(spark, THREE), query, 0, 180_000, 300_000).drop("t")
    assert {tuple(r) for r in out.collect()} == expected


def test_select_series_and_labels(spark):
    engine = ChunkEngine(chunks(spark, THREE), 0, 10**9)
    got = {tuple(r) for r in engine.select_series([equals("__name__", "queue_reads_total")], ["instance"]).collect()}
    assert got == {("0", "0"), ("1", "1"), ("2", "0")}
    assert {r[0] for r in engine.label_values("job").collect()} == {"loader-a", "writer"}
    assert {r[0] for r in engine.label_names().collect()} == {"__name__", "job", "instance"}
    assert engine.between(1, 10**9).select([]).count() == 6
    assert ChunkEngine(engine.chunks, 1, 59_999, mode="overlap").select([]).count() == 3
    assert ChunkEngine(engine.chunks, 1, 59_999).select([]).count() == 0


@pytest.mark.parametrize("series,expected", [
    ([("loader-a", "0")], [("0", "0")]),
    (THREE, [("0", "0"), ("2", "0"), ("1", "1")]),
    ([(j, i) for j in ("loader-a", "writer") for i in "012"], [("0", "0"), ("3", "0"), ("1", "1"), ("4", "1"), ("2", "2"), ("5", "2")]),
])
def test_series_come_in_the_order_of_the_sorted_table(spark, series, expected):
    engine = ChunkEngine(chunks(spark, series).repartition(5), 0, 10**9)
    got = engine.select_series_ordered([equals("__name__", "queue_reads_total")], ["instance"]).collect()
    assert [tuple(r) for r in got] == [(i, *e) for i, e in enumerate(expected)]
    assert engine.select_series_ordered([equals("job", "none")]).count() == 0


@pytest.mark.parametrize("bad", ["sum(", "sum by x (y)", "{a~\"b\"}", "{}", "a b", "sum(x) by", "{a=b}", ""])
def test_bad_queries(bad):
    with pytest.raises(QueryError):
        parse(bad)


def test_bad_grids(spark):
    with pytest.raises(QueryError):
        range_query(chunks(spark, THREE), "x", 10, 0, 1)
    with pytest.raises(ValueError):
        range_query(chunks(spark, THREE), "x", 0, 10, 1, samples="other")


def test_decoded_samples(spark):
    df = spark.createDataFrame([(1, 1000, 9000, b"0:1,1000:2,5000:7,9999:99", "m", "a")],
                               "__series__id long, __mint long, __maxt long, __chunk_bytes binary, __name__ string, job string")
    out = range_query(df, "sum by (job) (m)", 0, 12_000, 2_000, samples="decoded", lookback=4_000, mode="overlap")
    assert sorted(tuple(r) for r in out.collect()) == [("a", 2_000, 2.0), ("a", 4_000, 2.0), ("a", 6_000, 7.0), ("a", 8_000, 7.0)]


def test_schema_and_rows(spark):
    assert chunk_schema(["b", "a"]).names == ["__series__id", "__mint", "__maxt", "__chunk_bytes", "a", "b"]
    assert clustering_key(["z", "__maxt", "a", "__mint", "__name__", "__series__id"]) == ["__name__", "__mint", "__maxt", "a", "z"]
    df = spark.createDataFrame([(1, {"a": "x", "dropped": "y"}), (2, None)], "__series__id long, labels map<string,string>")
    assert [tuple(r) for r in make_chunk_rows(df, "labels", ["b", "a"]).orderBy("__series__id").collect()] == [(1, "x", ""), (2, "", "")]


def test_series_ids_and_samples(spark):
    df = spark.createDataFrame([("b", None), ("a", "z"), ("a", ""), ("b", "")], "x string, y string")
    assert {tuple(r) for r in assign_series_ids(df, ["x", "y"]).select("x", "y", "__series__id").collect()} == {("a", "", 0), ("a", "z", 1), ("b", "", 2)}
    samples = spark.createDataFrame([("m", 5, 1.5), ("m", 1, 2.0), ("m", None, 1.0), ("m", 7_300_000, None), ("n", 8_000_000, 3.25)],
                                    "__name__ string, ts_ms long, value double")
    made = samples_to_chunks(samples, ["__name__"])
    assert sorted((r[0], r[1], r[2], bytes(r[3]), r[4]) for r in made.collect()) == [
        (0, 1, 5, b"0:2.000,4:1.500", "m"), (1, 8_000_000, 8_000_000, b"0:3.250", "n")]
    assert sorted(tuple(r) for r in readings(made).collect()) == [(0, 1, 2.0), (0, 5, 1.5), (1, 8_000_000, 3.25)]


def test_damaged_payloads(spark):
    payload = b"0:1,-1:2,5:,x:1,6:NaN,7:inf,8:1e400,9:.5,10:+2.,11:0x1,12,99999999999999999999:1,13 :1,20:3,14:1:2"
    df = spark.createDataFrame([(1, 0, 19, payload), (2, 5, 1, b"0:1"), (3, None, 1, b"0:1"), (4, 0, 1, None), (5, 0, 1, b"")],
                               "__series__id long, __mint long, __maxt long, __chunk_bytes binary")
    assert sorted(tuple(r) for r in readings(df).collect()) == [(1, 0, 1.0), (1, 9, 0.5), (1, 10, 2.0)]
