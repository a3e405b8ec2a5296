from datetime import datetime as D

import pytest
from pyspark.sql import functions as F

from gridquill.functions import parse
from gridquill.operators.wide import filled_cells, wide_table

SCHEMA = "row_id long, series_id long, label_name string, label_value string, seen_at timestamp_ntz"
CATALOG = [("port", "bigint"), ("load_weight", "double"), ("paged", "boolean"), ("deployed_at", "timestamp"), ("zone", "string")]


def catalog(spark):
    return spark.createDataFrame(CATALOG, "label_name string, label_type string")


def cells(spark, data):
    return {tuple(r) for r in filled_cells(wide_table(spark.createDataFrame(data, SCHEMA), catalog(spark))).collect()}


def test_latest_row_decides(spark):
    t1, t2 = D(2025, 3, 1), D(2025, 3, 2)
    data = [
        (1, 1, "port", "80", t1), (2, 1, " PORT ", "81", t2), (3, 1, "p-o.r t", "82", None),
        (4, 1, "zone", "a", t1), (5, 1, "Zone", " b ", t1),               # tie: larger row_id
        (6, 2, "zone", "a", t1), (7, 2, "zone", "  ", t2),                # withdrawn
        (8, 3, "zone", "a", t1), (9, 3, "zone", None, t2),
        (10, 4, "port", "7", t1), (11, 4, "port", "n/a", t2),             # unreadable
        (12, 5, "My-Own", " x ", None), (13, 5, "my-own", "y", None), (13, 5, "my-own", "y", None),
        (14, 6, None, "x", t1), (15, None, "zone", "n", t1), (16, 7, "", "x", t1),
    ]
    assert cells(spark, data) == {(1, "port", "81"), (1, "zone", "b"), (5, "My-Own", "x"), (5, "my-own", "y"), (None, "zone", "n")}


def test_absurd_instants_are_unreadable(spark):
    data = [(1, 1, "deployed_at", "99999999999999999", None), (2, 2, "deployed_at", "9999-12-31T23:59:59Z", None), (3, 3, "deployed_at", "-99999999999999999", None),
            (4, 4, "deployed_at", "0001-01-01", None), (5, 5, "deployed_at", "9" * 60, None), (6, 6, "deployed_at", "253402300800000", None)]
    assert cells(spark, data) == {(2, "deployed_at", "253402300799000"), (4, "deployed_at", "-62135596800000")}


def test_a_catalogue_of_many_names(spark):
    many = spark.createDataFrame([(f"n{i}", "bigint") for i in range(1500)], "label_name string, label_type string")
    data = spark.createDataFrame([(i, 1, f"N-{i}", str(i), None) for i in range(1500)], SCHEMA)
    wide = wide_table(data, many)
    assert len(wide.columns) == 1502 and wide.first().n1499 == 1499


def test_wide_rows_are_typed(spark):
    data = [(1, 1, "load weight", "79e-3", None), (2, 1, "Deployed.At", "1707108150", None), (3, 1, "PAGED", "off", None), (4, 2, None, None, None)]
    df = wide_table(spark.createDataFrame(data, SCHEMA), catalog(spark))
    assert df.columns == ["series_id", "deployed_at", "load_weight", "paged", "port", "zone", "other_labels"]
    assert {r.series_id: tuple(r)[1:] for r in df.collect()} == {
        1: (D(2024, 2, 5, 4, 42, 30), 0.079, False, None, None, {}), 2: (None, None, None, None, None, {})}
    assert wide_table(spark.createDataFrame([], SCHEMA), catalog(spark)).count() == 0


def test_extra_columns_and_bad_catalog(spark):
    data = spark.createDataFrame([(1, 1, "zone", "z" * 100_000, None)], SCHEMA).withColumns({c: F.lit("?") for c in ("e", "slot", "at", "cell", "row")})
    assert len(wide_table(data, catalog(spark)).first().zone) == 100_000
    with pytest.raises(ValueError):
        wide_table(data, spark.createDataFrame([("a", "decimal")], "label_name string, label_type string"))


@pytest.mark.parametrize("how,values", [
    ("to_bigint", {"13": 13, " +26\t": 26, "-92": -92, "2.0": 2, "1,208": 1208, "1_547": 1547, "17709e1": 177090, "00000011": 11,
                   "11,670,323,200": 11670323200, "1.5": None, "1,20": None, "": None, None: None, "unknown": None, "9" * 19: None, "1e30": None,
                   "9223372036854775807": 9223372036854775807, "-": None, "1 234": 1234, "--1": None}),
    ("to_double", {".025": .025, "79e-3": .079, "34.769E+00": 34.769, "NaN": None, "Infinity": None, "1e400": None, "n/a": None, "1,234.5": 1234.5, "5.": 5.0}),
    ("to_boolean", {"\tY": True, " off  ": False, "FALSE": False, "1": True, "0": False, "maybe": None, "": None, None: None, "T": True}),
    ("to_epoch_ms", {"1707108150": 1707108150000, " 1726632469000 ": 1726632469000, "2024-02-06 11:38:30": 1707219510000,
                     "2024-02-06T11:38:30Z": 1707219510000, "2024-02-06T20:38:30+09:00": 1707219510000, "2024-02-06T06:38:30-0500": 1707219510000,
                     "2024-02-06": 1707177600000, "2024-02-06T11:38:30.1234567Z": 1707219510123, "2024-13-06": None, "soon": None, "": None,
                     "2024/2/6 1:02": 1707181320000}),
])
def test_parsing(spark, how, values):
    df = spark.createDataFrame([(k,) for k in values], "x string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    for tz in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", tz)
        assert {r.x: r.y for r in df.select("x", getattr(parse, how)(F.col("x")).alias("y")).collect()} == values
    spark.conf.set("spark.sql.session.timeZone", zone)
