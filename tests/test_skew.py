import random

from pyspark.sql import functions as F

from gridquill.operators.skew import heavy_keys, lookup, span_summary
from support import rows

SCHEMA = "id long, a long, b long, l string, m string"
COLUMNS = ["key_kind", "key_value", "n_rows", "first_start", "last_end", "covered_ms"]


def brute(data):
    groups = {}
    for i, a, b, l, m in data:
        for key in (("id", i), ("l", l or ""), ("m", m or "")):
            groups.setdefault(key, []).append((a, b))
    out = []
    for (kind, key), spans in groups.items():
        seen, reach = 0, None
        for a, b in sorted((a, b) for a, b in spans if a is not None and b is not None and a <= b):
            low = a if reach is None else max(a, reach)
            seen += max(0, b - low)
            reach = b if reach is None else max(reach, b)
        lows, highs = [a for a, _ in spans if a is not None], [b for _, b in spans if b is not None]
        out.append((kind, key, len(spans), min(lows, default=None), max(highs, default=None), seen))
    return sorted(tuple("∅" if x is None else str(x) for x in r) for r in out)


def made(n=600):
    rng = random.Random(8)
    data = []
    for _ in range(n):
        i = 1 if rng.random() < .4 else rng.randrange(2, 60)
        a = rng.randrange(-50, 5000)
        data.append((i, a, rng.choice([a, a + 3, a + 90, a + 700, a - 1, None]), rng.choice(["hot", "hot", None, "", f"x{i}"]), f"m{i % 3}"))
    return data + data[:20] + [(None, 5, 9, "hot", None), (2, None, 7, None, None)]


def test_split_paths_agree_with_brute_force(spark):
    data = made()
    df = spark.createDataFrame(data, SCHEMA).withColumns({c: F.lit("?") for c in ("k", "kind", "key", "s", "e", "_heavy", "l0")})
    for share, slice_ms, listed in ((0.02, 100, 1000), (0.02, 10_000, 1000), (2.0, 100, 1000), (0.02, 300, 2)):
        got = span_summary(df, "id", ["l", "m"], "a", "b", share=share, slice_ms=slice_ms, list_rows=listed)
        assert rows(got, COLUMNS) == brute(data)


def test_empty(spark):
    assert span_summary(spark.createDataFrame([], SCHEMA), "id", ["l"], "a", "b").count() == 0


def test_heavy_keys_are_bounded(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"))
    assert [r.k for r in heavy_keys(df, ["k"], 0.1).collect()] == [7]
    assert heavy_keys(df.limit(0), ["k"]).count() == 0
    # whatever the number of rows, 1 / share keys per kind, all of about that share
    many = spark.range(400_000).select((F.col("id") % 40).alias("a"), (F.col("id") % 100_000).alias("b"))
    kinds = [F.struct(F.lit(c).alias("kind"), F.col(c).alias("key")) for c in ("a", "b")]
    listed = heavy_keys(many, ["kind", "key"], 0.02, rows=20_000, stack=kinds, most_rows=None).collect()
    assert {r.kind for r in listed} == {"a"} and len(listed) <= 50


def test_lookup_beyond_the_broadcast_bound(spark):
    fact = spark.createDataFrame([(1, x) for x in range(300)] + [(k, k) for k in range(2, 40)] + [(None, 0)], "k long, x long")
    dim = spark.createDataFrame([(k, k * 10) for k in range(1, 30)], "d long, v long")
    wanted = rows(fact.select("k", "x", F.when(F.col("k") < 30, F.col("k") * 10).alias("v")))
    for bound in (1000, 5):
        assert rows(lookup(fact, dim, "k", ["v"], bound=bound, share=0.2, dim_key="d")) == wanted
