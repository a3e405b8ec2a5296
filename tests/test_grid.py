import random

from pyspark.sql import functions as F

from gridquill.operators.grid import regular_grid
from support import rows

SCHEMA = "__series__id long, __mint long, __maxt long, __chunk_bytes binary, received_at timestamp_ntz"
COLUMNS = ["series_id", "slot_ms", "n_readings", "value", "coverage", "status"]


def brute(points, slot, age):
    """points: {series: {t: v}}; integrates the step function cell by cell, millisecond by millisecond."""
    out = []
    for s, readings in points.items():
        ts = sorted(readings)
        low, high = ts[0] - ts[0] % slot, ts[-1] - ts[-1] % slot
        for g in range(low, high + 1, slot):
            area = covered = 0
            for ms in range(g, g + slot):
                held = [t for t in ts if t <= ms]
                if held and ms - held[-1] < age:
                    area += readings[held[-1]]
                    covered += 1
            n = sum(g <= t < g + slot for t in ts)
            out.append((s, g, n, area / covered if covered else None, covered / slot, "observed" if n else "filled" if covered else "missing"))
    return sorted(tuple("∅" if x is None else repr(round(x, 6)) if isinstance(x, float) else str(x) for x in r) for r in out)


def test_against_brute_force(spark):
    rng = random.Random(2)
    points, data = {}, []
    for s in (1, 2, None):
        readings = {t: float(rng.randrange(-5, 50)) for t in sorted({rng.randrange(0, 900) for _ in range(12)})}
        points[s] = readings
        pairs = [f"{t}:{v}" for t, v in readings.items()]
        rng.shuffle(pairs)
        data += [(s, 0, 900, ",".join(pairs[:7]).encode(), None), (s, 0, 900, ",".join(pairs[5:]).encode(), None)]
    dim = spark.createDataFrame([(1, 30), (5, 10)], "__series__id long, scrape_ms long")
    df = spark.createDataFrame(data, SCHEMA).withColumns({c: F.lit("?") for c in ("k", "t", "v", "p", "slot", "pair")})
    got = rows(regular_grid(df, dim, slot_ms=20, hold=2.0), COLUMNS)
    want = brute({1: points[1]}, 20, 60) + brute({k: points[k] for k in (2, None)}, 20, 40)
    assert got == sorted(want)
    from gridquill.operators import grid

    old, grid.BLOCK_SLOTS = grid.BLOCK_SLOTS, 3  # many blocks, some of them empty
    assert rows(regular_grid(df, dim, slot_ms=20, hold=2.0), COLUMNS) == got
    grid.BLOCK_SLOTS = old


def test_ties_and_nothing_usable(spark):
    from datetime import datetime as D

    data = [(1, 0, 100, b"0:1,50:9", D(2025, 1, 1)), (1, 0, 100, b"0:3", D(2025, 1, 2)), (1, 0, 100, b"0:2", None), (2, 0, 10, b"bad", None), (3, 9, 1, b"0:1", None)]
    got = regular_grid(spark.createDataFrame(data, SCHEMA), slot_ms=50).collect()
    assert sorted((r.series_id, r.slot_ms, r.n_readings, r.value, r.status) for r in got) == [(1, 0, 1, 3.0, "observed"), (1, 50, 1, 9.0, "observed")]
    assert regular_grid(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_reading_far_off(spark):
    """Fifty years between two readings: some 26 million cells, never in one array."""
    far = 26_297_280 * 60_000
    df = spark.createDataFrame([(1, 0, far, f"0:1,{far}:2".encode(), None)], SCHEMA)
    got = regular_grid(df).groupBy("status").agg(F.count("*").alias("n"), F.min("slot_ms").alias("a"), F.max("slot_ms").alias("b")).collect()
    assert {(r.status, r.n, r.a, r.b) for r in got} == {("observed", 2, 0, far), ("filled", 2, 60_000, 120_000), ("missing", 26_297_277, 180_000, far - 60_000)}
