import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridquill.llm.frequent import frequent_values


@pytest.mark.parametrize("run_rows", [7, 100_000])
def test_against_counting(spark, run_rows):
    rng = random.Random(1)
    data = [(rng.choice(["a", "b", "", None, f"x{rng.randrange(900)}", "é" * 3]), f"{rng.randrange(40)}") for _ in range(3000)]
    df = spark.createDataFrame(data, "p string, q string").repartition(5).withColumns({c: F.lit("z") for c in ("n", "label_name", "c0")})
    got = {(r.label_name, r.label_value): (r.n_rows, r.share) for r in frequent_values(df, ["p", "q"], 0.02, run_rows).collect()}
    want = {}
    for i, c in enumerate(("p", "q")):
        for v, n in Counter(r[i] for r in data).items():
            if v and n >= 0.02 * len(data):
                want[c, v] = (n, n / len(data))
    assert got == want


def test_edges(spark):
    df = spark.createDataFrame([(None,), ("",), ("v" * 200_000,), ("w",)], "p string")
    assert {r.label_value for r in frequent_values(df, ["p"], 0.25).collect()} == {"v" * 200_000, "w"}  # exactly at the edge
    assert frequent_values(df.limit(0), ["p"]).count() == 0
    tied = spark.createDataFrame([(str(i % 50),) for i in range(500)], "p string")
    assert frequent_values(tied, ["p"], 0.02).count() == 50
    assert frequent_values(tied, ["p"], 0.021).count() == 0
