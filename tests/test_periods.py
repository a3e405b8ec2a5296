import random

from gridquill.operators.periods import periods_and_gaps
from support import rows

SCHEMA = "e long, a long, b long"


def brute(data, slack):
    out = []
    for e in {r[0] for r in data}:
        spans = sorted((a, b) for k, a, b in data if k == e and a is not None and b is not None and a <= b)
        done = []
        for a, b in spans:
            if done and a <= done[-1][1] + max(slack.get(e) or 0, 0):
                done[-1][1] = max(done[-1][1], b)
            else:
                done.append([a, b])
        out += [(e, "period", a, b) for a, b in done]
        out += [(e, "gap", x[1], y[0]) for x, y in zip(done, done[1:])]
    return sorted(tuple("∅" if x is None else str(x) for x in r) for r in out)


def test_against_brute_force(spark):
    rng = random.Random(4)
    data = [(None if rng.random() < .05 else rng.randrange(3), a := rng.randrange(-300, 3000), a + rng.choice([0, 1, 7, 40, 500, -3]))
            for _ in range(400)]
    data += data[:30] + [(1, None, 5), (1, 5, None), (9, 5, 1)]
    slack = {0: 5, 1: None, None: 3}
    dim = spark.createDataFrame([(0, 5), (1, None), (7, 9)], "e long, slack_ms long")
    slack = {0: 5}
    for block in (10, 100, 10_000):
        got = periods_and_gaps(spark.createDataFrame(data, SCHEMA), "e", "a", "b", dim, block_ms=block)
        assert rows(got, ["e", "span_kind", "start_ms", "end_ms"]) == brute(data, slack)


def test_touching_and_nested_across_blocks(spark):
    data = [(1, 0, 35), (1, 12, 14), (1, 22, 23), (1, 36, 40), (1, 60, 60), (1, 60, 60)]
    got = periods_and_gaps(spark.createDataFrame(data, SCHEMA), "e", "a", "b", block_ms=10)
    assert rows(got, ["e", "span_kind", "start_ms", "end_ms"]) == brute(data, {})


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert periods_and_gaps(empty, "e", "a", "b").count() == 0
    odd = spark.createDataFrame([(1, 0, 5, "x", 3, 4), (1, 9, 10, "y", 3, 4)], "k long, s long, e long, block string, slack long, _k long")
    assert rows(periods_and_gaps(odd, "k", "s", "e"), ["k", "span_kind", "start_ms", "end_ms"]) == [
        ("1", "gap", "5", "9"), ("1", "period", "0", "5"), ("1", "period", "9", "10")]
