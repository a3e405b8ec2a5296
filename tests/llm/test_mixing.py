import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridquill.llm import mixing as M


def shares(*args, **more):
    return {s.source: s for s in M.water_fill(*args, **more)}


def test_water_filling():
    out = shares({"a": 1000, "b": 100, "c": 50}, [("a", .5, 2), ("b", .3, 1), ("c", .2, 1), ("none", .1, 3), ("off", 0.0, 1)], total=400)
    assert out["c"].planned == 50 and out["b"].planned == 100 and out["a"].planned == pytest.approx(250)
    assert out["c"].capped and out["b"].capped and not out["a"].capped and out["none"].planned == 0 and out["off"].planned == 0
    every = shares({"a": 10, "b": 10}, [("a", .5, 1), ("b", .5, 2)], total=1000)
    assert every["a"].planned == 10 and every["b"].planned == 20
    exact = shares({"a": 100, "b": 900}, [("a", .1, 1), ("b", .9, 1)])
    assert exact["a"].repeats == pytest.approx(1) and exact["b"].repeats == pytest.approx(1)
    assert shares({}, [("a", None, None)])["a"].planned == 0
    assert M.water_fill({}, []) == []


def docs(spark, n=900):
    return spark.range(n).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, " Big").when(F.col("id") % 30 == 0, None).otherwise("small").alias("source"),
        F.concat_ws(" ", F.lit("some words"), F.col("id")).alias("text"), F.lit(9).alias("copy_no"), F.lit(1).alias("_times"))


def targets(spark):
    return spark.createDataFrame([("big", .5, 1), ("SMALL", .5, 3), ("absent", .1, 2)], "source string, target_share double, max_repeats int")


def test_token_counts_match_the_tokenizer(spark):
    texts = [(1, "A", "naïve <|endoftext|> text"), (2, None, None), (3, " a ", ""), (4, "", "x" * 50_000)]
    t = Tokenizer.from_file(M.TOKENIZER)
    t.encode_special_tokens = True
    got = {r.doc_id: (r.source, r.n_tokens) for r in M.token_counts(spark.createDataFrame(texts, "doc_id long, source string, text string")).collect()}
    assert {k: n for k, (_, n) in got.items()} == {k: len(t.encode(x or "", add_special_tokens=False).ids) for k, _, x in texts}
    assert {k: s for k, (s, _) in got.items()} == {1: "a", 2: None, 3: "a", 4: None}


def test_mixture_and_report(spark):
    counts = M.token_counts(docs(spark))
    plan = M.plan_mixture(counts, targets(spark))
    mixture = M.mix(docs(spark), plan)
    assert mixture.columns == ["doc_id", "source", "text", "_times", "copy_no"]
    rows = mixture.select("doc_id", "source", "copy_no").collect()
    assert {r.source for r in rows} == {"big", "small"} and len(rows) == len(set(rows))
    assert max(r.copy_no for r in rows if r.source == "small") <= 3 and max(r.copy_no for r in rows if r.source == "big") == 1
    assert sorted(rows) == sorted(M.mix(docs(spark).repartition(7), plan).select("doc_id", "source", "copy_no").collect())
    tokens = {r.doc_id: r.n_tokens for r in counts.collect()}
    report = {r.source: r for r in M.reached_shares(counts, plan).collect()}
    for s in ("big", "small"):
        used = [r for r in rows if r.source == s]
        assert report[s].used_records == len(used) and report[s].used_tokens == sum(tokens[r.doc_id] for r in used)
        assert report[s].reached_share == pytest.approx(report[s].planned_share, abs=0.05)
    assert report["absent"].used_tokens == 0 and sum(r.reached_share for r in report.values()) == pytest.approx(1)


def test_empty(spark):
    none = docs(spark).limit(0)
    plan = M.plan_mixture(M.token_counts(none), targets(spark))
    assert M.mix(none, plan).count() == 0
    assert {r.reached_share for r in M.reached_shares(M.token_counts(none), plan).collect()} == {0.0}
    assert M.mix(docs(spark), M.plan_mixture(M.token_counts(docs(spark)), targets(spark).limit(0))).count() == 0


def test_records_are_taken_in_order_until_the_budget_is_met(spark):
    """Against a plain loop; sizes vary widely, some are 0, one source has many records of one place."""
    import hashlib

    sized = [(i, ("a", "b", "c")[i % 3], 0 if i % 11 == 0 else (i * 37) % 500 + (90_000 if i == 4 else 0)) for i in range(700)] + [(7, "b", 30)] * 5 + [(9, None, 5), (10, "d", 5)]
    counts = spark.createDataFrame(sized, "doc_id long, source string, n_tokens long")
    wanted = spark.createDataFrame([("a", .2, 1), ("b", .7, 2), ("c", .1, 4)], "source string, target_share double, max_repeats int")
    plan = {s.source: s for s in M.plan_mixture(counts, wanted)}
    got = {}
    for r in M.with_copies(counts, list(plan.values())).collect():
        got.setdefault(r.source, []).append((r.doc_id, r._uses))
    for source, share in plan.items():
        own = sorted((int(hashlib.md5(f"{M.SEED}/{source}/{i}".encode()).hexdigest()[:13], 16), i, n) for i, s, n in sized if s == source)
        taken, held = [], 0
        for h, i, n in own:
            held += n
            if share.rest > 0 and held - n / 2 <= share.rest:
                taken.append((h, i))
        want = [(i, share.whole + (bool(taken) and (h, i) <= max(taken))) for h, i, n in own]
        assert sorted(got[source]) == sorted(want), source
        used = sum(n * u for (_, _, n), (_, u) in zip(own, want))
        assert abs(used - share.planned) <= max(n for _, _, n in own) / 2 + 30 * 5
    assert {u for s in (None, "d") for _, u in got[s]} == {0}
