import random
from math import ceil, floor

from pyspark.sql import functions as F

from gridquill.llm.leakage import AUTOMATON_WORDS, Compiled, find_leaks, words


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def brute(docs, items):
    found = set()
    for i, passage in items:
        p = [w for w, _, _ in words(passage or "")]
        if not p:
            continue
        need, span = ceil(3 * len(p) / 4), floor(1.5 * len(p))
        grams = {tuple(p[k:k + 12]) for k in range(len(p) - 11)}
        for d, text in docs:
            t = [w for w, _, _ in words(text or "")]
            known = set(p)
            if any(tuple(t[k:k + 12]) in grams for k in range(len(t) - 11)) or any(
                    sum(w in known for w in t[k:k + span]) >= need and lcs(t[k:k + span], p) >= need for k in range(max(1, len(t) - span + 1))):
                found.add((d, i))
    return found


def made():
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(25)] + ["Été", "don't", "42"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 16, 24])))) for i in range(8)]
    items += [(50, items[0][1]), (51, None), (52, " ?! "), (53, "lone")]
    docs = []
    for d in range(40):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([0, 5, 20, 60]))]
        for _ in range(rng.choice([0, 1, 2])):
            p = rng.choice(items[:8])[1].split()
            keep = [w.upper() for w in p if rng.random() < rng.choice([.7, .8, 1])]
            at = rng.randrange(len(text) + 1)
            text[at:at] = [x for w in keep for x in ([w, "**"] if rng.random() < .7 else [w, "filler"])]
        docs.append((d, "  ".join(text)))
    return docs + [(900, None), (901, ""), (902, "x lone​y"), (903, "filler " * 20_000 + items[3][1])], items


def test_against_brute_force(spark):
    docs, items = made()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("?") for c in ("item_id", "passage", "match_kind")})
    i = spark.createDataFrame([(k, p, "42") for k, p in items], "item_id long, passage string, answer string")
    want = brute([x for x in docs if x[0] != 903], items) | {(903, k) for k, p in items if p == items[3][1]}
    want |= {(903, k) for k, p in items if brute([(903, "filler " * 40 + items[3][1])], [(k, p)])}
    for block in (AUTOMATON_WORDS, 150):
        rows = find_leaks(d, i, block).collect()
        assert len(rows) == len({(r.doc_id, r.item_id) for r in rows})
        assert {(r.doc_id, r.item_id) for r in rows} == want
    text = dict(docs)
    for r in rows:
        if r.match_kind == "verbatim":
            assert len(words(text[r.doc_id][r.start_char:r.end_char])) == 12
        assert r.answer_present == ("42" in [w for w, _, _ in words(text[r.doc_id])])


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    i = spark.createDataFrame([(1, "some text", None)], "item_id long, passage string, answer string")
    assert find_leaks(d.limit(0), i).count() == 0
    assert find_leaks(d, i.limit(0)).count() == 0
    assert [tuple(r)[:3] for r in find_leaks(d.union(d), i.union(i)).collect()] == [(1, 1, "partial")]


def test_offsets_point_into_the_original():
    text = "Oh  İstanbul — **One** two_three, FOUR five six; seven eight nine ten eleven twelve thirteen"
    passage = "one two three four five six seven eight nine ten eleven twelve"
    (_, kind, a, b, n, answer), = Compiled([(7, passage, "thirteen")]).find(text)
    assert (kind, n, answer, text[a:b]) == ("verbatim", 12, True, text[text.index("One"):text.index(" thirteen")])
