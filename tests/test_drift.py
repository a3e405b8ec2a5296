import json

from pyspark.sql import functions as F

from gridquill.operators.drift import consistent_table, migration_steps, schema_changes, schema_fingerprints

SCHEMA = "writer_id long, part_no int, row_no int, written_at timestamp_ntz, record string"


def part(writer, no, rows):
    return [(writer, no, i, None, r if isinstance(r, str) else json.dumps({"__series__id": i % 4, "__mint": i, "__maxt": i + 1, "__name__": "m"} | r))
            for i, r in enumerate(rows)]


def changes(spark, data):
    return {tuple(r) for r in schema_changes(spark.createDataFrame(data, SCHEMA)).collect()}


def test_renames_retypes_and_the_rest(spark):
    ids = [f"v{i}" for i in range(4)]
    old = [{"zone": ids[i % 4], "port": 9000 + i % 4, "gone": str(i), "same": 1.5} for i in range(8)]
    new = [{"az": ids[i % 4], "listen": f"{9000 + i % 4}.0", "fresh": True, "same": 2} for i in range(8)]
    new[5]["az"] = "stray"
    new[6]["az"] = None
    got = changes(spark, part(1, 0, old) + part(1, 2, new) + part(1, 2, new[:3]))
    assert got == {(1, 2, "renamed", "zone", "az"), (1, 2, "renamed", "port", "listen"), (1, 2, "retyped", "port", "listen"),
                   (1, 2, "removed", "gone", ""), (1, 2, "added", "", "fresh"), (1, 2, "retyped", "same", "same")}


def test_odd_input(spark):
    first = [{"a": "x"}, {"a": "x"}]
    data = part(1, 0, first) + part(1, 1, ["{broken", "[1]", "null"]) + part(1, 2, [{"A": "", "b": None}]) + part(2, 0, first)
    data += [(None, 0, 0, None, '{"a": 1}'), (None, 1, 0, None, '{"c": {"deep": 1}}'), (3, None, 0, None, '{"a": 1}'), (4, 0, None, None, None)]
    assert changes(spark, data) == {(1, 1, "removed", "a", ""), (1, 2, "added", "", "A"), (1, 2, "added", "", "b"),
                                    (None, 1, "removed", "a", ""), (None, 1, "added", "", "c")}
    assert changes(spark, []) == set()


def test_consistent_table_and_versions(spark):
    ids = [f"v{i}" for i in range(4)]
    data = part(1, 0, [{"zone": v, "port": 1} for v in ids]) + part(1, 1, [{"az": v, "port": "1"} for v in ids]) + part(1, 2, [{"area": v, "port": "x"} for v in ids])
    data.append(data[0])
    df = spark.createDataFrame(data, SCHEMA).withColumns({"label": F.lit(1), "kind": F.lit(2), "m": F.lit(3)})
    for files in (100, 1):  # routes broadcast, and joined by file
        got = {(r.part_no, r.row_no): r.strings for r in consistent_table(df, route_files=files).collect()}
        assert len(got) == 12 and got[0, 2] == {"area": "v2", "port": "1"} and got[2, 1] == {"area": "v1", "port": "x"}
    versions = [(r.part_no, r.n_labels, r.version) for r in schema_fingerprints(df).orderBy("part_no").collect()]
    assert versions == [(0, 2, 1), (1, 2, 2), (2, 2, 3)]


def test_rows_without_numbers_all_stay(spark):
    text = lambda v: json.dumps({"__series__id": 1, "__mint": 0, "__maxt": 1, "__name__": "m", "zone": v})
    data = [(1, 0, None, None, text("a")), (1, 0, None, None, text("b")), (1, 0, None, None, text("b")), (1, None, 3, None, text("c")),
            (1, None, 3, None, text("d")), (1, 0, 7, None, text("e")), (1, 0, 7, None, text("f")), (None, None, None, None, text("g")), (1, 0, None, None, None)]
    got = consistent_table(spark.createDataFrame(data, SCHEMA))
    assert "own_text" not in got.columns
    assert sorted((str(r.part_no), str(r.row_no), r.strings.get("zone", "")) for r in got.collect()) == [
        ("0", "7", "f"), ("0", "None", ""), ("0", "None", "a"), ("0", "None", "b"), ("None", "3", "c"), ("None", "3", "d"), ("None", "None", "g")]


def test_values_take_the_newest_type(spark):
    old = [{"n": "7", "d": 1, "b": "true", "s": 5, "gone": 1}, {"n": "x", "d": "1e2", "b": "maybe", "s": True, "gone": 2}]
    new = [{"n": 8, "d": 2.5, "b": False, "s": "t", "late": "a"}, {"n": 9.0, "d": 3.5, "b": True, "s": "", "late": None}, {"n": 9, "d": 3.5, "b": True, "s": "u"}]
    df = spark.createDataFrame(part(1, 0, old) + part(1, 1, new), SCHEMA)
    got = {(r.part_no, r.row_no): (r.strings, r.integers, r.decimals, r.booleans, r.unreadable) for r in consistent_table(df).collect()}
    assert got[0, 0] == ({"s": "5"}, {"n": 7, "gone": 1}, {"d": 1.0}, {"b": True}, {})
    assert got[0, 1] == ({"s": "true"}, {"gone": 2}, {"d": 100.0}, {}, {"n": "x", "b": "maybe"})
    assert got[1, 0] == ({"s": "t", "late": "a"}, {"n": 8}, {"d": 2.5}, {"b": False}, {})
    assert got[1, 1] == ({}, {"n": 9}, {"d": 3.5}, {"b": True}, {})


def test_steps_chain_and_apply_at_once(spark):
    ids = [f"v{i}" for i in range(4)]
    odd = [f"o{i}" for i in range(4)]
    # part 1 swaps the names of two columns' successors: a takes over b's name while b becomes c; part 2 renames on
    data = part(1, 0, [{"a": x, "b": y} for x, y in zip(ids, odd)]) + part(1, 1, [{"B": x, "c": y} for x, y in zip(ids, odd)]) + \
        part(1, 2, [{"B": x, "c": y} for x, y in zip(ids, odd)]) + part(1, 5, [{"c2": x, "d": y} for x, y in zip(ids, odd)])
    df = spark.createDataFrame(data, SCHEMA)
    got = {(r.part_no, r.row_no): r.strings for r in consistent_table(df).collect()}
    assert all(got[p, i] == {"c2": ids[i], "d": odd[i]} for p in (0, 1, 2, 5) for i in range(4))
    steps = [tuple(r)[1:7] for r in migration_steps(df).orderBy("part_no", "old_label").collect()]
    assert steps == [(1, 2, "rename", "renamed", "a", "B"), (1, 2, "rename", "renamed", "b", "c"),
                     (5, 3, "rename", "renamed", "B", "c2"), (5, 3, "rename", "renamed", "c", "d")]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert consistent_table(empty).count() == 0 and schema_fingerprints(empty).count() == 0 and migration_steps(empty).count() == 0
