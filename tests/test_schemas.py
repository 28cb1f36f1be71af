"""Schemas in parts, on literal rows."""

from finloom.operators import schemas as C


def test_parts_keep_properties_whole_and_merge_back(spark):
    paths = ["a", "b.x", "b.y.z", "c[].p", "c[].q", "c[].q", "d", None]
    fields = spark.createDataFrame([(1, i, p) for i, p in enumerate(paths)] + [(2, 0, "only")], "schema int, place int, path string")
    assert {(r.schema, r.property): (r.n_fields, r.chunk) for r in C.chunks(fields, 4).collect()} == {(1, "a"): (1, 0), (1, "b"): (4, 1), (1, "c"): (3, 2), (1, "d"): (1, 2), (2, "only"): (1, 0)}
    assert {r.chunk for r in C.chunks(fields).where("schema = 1").collect()} == {0}
    assert {r.property: r.chunk for r in C.chunks(fields, 1).where("schema = 1").collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    rows = [(1, 0, "rows", '[{"a": 1}, 2]'), (1, 1, "rows", "[ ]"), (1, 2, "rows", '"x"'), (1, 0, "none", None), (1, 1, "late", "5"), (2, 0, "rows", "7"), (2, 0, "none", None)]
    got = {(r.record, r.key): r.value for r in C.merged(spark.createDataFrame(rows, "record int, part int, key string, value string")).collect()}
    assert got == {(1, "rows"): '[{"a": 1}, 2,"x"]', (1, "none"): "[]", (2, "rows"): "7", (2, "none"): None}
    assert C.chunks(fields.limit(0)).count() == 0
