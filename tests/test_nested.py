"""Broken JSON, repeated items, and checks of figures with gaps, on literal rows."""

import json

import pytest

from finloom.operators import checks as K
from finloom.operators import entities as E
from finloom.operators import tolerant as T

BROKEN = [
    ('{"a": 1, "b": [1, 2,], }', {"a": 1, "b": [1, 2]}),
    ('{"a": 1 "b": 2\n"c": "x" "d": "y"}', {"a": 1, "b": 2, "c": "x", "d": "y"}),
    ('{"a": {"b": [1, {"c": "cut of', {"a": {"b": [1, {"c": "cut of"}]}}),
    ('{"a": "say "hi", please", "b": "it "was""}', {"a": 'say "hi", please', "b": 'it "was"'}),
    ("{'a': 'it\\'s', b: true, c: None, d: -1.5e3, e: two words}", {"a": "it's", "b": True, "c": None, "d": -1500.0, "e": "two words"}),
    ('{"a": [1, 2}, "b": 3}', {"a": [1, 2]}),
    ('{"a": {"b": 1], "c": 2}', {"a": {"b": 1, "c": 2}}),
    ('{"a": "line\nend\\u00e9\\q", /* note */ "b": 1 // more\n}', {"a": "line\nend\u00e9\\q", "b": 1}),
    ('{"a":, "b": "x", "a": 2, "k"}', {"a": 2, "b": "x", "k": None}),
    ("{“a”: “curly”, 7: NaN}", {"a": "curly", "7": None}),
    ('text {"a": "x, y", "b": ["p", "q" "r", -1, {"z": 0}]} tail', {"a": "x, y", "b": ["p", "q", "r", -1, {"z": 0}]}),
    ("{", {}), ("no object", None), ("", None), ("[1, 2]", None),
]


@pytest.mark.parametrize("text,want", BROKEN)
def test_scanner_on_broken_texts(text, want):
    assert T.scanned(text) == want


@pytest.mark.parametrize("value", [{"a": [1, 2.5, None, True, {"b": 'q"u\\o\n'}], "é": "漢,:}]"}, {"": {}, "x": [[], [{}]]}])
def test_scanner_reads_plain_json_and_its_starts(value):
    text = json.dumps(value)
    assert T.scanned(text) == value and T.scanned(json.dumps(value, indent=2, ensure_ascii=False)) == value
    for n in range(1, len(text)):
        assert isinstance(T.scanned(text[:n]), dict)


def test_ways_in_which_objects_are_found(spark):
    rows = [(1, ' {"b": 1, "a": "x"} '), (2, 'So:\n```json\n{"a": 1}\n```'), (3, 'see {"a": {"b": 2}} there'), (4, '{"a": 1,}'), (5, "none"), (6, None), (7, "[1]")]
    got = {r.id: (r.json, r.how) for r in T.recovered(spark.createDataFrame(rows, "id int, text string")).collect()}
    assert got == {1: ('{"a":"x","b":1}', "plain"), 2: ('{"a":1}', "fence"), 3: ('{"a":{"b":2}}', "braces"), 4: ('{"a":1}', "scanned"), 5: (None, None), 6: (None, None), 7: (None, None)}


def test_twins_of_a_page(spark):
    box = [0, 0, 5, 5]
    rows = [(1, i, "t", "same", None) for i in range(5)] + [(1, 5 + i, "t", "four", None) for i in range(4)]
    rows += [(1, 10, "a", "x", box), (1, 11, "b", "y", box), (2, 12, "b", "y", box), (1, 13, "c", "z", [1, 2, 3]), (1, 14, "c", "z", [1]), (1, 15, None, "w", None), (1, 16, None, "v", [1, 2, 3]), (1, 17, None, None, [1, 1, 1, 1])]
    got = T.without_twins(spark.createDataFrame(rows, "page int, pos int, category string, text string, bbox array<int>")).collect()
    assert sorted(r.pos for r in got) == [0, 5, 6, 7, 8, 10, 12, 13, 16, 17] and next(r.bbox for r in got if r.pos == 13) is None


def test_checks_of_figures_with_gaps(spark):
    lines = spark.createDataFrame([(1, "2024", "rev", 100), (1, "2024", "rev", 50)], "entity int, period string, section string, value long")
    totals = spark.createDataFrame([(1, "2024", "rev", 150), (1, "2024", "cost", 900), (1, "2024", "tax", 0)], "entity int, period string, section string, shown long")
    assert {r.section: r.status for r in K.section_sums(lines, totals).collect()} == {"rev": "OK", "cost": "NOT_ITEMISED", "tax": "OK"}
    side = lambda rows: spark.createDataFrame(rows, "entity int, period string, value long")
    got = K.matched_periods(side([(1, "FY2023", 5), (1, "FY24", 7), (2, "2024", 1)]), side([(1, "2023 (audited)", 5), (1, "fy-24", 9), (3, "2022", 1)]), 1)
    assert {(r.entity, r.key): r.status for r in got.collect()} == {(1, "2023"): "OK", (1, "2024"): "DIFFERS", (2, "2024"): "LEFT_ONLY", (3, "2022"): "RIGHT_ONLY"}
    found = spark.createDataFrame([(1, "revenue"), (1, "cost"), (1, "odd"), (2, "revenue")], "entity int, item string")
    assert {r.entity: (r.missing, r.unknown, r.valid) for r in K.structure(found, ("revenue", "cost"), ("loans",)).collect()} == {1: ("", "odd", True), 2: ("cost", "", False)}
    cells = lambda rows: spark.createDataFrame(rows, "entity int, period string, item string, value long")
    got = K.parity(cells([(1, "a", "x", 1), (1, "a", "y", 2), (1, "a", "w", 3)]), cells([(1, "a", "x", 1), (1, "a", "y", 5), (1, "a", "z", 6)]))
    assert {r.item: r.kind for r in got.collect()} == {"y": "DIFFERS", "w": "EXTRA", "z": "MISSING"}


def test_survivors_by_rows_turnover_and_least_text(spark):
    names = spark.createDataFrame([("ABX TRADING SDN BHD", 2, 10), ("ABX TRADING", 2, 10), ("ABX TRADING LTD", 2, 9), ("ZED HOLDINGS LTD", 1, 5), ("ZED HOLDINGS", 3, 1)], "name string, n_rows long, turnover long")
    assert {r.name: r.survivor for r in E.merged(names).collect()} == {"ABX TRADING SDN BHD": "ABX TRADING", "ABX TRADING": "ABX TRADING", "ABX TRADING LTD": "ABX TRADING", "ZED HOLDINGS LTD": "ZED HOLDINGS", "ZED HOLDINGS": "ZED HOLDINGS"}
