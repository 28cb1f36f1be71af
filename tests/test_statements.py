"""Statements on literal lines and words: years, hints, blocks, chosen balances, visual lines, columns."""

import random

import pytest

from finloom.operators import layout as L
from finloom.plans import blocks as P
from finloom.sources import banks as K
from finloom.sources import blocks as B

LINES = "file string, page int, line_no int, line string"


def _bank(spark, bank, year, text):
    rows = [("f", bank, year, i, t) for i, t in enumerate(text.strip("\n").split("\n"))]
    df = spark.createDataFrame(rows, "file string, bank string, year int, line_no int, line string")
    return [(str(r.date), r.description, r.debit, r.credit, r.balance) for r in K.statement_rows(df).orderBy("row").collect()]


def _file(spark, text, file="f"):
    rows, page, n = [], 0, 0
    for t in text.strip("\n").split("\n"):
        if t == "---":
            page += 1
            continue
        rows.append((file, page, n, t))
        n += 1
    return spark.createDataFrame(rows, LINES)


def test_year_turns_within_a_statement(spark):
    text = """
BALANCE B/F 100.00
30/12 CHEQUE 10.00 90.00
CASH 5.00 85.00
02/01 DEPOSIT 20.00 105.00
INWARD 1.00 106.00
31/12 LATE 1.00 105.00
03/01 MORE 1.00 106.00
"""
    got = _bank(spark, "public_bank", 2023, text)
    assert [d for d, *_ in got] == ["2023-12-30", "2023-12-30", "2024-01-02", "2024-01-02", "2023-12-31", "2024-01-03"]
    assert [(r[2], r[3]) for r in got] == [(1000, 0), (500, 0), (0, 2000), (0, 100), (100, 0), (0, 100)]
    assert [d for d, *_ in _bank(spark, "rhb", 2023, "5 Nov A 1.00 9.00-\n20 Oct B 1.00 8.00-\n1 Feb C 1.00 7.00-")] == ["2023-11-05", "2023-10-20", "2024-02-01"]
    assert [d for d, *_ in _bank(spark, "agrobank", 1999, "30/12/23 A 1.00 9.00\n02/01/23 B 1.00 8.00")] == ["2023-12-30", "2023-01-02"]  # a printed year stays


def test_hints_of_two_banks(spark):
    ocbc = _bank(spark, "ocbc", 2024, "01 Jan 2024 DUITNOW SC 2.00 98.00\n02 Jan 2024 TRF CR /IB X 5.00 90.00\n03 Jan 2024 CREDIT DR NOTE 5.00 95.00\n04 Jan 2024 OTHER 5.00 85.00\n05 Jan 2024 OTHER 9.97 95.00")
    assert [(r[2], r[3]) for r in ocbc] == [(200, 0), (0, 500), (500, 0), (1000, 0), (0, 997)]
    ambank = _bank(spark, "ambank", 2024, "Baki permulaan 100.00\n01Jan FEE CREDIT 5.00 105.00\n02Jan SERVICE CHARGE 5.00 108.00\n03Jan MYSTERY 5.00 100.00\n04Jan INW AMB CHQ PRESENTED 5.00 109.00")
    assert [(r[2], r[3]) for r in ambank] == [(0, 500), (500, 0), (800, 0), (500, 0)]


def test_blocks_stop_at_footers_and_open_only_when_none_is_open(spark):
    text = """
Tarikh Kod Transaksi
03/02/2024 XFER ALPHA 5.00 105.00
 BETA SDN BHD
PAID 01/02/2024 FOR 7.00
Mukasurat 1
orphan text
see 02/02/2024 note 1.00 100.00
  more

---
04/02/2024 no amount here
dangling
99/99/2024 BAD 1.00 5.00
Closing Balance
 90.00
05/02/2024 OUT 15.00 90.00
"""
    got = [(r.row, str(r.date), r.description, r.debit, r.credit, r.balance) for r in B.stopped_blocks(_file(spark, text)).orderBy("row").collect()]
    # the last four amounts are 5.00, 90.00, 15.00, 90.00: the opening is the first of them
    assert got == [
        (1, "2024-02-02", "see note 1.00 more", 0, 9500, 10000),
        (2, "2024-02-03", "XFER ALPHA 5.00 BETA SDN BHD PAID 01/02/2024 FOR 7.00", 0, 500, 10500),
        (3, "2024-02-05", "OUT 15.00", 1500, 0, 9000),
    ]


def test_opening_is_solved_back_from_the_closing(spark):
    (row,) = B.summaries(_file(spark, "01/01/2024 X 30.00\nBaki Penutup : -\nClosing Balance :\n80.00")).collect()
    assert (row.opening, row.total_debit, row.closing) == (8000, None, 8000)
    (row,) = B.summaries(_file(spark, "Opening Balance 0.00\n9.00\n2.00 3.00\nBaki Penutup 10.00")).collect()
    assert (row.opening, row.total_debit, row.total_credit, row.closing) == (900, 200, 300, 1000)  # zero counts as not printed
    assert B.stopped_blocks(_file(spark, "nothing")).count() == 0 and B.summaries(_file(spark, "x").where("false")).count() == 0


def test_both_orders_give_one_ledger(spark):
    """The same rows printed backwards by one layout and forwards by another."""
    rng = random.Random(6)
    rows, balance = [], 10000
    for day in range(1, 28):
        for _ in range(rng.randrange(3)):
            balance += rng.choice([-1, 1]) * rng.randrange(1, 999)
            rows.append((f"{day:02d}/03/2024", f"ROW{len(rows)}", balance))
    money = lambda c: f"{'-' if c < 0 else ''}{abs(c) // 100:,}.{abs(c) % 100:02d}"
    back = ["OPENING BALANCE 100.00"] + [f"{d} {t} 0 {money(b)}" for d, t, b in reversed(rows)] + [f"CLOSING BALANCE / BAKI PENUTUP {money(balance)}"]
    forth = ["Opening Balance 100.00"] + [f"{d} {t} {money(b)}" for d, t, b in rows] + ["Page 1 of 1"]
    ledger = lambda df: [(str(r.date), r.description, r.debit, r.credit, r.balance) for r in df.orderBy("row").collect()]
    first = ledger(B.reversed_blocks(_file(spark, "\n".join(back))))
    second = ledger(B.stopped_blocks(_file(spark, "\n".join(forth))))
    assert first[0] == ("2024-03-01", "OPENING BALANCE (PAGE 1)", 0, 0, 10000) and first[-1][1:] == ("CLOSING BALANCE / BAKI PENUTUP", 0, 0, balance)
    assert first[1:-1] == second and [r[1] for r in second] == [t for _, t, _ in rows]


def test_reversed_blocks_go_on_over_pages_and_drop_repeats(spark):
    text = """
OPENING BALANCE 50.00
05/01/2024 LAST
---
PART TWO 0 70.00
after 1.00
04/01/2024 SAME 5.00 60.00
31/02/2024 BAD 1.00
04/01/2024 OTHER WORDS 5.00 60.00
03/01/2024 NEVER CLOSED
"""
    got = [(r.kind, str(r.date), r.description, r.debit, r.credit, r.balance) for r in B.reversed_blocks(_file(spark, text)).orderBy("row").collect()]
    assert got == [
        ("opening", "2024-01-01", "OPENING BALANCE (PAGE 1)", 0, 0, 5000), ("row", "2024-01-04", "OTHER WORDS", 0, 1000, 6000),
        ("row", "2024-01-04", "SAME", 0, 0, 6000), ("row", "2024-01-05", "LAST PART TWO", 0, 1000, 7000),
    ]


def _chosen(rows, opening):
    by = {}
    for f, d, b, line, p in rows:
        by.setdefault(f, {}).setdefault(d, []).append((b, line, p))
    out = []
    for f, days in by.items():
        prev = opening.get(f)
        for d in sorted(days) if prev is not None else ():
            _, b, line, p = min((abs(b - prev), b, line, p) for b, line, p in days[d])
            out.append((f, d, b, line, p))
            prev = b
    return sorted(out)


@pytest.mark.parametrize("batch", [3, 10000])
def test_chosen_balances_match_the_sequential_rule(spark, batch):
    rng = random.Random(batch)
    rows = [(f"f{f}", f"2024-01-{d:02d}", rng.randrange(20) * 10, f"l{i}", rng.randrange(3)) for f in range(6) for d in range(1, 29) for i in range(rng.choice([0, 1, 1, 2, 5, 12]))]
    rows = list({(f, d, b): (f, d, b, line, p) for f, d, b, line, p in rows}.values())  # once a date and balance
    opening = {f"f{f}": 100 for f in range(5)} | {"f5": None}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(rows, "file string, date string, balance long, line string, page int").repartition(3)
        got = B.chosen_balances(df, spark.createDataFrame(list(opening.items()), "file string, opening long")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got)) == _chosen(rows, opening)


def test_dated_lines_tell_balances(spark):
    text = "1/2/24 SALE 5.00 120.00\n1/2/24 NOISE 990.00\n 02/02/2024  FEE 1,000.00 118.50 \n3/3/24 other month 1.00\n31/2/24 bad 1.00\nno date 5.00\n4/2/24 nothing"
    lines = _file(spark, text).selectExpr("*", "'2024-02' AS month")
    got = [(r.row, str(r.date), r.description, r.debit, r.credit, r.balance) for r in B.dated_balances(lines, spark.createDataFrame([("f", 10000)], "file string, opening long")).orderBy("row").collect()]
    assert got == [(1, "2024-02-01", "SALE", 0, 2000, 12000), (2, "2024-02-02", "FEE", 150, 0, 11850)]


def _clustered(words, tolerance):
    lines = []
    for w in sorted(words, key=lambda w: (w[1], w[0])):
        for line in lines:
            if abs(w[1] - line[0]) <= tolerance:
                line[1].append(w)
                line[0] = (line[0] * (len(line[1]) - 1) + w[1]) / len(line[1])
                break
        else:
            lines.append([w[1], [w]])
    return {w[2]: i for i, (_, ws) in enumerate(sorted(lines, key=lambda x: x[0])) for w in ws}


@pytest.mark.parametrize("batch", [4, 10000])
def test_visual_lines_match_the_sequential_rule(spark, batch):
    rng = random.Random(batch)
    pages = {(f"f{p % 3}", p): [(rng.random() * 500, rng.choice([rng.random() * 60, rng.randrange(12) * 5.0]), i) for i in range(rng.randrange(1, 70))] for p in range(9)}
    rows = [(f, p, i, x, y, f"t{i}") for (f, p), ws in pages.items() for x, y, i in ws] + [("f0", 0, 999, 1.0, None, "lost")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {(r.file, r.page, r.word): r.line for r in L.visual_lines(spark.createDataFrame(rows, "file string, page int, word int, x double, y double, text string")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(f, p, i): k for (f, p), ws in pages.items() for i, k in _clustered(ws, 3.0).items()} | {("f0", 0, 999): None}


def test_amounts_go_to_the_nearest_column(spark):
    def page(n, dx, *rows):
        out = [(n, 1, x + dx, 10.0, t) for x, t in ((320, "Deposit"), (410, "Withdrawal"), (520, "Balance"))] if dx is not None else []
        return out + [(n, k, x + (dx or 0), 30.0 + 12 * k, t) for k, cells in enumerate(rows) for x, t in cells]

    words = page(0, 0, [(20, "01-02-2024"), (60, "PAY"), (330, "10.00"), (530, "110.00")], [(60, "more"), (100, "7.00")], [(60, "TOTAL"), (330, "9.00")], [(60, "gone"), (330, "1.00")])
    words += page(1, -60, [(20, "02-02-2024"), (365, "4.00"), (366, "2.00")], [(20, "03-02-2024"), (60, "EMPTY")], [(20, "04-02-2024"), (60, "OD"), (505, "(5.00)")])
    words += page(2, None, [(20, "05-02-2024"), (405, "3.00"), (60, "X"), (600, "1,000.00-")])
    df = spark.createDataFrame([("f", p, i, float(x), float(y), t) for i, (p, _, x, y, t) in enumerate(words)], "file string, page int, word int, x double, y double, text string")
    got = [(r.page, r.row, str(r.date), r.description, r.debit, r.credit, r.balance) for r in L.column_rows(L.visual_lines(df)).orderBy("page", "row").collect()]
    assert got == [
        (0, 1, "2024-02-01", "PAY more", 0, 1000, 11000), (1, 1, "2024-02-02", "", 200, 400, None), (1, 2, "2024-02-04", "OD", 0, 0, -500), (2, 1, "2024-02-05", "X", 300, 0, -100000),
    ]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString().lower()


def test_summaries_read_a_file_once_and_what_follows_a_line_from_its_end(spark, sf_dir):
    text = "Opening Balance\nno figures here\nas of 5 May\nBaki Permulaan\n1,000.00 5.00\nClosing Balance: 7.00\nBaki Penutup 9.00"
    got = [tuple(r) for r in B.summaries(_file(spark, text)).collect()]
    assert got == [("f", 100_000, 500, 700, 700)]
    # an open frame to the end is read anew for every row, in time that is quadratic in the file
    plan = _plan(B.summaries(_file(spark, text)))
    assert "unboundedfollowing$" not in plan and plan.count("exchange") == 1
    assert _plan(P.rakyat(spark, sf_dir)).count("filescan") <= 2


def test_reversed_statements_are_printed_and_read_in_one_pass(spark, sf_dir):
    plan = _plan(P.cimb(spark, sf_dir))
    assert plan.count("filescan") == 1 and "union" not in plan


def test_lines_of_banks_are_printed_in_one_pass(spark, sf_dir):
    from finloom.plans import banks

    plan = _plan(banks.QUERIES["bank_uob"](spark, sf_dir))
    assert plan.count("filescan") == 1 and "union" not in plan


def test_words_of_columns_are_printed_in_one_pass_and_anchors_need_no_join(spark, sf_dir):
    plan = _plan(P.columns(spark, sf_dir))
    assert "union" not in plan and plan.count("mapinarrow") == 2
    words = [("f", 0, 0, 1.0, None, "x"), ("f", 1, 1, 5.0, 0.0, "Deposit"), ("f", 1, 2, 6.0, 0.0, "Withdrawal"), ("f", 1, 3, 7.0, 0.0, "Balance")]
    lined = L.visual_lines(spark.createDataFrame(words, "file string, page int, word int, x double, y double, text string"))
    assert sorted(tuple(r) for r in L.anchors(lined).collect()) == [("f", 0, 320.0, 410.0, 520.0), ("f", 1, 5.0, 6.0, 7.0)]


def test_lines_of_pages_are_numbered_and_printed_in_one_pass(spark, sf_dir):
    rng, rows = random.Random(11), []
    for file in (None, 1, 2, 3, 4):
        for page in (None, 0, 1):
            apart = rng.choice([12.0, 3.5, 2.0])
            for w in range(rng.choice([1, 7, 90])):
                y = None if rng.random() < 0.05 else rng.randrange(9) * apart + rng.choice([0.0, 0.5, 1.0, 3.0])
                rows.append((file, page, w, None if rng.random() < 0.05 else rng.randrange(5) * 30.0, y, None if rng.random() < 0.05 else f"t{w}"))
    rng.shuffle(rows)
    want, low = {}, lambda v: (v is not None, v or 0)
    for key in {r[:2] for r in rows}:
        page = sorted((r for r in rows if r[:2] == key), key=lambda r: [low(v) for v in (r[4], r[3], r[2])])
        of = iter(L.line_numbers([r[4] for r in page if r[4] is not None], 3.0))
        for r in page:
            want.setdefault((*key, None if r[4] is None else next(of)), []).append(r)
    words = spark.createDataFrame(rows, "file long, page int, word long, x double, y double, text string")
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    try:
        for n in ("10000", "13", "1"):
            spark.conf.set(size, n)
            texts = L.line_texts(words).collect()
            assert {tuple(r[:3]): r.text for r in texts} == {k: " ".join(r[5] for r in sorted(v, key=lambda r: [low(r[3]), r[2]]) if r[5] is not None) for k, v in want.items()}
            assert len(texts) == len(want) > 30
            assert sorted([tuple(r) for r in L.visual_lines(words).collect()], key=str) == sorted([(*r, k[2]) for k, v in want.items() for r in v], key=str)
            assert L.line_texts(words.limit(0)).count() == L.visual_lines(words.limit(0)).count() == 0
    finally:
        spark.conf.set(size, before)
    assert _plan(P.page_lines(spark, sf_dir)).count("exchange") == 1
