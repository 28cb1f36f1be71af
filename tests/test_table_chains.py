"""Tables over pages, on literal fragments."""

from finloom.operators import tables as K


def _t(*rows, head=None):
    cells = lambda tag, r: "<tr>" + "".join(f"<{tag}>{c}</{tag}>" for c in r) + "</tr>"
    return "<table>" + (cells("th", head) if head else "") + "".join(cells("td", r) for r in rows) + "</table>"


def test_chain_of_four_pages_and_one_that_breaks(spark):
    head = ("Date", "Amount")
    rows = [
        (1, 1, 0, _t(("note", "x", "y"))), (1, 1, 5, _t(("a", "1"), head=head)), (1, 2, 0, _t(("b", "2"), head=head)), (1, 3, 0, _t(("c", "3"))), (1, 4, 0, _t(("d", ""))),
        (2, 1, 0, _t(("a", "1"), head=head)), (2, 2, 0, _t(("b", "2"))), (2, 2, 3, _t(("z", "9"))), (2, 3, 0, _t(("c", "3"))), (2, 5, 0, _t(("d", "4"))), (2, 6, 0, _t(("e", "5"), head=("Other", "Head"))), (2, 7, 0, _t(("6", "e"))),
        (3, 1, 0, None), (3, 2, 0, "no rows"), (3, 3, 0, _t(("k", "1"))),
    ]
    got = K.chained(spark.createDataFrame([(*r, "c") for r in rows], "doc_id int, page int, reading_order int, html string, n_tables string")).collect()
    shown = {(r.doc_id, r.page, r.reading_order): (r.last_page, r.n_tables, K_cells(r.html)) for r in got}
    assert shown == {
        (1, 1, 0): (1, 1, "note x y"), (1, 1, 5): (4, 4, "Date Amount a 1 b 2 c 3 d "), (2, 1, 0): (2, 2, "Date Amount a 1 b 2"), (2, 2, 3): (3, 2, "z 9 c 3"), (2, 5, 0): (5, 1, "d 4"),
        (2, 6, 0): (6, 1, "Other Head e 5"), (2, 7, 0): (7, 1, "6 e"), (3, 1, 0): (1, 1, None), (3, 2, 0): (2, 1, "no rows"), (3, 3, 0): (3, 1, "k 1"),
    }
    assert K.chained(spark.createDataFrame([], "doc_id int, page int, reading_order int, html string")).count() == 0


def K_cells(html):
    import re

    return html if html is None or "<" not in html else " ".join(re.findall(r"<t[dh]>(.*?)</t[dh]>", html))


def test_parts_follow_the_rows_and_chains_take_them(spark, sf_dir, monkeypatch):
    from finloom.plans import tables as P
    from finloom.sources import tables as S

    t = S.table(spark, sf_dir, "lineitem")
    n, least = t.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert S.parted(t, "l_orderkey").rdd.getNumPartitions() == least
    assert S.parted(t, "l_orderkey", n // 10).rdd.getNumPartitions() == -(-n // (n // 10)) > least
    plan = P.table_chains(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "REPARTITION_BY_NUM" in plan
    assert "_rows" not in plan and "_body" not in plan
