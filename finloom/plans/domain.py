"""Queries over parties, returns, statements and documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from finloom.functions import dates, money, text
from finloom.operators import documents as D
from finloom.operators import finstat as FS
from finloom.operators import pairing as P
from finloom.operators import parties as Y
from finloom.sources import tables as S


def ledger_groupby(spark, d):
    return Y.ledger(S.ledger(spark, d))


def party_month_breakdown(spark, d):
    by = Y.month_breakdown(S.ledger(spark, d))
    line = lambda m: F.concat_ws(":", m["month"], m["credits"], m["debits"], m["n_rows"])
    return by.select("party", F.array_join(F.transform("months", line), ";").alias("breakdown"))


def top_payers(spark, d):
    return Y.top(Y.ledger(S.ledger(spark, d)), "credits")


def top_payees(spark, d):
    return Y.top(Y.ledger(S.ledger(spark, d)), "debits")


def rp_signals(spark, d):
    return Y.related_signals(S.ledger(spark, d))


def rp_autoconfirm(spark, d):
    return Y.related_signals(S.ledger(spark, d)).where("confidence = 'HIGH'").select("party", "score")


def ghost_anti_join(spark, d):
    return Y.without_ghosts(Y.named(S.ledger(spark, d))).groupBy("party").agg(F.count("*").alias("n_rows"))


def suffix_repair(spark, d):
    return S.ledger(spark, d).select("counterparty").distinct().select("counterparty", text.repaired_suffix(F.col("counterparty")).alias("repaired"))


def entity_merge_key(spark, d):
    return Y.merge_links(S.ledger(spark, d).select(F.col("counterparty").alias("name")).distinct())


def own_party_root(spark, d):
    return Y.own_party(S.ledger(spark, d).select(F.col("counterparty").alias("name")).distinct(), "BINTANG JAYA")


def lookup_join_last_wins(spark, d):
    """Rows left-joined to names by (date, amount, side), null-safe; the last ledger entry of a key wins."""
    tx = S.ledger(spark, d)
    key = ["date", "credit", "debit"]
    last = Window.partitionBy(*key).orderBy(F.col("row_ord").desc())
    names = tx.withColumn("rn", F.row_number().over(last)).where("rn = 1").select(*[F.col(k).alias(f"l_{k}") for k in key], F.col("counterparty").alias("found"))
    on = [tx[k].eqNullSafe(names[f"l_{k}"]) for k in key]
    return tx.join(names, on, "left").select("row_ord", "found")


def return_pair_candidates(spark, d):
    return P.candidates(_returns(spark, d)).select("account", "debit_row", "credit_row", "days")


def return_pairs_greedy(spark, d):
    return P.greedy_pairs(_returns(spark, d))


def unkeyworded_pairs(spark, d):
    tx = _returns(spark, d)
    return P.unkeyworded(P.greedy_pairs(tx), tx).select("account", "debit_row", "credit_row")


RETURNS = f"""SELECT account % 7 AS account, row_ord, CAST('2024-01-01' AS DATE) + CAST(row_ord % 60 AS INT) AS date, description,
  CASE WHEN credit > 0 THEN row_ord % 23 * 1000 + 1000 ELSE 0 END AS credit, CASE WHEN debit > 0 THEN row_ord % 23 * 1000 + 1000 ELSE 0 END AS debit
FROM ({S.LEDGER_SQL}) z"""


def _returns(spark, d):
    return spark.sql(RETURNS.replace("FROM orders", "FROM {t}"), t=S.table(spark, d, "orders"))


def business_days(spark, d):
    o = S.ledger(spark, d).select("row_ord", "date", F.date_add("date", F.pmod("row_ord", F.lit(12)).cast("int")).alias("until"))
    return o.select("row_ord", dates.business_days(F.col("date"), F.col("until")).cast("bigint").alias("days"))


def money_parse(spark, d):
    o = S.table(spark, d, "orders")
    k = F.col("o_orderkey") % 5
    c = F.format_number("o_totalprice", 2)
    shown = F.when(k == 0, c).when(k == 1, F.concat(F.lit("("), c, F.lit(")"))).when(k == 2, F.concat(c, F.lit(" DR"))).when(k == 3, F.concat(F.lit("RM "), c)).otherwise("n/a")
    return o.select("o_orderkey", money.parsed_cents(shown).alias("cents"))


def date_parse(spark, d):
    o = S.table(spark, d, "orders")
    k = F.col("o_orderkey") % 4
    shown = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "dd/MM/yyyy")).when(k == 2, F.date_format("o_orderdate", "dd MMM yyyy")).otherwise("none")
    return o.select("o_orderkey", dates.parsed_date(shown).alias("parsed"))


def _chain(spark, d):
    return FS.profit_chain(S.figures(spark, d))


def fin_pnl_chain(spark, d):
    return _chain(spark, d).select("entity", "period", "gross_profit", "ebit", "pbt", "npat")


def fin_identities(spark, d):
    c = _chain(spark, d)
    return c.select("entity", "period", FS.compared(F.col("revenue") - F.col("cost") - F.col("expenses") + F.col("line_count") % 5 * 60, F.col("ebit")).alias("status"))


def fin_ratios(spark, d):
    return FS.ratios(_chain(spark, d))


def fin_days(spark, d):
    return FS.day_counts(S.figures(spark, d))


def fin_dscr(spark, d):
    return FS.debt_service(_chain(spark, d))


def fin_equity_lag(spark, d):
    """Retained earnings are shown as profit so far, now and then with an error."""
    so_far = F.sum("npat").over(Window.partitionBy("entity").orderBy("period"))
    return FS.equity_articulation(_chain(spark, d).withColumn("retained", (so_far + F.col("line_count") % 4 * 150).cast("bigint")))


def fin_missing_periods(spark, d):
    return FS.missing_periods(S.figures(spark, d))


def fin_drift(spark, d):
    return FS.movement(S.figures(spark, d), "revenue")


def chunk_page(spark, d):
    return D.page_chunks(S.fragments(spark, d)).select("doc_id", "page", F.sha2("content", 256).alias("sha256"))


def chunk_section(spark, d):
    return D.section_chunks(S.fragments(spark, d))


def chunk_patterns(spark, d):
    return D.pattern_chunks(S.fragments(spark, d), "^the")


def table_row_split(spark, d):
    return D.row_budget(S.fragments(spark, d), 3)


def adjacent_page_join(spark, d):
    return D.adjacent_tables(S.fragments(spark, d))


def page_class_lists(spark, d):
    return D.page_classes(S.fragments(spark, d))


def header_hierarchy(spark, d):
    return D.header_trail(S.fragments(spark, d))


def html_to_text(spark, d):
    return S.table(spark, d, "pages").select("page_id", F.sha2(D.html_text(F.col("html")), 256).alias("sha256"))


BOXES = "SELECT p_partkey AS box, CAST(floor(p_partkey / 100) AS BIGINT) AS page, p_size AS x1, p_partkey % 50 AS y1, p_size + 10 + p_partkey % 7 AS x2, p_partkey % 50 + 12 + p_size % 5 AS y2 FROM part"


def _boxes(spark, d):
    return spark.sql(BOXES.replace("FROM part", "FROM {t}"), t=S.table(spark, d, "part"))


def iou_join(spark, d):
    return D.overlap_pairs(_boxes(spark, d), 0.7)


def box_containment(spark, d):
    return D.containment(_boxes(spark, d))


def nearest_label(spark, d):
    b = _boxes(spark, d)
    return D.nearest_label(b.where("box % 3 <> 0"), b.where("box % 3 = 0"))


QUERIES = {f.__name__: f for f in (
    ledger_groupby, party_month_breakdown, top_payers, top_payees, rp_signals, rp_autoconfirm, ghost_anti_join, suffix_repair, entity_merge_key,
    own_party_root, lookup_join_last_wins, return_pair_candidates, return_pairs_greedy, unkeyworded_pairs, business_days, money_parse, date_parse,
    fin_pnl_chain, fin_identities, fin_ratios, fin_days, fin_dscr, fin_equity_lag, fin_missing_periods, fin_drift, chunk_page, chunk_section,
    chunk_patterns, table_row_split, adjacent_page_join, page_class_lists, header_hierarchy, html_to_text, iou_join, box_containment, nearest_label,
)}

_REPAIR = r"regexp_replace(upper(trim(regexp_replace(counterparty, '\s+', ' ', 'g'))), '\s+(SDN\.?(\s+B(H(D\.?)?)?)?|SB)$', ' SDN BHD')"
_LIST = ", ".join(f"'{g}'" for g in Y.GHOSTS + Y.CHEQUE_BUCKETS)
TX = f"WITH tx AS ({S.LEDGER_SQL}), n AS (SELECT *, {_REPAIR} AS party FROM tx)"
BOOK = TX + """, b AS (SELECT party, CAST(sum(credit) AS BIGINT) AS credits, CAST(sum(debit) AS BIGINT) AS debits, CAST(sum(credit - debit) AS BIGINT) AS net,
  count(*) FILTER (credit > 0) AS credit_rows, count(*) FILTER (debit > 0) AS debit_rows, count(*) AS n_rows, count(DISTINCT month) AS months FROM n GROUP BY party)"""
SIGNALS = TX + rf""", w AS (SELECT *, debit >= 100000 AND debit % 10000 = 0 AS rnd, debit > 0 AND regexp_matches(upper(description), '\b(DIRECTOR|ADVANCE|ALLOWANCE|CLAIM)\b') AS ben,
    debit > 0 AND regexp_matches(upper(description), '\b(SALARY|GAJI|PAYROLL)\b') AS sal FROM n WHERE party NOT IN ({_LIST})),
  g AS (SELECT party, CAST(sum(credit) AS BIGINT) AS credits, CAST(sum(debit) AS BIGINT) AS debits, count(*) FILTER (credit > 0) AS cr_n, count(*) FILTER (debit > 0) AS dr_n,
    count(DISTINCT month) FILTER (debit > 0) AS dr_months, count(*) FILTER (rnd) AS round_n, count(DISTINCT month) FILTER (rnd) AS round_months, count(*) FILTER (ben) AS benefit_n,
    count(*) FILTER (sal) AS salary_n, coalesce(sum(debit) FILTER (sal), 0) AS salary_sum FROM w GROUP BY party),
  sc AS (SELECT *, CASE WHEN debits * 100 >= (SELECT sum(debit) FROM tx) * 5 THEN 2 ELSE 0 END + CASE WHEN dr_months >= 3 THEN 1 ELSE 0 END
    + CASE WHEN cr_n >= 2 AND dr_n >= 2 AND least(credits, debits) * 100 >= greatest(credits, debits) * 5 THEN 2 ELSE 0 END
    + CASE WHEN round_n >= 5 AND round_months >= 4 THEN 2 WHEN round_n >= 2 THEN 1 ELSE 0 END + CASE WHEN benefit_n > 0 THEN 2 ELSE 0 END AS score,
    regexp_matches(party, '{text.PERSON}') AS person FROM g WHERE NOT (salary_n >= 2 AND salary_sum * 100 >= debits * 50)),
  rp AS (SELECT party, credits, debits, dr_months, round_n, benefit_n, score, person,
    CASE WHEN score >= 3 AND (person OR benefit_n > 0) THEN 'HIGH' WHEN score >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM sc)"""


def _root_sql(c: str) -> str:
    bare = rf"regexp_replace(upper({c}), '\s*\([^)]*\)\s*', ' ', 'g')"
    for _ in range(2):
        bare = f"regexp_replace({bare}, '{text.SUFFIX}', '', 'g')"
    bare = rf"regexp_replace(trim(regexp_replace(regexp_replace({bare}, '[^A-Z0-9 ]', ' ', 'g'), '\s+', ' ', 'g')), '^([0-9]+\s+)+', '')"
    return f"CASE WHEN regexp_matches({bare}, '^[0-9]*$') THEN '' ELSE {bare} END"


def _top(c: str) -> str:
    return BOOK + f" SELECT row_number() OVER (ORDER BY {c} DESC, party) AS place, party, {c} AS amount FROM b WHERE {c} > 0 AND party NOT IN ({_LIST}) ORDER BY {c} DESC, party LIMIT 10"


PAIRS = f"""WITH tx AS ({RETURNS}), o AS (SELECT * FROM tx WHERE debit > 0 AND regexp_matches(upper(description), '{P.OUTWARD}') AND NOT regexp_matches(upper(description), '{P.INWARD}')),
  c AS (SELECT o.account, o.row_ord AS debit_row, x.row_ord AS credit_row,
    (SELECT count(*) FROM range(1, 12) t(k) WHERE k <= x.date - o.date AND isodow(o.date + CAST(k AS INT)) < 6) AS days
    FROM o JOIN tx x ON x.account = o.account AND x.credit > 0 AND abs(x.credit - o.debit) <= 1 AND x.date - o.date BETWEEN 0 AND 9 AND x.row_ord <> o.row_ord)"""
FIG = f"WITH f AS ({S.FIGURES_SQL}), c AS (SELECT *, revenue - cost AS gross_profit, revenue - cost - expenses AS ebit, revenue - cost - expenses - interest AS pbt, revenue - cost - expenses - interest - tax AS npat FROM f)"
FRAG = f"WITH fr AS ({S.FRAGMENTS_SQL['duck']})"


def _bp(a: str, b: str) -> str:
    return f"CAST(CASE WHEN {b} <> 0 THEN floor(CAST({a} AS DECIMAL(38, 6)) * 10000 / {b}) END AS BIGINT)"


_TAGS = r"regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '', '', 'g')"
for _e, _c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
    _TAGS = f"replace({_TAGS}, '{_e}', '{_c}')"

ORACLES = {
    "ledger_groupby": BOOK + " SELECT * FROM b",
    "party_month_breakdown": TX + """, m AS (SELECT party, month, CAST(sum(credit) AS BIGINT) AS c, CAST(sum(debit) AS BIGINT) AS d, count(*) AS k FROM n GROUP BY ALL)
      SELECT party, string_agg(month || ':' || c || ':' || d || ':' || k, ';' ORDER BY month) AS breakdown FROM m GROUP BY party""",
    "top_payers": _top("credits"),
    "top_payees": _top("debits"),
    "rp_signals": SIGNALS + " SELECT * FROM rp",
    "rp_autoconfirm": SIGNALS + " SELECT party, score FROM rp WHERE confidence = 'HIGH'",
    "ghost_anti_join": TX + f" SELECT party, count(*) AS n_rows FROM n WHERE party NOT IN ({_LIST}) GROUP BY party",
    "suffix_repair": TX + " SELECT DISTINCT counterparty, party AS repaired FROM n",
    "entity_merge_key": TX + f""", k AS (SELECT name, regexp_replace({_root_sql("name")}, '[^A-Z0-9]', '', 'g') AS key FROM (SELECT DISTINCT counterparty AS name FROM tx))
      SELECT name, key, first_value(name) OVER (PARTITION BY key ORDER BY length(name) DESC, name DESC) AS root FROM k WHERE key <> ''""",
    "own_party_root": TX + " SELECT DISTINCT counterparty AS name FROM tx WHERE contains(counterparty, 'BINTANG JAYA') OR (length(counterparty) >= 6 AND contains('BINTANG JAYA', counterparty))",
    "lookup_join_last_wins": TX + " SELECT row_ord, last_value(counterparty) OVER (PARTITION BY date, credit, debit ORDER BY row_ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS found FROM tx",
    "return_pair_candidates": PAIRS + " SELECT account, debit_row, credit_row, days FROM c WHERE days <= 5",
    "business_days": TX + """, u AS (SELECT row_ord, date, date + CAST(row_ord % 12 AS INT) AS until FROM tx)
      SELECT row_ord, (SELECT count(*) FROM range(1, 12) t(k) WHERE k <= until - date AND isodow(date + CAST(k AS INT)) < 6) AS days FROM u""",
    "money_parse": "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 1 WHEN 1 THEN -1 WHEN 2 THEN -1 WHEN 3 THEN 1 END * CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders",
    "date_parse": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN CAST(o_orderdate AS DATE) END AS parsed FROM orders",
    "fin_pnl_chain": FIG + " SELECT entity, period, gross_profit, ebit, pbt, npat FROM c",
    "fin_identities": FIG + " SELECT entity, period, CASE WHEN line_count % 5 * 60 <= 200 THEN 'OK' ELSE 'DIFFERS' END AS status FROM c",
    "fin_ratios": FIG + f" SELECT entity, period, {', '.join(_bp(n, 'revenue') + f' AS {n}_margin' for n in ('gross_profit', 'ebit', 'pbt', 'npat'))}, {_bp('ebit', 'interest')} AS interest_cover FROM c",
    "fin_days": FIG + " SELECT entity, period, CAST(CASE WHEN revenue <> 0 THEN floor(CAST(tax AS DECIMAL(38, 6)) * 365 / revenue) END AS BIGINT) AS debtor_days, CAST(CASE WHEN cost <> 0 THEN floor(CAST(tax AS DECIMAL(38, 6)) * 365 / cost) END AS BIGINT) AS creditor_days FROM f",
    "fin_dscr": FIG + f", p AS (SELECT *, greatest(coalesce(lag(cost) OVER (PARTITION BY entity ORDER BY period) - cost, 0), 0) AS principal FROM c), q AS (SELECT *, interest + principal AS service FROM p) SELECT entity, period, principal, service, {_bp('ebit', 'service')} AS dscr FROM q",
    "fin_equity_lag": FIG + ", r AS (SELECT *, CAST(sum(npat) OVER (PARTITION BY entity ORDER BY period) + line_count % 4 * 150 AS BIGINT) AS retained FROM c), l AS (SELECT *, lag(retained) OVER (PARTITION BY entity ORDER BY period) AS opening FROM r) SELECT entity, period, opening, npat, retained, CASE WHEN abs(opening + npat - retained) <= 200 THEN 'OK' ELSE 'DIFFERS' END AS status FROM l WHERE opening IS NOT NULL",
    "fin_missing_periods": FIG + ", g AS (SELECT entity, period FROM f) SELECT e.entity, p.period FROM (SELECT DISTINCT entity FROM g) e, (SELECT DISTINCT period FROM g) p EXCEPT SELECT entity, period FROM g",
    "fin_drift": FIG + f", b AS (SELECT *, lag(revenue) OVER (PARTITION BY entity ORDER BY period) AS before FROM f) SELECT entity, period, revenue, before, {_bp('(revenue - before)', 'before')} AS change FROM b",
    "chunk_page": FRAG + " SELECT doc_id, page, sha256(string_agg(content, chr(10) ORDER BY reading_order)) AS sha256 FROM fr GROUP BY doc_id, page",
    "chunk_section": FRAG + """, s AS (SELECT *, CASE WHEN kind = 'section_header' AND coalesce(lag(kind) OVER (PARTITION BY doc_id ORDER BY reading_order), '') <> 'section_header' THEN 1 ELSE 0 END AS st FROM fr),
      t AS (SELECT *, CAST(sum(st) OVER (PARTITION BY doc_id ORDER BY reading_order) AS BIGINT) AS section FROM s)
      SELECT doc_id, section, min(page) AS first_page, max(page) AS last_page, count(*) AS n_fragments, CAST(sum(length(content)) AS BIGINT) AS n_chars,
        sha256(string_agg(content, chr(10) ORDER BY reading_order)) AS sha256 FROM t GROUP BY doc_id, section""",
    "chunk_patterns": FRAG + """, t AS (SELECT *, CAST(sum(CASE WHEN regexp_matches(lower(content), '^the') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY reading_order) AS BIGINT) AS chunk FROM fr)
      SELECT doc_id, chunk, count(*) AS n_fragments, min(reading_order) AS first FROM t GROUP BY doc_id, chunk""",
    "table_row_split": FRAG + """, t AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY doc_id ORDER BY reading_order) - 1) / 3) AS BIGINT) AS chunk FROM fr WHERE kind = 'table')
      SELECT doc_id, chunk, count(*) AS n_rows, min(reading_order) AS first FROM t GROUP BY doc_id, chunk""",
    "adjacent_page_join": FRAG + """, t AS (SELECT doc_id, page, min(reading_order) AS f, max(reading_order) AS l FROM fr WHERE kind = 'table' GROUP BY doc_id, page)
      SELECT a.doc_id, a.page, a.l AS last, b.f AS next_first FROM t a JOIN t b ON b.doc_id = a.doc_id AND b.page = a.page + 1""",
    "page_class_lists": FRAG + " SELECT doc_id, kind, array_to_string(list_sort(list(DISTINCT page)), ',') AS pages FROM fr GROUP BY doc_id, kind",
    "header_hierarchy": FRAG + " SELECT doc_id, reading_order, last_value(CASE WHEN kind = 'section_header' THEN reading_order END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY reading_order) AS header FROM fr",
    "html_to_text": rf"SELECT page_id, sha256(trim(regexp_replace({_TAGS}, '\s+', ' ', 'g'))) AS sha256 FROM pages",
    "iou_join": f"""WITH x AS ({BOXES}), j AS (SELECT a.page, a.box AS a, b.box AS b, greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) AS shared,
        (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS areas FROM x a JOIN x b ON a.page = b.page AND a.box < b.box)
      SELECT page, a, b, shared, areas - shared AS joint FROM j WHERE areas - shared > 0 AND shared * 1000 > (areas - shared) * 700""",
    "box_containment": f"""WITH x AS ({BOXES}) SELECT a.page, a.box AS "inner", b.box AS "outer" FROM x a JOIN x b ON a.page = b.page AND a.box <> b.box
      WHERE greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) * 100 >= (a.x2 - a.x1) * (a.y2 - a.y1) * 90""",
    "nearest_label": f"""WITH x AS ({BOXES}), j AS (SELECT a.page, a.box, b.box AS label, (a.x1 + a.x2 - b.x1 - b.x2) ** 2 + (a.y1 + a.y2 - b.y1 - b.y2) ** 2 AS dist
        FROM x a JOIN x b ON a.page = b.page WHERE a.box % 3 <> 0 AND b.box % 3 = 0)
      SELECT page, box, CAST(dist AS BIGINT) AS distance, label FROM j QUALIFY row_number() OVER (PARTITION BY page, box ORDER BY dist, label) = 1""",
}
