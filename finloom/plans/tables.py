"""Queries over tables and layouts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from finloom.operators import tables as K
from finloom.sources import tables as S

#: A small table per order: a head, two rows of figures, and now and then a spanning or a short row.
HTML = """SELECT o_orderkey AS "table", '<table border="1"><tr><th>Date</th><th>Text</th><th>Amount</th></tr> <tr class="a"><td>' || substr(CAST(o_orderdate AS STRING), 1, 10) || '</td><td><b>' || o_orderpriority || '</b></td><td>$1,'
  || CAST(o_orderkey % 900 + 100 AS STRING) || '.50</td></tr>' || CASE o_orderkey % 4 WHEN 0 THEN '<tr><td colspan="2">Total</td><td>(5.00)</td></tr>' WHEN 1 THEN '<tr><td>short</td></tr>' WHEN 2 THEN '<tr><td> </td><td></td><td>7%</td></tr>' ELSE '' END || '</table>' AS html FROM orders"""
POLYGONS = "SELECT p_partkey AS box, p_size AS a, p_partkey % 50 AS b, p_size + 10 AS c, p_partkey % 50 + p_size % 9 AS d FROM part"


def _html(spark, d):
    return spark.sql(HTML.replace('"table"', "`table`").replace("FROM orders", "FROM {t}"), t=S.table(spark, d, "orders"))


def html_slice_rows(spark, d):
    h = F.col("html")
    return _html(spark, d).select("table", K.sliced(h, 1).alias("tail"), K.sliced(h, 0, 1).alias("head"), K.without_first(h, 1).alias("headless"), F.size(K.rows_of(h)).alias("n_rows"))


def html_merge_rows(spark, d):
    return _html(spark, d).select("table", F.sha2(K.merged(F.col("html"), F.col("html"), 1), 256).alias("sha256"))


def html_cell_types(spark, d):
    cells = _html(spark, d).select("table", F.posexplode(F.flatten(K.grid(F.col("html")))).alias("place", "text"))
    return cells.select("table", "place", "text", K.cell_type(F.col("text")).alias("kind"))


def html_column_types(spark, d):
    h = F.col("html")
    return _html(spark, d).select("table", F.array_join(K.column_types(h, 3), ",").alias("first"), F.array_join(K.column_types(h, 1, False), ",").alias("last"))


def html_alignment(spark, d):
    t = _html(spark, d)
    following = t.select((F.col("table") - 1).alias("table"), F.when(F.col("table") % 2 == 0, K.without_first(F.col("html"), 1)).otherwise(F.col("html")).alias("next"))
    return t.join(following, "table").select("table", K.aligned(F.col("html"), F.col("next")).alias("aligned"))


def html_odd_rows(spark, d):
    return K.odd_rows(_html(spark, d))


def markdown_escape(spark, d):
    return S.ledger(spark, d).select("row_ord", K.escaped_markdown(F.concat_ws("|", "description", F.lit("(x) [y] #1"))).alias("escaped"))


def markdown_to_html(spark, d):
    o = S.ledger(spark, d)
    line = F.concat(F.lit("| "), "description", F.lit(" | "), F.col("account").cast("string"), F.lit(" |"))
    text = F.when(F.col("row_ord") % 3 == 0, F.concat(F.lit("| A | B |\n|---|:-:|\n"), line)).when(F.col("row_ord") % 3 == 1, F.concat(line, F.lit("\nafter"))).otherwise("no table")
    return o.select("row_ord", K.markdown_to_html(text).alias("html"))


def polygon_boxes(spark, d):
    p = spark.sql(POLYGONS.replace("FROM part", "FROM {t}"), t=S.table(spark, d, "part"))
    box = K.bounding_box(F.array("a", "b", "c", "b", "c", "d", "a", "d"), F.lit(2), F.lit(3))
    return p.select("box", box.alias("r")).select("box", "r.*")


def document_routes(spark, d):
    f = S.fragments(spark, d).withColumn("kind", F.when(F.col("doc_id") % 3 == 0, F.when(F.col("reading_order") % 5 == 1, "figure").otherwise("text")).otherwise(F.col("kind")))
    return K.routes(f)


def documents_in_order(spark, d):
    """Documents asked for by a list of ids, in its order; unknown ids give no row."""
    asked = spark.sql("SELECT posexplode(array(7, 3, 100000000, 5, 3)) AS (place, doc_id)")
    docs = S.table(spark, d, "documents").select("doc_id", "n_chars")
    return asked.withColumn("doc_id", F.col("doc_id").cast("long")).join(docs, "doc_id").select("place", "doc_id", "n_chars")


def table_neighbours(spark, d):
    """Tables of a page with the first table of the next page or, if that has none, of the one after."""
    t = S.fragments(spark, d).where("kind = 'table'").groupBy("doc_id", "page").agg(F.min("reading_order").alias("first"), F.max("reading_order").alias("last"))
    after = F.explode(F.array(F.struct(F.lit(1).alias("depth")), F.struct(F.lit(2).alias("depth"))))
    asked = t.select("doc_id", "page", "last", after.alias("x")).select("doc_id", "page", "last", "x.depth", (F.col("page") + F.col("x.depth")).alias("other"))
    met = asked.join(t.select("doc_id", F.col("page").alias("other"), F.col("first").alias("next_first")), ["doc_id", "other"])
    return met.groupBy("doc_id", "page").agg(F.max("last").alias("last"), F.min("depth").alias("depth"), F.min_by("next_first", "depth").alias("next_first"))


#: A table a line item on pages of its own: heads on the first and on even ones, a third column on the third of every third order, a page without a table.
CHAINS = """SELECT l_orderkey AS doc_id, n + CASE WHEN n >= 4 AND l_orderkey % 5 = 0 THEN 1 ELSE 0 END AS page, 1 AS reading_order, n, l_orderkey % 3 = 0 AND n = 3 AS wide,
  CASE WHEN n = 1 OR n % 2 = 0 THEN '<tr><th>Item</th><th>Qty</th></tr>' ELSE '' END AS head,
  '<tr><td>P' || l_partkey || '</td><td>' || CAST(l_quantity AS INT) || '</td>' || CASE WHEN l_orderkey % 3 = 0 AND n = 3 THEN '<td>7</td>' ELSE '' END || '</tr>' AS line
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n FROM lineitem) l"""


def table_chains(spark, d):
    """Tables over pages put together; chains break where columns or pages do."""
    t = spark.sql(CHAINS.replace("FROM lineitem", "FROM {t}"), t=S.parted(S.table(spark, d, "lineitem"), "l_orderkey"))
    return K.chained(t.select("doc_id", "page", "reading_order", F.concat(F.lit("<table>"), "head", "line", F.lit("</table>")).alias("html")))


QUERIES = {f.__name__: f for f in (
    table_chains, html_slice_rows, html_merge_rows, html_cell_types, html_column_types, html_alignment, html_odd_rows, markdown_escape, markdown_to_html, polygon_boxes,
    document_routes, documents_in_order, table_neighbours,
)}

_H = f"WITH h AS ({HTML.replace('AS STRING', 'AS VARCHAR')}), p AS (SELECT \"table\", \"table\" % 4 AS k, regexp_extract(html, '<td>([0-9-]+)</td>', 1) AS a, regexp_extract(html, '<b>(.*?)</b>', 1) AS b, regexp_extract(html, '<td>(\\$1,.*?)</td>', 1) AS c, regexp_extract_all(html, '<tr.*?</tr>') AS r, html FROM h)"
_EXTRA = "CASE k WHEN 0 THEN ['Total', 'Total', '(5.00)'] WHEN 1 THEN ['short'] WHEN 2 THEN ['', '', '7%'] ELSE [] END"
_KIND = "CASE WHEN x = '' THEN 'empty' WHEN x IN ('(5.00)', '7%') OR starts_with(x, '$1,') THEN 'number' ELSE 'text' END"
_FIRST = "CASE WHEN true THEN 'text,text,text' END"
_LAST = "CASE k WHEN 0 THEN 'text,text,number' WHEN 1 THEN 'text' WHEN 2 THEN 'empty,empty,number' ELSE 'text,text,number' END"
_FR = f"WITH fr AS ({S.FRAGMENTS_SQL['duck']})"
ORACLES = {
    "table_chains": f"""WITH t AS ({CHAINS}), c AS (
        SELECT *, coalesce(NOT wide AND NOT lag(wide) OVER o AND lag(page) OVER o = page - 1, false) AS goes_on FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY n)
      ), g AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY n) AS chain FROM c)
      SELECT doc_id, min(page) AS page, 1 AS reading_order, max(page) AS last_page, count(*) AS n_tables, CASE WHEN count(*) = 1 THEN '<table>' || any_value(head) || any_value(line) || '</table>' ELSE
        '<table>' || chr(10) || string_agg(CASE WHEN goes_on OR head = '' THEN '' ELSE head || chr(10) END || line, chr(10) ORDER BY n) || chr(10) || '</table>' END AS html FROM g GROUP BY doc_id, chain""",
    "html_slice_rows": _H + """ SELECT "table", '<table border="1">' || chr(10) || array_to_string(r[2:], chr(10)) || chr(10) || '</table>' AS tail, '<table border="1">' || chr(10) || r[1] || chr(10) || '</table>' AS head,
      replace(html, r[1], '') AS headless, len(r) AS n_rows FROM p""",
    "html_merge_rows": _H + """ SELECT "table", sha256(replace(html, '</table>', chr(10) || array_to_string(r[2:], chr(10)) || chr(10) || '</table>')) AS sha256 FROM p""",
    "html_cell_types": _H + f""", c AS (SELECT "table", list_concat(['Date', 'Text', 'Amount', a, b, c], {_EXTRA}) AS v FROM p), u AS (SELECT "table", unnest(v) AS x, unnest(range(len(v))) AS place FROM c)
      SELECT "table", place, x AS text, {_KIND} AS kind FROM u""",
    "html_column_types": _H + f' SELECT "table", {_FIRST} AS "first", {_LAST} AS "last" FROM p',
    "html_alignment": _H + ' SELECT "table", "table" % 2 = 0 AS aligned FROM p a WHERE EXISTS (SELECT 1 FROM p b WHERE b."table" = a."table" + 1)',
    "html_odd_rows": _H + ' SELECT "table", 3 AS "row", 1 AS width, 3 AS usual FROM p WHERE k = 1',
    "markdown_escape": f"WITH tx AS ({S.LEDGER_SQL}) " + r"""SELECT row_ord, regexp_replace(description || '|(x) [y] #1', '([\\`*_{}\[\]()#+!|>~$-])', '\\\1', 'g') AS escaped FROM tx""",
    "markdown_to_html": f"WITH tx AS ({S.LEDGER_SQL}) " + """SELECT row_ord, CASE row_ord % 3 WHEN 0 THEN '<table><tr><th>A</th><th>B</th></tr><tr><td>' || description || '</td><td>' || account || '</td></tr></table>'
      WHEN 1 THEN '<table><tr><td>' || description || '</td><td>' || account || '</td></tr></table>' END AS html FROM tx""",
    "polygon_boxes": f"WITH p AS ({POLYGONS}) SELECT box, a * 2 AS x1, b * 3 AS y1, c * 2 AS x2, d * 3 AS y2 FROM p",
    "document_routes": _FR + """, g AS (SELECT doc_id, page, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN reading_order % 5 = 1 THEN 'figure' ELSE 'text' END ELSE kind END AS kind FROM fr),
      a AS (SELECT doc_id, bool_or(kind = 'table') AS has_table, bool_or(kind = 'figure') AS has_figure, bool_or(kind = 'chart') AS has_chart, bool_or(kind = 'form') AS has_form, bool_or(kind = 'text') AS has_text,
        count(DISTINCT page) FILTER (kind = 'table') AS table_pages FROM g GROUP BY doc_id)
      SELECT *, CASE WHEN table_pages > 1 THEN 'table_merging' WHEN has_table THEN 'table_correction' WHEN has_figure OR has_chart THEN 'summaries' WHEN has_form THEN 'forms' ELSE 'output' END AS route FROM a""",
    "documents_in_order": "SELECT place, doc_id, n_chars FROM (VALUES (0, 7), (1, 3), (2, 100000000), (3, 5), (4, 3)) t(place, doc_id) JOIN documents USING (doc_id)",
    "table_neighbours": _FR + """, t AS (SELECT doc_id, page, min(reading_order) AS f, max(reading_order) AS l FROM fr WHERE kind = 'table' GROUP BY doc_id, page)
      SELECT a.doc_id, a.page, a.l AS last, b.page - a.page AS depth, b.f AS next_first FROM t a JOIN t b ON b.doc_id = a.doc_id AND b.page - a.page IN (1, 2) QUALIFY row_number() OVER (PARTITION BY a.doc_id, a.page ORDER BY b.page) = 1""",
}
