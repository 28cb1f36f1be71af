"""Queries over texts that hold JSON and over items of pages, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from finloom.operators import tolerant as T
from finloom.sources import tables as S

#: An object a row, and what is done to it by the remainder of its number.
OBJECT = "'{\"account\": ' || account || ', \"items\": [' || credit || ', ' || debit || '], \"note\": \"' || description || '\"}'"
BROKEN = f"""SELECT row_ord, account, credit, debit, description, CASE row_ord % 8
  WHEN 0 THEN {OBJECT} WHEN 1 THEN 'Here it is: ```json ' || {OBJECT} || ' ``` as asked' WHEN 2 THEN 'So: ' || {OBJECT} || ' and no more'
  WHEN 3 THEN '{{"account": ' || account || ' "items": [' || credit || ', ' || debit || ',], "note": "' || description || '",}}'
  WHEN 4 THEN '{{account: ' || account || ', ''items'': [' || credit || ', ' || debit || '], ''note'': ''' || description || '''}}'
  WHEN 5 THEN '{{"account": ' || account || ', "items": [' || credit || ', ' || debit || '], "note": "' || description
  WHEN 6 THEN '{{"note": "the "' || description || '" row", "account": ' || account || ', "items": [' || credit || ', ' || debit || '}}'
  ELSE 'no object ' || description END AS text FROM ({S.LEDGER_SQL}) z"""


def json_recovered(spark, d):
    """The objects of whole, fenced, wrapped and broken texts."""
    rows = spark.sql(BROKEN.replace("{", "{{").replace("}", "}}").replace("FROM orders", "FROM {t}"), t=S.table(spark, d, "orders"))
    return T.recovered(rows.select("row_ord", "text")).select("row_ord", "json", "how")


#: Lines of documents as items of pages; boxes by the length of the line.
ITEMS = """SELECT page * 1000000 + doc_id AS page, reading_order AS pos, kind AS category, content AS text, {box} AS bbox FROM ({fragments}) f"""
_BOX = "CASE length(content) % 6 WHEN 0 THEN NULL WHEN 1 THEN {a}1, 2, 3{z} WHEN 2 THEN {a}1, 2{z} ELSE {a}length(content), 2, page, reading_order % 4{z} END"


def page_items(spark, d):
    text = ITEMS.format(box=_BOX.format(a="array(", z=")"), fragments=S.FRAGMENTS_SQL["spark"])
    items = spark.sql(text.replace("FROM documents", "FROM {t}"), t=S.table(spark, d, "documents"))
    return T.without_twins(items).select("page", "pos", "category", "text", F.array_join(F.col("bbox").cast("array<string>"), ",").alias("bbox"))


QUERIES = {f.__name__: f for f in (json_recovered, page_items)}
ORACLES = {
    "json_recovered": f"""SELECT row_ord, CASE WHEN row_ord % 8 < 7 THEN '{{"account":' || account || ',"items":[' || credit || ',' || debit || '],"note":"' || CASE WHEN row_ord % 8 = 6 THEN 'the \\"' || description || '\\" row' ELSE description END || '"}}' END AS json,
      list_extract(['plain', 'fence', 'braces', 'scanned', 'scanned', 'scanned', 'scanned', NULL], CAST(row_ord % 8 + 1 AS INT)) AS how FROM ({BROKEN}) b""",
    "page_items": f"""WITH i AS ({ITEMS.format(box=_BOX.format(a='[', z=']'), fragments=S.FRAGMENTS_SQL['duck'])}), s AS (
        SELECT page, pos, category, text, CASE WHEN len(bbox) = 4 THEN bbox END AS bbox FROM i WHERE bbox IS NULL OR len(bbox) IN (3, 4)
      ), m AS (SELECT *, count(*) OVER (PARTITION BY page, category, text) >= 5 AND row_number() OVER (PARTITION BY page, category, text ORDER BY pos) > 1 AND text IS NOT NULL AS a,
        bbox IS NOT NULL AND count(*) OVER (PARTITION BY page, bbox) >= 2 AND row_number() OVER (PARTITION BY page, bbox ORDER BY pos) > 1 AS b FROM s)
      SELECT page, pos, category, text, array_to_string(bbox, ',') AS bbox FROM m WHERE NOT a AND NOT b""",
}
