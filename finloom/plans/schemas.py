"""Queries over schemas in parts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from finloom.operators import schemas as C
from finloom.sources import tables as S

#: Fields of a supplier's schema: groups of lists, and plain names.
FIELDS = """SELECT l_suppkey AS schema, l_orderkey * 10 + l_linenumber AS place, CASE WHEN l_partkey % 5 = 0 THEN 'p' || l_partkey WHEN l_partkey % 5 = 1 THEN 'g' || l_partkey % 7 || '[].f' || l_orderkey
  ELSE 'h' || l_partkey % 11 || '.k' || l_orderkey % 4 || '.v' || l_orderkey END AS path FROM lineitem"""


def _fields(spark, d):
    return spark.sql(FIELDS.replace("FROM lineitem", "FROM {t}"), t=S.table(spark, d, "lineitem"))


def schema_chunks(spark, d):
    return C.chunks(_fields(spark, d), 40)


def schema_results(spark, d):
    """Every part answers with the paths of its properties, and with a note of its own; the parts' answers are put together."""
    fields = _fields(spark, d)
    part = C.chunks(fields, 40).select("schema", "property", "chunk")
    held = fields.withColumn("property", F.regexp_extract("path", r"^[^.\[]+", 0)).join(part, ["schema", "property"])
    paths = held.groupBy("schema", "chunk").agg(F.to_json(F.array_sort(F.collect_set("path"))).alias("value")).select(F.col("schema").alias("record"), F.col("chunk").alias("part"), F.lit("paths").alias("key"), "value")
    notes = paths.select("record", "part", F.lit("note").alias("key"), F.when(F.col("part") % 2 == 0, F.col("part").cast("string")).alias("value"))
    got = C.merged(paths.unionByName(notes))
    whole = F.array_join(F.array_sort(F.from_json("value", "array<string>")), ";")
    return got.select("record", "key", F.when(F.col("key") == "paths", F.sha2(whole, 256)).otherwise(F.col("value")).alias("value"))


QUERIES = {f.__name__: f for f in (schema_chunks, schema_results)}

_CHUNKS = f"""WITH RECURSIVE f AS ({FIELDS}), n AS (SELECT schema, place, string_split(replace(path, '[]', ''), '.') AS w FROM f), e AS (SELECT schema, place, w[1] AS property, unnest([array_to_string(w[1:k], '.') for k in range(1, len(w) + 1)]) AS name FROM n),
  p AS (SELECT schema, property, min(place) AS place, count(DISTINCT name) AS n_fields FROM e GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY schema ORDER BY place, property) AS i FROM p),
  c AS (SELECT schema, property, n_fields, i, 0 AS chunk, n_fields AS used FROM o WHERE i = 1
    UNION ALL SELECT o.schema, o.property, o.n_fields, o.i, CASE WHEN used + o.n_fields > 40 THEN chunk + 1 ELSE chunk END, CASE WHEN used + o.n_fields > 40 THEN o.n_fields ELSE used + o.n_fields END FROM c JOIN o ON o.schema = c.schema AND o.i = c.i + 1)"""
ORACLES = {
    "schema_chunks": _CHUNKS + " SELECT schema, property, n_fields, chunk FROM c",
    "schema_results": _CHUNKS + """ SELECT schema AS record, 'paths' AS key, sha256(string_agg(DISTINCT path, ';' ORDER BY path)) AS value FROM f GROUP BY schema
      UNION ALL SELECT schema, 'note', CASE WHEN max(chunk) = 0 THEN '0' ELSE '[' || string_agg(DISTINCT chunk, ',' ORDER BY chunk) FILTER (chunk % 2 = 0) || ']' END FROM c GROUP BY schema""",
}
