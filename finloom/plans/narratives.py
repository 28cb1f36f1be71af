"""Queries over words of narratives and garbled texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from finloom.functions import mojibake as M
from finloom.functions import tokens as T
from finloom.sources import tables as S

#: Narratives with blocks that come again, purposes in front, and references.
TEXTS = f"""SELECT row_ord, CASE row_ord % 8 WHEN 0 THEN description || ' ' || description || ' ' || counterparty WHEN 1 THEN 'JAN AND FEB 2026 ' || counterparty
  WHEN 2 THEN 'PV' || account || ' ' || description || ' PV' || account || ' ' || counterparty WHEN 3 THEN 'A/' || row_ord || ' & ' || counterparty || ' QTR4 ' || row_ord || '00000'
  WHEN 4 THEN '' WHEN 5 THEN counterparty || ' 123/' || account || ' ' || month WHEN 6 THEN '() FEE (MAR) ' || counterparty || ' & ' || bank ELSE counterparty || ' ' || bank || ' ' || counterparty || ' ' || row_ord END AS text FROM ({S.LEDGER_SQL}) z"""


def narrative_tokens(spark, d):
    rows = spark.sql(TEXTS.replace("FROM orders", "FROM {t}"), t=S.table(spark, d, "orders")).withColumn("w", T.words(F.col("text")))
    joined = lambda c: F.array_join(c, " ")
    return rows.select(
        "row_ord", T.repeated_block_end(F.col("w")).cast("long").alias("block_end"), joined(T.without_repeated_prefix(F.col("w"))).alias("unrepeated"),
        joined(T.without_purpose_prefix(F.col("w"))).alias("unpurposed"), joined(T.without_stop_tokens(F.col("w"))).alias("unstopped"), T.tail_of_letters(F.col("w")).alias("tail"),
        T.has_real_word(F.col("text")).alias("real"), T.name_at_end(F.col("text")).alias("name"), T.without_trailing_references(F.col("text")).alias("unreferenced"),
    )


#: What is written into every text before it is garbled; none of it is plain ASCII.
SAMPLES = ("naïve café", "→ “quoted” – €5", "漢字", "Ελληνικά", "😀", "Müller & Söhne", "½ °C", "Ångström", "don’t", "Жук")
WRITTEN = f"SELECT doc_id, {S._case('doc_id', [s for s in SAMPLES])} || ' ' || text || ' ' || {S._case('(doc_id + 3)', [s for s in SAMPLES])} AS text FROM documents WHERE text IS NOT NULL"


def mojibake_repair(spark, d):
    """Whole texts, read in a wrong charset none to three times by their number, and read again."""
    rows = spark.sql(WRITTEN.replace("FROM documents", "FROM {t}"), t=S.table(spark, d, "documents"))
    wrong = lambda c: F.translate(F.decode(F.encode(c, "UTF-8"), "ISO-8859-1"), M.BYTES, M.SHOWN)
    garbled = F.col("text")
    for n in (1, 2, 3):
        garbled = F.when(F.col("doc_id") % 4 >= n, wrong(garbled)).otherwise(garbled)
    return rows.select("doc_id", F.sha2(M.repaired(garbled), 256).alias("sha256"))


QUERIES = {f.__name__: f for f in (narrative_tokens, mojibake_repair)}

_W = "string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')"
_LIST = ", ".join(f"'{p}'" for p in T.PURPOSES)
_BARE = "trim({}, '().,')"
_SLICE = "array_to_string(list_slice(w, {}, {}), ' ')"
ORACLES = {
    "narrative_tokens": f"""WITH t AS (SELECT row_ord, text, CASE WHEN trim(text) = '' THEN []::VARCHAR[] ELSE {_W} END AS w FROM ({TEXTS}) z),
      p AS (SELECT row_ord, w, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM t),
      c AS (SELECT row_ord, i, {_BARE.format('x')} AS b, x, upper({_BARE.format('x')}) IN ({_LIST}) OR (regexp_full_match({_BARE.format('x')}, '[A-Z0-9/.-]+') AND regexp_matches({_BARE.format('x')}, '[0-9]')) AS purpose, upper({_BARE.format('x')}) IN ('AND', '&') AS link FROM p),
      f AS (SELECT row_ord, min(i) FILTER (NOT purpose AND NOT link AND b <> '') AS name, min(i) FILTER (link) AS l, min(i) FILTER (purpose) AS pu,
        max(i) FILTER (NOT regexp_matches(x, '{T.STOP_TOKEN}')) AS st, max(i) FILTER (NOT regexp_full_match(trim(x, '().,&'), '\\p{{L}}{{2,}}') AND x NOT IN ({", ".join(f"'{b}'" for b in T.BRIDGES)})) AS ta,
        max(i) FILTER (NOT (x = '_' OR regexp_full_match(x, '[0-9,.]+') OR (length(x) = 1 AND NOT regexp_matches(x, '\\p{{L}}')))) AS ke FROM c GROUP BY row_ord),
      nm AS (SELECT c.row_ord, max(i) AS at_ FROM c JOIN f USING (row_ord) WHERE i <= ke AND NOT ((regexp_matches(x, '\\p{{L}}') AND NOT regexp_matches(x, '[0-9]')) OR x = '&') GROUP BY ALL),
      k AS (SELECT unnest(range(1, 9)) AS k), e AS (SELECT row_ord, len(w) AS n, w, k FROM t, k WHERE len(w) >= 2 * k),
      pr AS (SELECT row_ord, max(k) AS k FROM e WHERE list_slice(w, 1, k) = list_slice(w, k + 1, 2 * k) GROUP BY ALL),
      bl AS (SELECT row_ord, k, b + k AS e FROM (SELECT *, unnest(range(a + k, n - k + 1)) AS b FROM (SELECT *, unnest(range(0, n - 2 * k + 1)) AS a FROM e WHERE k <= 6 AND n >= 4) q) r WHERE list_slice(w, a + 1, a + k) = list_slice(w, b + 1, b + k) AND (k > 1 OR length(w[a + 1]) > 1)),
      be AS (SELECT row_ord, max(e ORDER BY e) AS e FROM bl WHERE (row_ord, k) IN (SELECT (row_ord, max(k)) FROM bl GROUP BY row_ord) GROUP BY row_ord)
      SELECT t.row_ord, CAST(coalesce(be.e, 0) AS BIGINT) AS block_end, {_SLICE.format('coalesce(2 * pr.k, 0) + 1', 'len(w)')} AS unrepeated,
        {_SLICE.format('least(coalesce(name, len(w) + 1), CASE WHEN l < coalesce(pu, len(w) + 1) THEN l ELSE len(w) + 1 END)', 'len(w)')} AS unpurposed, {_SLICE.format('1', 'coalesce(st, 0)')} AS unstopped,
        CASE WHEN len(w) - coalesce(ta, 0) >= 2 THEN {_SLICE.format('coalesce(ta, 0) + 1', 'len(w)')} ELSE '' END AS tail,
        len(list_filter(regexp_extract_all(text, '[A-Z]+'), lambda x: length(x) >= 3 AND replace(x, 'X', '') <> '')) > 0 AS real,
        rtrim({_SLICE.format('coalesce(at_, 0) + 1', 'coalesce(ke, 0)')}, '.,;:&') AS name, trim(regexp_replace(text, '\\s+[0-9/]{{3,}}.*$', '')) AS unreferenced
      FROM t LEFT JOIN f USING (row_ord) LEFT JOIN nm USING (row_ord) LEFT JOIN pr USING (row_ord) LEFT JOIN be USING (row_ord)""",
    "mojibake_repair": f"SELECT doc_id, sha256(text) AS sha256 FROM ({WRITTEN}) w",
}
