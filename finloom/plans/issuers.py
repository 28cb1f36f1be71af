"""Queries over banks of files and their profiles, with their SQL."""

from __future__ import annotations

from finloom.operators import issuers as I
from finloom.sources import tables as S

CREATORS = ("Maybank2u.com", "omsgen", "", "JasperReports 5", "Streamline Pdfgen", "", "Quadient", "Word", "", "5.7.0", "Canva")
PRODUCERS = ("iText 2.1.3", "omsgen", "PDFium", "iText 2.1", "compugr", "", "Quadient", "", "PlanetPress", "iText 1.4", "", "CamScanner", "PoDoFo")
FONTS = ("Helvetica", "BCDEEE+Arial", "BCDFEE+Tahoma", "Calibri", "BCDGEE+ArialMT-Bold", "NSimSun", "Dax-Bold", "OpenSans-Regular", "MicrosoftSansSerif")
WORDS = ("CIMB CHQ DEP", "JOMPAY NON RHB", "Maybank Islamic Berhad", "Branch: UOBM Kepong", "OCBC Al-Amin", "Bank Islam", "GIRO", "cheque", "paid", "fee")
META = f"""SELECT c_custkey AS file, {S._case("c_custkey", CREATORS)} AS creator, {S._case("c_custkey", PRODUCERS)} AS producer,
  CASE c_custkey % 3 WHEN 0 THEN '1.7' ELSE '1.4' END AS version, CAST(c_custkey % 6 + 1 AS INT) AS pages, c_custkey * 7919 % 400000 + 1000 AS file_size FROM customer"""
LINES = f"""SELECT o_custkey AS file, o_orderkey AS n, CAST(o_orderkey % 3 + 1 AS INT) AS page, {S._case("CAST(floor(o_totalprice) AS BIGINT)", WORDS)} || ' ' || o_orderpriority AS line,
  {S._case("o_orderkey", FONTS)} AS font FROM orders"""
PAGES = "SELECT file, page, {} AS text FROM ({}) l GROUP BY file, page"


def _frames(spark, d):
    meta = spark.sql(META.replace("FROM customer", "FROM {t}"), t=S.table(spark, d, "customer"))
    lines = LINES.replace("FROM orders", "FROM {t}")
    texts = spark.sql(PAGES.format("array_join(transform(sort_array(collect_list(struct(n, line))), x -> x.line), '\\n')", lines), t=S.table(spark, d, "orders"))
    return meta, texts, spark.sql(f"SELECT file, page, font FROM ({lines}) l", t=S.table(spark, d, "orders"))


def file_issuers(spark, d):
    meta, texts, _ = _frames(spark, d)
    return I.issuers(meta, texts)


def profile_findings(spark, d):
    return I.profile_findings(*_frames(spark, d))


QUERIES = {f.__name__: f for f in (file_issuers, profile_findings)}

_DOUBLE = "regexp_replace({}, '([^a-z0-9])', '\\1\\1', 'g')"
_KEYS = ", ".join(f"({i}, '{b}', '{k}')" for i, (b, ks) in enumerate(I.KEYWORDS) for k in ks)
_TRIES = ", ".join(f"({i}, '{b}', {I.BANKS.index(b)}, '{c}', '{p}', [{', '.join(repr(f) for f in fs)}]::VARCHAR[])" for i, (b, c, p, fs) in enumerate(I.PROFILES))
_COUNT = "len(regexp_extract_all({}, '(?:^|[^a-z0-9])' || {} || '(?:$|[^a-z0-9])'))"
_MET = "CASE WHEN {0} <> '.*' AND m.{1} <> '' AND regexp_matches(m.{1}, '(?i)' || {0}) THEN 1 ELSE 0 END"
_ISSUERS = f"""WITH m AS ({META}), l AS ({LINES}), pg AS ({PAGES.format("string_agg(line, chr(10) ORDER BY n)", "SELECT * FROM l WHERE page <= 2")}),
  tx AS (SELECT file, lower(string_agg(text, chr(10) ORDER BY page)) AS t FROM pg GROUP BY file), kw(ko, kb, k) AS (VALUES {_KEYS}),
  kc AS (SELECT file, kb, ko, k, {_COUNT.format(_DOUBLE.format("t"), _DOUBLE.format("k"))} AS n, {_COUNT.format(_DOUBLE.format("left(t, 600)"), _DOUBLE.format("k"))} AS h FROM tx, kw),
  sc AS (SELECT file, kb, ko, max(n * (10 + length(k)) + CASE WHEN h > 0 THEN 250 ELSE 0 END) AS s, sum(n) AS hits FROM kc WHERE n > 0 GROUP BY ALL),
  rk AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY s DESC, ko) AS r FROM sc), pr(i, b, bo, c, p, fs) AS (VALUES {_TRIES}),
  cd AS (SELECT m.file, b, bo, max({_MET.format('pr.c', 'creator')} + {_MET.format('pr.p', 'producer')}) AS score FROM m, pr GROUP BY ALL HAVING score > 0),
  tp AS (SELECT file, count(*) AS nc, min(b) AS one, max(score) AS best FROM cd GROUP BY file),
  mo AS (SELECT cd.file, count(*) AS nt, min(b) AS top FROM cd JOIN tp ON cd.file = tp.file AND score = best GROUP BY ALL),
  wi AS (SELECT cd.file, first(b ORDER BY hits DESC, bo) AS wb FROM cd JOIN sc ON cd.file = sc.file AND b = kb GROUP BY ALL),
  jn AS (SELECT m.file, nc, one, nt, top, wb, a.kb AS tb, a.s, z.s AS s2, EXISTS (SELECT 1 FROM cd WHERE cd.file = m.file AND cd.b = a.kb) AS inside
    FROM m LEFT JOIN tp ON tp.file = m.file LEFT JOIN mo ON mo.file = m.file LEFT JOIN wi ON wi.file = m.file LEFT JOIN rk a ON a.file = m.file AND a.r = 1 LEFT JOIN rk z ON z.file = m.file AND z.r = 2),
  hw AS (SELECT *, CASE WHEN nc = 1 THEN 'metadata' WHEN tb IS NOT NULL AND (nc IS NULL OR inside) THEN 'text' WHEN nc IS NULL THEN NULL WHEN wb IS NOT NULL THEN 'text within metadata'
    WHEN nt = 1 THEN 'closest metadata' WHEN tb IS NOT NULL THEN 'text' END AS how FROM jn),
  iss AS (SELECT file, CASE how WHEN 'metadata' THEN one WHEN 'text' THEN tb WHEN 'text within metadata' THEN wb WHEN 'closest metadata' THEN top END AS bank, how,
    CAST(coalesce(s, 0) AS BIGINT) AS score, CAST(coalesce(s, 0) - coalesce(s2, 0) AS BIGINT) AS margin FROM hw)"""
_FINDINGS = f""", f AS (SELECT file, page, regexp_replace(font, '^[^+]*\\+', '') AS name, CASE WHEN regexp_matches(font, '^[A-Za-z]{{6}}\\+') THEN left(font, 6) END AS prefix FROM l),
  uf AS (SELECT file, list_sort(list(DISTINCT name)) AS fonts, list_sort(list(DISTINCT prefix) FILTER (prefix IS NOT NULL)) AS prefixes, count(prefix) AS np FROM f GROUP BY file),
  pf AS (SELECT file, max(n) AS page_fonts FROM (SELECT file, page, count(*) AS n FROM f WHERE page <= 2 GROUP BY ALL) x GROUP BY file),
  mp AS (SELECT m.*, iss.bank, uf.* EXCLUDE (file), page_fonts, coalesce((SELECT min(i) FROM pr WHERE b = bank AND creator <> '' AND regexp_matches(creator, '(?i)' || pr.c)),
    (SELECT min(i) FROM pr WHERE b = bank AND producer <> '' AND regexp_matches(producer, '(?i)' || pr.p))) AS px,
    (SELECT count(*) FROM pr WHERE b = bank AND regexp_matches(creator, '(?i)' || pr.c)) AS cm FROM m JOIN iss ON iss.file = m.file LEFT JOIN uf ON uf.file = m.file LEFT JOIN pf ON pf.file = m.file),
  q AS (SELECT mp.*, pr.fs, list_sort(list_filter(pr.fs, lambda x: NOT list_contains(list_transform(fonts, lambda y: regexp_replace(y, '(?i){I.WEIGHTS}', '')), x))) AS missing FROM mp LEFT JOIN pr ON pr.i = px),
  co(pat) AS (VALUES {", ".join(f"('{p}')" for p in I.CONSUMER)})
  SELECT file, 'LOW' AS severity, 'no bank found' AS message FROM q WHERE bank IS NULL
  UNION ALL SELECT file, 'HIGH', 'creator is a scanning or consumer program: ' || creator FROM q JOIN co ON regexp_matches(creator, '(?i)' || pat) WHERE bank IS NOT NULL
  UNION ALL SELECT file, 'HIGH', 'producer is a scanning or consumer program: ' || producer FROM q JOIN co ON regexp_matches(producer, '(?i)' || pat) WHERE bank IS NOT NULL
  UNION ALL SELECT file, CASE WHEN len(missing) > 0 THEN 'MEDIUM' ELSE 'LOW' END, CASE WHEN len(missing) > 0 THEN 'usual fonts are missing: ' || array_to_string(missing, ', ') ELSE 'made as usual' END FROM q WHERE len(fs) > 0 AND len(fonts) > 0
  UNION ALL SELECT file, 'HIGH', 'version ' || version FROM q WHERE px = 0 AND version <> '1.4'
  UNION ALL SELECT file, 'HIGH', 'too many fonts on a page' FROM q WHERE px = 0 AND page_fonts > 4
  UNION ALL SELECT file, 'HIGH', 'foreign fonts: ' || CASE WHEN list_contains(fonts, 'Calibri') AND list_contains(fonts, 'TimesNewRomanPSMT') THEN 'Calibri, TimesNewRomanPSMT' WHEN list_contains(fonts, 'Calibri') THEN 'Calibri' ELSE 'TimesNewRomanPSMT' END
    FROM q WHERE px = 0 AND list_has_any(fonts, ['Calibri', 'TimesNewRomanPSMT'])
  UNION ALL SELECT file, 'MEDIUM', 'prefixes of fonts in series: ' || left(prefixes[1], 3) FROM q WHERE px IS NOT NULL AND np >= 4 AND len(prefixes) >= 3 AND len(list_distinct(list_transform(prefixes, lambda x: left(x, 3)))) = 1
  UNION ALL SELECT file, 'MEDIUM', 'large for its pages' FROM q WHERE px = 0 AND file_size / pages / 1024 > 45
  UNION ALL SELECT file, CASE WHEN creator <> '' AND cm = 0 THEN 'HIGH' ELSE 'MEDIUM' END, 'made by no usual program' FROM q WHERE bank IS NOT NULL AND px IS NULL AND creator || producer <> ''
  UNION ALL SELECT file, 'MEDIUM', 'no metadata' FROM q WHERE bank IS NOT NULL AND px IS NULL AND creator || producer = ''"""
ORACLES = {"file_issuers": _ISSUERS + " SELECT * FROM iss", "profile_findings": _ISSUERS + _FINDINGS}
