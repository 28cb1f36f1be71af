"""Operator 3: URL filtering by host and path rules, then by link-graph propagation.

Where no rule fits, the verdict comes from the hosts' link graph: trust starts at
hosts of allowed pages and follows links (personalised PageRank); distrust starts
at hosts of blocked pages and follows links backwards.  A host is blocked if more
distrust than trust reaches it through links, and at least ``least`` of the mean
per host.  What a seed has by itself doesn't count: its rules have judged it.
Links without a scheme (``//host/path``) count; relative ones stay on their host.  What
hosts without links onwards hold isn't handed on: their share leaves the walk, for
trust and distrust alike.

Scores live in tables of one row per host in the shared folder; each of the
``rounds`` is one join on host pairs and one sum by host with partial sums first.

Defined cases: null urls and urls without ``://`` have empty host and path, no
rule, and are allowed; null html has no links; repeated pages count each time; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finloom.llm.common import LOWER, UPPER, Staging, ascii_lower, read

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DAMPING, ROUNDS, LEAST = 0.85, 10, 0.01
LINK = r"""(?i)href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(_rest(url), F.lit("")), "^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), "^[^/?#]*([^?#]*)", 1)


def fitted(rules, host: Column, path: Column) -> Column:
    """struct(rule, verdict) of the longest fitting rule, else null."""
    longest = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]))
    fits = lambda h, p: ((host == h) | host.endswith("." + h)) & path.startswith(p)
    said = [(fits(h, p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in longest]
    return reduce(lambda c, x: c.when(*x), said[1:], F.when(*said[0])) if said else F.lit(None).cast("struct<rule:string,verdict:string>")


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and the rule's verdict."""
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return split.withColumn("r", fitted(rules, F.col("host"), F.col("path"))).select(
        "page_id", "host", "path", "r.rule", "r.verdict"
    )


def host_links(pages: DataFrame) -> DataFrame:
    """src, dst, w: links between different hosts, counted."""
    links = pages.select(
        host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("to")
    ).select("src", host_of(F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), "to")).otherwise(F.col("to"))).alias("dst"))
    return links.where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("w"))


def blocked_hosts(pages: DataFrame, rules=RULES, damping=DAMPING, rounds=ROUNDS, least=LEAST) -> DataFrame | None:
    """Hosts that link propagation blocks; None if no page links to another host."""
    tables = Staging(pages.sparkSession, "links")
    links = tables.put(host_links(pages), "pairs")
    if links.isEmpty():
        tables.drop(links)
        return None
    out = links.groupBy("src").agg(F.sum("w").alias("total"))
    into = links.groupBy("dst").agg(F.sum("w").alias("total"))
    forward = links.join(out, "src").select(F.col("src").alias("host"), F.col("dst").alias("to"), (F.col("w") / F.col("total")).alias("t"), F.lit(0.0).alias("b"))
    back = links.join(into, "dst").select(F.col("dst").alias("host"), F.col("src").alias("to"), F.lit(0.0).alias("t"), (F.col("w") / F.col("total")).alias("b"))
    steps = tables.put(forward.unionByName(back), "steps")
    nodes = steps.select("host").distinct()
    seeded = ruled(pages, rules).where("verdict IS NOT NULL").groupBy("host").agg(
        F.count_if(F.col("verdict") == "allow").alias("t"), F.count_if(F.col("verdict") == "block").alias("b")
    )
    inside = tables.put(nodes.join(seeded, "host", "left").na.fill(0, ["t", "b"]), "inside")
    sums = inside.agg(F.sum("t").alias("st"), F.sum("b").alias("sb"), F.count("*").alias("n")).first()
    part = lambda c, total: (F.col(c) / F.lit(float(total or 1))).alias(c)
    seeds = tables.put(inside.select("host", part("t", sums.st), part("b", sums.sb)), "seeds")
    state, reached = seeds, None
    for _ in range(rounds):
        sent = steps.join(state.select("host", F.col("t").alias("st"), F.col("b").alias("sb")), "host").select(
            F.col("to").alias("host"), (damping * F.col("st") * F.col("t")).alias("t"), (damping * F.col("sb") * F.col("b")).alias("b")
        )
        tables.drop(reached)
        reached = tables.put(sent.groupBy("host").agg(F.sum("t").alias("t"), F.sum("b").alias("b")), "reached")
        own = seeds.select("host", ((1 - damping) * F.col("t")).alias("t"), ((1 - damping) * F.col("b")).alias("b"))
        before, state = state, tables.put(
            reached.unionByName(own).groupBy("host").agg(F.sum("t").alias("t"), F.sum("b").alias("b")), "state"
        )
        if before is not seeds:
            tables.drop(before)
    tables.drop(links, steps, inside, seeds, state)
    return reached.where((F.col("b") > F.col("t")) & (F.col("b") * float(sums.n) >= least)).select("host")


def judge(pages: DataFrame, rules=RULES, **how) -> DataFrame:
    """page_id, host, path, rule, verdict: one row per page."""
    pages = pages.select("page_id", "url", "html")
    out = ruled(pages, rules)
    bad = blocked_hosts(pages, rules, **how)
    if bad is None:
        return out.withColumn("verdict", F.coalesce("verdict", F.lit("allow")))
    out = out.join(bad.withColumn("bad", F.lit("block")), "host", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", "bad", F.lit("allow")).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"))


def _host_sql(url: str) -> str:
    return f"translate(regexp_extract(CASE WHEN strpos({url}, '://') > 0 THEN substr({url}, strpos({url}, '://') + 3) ELSE '' END, '^[^/?#]*'), '{UPPER}', '{LOWER}')"


def _rules_sql() -> tuple[str, str]:
    longest = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]))
    when = [(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN ", v, h + p) for v, h, p in longest]
    return tuple("CASE " + " ".join(f"{c}'{x[i]}'" for c, *x in when) + " END" for i in (1, 0))


ORACLE = f"""
WITH RECURSIVE p AS (
  SELECT page_id, html, {_host_sql("url")} AS host,
         regexp_extract(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END, '^[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), r AS (
  SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, html, {_rules_sql()[0]} AS rule, {_rules_sql()[1]} AS said FROM p
), l AS (
  SELECT src, {_host_sql("link")} AS dst
  FROM (SELECT src, CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END AS link FROM (
    SELECT host AS src, unnest(regexp_extract_all(html, '(?i)href\\s*=\\s*["'']?((?:[a-z][a-z0-9+.-]*:)?//[^"''\\s>]+)', 1)) AS link FROM r))
), e AS (
  SELECT src, dst, count(*) AS w FROM l WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL
), s AS (
  SELECT src AS host, dst AS hop, w / sum(w) OVER (PARTITION BY src) AS t, 0::DOUBLE AS b FROM e
  UNION ALL SELECT dst, src, 0::DOUBLE, w / sum(w) OVER (PARTITION BY dst) FROM e
), n AS (
  SELECT h.host, coalesce(count(*) FILTER (said = 'allow'), 0) AS t, coalesce(count(*) FILTER (said = 'block'), 0) AS b
  FROM (SELECT DISTINCT host FROM s) h LEFT JOIN r USING (host) GROUP BY h.host
), seed AS (
  SELECT host, t / greatest(sum(t) OVER (), 1) AS t, b / greatest(sum(b) OVER (), 1) AS b, count(*) OVER () AS hosts FROM n
), walk AS (
  SELECT 0 AS k, host, t::DOUBLE AS t, b::DOUBLE AS b FROM seed
  UNION ALL
  SELECT k, host, sum(t), sum(b) FROM (
    SELECT w.k + 1 AS k, x.host, x.t * w.t AS t, x.b * w.b AS b
    FROM walk w JOIN (
      SELECT host AS f, hop AS host, {DAMPING} * t AS t, {DAMPING} * b AS b FROM s
    ) x ON x.f = w.host WHERE w.k < {ROUNDS}
    UNION ALL
    SELECT z.k + 1, seed.host, (1 - {DAMPING}) * seed.t, (1 - {DAMPING}) * seed.b
    FROM seed, (SELECT DISTINCT k FROM walk WHERE k < {ROUNDS}) z
  ) GROUP BY k, host
), bad AS (
  SELECT host FROM walk JOIN seed USING (host)
  WHERE k = {ROUNDS} AND walk.b - (1 - {DAMPING}) * seed.b > walk.t - (1 - {DAMPING}) * seed.t
    AND (walk.b - (1 - {DAMPING}) * seed.b) * hosts >= {LEAST}
)
SELECT page_id, r.host, path, rule, coalesce(said, CASE WHEN bad.host IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM r LEFT JOIN bad USING (host)
"""
