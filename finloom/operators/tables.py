"""HTML and markdown tables: rows, cells, shapes, merging; boxes of layouts.

A table is one string.  Cells are read by pattern; column spans widen a row, row spans
aren't followed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finloom.functions.binding import bound

ROW, CELL = r"(?is)<tr[^>]*>.*?</tr>", r"(?is)<t[dh][^>]*>.*?</t[dh]>"
SAMPLE, MISMATCH = 5, 0.3


def rows_of(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(ROW), 0)


def sliced(html: Column, start: int, count: int | None = None) -> Column:
    """The table with rows from ``start`` on (from the end if negative), ``count`` of them; a text without rows stays as it is."""
    rows = rows_of(html)
    at = F.greatest(F.size(rows) + start, F.lit(0)) if start < 0 else F.lit(start)
    part = F.slice(rows, at + 1, F.lit(count) if count is not None else F.greatest(F.size(rows), F.lit(1)))
    head = F.coalesce(F.nullif(F.regexp_extract(html, r"(?i)(<table[^>]*>)", 1), F.lit("")), F.lit("<table>"))
    return F.when(F.size(rows) == 0, html).when(F.size(part) == 0, F.concat(head, F.lit("</table>"))).otherwise(F.concat(head, F.lit("\n"), F.array_join(part, "\n"), F.lit("\n</table>")))


def without_first(html: Column, n: int) -> Column:
    """The text without its first n rows; what stands between rows stays."""
    rows, between = rows_of(html), F.split(html, ROW, -1)
    kept = F.transform(rows, lambda r, i: F.when(i < n, F.lit("")).otherwise(r))
    return F.array_join(F.zip_with(between, kept, lambda b, r: F.concat(b, F.coalesce(r, F.lit("")))), "")


def merged(base: Column, following: Column, skip: int = 0) -> Column:
    """The base table with the rows of the next one, less its first ``skip``."""
    rows = F.slice(rows_of(following), skip + 1, F.greatest(F.size(rows_of(following)), F.lit(1)))
    return F.when(F.size(rows) == 0, base).otherwise(F.regexp_replace(base, r"(?is)\s*</table>\s*$", F.concat(F.lit("\n"), F.regexp_replace(F.array_join(rows, "\n"), r"([\\$])", r"\\$1"), F.lit("\n</table>"))))


def cell_type(text: Column) -> Column:
    """empty, number or text, by the text without signs of money, percent and thousands."""
    bare = F.regexp_replace(F.regexp_replace(text, r"[$,%\s]", ""), r"^\((.*)\)$", "$1")
    return F.when(F.trim(text) == "", "empty").when(F.rlike(bare, F.lit(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")), "number").otherwise("text")


def _cells(rows: Column) -> Column:
    span = lambda c: F.greatest(F.coalesce(F.nullif(F.regexp_extract(c, r"""(?i)colspan\s*=\s*["']?(\d+)""", 1), F.lit("")).cast("int"), F.lit(1)), F.lit(1))
    text = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"(?is)^<t[dh][^>]*>|</t[dh]>$", ""), r"<[^>]+>", ""))
    return F.transform(rows, lambda r: F.flatten(F.transform(F.regexp_extract_all(r, F.lit(CELL), 0), lambda c: F.array_repeat(text(c), span(c)))))


def grid(html: Column) -> Column:
    """array<array<string>>: the texts of all cells, one of a span repeated in every column that it covers."""
    return _cells(rows_of(html))


def _typed(rows: Column) -> Column:
    """The type of every column over the rows: text if any cell is, else number if any is, else empty."""

    def said(kinds: Column) -> Column:
        column = lambda i: F.transform(kinds, lambda k: F.get(k, i))
        one = lambda i: bound(column(i), lambda c: F.when(F.array_contains(c, "text"), "text").when(F.array_contains(c, "number"), "number").otherwise("empty"))
        width = F.coalesce(F.array_max(F.transform(kinds, lambda k: F.size(k))), F.lit(0))
        return F.when(width > 0, F.transform(F.sequence(F.lit(0), width - 1), one)).otherwise(F.array().cast("array<string>"))

    return bound(F.transform(rows, lambda r: F.transform(r, lambda c: cell_type(c))), said)


def _part(cells: Column, rows: int, from_start: bool) -> Column:
    return F.slice(cells, 1, rows) if from_start else F.slice(cells, F.greatest(F.size(cells) - rows, F.lit(0)) + 1, rows)


def column_types(html: Column, rows: int, from_start: bool = True) -> Column:
    return bound(grid(html), lambda cells: _typed(_part(cells, rows, from_start)))


def _alike(a: Column, b: Column) -> Column:
    """Whether two lists of column types are as long, with at most MISMATCH of other types, or one is empty."""
    both = F.zip_with(a, b, lambda x, y: F.struct(((x != "empty") & (y != "empty")).alias("met"), (x != y).alias("differs")))
    alike = bound(F.filter(both, lambda p: p["met"]), lambda met: F.size(F.filter(met, lambda p: p["differs"])) <= F.size(met) * MISMATCH)
    return (F.size(a) == 0) | (F.size(b) == 0) | ((F.size(a) == F.size(b)) & alike)


def aligned(upper: Column, lower: Column) -> Column:
    """Whether the last rows of one table and the first of the next have alike columns: as many, and at most MISMATCH of other types."""
    return bound(F.struct(column_types(upper, SAMPLE, False).alias("a"), column_types(lower, SAMPLE).alias("b")), lambda t: _alike(t["a"], t["b"]))


def _shape(html: Column) -> Column:
    """struct(n, headed, head, first, last): rows, the texts of a first row with head cells, and the column types of the first and last rows below it."""

    def below(t: Column) -> Column:
        body = F.when(t["headed"], F.slice(t["cells"], 2, F.greatest(F.size(t["cells"]), F.lit(1)))).otherwise(t["cells"])
        types = lambda from_start: bound(body, lambda c: _typed(_part(c, SAMPLE, from_start)))
        head = F.when(t["headed"], F.array_join(F.get(t["cells"], 0), "\n"))
        return F.struct(F.size(t["cells"]).alias("n"), t["headed"].alias("headed"), head.alias("head"), types(True).alias("first"), types(False).alias("last"))

    headed = lambda rows: F.coalesce(F.rlike(F.get(rows, 0), F.lit("(?i)<th[ >]")), F.lit(False))
    return bound(F.coalesce(rows_of(html), F.array().cast("array<string>")), lambda rows: bound(F.struct(headed(rows).alias("headed"), _cells(rows).alias("cells")), below))


def chained(tables: DataFrame) -> DataFrame:
    """doc_id, page, reading_order, last_page, n_tables, html: tables that go on over pages, as one.

    ``tables`` are (doc_id, page, reading_order, html).  The first table of a page goes on
    with the last one of the page before it if both have alike columns below their heads (a
    first row with head cells), and if its head, where it has one, is the last that the
    document showed; such a head is dropped.  Runs of tables that go on become one, whose rows
    follow in order.  A null or rowless table stands alone.  Tables that come parted by doc_id
    aren't shuffled; a task sorts those of its part.
    """
    x = tables.select("doc_id", "page", "reading_order", "html", _shape(F.col("html")).alias("_s"))
    order = Window.partitionBy("doc_id").orderBy("page", "reading_order")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    same_head = F.col("_s.head").isNull() | (F.col("_s.head") == F.last("_s.head", ignorenulls=True).over(before))
    near = F.lag("page").over(order) == F.col("page") - 1
    # windows see shapes; the text of a table goes by once
    x = x.withColumn("_near", near & same_head & (F.col("_s.n") > 0) & (F.lag("_s.n").over(order) > 0)).withColumn("_above", F.lag("_s.last").over(order))
    x = x.withColumn("_on", F.coalesce(F.when(F.col("_near"), _alike(F.col("_above"), F.col("_s.first"))), F.lit(False)))
    x = x.withColumn("_chain", F.sum(F.when(F.col("_on"), 0).otherwise(1)).over(order))
    by = x.groupBy("doc_id", "_chain").agg(
        F.min("page").alias("page"), F.min_by("reading_order", "page").alias("reading_order"), F.max("page").alias("last_page"), F.count("*").alias("n_tables"),
        F.sort_array(F.collect_list(F.struct("page", "reading_order", "html", (F.col("_on") & F.col("_s.headed")).alias("headless")))).alias("_all"),
    )
    first = F.get("_all", 0)["html"]
    tag = F.coalesce(F.nullif(F.regexp_extract(first, r"(?i)(<table[^>]*>)", 1), F.lit("")), F.lit("<table>"))
    rows = F.flatten(F.transform("_all", lambda t: F.slice(rows_of(t["html"]), F.when(t["headless"], 2).otherwise(1), F.length(t["html"]))))
    html = F.when(F.col("n_tables") == 1, first).otherwise(F.concat(tag, F.lit("\n"), F.array_join(rows, "\n"), F.lit("\n</table>")))
    return by.select("doc_id", "page", "reading_order", "last_page", "n_tables", html.alias("html"))


def odd_rows(tables: DataFrame) -> DataFrame:
    """table, row, width, usual: rows whose width isn't the most frequent one of their table, the earlier of equally frequent ones."""
    rows = tables.select("table", F.posexplode(grid(F.col("html"))).alias("row", "cells")).select("table", (F.col("row") + 1).alias("row"), F.size("cells").alias("width"))
    counts = rows.groupBy("table", "width").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    usual = counts.groupBy("table").agg(F.max_by("width", F.struct("n", -F.col("first"))).alias("usual"))
    return rows.join(usual, "table").where("width <> usual")


def escaped_markdown(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\`*_{}\[\]()#+!|>~$-])", r"\\$1")


def markdown_to_html(markdown: Column) -> Column:
    """Rows of bars as an HTML table: the first as heads where a rule of dashes follows it; null without a row."""
    lines = F.filter(F.transform(F.split(markdown, "\n"), lambda x: F.trim(x)), lambda x: F.rlike(x, F.lit(r"^\|.*\|$")))
    ruled = F.rlike(F.coalesce(F.get(lines, 1), F.lit("")), F.lit(r"^\|[\s:|-]+\|$"))
    body = F.filter(lines, lambda x, i: ~(ruled & (i == 1)))
    cells = lambda x: F.transform(F.split(F.regexp_replace(x, r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    tag = lambda i, c: F.when(ruled & (i == 0), F.concat(F.lit("<th>"), c, F.lit("</th>"))).otherwise(F.concat(F.lit("<td>"), c, F.lit("</td>")))
    row = lambda x, i: F.concat(F.lit("<tr>"), F.array_join(F.transform(cells(x), lambda c: tag(i, c)), ""), F.lit("</tr>"))
    return F.when(F.size(body) > 0, F.concat(F.lit("<table>"), F.array_join(F.transform(body, row), ""), F.lit("</table>")))


def bounding_box(points: Column, scale_x: Column, scale_y: Column) -> Column:
    """struct(x1, y1, x2, y2) around a polygon given as array of x, y, x, y, ..., scaled."""
    xs, ys = (F.filter(points, lambda _, i: i % 2 == k) for k in (0, 1))
    return F.struct((F.array_min(xs) * scale_x).alias("x1"), (F.array_min(ys) * scale_y).alias("y1"), (F.array_max(xs) * scale_x).alias("x2"), (F.array_max(ys) * scale_y).alias("y2"))


def routes(fragments: DataFrame) -> DataFrame:
    """Per document: what kinds of fragments it has, and where it goes next."""
    has = {k: F.bool_or(F.col("kind") == k) for k in ("table", "figure", "chart", "form", "text")}
    by = fragments.groupBy("doc_id").agg(*[v.alias(f"has_{k}") for k, v in has.items()], F.count_distinct(F.when(F.col("kind") == "table", F.col("page"))).alias("table_pages"))
    way = F.when(F.col("table_pages") > 1, "table_merging").when(F.col("has_table"), "table_correction").when(F.col("has_figure") | F.col("has_chart"), "summaries").when(F.col("has_form"), "forms").otherwise("output")
    return by.withColumn("route", way)
