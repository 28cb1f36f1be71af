"""Document operators: chunking, tables, spatial joins, markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reading():
    return Window.partitionBy("doc_id").orderBy("reading_order")


def page_chunks(fragments: DataFrame) -> DataFrame:
    """One chunk per page, fragments in reading order."""
    parts = F.sort_array(F.collect_list(F.struct("reading_order", "content")))
    return fragments.groupBy("doc_id", "page").agg(F.array_join(F.transform(parts, lambda p: p["content"]), "\n").alias("content"))


def section_chunks(fragments: DataFrame) -> DataFrame:
    """A chunk starts at a header that follows no header; consecutive headers stay together."""
    header = F.col("kind") == "section_header"
    starts = header & ~F.coalesce(F.lag(F.col("kind")).over(reading()) == "section_header", F.lit(False))
    numbered = fragments.withColumn("start", starts.cast("int")).withColumn("section", F.sum("start").over(reading()))
    parts = F.sort_array(F.collect_list(F.struct("reading_order", "content")))
    return numbered.groupBy("doc_id", "section").agg(
        F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count("*").alias("n_fragments"),
        F.sum(F.length("content")).alias("n_chars"), F.sha2(F.array_join(F.transform(parts, lambda p: p["content"]), "\n"), 256).alias("sha256"),
    )


def pattern_chunks(fragments: DataFrame, start: str) -> DataFrame:
    """A chunk starts at every fragment that matches ``start``."""
    numbered = fragments.withColumn("chunk", F.sum(F.rlike(F.lower("content"), F.lit(start.lower())).cast("int")).over(reading()))
    return numbered.groupBy("doc_id", "chunk").agg(F.count("*").alias("n_fragments"), F.min("reading_order").alias("first"))


def row_budget(fragments: DataFrame, rows: int) -> DataFrame:
    """Table rows dealt to chunks of ``rows`` each, in order."""
    at = F.row_number().over(reading())
    return fragments.where("kind = 'table'").withColumn("chunk", F.floor((at - 1) / rows)).groupBy("doc_id", "chunk").agg(
        F.count("*").alias("n_rows"), F.min("reading_order").alias("first")
    )


def adjacent_tables(fragments: DataFrame) -> DataFrame:
    """The last table of a page with the first of the next."""
    tables = fragments.where("kind = 'table'").groupBy("doc_id", "page").agg(F.min("reading_order").alias("first"), F.max("reading_order").alias("last"))
    following = tables.select("doc_id", (F.col("page") - 1).alias("page"), F.col("first").alias("next_first"))
    return tables.join(following, ["doc_id", "page"]).select("doc_id", "page", "last", "next_first")


def page_classes(fragments: DataFrame) -> DataFrame:
    """Per document and kind: the pages that have it."""
    return fragments.groupBy("doc_id", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_set("page")), lambda p: p.cast("string")), ",").alias("pages"))


def header_trail(fragments: DataFrame) -> DataFrame:
    """Every fragment with the position of the header above it."""
    above = F.last(F.when(F.col("kind") == "section_header", F.col("reading_order")), ignorenulls=True).over(reading())
    return fragments.select("doc_id", "reading_order", above.alias("header"))


def html_text(html: Column) -> Column:
    """Visible text: no scripts, styles, comments or tags; entities of the markup itself decoded."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)[^>]*>.*?</\1>|<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


CELL = 16


def _cells(boxes: DataFrame) -> DataFrame:
    """A row for every cell of a square grid that a box touches."""
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / CELL), F.floor(F.col(hi) / CELL))
    return boxes.withColumn("cx", F.explode(span("x1", "x2"))).withColumn("cy", F.explode(span("y1", "y2")))


def overlap_pairs(boxes: DataFrame, least: float) -> DataFrame:
    """Pairs of boxes on one page whose intersection is ``least`` of their union.

    Boxes meet in the cells of a grid; a pair counts only in the cell of its intersection's least corner.
    """
    a, b = _cells(boxes).alias("a"), _cells(boxes).alias("b")
    low = lambda c: F.greatest(f"a.{c}", f"b.{c}")
    side = lambda lo, hi: F.greatest(F.least(f"a.{hi}", f"b.{hi}") - low(lo), F.lit(0))
    area = lambda t: (F.col(f"{t}.x2") - F.col(f"{t}.x1")) * (F.col(f"{t}.y2") - F.col(f"{t}.y1"))
    here = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("page", "cx", "cy")]
    met = a.join(b, here).where(
        (F.col("a.box") < F.col("b.box")) & (F.floor(low("x1") / CELL) == F.col("a.cx")) & (F.floor(low("y1") / CELL) == F.col("a.cy"))
    )
    both = side("x1", "x2") * side("y1", "y2")
    out = met.select(F.col("a.page").alias("page"), F.col("a.box").alias("a"), F.col("b.box").alias("b"), both.alias("shared"), (area("a") + area("b") - both).alias("joint"))
    return out.where((F.col("joint") > 0) & (F.col("shared") * 1000 > F.col("joint") * int(least * 1000)))


def containment(boxes: DataFrame, least: float = 0.9) -> DataFrame:
    """Pairs (inner, outer) of boxes on one page of which ``least`` of the inner one's area lies in the outer one."""
    a, b = _cells(boxes).alias("a"), _cells(boxes).alias("b")
    low = lambda c: F.greatest(f"a.{c}", f"b.{c}")
    side = lambda lo, hi: F.greatest(F.least(f"a.{hi}", f"b.{hi}") - low(lo), F.lit(0))
    own = (F.col("a.x2") - F.col("a.x1")) * (F.col("a.y2") - F.col("a.y1"))
    here = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("page", "cx", "cy")]
    met = a.join(b, here).where(
        (F.col("a.box") != F.col("b.box")) & (F.floor(low("x1") / CELL) == F.col("a.cx")) & (F.floor(low("y1") / CELL) == F.col("a.cy")) & (own > 0)
    )
    return met.where(side("x1", "x2") * side("y1", "y2") * 100 >= own * int(least * 100)).select(F.col("a.page").alias("page"), F.col("a.box").alias("inner"), F.col("b.box").alias("outer"))


def nearest_label(boxes: DataFrame, labels: DataFrame) -> DataFrame:
    """Every box with the label of its page that is nearest, by distance of centres, ties by label.

    Labels of the cells around a box's centre come first; their best is right if it is
    no farther than a cell.  Only boxes without such a label look at the whole page.
    Tasks take pages, however the tables' files are cut, and both sides meet sorted: labels
    are neither broadcast nor is a file's worth of pairs sorted in one task.
    """
    centred = lambda t: t.withColumn("mx", F.col("x1") + F.col("x2")).withColumn("my", F.col("y1") + F.col("y2"))
    size = 2 * CELL  # centres are doubled
    near = lambda c: F.explode(F.transform(F.array(*[F.lit(k) for k in (-1, 0, 1)]), lambda k: F.floor(F.col(c) / size) + k))
    a = centred(boxes).select("page", "box", "mx", "my").repartition("page")
    b = centred(labels).select("page", F.col("box").alias("label"), F.col("mx").alias("lx"), F.col("my").alias("ly")).repartition("page")
    gap = (F.col("mx") - F.col("lx")) * (F.col("mx") - F.col("lx")) + (F.col("my") - F.col("ly")) * (F.col("my") - F.col("ly"))
    best = lambda met: met.groupBy("page", "box", "mx", "my").agg(F.min(F.struct(F.col("gap").alias("distance"), "label")).alias("m"))
    placed = a.withColumn("cx", F.floor(F.col("mx") / size)).withColumn("cy", F.floor(F.col("my") / size))
    around = b.withColumn("cx", near("lx")).withColumn("cy", near("ly"))
    met = placed.join(around.hint("merge"), ["page", "cx", "cy"]).withColumn("gap", gap)
    close = best(met.where(F.col("gap") <= size * size))
    far = best(a.join(close.select("page", "box").hint("merge"), ["page", "box"], "left_anti").join(b.hint("merge"), "page").withColumn("gap", gap))
    return close.unionByName(far).select("page", "box", "m.distance", "m.label")
