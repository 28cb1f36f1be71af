"""Words with places on a page: visual lines, column anchors, amounts by column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from finloom.functions.money import parsed_cents

PAGE = ("file", "page")
#: A money token, with brackets or a trailing sign, and a date token.
MONEY = r"^\(?(?:RM\s*)?(?:\d{1,3}(?:,\d{3})*|\d+)?\.\d{2}\)?[+-]?$"
DATE = r"^\d{2}-\d{2}-\d{4}$"


def line_numbers(ys: list[float], tolerance: float) -> list[int]:
    """Numbers from the top of the lines that words, given from the top down, fall into.

    A word joins the first line, in the order of their making, whose centre is within the
    tolerance; the centre is the mean of the line's words.
    """
    centres, counts, of, live = [], [], [], []
    for y in ys:
        live = [k for k in live if y - centres[k] <= tolerance]  # centres that words have passed come no nearer
        at = next((k for k in live if abs(y - centres[k]) <= tolerance), None)
        if at is None:
            at = len(centres)
            live.append(at)
            centres.append(y)
            counts.append(1)
        else:
            counts[at] += 1
            centres[at] = (centres[at] * (counts[at] - 1) + y) / counts[at]
        of.append(at)
    place = {k: i for i, k in enumerate(sorted(range(len(centres)), key=lambda k: centres[k]))}
    return [place[k] for k in of]


def _numbered(pages, tolerance: float):
    """Place of the page and number of the line of every row of an Arrow table of whole pages, sorted by page and y; -1 where y is null.

    A gap wider than the tolerance parts lines whatever their centres are, and words that
    span less than it are one line; only what is neither is numbered word by word.
    """
    import numpy as np
    import pyarrow.compute as pc

    n = pages.num_rows
    cut = np.ones(n, bool)
    if n > 1:
        cut[1:] = False
        for name in PAGE:
            c = pages.column(name).combine_chunks()
            other = pc.fill_null(pc.not_equal(c[1:], c[:-1]), False)
            cut[1:] |= pc.or_(other, pc.xor(pc.is_null(c[1:]), pc.is_null(c[:-1]))).to_numpy(zero_copy_only=False)
    page = np.cumsum(cut) - 1
    y = pages.column("y").combine_chunks()
    line, known = np.full(n, -1, np.int64), np.flatnonzero(pc.is_valid(y).to_numpy(zero_copy_only=False))
    if not len(known):
        return page, line
    ys, of = y.drop_null().to_numpy(zero_copy_only=False).astype(float), page[known]
    slack = 1e-9 * (1 + np.abs(ys))  # centres are rounded
    start = np.concatenate([[True], (np.diff(ys) > tolerance + slack[1:]) | (np.diff(of) > 0)])
    lo = np.flatnonzero(start)
    hi = np.append(lo[1:], len(ys))
    lines, own = np.ones(len(lo), np.int64), np.zeros(len(ys), np.int64)
    for r in np.flatnonzero(~(ys[hi - 1] - ys[lo] <= tolerance - slack[hi - 1])):
        own[lo[r] : hi[r]] = line_numbers(ys[lo[r] : hi[r]].tolist(), tolerance)
        lines[r] = own[lo[r] : hi[r]].max() + 1
    before = np.cumsum(lines) - lines
    first = np.searchsorted(of[lo], of[lo])  # the first run of the page
    line[known] = own + np.repeat(before - before[first], hi - lo)
    return page, line


def _whole_pages(batches, done):
    """``done`` of tables of whole pages, from Arrow batches sorted by page; a task holds one page and a batch."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = batch.num_rows - 1
        same = None
        for name in PAGE:
            c, v = batch.column(name), batch.column(name)[last]
            alike = pc.is_null(c) if not v.is_valid else pc.fill_null(pc.equal(c, v), False)
            same = alike if same is None else pc.and_(same, alike)
        # the batch's last page begins where the run of its key at the end does
        at = pc.index(same, True).as_py()
        head = held[-1] if held else None
        if at or (head is not None and any(head.column(name)[head.num_rows - 1] != batch.column(name)[0] for name in PAGE)):
            if held or at:
                yield from done(pa.Table.from_batches([*held, batch.slice(0, at)]))
            held = []
        held.append(batch.slice(at))
    if held:
        yield from done(pa.Table.from_batches(held))


def visual_lines(words: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """``words`` (file, page, word, x, y, ...) with ``line``, counted from 0 at the top of each page.

    The centre of a line moves with every word, so pages are read in order, sorted by
    Spark and streamed; a task holds one page.  Words with a null y make line null.
    """
    schema = StructType([*words.schema.fields]).add("line", IntegerType())

    def run(batches):
        import pyarrow as pa

        def done(pages):
            _, line = _numbered(pages, tolerance)
            yield from pages.append_column("line", pa.array(line, pa.int32(), mask=line < 0)).combine_chunks().to_batches()

        yield from _whole_pages(batches, done)

    return words.repartition(*PAGE).sortWithinPartitions(*PAGE, "y", "x", "word").mapInArrow(run, schema)


def line_texts(words: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """file, page, line, text: the words of every line of ``visual_lines``, from the left, in the pass that numbers the lines."""
    schema = StructType([words.schema[c] for c in PAGE]).add("line", IntegerType()).add("text", StringType())

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def done(pages):
            page, line = _numbered(pages, tolerance)
            keys = pa.table({"page": page, "line": line, "x": pages.column("x"), "word": pages.column("word")})
            order = pc.sort_indices(keys, [(c, "ascending") for c in keys.column_names], null_placement="at_start")
            page, line = page[order], line[order]
            first = np.flatnonzero(np.concatenate([[True], (np.diff(page) != 0) | (np.diff(line) != 0)]))
            text = pages.column("text").combine_chunks().take(order)
            there = pc.is_valid(text)
            ends = np.concatenate([[0], np.cumsum(there.to_numpy(zero_copy_only=False))])
            at = pa.array(np.append(ends[first], ends[-1]), pa.int32())
            texts = pc.binary_join(pa.ListArray.from_arrays(at, text.filter(there)), " ")
            heads, line = pages.select(list(PAGE)).take(order.take(pa.array(first))), line[first]
            columns = [heads.column(c).combine_chunks() for c in PAGE] + [pa.array(line, pa.int32(), mask=line < 0), texts]
            yield pa.record_batch(columns, names=[*PAGE, "line", "text"])

        yield from _whole_pages(batches, done)

    return words.select(*PAGE, "word", "x", "y", "text").repartition(*PAGE).sortWithinPartitions(*PAGE, "y").mapInArrow(run, schema)


@dataclass(frozen=True)
class Columns:
    """Labels of the amount columns, where they are if no heading is found, and the reach of each."""

    credit: str = "deposit"
    debit: str = "withdrawal"
    balance: str = "balance"
    places: tuple[float, float, float] = (320.0, 410.0, 520.0)
    left: float = 25.0
    near: float = 10.0
    reach: float = 80.0


def anchors(lined: DataFrame, columns: Columns = Columns()) -> DataFrame:
    """file, page, credit_x, debit_x, balance_x: where the labels stand in the first line of the page that has all three."""
    low = F.lower(F.trim("text"))
    labels = (columns.credit, columns.debit, columns.balance)
    place = lambda label: F.max_by("x", F.when(low == label, F.struct("x", "word")))
    # part of a word counts for the line, the place needs the word itself
    has = lambda label: F.max(F.contains(low, F.lit(label)))
    lines = lined.groupBy(*PAGE, "line").agg(*[place(x).alias(f"x{i}") for i, x in enumerate(labels)], *[has(x).alias(f"h{i}") for i, x in enumerate(labels)])
    names = ("credit_x", "debit_x", "balance_x")
    # pages without such a line stay, with a null
    found = lines.groupBy(*PAGE).agg(F.min_by(F.struct("x0", "x1", "x2"), F.when(F.expr("h0 AND h1 AND h2"), F.col("line"))).alias("h"))
    return found.select(*PAGE, *[F.coalesce(F.col(f"h.x{i}"), F.lit(p)).alias(n) for i, (n, p) in enumerate(zip(names, columns.places, strict=True))])


def _money(text: Column) -> Column:
    return parsed_cents(F.regexp_replace(F.regexp_replace(text, r"\+$", ""), r"^RM\s*", ""))


def column_rows(lined: DataFrame, columns: Columns = Columns()) -> DataFrame:
    """file, page, row, date, description, debit, credit, balance from words in lines.

    A line with a date token opens a row, lines without go on with it, a line of totals
    ends it.  An amount counts for the column whose anchor is nearest (credit before
    debit before balance); the balance is the rightmost amount in its column's area, or
    else the nearest within reach.  Rows without any amount go; the balance may be null.
    """
    order = Window.partitionBy(*PAGE).orderBy("line", "x", "word").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    of_line = Window.partitionBy(*PAGE, "line")
    text = F.trim("text")
    dated = F.max(F.when(F.rlike(text, F.lit(DATE)), text)).over(of_line)
    total = F.max(F.upper(text).isin("TOTAL", "JUMLAH")).over(of_line)
    w = lined.withColumn("_date", F.min_by(F.when(F.rlike(text, F.lit(DATE)), text), F.when(F.rlike(text, F.lit(DATE)), F.struct("x", "word"))).over(of_line))
    w = w.withColumn("_open", dated.isNotNull() & ~total).withColumn("_stop", total)
    first = F.row_number().over(Window.partitionBy(*PAGE, "line").orderBy("x", "word")) == 1
    w = w.withColumn("_edge", F.when(first & F.col("_open"), 1).when(first & F.col("_stop"), 0)).withColumn("_n", F.when(first & (F.col("_open") | F.col("_stop")), 1).otherwise(0))
    w = w.withColumn("row", F.sum("_n").over(order)).withColumn("_in", F.last("_edge", ignorenulls=True).over(order) == 1)
    w = w.where("_in").join(anchors(lined, columns), list(PAGE))
    x, (c, d, b) = F.col("x"), (F.abs(F.col("x") - F.col(n)) for n in ("credit_x", "debit_x", "balance_x"))
    amount = F.when(F.rlike(text, F.lit(MONEY)) & (x >= F.col("credit_x") - columns.left), _money(text))
    column = F.when((c <= d) & (c <= b), "CR").when((d <= c) & (d <= b), "DR").otherwise("B")
    w = w.withColumn("_a", amount).withColumn("_c", column).withColumn("_d", b)
    mine = lambda k: F.sum(F.when(F.col("_c") == k, F.abs("_a"))).cast("bigint")
    area = F.when(F.col("_a").isNotNull() & (x >= F.col("balance_x") - columns.near), F.struct(x, F.col("word")))
    close = F.when(F.col("_a").isNotNull() & (F.col("_d") <= columns.reach) & (F.col("_d") <= c) & (F.col("_d") <= d), F.struct(F.col("_d"), -x))
    words = F.sort_array(F.collect_list(F.when(~F.rlike(text, F.lit(DATE)) & ~F.rlike(text, F.lit(MONEY)), F.struct("line", "x", "word", text.alias("t")))))
    rows = w.groupBy(*PAGE, "row").agg(
        F.to_date(F.min_by("_date", "line"), "dd-MM-yyyy").alias("date"), F.array_join(F.transform(words, lambda s: s["t"]), " ").alias("description"),
        F.coalesce(mine("DR"), F.lit(0)).alias("debit"), F.coalesce(mine("CR"), F.lit(0)).alias("credit"), F.coalesce(F.max_by("_a", area), F.min_by("_a", close)).alias("balance"),
    )
    kept = rows.where((F.col("debit") > 0) | (F.col("credit") > 0) | F.col("balance").isNotNull())
    return kept.withColumn("row", F.row_number().over(Window.partitionBy(*PAGE).orderBy("row")))
