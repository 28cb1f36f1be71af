"""Statements whose rows are blocks of lines, and what their balances say.

Lines are (file, page, line_no, line).  Three layouts: blocks that stop at footers, with
an opening that may have to be solved back from the closing; reverse chronological blocks
between an opening and a closing row; and dated lines of which only one balance a date
is right.  Money is in cents; sides follow from the change of the balance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finloom.functions.money import parsed_cents
from finloom.functions.text import squash

#: Money and dates in lines, and the lines that end a block.
MONEY = r"-?\d[\d,]*\.\d{2}"
UNSIGNED = r"(?:\d{1,3}(?:,\d{3})*|\d+)\.\d{2}"
TOKEN = r"^-?\d{1,3}(?:,\d{3})*\.\d{2}$"
DAY = r"\d{2}/\d{2}/\d{4}"
STOP = r"(?i)^\s*(?:Baki\s*Permulaan|Opening\s*Balance|Closing\s*Balance|Baki\s*Penutup|Tarikh\s*Kod|Date\s*Transaction|Mukasurat|Page\s*\d+\s*of|This\s+is\s+a\s+computer\s+generated)"
OPENING, CLOSING = r"(?:Opening Balance|Baki Permulaan)", r"(?:Closing Balance|Baki Penutup)"

FILE_ORDER = ("page", "line_no")


def _before(*by: str, order=FILE_ORDER):
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def _upto(*by: str, order=FILE_ORDER):
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _day(text: Column, form: str = "dd/MM/yyyy") -> Column:
    return F.try_to_timestamp(text, F.lit(form)).cast("date")


def with_sides(rows: DataFrame, first: Column) -> DataFrame:
    """``rows`` (file, row, balance, ...) with debit and credit by the change of the balance, the first one's against ``first``."""
    delta = F.col("balance") - F.coalesce(F.lag("balance").over(Window.partitionBy("file").orderBy("row")), first)
    held = rows.withColumn("_d", delta)
    return held.withColumn("debit", F.when(F.col("_d") < 0, -F.col("_d")).otherwise(0)).withColumn("credit", F.when(F.col("_d") > 0, F.col("_d")).otherwise(0)).drop("_d")


def _labelled(label: str, told: Column) -> Column:
    """The first amount after the label: in its line, or first in the next line that has a digit or sign (``told``)."""
    here = F.regexp_extract("line", rf"(?i){label}[^\d\-]*({MONEY})", 1)
    below = F.when(F.rlike("line", F.lit(rf"(?i){label}[^\d\-]*$")), F.regexp_extract(told, rf"^[^\d\-]*({MONEY})", 1))
    return F.coalesce(F.nullif(here, F.lit("")), F.nullif(below, F.lit("")))


def summaries(lines: DataFrame) -> DataFrame:
    """file, opening, total_debit, total_credit, closing as printed: by labels, else the last four amounts of the file.

    A labelled amount of zero counts as not printed.  Where there is no opening, it is
    solved back from the closing and the totals.  A file is read once, from its end, so
    that what follows a line is what was read before it.
    """
    back = Window.partitionBy("file").orderBy(*[F.desc(c) for c in FILE_ORDER]).rowsBetween(Window.unboundedPreceding, -1)
    x = lines.where("line IS NOT NULL").withColumn("_a", F.regexp_extract_all("line", F.lit(f"({MONEY})"), 1))
    x = x.withColumn("_told", F.last(F.when(F.rlike("line", F.lit(r"[\d\-]")), F.col("line")), ignorenulls=True).over(back))
    x = x.withColumn("_after", F.coalesce(F.sum(F.size("_a")).over(back), F.lit(0)))
    place, told = F.struct(*FILE_ORDER), F.col("_told")
    x = x.select("file", place.alias("_p"), _labelled(OPENING, told).alias("_o"), _labelled(CLOSING, told).alias("_b"), F.when(F.col("_after") < 4, F.struct(*FILE_ORDER, F.col("_a").alias("a"))).alias("_l"))
    first = lambda c: parsed_cents(F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_p"))))
    # the last line of a file has none after it, so that no file goes
    of = x.where("_o IS NOT NULL OR _b IS NOT NULL OR _l IS NOT NULL").groupBy("file").agg(first("_o").alias("o"), first("_b").alias("b"), F.flatten(F.transform(F.sort_array(F.collect_list("_l")), lambda l: l["a"])).alias("_all"))
    at = lambda k: F.when(F.size("_all") >= 4, parsed_cents(F.try_element_at("_all", F.lit(-k))))
    x = of.withColumn("k", F.size("_all") >= 4).withColumns({"o4": at(4), "d4": at(3), "c4": at(2), "b4": at(1)})
    printed = lambda a, b: F.when(F.col("k"), F.coalesce(F.nullif(F.col(a), F.lit(0)), F.col(b))).otherwise(F.col(a))
    x = x.select("file", printed("o", "o4").alias("opening"), F.col("d4").alias("total_debit"), F.col("c4").alias("total_credit"), printed("b", "b4").alias("closing"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return x.withColumn("opening", F.coalesce("opening", F.col("closing") - zero(F.col("total_credit")) + zero(F.col("total_debit"))))


def stopped_blocks(lines: DataFrame) -> DataFrame:
    """file, row, date, description, debit, credit, balance: blocks opened by a dated line with an amount.

    A block goes on to the next line that starts with a date or a footer, within its page.
    A date inside a line opens a block only where none is open, so the state before a
    line is that after the last line which decides it.  Rows are in order of date and page.
    """
    amounts = F.regexp_extract_all("line", F.lit(f"({MONEY})"), 1)
    day = F.regexp_extract("line", f"({DAY})", 1)
    x = lines.where("line IS NOT NULL").withColumn("_a", F.try_element_at(amounts, F.lit(-1))).withColumn("_day", day)
    x = x.withColumn("date", _day(F.col("_day"))).withColumn("_cut", F.rlike("line", F.lit(rf"^\s*{DAY}")) | F.rlike("line", F.lit(STOP)))
    x = x.withColumn("_fit", F.col("date").isNotNull() & F.col("_a").isNotNull())
    decided = F.when(F.col("_cut"), F.col("_fit")).when(F.col("_fit"), True)
    x = x.withColumn("_open", F.coalesce(F.last(decided, ignorenulls=True).over(_before("file", "page")), F.lit(False)))
    x = x.withColumn("_head", F.col("_fit") & (F.col("_cut") | ~F.col("_open"))).withColumn("_block", F.sum(F.col("_head").cast("int")).over(_upto("file", "page")))
    x = x.where(F.col("_head") | (F.col("_open") & ~F.col("_cut")))
    bare = F.replace("line", "_day", F.lit(""))
    at = F.instr(bare, F.col("_a"))
    text = squash(F.concat(F.substr(bare, F.lit(1), at - 1), F.substr(bare, at + F.length("_a"))))
    rest = F.when(~F.col("_head") & (F.trim("line") != ""), F.struct("line_no", F.trim("line").alias("t")))
    rows = x.groupBy("file", "page", "_block").agg(
        F.min("line_no").alias("line_no"), F.min_by("date", "line_no").alias("date"), F.min_by(text, F.col("line_no")).alias("head"),
        F.array_join(F.transform(F.sort_array(F.collect_list(rest)), lambda r: r["t"]), " ").alias("rest"), parsed_cents(F.min_by("_a", "line_no")).alias("balance"),
    )
    placed = rows.select("file", F.row_number().over(Window.partitionBy("file").orderBy("date", "page", "line_no")).alias("row"), "date", F.trim(F.concat_ws(" ", "head", "rest")).alias("description"), "balance")
    sided = with_sides(placed.join(summaries(lines).select("file", "opening"), "file", "left"), F.col("opening"))
    return sided.select("file", "row", "date", "description", "debit", "credit", "balance")


def reversed_blocks(lines: DataFrame) -> DataFrame:
    """file, row, kind, date, description, debit, credit, balance of statements that print the latest row first.

    A dated line opens a block, which ends with its first line that has a balance, the
    last money token; pages don't end it.  Rows are put in order: by date, and within one
    from the last printed.  The opening line gives the first row, dated on the first of
    the latest row's month, and the start of the balance; the closing line gives the
    last.  Of rows equal in date, amounts and balance the first stays.
    """
    x = lines.where("line IS NOT NULL").withColumn("line", F.trim(F.regexp_replace("line", r"\s+", " "))).where("line <> ''")
    tokens = F.split("line", " ")
    money = F.filter(tokens, lambda t: F.rlike(t, F.lit(TOKEN)))
    first = F.array_position(F.transform(tokens, lambda t: F.rlike(t, F.lit(TOKEN)) | (t == "0")), True)
    x = x.withColumn("_m", F.try_element_at(money, F.lit(-1))).withColumn("_words", F.when(F.col("_m").isNull(), F.col("line")).otherwise(F.array_join(F.slice(tokens, 1, (first - 1).cast("int")), " ")))
    opening, closing = F.rlike("line", F.lit(r"(?i)^\s*OPENING\s+BALANCE\b")), F.rlike("line", F.lit("(?i)CLOSING BALANCE")) & F.rlike("line", F.lit("(?i)BAKI"))
    x = x.withColumn("_kind", F.when(opening, "opening").when(closing, "closing").when(F.rlike("line", F.lit(rf"^{DAY} ")), "dated").otherwise("more"))
    # both ends and the latest date stand beside every row, so that a file is read once
    place, whole = F.struct(*FILE_ORDER), Window.partitionBy("file")
    end = lambda pick, kind: parsed_cents(pick("_m", F.when((F.col("_kind") == kind) & F.col("_m").isNotNull(), place)).over(whole))
    x = x.withColumn("opening", end(F.max_by, "opening")).withColumn("closing", end(F.min_by, "closing"))
    y = x.where("_kind IN ('dated', 'more')").withColumn("_block", F.sum(F.when(F.col("_kind") == "dated", 1).otherwise(0)).over(_upto("file")))
    done = F.coalesce(F.max(F.col("_m").isNotNull()).over(_before("file", "_block")), F.lit(False))
    y = y.withColumn("_done", done).where("_block > 0 AND NOT _done")
    blocks = y.groupBy("file", "_block").agg(
        _day(F.substr(F.min_by("line", place), F.lit(1), F.lit(10))).alias("date"),
        squash(F.substr(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*FILE_ORDER, "_words"))), lambda r: r["_words"]), " "), F.lit(11))).alias("description"),
        parsed_cents(F.max("_m")).alias("balance"), F.first("opening").alias("opening"), F.first("closing").alias("closing"),
    ).where("balance IS NOT NULL AND date IS NOT NULL")
    placed = blocks.withColumn("row", F.row_number().over(Window.partitionBy("file").orderBy("date", F.desc("_block")))).withColumn("latest", F.max("date").over(whole))
    rows = with_sides(placed, F.col("opening"))
    kept = ("row", "kind", "date", "description", "debit", "credit", "balance")
    item = lambda *values: F.struct(*[v.alias(c) for c, v in zip(kept, values, strict=True)])
    none = F.lit(0).cast("bigint")
    head = item(F.lit(0), F.lit("opening"), F.trunc("latest", "month"), F.lit("OPENING BALANCE (PAGE 1)"), none, none, F.col("opening"))
    tail = item(F.lit(2**31 - 1), F.lit("closing"), F.col("latest"), F.lit("CLOSING BALANCE / BAKI PENUTUP"), none, none, F.col("closing"))
    told = lambda c, extra: F.when((F.col("row") == 1) & F.col(c).isNotNull(), extra)
    own = item(F.col("row"), F.lit("row"), *[F.col(c) for c in kept[2:4]], *[F.col(c).cast("bigint") for c in kept[4:6]], F.col("balance"))
    every = rows.select("file", F.inline(F.array_compact(F.array(told("opening", head), own, told("closing", tail)))))
    once = every.withColumn("_k", F.row_number().over(Window.partitionBy("file", "date", "debit", "credit", "balance").orderBy("row"))).where("_k = 1")
    return once.withColumn("row", F.row_number().over(Window.partitionBy("file").orderBy("row"))).drop("_k")


def balance_candidates(lines: DataFrame) -> DataFrame:
    """file, date, balance, line, page: every balance that a dated line may tell, once a date and balance, from its first line.

    ``lines`` may have ``month`` (yyyy-MM): dates outside it are noise.
    """
    line = F.trim(F.regexp_replace("line", r"\s+", " "))
    x = lines.withColumn("line", line).withColumn("_d", F.regexp_extract("line", r"^(\d{1,2}/\d{1,2}/\d{2,4})\b", 1))
    date = F.coalesce(F.when(F.rlike("_d", F.lit(r"/\d{2}$")), _day(F.col("_d"), "d/M/yy")), F.when(F.rlike("_d", F.lit(r"/\d{4}$")), _day(F.col("_d"), "d/M/yyyy")))
    x = x.withColumn("date", F.when(F.year(date) >= 2069, F.add_months(date, -1200)).otherwise(date))
    if "month" in lines.columns:
        x = x.where(F.col("month").isNull() | (F.date_format("date", "yyyy-MM") == F.col("month")))
    x = x.withColumn("balance", parsed_cents(F.try_element_at(F.regexp_extract_all("line", F.lit(f"({UNSIGNED})"), 1), F.lit(-1))))
    first = F.min(F.struct("page", "line_no", "line")).alias("f")
    return x.where("date IS NOT NULL AND balance IS NOT NULL").groupBy("file", "date", "balance").agg(first).select("file", "date", "balance", "f.line", "f.page")


def chosen_balances(candidates: DataFrame, openings: DataFrame) -> DataFrame:
    """file, date, balance, line, page: of every date the balance nearest to the one chosen before, from the file's opening on.

    Ties go to the lesser balance, line, page.  What is chosen depends on the choice before, so
    candidates are read in order.  A date with one candidate needs no choice and starts
    a new chain: chains, not files, are dealt to tasks, and a task holds one row of state.
    Files without an opening (``openings``: file, opening) have no rows.
    """
    import pyspark.sql.types as T

    per = candidates.groupBy("file", "date").agg(F.count("*").alias("_n"), F.min("balance").alias("_only"))
    before = _before("file", order=("date",))
    alone = F.when(F.col("_n") == 1, 1).otherwise(0)
    chains = per.select("file", "date", F.coalesce(F.sum(alone).over(before), F.lit(0)).alias("chain"), F.last(F.when(F.col("_n") == 1, F.col("_only")), ignorenulls=True).over(before).alias("_from"))
    known = candidates.join(chains, ["file", "date"]).join(openings.where("opening IS NOT NULL").select("file", "opening"), "file")
    ready = known.select("file", "chain", "date", "balance", "line", "page", F.coalesce("_from", "opening").alias("start"))
    kept = ["file", "date", "balance", "line", "page"]
    schema = T.StructType([candidates.schema[c] for c in kept])

    def run(batches):
        import pyarrow as pa

        def told(rows):
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=kept)

        now, prev, best, types = None, None, None, None  # now: file, chain, date; best: of the date so far
        for batch in batches:
            types, out = [batch.schema.field(c).type for c in kept], []
            for f, c, d, b, line, page, start in zip(*(batch.column(n).to_pylist() for n in ("file", "chain", "date", "balance", "line", "page", "start")), strict=True):
                if (f, c, d) != now:
                    if now is not None:
                        out.append((now[0], now[2], *best[1:]))
                    prev = best[1] if now is not None and (f, c) == now[:2] else start
                    now, best = (f, c, d), None
                option = (abs(b - prev), b, line, page)
                best = option if best is None else min(best, option)
            if out:
                yield told(out)
        if now is not None:
            yield told([(now[0], now[2], *best[1:])])

    return ready.repartition("file", "chain").sortWithinPartitions("file", "chain", "date", "balance", "line", "page").mapInArrow(run, schema)


def dated_balances(lines: DataFrame, openings: DataFrame) -> DataFrame:
    """file, row, date, description, debit, credit, balance: one row a date, by the balance chosen for it."""
    rows = chosen_balances(balance_candidates(lines), openings)
    bare = F.regexp_replace(F.regexp_replace("line", r"^\d{1,2}/\d{1,2}/\d{2,4}", ""), UNSIGNED, "")
    placed = rows.join(openings, "file").select("file", F.row_number().over(Window.partitionBy("file").orderBy("date")).alias("row"), "date", F.trim(bare).alias("description"), "balance", "opening")
    return with_sides(placed, F.col("opening")).select("file", "row", "date", "description", "debit", "credit", "balance")
