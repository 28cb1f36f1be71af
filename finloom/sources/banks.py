"""Line formats of banks: a registry of patterns over text lines, parsed by one plan.

A statement is lines (file, bank, year, line_no, line).  A line that fits its bank's
pattern opens a transaction; lines after it that fit nothing go on with its text, up to
the format's limit, and noise lines go.  What a line doesn't print follows from the file:
the date from the row before, the year from the statement and the turns that its dates show,
the side from the balance.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finloom.functions.money import parsed_cents
from finloom.functions.text import squash

M = r"[\d,]+\.\d{2}"
#: Hint words of formats without their own.
CREDIT_WORDS, DEBIT_WORDS = r"\bDEPOSIT\b|\bCREDIT\b|\bINWARD\b|\bFROM\b", r"\bPAYMENT\b|\bFEE\b|\bTO\b|\bTAX\b"


@dataclass(frozen=True)
class BankFormat:
    """``pattern`` has the groups date, text, amount, mark or second amount, balance.

    ``side``: "delta" by the change of the balance; "words" by hint words of the first line,
    else by delta, whose size is the amount if it differs by over five cents; "check" by delta
    if it is the amount, else by hint words; "sign" by the mark; "in_out" and "out_in" by two
    columns.  ``more`` lines of text may follow.  Hints are patterns over the text between
    blanks: of credits, of what rules them out, and of debits.
    """

    bank: str
    pattern: str
    date_form: str
    side: str
    has_year: bool = True
    more: int = 0
    hints: tuple[str, str, str] = (CREDIT_WORDS, "", DEBIT_WORDS)


#: The hints of two banks.
OCBC_HINTS = (" CR |CR /IB|CR INWARD|CREDIT", " DR |DR /IB", " DR |DR /IB|DEBIT|DUITNOW SC|DEBIT AS ADVISED")
AMBANK_HINTS = (" CR |CREDIT|DUITNOW CR", "", "INW.*CHQ|CHQ.*INW|[^ ] DEBIT|/DEBIT|FEE|CHARGE|INT")

BANKS = (
    BankFormat("public_bank", rf"^(?:(\d{{2}}/\d{{2}})\s+)?(.+?)\s+({M})()\s+(-?{M})$", "dd/MM/yyyy", "delta", has_year=False, more=6),
    BankFormat("uob", rf"^(\d{{2}}/\d{{2}}/\d{{4}})\s+(.+?)\s+({M})\s+({M})\s+(-?{M})$", "dd/MM/yyyy", "in_out", more=4),
    BankFormat("alliance", rf"^(\d{{6}})\s+(.+?)\s+({M})()\s+({M}\s*(?:CR|DR))$", "ddMMyy", "delta", more=3),
    BankFormat("rhb", rf"^(\d{{1,2}} [A-Za-z]{{3}})\s+(.+?)\s+({M})()\s+({M}[+-]?)$", "d MMM yyyy", "delta", has_year=False, more=2),
    BankFormat("ambank", rf"^(\d{{2}}[A-Za-z]{{3}})\s+(.+?)\s+({M})()\s+(-?{M})$", "ddMMM yyyy", "check", has_year=False, more=4, hints=AMBANK_HINTS),
    BankFormat("ocbc", rf"^(\d{{2}} [A-Za-z]{{3}} \d{{4}})\s+(.+?)\s+({M})()\s+(-?{M})$", "dd MMM yyyy", "words", more=3, hints=OCBC_HINTS),
    BankFormat("agrobank", rf"^(\d{{1,2}}/\d{{2}}/\d{{2}})\s+(.+?)\s+({M})(-?)\s+({M}-?)$", "d/MM/yy", "delta"),
    BankFormat("maybank", rf"^(\d{{2}}/\d{{2}})\s+(.+?)\s+({M})([+-])\s+({M}(?:DR)?)$", "dd/MM/yyyy", "sign", has_year=False, more=5),
    BankFormat("muamalat", rf"^(\d{{1,2}}/\d{{2}}/\d{{2}})\s+(.+?)\s+({M})\s+({M})\s+(-?{M})$", "d/MM/yy", "out_in"),
)
#: Lines that are never part of a transaction, and that of the opening balance.
NOISE = r"(?i)^\s*$|^(?:page \d+|date\s+description|closing balance|total (?:debit|credit)|penyata akaun|statement of account|end of statement)\b"
OPENING = r"(?i)^(?:opening balance|balance b/f|baki permulaan|balance brought fwd)\s+(-?[\d,]+\.\d{2})"


def _by_bank(value, formats: tuple[BankFormat, ...], other: Column) -> Column:
    return reduce(lambda c, f: c.when(F.col("bank") == f.bank, value(f)), formats[1:], F.when(F.col("bank") == formats[0].bank, value(formats[0]))).otherwise(other)


def advanced_years(rows: DataFrame, fixed: Column) -> DataFrame:
    """``rows`` (file, row, date, ...) with dates of the statement's year brought to the next one after its turn.

    A date over 30 days before the one of the row above, as that one was advanced, is of the
    next year; ``fixed`` rows print their year.  Whether a row is advanced so depends on the
    row above only where the printed dates alone don't decide, so it is the last decision.
    """
    in_file = Window.partitionBy("file").orderBy("row")
    falls = lambda c: F.datediff(c, "date") > 30
    x = rows.withColumn("_was", F.lag("date").over(in_file))
    decided = F.when(falls(F.col("_was")), True).when(~falls(F.add_months("_was", 12)), False)
    x = x.withColumn("_next", F.last(decided, ignorenulls=True).over(in_file))
    return x.withColumn("date", F.when(F.col("_next") & ~fixed, F.add_months("date", 12)).otherwise(F.col("date"))).drop("_was", "_next")


def statement_rows(lines: DataFrame, formats: tuple[BankFormat, ...] = BANKS) -> DataFrame:
    """file, bank, row (its place), date, description, debit, credit, balance of every transaction.

    Files of unknown banks give no rows; a null line is noise.
    """
    none = F.lit(None).cast("array<string>")
    cells = lambda f: F.when(F.rlike("line", F.lit(f.pattern)), F.array(*[F.regexp_extract("line", f.pattern, i) for i in range(1, 6)]))
    kept = lines.where(F.col("line").isNotNull() & ~F.rlike("line", F.lit(NOISE)) & F.col("bank").isin(*[f.bank for f in formats]))
    order = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opening = parsed_cents(F.nullif(F.regexp_extract("line", OPENING, 1), F.lit("")))
    x = kept.withColumn("opening", opening).withColumn("g", F.when(F.col("opening").isNull(), F.element_at(F.transform(F.array("line"), lambda _: _by_bank(cells, formats, none)), 1)))
    x = x.withColumn("row", F.count("g").over(order)).withColumn("opening", F.last("opening", ignorenulls=True).over(order))
    rows = x.where("row > 0").groupBy("file", "bank", "year", "row").agg(
        F.min_by("g", "line_no").alias("g"), F.min_by("opening", "line_no").alias("opening"),
        F.sort_array(F.collect_list(F.when(F.col("g").isNull(), F.struct("line_no", "line")))).alias("rest"),
    )
    more = _by_bank(lambda f: F.lit(f.more), formats, F.lit(0))
    shown = F.nullif(F.get("g", 0), F.lit(""))
    printed = _by_bank(lambda f: F.try_to_timestamp(shown if f.has_year else F.concat(shown, F.lit("/" if f.date_form.startswith("dd/") else " "), F.col("year").cast("string")), F.lit(f.date_form)).cast("date"), formats, F.lit(None).cast("date"))
    # two-digit years from 69 on are of the last century
    printed = F.when(F.year(printed) >= 2069, F.add_months(printed, -1200)).otherwise(printed)
    in_file = Window.partitionBy("file").orderBy("row")
    y = rows.select(
        "file", "bank", "row", F.last(printed, ignorenulls=True).over(in_file).alias("date"),
        squash(F.concat_ws(" ", F.get("g", 1), F.array_join(F.transform(F.slice("rest", 1, more), lambda r: r["line"]), " "))).alias("description"),
        squash(F.get("g", 1)).alias("head"), parsed_cents(F.get("g", 2)).alias("a"), F.get("g", 3).alias("mark"), parsed_cents(F.get("g", 4)).alias("balance"), "opening",
    )
    delta = F.col("balance") - F.coalesce(F.lag("balance").over(in_file), F.col("opening"))
    y = y.withColumn("delta", delta).withColumn("_t", F.upper(F.concat(F.lit(" "), _by_bank(lambda f: F.col("head" if f.side == "words" else "description"), formats, F.lit("")), F.lit(" "))))
    told = lambda p: F.rlike("_t", F.lit(p)) if p else F.lit(False)
    hint = _by_bank(lambda f: F.when(told(f.hints[0]) & ~told(f.hints[1]), "CR").when(told(f.hints[2]), "DR"), formats, F.lit(None).cast("string"))
    y = y.withColumn("hint", hint)
    hint = F.col("hint")
    moved = F.when(F.col("delta") > 0, "CR").when(F.col("delta") < 0, "DR")
    exact = F.when(F.abs(F.abs("delta") - F.col("a")) <= 1, moved)
    rules = {
        "delta": F.coalesce(moved, hint), "words": F.coalesce(hint, moved), "check": F.coalesce(exact, hint, moved, F.when(F.col("delta").isNull(), "DR")),
        "sign": F.when(F.col("mark") == "+", "CR").otherwise("DR"), "in_out": F.when(F.col("a") > 0, "CR").otherwise("DR"), "out_in": F.when(F.col("a") > 0, "DR").otherwise("CR"),
    }
    two = _by_bank(lambda f: F.lit(f.side in ("in_out", "out_in")), formats, F.lit(False))
    apart = {"words": F.abs(F.abs("delta") - F.col("a")) > 5, "check": exact.isNull() & F.col("delta").isNotNull()}
    unlike = hint.isNull() & _by_bank(lambda f: apart.get(f.side, F.lit(False)), formats, F.lit(False))
    y = y.withColumn("side", _by_bank(lambda f: rules[f.side], formats, F.lit(None).cast("string")))
    y = y.withColumn("amount", F.when(two & (F.col("a") == 0), parsed_cents(F.col("mark"))).when(unlike, F.abs("delta")).otherwise(F.col("a")))
    of = lambda s: F.when(F.col("side") == s, F.col("amount")).otherwise(0)
    y = advanced_years(y, _by_bank(lambda f: F.lit(f.has_year), formats, F.lit(True)))
    return y.select("file", "bank", "row", "date", "description", of("DR").alias("debit"), of("CR").alias("credit"), "balance")
