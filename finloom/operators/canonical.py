"""Raw statement rows brought to one form: dates, sides, balances, labels, totals.

Input rows belong to a ``file`` and have a total order in it, ``row_ord``.  Money is
BIGINT cents.  Windows are over one file, the unit that a statement is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finloom.functions.dates import parsed_date
from finloom.functions.money import parsed_cents
from finloom.functions.text import squash, squash_upper

#: Labels of buckets that stand for no third party.
SYNTHETIC = (
    "UNIDENTIFIED", "UNCATEGORIZED", "CASH DEPOSIT", "CASH WITHDRAWAL", "BANK FEES", "BULK SALARY", "FD/INTEREST", "LOAN REPAYMENT",
    "LOAN DISBURSEMENT", "KWSP", "SOCSO", "LHDN", "HRDF", "REVERSAL", "RETURNED CHEQUE", "INWARD RETURN", "JANM", "APAYLATER",
)
SYNTHETIC_FORM = (
    r"^UNNAMED\s+.+?\s+TRANSFER\s*\((?:CR|DR)\)\s*$|^UNNAMED\s+INTERNAL\s+PAYROLL\s*\((?:CR|DR)\)\s*$|^CARD\s+POS\s*\([A-Z]+\)\s*$"
    r"|^UNIDENTIFIED(?:\s.*)?$"
)
#: Words that are months, and words of purpose, neither of which name a party.
MONTHS = (
    "JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "SEPT", "OCT", "NOV", "DEC", "JANUARY", "FEBRUARY", "MARCH", "APRIL",
    "JUNE", "JULY", "AUGUST", "SEPTEMBER", "OCTOBER", "NOVEMBER", "DECEMBER",
)
PURPOSES = (
    "BULK", "SALARY", "PAYMENT", "PAY", "TRANSFER", "TRF", "FUND", "SETTLEMENT", "SETTLE", "LOAN", "REPAYMENT", "ADVANCE", "IBG", "ADVICE",
    "CREDIT", "DEBIT", "ACCOUNT", "HUB", "MISC", "DUITNOW", "FPX", "INSTANT", "CR", "DR", "TO", "FROM", "FR", "TRANSACTION", "TRANSACTIONS",
    "TRANS", "DEPOSIT", "WITHDRAWAL", "CASH", "INWARD", "OUTWARD",
)
#: What looks like a facility, and prose that only mentions one.
LOAN_SHAPED = (
    r"\bLOANS?\b|\bLOANS?/FIN\b|\bFINANCING\b|\bPEMBIAYAAN\b|\bANGSURAN\b|\bINSTAL?MENT\b|\bHIRE\s*PURCHASE\b|\bHP\s+LOAN\b|\bREPAYMENT\b|\bDISBURS"
)
LOAN_NOISE = (
    r"PEMBIAYAAN\s+RUMAH|TERM\s+DEPOSIT|FIXED\s+DEPOSIT|FINANCE\s+ACT|KADAR\s+(?:ASAS|PEMBIAYAAN)|ISLAMIK?\s+\("
    r"|FINANCIAL\s+(?:SERVICES|MEDIATION|ACTIVITIES|INSTITUTION)|FINANCING-?I?\s+PRODUCTS"
)
#: Bank acronyms that are also parts of names after a patronymic.
PATRONYMIC = r"\b(?:BIN|BINTI|BT|BTE|A/L|A/P|S/O|D/O)\s+(BA|TL|TF|FD|CT)\b"
SNAP, MATCH, TOTALS_TOLERANCE = 50_000, 1, 6
CANDIDATES = {"opens": 10, "ends": 10, "debits": 15, "credits": 15}


def in_file():
    return Window.partitionBy("file").orderBy("row_ord")


def canonical(raw: DataFrame, default_bank: str) -> DataFrame:
    """Typed rows of raw strings; dates without year take the file's first printed year.

    A date that can't be read stays as text in ``date``.  A negative debit without
    credit is a credit and the other way round.  Either account column fills the other.
    """
    full = F.rlike("raw_date", F.lit(r"\b\d{4}\b"))
    years = raw.where(full).withColumn("y", F.year(parsed_date(F.col("raw_date")))).where("y IS NOT NULL")
    first = years.groupBy("file").agg(F.min_by("y", "row_ord").alias("year"))
    rows = raw.join(first, "file", "left")
    text = squash(F.col("raw_date"))
    day = parsed_date(F.when(full, text).otherwise(F.concat(text, F.lit("/"), F.col("year").cast("string"))))
    money = lambda c: F.coalesce(parsed_cents(F.col(c)), F.lit(0))
    d, c = money("raw_debit"), money("raw_credit")
    blank = lambda x: F.nullif(squash(F.col(x)), F.lit(""))
    return rows.select(
        "file", "row_ord", F.coalesce(F.date_format(day, "yyyy-MM-dd"), text).alias("date"), squash(F.col("description")).alias("description"),
        F.when((d < 0) & (c == 0), 0).when((c < 0) & (d == 0), -c).otherwise(d).alias("debit"),
        F.when((d < 0) & (c == 0), -d).when((c < 0) & (d == 0), 0).otherwise(c).alias("credit"),
        parsed_cents(F.col("raw_balance")).alias("balance"), F.coalesce(blank("bank"), F.lit(default_bank)).alias("bank"),
        F.coalesce(blank("account_no"), blank("account_number")).alias("account_no"),
        F.coalesce(blank("account_number"), blank("account_no")).alias("account_number"),
    )


def sided(rows: DataFrame, credit_words: str, debit_words: str) -> DataFrame:
    """credit and debit of unsigned amounts: by the balance's change if it is the amount, else by words, else by the change's sign."""
    delta = F.col("balance") - F.lag("balance").over(in_file())
    x = rows.withColumn("delta", delta).withColumn("_t", squash_upper(F.col("description")))
    side = (
        F.when((F.abs(F.abs("delta") - F.col("amount")) <= MATCH) & (F.col("delta") != 0), F.when(F.col("delta") > 0, "CR").otherwise("DR"))
        .when(F.rlike("_t", F.lit(credit_words)), "CR")
        .when(F.rlike("_t", F.lit(debit_words)), "DR")
    )
    x = x.withColumn("side", side)
    known = lambda s, v: F.when(F.col("side") == s, F.col("amount")).when(F.col("side").isNull(), v).otherwise(0)
    return x.select(
        "file", "row_ord", "side",
        known("CR", F.greatest(F.coalesce("delta", F.lit(0)), F.lit(0))).alias("credit"),
        known("DR", F.when(F.col("delta").isNull(), F.col("amount")).otherwise(F.greatest(-F.col("delta"), F.lit(0)))).alias("debit"),
    )


def snapped(rows: DataFrame) -> DataFrame:
    """Amounts within SNAP of the balance's change take the change, on its side."""
    delta = F.col("balance") - F.lag("balance").over(in_file())
    x = rows.withColumn("delta", delta).withColumn("had", F.when(F.col("credit") > 0, F.col("credit")).otherwise(F.col("debit")))
    near = F.coalesce((F.col("delta") != 0) & (F.col("had") > 0) & (F.abs(F.abs("delta") - F.col("had")) <= SNAP), F.lit(False))
    return x.select(
        "file", "row_ord", F.when(near, F.greatest("delta", F.lit(0))).otherwise(F.col("credit")).alias("credit"),
        F.when(near, F.greatest(-F.col("delta"), F.lit(0))).otherwise(F.col("debit")).alias("debit"), near.alias("snapped"),
    )


def anchored_balance(rows: DataFrame) -> DataFrame:
    """Running balance that starts again at every printed one."""
    x = rows.withColumn("anchor", F.count("printed").over(in_file()))
    since = Window.partitionBy("file", "anchor").orderBy("row_ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    moved = F.sum(F.when(F.col("printed").isNotNull(), F.col("printed")).otherwise(F.col("credit") - F.col("debit"))).over(since)
    return x.select("file", "row_ord", moved.alias("balance"))


def carried_dates(rows: DataFrame) -> DataFrame:
    """Rows without date take the last one before them in the file."""
    return rows.withColumn("date", F.last("date", ignorenulls=True).over(in_file().rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def date_faults(rows: DataFrame) -> DataFrame:
    """Rows whose date falls behind the one before: by about a year (a leaked year) or otherwise by more than 30 days."""
    back = F.datediff(F.lag("date").over(in_file()), F.col("date"))
    kind = F.when(F.col("back").between(330, 400), "YEAR_LEAK").when(F.col("back") > 30, "REGRESSION")
    return rows.withColumn("back", back).withColumn("fault", kind).where("fault IS NOT NULL").select("file", "row_ord", "back", "fault")


def is_synthetic(name: Column) -> Column:
    """Labels of buckets; null and blank names are, too."""
    n = F.upper(F.trim(F.coalesce(name, F.lit(""))))
    return (n == "") | n.isin(*SYNTHETIC) | F.rlike(n, F.lit(SYNTHETIC_FORM))


def is_fragment(name: Column) -> Column:
    """Names that are only months or words of purpose, have no letter, or at most two characters."""
    n = squash_upper(name)
    return (F.length(n) <= 2) | ~F.rlike(n, F.lit("[A-Z]")) | F.forall(F.split(n, " "), lambda w: w.isin(*MONTHS, *PURPOSES))


def loan_review(classified: DataFrame) -> DataFrame:
    """Rows without category and of some amount whose narrative looks like a facility and isn't prose about one."""
    t = F.upper("description")
    amount = F.greatest("credit", "debit")
    odd = F.col("primary").isNull() & F.rlike(t, F.lit(LOAN_SHAPED)) & ~F.rlike(t, F.lit(LOAN_NOISE)) & (amount > 0)
    return classified.where(odd).select("row_ord", "account", "side", amount.alias("amount"))


def statutory_bucket(description: Column, own_name: Column, credit: Column, buckets: tuple[tuple[str, str], ...]) -> Column:
    """The bucket whose pattern the narrative has; none on credits, or where the company's own name of four letters or more stands."""
    bare = lambda c: F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9]", "")
    own = (F.length(bare(own_name)) >= 4) & bare(description).contains(bare(own_name))
    found = reduce(lambda c, b: c.when(F.rlike(F.upper(description), F.lit(b[1])), b[0]), buckets[1:], F.when(F.rlike(F.upper(description), F.lit(buckets[0][1])), buckets[0][0]))
    return F.when((credit > 0) | own, F.lit(None).cast("string")).otherwise(found)


def patronymic_tokens(description: Column) -> Column:
    """Acronyms that stand right after a patronymic and so are parts of a name."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.upper(description), F.lit(PATRONYMIC), 1)))


def suffix_shares(rows: DataFrame) -> DataFrame:
    """Per file: rows with a printed sign, those marked DR, and their share in hundredths of a percent."""
    by = rows.groupBy("file").agg(F.count("sign").alias("signed"), F.count_if(F.upper("sign") == "DR").alias("dr_rows"))
    return by.withColumn("dr_share", F.when(F.col("signed") > 0, F.floor(F.col("dr_rows") * 10000 / F.col("signed"))).otherwise(0).cast("bigint"))


def month_summary(rows: DataFrame) -> DataFrame:
    """Per month over all files: sums, rows, and the sum of each file's last balance; files meet as one row a month each."""
    by = rows.groupBy("file", "month").agg(
        F.sum("credit").alias("c"), F.sum("debit").alias("d"), F.count("*").alias("n"), F.max_by("balance", "row_ord").alias("last"), F.min("balance").alias("low")
    )
    return by.groupBy("month").agg(
        F.sum("c").alias("credits"), F.sum("d").alias("debits"), (F.sum("c") - F.sum("d")).alias("net"), F.sum("n").alias("n_rows"),
        F.count("*").alias("files"), F.sum("last").alias("ending"), F.min("low").alias("lowest"),
    )


def statement_month(day: Column) -> Column:
    """The month that a statement dated ``day`` is for: the one before in its first week."""
    return F.date_format(F.add_months(F.trunc(day, "MM"), F.when(F.dayofmonth(day) <= 7, -1).otherwise(0)), "yyyy-MM")


def best_totals(files: DataFrame) -> DataFrame:
    """file and the opening, closing, debit and credit totals that fit best.

    ``opens``, ``ends``, ``debits``, ``credits`` are candidate amounts in order; the first
    CANDIDATES of each are combined inside the row.  Combinations within the tolerance
    come before others; then the least error counts, with a penalty where a small figure
    stands beside large ones; then the order of the candidates.
    """
    first = lambda c: F.slice(c, 1, CANDIDATES[c])

    def combos(o: Column, i: Column) -> Column:
        return F.flatten(F.transform(first("ends"), lambda e, j: F.flatten(F.transform(first("debits"), lambda d, k: F.transform(first("credits"), lambda c, m: _combo(o, e, d, c, i, j, k, m))))))

    best = F.array_min(F.flatten(F.transform(first("opens"), combos)))
    or_first = lambda got, c: F.coalesce(F.col(f"b.{got}"), F.get(c, 0))
    return files.withColumn("b", best).select(
        "file", or_first("o", "opens").alias("opening"), or_first("e", "ends").alias("ending"), or_first("d", "debits").alias("total_debit"),
        or_first("c", "credits").alias("total_credit"), F.coalesce(F.col("b.loose") == 0, F.lit(False)).alias("exact"),
    )


def _combo(o, e, d, c, i, j, k, m) -> Column:
    error = F.abs(o + c - d - e)
    artefact = (F.greatest(o, e, d, c) >= 1_000_000) & (F.least(o, e, d, c) < 100_000)
    return F.struct(
        (error > TOTALS_TOLERANCE).cast("int").alias("loose"), (error + F.when(artefact, 100_000).otherwise(0)).alias("score"),
        i.alias("i"), j.alias("j"), k.alias("k"), m.alias("m"), o.alias("o"), e.alias("e"), d.alias("d"), c.alias("c"),
    )


def first_spellings(names: DataFrame) -> DataFrame:
    """name by place: an ordered union in which later spellings of a name, whatever their case, go."""
    return names.where("trim(name) <> ''").groupBy(F.upper(F.trim("name")).alias("key")).agg(F.min(F.struct("place", "name")).alias("x")).select("x.place", "x.name")


def dollars(amount: Column) -> Column:
    """Cents as printed money."""
    return F.concat(F.lit("RM "), F.format_number(amount / 100, 2))


def percent(part: Column, whole: Column) -> Column:
    """A share with one decimal, rounded half up on integers; 0.0% of nothing."""
    tenths = F.when(whole != 0, F.floor((part * 2000 + whole) / (whole * 2))).otherwise(0).cast("bigint")
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("%"))
