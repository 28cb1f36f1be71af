"""Reports as nested JSON in two versions, read as one set of canonical frames.

``docs`` is one row per report: report, json.  The flat version holds the transactions,
months and counterparties as they were extracted; the sectioned one (it has
``report_info``) holds accounts, months and ranked parties.  One schema of both is read
in one pass, and only the fields that a frame asks for.  A text is parsed once for both
versions; a report is one row, so that its own lists are summed and ranked within it.

Money is BIGINT cents.  A null or broken text gives no rows; absent fields are empty or
0; equal amounts are ranked in the order of the report; other fields are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP_PARTIES, TOP_CREDITS = 10, 30
_PARTY = "array<struct<rank:int,party_name:string,total_amount:double,transaction_count:bigint,is_related_party:boolean,monthly_breakdown:array<struct<month:string,amount:double>>>>"
SCHEMA = f"""summary struct<company_names:array<string>,date_range:string>,
  transactions array<struct<account_no:string,bank:string,date:string,description:string,credit:double,debit:double,balance:double>>,
  monthly_summary array<struct<month:string,account_no:string,total_credit:double,total_debit:double,highest_balance:double,lowest_balance:double,opening_balance:double,ending_balance:double>>,
  counterparty_ledger struct<counterparties:array<struct<counterparty_name:string,total_credits:double,total_debits:double,credit_count:bigint,debit_count:bigint,transactions:array<struct<type:string,date:string,amount:double>>>>>,
  report_info struct<company_name:string,period_start:string,period_end:string,total_months:int>,
  accounts array<struct<bank_name:string,account_number:string,opening_balance:double,closing_balance:double,total_credits:double,total_debits:double,transaction_count:bigint>>,
  monthly_analysis array<struct<month:string,account_number:string,net_credits:double,net_debits:double,eod_lowest:double,eod_highest:double,opening_balance:double,closing_balance:double,transaction_count:bigint>>,
  consolidated struct<gross_credits:double,gross_debits:double>, large_credits array<struct<date:string,description:string,amount:double,balance:double,account_number:string>>,
  top_parties struct<top_payers:{_PARTY},top_payees:{_PARTY}>, observations string"""


def cents(c: Column) -> Column:
    return F.coalesce(F.round(c * 100).cast("long"), F.lit(0).cast("long"))


def _read(docs: DataFrame) -> DataFrame:
    return docs.select("report", F.from_json("json", SCHEMA).alias("d"))


FLAT = "d.report_info IS NULL AND coalesce(d.summary IS NOT NULL OR d.transactions IS NOT NULL OR d.monthly_summary IS NOT NULL OR d.counterparty_ledger IS NOT NULL, false)"


def _parsed(docs: DataFrame) -> DataFrame:
    """report, d, flat, told: every text parsed once, and which version it is, if any."""
    return _read(docs).withColumn("flat", F.expr(FLAT)).withColumn("told", F.col("d.report_info").isNotNull())


def _listed(parsed: DataFrame, flat: Column, told: Column) -> DataFrame:
    """report and the fields of the structs in the array that a text of each version gives."""
    return parsed.select("report", F.inline(F.when(F.col("flat"), flat).when(F.col("told"), told)))


def _struct(**fields: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def _both(docs: DataFrame, flat: str, sectioned: str) -> DataFrame:
    """report, flat (whether it is), pos, t (an item of the flat field) or s (of the sectioned one): both versions in one pass over the texts."""
    read = _parsed(docs)
    kind = dict(read.select(F.col(f"d.{flat}").alias("t"), F.col(f"d.{sectioned}").alias("s")).dtypes)
    of = lambda when, field, c: F.coalesce(F.when(F.col(when), F.col(f"d.{field}")), F.array().cast(kind[c]))
    read = read.select("report", "flat", of("flat", flat, "t").alias("t"), of("told", sectioned, "s").alias("s"))
    return read.select("report", "flat", F.posexplode(F.arrays_zip("t", "s")).alias("pos", "x")).select("report", "flat", "pos", F.col("x.t").alias("t"), F.col("x.s").alias("s"))


def _company(d: str = "d.summary.company_names") -> Column:
    return F.coalesce(F.get(F.col(d), F.lit(0)), F.lit("Unknown"))


def accounts(docs: DataFrame) -> DataFrame:
    """report, account, bank, opening, closing, credits, debits, n_rows: by the first and last row that shows a balance."""
    x, either = F.col, lambda a, b: F.when(F.col("flat"), a).otherwise(b)
    balance = F.when(x("t.balance").isNotNull(), cents(x("t.balance")))
    debit, credit = cents(either(x("t.debit"), x("s.total_debits"))), cents(either(x("t.credit"), x("s.total_credits")))
    # an account that a sectioned report tells is one row of its own
    rows = _both(docs, "transactions", "accounts").select(
        "report", "pos", either(None, x("pos")).alias("_told"), either(x("t.account_no"), x("s.account_number")).alias("account"), either(x("t.bank"), x("s.bank_name")).alias("bank"), credit.alias("cr"), debit.alias("dr"),
        either(balance - credit + debit, cents(x("s.opening_balance"))).alias("open"), either(balance, cents(x("s.closing_balance"))).alias("bal"), either(1, F.coalesce("s.transaction_count", F.lit(0))).cast("long").alias("n"), "flat",
    ).where("NOT flat OR account <> ''")
    shown = F.when(F.col("bal").isNotNull(), F.col("pos"))
    return rows.groupBy("report", "account", "_told").agg(
        F.coalesce(F.min_by("bank", F.when(F.col("bank") != "", F.col("pos"))), F.lit("")).alias("bank"),
        F.coalesce(F.min_by("open", shown), F.lit(0)).alias("opening"), F.coalesce(F.max_by("bal", shown), F.lit(0)).alias("closing"),
        F.sum("cr").alias("credits"), F.sum("dr").alias("debits"), F.sum("n").alias("n_rows"),
    ).drop("_told")


def months(docs: DataFrame) -> DataFrame:
    """report, place, month, account, credits, debits, lowest, highest, opening, closing, n_rows; a flat report's rows are those of the month in all accounts."""
    text, count = lambda c: F.coalesce(c, F.lit("")), lambda c: F.coalesce(c, F.lit(0)).cast("long")
    dated = lambda m: F.size(F.filter("d.transactions", lambda t: (F.left(t["date"], F.lit(7)) == m) & (F.length(m) == 7)))
    made = F.transform("d.monthly_summary", lambda x, i: _struct(
        place=i, month=text(x["month"]), account=text(x["account_no"]), credits=cents(x["total_credit"]), debits=cents(x["total_debit"]), lowest=cents(x["lowest_balance"]),
        highest=cents(x["highest_balance"]), opening=cents(x["opening_balance"]), closing=cents(x["ending_balance"]), n_rows=F.greatest(count(dated(x["month"])), F.lit(0)),
    ))
    said = F.transform("d.monthly_analysis", lambda x, i: _struct(
        place=i, month=text(x["month"]), account=text(x["account_number"]), credits=cents(x["net_credits"]), debits=cents(x["net_debits"]), lowest=cents(x["eod_lowest"]),
        highest=cents(x["eod_highest"]), opening=cents(x["opening_balance"]), closing=cents(x["closing_balance"]), n_rows=count(x["transaction_count"]),
    ))
    return _listed(_parsed(docs), made, said)


def totals(docs: DataFrame) -> DataFrame:
    """report, version, company, period_start, period_end, n_months, credits, debits, yearly_credits, yearly_debits (at twelve months)."""
    dates = F.split("d.summary.date_range", " to ", 2)
    end = lambda i: F.coalesce(F.when(F.contains("d.summary.date_range", F.lit(" to ")), F.trim(F.get(dates, F.lit(i)))), F.lit(""))
    summed = lambda c: F.coalesce(F.aggregate("d.transactions", F.lit(0).cast("long"), lambda a, t: a + cents(t[c])), F.lit(0))
    info = lambda c, other="": F.coalesce(f"d.report_info.{c}", F.lit(other))
    made = _struct(
        version=F.lit("flat"), company=_company(), period_start=end(0), period_end=end(1), n_months=F.greatest(F.coalesce(F.size("d.monthly_summary"), F.lit(0)), F.lit(0)), credits=summed("credit"), debits=summed("debit"),
    )
    said = _struct(
        version=F.lit("sectioned"), company=info("company_name", "Unknown"), period_start=info("period_start"), period_end=info("period_end"), n_months=info("total_months", 0),
        credits=cents(F.col("d.consolidated.gross_credits")), debits=cents(F.col("d.consolidated.gross_debits")),
    )
    both = _listed(_parsed(docs), F.array(made), F.array(said))
    yearly = lambda c: F.when(F.col("n_months") > 0, F.round(F.col(c) * 12 / F.col("n_months")).cast("long")).otherwise(0)
    return both.withColumn("yearly_credits", yearly("credits")).withColumn("yearly_debits", yearly("debits"))


def _by_month(transactions: Column, side: str) -> Column:
    """month:cents of one side, in order of month; a party's months are few."""
    own = F.filter(F.coalesce(transactions, F.array().cast("array<struct<type:string,date:string,amount:double>>")), lambda t: (F.upper(t["type"]) == side) & (F.length(t["date"]) >= 7))
    total = lambda m: F.aggregate(F.filter(own, lambda t: F.left(t["date"], F.lit(7)) == m), F.lit(0).cast("long"), lambda a, t: a + cents(t["amount"]))
    return F.array_join(F.transform(F.array_sort(F.array_distinct(F.transform(own, lambda t: F.left(t["date"], F.lit(7))))), lambda m: F.concat_ws(":", m, total(m))), ";")


def parties(docs: DataFrame, top: int = TOP_PARTIES) -> DataFrame:
    """report, side (payer or payee), rank, party, amount, n_rows, related, by_month: the ``top`` of each side.

    A party is related if a word of four letters or more of the company's name stands in its own.
    """
    own = F.filter(F.split(F.upper(_company()), r"\s+"), lambda w: F.length(w) >= 4)
    name, count = lambda c: F.coalesce(c, F.lit("")), lambda c: F.coalesce(c, F.lit(0)).cast("long")

    def made(money: str, counted: str, kind: str) -> Column:
        by_sum = F.array_sort(F.transform("d.counterparty_ledger.counterparties", lambda x, i: _struct(by=-cents(x[money]), pos=i, x=x)))
        return F.transform(F.slice(by_sum, 1, top), lambda y, i: _struct(
            rank=i + 1, party=name(y["x"]["counterparty_name"]), amount=-y["by"], n_rows=count(y["x"][counted]),
            related=F.exists(own, lambda w: F.contains(F.upper(name(y["x"]["counterparty_name"])), w)), by_month=_by_month(y["x"]["transactions"], kind),
        ))

    def said(field: str) -> Column:
        months_of = lambda x: F.array_join(F.transform(x["monthly_breakdown"], lambda m: F.concat_ws(":", m["month"], cents(m["amount"]))), ";")
        return F.transform(f"d.top_parties.{field}", lambda x, i: _struct(
            rank=F.coalesce(x["rank"], i + 1), party=name(x["party_name"]), amount=cents(x["total_amount"]), n_rows=count(x["transaction_count"]),
            related=F.coalesce(x["is_related_party"], F.lit(False)), by_month=name(months_of(x)),
        ))

    sides = lambda payer, payee: F.array(_struct(side=F.lit("payer"), _p=payer), _struct(side=F.lit("payee"), _p=payee))
    flat = sides(made("total_credits", "credit_count", "CREDIT"), made("total_debits", "debit_count", "DEBIT"))
    return _listed(_parsed(docs), flat, sides(said("top_payers"), said("top_payees"))).select("report", "side", F.inline("_p"))


def large_credits(docs: DataFrame, top: int = TOP_CREDITS) -> DataFrame:
    """report, place (from 1), date, description, amount, balance, account: the ``top`` credits of a report."""
    x, either = F.col, lambda c: F.when(F.col("flat"), F.col(f"t.{c}")).otherwise(F.col(f"s.{c}"))
    amount, account = (F.when(x("flat"), x(f"t.{a}")).otherwise(x(f"s.{b}")) for a, b in (("credit", "amount"), ("account_no", "account_number")))
    rows = _both(docs, "transactions", "large_credits").select("report", "flat", "pos", either("date").alias("date"), either("description").alias("description"), cents(amount).alias("amount"), cents(either("balance")).alias("balance"), account.alias("account"))
    ranked = F.row_number().over(Window.partitionBy("report", "flat").orderBy(x("amount").desc(), "pos"))
    placed = rows.where("NOT flat OR amount > 0").withColumn("place", F.when(x("flat"), ranked).otherwise(x("pos") + 1)).where(f"NOT flat OR place <= {int(top)}")
    return placed.select("report", "place", "date", "description", "amount", "balance", "account")


# Names under which a remark keeps its kind and its text, and kinds that are good.
KIND_NAMES, TEXT_NAMES = ("type", "category", "sentiment"), ("text", "observation", "message", "description")
GOOD = ("positive", "pos", "good", "strength")


def observations(docs: DataFrame) -> DataFrame:
    """report, kind (positive or concern), place, text.

    Remarks come as an object of two lists, as a list of texts (concerns), or as a list of
    objects whose kind and text have several names; objects without text are left out.
    A listed text that begins with { is taken for an object.
    """
    read = _read(docs).select("report", F.col("d.observations").alias("o"))
    lists = read.where("o LIKE '{%'").select("report", F.from_json("o", "positive array<string>, concerns array<string>").alias("o"))
    kinds = [lists.select("report", F.lit(kind).alias("kind"), F.posexplode(f"o.{field}").alias("place", "text")) for kind, field in (("positive", "positive"), ("concern", "concerns"))]
    each = read.where("o LIKE '[%'").select("report", F.posexplode(F.from_json("o", "array<string>")).alias("place", "x"))
    fields = F.from_json("x", ", ".join(f"{n} string" for n in KIND_NAMES + TEXT_NAMES))
    named = lambda names: F.coalesce(*[F.when(F.col(f"f.{n}") != "", F.col(f"f.{n}")) for n in names], F.lit(""))
    made = each.withColumn("f", F.when(F.startswith("x", F.lit("{")), fields)).select(
        "report", "place", F.when(F.col("f").isNull(), "").otherwise(F.lower(named(KIND_NAMES))).alias("k"), F.when(F.col("f").isNull(), F.col("x")).otherwise(named(TEXT_NAMES)).alias("text"), F.col("f").isNull().alias("plain")
    )
    made = made.where("text IS NOT NULL AND (plain OR text <> '')").select("report", F.when(F.col("k").isin(*GOOD), "positive").otherwise("concern").alias("kind"), "place", "text")
    return kinds[0].unionByName(kinds[1]).unionByName(made)


def value_at(item: Column, period: Column, default: int = 0) -> Column:
    """An item's figure of a period: from its values if it has any, else its standard values, else those of its amount.

    ``item`` is struct(values, values_standard, amount struct(values)) of maps by period.
    """
    some = lambda m: F.coalesce(F.size(m) > 0, F.lit(False))
    got = F.when(some(item["values"]), F.try_element_at(item["values"], period)).when(some(item["values_standard"]), F.try_element_at(item["values_standard"], period))
    return F.coalesce(got.otherwise(F.try_element_at(item["amount"]["values"], period)), F.lit(default))


def truths(docs: DataFrame) -> DataFrame:
    """file, credits, debits, opening, closing of texts that hold an object of files: null where a figure isn't known."""
    held = docs.select(F.explode(F.from_json("json", "map<string,struct<total_credit:double,total_debit:double,opening_balance:double,ending_balance:double>>")).alias("file", "x"))
    known = lambda c: F.when(F.col(c).isNotNull(), cents(F.col(c)))
    return held.select("file", known("x.total_credit").alias("credits"), known("x.total_debit").alias("debits"), known("x.opening_balance").alias("opening"), known("x.ending_balance").alias("closing"))


def audited(known: DataFrame, parsed: DataFrame, tolerance: int = 1) -> DataFrame:
    """file, figure, truth, found, status: printed figures against parsed ones, files of either side.

    MATCH up to ``tolerance`` cents, DIFFERS, NOT_PARSED, or NO_TRUTH where nothing is known of a file; figures that neither side has give no row.
    """
    figures = ("credits", "debits", "opening", "closing")
    t, p = (df.select("file", *[F.col(c).alias(f"{s}_{c}") for c in figures]) for s, df in (("t", known), ("p", parsed)))
    both = t.join(p, "file", "full").select("file", F.explode(F.array(*[F.struct(F.lit(c).alias("figure"), F.col(f"t_{c}").alias("truth"), F.col(f"p_{c}").alias("found")) for c in figures])).alias("x")).select("file", "x.*")
    status = F.when(F.col("truth").isNull(), "NO_TRUTH").when(F.col("found").isNull(), "NOT_PARSED").when(F.abs(F.col("truth") - F.col("found")) <= tolerance, "MATCH").otherwise("DIFFERS")
    return both.where("truth IS NOT NULL OR found IS NOT NULL").withColumn("status", status)
