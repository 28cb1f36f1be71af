"""Transaction categories by an ordered ladder of predicates, compiled into one CASE.

The rules below are data: category, side, pattern, pattern that forbids it, and
whether the hit is a heuristic.  ``ladder`` turns them into one Spark expression
over upper-cased narratives; the first hit wins.  Patterns are the published ones, but
for lookaround: where they look around a term for letters, these match the neighbour,
so that engines without lookaround (the SQL that the tests compare with) read them too.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finloom.functions.text import PERSON, is_corporate, squash_upper

# Patterns of the published rule set, over upper-case text.
BALANCE = r"^\s*(?:OPENING|CLOSING|PREVIOUS|STATEMENT)\s+BALANCE\b|^\s*BAL(?:ANCE)?\s*[BC]/F\b|^\s*B/F\b|^\s*C/F\b|^\s*(?:BROUGHT|CARRIED)\s+FORWARD\b"
OWN_MARKER = r"\(\s*OWN[\s\-_]?PARTY\s*\)"
EPF = r"KUMPULAN WANG SIMPAN(?:AN PEKERJA)?|EPF DPE|\bEPF\b|\bKWSP(?:\s|[/\-]|$)"
SOCSO = r"\b(?:SOCSO|PERKESO|PERTUBUHAN\s+KESELAM(?:AT(?:AN)?|A)(?:\s+SOSIAL)?|EIS)\b|\bFPX\s*B2B\s+PERTUBUH(?:\s|$|/|-)|\bPERTUBUH(?:AN)?\s+CP(?:[_\s]|$)"
TAX = r"LEMBAGA HASIL(?:\s+DALAM NEGERI)?|\bLHDN\b"
HRDF = r"PEMBANGUNAN SUMBER M(?:ANUSIA)?|\bPSMB\b|\bHRDF\b"
SALARY = (
    r"(?:^|[^A-Z])(?:SALAR(?:Y|IES)|GAJI\s+(?:BULANAN|BLN|JAN|FEB|MAR|MAC|APR|MAY|MEI|JUN|JUL|AUG|OGOS|SEP|SEPT|OCT|OKT|NOV|DEC|DIS)"
    r"|(?:BAYARAN|PEMBAYARAN)\s+GAJI|STAFF\s+(?:SALARY|INCENTIVE|OVERTIME|BONUS|ADVANCE)|EXTRA\s+SALARY|GUARD\s+SALARY|PMT\s+SLRY|SLRY|PAYROLL"
    r"|NET\s+PAY|AUTOPAY\s+DR)(?:$|[^A-Z])"
)
#: Month names and staff numbers glued to their keyword, as some banks print them.
SALARY_GLUED = (
    r"(?:^|[^A-Z])(?:GAJI(?:BULANAN|JANUARI|JAN|FEBRUARI|FEB|MAC|MAR|APRIL|APR|MEI|MAY|JUN|JULAI|JUL|OGOS|AUG|SEPTEMBER|SEPT|SEP|OKTOBER|OCTOBER|OKT|OCT"
    r"|NOVEMBER|NOV|DECEMBER|DISEMBER|DEC|DIS)\d{0,4}|STAFFID\d+)(?:$|[^A-Z])"
)
SALARY_BLOCK = (
    r"\bCOMMS?\b|\bCOMMIS(?:S)?ION(?:S|ED|ING)?\b|\bKOMIS(?:E|YE)N\b|\bHABUAN\b"
    r"|\bOWN\s+ACC(?:OUNT)?\s+TXN\b|\bINTER\s+ACC(?:OUNT)?\s+TXN\b|\bOWN\s+ACCOUNT\s+TRANSFER\b"
    r"|\b(?:CIBSMSFEE|CIBDRCHARGES|DUITNOWFEE|IBGFEE|SMSFEE)\b"
)
DISBURSEMENT = (
    r"\bLOAN DISB|\bFINANCING DISB|\bTRADE FINANCE CR\b|\bTRADE FIN\b|\bSCF TRADE\b|\bFACTORING\b|\bINVOICE FIN\b|\bINVOICE DISCOUNT\b"
    r"|\bBILL PURCHAS|\bBILL DISCOUNT\b|\bBANKERS ACCEPTANCE\b|\bFACILITY DRAWDOWN\b|\bLOANS?/FIN\b|\bFUNDING\s+SOCIET|\bCAPBAY\b|\bFUNDAZTIC\b|\bMICROLEAP\b"
)
REPAYMENT = (
    r"\bTERM LOAN\b|\bLOAN REPAY|\bFINANCING REPAY|\bMONTHLY INSTALMENT\b|\bIB2G\s+DR\s+CA\s+CR\s+LN\b|\bTRANSFER TO LOAN\b|\bDD CASA PYMT\b"
    r"|\bFINPAL ISSUER REPAYM|\bLOANS?/FIN\b|\bLOAN PYMT\b|\bREPAYMENT LOAN\b|\bHIRE\s*PURCHASE\b|\bHP\s+LOAN\b|\bFUNDING\s+SOCIET|\bCAPBAY\b|\bFUNDAZTIC\b|\bMICROLEAP\b"
)
FINANCIER = r"\b[A-Z][A-Z0-9&./-]*\s+(?:CREDIT|CAPITAL|LEASING|FINANCE|FINANCING)\b"
NO_FINANCIER = (
    r"\b(?:INSURANCE|TAKAFUL|GUARANTEE|ATM|GIRO|CASH|WDRWL|WITHDRAW(?:AL)?|FEES?|INTERBANK|VELOCITY|RINGKASAN|SAL(?:ARY)?|PAYROLL|DEPOSIT"
    r"|REVERSAL|REFUND)\b|SERVICE\s+CHARGE"
)
REVERSAL = r"REVERSAL|REVERSED|REV\s+CR|CREDIT\s+REVERSAL"
RETURNED = r"RETURN(?:ED)?\s+CHQ|CHQ\s+RETURN|DISHONOUR"
INWARD_RETURN = r"IBG\s+INWARD\s+RETURN|GIRO\s+INWARD\s+RETURN"
CASH_IN = r"(?:CDM\s+)?CASH\s+DEPOSIT"
CASH_OUT = r"CASH\s+CHQ\s+DR"
CHEQUE_IN = r"HSE\s+CHQ\s+DEPOSIT|2D\s+LOCAL\s+CHQ|CHQ\s+DEPOSIT|CHEQUE\s+DEPOSIT"
CHEQUE_OUT = r"HOUSE\s+CHQ\s+DR|CLRG\s+CHQ\s+DR|INWARD\s+CLEARING\s+CHQ\s+DEBIT"
FEES = (
    r"AUTOPAY CHARGES|OTHER TRANSFER FEE|CH(?:Q|EQUE)\s+PROCESS(?:ING)?\s+FEE|3RD PARTY CHEQUE|ACCOUNT STATUS CONFIRM|SERVICE TAX \d+%|STAMP DUTY"
    r"|CABLE CHARGE|NOSTRO CHARGE|MAS SERVICE CHARGE|AGENT CHARGES|CMS - DR CORP CHG|HANDLING\s+CHRG|CHEQ(?:UE)?\s+STAMP\s+FEE"
    r"|RFLX\s+INSTANT\s+TRF\s+SC|RFLX\s*/\s*CM\d+|REFLEX-\s*/\s*CM\d+|CHQ\s+SVC|SERVICE\s+CASH\s+CHQ|SERVICE\s+CHARGES-OTHERS|BANKERS\s+REFER\s+CHARGES"
)
UTILITY = r"CIBDRADVICE\(JOMPA\b.*\b(?:DIGITELECOMMUNI|TENAGANASIONAL|PENGURUSANAIRS|INDAHWATERKONS|TMTECHNOLOGYSE)"
FX_NOT = r"\bRENTAS\b|\bJANM\b|\bDUITNOW\b|\bFPX\b|\bJOMPAY\b|\b(?:GBP|USD|EUR|SGD|MYR|HKD|AUD|JPY|CNY)[A-Z]\d|\bIBG\b|\bIBFT\b"
FX = (
    r"\bFOREX\b|\bFX\s*CONV|\bFOREIGN\s+EXCHANGE\b|\bSWIFT\b|\bCURRENCY\s+CONVER|\b(?:BOUGHT|SOLD)\s+(?:USD|EUR|GBP|SGD|HKD|AUD|JPY|CNY)"
    r"|\b(?:USD|EUR|GBP|SGD|HKD|AUD|JPY|CNY)\s+[0-9,]"
)
#: Buckets that a counterparty name can stand for.
BUCKETS = {
    "BULK SALARY": "C05", "BANK FEES": "C24", "KWSP": "C06", "SOCSO": "C07", "LHDN": "C08", "HRDF": "C09", "LOAN REPAYMENT": "C11",
    "LOAN DISBURSEMENT": "C10", "FD/INTEREST": "C12", "CASH DEPOSIT": "C17", "CASH WITHDRAWAL": "C18", "CHEQUE DEPOSIT": "C19",
    "CHEQUE ISSUE": "C20", "INWARD RETURN": "C16",
}
#: The side that each category needs.
SIDES = {
    "C01": "CR", "C02": "DR", "C03": "CR", "C04": "DR", "C05": "DR", "C06": "DR", "C07": "DR", "C08": "DR", "C09": "DR", "C10": "CR",
    "C11": "DR", "C12": "CR", "C13": "CR", "C14": "DR", "C15": "CR", "C16": "CR", "C17": "CR", "C18": "DR", "C19": "CR", "C20": "DR",
    "C24": "ANY", "C25": "ANY", "C26": "CR", "C27": "DR",
}
#: Names that are no parties.
GHOSTS = (
    "TRANSFER FR A/C", "TRANSFER TO A/C", "TRANSFER FROM A/C", "PAYMENT FR A/C", "PAYMENT TO A/C", "PAYMENT FROM A/C",
    "INTER-BANK PAYMENT INTO A/C", "INTERBANK PAYMENT INTO A/C", "INTER-BANK PAYMENT FR A/C", "INTERBANK PAYMENT FR A/C",
    "INTER-BANK PAYMENT FROM A/C", "INTERBANK PAYMENT FROM A/C",
)
#: Buckets of cheques and cash that are no parties unless asked for.
CHEQUE_BUCKETS = ("HSE CHQ DEPOSIT", "CDM CASH DEPOSIT", "2D LOCAL CHQ", "CASH CHQ DR")
#: Words of a JomPAY narrative that name nobody.
JOMPAY_WORDS = (
    "JOMPAY", "BILL", "PAYMENT", "PAYMENTS", "AT", "DIO", "DEBIT", "CREDIT", "TRANSFER", "TRANSFERS", "TXN", "REF", "FR", "TO", "VIA", "CR", "DR", "NO",
    "FOR", "OF",
)


@dataclass(frozen=True)
class Rung:
    code: str
    side: str
    pattern: str
    unless: str | None = None
    mode: str = "KEYWORD"
    guarded: bool = False


#: From the statutory rungs on; the rungs before them look at parties.
RUNGS = (
    Rung("C06", "DR", EPF, guarded=True), Rung("C07", "DR", SOCSO, guarded=True), Rung("C08", "DR", TAX, guarded=True),
    Rung("C09", "DR", HRDF, guarded=True), Rung("C10", "CR", DISBURSEMENT), Rung("C11", "DR", REPAYMENT, FEES),
    Rung("C13", "CR", REVERSAL), Rung("C14", "DR", RETURNED), Rung("C15", "CR", RETURNED), Rung("C16", "CR", INWARD_RETURN),
    Rung("C17", "CR", CASH_IN), Rung("C18", "DR", CASH_OUT), Rung("C19", "CR", CHEQUE_IN), Rung("C20", "DR", CHEQUE_OUT),
    Rung("C24", "DR", FEES), Rung("C27", "DR", UTILITY),
)

#: Detectors over single narratives: name, side, pattern, pattern that forbids it.
DETECTORS = {
    "detect_returned_cheques": Rung("C14", "ANY", RETURNED), "detect_epf": Rung("C06", "DR", EPF), "detect_socso": Rung("C07", "DR", SOCSO),
    "detect_tax": Rung("C08", "DR", TAX), "detect_hrdf": Rung("C09", "DR", HRDF), "detect_salary": Rung("C05", "DR", f"{SALARY}|{SALARY_GLUED}", SALARY_BLOCK),
    "detect_reversals": Rung("C13", "CR", REVERSAL), "detect_inward_returns": Rung("C16", "CR", INWARD_RETURN),
    "detect_cash_deposits": Rung("C17", "CR", CASH_IN), "detect_cash_withdrawals": Rung("C18", "DR", CASH_OUT),
    "detect_cheque_deposits": Rung("C19", "CR", CHEQUE_IN), "detect_cheque_issues": Rung("C20", "DR", CHEQUE_OUT),
    "detect_fees": Rung("C24", "DR", FEES), "detect_fx": Rung("FX", "ANY", FX, FX_NOT),
}


def side_of() -> Column:
    return F.when((F.col("credit") > 0) & (F.col("debit") <= 0), "CR").when((F.col("debit") > 0) & (F.col("credit") <= 0), "DR")


def _has(c: Column, pattern: str | None) -> Column:
    return F.rlike(c, F.lit(pattern)) if pattern else F.lit(False)


def hit(rung: Rung, text: Column, side: Column) -> Column:
    right = F.lit(True) if rung.side == "ANY" else side == rung.side
    return F.coalesce(right & _has(text, rung.pattern) & ~_has(text, rung.unless), F.lit(False))


def biller_code_only(text: Column) -> Column:
    """A narrative that starts with JOMPAY and has no word of letters that could be a name."""
    names = F.filter(F.split(text, r"[\s,/\-]+"), lambda w: F.rlike(w, F.lit("^[A-Z]{2,}$")) & ~w.isin(*JOMPAY_WORDS))
    return F.rlike(text, F.lit(r"^\s*JOMPAY\b")) & (F.size(names) == 0)


def _own(text: Column, party: Column, companies) -> Column:
    """A company root of five characters in the narrative or the party, or a party of six within a root."""
    tests = [F.lit(False)]
    for root in companies:
        root = F.lit(root)
        tests.append((F.length(root) >= 5) & (text.contains(root) | party.contains(root)))
        tests.append((F.length(party) >= 6) & root.contains(party))
    return reduce(lambda a, b: a | b, tests)


def narrative_sums(tx: DataFrame) -> DataFrame:
    """account, month, description, counterparty, side, n, amount, credits, debits: rows that the ladder can't tell apart, as one."""
    return tx.groupBy("account", "month", "description", "counterparty", side_of().alias("side")).agg(
        F.count("*").alias("n"), F.sum(F.greatest("credit", "debit")).alias("amount"), F.sum("credit").alias("credits"), F.sum("debit").alias("debits")
    )


def classified(tx: DataFrame, companies: tuple = (), related: tuple = (), factors: tuple = ()) -> DataFrame:
    """The rows with ``side`` (by their amounts, if they don't have it), ``primary`` (category or null) and ``mode``.

    ``companies`` are roots as by ``company_root``; names are matched in upper case.
    """
    sided = tx if "side" in tx.columns else tx.withColumn("side", side_of())
    named = sided.withColumn("_t", squash_upper(F.col("description"))).withColumn(
        "_p", squash_upper(F.col("counterparty"))
    )
    t, p, side = F.col("_t"), F.col("_p"), F.col("side")
    said = lambda code, mode: F.struct(F.lit(code).cast("string").alias("code"), F.lit(mode).cast("string").alias("mode"))
    either = lambda cr, dr, mode: F.when(side == "CR", said(cr, mode)).otherwise(said(dr, mode))
    any_of = lambda names: reduce(lambda a, b: a | b, [t.contains(n) | p.contains(n) for n in names], F.lit(False))
    loan_memo = (p != "") & ~_own(p, p, companies) & (_has(t, DISBURSEMENT) | _has(t, REPAYMENT))
    out = F.when(_has(t, BALANCE), said("C25", "KEYWORD"))
    out = out.when(side.isNotNull() & _has(p, OWN_MARKER), either("C01", "C02", "PARTY"))
    out = out.when(side.isNotNull() & _own(t, p, companies) & ~loan_memo, either("C01", "C02", "PARTY"))
    out = out.when(hit(DETECTORS["detect_salary"], t, side), said("C05", "KEYWORD"))
    out = out.when(side.isNotNull() & any_of(related), either("C03", "C04", "PARTY"))
    for name, code in BUCKETS.items():
        right = side.isNotNull() if SIDES[code] == "ANY" else side == SIDES[code]
        out = out.when((p == name) & right, said(code, "BUCKET"))
    for rung in RUNGS:
        if rung.code == "C13":
            lender = (side == "DR") & _has(p, FINANCIER) & ~_has(p, NO_FINANCIER) & ~_has(p, PERSON) & ~_has(t, FEES)
            out = out.when(lender, said("C11", "HEURISTIC"))
        test = hit(rung, t, side)
        if rung.guarded:
            test = test & ~biller_code_only(t)
        if rung.code == "C10":
            test = test | ((side == "CR") & p.isin(*factors) if factors else F.lit(False))
        out = out.when(test, said(rung.code, rung.mode))
    out = out.when(side.isNotNull() & is_corporate(p) & ~_has(p, PERSON), either("C26", "C27", "HEURISTIC")).otherwise(said(None, None))
    # one generated row, so that the optimizer can't copy the ladder into every later use of the category
    return named.select(*sided.columns, F.inline(F.array(out)).alias("primary", "mode"))


def detected(tx: DataFrame, rung: Rung) -> DataFrame:
    """Per account and month: rows that a detector finds, and their sum."""
    found = tx.withColumn("side", side_of()).where(hit(rung, squash_upper(F.col("description")), F.col("side")))
    return found.groupBy("account", "month").agg(
        F.count("*").alias("hits"), F.sum(F.greatest("credit", "debit")).alias("amount"), F.min("row_ord").alias("first_row")
    )

