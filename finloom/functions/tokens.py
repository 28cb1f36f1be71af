"""Functions on words of narratives: repeated blocks, purposes in front, names at the end.

Words are an array of strings, as ``words`` splits them; a null text has none.  Only
array functions are used: a block that comes again is found by the first place of each
run of words, not by a pattern.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from finloom.functions.binding import bound
from finloom.functions.text import squash

# Words of purpose and date in front of a name.
PURPOSES = (
    "FUND", "TRANSFER", "REFUND", "BAKI", "SUMBANGAN", "PERUNTUKAN", "PAYMENT", "BALANCE", "PK", "PMB", "INV", "IV", "QT", "QTR", "SDR", "YE", "I", "FEE", "SEC", "MILESTONE", "COMPLET",
    "JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "SEPT", "OCT", "NOV", "DEC",
    "JANUARY", "FEBRUARY", "MARCH", "APRIL", "JUNE", "JULY", "AUGUST", "SEPTEMBER", "OCTOBER", "NOVEMBER", "DECEMBER",
)
# What may stand among the words of a name, and tokens that end one.
BRIDGES = ("&", "(M)", "(SARAWAK)", "(MALAYSI", "(SAR", "(L")
STOP_TOKEN = r"^(?:[A-Z]{1,3}[0-9]{3,5}|QTR[0-9]+|QT[0-9]+|CP_[0-9]+_[0-9]+|F[0-9]{2}[A-Z][0-9]+|[0-9]{5,})$"
BANK_FOOTER = r"(?i)\s+Hong\s+Leong\s+(?:Islamic\s+)?Bank.*$"
LONGEST_PREFIX, LONGEST_BLOCK = 8, 6


def words(c: Column) -> Column:
    return F.array_remove(F.split(squash(c), " "), "")


def _text(ws: Column) -> Column:
    return F.array_join(ws, " ")


def _last(ws: Column, test) -> Column:
    """How many words there are up to the last one that passes the test."""
    return F.coalesce(F.array_max(F.transform(ws, lambda w, i: F.when(test(w), i + 1))), F.lit(0))


def _first(ws: Column, test) -> Column:
    """Place of the first word that passes the test, the number of words if none does."""
    return F.coalesce(F.array_min(F.transform(ws, lambda w, i: F.when(test(w), i))), F.size(ws))


def without_trailing_references(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+[0-9/]{3,}.*$", ""))


def without_stop_tokens(ws: Column) -> Column:
    """The words without plates and numbers at their end."""
    return bound(ws, lambda x: F.slice(x, 1, _last(x, lambda w: ~F.rlike(w, F.lit(STOP_TOKEN)))))


def without_repeated_prefix(ws: Column, most: int = LONGEST_PREFIX) -> Column:
    """What follows a prefix of up to ``most`` words that stands twice; the longest such prefix counts."""
    same = lambda x, k: (F.size(x) >= 2 * k) & (F.slice(x, 1, k) == F.slice(x, k + 1, k))
    rest = lambda x, k: F.slice(x, 2 * k + 1, F.size(x))
    cases = lambda x: reduce(lambda w, k: w.when(same(x, k), rest(x, k)), range(most - 1, 0, -1), F.when(same(x, most), rest(x, most)))
    return bound(ws, lambda x: F.when(F.size(x) > 0, cases(x).otherwise(x)).otherwise(x))


def repeated_block_end(ws: Column, most: int = LONGEST_BLOCK) -> Column:
    """The place after the last repeat of the longest block that stands twice, apart; 0 for none.

    Blocks have up to ``most`` words; a single character isn't one, nor do fewer than four words hold any.
    """

    def ends(x: Column, k: int) -> Column:
        n = F.size(x)
        runs = F.transform(F.sequence(F.lit(0), n - k), lambda i: _text(F.slice(x, i + 1, k)))
        kept = lambda r: F.length(r) > 1 if k == 1 else F.lit(True)
        again = lambda rs: F.array_max(F.transform(rs, lambda r, b: F.when(kept(r) & (F.array_position(rs, r) - 1 + k <= b), b + k)))
        return F.when(n >= 2 * k, bound(runs, again))

    return bound(ws, lambda x: F.when(F.size(x) >= 4, F.coalesce(*[ends(x, k) for k in range(most, 0, -1)], F.lit(0))).otherwise(0))


def without_purpose_prefix(ws: Column) -> Column:
    """The words from the first on that is no purpose, date, number or reference; AND and & go too, after one of these."""
    bare = lambda w: F.trim(w, F.lit("().,"))
    purpose = lambda w: F.upper(bare(w)).isin(*PURPOSES) | F.rlike(bare(w), F.lit("^[A-Z0-9/.-]*[0-9][A-Z0-9/.-]*$"))
    link = lambda w: F.upper(bare(w)).isin("AND", "&")

    def body(x: Column) -> Column:
        name = _first(x, lambda w: ~purpose(w) & ~link(w) & (bare(w) != ""))
        early = F.when(_first(x, link) < _first(x, purpose), _first(x, link)).otherwise(F.size(x))
        return F.slice(x, F.least(name, early) + 1, F.size(x))

    return bound(ws, body)


def tail_of_letters(ws: Column, least: int = 2) -> Column:
    """The words of letters at the end, as text; empty if fewer than ``least``, each of as many letters."""

    def body(x: Column) -> Column:
        alone = lambda w: F.rlike(F.trim(w, F.lit("().,&")), F.lit(rf"^\p{{L}}{{{least},}}$")) | w.isin(*BRIDGES)
        at = _last(x, lambda w: ~alone(w))
        return F.when(F.size(x) - at >= least, _text(F.slice(x, at + 1, F.size(x)))).otherwise("")

    return bound(ws, body)


def has_real_word(c: Column) -> Column:
    """Whether three capitals or more stand together that aren't all X."""
    return F.exists(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[A-Z]+"), F.lit(0)), lambda w: (F.length(w) >= 3) & ~F.rlike(w, F.lit("^X+$")))


def name_at_end(c: Column, capitals: bool = False) -> Column:
    """The words without digits that end a body, less numbers and single signs after them.

    & may stand between them.  With ``capitals`` every word of it is in capitals.
    """
    noise = lambda w: (w == "_") | F.rlike(w, F.lit("^[0-9,.]+$")) | ((F.length(w) == 1) & ~F.rlike(w, F.lit(r"^\p{L}$")))
    cased = (lambda w: F.rlike(w, F.lit(r"\p{Lu}")) & ~F.rlike(w, F.lit(r"\p{Ll}"))) if capitals else (lambda w: F.rlike(w, F.lit(r"\p{L}")))
    named = lambda w: (cased(w) & ~F.rlike(w, F.lit("[0-9]"))) | (w == "&")

    def body(x: Column) -> Column:
        kept = F.slice(x, 1, _last(x, lambda w: ~noise(w)))
        return bound(kept, lambda y: F.rtrim(_text(F.slice(y, _last(y, lambda w: ~named(w)) + 1, F.size(y))), F.lit(".,;:&")))

    return bound(words(F.regexp_replace(F.trim(c), BANK_FOOTER, "")), body)
