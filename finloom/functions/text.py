"""Text functions: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Legal forms at the end of company names.
SUFFIX = r"\s+(SDN\.?\s*BHD\.?|SENDIRIAN\s+BERHAD|BERHAD|BHD\.?|PLT|ENTERPRISE|TRADING)\s*$"
CORPORATE = (
    r"(^|[^A-Z])(SDN\.?\s*BHD\.?|BERHAD|BHD\.?|ENTERPRISES?|TRADING|CORPORATION|GROUP|HOLDINGS|INDUSTRIES"
    r"|CO\.?\s*LTD|PTE\.?\s*LTD|LIMITED|GMBH|LLC|PLC|IMPORT|EXPORT|EXPO|TECHN?OLOGY)($|[^A-Z])"
)
#: A legal form glued to its name, cut off by a length limit, or written SB at the end.
CORPORATE_GLUED = r"[A-Z]{4,}(?:SDNBHD\.?|BERHAD|BHD\.?)(?:$|[^A-Z])"
CORPORATE_CUT = r"[A-Z]{2,}\s+(?:\([^)]*\)\s+)?SDN\.?(?:\s+BH?\.?)?\s*$"
CORPORATE_SB = r"[A-Z]{2,}\s+(?:\([^)]*\)\s+)?SB\s*$"
CORPORATE_ANY = "|".join((CORPORATE, CORPORATE_GLUED, CORPORATE_CUT, CORPORATE_SB))
#: Markers of personal names, between blanks.
PERSON = r"(^| )(BIN|BINTI|A/L|A/P)( |$)"
REFERENCE = r"\b[A-Z]{0,3}[0-9]{6,}\b"


def squash(c: Column) -> Column:
    """White space runs as one blank, none at the ends; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def squash_upper(c: Column) -> Column:
    return F.upper(squash(c))


def without_references(c: Column) -> Column:
    return squash(F.regexp_replace(F.upper(c), REFERENCE, ""))


def repaired_suffix(c: Column) -> Column:
    """Truncated legal forms written out: SDN, SDN B, SDN BH and SB at the end."""
    return F.regexp_replace(squash_upper(c), r"\s+(SDN\.?(\s+B(H(D\.?)?)?)?|SB)$", " SDN BHD")


def company_root(c: Column) -> Column:
    """The name without brackets, legal forms, punctuation and leading numbers."""
    bare = F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"\s*\([^)]*\)\s*", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, SUFFIX, ""), SUFFIX, "")
    bare = F.trim(F.regexp_replace(F.regexp_replace(bare, "[^A-Z0-9 ]", " "), r"\s+", " "))
    bare = F.regexp_replace(bare, r"^([0-9]+\s+)+", "")
    return F.when(F.rlike(bare, F.lit("^[0-9]*$")), "").otherwise(bare)


def merge_key(c: Column) -> Column:
    return F.regexp_replace(company_root(c), "[^A-Z0-9]", "")


def is_corporate(c: Column) -> Column:
    return F.rlike(squash_upper(c), F.lit(CORPORATE_ANY))


def is_person(c: Column) -> Column:
    return F.rlike(squash_upper(c), F.lit(PERSON))


def slug(c: Column, most: int = 80) -> Column:
    return F.left(F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-")), F.lit(most))


def tokens_estimate(c: Column) -> Column:
    return F.floor(F.length(c) / 4)


def collapsed_repeats(c: Column, most: int = 6, rounds: int = 3) -> Column:
    """Immediate repeats of phrases of 2 to ``most`` words reduced to one."""
    out = squash(c)
    for _ in range(rounds):
        for n in range(most, 1, -1):
            out = F.regexp_replace(out, rf"\b((?:\S+ ){{{n - 1}}}\S+)(?: \1)+(?= |$)", "$1")
    return out
