"""Texts that were written in UTF-8 and read as a one-byte charset, read again.

Only what has the form of one character's bytes is read again: a lead and as many
continuations as it asks for, as the one-byte charset shows them.  A round is kept if
it leaves fewer such forms than before; so texts that were garbled more than once come
back round by round, and texts without such forms stay as they are.  Pairs other than
those of Latin letters are read again only if no capital stands before them and no
quotation mark or dash ends them, or if another such form stands beside them: a capital
before a closing quotation mark looks like one.

A null text stays null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from finloom.functions.binding import bound

# What the charset has at 0x80 to 0x9F, in order, where it has any; their bytes.
SHOWN = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
BYTES = "".join(map(chr, (0x80, *range(0x82, 0x8D), 0x8E, *range(0x91, 0x9D), 0x9E, 0x9F)))
_MORE = f"[\u0080-¿{SHOWN}]"
_QUOTES = "‚„…‹‘’“”–—›"
#: Every form begins with one of these, which is looked at before the kinds of forms are tried.
FORM = (
    f"(?=[Â-ô])(?:[ÂÃ]{_MORE}|[à-ï]{_MORE}{{2}}|[ð-ô]{_MORE}{{3}}|(?<![A-ZÀ-Þ])[Ä-ß](?![{_QUOTES}]){_MORE}"
    f"|[Ä-ß]{_MORE}(?=[Â-ô]{_MORE})|(?<=[Â-ô]{_MORE})[Ä-ß]{_MORE})"
)
ROUNDS = 4


def _read_again(form: Column) -> Column:
    return F.coalesce(F.try_validate_utf8(F.encode(F.translate(form, SHOWN, BYTES), "ISO-8859-1").cast("string")), form)


def repaired(text: Column, rounds: int = ROUNDS) -> Column:
    """The text as it was written: a round that finds nothing, or leaves no fewer forms, is the last."""

    def one(t: Column, left: int) -> Column:
        if not left:
            return t

        def body(found: Column) -> Column:
            pieces = F.zip_with(F.split(t, FORM, -1), F.transform(found, _read_again), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
            fewer = lambda new: F.when(F.regexp_count(new, F.lit(FORM)) < F.size(found), one(new, left - 1)).otherwise(t)
            return F.when(F.size(found) > 0, bound(F.array_join(pieces, ""), fewer)).otherwise(t)

        return bound(F.regexp_extract_all(t, F.lit(FORM), F.lit(0)), body)

    return bound(text, lambda t: one(t, rounds))
