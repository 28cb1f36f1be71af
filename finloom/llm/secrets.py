"""Operator 6: secret scanning with Spark expressions only.

Three fixed patterns (assigned values, access keys, long hexadecimal runs) give
the base spans.  The method looks at every further run of 20 or more characters
``[A-Za-z0-9+/_=-]``: its encoding is inferred from its characters (decimal, hex,
letters of one case, base32, base36, base62, base64), and a battery tests it for
randomness:

* chi-squared uniformity over the alphabet,
* the number of runs above and below the middle of the alphabet,
* the lag-1 serial correlation of the symbols.

Each test is made twice.  Against randomness: a candidate that fails one of them by
``REJECT`` standard deviations is ordered text, not a secret.  Against ordinary text,
that is symbols as uneven, runs as few and neighbours as alike as ENCODINGS, TURNS
and SERIAL say at least: the chance that such text looks as random as the candidate falls
with the length by itself.  The chances of the three tests are combined by Fisher's
method, and the result is never less than that of uniformity alone.  Benjamini-Hochberg
over the document's candidates, weighted by their length, then holds the false
discovery rate at ``ALPHA``.  Short tokens of small alphabets can't be told apart: 24
decimal digits or 20 letters of one case are left to the base patterns.  A candidate inside
a base span is not looked at; one that only overlaps base spans is tested whole and
reported beside them, so that no half of a token stays readable.  Base spans stay.
Other data in such an encoding, base64 of plain prose for one, looks random and is reported.

No shuffle and no Python; positions are prefix sums of the pieces between matches.

Defined cases: null text is empty; no match gives empty digests; repeated rows are
each scanned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finloom.llm.common import cut, let, prefix_sums, read


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


ASSIGN = (
    "(" + "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key"))) + ")"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")
ALPHA, REJECT = 0.01, 4.0
#: Ordinary text: most turns between the halves of the alphabet, least serial correlation; for its unevenness see ENCODINGS.
TURNS, SERIAL = 0.25, 0.3

#: Encodings from the narrowest: name, pattern, symbols in order of value, and the least
#: chance that two symbols of ordinary text in it are equal.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    ("decimal", "^[0-9]+$", DIGITS, 0.15),
    ("hex", "^[0-9a-f]+$", DIGITS + "abcdef", 0.125),
    ("HEX", "^[0-9A-F]+$", DIGITS + "ABCDEF", 0.125),
    ("lower", "^[a-z]+$", LOWER, 0.06),
    ("UPPER", "^[A-Z]+$", UPPER, 0.06),
    ("base32", "^[A-Z2-7]+=*$", UPPER + "234567", 0.06),
    ("base36", "^[0-9a-z]+$", DIGITS + LOWER, 0.06),
    ("BASE36", "^[0-9A-Z]+$", DIGITS + UPPER, 0.06),
    ("base62", "^[0-9A-Za-z]+$", DIGITS + UPPER + LOWER, 0.06),
    ("base64", "^", UPPER + LOWER + DIGITS + "+/-_", 0.06),
)


def spans_of(text: Column, pattern: str, kind: str, fits=None) -> Column:
    """array<struct(start, end, kind)> of leftmost matches; ``fits`` drops matches afterwards."""
    rank = KINDS.index(kind)

    def located(found: Column) -> Column:
        pieces = F.split(text, pattern, -1)
        lengths = F.flatten(F.zip_with(F.transform(found, F.length), F.slice(pieces, 1, F.size(found)), lambda m, p: F.array(p_len(p), m)))
        starts = prefix_sums(lengths)
        return F.transform(
            found,
            lambda m, i: F.struct(
                F.get(starts, 2 * i + 1).alias("start"),
                (F.get(starts, 2 * i + 1) + F.length(m)).alias("end"),
                F.lit(rank).alias("kind"),
                m.alias("value"),
            ),
        )

    p_len = lambda p: F.length(p)
    none = F.array().cast("array<struct<start:bigint,end:bigint,kind:int,value:string>>")
    out = F.when(F.rlike(text, F.lit(pattern)), let(F.regexp_extract_all(text, F.lit(pattern), 0), located)).otherwise(none)
    return F.filter(out, lambda s: fits(s["value"])) if fits else out


def _inferred(token: Column) -> Column:
    """struct(symbols, match) of the narrowest encoding that holds the token."""
    said = [(F.rlike(token, F.lit(p)), F.struct(F.lit(symbols).alias("symbols"), F.lit(match).alias("match"))) for _, p, symbols, match in ENCODINGS]
    return reduce(lambda c, x: c.when(*x), said[1:], F.when(*said[0]))


def _below(z: Column) -> Column:
    """Chance of a normal score of at most z, by a logistic curve with a cubic term."""
    return 1.0 / (1.0 + F.exp(-F.greatest(F.least(1.5976 * z + 0.07056 * z * z * z, F.lit(300.0)), F.lit(-300.0))))


def evidence(token: Column) -> Column:
    """struct(z, p): the worst score against randomness, and the chance that ordinary text looks so random."""

    def body(x: Column) -> Column:
        vals, k = x["vals"], x["k"].cast("double")
        n = F.size(vals).cast("double")
        total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)

        def tested(s: Column) -> Column:
            counts = F.transform(F.array_distinct(vals), lambda v: F.size(F.filter(vals, lambda y: y == v)).cast("double"))
            above = F.transform(vals, lambda v: (2 * v >= k).cast("int"))
            turns = F.size(F.filter(above, lambda a, i: (i > 0) & (a != F.get(above, i - 1)))).cast("double")
            mean = s / n
            var = total(F.transform(vals, lambda v: (v - mean) * (v - mean)))
            lag = total(F.transform(vals, lambda v, i: F.coalesce((v - mean) * (F.get(vals, i + 1) - mean), F.lit(0.0))))
            return F.struct(
                (total(F.transform(counts, lambda c: c * c)) * k / n - n).alias("chi"), turns.alias("turns"),
                F.when(var > 0, lag / var).otherwise(F.lit(1.0)).alias("serial"),
            )

        def judged(t: Column) -> Column:
            df = k - 1.0
            z_chi = (F.pow(F.greatest(t["chi"], F.lit(0.0)) / df, F.lit(1.0 / 3)) - (1.0 - 2.0 / (9.0 * df))) / F.sqrt(2.0 / (9.0 * df))
            z_turns = (t["turns"] - (n - 1.0) / 2.0) / F.sqrt((n - 1.0) / 4.0)
            uneven = n * (k * x["match"] - 1.0)
            p_chi = _below((t["chi"] - df - uneven) / F.sqrt(2.0 * (df + 2.0 * uneven)))
            p_turns = _below(((n - 1.0) * TURNS + 0.5 - t["turns"]) / F.sqrt((n - 1.0) * TURNS * (1.0 - TURNS)))
            p_serial = _below((F.abs(t["serial"]) - SERIAL) * F.sqrt(n))
            fisher = let(-F.log(p_chi) - F.log(p_turns) - F.log(p_serial), lambda q: F.exp(-q) * (1.0 + q + q * q / 2.0))
            return F.struct(F.greatest(z_chi, F.abs(z_turns), F.abs(t["serial"]) * F.sqrt(n)).alias("z"), F.greatest(p_chi, fisher).alias("p"))

        return let(let(total(vals), tested), judged)

    def prepared(found: Column) -> Column:
        value = lambda c: (F.instr(found["symbols"], c) - 1).cast("double")
        return F.struct(F.length(found["symbols"]).alias("k"), found["match"].alias("match"), F.transform(F.split(F.regexp_replace(token, "=+$", ""), ""), value).alias("vals"))

    return let(let(_inferred(token), prepared), body)


def _discovered(spans: Column) -> Column:
    """Benjamini-Hochberg over all candidates, weighted by length; those that fail the battery have a chance of one."""

    def body(ss: Column) -> Column:
        m = F.size(ss).cast("double")
        chars = F.aggregate(ss, F.lit(0.0), lambda a, s: a + (s["end"] - s["start"]).cast("double"))
        p_of = lambda s: F.when(s["e"]["z"] <= REJECT, s["e"]["p"] * chars / m / (s["end"] - s["start"])).otherwise(1.0)

        def kept(ps: Column) -> Column:
            passing = F.filter(F.transform(ps, lambda p, i: F.when(p <= ALPHA * (i + 1) / m, p)), lambda p: p.isNotNull())
            return let(F.array_max(passing), lambda most: F.filter(ss, lambda s: p_of(s) <= most))

        return let(F.sort_array(F.transform(ss, p_of)), kept)

    tested = F.transform(spans, lambda s: s.withField("e", evidence(s["value"])))
    return F.coalesce(F.when(F.size(spans) > 0, let(tested, body)), F.array().cast("array<struct<start:bigint,end:bigint,kind:int,value:string,e:struct<z:double,p:double>>>"))


def _bare(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))


def scan(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, base and spans (arrays of struct(start, end, kind)), with the columns of ``keep``.

    ``kind`` is the position in KINDS; arrays are in order of start, then kind.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    assigned = spans_of(text, ASSIGN, "assign", lambda v: F.length(F.regexp_extract(v, ASSIGN, 2)) >= 6)
    found = docs.select(
        "doc_id",
        *[c for c in keep if c != "doc_id"],
        F.sort_array(
            F.concat(_bare(assigned), _bare(spans_of(text, ACCESS, "access")), _bare(spans_of(text, HEX, "hex")))
        ).alias("base"),
        spans_of(text, CANDIDATE, "random").alias("candidates"),
    )
    beyond = lambda s: ~F.exists("base", lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"]))
    more = _bare(_discovered(F.filter("candidates", beyond)))
    return found.withColumn("spans", F.sort_array(F.concat("base", more))).drop("candidates")


def as_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with every span replaced; overlapping spans share one mask."""
    return cut(text, spans, mask)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return got.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans")
    )
