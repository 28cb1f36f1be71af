"""Which bank made a file, and whether the file looks as that bank's files do.

``meta`` is one row per file: file, creator, producer, version, pages, file_size.
``texts`` is one row per page: file, page, text; the first two pages are read.
``fonts`` is one row per page and font: file, page, font (with a subset's prefix).

Keywords are a table.  A text is cut into words once; only words that begin a keyword
are looked at, and the one to three words from there on meet the table in a join of
equal strings.  So cost grows with the text, not with banks times keywords.

Null metadata and texts are empty; a file without text or metadata has no bank; rows of a
page that is given twice are joined in order of their text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finloom.functions.binding import bound

# Banks and the keywords that name them, in order of preference at ties.
KEYWORDS = (
    ("maybank", ("maybank islamic", "maybankislamicberhad", "maybank2u", "malayan banking", "maybank")),
    ("hong leong", ("hong leong bank", "hong leong islamic", "hong leong")),
    ("public bank", ("public bank", "public berhad")),
    ("bank rakyat", ("bank rakyat",)),
    ("bank islam", ("bank islam",)),
    ("alliance", ("alliance bank",)),
    ("agrobank", ("agrobank", "agro bank")),
    ("bsn", ("bank simpanan nasional", "bsn")),
    ("muamalat", ("muamalat",)),
    ("affin", ("affin bank", "affin islamic", "affin")),
    ("ambank", ("ambank", "ammb holdings")),
    ("cimb", ("cimb bank", "cimb islamic", "cimb group", "cimb")),
    ("rhb", ("rhb bank", "rhb islamic", "reflex cash management", "rhbgroup", "rhb")),
    ("ocbc", ("ocbc bank", "ocbc al-amin", "ocbc")),
    ("uob", ("uob malaysia", "uobm", "uob")),
)
_PALETTE = ("Helvetica", "OpenSans", "ArialUnicodeMS", "FangSong")
# Bank, pattern of the creator, pattern of the producer (ANY says nothing), families of fonts.
ANY = ".*"
PROFILES = (
    ("maybank", r"maybank2u\.com", r"itext\s*2\.1\.3", ("Tahoma", "NSimSun", "MicrosoftSansSerif")),
    ("maybank", r"elixir\s*report", r"itext\s*2\.1\.7", ("ArialUnicodeMS",)),
    ("cimb", "jasperreports", r"itext\s*1\.4", ("Helvetica",)),
    ("cimb", r"vault\s*rendering", r"rendering\s*engine", ("Helvetica",)),
    ("public bank", ANY, "itextsharp", ("Helvetica",)),
    ("rhb", "jasperreports", "itext", ("Helvetica",)),
    ("rhb", ANY, "pdfium", ("Calibri",)),
    ("rhb", "vault", "vault", ()),
    ("hong leong", r"5\.7", r"itext\s*1\.4", ("Dax-Bold", "Dax-Regular")),
    ("bank rakyat", ANY, "podofo", ("Helvetica",)),
    ("bank rakyat", ANY, r"itext\s*2\.1", ("Helvetica",)),
    ("bank islam", ANY, "openhtmltopdf", ()),
    ("bank islam", ANY, r"itext\s*2\.1", ()),
    ("bank islam", ANY, "podofo", ()),
    ("bank islam", ANY, "pdfium", ()),
    ("bank islam", ANY, r"acrobat\s*distiller", ()),
    ("bank islam", ANY, r"microsoft.*print\s*to\s*pdf", ()),
    ("affin", ANY, ANY, ()),
    ("alliance", "quadient|inspire", "quadient|inspire", ("ArialMT",)),
    ("ambank", r"streamline\s*pdfgen", "compugr", ()),
    ("ambank", "omsgen", ANY, ()),
    ("agrobank", "microsoft.*word", ANY, ("Calibri", "Tahoma")),
    ("agrobank", r"wps\s*writer", ANY, ()),
    ("bsn", "bsn|jasper", "itext|jasper", ()),
    ("muamalat", ANY, "planetpress", ("Calibri-Italic", "CourierNewPS-BoldMT", "ArialNarrow")),
    ("ocbc", r"streamline\s*pdfgen", "compugr", ("Arial",)),
    ("ocbc", "omsgen", "omsgen", ("Arial",)),
    ("uob", "jasperreports", r"itext\s*2\.1", _PALETTE),
    ("uob", "pdfium", "pdfium", _PALETTE),
)
# Of the first profile only, its version, most fonts a page, and fonts that never occur.
VERSION, MOST_FONTS, FOREIGN, MOST_KB = "1.4", 4, ("Calibri", "TimesNewRomanPSMT"), 45
# Programs of phones and scanners, no bank's.
CONSUMER = (
    r"adobe\s*scan", "camscanner", r"genius\s*scan", r"microsoft\s*lens", r"google\s*drive", "scanbot", r"tiny\s*scanner",
    r"clear\s*scanner", r"scanner\s*pro", r"adobe\s*photoshop", "gimp", "paint", "canva",
)
WEIGHTS = "-(Regular|Bold|Italic|BoldItalic|Light|Medium|Heavy|Black|Semibold|Thin|Condensed|Oblique)$"
HEADER_CHARS, HEADER_BONUS = 600, 250

BANKS = tuple(dict.fromkeys(p[0] for p in PROFILES))
_LONGEST = 3


def _said(c: Column, pattern: str) -> Column:
    return F.rlike(c, F.lit("(?i)" + pattern))


def front(texts: DataFrame) -> DataFrame:
    """file, text: the first two pages in lower case."""
    two = texts.where("page BETWEEN 1 AND 2").groupBy("file").agg(F.sort_array(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text")))).alias("p"))
    return two.select("file", F.lower(F.array_join(F.col("p.text"), "\n")).alias("text"))


def _phrases(text: Column) -> Column:
    """The runs of up to three words, as they are written, from each word on that begins a keyword."""
    first = sorted({k.replace("-", " ").split()[0] for _, ks in KEYWORDS for k in ks})

    def runs(p: Column) -> Column:
        words, pieces = p["words"], p["pieces"]
        some = F.filter(F.transform(words, lambda w, i: F.when(w.isin(*first), i)), lambda i: i.isNotNull())
        run = lambda i, k: F.concat(F.array_join(F.slice(pieces, i + 1, k), ""), F.get(words, i + k))
        return F.flatten(F.transform(some, lambda i: F.filter(F.array(*[run(i, k) for k in range(_LONGEST)]), lambda r: r.isNotNull())))

    found = lambda group: F.regexp_extract_all(text, F.lit("([a-z0-9]+)([^a-z0-9]*)"), F.lit(group))
    return bound(F.struct(found(1).alias("words"), found(0).alias("pieces")), runs)


def keyword_counts(texts: DataFrame) -> DataFrame:
    """file, bank, keyword, n, in_header: how often each keyword stands between other characters."""
    read = front(texts)
    head = F.substr("text", F.lit(1), F.lit(HEADER_CHARS))
    zones = read.select("file", F.explode(F.array(F.struct(F.lit(0).alias("head"), F.col("text").alias("t")), F.struct(F.lit(1).alias("head"), head.alias("t")))).alias("z"))
    hits = zones.select("file", F.col("z.head").alias("head"), F.explode(_phrases(F.col("z.t"))).alias("keyword"))
    known = read.sparkSession.createDataFrame([(b, k) for b, ks in KEYWORDS for k in ks], "bank string, keyword string")
    met = hits.join(F.broadcast(known), "keyword").groupBy("file", "bank", "keyword")
    return met.agg(F.count_if(F.col("head") == 0).alias("n"), (F.max("head") == 1).alias("in_header")).where("n > 0")


def _order(bank: Column, banks) -> Column:
    return F.array_position(F.array(*[F.lit(b) for b in banks]), bank)


def candidates() -> Column:
    """array<struct(bank, score)>: banks whose profiles the creator or producer meets, in order of BANKS."""

    def score(bank: str) -> Column:
        fits = lambda c, p: F.lit(0) if p == ANY else F.when((c != "") & _said(c, p), 1).otherwise(0)
        each = [fits(F.col("creator"), c) + fits(F.col("producer"), p) for b, c, p, _ in PROFILES if b == bank]
        return F.greatest(*each) if len(each) > 1 else each[0]

    every = F.array(*[F.struct(F.lit(b).alias("bank"), score(b).alias("score")) for b in BANKS])
    return F.filter(every, lambda x: x["score"] > 0)


def _tidy(meta: DataFrame) -> DataFrame:
    clean = lambda c: F.trim(F.coalesce(c, F.lit("")))
    return meta.withColumn("creator", clean(F.col("creator"))).withColumn("producer", clean(F.col("producer")))


def issuers(meta: DataFrame, texts: DataFrame) -> DataFrame:
    """file, bank, how, score, margin: a row per row of ``meta``.

    One bank's profile alone meets the metadata: it is the bank.  Otherwise the text's
    best bank, if no profile or that bank's meets; then the profile's bank with most hits in
    the text; then the one profile of most matches; then the text's bank after all.
    ``score`` is ten times the text's: n (1 + length / 10) of the best keyword, and 25
    for one in the header; ``margin`` is what the next bank lacks.
    """
    counts = keyword_counts(texts)
    weighed = F.col("n") * (10 + F.length("keyword")) + F.when(F.col("in_header"), HEADER_BONUS).otherwise(0)
    scored = counts.groupBy("file", "bank").agg(F.max(weighed).alias("score"), F.sum("n").alias("hits"))
    place = _order(F.col("bank"), [b for b, _ in KEYWORDS])
    ranked = scored.groupBy("file").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), place.alias("at"), "bank", "hits"))).alias("r"))
    found = _tidy(meta).select("file", candidates().alias("c")).join(ranked, "file", "left")
    text_bank = F.get("r", F.lit(0))["bank"]
    within = F.array_sort(
        F.transform(
            F.filter(F.col("r"), lambda x: F.array_contains(F.col("c.bank"), x["bank"])),
            lambda x: F.struct((-x["hits"]).alias("h"), F.array_position(F.col("c.bank"), x["bank"]).alias("at"), x["bank"].alias("bank")),
        )
    )
    tops = F.filter("c", lambda x: x["score"] == F.array_max(F.col("c.score")))
    one, none = F.size("c") == 1, F.size("c") == 0
    how = (
        F.when(one, "metadata").when(text_bank.isNotNull() & (none | F.array_contains(F.col("c.bank"), text_bank)), "text")
        .when(none, F.lit(None)).when(F.size(within) > 0, "text within metadata").when(F.size(tops) == 1, "closest metadata")
        .when(text_bank.isNotNull(), "text").otherwise(F.lit(None))
    )
    bank = (
        F.when(F.col("how") == "metadata", F.get("c", F.lit(0))["bank"]).when(F.col("how") == "text", text_bank)
        .when(F.col("how") == "text within metadata", F.get(within, F.lit(0))["bank"]).when(F.col("how") == "closest metadata", F.get(tops, F.lit(0))["bank"])
    )
    score = -F.coalesce(F.get("r", F.lit(0))["s"], F.lit(0))
    return found.withColumn("how", how).select("file", bank.alias("bank"), "how", score.alias("score"), (score + F.coalesce(F.get("r", F.lit(1))["s"], F.lit(0))).alias("margin"))


def used_fonts(fonts: DataFrame) -> DataFrame:
    """Per file: its fonts without prefixes, its families, the most fonts of a page among the first two, and its prefixes."""
    bare = F.regexp_replace(F.coalesce("font", F.lit("")), r"^[^+]*\+", "")
    named = fonts.select("file", "page", bare.alias("name"), F.when(F.rlike("font", F.lit(r"^[A-Za-z]{6}\+")), F.substr("font", F.lit(1), F.lit(6))).alias("prefix"))
    pages = named.groupBy("file", "page").agg(
        F.collect_set(F.when(F.col("name") != "", F.col("name"))).alias("names"), F.collect_set("prefix").alias("prefixes"), F.count("prefix").alias("n_prefixes"), F.count("*").alias("n"),
    )
    return pages.groupBy("file").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("fonts"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("prefixes")))).alias("prefixes"),
        F.sum("n_prefixes").alias("n_prefixes"), F.max(F.when(F.col("page") <= 2, F.col("n"))).alias("page_fonts"),
    )


def matched_profile() -> Column:
    """Place in PROFILES of the bank's first profile that meets a creator, or else a producer; null for none."""
    tried = [F.when((F.col("bank") == b) & (F.col("creator") != "") & _said(F.col("creator"), c), i) for i, (b, c, _, _) in enumerate(PROFILES)]
    tried += [F.when((F.col("bank") == b) & (F.col("producer") != "") & _said(F.col("producer"), p), i) for i, (b, _, p, _) in enumerate(PROFILES)]
    return F.coalesce(*tried)


def profile_findings(meta: DataFrame, texts: DataFrame, fonts: DataFrame) -> DataFrame:
    """file, severity, message: what speaks against the bank's usual way of making files, or for it."""
    no_fonts = F.array().cast("array<string>")
    whole = _tidy(meta).join(issuers(meta, texts), "file").join(used_fonts(fonts), "file", "left").withColumn("profile", matched_profile())
    whole = whole.withColumn("fonts", F.coalesce("fonts", no_fonts)).withColumn("prefixes", F.coalesce("prefixes", no_fonts))
    usual = F.get(F.array(*[F.array(*[F.lit(f) for f in p[3]]).cast("array<string>") for p in PROFILES]), F.col("profile"))
    families = F.transform("fonts", lambda f: F.regexp_replace(f, "(?i)" + WEIGHTS, ""))
    whole = whole.withColumn("missing", F.array_sort(F.array_except(F.coalesce(usual, no_fonts), families))).withColumn("usual", F.coalesce(usual, no_fonts))
    met, has = F.col("profile").isNotNull(), (F.size("usual") > 0) & (F.size("fonts") > 0)
    strict, known = F.col("profile") == 0, F.col("bank").isNotNull()
    foreign = F.array_intersect(F.array(*[F.lit(f) for f in FOREIGN]), "fonts")
    root = F.substr(F.get("prefixes", F.lit(0)), F.lit(1), F.lit(3))
    serial = (F.col("n_prefixes") >= 4) & (F.size("prefixes") >= 3) & F.forall("prefixes", lambda p: F.startswith(p, root))
    per_page = F.col("file_size") / F.col("pages") / 1024
    creator_met = reduce(lambda a, b: a | b, [(F.col("bank") == b) & _said(F.col("creator"), c) for b, c, _, _ in PROFILES])
    bare = (F.col("creator") == "") & (F.col("producer") == "")
    tests = [
        (~known, "LOW", F.lit("no bank found")),
        *[(known & _said(F.col(c), p), "HIGH", F.concat(F.lit(f"{c} is a scanning or consumer program: "), F.col(c))) for p in CONSUMER for c in ("creator", "producer")],
        (known & met & has & (F.size("missing") > 0), "MEDIUM", F.concat(F.lit("usual fonts are missing: "), F.array_join("missing", ", "))),
        (known & met & has & (F.size("missing") == 0), "LOW", F.lit("made as usual")),
        (known & strict & (F.col("version") != VERSION), "HIGH", F.concat(F.lit("version "), F.col("version"))),
        (known & strict & (F.col("page_fonts") > MOST_FONTS), "HIGH", F.lit("too many fonts on a page")),
        (known & strict & (F.size(foreign) > 0), "HIGH", F.concat(F.lit("foreign fonts: "), F.array_join(F.array_sort(foreign), ", "))),
        (known & met & serial, "MEDIUM", F.concat(F.lit("prefixes of fonts in series: "), root)),
        (known & strict & (F.col("pages") > 0) & (per_page > MOST_KB), "MEDIUM", F.lit("large for its pages")),
        (known & ~met & ~bare, None, F.lit("made by no usual program")),
        (known & ~met & bare, "MEDIUM", F.lit("no metadata")),
    ]
    unusual = F.when((F.col("creator") != "") & ~creator_met, "HIGH").otherwise("MEDIUM")
    made = F.array(*[F.when(t, F.struct((unusual if s is None else F.lit(s)).alias("severity"), m.alias("message"))) for t, s, m in tests])
    return whole.select("file", F.explode(F.array_compact(made)).alias("f")).select("file", "f.severity", "f.message")
