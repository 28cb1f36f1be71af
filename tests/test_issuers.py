"""Banks by keywords and profiles, on literal files."""

import re

from finloom.operators import issuers as I

META = "file int, creator string, producer string, version string, pages int, file_size long"


def _texts(spark, *rows):
    return spark.createDataFrame(list(rows), "file int, page int, text string")


def test_keyword_counts_equal_a_search_by_pattern(spark):
    texts = [
        "Maybank Islamic Berhad maybank maybank2u www.maybank2u.com.my", "RHB rhb\nrhb-rhb xrhb rhb2 www.rhbgroup.com", "OCBC Al-Amin ocbc al amin OCBC  Bank bank simpanan nasional bsn",
        "", "x" * 596 + " uob malaysia uob", "reflex cash management, Hong Leong hong leong bank Éaffin", "bank islam bank islam bank rakyat cimb",
    ]
    want = set()
    for i, t in enumerate(texts):
        for bank, keys in I.KEYWORDS:
            for k in keys:
                pattern = f"(?<![a-z0-9]){re.escape(k)}(?![a-z0-9])"
                if n := len(re.findall(pattern, t.lower())):
                    want.add((i, bank, k, n, bool(re.search(pattern, t.lower()[:600]))))
    got = I.keyword_counts(_texts(spark, *[(i, 1, t) for i, t in enumerate(texts)], (9, 1, None), (9, 3, "cimb")))
    assert {tuple(r) for r in got.collect()} == want and len(want) > 15


def test_cascade_from_metadata_to_text(spark):
    cheques = "CIMB CHQ DEP\n" * 15
    meta = spark.createDataFrame([
        (1, "Maybank2u.com", "iText 2.1.3", "1.4", 1, 1), (2, "omsgen", "omsgen", "1.4", 1, 1), (3, None, "PDFium", "1.4", 1, 1), (4, "jasperreports", "iText 2.1", "1.4", 1, 1),
        (5, "", None, "1.4", 1, 1), (6, "", "", "1.4", 1, 1), (7, "", "", "1.4", 1, 1), (8, "omsgen", "x", "1.4", 1, 1), (9, "streamline pdfgen", "compugr", "1.4", 1, 1), (10, "", "PlanetPress 7", "1.4", 1, 1),
    ], META)
    texts = _texts(
        spark, (1, 1, cheques), (2, 1, "OCBC Bank"), (3, 1, cheques), (3, 2, "rhb"), (4, 1, cheques), (5, 1, "Maybank Islamic Berhad\n" + "x " * 300 + cheques), (6, 1, "none"), (8, 1, cheques), (10, 1, cheques)
    )
    got = {r.file: (r.bank, r.how) for r in I.issuers(meta, texts).collect()}
    assert got == {
        1: ("maybank", "closest metadata"), 2: ("ocbc", "text"), 3: ("rhb", "text within metadata"), 4: ("cimb", "text"), 5: ("maybank", "text"), 6: (None, None),
        7: (None, None), 8: ("cimb", "text"), 9: (None, None), 10: ("muamalat", "metadata"),
    }
    five = I.issuers(meta, texts).where("file = 5").first()
    assert (five.score, five.margin) == (275, 275 - 15 * 14)


def test_findings_against_a_profile(spark):
    meta = spark.createDataFrame([
        (1, "Maybank2u.com", "iText 2.1.3", "1.7", 2, 200_000), (2, "Maybank2u.com", "iText 2.1.3", "1.4", 2, 50_000), (3, "", "CamScanner", "1.4", 1, 1),
        (4, "", "", "1.4", 1, 1), (5, "", "", "1.4", 1, 1), (6, "", "Quadient", None, 0, None),
    ], META)
    texts = _texts(spark, *[(i, 1, "Maybank") for i in (1, 2, 3, 4)])
    fonts = spark.createDataFrame(
        [(1, 1, f"BCD{c}EE+{n}") for c, n in zip("EFGHI", ("Tahoma-Bold", "Calibri", "NSimSun", "Arial", "X"), strict=True)]
        + [(2, 1, "RAZIHG+Tahoma"), (2, 1, "QQWERT+NSimSun"), (2, 2, "MicrosoftSansSerif-Regular"), (6, 1, "ArialMT"), (6, 3, None)], "file int, page int, font string",
    )
    got = {}
    for r in I.profile_findings(meta, texts, fonts).collect():
        got.setdefault(r.file, set()).add((r.severity, r.message))
    assert got == {
        1: {("MEDIUM", "usual fonts are missing: MicrosoftSansSerif"), ("HIGH", "version 1.7"), ("HIGH", "too many fonts on a page"), ("HIGH", "foreign fonts: Calibri"),
            ("MEDIUM", "prefixes of fonts in series: BCD"), ("MEDIUM", "large for its pages")},
        2: {("LOW", "made as usual")}, 3: {("HIGH", "producer is a scanning or consumer program: CamScanner"), ("MEDIUM", "made by no usual program")},
        4: {("MEDIUM", "no metadata")}, 5: {("LOW", "no bank found")}, 6: {("LOW", "made as usual")},
    }
