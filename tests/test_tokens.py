"""Words of narratives and garbled texts against plain Python and literal rows."""

import random
import re

from pyspark.sql import functions as F

from finloom.functions import mojibake as M
from finloom.functions import tokens as T


def _one(spark, texts, *columns):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").repartition(2)
    return [tuple(r)[1:] for r in rows.select("id", *columns).orderBy("id").collect()]


def _block_end(w):
    best = [(k, b + k) for k in range(1, 7) for a in range(len(w)) for b in range(a + k, len(w) - k + 1) if w[a : a + k] == w[b : b + k] and (k > 1 or len(w[a]) > 1)]
    return max(best)[1] if best and len(w) >= 4 else 0


def _prefix(w):
    k = max((k for k in range(1, 9) if 2 * k <= len(w) and w[:k] == w[k : 2 * k]), default=0)
    return w[2 * k :]


def test_repeated_blocks_equal_a_search_of_all_places(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["AB", "C1", "-", "DEF", "G"]) for _ in range(rng.randint(0, 14))) for _ in range(300)] + [None, "", " a  b a b ", "P Q R P Q R NAME"]
    w = [(t or "").split() for t in texts]
    got = _one(spark, texts, T.repeated_block_end(T.words(F.col("t"))), T.without_repeated_prefix(T.words(F.col("t"))))
    assert got == [(_block_end(x), _prefix(x)) for x in w] and sum(g[0] > 0 for g in got) > 100


def test_literal_narratives(spark):
    cases = [
        ("JAN AND FEB 2026 ALI BIN ABU", "ALI BIN ABU"), ("AND SONS TRADING", "AND SONS TRADING"), ("INV/0012 PAYMENT (MAR) & HASAN", "HASAN"), ("() BAKI", ""), ("May Lim", "Lim"), ("", ""),
        ("12 inv abc", "abc"), ("PV-12a X", "PV-12a X"), ("() & X", "& X"),
    ]
    assert [r[0] for r in _one(spark, [c[0] for c in cases], F.array_join(T.without_purpose_prefix(T.words(F.col("t"))), " "))] == [c[1] for c in cases]
    cases = [("REF 1234 SYARIKAT MAJU (M) BHD", "SYARIKAT MAJU (M) BHD"), ("12 ALI", ""), ("AB & C1 DE FG", "DE FG"), ("ÉCOLE ABC", "ÉCOLE ABC"), ("A BC DE", "BC DE"), ("", "")]
    assert [r[0] for r in _one(spark, [c[0] for c in cases], T.tail_of_letters(T.words(F.col("t"))))] == [c[1] for c in cases]
    cases = [("XXXX-XXXX-1386", False), ("MAYBANK VISA", True), ("21025 AB", False), ("XXXY", True), (None, False)]
    assert [r[0] for r in _one(spark, [c[0] for c in cases], T.has_real_word(F.col("t")))] == [c[1] for c in cases]
    cases = [("ALI ABC123 12345", "ALI"), ("ABCD1234", "ABCD1234"), ("QTR4 QT1", ""), ("X F12A3 CP_1_2", "X")]
    assert [r[0] for r in _one(spark, [c[0] for c in cases], F.array_join(T.without_stop_tokens(T.words(F.col("t"))), " "))] == [c[1] for c in cases]
    cases = [
        ("1,200.00 REF9 HABLEM OIL & GAS SDN. BHD. 12.50 _", "HABLEM OIL & GAS SDN. BHD", "HABLEM OIL & GAS SDN. BHD"), ("gaji pekerja SITI ALI Hong Leong Islamic Bank Berhad page", "gaji pekerja SITI ALI", "SITI ALI"),
        ("x 99", "x", ""), ("123 #", "", ""), ("", "", ""), ("& ALI", "& ALI", "& ALI"),
    ]
    got = _one(spark, [c[0] for c in cases[:-1]], T.name_at_end(F.col("t")), T.name_at_end(F.col("t"), True))
    assert got == [c[1:] for c in cases[:-1]]
    assert _one(spark, ["ABC 123/45 x", "ABC 12"], T.without_trailing_references(F.col("t"))) == [("ABC",), ("ABC 12",)]


def _garbled(t, charset, times=1):
    for _ in range(times):
        t = "".join(chr(b) if charset == "latin-1" or b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([b]).decode("cp1252") for b in t.encode())
    return t


def test_garbled_texts_come_back_and_others_stay(spark):
    plain = ["é", "naïve café → “quoted” – €5", "漢字 and Ελληνικά", "😀 ok", "Müller & Söhne, Ångström", "RM 1,200.00", "", None, "CAFÉ” and NÃO", "Ó’BRIEN", "Âme", "x" * 3000 + "ü", "© 2024 ½ °C", "ЖУК", "É…"]
    bad = [(c, n, t) for c in ("latin-1", "cp1252") for n in (1, 2, 3) for t in plain if t and t not in ("CAFÉ” and NÃO", "Ó’BRIEN", "É…", "ЖУК")]
    got = [r[0] for r in _one(spark, plain + [_garbled(t, c, n) for c, n, t in bad], M.repaired(F.col("t")))]
    assert got[: len(plain)] == plain[:13] + ["ЖУК", got[14]]
    assert [(b, g) for b, g in zip(bad, got[len(plain) :], strict=True) if b[2] != g] == []
    assert not re.search(M.FORM, "plain text")


def test_a_round_reads_a_text_three_times_and_the_last_once(spark):
    plan = spark.range(1).select(M.repaired(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "rlike" not in plan and plan.count("regexp_count(") == M.ROUNDS
    # a lead is one of those that are looked at first
    assert all(re.match("[Â-ô]", _garbled(chr(c), "cp1252")) for c in [*range(0x80, 0x800), 0x20AC, 0xFFFD, 0x1F600, 0x10FFFF])
