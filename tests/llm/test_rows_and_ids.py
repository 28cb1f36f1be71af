"""The pipeline's stages where ids are shared or null, and the tables that stages leave."""

import random
import threading

import corpus_pipeline as P
from finloom.llm.common import Staging, read, staged

WORDS = "the of and to in alpha beta gamma delta omega river stone cloud paper light green table water north south".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n=80):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing"]) for _ in range(n))


def test_near_dedup_keeps_a_row_of_every_text(spark, tmp_path):
    a, b, c, d = (prose(i) for i in range(4))
    rows = [(1, a), (1, b), (2, b), (3, c), (3, c), (None, d), (None, d), (None, prose(9)), (4, d + " more"), (5, None), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    got = sorted(((r.doc_id, r.text) for r in P.keep_distinct(spark, docs, "").collect()), key=str)
    assert sorted(t for _, t in got if t) == sorted([a, b, c, d + " more", prose(9)])
    assert dict((t, i) for i, t in got)[b] == 2 and (5, None) in got


def test_leaks_go_by_text(spark, tmp_path):
    item = prose(1, 30)
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, prose(2) + " " + item), (1, prose(3)), (None, item + " " + prose(4)), (None, prose(5))]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    got = {(r.doc_id, r.text) for r in P.drop_leaks(spark, docs, str(tmp_path)).collect()}
    assert got == {(1, prose(3)), (None, prose(5))}


def test_tables_belong_to_the_block_that_opened_them(spark):
    seen = {}

    def other():
        with staged() as mine:
            Staging(spark, "other")
        seen["other"] = len(mine)

    with staged() as mine:
        t = threading.Thread(target=other)
        t.start()
        t.join()
        Staging(spark, "one")
    Staging(spark, "free")
    assert (len(mine), seen["other"]) == (1, 1)
    assert read(spark, "/root/testdata/sf0.001", "documents").count() > 0
