"""The pipeline's stages against plain Python over the same rows."""

import re
from collections import Counter

import corpus_pipeline as P
from finloom.llm import packing, secrets


def _words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def _grams(t, k=5):
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in _words(t)]
    return {tuple(w[i : i + min(k, len(w))]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_stages_match_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    stages = dict(P.STAGES)
    kept = {}
    for name, stage in P.STAGES:
        before = docs
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs
        if name != "packing":
            assert docs.columns == P.COLUMNS
        if name == "near_dedup":
            rows = {r.doc_id: _grams(r.text) for r in before.collect()}
            root = {i: i for i in rows}

            def find(x):
                while root[x] != x:
                    x = root[x]
                return x

            for a in rows:
                for b in rows:
                    if a < b and rows[a] and 100 * len(rows[a] & rows[b]) >= 80 * len(rows[a] | rows[b]):
                        x, y = sorted((find(a), find(b)))
                        root[y] = x
            assert {r.doc_id for r in docs.collect()} == {i for i in rows if find(i) == i}
        if name == "decontamination":
            bad = set()
            for r in before.collect():
                have = _grams(r.text)
                bad |= {r.doc_id for b in benchmark if _grams(b) and 100 * len(_grams(b) & have) >= 80 * len(_grams(b))}
            assert {r.doc_id for r in before.collect()} - {r.doc_id for r in docs.collect()} == bad
        if name == "secret_scans":
            for r in docs.collect():
                assert not [m for m in re.finditer(secrets.ASSIGN, r.text) if len(m[2]) >= 6] and r.n_chars == len(r.text)
    whole = {r.doc_id: len(_words(r.text)) for r in kept["secret_scans"].collect()}
    packed, bins = Counter(), Counter()
    for r in kept["packing"].collect():
        packed[r.doc_id] += r.n_words
        bins[r.bin_id] += r.n_words
    assert dict(packed) == whole and max(bins.values()) <= packing.CAPACITY
    assert [n for n, _ in P.STAGES] == list(stages)


def test_run_gives_the_last_stage(spark, sf_dir):
    assert P.run(spark, sf_dir).columns == ["bin_id", "position", "doc_id", "piece", "start_word", "n_words"]
