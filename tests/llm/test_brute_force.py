"""Whole operators against plain Python that follows their definitions."""

import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from finloom.llm import classifier, fitting, secrets, substrings, toxicity, urls
from tests.compare import rows as plain_rows

WORDS = "the of and to in alpha beta gamma delta omega river stone cloud paper light green table water north south".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ed"]) for _ in range(n))


# operator 5


def _ends(data, radius=substrings.RADIUS, n_gear=substrings.GEAR_BYTES):
    gear = [int(x) for x in np.random.default_rng(1).integers(0, 2**32, 256, np.uint32)]
    h = [sum(gear[data[i - d]] << d for d in range(n_gear) if i >= d) % 2**32 for i in range(len(data))]
    out = []
    for i in range(radius, len(data) - radius):
        if all(h[i] > h[j] for j in range(i - radius, i)) and all(h[i] >= h[j] for j in range(i + 1, i + radius + 1)):
            if i + 1 < len(data) and data[i + 1] & 0xC0 != 0x80:
                out.append(i + 1)
    return out + [len(data)] if data else []


@pytest.mark.parametrize("text", ["", "short", "ab" * 200, "ß漢字 \U0001f600 word " * 30, prose(random.Random(1), 400)])
def test_chunk_ends_match_the_definition(text):
    assert list(substrings.chunk_ends(text.encode())) == _ends(text.encode())


def _passages(docs):
    """(doc, start, chars) of every repeated passage, by character."""
    chunks, first = {}, {}
    for doc in sorted(docs):
        data, begin, at = docs[doc].encode(), 0, []
        for e in _ends(data):
            at.append((len(data[:begin].decode()), data[begin:e].decode()))
            begin = e
        chunks[doc] = at
        for start, piece in at:
            first.setdefault(piece, (doc, start))
    out = set()
    for doc, at in chunks.items():
        runs = []
        for start, piece in at:
            if first[piece] == (doc, start):
                continue
            if runs and runs[-1][-1][0] + len(runs[-1][-1][1]) == start:
                runs[-1].append((start, piece))
            else:
                runs.append([(start, piece)])
        own = docs[doc]
        for run in runs:
            start, end = run[0][0], run[-1][0] + len(run[-1][1])
            long = end - start >= substrings.MIN_CHARS
            left = right = 0
            for i, (s, piece) in enumerate(run):
                other, t = first[piece]
                text = docs[other]
                if not long or i == 0:
                    n = 0
                    while min(s, t) > n and own[s - n - 1] == text[t - n - 1]:
                        n += 1
                    left = max(left, n - (s - start))
                if not long or i == len(run) - 1:
                    s2, t2, n = s + len(piece), t + len(piece), 0
                    while s2 + n < len(own) and t2 + n < len(text) and own[s2 + n] == text[t2 + n]:
                        n += 1
                    right = max(right, n - (end - s2))
            words = len([m for m in re.finditer(r"(?<!\S)\S", own) if start <= m.start() < end])
            words += max(1, len(own[start - left : start].split())) + len(own[end : end + right].split())
            if long or words > substrings.MIN_WORDS:
                out.add((doc, start - left, end - start + left + right))
    return out


def test_repeated_passages_match_brute_force(spark):
    rng = random.Random(21)
    shared = [prose(rng, rng.choice([20, 49, 51, 60, 120])) for _ in range(25)]
    docs = {}
    for i in range(70):
        parts = [prose(rng, rng.randint(0, 80))]
        for _ in range(rng.randint(0, 2)):
            parts += [rng.choice(shared), prose(rng, rng.randint(1, 60))]
        docs[i] = rng.choice([" ", ", "]).join(parts)
    got = substrings.repeated_passages(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    assert {(r.doc_id, r.start, r.chars) for r in got} == _passages(docs)


# operator 6


def _chance(token):
    """(worst score, chance) of the battery, term by term."""
    symbols, match = next((s, m) for _, p, s, m in secrets.ENCODINGS if re.search(p, token))
    vals = [symbols.index(c) if c in symbols else -1 for c in re.sub("=+$", "", token)]
    n, k = len(vals), len(symbols)
    chi = sum(vals.count(v) ** 2 for v in set(vals)) * k / n - n
    above = [2 * v >= k for v in vals]
    turns = sum(a != b for a, b in zip(above, above[1:]))
    mean = sum(vals) / n
    var = sum((v - mean) ** 2 for v in vals)
    serial = sum((a - mean) * (b - mean) for a, b in zip(vals, vals[1:])) / var if var else 1.0
    below = lambda z: 1 / (1 + math.exp(-max(-300, min(300, 1.5976 * z + 0.07056 * z**3))))
    df, uneven = k - 1, n * (k * match - 1)
    p = [
        below((chi - df - uneven) / (2 * (df + 2 * uneven)) ** 0.5),
        below(((n - 1) * secrets.TURNS + 0.5 - turns) / ((n - 1) * secrets.TURNS * (1 - secrets.TURNS)) ** 0.5),
        below((abs(serial) - secrets.SERIAL) * n**0.5),
    ]
    q = -sum(map(math.log, p))
    z_chi = ((max(chi, 0) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / (2 / (9 * df)) ** 0.5
    return max(z_chi, abs((turns - (n - 1) / 2) / ((n - 1) / 4) ** 0.5), abs(serial) * n**0.5), max(p[0], math.exp(-q) * (1 + q + q * q / 2))


def _random_spans(text):
    base = [m.span() for p in (secrets.ASSIGN, secrets.ACCESS, secrets.HEX) for m in re.finditer(p, text) if p != secrets.ASSIGN or len(m[2]) >= 6]
    found = [m.span() for m in re.finditer(secrets.CANDIDATE, text) if not any(a <= m.start() and m.end() <= b for a, b in base)]
    if not found:
        return []
    mean = sum(b - a for a, b in found) / len(found)
    weighed = []
    for a, b in found:
        z, p = _chance(text[a:b])
        weighed.append(p * mean / (b - a) if z <= secrets.REJECT else 1.0)
    passing = [p for i, p in enumerate(sorted(weighed), 1) if p <= secrets.ALPHA * i / len(weighed)]
    return [s for s, p in zip(found, weighed, strict=True) if passing and p <= max(passing)]


def test_random_spans_match_brute_force(spark):
    rng = random.Random(31)
    texts = []
    for _ in range(120):
        parts = []
        for _ in range(rng.randint(0, 6)):
            symbols = rng.choice(secrets.ENCODINGS)[2]
            word = "".join(rng.choice(symbols) for _ in range(rng.choice([20, 24, 32, 48, 80])))
            plain = "".join(rng.choice(["th", "er", "Ing", "tion", "sch", "ent", "_", "/"]) for _ in range(rng.randint(8, 14)))
            parts.append(rng.choice([word, word, plain, "abcdefghijklmnopqrstuvwxyz0123456789", "token: " + word, prose(rng, 5)]))
        texts.append(" ".join(parts))
    got = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    want = {i: _random_spans(t) for i, t in enumerate(texts)}
    assert {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == 3] for r in got} == want
    assert sum(map(len, want.values())) > 40


# operators 8 and 9


@pytest.fixture(scope="module")
def marked(spark):
    rng = random.Random(41)
    docs = []
    for i in range(160):
        w = prose(rng, rng.randint(5, 60)).split()
        bad = i % 3 == 0
        for _ in range(3 if bad else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["vileword", "nastyterm"]))
        docs.append((i, (" ".join(w) * 3 if i % 2 else " ".join(w)), i % 2, int(bad)))
    frame = spark.createDataFrame([*docs, (1000, "", 0, 0), (1001, None, 0, 0)], "doc_id long, text string, quality int, toxic int")
    return frame.select("doc_id", "text"), frame.select("doc_id", "quality", "toxic")


def test_quality_scores_match_brute_force(spark, marked):
    docs, labels = marked
    model = classifier.fit(*fitting.sample(docs, labels.select("doc_id", "quality"), "quality", fitting.remainder(classifier.HELD_OUT) != 2, classifier.PER_CLASS, classifier.MAX_CHARS))
    got = {r.doc_id: r.score for r in classifier.quality(docs, labels).collect()}
    shape = lambda c: "a" if c > 127 or 97 <= c <= 122 else "A" if 65 <= c <= 90 else "0" if 48 <= c <= 57 else " " if c in b"\t\v\f\r" else chr(c)
    for r in docs.collect():
        s, on = [ord(shape(c)) for c in (r.text or "").encode()], set()
        for n in classifier.GRAMS:
            for i in range(len(s) - n + 1):
                h = n
                for x in s[i : i + n]:
                    h = (h * 0x01000193 + x) % 2**32
                on.add((h * 0x9E3779B1) % 2**32 >> 16)
        w = (r.text or "").split()
        if w:
            on.add(classifier.BUCKETS + min(9, int(10 * sum(a == b for a, b in zip(w, w[1:])) / len(w))))
            on.add(classifier.BUCKETS + 10 + min(9, int(10 * len(set(w)) / len(w))))
        on.add(classifier.BUCKETS + 20 + min(11, len(w).bit_length()))
        norm = math.sqrt(sum(model.ratio[i] ** 2 for i in on)) or 1e-12
        margin = sum(model.weights[i] * model.ratio[i] for i in on) / norm + model.bias
        mean, scale, (slope, bias) = model.curve
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-((margin - mean[0]) / scale[0] * slope + bias))), abs=1e-9)


def test_toxicity_scores_match_brute_force(spark, marked):
    import zstandard as zs

    docs, labels = marked
    model = toxicity.fit(*fitting.sample(docs, labels.select("doc_id", "toxic"), "toxic", fitting.remainder(toxicity.HELD_OUT) != 0, toxicity.PER_CLASS, toxicity.MAX_CHARS))
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    params = zs.ZstdCompressionParameters(strategy=zs.STRATEGY_GREEDY, min_match=6, window_log=15, hash_log=15, chain_log=15, search_log=4, write_content_size=False, write_checksum=False, write_dict_id=False)
    good, bad = (zs.ZstdCompressor(compression_params=params, dict_data=zs.ZstdCompressionDict(c, dict_type=zs.DICT_TYPE_RAWCONTENT)) for c in (model.ordinary, model.toxic))
    for r in docs.collect():
        t = (r.text or "").encode().lower()
        at = [i for i in range(0, len(t), toxicity.STRIDE) if i == 0 or i < len(t) - toxicity.WINDOW + toxicity.STRIDE] or [0]
        d = [len(good.compress(t[i : i + toxicity.WINDOW])) - len(bad.compress(t[i : i + toxicity.WINDOW])) for i in at]
        n = len(d)
        x = [max(d), min(max(d), 8), math.log(n), *(sum(v >= k for v in d) / n**0.5 for k in range(3, 9)), sum(max(v - 3, 0) for v in d) / n, sum(v >= 7 for v in d), sum(d) / n]
        mean, scale, w = model.weights
        z = sum((a - m) / s * b for a, m, s, b in zip(x, mean, scale, w)) + w[-1]
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=1e-9)


def test_dictionaries_are_trained_on_windows_of_their_class():
    texts = [b"plain words of running text " * 20 + (b"vileword" if i % 2 else b"kindword") for i in range(400)]
    model = toxicity.fit(texts, np.array([i % 2 for i in range(400)]))
    assert b"vilewo" in model.toxic and b"vilewo" not in model.ordinary


def test_toxicity_on_the_given_labels(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = toxicity.query(spark, d).join(labels, "doc_id").where("held_out").collect()
    ranked = sorted(rows, key=lambda r: r.score)
    ones = [i for i, r in enumerate(ranked, 1) if r.toxic == 1]
    auc = (sum(ones) - len(ones) * (len(ones) + 1) / 2) / (len(ones) * (len(ranked) - len(ones)))
    print("AUC", auc)
    assert auc > 0.8


def test_samples_are_bounded_before_they_are_collected(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 5, f"text {i} " + "x" * 100) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id long, y int")
    texts, y = fitting.sample(docs, labels, "y", F.lit(True), 10, 30)
    assert len(texts) == 5 and all(len(t) == 30 for t in texts)  # one row for each doc_id
    monkeypatch.setattr(fitting, "CLASS_BYTES", 60)
    texts, y = fitting.sample(docs, labels, "y", F.lit(True), 10, 30)
    assert sorted(y) == [0, 0, 1, 1]


# operator 3


def test_link_propagation_matches_sql_on_a_linked_graph(spark, tmp_path):
    rng = random.Random(51)
    hosts = [f"h{i}.{rng.choice(['io', 'net', 'org', 'com'])}" for i in range(120)]
    pages = []
    for i in range(1000):
        near = rng.randrange(len(hosts))
        links = [rng.choice(["http://", "https://", "//"]) + hosts[(near + rng.randint(-9, 9)) % len(hosts)] + "/x" for _ in range(rng.randint(0, 5))]
        html = " ".join(f"<a href={rng.choice(['', chr(34)])}{u}> t</a>" for u in [*links, "/relative"])
        pages.append((i, rng.choice([f"https://{hosts[near]}/{rng.choice(['fr', 'de', 'en'])}/p{i}", f"https://{hosts[near]}/p{i}"]), rng.choice([html, html, html, None])))
    pages += [(2000, None, "<a href='http://h1.io/'>"), (2001, "no address", None)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    frame.coalesce(1).write.parquet(f"{tmp_path}/pages")
    got = urls.judge(frame)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages/*.parquet'")
    cur = con.execute(urls.ORACLE)
    want = plain_rows([c[0] for c in cur.description], cur.fetchall())
    assert plain_rows(got.columns, [tuple(r) for r in got.collect()]) == want
    found = got.where("rule IS NULL AND verdict = 'block'").count()
    assert 0 < found < 600, found


# pipeline


ODD = "doc_id long, text string, lang string, source string, n_chars long, kept string, component_id long, item_id long, spans string"


def _odd(spark):
    rng = random.Random(61)
    fine = "The first plain text says what it says, and it has a number of words that no rule rejects. " + prose(rng, 60)
    other = "Another text of its own comes here with words that differ from all that went before it. " + prose(rng, 60)
    rows = [
        (1, fine, "en", "a", len(fine)), (1, fine, "en", "a", len(fine)), (1, fine, "en", None, len(fine)), (2, fine, "en", "b", len(fine)),
        (None, other, "en", "a", 1), (None, other, "en", "a", 1), (3, None, None, None, None), (4, "", "en", "a", 0),
        (5, prose(rng, 30000), "en", "c", 9), (6, other + " password=abc123xyz", None, None, None),
    ]
    return spark.createDataFrame([(*r, "x", 7, 7, "x") for r in rows], ODD)


def test_stages_on_odd_rows_and_empty_tables(spark, sf_dir, tmp_path):
    for kind, docs in (("odd", _odd(spark)), ("empty", _odd(spark).limit(0))):
        for name, stage in P.STAGES:
            stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{kind}-{name}")
            docs = spark.read.parquet(f"{tmp_path}/{kind}-{name}")
            assert name == "packing" or docs.columns == P.COLUMNS
            if kind == "empty":
                assert docs.isEmpty()
    kept = [r.doc_id for r in spark.read.parquet(f"{tmp_path}/odd-near_dedup").collect()]
    assert kept.count(1) == 1 and 2 not in kept and 3 not in kept and 4 not in kept and kept.count(None) == 2
    one = spark.read.parquet(f"{tmp_path}/odd-near_dedup").where("doc_id = 1").first()
    assert one.source is None  # the least of its rows
    assert "abc123xyz" not in spark.read.parquet(f"{tmp_path}/odd-secret_scans").where("doc_id = 6").first().text


def test_each_stage_takes_odd_rows_as_they_are(spark, sf_dir):
    for _, stage in P.STAGES:
        assert stage(spark, _odd(spark), sf_dir).count() > 0
