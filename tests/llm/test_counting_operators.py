"""Operators 11, 12 and 13 against plain Python, and on odd input."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from finloom.llm import centroids as C
from finloom.llm import collocations as K
from finloom.llm import registry
from finloom.llm import tokens as T
from tests.compare import engine, same

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path(T.MODEL)


@pytest.mark.parametrize("name", ["op11_centroid_clustering", "op12_phrase_collocations"])
def test_queries_match_sql(spark, sf_dir, name):
    same(spark, engine(sf_dir), sf_dir, registry.QUERIES[name], registry.ORACLES[name])


# operator 11


def _check_tree(t, points, leaf):
    assert sorted(map(tuple, t.points.tolist())) == sorted(map(tuple, points.tolist()))
    for i in range(len(t.lo)):
        d = np.sqrt(((t.points[t.lo[i] : t.hi[i]] - t.points[t.centre[i]]) ** 2).sum(1).astype(float))
        assert abs(d.max() - t.radius[i]) < 1e-9
        kids = range(t.child[i], t.child[i] + t.children[i])
        if t.children[i]:
            assert (t.lo[i], t.hi[i]) == (t.lo[kids[0]], t.hi[kids[-1]]) and all(t.hi[a] == t.lo[a + 1] for a in kids[:-1])
            cover = 2.0 ** (np.ceil(np.log2(t.radius[i])) - 1)
            heads = t.points[t.centre[list(kids)]]
            gaps = [np.sqrt(((a - b) ** 2).sum()) for n, a in enumerate(heads) for b in heads[:n]]
            assert all(t.radius[k] <= cover for k in kids) and all(g > cover for g in gaps)
        else:
            assert t.hi[i] - t.lo[i] <= leaf or t.radius[i] == 0


@pytest.mark.parametrize("seed", range(6))
def test_walk_over_two_trees_finds_the_nearest(seed):
    rng = np.random.default_rng(seed)
    wide = (3, 40, 2)[seed % 3]
    points = rng.integers(-wide, wide, (300, 4 if seed % 2 else 16))
    points = np.concatenate([points, points[:40], np.repeat(points[:1], 60, 0)])
    heads = np.concatenate([rng.integers(-wide, wide, (30, points.shape[1])), points[:6], points[:3]])  # equal centroids, and those on vectors
    tree, over = C.cover_tree(points), C.cover_tree(heads, 1)
    _check_tree(tree, points, C.LEAF)
    _check_tree(over, heads, 1)
    want = ((tree.points[:, None, :] - heads[None]) ** 2).sum(2).argmin(1)
    assert (C.nearest(tree, over) == want).all()


def _lloyd(rows, k, rounds, dim):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) and abs(x) < C.LIMIT for x in v)]
    heads = [p for _, _, p in sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), n, p) for n, (i, p) in enumerate(sorted(kept, key=lambda r: r[1])) if i is not None)[:k]]
    d2 = lambda p, q: sum((a - b) ** 2 for a, b in zip(p, q, strict=True))
    best = lambda p: min(range(len(heads)), key=lambda c: (d2(p, heads[c]), c))
    for _ in range(rounds):
        of = [best(p) for _, p in kept]
        heads = [[sum(x) // len(x) for x in zip(*m, strict=True)] if (m := [p for (_, p), c in zip(kept, of, strict=True) if c == n]) else h for n, h in enumerate(heads)]
    of = [best(p) for _, p in kept]
    dist = [d2(p, heads[c]) for (_, p), c in zip(kept, of, strict=True)]
    mass = Counter()
    for c, d in zip(of, dist, strict=True):
        mass[c] += d
    sha = [hashlib.sha256(",".join(map(str, h)).encode()).hexdigest() for h in heads]
    return sorted(str((i, c, d, mass[c], sum(dist), sha[c])) for (i, _), c, d in zip(kept, of, dist, strict=True))


def test_clusters_match_plain_rounds_on_odd_vectors(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-0.51, -0.02, 0.003, 0.4]) + rng.random() / 8 for _ in range(5)]) for i in range(120)]
    rows += [rows[3], (3, rows[9][1]), (None, rows[5][1]), (200, None), (201, []), (202, [1.0] * 4), (203, [None] + [1.0] * 4), (204, [float("nan")] * 5), (205, [float("inf")] * 5), (206, [1e9] * 5)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, cluster string, distance int").repartition(3)
    got = sorted(str(tuple(r)) for r in C.clusters(df, k=7, rounds=3, dim=5).collect())
    assert got == _lloyd(rows, 7, 3, 5)
    few = C.clusters(df.where("vec_id in (1, 2)"), k=7, rounds=2, dim=5).collect()
    assert {r.distance for r in few} == {0} and len(few) == 2
    assert C.clusters(df.limit(0), dim=5).count() == 0


# operator 12


def _phrases(rows, spec):
    f, n = {}, Counter()
    for lang, text in rows:
        lang, t = lang or "und", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for d in ".,;:!?\n\x0b\x0c\r":
            t = t.replace(d, ".")
        for piece in t.split("."):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            n[lang] += len(w)
            for k in range(1, spec.longest + 1):
                for i in range(len(w) - k + 1):
                    key = lang, tuple(w[i : i + k])
                    f[key] = f.get(key, 0) + 1
    out = {}
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= spec.least}
    within = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
    for (lang, p), a in cand.items():
        if any(x == lang and len(q) > len(p) and within(p, q) and 100 * b >= spec.inside_pct * a for (x, q), b in cand.items()):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, v in out.items() for i, (s, a, p, left, right) in enumerate(sorted(v)[: spec.top]))


def test_phrases_match_plain_counts_on_odd_texts(spark):
    rng = random.Random(2)
    vocabulary = ["of", "the", "Of", "THE", "New", "york", "ß", "漢字", "a", "b"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ",", "!"]) for _ in range(n))
    rows = [(rng.choice(["en", "de", None, "und"]), text(rng.randrange(80))) for _ in range(150)] + [("en", None), ("xx", ""), ("en", "a " * 900), ("en", "a " * 900), ("de", text(6000))]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, text string, phrase string, rank int").repartition(5)
    for spec in (K.Spec(least=9, top=25, bits=20), K.Spec(longest=3, least=30, top=1000, bits=20, inside_pct=60), K.Spec(least=9, top=25, bits=8)):  # the last sketch is full
        assert sorted(tuple(r) for r in K.collocations(df, spec).collect()) == _phrases(rows, spec)
    assert K.collocations(df.limit(0), K.Spec(bits=12)).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    big = 3 * 10**15 + 1
    counts = spark.createDataFrame([("en", 0, "", 10**16 + 7), ("en", 1, "a", big), ("en", 1, "b", big + 5), ("en", 2, "a b", big - 3)], "lang string, k int, phrase string, a long")
    (row,) = K.scored(counts, K.Spec(), K.Staging(spark, "test")).collect()
    assert row.score == 1000 * (big - 3) * (10**16 + 7) // (big * (big + 5))


def test_stretches_keep_pieces_and_bound_memory():
    rows = [("en", b"one two. three four, five"), ("de", b"x" * 50 + b" y. z"), ("en", None), ("en", b"")]
    for step in (1, 7, 1000):
        got = [(lang, p.strip()) for lang, t in K.stretches(iter(rows), step) for p in t.split(b".") if p.strip()]
        assert sorted(got) == sorted([("en", b"one two"), ("en", b"three four"), ("en", b"five"), ("de", b"x" * 50 + b" y"), ("de", b"z")])


# operator 13

ALPHABET = ["the ", "of", "and ", " ", "  ", "\n", "\t", "漢字", "ß", "\U0001f600", "</s>", "<s>", "<unk>", "a", "zz", "1234", "\x00", "▁", "##", ". ", "x" * 9]


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
def test_spliced_chunks_have_the_tokens_of_the_whole(name):
    model, rng = T.encoder(public_tokenizers.path(name)), random.Random(3)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(1, 500))) for _ in range(120)]
    texts += ["漢字" * 700, "ab" * 900, " " * 2000, "\U0001f600" * 500, "x y" * 900, "1" * 999]
    for t in texts:
        assert T.spliced(t, model, rng.choice([16, 64, 300]), rng.choice([1, 4, 16])) == model.counts([t])[0]


def test_no_piece_covers_a_stable_place():
    model, rng = T.encoder(MODEL), random.Random(8)
    for _ in range(60):
        t = "".join(rng.choice(ALPHABET) for _ in range(200))
        assert set(model.stable(t)) <= set(model.begins(t))


def test_token_counts_of_odd_rows(spark):
    long = "of the </s> stone\n" * 9000
    rows = [(1, None), (2, ""), (None, "of the"), (3, long), (3, long), (4, "漢字\U0001f600</s>"), (5, " " * 70000)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_tokens int")
    model = T.encoder(MODEL)
    want = sorted(str((i, len((t or "").encode()), n := len(model.model.encode(t or "")), n > T.LIMIT)) for i, t in rows)
    assert sorted(str(tuple(r)) for r in T.token_counts(df, MODEL).collect()) == want
    assert T.token_counts(df.limit(0), MODEL).count() == 0


def test_query_counts_every_document(spark, sf_dir):
    model = T.encoder(MODEL)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in registry.QUERIES["op13_token_counts"](spark, sf_dir).collect()}
    assert got == {i: (len(t.encode()), len(model.model.encode(t))) for i, t in texts.items()}
