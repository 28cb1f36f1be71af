"""Operator 9: toxicity by compression distance.

Two zstandard dictionaries are trained, one on windows of toxic and one on windows of
ordinary training rows.  Every window of a document is compressed with both; where
the toxic dictionary makes it shorter, the window resembles toxic text.  The
thresholds on these differences, and the weights of how often they are passed, are
calibrated on training rows that the dictionaries haven't seen.

Most of a toxic row is ordinary text, so its training windows are those that set the
toxic rows apart: around words whose distinct contexts (word before, word after), or
those of all words with the same start, are too many among them, RATIO times those
expected and ``z`` standard deviations.  Contexts count once, so copies of a document
don't.  The ordinary windows are as many, around words drawn from ordinary rows.
Both dictionaries are loaded as content after one stretch of ordinary text, which
both know alike, so that ordinary windows differ little.

Fitting is bounded: about ``per_class`` rows of each class, of ``max_chars`` each.
Scoring reads every whole text in one pass without shuffle.

Defined cases: null and empty texts are scored as one empty window; without labels of
both classes every score is 0; rows with null doc_id are scored and not held out;
repeated rows get equal scores; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finloom.llm import fitting
from finloom.llm.common import read

WINDOW, STRIDE, DICTIONARY, SHARED = 48, 24, 8192, 16384
#: Segment and pattern length of the dictionary trainer.
SEGMENT, PATTERN = 16, 6
PER_CLASS, MAX_CHARS, Z = 2000, 65536, 3.0
STARTS, RATIO = (5, 6), 4
HELD_OUT, THRESHOLD = 5, 0.5


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple | None

    def measures(self, texts) -> np.ndarray:
        """Per text the features of its windows' length differences."""
        plain, toxic = (_lengths(d) for d in (self.ordinary, self.toxic))
        out = []
        for text in texts:
            t = (text or b"").lower()
            d = []
            for i in range(0, max(1, len(t) - (WINDOW - STRIDE)), STRIDE):
                w = t[i : i + WINDOW]
                d.append(len(plain(w)) - len(toxic(w)))
            d = np.array(d)
            root = len(d) ** 0.5
            passed = [(d >= k).sum() / root for k in range(3, 9)]
            out.append([d.max(), min(d.max(), 8), math.log(len(d)), *passed, np.maximum(d - 3, 0).sum() / len(d), (d >= 7).sum(), d.mean()])
        return np.array(out, float).reshape(len(out), 12)

    def scores(self, texts) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(texts))
        return fitting.probability(self.weights, self.measures(texts))


def _lengths(content: bytes):
    """The compressor of a dictionary's content; matches have six bytes or more."""
    import zstandard as zs

    params = zs.ZstdCompressionParameters(
        strategy=zs.STRATEGY_GREEDY, min_match=6, window_log=15, hash_log=15, chain_log=15, search_log=4,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    held = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
    return zs.ZstdCompressor(compression_params=params, dict_data=held).compress


def _contexts(texts) -> tuple[Counter, int]:
    """Distinct contexts by word and by the starts of words, and of all words."""
    seen = set()
    for t in texts:
        w = [b"", *t.lower().split(), b""]
        seen.update(zip(w, w[1:], w[2:], strict=False))
    return Counter(f for x in seen for f in _forms(x[1])), max(1, len(seen))


def _forms(word: bytes) -> list[bytes]:
    """The word and its starts of five bytes or more; starts end in an asterisk."""
    return [word, *(word[:k] + b"*" for k in STARTS if k < len(word))]


def _windows(texts, words) -> list[bytes]:
    """The places of ``words`` in the texts, each with the character before and after it."""
    out = []
    for text in texts:
        t, at = b" " + text.lower() + b" ", 0
        for w in t.split():
            at = t.find(w, at)
            if w in words:
                out.append(t[at - 1 : at + len(w) + 1])
            at += len(w)
    return out


def _drawn(texts, n: int) -> list[bytes]:
    """n words of the texts with the characters around them; texts and places are drawn evenly."""
    rng, out = random.Random(3), []
    for _ in range(n):
        t = b" " + rng.choice(texts).lower() + b" "
        a = t.find(b" ", rng.randrange(len(t))) % len(t)
        z = t.find(b" ", a + 1)
        out.append(t[a : z + 1] if z > a else t[:SEGMENT])
    return out


def _dictionary(windows: list[bytes], size: int) -> bytes:
    """A trained zstandard dictionary; the windows themselves where they are too few to train on."""
    import zstandard as zs

    try:
        return zs.train_dictionary(size, windows, k=SEGMENT, d=PATTERN).as_bytes()
    except zs.ZstdError:
        return b"".join(sorted(set(windows)))[-size:]


def fit(texts: list[bytes], y: np.ndarray, z: float = Z) -> Model:
    toxic = [t for t, v in zip(texts, y, strict=True) if v]
    plain = [t for t, v in zip(texts, y, strict=True) if not v]
    if not toxic or not plain:
        return Model(b"", b"", None)
    cut_t, cut_p = max(1, len(toxic) * 3 // 4), max(1, len(plain) * 3 // 4)
    t, nt = _contexts(toxic[:cut_t])
    p, np_ = _contexts(plain[:cut_p])

    def excess(w: bytes) -> float:
        expected = p[w] * nt / np_
        return (t[w] - expected) / math.sqrt(t[w] + expected) if t[w] > RATIO * expected else 0.0

    found = {w for x in toxic[:cut_t] for w in x.lower().split() if len(w) > 2}
    ranked = sorted(((max(map(excess, _forms(w))), w) for w in found), key=lambda x: (-x[0], x[1]))
    strong = {w for s, w in ranked if s >= z} or {w for s, w in ranked[:32] if s > 0}
    marked = _windows(toxic[:cut_t], strong)
    usual = _drawn(plain[:cut_p], len(marked))
    bad, good = _dictionary(marked, DICTIONARY), _dictionary(usual, DICTIONARY)
    n = min(len(bad), len(good))
    shared = b" ".join(x[:400].lower() for x in plain[:64])[:SHARED]
    model = Model(shared + good[-n:], shared + bad[-n:], None)
    held, label = toxic[cut_t:] + plain[cut_p:], [1] * (len(toxic) - cut_t) + [0] * (len(plain) - cut_p)
    if len(set(label)) < 2:
        held, label = toxic + plain, [1] * len(toxic) + [0] * len(plain)
    # the sample is balanced by design: calibrated odds are those of equal classes
    model.weights = fitting.logistic(model.measures(held), np.array(label, float))
    return model


def scorer(model: Model):
    """Function on Arrow batches of (doc_id, text): scores."""

    def score(batches):
        import pyarrow as pa

        from finloom.llm import hashing as H

        for batch in batches:
            yield pa.record_batch([batch.column("doc_id"), pa.array(model.scores(H.texts(batch.column("text"))), pa.float64())], names=["doc_id", "score"])

    return score


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of ``docs``."""
    docs = docs.select("doc_id", "text")
    fold = fitting.remainder(HELD_OUT)
    model = fit(*fitting.sample(docs, labels.select("doc_id", "toxic"), "toxic", fold != 0, per_class, max_chars))
    scored = docs.mapInArrow(scorer(model), "doc_id long, score double")
    return scored.select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
