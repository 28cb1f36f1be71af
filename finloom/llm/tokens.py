"""Operator 13: how many tokens every text has, huge texts chunk by chunk.

A text of up to ``chunk`` characters is encoded whole.  A longer one is encoded in
chunks that overlap, with the offsets of their tokens, and the token sequences are spliced
where both chunks have a boundary at the same stable place:

* Merging by byte pairs joins what some piece of the vocabulary holds.  Where two
  characters meet that stand side by side in no piece, no token can cover both, whatever
  stands around; such a place cuts the text into parts that are encoded alike alone and
  together.  For byte-level encodings, whose words are split by a pattern first, the
  place before a blank that follows another character is one.
* So the tokens of a chunk are those of the whole text between its first and last stable
  place, and any stable place in the overlap serves, if both sequences have a boundary
  there.  If no place does, the overlap is doubled; where it would reach back to the last
  splice, the chunk is doubled instead, up to the whole rest of the text.

Counting reads every text once, without shuffle; a worker holds one chunk's tokens.

Defined cases: null and empty texts have no tokens and no bytes; rows with null doc_id
are counted; repeated rows get equal counts; strings of special tokens inside texts are
ordinary text for pieces, and what the library makes of them by default for .json; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finloom.llm.common import read

CHUNK, OVERLAP, LIMIT = 1 << 16, 1 << 10, 4096
MODEL = "piece_bpe_32k.model"
#: Characters of short texts that are encoded in one call.
AT_ONCE = 1 << 20
SPACE = "▁"


class Pieces:
    """A sentencepiece model of byte pairs; blanks are a character of its pieces."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()) if not self.model.is_control(i) and not self.model.is_byte(i))
        self.pairs = {ord(a) << 21 | ord(b) for p in pieces for a, b in zip(p, p[1:], strict=False)}
        self.sorted = np.array(sorted(self.pairs), np.int64)

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]

    def begins(self, text: str) -> np.ndarray:
        """Where each token starts; all tokens of a character's bytes start at the character."""
        at = np.array([p.begin for p in self.model.encode(text, return_type="proto").pieces], np.int64)  # in UTF-8
        head = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
        return np.append(0, np.cumsum(head))[at]

    def stable(self, text: str) -> np.ndarray:
        """The places i, 0 < i < length, where text[i - 1] and text[i] are side by side in no piece."""
        c = np.frombuffer(text.replace(" ", SPACE).encode("utf-32-le"), np.uint32).astype(np.int64)
        pair = c[:-1] << 21 | c[1:]
        at = np.minimum(np.searchsorted(self.sorted, pair), max(0, len(self.sorted) - 1))
        return np.flatnonzero(self.sorted[at] != pair) + 1 if len(self.sorted) else np.arange(1, len(c))


class Bytes:
    """A tokenizers file of byte pairs within words; words don't go past a blank that follows another character."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_padding()
        self.model.no_truncation()

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x.ids) for x in self.model.encode_batch(texts, add_special_tokens=False)]

    def begins(self, text: str) -> np.ndarray:
        return np.array([a for a, _ in self.model.encode(text, add_special_tokens=False).offsets], np.int64)

    def stable(self, text: str) -> np.ndarray:
        c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        letter = ((c[:-1] | 32) >= 97) & ((c[:-1] | 32) <= 122) & (c[:-1] < 128)
        return np.flatnonzero(letter & (c[1:] == 32)) + 1


@lru_cache(maxsize=4)
def encoder(path: str):
    return Pieces(path) if path.endswith(".model") else Bytes(path)


def spliced(text: str, model, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """The number of tokens of a text, from chunks of about ``chunk`` characters."""
    n, total, lo, since, size, begins = len(text), 0, 0, 0, chunk, None
    while True:
        hi = min(n, lo + size)
        if begins is None:
            begins = model.begins(text[lo:hi]) + lo
        if hi == n:
            return total + int((begins >= since).sum())
        back, met = overlap, None
        while met is None and hi - back > since:
            start = hi - back
            end = min(n, start + max(chunk, 2 * back))
            after = model.begins(text[start:end]) + start
            places = model.stable(text[start:hi]) + start
            places = places[np.isin(places, begins) & np.isin(places, after)]
            if len(places):
                met = int(places[len(places) // 2])
            back *= 2
        if met is None:
            size, begins = size * 2, None
            continue
        total += int(((begins >= since) & (begins < met)).sum())
        lo, since, size, begins = start, met, end - start, after


def counter(path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
    """Function on Arrow batches of (doc_id, text): doc_id, n_tokens."""

    def run(batches):
        import pyarrow as pa

        model = encoder(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            out, short, size = np.zeros(len(texts), np.int64), [], 0

            def flush():
                if short:
                    out[short] = model.counts([texts[i] for i in short])

            for i, t in enumerate(texts):
                if not t:
                    continue
                if len(t) > chunk:
                    out[i] = spliced(t, model, chunk, overlap)
                    continue
                short.append(i)
                size += len(t)
                if size >= AT_ONCE:
                    flush()
                    short, size = [], 0
            flush()
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "n_bytes")), pa.array(out)], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row per row of ``docs``; ``path`` names a .model or .json file that all workers have."""
    sized = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    counted = sized.mapInArrow(counter(path, chunk, overlap), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))
