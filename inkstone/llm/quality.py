"""Operator 10: quality by hashed word n-grams and logistic regression, learnt by FTRL-proximal.

Words are runs of letters and digits or runs of other visible characters, so that marks are words too.
The n-grams are single words, pairs of words, and triples of word classes (letter case, digits, the
mark itself, and whether the word repeats the one before). Each is hashed into DIM buckets; a text's
features are the buckets' counts over its number of words, and its score the logistic of their sparse
dot product with the weights.

Learning takes at most SAMPLE labelled rows of the folds that may be learnt from, in whole texts, and
passes over them EPOCHS times. Without any labelled row each score is 0.5.

Defined cases: a null or empty text has the bias alone; rows that repeat are each scored; other
columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import arrow_map, crc_mod, labelled_sample, table, utf8_view

DIM = 1 << 20
SAMPLE = 6000
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.2, 1.0, 0.02, 0.5
SCALE = 8.0
CACHE = 200_000
ROWS = 256
TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\s0-9A-Za-z\x80-\xff]+")
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def word_code(token: bytes) -> int:
    """A hash of the lower-case word, with the word's class in the lowest 4 bits."""
    text = token.decode("utf-8", "replace")
    if not (text[0].isalnum() or token[0] >= 0x80):
        kind = 8 + zlib.crc32(token) % 8
    elif text.isdigit():
        kind = 0
    elif text.isupper():
        kind = 1 if len(text) > 1 else 2
    elif text[0].isupper():
        kind = 3
    elif text.islower():
        kind = 4 if len(text) > 3 else 5
    else:
        kind = 6
    low = text.lower().encode()
    return (zlib.crc32(low) << 20 | (zlib.crc32(low, 77) & 0xFFFF) << 4) | kind


class Codes(dict):
    """Codes of words already seen, emptied where it has grown to CACHE words."""

    def __missing__(self, token: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[token] = code = word_code(token)
        return code


def features(texts: list[bytes], codes: Codes) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, ends): the buckets of all n-grams, text by text, with each text's end among them."""
    tokens: list[bytes] = []
    ends = np.zeros(len(texts) + 1, np.int64)
    for i, text in enumerate(texts):
        tokens += TOKEN.findall(text)
        ends[i + 1] = len(tokens)
    n = len(tokens)
    if not n:
        return np.zeros((0, 3), np.int64), ends
    code = np.fromiter(map(codes.__getitem__, tokens), np.uint64, n)
    first = np.zeros(n, bool)
    first[ends[:-1][ends[:-1] < ends[1:]]] = True
    before = np.roll(code, 1)
    before[first] = 0
    kind = (code & np.uint64(15)) | ((before == code).astype(np.uint64) << np.uint64(4))
    kind1 = np.roll(kind, 1)
    kind1[first] = 32
    kind2 = np.roll(kind1, 1)
    kind2[first] = 33
    word, shift = code >> np.uint64(4), np.uint64(44)
    one = (word * M1) >> shift
    two = ((word * M1) ^ ((before >> np.uint64(4)) * M2) + M3) * M2 >> shift
    three = (((kind + np.uint64(1)) * M3) ^ ((kind1 + np.uint64(64)) * M1) ^ ((kind2 + np.uint64(4096)) * M2)) * M1 >> shift
    return np.stack([one, two, three], 1).astype(np.int64), ends


def train(sample: list[tuple[str, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """(weights, bias) after passes of FTRL-proximal over the sample, one text at a time."""
    z, n, codes = np.zeros(DIM + 1), np.zeros(DIM + 1), Codes()

    def weights(at):
        zi = z[at]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for text, y in sample:
            buckets, _ = features([text.encode()], codes)
            at, count = np.unique(buckets, return_counts=True)
            at, x = np.append(at, DIM), np.append(count * (SCALE / max(1, len(buckets))), 1.0)
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    every = weights(np.arange(DIM + 1))
    return every[:DIM].astype(np.float32), float(every[DIM])


def scores(texts: list[bytes], weights: np.ndarray, bias: float, codes: Codes) -> np.ndarray:
    buckets, ends = features(texts, codes)
    total = np.concatenate([[0.0], np.cumsum(weights[buckets].sum(1, dtype=np.float64))])
    size = np.maximum(1, ends[1:] - ends[:-1])
    margin = bias + SCALE * (total[ends[1:]] - total[ends[:-1]]) / size
    return 1 / (1 + np.exp(-np.clip(margin, -35, 35)))


def _score(batches: Iterator[pa.RecordBatch], at: np.ndarray, value: np.ndarray, bias: float) -> Iterator[pa.RecordBatch]:
    weights, codes = np.zeros(DIM, np.float32), Codes()
    weights[at] = value
    for batch in batches:
        data, off = utf8_view(batch.column(2))
        raw = data.tobytes()
        out = [scores([raw[off[i] : off[i + 1]] for i in range(k, min(k + ROWS, batch.num_rows))], weights, bias, codes) for k in range(0, batch.num_rows, ROWS)]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(np.concatenate(out) if out else [], pa.float64())], ["doc_id", "held_out", "score"])


def quality_scores(docs: DataFrame, weights: np.ndarray, bias: float, held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out and score of each row of ``docs``."""
    at = np.flatnonzero(weights)
    fn = partial(_score, at=at, value=weights[at], bias=bias)
    return arrow_map(docs.select("doc_id", (F.lit(False) if held_out is None else held_out).alias("held_out"), "text"), fn, "doc_id long, held_out boolean, score double")


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights, bias = train(labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", 3, 1, SAMPLE))
    scored = quality_scores(docs, weights, bias, crc_mod("doc_id", 3) == 1)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
