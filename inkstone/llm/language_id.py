"""Operator 5: language identification of words by a linear-chain conditional random field.

Each word has features: its beginnings and ends, the runs of 2 to 4 bytes in it and the word itself
(the lexicon), hashed into DIM buckets with a weight for each language. Learned weights of
the transitions tie neighbouring words together. Forward-backward gives each word's probability of
each language, so code-switched texts are labelled word by word; a text's language is the one with the
largest sum of these, and its score that sum over the number of words.

Learning takes at most SAMPLE texts of the folds that may be learnt from; each word's label is its
text's. The gradient of the log-likelihood is exact, by forward-backward over whole texts.

Defined cases: a null text or one without a letter is "und" with score 0, as is any text where there
is nothing to learn from; ties go to the smallest name; rows that repeat are each labelled; columns
other than doc_id, text and, for learning, lang are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import SAMPLE_BYTES, arrow_map, collected, crc_mod, table, utf8_view

DIM_BITS = 18
DIM = 1 << DIM_BITS
SAMPLE = 1500
EPOCHS = 8
RATE, L2 = 0.5, 1e-5
CACHE = 150_000
PADDED = 300_000
UNKNOWN = "und"
TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+")


def word_features(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, owners, how many) of the features of words: runs of 2, 3 and 4 bytes of ^word$, and the word.

    Runs with ^ or $ are the beginnings and ends. Words are taken in lower case.
    """
    words = [b"^" + t.decode("utf-8", "replace").lower().encode() + b"$" for t in tokens]
    length = np.array([len(w) for w in words], np.int64)
    data = np.frombuffer(b"".join(words) + b"   ", np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), length)
    to_end = np.repeat(np.cumsum(length), length) - np.arange(len(owner))
    code, buckets, owners = data[: len(owner)], [np.array([zlib.crc32(w) % DIM for w in words], np.int64)], [np.arange(len(words))]
    for n in (2, 3, 4):
        code = (code << np.uint64(8)) | data[n - 1 : n - 1 + len(owner)]
        whole = to_end >= n
        buckets.append((((code[whole] << np.uint64(3)) + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - DIM_BITS)).astype(np.int64))
        owners.append(owner[whole])
    owners = np.concatenate(owners)
    return np.concatenate(buckets), owners, np.bincount(owners, minlength=len(words))


@dataclass
class Crf:
    langs: list[str]
    emit: np.ndarray  # DIM x languages
    trans: np.ndarray  # log weights, from x to


def padded_batches(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Texts in order of length, longest first, cut so that a batch has at most PADDED places (or one text)."""
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    at = 0
    while at < len(order):
        n = max(1, int(PADDED // lengths[order[at]]))
        yield order[at : at + n]
        at += n


def forward_backward(scores: np.ndarray, lengths: np.ndarray, trans: np.ndarray, pairs: bool = False):
    """Marginals of each place (places x texts x languages), and the summed pair marginals if asked for.

    ``scores`` has exp'd emissions; texts are in order of length, longest first, so that at each place
    the texts still running are a prefix. Messages are normalised at each place.
    """
    steps, _, k = scores.shape
    move = np.exp(trans - trans.max()).astype(scores.dtype)
    running = (lengths[None, :] > np.arange(steps)[:, None]).sum(1)
    alpha = scores.copy()
    alpha[0] /= alpha[0].sum(1, keepdims=True)
    for t in range(1, steps):
        n = running[t]
        a = (alpha[t - 1, :n] @ move) * scores[t, :n]
        alpha[t, :n] = a / a.sum(1, keepdims=True)
    beta = np.full((scores.shape[1], k), 1.0 / k, scores.dtype)
    count = np.zeros((k, k))
    for t in range(steps - 2, -1, -1):
        n = running[t + 1]
        after = beta[:n] * scores[t + 1, :n]
        if pairs:
            m = alpha[t, :n, :, None] * move[None] * after[:, None, :]
            count += (m / m.sum((1, 2), keepdims=True)).sum(0)
        # marginals of place t + 1 replace its forward messages, which are not needed any more
        alpha[t + 1, :n] *= beta[:n]
        b = after @ move.T
        beta[:n] = b / b.sum(1, keepdims=True)
    alpha[0] *= beta
    alpha /= np.maximum(alpha.sum(2, keepdims=True), 1e-30)
    return alpha, running, count


def train(sample: list[tuple[str, str]], epochs: int = EPOCHS) -> Crf | None:
    """AdaGrad ascent on the mean log-likelihood of a word, over batches of whole texts."""
    langs = sorted({y for _, y in sample})
    if not langs:
        return None
    k, types, texts, gold = len(langs), {}, [], []
    for text, y in sample:
        ids = [types.setdefault(t, len(types)) for t in TOKEN.findall(text.encode())]
        if ids:
            texts.append(np.array(ids, np.int64))
            gold.append(langs.index(y))
    flat, owner, size = word_features(list(types))
    n_types, size = len(types), size[:, None]
    lengths, gold = np.array([len(t) for t in texts], np.int64), np.array(gold, np.int64)
    emit, trans = np.zeros((DIM, k)), np.zeros((k, k))
    g_emit, g_trans = np.full((DIM, k), 1e-6), np.full((k, k), 1e-2)
    batches = list(padded_batches(lengths))
    for epoch in range(epochs):
        for b in np.random.default_rng(epoch).permutation(len(batches)):
            rows = batches[b]
            n = lengths[rows]
            place = np.arange(n[0])[:, None]
            inside = place < n[None, :]
            words = np.zeros(inside.shape, np.int64)
            for j, r in enumerate(rows):
                words[: n[j], j] = texts[r]
            type_scores = np.stack([np.bincount(owner, emit[flat, c], n_types) for c in range(k)], 1) / np.sqrt(size)
            scores = np.exp(np.clip(type_scores[words] - type_scores[words].max(2, keepdims=True), -30, 0))
            marginal, _, pair = forward_backward(scores, n, trans, pairs=True)
            miss = -marginal
            miss[place, np.arange(len(rows))[None, :], gold[rows][None, :]] += 1
            miss *= inside[:, :, None]
            total = inside.sum()
            by_type = np.stack([np.bincount(words.ravel(), miss[:, :, c].ravel(), n_types) for c in range(k)], 1) / np.sqrt(size) / total
            grad = np.stack([np.bincount(flat, by_type[owner, c], DIM) for c in range(k)], 1) - L2 * emit
            g_emit += grad * grad
            emit += RATE * grad / np.sqrt(g_emit)
            want = np.zeros((k, k))
            np.add.at(want, (gold[rows], gold[rows]), n - 1)
            grad = (want - pair) / total - 1e-3 * trans
            g_trans += grad * grad
            trans += RATE * grad / np.sqrt(g_trans)
    return Crf(langs, emit.astype(np.float32), trans)


class Emissions:
    """exp'd emissions of words already seen, by row; emptied between batches where they have grown to CACHE."""

    def __init__(self, model: Crf):
        self.model, self.rows = model, {}
        self.table = np.zeros((1024, len(model.langs)), np.float32)

    def ids(self, tokens: list[bytes]) -> np.ndarray:
        rows, new = self.rows, []
        for t in set(tokens):
            if t not in rows:
                rows[t] = len(rows)
                new.append(t)
        if new:
            while len(rows) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            flat, owner, size = word_features(new)
            s = np.stack([np.bincount(owner, self.model.emit[flat, c], len(new)) for c in range(self.table.shape[1])], 1) / np.sqrt(size)[:, None]
            self.table[len(rows) - len(new) : len(rows)] = np.exp(np.clip(s - s.max(1, keepdims=True), -30, 0))
        return np.fromiter(map(rows.__getitem__, tokens), np.int64, len(tokens))

    def trim(self) -> None:
        if len(self.rows) > CACHE:
            self.rows, self.table = {}, self.table[:1024].copy()


def word_marginals(texts: list[bytes], emissions: Emissions) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, lengths, marginals) batch by batch; texts without words are in none."""
    model = emissions.model
    tokens = [TOKEN.findall(t) for t in texts]
    emissions.trim()
    ids = [emissions.ids(t) if t else np.zeros(0, np.int64) for t in tokens]
    lengths = np.array([len(t) for t in ids], np.int64)
    for rows in padded_batches(lengths):
        n = lengths[rows]
        words = np.zeros((n[0], len(rows)), np.int64)
        for j, r in enumerate(rows):
            words[: n[j], j] = ids[r]
        marginal, _, _ = forward_backward(emissions.table[words], n, model.trans)
        marginal *= (np.arange(n[0])[:, None] < n[None, :])[:, :, None]
        yield rows, n, marginal


def has_letter(text: bytes) -> bool:
    return bool(re.search(rb"[A-Za-z]", text)) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


def predict(texts: list[bytes], emissions: Emissions | None) -> tuple[list[str], np.ndarray]:
    langs, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if emissions:
        for rows, n, marginal in word_marginals(texts, emissions):
            total = marginal.sum(0, dtype=np.float64) / n[:, None]
            best = total.argmax(1)
            for j, r in enumerate(rows):
                if has_letter(texts[r]):
                    langs[r], score[r] = emissions.model.langs[best[j]], min(1.0, total[j, best[j]])
    return langs, score


def _predict(batches: Iterator[pa.RecordBatch], model: Crf | None) -> Iterator[pa.RecordBatch]:
    emissions = Emissions(model) if model else None
    for batch in batches:
        data, off = utf8_view(batch.column(2))
        raw = data.tobytes()
        langs, score = [], []
        for k in range(0, batch.num_rows, 2048):
            got = predict([raw[off[i] : off[i + 1]] for i in range(k, min(k + 2048, batch.num_rows))], emissions)
            langs += got[0]
            score.append(got[1])
        score = np.concatenate(score) if score else []
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(langs, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])


def identify(docs: DataFrame, model: Crf | None, held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row of ``docs``."""
    return arrow_map(docs.select("doc_id", (F.lit(False) if held_out is None else held_out).alias("held_out"), "text"), partial(_predict, model=model), "doc_id long, held_out boolean, lang_pred string, score double")


def fitted(docs: DataFrame, most_bytes: int = SAMPLE_BYTES) -> Crf | None:
    """A model of at most SAMPLE texts, those first in the order of a hash of doc_id, of the folds other than 2.

    An id is one row, with its smallest text, before anything is collected; the texts have ``most_bytes`` at most.
    """
    known = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod("doc_id", 4) != 2))
    order = F.xxhash64("doc_id")
    ids = known.select("doc_id").distinct().orderBy(order, "doc_id").limit(SAMPLE)
    rows = known.select("doc_id", "text", "lang").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("_x"))
    got = collected(rows.select("doc_id", "_x.text", "_x.lang"), most_bytes)
    return train([(r.text, r.lang) for r in got])


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fitted(docs), crc_mod("doc_id", 4) == 2)
