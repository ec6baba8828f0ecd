"""Operator 9: benchmark decontamination by a BM25 index of the test items with block-max WAND.

Test items, cut into pieces of PIECE words, are indexed once; every passage of every training text is a
query. A passage is WINDOW words, half of them shared with the next one. A piece is retrieved if its BM25
score reaches the share THRESHOLD of the score that it has with itself; impacts are divided by that bound,
so that the threshold is 1 for all pieces.

Postings are arrays of blocks of BLOCK pieces, with the largest impact that a term has in each block and in all.
Terms are numbered by the length of their postings, longest first, and so are a passage's terms in order. Their largest
impacts are added up; where the sum doesn't reach the threshold, the passage is done. The term that brings it to PIVOT of
the threshold is the pivot, and only the postings from there on are read: no piece can do by the terms before alone. They
tell the blocks that are worth a look, with what they add there at most. Where that and the largest impacts before
the pivot reach the threshold, the latter are looked up block by block. The blocks still left are scored piece by piece, and a piece is left where what
is yet to come can't do. No piece above the threshold is missed. All passages of a batch go through each step together.

A retrieved item is verified in the passage and as many words around it as the item has: of its word
NGRAM-grams those ending in the question and those ending in the answer (its last sentence) are looked up.
Both shares must reach their minima.

Defined cases: null or empty texts and items match nothing; items of fewer words than NGRAM are matched as
a whole; rows that repeat a text are each reported; rows that repeat an item_id are one item each; columns
other than doc_id, text and item_id are not read; without items nothing is contaminated.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import arrow_map, checkpointed, distinct, table, utf8_view

WINDOW, PIECE, BLOCK = 128, 48, 2
K1, B = 1.2, 0.75
THRESHOLD = 0.6
NGRAM, MIN_QUESTION, MIN_ANSWER = 4, 0.6, 0.5
#: Items, and bytes of their texts, that are sent to the executors at once; more are matched in rounds.
MAX_ITEMS, MAX_BYTES = 50_000, 32 << 20
#: Share of the threshold that the terms before the pivot may sum up to (less than 1).
PIVOT = 0.6
#: Texts that are searched at once, and postings that are read at once.
TEXTS, POSTINGS = 512, 1 << 21
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


@dataclass
class Item:
    item_id: int
    words: list[bytes]
    answer_from: int  # word at which the last sentence starts, or the number of words

    @property
    def grams(self) -> list[tuple[bytes, ...]]:
        n = min(NGRAM, len(self.words))
        return [tuple(self.words[i : i + n]) for i in range(len(self.words) - n + 1)]


def as_item(item_id: int, text: str) -> Item:
    parts = SENTENCE.split(text.strip())
    words = words_of(text.encode())
    answer = len(words_of(parts[-1].encode())) if len(parts) > 1 else 0
    return Item(item_id, words, len(words) - answer)


def pieces_of(words: list[bytes]) -> list[list[bytes]]:
    n = max(1, round(len(words) / PIECE))
    cuts = [len(words) * j // n for j in range(n + 1)]
    return [words[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


@dataclass
class Statistics:
    """Of all items: pieces, words in them, and pieces that have a term."""

    pieces: int
    words: int
    df: dict[bytes, int]

    @classmethod
    def of(cls, items: list[Item]) -> Statistics:
        pieces = [p for i in items for p in pieces_of(i.words) if i.words]
        return cls(len(pieces), sum(map(len, pieces)), Counter(t for p in pieces for t in set(p)))


def in_runs(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(run, place in it) of each element of runs of n elements."""
    run = np.repeat(np.arange(len(n)), n)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)


class Index:
    """Postings by term and impacts by piece, as arrays. Statistics may be those of more items than these."""

    def __init__(self, items: list[Item], stats: Statistics | None = None):
        self.items = [i for i in items if i.words]
        stats = stats or Statistics.of(self.items)
        pieces = [(k, p) for k, item in enumerate(self.items) for p in pieces_of(item.words)]
        self.item_of = [k for k, _ in pieces]
        mean = stats.words / max(1, stats.pieces)
        blocks = Counter(t for _, t in {(i // BLOCK, t) for i, (_, p) in enumerate(pieces) for t in p})
        self.terms = {t: i for i, t in enumerate(sorted(blocks, key=lambda t: (-blocks[t], t)))}
        self.impacts: list[list[tuple[int, float]]] = []
        for _, p in pieces:
            weigh = lambda t, f, n=len(p): math.log(1 + (stats.pieces - stats.df[t] + 0.5) / (stats.df[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * n / mean))
            impact = [(self.terms[t], weigh(t, f)) for t, f in sorted(Counter(p).items())]
            bound = THRESHOLD * sum(x for _, x in impact)
            # heaviest first: what the terms not yet looked at can add falls fastest
            self.impacts.append(sorted(((t, x / bound) for t, x in impact), key=lambda tx: -tx[1]))
        self.n_blocks = -(-len(pieces) // BLOCK)
        flat = [(t, p // BLOCK, x) for p, impact in enumerate(self.impacts) for t, x in impact]
        term, block, most = (np.array(c) for c in zip(*flat, strict=True)) if flat else (np.zeros(0, np.int64),) * 3
        order = np.lexsort((-most, block, term))
        first = np.r_[True, np.diff(term[order] * max(1, self.n_blocks) + block[order]) != 0] if len(order) else np.zeros(0, bool)
        order = order[first]
        #: Postings in order of term and block: where a term's begin, their blocks, and the largest impact in each.
        self.at = np.searchsorted(term[order], np.arange(len(self.terms) + 2))
        self.block, self.most = block[order], most[order]
        self.key = term[order] * max(1, self.n_blocks) + self.block
        self.top = np.zeros(len(self.terms) + 1)
        np.maximum.at(self.top, term[order], self.most)

    def reachable(self, passage: np.ndarray, term: np.ndarray) -> Iterator[tuple[int, int]]:
        """(passage, block) where a piece can reach 1, of pairs (passage, term) in order."""
        enough = 1.0 - 1e-9
        if not len(passage):
            return
        begin = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
        length = np.diff(np.r_[begin, len(passage)])
        upto = np.cumsum(self.top[term])
        upto -= np.repeat(np.r_[0.0, upto][begin], length)  # of the passage's terms up to this one
        able = upto[begin + length - 1] >= enough
        driving = upto >= PIVOT
        n_before = np.add.reduceat(~driving, begin, dtype=np.int64)
        before = np.where(n_before > 0, upto[begin + np.maximum(n_before, 1) - 1], 0.0)
        read = np.flatnonzero(driving & np.repeat(able, length))
        run = np.repeat(np.arange(len(begin)), length)[read]
        size = self.at[term[read] + 1] - self.at[term[read]]
        # in steps of about POSTINGS; passages are kept whole
        steps = np.searchsorted(np.cumsum(size), np.arange(0, int(size.sum()), POSTINGS))
        edges = sorted({0, len(read), *[int(np.searchsorted(run, run[i])) for i in steps]})
        for a, b in zip(edges, edges[1:], strict=False):
            owner, place = in_runs(size[a:b])
            posting = self.at[term[read[a:b]]][owner] + place
            low, high = int(run[a]), int(run[b - 1]) + 1
            pair = (run[a:b] - low)[owner] * self.n_blocks + self.block[posting]
            if (cells := (high - low) * self.n_blocks) <= 8 * len(pair):
                bound = np.bincount(pair, self.most[posting], cells)
                pair = np.flatnonzero(bound + np.repeat(before[low:high], self.n_blocks) >= enough)
                bound = bound[pair]
            else:
                pair, where = np.unique(pair, return_inverse=True)
                bound = np.bincount(where, self.most[posting], len(pair))
            who = low + pair // self.n_blocks
            left = (bound > 0) & (bound + before[who] >= enough)
            pair, bound, who = pair[left], bound[left], who[left]
            # the terms before the pivot, in the blocks that are left
            owner, place = in_runs(n_before[who])
            key = term[begin[who][owner] + place] * self.n_blocks + (pair % self.n_blocks)[owner]
            found = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            bound = bound + np.bincount(owner, np.where(self.key[found] == key, self.most[found], 0.0), len(pair))
            left = bound >= enough
            yield from zip(passage[begin[who[left]]].tolist(), (pair[left] % self.n_blocks).tolist(), strict=True)

    def score(self, block: int, terms: set[int]) -> Iterator[tuple[int, float]]:
        """Pieces of a block that reach 1 with these terms. A piece is left where what is yet to come can't do."""
        for p in range(block * BLOCK, min(len(self.impacts), (block + 1) * BLOCK)):
            total, rest = 0.0, 1.0 / THRESHOLD
            for t, x in self.impacts[p]:
                rest -= x
                if t in terms:
                    total += x
                elif total + rest < 1.0 - 1e-9:
                    break
            if total >= 1.0 - 1e-9:
                yield p, total * THRESHOLD


def verify(item: Item, words: list[bytes]) -> tuple[float, float]:
    """Shares of the item's grams found among ``words``, for those ending in the question and in the answer."""
    n = min(NGRAM, len(item.words))
    have = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
    hit = [g in have for g in item.grams]
    cut = max(0, item.answer_from - n + 1)
    question, answer = hit[:cut], hit[cut:]
    share = lambda x, other: sum(x) / len(x) if x else sum(other) / max(1, len(other))
    return share(question, answer), share(answer, question)


def passages(words: list[list[bytes]], index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, term) of all texts, in order and each once, and the first passage of each text."""
    size, none = WINDOW // 2, len(index.terms)
    lengths = np.array([len(w) for w in words])
    n_halves = np.maximum(1, -(-lengths // size))
    first = np.cumsum(n_halves) - n_halves
    get = index.terms.get
    term = np.fromiter((get(x, none) for w in words for x in w), np.int64, lengths.sum())
    text, place = in_runs(lengths)
    half = first[text] + place // size
    known = term < none
    text, half, term = text[known], half[known], term[known]
    width = none + 1
    own = distinct(half * width + term)
    later = own[own // width > first[np.searchsorted(first, own // width, side="right") - 1]]  # a half is in the passage before, too
    pairs = distinct(np.concatenate([own, later - width]))
    return pairs // width, pairs % width, first


def search(texts: list[bytes], index: Index) -> list[list[tuple]]:
    """For each text its verified items: (item_id, first word of the passage, score, question, answer)."""
    found: list[dict[int, tuple]] = [{} for _ in texts]
    if not index.items or not texts:
        return [[] for _ in texts]
    words = [words_of(t) for t in texts]
    passage, term, first = passages(words, index)
    last, terms = None, set()
    for h, block in index.reachable(passage, term):
        if h != last:
            last, terms = h, set(term[np.searchsorted(passage, h) : np.searchsorted(passage, h, side="right")].tolist())
        d = int(np.searchsorted(first, h, side="right")) - 1
        for p, score in index.score(block, terms):
            k = index.item_of[p]
            if k in found[d] and found[d][k][2] >= score:
                continue
            item, at = index.items[k], (h - int(first[d])) * (WINDOW // 2)
            question, answer = verify(item, words[d][max(0, at - len(item.words)) : at + WINDOW + len(item.words)])
            if question >= MIN_QUESTION and answer >= MIN_ANSWER:
                found[d][k] = (item.item_id, at, score, question, answer)
    return [sorted(f.values(), key=lambda r: (r[0] is None, r[0] or 0, r[1])) for f in found]


def _hits(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
    for batch in batches:
        ids = batch.column(0).to_pylist()
        rows = [(ids[i], *hit) for i, hits in _searched(batch.column(1), index) for hit in hits]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "passage", "score", "question", "answer"])


def _searched(texts: pa.Array, index: Index) -> Iterator[tuple[int, list[tuple]]]:
    data, off = utf8_view(texts)
    raw = data.tobytes()
    for k in range(0, len(off) - 1, TEXTS):
        part = [raw[off[i] : off[i + 1]] for i in range(k, min(k + TEXTS, len(off) - 1))]
        yield from enumerate(search(part, index), k)


def _without(batches: Iterator[pa.RecordBatch], index: Index, at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array([not hits for _, hits in _searched(batch.column(at), index)], pa.bool_()))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(words, terms) of each piece of the items."""
    for batch in batches:
        items = [as_item(0, t) for t in batch.column(0).to_pylist()]
        pieces = [p for i in items if i.words for p in pieces_of(i.words)]
        yield pa.RecordBatch.from_arrays([pa.array([len(p) for p in pieces], pa.int64()), pa.array([sorted(set(p)) for p in pieces], pa.list_(pa.binary()))], ["words", "terms"])


def indexes(items: DataFrame) -> Iterator[Index]:
    """Indexes of at most about MAX_ITEMS items and MAX_BYTES of text each, which is checked before items are collected.

    In more rounds than one, statistics are those of all items, of which a round fetches those of its own terms.
    """
    rows = items.select("item_id", "text").where("text is not null")
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    rounds = max(1, -(-n // MAX_ITEMS), -(-size // MAX_BYTES))
    if rounds > 1:
        pieces = checkpointed(arrow_map(rows.select("text"), _pieces, "words long, terms array<binary>"))
        total, words = pieces.agg(F.count(F.lit(1)), F.coalesce(F.sum("words"), F.lit(0))).first()
        df = checkpointed(pieces.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")))
    for r in range(rounds):
        part = rows.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == r).orderBy("item_id", "text").collect()
        part = [as_item(x["item_id"], x["text"]) for x in part]
        stats = None
        if rounds > 1:
            own = items.sparkSession.createDataFrame([(bytearray(t),) for t in sorted({t for i in part for t in i.words})], "term binary")
            stats = Statistics(total, words, {bytes(x.term): x.n for x in df.join(F.broadcast(own), "term", "left_semi").collect()})
        yield Index(part, stats)


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row for each document and test item that it holds."""
    out = None
    for index in indexes(items):
        hits = arrow_map(docs.select("doc_id", "text"), partial(_hits, index=index), "doc_id long, item_id long, passage long, score double, question double, answer double")
        out = hits if out is None else out.unionByName(hits)
    return out


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a test item; nothing is shuffled."""
    schema, at = docs.schema, docs.columns.index("text")
    for index in indexes(items):
        docs = arrow_map(docs, partial(_without, index=index, at=at), schema)
    return docs


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
