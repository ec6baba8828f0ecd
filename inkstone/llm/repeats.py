"""Operator 3: removal of repeated passages by longest previous factors.

A byte goes if a string of MIN bytes that covers it also starts earlier: in a document of a smaller id,
or before in its own. That is so just where the longest previous factor of the string's position is MIN
or more, which the suffix order tells: among suffixes that agree in MIN bytes, a position has an earlier
match if its previous or next smaller position in suffix order is among them.

One suffix array of a corpus fits no machine, so the suffixes are dealt out first, in such a way that
strings that are equal always meet:

1. Each window of MIN bytes picks an anchor, the leftmost of its GRAM-byte grams with the least hash.
   Equal windows pick equal grams at equal offsets. Windows in a row with one anchor make a context.
2. Contexts meet by the hash of their gram. Those that occur but once go. Of contexts that are equal as a
   whole, which two independent hashes of 64 bits tell, the first stays and the others are repeats, told in each batch of documents before the shuffle,
   so that a passage held by a third of all documents is dealt a row for each batch.
3. Contexts of one gram that differ are fetched as text and their suffixes sorted, by doubling up to MIN
   bytes, in blocks of whole grams; previous smaller positions mark what is repeated. A gram with more
   than CAP different contexts is dealt out window by window instead, and minima found before a shuffle.

Defined cases: a null text is empty; rows that share a doc_id are taken as one document with one text, in
whichever batches they are; rows with a null doc_id are documents told by a hash of their text, after all
others (ids in the last OWN of the range excepted); texts shorter than MIN bytes lose nothing; an empty table gives no rows;
other columns pass through ``without_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import arrow_map, checkpointed, fresh, table, utf8_view

MIN, GRAM = 100, 32
SPAN = MIN - GRAM + 1  # grams in a window
CAP = 20_000
#: Rows of a batch that are added to a block at a time, so that blocks are not much larger than SORT_BLOCK.
ROWS = 512
SLICE, SORT_BLOCK = 1 << 20, 1 << 20
#: Bytes of a text in its piece of work; a longer text is cut into pieces that overlap by MIN - 1 bytes.
PIECE = 1 << 20
LAST, OWN = (1 << 63) - 1, 1 << 48
REPEAT = 255
U = np.uint64
MIX1, MIX2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9)


#: Odd bases of the two hashes of a string; the first also hashes grams.
BASES = (0x5851F42D4C957F2D, 0xD1342543DE82EF95)


#: For each base the tables of a task's largest slice so far; those of a smaller one are their first values.
POWERS: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of a base modulo 2 ** 64, those of its inverse, at least n of each, and a random value for each byte."""
    if which not in POWERS or len(POWERS[which][0]) < n:
        POWERS.pop(which, None)  # not both at once
        POWERS[which] = _power_tables(n, which)
    return POWERS[which]


def _power_tables(n: int, which: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    base = BASES[which]
    inverse = pow(base, -1, 1 << 64)
    up, down = np.full(n, base, U), np.full(n, inverse, U)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down), np.random.default_rng([7, which]).integers(1, 1 << 63, 256, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * MIX1
    return h ^ (h >> U(29))


def contexts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, key, ctx, check, first window, anchor - first, last - first) of all contexts of the texts in ``data``.

    key hashes the gram, ctx and check the whole context, each with a base and byte values of its own.
    """
    none = tuple(np.zeros(0, t) for t in (np.int64, U, U, U, np.int64, np.int64, np.int64))
    n = len(data)
    if n < MIN:
        return none
    up, down, value = _powers(1 << max(16, int(n).bit_length()), 0)
    prefix = np.zeros(n + 1, U)
    np.cumsum(value[data] * up[:n], out=prefix[1:])
    grams = _mixed((prefix[GRAM:] - prefix[:-GRAM]) * down[: n - GRAM + 1])
    least, at, have = grams, np.arange(len(grams), dtype=np.int32), 1
    while have < SPAN:  # least of 2, 4, ... grams and its leftmost place
        step = min(have, SPAN - have)
        right = least[step:] < least[:-step]
        at = np.where(right, at[step:], at[:-step])
        least = np.where(right, least[step:], least[:-step])
        have += step
    windows = n - MIN + 1
    at = at[:windows]
    length = off[1:] - off[:-1]
    ok = np.zeros(windows + 1, np.int8)
    holds = length >= MIN
    np.add.at(ok, off[:-1][holds], 1)
    np.add.at(ok, off[1:][holds] - MIN + 1, -1)
    inside = np.cumsum(ok[:-1]) > 0
    at = np.where(inside, at, -1)
    edge = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[edge[1:], windows] - 1
    real = at[edge] >= 0
    first, last = edge[real], last[real]
    anchor = at[first].astype(np.int64)
    ctx = _mixed((prefix[last + MIN] - prefix[first]) * down[first])
    ctx = (ctx ^ ((anchor - first).astype(U) << U(8)) ^ (last - first).astype(U)) * MIX2
    up, down, value = _powers(1 << max(16, int(n).bit_length()), 1)
    np.cumsum(value[data] * up[:n], out=prefix[1:])
    check = _mixed((prefix[last + MIN] - prefix[first]) * down[first])
    text = np.searchsorted(off, first, side="right") - 1
    return text, grams[anchor], ctx, check, first - off[text], anchor - first, last - first


def pieces(off: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(text, from, to, byte where the piece starts in its text) for runs of work of about SLICE bytes."""
    for i in range(len(off) - 1):
        a, b = int(off[i]), int(off[i + 1])
        if b - a < MIN:
            continue
        for s in range(a, max(a + 1, b - MIN + 1), PIECE):
            yield i, s, min(b, s + PIECE + MIN - 1), s - a


def _in_slices(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Contexts of all texts; first windows are places in the whole text."""
    held, size = [], 0

    def work():
        owner, start = np.array([h[0] for h in held]), np.array([h[3] for h in held])
        joined = np.concatenate([data[h[1] : h[2]] for h in held])
        ends = np.concatenate([[0], np.cumsum([h[2] - h[1] for h in held])])
        text, key, ctx, check, first, to_anchor, extent = contexts(joined, ends)
        return owner[text], key, ctx, check, first + start[text], to_anchor, extent

    for piece in pieces(off):
        held.append(piece)
        size += piece[2] - piece[1]
        if size >= SLICE:
            yield work()
            held, size = [], 0
    if held:
        yield work()


ANCHORS = "key long, ctx long, check long, doc long, packed long"


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each different context of a batch at its first place; its other places are repeats already.

    Repeats get the hash of their document for a key, to be dealt out evenly.
    """
    try:
        for batch in batches:
            yield from _anchors_of(batch)
    finally:
        POWERS.clear()  # the worker lives on, in other stages


def _anchors_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    data, off = utf8_view(batch.column(1))
    ids = batch.column(0).to_numpy()
    got = list(_in_slices(data, off))
    if not got:
        return
    text, key, ctx, check, first, to_anchor, extent = (np.concatenate(x) for x in zip(*got, strict=True))
    doc = ids[text]
    order = np.lexsort((first, doc, check, ctx, key))
    text, key, ctx, check, first, to_anchor, extent, doc = (x[order] for x in (text, key, ctx, check, first, to_anchor, extent, doc))
    same = np.r_[False, (key[1:] == key[:-1]) & (ctx[1:] == ctx[:-1]) & (check[1:] == check[:-1])]
    place = same & np.r_[False, (doc[1:] == doc[:-1]) & (first[1:] == first[:-1])]  # a row given twice
    rep_doc, rep_from, rep_to = merged(doc[same & ~place], first[same & ~place], (first + extent)[same & ~place] + MIN)
    packed = (first << 16) | (to_anchor << 8) | extent
    fresh = ~same
    columns = [key[fresh].view(np.int64), ctx[fresh].view(np.int64), check[fresh].view(np.int64), doc[fresh], packed[fresh]]
    more = [_mixed(rep_doc.astype(U) * MIX2 + MIX1).view(np.int64), rep_to, np.zeros_like(rep_to), rep_doc, (rep_from << 16) | (REPEAT << 8)]
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(columns, more, strict=True)], ANCHORS.replace(" long", "").split(", "))


def merged(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of the intervals [a, b) of each document, where they overlap or touch."""
    if not len(doc):
        return doc, a, b
    order = np.lexsort((a, doc))
    doc, a, b = doc[order], a[order], b[order]
    group = np.cumsum(np.r_[True, doc[1:] != doc[:-1]])
    # running maximum of the ends within a document, by a lift of each document above those before
    lift = group * (int(b.max()) + 1)
    reach = np.maximum.accumulate(b + lift) - lift
    new = np.r_[True, (doc[1:] != doc[:-1]) | (a[1:] > reach[:-1])]
    start = np.flatnonzero(new)
    return doc[start], a[start], reach[np.r_[start[1:], len(a)] - 1]


OPEN, HOT = 1, 2
RESOLVED = "doc long, kind int, a long, b long, key long"


class Resolver:
    """Reads contexts in order of key, context and place. It tells repeats, and holds back the first places
    of a key's different contexts until the key ends: one alone is of no use, more are to be compared."""

    def __init__(self, cap: int):
        self.cap, self.key, self.ctx, self.place, self.held, self.hot = cap, None, (None, None), (None, None), [], False

    def release(self) -> list[np.ndarray]:
        out = []
        if self.hot or sum(len(h[0]) for h in self.held) > 1:
            kind = HOT if self.hot else OPEN
            out = [(h[0], np.full(len(h[0]), kind), h[1], np.zeros(len(h[0]), np.int64), h[2]) for h in self.held]
        self.held = []
        return out

    def take(self, key, ctx, check, doc, packed) -> Iterator[tuple]:
        flag = ((packed >> 8) & 255) == REPEAT
        yield doc[flag], np.zeros(flag.sum(), np.int64), packed[flag] >> 16, ctx[flag], key[flag]
        key, ctx, check, doc, packed = (x[~flag] for x in (key, ctx, check, doc, packed))
        if not len(key):
            return
        same = (key[1:] == key[:-1]) & (ctx[1:] == ctx[:-1]) & (check[1:] == check[:-1])
        same = np.r_[(key[0] == self.key) and (ctx[0], check[0]) == self.ctx, same]
        first = packed >> 16
        # the first place of each row's context, -1 for one of an earlier batch; a row given twice is no repeat of itself
        at = np.maximum.accumulate(np.where(same, -1, np.arange(len(key))))
        of_doc, of_first = doc[at], first[at]
        if same[0]:
            of_doc[at < 0], of_first[at < 0] = self.place
        again = same & ((doc != of_doc) | (first != of_first))
        yield doc[again], np.zeros(again.sum(), np.int64), first[again], (first + (packed & 255) + MIN)[again], key[again]
        self.ctx, self.place = (ctx[-1], check[-1]), (of_doc[-1], of_first[-1])
        key, doc, packed = key[~same], doc[~same], packed[~same]
        edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        if len(edge):
            size = np.diff(np.r_[edge, len(key)])
            if key[0] != self.key:
                yield from self.release()
                self.hot = False
            # keys that begin and end here, all at once
            whole = np.ones(len(edge), bool)
            whole[-1] = False
            whole[0] &= key[0] != self.key
            take = np.repeat(whole & (size > 1), size)
            kind = np.repeat(np.where(size > self.cap, HOT, OPEN), size)[take]
            yield doc[take], kind, packed[take], np.zeros(take.sum(), np.int64), key[take]
            for e in {0, len(edge) - 1}:
                if not whole[e]:
                    if key[edge[e]] != self.key:
                        yield from self.release()
                        self.hot = False
                    self.key = key[edge[e]]
                    part = slice(edge[e], edge[e] + size[e])
                    self.held.append((doc[part], packed[part], key[part]))
                    if self.hot or sum(len(h[0]) for h in self.held) > self.cap:
                        self.hot = True
                        yield from self.release()


def _resolve(batches: Iterator[pa.RecordBatch], cap: int) -> Iterator[pa.RecordBatch]:
    state = Resolver(cap)
    pack = lambda rows: pa.RecordBatch.from_arrays(
        [pa.array(rows[0]), pa.array(rows[1].astype(np.int32)), *[pa.array(r) for r in rows[2:]]], ["doc", "kind", "a", "b", "key"]
    )
    for batch in batches:
        for rows in state.take(*[batch.column(c).to_numpy() for c in range(5)]):
            if len(rows[0]):
                yield pack(rows)
    for rows in state.release():
        yield pack(rows)


def suffix_ranks(data: np.ndarray, starts: np.ndarray, length: int = MIN) -> np.ndarray:
    """Ranks of the suffixes at ``starts`` by their first ``length`` bytes, by doubling from 8 bytes.

    Only suffixes that some suffix at ``starts`` needs are ranked, at each of the lengths 8, 16, 32 and 64.
    """
    padded = np.concatenate([data, np.zeros(length, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    need = np.zeros(len(data) + length, bool)
    need[starts] = True
    for step in (8, 16, 32, length - 64):
        need[step:] |= need[:-step].copy()
    at = np.flatnonzero(need[: len(padded) - 7])
    _, rank = np.unique(np.ascontiguousarray(words[at]).view(">u8").ravel(), return_inverse=True)
    full = np.zeros(len(padded) + length, np.int64)
    full[at] = rank + 1
    for step in (8, 16, 32, length - 64):
        pair = (full[at] << 32) | full[at + step]
        _, rank = np.unique(pair, return_inverse=True)
        full[at] = rank + 1
    return full[starts]


def earlier_match(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which of the positions ``starts``, given in order of occurrence, have a longest previous factor of MIN or more.

    The positions are put in suffix order, suffixes that agree in MIN bytes by occurrence. The previous
    smaller position in that order whose common prefix is that long is then the neighbour, if that agrees;
    the next smaller position never has such a prefix.
    """
    rank = suffix_ranks(data, starts)
    order = np.argsort(rank, kind="stable")
    agree = np.r_[False, rank[order][1:] == rank[order][:-1]]
    previous = np.r_[-1, order[:-1]]
    out = np.zeros(len(starts), bool)
    out[order] = agree & (previous < order)
    return out


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of each context that is to be compared: (key, doc, a, n windows, bytes)."""
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            data, off = utf8_view(batch.column(1))
            raw, keys, docs, firsts, counts, out = data.tobytes(), [], [], [], [], []
            for i, (doc, wanted) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                for w in wanted:
                    a, n = w["a"] >> 16, (w["a"] & 255) + 1
                    text = raw[off[i] + a : min(off[i] + a + n + MIN - 1, off[i + 1])]
                    if len(text) == n + MIN - 1:
                        keys.append(w["key"])
                        docs.append(doc)
                        firsts.append(a)
                        counts.append(n)
                        out.append(text)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(docs, pa.int64()), pa.array(firsts, pa.int64()), pa.array(counts, pa.int32()), pa.array(out, pa.binary())],
                ["key", "doc", "a", "n", "bytes"],
            )


SPANS = "doc long, a long, b long"


def _spans(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in merged(doc, a, b)], ["doc", "a", "b"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats among contexts in order of key and place, in blocks of whole keys of about SORT_BLOCK bytes."""

    def work(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        doc, a, n = (np.concatenate([h.column(c).to_numpy() for h in held]) for c in (1, 2, 3))
        views = [utf8_view(h.column(4)) for h in held]
        data = np.concatenate([v[0] for v in views])
        size = np.concatenate([v[1][1:] - v[1][:-1] for v in views])
        begin = np.cumsum(size) - size
        which = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        # a window that is in two contexts is one place: by document and byte, the later ones go
        key = np.concatenate([h.column(0).to_numpy() for h in held])
        order = np.lexsort((a[which] + step, doc[which], key[which]))
        which, step = which[order], step[order]
        place = a[which] + step
        again = np.r_[False, (key[which][1:] == key[which][:-1]) & (doc[which][1:] == doc[which][:-1]) & (place[1:] == place[:-1])]
        which, step, place = which[~again], step[~again], place[~again]
        hit = earlier_match(data, begin[which] + step)
        return _spans(doc[which][hit], place[hit], place[hit] + MIN)

    held, size = [], 0
    for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
        held.append(batch)
        size += batch.column(4).nbytes
        keys = batch.column(0).to_numpy()
        if size >= SORT_BLOCK and (cut := int(np.searchsorted(keys, keys[-1]))):
            held[-1] = batch.slice(0, cut)
            yield work(held)
            held = [batch.slice(cut)]
            size = held[0].column(4).nbytes
    if held:
        yield work(held)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of the contexts of a gram that has too many: its digest and place."""
    for batch in batches:
        rows = []
        for _, doc, a, n, text in zip(*batch.to_pydict().values(), strict=True):
            rows += [(hashlib.blake2b(text[k : k + MIN], digest_size=16).digest(), doc, a + k) for k in range(n)]
        if rows:
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], ["digest", "doc", "a"])


def document() -> Column:
    """The id of a row's document: rows without one get an id of their text, after all others."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST) - F.pmod(F.xxhash64("text"), F.lit(OWN)))


def repeated_spans(docs: DataFrame, cap: int = CAP) -> DataFrame:
    """(doc, spans): for each document with repeats, the intervals [a, b) of its bytes that are to go."""
    texts = docs.select(document().alias("doc"), "text")
    anchors = arrow_map(texts, _anchors, ANCHORS)
    anchors = anchors.repartition("key").sortWithinPartitions("key", "ctx", "check", "doc", "packed")
    resolved = checkpointed(arrow_map(anchors, partial(_resolve, cap=cap), RESOLVED))

    def fetched(kind: int) -> DataFrame:
        wanted = resolved.where(F.col("kind") == kind).groupBy("doc").agg(F.collect_list(F.struct("key", "a")).alias("wanted"))
        return arrow_map(texts.join(wanted, "doc").select("doc", "text", "wanted"), _texts, "key long, doc long, a long, n int, bytes binary")

    met = fetched(OPEN).repartition("key").sortWithinPartitions("key", "doc", "a")
    spans = resolved.where("kind = 0").select("doc", "a", "b").unionByName(arrow_map(met, _compare, SPANS))
    if resolved.where(F.col("kind") == HOT).limit(1).count():
        windows = arrow_map(fetched(HOT), _windows, "digest binary, doc long, a long").distinct()
        first = windows.groupBy("digest").agg(F.min(F.struct("doc", "a")).alias("_first"))
        later = windows.join(first, "digest").where(F.struct("doc", "a") != F.col("_first"))
        spans = spans.unionByName(later.select("doc", "a", (F.col("a") + MIN).alias("b")))
    return spans.groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def cut_out(data: bytes, spans: list[dict] | None) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of a text, and its maximal removed runs."""
    runs: list[list[int]] = []
    for s in sorted((s["a"], min(s["b"], len(data))) for s in spans or ()):
        if runs and s[0] <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], s[1])
        else:
            runs.append(list(s))
    kept, at = [], 0
    for a, b in runs:
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]]), [tuple(r) for r in runs]


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = utf8_view(batch.column(1))
        raw, rows = data.tobytes(), []
        for i, spans in enumerate(batch.column(2).to_pylist()):
            text = raw[off[i] : off[i + 1]]
            kept, runs = cut_out(text, spans)
            rows.append((len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()], strict=True)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _with_spans(docs: DataFrame, cap: int = CAP) -> DataFrame:
    """Each row of ``docs`` and, after its columns, the spans that go from its text. The row is one struct in the
    join, so that no name of its columns can clash with those used here."""
    rows = docs.select(document().alias("id"), F.struct("*").alias("row"))
    joined = rows.join(repeated_spans(docs, cap), F.col("id") == F.col("doc"), "left")
    return joined.select("row.*", F.col("spans").alias(fresh("spans", docs.columns)))


def digests(docs: DataFrame, cap: int = CAP) -> DataFrame:
    return arrow_map(_with_spans(docs.select("doc_id", "text"), cap), _digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _cut(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """Rows with what is left of their texts; a removed run gives up the bytes of characters it cuts."""
    for batch in batches:
        texts = batch.column(at).cast(pa.large_binary()).to_pylist()
        for i, spans in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
            if spans and texts[i]:
                text, whole = texts[i], []
                for a, b in cut_out(text, spans)[1]:
                    while a < b and text[a] & 0xC0 == 0x80:
                        a += 1
                    while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
                        b -= 1
                    whole.append({"a": a, "b": b})
                texts[i] = cut_out(text, whole)[0]
        texts = [None if t is None else t.decode("utf-8", "replace") for t in texts]
        columns = [pa.array(texts, pa.string()) if c == at else batch.column(c) for c in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``; other columns and all rows stay."""
    names = docs.columns
    return arrow_map(_with_spans(docs), partial(_cut, at=names.index("text")), docs.schema)


def op3_repeats(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
