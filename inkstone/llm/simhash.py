"""Operator 8: SimHash near duplicates by a byte-position inverted index with count filtering.

A text's fingerprint has a bit set where it is set in over half the hashes of its word shingles. Two
fingerprints of n bytes that differ in at most d bits share at least n - d bytes in their positions.

One posting list for each position and byte would hold a share of the corpus, so the index is dealt out first: the
positions are cut into d + 2 chunks, of which such a pair shares two whole ones, and there is a part of the index for
each pair of chunks and their bytes. In a part, every other position has its posting lists by byte. A fingerprint's
lists are gone through together; they tally, for each other one, the positional bytes that the two share. Pairs whose
tally, with the bytes of the part, reaches n - d are retained and verified by their differing bits. A part with
more than PART fingerprints is dealt out once more, by all sets of n - d positions, in which no more than
256 ** d can meet. So no pair is missed. Copies are one entry; a part gives the links of a spanning forest of its
close pairs, not all pairs.

``similar`` finds all pairs of texts whose shingle sets have a Jaccard similarity of at least 0.8, with the same index.
Fingerprints of the different word pairs of each text go through it, for NEAR_DISTANCE differing bits: a changed word
is in two pairs and in five shingles, so these stay nearer. In a component of such links the exact similarity
decides, from each text to those not yet reached, and leaves classes. Components of more than CLUSTER texts are dealt
out as pairs of blocks.

A fingerprint estimates similarity, so similar sets may be further apart than that. The rest, links between texts of
different classes, has an exact way. Of the shingles in one fixed order the first n - ceil(0.8 n) + 1 of a set of n
are its prefix; two similar sets share a shingle of their prefixes, so they meet in its list. Shingles that are
common in a sample come last in that order, which shortens lists and loses no pair. Lists that hold one class only
are left out. In others, sizes and a lower bound of the sets' difference (the differing bits of the parities of their
hashes in buckets) leave a forest of pairs that may be similar, between classes. Classes that meet in its trees are
verified as the index's components are.

Copies of a fingerprint within a batch of rows are one row with their ids, so that a fingerprint
of a third of all documents is dealt a row for each batch.

Defined cases: a null or empty text has fingerprint zero, linked like any other; texts of fewer words
than a shingle have their whole sequence as one; rows with one doc_id are one document; a null doc_id
gets the component of its fingerprint; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkstone.llm.common import arrow_map, checkpointed, distinct, table, utf8_view
from inkstone.llm.components import components

SEED = 42
#: Query op8.
SHINGLE, DISTANCE = 3, 2
#: ``similar``: shingles of five words, Jaccard similarity of at least 0.8.
WIDE_SHINGLE, SIMILARITY = 5, 0.8
#: The index takes fingerprints of word pairs up to so many differing bits; what is further apart is left to prefixes.
NEAR_SHINGLE, NEAR_DISTANCE = 2, 5
#: Parities of a set are in as many buckets as it has shingles or more, a power of two between these.
LEAST_BITS, MOST_BITS = 512, 1 << 15
#: Shingles that COMMON or more of about SAMPLE texts have are last in the order, at most MOST_COMMON of them.
SAMPLE, COMMON, MOST_COMMON = 10_000, 10, 100_000
CLUSTER = 10_000
#: Most ids that are broadcast to pick rows without dealing out their texts; more are joined.
BROADCAST_IDS = 2_000_000
#: Parts of up to so many fingerprints are compared by offset, all parts of a batch at once; larger ones than PART are
#: dealt out again.
SMALL_LIST, PART = 8, 8192
LINKS = "deeper boolean, a long, b long"
U = np.uint64
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of each shingle of a text, repeats included."""
    w = text.lower().split()  # bytes: A-Z only, and just the blanks 0x20 and 0x09 to 0x0d
    if not w:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(w), xxhash.xxh64_intdigest
    if len(w) <= words:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = list(accumulate(len(x) + 1 for x in w))
    starts = [0, *ends[: len(w) - words]]
    return np.fromiter((digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[words - 1 :], strict=True)), np.uint64, len(starts))


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have bit 0, 1, ... set."""
    octets = h.astype("<u8").view(np.uint8).reshape(-1, 8)
    if len(h) < 256:
        return np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.concatenate([np.bincount(octets[:, j], minlength=256) @ BITS for j in range(8)])


def majority(h: np.ndarray) -> bytes:
    """The bits set in over half the hashes: 8 bytes, the most significant bit first."""
    bits = 2 * bit_counts(h) > len(h) if len(h) else np.zeros(64, bool)
    return np.packbits(bits, bitorder="little").tobytes()[::-1]


def fingerprint(text: bytes, words: int = SHINGLE) -> bytes:
    """The fingerprint's 8 bytes, the most significant bit first."""
    return majority(shingle_hashes(text, words))


def sketch(text: bytes, words: int = WIDE_SHINGLE) -> bytes:
    """A set of shingles as its digest of 16 bytes, its size in 8, the fingerprint of its word pairs in 8, and the
    parities of its buckets."""
    h = distinct(shingle_hashes(text, words))
    width = min(max(LEAST_BITS, 1 << (max(1, len(h)) - 1).bit_length()), MOST_BITS)
    odd = np.bincount((h & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    digest, size = hashlib.blake2b(h.tobytes(), digest_size=16).digest(), len(h).to_bytes(8, "little")
    pairs = majority(distinct(shingle_hashes(text, NEAR_SHINGLE)))
    return digest + size + pairs + np.packbits(odd.astype(bool), bitorder="little").tobytes()


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int, of: Callable[[bytes, int], bytes]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = utf8_view(batch.column(1))
        raw, held = data.tobytes(), {}
        for i, doc_id in enumerate(batch.column(0).to_pylist()):
            held.setdefault(of(raw[off[i] : off[i + 1]], words), []).append(doc_id)
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.list_(pa.int64()))], ["fp", "ids"])


def fingerprints(docs: DataFrame, words: int = SHINGLE, of: Callable[[bytes, int], bytes] = fingerprint) -> DataFrame:
    """(fp, ids): the fingerprints of each batch of rows, with the ids of the rows that have them."""
    return arrow_map(docs.select("doc_id", "text"), partial(_fingerprints, words=words, of=of), "fp binary, ids array<bigint>")


def position_sets(octets: int, size: int) -> list[tuple[int, ...]]:
    """All sets of ``size`` byte positions."""
    return list(combinations(range(octets), size))


def chunk_sets(octets: int, bits: int) -> list[tuple[int, ...]]:
    """The positions of all sets of chunks that remain if ``bits`` of bits + 2 chunks (or of single bytes) differ."""
    chunks = np.array_split(np.arange(octets), min(octets, bits + 2))
    return [tuple(np.concatenate(x).tolist()) for x in combinations(chunks, len(chunks) - bits)]


def _parts(batches: Iterator[pa.RecordBatch], sets: list[tuple[int, ...]]) -> Iterator[pa.RecordBatch]:
    """(part, fp) of each fingerprint for each set: a part is the number of the set and the bytes in its positions."""
    for whole in batches:
        for k in range(0, whole.num_rows, 4000):
            data, _ = utf8_view(whole.column(0).slice(k, 4000))
            yield from _dealt(data.reshape(-1, 8), sets)


def _dealt(octets: np.ndarray, sets: list[tuple[int, ...]]) -> Iterator[pa.RecordBatch]:
    fp, width = octets.copy().view(np.int64).ravel(), max(map(len, sets))
    for number, at in enumerate(sets):
        scale = U(256) ** np.arange(len(at), dtype=np.uint64)
        part = (octets[:, list(at)].astype(np.uint64) * scale).sum(1, dtype=np.uint64)
        if width < 8:
            part += U(number) << U(8 * width)
        yield pa.RecordBatch.from_arrays([pa.array(part.view(np.int64)), pa.array(fp)], ["part", "fp"])


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints given as rows of 64-bit words."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """For each of n entries the first one of its tree, in a forest over pairs that are ``near``.

    Each entry is compared with those not yet reached, so a list of close copies costs about its length.
    """
    left, tree = np.arange(n), np.arange(n)
    while len(left):
        root, left, todo = left[0], left[1:], [left[0]]
        while todo and len(left):
            hit = near(todo.pop(), left)
            tree[left[hit]] = root
            todo += left[hit].tolist()
            left = left[~hit]
    return tree


def tally_forest(octets: np.ndarray, free: list[int], least: int, most: int) -> np.ndarray:
    """For each of the fingerprints of a part the first one of its tree, in a forest over pairs within ``most`` bits
    whose tally over the positions ``free`` is at least ``least``."""
    n, fps = len(octets), octets.copy().view(np.uint64).ravel()
    tree, alive = np.arange(n), np.ones(n, bool)
    lists = [np.argsort(octets[:, p], kind="stable") for p in free]
    ends = [np.searchsorted(octets[order, p], np.arange(257)) for p, order in zip(free, lists, strict=True)]
    for root in range(n):
        if not alive[root]:
            continue
        alive[root], todo = False, [root]
        while todo:
            q = todo.pop()
            if least > 0:
                met = [order[e[x] : e[x + 1]] for x, order, e in zip(octets[q, free].tolist(), lists, ends, strict=True)]
                tally = np.bincount(np.concatenate(met), minlength=n)
                other = np.flatnonzero((tally >= least) & alive)
            else:
                other = np.flatnonzero(alive)
            other = other[np.bitwise_count(fps[other] ^ fps[q]) <= most]
            tree[other], alive[other] = root, False
            todo += other.tolist()
    return tree


def _links_of(part: np.ndarray, fps: np.ndarray, sets: list[tuple[int, ...]], most: int) -> pa.RecordBatch:
    """Links of whole parts, given in order of their numbers."""
    first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    size = np.diff(np.r_[first, len(part)])
    of, pairs, octets = np.repeat(size, size), [np.zeros((2, 0), np.int64)], fps.view(np.uint8).reshape(-1, 8)
    width = max(map(len, sets))
    for step in range(1, min(SMALL_LIST, len(part))):  # small parts, all at once
        i = np.flatnonzero((of[:-step] > step) & (of[:-step] <= SMALL_LIST) & (part[:-step] == part[step:]))
        i = i[(octets[i] == octets[i + step]).sum(1) >= 8 - most]
        i = i[np.bitwise_count((fps[i] ^ fps[i + step]).view(np.uint64)) <= most]
        pairs.append(np.stack([fps[i + step], fps[i]]))
    for at, n in zip(first[size > SMALL_LIST], size[size > SMALL_LIST], strict=True):
        held = sets[int(part[at]) >> (8 * width) if width < 8 else 0]
        free = [p for p in range(8) if p not in held]
        tree = tally_forest(octets[at : at + n], free, 8 - most - len(held), most)
        i = np.flatnonzero(tree != np.arange(n))
        pairs.append(np.stack([fps[at + i], fps[at + tree[i]]]))
    pairs = np.unique(np.concatenate(pairs, 1), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(np.zeros(pairs.shape[1], bool)), *[pa.array(x) for x in pairs]], ["deeper", "a", "b"])


def _link(batches: Iterator[pa.RecordBatch], sets: list[tuple[int, ...]], most: int, cap: int | None) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of the parts of a partition in order; of a part with more than ``cap`` fingerprints its rows for
    the sets of 8 - ``most`` positions, marked as deeper."""
    deep = position_sets(8, 8 - most)

    def deeper(fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        for rows in _dealt(fps.view(np.uint8).reshape(-1, 8), deep):
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(rows.num_rows, bool)), *rows.columns], ["deeper", "a", "b"])

    held, size, hot = [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        part, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if hot is not None:
            cut = int(np.searchsorted(part, hot, side="right"))
            yield from deeper(fps[:cut])
            part, fps = part[cut:], fps[cut:]
            if not len(part):
                continue
            hot = None
        held.append((part, fps))
        size += len(part)
        if held[0][0][0] == part[-1]:  # one part so far
            if cap is not None and size > cap:
                hot = part[-1]
                for _, x in held:
                    yield from deeper(x)
                held, size = [], 0
            continue
        part, fps = (np.concatenate([h[c] for h in held]) for c in (0, 1))
        cut = np.searchsorted(part, part[-1])
        yield from _whole(part[:cut], fps[:cut], sets, most, cap, deeper)
        held, size = [(part[cut:], fps[cut:])], len(part) - cut
    if held:
        yield from _whole(*[np.concatenate([h[c] for h in held]) for c in (0, 1)], sets, most, cap, deeper)


def _whole(part: np.ndarray, fps: np.ndarray, sets: list[tuple[int, ...]], most: int, cap: int | None, deeper: Callable) -> Iterator[pa.RecordBatch]:
    size = np.unique(part, return_counts=True)[1]
    large = np.repeat(size > (len(part) if cap is None else cap), size)
    alone = np.repeat(size == 1, size)
    yield from deeper(fps[large]) if large.any() else ()
    if (rest := ~large & ~alone).any():
        yield _links_of(part[rest], fps[rest], sets, most)


def close_links(reps: DataFrame, bits: int, cap: int = PART) -> DataFrame:
    """(a, b): links between the representatives in ``reps`` (fp, rep), one row for each fingerprint."""
    sets = chunk_sets(8, bits)
    parts = arrow_map(reps.select("fp"), partial(_parts, sets=sets), "part long, fp long")
    found = checkpointed(arrow_map(parts.repartition("part").sortWithinPartitions("part", "fp"), partial(_link, sets=sets, most=bits, cap=cap), LINKS))
    again = found.where("deeper").select(F.col("a").alias("part"), F.col("b").alias("fp")).distinct()
    again = arrow_map(again.repartition("part").sortWithinPartitions("part", "fp"), partial(_link, sets=position_sets(8, 8 - bits), most=bits, cap=None), LINKS)
    links = found.where("not deeper").unionByName(again).select("a", "b").distinct()
    known = arrow_map(reps.select("fp", "rep"), _numbered, "number long, rep long")
    links = links.join(known.toDF("a", "rep_a"), "a").join(known.toDF("b", "rep_b"), "b")
    return links.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints as the numbers that links have."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(utf8_view(batch.column(0))[0].copy().view(np.int64)), batch.column(1)], ["number", "rep"])


def representatives(fps: DataFrame) -> DataFrame:
    return fps.groupBy("fp").agg(F.min(F.array_min("ids")).alias("rep"))


def with_components(fps: DataFrame, reps: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for each row whose fingerprint is in ``fps``."""
    star = components(links)
    classes = reps.join(star, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return fps.join(classes, "fp").select(F.explode("ids").alias("doc_id"), "fp", "component_id")


def indexed(fps: DataFrame, bits: int, cap: int = PART) -> DataFrame:
    """(doc_id, fp, component_id): all links of at most ``bits`` (0 to 7) differing bits of 64, exactly."""
    reps = representatives(fps)
    return with_components(fps, reps, close_links(reps.where("rep is not null"), bits, cap))


def simhash_components(docs: DataFrame, words: int = SHINGLE, bits: int = DISTANCE, cap: int = PART) -> DataFrame:
    """(doc_id, fingerprint, component_id), with the links of ``indexed``."""
    fps = checkpointed(fingerprints(docs, words))
    return indexed(fps, bits, cap).select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def _shingle_sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = utf8_view(batch.column(1))
        raw = data.tobytes()
        out = [distinct(shingle_hashes(raw[off[i] : off[i + 1]], words)).view(np.int64) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "shingles"])


def cluster_links(rep: np.ndarray, kin: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links (member, first of its tree) of a forest over pairs of sets with a Jaccard similarity of ``similarity``
    and those of one class (``kin``).

    Shared elements are counted from postings of the sets not yet reached, built anew when half of them are.
    """
    size = np.array([len(s) for s in sets])
    _, element = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.concatenate([[0], np.cumsum(size)])
    left, links, held = np.arange(len(sets)), [], None
    while len(left) > 1:
        root, left, todo = left[0], left[1:], [left[0]]
        while todo and len(left):
            if held is None or 2 * len(left) < held[0]:
                flat = np.concatenate([element[ends[i] : ends[i + 1]] for i in left])
                order = np.argsort(flat, kind="stable")
                held = (len(left), flat[order], np.repeat(left, size[left])[order])
            q = todo.pop()
            mine = element[ends[q] : ends[q + 1]]
            low, high = np.searchsorted(held[1], mine), np.searchsorted(held[1], mine, side="right")
            n = high - low
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            both = np.bincount(held[2][at], minlength=len(sets))[left]
            near = (kin[left] == kin[q]) | (both >= similarity * (size[q] + size[left] - both))
            links += [(int(rep[i]), int(rep[root])) for i in left[near]]
            todo += left[near].tolist()
            left = left[~near]
    return links


def _verify(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Links of clusters, or pairs of blocks of one, given in their order: (root, i, j, rep, kin, shingles)."""
    held, key = [], None

    def work() -> pa.RecordBatch:
        rep, kin, sets = zip(*held, strict=True) if len(held) > 1 else ((), (), ())
        links = cluster_links(np.array(rep), np.array(kin), sets, similarity) if rep else []
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    for batch in batches:
        keys = zip(*[batch.column(c).to_pylist() for c in range(5)], strict=True)
        for k, (root, i, j, rep, kin) in enumerate(keys):
            if (root, i, j) != key:
                yield work()
                held, key = [], (root, i, j)
            held.append((rep, kin, np.array(batch.column(5)[k].values.to_numpy(zero_copy_only=False))))
    yield work()


def picked(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Rows whose doc_id is in ``ids`` (left_semi) or isn't (left_anti); few ids are broadcast, so that no text moves."""
    ids = checkpointed(ids)
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", how)


def _prefixes(batches: Iterator[pa.RecordBatch], words: int, similarity: float, common: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(key, rep): the shingles of each text's prefix. ``common`` has the shingles that come last, rarest first."""
    by_hash = np.argsort(common)
    known = common[by_hash]
    for batch in batches:
        data, off = utf8_view(batch.column(1))
        raw, out = data.tobytes(), []
        for i in range(batch.num_rows):
            h = distinct(shingle_hashes(raw[off[i] : off[i + 1]], words))
            n = len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1 if len(h) else 0
            if len(known) and n:
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                last = known[at] == h
                h = np.concatenate([h[~last], h[last][np.argsort(by_hash[at[last]])]])
            out.append(h[:n])
        rep = np.repeat(batch.column(0).to_numpy(), [len(h) for h in out])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *out]).view(np.int64)), pa.array(rep)], ["key", "rep"])


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of each list that has two or more, of postings in order of their keys."""

    def work(rows: np.ndarray) -> pa.RecordBatch:
        same = rows[0, 1:] == rows[0, :-1]
        rows = rows[:, np.r_[False, same] | np.r_[same, False]]  # not those alone in their list
        rows = rows[:, np.lexsort((rows[1], rows[0]))]
        if rows.shape[1]:
            rows = rows[:, np.r_[True, (rows[:, 1:] != rows[:, :-1]).any(0)]]
        size = np.unique(rows[0], return_counts=True)[1]
        ends = np.r_[0, np.cumsum(size[size > 1])]
        members = rows[1, np.repeat(size > 1, size)]
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(members))], ["members"])

    held: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
        if rows[0, 0] == rows[0, -1] and (not held or held[-1][0, 0] == rows[0, 0]):
            held.append(rows)
            continue
        rows = np.concatenate([*held, rows], axis=1)
        cut = int(np.searchsorted(rows[0], rows[0, -1]))
        yield work(rows[:, :cut])
        held = [rows[:, cut:]]
    if held:
        yield work(np.concatenate(held, axis=1))


def folded(bits: np.ndarray, octets: int) -> np.ndarray:
    """Parities in fewer buckets, from those in more."""
    while len(bits) > octets:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def maybe_links(sketches: list[bytes], kin: list[int], similarity: float) -> list[tuple[int, int]]:
    """Links (kin, kin) of forests over all pairs of a list that are of one class or may have a Jaccard similarity of
    ``similarity``.

    Such sets differ in at most (1 - s) / (1 + s) of their summed sizes, and each differing bit takes a differing
    shingle. Sizes of such pairs are within that factor, so their numbers of buckets are the same or next.
    """
    size = np.array([int.from_bytes(x[16:24], "little") for x in sketches])
    octets = np.array([len(x) - 32 for x in sketches])
    share, links, kin = (1 - similarity) / (1 + similarity), [], np.array(kin)
    for w in np.unique(octets):
        mine = np.flatnonzero((octets == w) | (octets == 2 * w))
        bits = np.stack([folded(np.frombuffer(sketches[i], np.uint8, offset=32), w) for i in mine]).view(np.uint64)
        n, own = size[mine], kin[mine]

        def near(q: int, left: np.ndarray, n: np.ndarray = n, bits: np.ndarray = bits, own: np.ndarray = own) -> np.ndarray:
            same = own[left] == own[q]
            fits = ~same & (np.minimum(n[q], n[left]) >= similarity * np.maximum(n[q], n[left]) - 1e-9)
            fits[fits] = distance(bits[q], bits[left[fits]]) <= share * (n[q] + n[left[fits]]) + 1e-9
            return same | fits

        tree = forest(len(mine), near)
        links += [(int(a), int(b)) for a, b in zip(own, own[tree], strict=True) if a != b]
    return links


def _maybe(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Links between classes, of lists given in their order: (list, kin, fp)."""
    last, kin, sketches, out = None, [], [], []
    for batch in batches:
        for key, own, fp in zip(*[batch.column(c).to_pylist() for c in range(3)], strict=True):
            if key != last:
                out += maybe_links(sketches, kin, similarity)
                last, kin, sketches = key, [], []
            kin.append(own)
            sketches.append(fp)
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])
        out = []
    out = maybe_links(sketches, kin, similarity)
    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])


def shingle_sets(docs: DataFrame) -> DataFrame:
    return arrow_map(docs.select("doc_id", "text"), partial(_shingle_sets, words=WIDE_SHINGLE), "doc_id long, shingles array<bigint>")


def common_shingles(docs: DataFrame) -> np.ndarray:
    """Shingles that many texts of a sample have, the rarest of them first."""
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(np.ceil(min(1.0, SAMPLE / max(1, docs.count())) * (1 << 30))))
    counted = shingle_sets(some).select(F.explode("shingles").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON)
    top = counted.orderBy(F.desc("n"), "key").limit(MOST_COMMON).collect()
    return np.array([r.key for r in reversed(top)], np.int64).view(np.uint64)


def verified(docs: DataFrame, member: DataFrame, similarity: float, cluster: int) -> DataFrame:
    """(a, b): links whose trees hold all pairs with a similarity of at least ``similarity`` in the clusters of
    ``member`` (root, kin, rep), and those of one class."""
    blocks = member.groupBy("root").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("root", F.ceil(F.col("_n") / F.lit(cluster)).cast("int").alias("_blocks"))
    member = member.join(blocks, "root").withColumn("_own", F.pmod(F.xxhash64("rep"), "_blocks").cast("int"))
    member = member.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).where("_blocks = 1 or _own <> _other")
    member = member.select("root", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), "rep", "kin")
    sets = shingle_sets(picked(docs.select("doc_id", "text"), member.select(F.col("rep").alias("doc_id")).distinct(), "left_semi"))
    dealt = member.join(sets.dropDuplicates(["doc_id"]).where(F.size("shingles") > 0), F.col("rep") == F.col("doc_id")).select("root", "i", "j", "rep", "kin", "shingles")
    dealt = dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "rep")
    return arrow_map(dealt, partial(_verify, similarity=similarity), "a long, b long").distinct()


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp, ids): the fingerprints in each batch of sketches, with the representatives that have them."""
    for batch in batches:
        held: dict[bytes, list[int]] = {}
        for fp, rep in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.setdefault(fp, []).append(rep)
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.list_(pa.int64()))], ["fp", "ids"])


def index_classes(docs: DataFrame, reps: DataFrame, similarity: float, cluster: int) -> DataFrame:
    """(node, root): classes of representatives by links of the index with a similarity of at least ``similarity``."""
    fps = checkpointed(arrow_map(reps.select(F.substring("fp", 25, 8).alias("fp"), "rep"), _held, "fp binary, ids array<bigint>"))
    near = indexed(fps, NEAR_DISTANCE).select(F.col("component_id").alias("root"), F.col("doc_id").alias("kin"), F.col("doc_id").alias("rep"))
    return components(verified(docs, checkpointed(near.distinct()), similarity, cluster))


def maybe_similar(docs: DataFrame, fps: DataFrame, reps: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links between classes in ``known`` (node, root) whose trees hold all pairs of representatives with a
    similarity of at least ``similarity``."""
    ids = fps.select("fp", F.explode("ids").alias("doc_id")).where("doc_id is not null").join(reps, "fp")
    copies = ids.groupBy("doc_id").agg(F.min(F.col("doc_id") != F.col("rep")).alias("_copy")).where("_copy").select("doc_id")
    texts = picked(docs.select("doc_id", "text").where("doc_id is not null"), copies, "left_anti")
    run = partial(_prefixes, words=WIDE_SHINGLE, similarity=similarity, common=common_shingles(texts))
    lists = arrow_map(texts.select("doc_id", "text"), run, "key long, rep long").repartition("key").sortWithinPartitions("key")
    lists = arrow_map(lists, _lists, "members array<bigint>").distinct()
    members = lists.select(F.xxhash64("members").alias("list"), F.explode("members").alias("rep")).join(known.toDF("rep", "kin"), "rep", "left")
    members = members.select("list", "rep", F.coalesce("kin", "rep").alias("kin"))
    of = Window.partitionBy("list")
    members = members.withColumn("_open", F.min("kin").over(of) < F.max("kin").over(of)).where("_open")
    members = members.join(reps, "rep").select("list", "kin", "fp")
    return arrow_map(members.repartition("list").sortWithinPartitions("list", "kin"), partial(_maybe, similarity=similarity), "a long, b long").distinct()


def similar(docs: DataFrame, similarity: float = SIMILARITY, cluster: int = CLUSTER) -> DataFrame:
    """(doc_id, fp, component_id) with links between texts of a shingle similarity of at least ``similarity``."""
    fps = checkpointed(fingerprints(docs, WIDE_SHINGLE, sketch))
    reps = checkpointed(representatives(fps))
    some = reps.where("rep is not null")
    known = checkpointed(index_classes(docs, some, similarity, cluster))
    star = checkpointed(components(maybe_similar(docs, fps, some, known, similarity)))
    loose = star.select(F.col("node").alias("kin"), "root").unionByName(star.select(F.col("root").alias("kin"), "root").distinct())
    member = known.select(F.col("node").alias("rep"), F.col("root").alias("kin")).unionByName(loose.select(F.col("kin").alias("rep"), "kin"))
    more = verified(docs, member.join(loose, "kin").select("root", "kin", "rep"), similarity, cluster)
    return with_components(fps, reps, known.toDF("a", "b").unionByName(more))


def first_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the documents that are near duplicates of one with a smaller doc_id in their component.

    Texts without words are alike and leave one; rows without a doc_id stay.
    """
    later = similar(docs, similarity).where("doc_id <> component_id").select("doc_id").distinct()
    return picked(docs, later, "left_anti").select(docs.columns)


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
