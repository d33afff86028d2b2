"""Benchmark decontamination by CGK embedding and bit-sampling LSH, with exact edit verification.

The CGK walk over a word sequence x copies x[i] at each step j and moves on if a random bit of
(j, x[i]) is set; sequences at a small edit distance then agree in most steps (Hamming). A key samples a
few steps, in several independent walks and samples (``REPEATS``). Windows are item-sized: an item of n
words is looked for with the largest size 3 * 2^k up to ``PART`` of n, anchored at every word where such a
window fits: each anchor is a draw of its own against the edits, at no cost to the texts, whose windows
start at every word anyway. The walks reach ``TARGET`` recall at ``MAX_EDITS``.

Exact pieces finish the rest: an item that allows k edits is cut into k + 1 pieces, and k edits leave one
of them whole. Every text is searched for all pieces, so the recall is 1 up to and at ``MAX_EDITS``.

All windows of a size share their walks from (step, word) on, so keys of all starts come from one
backward recursion over steps, vectorised over words:
key_j(i) = [j sampled] x[i] + key_{j+1}(i + bit_j(x[i])).

Keys of frequent words select nothing, so an anchor is keyed only if its sampled words, by their frequency in
the block of items, are expected to meet fewer than ``CANDIDATES`` windows a word of text, all anchors
together; pieces cannot be left out. Before a hit becomes a candidate, the item's words are looked up around
their places, rarest first, many hits at once: more of them missing than edits are allowed rule it out.

A candidate is verified by semi-global edit distance over words, bit-parallel: at most ``MAX_EDITS`` of the
item's words. Items are read in blocks of at most ``ITEM_BLOCK`` rows and ``ITEM_WORDS`` words (but one item at
least), which bounds what a task is sent; each block meets all texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.llm.common import map_batches, slices, table, text_or_empty, texts_of
from panelmill.llm.wordhash import PUNCTUATION, Words, mix, rolling

MAX_EDITS = 0.2
TARGET = 0.95
PART = 0.75
SAMPLES = 4
REPEATS = 3
STRETCH = 1.4
CANDIDATES = 0.02
ITEM_BLOCK = 20_000
ITEM_WORDS = 300_000
HITS = 500_000
SLICE = 200_000
_LUT_BITS = 16


def item_words(texts: list[str]) -> Words:
    """Words of letters and digits in lower case."""
    return Words([t.lower() for t in texts], separators=PUNCTUATION)


def window_size(n: int) -> int:
    """Largest 3 * 2^k up to ``PART`` of n words; 3 where there is none, n itself below 3."""
    size = 3
    while 2 * size <= PART * n:
        size *= 2
    return min(size, n)


def pieces(n: int) -> list[tuple[int, int]]:
    """(first word, words) of the parts of an item of n words, one more than its edits."""
    cut = [n * i // (int(MAX_EDITS * n) + 1) for i in range(int(MAX_EDITS * n) + 2)]
    return [(a, b - a) for a, b in zip(cut, cut[1:], strict=False)]


def walk_keys(hashes: np.ndarray, size: int, repeat: int, rarity: np.ndarray | None = None):
    """Key of the window that starts at each word (the walk may look at words past its end). With the ``rarity``
    of each word, a 32-bit number: (keys, summed rarity of the places that each key samples, each place once)."""
    steps = max(1, round(STRETCH * size))
    rng = np.random.default_rng([size, repeat])
    edges = np.linspace(0, steps, min(SAMPLES, steps) + 1).astype(int)
    sampled = {int(rng.integers(a, b)) for a, b in zip(edges, edges[1:], strict=False) if b > a}
    n = len(hashes)
    salt = int(rng.integers(1, 2**63))
    symbol = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    key = np.zeros(n + 1, np.uint32)
    move, other = np.empty(n, np.int32), np.empty(n, np.uint32)
    ahead, here = key[1:], key[:-1]
    # twice the sum, plus one where the place itself is in it
    total, spare = np.zeros(n + 1 if rarity is not None else 1, np.uint32), np.empty(n if rarity is not None else 0, np.uint32)
    bits = None
    for j in range(max(sampled), -1, -1):
        if bits is None or j % 32 == 31:
            bits = (mix(hashes + np.uint64(salt * (j // 32 + 1) % 2**64)) >> np.uint64(32)).astype(np.uint32).view(np.int32)
        # all ones where the walk moves on, else all zeros; selecting by mask stays in SIMD registers
        np.left_shift(bits, 31 - j % 32, out=move)
        np.right_shift(move, 31, out=move)
        np.bitwise_xor(ahead, here, out=other)
        np.bitwise_and(other, move.view(np.uint32), out=other)
        np.bitwise_xor(here, other, out=here)
        if j in sampled:
            np.multiply(here, np.uint32(0x9E3779B1), out=here)
            np.bitwise_xor(here, symbol * np.uint32(2 * j + 0x85EBCA6B), out=here)
        if rarity is not None:
            np.bitwise_xor(total[1:], total[:-1], out=spare)
            np.bitwise_and(spare, move.view(np.uint32), out=spare)
            np.bitwise_xor(total[:-1], spare, out=total[:-1])
            np.bitwise_and(move.view(np.uint32), np.uint32(1), out=spare)
            np.bitwise_and(total[:-1], ~spare, out=total[:-1])
            if j in sampled:
                total[:-1] += np.where(total[:-1] & np.uint32(1), np.uint32(0), 2 * rarity + np.uint32(1))
    return here if rarity is None else (here, total[:-1] >> np.uint32(1))


class Items:
    """Benchmark items by window size and repeat: sorted keys, and the item and anchor behind each."""

    def __init__(self, ids: list[int | None], texts: list[str], times: list[int] | None = None):
        w = item_words(texts)
        self.ids, self.times = ids, times or [1] * len(ids)
        self.words = [w.hashes[a:b] for a, b in zip(w.offsets[:-1], w.offsets[1:], strict=True)]
        self.known, which, often = np.unique(w.hashes, return_inverse=True, return_counts=True)
        self.first, self.sizes = w.offsets[:-1], w.counts
        self.most = (MAX_EDITS * w.counts).astype(np.int64)
        # places of each item's words, rarest first, and the words there
        self.places = np.lexsort((often[which], np.repeat(np.arange(len(ids)), w.counts))) if len(which) else np.empty(0, np.int64)
        self.which = which[self.places].astype(np.int64)
        self.places = (self.places - np.repeat(self.first, w.counts)).astype(np.int64)
        by_size: dict[int, list[int]] = {}
        for k, words in enumerate(self.words):
            if len(words):
                by_size.setdefault(window_size(len(words)), []).append(k)
        anchors = sum(len(self.words[k]) - size + 1 for size, own in by_size.items() for k in own)
        needed = 1024 * (np.log2(max(anchors, 1) * REPEATS) - np.log2(CANDIDATES))
        rarity = (1024 * np.log2(len(which) / often)).astype(np.uint32) if len(which) else np.empty(0, np.uint32)
        self.tables = []
        for size, own in sorted(by_size.items()):
            # all items of a size in one walk, kept apart by words that no text has
            pad = mix(np.arange(1, 2 * size + 1, dtype=np.uint64))
            flat = np.concatenate([part for k in own for part in (self.words[k], pad)])
            counts = np.array([len(self.words[k]) - size + 1 for k in own])
            base = np.cumsum(counts + 3 * size - 1) - (counts + 3 * size - 1)
            at = np.minimum(np.searchsorted(self.known, flat), len(self.known) - 1)
            rare = np.where(self.known[at] == flat, rarity[at], np.uint32(0))
            every = np.repeat(own, counts).astype(np.int32)
            offsets = (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int32)
            for repeat in range(REPEATS):
                keys, total = walk_keys(flat, size, repeat, rare)
                told = total[np.repeat(base, counts) + offsets] >= needed
                keys, item, offset = keys[(np.repeat(base, counts) + offsets)[told]], every[told], offsets[told]
                by = np.argsort(keys, kind="stable")
                lut = np.zeros(1 << min(32, max(_LUT_BITS, len(keys).bit_length() + 4)), bool)
                lut[keys & np.uint32(len(lut) - 1)] = True
                self.tables.append((size, repeat, keys[by], item[by], offset[by], lut))
        by_width: dict[int, list[tuple[int, int, int]]] = {}
        for k, words in enumerate(self.words):
            for o, width in pieces(len(words)) if len(words) else []:
                by_width.setdefault(width, []).append((int(rolling(words[o : o + width], width)[0]), k, o))
        self.pieces = []
        for width, rows in sorted(by_width.items()):
            rows.sort()
            keys = np.array([h for h, _, _ in rows], np.uint64)
            bits = max(_LUT_BITS, len(keys).bit_length() + 4)
            lut = np.zeros(1 << bits, bool)
            lut[keys & np.uint64((1 << bits) - 1)] = True
            self.pieces.append((width, keys, np.array([k for _, k, _ in rows], np.int32), np.array([o for _, _, o in rows], np.int32), lut))

    def matches(self, w: Words):
        """Arrays (word of the texts, item, word of the item) of all key matches and whole pieces, in runs of about
        ``HITS``; one place of the texts is never cut."""
        for size, repeat, keys, item, offset, lut in self.tables:
            if len(w.hashes) and len(keys):
                mine = walk_keys(w.hashes, size, repeat)
                near = np.flatnonzero(lut[mine & np.uint32(len(lut) - 1)])
                yield from _equal_keys(mine[near], near, keys, item, offset)
        for width, keys, item, offset, lut in self.pieces:
            mine = rolling(w.hashes, width)
            near = np.flatnonzero(lut[mine & np.uint64(len(lut) - 1)])
            near = near[near + width <= w.offsets[np.searchsorted(w.offsets, near, side="right")]]
            yield from _equal_keys(mine[near], near, keys, item, offset)

    def hits(self, w: Words) -> set[tuple[int, int, int]]:
        """(text, item, expected first word of the item) of every match around which enough of the item's words stand."""
        n = len(w.hashes)
        at = np.minimum(np.searchsorted(self.known, w.hashes), max(len(self.known) - 1, 0))
        there = np.flatnonzero(self.known[at] == w.hashes) if len(self.known) else np.empty(0, np.int64)
        stands = np.sort(at[there] * (n + 1) + there)
        out = set()
        for place, item, offset in self.matches(w):
            pairs = np.unique(np.stack((item.astype(np.int64), place - offset, np.searchsorted(w.offsets, place, side="right") - 1)), axis=1)
            item, start, text = pairs[:, self._enough(*pairs[:2], stands, n)]
            out.update(zip(text.tolist(), item.tolist(), start.tolist(), strict=True))
        return out

    def _enough(self, item: np.ndarray, start: np.ndarray, stands: np.ndarray, n: int) -> np.ndarray:
        """Which (item, first word) can be within the edits allowed: at most so many words of the item do not stand
        within so many words of their place. ``stands``: sorted (known word) * (n + 1) + (place among n words)."""
        out = np.zeros(len(item), bool)
        alive, missing, j = np.arange(len(item)), np.zeros(len(item), np.int64), 0
        while len(alive):
            k = item[alive]
            entry, most = self.first[k] + j, self.most[k]
            word, place = self.which[entry] * (n + 1), start[alive] + self.places[entry]
            low, high = word + np.clip(place - most, 0, n), word + np.clip(place + most, -1, n)
            found = np.append(stands, np.iinfo(np.int64).max)[np.searchsorted(stands, low)] <= high
            missing += ~found
            j += 1
            good = missing <= most
            ends = self.sizes[k] == j
            out[alive[good & ends]] = True
            alive, missing = alive[good & ~ends], missing[good & ~ends]
        return out

    def find(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, first word, words of the item, edits): the best place of each leaked item."""
        w = item_words(texts)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        tried = set()
        for t, k, start in sorted(self.hits(w)):
            item = self.words[k]
            n = len(item)
            most = int(MAX_EDITS * n)
            place = (t, k, start // max(1, most + 1))
            if place in tried:
                continue
            tried.add(place)
            first, last = int(w.offsets[t]), int(w.offsets[t + 1])
            a, b = max(first, start - 2 * most - 1), min(last, start + n + 2 * most + 1)
            part = w.hashes[a:b]
            edits, end = edit_distance(item, part)
            if edits <= most and ((t, k) not in best or edits < best[t, k][0]):
                best[t, k] = (edits, max(a + end - n, first) - first)
        return [(t, k, s, len(self.words[k]), e) for (t, k), (e, s) in sorted(best.items())]


def _equal_keys(mine: np.ndarray, place: np.ndarray, keys: np.ndarray, item: np.ndarray, offset: np.ndarray):
    """(place, item, offset) of all pairs of equal keys, in runs of about ``HITS`` pairs."""
    low, high = np.searchsorted(keys, mine), np.searchsorted(keys, mine, side="right")
    met = high > low
    place, low, many = place[met], low[met], (high - low)[met]
    ends = np.cumsum(many)
    a = 0
    while a < len(place):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] - many[a] + HITS, side="right")))
        some = many[a:b]
        row = np.repeat(low[a:b] - (np.cumsum(some) - some), some) + np.arange(some.sum())
        yield np.repeat(place[a:b], some), item[row], offset[row]
        a = b


def edit_distance(item: np.ndarray, part: np.ndarray) -> tuple[int, int]:
    """Least edits between the item and any piece of ``part``, and the end of the first such piece.

    The columns of the table of edits are bit vectors of their differences: one bit a word of the item."""
    n = len(item)
    where: dict[int, int] = {}
    for i, word in enumerate(item.tolist()):
        where[word] = where.get(word, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << n >> 1
    more, less = full, 0
    edits, best, end = n, n, 0
    for j, word in enumerate(part.tolist()):
        same = where.get(word, 0)
        across = (((same & more) + more) ^ more) | same
        up, down = less | (full & ~(across | more)), more & across
        edits += bool(up & top) - bool(down & top)
        up, down, same = up << 1 & full, down << 1 & full, same | less
        more, less = down | (full & ~(same | up)), up & same
        if edits < best:
            best, end = edits, j + 1
    return best, end


def item_blocks(items: DataFrame):
    """Items in blocks of bounded rows and words, by item_id (nulls first) and text, read one part of the sorted table
    at a time. Repeated rows are one, with their number."""
    items = items.select("item_id", text_or_empty().alias("text")).groupBy("item_id", "text").agg(F.count("*").alias("times"))
    rows, words = [], 0
    for row in items.orderBy(F.col("item_id").asc_nulls_first(), "text").toLocalIterator():
        size = len(item_words([row[1]]).hashes)
        if rows and (len(rows) == ITEM_BLOCK or words + size > ITEM_WORDS):
            yield Items(*map(list, zip(*rows, strict=True)))
            rows, words = [], 0
        rows.append(tuple(row))
        words += size
    if rows:
        yield Items(*map(list, zip(*rows, strict=True)))


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, first_word, item_words, edits: one row for each item found in each row of ``docs``.

    Null and empty texts hold no item; items without words are never found; items of equal text are each
    reported. Null doc_ids and item_ids are searched like others and reported as null; repeated rows give
    repeated results. Extra columns are ignored.
    """
    schema = "doc_id long, item_id long, first_word long, item_words long, edits long"
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    out = None
    for block in item_blocks(items):

        def run(batch, block=block):
            all_texts = texts_of(batch)
            for a, b in slices(all_texts, SLICE):
                rows = [(a + t, block.ids[k], s, n, e) for t, k, s, n, e in block.find(all_texts[a:b]) for _ in range(block.times[k])]
                if rows:
                    at, *rest = zip(*rows, strict=True)
                    yield batch.column("doc_id").take(pa.array(at)), *rest

        found = map_batches(texts, run, schema)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns kept as they are, whose text holds no benchmark item. Every row is
    judged by its own text, whatever its id; null and empty texts stay."""
    for block in item_blocks(items):

        def run(batches, block=block):
            for batch in batches:
                texts = texts_of(batch)
                clean = np.ones(len(texts), bool)
                for a, b in slices(texts, SLICE):
                    for t, *_ in block.find(texts[a:b]):
                        clean[a + t] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op1_cgk_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


QUERIES = {"op1_cgk_lsh": op1_cgk_lsh}
