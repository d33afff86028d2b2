"""Byte-level BPE by merge replay over word tables.

A shard's texts are cut into pattern matches ("words"); every distinct word that the shard has not
met yet joins one flat token array. An inverted index maps each mergeable pair's rank to the
positions where it stands. Merges are applied in rank order over the whole array at once, and each
application touches only its two neighbours. The ids of a text are then the concatenation of its
words' ids. Shards are the Arrow batches of a partition, so nothing is shuffled or collected; the
word table of a worker is cleared once it holds over ``WORD_TABLE_ROWS`` words, which bounds memory
and changes no result.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from panelmill.llm.common import map_batches, sha_hex, slices, table, text_or_empty, texts_of

WORD_TABLE_ROWS = 250_000
SLICE = 6_000_000
ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> tuple[dict[bytes, int], list[bytes]]:
    """Ranks by token bytes, and token bytes by rank."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    return ranks, pieces


def replay(words: list[bytes], ranks: dict[bytes, int], pieces: list[bytes]) -> list[list[int]]:
    """Token ids of every word.

    The heap holds ranks that have waiting positions. A merge can create a pair of a rank below the
    current one; the rest of that word then waits until the lower rank has been replayed, as the
    lowest rank of a word always goes first and equal ranks go from left to right.
    """
    single = [ranks[bytes([b])] for b in range(256)]
    token: list[int] = []
    word_of: list[int] = []
    starts: list[int] = []
    for w, word in enumerate(words):
        starts.append(len(token))
        token += [single[b] for b in word]
        token.append(-1)
        word_of += [w] * (len(word) + 1)
    size = len(token)
    after = list(range(1, size + 1))
    before = list(range(-1, size - 1))
    joined: dict[tuple[int, int], int] = {}

    def rank_at(i: int) -> int:
        """Rank of the pair that starts at i; -1 if there is none."""
        a, b = token[i], token[after[i]]
        if a < 0 or b < 0:
            return -1
        r = joined.get((a, b))
        if r is None:
            r = joined[a, b] = ranks.get(pieces[a] + pieces[b], -1)
        return r

    waiting: dict[int, list[int]] = {}
    for i in range(size - 1):
        if (r := rank_at(i)) >= 0:
            waiting.setdefault(r, []).append(i)
    order = list(waiting)
    heapq.heapify(order)
    while order:
        rank = heapq.heappop(order)
        places = waiting.pop(rank, None)
        if places is None:
            continue
        places.sort()
        later: list[int] = []
        held_word = -1
        for i in places:
            if word_of[i] == held_word:
                later.append(i)
                continue
            if token[i] < 0 or rank_at(i) != rank:
                continue
            j = after[i]
            k = after[j]
            token[i] = rank
            token[j] = -2
            after[i] = k
            before[k] = i
            h = before[i]
            for at in (h, i):
                if at >= 0 and token[at] >= 0 and (r := rank_at(at)) >= 0:
                    if r == rank:
                        # the next equal pair to the right may already wait; the left one never precedes i
                        later.append(at)
                        held_word = word_of[i]
                        continue
                    if r not in waiting:
                        waiting[r] = []
                        heapq.heappush(order, r)
                    waiting[r].append(at)
                    if r < rank:
                        held_word = word_of[i]
        if later:
            if rank not in waiting:
                waiting[rank] = []
                heapq.heappush(order, rank)
            waiting[rank] += later
    out = []
    for s, word in zip(starts, words, strict=True):
        ids, i, end = [], s, s + len(word)
        while i < end:
            ids.append(token[i])
            i = after[i]
        out.append(ids)
    return out


@functools.lru_cache(maxsize=4)
def pair_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys (left rank << 32 | right rank) of every mergeable pair in order, and the ranks they make."""
    ranks, _ = vocabulary(path)
    keys, made = [], []
    for piece, rank in ranks.items():
        for cut in range(1, len(piece)):
            a, b = ranks.get(piece[:cut]), ranks.get(piece[cut:])
            if a is not None and b is not None:
                keys.append(a << 32 | b)
                made.append(rank)
    order = np.argsort(np.array(keys, dtype=np.int64))
    return np.array(keys, dtype=np.int64)[order], np.array(made, dtype=np.int64)[order]


def replay_many(words: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Merge replay over a whole word table: (token ids of all words in order, their number by word).

    One step replays one rank at all its positions. Two things need a left-to-right order inside a
    word: equal pairs that overlap, and a merge that makes a pair of a lower rank while the word
    has other positions of this rank. Words where either occurs go through ``replay``.
    """
    ranks, pieces = vocabulary(path)
    keys, made = pair_table(path)
    single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
    size = len(flat)
    token = single[flat]
    ends = np.cumsum(lengths + 1) - 1
    token[ends] = -1
    word_of = np.repeat(np.arange(len(words)), lengths + 1)
    after = np.arange(1, size + 1)
    after[-1] = size - 1
    before = np.arange(-1, size - 1)
    before[0] = 0
    odd = np.zeros(len(words), bool)

    def rank_at(at: np.ndarray) -> np.ndarray:
        a, b = token[at], token[after[at]]
        key = np.where((a < 0) | (b < 0), -1, a << 32 | b)
        place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[place] == key, made[place], -1)

    rank_of = rank_at(np.arange(size))
    waiting: dict[int, list[np.ndarray]] = {}

    def enlist(at: np.ndarray, values: np.ndarray) -> None:
        """Add positions to the inverted index by the rank of their pair."""
        some = values >= 0
        at, values = at[some], values[some]
        if not len(at):
            return
        by = np.argsort(values, kind="stable")
        at, values = at[by], values[by]
        cuts = np.flatnonzero(np.diff(values)) + 1
        for part, first in zip(np.split(at, cuts), values[np.concatenate(([0], cuts))].tolist(), strict=True):
            if first not in waiting:
                waiting[first] = []
                heapq.heappush(order, first)
            waiting[first].append(part)

    order: list[int] = []
    enlist(np.arange(size), rank_of)
    while order:
        rank = heapq.heappop(order)
        lists = waiting.pop(rank)
        at = lists[0] if len(lists) == 1 else np.concatenate(lists)
        at = at[(rank_of[at] == rank) & ~odd[word_of[at]]]
        if not len(at):
            continue
        nxt = after[at]
        clash = (rank_of[nxt] == rank) & (token[nxt] >= 0)
        if clash.any():
            odd[word_of[at[clash]]] = True
            keep = ~odd[word_of[at]]
            at, nxt = at[keep], nxt[keep]
            if not len(at):
                continue
        far = after[nxt]
        token[at] = rank
        token[nxt] = -2
        rank_of[nxt] = -1
        after[at] = far
        before[far] = at
        touched = np.concatenate((at, before[at]))
        values = rank_at(touched)
        rank_of[touched] = values
        low = (values >= 0) & (values < rank)
        if low.any():
            owners, times = np.unique(word_of[at], return_counts=True)
            odd[np.intersect1d(owners[times > 1], word_of[touched[low]])] = True
        enlist(touched, values)
    live = token >= 0
    live &= ~odd[word_of]
    ids = token[live]
    counts = np.bincount(word_of[live], minlength=len(words))
    if odd.any():
        which = np.flatnonzero(odd)
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for w, own in zip(which.tolist(), replay([words[w] for w in which], ranks, pieces), strict=True):
            parts[w] = np.array(own, dtype=np.int64)
            counts[w] = len(own)
        ids = np.concatenate(parts)
    return ids, counts


class _Codes(dict):
    """Numbers words in the order they are met."""

    def __missing__(self, word: str) -> int:
        self[word] = code = len(self)
        return code


class Encoder:
    """Encodes and decodes texts as the tiktoken library does, without special tokens."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        self.path = path
        self.ranks, self.pieces = vocabulary(path)
        self.find = regex.compile(pattern).findall
        self._clear()

    def _clear(self) -> None:
        self.codes, self.packed, self.plain = _Codes(), [], []

    def learn(self, words: list[str]) -> None:
        """Ids and decoded bytes of newly numbered words."""
        data = [w.encode("utf-8", "surrogatepass") for w in words]
        whole = [self.ranks.get(d) for d in data]  # a match that is itself a token is never merged
        ids, counts = replay_many([d for d, r in zip(data, whole, strict=True) if r is None], self.path)
        packed, at, counts = ids.astype("<u4").tobytes(), 0, iter(counts.tolist())
        ids = ids.tolist()
        for rank in whole:
            if rank is not None:
                self.packed.append(rank.to_bytes(4, "little"))
                self.plain.append(self.pieces[rank])
            else:
                n = next(counts)
                self.packed.append(packed[4 * at : 4 * (at + n)])
                self.plain.append(self.decode(ids[at : at + n]))
                at += n

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.pieces[i] for i in ids])

    def encode_many(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """(ids as little-endian unsigned 32-bit integers, bytes decoded from them) of every text."""
        for a, b in slices(texts, SLICE):
            if len(self.codes) > WORD_TABLE_ROWS:
                self._clear()
            number = self.codes.__getitem__
            coded = []
            for t in texts[a:b]:
                found = self.find(t)
                coded.append(np.fromiter(map(number, found), np.int32, len(found)))
            if len(self.codes) > len(self.packed):
                self.learn(list(islice(self.codes, len(self.packed), None)))
            packed, plain = self.packed, self.plain
            for codes in coded:
                codes = codes.tolist()
                yield b"".join([packed[c] for c in codes]), b"".join([plain[c] for c in codes])


def tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids, and digests of the ids and of the bytes decoded from them.

    A null or empty text has no ids; a null doc_id stays null. Repeated rows give repeated results; other
    columns are ignored.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batch, encoder):
        texts = texts_of(batch)
        for a, b in slices(texts, SLICE):
            made = list(encoder.encode_many(texts[a:b]))
            yield batch.column("doc_id").slice(a, b - a), [len(p) // 4 for p, _ in made], [np.frombuffer(p, "<i4") for p, _ in made], [sha_hex(p) for p, _ in made], [sha_hex(d) for _, d in made]

    return map_batches(docs.select("doc_id", text_or_empty().alias("text")), run, "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string", lambda: Encoder(path))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Counts and hashes of the ids and of the bytes decoded from them, one row for each input row."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batch, encoder):
        rows = [(len(p) // 4, sha_hex(p), sha_hex(d)) for p, d in encoder.encode_many(texts_of(batch))]
        yield batch.column("doc_id"), *(zip(*rows, strict=True) if rows else [()] * 3)

    return map_batches(docs.select("doc_id", text_or_empty().alias("text")), run, ENCODED, lambda: Encoder(path))


def op3_bpe_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {"op3_bpe_merge_replay": op3_bpe_merge_replay}
