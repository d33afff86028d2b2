"""Cross-tokenizer alignment by a dangling-suffix transducer.

Tokens of two vocabularies over the same bytes are read in turn. The state is the side that leads and the
bytes of its last token that the other side has not matched yet; the next token comes from the side behind.
Transitions are memoised by state and token. An empty residual closes a group; a token read on a residual
overlaps exactly the token that left it, which is the link between the two.

No token of either vocabulary has a space or line end after another character, nor punctuation after an
ASCII letter (checked as the vocabularies are loaded; else texts stay whole), so both cut before a lone space
or line end and between such a letter and punctuation. Texts are read in such units, and an equal unit is
aligned once for each worker's table. A unit whose bytes are not those of both tokenizations spoils its
document: the first byte that differs stays different whatever follows.

Counts of id pairs are corpus-wide. Tasks cut their texts into blocks and write, for each block, one row
with its distinct pairs, in how many of its documents each is held, and its documents' pairs as numbers into
that list. The lists are counted over all blocks, each block gets the counts of its own pairs back, and
documents are summed up by block: texts never travel, and a pair travels once for each block, not for each
document. A block is bounded by ``BLOCK`` characters or one text.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import re
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.llm.common import arrow_schema, slices, table, text_or_empty, texts_of, written

BLOCK = 2_000_000
UNIT_TABLE_ROWS = 100_000
#: So many units are encoded as one text.
JOINED = 1000
#: So many units' tokens, groups and links are held as lists at once, before they go to the tables.
LEARNT = 20 * JOINED
#: Bits of an id in a pair's code, A's id above B's.
BITS = 16
# U+180E is white space to some versions of Unicode
_UNIT = re.compile(r"(?<=[^\s\u180e])(?=[ \n][^\s\u180e])|(?<=[A-Za-z])(?=[.,;:!?])")
_PLAIN = re.compile(r" [^\s\u180e]+")
_SPANS = re.compile(r"[^\s\u180e][ \n]|[A-Za-z][.,;:!?]")
BLOCKS = "block long, doc_ids array<long>, stats binary, digests array<string>, held binary, pairs array<long>, docs array<long>"
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones stand for themselves,
    the others in order for the code points from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Numbering(dict):
    """Numbers keys from 0 in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class Transducer:
    """States are numbered; 0 is the empty residual, -1 that of bytes that differ. ``memo`` holds transitions by
    state and token, ``at_once`` those from the empty residual by a token of either side: what a group of
    just the two reads, and nothing where they do not close one."""

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes]):
        self.tokens = (a_bytes, b_bytes)
        self.states: list[tuple[int, bytes]] = [(1, b"")]
        self.known: dict[tuple[int, bytes], int] = {(1, b""): 0}
        self.memo: dict[int, int] = {}
        self.at_once: dict[int, str] = {}

    def _number(self, lead: int, residual: bytes) -> int:
        if not residual:
            return 0
        state = self.known.get((lead, residual))
        if state is None:
            state = self.known[lead, residual] = len(self.states)
            self.states.append((lead, residual))
        return state

    def after(self, state: int, token: int) -> int:
        """The token is of the side behind; side A (0) moves first where none leads."""
        key = state << BITS | token
        out = self.memo.get(key)
        if out is None:
            lead, residual = self.states[state]
            new = self.tokens[1 - lead][token]
            if residual.startswith(new):
                out = self._number(lead, residual[len(new) :])
            elif new.startswith(residual):
                out = self._number(1 - lead, new[len(residual) :])
            else:
                out = -1
            self.memo[key] = out
        return out

    def align(self, a: list[int], b: list[int]) -> tuple[list[str], list[int]] | None:
        """(groups as they read, links as codes) of two token lists of the same bytes; None where they differ."""
        at_once, states, after = self.at_once, self.states, self.after
        groups, links = [], []
        i, j, n_a, n_b = 0, 0, len(a), len(b)
        while i < n_a and j < n_b:
            key = a[i] << BITS | b[j]
            text = at_once.get(key)
            if text is None:
                text = at_once[key] = "" if after(after(0, a[i]), b[j]) else f"{a[i]}|{b[j]}"
            links.append(key)
            if text:
                groups.append(text)
                i += 1
                j += 1
                continue
            begin_a, begin_b = i, j
            state = after(after(0, a[i]), b[j])
            i += 1
            j += 1
            while state > 0:
                if states[state][0]:
                    if i == n_a:
                        return None
                    token = a[i]
                    i += 1
                else:
                    if j == n_b:
                        return None
                    token = b[j]
                    j += 1
                links.append(a[i - 1] << BITS | b[j - 1])
                state = after(state, token)
            if state:
                return None
            groups.append(",".join(map(str, a[begin_a:i])) + "|" + ",".join(map(str, b[begin_b:j])))
        return None if i < n_a or j < n_b else (groups, links)


class Aligner:
    """Both tokenizers and the units that the worker has met."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of = byte_letters()
        names = [self.a.id_to_token(i) for i in range(self.a.get_vocab_size())]
        self.a_bytes = [bytes(byte_of[c] for c in name) if set(name) <= byte_of.keys() else name.encode() for name in names]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.cut = None if any(_SPANS.search(t.decode(errors="replace")) for t in (*self.a_bytes, *self.b_bytes)) else _UNIT
        self.begins = tuple(np.array([t.startswith(b" ") for t in side]) for side in (self.a_bytes, self.b_bytes))
        self.clear()

    def clear(self) -> None:
        """Forget all units, their distinct pairs and the transitions."""
        self.units = Numbering()
        self.sizes = array("q")  # n_a, n_b, n_groups, whether it is sound, of each unit
        self.groups: list[bytes] = []
        self.ends = array("q", [0])
        self.links = array("q")  # numbers of pairs
        self.pairs = Numbering()
        self.machine = Transducer(self.a_bytes, self.b_bytes)

    def units_of(self, text: str) -> list[str]:
        """Units of a text with the space that A is given and B adds; none of an empty text."""
        if not text:
            return []
        return self.cut.split(" " + text) if self.cut else [" " + text]

    def _encoded_a(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded_b(self, units: list[str]) -> list[list[int]]:
        """B adds a space to every text; a line end before units without one keeps the added one apart."""
        made = self.b.encode([u[1:] if u[0] == " " else "\n" + u for u in units], num_threads=1)
        return [ids if u[0] == " " else ids[2:] for u, ids in zip(units, made, strict=True)]

    def learn(self, new: list[str]) -> None:
        """Units in the order of their numbers, ``LEARNT`` at a time."""
        for at in range(0, len(new), LEARNT):
            self._learn(new[at : at + LEARNT])

    def _learn(self, new: list[str]) -> None:
        """Plain units, one space and then no white space, are encoded many at once: in both vocabularies each
        begins with the one token of it that starts with a space."""
        made: dict[str, tuple] = {}
        odd = [u for u in new if not _PLAIN.fullmatch(u)]
        plain = [u for u in new if _PLAIN.fullmatch(u)]
        align = self.machine.align
        for at in range(0, len(plain), JOINED):
            some = plain[at : at + JOINED]
            whole = "".join(some)
            a, b = self._encoded_a([whole])[0], self.b.encode(whole[1:])
            of_a, of_b = (np.flatnonzero(first[np.array(ids)]).tolist() for first, ids in zip(self.begins, (a, b), strict=True))
            if len(of_a) != len(some) or len(of_b) != len(some) or b"".join([self.a_bytes[i] for i in a]) != whole.encode():
                odd += some
                continue
            of_a.append(len(a))
            of_b.append(len(b))
            for k, unit in enumerate(some):
                x, y = a[of_a[k] : of_a[k + 1]], b[of_b[k] : of_b[k + 1]]
                made[unit] = len(x), len(y), align(x, y)
        for at in range(0, len(odd), JOINED):
            some = odd[at : at + JOINED]
            for unit, x, y in zip(some, self._encoded_a(some), self._encoded_b(some), strict=True):
                right = b"".join([self.a_bytes[i] for i in x]) == unit.encode()
                made[unit] = len(x), len(y), align(x, y) if right else None
        for unit in new:
            n_a, n_b, found = made[unit]
            groups, links = found or ((), ())
            self.sizes.extend((n_a, n_b, len(groups), found is not None))
            self.groups.append(";".join(groups).encode())
            self.links.extend(map(self.pairs.__getitem__, links))
            self.ends.append(len(self.links))

    def block(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(stats, digests, bounds, held, times, pairs and their documents) of a list of texts.

        stats: n_a, n_b, n_groups, n_links by text. held[bounds[i]:bounds[i+1]] are the numbers of the pairs that
        text i holds, times how often; numbers are in the order of falling counts of documents.
        """
        if len(self.units) > UNIT_TABLE_ROWS:
            self.clear()
        split = [self.units_of(t) for t in texts]
        had = len(self.units)
        numbers = [np.fromiter(map(self.units.__getitem__, units), np.int64, len(units)) for units in split]
        del split
        self.learn(list(itertools.islice(self.units, had, None)))
        sizes = np.frombuffer(self.sizes, np.int64).reshape(-1, 4) if self.sizes else np.zeros((0, 4), np.int64)
        numbers = [n if sizes[n, 3].all() else n[:0] for n in numbers]
        digests = [hashlib.sha256(b";".join([self.groups[k] for k in n.tolist()])).hexdigest() if len(n) else "" for n in numbers]
        flat = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(texts)), [len(n) for n in numbers])
        ends = np.frombuffer(self.ends, np.int64)
        counts = (ends[1:] - ends[:-1])[flat]
        of_text = np.concatenate(([0], np.cumsum([len(n) for n in numbers]))).astype(np.int64)
        totals = np.concatenate((np.zeros((1, 4), np.int64), np.cumsum(np.column_stack((sizes[flat, :3], counts)), axis=0)))
        stats = totals[of_text[1:]] - totals[of_text[:-1]]
        before = np.concatenate(([0], np.cumsum(counts)))
        links = np.frombuffer(self.links, np.int64)[np.repeat(ends[flat] - before[:-1], counts) + np.arange(before[-1])] if before[-1] else np.zeros(0, np.int64)
        width = max(len(self.pairs), 1)
        keys, times = np.unique(np.repeat(owner, counts) * width + links, return_counts=True)
        holder, pair = keys // width, keys % width
        docs = np.bincount(pair, minlength=width)
        order = np.argsort(-docs, kind="stable")[: np.count_nonzero(docs)]
        rank = np.empty(width, np.int64)
        rank[order] = np.arange(len(order))
        bounds = np.searchsorted(holder, np.arange(len(texts) + 1))
        codes = np.fromiter(self.pairs, np.int64, len(self.pairs))[order] if len(order) else np.zeros(0, np.int64)
        return stats, digests, bounds, rank[pair], times, np.stack((codes, docs[order]))


@functools.lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _packed(*parts: np.ndarray) -> bytes:
    """Numbers as one compressed string, byte by byte of their four bytes."""
    sizes = np.array([len(p) for p in parts], "<i8").tobytes()
    planes = [np.ascontiguousarray(p.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for p in parts]
    return sizes + zstandard.compress(b"".join(planes), 3)


def _unpacked(data: bytes, n: int) -> list[np.ndarray]:
    sizes = np.frombuffer(data, "<i8", n)
    raw = np.frombuffer(zstandard.decompress(data[8 * n :]), np.uint8)
    out, at = [], 0
    for size in sizes:
        out.append(np.ascontiguousarray(raw[at : at + 4 * size].reshape(4, -1).T).view("<u4").ravel())
        at += 4 * size
    return out


def blocks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row for each block of texts, see ``BLOCKS``."""
    schema = arrow_schema(BLOCKS)

    def run(batches):
        own = aligner(a_path, b_path)
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = texts_of(batch)
            for a, b in slices(texts, BLOCK):
                stats, digests, bounds, held, times, pairs = own.block(texts[a:b])
                ids = pa.ListArray.from_arrays([0, b - a], batch.column("doc_id").slice(a, b - a))
                made = [[block], ids, [stats.tobytes()], [digests], [_packed(np.diff(bounds), held, times)], [pairs[0]], [pairs[1]]]
                yield pa.RecordBatch.from_arrays([c if c is ids else pa.array(c, f.type) for c, f in zip(made, schema, strict=True)], schema=schema)
                block += 1
        # the worker lives on, and what follows needs its memory
        own.clear()

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, BLOCKS)


def _summed(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """The documents of one block from its row and the counts of its pairs."""
    schema = arrow_schema(ALIGNED)
    if not left.num_rows:
        return schema.empty_table()
    row = left.select(["stats", "digests", "held"]).to_pydict()
    ids = left.column("doc_ids").combine_chunks().flatten()
    stats = np.frombuffer(row["stats"][0], np.int64).reshape(-1, 4)
    per, held, times = (x.astype(np.int64) for x in _unpacked(row["held"][0], 3))
    at = right.column("i").to_numpy()
    n, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    n[at] = right.column("n").to_numpy()
    best[at] = right.column("best").to_numpy()
    bounds = np.concatenate(([0], np.cumsum(per)))

    def by_text(values):
        total = np.concatenate(([0], np.cumsum(values)))
        return total[bounds[1:]] - total[bounds[:-1]]

    columns = [ids, *stats.T, by_text(best[held] * times), by_text(n[held] * times), row["digests"][0]]
    return pa.Table.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def aligned(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Null and empty texts, and texts that either vocabulary does not give back byte by byte, have no tokens: zeros and
    an empty digest. Each row is a document: repeated rows and ids count again, null ids too. Of pairs that
    tie for an A id's highest count all are best. Empty tables give no rows. Extra columns are ignored.
    """
    a_path = a_path or public_tokenizers.path("byte_bpe_50k.json")
    b_path = b_path or public_tokenizers.path("piece_bpe_32k.model")
    made = written(blocks(docs, a_path, b_path), "alignment-blocks")
    entries = made.select("block", F.posexplode(F.arrays_zip("pairs", "docs")).alias("i", "e")).select("block", "i", F.col("e.pairs").alias("pair"), F.col("e.docs").alias("docs"))
    counts = written(entries.groupBy("pair").agg(F.sum("docs").alias("n")), "alignment-counts")
    lead = F.shiftright("pair", BITS).alias("a")
    # one row for each id of A's vocabulary at most
    top = F.broadcast(counts.groupBy(lead).agg(F.max("n").alias("top")))
    judged = counts.select("pair", "n", lead).join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).cast("long").alias("best"))
    back = entries.join(judged, "pair").select(F.col("block").alias("of_block"), "i", "n", "best")
    return made.select("block", "doc_ids", "stats", "digests", "held").groupBy("block").cogroup(back.groupBy("of_block")).applyInArrow(_summed, ALIGNED)


def op12_dangling_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {"op12_dangling_suffix": op12_dangling_suffix}
