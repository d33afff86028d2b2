"""Sum-of-squares packing of token sequences, online, one packer for each task.

A document's full windows are cut off first; what is left of it goes to the fill level at which the sum of
the squared counts of partially filled windows grows least. The counts stand in a level array, the windows
of a level in a stack. The documents of a task come in the order of its rows, and nothing is shuffled:
sequences hold pieces of one task's documents, and their ids begin with the task's number.

Pieces may be cut anywhere, so no task has to pad: at its end the partially filled windows, fullest first,
are strung together and cut every ``LENGTH`` tokens, and the rest is cut into powers of two, which need no
padding. The same closes windows early where sizes do not fit together and over ``MOST_OPEN`` windows
would be held, which bounds a task's memory by them and its longest text.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from panelmill.llm.common import arrow_schema, slices, table, text_or_empty, texts_of

LENGTH = 2048
END_ID = 1
MOST_OPEN = 4096
WORD_TABLE_ROWS = 1_500_000
#: So many words are encoded as one text.
JOINED = 1000
_TAIL = b".,;:!?"
LONGEST_KEPT_WORD = 64
SLICE = 2_000_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Sequence ids of a task start at its number shifted by so many bits.
SEQUENCE_BITS = 40


class WordEncoder:
    """Ids of whole texts, as little-endian unsigned 32-bit integers.

    The vocabulary drops white space and no token spans it, nor does any normalisation reach across ASCII white
    space, so a text's ids are those of its words in order. A word's ids are kept in a table, which is
    cleared once it holds over ``WORD_TABLE_ROWS`` words, some 250 MB. Words that are only letters are one match of the
    vocabulary's pattern each, whose last token alone ends a word: many are encoded as one text and cut there.
    Punctuation after an ASCII letter is a match of its own. Capitals are looked up as small letters, but for texts
    with characters beyond U+00FF: a mark after a capital could compose with the small letter only.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        names = (self.library.id_to_token(i) for i in range(self.library.get_vocab_size()))
        self.is_last = np.array([name.endswith("</w>") for name in names])
        self.ids: dict[bytes, bytes] = {}

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: set[bytes]) -> None:
        known = self.ids
        plain, odd = [], []
        for word in words:
            (plain if word.isalpha() or word.decode().isalpha() else odd).append(word)
        for at in range(0, len(plain), JOINED):
            some = plain[at : at + JOINED]
            ids = np.array(self._encoded([b" ".join(some).decode()])[0], "<u4")
            ends = np.flatnonzero(self.is_last[ids]) + 1
            if len(ends) != len(some):  # a letter that normalisation takes apart
                odd += some
                continue
            raw, begin = ids.tobytes(), 0
            for word, end in zip(some, (4 * ends).tolist(), strict=True):
                known[word] = raw[begin:end]
                begin = end
        for at in range(0, len(odd), JOINED):
            some = odd[at : at + JOINED]
            for word, ids in zip(some, self._encoded([w.decode() for w in some]), strict=True):
                known[word] = np.array(ids, "<u4").tobytes()

    def encode_many(self, texts: list[str]) -> Iterator[bytes]:
        split = []
        for text in texts:
            raw = text.encode()
            try:
                text.encode("latin-1")
                raw = raw.lower()
            except UnicodeEncodeError:
                pass
            split.append(raw.split())
        if len(self.ids) > WORD_TABLE_ROWS:
            self.ids = {}
        known = self.ids
        new = set().union(*split).difference(known)
        tailed, bare = [], set()
        for word in new:
            core = word.rstrip(_TAIL)
            if len(core) < len(word) and core[-1:].isalpha():
                tailed.append((word, core, word[len(core) :]))
            else:
                bare.add(word)
        self._learn(bare | {w for _, *parts in tailed for w in parts if w not in known})
        for word, core, tail in tailed:
            known[word] = known[core] + known[tail]
        for words in split:
            yield b"".join(map(known.__getitem__, words))
        for word in new:
            if len(word) > LONGEST_KEPT_WORD:
                del known[word]


@functools.lru_cache(maxsize=1)
def encoder_of(path: str) -> WordEncoder:
    """One for each worker, whatever the number of its tasks."""
    return WordEncoder(path)


class Packer:
    """Windows of ``length`` tokens. A piece is (doc_id, start, ids, doc_tokens); ``rows`` collects finished
    ones as (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""

    def __init__(self, first_sequence: int = 0, length: int = LENGTH, most_open: int = MOST_OPEN):
        self.length, self.most_open = length, most_open
        self.next_sequence = first_sequence
        #: Partially filled windows by fill level; a full one counts no longer.
        self.levels = np.zeros(length + 1, np.int64)
        self.windows: dict[int, list[list[tuple]]] = {}
        self.open = 0
        self.rows: list[tuple] = []

    def level_for(self, size: int) -> int:
        """The level (0: a new window) that gives the least sum of squares; of equal ones the fullest."""
        room = self.length - size
        counts = self.levels
        grows = np.full(room + 1, np.iinfo(np.int64).max)
        # a window goes from h to h + size: (c[h]-1)^2 - c[h]^2 + (c[h+size]+1)^2 - c[h+size]^2
        here = np.flatnonzero(counts[1 : room + 1]) + 1
        grows[here] = 2 - 2 * counts[here] + 2 * counts[here + size]
        if counts[room]:
            grows[room] -= 1  # a full window is no longer counted
        grows[0] = 2 * counts[size] + 1
        return room - int(np.argmin(grows[::-1]))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total = len(ids) // 4
        whole = total - total % self.length
        for start in range(0, whole, self.length):
            self._finish([(doc_id, start, ids[4 * start : 4 * (start + self.length)], total)])
        size = total - whole
        if not size:
            return
        level = self.level_for(size)
        window = []
        if level:
            window = self.windows[level].pop()
            self.levels[level] -= 1
            self.open -= 1
        window.append((doc_id, whole, ids[4 * whole :], total))
        if level + size == self.length:
            self._finish(window)
            return
        self.windows.setdefault(level + size, []).append(window)
        self.levels[level + size] += 1
        self.open += 1
        if self.open > self.most_open:
            self._string(last=False)

    def _finish(self, window: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in window:
            self.rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), total, self.next_sequence, offset))
            offset += len(ids) // 4
        self.next_sequence += 1

    def _string(self, last: bool) -> None:
        """String the open windows together and cut them anew; the rest stays open unless it is the last."""
        waiting = [w for level in sorted(self.windows, reverse=True) for w in self.windows[level]]
        self.windows, self.open = {}, 0
        self.levels[:] = 0
        window, fill = [], 0
        for doc_id, start, ids, total in (p for w in waiting for p in w):
            while ids:
                part = ids[: 4 * (self.length - fill)]
                window.append((doc_id, start, part, total))
                fill += len(part) // 4
                start += len(part) // 4
                ids = ids[len(part) :]
                if fill == self.length:
                    self._finish(window)
                    window, fill = [], 0
        if not fill:
            return
        if not last:
            self.windows[fill] = [window]
            self.levels[fill] = self.open = 1
            return
        sizes = [1 << k for k in range(self.length.bit_length(), -1, -1) if fill >> k & 1]
        for size in sizes:
            cut, window = _split(window, size)
            self._finish(cut)

    def close(self) -> None:
        self._string(last=True)


def _split(window: list[tuple], size: int) -> tuple[list[tuple], list[tuple]]:
    """A window's first ``size`` tokens and the others."""
    head, tail = [], []
    for doc_id, start, ids, total in window:
        part, rest = ids[: 4 * size], ids[4 * size :]
        size -= len(part) // 4
        if part:
            head.append((doc_id, start, part, total))
        if rest:
            tail.append((doc_id, start + len(part) // 4, rest, total))
    return head, tail


def packed(docs: DataFrame, path: str | None = None, length: int = LENGTH, most_open: int = MOST_OPEN) -> DataFrame:
    """One row for each piece of ``docs`` (doc_id, text).

    A null text is empty and, as an empty text, holds its end id only. Ids are handed on as they are, null and
    repeated ones too; each row is a document of its own. Every sequence is full or a power of two long. Empty
    tables give no rows. Extra columns are ignored. Which documents share a sequence depends on how the rows
    lie in partitions, so read them from a table: a task that is run again then packs the same rows alike.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")
    schema = arrow_schema(PIECES)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches):
        encoder = encoder_of(path)
        packer = Packer(TaskContext.get().partitionId() << SEQUENCE_BITS, length, most_open)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            texts, ids = texts_of(batch), batch.column("doc_id").to_pylist()
            for a, b in slices(texts, SLICE):
                for doc_id, made in zip(ids[a:b], encoder.encode_many(texts[a:b]), strict=True):
                    packer.add(doc_id, made + end)
                if packer.rows:
                    yield batch_of(packer.rows)
                    packer.rows = []
        packer.close()
        if packer.rows:
            yield batch_of(packer.rows)

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, PIECES)


def op11_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {"op11_sum_of_squares": op11_sum_of_squares}
