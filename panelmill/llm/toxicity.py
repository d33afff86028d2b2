"""Toxicity by noisy-channel deobfuscation and word evidence.

Writers hide words by leetspeak, spacing, separators and repeated letters. Each token that is not plain
letters (or run of single letters) becomes a lattice: every character offers the letters it may stand for,
with a channel cost, separators may vanish, and a long run of one letter may shrink. Viterbi decoding under
a character trigram model picks the restored word. Repeated letters of the outcome are read both once and
twice, and a run of single letters also without its first or last one, and cut where its gaps are wider or
where the model puts a word boundary. The model's counts are taken over all documents, in
one pass that adds 27^3 cells, whatever the input's size.

The score is a logistic function of the strongest word evidences (log odds of toxic against other
documents, by word, else by its first five or four letters). Evidence and calibration are learned
from at most ``MAX_TRAIN`` labelled rows, chosen by the hash of their id among rows that are not
held out.
"""

from __future__ import annotations

import functools
import itertools
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.llm.common import drop_since, made, map_batches, slices, table, text_or_empty, texts_of, written

MAX_TRAIN = 20_000
FOLDS = 5
LEAST_DOCS = 3
TOP = 3
SMOOTH = 0.5
WORD_TABLE_ROWS = 100_000
#: Letters that a character may stand for, with channel costs in nats.
CHANNEL = {
    "0": (("o", 1.0),),
    "1": (("i", 1.0), ("l", 1.5)),
    "2": (("z", 2.0),),
    "3": (("e", 1.0),),
    "4": (("a", 1.0),),
    "5": (("s", 1.0),),
    "6": (("g", 2.0), ("b", 2.5)),
    "7": (("t", 1.0),),
    "8": (("b", 1.5),),
    "9": (("g", 1.5),),
    "@": (("a", 0.7),),
    "$": (("s", 0.7),),
    "!": (("i", 0.9), ("", 2.0)),
    "|": (("l", 1.2), ("i", 1.4), ("", 2.0)),
    "+": (("t", 1.5), ("", 2.0)),
    "*": (("", 1.0), ("a", 2.5), ("e", 2.5), ("i", 2.5), ("o", 2.5), ("u", 2.5)),
}
_SEPARATOR_COST = 0.5
_SHRINK_COST = 0.5
_FOLD = np.zeros(256, np.int64)
_FOLD[97:123] = np.arange(1, 27)
_FOLD[65:91] = np.arange(1, 27)
#: What decoding may change: characters with a meaning anywhere, others but letters inside a token, runs of three.
_ODD = re.compile(r"[0-9@$!|+*]|[^\W\d_][\W_]+[^\W_]|(.)\1\1")
_TWICE = re.compile(r"([^\W\d_])\1+")
_MOST_TWICE = 8
_SPACED = re.compile(r"(?<!\S)\S(?:(?:[._*-]|\s+)\S){2,}(?!\S)")
_WIDE = re.compile(r"\s{2,}|\n")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves no remainder; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def trigram_counts(texts: list[str]) -> np.ndarray:
    """27^3 counts of letter trigrams; anything but A-Z is the boundary symbol."""
    data = np.frombuffer(b"\n\n" + "\n\n".join(texts).encode("utf-8", "surrogatepass") + b"\n", np.uint8)
    s = _FOLD[data]
    return np.bincount(s[:-2] * 729 + s[1:-1] * 27 + s[2:], minlength=27**3)


def character_model(docs: DataFrame) -> np.ndarray:
    """Log probabilities (27, 27, 27) from the trigrams of every text."""

    def run(batches):
        total = np.zeros(27**3, np.int64)
        for pdf in batches:
            texts = list(pdf["text"])
            for a, b in slices(texts, 500_000):
                total += trigram_counts(texts[a:b])
        cells = np.flatnonzero(total)
        yield pd.DataFrame({"cell": cells, "n": total[cells]})

    cells = docs.select(text_or_empty().alias("text")).mapInPandas(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.full(27**3, 0.1)
    counts[cells["cell"].to_numpy(int)] += cells["n"].to_numpy(float)
    counts = counts.reshape(27, 27, 27)
    return np.log(counts / counts.sum(axis=2, keepdims=True)).astype(np.float32)


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each step the strings it may emit, with costs."""
    out: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(token):
        c = token[i]
        j = i
        while j < len(token) and token[j] == c:
            j += 1
        if c.isalpha():
            n = j - i
            emit = [(c * n, 0.0)] if n < 3 else []
            if n >= 3:
                emit = [(c, _SHRINK_COST), (c * 2, _SHRINK_COST)]
            out.append(emit)
        else:
            choices = CHANNEL.get(c)
            for _ in range(j - i if choices and choices[0][0] else 1):
                out.append(list(choices) if choices else [("", _SEPARATOR_COST)])
        i = j
    return out


def restore(token: str, model: list) -> str:
    """The likeliest letters behind a token."""
    return decode(lattice(token), model)


def segment(parts: list[str], model: list) -> list[str]:
    """The likeliest words behind a run of single characters, any gap of which may be a word boundary."""
    steps = lattice(parts[0])
    for part in parts[1:]:
        steps += [[("", 0.0), (" ", 0.0)], *lattice(part)]
    return decode(steps, model).split()


def shrunk(word: str, model: list) -> set[str]:
    """The word with each run of one letter read once or twice: every choice up to ``_MOST_TWICE`` runs,
    beyond that once everywhere, or by the model."""
    runs = list(_TWICE.finditer(word))
    if not runs:
        return {word}
    if len(runs) == 1:
        a, b, c = word[: runs[0].start()], word[runs[0].end() :], runs[0][1]
        return {word, a + c + b, a + c + c + b}
    between = [word[a:b] for a, b in zip([0, *(m.end() for m in runs)], [*(m.start() for m in runs), len(word)], strict=True)]
    choices = [(m[1], m[1] * 2) for m in runs]
    if len(runs) > _MOST_TWICE:
        steps: list[list[tuple[str, float]]] = [[(c, 0.0)] for c in between[0]]
        for (one, two), rest in zip(choices, between[1:], strict=True):
            steps += [[(one, _SHRINK_COST), (two, 0.0)], *([(c, 0.0)] for c in rest)]
        return {word, "".join(x for pair in zip(between, [c for c, _ in choices] + [""], strict=True) for x in pair), decode(steps, model)}
    return {word} | {"".join(x for pair in zip(between, (*picked, ""), strict=True) for x in pair) for picked in itertools.product(*choices)}


def decode(steps: list[list[tuple[str, float]]], model: list) -> str:
    """Viterbi over a lattice, states are the last two symbols. A state keeps what it emitted last and the state before,
    so a step costs the same however long the text; of equal ends the first in alphabetical order counts."""
    beams: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for step in steps:
        nxt: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (cost, trail) in beams.items():
            for emit, price in step:
                x, y, total = a, b, cost + price
                for c in emit:
                    z = ord(c) - 96 if "a" <= c <= "z" else 0
                    total -= model[x][y][z]
                    x, y = y, z
                held = nxt.get((x, y))
                if held is None or total < held[0]:
                    nxt[x, y] = (total, (trail, emit) if emit else trail)
        beams = nxt
    ends = [(cost - model[a][b][0], trail) for (a, b), (cost, trail) in beams.items()]
    least = min(cost for cost, _ in ends)
    return min(_spelled(trail) for cost, trail in ends if cost == least)


def _spelled(trail: tuple | None) -> str:
    parts = []
    while trail is not None:
        trail, emit = trail
        parts.append(emit)
    return "".join(reversed(parts))


class Restorer:
    """Distinct restored words of texts; a worker remembers the tokens it has restored."""

    def __init__(self, model: np.ndarray):
        # nested lists are read faster than single cells of an array
        self.model = model.tolist()
        self.word = functools.lru_cache(maxsize=WORD_TABLE_ROWS)(self._word)

    def _word(self, token: str) -> tuple[str, ...]:
        if token.isalpha() and not _TWICE.search(token):
            return (token,)
        plain = _EDGE.sub("", token)
        if _ODD.search(token):
            out = {plain} | {restore(t, self.model) for t in {token, plain}}
        elif _TWICE.search(plain):
            out = {plain}
        else:
            return (plain,) if plain else ()
        return tuple(set().union(*(shrunk(w, self.model) for w in out)) - {""})

    def run(self, run: str) -> set[str]:
        """Words behind a run of single letters."""
        out = {"".join(r.split()) for r in _WIDE.split(run)}
        for gap in (r"[\s._-]+", r"[\s._*-]+") if "*" in run else (r"[\s._-]+",):
            if parts := [p for p in re.split(gap, run) if p]:
                out |= {"".join(p) for p in (parts, parts[1:], parts[:-1], parts[1:-1])} | set(segment(parts, self.model))
        return {w for token in out if token for w in self.word(token)}

    def words(self, text: str) -> set[str]:
        text = text.lower()
        out: set[str] = set()
        for token in set(text.split()):
            out.update(self.word(token))
        for run in set(_SPACED.findall(text)):
            out |= self.run(run)
        return out - {""}


def word_features(word: str) -> list[str]:
    return [f"w:{word}", *([f"5:{word[:5]}"] if len(word) >= 5 else []), *([f"4:{word[:4]}"] if len(word) >= 4 else [])]


class Scorer:
    """Scores texts by the strongest evidences of their restored words."""

    def __init__(self, model: np.ndarray, evidence: dict[str, float], weights: tuple[float, float, float]):
        self.restorer, self.evidence, self.weights = Restorer(model), evidence, weights
        self.of_token = functools.lru_cache(maxsize=WORD_TABLE_ROWS)(self._of_token)

    def of_word(self, word: str) -> float:
        # the order of word_features, made only as far as needed
        e = self.evidence.get("w:" + word)
        if e is None and len(word) >= 5:
            e = self.evidence.get("5:" + word[:5])
        if e is None and len(word) >= 4:
            e = self.evidence.get("4:" + word[:4])
        return 0.0 if e is None else e

    def _of_token(self, token: str) -> float:
        # of_token has its own memory
        return max(map(self.of_word, self.restorer._word(token)), default=0.0)

    def features(self, text: str) -> tuple[float, float]:
        text = text.lower()
        found = [e for e in map(self.of_token, set(text.split())) if e > 0]
        found += [e for run in set(_SPACED.findall(text)) if (e := max(map(self.of_word, self.restorer.run(run)), default=0.0)) > 0]
        top = sorted(found, reverse=True)[:TOP]
        return (top[0] if top else 0.0), sum(top)

    def score(self, text: str) -> float:
        first, total = self.features(text)
        z = self.weights[0] + self.weights[1] * first + self.weights[2] * total
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(toxic, part, text) of the bounded sample; part 0 calibrates, the others give evidence.

    Of labels that contradict each other toxic counts, of texts under one doc_id the least. Only ids whose
    hash lies below a threshold are sorted; it lets about a fifth more of them through than are taken.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = rows.count()
    place = F.xxhash64("doc_id")
    if n > 2 * MAX_TRAIN:
        rows = rows.where(place < int(-(2**63) + 2**64 * (1.2 * MAX_TRAIN / n)))
    chosen = rows.orderBy(place, "doc_id").limit(MAX_TRAIN)
    part = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4))
    # at most MAX_TRAIN rows of a few bytes
    texts = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    return texts.select((F.col("toxic") > 0).cast("int").alias("toxic"), part.alias("part"), "text")


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, dict[str, float], tuple[float, float, float]]:
    """Character model over all of ``docs``, evidence and calibration from the labelled sample."""
    spark = docs.sparkSession
    mark = made(spark)
    model = character_model(docs)
    rows = written(_training_rows(docs, labels), "toxicity-sample")

    def count(batches):
        restorer = Restorer(model)
        for pdf in batches:
            out: dict[tuple[str, int], int] = {}
            for text, toxic in zip(pdf["text"], pdf["toxic"], strict=True):
                for f in {f for w in restorer.words(text) for f in word_features(w)} | {"n:"}:
                    out[f, toxic] = out.get((f, toxic), 0) + 1
            yield pd.DataFrame([(f, n * (1 - t), n * t) for (f, t), n in out.items()], columns=["feature", "other", "toxic"])

    seen = rows.where("part != 0").mapInPandas(count, "feature string, other long, toxic long").groupBy("feature").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
    # bounded by the sample: features of at least LEAST_DOCS of its documents
    table_ = seen.where((F.col("other") + F.col("toxic") >= LEAST_DOCS) | (F.col("feature") == "n:")).toPandas()
    whole = table_[table_["feature"] == "n:"]
    n_other, n_toxic = (int(whole[c].sum()) if len(whole) else 0 for c in ("other", "toxic"))
    table_ = table_[table_["feature"] != "n:"]
    odds = np.log((table_["toxic"] + SMOOTH) / (n_toxic + 1)) - np.log((table_["other"] + SMOOTH) / (n_other + 1))
    evidence = dict(zip(table_["feature"], odds.astype(float), strict=True))

    def measure(batches):
        scorer = Scorer(model, evidence, (0.0, 0.0, 0.0))
        for pdf in batches:
            found = [scorer.features(t) for t in pdf["text"]]
            yield pd.DataFrame({"first": [f for f, _ in found], "total": [t for _, t in found], "toxic": pdf["toxic"]})

    measured = rows.where("part = 0").mapInPandas(measure, "first double, total double, toxic int").toPandas()
    drop_since(spark, mark)
    return model, evidence, calibrate(measured)


def calibrate(rows: pd.DataFrame) -> tuple[float, float, float]:
    """Logistic regression by Newton steps, with a ridge that also holds for separable or empty samples."""
    x = np.column_stack((np.ones(len(rows)), rows["first"], rows["total"])) if len(rows) else np.empty((0, 3))
    y = rows["toxic"].to_numpy(float) if len(rows) else np.empty(0)
    w = np.array([-3.0, 0.5, 0.3])
    prior, ridge = w.copy(), np.diag([0.05, 0.05, 0.05])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge @ (w - prior)
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(h, g)
        w = w - np.clip(step, -1, 1)
    return tuple(float(v) for v in w)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Null and empty texts score as texts without evidence. Null ids stay null and never meet a label.
    Repeated rows give repeated results; without labels the prior weights hold. Extra columns are ignored.
    """
    parts = train(docs, labels)

    def run(batch, own):
        score = np.fromiter(map(own.score, texts_of(batch)), float, len(batch))
        yield batch.column("doc_id"), batch.column("held_out"), score, (score >= 0.5).astype(np.int32)

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), text_or_empty().alias("text"))
    return map_batches(rows, run, "doc_id long, held_out boolean, score double, predicted int", lambda: Scorer(*parts))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns kept as they are, that score below 0.5. Every row is judged by its
    own text, whatever its id; null texts score as empty ones."""
    parts = train(docs, labels)

    def run(batches):
        own = Scorer(*parts)
        for batch in batches:
            yield batch.filter(pa.array([own.score(t) < 0.5 for t in texts_of(batch)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op10_noisy_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))


QUERIES = {"op10_noisy_channel": op10_noisy_channel}
