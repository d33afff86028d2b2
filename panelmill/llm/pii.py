"""Personal data: base patterns, and spans that a character BiLSTM-CRF adds.

The network reads character classes of overlapping windows over the whole text. It is trained in numpy
from labelled spans that a seeded generator writes into invented prose. Windows are decoded by CRF
Viterbi and reconciled for the whole text: each window decides for its middle only, adjoining pieces
join, base spans stay as they are, and a decoded span that meets one or lacks its kind's digits goes.
"""

from __future__ import annotations

import bisect
import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from panelmill.llm import bilstm
from panelmill.llm.common import hits_sql, map_batches, sha_hex, slices, span_digest, table, text_or_empty, texts_of

KINDS = {"email": 0, "ip": 1, "card": 2, "phone": 3}
TAGS = 5  # outside, then the kinds
HIDDEN = 8
WINDOW = 512
MARGIN = 24
BATCH = 1024
SLICE = 1_500_000
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the four fixed patterns, leftmost and non-overlapping by kind, in linear time."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
        # what stands before this @ can hold no later match's start
        done = m.end() if m else at + 1
        at = text.find("@", done)
    if not _DIGITS.search(text):
        return out
    for m in _DOTTED.finditer(text):
        parts = m[0].split(".")
        pos = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append(("ip", pos, pos + size))
            pos += size + 1
    for m in _CARD.finditer(text):
        if 12 <= m.end() - m.start() and 12 <= len(digits := re.sub(r"[\x20-]", "", m[0])) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def _class_table() -> np.ndarray:
    """Class of each byte of a latin-1 encoded text: 26 letters, capital, digit, some signs, rest."""
    out = np.zeros(256, np.uint8)
    out[33:128] = 1
    out[97:123] = np.arange(2, 28)
    out[65:91] = 28
    out[48:58] = 29
    for i, c in enumerate("@.-+()[]_%:/,#*|"):
        out[ord(c)] = 30 + i
    out[9:14] = 46
    out[32] = 47
    out[128:] = 48
    return out


_CLASSES = _class_table()
N_CLASSES = 49


def classes(text: str) -> np.ndarray:
    """One class for each code point; what latin-1 lacks counts as a sign."""
    return _CLASSES[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]


_PARTS = "er an th in on re at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur que ción eux keit".split()


def _word(rng) -> str:
    w = "".join(_PARTS[int(k)] for k in rng.integers(0, len(_PARTS), rng.integers(1, 5)))
    return w.capitalize() if rng.random() < 0.15 else w


def _digits(rng, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _value(rng) -> tuple[int, str]:
    """(tag, text) of one personal value in one of many spellings."""
    kind = int(rng.integers(1, 5))
    pick = rng.random()
    if kind == 1:
        name = _word(rng).lower() + ("." + _digits(rng, 2) if pick < 0.4 else "_" + _word(rng).lower() if pick < 0.6 else "")
        host = _word(rng).lower() + (_digits(rng, 1) if rng.random() < 0.5 else "")
        dot, top = ".", ("com", "org", "net", "de", "fr")[int(rng.integers(0, 5))]
        at = "@"
        if rng.random() < 0.35:
            at, dot = ((" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" @ ", "."))[int(rng.integers(0, 4))]
        return 1, name + at + host + (dot + "example" if rng.random() < 0.5 else "") + dot + top
    if kind == 2:
        sep = "." if pick < 0.7 else " . " if pick < 0.85 else "[.]"
        return 2, sep.join(str(int(x)) for x in rng.integers(0, 256, 4))
    if kind == 3:
        d = _digits(rng, 16)
        sep = "" if pick < 0.5 else "-" if pick < 0.7 else " " if pick < 0.85 else "."
        return 3, sep.join(d[i : i + 4] for i in range(0, 16, 4))
    a, b, c = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
    shapes = (f"+1 ({a}) {b}-{c}", f"+{a[:2]} {b} {c}{a[0]}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+1.{a}.{b}.{c}", f"+1-{a}-{b}-{c}", f"{a} {b} {c}")
    return 4, shapes[int(rng.integers(0, len(shapes)))]


def _noise(rng) -> str:
    """Texts with digits or signs that are no personal data."""
    k = int(rng.integers(0, 11))
    return (
        str(rng.integers(1900, 2030)),
        f"{rng.integers(1, 13)}/{rng.integers(1, 29)}/{rng.integers(1990, 2030)}",
        f"{rng.integers(0, 9)}.{rng.integers(0, 99)}",
        f"{rng.integers(0, 9)}.{rng.integers(0, 99)}.{rng.integers(0, 9)}",
        f"{rng.integers(0, 24)}:{rng.integers(10, 60)}",
        "$" + str(rng.integers(1, 9999)),
        "".join("0123456789abcdef"[int(i)] for i in rng.integers(0, 16, 40)),
        'token = "' + "".join("0123456789abcdef"[int(i)] for i in rng.integers(0, 16, 20)) + '"',
        "AKIA" + "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"[int(i)] for i in rng.integers(0, 32, 16)),
        ("%%%", "***", "###", "&&&", "$$$", "!!", "|", "-", "(c)", "@")[int(rng.integers(0, 10))],
        _digits(rng, int(rng.integers(1, 7))),
    )[k]


def labelled_windows(n: int, length: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(classes, tags), both (length, n): invented prose with labelled spans."""
    rng = np.random.default_rng(seed)
    xs, ys = np.zeros((length, n), np.uint8), np.zeros((length, n), np.int64)
    for b in range(n):
        text, tags = "", []
        while len(text) < length + 40:
            r = rng.random()
            tag, piece = _value(rng) if r < 0.13 else (0, _noise(rng)) if r < 0.28 else (0, _word(rng))
            tail = (" ", " ", " ", " ", ", ", ". ", "\n", "%%% ", "!! ", " | ", "; ")[int(rng.integers(0, 11))]
            text += piece + tail
            tags += [tag] * len(piece) + [0] * len(tail)
        at = int(rng.integers(0, 40))
        xs[:, b], ys[:, b] = classes(text)[at : at + length], tags[at : at + length]
    return xs, ys


@functools.lru_cache(maxsize=1)
def trained(steps: int = 160, batch: int = 128, length: int = 72) -> dict[str, np.ndarray]:
    """Parameters after Adam steps on the CRF likelihood; the same on every run."""
    rng = np.random.default_rng(5)
    p = bilstm.new_params(rng, N_CLASSES, HIDDEN, TAGS)
    xs, ys = labelled_windows(steps * batch // 4, length)
    adam = bilstm.Adam(p)
    index = bilstm.reversal(np.full(batch, length), length)
    for step in range(steps):
        some = rng.integers(0, xs.shape[1], batch)
        x, y = xs[:, some], ys[:, some]
        zf = p["wf"][:, x].transpose(1, 0, 2) + p["wf"][:, -1][None, :, None]
        zb = p["wb"][:, x[::-1]].transpose(1, 0, 2) + p["wb"][:, -1][None, :, None]
        e, kept = bilstm.emissions(p, zf, zb, index)
        _, de, dt = bilstm.crf_gradients(e, p["trans"], y)
        g, dzf, dzb = bilstm.emission_grads(p, de, kept, index)
        g["trans"] = dt
        for d, dz, codes in (("wf", dzf, x), ("wb", dzb, x[::-1])):
            grad = np.zeros_like(p[d].T)
            np.add.at(grad, codes.ravel(), dz.transpose(0, 2, 1).reshape(-1, 4 * HIDDEN))
            grad[-1] = dz.sum((0, 2))
            g[d] = grad.T
        adam.update(g, 0.03 if step < steps * 0.6 else 0.01)
    return p


class Tagger:
    """Batched window decoding with preallocated buffers."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p
        self.tables = {d: np.ascontiguousarray((p["w" + d][:, :N_CLASSES] + p["w" + d][:, -1:]).astype(np.float32)) for d in "fb"}
        t = p["trans"]
        # no path that leaves tag 0 can win while these margins hold at every position
        self.stay = np.maximum(np.diag(t) - t[0, 0], 0)
        self.loop = float((t[0, 1:, None] + t[None, 1:, 0] - 2 * t[0, 0]).max())
        cross = t[1:, 1:] - np.minimum(np.diag(t)[1:, None], np.diag(t)[None, 1:])
        self.simple = bool((cross - np.diag(np.diag(cross)) <= 0).all())

    def run(self, codes: np.ndarray, live: np.ndarray, d: str) -> np.ndarray:
        """Emission part (T, tags, B) of one direction; live[t] sequences, the longest first, go on at t."""
        h, table_, u, o = HIDDEN, self.tables[d], self.p["u" + d], self.p["o" + d]
        b = codes.shape[1]
        out = np.zeros((len(codes), TAGS, b), np.float32)
        z, add = np.empty((4 * h, b), np.float32), np.empty((4 * h, b), np.float32)
        state, cell, tmp = np.zeros((h, b), np.float32), np.zeros((h, b), np.float32), np.empty((h, b), np.float32)
        last = b
        for t in range(len(codes)):
            n = int(live[t])
            if n != last:
                z, add, tmp = np.empty((4 * h, n), np.float32), np.empty((4 * h, n), np.float32), np.empty((h, n), np.float32)
                state, cell, last = np.ascontiguousarray(state[:, :n]), np.ascontiguousarray(cell[:, :n]), n
            np.take(table_, codes[t, :n], axis=1, out=z, mode="clip")
            np.matmul(u, state, out=add)
            z += add
            bilstm.squash(z, h, add)
            np.multiply(z[:h], z[3 * h :], out=tmp)
            cell *= z[h : 2 * h]
            cell += tmp
            bilstm.soft(cell, tmp, state)
            np.multiply(z[2 * h : 3 * h], tmp, out=state)
            out[t, :, :n] = o @ state
        return out

    def paths(self, windows: list[np.ndarray]) -> list[np.ndarray | None]:
        """Tags of each window, None where all are outside."""
        order = sorted(range(len(windows)), key=lambda i: -len(windows[i]))
        found: list[np.ndarray | None] = [None] * len(windows)
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            lengths = np.array([len(windows[i]) for i in some])
            t = int(lengths[0])
            fwd, rev = np.zeros((len(some), t), np.uint8), np.zeros((len(some), t), np.uint8)
            for k, i in enumerate(some):
                fwd[k, : lengths[k]], rev[k, : lengths[k]] = windows[i], windows[i][::-1]
            live = (lengths[None, :] > np.arange(t)[:, None]).sum(1)
            ahead = self.run(np.ascontiguousarray(fwd.T), live, "f")
            behind = self.run(np.ascontiguousarray(rev.T), live, "b")
            ahead += self.p["bias"][None, :, None]
            index = bilstm.reversal(lengths, t)
            ahead += np.take_along_axis(behind, index[:, None, :], axis=0)
            margin = (ahead[:, 1:] - ahead[:, :1] + self.stay[None, 1:, None]).max(axis=(1,))
            margin[np.arange(t)[:, None] >= lengths[None, :]] = -1
            if self.simple and self.loop <= 0:
                open_ = np.flatnonzero(margin.max(axis=0) > 0)
            else:
                open_ = np.arange(len(some))
            if len(open_):
                path = bilstm.viterbi(ahead[:, :, open_], self.p["trans"], lengths[open_])
                for k, j in enumerate(open_.tolist()):
                    found[some[j]] = path[: lengths[j], k]
        return found

    def tags(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(tag, start, end) runs of every text, decided by the middle of each window."""
        windows, where = [], []
        for i, text in enumerate(texts):
            codes = classes(text)
            for a in range(0, max(len(codes) - 2 * MARGIN, 1), WINDOW - 2 * MARGIN):
                piece = codes[a : a + WINDOW]
                if len(piece):
                    windows.append(piece)
                    where.append((i, a, a + WINDOW >= len(codes)))
        runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for (i, a, ends), path in zip(where, self.paths(windows), strict=True):
            if path is None:
                continue
            low, high = (0 if a == 0 else MARGIN), (len(path) if ends else len(path) - MARGIN)
            path = path[low:high]
            edges = np.flatnonzero(np.diff(path)) + 1
            bounds = [0, *edges.tolist(), len(path)]
            for s, e in zip(bounds, bounds[1:], strict=False):
                if e > s and path[s]:
                    if runs[i] and runs[i][-1][0] == path[s] and runs[i][-1][2] == a + low + s:
                        runs[i][-1] = (int(path[s]), runs[i][-1][1], a + low + e)
                    else:
                        runs[i].append((int(path[s]), a + low + s, a + low + e))
        return runs


_NAMES = ("", *KINDS)
_AT = re.compile(r"@|[\[( ]at[\]) ]")


def plausible(kind: str, value: str) -> bool:
    """Whether a decoded value has what its kind needs."""
    digits = sum("0" <= c <= "9" for c in value)
    if kind == "email":
        return len(value) >= 7 and len(_AT.findall(value)) == 1 and bool(re.search(r"\.|[\[( ]dot[\]) ]", value))
    if kind == "ip":
        parts = re.findall(r"[0-9]+", value)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) and not _LETTERS.search(value)
    if kind == "card":
        return 13 <= digits <= 19 and luhn(re.sub(r"[^0-9]", "", value)) and not _LETTERS.search(value)
    return 10 <= digits <= 15 and not _LETTERS.search(value)


_LETTERS = re.compile(r"[^\W\d_]")


def reconciled(text: str, runs: list[tuple[int, int, int]]) -> tuple[list, list]:
    """(base spans, all spans): decoded runs, in order and apart, are trimmed, checked, and give way to base spans."""
    base = base_spans(text)
    spans = list(base)
    starts, ends = [], []  # of the base spans' union, in order
    for _, a, b in sorted(base, key=lambda x: x[1]):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    for tag, s, e in runs:
        while s < e and not (text[s].isalnum() or text[s] in "+(["):
            s += 1
        while e > s and not (text[e - 1].isalnum() or text[e - 1] in ")]"):
            e -= 1
        whole = (s == 0 or not text[s - 1].isalnum()) and (e == len(text) or not text[e].isalnum())
        if whole and e > s:
            k = bisect.bisect_left(starts, e)
            if (k == 0 or ends[k - 1] <= s) and plausible(_NAMES[tag], text[s:e]):
                spans.append((_NAMES[tag], s, e))
    return base, spans


def _found(texts: list[str], tagger: Tagger):
    for a, b in slices(texts, SLICE):
        for text, runs in zip(texts[a:b], tagger.tags(texts[a:b]), strict=True):
            yield reconciled(text, runs)


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, their digest and all spans, one row for each row of ``docs``.

    Null and empty texts have no spans; a null doc_id stays null. Repeated rows give repeated results;
    extra columns are ignored.
    """
    params = trained()

    def run(batch, tagger):
        rows = []
        for base, spans in _found(texts_of(batch), tagger):
            counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
            rows.append((*counts, sha_hex(span_digest(base, KINDS).encode()), span_digest(spans, KINDS)))
        yield batch.column("doc_id"), *(zip(*rows, strict=True) if rows else [()] * 6)

    return map_batches(docs.select("doc_id", text_or_empty().alias("text")), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", lambda: Tagger(params))


def masked(docs: DataFrame) -> DataFrame:
    """``docs``, all columns kept, with each span of ``text`` replaced by its kind in angle brackets.

    Overlapping spans are masked together under the first one's kind; ``n_chars``, if there, is
    counted anew for changed texts. Null texts, and all other columns, stay as they are.
    """
    params = trained()

    def run(batches):
        tagger = Tagger(params)
        for batch in batches:
            texts, out = texts_of(batch), batch.column("text").to_pylist()
            sizes = batch.column("n_chars").to_pylist() if "n_chars" in batch.schema.names else None
            for i, (_, spans) in enumerate(_found(texts, tagger)):
                if not spans:
                    continue
                pieces, at = [], 0
                for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
                    if s >= at:
                        pieces += [texts[i][at:s], f"<{kind}>"]
                    at = max(at, e)
                out[i] = "".join(pieces) + texts[i][at:]
                if sizes:
                    sizes[i] = len(out[i])
            new = {"text": out} | ({"n_chars": sizes} if sizes else {})
            columns = [pa.array(new[f.name], f.type) if f.name in new else batch.column(k) for k, f in enumerate(batch.schema)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def op2_bilstm_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {"op2_bilstm_crf": op2_bilstm_crf}

_LUHN = "list_sum(list_transform(range(0, length(digits)), lambda i: CAST(substr(digits, length(digits) - i, 1) AS INT) * (1 + i % 2) - 9 * CAST(CAST(substr(digits, length(digits) - i, 1) AS INT) * (1 + i % 2) > 9 AS INT))) % 10 = 0"
# The base spans, which are all spans on tables where the network adds none, as on those of the tests.
ORACLE_SQL = {
    "op2_bilstm_crf": rf"""
WITH hits AS (
    {hits_sql("email", 0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")}
    UNION ALL {hits_sql("ip", 1, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")}
    UNION ALL {hits_sql("card", 2, r"[0-9]([\x20-]?[0-9])+")}
    UNION ALL {hits_sql("phone", 3, r"\+[0-9][\x20().0-9-]+[0-9]")}),
counted AS (SELECT *, regexp_replace(hit, '[^0-9]', '', 'g') AS digits FROM hits WHERE i > 1),
found AS (SELECT doc_id, kind, rank, start, start + length(hit) AS stop FROM counted WHERE CASE kind WHEN 'email' THEN true
    WHEN 'ip' THEN len(list_filter(string_split(hit, '.'), lambda p: length(ltrim(p, '0')) > 3 OR TRY_CAST(p AS DOUBLE) > 255)) = 0
    WHEN 'card' THEN length(digits) BETWEEN 12 AND 19 AND {_LUHN} ELSE length(digits) BETWEEN 9 AND 15 END),
per AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in KINDS)}, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM found GROUP BY doc_id)
SELECT doc_id, {", ".join(f"CAST(coalesce(n_{k}, 0) AS BIGINT) AS n_{k}" for k in KINDS)}, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN per USING (doc_id)""",
}
