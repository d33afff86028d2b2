"""Packing, cross-tokenizer alignment and spelling variants against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import frames
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from panelmill.llm import alignment, packing, spelling

ODD = [
    (910_001, "two  spaces and   three, a tab\tand\n new lines \n\n x  "),
    (910_002, "  leading blanks; ﬁ ligature é café   nbsp　wide   em"),
    (910_003, "literal <|endoftext|> and <|startoftext|> and <s> </s> <unk> <0x41> end"),
    (910_004, "a▁b holds the piece mark"),
    (910_005, "᠎ mongolian ᠎ x᠎ y ​ zero ﻿ mark \x1c fs \x85 nel"),
    (910_006, "ΟΔΟΣ ΣΑΣ İstanbul ǅ ß 'S 'LL we'RE 12345 ½ ²"),
    (910_007, "\U0001f469‍\U0001f469‍\U0001f467 \U0001f600\U0001f600 日本語のテキスト"),
    (910_008, " "),
    (910_009, "x" * 3000 + " " + "y " * 2100),
]


# --- packing ---------------------------------------------------------------------------------------------------


def by_library(path, texts):
    t = Tokenizer.from_file(path)
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for x in texts]


@pytest.mark.parametrize("most_open", [4096, 3])
def test_pieces_tile_documents_and_sequences(spark, most_open):
    df, rows = frames.awkward(spark, frames.sample_texts(120) + ODD)
    pieces = packing.packed(df.repartition(3), most_open=most_open).collect()
    whole = Counter((i, ids.tobytes()) for (i, _), ids in zip(rows, by_library(public_tokenizers.path("word_bpe_49k.json"), [t for _, t in rows]), strict=True))
    unused = Counter()
    for (doc_id, ids), times in whole.items():
        unused[doc_id, len(ids) // 4] += times
    of = defaultdict(list)
    for p in pieces:
        of[p.sequence_id].append(p)
    for parts in of.values():
        parts.sort(key=lambda p: p.offset)
        assert [p.offset for p in parts] == [0, *itertools.accumulate(p.length for p in parts)][:-1]
        total = sum(p.length for p in parts)
        assert total == 2048 or (total & (total - 1)) == 0  # no padding at all
        assert total <= 2048
    # every id of every document lies in exactly one piece; rows that repeat are documents of their own
    unique = {i: np.frombuffer(ids, "<u4") for (i, ids), n in whole.items() if n == 1 and sum(k[0] == i for k in whole) == 1}
    for doc_id, ids in unique.items():
        own = sorted((p for p in pieces if p.doc_id == doc_id), key=lambda p: p.start)
        assert [p.start for p in own] == [0, *itertools.accumulate(p.length for p in own)][:-1]
        assert sum(p.length for p in own) == len(ids)
        assert all(p.doc_tokens == len(ids) for p in own)
        for p in own:
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    assert sum(p.length for p in pieces) == sum(n * len(ids) // 4 for (_, ids), n in whole.items())
    assert Counter({k: n for k, n in unused.items()}) == Counter({k: v // k[1] for k, v in _lengths(pieces).items()})


def _lengths(pieces):
    out = Counter()
    for p in pieces:
        out[p.doc_id, p.doc_tokens] += p.length
    return out


def test_word_table_equals_library_on_whole_texts(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [t or "" for _, t in frames.sample_texts(200) + ODD]
    rnd = random.Random(3)
    letters = "ab'sS \t\n\x0b\x1c\x85 éÉéΣσ <|>12½😀日­"
    texts += ["".join(rnd.choices(letters, k=rnd.randrange(60))) for _ in range(400)]
    want = [ids[:-1].tobytes() for ids in by_library(path, texts)]
    encoder = packing.WordEncoder(path)
    assert list(encoder.encode_many(texts)) == want
    monkeypatch.setattr(packing, "WORD_TABLE_ROWS", 5)
    assert [x for t in texts for x in encoder.encode_many([t])] == want


def test_level_is_the_one_of_the_least_sum_of_squares():
    rnd = random.Random(7)
    packer = packing.Packer(length=16)
    levels: Counter = Counter()
    for k in range(600):
        size = rnd.choice((3, 5, 6, 7, 11, 15))

        def squares(level, size=size):
            after = Counter(levels)
            after[level] -= bool(level)
            after[level + size] += 1
            return sum(n * n for h, n in after.items() if 0 < h < 16)

        fits = [0, *(h for h in range(1, 17 - size) if levels[h])]
        best = max((h for h in fits if squares(h) == min(map(squares, fits))))
        assert packer.level_for(size) == best
        packer.add(k, np.arange(size, dtype="<u4").tobytes())
        levels[best] -= bool(best)
        levels[best + size] += best + size < 16
        assert [packer.levels[h] for h in range(1, 16)] == [levels[h] for h in range(1, 16)]
    before = len(packer.rows)
    packer.close()
    assert before > 400 and sum(r[2] for r in packer.rows) == sum(r[4] for r in {r[0]: r for r in packer.rows}.values())


def test_packing_of_an_empty_table(spark):
    assert packing.packed(frames.empty(spark)).count() == 0


# --- alignment -------------------------------------------------------------------------------------------------


def aligned_by_offsets(texts):
    """(n_a, n_b, groups string, links) of whole texts by byte offsets."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = alignment.byte_letters()
    out = []
    for t in texts:
        x = a.encode(" " + t, add_special_tokens=False).ids if t else []
        y = b.encode(t) if t else []
        xs = [bytes(letters[c] for c in a.id_to_token(i)) for i in x]
        ys = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, y)]
        if not t or b"".join(xs) != (" " + t).encode() or b"".join(ys) != (" " + t).encode():
            out.append((0, 0, "", []))
            continue
        ex, ey = list(itertools.accumulate(map(len, xs))), list(itertools.accumulate(map(len, ys)))
        cuts = sorted(set(ex) & set(ey))
        groups, lo = [], 0
        for hi in cuts:
            groups.append(",".join(str(i) for i, e in zip(x, ex, strict=True) if lo < e <= hi) + "|" + ",".join(str(i) for i, e in zip(y, ey, strict=True) if lo < e <= hi))
            lo = hi
        links, j = [], 0
        for i in range(len(x)):
            while j < len(y) and ey[j] <= ex[i] - len(xs[i]):
                j += 1
            k = j
            while k < len(y) and ey[k] - len(ys[k]) < ex[i]:
                links.append((x[i], y[k]))
                k += 1
        out.append((len(x), len(y), ";".join(groups), links))
    return out


def want_alignment(rows):
    made = aligned_by_offsets([t or "" for _, t in rows])
    count = Counter(p for *_, links in made for p in set(links))
    top: dict = {}
    for (x, _), n in count.items():
        top[x] = max(top.get(x, 0), n)
    return Counter(
        (i, na, nb, g.count("|") if na else 0, len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if na else "")
        for (i, _), (na, nb, g, links) in zip(rows, made, strict=True)
    )


@pytest.mark.parametrize(("block", "kept"), [(6_000_000, 150_000), (4_000, 40)])
def test_alignment_equals_byte_offsets(spark, monkeypatch, block, kept):
    df, rows = frames.awkward(spark, frames.sample_texts(60)[:40] + ODD[:-1])
    monkeypatch.setattr(alignment, "BLOCK", block)
    monkeypatch.setattr(alignment, "UNIT_TABLE_ROWS", kept)
    rows = [(i, t) for i, t in rows if t is None or len(t) < 20_000]
    df = df.where("text IS NULL OR length(text) < 20000")
    got = Counter(tuple(r) for r in alignment.aligned(df.repartition(3)).select(*[c.split()[0] for c in alignment.ALIGNED.split(", ")]).collect())
    assert got == want_alignment(rows)


def test_transducer_on_ambiguous_bytes():
    a = [b"a", b"ab", b"b", b"aab", b"c"]
    b = [b"a", b"b", b"ba", b"abc", b"c"]
    machine = alignment.Transducer(a, b)
    rnd = random.Random(2)
    for _ in range(300):
        x = [rnd.randrange(5) for _ in range(rnd.randrange(1, 8))]
        text = b"".join(a[i] for i in x)
        y, rest = [], text
        while rest and (fit := [i for i, t in enumerate(b) if rest.startswith(t)]):
            y.append(rnd.choice(fit))
            rest = rest[len(b[y[-1]]) :]
        if rest:
            continue
        ex, ey = (list(itertools.accumulate(len(v[i]) for i in ids)) for v, ids in ((a, x), (b, y)))
        groups, links = machine.align(x, y)
        assert len(groups) == len(set(ex) & set(ey))
        assert [[int(i) for g in groups for i in g.split("|")[s].split(",")] for s in (0, 1)] == [x, y]
        overlap = [(x[i], y[j]) for i in range(len(x)) for j in range(len(y)) if max(ex[i] - len(a[x[i]]), ey[j] - len(b[y[j]])) < min(ex[i], ey[j])]
        assert Counter(divmod(c, 1 << alignment.BITS) for c in links) == Counter(overlap)
    assert machine.align([0], [1]) is None
    assert machine.align([0], []) is None
    assert machine.align([], [0]) is None
    assert machine.align([], []) == ([], [])


def test_units_are_learnt_in_parts_and_forgotten_after_a_task(spark, monkeypatch):
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    texts = [t or "" for _, t in frames.sample_texts(20)]
    whole = alignment.Aligner(*paths).block(texts)
    own, parts = alignment.Aligner(*paths), []
    monkeypatch.setattr(alignment, "LEARNT", 50)
    learn = own._learn
    monkeypatch.setattr(own, "_learn", lambda new: parts.append(len(new)) or learn(new))
    for got, want in zip(own.block(texts), whole, strict=True):
        assert np.array_equal(got, want)
    assert max(parts) == 50 and sum(parts) == len(own.units)

    def kept(batches):
        for _ in batches:
            yield pd.DataFrame({"n": [len(alignment.aligner(*paths).units)]})

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert alignment.aligned(df).count() == len(texts)
    assert spark.range(4).repartition(4).mapInPandas(kept, "n long").agg({"n": "max"}).first()[0] == 0


def test_alignment_of_an_empty_table(spark):
    assert alignment.aligned(frames.empty(spark)).count() == 0


# --- spelling --------------------------------------------------------------------------------------------------

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def want_variants(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate(AZ)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    near = {w: [v for v in n if one_edit(v, w)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def variant_rows():
    """Texts with chains of forms, ties, accents, letters that are signs, and a very long word."""
    words = {"planets": 500, "planet": 60, "planete": 60, "plamet": 12, "pLAMETS": 90, "élèves": 40, "élève×": 5, "eleves": 9, "ÉLÈVES": 7, "aaaaaa": 30, "aaaaaaa": 6, "aaaaaaaa": 5, "abcdefg" * 300: 5, "abcdefg" * 300 + "h": 26, "gathers": 25, "fathers": 25, "lathers": 5}
    text = " ".join(w for w, k in words.items() for _ in range(k))
    rnd = random.Random(5)
    base = ["".join(rnd.choices("abz", k=rnd.choice((6, 7, 8)))) for _ in range(120)]
    many = " ".join(w for w in base for _ in range(rnd.choice((5, 6, 30, 200))))
    return [(930_000, text), (930_001, many), (None, many), (-3, "planets' planets-planets_planets2planets")]


@pytest.mark.parametrize("bucket", [4096, 3])
def test_variants_equal_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(spelling, "BUCKET", bucket)
    df, rows = frames.awkward(spark, frames.sample_texts(40) + variant_rows())
    got = [tuple(r) for r in spelling.variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got))
    assert set(got) == want_variants(rows)
    chains = {w: (f, r) for w, f, r, *_ in got}
    assert any(f and f != r for f, r in chains.values())


def test_prefixes_of_near_words_meet():
    """The filter's claim by brute force: the three rarest positional bigrams of two near words share one, at an
    allowed place."""
    rnd = random.Random(11)
    words = list({"".join(rnd.choices("abcdé", k=rnd.randrange(6, 12))) for _ in range(300)})
    words += [w[:k] + rnd.choice("abcdé") + w[k + rnd.randrange(2) :] for w in words for k in [rnd.randrange(len(w))]]
    words = [w for w in dict.fromkeys(words) if len(w) >= 6]
    often = Counter(w[i : i + 2] for w in words for i in range(len(w) - 1))
    rare = {w: [g[1:] for g in sorted((often[w[i : i + 2]], w[i : i + 2], i) for i in range(len(w) - 1))[:3]] for w in words}
    met = 0
    for a, b in itertools.combinations(words, 2):
        if one_edit(a, b):
            short, long = sorted((a, b), key=len)
            steps = (0,) if len(a) == len(b) else (0, 1)
            assert any(g == h and q - p in steps for g, p in rare[short] for h, q in rare[long])
            met += 1
    assert met > 200


def test_variants_of_an_empty_table(spark):
    assert spelling.variants(frames.empty(spark)).count() == 0
