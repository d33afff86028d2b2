"""Operators of one text at a time against brute force, with the awkward cases."""

import base64
import hashlib
import itertools
import random
import re
import time
from collections import Counter

import frames
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from panelmill.llm import bilstm, bpe, common, pii, quality, secrets
from panelmill.llm.common import scratch_path
from panelmill.llm.wordhash import Words, rolling

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def docs(spark):
    return frames.awkward(spark, frames.sample_texts())


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_words_and_windows():
    texts = ["", " a  b\tc\n", "x" * 9000 + " y", "é ü é ü", "A b"]
    w = Words(texts, lower=True)
    split = [t.encode().lower().split() for t in texts]
    assert w.counts.tolist() == [len(s) for s in split]
    flat = [x for s in split for x in s]
    assert all((flat[i] == flat[j]) == (w.hashes[i] == w.hashes[j]) for i in range(len(flat)) for j in range(len(flat)))
    for width in (1, 2, 3, 7):
        r = rolling(np.array([1, 2, 1, 2, 1, 2, 1, 2, 1], np.uint64), width)
        assert len(r) == 10 - width and len(set(r.tolist())) == min(2, len(r))


def test_bpe_equals_the_library(spark, docs):
    df, rows = docs
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = Counter(map(tuple, bpe.digests(df).collect()))
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())))
    assert got == Counter(want)
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.tokens(df).collect()) == got
    assert bpe.digests(frames.empty(spark)).count() == 0


def test_bpe_random_strings():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd, letters = random.Random(5), "aaab bcd'sé\n\t 12345.!?xyzthe日本  🙂"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(3000)] + ["a" * 3000, " " * 999]
    out = list(bpe.Encoder(PATH).encode_many(texts))
    assert [np.frombuffer(p, "<u4").tolist() for p, _ in out] == [library.encode_ordinary(t) for t in texts]
    assert [d for _, d in out] == [t.encode() for t in texts]


def naive_secrets(text: str) -> list:
    assign = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [("assign", m.start(), m.end()) for m in assign.finditer(text) if len(m[1]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return out + [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]


def test_secrets_equal_brute_force_on_every_path(spark, docs):
    rnd = random.Random(3)
    made = [(910_000 + k, "".join(rnd.choice(["Token", "API_KEY", "pass", "wd", " = ", ":", '"', "AKIA", "ABCDEFGH01234567", "0123456789abcdef", "deadbeef99", " ", "ſecret=abcdefg"]) for _ in range(12))) for k in range(300)]
    df, rows = frames.awkward(spark, made)
    found = secrets.scan_history(df.select("doc_id", "text").withColumnRenamed("doc_id", "path"), scratch_path(spark, "ledger"))
    got = Counter((r.path, r.n_assign, r.n_access, r.n_hex, r.spans, r.base_sha256) for r in found.collect())
    order = {"assign": 0, "access": 1, "hex": 2}
    want = []
    for i, t in rows:
        s = sorted(naive_secrets(t or ""), key=lambda x: (x[1], order[x[0]]))
        d = ",".join(f"{k}:{a}:{b}" for k, a, b in s)
        want.append((i, *(sum(x[0] == k for x in s) for k in order), d, sha(d.encode())))
    assert got == Counter(want)
    assert secrets.scan_history(frames.empty(spark).withColumnRenamed("doc_id", "path"), scratch_path(spark, "ledger")).count() == 0


def test_ledger_scans_only_unseen_blobs(spark):
    ledger = scratch_path(spark, "ledger")
    rows = spark.createDataFrame([("a", "token = abcdef1"), ("b", "token = abcdef1"), ("c", "plain")], "path string, text string")
    secrets.scan_history(rows, ledger)
    assert secrets.read_ledger(spark, ledger).count() == 2
    assert secrets.update_ledger(rows, ledger)[0].count() == 0
    more = spark.createDataFrame([("d", "token = abcdef1"), ("e", "secret: zzzzzz9")], "path string, text string")
    found = secrets.scan_history(more, ledger)
    assert {r.path: r.n_assign for r in found.collect()} == {"d": 1, "e": 1}
    assert spark.read.parquet(ledger).count() == 3


def test_ledger_of_other_rules_is_not_trusted(spark):
    ledger = scratch_path(spark, "ledger")
    rows = spark.createDataFrame([("a", "token = abcdef1")], "path string, text string")
    secrets.scan_history(rows, ledger)
    old = scratch_path(spark, "ledger")
    secrets.read_ledger(spark, ledger).selectExpr("blob", "'older' AS rule_version", "0L AS n_assign", "n_access", "n_hex", "base_sha256", "'' AS spans").write.parquet(old)
    assert [r.n_assign for r in secrets.scan_history(rows, old).collect()] == [1]
    assert {r.rule_version for r in spark.read.parquet(old).collect()} == {"older", secrets.RULE_VERSION}


def test_versions_under_one_path(spark):
    rows = [("a", f"secret: value{k:04d}") for k in range(30)] + [("a", "secret: value0001"), ("b", "secret: value0002"), (None, "secret: value0003")]
    ledger = scratch_path(spark, "ledger")
    found = secrets.scan_history(spark.createDataFrame(rows, "path string, text string"), ledger)
    assert Counter(r.path for r in found.collect() if r.n_assign == 1) == Counter(p for p, _ in rows)
    assert spark.read.parquet(ledger).count() == 30


def test_query_reads_the_named_ledger(spark, sf):
    ledger = scratch_path(spark, "ledger")
    spark.conf.set(secrets.LEDGER_SETTING, ledger)
    try:
        first = Counter(map(tuple, secrets.op6_secret_ledger(spark, sf).collect()))
        n = spark.read.parquet(ledger).count()
        assert Counter(map(tuple, secrets.op6_secret_ledger(spark, sf).collect())) == first
        assert spark.read.parquet(ledger).count() == n > 0
    finally:
        spark.conf.unset(secrets.LEDGER_SETTING)


def naive_personal(text: str) -> list:
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and pii.luhn(d)]
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]


def test_a_secret_at_a_null_path_is_found(spark):
    rows = [(None, "password = hunter2222"), (None, "plain"), (1, "also plain"), (None, None)]
    ledger = scratch_path(spark, "ledger")
    found = secrets.scan_history(spark.createDataFrame(rows, "path long, text string"), ledger)
    assert sorted(r.n_assign for r in found.collect()) == [0, 0, 0, 1]
    assert spark.read.parquet(ledger).count() == 4


def test_base_personal_spans_equal_brute_force():
    rnd = random.Random(4)
    for _ in range(20_000):
        t = "".join(rnd.choice("a1.@-+ (5_%2.9 .b@4") for _ in range(rnd.randint(0, 45)))
        assert sorted(pii.base_spans(t)) == sorted(naive_personal(t)), t


def test_personal_data_rows(spark, docs):
    df, rows = docs
    got = pii.personal_data(df).collect()
    order = {k: n for n, k in enumerate(pii.KINDS)}
    want = Counter()
    for i, t in rows:
        # the contract's email pattern is quadratic on the long text, which has no @
        s = sorted(naive_personal(t if t and "@" in t else (t or "").replace("w", " ")), key=lambda x: (x[1], order[x[0]]))
        want[i, *(sum(x[0] == k for x in s) for k in order), sha(",".join(f"{k}:{a}:{b}" for k, a, b in s).encode())] += 1
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    assert pii.personal_data(frames.empty(spark)).count() == 0


def naive_reconciled(text, runs):
    base = pii.base_spans(text)
    spans = list(base)
    for tag, s, e in runs:
        while s < e and not (text[s].isalnum() or text[s] in "+(["):
            s += 1
        while e > s and not (text[e - 1].isalnum() or text[e - 1] in ")]"):
            e -= 1
        free = all(e <= a or s >= b for _, a, b in base)
        edge = (s == 0 or not text[s - 1].isalnum()) and (e == len(text) or not text[e].isalnum())
        if s < e and free and edge and pii.plausible(("", *pii.KINDS)[tag], text[s:e]):
            spans.append((("", *pii.KINDS)[tag], s, e))
    return base, spans


def test_reconciliation_equals_brute_force_and_is_linear():
    rnd = random.Random(6)
    pieces = ["a.b@c.org ", "ann at mail dot com ", "10.0.0.1 ", "10 . 0 . 0 . 2 ", "555 123 4567 ", "+1 555 123 4567 ", "4111.1111.1111.1111 ", "4111111111111111 ", "word ", "x"]
    for _ in range(300):
        text = "".join(rnd.choice(pieces) for _ in range(30))
        cuts = sorted(rnd.sample(range(len(text) + 1), 12))
        runs = [(rnd.randint(1, 4), a, b) for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
        got, want = pii.reconciled(text, runs), naive_reconciled(text, runs)
        assert got == want
    text = "10.0.0.1 " * 120_000
    began = time.process_time()
    assert len(pii.reconciled(text, [(2, 9 * k + 8, 9 * k + 9) for k in range(119_000)])[0]) == 120_000
    assert time.process_time() - began < 20


def test_windows_agree_with_one_long_pass():
    """Windows are reconciled to what the whole text gives at once, but for rare runs at their margins."""
    rng = np.random.default_rng(3)
    tagger = pii.Tagger(pii.trained())
    text = " ".join(pii._value(rng)[1] if rng.random() < 0.1 else pii._word(rng) for _ in range(1500))
    cut = tagger.tags([text])[0]
    path = tagger.paths([pii.classes(text)])[0]
    edges = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
    whole = {(int(path[a]), a, b) for a, b in zip(edges, edges[1:], strict=False) if path[a]}
    assert len(whole) > 50 and len(whole & set(cut)) >= 0.98 * max(len(whole), len(cut))


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(9)
    for _ in range(20):
        t, k, b = 5, 3, 4
        e, trans = rng.normal(size=(t, k, b)).astype(np.float32), rng.normal(size=(k, k)).astype(np.float32)
        lengths = np.array([5, 5, 3, 1])
        path = bilstm.viterbi(e, trans, lengths)
        for j, n in enumerate(lengths.tolist()):
            def score(p, n=n, j=j):
                return sum(e[i, p[i], j] for i in range(n)) + sum(trans[p[i - 1], p[i]] for i in range(1, n))

            best = max(itertools.product(range(k), repeat=n), key=score)
            assert abs(score(best) - score(path[:n, j].tolist())) < 1e-4


def test_network_finds_held_out_spans():
    tagger = pii.Tagger(pii.trained())
    xs, ys = pii.labelled_windows(200, 180, seed=77)
    path = np.zeros_like(ys)
    for b, p in enumerate(tagger.paths([xs[:, b] for b in range(xs.shape[1])])):
        if p is not None:
            path[:, b] = p
    assert (path == ys).mean() > 0.97
    full = pii.bilstm.viterbi
    assert full(np.zeros((3, 2, 1)), np.zeros((2, 2)), np.array([2])).shape == (3, 1)
    for k in range(1, pii.TAGS):
        assert ((path == k) & (ys == k)).sum() > 0.9 * (ys == k).sum()


def test_masking(spark):
    df = spark.createDataFrame([(2**60 + 1, "mail me: a.b@c.example.com now", 5), (2, None, None), (None, "plain", 5)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in pii.masked(df).collect()}
    assert got == {2**60 + 1: ("mail me: <email> now", 20), 2: (None, None), None: ("plain", 5)}


def test_quality_base_equals_brute_force(spark, docs):
    df, rows = docs
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judged(df).collect())
    want = Counter()
    for i, t in rows:
        t = t or ""
        words = t.encode().split()
        windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        seen: dict = {}
        for w in windows:
            seen[w] = seen.get(w, 0) + 1
        covered = {k + j for k, w in enumerate(windows) if seen[w] > 1 for j in range(8)}
        lines, dup = set(), 0
        for line in t.split("\n"):
            if line.encode().split():
                dup += line in lines
                lines.add(line)
        n = len(words)
        want[i, n, sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in t), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n] += 1
    assert got == want
    assert quality.judged(frames.empty(spark)).count() == 0


def test_frequent_lines_deplete_documents(spark):
    shared = "\n".join(f"shared notice {w} of all the people here" for w in ("alpha", "beta", "gamma", "delta"))
    own = "unique words number {0} stand here and more of them follow in this long enough line about topic {0} with text"
    rows = [(k, shared + "\n" + own.format(k), "s") for k in range(60)] + [(200, shared, "s"), (201, shared + "\ntail", "s"), (202, shared + "\nlonely", "other")]
    got = {r.doc_id: r for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[200].n_common_words == 32 and not got[200].kept and not got[201].kept
    assert got[202].n_common_words == 0 and got[202].kept
    assert all(got[k].n_common_words == 32 and got[k].kept for k in range(60))


def test_long_lines_deplete_documents(spark):
    notice = " ".join(f"clause{k}" for k in range(120))
    own = " ".join("only{0}x%d" % k for k in range(60))
    rows = [(k, notice + "\n" + own.format(k), "s") for k in range(60)] + [(200, notice, "s"), (201, notice, "other")]
    got = {r.doc_id: r for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[200].n_common_words == 120 and not got[200].kept
    assert got[201].n_common_words == 0 and got[201].kept
    assert all(got[k].n_common_words == 120 and got[k].kept for k in range(60))


def test_lines_count_documents_not_texts_or_rows(spark, monkeypatch):
    line = "one line that many of the documents hold in common with each other"
    own = "and words that are their own here {0} " * 6
    rows = [(k, line, "s") for k in range(40)]  # forty copies are forty documents
    rows += [(100, line + own.format(k), "t") for k in range(40)] + [(200 + k, own.format(k), "t") for k in range(10)]  # one document in forty rows
    rows += [(None, line + "\n" + own.format(k), "u") for k in range(40)] + [(None, line, "u")]  # null ids are documents by their text
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = quality.judged(df).collect()
    monkeypatch.setattr(quality, "BROADCAST_LINES", 0)
    assert Counter(map(tuple, quality.judged(df).collect())) == Counter(map(tuple, got))
    assert all(r.n_common_words == 13 for r in got if r.doc_id is not None and r.doc_id < 100)
    assert all(r.n_common_words == 0 for r in got if r.doc_id is not None and r.doc_id >= 100)
    assert all(r.n_common_words == 13 for r in got if r.doc_id is None)


def test_no_local_scratch_on_a_cluster(spark, monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", "x"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="checkpoint"):
        common.scratch_dir(Session())


def test_scratch_tables_are_dropped(spark):
    mark = common.made(spark)
    a, b = common.written(spark.range(3), "one"), common.written(spark.range(4), "two")
    common.drop_since(spark, mark, b)
    assert b.count() == 4 and common.made(spark) == mark + 1
    common.drop_written(b)
    assert common.made(spark) == mark
