"""Operators over the whole corpus against brute force."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import frames
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelmill.llm import common, components, decontaminate, near_dedup, substring, toxicity


def jaccard_sets(rows, width):
    out = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    return out


def near_copies(n=60, seed=1):
    rnd = random.Random(seed)
    base = [f"term{rnd.randint(0, 400)}" for _ in range(160)]
    rows = []
    for k in range(n):
        w = list(base)
        for _ in range(rnd.choice((0, 1, 3, 6, 9))):
            w[rnd.randrange(len(w))] = f"new{rnd.randint(0, 10_000)}"
        rows.append((920_000 + k, " ".join(w)))
    return rows


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, width, percent):
    df, rows = frames.awkward(spark, frames.sample_texts(80) + near_copies())
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df, width, percent).collect())
    sets = jaccard_sets(rows, width)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least: dict = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min((x for x in (least.get(find(k)), i) if x is not None), default=None)
    assert got == Counter((i, len(sets[k]), least[find(k)], i == least[find(k)]) for k, (i, _) in enumerate(rows))
    groups = Counter(find(k) for k in range(len(rows)) if sets[k])
    kept = near_dedup.without_near_duplicates(df, width, percent)
    assert kept.columns == df.columns
    out = kept.select("doc_id", "text").collect()
    assert Counter(r.doc_id for r in out) == Counter(least[g] for g in groups) + Counter(i for k, (i, _) in enumerate(rows) if not sets[k])
    assert near_dedup.near_duplicates(frames.empty(spark)).count() == 0


@pytest.mark.parametrize("hot", [16_000_000, 0])
def test_leftover_blocks_find_links_that_centres_miss(spark, monkeypatch, hot):
    rows = near_copies(40, 9)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    many = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, 3, 85).collect()}
    monkeypatch.setattr(near_dedup, "CENTRES", 1)
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    monkeypatch.setattr(near_dedup, "HOT", hot)
    few = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, 3, 85).collect()}
    assert few == many


def test_variants_of_a_template_leave_the_grid(spark, monkeypatch):
    """Each has its own words, so none can be linked; they share buckets, and are not compared."""
    rnd = random.Random(4)
    base = [f"term{rnd.randint(0, 4000)}" for _ in range(200)]
    rows = [(k, " ".join(f"own{k}x{j}" if (j + k) % 12 == 0 else w for j, w in enumerate(base))) for k in range(120)]
    monkeypatch.setattr(near_dedup, "HOT", 0)
    sets = [s.tobytes() for s in near_dedup.shingle_sets([t for _, t in rows], 3)]
    sizes = [len(s) // 8 for s in sets]
    profiles = spark.createDataFrame([(k, bytearray(s), n) for k, (s, n) in enumerate(zip(sets, sizes, strict=True))], "rep long, items binary, n_shingles long")
    kept = spark.createDataFrame([(5, k, k, k > 0, 120, 119) for k in range(120)], "band long, rep long, comp long, outside boolean, n long, n_outside long")
    assert near_dedup._thinned(kept, profiles, 0.85).count() == 0
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85)
    assert out.where("kept").count() == 120


def test_stage_keeps_one_row_of_each_group(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(3, text, "a"), (3, text, "b"), (3, text + " more", "c"), (None, text, "d"), (None, "only here " * 9, "e"), (None, "only here " * 9, "f"), (4, None, "g"), (4, None, "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, text_id string")
    got = Counter((r.doc_id, bool(r.text)) for r in near_dedup.without_near_duplicates(df).collect())
    assert got == Counter({(3, True): 1, (None, True): 1, (4, False): 2})


def test_only_texts_that_may_be_asked_for_travel(spark, monkeypatch):
    df = spark.createDataFrame([(k if k % 7 else None, f"t{k}") for k in range(2000)], "doc_id long, text string")
    keys = df.where("doc_id is null or doc_id % 10 = 1")
    met = common.perhaps_in(df, keys, "doc_id", "text")
    assert met.where("_perhaps").join(keys, df.text == keys.text, "left_semi").count() == keys.count()
    assert met.count() == 2000 and met.where("_perhaps").count() < 1.1 * keys.count()
    # a filter that lets all pass changes nothing
    docs = spark.createDataFrame(near_copies() + [(None, "only here " * 9), (5, None)], "doc_id long, text string")
    want = Counter(near_dedup.without_near_duplicates(docs).collect())
    monkeypatch.setattr(common, "FILTER_BITS", 64)
    assert Counter(near_dedup.without_near_duplicates(docs).collect()) == want
    # a band's key depends on its registers and its number only
    r = spark.createDataFrame([(bytearray(range(240)),), (bytearray([1] * 240),)], "r binary").select(near_dedup.bands_of(F.col("r")).alias("b")).collect()
    assert len(set(r[0].b) | set(r[1].b)) == 2 * near_dedup.BANDS


def test_likelihood_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 1500).astype(np.uint64)
    a, b = pool[:1200], pool[200:1400]
    r = near_dedup.registers(np.concatenate((a, b)), np.array([0, len(a)]))
    x, y = r[:1], r[1:]
    est = near_dedup.likelihood_similarity(np.array([1200.0]), np.array([1200.0]), (x > y).sum(1), (x < y).sum(1), (x == y).sum(1))[0]
    assert abs(est - 1000 / 1400) < 0.13
    union = near_dedup.registers(np.concatenate((a, b)), np.array([0]))
    assert (union[0] == np.maximum(r[0], r[1])).all()


def test_components_of_a_chain_and_a_star(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)]
    random.Random(1).shuffle(chain)
    got = {r.a: r.b for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {100 + k: 100 for k in range(1, 30)}


def test_components_equal_union_find_and_stars_take_one_round(spark, monkeypatch):
    rnd = random.Random(7)
    links = [(a, b) for a, b in ((rnd.randrange(150), rnd.randrange(150)) for _ in range(110)) if a != b]
    top = {k: k for link in links for k in link}
    for _ in top:
        for a, b in links:
            top[a] = top[b] = min(top[a], top[b])
    found = components.components(spark.createDataFrame(links + links[:20], "a long, b long")).collect()
    assert Counter(map(tuple, found)) == Counter((a, b) for a, b in top.items() if a != b)
    writes = []
    monkeypatch.setattr(components, "written", lambda df, label: writes.append(label) or common.written(df, label))
    star = components.components(spark.createDataFrame([(5, 5 + k) for k in range(1, 30)], "a long, b long"))
    assert len(writes) == 2  # the links and one round, none to see that nothing changes any more
    assert sorted(map(tuple, star.collect())) == [(5 + k, 5) for k in range(1, 30)]
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def naive_cut(rows):
    words = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[k : k + 35]) for w in words for k in range(len(w) - 34))
    out = Counter()
    for (i, _), w in zip(rows, words, strict=True):
        gone = {k + j for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for j in range(35)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[(i, len(w), len(gone), hashlib.sha256(kept).hexdigest())] += 1
    return out


def test_substrings_equal_brute_force(spark):
    rnd = random.Random(2)
    passage = [f"p{rnd.randint(0, 50)}" for _ in range(90)]
    made = []
    for k in range(60):
        w = [f"q{rnd.randint(0, 9)}" for _ in range(rnd.randint(0, 70))]
        cut = sorted(rnd.sample(range(91), 2))
        made.append((930_000 + k, " ".join(w[: rnd.randint(0, len(w))] + passage[cut[0] : cut[1]] + w)))
    df, rows = frames.awkward(spark, made + [(940_000, "z " * 300)])
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.without_repeats(df).collect())
    assert got == naive_cut(rows)
    assert substring.without_repeats(frames.empty(spark)).count() == 0


@pytest.mark.parametrize("fan", [4, 1])
def test_blobs_dealt_twice_give_the_same_hot_blocks(spark, monkeypatch, fan):
    texts = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(frames.sample_texts(60) * 2)], "doc_id long, text string")
    want = {r.hash for r in substring.hot_blocks(texts, 4).collect()}
    monkeypatch.setattr(substring, "FAN", fan)
    monkeypatch.setattr(substring, "GATHER", 500)
    assert want and {r.hash for r in substring.hot_blocks(texts, 16).collect()} == want


def test_windows_of_equal_first_hash_are_told_apart():
    h, g = np.array([7, 7, 7, 9], np.uint64), np.array([1, 2, 1, 1], np.uint64)
    by, first, which = substring._distinct(h, g)
    assert by.tolist() == [0, 2, 1, 3] and first.tolist() == [0, 2, 3] and which.tolist() == [0, 0, 1, 2]


def test_packing_round_trip():
    for values in ([5], [1, 2, 2**40, 2**63], list(range(100)), [3, 3 + 2**48], [3, 3 + 2**47, 2**48]):
        v = np.array(values, np.uint64)
        assert substring.unpack(substring.pack(v)).tolist() == values


ITEMS = [(k, " ".join(f"item{k}word{(j * 7 + k) % 23}" for j in range(14 + k))) for k in range(30)]


def test_leaks_are_found_and_clean_documents_left(spark):
    rnd = random.Random(7)
    fill = lambda n: " ".join(f"f{rnd.randint(0, 500)}" for _ in range(n))
    exact = [(950_000 + k, f"{fill(40)} {t.upper()}. {fill(30)}") for k, t in ITEMS]
    edited = []
    for k, t in ITEMS:
        w = t.split()
        w[len(w) // 3] = "changed"
        del w[2 * len(w) // 3]
        edited.append((960_000 + k, f"{fill(25)} {' '.join(w)} {fill(12)}"))
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS] + [(99, None, "x"), (98, "", "x")], "item_id long, text string, doc_id string")
    df, rows = frames.awkward(spark, exact + edited + frames.sample_texts(60))
    found = {(r.doc_id, r.item_id): r.edits for r in decontaminate.leaks(df, items).collect()}
    beside = decontaminate.leaks(df.unionByName(spark.createDataFrame([(None, ITEMS[3][1])], "doc_id long, text string"), allowMissingColumns=True), items).where("doc_id is null")
    assert [r.item_id for r in beside.collect()] == [3]
    assert all(found.get((950_000 + k, k)) == 0 for k, _ in ITEMS)
    assert sum((960_000 + k, k) in found for k, _ in ITEMS) >= 0.9 * len(ITEMS)
    assert all(e <= 0.2 * (14 + i) for (_, i), e in found.items()) and all(d >= 950_000 for d, _ in found)
    kept = decontaminate.without_leaks(df, items)
    assert kept.columns == df.columns
    assert Counter(r.doc_id for r in kept.select("doc_id").collect()) == Counter(i for i, _ in rows if not any(d == i for d, _ in found))
    assert decontaminate.leaks(frames.empty(spark), items).count() == 0
    assert decontaminate.leaks(df, items.limit(0)).count() == 0


def test_item_blocks_leave_no_row_out(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEM_BLOCK", 2)
    names = [f"alpha{k} beta{k} gamma{k} delta{k}" for k in range(9)]
    ids = [None, None, None, 2**60 + 1, 5, 5, 5, 5, 6]
    items = spark.createDataFrame([*zip(ids, names, strict=True), (5, names[4]), (7, None)], "item_id long, text string")
    docs = spark.createDataFrame([*((k, f"one two {t} three") for k, t in enumerate(names)), (100, "plain words only")], "doc_id long, text string")
    found = sorted(((r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()), key=str)
    assert found == sorted([*enumerate(ids), (4, 5)], key=str)
    assert [r.doc_id for r in decontaminate.without_leaks(docs, items).collect()] == [100]


def test_every_item_within_the_edits_allowed_is_found():
    rnd = random.Random(11)
    items = [[f"v{rnd.randrange(400)}" for _ in range(n)] for n in range(1, 64) for _ in range(4)]
    texts = []
    for w in items:
        w = list(w)
        for _ in range(len(w) // 5):
            kind, at = rnd.randrange(3), rnd.randrange(len(w))
            w[at : at + (kind != 1)] = [] if kind == 0 else [f"z{rnd.randrange(10**6)}"]
        texts.append(" ".join([f"f{rnd.randrange(500)}" for _ in range(20)] + w + [f"f{rnd.randrange(500)}" for _ in range(20)]))
    found = {(t, k) for t, k, *_ in decontaminate.Items(list(range(len(items))), [" ".join(w) for w in items]).find(texts)}
    assert all((k, k) in found for k in range(len(items)))


@pytest.mark.parametrize("share", [0.05, 0.1, 0.15, 0.2])
def test_walks_alone_reach_the_target_recall(share):
    rnd = random.Random(13)
    made = [[f"v{rnd.randrange(400)}" for _ in range(rnd.randint(15, 63))] for _ in range(200)]
    items = decontaminate.Items(list(range(200)), [" ".join(w) for w in made])
    items.pieces = []
    texts = []
    for w in made:
        w = list(w)
        for _ in range(int(share * len(w))):
            kind, at = rnd.randrange(3), rnd.randrange(len(w))
            w[at : at + (kind != 1)] = [] if kind == 0 else [f"z{rnd.randrange(10**6)}"]
        texts.append(" ".join([f"f{rnd.randrange(500)}" for _ in range(20)] + w + [f"f{rnd.randrange(500)}" for _ in range(20)]))
    found = {(t, k) for t, k, *_ in items.find(texts)}
    assert sum((k, k) in found for k in range(200)) >= decontaminate.TARGET * 200


def test_walk_tables_hold_the_keys_of_every_item_alone(monkeypatch):
    monkeypatch.setattr(decontaminate, "CANDIDATES", float("inf"))  # no anchor is left out
    rnd = random.Random(3)
    texts = [" ".join(f"v{rnd.randrange(99)}" for _ in range(n)) for n in (1, 2, 3, 7, 20, 21, 40, 300, 900)]
    items = decontaminate.Items(list(range(9)), texts)
    assert {(k, o) for _, r, _, item, offset, _ in items.tables if r == 0 for k, o in zip(item.tolist(), offset.tolist(), strict=True)} == {(k, o) for k, w in enumerate(items.words) for o in range(len(w) - decontaminate.window_size(len(w)) + 1)}
    for size, repeat, keys, item, offset, _ in items.tables:
        pad = decontaminate.mix(np.arange(1, 2 * size + 1, dtype=np.uint64))
        for key, k, o in zip(keys.tolist(), item.tolist(), offset.tolist(), strict=True):
            assert key == decontaminate.walk_keys(np.concatenate((items.words[k][o:], pad)), size, repeat)[0]


def frequent_words(rnd, n, of=2000):
    """Words whose frequency falls with their rank."""
    return rnd.choices([f"w{k}" for k in range(of)], [1 / (k + 1) for k in range(of)], k=n)


def test_frequent_words_give_few_candidates_and_lose_no_item():
    rnd = random.Random(5)
    made = [frequent_words(rnd, 15) for _ in range(500)]
    items = decontaminate.Items(list(range(500)), [" ".join(w) for w in made])
    words = decontaminate.item_words([" ".join(frequent_words(rnd, 2000)) for _ in range(20)])
    assert sum(len(place) for place, *_ in items.matches(words)) <= 0.05 * len(words.hashes)
    assert len(items.hits(words)) <= 0.01 * len(words.hashes)
    texts = []
    for w in made:
        w = list(w)
        for _ in range(3):
            kind, at = rnd.randrange(3), rnd.randrange(len(w))
            w[at : at + (kind != 1)] = [] if kind == 0 else frequent_words(rnd, 1)
        texts.append(" ".join(frequent_words(rnd, 30) + w + frequent_words(rnd, 30)))
    assert {(k, k) for k in range(500)} <= {(t, k) for t, k, *_ in items.find(texts)}
    items.pieces = []
    assert sum(t == k for t, k, *_ in items.find(texts)) >= decontaminate.TARGET * 500


def table_of_edits(item, part):
    """Least edits between ``item`` and any piece of ``part``, and the first end of such a piece, cell by cell."""
    above = [0] * (len(part) + 1)
    for i, word in enumerate(item):
        row = [i + 1]
        for j, other in enumerate(part):
            row.append(min(above[j] + (word != other), above[j + 1] + 1, row[j] + 1))
        above = row
    return min(above), above.index(min(above))


def test_finds_equal_a_table_of_edits_over_all_texts_and_items():
    rnd = random.Random(8)
    made = [[f"v{rnd.randrange(6)}" for _ in range(rnd.randint(1, 14))] for _ in range(40)]
    texts = [[f"v{rnd.randrange(7)}" for _ in range(rnd.randint(0, 60))] for _ in range(40)]
    for w in made[::2]:
        i, w = rnd.randrange(len(texts)), [x for x in w if rnd.random() > 0.1]
        texts[i][rnd.randint(0, len(texts[i])) : 0] = w
    items = decontaminate.Items(list(range(len(made))), [" ".join(w) for w in made])
    found = {(t, k): e for t, k, _, _, e in items.find([" ".join(w) for w in texts])}
    wanted = {(t, k): table_of_edits(w, text)[0] for t, text in enumerate(texts) for k, w in enumerate(made)}
    assert found == {at: e for at, e in wanted.items() if e <= int(decontaminate.MAX_EDITS * len(made[at[1]]))}
    assert len(found) > 40


def test_edit_distance_equals_a_table_of_edits():
    rnd = random.Random(9)
    for _ in range(400):
        item = [rnd.randrange(5) for _ in range(rnd.choice((1, 2, 5, 20, 70, 130)))]
        part = [rnd.randrange(5) for _ in range(rnd.randrange(90))]
        assert decontaminate.edit_distance(np.array(item), np.array(part)) == table_of_edits(item, part)


def test_blocks_of_items_are_bounded_by_words(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEM_WORDS", 10)
    items = spark.createDataFrame([(k, " ".join(f"a{k}b{j}" for j in range(n))) for k, n in enumerate((4, 6, 1, 25, 3, 0))], "item_id long, text string")
    assert [[len(w) for w in block.words] for block in decontaminate.item_blocks(items)] == [[4, 6], [1], [25], [3, 0]]


def test_edit_distance_by_hand():
    item = np.array([1, 2, 3, 4, 5])
    assert decontaminate.edit_distance(item, np.array([9, 1, 2, 3, 4, 5, 9])) == (0, 6)
    assert decontaminate.edit_distance(item, np.array([9, 1, 2, 4, 5, 9]))[0] == 1


def corpus(n=600, seed=3):
    rnd = random.Random(seed)
    parts = "er an th in on re at en nd ti es or te of".split()
    word = lambda: "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 4)))
    bad = ["stupidhead", "awfulclown", "nastyfool"]
    rows, labels = [], []
    for k in range(n):
        toxic = k % 4 == 0
        w = [word() for _ in range(60)]
        if toxic:
            for _ in range(3):
                w[rnd.randrange(60)] = rnd.choice(bad)
        rows.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
    return rows, labels


def test_toxicity_separates_held_out_rows_and_hidden_words(spark):
    rows, labels = corpus()
    hidden = [(10_000, "the st0p1dhead " + "on re at " * 5 + " stup1dh3ad n4styf00l"), (10_001, "s t u p i d h e a d and awfuuuulclown n.a.s.t.y.f.o.o.l"), (10_002, "on re at the " * 10)]
    df, all_rows = frames.awkward(spark, rows + hidden)
    lab = spark.createDataFrame(labels + [(5, 1), (None, 1)], "doc_id long, toxic int")
    got = pd.DataFrame([r.asDict() for r in toxicity.scored(df, lab).collect()])
    assert len(got) == len(all_rows) and got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.5)).all()
    ids = Counter((r.doc_id, r.held_out) for r in toxicity.scored(df, lab).select("doc_id", "held_out").collect())
    assert ids == Counter((i, i is not None and zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in all_rows)
    own = got[got.doc_id < 600].merge(pd.DataFrame(labels, columns=["doc_id", "toxic"]).drop_duplicates("doc_id"), on="doc_id")
    held = own[own.held_out]
    assert len(held) > 60 and ((held.score >= 0.5) == held.toxic).mean() > 0.97
    s = got.set_index("doc_id").score
    assert s[10_000] > 0.5 and s[10_001] > 0.5 and s[10_002] < 0.5 and s[900_001] < 0.5
    clean = toxicity.without_toxic(df, lab)
    assert clean.columns == df.columns and {10_002, 900_001} <= {r.doc_id for r in clean.select("doc_id").collect()}


@pytest.mark.parametrize(
    ("hidden", "word"),
    [("@$$", "ass"), ("455", "ass"), ("stuupid", "stupid"), ("iddiot", "idiot"), ("iddi0tt!", "idiot"), ("ssttuuppiidd", "stupid"), ("stu,pid", "stupid"), ("assh00le", "asshole"),
     ("you are a s t u p i d head", "stupid"), ("s t u p i d i am", "stupid"), ("s  t  u  p  i  d", "stupid"), ("s\nt\nu\np\ni\nd", "stupid"), ("s t u p i d  f o o l", "fool"), ("a s t u u p 1 d", "stupid"), ("a.s.t.u.p.i.d", "stupid"), ("a*s*t*u*p*i*d", "stupid")],
)
def test_hidden_words_are_read(hidden, word):
    text = "the stupid idiot asshole ass fool am in a mad class of people " * 50
    counts = toxicity.trigram_counts([text]).reshape(27, 27, 27) + 0.1
    model = np.log(counts / counts.sum(axis=2, keepdims=True)).astype(np.float32)
    assert word in toxicity.Restorer(model).words(hidden)
    scorer = toxicity.Scorer(model, {f"w:{word}": 5.0}, (-3.0, 1.0, 1.0))
    assert scorer.score(hidden) > 0.5 and scorer.score("the people of class ball 12 off") < 0.5


def test_decoding_finds_the_cheapest_path_of_a_lattice():
    """Against every path of small lattices."""
    counts = toxicity.trigram_counts(["the stupid idiot ass fool am in a mad class of people " * 50]).reshape(27, 27, 27) + 0.1
    model = np.log(counts / counts.sum(axis=2, keepdims=True)).astype(np.float32).tolist()

    def cost(emits, prices):
        a = b = 0
        total = sum(prices)
        for c in "".join(emits):
            z = ord(c) - 96 if "a" <= c <= "z" else 0
            total -= model[a][b][z]
            a, b = b, z
        return total - model[a][b][0]

    for token in ("st*p!d", "1d10t", "a$$", "f00l", "m4d", "cl*ss", "i.d.1.o.t", "aaass", "|*+"):
        steps = toxicity.lattice(token)
        paths = [cost([e for e, _ in p], [x for _, x in p]) for p in itertools.product(*steps)]
        word = toxicity.restore(token, model)
        mine = min(cost([e for e, _ in p], [x for _, x in p]) for p in itertools.product(*steps) if "".join(e for e, _ in p) == word)
        assert abs(mine - min(paths)) < 1e-6, token


def test_training_sample_is_bounded_and_agrees_with_the_whole(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_TRAIN", 50)
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(2000)] + [(7, "text 0")] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(2000)] + [(8, 1), (8, 0), (None, 1)], "doc_id long, toxic int")
    got = [r.text for r in toxicity._training_rows(docs, labels).collect()]
    held = {k for k in range(2000) if zlib.crc32(str(k).encode()) % 5 == 0}
    order = [r.k for r in spark.range(2000).selectExpr("id AS k", "xxhash64(id) AS h").orderBy("h", "k").collect() if r.k not in held]
    assert sorted(got) == sorted("text 0" if k == 7 else f"text {k}" for k in order[:50])


def test_toxicity_without_labels_or_documents(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    df, rows = frames.awkward(spark)
    assert toxicity.scored(df, none).where("predicted = 0").count() == len(rows)
    assert toxicity.scored(frames.empty(spark), none).count() == 0
