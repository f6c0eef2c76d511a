import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm import minhash, suffixes
from tessera.llm.common import materialise
from tessera.llm.components import components

from .helpers import NASTY, docs_frame, words

VOCAB = [f"w{i}" for i in range(3000)]


def text(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def edited(rng, t, n):
    w = t.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(VOCAB)
    return " ".join(w)


def brute_links(rows):
    """All pairs of a similarity of 0.8 or more, from words and dictionaries alone: nothing of the operator is used."""
    counts = {}
    for i, t in rows:
        w = words(t)
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)] or [tuple(w)] * bool(w)
        counts[i] = Counter(grams)
    df = Counter(g for c in counts.values() for g in c)
    idf = {g: 1 + math.log10(len(rows) / max(n, 0.01 * len(rows), 1)) for g, n in df.items()}
    out = []
    for (i, x), (j, y) in itertools.combinations(counts.items(), 2):
        low = sum(min(n, y[g]) * idf[g] for g, n in x.items() if g in y)
        total = sum(n * idf[g] for c in (x, y) for g, n in c.items()) - low
        if total and low / total >= 0.8:
            out.append((i, j))
    return out


def brute_classes(rows):
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in brute_links(rows):
        x, y = find(i), find(j)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


def test_classes_against_brute_force_with_a_large_group(spark, monkeypatch):
    rng = random.Random(5)
    base = text(rng, 150)
    rows = [(i, edited(rng, base, rng.randint(0, 6))) for i in range(150)] + [(i, base) for i in range(200, 215)]
    rows += [(1000 + i, text(rng, 60)) for i in range(30)] + [(2000, None), (2001, ""), (2002, "a b"), (2003, "A, b!"), (2004, "!!")]
    # small limits, so that the group goes through runs and blocks
    monkeypatch.setattr(minhash.candidate_links, "__defaults__", (minhash.THRESHOLD, 20, 16))
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs_frame(spark, rows)).collect()}
    assert got == brute_classes(rows)


def test_odd_rows_of_near_duplicates(spark):
    got = minhash.near_duplicates(docs_frame(spark, NASTY)).collect()
    by_id = {r["doc_id"]: r["class_id"] for r in got}
    assert len(got) == sum(i is not None for i, _ in NASTY) and None not in by_id
    assert by_id[7] == by_id[8] == 7 and all(by_id[i] == i for i in (1, 2, 3, 4, 5, 6, 9, 10))
    assert minhash.near_duplicates(docs_frame(spark, [])).count() == 0


def test_recall_of_links_on_random_edits(spark):
    """Of the pairs that reach 0.8, at least 0.9 are in one class: edits of many kinds, with a line that all texts share."""
    rng = random.Random(21)
    line = text(rng, 12)
    rows = []
    for g in range(120):
        base = text(rng, rng.randint(30, 200))
        rows += [(1000 * g + k, f"{edited(rng, base, k)} {line}") for k in range(4)]
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs_frame(spark, rows)).collect()}
    links = brute_links(rows)
    assert len(links) > 150 and sum(got[i] == got[j] for i, j in links) >= 0.9 * len(links)
    want = brute_classes(rows)
    assert all(want[i] == want[c] for i, c in got.items())  # and none is wrong


def test_links_copies_and_ids(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base), (2, base), (2, base), (3, base + " more"), (4, "other words stand here alone"), (5, "x"), (5, base)]
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs_frame(spark, rows)).collect()}
    assert {i: r["class_id"] for i, r in got.items()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 1}
    assert got[1]["n_copies"] == 4 and got[3]["n_links"] >= 1 and 0.8 <= got[3]["similarity"] < 1 and got[4]["similarity"] is None
    with pytest.raises(TypeError):
        minhash.near_duplicates(docs_frame(spark, rows).selectExpr("cast(doc_id as string) as doc_id", "text"))


def shingle_counts(t):
    w = words(t)
    return Counter([tuple(w[k : k + 5]) for k in range(len(w) - 4)] or [tuple(w)] * bool(w))


def test_rare_shingles_weigh_by_their_own_frequency(spark):
    """All shingles here stand in less than 1 % of the texts. By counts alone (or one weight for all rare ones) the first pair would reach 0.8 and the
    second would not."""
    fresh = iter(f"u{i}" for i in range(100_000))
    own = lambda n: " ".join(next(fresh) for _ in range(n))
    one, other, line = own(100), own(100), own(26)
    rows = [(1, one), (2, f"{one} {own(23)}"), (3, other), (4, f"{other} {line}")]
    rows += [(10 + i, f"{own(30)} {line}") for i in range(8)] + [(100 + i, own(6)) for i in range(988)]
    counts = {i: shingle_counts(t) for i, t in rows}
    df = Counter(g for c in counts.values() for g in c)
    assert max(df.values()) < 0.01 * len(rows)

    def similarity(i, j, weight):
        low, high = (sum(f(counts[i][g], counts[j][g]) * weight(g) for g in counts[i] | counts[j]) for f in (min, max))
        return low / high

    exact = lambda g: 1 + math.log10(len(rows) / df[g])
    assert similarity(1, 2, lambda g: 1) > 0.8 > similarity(1, 2, exact) and similarity(3, 4, lambda g: 1) < 0.8 < similarity(3, 4, exact)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs_frame(spark, rows)).collect()}
    assert {i: r["class_id"] for i, r in got.items() if r["class_id"] != i} == {4: 3}
    assert got[3]["similarity"] == pytest.approx(similarity(3, 4, exact), abs=1e-6) and got[1]["similarity"] is None


def test_frequencies_of_shingles_across_bundles(spark):
    rng = random.Random(31)
    line = text(rng, 9)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) + f" {line}" * (i % 3)) for i in range(300)]
    rows += [(i + 1000, t) for i, t in rows[:50]] + [(2000, None), (2001, "!"), (2002, "a b"), (2003, "a b a b a b")]
    counts = {i: shingle_counts(t) for i, t in rows}
    df = Counter(g for c in counts.values() for g in c)
    table = docs_frame(spark, rows).selectExpr("doc_id as id", "text as _text").repartition(7).where("id is not null")
    minhash.tune(spark)
    bundles = materialise(minhash.text_bundles(table, size=100), "bundles")
    made = minhash.sketches(bundles, materialise(minhash.document_frequencies(bundles, bits=3), "frequencies"), len(rows)).collect()
    assert bundles.select("bundle").distinct().count() > 4 and sorted(r["id"] for r in made) == sorted(i for i, c in counts.items() if c)
    for r in made:
        assert sorted(np.frombuffer(r["df"], np.uint32).tolist()) == sorted(df[g] for g in counts[r["id"]]), r["id"]


def test_runs_of_a_band_tie_all_members(spark):
    rows = [(7, i, 5) for i in range(100)] + [(8, i, 2) for i in (3, 200)] + [(9, 1, 1)]
    pairs = minhash.star_pairs(spark.createDataFrame(rows, "key bigint, id bigint, n bigint"), chunk=8)
    root = {r["id"]: r["root"] for r in components(pairs).collect()}
    assert root == {**{i: 0 for i in range(100)}, 200: 0}


def test_sketch_entries_agree_as_often_as_weighted_jaccard_says():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    w = rng.random(400).astype(np.float32) * 3 + 0.1
    v = w.copy()
    v[300:] *= 2
    first = np.array([0, 400, 700])
    s = minhash.sketch(np.concatenate([h, h[:300]]), np.concatenate([w, v[:300]]), first, 2000)
    want = w[:300].sum() / w.sum()
    assert abs((s[0] == s[1]).mean() - want) < 0.04
    t = minhash.sketch(np.concatenate([h, h]), np.concatenate([w, v]), np.array([0, 400, 800]), 2000)
    assert abs((t[0] == t[1]).mean() - w.sum() / v.sum()) < 0.04


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (103, 102), (101, 103), (7, 7)], "a bigint, b bigint")
    got = {r["id"]: r["root"] for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in (100, 101, 102, 103)}}


def test_passages_against_brute_force(spark):
    rng = random.Random(8)
    shared = [text(rng, n) for n in (50, 51, 64, 90, 200)]
    fresh = iter(f"u{i}" for i in range(100_000))
    own = lambda n: " ".join(next(fresh) for _ in range(n))
    rows = [(i, " ".join([own(rng.randint(1, 60)), shared[i % 5], own(rng.randint(1, 60)), rng.choice(shared), own(1)])) for i in range(60)]
    rows += [(100 + i, own(30) + " " + " ".join(shared[0].split()[:49])) for i in range(5)]
    rows += [(200, shared[0]), (201, shared[0].upper().replace(" ", ", ")), *[(300 + (i or 99), t) for i, t in NASTY]]
    found = suffixes.repeated_passages(docs_frame(spark, rows)).collect()
    w = {i: words(t) for i, t in rows}
    seen = {}
    for i, x in w.items():
        for j in range(len(x) - 49):
            g = tuple(x[j : j + 50])
            seen[g] = min(i, seen.get(g, i))
    got = {i: set() for i in w}
    for r in found:
        a, b = r["first_word"], r["other_first_word"]
        assert r["other_doc_id"] < r["doc_id"] and r["n_words"] >= 50
        assert w[r["doc_id"]][a : a + r["n_words"]] == w[r["other_doc_id"]][b : b + r["n_words"]]
        got[r["doc_id"]].update(range(a, a + r["n_words"]))
    for i, x in w.items():
        want = {k for j in range(len(x) - 49) if seen[tuple(x[j : j + 50])] < i for k in range(j, j + 50)}
        assert got[i] == want, i
    assert suffixes.repeated_passages(docs_frame(spark, [])).count() == 0


def test_passages_around_a_frequent_line(spark):
    rng = random.Random(10)
    lines, fresh = [text(rng, 40) for _ in range(8)], iter(f"u{i}" for i in range(100_000))
    own = lambda n: " ".join(next(fresh) for _ in range(n))
    rows, want = [], set()
    for p in range(40):
        for before, after in ((5, 5), (2, 8)):
            passage = f"{own(before)} {lines[p % 8]} {own(after)}"
            pair = rng.sample(range(10_000 * p + 1000 * before, 10_000 * p + 1000 * before + 999), 2)
            rows += [(i, f"{own(30)} {passage} {own(30)}") for i in pair]
            want.add((max(pair), 30, 50, min(pair), 30))
    rows += [(1_000_000 + i, f"{own(30)} {lines[i % 8]} {own(30)}") for i in range(400)]
    ids = [i for i, _ in rows]
    rng.shuffle(ids)  # pairs aren't neighbours by id
    new = dict(zip([i for i, _ in rows], ids, strict=True))
    pairs = {(max(new[a], new[b]), x, n, min(new[a], new[b]), y) for a, x, n, b, y in want}
    got = suffixes.repeated_passages(docs_frame(spark, [(new[i], t) for i, t in rows])).collect()
    assert {(r["doc_id"], r["first_word"], r["n_words"], r["other_doc_id"], r["other_first_word"]) for r in got} == pairs


def test_removal_keeps_all_else(spark):
    rng = random.Random(9)
    passage = text(rng, 70)
    docs = docs_frame(spark, [(1, f"Start. {passage}; end!"), (2, f"Other, start - {passage}. And (its) end?"), (3, None), (4, "x")])
    out = {r["doc_id"]: r["text"] for r in suffixes.remove_passages(docs, suffixes.repeated_passages(docs)).collect()}
    assert out == {1: f"Start. {passage}; end!", 2: "Other, . And (its) end?", 3: None, 4: "x"}


def test_minimisers_meet_in_shared_windows():
    rng = np.random.default_rng(3)
    one, other = rng.integers(0, 1 << 62, 300), rng.integers(0, 1 << 62, 260)
    other[100:140] = one[37:77]
    a = suffixes.minimisers(one.astype(np.uint64), np.zeros(300, int), 35)
    b = suffixes.minimisers(other.astype(np.uint64), np.zeros(260, int), 35)
    for at in range(6):  # each window of 35 within what is shared
        inside = {x - 37 for x in a.tolist() if 37 + at <= x < 37 + at + 35} & {x - 100 for x in b.tolist() if 100 + at <= x < 100 + at + 35}
        assert inside
