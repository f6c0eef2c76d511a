import hashlib
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import langid, license_scan, positional_index, toxicity

from .helpers import NASTY, docs_frame, words


def test_license_phrases_against_brute_force(spark):
    rows = [*NASTY, (20, "mit license MIT, license the apache-license\nGeneral Public; license mit license"), (21, "mitlicense mit  licensed")]
    got = license_scan.scan_licenses(docs_frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by_id = {(r["doc_id"], r["n_words"]): r for r in got}
    for i, t in rows:
        w = words(t)
        starts = [j for p in license_scan.PHRASES for j in range(len(w)) if w[j : j + len(p.split())] == p.split()]
        labels = {v for k, v in license_scan.PHRASES.items() if any(w[j : j + len(k.split())] == k.split() for j in range(len(w)))}
        r = by_id[i, len(w)]
        assert (r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)))
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
    assert license_scan.scan_licenses(docs_frame(spark, [])).count() == 0


def test_notices_with_edits(spark):
    rows = [(1, "xx Licenced undr the Apache Licence, Version 2.0 yy"), (2, "Permision is hereby granted, free of charge, to any person obtaning a copy"), (3, "nothing of the kind"), (4, "all rights"), (5, "reserved")]
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(docs_frame(spark, rows)).collect()}
    assert "apache-notice" in got[1]["labels"] and got[1]["spans"][0]["first_word"] == 1
    assert "mit-notice" in got[2]["labels"] and 0 < got[2]["score"] < 1
    assert got[3]["labels"] == got[4]["labels"] == got[5]["labels"] == ""


def test_notices_at_the_edges_of_texts_that_share_a_block():
    notices = tuple(sorted(license_scan.NOTICES.items()))
    texts = ["some words", *(t for t, _ in notices), "", *(f"{t} and more" for t, _ in notices), *(f"more and {t}" for t, _ in notices), "Licenced under the Apache License, Version 2.0", "x all rights", "reserved x"]
    got = license_scan._scan(pa.array(texts), (), notices)
    for i, t in enumerate(texts):
        alone = license_scan._scan(pa.array([t]), (), notices)
        assert (got["labels"][i], got["score"][i], got["spans"][i]) == (alone["labels"][0], alone["score"][0], alone["spans"][0]), t
        assert all(label in got["labels"][i].split(",") for x, label in notices if x in t), t
    assert got["labels"][-3] == "apache-notice" and got["labels"][-2:] == ["", ""]


def test_every_edit_within_the_bound_is_found():
    n = license_scan.Notice("under the terms of the gnu general public license", "x")
    for at in range(0, len(n.text), 7):
        for kind in ("cut", "swap", "add"):
            t = bytearray(n.text)
            if kind == "cut":
                del t[at]
            elif kind == "swap":
                t[at] = ord("z")
            else:
                t.insert(at, ord("z"))
            assert n.occurrences(b"foo " + bytes(t) + b" bar\n"), (at, kind)


def brute_contamination(docs, items, k=8):
    windows = {}
    for i, t in items:
        w = words(t)
        for j in range(max(1, len(w) - k + 1) if w else 0):
            windows.setdefault(tuple(w[j : j + k]), set()).add(str(i))
    out = []
    sizes = {len(g) for g in windows}
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for j in range(len(w) - n + 1):
                if (g := tuple(w[j : j + n])) in windows:
                    hit.update(range(j, j + n))
                    found |= windows[g]
        out.append((i, len(w), len(hit), sorted(found)))
    return out


def test_contamination_against_brute_force(spark):
    items = [(1, "the quick brown fox jumps over the lazy dog again and again"), (2, "short one"), (3, None), (4, ""), (10, "a b a b a b a b a b"), (5, "a")]
    docs = [*NASTY, (30, "say The quick brown fox jumps over the lazy dog again, and again and a short one"), (31, "a b " * 30), (32, "over the lazy dog again and"), (33, "short"), (34, "one")]
    frame = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, doc_id int")
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in positional_index.contamination(docs_frame(spark, docs), frame).collect()]
    assert sorted(got, key=str) == sorted(brute_contamination(docs, items), key=str)
    none = positional_index.contamination(docs_frame(spark, docs), frame.limit(0))
    assert none.where("n_hit > 0 or contaminated").count() == 0 and none.count() == len(docs)
    assert positional_index.contamination(docs_frame(spark, []), frame).count() == 0
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.concat_ws(",", F.array().cast("array<string>")), 256)).first()[0]


def test_search_in_passes_and_with_gaps(spark):
    docs = docs_frame(spark, [(1, "alpha x beta gamma"), (2, "alpha beta x y gamma"), (3, "gamma beta alpha")])
    items = spark.createDataFrame([(1, "alpha beta gamma"), (2, "gamma beta")], "item_id bigint, text string")
    index, windows = positional_index.build_index(docs), positional_index.item_windows(items)
    exact = positional_index.search_index(index, windows, pass_windows=1).collect()
    assert [(r["doc_at"], r["items"]) for r in exact if r["items"] == ["2"]] and all(r["items"] != ["1"] for r in exact)
    near = positional_index.search_index(index, windows, gaps=1).join(positional_index.index_documents(index), ["shard", "doc_at"]).collect()
    assert {(r["id"], *r["items"]) for r in near} == {(1, "1"), (3, "2")}


def test_languages_held_out(spark):
    texts = {"en": "the quick fox and the dog were with them in that house", "de": "der schnelle fuchs und die katze sind nicht mit ihnen im haus", "fr": "le renard et les chiens sont dans la maison avec nous pour elle"}
    rows = [(i, " ".join(texts[lang].split()[(i + j * 3) % 11] for j in range(30)), lang) for i, lang in enumerate(list(texts) * 40)]
    rows += [(1000, None, "en"), (1001, "", "de"), (1002, "123 !!!", None), (1003, "漢字", "fr")]
    docs = docs_frame(spark, rows)
    model = langid.learn(docs.where(~langid.held_out()))
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows if i < 1000)
    assert {got[i]["lang_pred"] for i in (1000, 1001, 1002)} == {"und"} and got[1003]["lang_pred"] in texts
    assert all(0 <= r["score"] <= 1 for r in got.values())
    none = langid.learn(docs.where("false"))
    assert {r["lang_pred"] for r in langid.identify(docs, none).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).count() == 0
    assert spark.range(20).select(langid.held_out("id").alias("h"), "id").where("h").collect() == [r for r in spark.range(20).select(langid.held_out("id").alias("h"), "id").collect() if zlib.crc32(str(r["id"]).encode()) % 5 == 0]


def test_more_languages_than_a_byte_has_bits():
    import numpy as np

    f = langid.LanguageFilter([f"l{i:02}" for i in range(20)])
    for i in range(20):
        f.add(i, np.arange(i * 50, i * 50 + 50))
    shares = f.shares(np.arange(850, 900), np.array([0, 50]))
    assert shares[0].argmax() == 17 and shares[0, 17] == 1


def test_lexicon_automaton_against_edit_distance():
    lex = toxicity.Lexicon(["idiot", "worthless", "disgusting"], ["loweix"])

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    tried = ["idiot", "idiots", "idiott", "idot", "1diot", "idiotic", "ideas", "wrthless", "worthles", "worthless", "wortless", "disgustin", "disgusing", "dsgustng", "disgust", "loweixen", "loweiy", "", "i", "xidiot", "idoit"]
    for w in tried:
        allowed = [t for t in lex.words if distance(w, t) <= (len(t) >= 5) + (len(t) >= 10)]
        want = toxicity.EXACT if w in lex.words or w.startswith("loweix") else toxicity.FUZZY if allowed else 0
        assert lex.match(w) == want, w


def test_toxicity_learns_terms_and_quotation(spark):
    import random

    rng = random.Random(4)
    clean = [f"word{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(clean) for _ in range(40)]
        kind = i % 4
        if kind == 0:
            w[10], w[20] = rng.choice(["moron", "scum"]), rng.choice(["moron", "scum"])
        if kind == 1 and i % 8 == 1:
            w[10] = 'the word "moron"'
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(kind == 0)))
    frame = spark.createDataFrame([*labels, (9999, 1, 1), (None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
    docs = docs_frame(spark, rows)
    model = toxicity.learn(docs, frame)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert sum(got[i]["predicted"] == (i % 4 == 0) for i, _ in rows) >= 590
    odd = toxicity.score_toxicity(docs_frame(spark, [*NASTY, (50, "you m0ron and scumm moron")]), model).collect()
    assert len(odd) == len(NASTY) + 1 and all(0 <= r["score"] <= 1 for r in odd)
    assert {r["predicted"] for r in odd if r["doc_id"] in (2, 3, 4)} == {0}
    none = toxicity.learn(docs, frame.limit(0))
    assert toxicity.score_toxicity(docs, none).where("predicted = 1").count() == 0
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def test_held_out_labels_are_not_learned(spark):
    docs = docs_frame(spark, [(i, "x") for i in range(50)])
    labels = spark.createDataFrame([(i, int(zlib.crc32(str(i).encode()) % 5 == 0)) for i in range(50)], "doc_id bigint, toxic int")
    assert pytest.approx(toxicity.learn(docs, labels).score(__import__("numpy").zeros((1, 4)))[0], abs=1e-6) == 0


def test_quotations_are_pairs_of_marks_of_any_length():
    from tessera.llm import toxicity as T

    lexicon = T.Lexicon(["moron"], [])
    texts = ['"hello" you moron "bye"', '"you moron"', '"' + "x " * 200 + "moron " + "y " * 200 + '"', "„du moron“ und", 'one " mark, moron', '"first\n\nmoron" second', "moron, he said"]
    kinds = [tuple(x[:3].tolist()) for x in T._features(pa.array(texts), lexicon)]
    assert kinds == [(1, 0, 0), (0, 0, 1), (0, 0, 1), (0, 0, 1), (1, 0, 0), (1, 0, 0), (0, 0, 1)]


def test_misspelled_forms_of_a_stem():
    from tessera.llm import toxicity as T

    lexicon = T.Lexicon(["idiots", "idiotic"], ["idiot"])
    assert [lexicon.match(w) for w in ("idiot", "idiotism", "id1otic", "idiats", "plain")] == [T.EXACT, T.EXACT, T.FUZZY, T.FUZZY, 0]


def test_rows_without_an_id_are_not_held_out(spark):
    from tessera.llm import langid

    rows = spark.createDataFrame([(None,), (1,), (2,), (3,)], "doc_id bigint")
    assert [r[0] for r in rows.select(langid.held_out()).collect()][0] is False
