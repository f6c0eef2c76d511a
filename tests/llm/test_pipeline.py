import random
import zlib

import numpy as np
import pytest

import corpus_pipeline as P
from tessera.llm import queries, tokens
from tessera.llm.common import materialise

from .helpers import words

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents of which it is known what becomes of each."""
    rng = random.Random(11)
    vocab = [f"v{i}" for i in range(2000)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    item, passage = text(30), text(80)
    rows, labels = [], []
    for i in range(200):
        rows.append((i, text(60)))
        labels.append((i, 1, 0))
    for i in range(200, 280):
        rows.append((i, text(20) + " moron " + text(20) + " scum " + text(10)))
        labels.append((i, 0, 1))
    rows += [(300, rows[0][1]), (301, rows[1][1].upper()), (302, rows[2][1] + " extra"), (310, text(30) + " " + passage), (311, text(30) + " " + passage + " " + text(30)), (312, text(30) + f" {item} " + text(9))]
    rows += [(320, None), (321, ""), (None, text(20)), (330, rows[3][1]), (330, rows[3][1])]
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], COLUMNS).coalesce(2).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item), (2, text(12))], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), dict(rows), passage


def test_stages(spark, folder):
    d, texts, passage = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    left = []
    for name, stage in P.STAGES[:-1]:
        docs = materialise(stage(spark, docs, d), name)
        assert docs.columns == COLUMNS.replace(" bigint", "").replace(" string", "").split(", ")
        left.append({r["doc_id"]: r for r in docs.collect()})
    toxic, single, cut, clean = left
    assert not any(200 <= (i or 0) < 280 for i in toxic) and set(range(200)) <= set(toxic)
    assert set(single) == set(toxic) - {300, 301, 302, 330}
    assert cut[310]["text"] == texts[310] and passage not in cut[311]["text"] and words(cut[311]["text"]) == words(texts[311].replace(passage, ""))
    assert cut[311]["n_chars"] == len(cut[311]["text"])
    assert all(cut[i]["text"] == texts[i] for i in range(200)) and {320, 321, None} <= set(cut)
    assert set(clean) == set(cut) - {312}
    packed = P.run(spark, d).toPandas()
    e = tokens.encoder(tokens.tokenizer_path())
    ids = {i: e.tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0] for i, r in clean.items()}
    assert packed["length"].sum() == sum(map(len, ids.values()))
    for r in packed[packed.doc_id.notna()].itertuples():
        part = np.array(ids[int(r.doc_id)][r.start : r.start + r.length], "<u4")
        assert zlib.crc32(part.tobytes()) == r.ids_crc32


EXTRA = COLUMNS + ", _bad bigint, _cut string, _gone int, _twice int, _of int, _spans array<int>, _words string, key string, id bigint, class_id bigint"


def test_two_runs_live_and_odd_rows(spark, folder, tmp_path):
    """A run's rows outlive another run; extra columns of any name, empty tables and long texts pass."""
    d, texts, passage = folder
    one = P.run(spark, d)
    long = " ".join(f"z{i}" for i in range(150_000))
    rows = [(1, long), (2, long + " end"), (3, None), (4, ""), (5, "plain words of no use"), (5, "another text of that id"), (None, "no id here"), (None, None)]
    full = [(i, t, "en", "s", None, 1, "c", 2, 3, 4, [5], "w", "k", 6, 7) for i, t in rows]
    spark.createDataFrame(full, EXTRA).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([], EXTRA).write.parquet(f"{tmp_path}/b/documents.parquet")
    for name in ("labels", "benchmark"):
        table = spark.read.parquet(f"{d}/{name}.parquet")
        table.write.parquet(f"{tmp_path}/a/{name}.parquet")
        table.limit(0).write.parquet(f"{tmp_path}/b/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/a/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        docs = materialise(stage(spark, docs, f"{tmp_path}/a"), name)
        assert docs.columns == spark.read.parquet(f"{tmp_path}/a/documents.parquet").columns, name
    left = sorted((r["doc_id"] or 0, r["text"] or "") for r in docs.collect())
    assert left == sorted([(0, ""), (0, "no id here"), (1, long), (3, ""), (4, ""), (5, "another text of that id")])
    assert P.run(spark, f"{tmp_path}/b").count() == 0
    assert one.agg({"length": "sum"}).first()[0] > 0 and one.count() == P.run(spark, d).count()


def test_rows_without_an_id_are_judged(spark, folder, tmp_path):
    d, texts, _ = folder
    rows = [(i, t) for i, t in texts.items() if i is not None] + [(None, texts[200]), (None, texts[312]), (None, "words of no harm")]
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k in (0, 3):
        docs = materialise(P.STAGES[k][1](spark, docs, d), "docs")
    assert [r["text"] for r in docs.where("doc_id is null").collect()] == ["words of no harm"]


def test_queries_are_registered():
    assert [name for name, _ in P.STAGES] == ["toxicity", "near_duplicates", "suffix_array_dedup", "benchmark_decontamination", "packing"]
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
