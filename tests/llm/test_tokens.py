import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import packing, tokens, wavelet

from .helpers import NASTY, docs_frame


@pytest.fixture(scope="module")
def expected():
    e = tokens.encoder(tokens.tokenizer_path())
    return [(i, e.tokenizer.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in NASTY]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_block_encoding_equals_the_library():
    rng = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "'s", "'re", "'", "1", "2.", "é", "ß", "×", "«", " ", "“", "漢", "<|endoftext|>", "\t", "!", "_", "'ll", "S", "\x0b", "²", "ª", "$$", "don't"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    plain = [t for t in texts if t.isascii() and "<" not in t and "\x0b" not in t]
    e = tokens.encoder(tokens.tokenizer_path())
    for some in (texts, plain, [""], ["", "a"]):
        ids, cut = e.encode(pa.array(some, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(cut, cut[1:], strict=False)] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in some]


def test_packing_covers_every_id_once(spark, expected):
    p = packing.pack(docs_frame(spark, NASTY), with_ids=True).toPandas()
    assert p["length"].sum() == sum(len(x) for _, x in expected)
    by_crc = sorted((-1 if i is None else i, a, crc(x[a : a + 1024]), len(x)) for i, x in expected for a in range(0, len(x), 1024))
    assert sorted((-1 if r.doc_id != r.doc_id else int(r.doc_id), r.start, r.ids_crc32, r.doc_tokens) for r in p.itertuples()) == by_crc
    assert all(crc(np.frombuffer(r.ids, "<u4")) == r.ids_crc32 for r in p.itertuples())
    for _, s in p.sort_values("offset").groupby("sequence_id"):
        assert (s["offset"] == s["length"].cumsum() - s["length"]).all() and s["length"].sum() <= 1024
    assert packing.pack(docs_frame(spark, [])).count() == 0


def test_sequences_hold_the_pieces_and_padding(spark):
    packed = packing.pack(docs_frame(spark, NASTY), with_ids=True)
    for r in packing.sequences(packed).collect():
        n = len(r["ids"]) // 4
        assert n == 1024 or n == r["n_ids"] and n & (n - 1) == 0


def test_shortest_pack_first():
    rng = random.Random(2)
    for _ in range(50):
        h = {rng.randint(1, 64): rng.randint(1, 40) for _ in range(rng.randint(1, 30))}
        packs = packing.shortest_pack_first(h, 64)
        back = {}
        for pattern, n in packs:
            assert sum(pattern) <= 64
            for x in pattern:
                back[x] = back.get(x, 0) + n
        assert back == h
        for size, lo, hi, _, _ in packing.slots(packs):
            assert 0 <= lo < hi <= h[size]
    even = {n: 100 for n in range(1, 1024)}
    packs = packing.shortest_pack_first(even)
    assert packing.padding(packs) < 0.01 * sum(n * c for n, c in even.items())


def test_token_files_round_trip(spark, expected):
    files = wavelet.write_token_files(docs_frame(spark, NASTY), file_ids=1 << 12)
    rows = wavelet.read_token_files(files, with_ids=True).orderBy("start").collect()
    ids = [(r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in rows]
    assert sorted(ids, key=str) == sorted(expected, key=str)
    assert [r["doc_id"] for r in rows] == sorted((i for i, _ in expected), key=lambda i: (i is not None, i))
    start = 0
    for r in rows:
        assert (r["start"], r["ids_crc32"]) == (start, crc(np.frombuffer(r["ids"], "<u4")))
        start += r["n_tokens"]
    assert wavelet.read_token_files(wavelet.write_token_files(docs_frame(spark, []))).count() == 0
    assert files.where(F.col("n_ids") == 0).count() == 0


@pytest.mark.parametrize(("n", "levels"), [(1, 1), (5, 3), (513, 9), (5000, 16), (4096, 17)])
def test_wavelet_matrix(n, levels):
    a = np.random.default_rng(n).integers(0, 1 << levels, n) if n > 1 else np.array([1])
    a[: n // 3] = a[0]
    m, ids, starts = wavelet.from_file(wavelet.to_file(a, np.array([4]), np.array([0, n]), levels))
    assert (ids.tolist(), starts.tolist()) == ([4], [0, n])
    assert (m.decode() == a).all()
    assert all(m.access(i) == a[i] for i in range(0, n, 37))
    for s in {int(a[0]), int(a[-1]), 0}:
        assert m.count(s) == (a == s).sum()
        assert m.rank(s, n // 2) == (a[: n // 2] == s).sum()
        assert m.locate(s)[:20] == np.flatnonzero(a == s).tolist()[:20] if (a == s).sum() < 50 else True
        if (a == s).any():
            assert m.select(s, int((a == s).sum()) - 1) == np.flatnonzero(a == s)[-1]
    with pytest.raises(IndexError):
        m.select(int(a[0]), n + 1)
