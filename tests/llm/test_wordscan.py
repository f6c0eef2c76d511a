import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.common import blocks
from tessera.llm.wordscan import Words, gram_hashes, inside, word_hash

from .helpers import NASTY, words


@given(st.lists(st.text(alphabet="aZ09 .é漢\n_", max_size=12), max_size=6))
@settings(max_examples=150, deadline=None)
def test_words_of_a_block_are_those_of_the_pattern(texts):
    w = Words(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert [w.word(j).decode() for j in range(w.first[i], w.first[i + 1])] == words(t)


def test_equal_words_have_equal_hashes_and_others_do_not():
    texts = [t or "" for _, t in NASTY]
    w = Words(pa.array(texts))
    by_word = {}
    for j in range(len(w)):
        by_word.setdefault(w.word(j), set()).add(int(w.hash[j]))
    assert all(len(v) == 1 for v in by_word.values())
    assert len({next(iter(v)) for v in by_word.values()}) == len(by_word)
    assert word_hash("mit") == next(iter(by_word[b"mit"]))


def test_grams_inside_texts():
    w = Words(pa.array(["a b c d", "", "x y", "p q r"]))
    ok = inside(w.first, 3, len(w))
    assert ok.tolist() == [True, True, False, False, False, False, True]
    assert len(gram_hashes(w.hash, 3)) == len(ok)


def test_blocks_keep_every_row_in_order_and_within_the_limit():
    rng = random.Random(3)
    texts = ["x" * rng.choice([0, 1, 50, 400]) if rng.random() < 0.9 else None for _ in range(500)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(a, min(a + 70, 500))), pa.array(texts[a : a + 70], pa.string())], ["n", "t"]) for a in range(0, 500, 70)]
    got = list(blocks(iter(batches), "t", 1000))
    assert np.concatenate([b.column("n").to_numpy() for b in got]).tolist() == list(range(500))
    assert [x for b in got for x in b.column("t").to_pylist()] == [t or "" for t in texts]
    assert max(sum(map(len, b.column("t").to_pylist())) for b in got) <= 1400
