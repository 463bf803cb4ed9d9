from __future__ import annotations

import random
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrylight.llm.bpe import PATTERN, TOKENIZER_DIR, VOCABULARY, count_tokens, encode, tokenizer
from quarrylight.llm.packing import fill, pack

PATH = f"{TOKENIZER_DIR}/{VOCABULARY}"
needs_vocabulary = pytest.mark.skipif(not Path(PATH).exists(), reason="no vocabulary here")
TEXTS = [None, "", " ", "Hello world", "größer\r\n\tkód  世界 🙂", "a" * 5000, "x = 1\n\n\n    y", "don't I'LL", "\u200b\u00a0 zero", "𝔘𝔫𝔦 é e\u0301"]


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=tokenizer(PATH).ranks, special_tokens={})


@needs_vocabulary
def test_same_ids_as_the_library(reference):
    bpe = tokenizer(PATH)
    for text in TEXTS:
        assert bpe.encode(text) == reference.encode_ordinary(text or "")


@needs_vocabulary
@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_round_trip(text):
    bpe = tokenizer(PATH)
    assert bpe.decode(bpe.encode(text)) == text


@needs_vocabulary
def test_encode_rows(spark, reference):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, None, "x"), (99, "same", "x"), (99, "same", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r.doc_id, list(r.ids)) for r in encode(df).collect())
    assert got == sorted((i, reference.encode_ordinary(t or "")) for i, t, _ in rows)
    counts = sorted((r.doc_id, r.n_tokens) for r in count_tokens(df).collect())
    assert counts == [(i, len(x)) for i, x in got]
    assert encode(spark.createDataFrame([], df.schema)).count() == 0


def check(sizes, capacity):
    into = pack(np.array(sizes, np.int64), capacity)
    used = np.bincount(into, weights=sizes, minlength=1) if len(sizes) else np.zeros(1)
    assert len(into) == len(sizes) and used.max() <= capacity
    return used


def test_packing_bounds():
    r = random.Random(1)
    for capacity in (10, 100, 512):
        sizes = [min(capacity, int(r.expovariate(4 / capacity))) for _ in range(2000)]
        used = check(sizes, capacity)
        assert len(used) <= 1.05 * sum(sizes) / capacity + 1
    assert check([], 10).tolist() == [0]
    assert len(check([10] * 5, 10)) == 5
    assert len(check([0, 0], 10)) == 1
    assert len(check([6, 4, 6, 4], 10)) == 2


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 20), max_size=40))
def test_packing_never_overflows_and_beats_first_come(sizes):
    used = check(sizes, 20)
    bins = np.count_nonzero(used)
    assert bins <= max(1, 2 * -(-sum(sizes) // 20))


def test_fill_splits_only_what_exceeds_the_capacity(spark):
    rows = [(1, 25, "x"), (2, 10, "x"), (3, 0, "x"), (4, None, "x"), (5, 3, "x"), (6, 3, "x"), (7, 20, "x")]
    items = spark.createDataFrame(rows, "doc_id long, n_tokens int, piece string")
    out = fill(items, [("small", 10), ("large", 100)]).collect()
    for kind, capacity in (("small", 10), ("large", 100)):
        mine = [r for r in out if r.container_type == kind]
        used = {}
        for r in mine:
            used[r.container_id] = used.get(r.container_id, 0) + r.n_tokens
        assert max(used.values()) <= capacity
        for i, n, _ in rows:
            pieces = sorted((r.first_token, r.n_tokens) for r in mine if r.doc_id == i)
            assert sum(p[1] for p in pieces) == (n or 0) and len(pieces) == max(1, -(-(n or 0) // capacity))
            assert [p[0] for p in pieces] == [k * capacity for k in range(len(pieces))]
    assert len({r.container_id for r in out if r.container_type == "large"}) == 1
    assert fill(items.limit(0), [("small", 10)]).count() == 0 and fill(items, [("small", 10)], slots=4).count() == 10


def test_independent_classes_have_a_fixed_number_of_items(spark):
    from collections import Counter

    from quarrylight.llm.packing import fill, pack_class

    assert pack_class(np.array([300, 300, 290, 270]), 1000).tolist() == [0, 0, 0, 1] and pack_class(np.array([], np.int64), 10).tolist() == [] and pack_class(np.array([0, 0]), 10).tolist() == [0, 0]
    rows = [(i, (i * 37) % 1500) for i in range(300)] + [(900, None), (901, 0)]
    items = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    out = fill(items, [("a", 1000), ("b", 64)], leftovers=False).collect()
    assert {r.doc_id for r in out} == {r[0] for r in rows}
    for kind, capacity in (("a", 1000), ("b", 64)):
        mine = [r for r in out if r.container_type == kind]
        assert sum(r.n_tokens for r in mine) == sum(n or 0 for _, n in rows)
        boxes = {}
        for r in mine:
            boxes.setdefault(r.container_id, []).append(r.n_tokens)
        short = Counter()
        for sizes in boxes.values():
            assert sum(sizes) <= capacity
            classes = {capacity // n for n in sizes if n}
            assert len(classes) <= 1
            if classes and len(sizes) < (k := classes.pop()):
                short[k] += 1
        assert all(n <= 1 for n in short.values())  # one open container a class and slot
