"""Packing against its promises: nothing lost, nothing split without need, little unused."""

import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as s

from strandline.llm.packing import Capacity, Limits, cut, fill_containers, pack
from strandline.llm.tokenizer import DEFAULT_VOCABULARY, TOKENIZER_DIR, count_tokens

VOCABULARY = f"{TOKENIZER_DIR}/{DEFAULT_VOCABULARY}"
needs_tokenizer = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")


@settings(max_examples=80, deadline=None)
@given(s.lists(s.integers(1, 100), max_size=120), s.integers(1, 20), s.integers(100, 10_000), s.sampled_from(["norm", "dot"]))
def test_every_constraint_holds(lengths, documents, attention, rule):
    cap = Capacity(100, documents, attention)
    pieces = sorted((n for x in lengths for _, n in cut(x, cap.longest)), reverse=True)
    where = pack(np.array(pieces, np.int64), cap, rule=rule)
    assert sum(pieces) == sum(lengths) and len(where) == len(pieces)
    for b in set(where.tolist()):
        own = [n for n, w in zip(pieces, where) if w == b]
        assert sum(own) <= 100 and len(own) <= documents and sum(n * n for n in own) <= attention


def test_as_good_as_best_fit():
    """By tokens alone the rule is best fit, checked against a direct version."""
    draw = random.Random(2)
    lengths = sorted((draw.randint(1, 512) for _ in range(800)), reverse=True)
    bins = []
    for n in lengths:
        fits = [b for b in range(len(bins)) if bins[b] >= n]
        if fits:
            bins[min(fits, key=lambda b: bins[b])] -= n
        else:
            bins.append(512 - n)
    cap = Capacity(512, 10**6, 10**9)
    assert pack(np.array(lengths), cap, weights=(1, 0, 0)).max() + 1 == len(bins)
    assert sum(lengths) / (512 * len(bins)) > 0.97


@needs_tokenizer
def test_documents_come_out_once(spark):
    draw = random.Random(3)
    docs = [(k, " ".join(draw.choice(["alpha", "beta", "x=1", "\n", "ü漢"]) for _ in range(draw.choice((0, 1, 5, 40, 900))))) for k in range(300)]
    docs += [(1000, None), (1001, ""), (1002, "   "), (None, "text"), (1003, "<|endoftext|>"), docs[5], docs[6], (1004, "word " * 40_000)]
    frame = spark.createDataFrame([(*d, 0, 0) for d in docs], "doc_id long, text string, n_tokens int, block int")
    kinds = spark.createDataFrame([(1, "a", 64), (2, "b", 512), (2, "b", 512), (3, "c", None)], "container_id int, purpose string, capacity_tokens int")
    rows = [r.asDict() for r in fill_containers(frame, kinds, block_docs=50).collect()]
    want = {k: n for (k, t), n in zip(docs, count_tokens([t for _, t in docs], VOCABULARY)) if n and k is not None}
    for container, capacity in ((1, 64), (2, 512)):
        own = [r for r in rows if r["container_id"] == container]
        bins = {}
        for r in own:
            bins.setdefault(r["sequence_id"], []).append(r)
        assert all(sum(r["n_tokens"] for r in b) <= capacity and sorted(r["slot"] for r in b) == list(range(len(b))) for b in bins.values())
        assert {r["doc_id"] for r in own} == set(want)
        for doc, n in want.items():
            pieces = sorted((r["first_token"], r["n_tokens"], r["piece"]) for r in own if r["doc_id"] == doc)
            assert [(p[0], p[1]) for p in pieces] == cut(n, capacity) and [p[2] for p in pieces] == list(range(len(pieces)))
    assert {r["container_id"] for r in rows} == {1, 2}


@needs_tokenizer
def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    kinds = spark.createDataFrame([(1, 64)], "container_id int, capacity_tokens int")
    assert fill_containers(docs, kinds).count() == 0
    one = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    assert fill_containers(one, kinds.where("false")).count() == 0


def test_attention_cost_cuts():
    assert Capacity(100, 5, 900).longest == 30
    assert cut(70, 30) == [(0, 30), (30, 30), (60, 10)]


def test_dropping_a_constraint_changes_the_packing():
    """Under a tight budget both the number of documents and the attention cost bind."""
    draw = np.random.default_rng(4)
    lengths = np.sort(np.clip(np.exp(draw.normal(4.6, 1.0, 3000)), 1, 256).astype(np.int64))[::-1]
    used = lambda limits: int(pack(lengths, limits.of(512)).max()) + 1
    tight = Limits(tokens_per_document=128, attention_share=0.25)
    assert Limits(128, 0.25).of(512) == Capacity(512, 4, 65536) and Limits(128, 0.25).of(512).longest == 256
    assert used(tight) > used(Limits(1, 0.25)) > used(Limits(1, 1.0)) and used(tight) > used(Limits(128, 1.0)) > used(Limits(1, 1.0))
    where = pack(lengths, tight.of(512))
    assert np.bincount(where).max() <= 4 and np.bincount(where, weights=lengths * lengths).max() <= 65536
    assert lengths.sum() / (512 * used(Limits())) > 0.97
