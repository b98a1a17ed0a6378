"""Leaks against brute force over all windows, and the alignment against its definition."""

import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as s

from strandline.llm.alignment import nearly_verbatim, smith_waterman
from strandline.llm.contamination import WINDOW, choose_seeds, item_words, leaked_items, shared_edges, word_hashes, words

ids = s.lists(s.integers(0, 5), min_size=1, max_size=14)


def plain_alignment(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (1 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def plain_window(item, doc, window):
    """Some window of the item within edit distance one of some stretch of the document."""
    for i in range(len(item) - window + 1):
        want = item[i : i + window]
        for j in range(len(doc) + 1):
            for size in (window - 1, window, window + 1):
                got = doc[j : j + size]
                if len(got) != size:
                    continue
                k = next((k for k, (x, y) in enumerate(zip(want, got)) if x != y), min(len(want), size))
                if want[k + (size <= window) :] == got[k + (size >= window) :] or want == got:
                    return True
    return False


@settings(max_examples=150, deadline=None)
@given(s.lists(s.tuples(ids, ids), min_size=1, max_size=4))
def test_alignment(pairs):
    a, b = [np.array(x) for x, _ in pairs], [np.array(y) for _, y in pairs]
    assert smith_waterman(a, b).tolist() == [plain_alignment(x, y) for x, y in pairs]


@settings(max_examples=300, deadline=None)
@given(s.lists(s.integers(0, 2), min_size=4, max_size=12), s.lists(s.integers(0, 2), min_size=1, max_size=12))
def test_nearly_verbatim(item, doc):
    assert bool(nearly_verbatim([np.array(item)], [np.array(doc)], 4)[0]) == plain_window(item, doc, 4)


def corpus(seed):
    draw = random.Random(seed)
    bank = [f"w{k}" for k in range(60)]
    items = {k: [draw.choice(bank) for _ in range(draw.choice((10, 15, 16, 40)))] for k in range(1, 40)}
    docs = {}
    for k in range(1, 700):
        own = draw.choice(list(items.values()))
        at = draw.randrange(len(own))
        piece = own[at : at + draw.choice((8, 13, 14, 15, 16, 20, 40))]
        for _ in range(draw.choice((0, 0, 1, 1, 2, 3))):
            if piece:
                p = draw.randrange(len(piece))
                piece = draw.choice([piece[:p] + ["new"] + piece[p + 1 :], piece[:p] + piece[p + 1 :], [*piece[:p], draw.choice(bank), *piece[p:]]])
        noise = lambda: [draw.choice([*bank, "other", "thing"]) for _ in range(draw.randrange(12))]  # noqa: B023, E731
        docs[k] = noise() + piece + noise()
    return items, docs, draw


def test_against_brute_force(spark):
    items, docs, draw = corpus(5)
    spell = lambda ws: "".join(draw.choice([w, w.upper()]) + draw.choice([" ", "\n+ ", ", ", "\n// ", "  ", '" ']) for w in ws)
    want = {(d, i) for d, text in docs.items() for i, item in items.items() if plain_window(item, text, WINDOW)}
    rows = [(d, spell(t)) for d, t in docs.items()]
    frame = spark.createDataFrame([*rows, rows[0], (900, None), (901, ""), (None, "x")], "doc_id long, text string")
    tests = spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()] + [(800, None), (801, "")], "item_id long, text string")
    got = [(r["doc_id"], r["item_id"]) for r in leaked_items(frame, tests).where("verbatim").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert len(want) > 50


def test_shared_instruction_does_not_count(spark):
    instruction = "Read the change described below and answer with one short sentence without quoting any of the code."
    own = [" ".join(f"{c}{k}" for k in range(30)) + "." for c in "abc"]
    tests = spark.createDataFrame([(k, f"{instruction} {o}") for k, o in enumerate(own)] + [(7, own[0])], "item_id long, text string")
    docs = spark.createDataFrame([(1, instruction + " " + own[1][:8]), (2, "x " + own[1]), (3, instruction + " " + own[0])], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leaked_items(docs, tests).where("verbatim").collect()}
    assert got == {(2, 1), (3, 0), (3, 7)}


def test_shared_endings_of_sentences(spark):
    """Endings count like beginnings; a long item costs linear time."""
    ending = "Answer in one short sentence and do not quote any of the words above."
    own = [" ".join(f"{c}{k}" for k in range(20)) + ". " for c in "abc"]
    rows = [(k, o + ending) for k, o in enumerate(own)] + [(3, "one two three. " * 30_000)]
    found = {r["item_id"]: (r["head"], r["tail"]) for r in shared_edges(spark.createDataFrame(rows, "item_id long, text string")).collect()}
    assert found == {k: (None, 14) for k in range(3)}


def test_shared_passages_are_content(spark):
    """A passage that two items share, or a long one that many share, leaks for all of them."""
    passage = " ".join(f"p{k}" for k in range(60)) + "."
    tests = [(k, f"{passage} What does q{k} hold at the end of the day?") for k in (1, 2)] + [(k, f"{passage} {' '.join(f'r{k}x{j}' for j in range(20))}.") for k in (3, 4)]
    docs = spark.createDataFrame([(1, "before " + passage + " after")], "doc_id long, text string")
    got = leaked_items(docs, spark.createDataFrame(tests, "item_id long, text string")).where("verbatim").collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 1), (1, 2), (1, 3), (1, 4)}


def test_common_phrases_are_still_found(spark):
    """Items that share all but a name, in documents that make every n-gram common."""
    tests = [(k, f"how many spools does {chr(97 + k)}x hold at the end and who has to flush them again") for k in range(26)]
    docs = [(k, "how many spools does zz hold at the end and who has to flush them") for k in range(40)] + [(99, "how many spools")]
    got = leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(tests, "item_id long, text string")).where("verbatim").collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(d, i) for d in range(40) for i in range(26)}


@settings(max_examples=100, deadline=None)
@given(s.lists(s.sampled_from([0, 1, 40, 50, 1000, 5000]), min_size=WINDOW - 3, max_size=60))
def test_seeds_are_complete(costs):
    """Every window with any one word edited keeps a seed, unless some n-gram that stays stands nowhere."""
    chosen = choose_seeds(np.array(costs))
    for start in range(len(costs) + 4 - WINDOW):
        for edit in range(WINDOW):
            stay = [start + k for k in range(WINDOW - 3) if k + 4 <= edit or k > edit]
            assert any(costs[k] == 0 or chosen[k] for k in stay)


def test_words_of_arrow_and_python_agree(spark):
    texts = ["", None, "Über_Maß  'x' 12½\n+ 日本語 foo", "  lead", "trail!! "]
    hashes, bounds = word_hashes(pa.array(texts))
    plain = [words(t or "") for t in texts]
    assert np.diff(bounds).tolist() == [len(p) for p in plain]
    assert hashes.tolist() == word_hashes(pa.array([" ".join(p) for p in plain]))[0].tolist()


def edited(own, every, draw):
    """A copy with one word in ``every`` replaced, dropped or doubled with another."""
    out, k = [], draw.randrange(every)
    for n, word in enumerate(own):
        if n % every != k:
            out.append(word)
            continue
        out += draw.choice([[f"new{draw.randrange(10**6)}"], [], [word, f"new{draw.randrange(10**6)}"]])
    return out


def test_recall_of_edited_copies(spark):
    """Copies with an edit every 5, 7 and 10 words are scored; unrelated texts of the same words aren't."""
    draw = random.Random(11)
    bank = [f"w{k}" for k in range(400)]
    own = {k: [draw.choice(bank) for _ in range(70)] for k in range(60)}
    docs = {(k, every): edited(text, every, draw) for k, text in own.items() for every in (5, 7, 10)}
    noise = [" ".join(draw.choice(bank) for _ in range(150)) for _ in range(300)]
    ids = {n: key for n, key in enumerate(docs)}
    rows = [(n, " ".join(["lead"] * 9 + docs[key])) for n, key in ids.items()] + [(10_000 + n, t) for n, t in enumerate(noise)]
    got = leaked_items(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(t)) for k, t in own.items()], "item_id long, text string")).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in got}
    for every in (5, 7, 10):
        recall = sum((n, k) in pairs for n, (k, e) in ids.items() if e == every) / len(own)
        assert recall >= 0.9, (every, recall)
    right = sum(d < 10_000 and ids[d][0] == i for d, i in pairs)
    assert right / len(pairs) >= 0.9


def test_texts_of_one_word_cost_linear_time(spark):
    docs = spark.createDataFrame([(1, "same " * 20_000)], "doc_id long, text string")
    tests = spark.createDataFrame([(1, "same " * 300)], "item_id long, text string")
    assert [tuple(r)[:2] for r in leaked_items(docs, tests).where("verbatim").collect()] == [(1, 1)]


def test_item_words_without_instruction(spark):
    rows = [(k, "Read this and answer all of it in short. " + " ".join(f"{c}{j}" for j in range(20))) for k, c in enumerate("abc")]
    assert {len(r["words"]) for r in item_words(spark.createDataFrame(rows, "item_id long, text string")).collect()} == {20}


def test_long_text_and_empty_tables(spark):
    item = " ".join(f"q{k}" for k in range(400))
    docs = spark.createDataFrame([(1, "filler " * 200_000 + item + " filler" * 1000)], "doc_id long, text string")
    tests = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [tuple(r)[:2] for r in leaked_items(docs, tests).collect()] == [(1, 1)]
    assert leaked_items(docs.where("false"), tests).count() == 0 and leaked_items(docs, tests.where("false")).count() == 0
