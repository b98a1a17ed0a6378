"""Prose extraction, the classifier on held-out text, and segments."""

import random
import time

import numpy as np

from strandline.llm import language_model as lm
from strandline.llm.language_id import inverse_frequencies, language_segments, relabelled, segment, with_prose
from strandline.llm.prose import prose

#: Words of three invented languages with their own letters' habits.
WORDS = {"aa": ["tharn", "whelth", "ingth", "wharn", "thern", "lowth"], "bb": ["czesz", "przyk", "szczo", "wrzyn", "cztyn", "dzyk"], "cc": ["olanto", "rianto", "celanta", "morianto", "valente", "antola"]}
HEADER = "commit 0123456789abcdef0123456789abcdef01234567\nAuthor: Some Body <a@b.example>\nDate:   Mon Jan 6 10:00:00 2025 +0000\n\n"


def sentence(draw, lang, n=8):
    return " ".join(draw.choice(WORDS[lang]) for _ in range(n))


def test_prose():
    body = "    feat(x): The reader (`GraphEdge`) keeps the order!\n\n    > It returns early, see lib/a_b.py and foo() now.\n\n    Signed-off-by: A B <a@b.c>\n\ndiff --git a/x b/x\n--- a/x\n+the code is no prose\n"
    assert prose(HEADER + body) == "the reader keeps the order\nit returns early see and now"


def test_no_prose():
    for text in (
        None, "", "\n", "wip", "wip wip", "fix: typo", "conf/a_b.py", "Merge branch 'a/b' into main\n\nConflicts:\n\tlib/a_b.sh", 'Revert "abc: def"\n\nThis reverts commit 0123456789abcdef.',
        "chore(deps): bump abc from 1.2.3 to 1.2.4", "[skip ci] update lock file", "ci: regenerate abc fixtures [bot]", "Automatic version bump to 1.2.3", "vendor: import abc", "build #12: publish snapshot",
        "Auto-commit 1-2-3", HEADER + "    #123 data_type\n\ndiff --git a/x b/x\n+one two three four", "From: A B <a@b.c>\nDate: today\nSubject: v123\n---\n", "```\nsome code here now\n```", "x = f(1); y = g(2);",
    ):
        assert prose(text) == "", text


def test_scripts_without_blanks():
    assert prose("導入する。") == "導 入 す る"
    assert prose("docs: 导入") == ""


def test_very_long_texts_cost_linear_time():
    began = time.perf_counter()
    for unit in ("a", "/", "<", "a-", "`", "f(", "A", "a.", "> ", "[", "#1 ", "aB", "漢", "a'", "one two three. "):
        prose(unit * 100_000)
        prose("x" + " " * 100_000 + unit * 1000)
    assert time.perf_counter() - began < 20


def test_text_after_a_later_header():
    text = "One fine thing.\ndiff --git a/x b/x\n+code line here\ncommit " + "a" * 40 + "\nAuthor: X\n\n    Another fine thing.\n"
    assert prose(text) == "one fine thing\nanother fine thing"


def test_ngrams_match_definition():
    text = ["ab", "c", "defghi"]
    owner, feature = lm.ngrams(text)
    want = sum(len({(k, n) for n in lm.ORDERS for k in range(len(w) + 2 - n + 1)}) - 2 for w in text)  # single blanks aside
    assert len(owner) == len(feature) == want and sorted(set(owner.tolist())) == [0, 1, 2]
    alone = [lm.ngrams([w])[1].tolist() for w in text]
    assert [sorted(feature[owner == k].tolist()) for k in range(3)] == [sorted(a) for a in alone]


def model(seed=1, noise=0.1):
    draw = random.Random(seed)
    sentences, labels = [], []
    for _ in range(400):
        lang = draw.choice("abc") * 2
        sentences.append(sentence(draw, lang, draw.randint(3, 9)).split())
        labels.append(lang if draw.random() > noise else draw.choice("abc") * 2)
    return lm.train(sentences, labels, ["aa", "bb", "cc"], np.ones(lm.SIZE, np.float32)), draw


def test_held_out_accuracy_despite_wrong_labels():
    trained, draw = model()
    texts = [(lang, sentence(draw, lang, 5)) for lang in ("aa", "bb", "cc") for _ in range(60)]
    found = segment(trained, [t for _, t in texts])
    assert np.mean([f[1] == lang for (lang, _), f in zip(texts, found)]) > 0.97
    assert all(0 <= c <= 1 for f in found for _, c, _ in f[0])


def test_segments_between_and_inside_sentences():
    trained, draw = model(2)
    for border in ("\n", " "):
        text = border.join(sentence(draw, lang) for lang in ("aa", "bb", "aa", "cc"))
        (own, _, _), = segment(trained, [text])
        assert [o[0] for o in own] == ["aa", "bb", "aa", "cc"] and sum(o[2] for o in own) == 32
    mixed = sentence(draw, "aa") + " czesz " + sentence(draw, "aa")
    assert [o[0] for o in segment(trained, [mixed])[0][0]] == ["aa"]


DOCS = "doc_id long, lang string, text string, label string, prose string"


def test_one_very_long_text_among_short_ones():
    trained, draw = model(4)
    texts = [sentence(draw, "aa") for _ in range(600)] + ["\n".join(sentence(draw, "bb") for _ in range(5000))]
    found = segment(trained, texts)
    assert [f[0][0][0] for f in found] == ["aa"] * 600 + ["bb"] and len(found[-1][0]) == 1


def test_operator(spark):
    draw = random.Random(3)
    rows = []
    for k in range(1, 241):
        lang = ("aa", "bb", "cc")[k % 3]
        other = ("bb", "cc", "aa")[k % 3]
        text = HEADER + "    " + ". ".join(sentence(draw, lang) for _ in range(3)) + "."
        if k % 10 == 0:
            text += "\n\n    " + sentence(draw, other) + "."
        rows.append((k, None if k % 7 == 0 else "??" if k % 11 == 0 else other if k % 13 == 0 else lang.upper(), text, None, None))
    extra = [(900, "AA", None, None, None), (901, None, "wip", None, None), (902, "AA", "", None, None), (None, "AA", rows[0][2], None, None), rows[4]]
    codes = spark.createDataFrame([(x, c) for c in ("aa", "bb", "cc") for x in (c, c.upper())], "label string, lang string")
    segments = language_segments(spark.createDataFrame(rows + extra, DOCS), codes)
    got = {}
    for r in relabelled(segments, codes).orderBy("doc_id", "seg_no").collect():
        got.setdefault(r["doc_id"], []).append(r["lang"])
        assert r["seg_no"] == len(got[r["doc_id"]]) and 0 <= r["confidence"] <= 1
    want = {}
    for k in range(1, 241):
        lang, other = ("aa", "bb", "cc")[k % 3], ("bb", "cc", "aa")[k % 3]
        if k % 10 == 0 or k % 7 == 0 or k % 11 == 0 or k % 13 == 0:
            want[k] = [lang, other] if k % 10 == 0 else [lang]
    assert got == want


def test_without_labels_or_rows(spark):
    codes = spark.createDataFrame([("aa", "aa")], "label string, lang string")
    docs = spark.createDataFrame([(1, None, "some words here", None, None)], DOCS)
    assert language_segments(docs, codes).count() == 0
    assert language_segments(docs.where("false"), codes).count() == 0
    assert language_segments(docs, codes.where("false")).count() == 0


def test_frequencies_count_documents(spark):
    docs = spark.createDataFrame([(1, None, "alpha beta alpha", None, None), (2, None, "alpha gamma words", None, None)], DOCS)
    idf = inverse_frequencies(with_prose(docs))
    assert idf[lm.ngrams(["alpha"])[1]].min() < idf[lm.ngrams(["gamma"])[1]].max()


def test_more_languages_than_a_byte_holds():
    """Indexes of languages stay whole beyond 127."""
    emit = np.full((6, 200), -9.0, np.float32)
    emit[:3, 150], emit[3:, 199] = 0, 0
    model = lm.LanguageModel([f"l{k}" for k in range(200)], np.zeros(0, np.int64), np.zeros((1, 200), np.float32), np.zeros(lm.SIZE, np.float32), 1.0, 1.0, [])
    assert model.decode(emit, np.array([0]), np.ones(6, np.float32)).tolist() == [150] * 3 + [199] * 3


def test_calibration_bins():
    p = np.array([[0.9, 0.1], [0.94, 0.06], [0.4, 0.6], [1.0, 0.0]])
    found = lm.calibration_bins(p, np.array([0, 1, 1, 0]))
    assert [(round(b, 1), n, round(c, 3), round(r, 3)) for b, n, c, r in found] == [(0.7, 1, 0.6, 1.0), (1.0, 3, 0.947, 0.667)]
