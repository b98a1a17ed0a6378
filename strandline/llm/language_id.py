"""Languages of documents and of the segments of their message prose, with confidence.

Method: sparse multinomial logistic regression on TF-IDF character n-grams, trained with
follow-the-regularised-leader and elastic-net penalties and calibrated by temperature; a path over
word evidence with a price for changes gives the segments.

The classifier is fitted on a bounded sample: at most ``SAMPLE_DOCS`` labelled documents per language
and ``SAMPLE_SENTENCES`` sentences of each.  Document frequencies come from all documents.

Scale: texts are read once and reduced to their prose; the model is a broadcast of at most 2**18
rows.  Word counts are combined before their shuffle, and only sums per hashed feature, at most 2**18,
reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import language_model as lm
from strandline.llm.prose import is_unspaced, prose
from strandline.workspace import materialise

SAMPLE_DOCS = 300
SAMPLE_SENTENCES = 12
SENTENCE_WORDS = (3, 60)  #: training sentences have so many words
SENTENCE_CHARS = 1000  #: and are drawn from so many characters, which bounds the sample
MAX_CODES = 10_000  #: notations of language labels
SEGMENTS = "doc_id long, label string, seg_no long, lang string, confidence double, n_words long, n_segments long, doc_lang string, doc_confidence double"


def with_prose(documents: DataFrame) -> DataFrame:
    """``doc_id, label, prose`` of the documents that have prose; repeated rows count once."""

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = pd.Series([prose(t if isinstance(t, str) else None) for t in batch["text"]], index=batch.index, dtype=object)
            yield batch[["doc_id", "label"]].assign(prose=found)[found != ""]

    slim = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("lang").alias("label"), "text")
    return slim.mapInPandas(extract, "doc_id long, label string, prose string").dropDuplicates()


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """IDF of every hashed feature: how many pairs of document and word contain it."""
    words = texts.select(F.explode(F.array_distinct(F.split("prose", r"\s+"))).alias("word")).groupBy("word").count()

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            owner, feature = lm.ngrams(batch["word"].tolist())
            pair = np.unique(owner * lm.SIZE + feature)
            total = np.bincount(pair % lm.SIZE, weights=batch["count"].to_numpy()[pair // lm.SIZE], minlength=lm.SIZE)
            live = np.flatnonzero(total)
            yield pd.DataFrame({"feature": live, "n": total[live].astype(np.int64)})

    sums = words.mapInPandas(features, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    n_docs = texts.count()
    df = np.zeros(lm.SIZE)
    df[sums["feature"].to_numpy()] = sums["n"].to_numpy()
    return np.where(df > 0, np.log((1 + n_docs) / (1 + np.minimum(df, n_docs))) + 1, 0).astype(np.float32)


def training_sentences(texts: DataFrame, codes: dict[str, str]) -> tuple[list[list[str]], list[str]]:
    """Sentences and label codes of the bounded sample, drawn by hash and alike on every run."""
    label = F.col("label")
    listed = texts.where(label.isin(list(codes)))
    listed = listed.withColumn("code", F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])[label])
    counts = {r["code"]: r["count"] for r in listed.groupBy("code").count().collect()}  # one row per language
    share = F.lit(0)
    for code, n in counts.items():
        share = F.when(F.col("code") == code, min(1.0, 1.5 * SAMPLE_DOCS / n)).otherwise(share)
    rank = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30))
    drawn = listed.withColumn("rank", rank).where(F.col("rank") < share * (1 << 30))
    rows = drawn.select("code", "rank", "doc_id", F.transform(F.slice(F.split("prose", "\n"), 1, SAMPLE_SENTENCES), lambda x: F.substring(x, 1, SENTENCE_CHARS)).alias("s")).collect()
    sentences, labels, taken = [], [], dict.fromkeys(counts, 0)
    for r in sorted(rows, key=lambda r: (r["code"], r["rank"], r["doc_id"])):
        if taken[r["code"]] < SAMPLE_DOCS:
            taken[r["code"]] += 1
            for s in r["s"]:
                own = s.split()[: SENTENCE_WORDS[1]]
                if len(own) >= SENTENCE_WORDS[0]:
                    sentences.append(own)
                    labels.append(r["code"])
    return sentences, labels


def segment(model: lm.LanguageModel, texts: list[str]) -> list[tuple[list[tuple[str, float, int]], str, float]]:
    """Per prose text its segments (language, confidence, words), and language and confidence of all."""
    vocabulary: dict[str, int] = {}
    ids, start, cost = [], [], []
    for text in texts:
        start.append(len(ids))
        for sentence in text.split("\n"):
            last = False
            for k, word in enumerate(sentence.split()):
                ids.append(vocabulary.setdefault(word, len(vocabulary)))
                now = is_unspaced(word)
                cost.append(lm.SWITCH_AT_BORDER if k == 0 else lm.SWITCH_BETWEEN_LETTERS if now and last else lm.SWITCH_INSIDE)
                last = now
    scores, energy = model.word_scores(list(vocabulary))
    at = np.array(ids, np.int64)
    first, stop = np.array(start, np.int64), np.append(start[1:], len(ids)).astype(np.int64)
    path = model.decode(model.word_evidence(scores, energy)[at], first, np.array(cost, np.float32))
    opens = np.ones(len(path), bool)
    opens[1:] = path[1:] != path[:-1]
    opens[first] = True
    cuts = np.flatnonzero(opens)
    sums, powers = np.add.reduceat(scores[at], cuts, axis=0), np.add.reduceat(energy[at], cuts)
    sure = model.probabilities(sums, powers)
    whole = model.probabilities(np.add.reduceat(scores[at], first, axis=0), np.add.reduceat(energy[at], first))
    size = np.diff(np.append(cuts, len(path)))
    begin, end = np.searchsorted(cuts, first), np.searchsorted(cuts, stop)
    out = []
    for k in range(len(texts)):
        own = [(model.languages[path[cuts[c]]], float(sure[c, path[cuts[c]]]), int(size[c])) for c in range(begin[k], end[k])]
        top = int(whole[k].argmax())
        out.append((own, model.languages[top], float(whole[k, top])))
    return out


def fitted(texts: DataFrame, lang_codes: DataFrame) -> lm.LanguageModel | None:
    """The model of the bounded sample; None without a labelled text.  More than MAX_CODES notations raise ValueError."""
    pairs = lang_codes.where("label is not null and lang is not null").dropDuplicates(["label"]).limit(MAX_CODES + 1).collect()
    if len(pairs) > MAX_CODES:
        raise ValueError(f"more than {MAX_CODES} notations of languages")
    codes = {r["label"]: r["lang"] for r in pairs}
    sentences, labels = training_sentences(texts, codes) if codes else ([], [])
    return lm.train(sentences, labels, sorted(set(codes.values())), inverse_frequencies(texts)) if sentences else None


def calibration(documents: DataFrame, lang_codes: DataFrame) -> DataFrame:
    """``confidence_to, n, mean_confidence, share_right``: confidence against the truth on held-out spans of one to four words."""
    model = fitted(materialise(with_prose(documents), "prose"), lang_codes)
    return documents.sparkSession.createDataFrame(model.calibration if model else [], "confidence_to double, n long, mean_confidence double, share_right double")


def language_segments(documents: DataFrame, lang_codes: DataFrame) -> DataFrame:
    """One row per segment of prose: see ``SEGMENTS``; ``label`` is the label as delivered.

    ``documents`` has doc_id, text and lang, ``lang_codes`` label and lang.  Segments are numbered from
    1.  Documents without prose, null ids and null or empty texts yield nothing, repeated rows count
    once; without a single labelled document there is no model and no rows.
    """
    spark = documents.sparkSession
    texts = materialise(with_prose(documents), "prose")
    model = fitted(texts, lang_codes)
    if model is None:
        return spark.createDataFrame([], SEGMENTS)
    shared = spark.sparkContext.broadcast(model)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            rows = []
            for doc, label, (own, lang, sure) in zip(batch["doc_id"], batch["label"], segment(shared.value, batch["prose"].tolist())):
                rows += [(doc, label, k, *s, len(own), lang, sure) for k, s in enumerate(own, 1)]
            yield pd.DataFrame(rows, columns=["doc_id", "label", "seg_no", "lang", "confidence", "n_words", "n_segments", "doc_lang", "doc_confidence"])

    return texts.mapInPandas(decode, SEGMENTS)


def relabelled(segments: DataFrame, lang_codes: DataFrame) -> DataFrame:
    """The segments of documents whose label is missing, names no or another language, or hides several."""
    codes = lang_codes.where("label is not null").groupBy("label").agg(F.min("lang").alias("meant"))
    known = segments.join(codes, "label", "left")
    return known.where(F.col("meant").isNull() | (F.col("n_segments") > 1) | (F.col("meant") != F.col("lang")))
