"""Evaluation texts leaking into training text.

Method: rare n-gram seeds join the passages of the corpus to the test items; Smith-Waterman alignment
then scores every candidate, edited copies included, and an exact test tells which of them hold a window
of an item's words nearly verbatim.

Rarity is counted over the whole corpus: the scan keeps every passage that holds an n-gram of any item,
and of an item's n-grams those become seeds that stand in few passages, or in not many more than
the item's own rarest ones do.  Seeds are complete: where only common n-grams would outlive an edit of
a window, the rarest of them is a seed as well; n-grams that stand nowhere need none.

Scale: the corpus is read once, whatever the number of items, and never shuffled; a bitmap of the items'
n-grams, of bounded size, is all that is sent to the scan.  What is shuffled are hits.  Seeds meet hits by
a shuffled join with hot seeds spread over salts.  Within a passage of bounded length a repeated n-gram is
one row, so a text of one word costs linear time.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.alignment import nearly_verbatim, smith_waterman
from strandline.plans.skew import join_counted, join_salted
from strandline.workspace import materialise

WINDOW = 15  #: successive words of an item
SEED = 4  #: words of a seed: what stays whole where every fifth word is edited
RARE = 32  #: a seed in so many passages, times items, is rare
RARE_FACTOR = 8  #: and so is one in so many times as many as the rarer quarter of its item's
MIN_SCORE = WINDOW - 2  #: what a window with one word replaced scores
INSTRUCTION_WORDS = (8, 40)  #: an instruction has so many words
INSTRUCTION_ITEMS = 3  #: and stands at the same end of so many items of unequal text at least
MAX_FILTER_BITS = 1 << 29  #: 64 MB
_REACH = 24  #: words around a hit that its alignment sees
_CELL = 256  #: positions of one passage
_BATCH = 64

_WORD = re.compile(r"[^\W_]+")
_NO_WORD = r"[^\p{L}\p{N}]+"  # the same for Arrow's expressions
_SENTENCE_END = re.compile(r"[.!?:](?=\s|$)|[\r\n]+|[。！？]")

SCORES = "doc_id long, item_id long, score int, verbatim boolean"
_LONGS = pa.list_(pa.int64())


def words(text: str) -> list[str]:
    """Runs of letters and digits in lower case."""
    return [w.lower() for w in _WORD.findall(text)]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts end to end, and where each text begins and the last ends."""
    pieces = pc.split_pattern_regex(pc.fill_null(texts, ""), _NO_WORD)
    coded = pieces.flatten().dictionary_encode()
    spelt = coded.dictionary.to_pylist()
    known = np.fromiter((xxhash.xxh64_intdigest(w.lower()) for w in spelt), np.uint64, len(spelt))
    real = np.fromiter((w != "" for w in spelt), bool, len(spelt))
    ids = coded.indices.to_numpy()
    offsets = pieces.offsets.to_numpy() - (pieces.offsets[0].as_py() if len(pieces) else 0)
    keep = real[ids] if len(ids) else np.zeros(0, bool)
    before = np.concatenate([[0], np.cumsum(keep)])
    return (known[ids[keep]] if len(ids) else np.zeros(0, np.uint64)), before[offsets]


def seed_hashes(own: np.ndarray) -> np.ndarray:
    """64-bit hashes of the SEED words from each position on."""
    m = max(len(own) - SEED + 1, 0)
    out = np.zeros(m, np.uint64)
    for k in range(SEED):
        out = out * np.uint64(0x9E3779B97F4A7C15) + own[k : k + m] + np.uint64(1)
        out ^= out >> np.uint64(29)
    return out


def filter_bits(hashes: np.ndarray, n_bits: int) -> np.ndarray:
    """The three bits of each hash in a filter of ``n_bits``, a power of two: (3, hashes)."""
    mask = np.uint64(n_bits - 1)
    return np.stack([hashes & mask, (hashes >> np.uint64(32)) & mask, ((hashes * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(31)) & mask]).astype(np.int64)


def in_filter(hashes: np.ndarray, bits: np.ndarray, n_bits: int) -> np.ndarray:
    """Positions of the hashes whose bits are all set."""
    at = np.arange(len(hashes))
    for k in range(3):
        own = filter_bits(hashes[at], n_bits)[k]
        at = at[(bits[own >> 3] >> (own & 7).astype(np.uint8)) & 1 == 1]
    return at


# --- items ----------------------------------------------------------------------------------------


def _running_hashes(own: list[str], at: set[int]) -> dict[int, str]:
    """Hashes of the first n words for every n asked for, in one pass."""
    state, out = hashlib.blake2b(digest_size=16), {}
    for n, word in enumerate(own, 1):
        state.update(word.encode("utf-8", "surrogatepass") + b"\x1f")
        if n in at:
            out[n] = state.hexdigest()
    return out


def _edges_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per item its beginnings and endings of whole sentences: how many words, and their hashes."""
    low, high = INSTRUCTION_WORDS
    for batch in batches:
        rows = []
        for item, text in zip(batch["item_id"], batch["text"]):
            own, ends = words(text), [m.end() for m in _WORD.finditer(text)]
            cuts = {bisect_right(ends, m.end()) for m in _SENTENCE_END.finditer(text)}
            whole = _running_hashes(own, {len(own)}).get(len(own), "")
            heads = _running_hashes(own[:high], {c for c in cuts if low <= c <= high})
            tails = _running_hashes(own[::-1][:high], {len(own) - c for c in cuts if low <= len(own) - c <= high})
            rows += [(item, whole, side, n, h) for side, found in (("head", heads), ("tail", tails)) for n, h in found.items()]
        yield pd.DataFrame(rows, columns=["item_id", "whole", "side", "n", "edge"])


def shared_edges(items: DataFrame) -> DataFrame:
    """``item_id, head, tail``: words of the instruction at either end.

    An instruction is whole sentences of ``INSTRUCTION_WORDS`` words that stand alike at that end of
    ``INSTRUCTION_ITEMS`` items of unequal text; longer passages and those that fewer items share are content.
    """
    edges = items.mapInPandas(_edges_of, "item_id long, whole string, side string, n long, edge string")
    common = edges.groupBy("side", "edge").agg(F.count_distinct("whole").alias("c")).where(F.col("c") >= INSTRUCTION_ITEMS)
    longest = edges.join(common, ["side", "edge"]).groupBy("item_id")
    return longest.agg(F.max(F.when(F.col("side") == "head", F.col("n"))).alias("head"), F.max(F.when(F.col("side") == "tail", F.col("n"))).alias("tail"))


def item_words(items: DataFrame) -> DataFrame:
    """``item_id, words``: hashes of an item's own words, for items of at least WINDOW such words."""
    own = items.join(shared_edges(items), "item_id", "left")
    own = own.select("item_id", "text", F.coalesce("head", F.lit(0)).alias("head"), F.coalesce("tail", F.lit(0)).alias("tail"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, bounds = word_hashes(batch.column("text"))
            head, tail = batch.column("head").to_numpy(), batch.column("tail").to_numpy()
            rows = [hashes[a + h : max(b - t, a + h)].view(np.int64) for a, b, h, t in zip(bounds, bounds[1:], head, tail)]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(rows, _LONGS)], names=["item_id", "words"])

    return own.mapInArrow(cut, "item_id long, words array<long>").where(F.size("words") >= WINDOW).dropDuplicates()


def _item_grams(own: DataFrame) -> DataFrame:
    """``item_id, words_id, pos, hash`` of every n-gram; ``words_id`` tells texts of one id apart."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, key, row in zip(batch.column("item_id").to_pylist(), batch.column("words_id").to_pylist(), batch.column("words")):
                hashes = seed_hashes(row.values.to_numpy().view(np.uint64)).view(np.int64)
                n = len(hashes)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, item)), pa.array(np.full(n, key)), pa.array(np.arange(n, dtype=np.int32)), pa.array(hashes)], names=["item_id", "words_id", "pos", "hash"])

    return own.mapInArrow(grams, "item_id long, words_id long, pos int, hash long")


def _filter(grams: DataFrame, n_bits: int) -> np.ndarray:
    """The bitmap of all n-grams, made where they are and brought together in pieces of 4 KB."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.unique(filter_bits(batch.column("hash").to_numpy().view(np.uint64), n_bits))
            yield pa.RecordBatch.from_arrays([pa.array(own >> 15), pa.array(own & 32767)], names=["block", "bit"])

    made = grams.select("hash").mapInArrow(bits, "block long, bit long").groupBy("block").agg(F.bitmap_construct_agg("bit").alias("map")).toArrow()
    out = np.zeros((max(n_bits >> 15, 1), 4096), np.uint8)
    for block, piece in zip(made["block"].to_pylist(), made["map"].to_pylist()):
        out[block] = np.frombuffer(piece, np.uint8)
    return out.reshape(-1)


def choose_seeds(costs: np.ndarray) -> np.ndarray:
    """Which n-grams of an item are seeds, given their costs by position; 0 costs stand nowhere.

    Rare ones, and for every window and every word of it that may be edited the cheapest n-gram that stays.
    """
    found = costs[costs > 0]
    if not len(found):
        return np.zeros(len(costs), bool)
    chosen = (costs > 0) & (costs <= max(RARE, RARE_FACTOR * float(np.quantile(found, 0.25))))
    settled = chosen | (costs == 0)  # a window with an n-gram that stands nowhere stands nowhere
    starts = np.arange(len(costs) + SEED - WINDOW)
    for edit in range(WINDOW):
        stay = [k for k in range(WINDOW - SEED + 1) if k + SEED <= edit or k > edit]
        if stay and len(starts):
            held = np.zeros(len(starts), bool)
            for k in stay:
                held |= settled[starts + k]
            for s in starts[~held]:
                at = s + np.array(stay)
                if not settled[at].any():
                    best = at[np.argmin(costs[at])]
                    chosen[best] = settled[best] = True
    return chosen


def _seeds(grams: DataFrame, passages: DataFrame) -> DataFrame:
    """``hash, item_id, words_id, ci, i0, i1``: the seeds by cell of the item, first and last place."""
    shared = grams.groupBy("hash").agg(F.count_distinct("item_id").alias("items"))
    cost = shared.join(passages, "hash").select("hash", (F.col("items") * F.col("n")).alias("cost"))
    rows = grams.join(cost, "hash", "left").groupBy("item_id", "words_id").agg(F.array_sort(F.collect_list(F.struct("pos", "hash", F.coalesce("cost", F.lit(0)).alias("cost")))).alias("g"))

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for item, key, hashes, costs in zip(batch["item_id"], batch["words_id"], batch["hashes"], batch["costs"]):
                at = np.flatnonzero(choose_seeds(np.asarray(costs)))
                yield pd.DataFrame({"hash": np.asarray(hashes)[at], "item_id": item, "words_id": key, "ci": at // _CELL, "i": at})

    slim = rows.select("item_id", "words_id", F.col("g.hash").alias("hashes"), F.col("g.cost").alias("costs"))
    seeds = slim.mapInPandas(choose, "hash long, item_id long, words_id long, ci int, i int")
    return seeds.groupBy("hash", "item_id", "words_id", "ci").agg(F.min("i").alias("i0"), F.max("i").alias("i1"))


# --- corpus ---------------------------------------------------------------------------------------

PASSAGES = "doc_id long, text_id long, cell int, first int, words array<long>, hashes array<long>, j0 array<int>, j1 array<int>"


def scan(hashes: np.ndarray, bounds: np.ndarray, bits: np.ndarray, n_bits: int) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Passages of texts given as word hashes: (index of text, cell, first word's place, words, n-grams, first and last place of each)."""
    grams = seed_hashes(hashes)
    at = in_filter(grams, bits, n_bits)
    text = np.searchsorted(bounds, at, side="right") - 1
    inside = at + SEED <= bounds[text + 1] if len(at) else np.zeros(0, bool)
    at, text = at[inside], text[inside]
    if not len(at):
        return
    cell = (at - bounds[text]) // _CELL
    cuts = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (cell[1:] != cell[:-1])]))
    for a, b in zip(cuts, np.append(cuts[1:], len(at))):
        t, places = text[a], at[a:b]
        lo, hi = max(places[0] - _REACH, bounds[t]), min(places[-1] + SEED + _REACH, bounds[t + 1])
        kinds, first, inverse = np.unique(grams[places], return_index=True, return_inverse=True)
        last = np.zeros(len(kinds), np.int64)
        np.maximum.at(last, inverse, np.arange(len(places)))
        yield int(t), int(cell[a]), int(lo - bounds[t]), hashes[lo:hi], kinds, places[first] - bounds[t], places[last] - bounds[t]


def _passages(documents: DataFrame, bits: np.ndarray, n_bits: int) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(bits)
    texts = documents.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("text_id"), "text")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in PASSAGES.split(", ")]
        ints = pa.list_(pa.int32())
        for batch in batches:
            ids, keys = batch.column("doc_id").to_numpy(), batch.column("text_id").to_numpy()
            rows = list(scan(*word_hashes(batch.column("text")), shared.value, n_bits))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[r[0]] for r in rows], pa.int64()), pa.array([keys[r[0]] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32()),
                    pa.array([r[3].view(np.int64) for r in rows], _LONGS), pa.array([r[4].view(np.int64) for r in rows], _LONGS), pa.array([r[5].astype(np.int32) for r in rows], ints), pa.array([r[6].astype(np.int32) for r in rows], ints),
                ],
                names=names,
            )

    return texts.mapInArrow(find, PASSAGES)


def align(batch: pd.DataFrame) -> pd.DataFrame:
    """Score every candidate; those of at least MIN_SCORE stay.  Similar sizes are aligned together."""
    pairs = []
    for c in batch.itertuples():
        item = np.asarray(c.item_words)[max(c.i0 - c.item_first - _REACH, 0) : c.i1 - c.item_first + SEED + _REACH]
        doc = np.asarray(c.words)[max(c.j0 - c.first - _REACH, 0) : c.j1 - c.first + SEED + _REACH]
        pairs.append((c.doc_id, c.item_id, item, doc))
    pairs.sort(key=lambda p: len(p[3]))
    out = []
    for k in range(0, len(pairs), _BATCH):
        part = pairs[k : k + _BATCH]
        _, ids = np.unique(np.concatenate([x for p in part for x in p[2:]]), return_inverse=True)
        cuts = np.cumsum([len(x) for p in part for x in p[2:]])[:-1]
        pieces = np.split(ids.astype(np.int32), cuts)
        a, b = pieces[0::2], pieces[1::2]
        score = smith_waterman(a, b)
        good = np.flatnonzero(score >= MIN_SCORE)
        exact = nearly_verbatim([a[g] for g in good], [b[g] for g in good], WINDOW) if len(good) else []
        out += [(part[g][0], part[g][1], int(score[g]), bool(e)) for g, e in zip(good, exact)]
    return pd.DataFrame(out, columns=["doc_id", "item_id", "score", "verbatim"])


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, score, verbatim``: one row per document and item that align well.

    ``documents`` has doc_id and text, ``items`` item_id and text.  ``score`` is that of the best local
    alignment (1 a word, -1 a replaced, dropped or added one) within passages around seeds, at least
    MIN_SCORE.  ``verbatim`` tells whether WINDOW successive words of the item stand in the document, in order,
    with at most one word replaced, dropped or added.  Letter case, punctuation and blanks don't count.  An
    instruction (see :func:`shared_edges`) doesn't count; identical items are each reported, and so are all
    items that share a leaked passage.  Null or empty texts and items of fewer than WINDOW words of their own
    yield nothing; repeated rows count once.
    """
    spark = documents.sparkSession
    items = items.where("item_id is not null and text is not null").select("item_id", "text").dropDuplicates()
    own = materialise(item_words(items).withColumn("words_id", F.xxhash64("words")), "item-words")
    n_words = own.agg(F.sum(F.size("words"))).first()[0]
    if not n_words:
        return spark.createDataFrame([], SCORES)
    n_bits = min(MAX_FILTER_BITS, 1 << max(15, int(64 * n_words - 1).bit_length()))
    grams = materialise(_item_grams(own), "item-grams")
    found = materialise(_passages(documents, _filter(grams, n_bits), n_bits), "passages")
    hits = found.select("doc_id", "text_id", "cell", F.explode(F.arrays_zip("hashes", "j0", "j1")).alias("h")).select("doc_id", "text_id", "cell", F.col("h.hashes").alias("hash"), "h.j0", "h.j1")
    passages = materialise(hits.groupBy("hash").agg(F.count("*").alias("n")).join(grams.select("hash").dropDuplicates(), "hash", "left_semi"), "rarity")
    total = passages.agg(F.sum("n")).first()[0] or 0
    met = join_salted(hits, _seeds(grams, passages), "hash", passages, total)
    where = ["doc_id", "text_id", "cell"]
    ends = [F.min("j0").alias("j0"), F.max("j1").alias("j1"), F.min("i0").alias("i0"), F.max("i1").alias("i1")]
    candidates = materialise(met.groupBy(*where, "item_id", "words_id", "ci").agg(*ends), "candidates")
    segment = F.struct("item_id", "words_id", "ci")
    begin = F.greatest(F.col("ci") * _CELL - _REACH, F.lit(0))
    pieces = own.withColumn("ci", F.explode(F.sequence(F.lit(0), F.floor((F.size("words") - 1) / _CELL).cast("int"))))
    pieces = pieces.select(segment.alias("seg"), begin.alias("item_first"), F.slice("words", begin + 1, _CELL + SEED + 2 * _REACH).alias("item_words"))
    sizes = candidates.groupBy(segment.alias("seg")).agg(F.count("*").alias("n"))
    pieces = pieces.join(sizes, "seg")
    paired = join_counted(candidates.withColumn("seg", segment), pieces, "seg", "n", candidates.count())
    paired = paired.join(found.select(*where, "first", "words"), where).select("doc_id", "item_id", "j0", "j1", "i0", "i1", "first", "words", "item_first", "item_words")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield align(batch)

    return paired.mapInPandas(score, SCORES).groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.max("verbatim").alias("verbatim"))
