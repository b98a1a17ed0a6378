"""Filling fixed-capacity containers with documents.

Method: vector best-fit.  A container has three residual capacities: tokens, documents and attention
cost (the sum of squared lengths).  Documents come in falling length; each goes to the open
container that satisfies every constraint and has the best weighted score: the smallest norm of what
would remain, or the greatest dot product of demand and residual.

How many documents a container takes, and what share of the attention cost of one document as long as the
container, are parameters (:class:`Limits`).  With a share of 1 tokens bound the cost as well; below 1 a
document longer than the root of the cost exceeds the capacity and is cut.

Scale: texts are only counted where they are read; what is shuffled is one slim row per document.
Documents are packed in blocks of about ``BLOCK_DOCS``, spread by hash, so that no task depends on
the size of the corpus or of one source; each block leaves about one container part-filled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.tokenizer import DEFAULT_VOCABULARY, TOKENIZER_DIR, count_tokens
from strandline.workspace import materialise

BLOCK_DOCS = 16384
MAX_CONTAINERS = 1000  #: kinds of container that one call may fill


@dataclass(frozen=True)
class Capacity:
    """What one container holds.  ``attention`` bounds the sum of squared lengths."""

    tokens: int
    documents: int
    attention: int

    @property
    def longest(self) -> int:
        """The longest piece that fits an empty container."""
        return max(1, min(self.tokens, math.isqrt(self.attention)))


@dataclass(frozen=True)
class Limits:
    """Capacities that go with a number of tokens."""

    tokens_per_document: int = 8  #: a container takes one document per so many tokens of its capacity
    attention_share: float = 1.0  #: of the square of its tokens

    def of(self, tokens: int) -> Capacity:
        return Capacity(tokens, max(1, tokens // self.tokens_per_document), max(1, int(tokens * tokens * self.attention_share)))


def cut(n_tokens: int, longest: int) -> list[tuple[int, int]]:
    """(first token, tokens) of each piece: one, unless the document exceeds the capacity."""
    return [(at, min(longest, n_tokens - at)) for at in range(0, n_tokens, longest)]


def pack(lengths: np.ndarray, cap: Capacity, weights: tuple[float, float, float] = (1.0, 0.01, 0.05), rule: str = "norm") -> np.ndarray:
    """The container number of each piece; ``lengths`` falls and no length exceeds ``cap.longest``."""
    n = len(lengths)
    where = np.empty(n, np.int64)
    caps = np.array([cap.tokens, cap.documents, cap.attention], float)
    scale = np.sqrt(np.array(weights)) / caps
    left = np.empty((3, max(n, 1)))  # residuals of open containers
    label = np.empty(max(n, 1), np.int64)
    n_open = used = 0
    least = lengths[-1] if n else 0
    for k in range(n):
        length = float(lengths[k])
        demand = np.array([length, 1.0, length * length])
        rest = left[:, :n_open] - demand[:, None]
        fits = np.flatnonzero(rest.min(axis=0) >= 0) if n_open else ()
        if len(fits):
            scaled = rest[:, fits] * scale[:, None]
            if rule == "norm":
                best = fits[np.argmin(np.einsum("ij,ij->j", scaled, scaled))]
            else:
                best = fits[np.argmax((demand * scale) @ (left[:, fits] * scale[:, None]))]
            left[:, best] = rest[:, best]
        else:
            best, n_open = n_open, n_open + 1
            left[:, best], label[best] = caps - demand, used
            used += 1
        where[k] = label[best]
        if left[0, best] < least or left[1, best] < 1 or left[2, best] < least * least:  # full: close it
            n_open -= 1
            left[:, best], label[best] = left[:, n_open], label[n_open]
    return where


def with_token_counts(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, digest, n_tokens`` of each distinct (doc_id, text) with at least one token."""
    path = vocabulary or f"{TOKENIZER_DIR}/{DEFAULT_VOCABULARY}"

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["doc_id", "digest"]].assign(n_tokens=count_tokens(batch["text"].tolist(), path))

    texts = documents.where(F.col("doc_id").isNotNull() & (F.length("text") > 0)).select("doc_id", F.xxhash64("text").alias("digest"), "text")
    counted = texts.mapInPandas(count, "doc_id long, digest long, n_tokens long")
    return counted.where("n_tokens > 0").dropDuplicates(["doc_id", "digest"])


OUTPUT = "container_id int, sequence_id long, slot int, doc_id long, piece int, first_token long, n_tokens long"


def fill_containers(documents: DataFrame, containers: DataFrame, vocabulary: str | None = None, rule: str = "norm", block_docs: int = BLOCK_DOCS, limits: Limits = Limits()) -> DataFrame:
    """One row per piece of document placed: ``container_id, sequence_id, slot, doc_id, piece,
    first_token, n_tokens``.

    Every document with text comes out once for each kind of container, in one piece unless it exceeds
    the capacity, in tokens or in attention cost; null and empty texts and null ids don't come out.  Repeated rows count once; rows of
    one doc_id with unequal texts are documents of their own.  Containers need a positive capacity.
    Equal lengths are ordered by doc_id, so that a repeated task gives the same result.
    """
    kinds = [(int(c), limits.of(int(t))) for c, t in containers.select("container_id", "capacity_tokens").dropDuplicates().limit(MAX_CONTAINERS + 1).collect() if t and t > 0]
    if len(kinds) > MAX_CONTAINERS:
        raise ValueError(f"more than {MAX_CONTAINERS} kinds of container")
    caps = dict(kinds)
    counted = materialise(with_token_counts(documents, vocabulary), "token-counts")
    n_blocks = max(1, -(-counted.count() // block_docs))
    kind = F.explode(F.array(*[F.lit(c).cast("int") for c in caps])) if caps else F.lit(None).cast("int")
    spread = counted.withColumn("block", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(n_blocks))).withColumn("container_id", kind)
    spread = spread.where(F.col("container_id").isNotNull())

    def place(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        container, block = key
        cap = caps[int(container)]
        rows = [(d, g, k, at, n) for d, g, total in zip(group["doc_id"], group["digest"], group["n_tokens"]) for k, (at, n) in enumerate(cut(int(total), cap.longest))]
        pieces = pd.DataFrame(rows, columns=["doc_id", "digest", "piece", "first_token", "n_tokens"])
        pieces = pieces.sort_values(["n_tokens", "doc_id", "digest", "piece"], ascending=[False, True, True, True], kind="stable")
        pieces["sequence_id"] = (int(block) << 32) + pack(pieces["n_tokens"].to_numpy(), cap, rule=rule)
        pieces["slot"] = pieces.groupby("sequence_id").cumcount()
        pieces["container_id"] = int(container)
        return pieces[["container_id", "sequence_id", "slot", "doc_id", "piece", "first_token", "n_tokens"]]

    return spread.groupBy("container_id", "block").applyInPandas(place, OUTPUT)
