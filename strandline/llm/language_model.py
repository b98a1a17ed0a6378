"""Sparse multinomial logistic regression on TF-IDF character n-grams, and decoding of word runs.

The model is trained with follow-the-regularised-leader (FTRL-proximal) and elastic-net penalties and
calibrated by temperature.  N-grams are taken inside blank-padded words and hashed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BITS = 18
SIZE = 1 << BITS
ORDERS = (1, 2, 3, 4, 5)

#: FTRL: learning rate, its smoothing, and the two penalties of the elastic net.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.02
EPOCHS, MINI_BATCH = 2, 128
_STEPS = 2_000_000  #: words that are decoded at once
#: What a change of language costs in a decoded run, in nats: at a sentence border, between words, and
#: between letters of a script without blanks, where one letter tells little.
SWITCH_AT_BORDER, SWITCH_INSIDE, SWITCH_BETWEEN_LETTERS = 4.0, 8.0, 24.0
#: The share of words that any language may borrow; bounds what one word tells.
BORROWED = 0.02


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the word, hashed feature) of every character n-gram, by word."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = " " + " ".join(words) + " "
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    blank = points == 32
    blanks = np.concatenate([[0], np.cumsum(blank)])
    word = blanks[1:] - 1  # a blank belongs to the word after it
    owners, features = [], []
    rolling = np.full(len(points), 1469598103934665603, np.uint64)
    for n in ORDERS:
        m = len(points) - n + 1
        if m <= 0:
            break
        rolling = (rolling[:m] ^ points[n - 1 :]) * np.uint64(1099511628211)
        inner = blanks[n - 1 : n - 1 + m] - blanks[1 : 1 + m] if n > 2 else np.zeros(m, np.int64)
        good = np.flatnonzero(~blank[:m] if n == 1 else inner == 0)  # two blanks never touch
        h = rolling[good]
        features.append(((h ^ (h >> np.uint64(29)) ^ (h >> np.uint64(47))) & np.uint64(SIZE - 1)).astype(np.int64))
        owners.append(word[good])
    owner, feature = np.concatenate(owners), np.concatenate(features)
    order = np.argsort(owner, kind="stable")
    return owner[order], feature[order]


@dataclass
class LanguageModel:
    """Weights of the features that are not zero, times their IDF; rows follow ``features``."""

    languages: list[str]
    features: np.ndarray
    weights: np.ndarray  #: (features + 1, languages); the last row is zero
    energy: np.ndarray  #: squared IDF by feature
    temperature: float  #: of texts
    word_temperature: float  #: of single words
    calibration: list[tuple[float, int, float, float]]  #: on held-out spans: upper end of the bin, spans, mean confidence, share right

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Raw scores by language, and energy, of each word."""
        owner, feature = ngrams(words)
        row = np.searchsorted(self.features, feature)
        row[row == len(self.features)] = 0
        row = np.where(self.features[row] == feature, row, len(self.features)) if len(self.features) else np.zeros_like(feature)
        scores = np.zeros((len(words), len(self.languages)), np.float32)
        energy = np.zeros(len(words), np.float32)
        if len(owner):
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            scores[owner[starts]] = np.add.reduceat(self.weights[row], starts, axis=0)
            energy[owner[starts]] = np.add.reduceat(self.energy[feature], starts)
        return scores, energy

    def probabilities(self, scores: np.ndarray, energy: np.ndarray, temperature: float | None = None) -> np.ndarray:
        """Calibrated probabilities of texts from the sums over their words."""
        z = scores / np.sqrt(np.maximum(energy, 1e-9))[:, None] / (temperature or self.temperature)
        return _softmax(z)

    def word_evidence(self, scores: np.ndarray, energy: np.ndarray) -> np.ndarray:
        """Log-probabilities of the languages given one word."""
        p = self.probabilities(scores, energy, self.word_temperature)
        return np.log((1 - BORROWED) * p + BORROWED / p.shape[1]).astype(np.float32)

    def decode(self, emit: np.ndarray, start: np.ndarray, cost: np.ndarray) -> np.ndarray:
        """The language of each word: the best path where a change before word k costs ``cost[k]``.

        ``start`` begins each text.
        """
        length = np.diff(np.append(start, len(emit)))
        out = np.zeros(len(emit), np.int16)
        order = np.argsort(length, kind="stable")
        order = order[length[order] > 0]
        k = 0
        while k < len(order):  # texts of like length together, so many that the table of steps stays small
            room = max(1, min(512, len(order) - k, _STEPS // int(length[order[k]])))
            while room > 1 and room * int(length[order[k + room - 1]]) > _STEPS:
                room //= 2
            part = order[k : k + room]
            k += room
            first, size = start[part], length[part]
            back = np.zeros((int(size.max()), len(part), emit.shape[1]), np.int16)
            best = emit[first].copy()
            every = np.arange(emit.shape[1], dtype=np.int16)[None, :]
            for t in range(1, int(size.max())):
                on = np.flatnonzero(size > t)
                at = first[on] + t
                now = best[on]
                top = now.argmax(axis=1)
                moved = now[np.arange(len(on)), top] - cost[at]
                stay = now >= moved[:, None]
                back[t, on] = np.where(stay, every, top[:, None].astype(np.int16))
                best[on] = np.where(stay, now, moved[:, None]) + emit[at]
            state = best.argmax(axis=1)
            for t in range(int(size.max()) - 1, -1, -1):
                on = np.flatnonzero(size > t)
                out[first[on] + t] = state[on]
                state[on] = back[t, on, state[on]]
        return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class _Samples:
    """Sentences as sparse rows: features, values (IDF over the row's norm), row bounds."""

    def __init__(self, sentences: list[list[str]], idf: np.ndarray) -> None:
        vocabulary: dict[str, int] = {}
        ids = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in s], np.int64) for s in sentences]
        owner, feature = ngrams(list(vocabulary))
        bounds = np.searchsorted(owner, np.arange(len(vocabulary) + 1))
        rows = [np.concatenate([feature[bounds[i] : bounds[i + 1]] for i in s]) for s in ids]
        self.rows = rows
        self.values = []
        self.norms = np.zeros(len(rows))
        for k, row in enumerate(rows):
            v = idf[row]
            self.norms[k] = np.sqrt((v * v).sum()) or 1.0
            self.values.append((v / self.norms[k]).astype(np.float32))

    def batch(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        feature = np.concatenate([self.rows[k] for k in which])
        value = np.concatenate([self.values[k] for k in which])
        starts = np.concatenate([[0], np.cumsum([len(self.rows[k]) for k in which])[:-1]])
        return feature, value, starts


def _ftrl(samples: _Samples, labels: np.ndarray, rows: np.ndarray, n_languages: int, seed: int) -> np.ndarray:
    """Dense weights (SIZE, languages), zero where the L1 penalty holds."""
    w = np.zeros((SIZE, n_languages), np.float32)
    z = np.zeros_like(w)
    n = np.zeros_like(w)
    draw = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        order = draw.permutation(rows)
        for k in range(0, len(order), MINI_BATCH):
            which = order[k : k + MINI_BATCH]
            feature, value, starts = samples.batch(which)
            p = _softmax(np.add.reduceat(w[feature] * value[:, None], starts, axis=0))
            p[np.arange(len(which)), labels[which]] -= 1
            size = np.diff(np.append(starts, len(feature)))
            grad = np.repeat(p, size, axis=0) * value[:, None]
            touched, inverse = np.unique(feature, return_inverse=True)
            by = np.argsort(inverse, kind="stable")
            cut = np.searchsorted(inverse[by], np.arange(len(touched)))
            g = np.add.reduceat(grad[by], cut, axis=0)
            old = n[touched]
            new = old + g * g
            z[touched] += g - (np.sqrt(new) - np.sqrt(old)) / ALPHA * w[touched]
            n[touched] = new
            zt = z[touched]
            w[touched] = np.where(np.abs(zt) <= L1, 0, -(zt - np.sign(zt) * L1) / ((BETA + np.sqrt(new)) / ALPHA + L2))
    return w


def _logits(w: np.ndarray, samples: _Samples, rows: np.ndarray) -> np.ndarray:
    out = []
    for k in range(0, len(rows), 1024):
        feature, value, starts = samples.batch(rows[k : k + 1024])
        out.append(np.add.reduceat(w[feature] * value[:, None], starts, axis=0))
    return np.concatenate(out)


def _temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least loss."""
    grid = np.geomspace(0.02, 5, 60)
    loss = [-np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def calibration_bins(p: np.ndarray, y: np.ndarray, n: int = 10) -> list[tuple[float, int, float, float]]:
    """Per tenth of confidence: its upper end, how many texts fall in it, their mean confidence, the share judged right."""
    sure, right = p.max(axis=1), p.argmax(axis=1) == y
    tenth = np.minimum((sure * n).astype(int), n - 1)
    return [((k + 1) / n, int((tenth == k).sum()), float(sure[tenth == k].mean()), float(right[tenth == k].mean())) for k in range(n) if (tenth == k).any()]


def train(sentences: list[list[str]], labels: list[str], languages: list[str], idf: np.ndarray, seed: int = 7) -> LanguageModel:
    """A model from sentences whose labels may be wrong.

    Two folds each judge the other's sentences; those that are judged otherwise are left out.  The rest
    is learnt with a short span of each, since words are to be told apart too.  Temperatures minimise
    the loss on a tenth that is held out: on spans of one to four words, and on single words.
    """
    index = {code: k for k, code in enumerate(languages)}
    y = np.array([index[c] for c in labels], np.int64)
    samples = _Samples(sentences, idf)
    draw = np.random.default_rng(seed)
    fold = draw.integers(0, 2, len(y))
    kept = np.ones(len(y), bool)
    for half in (0, 1):
        own, other = np.flatnonzero(fold != half), np.flatnonzero(fold == half)
        if len(own) and len(other):
            w = _ftrl(samples, y, own, len(languages), seed)
            kept[other] = _logits(w, samples, other).argmax(axis=1) == y[other]
    rows = np.flatnonzero(kept)
    held = draw.random(len(rows)) < 0.1
    learnt = rows[~held] if held.any() and not held.all() else rows
    judged = rows[held] if held.any() else rows

    def spans(which: np.ndarray, low: int, high: int) -> list[list[str]]:
        out = []
        for k in which:
            size = min(int(draw.integers(low, high + 1)), len(sentences[k]))
            at = int(draw.integers(0, len(sentences[k]) - size + 1))
            out.append(sentences[k][at : at + size])
        return out

    both = _Samples([sentences[k] for k in learnt] + spans(learnt, 1, 3), idf)
    w = _ftrl(both, np.concatenate([y[learnt]] * 2), np.arange(2 * len(learnt)), len(languages), seed)
    found = []
    for low, high in ((1, 4), (1, 1)):
        probe = _Samples(spans(judged, low, high), idf)
        found.append(_temperature(_logits(w, probe, np.arange(len(judged))), y[judged]))
    told = judged[draw.permutation(len(judged))[: max(1, len(judged) // 2)]]  # other spans than those the temperature was chosen on
    z = np.concatenate([_logits(w, _Samples(spans(told, 1, 4), idf), np.arange(len(told))) for _ in range(2)])
    bins = calibration_bins(_softmax(z / found[0]), np.concatenate([y[told]] * 2))
    live = np.flatnonzero(np.abs(w).sum(axis=1) > 0)
    weights = np.concatenate([w[live] * idf[live, None], np.zeros((1, len(languages)))]).astype(np.float32)
    return LanguageModel(languages, live, weights, (idf * idf).astype(np.float32), *found, bins)
