"""Hashed subword features and classifiers over them, trained by gradient descent in numpy.

A word's features are its own hash and those of its character n-grams between
the marks ``<`` and ``>``.  All models here are linear in the words of a text,
so a text is scored by looking up one small vector for each distinct word of a
slice of texts and summing: the cost is that of splitting the text.
"""

from __future__ import annotations

import ctypes
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from foliomill.llm.text import STEP, Words, hashed, mix, plain, split_words

#: Bytes of text that are scored at a time: a distinct word takes some 30 features of 16 bytes.
SCORED_BYTES = 2 << 20
#: Stands for "the same word as before"; holds a blank, so no word equals it.
REPEAT = "= ="


@dataclass(frozen=True)
class Features:
    """How words are turned into feature numbers below ``2 ** bits``."""

    bits: int = 17
    shortest: int = 2
    longest: int = 4
    repeats: bool = False
    lower: bool = False

    def of(self, distinct: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers and feature numbers, sorted by word."""
        count, down = len(distinct), np.uint64(64 - self.bits)
        owners, found = [np.arange(count)], [hashed(distinct) >> down]
        if count:
            letters = np.frombuffer(("<" + "><".join(distinct.to_pylist()) + ">").encode("utf-32-le"), np.uint32).astype(np.uint64)
            sizes = pc.utf8_length(distinct).to_numpy().astype(np.int64) + 2
            owner, end = np.repeat(np.arange(count), sizes), np.repeat(np.cumsum(sizes), sizes)
            rolled = np.zeros(len(letters), np.uint64)
            for n in range(1, self.longest + 1):
                m = len(letters) - n + 1
                if m <= 0:
                    break
                rolled = rolled[:m] * np.uint64(STEP) + letters[n - 1 :]
                if n >= self.shortest:
                    inside = np.arange(m) + n <= end[:m]
                    owners.append(owner[:m][inside])
                    found.append(mix(rolled[inside] + np.uint64(n)) >> down)
        owners, found = np.concatenate(owners), np.concatenate(found).astype(np.int64)
        order = np.argsort(owners, kind="stable")
        return owners[order], found[order]

    def shares(self, owner: np.ndarray, count: int) -> np.ndarray:
        """The weight of each feature in its word: one half for the word itself, the rest for its n-grams."""
        size = np.bincount(owner, minlength=count)
        first = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, bool)
        return np.where(first, 0.5, 0.5 / np.maximum(1, size - 1)[owner])

    def words(self, texts: pa.Array | pa.ChunkedArray) -> Words:
        """The words of some texts, with ``REPEAT`` in place of repeated words if wanted."""
        words = split_words(pc.utf8_lower(plain(texts)) if self.lower else texts)
        if self.repeats and len(words.codes):
            again = np.concatenate([[False], words.codes[1:] == words.codes[:-1]])
            again[words.offsets[:-1][words.counts > 0]] = False
            words.codes = np.where(again, len(words.distinct), words.codes)
            words.distinct = pa.concat_arrays([words.distinct.cast(pa.string()), pa.array([REPEAT])])
        return words


@dataclass
class LinearText:
    """Scores of texts: a table of feature weights for each output, averaged over words.

    ``spread``: texts are scored by the mean over words, or else by the sum
    over distinct words divided by the root of their number, which keeps a
    few telling words visible in a long text.  ``piece``: longer texts are
    scored by pieces of that many words (the last one half as long again at
    most), and the largest output of the pieces is the text's.
    """

    features: Features
    table: np.ndarray  # outputs x buckets
    bias: np.ndarray
    spread: bool = False
    piece: int | None = None
    index: np.ndarray | None = None

    def scores(self, texts: pa.Array | pa.ChunkedArray) -> np.ndarray:
        """One row of outputs for each text; the bias alone for a text without words."""
        words = self.features.words(texts)
        owner, found = self.features.of(words.distinct)
        found = found if self.index is None else self.index[found]
        share = self.features.shares(owner, len(words.distinct))
        codes, text = words.codes.astype(np.int64), words.owner
        pieces = np.ones(len(words.offsets) - 1, np.int64)
        if self.piece:
            pieces = np.maximum(1, (words.counts + self.piece // 2) // self.piece)
            inside = (np.arange(len(codes)) - np.repeat(words.offsets[:-1], words.counts)) // self.piece
            text = np.repeat(np.cumsum(pieces) - pieces, words.counts) + np.minimum(inside, np.repeat(pieces - 1, words.counts))
        if self.spread:
            key = np.unique(text * max(1, len(words.distinct)) + codes)
            text, codes = np.divmod(key, max(1, len(words.distinct)))
        number = np.bincount(text, minlength=int(pieces.sum()))
        out = np.empty((int(pieces.sum()), len(self.table)))
        for k, weights in enumerate(self.table):
            each = np.bincount(owner, weights=weights[found] * share, minlength=len(words.distinct))
            total = np.bincount(text, weights=each[codes], minlength=len(out))
            out[:, k] = total / np.maximum(1, np.sqrt(number) if self.spread else number)
        if self.piece and len(out):
            out = np.maximum.reduceat(out, np.cumsum(pieces) - pieces, axis=0)
        return out + self.bias

    def add_output(self, ones: np.ndarray) -> None:
        """One more output: the share of a text's features that ``ones`` marks by number.

        Numbers that have no column of their own yet share one with all that are marked alike.
        """
        most = self.table.shape[1]
        columns = np.concatenate([self.table, np.zeros((len(self.table), 1))], axis=1)
        index = np.where((self.index == most - 1) & ones, most, self.index).astype(np.int32)
        last = np.zeros((1, most + 1))
        last[0, index[ones]] = 1
        self.table, self.index, self.bias = np.concatenate([columns, last]), index, np.concatenate([self.bias, [0.0]])


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class _Bags:
    """Training texts as distinct words with weights, and their features, ready for minibatches."""

    def __init__(self, features: Features, texts: list[str], spread: bool, least: int = 1) -> None:
        """``least``: features of words that together have fewer (text, word) pairs are left out."""
        words = features.words(pa.array(texts, pa.string()))
        owner, self.found = features.of(words.distinct)
        self.share = features.shares(owner, len(words.distinct))
        self.size = np.maximum(1, np.bincount(owner, minlength=len(words.distinct)))
        self.begin = np.cumsum(self.size) - self.size
        key, times = np.unique(words.owner * max(1, len(words.distinct)) + words.codes, return_counts=True)
        text, self.word = np.divmod(key, max(1, len(words.distinct)))
        number = np.bincount(text, minlength=len(texts))
        self.weight = 1 / np.sqrt(number[text]) if spread else times / np.maximum(1, words.counts)[text]
        self.text, self.owner, self.buckets = text, owner, 1 << features.bits
        if least > 1:
            self.share[self.frequency(0, len(texts))[self.found] < least] = 0
        self.number = number
        self.first = np.cumsum(number) - number

    def frequency(self, low: int, high: int) -> np.ndarray:
        """How many (text, word) pairs of texts low to high have each feature."""
        inside = (self.text >= low) & (self.text < high)
        often = np.bincount(self.word[inside], minlength=len(self.size))
        return np.bincount(self.found, weights=often[self.owner], minlength=self.buckets)

    def batch(self, docs: np.ndarray):
        """Entries (document, word), the distinct words' features, and the weights of entries."""
        number = self.number[docs]
        doc = np.repeat(np.arange(len(docs)), number)
        at = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number) + np.repeat(self.first[docs], number)
        words, entry = np.unique(self.word[at], return_inverse=True)
        size = self.size[words]
        owner = np.repeat(np.arange(len(words)), size)
        where = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.begin[words], size)
        where = where[keep := self.share[where] > 0]
        return doc, entry, self.weight[at], owner[keep], self.found[where], self.share[where], len(words)


def _sums(index: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Rows of ``values`` summed by index."""
    return np.stack([np.bincount(index, weights=v, minlength=size) for v in values.T], axis=1)


def train_embeddings(features: Features, texts: list[str], labels: np.ndarray, classes: int, dim: int = 8, epochs: int = 4, rate: float = 0.5, batch: int = 32, least_steps: int = 300, seed: int = 1) -> LinearText:
    """Averaged subword embeddings under a linear softmax, by plain stochastic gradient descent.

    Only features that occur have an embedding; the others count as zero.  The
    learned embeddings and the softmax weights are multiplied out, so the
    result scores words without the embeddings themselves.  Few texts are gone
    through more often, so that there are ``least_steps`` steps.
    """
    rng = np.random.default_rng(seed)
    bags = _Bags(features, texts, spread=False)
    met, bags.found = np.unique(bags.found, return_inverse=True)
    embed = rng.uniform(-1 / dim, 1 / dim, (len(met), dim))
    weights, bias = rng.normal(0, 0.1, (dim, classes)), np.zeros(classes)
    rounds = -(-len(texts) // batch)
    epochs = max(epochs, -(-least_steps // max(1, rounds)))
    steps, done = epochs * rounds, 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), batch):
            docs = order[i : i + batch]
            now = rate * (1 - done / steps)
            done += 1
            doc, entry, share, owner, found, part, count = bags.batch(docs)
            begin = np.flatnonzero(np.diff(owner, prepend=-1))
            vectors = np.add.reduceat(embed[found] * part[:, None], begin, axis=0) if count else np.zeros((0, dim))
            hidden = _sums(doc, vectors[entry] * share[:, None], len(docs))
            error = softmax(hidden @ weights + bias)
            error[np.arange(len(docs)), labels[docs]] -= 1
            on_texts = error @ weights.T
            weights -= now * hidden.T @ error / len(docs)
            bias -= now * 0.1 * error.mean(axis=0)
            on_words = _sums(entry, on_texts[doc] * share[:, None], count)
            which, back = np.unique(found, return_inverse=True)
            embed[which] -= now * RATE_SCALE / len(docs) * _sums(back, on_words[owner] * part[:, None], len(which))
    index = np.full(1 << features.bits, len(met), np.int32)
    index[met] = np.arange(len(met))
    table = np.zeros((classes, len(met) + 1))
    table[:, : len(met)] = (embed @ weights).T
    return LinearText(features, table, bias, index=index)


#: A word's gradient is shared by its features, so their step is this many times longer.
RATE_SCALE = 200.0


def _counted(features: Features, distinct: pa.StringArray, often: np.ndarray) -> np.ndarray:
    """How many (text, word) pairs have each feature number, for each row of ``often`` (rows x words)."""
    out = np.zeros((len(often), 1 << features.bits), np.int32)
    for a, b, owner, found in _chunks(features, distinct):
        for row, part in zip(out, often[:, a:b], strict=True):
            row += np.bincount(found, weights=part[owner], minlength=len(row)).astype(np.int32)
    return out


def _chunks(features: Features, distinct: pa.StringArray):
    """The features of some words at a time, so that memory doesn't depend on how many there are."""
    for a in range(0, len(distinct), CHUNK_WORDS):
        part = distinct.slice(a, CHUNK_WORDS)
        yield a, a + len(part), *features.of(part)


#: Distinct words whose features are in memory at a time while features are counted.
CHUNK_WORDS = 16_384


def _often(words: Words, fold: np.ndarray, folds: list[int]) -> np.ndarray:
    """For each fold, in how many of the other folds' texts each word occurs."""
    count = max(1, len(words.distinct))
    text, word = np.divmod(np.unique(words.owner * count + words.codes), count)
    return np.stack([np.bincount(word[fold[text] != k], minlength=count) for k in folds])


def met_features(features: Features, texts: list[str], least: int = 2) -> np.ndarray:
    """The feature numbers that words of at least ``least`` of the texts have."""
    words = features.words(pa.array(texts, pa.string()))
    often = _often(words, np.zeros(len(texts), np.int64), [-1])
    return np.flatnonzero(_counted(features, words.distinct, often)[0] >= least)


def left_out_shares(features: Features, shortest: int, texts: list[str], fold: np.ndarray, least: int = 2) -> np.ndarray:
    """For each text the share of its words' features that ``met_features`` of the texts of other folds would hold."""
    words = features.words(pa.array(texts, pa.string()))
    folds = np.unique(fold).tolist()
    met = _counted(replace(features, shortest=shortest), words.distinct, _often(words, fold, folds)) >= least
    each = np.zeros((len(folds), max(1, len(words.distinct))))
    for a, b, owner, found in _chunks(features, words.distinct):
        share = features.shares(owner, b - a)
        for k in range(len(folds)):
            each[k, a:b] = np.bincount(owner, weights=share * met[k][found], minlength=b - a)
    out = np.zeros(len(texts))
    for k, value in zip(folds, each, strict=True):
        total = np.bincount(words.owner, weights=value[words.codes], minlength=len(texts)) / np.maximum(1, words.counts)
        out[fold == k] = total[fold == k]
    return out


def give_back() -> None:
    """Return freed memory to the system, where the C library can: a driver goes on for long after a model is fitted."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def passages(texts: list[str], words: int, seed: int = 3) -> list[str]:
    """Of each text a stretch of at most so many words, at a random place."""
    rng = np.random.default_rng(seed)
    out = []
    for text in texts:
        split = text.split()
        begin = int(rng.integers(0, max(1, len(split) - words + 1)))
        out.append(" ".join(split[begin : begin + words]))
    return out


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits that makes held-out labels likeliest.

    A grid that moves on while its best value is at an end: where every label
    is right a lower divisor is always better, and the last one is taken.
    """
    if len(labels) == 0:
        return 1.0
    loss = lambda t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(labels)), labels], 1e-12)).mean()
    centre = 0.0
    for _ in range(8):
        grid = np.exp(centre + np.linspace(-2, 2, 41))
        best = int(np.argmin([loss(t) for t in grid]))
        centre = float(np.log(grid[best]))
        if 0 < best < len(grid) - 1:
            break
    return float(np.exp(centre))


#: The weight of scaled features before training.
START = 4.0


def train_nnpu(features: Features, positive: list[str], unlabelled: list[str], prior: float, epochs: int = 16, rate: float = 0.6, batch: int = 192, slack: float = 0.02, least: int = 16, piece: int | None = 400, seed: int = 1) -> LinearText:
    """A linear classifier from confirmed positives and unlabelled texts.

    Minimises the non-negative risk: prior * loss(P as positive) +
    max(0, loss(U as negative) - prior * loss(P as negative)), the loss being
    logistic.  Where the second part falls under ``-slack`` its gradient is
    taken the other way, so that the flexible model can't drive it negative
    by learning the unlabelled texts by heart.  Steps are scaled by the root
    of summed squared gradients for each weight.  Features seen in fewer than
    ``least`` texts keep weight 0.
    """
    rng = np.random.default_rng(seed)
    buckets = 1 << features.bits
    np_, nu = len(positive), len(unlabelled)
    bags = _Bags(features, positive + unlabelled, spread=True, least=least)
    # How much oftener a feature is among positives; it scales the feature, so that weights of common words stay small.
    in_p, in_u = bags.frequency(0, np_), bags.frequency(np_, np_ + nu)
    ratio = np.log((in_p + least) / (in_u * in_p.sum() / max(1.0, in_u.sum()) + least))
    table, bias = np.full(buckets, START), float(np.log(prior / (1 - prior)))
    squares, bias_squares = np.full(buckets, 1e-8), 1e-8
    share = max(1, min(batch // 3, np_))
    for _ in range(epochs):
        pos_order = rng.permutation(np_)
        for k, i in enumerate(range(0, nu, batch)):
            u = np_ + np.arange(nu)[i : i + batch] if nu <= batch else np_ + rng.integers(0, nu, batch)
            p = pos_order[(k * share + np.arange(share)) % np_]
            docs = np.concatenate([p, u])
            doc, entry, weight, owner, found, part, count = bags.batch(docs)
            part = part * ratio[found]
            word = np.bincount(owner, weights=table[found] * part, minlength=count)
            score = np.bincount(doc, weights=word[entry] * weight, minlength=len(docs)) + bias
            prob = sigmoid(score)
            sp, su = prob[: len(p)], prob[len(p) :]
            as_negative = -np.log(np.maximum(1 - su, 1e-12)).mean() + prior * np.log(np.maximum(1 - sp, 1e-12)).mean()
            less, more = -prior * sp / len(p), su / len(u)
            error = np.concatenate([prior * (sp - 1) / len(p) + less, more]) if as_negative >= -slack else np.concatenate([-less, -more])
            on_words = np.bincount(entry, weights=error[doc] * weight, minlength=count)
            which, back = np.unique(found, return_inverse=True)
            grad = np.bincount(back, weights=on_words[owner] * part)
            squares[which] += grad**2
            table[which] -= rate * grad / np.sqrt(squares[which])
            g = error.sum()
            bias_squares += g * g
            bias -= rate * 0.1 * g / np.sqrt(bias_squares)
    return LinearText(features, (table * ratio)[None, :], np.array([bias]), spread=True, piece=piece)


def pu_cut(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """The score that separates best by held-out positives and unlabelled texts alone.

    The share of positives above a cut is its recall, and the prior times that
    over the share of unlabelled texts above it its precision; the cut with
    the largest harmonic mean of the two is taken, and of equal ones the
    middle of the gap in the scores.
    """
    if len(positive) == 0 or len(unlabelled) == 0:
        return 0.0
    levels = np.unique(np.concatenate([positive, unlabelled]))
    cuts = np.concatenate([[levels[0] - 1], (levels[1:] + levels[:-1]) / 2, [levels[-1] + 1]])
    recall = 1 - np.searchsorted(np.sort(positive), cuts) / len(positive)
    above = 1 - np.searchsorted(np.sort(unlabelled), cuts) / len(unlabelled)
    precision = np.minimum(1, prior * recall / np.maximum(above, 1 / len(unlabelled)))
    value = 2 * precision * recall / np.maximum(precision + recall, 1e-9)
    return float(np.median(cuts[value >= value.max() - 1e-9]))
