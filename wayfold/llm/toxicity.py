"""Toxicity by a linear-chain conditional random field.

Words are tagged toxic or not. Labelled tokens come from labelled documents:
words, or word beginnings, that stand out in toxic documents by their log-odds
mark the tokens that have them there; all other tokens are labelled clean. The
field has one weight for each word and each beginning of 3 to 6 letters that several toxic
documents have, and weights between neighbouring tags; it is trained by gradient
steps on the likelihood, whose gradient needs the marginals of forward-backward.

A document is one chain, however long. Its messages are ratios of the two tags'
scores. Chains are cut into segments of SEGMENT words that run side by side: the
product of a segment's transfer matrices takes the messages across it, so one
pass over the segments of a document gives each the messages that enter it from
both sides, and the marginals are those of the whole chain.

A document's score comes from its tokens' marginals (the highest, and the sum of
their squares) by logistic regression on the labelled documents. Offending
offsets are runs of tokens whose marginal is at least SPAN_LEAST.

The model is fitted on a sample of labelled documents of bounded size (SAMPLE),
of any length; of near copies with one label, one is learnt from.

Null texts count as empty; a text without letters has the score of a text
without evidence. Very long texts are read whole. Null labels are not learnt
from. Only text is ever an input. With no labelled document, or with one class
only, every score is the share of toxic documents among those learnt from (0
without any). Repeated rows repeat, with equal scores; a null doc_id is a row
like any other. An empty table gives no rows. Other columns are ignored by
scoring and kept as they are by clean_documents(), whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import release, slices, sole_memo, texts

#: Labelled documents of each class that the field is fitted on, about: 1.5 times
#: as many are expected, and twice as many are taken at most.
SAMPLE = 1200
#: Share of common words from which two documents of the sample are near copies.
NEAR = 0.8
SEGMENT = 64
#: Scores of a word lie within this of 0, so that ratios stay finite.
MOST_SCORE = 30.0
#: Log-odds of a feature that marks tokens, and the toxic documents it is in: so
#: many, and this share of them.
LEAST_ODDS, LEAST_TOXIC, LEAST_SHARE = 2.5, 4, 0.01
STEPS, RATE, DECAY = 40, 0.5, 1e-4
THRESHOLD = 0.7
SPAN_LEAST = 0.5
MEMO_WORDS = 200_000
#: Words whose messages are held at once while the field is fitted, about.
FIT_WORDS = 1 << 17
TOKEN = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    return ["=" + word, *(word[:k] for k in range(3, 7) if len(word) > k)]


class Chains:
    """Texts of so many words as chains, cut into segments of `size` words. Words
    of all texts stand one after another."""

    def __init__(self, sizes: list[int], size: int = SEGMENT):
        self.sizes = np.asarray(sizes, np.int64)
        self.parts = -(-self.sizes // size)  # segments of each text
        first = np.cumsum(self.parts) - self.parts
        self.owner = np.repeat(np.arange(len(self.sizes)), self.parts)
        k = np.arange(int(self.parts.sum())) - first[self.owner]
        ends = np.cumsum(self.sizes)
        place = (ends - self.sizes)[self.owner, None] + k[:, None] * size + np.arange(size)[None, :]
        self.real = place < ends[self.owner, None]  # [segment, word]
        self.place = np.where(self.real, place, 0)
        self.opens = k == 0  # segments that begin a text
        # for the pass over segments: those that are the k-th of their text, from either side
        order = np.argsort(-self.parts, kind="stable")
        deep = np.arange(1, 1 + int(self.parts.max(initial=0)))
        live = np.searchsorted(-self.parts[order], -deep, "right")
        self.ahead = [first[order[:n]] + k for k, n in enumerate(live)]
        self.behind = [first[order[:n]] + self.parts[order[:n]] - 1 - k for k, n in enumerate(live)]

    def marginals(self, score: np.ndarray, move: np.ndarray, moves: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """score: of the toxic tag over the clean one, by word. move: [tag, tag]
        scores. Returns the probability that a word is toxic, and the expected
        numbers of moves, [2, 2], if asked for."""
        lanes, size = self.real.shape
        out, seen = np.zeros(len(score)), np.zeros((2, 2))
        if not lanes:
            return out, seen
        m = np.exp(move)
        e = np.exp(np.clip(score, -MOST_SCORE, MOST_SCORE))[self.place].T.copy()  # [word, segment]
        real = self.real.T
        whole = real.all(1)
        # transfer matrix of each segment; the first word of a text is not moved to
        t = [np.ones(lanes), np.zeros(lanes), np.zeros(lanes), np.ones(lanes)]
        for i in range(size):
            a, b, c, d = t
            new = [a * m[0, 0] + b * m[1, 0], (a * m[0, 1] + b * m[1, 1]) * e[i], c * m[0, 0] + d * m[1, 0], (c * m[0, 1] + d * m[1, 1]) * e[i]]
            if i == 0:
                new = [np.where(self.opens, y, x) for x, y in zip(new, (1.0, 0.0, 0.0, e[0]), strict=True)]
            if not whole[i]:
                new = [np.where(real[i], x, y) for x, y in zip(new, t, strict=True)]
            total = new[0] + new[1] + new[2] + new[3]
            t = [x / total for x in new]
        # ratios of the messages that enter a segment from before it and from behind it
        enter, leave = np.ones(lanes), np.ones(lanes)
        for after in self.ahead[1:]:
            here = after - 1
            enter[after] = (t[1][here] + enter[here] * t[3][here]) / (t[0][here] + enter[here] * t[2][here])
        for before in self.behind[1:]:
            here = before + 1
            leave[before] = (t[2][here] + t[3][here] * leave[here]) / (t[0][here] + t[1][here] * leave[here])
        ahead, behind = np.empty((size, lanes)), np.empty((size, lanes))
        now = enter
        for i in range(size):
            new = e[i] * (m[0, 1] + m[1, 1] * now) / (m[0, 0] + m[1, 0] * now)
            if i == 0:
                new = np.where(self.opens, e[0], new)
            now = ahead[i] = new if whole[i] else np.where(real[i], new, now)
        now = leave
        for i in range(size - 1, -1, -1):
            behind[i] = now
            new = (m[1, 0] + m[1, 1] * e[i] * now) / (m[0, 0] + m[0, 1] * e[i] * now)
            now = new if whole[i] else np.where(real[i], new, now)
        odds = ahead * behind
        out[self.place[self.real]] = (odds / (1 + odds)).T[self.real]
        if moves:
            before = np.concatenate([enter[None, :], ahead[:-1]])
            moved = real.copy()
            moved[0] &= ~self.opens
            w = {(a, b): (before if a else 1.0) * m[a, b] * (e * behind if b else 1.0) for a in (0, 1) for b in (0, 1)}
            total = w[0, 0] + w[0, 1] + w[1, 0] + w[1, 1]
            for a, b in w:
                seen[a, b] = (w[a, b] / total)[moved].sum()
        return out, seen


def document_evidence(p: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Per text: highest marginal, log(1 + sum of squares), and whether any
    reaches SPAN_LEAST."""
    owner, n = np.repeat(np.arange(len(sizes)), sizes), len(sizes)
    best = np.zeros(n)
    np.maximum.at(best, owner, p)
    return np.stack([best, np.log1p(np.bincount(owner, p * p, n)), best >= SPAN_LEAST], 1)


class Model:
    def __init__(self, weights: dict[str, float], bias: float, move: np.ndarray, doc: np.ndarray):
        self.weights, self.bias, self.move, self.doc = weights, bias, move, doc
        self.memo: dict[str, float] = {}

    def emission(self, words: list[str]) -> np.ndarray:
        memo, get = self.memo, self.weights.get
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = self.bias + sum(get(f, 0.0) for f in features(w.lower()))
        return np.fromiter(map(memo.__getitem__, words), np.float64, len(words))

    def tag(self, found: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Words of each text, marginal of each word, and evidence of each text."""
        split = [TOKEN.findall(t) for t in found]
        sizes = [len(w) for w in split]
        p, _ = Chains(sizes).marginals(self.emission([w for ws in split for w in ws]), self.move)
        return sizes, p, document_evidence(p, sizes)

    def score(self, found: list[str]) -> np.ndarray:
        _, _, x = self.tag(found)
        return 1 / (1 + np.exp(-np.clip(x @ self.doc[1:] + self.doc[0], -30, 30)))

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Offending offsets: runs of toxic tokens, from first to last character."""
        at = [m.span() for m in TOKEN.finditer(text)]
        _, p, _ = self.tag([text])
        out: list[tuple[int, int]] = []
        for k, (a, b) in enumerate(at):
            if p[k] >= SPAN_LEAST:
                if k and p[k - 1] >= SPAN_LEAST and out:
                    out[-1] = (out[-1][0], b)
                else:
                    out.append((a, b))
        return out


def without_near_copies(texts: list[np.ndarray], labels: list[int]) -> list[int]:
    """texts: the numbers of their words. Places of all but those whose 3-word
    shingles are alike, by NEAR, with those of an earlier text of the same label.
    Texts that share one of the eight smallest hashes of their shingles are compared."""
    kept: list[int] = []
    at: dict[tuple[int, int], list[int]] = {}
    own: dict[int, np.ndarray] = {}
    for i, words in enumerate(texts):
        held = np.zeros(max(1, len(words) - 2), np.uint64)
        for k in range(min(3, len(words))):
            held = (held ^ (words[k : k + len(held)].astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
            held ^= held >> np.uint64(29)
        held = np.unique((held >> np.uint64(32)).astype(np.uint32))
        keys = [(labels[i], h) for h in held[:8].tolist()]
        others = {j for k in keys for j in at.get(k, ())}
        if any((same := len(np.intersect1d(held, own[j], True))) >= NEAR * (len(held) + len(own[j]) - same) for j in others):
            continue
        kept.append(i)
        own[i] = held
        for k in keys:
            at.setdefault(k, []).append(i)
    return kept


def _document_counts(word: list[np.ndarray], labels: list[int], first: np.ndarray, feature: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """In how many clean and toxic documents each feature is. word: the distinct
    words of each document; feature: those of all words, from first[w] on."""
    seen = np.zeros((2, n), np.int64)
    for ws, label in zip(word, labels, strict=True):
        size = first[ws + 1] - first[ws]
        place = np.repeat(first[ws] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        seen[label, np.unique(feature[place])] += 1
    return seen[0], seen[1]


def fit(found: list[str], labels: list[int]) -> Model:
    """found is emptied, so that texts and what is made of them aren't held at once."""
    y = np.array(labels, np.float64)
    share = float(y.mean()) if len(y) else 0.0
    if not 0 < share < 1:
        logit = math.log((share or 1e-9) / (1 - share)) if share < 1 else 30.0
        return Model({}, -6.0, np.zeros((2, 2)), np.array([max(logit, -30.0), 0, 0, 0]))
    index: dict[str, int] = {}
    numbers = []
    while found:  # texts go as they are read
        ws = TOKEN.findall(found.pop())
        numbers.append(np.fromiter((index.setdefault(w.lower(), len(index)) for w in ws), np.int32, len(ws)))
    numbers.reverse()
    # near copies would make any of their words stand out
    chosen = without_near_copies(numbers, labels)
    numbers, labels = [numbers[i] for i in chosen], [labels[i] for i in chosen]
    y = np.array(labels, np.float64)
    nt, nc = sum(labels), len(labels) - sum(labels)
    sizes = [len(x) for x in numbers]
    flat = np.concatenate(numbers)
    named: dict[str, int] = {}
    count = np.fromiter((len(features(w)) for w in index), np.int64, len(index))
    feature = np.fromiter((named.setdefault(f, len(named)) for w in index for f in features(w)), np.int32, int(count.sum()))
    first, own = np.concatenate([[0], np.cumsum(count)]), np.repeat(np.arange(len(index), dtype=np.int32), count)
    del index
    clean, toxic = _document_counts([np.unique(x) for x in numbers], labels, first, feature, len(named))
    odds = np.log((toxic + 0.25) / (nt + 0.5)) - np.log((clean + 0.25) / (nc + 0.5))
    seeds = (toxic >= max(LEAST_TOXIC, LEAST_SHARE * nt)) & (odds >= LEAST_ODDS)
    # the field weighs features of several toxic documents
    weighed = toxic >= LEAST_TOXIC
    marked = np.bincount(own, seeds[feature], len(count)) > 0
    names = [f for f, ok in zip(named, weighed, strict=True) if ok]
    own, feature = own[weighed[feature]], (np.cumsum(weighed) - 1)[feature[weighed[feature]]]
    del named, numbers
    target = marked[flat] & np.repeat(y > 0, sizes)
    follows = np.ones(len(flat), bool)  # words with one before them in their text
    follows[(np.cumsum(sizes) - sizes)[np.array(sizes) > 0]] = False
    weights, bias, move = np.zeros(len(names)), -4.0, np.zeros((2, 2))
    pairs = 2 * np.roll(target, 1)[follows] + target[follows]
    seen = np.bincount(pairs, minlength=4).reshape(2, 2).astype(np.float64)
    # in groups of texts, for the messages take several times the room
    starts = np.flatnonzero(np.diff(np.cumsum(sizes) // FIT_WORDS, prepend=-1)).tolist()
    parts = [(int(np.sum(sizes[:a])), Chains(sizes[a:b])) for a, b in zip(starts, [*starts[1:], len(sizes)], strict=True)]
    n = max(1.0, float(target.sum()))
    square = np.full(len(names), 1e-6)
    square_move, square_bias = np.full((2, 2), 1e-6), 1e-6
    for _ in range(STEPS):
        by_word = np.bincount(own, weights[feature], len(marked)) + bias
        off, moves = target.astype(np.float64), np.zeros((2, 2))
        for at, chains in parts:
            part = slice(at, at + int(chains.sizes.sum()))
            p, some = chains.marginals(by_word[flat[part]], move, True)
            off[part] -= p
            moves += some
        grad_word = np.bincount(flat, off, len(marked))
        grad = np.bincount(feature, grad_word[own], len(names)) / n - DECAY * weights
        square += grad**2
        weights += RATE * grad / np.sqrt(square)
        grad_move = (seen - moves) / n - DECAY * move
        square_move += grad_move**2
        move += RATE * 0.2 * grad_move / np.sqrt(square_move)
        grad_bias = off.sum() / n
        square_bias += grad_bias**2
        bias += RATE * 0.2 * grad_bias / math.sqrt(square_bias)
    weights[np.abs(weights) <= 1e-3] = 0.0
    by_word = np.bincount(own, weights[feature], len(marked)) + bias
    p = np.concatenate([chains.marginals(by_word[flat[at : at + int(chains.sizes.sum())]], move)[0] for at, chains in parts])
    return Model({f: w for f, w in zip(names, weights.tolist(), strict=True) if w}, float(bias), move, _logistic(document_evidence(p, sizes), y))


def _logistic(x: np.ndarray, y: np.ndarray, decay: float = 1e-3) -> np.ndarray:
    """Weights of logistic regression by Newton steps, the constant first."""
    x = np.concatenate([np.ones((len(x), 1)), x], 1)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x / len(x) + decay * np.eye(x.shape[1])
        w = w + np.linalg.solve(h, x.T @ (y - p) / len(x) - decay * w)
    return w


def held_out():
    """Whether a document is not learnt from: crc32 of its id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of about SAMPLE labelled documents of each class, none of them
    held out. They are chosen from the labels alone, by a hash of their ids, so
    no text is moved but theirs: each class's share is such that 1.5 times
    SAMPLE are expected, and no more than twice SAMPLE are taken."""
    known = labels.where("toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") != 0).cast("int").alias("toxic")).where(~held_out())
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = None
    for label, n in sorted(counts.items()):
        some = known.where((F.col("toxic") == label) & (place < 1.5 * SAMPLE / n)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * SAMPLE)
        chosen = some if chosen is None else chosen.unionByName(some)
    if chosen is None:
        return fit([], [])
    # four times SAMPLE rows at most; a document with both labels is toxic
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = texts(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic").collect()
    rows.sort()
    labels_ = [r["toxic"] for r in rows]
    found = [r["text"] for r in rows]
    del rows
    model = fit(found, labels_)
    release()
    return model


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD, offsets: bool = False) -> DataFrame:
    """doc_id, score, predicted and, if asked for, spans: offending offsets."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # weights of features that the sample holds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        sole_memo("toxicity", m.memo.clear)
        for batch in batches:
            for at, n in slices(batch):
                part = batch.slice(at, n)
                found = part.column("text").to_pylist()
                score = m.score(found)
                cols = [part.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))]
                if offsets:
                    cols.append(pa.array([[{"start": a, "end": b} for a, b in m.spans(t)] if s >= threshold else [] for t, s in zip(found, score, strict=True)], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "score", "predicted", *["spans"] * offsets])

    return texts(docs).mapInArrow(run, "doc_id long, score double, predicted int" + ", spans array<struct<start: int, end: int>>" * offsets)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return scored(docs, train(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def clean_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are not predicted toxic, all columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_memo("toxicity", shared.value.memo.clear)
        for batch in batches:
            for start, n in slices(batch):
                part = batch.slice(start, n)
                score = shared.value.score([t or "" for t in part.column(at).to_pylist()])
                yield part.filter(pa.array(score < threshold))

    return docs.mapInArrow(run, docs.schema)
