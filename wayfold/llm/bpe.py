"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The vocabulary file gives ranked merges over byte symbols. Words (pieces of the
pre-tokeniser) that are frequent in the corpus are compiled, with their ids,
into a minimal acyclic automaton: suffixes are shared, and every transition
carries a number so that the numbers along a word sum to its index in the id
table. The automaton is one flat file that executors map into memory. A word
that it does not hold is merged exactly, so the result never depends on which
words were compiled.

Nulls count as empty texts and give no ids. The special string of the vocabulary
inside a text becomes its id, as the tokenizers library does by default. Very
long texts, and very long words, are encoded whole. Of words that occur equally
often, the lexicon takes all or none. Repeated rows give repeated results, a
null doc_id is a row like any other, an empty table gives no rows. Other columns
are ignored by encoding and kept by decoding, which replaces a column `decoded`.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import struct
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import ship, shipped, slices, stored, texts
from wayfold.llm.pieces import byte_symbols, splitter

#: Words that a compiled lexicon holds at most; the others are merged exactly.
LEXICON_WORDS = 65536
#: Entries of a worker's memo of words, which is emptied beyond it.
MEMO_WORDS = 400_000
#: Counts that a task holds before it hands them on.
COUNT_WORDS = 400_000


class Vocabulary:
    """Merges, ids and pre-tokeniser of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, symbols = spec["model"], byte_symbols()
        back = {c: b for b, c in enumerate(symbols)}
        as_bytes = lambda s: bytes(back[c] for c in s)
        ids = {as_bytes(k): v for k, v in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.byte_ids = [ids[bytes([b])] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = map(as_bytes, pair.split(" ") if isinstance(pair, str) else pair)
            self.merges[ids[a], ids[b]] = (rank, ids[a + b])
        self.table: list[bytes] = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
        for k, v in ids.items():
            self.table[v] = k
        for k, v in self.special.items():
            self.table[v] = k.encode()
        self.piece = splitter()
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: the best-ranked adjacent pair, leftmost first, is
        merged until none is left."""
        ids = [self.byte_ids[b] for b in word]
        merges = self.merges
        if len(ids) > 48:
            return self._merge_long(ids)
        while len(ids) > 1:
            best, at = None, -1
            for i in range(len(ids) - 1):
                m = merges.get((ids[i], ids[i + 1]))
                if m is not None and (best is None or m[0] < best[0]):
                    best, at = m, i
            if best is None:
                break
            ids[at : at + 2] = [best[1]]
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, merges = len(ids), self.merges
        left, right, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = right[i] if alive[i] else -1
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], right[i] = new, False, right[j]
            if right[j] >= 0:
                left[right[j]] = i
                if (m := merges.get((new, ids[right[j]]))) is not None:
                    heapq.heappush(heap, (m[0], i, new, ids[right[j]], m[1]))
            if left[i] >= 0 and (m := merges.get((ids[left[i]], new))) is not None:
                heapq.heappush(heap, (m[0], left[i], ids[left[i]], new, m[1]))
        return [x for x, ok in zip(ids, alive, strict=True) if ok]

    def pieces(self, text: str) -> list[str]:
        """Words of a text; special strings stand by themselves."""
        if self.split is None or not any(s in text for s in self.special):
            return self.piece(text)
        out: list[str] = []
        for part in self.split.split(text):
            out.extend([part] if part in self.special else self.piece(part))
        return out


class Lexicon:
    """A minimal acyclic automaton over bytes, in one flat buffer.

    Layout: magic, number of states, transitions, words and ids; first
    transition of each state; label, target and skip of each transition (skip:
    accepted words that sort before it from its state); finality of each state;
    offsets into the id list for each word; the ids.
    """

    MAGIC = b"WFL1"

    def __init__(self, buffer):
        magic, states, moves, words, ids = struct.unpack_from("<4sIIII", buffer)
        if magic != self.MAGIC:
            raise ValueError("not a lexicon file")
        at, arrays = 20, []
        for kind, n in (("<u4", states + 1), ("<u4", moves), ("<u4", moves), ("<u4", words + 1), ("<u4", ids), ("u1", moves), ("u1", states)):
            arrays.append(np.frombuffer(buffer, kind, n, at))
            at += arrays[-1].nbytes
        self.first, self.target, self.skip, self.offset, self.ids, self.label, self.final = arrays
        self.labels = self.label.tobytes()

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    @classmethod
    def compile(cls, words: Iterable[tuple[bytes, list[int]]]) -> bytes:
        """words: distinct and sorted by their bytes; the empty word is not allowed."""
        registry: dict[tuple, int] = {}
        states: list[tuple] = []  # (final, ((label, state), ...)), children first
        path: list[list] = [[False, []]]  # the unfinished states of the last word
        last, ids, offsets = b"", [], [0]

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                final, moves = path.pop()
                key = (final, tuple(moves))
                state = registry.get(key)
                if state is None:
                    state = registry[key] = len(states)
                    states.append(key)
                path[-1][1].append((last[len(path) - 1], state))

        for word, out in words:
            if word <= last:
                raise ValueError("words must be sorted, distinct and not empty")
            k = next((i for i, (a, b) in enumerate(zip(word, last)) if a != b), min(len(word), len(last)))
            close(k)
            path.extend([False, []] for _ in word[k:])
            path[-1][0] = True
            last = word
            ids.extend(out)
            offsets.append(len(ids))
        close(0)
        states.append((path[0][0], tuple(path[0][1])))
        held = []
        for final, moves in states:
            held.append(int(final) + sum(held[s] for _, s in moves))
        first, label, target, skip = [0], [], [], []
        for final, moves in states:
            before = int(final)
            for c, s in moves:
                label.append(c)
                target.append(s)
                skip.append(before)
                before += held[s]
            first.append(len(label))
        head = struct.pack("<4sIIII", cls.MAGIC, len(states), len(label), len(offsets) - 1, len(ids))
        return head + b"".join(np.array(x, k).tobytes() for k, x in (("<u4", first), ("<u4", target), ("<u4", skip), ("<u4", offsets), ("<u4", ids), ("u1", label), ("u1", [f for f, _ in states])))

    def index(self, word: bytes) -> int:
        """Rank of the word among those held, or -1."""
        state, rank, first = len(self.final) - 1, 0, self.first
        for c in word:
            a = int(first[state])
            at = self.labels.find(c, a, int(first[state + 1]))
            if at < 0:
                return -1
            rank += int(self.skip[at])
            state = int(self.target[at])
        return rank if self.final[state] else -1

    def get(self, word: bytes) -> np.ndarray | None:
        i = self.index(word)
        return None if i < 0 else self.ids[self.offset[i] : self.offset[i + 1]]


class Encoder(dict):
    """Memo from a word to its ids as little-endian 32-bit bytes."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None):
        super().__init__()
        self.vocabulary, self.lexicon = vocabulary, lexicon

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMO_WORDS:
            self.clear()
        v, raw = self.vocabulary, word.encode()
        if word in v.special:
            out = struct.pack("<I", v.special[word])
        elif self.lexicon is not None and (ids := self.lexicon.get(raw)) is not None:
            out = ids.tobytes()
        else:
            ids = v.merge(raw)
            out = struct.pack(f"<{len(ids)}I", *ids)
        self[word] = out
        return out

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.vocabulary.pieces(text)))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.vocabulary.table.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_workers: dict[tuple, object] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of this process, read once."""
    if ("v", path) not in _workers:
        _workers["v", path] = Vocabulary(path)
    return _workers["v", path]


def encoder(path: str, lexicon: str | None) -> Encoder:
    if ("e", path, lexicon) not in _workers:
        for k in [k for k in _workers if k[0] == "e"]:
            del _workers[k]
        _workers["e", path, lexicon] = Encoder(vocabulary(path), Lexicon.mapped(shipped(lexicon)) if lexicon else None)
    return _workers["e", path, lexicon]


def word_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(word, n): how often each word of the pre-tokeniser occurs in all texts.
    Tasks count before they shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, held = vocabulary(tokenizer), Counter()

        def out() -> Iterator[pa.RecordBatch]:
            items = list(held.items())
            held.clear()
            for i in range(0, len(items), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array([w.encode() for w, _ in items[i : i + 50_000]], pa.binary()), pa.array([n for _, n in items[i : i + 50_000]], pa.int64())], ["word", "n"])

        for batch in batches:
            column = batch.column("text")
            for at, n in slices(batch):
                for text in column.slice(at, n).to_pylist():
                    held.update(v.pieces(text))
                if len(held) > COUNT_WORDS:
                    yield from out()
        yield from out()

    return texts(docs).select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, tokenizer: str, words: int = LEXICON_WORDS) -> list[bytes]:
    """The words of two bytes or more with the highest counts in the corpus,
    sorted by their bytes: all that occur at least t times, for the smallest t
    (two or more) that leaves at most `words` of them. t comes from the histogram
    of counts, so no task or driver sorts or holds more than these words."""
    counts = stored(word_counts(docs, tokenizer).where((F.col("n") > 1) & F.length("word").between(2, 64)))
    # numbers of words by count; counts beyond `words` are too few to matter apart
    bins = counts.groupBy(F.least("n", F.lit(words)).alias("n")).agg(F.count("*").alias("k")).collect()
    least, held = words + 1, 0
    for r in sorted(bins, key=lambda r: -r["n"]):
        if held + r["k"] > words:
            break
        least, held = r["n"], held + r["k"]
    return sorted(bytes(r["word"]) for r in counts.where(F.col("n") >= least).select("word").collect())


def compile_lexicon(docs: DataFrame, tokenizer: str, words: int = LEXICON_WORDS) -> str:
    """Count, compile, and ship the lexicon; returns the file's name."""
    v = vocabulary(tokenizer)
    chosen = [w for w in frequent_words(docs, tokenizer, words) if w.decode("utf-8", "replace") not in v.special]
    data = Lexicon.compile((w, v.merge(w)) for w in chosen)
    return ship(docs.sparkSession, "lexicon.bin", data)


def encode(docs: DataFrame, tokenizer: str, lexicon: str | None = None) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), n_tokens."""
    lexicon = lexicon or compile_lexicon(docs, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer, lexicon)
        for batch in batches:
            for at, n in slices(batch):
                part = batch.slice(at, n)
                ids = [e.encode(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], ["doc_id", "ids", "n_tokens"])

    return texts(docs).mapInArrow(run, "doc_id long, ids binary, n_tokens long")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """The input's columns and decoded, the text that the ids stand for; bytes
    that are no UTF-8 become the replacement character."""
    encoded = encoded.drop("decoded")
    fields = encoded.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer, None)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = [e.decode(x or b"") for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string())], [*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, fields.simpleString()[7:-1].replace(":", " ") + ", decoded string")


def round_trip_digests(docs: DataFrame, tokenizer: str, lexicon: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document: encoding
    and decoding follow each other in one task, and only digests leave it."""
    lexicon = lexicon or compile_lexicon(docs, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer, lexicon)
        hexed = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            for at, n in slices(batch):
                part = batch.slice(at, n)
                ids = [e.encode(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hexed(x) for x in ids]), pa.array([hexed(e.decode(x).encode()) for x in ids])],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
