"""Token counts by compiled finite-state transducers.

Two deterministic transducers follow each other.

* The word splitter reads one symbol a character (its class, joined with what
  the next characters decide) and marks where words start. Texts are cut into
  chunks of fixed length. Each chunk gives a map from every state it may be
  entered in to the state it is left in; a parallel prefix scan composes the
  maps, so all chunks, also those of one very long text, run side by side.
* The counter reads a word's characters. Each transition is annotated with the
  number of tokens that it adds (it may take some back), so that the numbers
  along a word sum to its count. It holds the frequent words of the corpus;
  the count of any other word comes from exact merging.

Nulls count as empty texts (0 bytes, 0 tokens). Very long texts are read whole.
Special strings in a text count as one token each, as the tokenizers library
does by default. Repeated rows repeat, a null doc_id is a row like any other, an
empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from wayfold.llm.bpe import MEMO_WORDS, Vocabulary, frequent_words, vocabulary
from wayfold.llm.common import ship, shipped, slices, texts

#: Words of the counting transducer at most; the others are merged exactly.
COUNTER_WORDS = 32768
CHUNK = 128
#: Longest word that the counting transducer is asked for.
WORD_CHARS = 40
#: Bits of a symbol's number: code points have 21.
SYMBOL_BITS = 21

LETTER, NUMBER, OTHER, GLUE, LAST, SPACE, SHORT, LONG = range(8)  # symbols
START, IN_LETTER, IN_NUMBER, IN_OTHER, GLUED, IN_SPACE, ONE_MORE, TWO_MORE = range(8)  # states


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """next state and whether a word starts, by [state, symbol]."""
    to, begins = np.zeros((8, 8), np.uint8), np.ones((8, 8), bool)
    for state in range(8):
        for symbol, into in ((LETTER, IN_LETTER), (NUMBER, IN_NUMBER), (OTHER, IN_OTHER)):
            to[state, symbol] = into
            begins[state, symbol] = state not in (into, GLUED)
        to[state, GLUE], to[state, LAST], to[state, SPACE] = GLUED, START, IN_SPACE
        begins[state, SPACE] = state != IN_SPACE
        for symbol, into in ((SHORT, ONE_MORE), (LONG, TWO_MORE)):  # an apostrophe before its letters
            joined = state in (IN_OTHER, GLUED)
            to[state, symbol] = IN_OTHER if joined else into
            begins[state, symbol] = not joined
    to[ONE_MORE, :], begins[ONE_MORE, :] = START, False
    to[TWO_MORE, :], begins[TWO_MORE, :] = ONE_MORE, False
    return to, begins


_classes: list[np.ndarray] = []


def char_classes() -> np.ndarray:
    """LETTER, NUMBER, SPACE or OTHER for every code point."""
    if not _classes:
        table = np.full(0x110000, OTHER, np.uint8)
        every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        shift = lambda i: i if i < 0xD800 else i + 0x800
        for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
            for m in regex.finditer(pattern, every):
                table[shift(m.start()) : shift(m.end() - 1) + 1] = kind
        _classes.append(table)
    return _classes[0]


def symbols(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """codes: characters of texts that follow each other. ends: for each text
    where it ends. What a text's last character sees next is white space."""
    kind = char_classes()[codes]
    ahead = np.empty_like(kind)
    ahead[:-1], ahead[-1:] = kind[1:], SPACE
    ahead[ends[ends > 0] - 1] = SPACE
    space = kind == SPACE
    out = kind.copy()
    last = space & (ahead != SPACE)
    out[last] = np.where(codes[last] == 32, GLUE, LAST)
    marks = np.flatnonzero(codes == 39)
    if len(marks):
        text = np.searchsorted(ends, marks, "right")
        room = ends[text] - marks
        pad = np.concatenate([codes, np.zeros(2, codes.dtype)])
        a, b = pad[marks + 1], pad[marks + 2]
        is_ = lambda x, c: x == ord(c)
        short = (room > 1) & (is_(a, "s") | is_(a, "t") | is_(a, "m") | is_(a, "d"))
        long = (room > 2) & ((is_(a, "r") & is_(b, "e")) | (is_(a, "v") & is_(b, "e")) | (is_(a, "l") & is_(b, "l")))
        out[marks[short]], out[marks[long]] = SHORT, LONG
    return out


def word_starts(symbol: np.ndarray, firsts: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Whether a word starts at each character; firsts: where texts start. The
    state is START there whatever came before."""
    to, begins = splitter()
    n = len(symbol)
    if not n:
        return np.zeros(0, bool)
    lanes = -(-n // chunk)
    # A text's first character resets: symbols 8..15 act as 0..7 do from START.
    table = np.concatenate([to, np.repeat(to[:1], 8, 0)], 1)
    marks = np.concatenate([begins, np.repeat(begins[:1], 8, 0)], 1)
    held = np.full(lanes * chunk, 16, np.uint8)  # 16: beyond the end, nothing moves
    held[:n] = symbol
    held[firsts[firsts < n]] += 8
    table = np.concatenate([table, np.arange(8, dtype=np.uint8)[:, None]], 1)
    marks = np.concatenate([marks, np.zeros((8, 1), bool)], 1)
    flat, cells = table.ravel(), np.ascontiguousarray(held.reshape(lanes, chunk).T).astype(np.intp)
    state = np.repeat(np.arange(8, dtype=np.uint8)[:, None], lanes, 1)
    for step in range(chunk):  # the map of every chunk
        state = flat[state.astype(np.intp) * 17 + cells[step]]
    maps, reach = state, 1
    while reach < lanes:  # inclusive scan: maps[:, i] becomes the map of chunks 0..i
        joined = maps.copy()
        joined[:, reach:] = np.take_along_axis(maps[:, reach:], maps[:, :-reach].astype(np.intp), 0)
        maps, reach = joined, reach * 2
    now = np.concatenate([[START], maps[START, :-1]]).astype(np.intp)
    out, mark = np.empty((chunk, lanes), bool), marks.ravel()
    for step in range(chunk):
        at = now * 17 + cells[step]
        out[step] = mark[at]
        now = flat[at].astype(np.intp)
    return out.T.ravel()[:n]


class Counter:
    """The counting transducer: a trie of words, its equivalent states merged,
    each transition with the tokens it adds. Transitions stand in one hash table
    by state and symbol, a quarter full, so its size goes with their number and
    not with that of the alphabet's symbols."""

    def __init__(self, key: np.ndarray, to: np.ndarray, adds: np.ndarray, final: np.ndarray, symbol: np.ndarray):
        self.key, self.to, self.adds, self.final, self.symbol = key, to, adds, final, symbol

    @staticmethod
    def _slot(key: np.ndarray, size: int) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - size.bit_length())).astype(np.int64)

    @classmethod
    def _table(cls, key: np.ndarray, to: np.ndarray, adds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = 1 << max(3, (4 * len(key)).bit_length())
        held, left, at = np.full(size, -1, np.int64), np.arange(len(key)), cls._slot(key, size)
        place = np.empty(len(key), np.int64)
        while len(left):  # those that find a free slot, the first of each slot, take it; the others go on
            own = at[left]
            first = np.unique(own, return_index=True)[1]
            first = first[held[own[first]] < 0]
            took = left[first]
            held[at[took]], place[took] = key[took], at[took]
            left = np.delete(left, first)
            at[left] = (at[left] + 1) % size
        out_to, out_adds = np.zeros(size, np.int32), np.zeros(size, np.int8)
        out_to[place], out_adds[place] = to, adds
        return held, out_to, out_adds

    def _cells(self, key: np.ndarray) -> np.ndarray:
        """Slots of transitions, -1 for those that there are not."""
        size = len(self.key)
        at = self._slot(key, size)
        seen = self.key[at]
        out = np.where(seen == key, at, -1)
        left = np.flatnonzero((seen != key) & (seen >= 0))
        while len(left):
            at[left] = (at[left] + 1) & (size - 1)
            seen = self.key[at[left]]
            hit = seen == key[left]
            out[left[hit]] = at[left[hit]]
            left = left[~hit & (seen >= 0)]
        return out

    @classmethod
    def compile(cls, words: list[str], v: Vocabulary) -> Counter:
        """Trie states are merged bottom-up where finality, transitions and
        annotations agree; a transition to a prefix that is no word adds nothing
        and the rest of the count comes when a word is complete."""
        alphabet = sorted({c for w in words for c in w})
        code = {c: i + 1 for i, c in enumerate(alphabet)}
        trie: list[list] = [[None, {}]]
        for w in words:
            at = 0
            for c in w:
                at = trie[at][1].setdefault(code[c], len(trie))
                if at == len(trie):
                    trie.append([None, {}])
            trie[at][0] = len(v.merge(w.encode()))
        # potential of a state: its own count if a word ends here, else its parent's
        potential = [0] * len(trie)
        for at, (_, moves) in enumerate(trie):
            for to in moves.values():
                potential[to] = trie[to][0] if trie[to][0] is not None else potential[at]
        registry, merged, rows = {}, [0] * len(trie), []
        for at in range(len(trie) - 1, -1, -1):  # children have higher numbers
            key = (trie[at][0] is not None, tuple(sorted((c, merged[to], potential[to] - potential[at]) for c, to in trie[at][1].items())))
            if key not in registry or at == 0:
                registry[key] = len(rows)
                rows.append(key)
            merged[at] = registry[key] if at else len(rows) - 1
        final = np.zeros(len(rows) + 1, bool)  # state 0: dead; the root is the last
        key, to, adds = [], [], []
        for i, (ends, moves) in enumerate(rows):
            final[i + 1] = ends
            for c, state, n in moves:
                key.append(((i + 1) << SYMBOL_BITS) | c)
                to.append(state + 1)
                adds.append(n)
        symbol = np.zeros(0x110000, np.int32)
        symbol[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        return cls(*cls._table(np.array(key, np.int64), np.array(to, np.int32), np.array(adds, np.int8)), final, symbol)

    def counts(self, codes: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Tokens of the words at these places, -1 where the word is unknown."""
        root = len(self.final) - 1
        out = np.full(len(at), -1, np.int64)
        lanes = np.flatnonzero(length <= WORD_CHARS)
        order = lanes[np.argsort(length[lanes], kind="stable")]
        place, size = at[order], length[order]
        state, total = np.full(len(order), root, np.int64), np.zeros(len(order), np.int64)
        seen = self.symbol[codes].astype(np.int64)
        done = 0
        for step in range(int(size[-1]) if len(size) else 0):
            done = int(np.searchsorted(size, step, "right"))
            cell = self._cells((state[done:] << SYMBOL_BITS) | seen[place[done:] + step])
            total[done:] += np.where(cell < 0, 0, self.adds[cell])
            state[done:] = np.where(cell < 0, 0, self.to[cell])
        known = self.final[state]
        out[order[known]] = total[known]
        return out


_workers: dict[str, Counter] = {}


def counter(name: str) -> Counter:
    if name not in _workers:
        _workers.clear()
        with open(shipped(name), "rb") as f:
            _workers[name] = Counter(*pickle.load(f))
    return _workers[name]


_memo: dict[str, int] = {}


def exact(word: str, v: Vocabulary) -> int:
    n = _memo.get(word)
    if n is None:
        if len(_memo) >= MEMO_WORDS:
            _memo.clear()
        n = _memo[word] = len(v.merge(word.encode()))
    return n


def count_texts(found: list[str], v: Vocabulary, transducer: Counter) -> np.ndarray:
    """Tokens of each text."""
    parts, owner, extra = [], [], np.zeros(len(found), np.int64)
    for i, text in enumerate(found):
        if v.split is not None and any(s in text for s in v.special):
            for piece in v.split.split(text):
                if piece in v.special:
                    extra[i] += 1
                else:
                    parts.append(piece)
                    owner.append(i)
        else:
            parts.append(text)
            owner.append(i)
    joined = "".join(parts)
    codes = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    ends = np.cumsum([len(p) for p in parts]) if parts else np.zeros(0, np.int64)
    if not len(codes):
        return extra
    firsts = ends - [len(p) for p in parts]
    begins = np.flatnonzero(word_starts(symbols(codes, ends), firsts))
    length = np.diff(np.append(begins, len(codes)))
    n = transducer.counts(codes, begins, length)
    for k in np.flatnonzero(n < 0).tolist():
        a = int(begins[k])
        n[k] = exact(joined[a : a + int(length[k])], v)
    text = np.asarray(owner)[np.searchsorted(ends, begins, "right")]
    return extra + np.bincount(text, weights=n, minlength=len(found)).astype(np.int64)


def compile_counter(docs: DataFrame, tokenizer: str, words: int = COUNTER_WORDS) -> str:
    v = vocabulary(tokenizer)
    chosen = [w.decode() for w in frequent_words(docs, tokenizer, words)]
    made = Counter.compile([w for w in chosen if w not in v.special], v)
    data = pickle.dumps((made.key, made.to, made.adds, made.final, made.symbol))
    return ship(docs.sparkSession, "counter.bin", data)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, transducer: str | None = None) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit)."""
    transducer = transducer or compile_counter(docs, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        v, t = vocabulary(tokenizer), counter(transducer)
        for batch in batches:
            for at, n in slices(batch):
                part = batch.slice(at, n)
                got = count_texts(part.column("text").to_pylist(), v, t)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pc.cast(pc.binary_length(part.column("text")), pa.int64()), pa.array(got), pa.array(got > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
