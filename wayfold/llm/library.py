"""Ids by the tokenizers library, word by word.

The library works on each word of its pre-tokeniser by itself, so a text's ids
are its words' ids in a row. Distinct words go to the library's model in batches
and are remembered; texts that hold a special string go to the library whole.

A batch of words is one string in the byte symbols of the vocabulary, a line for
each word, for a copy of the tokenizer that splits at line ends and does nothing
else. Each symbol stands for a byte, so the lengths of the tokens say where a
word's ids end."""

from __future__ import annotations

import sys
from array import array
from itertools import islice

import numpy as np

from wayfold.llm.common import sole_memo
from wayfold.llm.pieces import byte_symbols, splitter

#: Words remembered by a process, unless an operator has room for more, about
#: 200 bytes each; beyond it all but the first MEMO_KEPT are dropped: common
#: words are met early.
MEMO_WORDS, MEMO_KEPT = 600_000, 300_000
#: New words that go to the library at once.
BATCH_WORDS = 4096


class LibraryEncoder:
    def __init__(self, path: str, narrow: bool = False, words: int = MEMO_WORDS):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        #: bytes of an id: 4, or 2 if narrow ids are asked for and fit
        self.width = 2 if narrow and self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self._code = ("H" if self.width == 2 else "I") if sys.byteorder == "little" else None
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces = splitter()
        self.words = words
        self.memo: dict[str, bytes] = {}
        self._lines = Tokenizer.from_file(path)
        self._lines.no_truncation()
        self._lines.no_padding()
        self._lines.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        symbols = byte_symbols()
        self._symbols, self._space = dict(enumerate(symbols)), symbols[32]
        self._size = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self._size[i] = len(token)

    def _raw(self, encoding) -> bytes:
        return array(self._code, encoding.ids).tobytes() if self._code else np.array(encoding.ids, f"<u{self.width}").tobytes()

    def _new(self, words: list[str]) -> list[bytes]:
        """Ids of words, none of which holds a special string."""
        held = [w.replace(" ", self._space) if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(self._symbols) for w in words]
        encoding = self._lines.encode_batch_fast(["\n".join(held)], add_special_tokens=False)[0]
        ids = np.array(encoding.ids, f"<u{self.width}")
        ends = np.searchsorted(np.cumsum(self._size[ids]), np.cumsum([len(h) for h in held])) + 1
        raw, at = ids.tobytes(), [0, *(ends * self.width).tolist()]
        return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned integers of `width` bytes."""
        if len(self.memo) > self.words:
            self.memo = dict(islice(self.memo.items(), MEMO_KEPT))
        memo, special = self.memo, self.special
        found: list[list[bytes | None]] = []
        gaps: list[tuple[list[bytes | None], list[str], list[int]]] = []
        for text in texts:
            if any(s in text for s in special):
                found.append([self._raw(self.tokenizer.encode(text, add_special_tokens=False))])
                continue
            words = self.pieces(text)
            ids = list(map(memo.get, words))
            if None in ids:
                gaps.append((ids, words, [i for i, x in enumerate(ids) if x is None]))
            found.append(ids)
        new = list({words[i] for _, words, at in gaps for i in at})
        if new:
            for k in range(0, len(new), BATCH_WORDS):
                memo.update(zip(new[k : k + BATCH_WORDS], self._new(new[k : k + BATCH_WORDS]), strict=True))
            for ids, words, at in gaps:
                for i in at:
                    ids[i] = memo[words[i]]
        return [b"".join(ids) for ids in found]


_workers: dict[tuple[str, bool, int], LibraryEncoder] = {}


def library_encoder(path: str, narrow: bool = False, words: int = MEMO_WORDS) -> LibraryEncoder:
    """The encoder of this process."""
    sole_memo("library", _workers.clear)
    if (path, narrow, words) not in _workers:
        _workers.clear()
        _workers[path, narrow, words] = LibraryEncoder(path, narrow, words)
    return _workers[path, narrow, words]
