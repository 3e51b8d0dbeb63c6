"""Token ids by a public tokenizer, with a bounded memory of words already seen."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np


#: Lower-case letters, then ASCII punctuation without the apostrophe: the tokenizer's own split falls between the
#: two, and either is one piece for its merges. Letters: a-z, and those of U+00DF to U+00FF in UTF-8.
_WORD_AND_TAIL = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])*)([!-&(-/:-@\[-`{-~]*)")


#: Longer parts are not remembered.
_LONGEST = 80


class WordEncoder:
    """``Tokenizer.encode(text, add_special_tokens=False)`` for a lower-casing tokenizer whose tokens never hold white space.

    Such a tokenizer treats the parts between white space one by one, so each
    distinct part is encoded once and looked up afterwards.  The memory has two
    generations of at most ``most_words`` parts (and those of one text): what
    was met in neither for so long is forgotten.
    """

    def __init__(self, path: str, most_words: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self._tokenizer = Tokenizer.from_file(path)
        self._most = most_words
        self._known = _Known(self._learn)
        self._before: dict[bytes, bytes] = {}
        #: ids as little-endian unsigned integers; two bytes where the vocabulary allows
        self.dtype = np.dtype("<u2" if self._tokenizer.get_vocab_size() <= 1 << 16 else "<u4")

        #: characters as the tokenizer's byte level writes them
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self._written = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100)}
        self._merge = self._tokenizer.model.tokenize
        self._code = {2: "H", 4: "I"}[self.dtype.itemsize]

    def _encode(self, part: bytes) -> bytes:
        ids = self._tokenizer.encode(part.decode(), add_special_tokens=False).ids
        return np.array(ids, self.dtype).tobytes()

    def _piece(self, part: bytes) -> bytes:
        """Ids of a word's letters, or of its punctuation."""
        tokens = self._merge(part.decode().translate(self._written))
        return array(self._code, [t.id for t in tokens]).tobytes()

    def _learn(self, part: bytes) -> bytes:
        before = self._before.get(part)
        if before is not None:
            return before
        halves = _WORD_AND_TAIL.fullmatch(part)
        if halves is None:
            return self._encode(part)
        word, tail = halves.groups()
        if word and tail:
            return self._known[word] + self._known[tail]
        return self._piece(part)

    def ids(self, text: bytes | None) -> np.ndarray:
        """Ids of a text in UTF-8."""
        if not text:
            return np.empty(0, self.dtype)
        if b"<|" in text:  # special tokens are found before lower-casing, so such texts are left as they are
            return np.frombuffer(self._encode(text), self.dtype)
        if len(self._known) > self._most:
            self._known, self._before = _Known(self._learn), self._known
        known = self._known
        # for bytes lower and split are ASCII only, as are the tokenizer's word ends here
        joined = b"".join([known[p] for p in text.lower().split()])
        return np.frombuffer(joined, self.dtype)


class _Known(dict):
    """Ids by part; a part that is missing is learnt."""

    def __init__(self, learn: Callable[[bytes], bytes]):
        super().__init__()
        self._learn = learn

    def __missing__(self, part: bytes) -> bytes:
        found = self._learn(part)
        if len(part) <= _LONGEST:
            self[part] = found
        return found


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One encoder per worker process and file."""
    return WordEncoder(path)
