"""Token ids of white-space separated words under a ``tokenizers`` file whose tokens never span white space.

ASCII white space always ends a token there, so a text's ids are its words'
ids in order, and each distinct word needs encoding only once.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import codes_of, list_lengths

# Contractions, letters and digits of the tokenizer's split pattern, for characters below U+0180.
_LETTER = "a-zªµºß-öø-ſ"
_DIGIT = "0-9²³¹¼-¾"
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^{_LETTER}{_DIGIT}]+")
_PLAIN = re.compile("[!-~¡-¬®-įı-ſ]+")


def _byte_letters() -> dict[int, int]:
    """The public byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest follow from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return dict(zip(shown, shown)) | {b: 256 + i for i, b in enumerate(rest)}


class WordIds:
    """Encodes words; remembers the ids of at most ``limit`` word pieces."""

    def __init__(self, path: str, limit: int = 400_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.tok.encode_special_tokens = False
        self.model, self.limit = self.tok.model, limit
        self.table = _byte_letters()
        self.cache: dict[str, bytes] = {}
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.marks = {s[0] for s in self.special}

    def _piece(self, p: str) -> bytes:
        s = p if p.isascii() else p.encode().decode("latin-1").translate(self.table)
        return array("I", [t.id for t in self.model.tokenize(s)]).tobytes()

    def _whole(self, w: str) -> bytes:
        return array("I", self.tok.encode(w, add_special_tokens=False).ids).tobytes()

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, ids per word)."""
        cache, find, plain, out, n = self.cache, _PIECE.findall, _PLAIN.fullmatch, [], []
        for w in words:
            if plain(w) and not any(m in w for m in self.marks):
                size = 0
                for p in find(w.lower()):
                    b = cache.get(p)
                    if b is None:
                        if len(cache) >= self.limit:
                            cache.clear()
                        b = cache[p] = self._piece(p)
                    out.append(b)
                    size += len(b)
            else:
                b = self._whole(w)
                out.append(b)
                size = len(b)
            n.append(size >> 2)
        return np.frombuffer(b"".join(out), dtype="<u4"), np.asarray(n, dtype=np.int64)


_CODERS: dict[str, WordIds] = {}


def coder(path: str) -> WordIds:
    """The worker's coder of a tokenizer file."""
    if path not in _CODERS:
        _CODERS[path] = WordIds(path)
    return _CODERS[path]


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(words per text, code per word, distinct words) over ASCII white space; empty words are left in with code of ''."""
    lists = pc.ascii_split_whitespace(texts)
    codes, distinct = codes_of(lists.flatten())
    return list_lengths(lists), codes, distinct
