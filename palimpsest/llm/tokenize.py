"""Encoding whole texts with the `tokenizers` library, remembering the ids of pre-tokens that recur.

A text of Latin letters, digits, ASCII punctuation and single blanks or line ends is cut into its
pre-tokens here, by the tokenizer's own pattern over that alphabet, and each distinct pre-token goes to
the library's BPE model once.  Any other text is encoded whole by the library.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks side by side

_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ\u0100-\u012f\u0131-\u017f"
_PUNCT = r"!-/:-@\[-`{-~"
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
#: The byte-level pattern: a blank goes with what follows; a lone line end stands alone.  Other white space finds no match.
_BYTE_LEVEL = re.compile(rf"{_SHORT}| ?[{_LETTER}]+| ?[0-9]+| ?[{_PUNCT}]+|\n(?=\S)")
#: The lower-casing pattern: white space is dropped, digits stand alone.
_WORD_LEVEL = re.compile(rf"{_SHORT}|[{_LETTER}]+|[0-9]|[{_PUNCT}]+|[ \n\t\r]+")
#: Entries of a table of a Python process, about 150 bytes each; each table keeps its last two generations.
_BOUND = 500_000


class _Remembered(dict):
    """Values by key, made when first asked for; frequent keys survive the change of generations."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        value = self.old.get(key, self)
        if value is self:
            value = self.make(key)
        if len(self) >= _BOUND:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def _byte_letters() -> dict[int, str]:
    """The letter by which byte-level BPE shows each byte: printable ones as they are, others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """One tokenizer file.  ``encode(texts)`` returns the ids of each text; null is empty."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.tok.get_vocab_size() <= 65536 else np.dtype("<u4")
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.drops_space = told["normalizer"] is not None  # the lower-casing kind, which drops white space
        #: A text that holds one of these is left to the library, which takes it out before anything else.
        self.added = [t["content"] for t in told["added_tokens"]]
        self.letters = _byte_letters()
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.parts = _Remembered(self._part)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tok.encode_batch(texts, add_special_tokens=False)]

    def _part(self, s: str) -> bytes:
        """Ids of one pre-token."""
        if self.drops_space and s.isspace():
            return b""
        if s.isascii() and s[0] > " ":
            shown = s
        elif s.isascii() and s[1:].isprintable() and s[0] == " ":
            shown = self.letters[32] + s[1:]
        else:
            shown = s.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.tok.model.tokenize(shown)]).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian ids of each text."""
        out: list[bytes | None] = []
        get, cut = self.parts.__getitem__, (_WORD_LEVEL if self.drops_space else _BYTE_LEVEL).findall
        for t in texts:
            if any(a in (t or "") for a in self.added):
                out.append(None)
                continue
            given = (t or "").lower() if self.drops_space else t or ""
            found = cut(given)
            out.append(b"".join(map(get, found)) if sum(map(len, found)) == len(given) else None)
        whole = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(whole, self._encode([texts[i] for i in whole]), strict=True):
            out[i] = ids
        return out


_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a file, loaded once in each Python process."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def slices(texts: list[str | None], most: int = 4_000_000):
    """Ranges of ``texts`` of at most about ``most`` characters, one text at least."""
    begin = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > begin and size + n > most:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)
