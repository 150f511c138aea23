"""Token ids of whole texts with the installed word-level BPE, a white-space run of characters at a time.

The tokenizer joins nothing across white space, so the ids of a text are those of its chunks, and chunks
repeat: each worker keeps the ids of the chunks it has seen lately. The merging is the library's. A chunk with a
code point that this Python's Unicode tables do not have goes to the library as it is, since newer tables may
know how to compose it or what its small letter is.
"""

from __future__ import annotations

import sys
import unicodedata
from array import array

import regex

#: White space as the tokenizer sees it; str.split() takes four control characters more.
_SPACE = regex.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
#: The tokenizer's own split of a chunk (a fixed value of its file).
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_CONTROL = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Chunks that a worker remembers; twice as many for a while. About 0.2 kB each.
REMEMBERED = 200_000


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level BPE files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, other = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(other)
            other += 1
    return out


def _packed(ids: list[int]) -> bytes:
    out = array("H", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


#: The bytes of each id.
_PAIRS = [i.to_bytes(2, "little") for i in range(1 << 16)]
#: Signs that are one part wherever they come together.
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class Encoder:
    """encode(text) gives the ids as little-endian 16-bit bytes."""

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        from tokenizers import Tokenizer

        self._most = remembered
        self._whole = Tokenizer.from_file(path)
        self._model = self._whole.model
        if self._whole.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit in 16 bits")
        self._letters = _byte_letters()
        self._assigned: dict[str, bool] = {}
        self._recent: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        if "<|" in text:  # may hold a special token, which the library finds before anything else
            return b"".join([self._special(c) if "<|" in c else self.encode(c) for c in _SPACE.split(text) if c])
        if not text.isascii() and (odd := self._unassigned(text)):
            return b"".join([self._special(c) if not odd.isdisjoint(c) else self.encode(c) for c in _SPACE.split(text) if c])
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # each letter by itself: no final sigma
        chunks = [c for c in _SPACE.split(text) if c] if any(c in text for c in _CONTROL) else text.split()
        get = self._recent.get
        found = [get(c) for c in chunks]
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    found[i] = self._known(chunks[i])
        return b"".join(found)

    def _unassigned(self, text: str) -> set[str]:
        """The code points of the text that Python does not know; what it says of each is remembered."""
        out = set()
        for c in set(text):
            known = self._assigned.get(c)
            if known is None:
                known = self._assigned[c] = unicodedata.category(c) != "Cn"
            if not known:
                out.add(c)
        return out

    def _known(self, chunk: str) -> bytes:
        """The ids of a chunk, or of a part of one."""
        ids = self._recent.get(chunk)
        if ids is None:
            ids = self._older.get(chunk)
            if ids is None:
                ids = self._new(chunk)
            if len(chunk) <= 64:
                if len(self._recent) >= self._most:
                    self._older, self._recent = self._recent, {}
                self._recent[chunk] = ids
        return ids

    def _new(self, chunk: str) -> bytes:
        if not chunk.isalpha():
            # letters and either one more character or signs are two parts without asking the pattern
            head = chunk.rstrip(_SIGNS) if chunk[-1] in _SIGNS else chunk[:-1]
            parts = [head, chunk[len(head) :]] if head.isalpha() else _SPLIT.findall(chunk)
            if len(parts) > 1:
                get = self._recent.get
                return b"".join([get(p) or self._known(p) for p in parts])
        spelled = chunk if chunk.isascii() and chunk.isprintable() else "".join([self._letters[b] for b in chunk.encode()])
        return b"".join([_PAIRS[t.id] for t in self._model.tokenize(spelled)])

    def _special(self, chunk: str) -> bytes:
        return _packed(self._whole.encode(chunk, add_special_tokens=False).ids)


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, remembered: int = REMEMBERED) -> Encoder:
    """The encoder of this process for a tokenizer file, which remembers so many chunks."""
    if (path, remembered) not in _encoders:
        _encoders[path, remembered] = Encoder(path, remembered)
    return _encoders[path, remembered]


def forget() -> None:
    """Drops what the encoders of this process remember."""
    _encoders.clear()
