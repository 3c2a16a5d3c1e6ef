"""Token ids of whole texts through the ``tokenizers`` library, with bounded caches of words."""

from __future__ import annotations

import json

import numpy as np
import regex

# The one normalizer and splitter of which the cached path below is known to be the same.
KNOWN_NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
KNOWN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# In texts without these, white space bounds words, NFC changes nothing and lower case is the same by character.
_UNUSUAL = np.ones(1 << 16, bool)
_UNUSUAL[:0x300] = False
_UNUSUAL[[0x1C, 0x1D, 0x1E, 0x1F, 0x130]] = True


def unusual(text: str) -> bool:
    return bool(_UNUSUAL[np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16)].any())


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 characters stand for themselves, other bytes follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Cache(dict):
    """word -> ids as little-endian uint32 bytes; emptied when ``limit`` words are held."""

    def __init__(self, make, limit: int) -> None:
        self.make, self.limit = make, limit

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        out = self[word] = self.make(word)
        return out


class TextTokenizer:
    """ids(text) are exactly those of ``Tokenizer.encode(text, add_special_tokens=False)``.

    For a tokenizer of the known form every blank-separated word of a usual text has ids of its own, so words
    are looked up; texts with unusual characters or spelled special tokens, and other tokenizers, are encoded
    as a whole."""

    def __init__(self, path: str, limit: int = 400_000) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec.get("pre_tokenizer") or {}
        parts = split.get("pretokenizers", [{}])
        self.by_word = (spec.get("normalizer") == KNOWN_NORMALIZER and spec["model"]["type"] == "BPE" and len(parts) == 2
                        and parts[0].get("pattern") == {"Regex": KNOWN_SPLIT} and parts[0].get("invert") is True and parts[0].get("behavior") == "Removed"
                        and parts[1].get("type") == "ByteLevel" and not parts[1].get("add_prefix_space") and not parts[1].get("use_regex"))
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(regex.escape(t) for t in special)) if special else None
        self.pieces = regex.compile(KNOWN_SPLIT)
        self.letters = _byte_letters()
        self.words, self.parts = _Cache(self._word, limit), _Cache(self._part, limit)

    def _part(self, part: str) -> bytes:
        if not part.isascii():
            part = part.encode().decode("latin-1")
        return np.array([t.id for t in self.whole.model.tokenize(part.translate(self.letters))], "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if word.isalpha():
            return self.parts[word]
        if word[-1] in ".,;:!?" and word[:-1].isalpha():
            return self.parts[word[:-1]] + self.parts[word[-1]]
        return b"".join(map(self.parts.__getitem__, self.pieces.findall(word)))

    def ids(self, text: str) -> bytes:
        """The ids as little-endian uint32 bytes."""
        if self.by_word and not unusual(text) and not (self.special and self.special.search(text)):
            return b"".join(map(self.words.__getitem__, text.lower().split()))
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_LOADED: dict[str, TextTokenizer] = {}


def tokenizer(path: str) -> TextTokenizer:
    """The tokenizer of ``path``, loaded once in each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = TextTokenizer(path)
    return _LOADED[path]
