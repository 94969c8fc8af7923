"""Token ids of texts by a tokenizers file, with a bounded memory of words seen.

A tokenizer that drops white space and never joins across it encodes a text as its words one after
another, so words are encoded once and remembered. The text of a word goes through the library
itself; only plain words of Latin letters take a shorter way (pre-split here, then the
library's model). Any other kind of tokenizer encodes whole texts.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import regex
from tokenizers import Tokenizer

#: Words and pieces remembered at most; the memory is emptied when full.
MOST_WORDS = 1 << 19

# How the vocabulary files' byte-level models write the 256 bytes as characters.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(_PRINTABLE))}


class _Pieces(dict):
    def __init__(self, model):
        self.model = model

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MOST_WORDS:
            self.clear()
        # visible ASCII characters stand for themselves
        shown = piece if piece.isascii() and piece.isprintable() and " " not in piece else piece.encode().decode("latin-1").translate(BYTE_CHARS)
        out = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(shown)])
        self[piece] = out
        return out


class WordTokens(dict):
    """``ids(text)``: the text's token ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        rule = json.loads(self.tokenizer.to_str())
        norm, pre = rule.get("normalizer") or {}, rule.get("pre_tokenizer") or {}
        steps = [x.get("type") for x in norm.get("normalizers", [])], [x.get("type") for x in pre.get("pretokenizers", [])]
        split = (pre.get("pretokenizers") or [{}])[0]
        special = [x for x in rule.get("added_tokens", []) if x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] or any(c.isspace() for c in x["content"])]
        # inverted and removed: what the pattern doesn't match, white space here, is dropped
        self.by_word = steps == (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) and split.get("behavior") == "Removed" and split.get("invert") is True and not special
        if self.by_word:
            self.pattern = regex.compile(split["pattern"]["Regex"])
            special = [regex.escape(x["content"]) for x in rule.get("added_tokens", [])]
            self.special = regex.compile("|".join(special) or r"(?!)")
            self.plain = regex.compile(r"[\x21-\x7e\xa1-ɏ]*")
            self.pieces = _Pieces(self.tokenizer.model)

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= MOST_WORDS:
            self.clear()
        text = word.decode()
        if self.plain.fullmatch(text) and not self.special.search(text):
            composed = text if text.isascii() else unicodedata.normalize("NFC", text)
            out = b"".join([self.pieces[x] for x in self.pattern.findall(composed.lower())])
        else:
            out = self._whole(text)
        if len(word) <= 64:
            self[word] = out
        return out

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_word:
            return self._whole(text)
        # bytes.split cuts at ASCII white space only
        return b"".join(map(self.__getitem__, text.encode().split()))


_loaded: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """The tokenizer of a file, loaded once in each Python worker."""
    if path not in _loaded:
        _loaded[path] = WordTokens(path)
    return _loaded[path]
