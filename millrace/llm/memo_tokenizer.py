"""Exact subword encoding with a bounded memo of pre-tokens.

A byte-pair tokenizer never merges across its own pre-token boundaries, so the
ids of a text are the concatenation of the ids of its pre-tokens. The memo maps
a pre-token to its packed little-endian ids; only pre-tokens not seen before go
through the tokenizers library, in batches. The memo is emptied when it reaches
``capacity`` entries, so a worker's memory does not follow the corpus.

Strings of the tokenizer's added tokens are taken out first, and the texts
between them are cut each for itself, as the library does. With ``plain`` they
are ordinary text.

Texts made of ASCII and Latin-1 letters are cut with the tokenizer's own
pre-token pattern (the Unicode classes have a plain equivalent there). Any
other text is cut at white space only, where no pattern reaches across, and the
library does the rest.
"""

from __future__ import annotations

import gc
import re
from array import array

import numpy as np

from millrace.llm.runtime import claim

LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Unicode White_Space, which the tokenizers' patterns mean by \s.
SPACE = "\t-\r \x85\xa0  -     　"
RARE = re.compile(f"[^\x00-\x7f{LETTERS}]")
#: Pre-token patterns of the two public vocabularies, restricted to LETTERS.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
CUTS = {
    "word": (
        re.compile(f"{CONTRACTIONS}|[{LETTERS}]+|[0-9]|[^\t-\r 0-9{LETTERS}]+"),
        re.compile(f"[^{SPACE}]+"),
    ),
    "byte": (
        re.compile(f"{CONTRACTIONS}| ?[{LETTERS}]+| ?[0-9]+| ?[^\t-\r 0-9{LETTERS}]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"),
        re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"),
    ),
}

_LOADED: dict[tuple, "MemoTokenizer"] = {}


def load(path: str, capacity: int = 1_000_000, plain: bool = False) -> "MemoTokenizer":
    """The process-wide tokenizer of a vocabulary file."""
    claim("tokenizer", _LOADED.clear)
    if (path, capacity, plain) not in _LOADED:
        _LOADED[path, capacity, plain] = MemoTokenizer(path, capacity, plain)
    return _LOADED[path, capacity, plain]


class MemoTokenizer:
    """``encode`` gives the same ids as the library's ``encode_batch`` with ``add_special_tokens=False``."""

    def __init__(self, path: str, capacity: int, plain: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        added = [t for t in self.tokenizer.get_added_tokens_decoder().values() if not (plain and t.special)]
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError("added tokens that depend on what stands around them are not supported")
        names = sorted((t.content for t in added), key=len, reverse=True)
        self.added = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.typecode = "H" if self.dtype.itemsize == 2 else "I"
        self.kind = "word" if self.tokenizer.normalizer is not None else "byte"
        self.fine, self.coarse = CUTS[self.kind]
        self.capacity = capacity
        self.memo: dict[str, bytes] = {}

    def cut(self, text: str) -> list[str]:
        if self.added and self.added.search(text):
            parts = self.added.split(text)  # every second one is an added token
            return [piece for i, part in enumerate(parts) for piece in ((part,) if i % 2 else self._cut(part))]
        return self._cut(text)

    def _cut(self, text: str) -> list[str]:
        if not text.isascii() and RARE.search(text):
            return self.coarse.findall(text)
        return self.fine.findall(text.lower() if self.kind == "word" else text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text, in ``dtype``; texts longer than the batch are no special case."""
        out = []
        collecting = gc.isenabled()
        gc.disable()  # millions of short-lived objects, none of them in cycles
        try:
            for at in range(0, len(texts), 256):
                out += self._packed([self.cut(t) for t in texts[at : at + 256]])
        finally:
            if collecting:
                gc.enable()
        return out

    def _packed(self, pieces: list[list[str]]) -> list[bytes]:
        memo = self.memo
        if len(memo) > self.capacity:
            memo.clear()
        found = [list(map(memo.get, p)) for p in pieces]
        new: dict[str, None] = {}
        gaps = []
        for names, ids in zip(pieces, found):
            if None in ids:
                at = [i for i, x in enumerate(ids) if x is None]
                gaps.append((names, ids, at))
                for i in at:
                    new[names[i]] = None
        if new:
            encoded = self.tokenizer.encode_batch_fast(list(new), add_special_tokens=False)
            code = self.typecode
            memo.update([(k, array(code, e.ids).tobytes()) for k, e in zip(new, encoded)])
            for names, ids, at in gaps:
                for i in at:
                    ids[i] = memo[names[i]]
        return [b"".join(ids) for ids in found]
