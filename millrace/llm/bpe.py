"""Byte-pair encoding and decoding of whole texts, merged through a segment tree.

A text is normalised and cut into pre-tokens as the vocabulary file says, and
every pre-token becomes symbols, one for each byte. The leaves of a segment tree
are the pairs of neighbouring symbols, a leaf holding the rank of its pair's
merge with its place behind it; an inner node holds the least of its two. So the
root is the leftmost of the merges of lowest rank. A merge changes three leaves,
each in as many steps as the tree is high, and merging ends when the root is
empty. A pre-token of n symbols takes O(n log n), however long it is.

Ids of pre-tokens are kept in a memo of at most ``capacity`` entries, so a
worker's memory does not follow the corpus. Long texts are cut before single
blanks, where no pre-token reaches across, and go piece by piece.

``encode`` gives what the tokenizers library gives with
``add_special_tokens=False``: strings of added tokens in a text become those
tokens. ``decode`` gives what its ``decode(ids, skip_special_tokens=False)``
gives: tokens joined by blanks where the file names no decoder, else their bytes
as UTF-8, with U+FFFD for what is none; ids that the vocabulary lacks are left
out. Letters and digits are those of Unicode as the regex package knows it.

Defined results: null texts have null ids, and empty ones none; null ids have
null text, and null entries are left out; the columns of a table stay as they
are, so names cannot clash.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import memo_tokenizer
from millrace.llm.memo_tokenizer import SPACE
from millrace.llm.runtime import claim, prepare, tidy

#: The pre-token patterns of the two kinds of vocabulary file, as the files and the library state them.
PRETOKENS = {
    "word": rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+",
    "byte": rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+",
}
NO_MERGE = 1 << 62
PLACE_BITS = 32
PART = 1 << 20  # characters of a long text that are handled at once
LONGEST_MEMO = 64
CUT = re.compile(r"(?<=\S) (?=\S)")


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself where it is printable, else one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class MergeTree:
    """Merges the symbols of one pre-token in place, lowest rank first and leftmost among equals."""

    def __init__(self, symbols: list[int], ranks: dict[int, int], merged: list[int]):
        self.symbols, self.ranks, self.merged = symbols, ranks, merged
        n = len(symbols)
        self.leaves = 1 << max(n - 2, 0).bit_length()
        tree = [NO_MERGE] * (2 * self.leaves)
        get = ranks.get
        for i in range(n - 1):
            rank = get(symbols[i] << 32 | symbols[i + 1])
            if rank is not None:
                tree[self.leaves + i] = rank << PLACE_BITS | i
        for i in range(self.leaves - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        self.tree = tree if n <= 4096 else array("q", tree)

    def update(self, leaf: int, value: int) -> None:
        """Set a leaf and the nodes above it, as far up as they change."""
        tree, i = self.tree, self.leaves + leaf
        tree[i] = value
        while i > 1:
            a, b = tree[i], tree[i ^ 1]
            i >>= 1
            least = a if a < b else b
            if tree[i] == least:
                return
            tree[i] = least

    def pair(self, left: int, right: int) -> int:
        rank = self.ranks.get(self.symbols[left] << 32 | self.symbols[right])
        return NO_MERGE if rank is None else rank << PLACE_BITS | left

    def run(self) -> list[int]:
        """Merge until the root is empty; the symbols that are left."""
        symbols, tree, n = self.symbols, self.tree, len(self.symbols)
        if n < 2 or tree[1] == NO_MERGE:
            return symbols
        after, before, alive = array("l", range(1, n + 1)), array("l", range(-1, n - 1)), bytearray(b"\1" * n)
        while (root := tree[1]) != NO_MERGE:
            left = root & ((1 << PLACE_BITS) - 1)
            gone = after[left]
            symbols[left] = self.merged[root >> PLACE_BITS]
            alive[gone] = 0
            right = after[left] = after[gone]
            if right < n:
                before[right] = left
                self.update(gone, NO_MERGE)
                self.update(left, self.pair(left, right))
            else:
                self.update(left, NO_MERGE)  # the symbol that went had no pair
            if before[left] >= 0:
                self.update(before[left], self.pair(before[left], left))
        return list(compress(symbols, alive))


class Codec:
    """Encoder and decoder of a byte-level vocabulary file, with or without word ends."""

    def __init__(self, path: str, capacity: int = 500_000):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")):
            raise ValueError("only plain byte-pair models are supported")
        added = spec["added_tokens"]
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("added tokens that depend on what stands around them are not supported")
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.kind = "word" if end else "byte"
        letters = byte_characters()
        self.first = [vocab[c] for c in letters]
        self.last = [vocab[c + end] for c in letters]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {vocab[a] << 32 | vocab[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.merged = [vocab[a + b] for a, b in pairs]
        names = {t["content"]: t["id"] for t in added}
        self.specials = {k: array("I", [v]).tobytes() for k, v in names.items()}
        self.added = re.compile("(" + "|".join(map(re.escape, sorted(names, key=len, reverse=True))) + ")") if names else None
        self.fine, self.pattern = memo_tokenizer.CUTS[self.kind][0], regex.compile(PRETOKENS[self.kind])
        self.white = re.compile(f"[{SPACE}]+")
        tokens = {v: k for k, v in vocab.items()} | {v: k for k, v in names.items()}
        self.joint, self.tokens = self._texts(tokens, letters, spec["decoder"])
        self.capacity, self.memo = capacity, {}

    @staticmethod
    def _texts(tokens: dict[int, str], letters: list[str], decoder: dict | None) -> tuple[bytes, list[bytes | None]]:
        """What stands between tokens, and the bytes of each."""
        if decoder is None:
            joint, of = b" ", str.encode
        elif decoder["type"] == "ByteLevel":
            back = {c: b for b, c in enumerate(letters)}
            joint, of = b"", lambda t: bytes(back[c] for c in t) if all(c in back for c in t) else t.encode()
        else:
            raise ValueError(f"no decoder of type {decoder['type']}")
        out: list[bytes | None] = [None] * (max(tokens) + 1)
        for k, v in tokens.items():
            out[k] = of(v)
        return joint, out

    def _parts(self, text: str):
        """``text`` in parts that no pre-token reaches across; long texts are cut before blanks."""
        at = 0
        while len(text) - at > PART and (found := CUT.search(text, at + PART)):
            yield text[at : found.start()]
            at = found.start()
        yield text[at:] if at else text

    def _pretokens(self, text: str) -> list[str]:
        plain = text.isascii() or not memo_tokenizer.RARE.search(text)
        if self.kind == "word":
            if not plain:
                text = self.white.sub(" ", unicodedata.normalize("NFC", text)).replace("Σ", "σ")  # lower case does not depend on what follows
            text = text.lower()
        return self.fine.findall(text) if plain else self.pattern.findall(text)

    def _piece(self, name: str) -> bytes:
        data = name.encode()
        symbols = list(map(self.first.__getitem__, data))
        symbols[-1] = self.last[data[-1]]
        return array("I", MergeTree(symbols, self.ranks, self.merged).run()).tobytes()

    def _plain(self, text: str) -> bytes:
        memo, out = self.memo, []
        for part in self._parts(text):
            names = self._pretokens(part)
            found = list(map(memo.get, names))
            if None in found:
                if len(memo) > self.capacity:
                    memo.clear()
                for i, ids in enumerate(found):
                    if ids is None:
                        name = names[i]
                        ids = memo.get(name) or self._piece(name)
                        if len(name) <= LONGEST_MEMO:
                            memo[name] = ids
                        found[i] = ids
            out.append(b"".join(found))
        return out[0] if len(out) == 1 else b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, as 32-bit numbers."""
        if self.added and self.added.search(text):
            parts = self.added.split(text)  # every second one is an added token
            packed = b"".join(self.specials[p] if i % 2 else self._plain(p) for i, p in enumerate(parts))
        else:
            packed = self._plain(text)
        return np.frombuffer(packed, "=u4")

    def decode_bytes(self, ids) -> bytes:
        tokens, n = self.tokens, len(self.tokens)
        ids = np.asarray(ids)
        if len(ids) and not (0 <= ids.min() and ids.max() < n):
            ids = ids[(ids >= 0) & (ids < n)]
        parts = list(map(tokens.__getitem__, ids.tolist()))
        return self.joint.join([p for p in parts if p is not None] if None in parts else parts)

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


_LOADED: dict[str, Codec] = {}


def load(path: str) -> Codec:
    """The process-wide codec of a vocabulary file."""
    claim("bpe", _LOADED.clear)
    if path not in _LOADED:
        _LOADED[path] = Codec(path)
    return _LOADED[path]


def _mapped(path: str, each, kind: pa.DataType, sql: str):
    """A column function of one argument: ``each(codec, value)`` for values that are not null."""

    def run(values: pa.Array) -> pa.Array:
        codec = load(path)
        out = pa.array([each(codec, v.as_py()) if v.is_valid else None for v in values], kind)
        tidy()
        return out

    run.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, sql)


def encode(text: Column, path: str) -> Column:
    """The ids of a text, array<int>."""
    return _mapped(path, lambda codec, t: codec.encode(t).astype("i4"), pa.list_(pa.int32()), "array<int>")(text)


def decode(ids: Column, path: str) -> Column:
    """The text of an array of ids."""
    return _mapped(path, lambda codec, x: codec.decode([i for i in x if i is not None]), pa.string(), "string")(ids)


def digests(text: Column, path: str) -> Column:
    """What encoding and decoding give, without the ids and texts themselves: struct<n_tokens, ids_sha256, decoded_sha256>."""
    fields = [pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]

    def each(codec: Codec, t: str) -> dict:
        ids = codec.encode(t)
        back = codec.decode_bytes(ids)
        if not codec.joint:  # bytes of one token need not be whole characters
            back = back.decode("utf-8", "replace").encode()
        return {"n_tokens": len(ids), "ids_sha256": hashlib.sha256(ids.astype("<u4")).hexdigest(), "decoded_sha256": hashlib.sha256(back).hexdigest()}

    return _mapped(path, each, pa.struct(fields), "struct<n_tokens: long, ids_sha256: string, decoded_sha256: string>")(text)


def round_trips(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row; a null text counts as empty."""
    prepare(docs.sparkSession)
    found = docs.select(F.col(id_col), digests(F.coalesce(F.col(text_col), F.lit("")), path).alias("_found"))
    return found.select(id_col, "_found.n_tokens", "_found.ids_sha256", "_found.decoded_sha256")
