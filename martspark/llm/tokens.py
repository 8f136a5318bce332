"""Byte-level ids of whole texts, with a memory of the chunks between spaces."""

from __future__ import annotations

import functools
import json
import re
import struct

import tiktoken
from tokenizers import Tokenizer

# Fixed value: how this kind of vocabulary cuts a text before merging.
_CUT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_REMEMBERED = 500_000


@functools.cache
def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself where printable, else the next free one from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in own}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(own))
    return letters


def is_plain(text: str) -> bool:
    """Only letters up to U+00FF: there all Unicode tables agree and no normal form changes a text."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class ByteBpe:
    """Ids as the tokenizers library gives them, as little-endian unsigned 32-bit numbers.

    No token reaches over a space that stands between two other characters, so a plain text is the
    row of its chunks, and each chunk is merged once as long as it is remembered. Other texts, and
    those with a special token's string, go to the library whole.
    """

    def __init__(self, path: str) -> None:
        self._whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        special = [t["content"] for t in spec["added_tokens"]]
        to_byte = {c: b for b, c in byte_letters().items()}
        ranks = {
            bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special
        }
        self._special = re.compile("|".join(map(re.escape, special))) if special else None
        merge = tiktoken.Encoding("chunks", pat_str=_CUT, mergeable_ranks=ranks, special_tokens={})
        self._merge = merge.encode_ordinary
        self._merge_piece = merge._core_bpe.encode_single_piece
        self._known: dict[str, bytes | None] = {}

    def encode(self, text: str) -> bytes:
        if not is_plain(text) or (self._special and "<" in text and self._special.search(text)):
            return _packed(self._whole.encode(text, add_special_tokens=False).ids)
        first, *chunks = text.split(" ")
        known = self._known
        try:
            found = [known[c] for c in chunks]
        except KeyError:
            self._learn(chunks)
            found = [known[c] for c in chunks]
        if not first or first[-1].isspace() or None in found:
            return _packed(self._merge(text))
        return _packed(self._merge(first)) + b"".join(found)

    def _learn(self, chunks: list[str]) -> None:
        known = self._known
        if len(known) > _REMEMBERED:
            known.clear()
        for chunk in chunks:
            if chunk not in known:
                if chunk.isalpha():
                    known[chunk] = _packed(self._merge_piece(f" {chunk}".encode()))
                elif not chunk or chunk[0].isspace() or chunk[-1].isspace():
                    known[chunk] = None  # this white space belongs to more than one chunk
                else:
                    known[chunk] = _packed(self._merge(" " + chunk))


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@functools.lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)
