"""Encoding and decoding with a word vocabulary by an index of the places of each pair of symbols."""

from __future__ import annotations

import functools
import heapq
import json
import re
import struct
from collections.abc import Iterable

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from martspark.llm.common import map_slices, text_or_empty
from martspark.llm.tokens import byte_letters, is_plain

# Python's split also takes these for white space.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_REMEMBERED = 400_000


class PairIndex:
    """Merges all words of a block at once.

    `places[r]` holds the places of the pair with rank r in the whole block. The least active rank
    is applied at all its places, left to right, and the pairs that appear or vanish next to a
    merged place change the lists of their ranks. A new pair that ranks before the one at work is
    taken first, so each word sees its merges in the order of (rank, place).
    """

    def __init__(self, merges: dict[tuple[int, int], tuple[int, int]]) -> None:
        self._merges = merges

    def merge(self, words: list[list[int]]) -> list[list[int]]:
        merges = self._merges
        symbol: list[int] = []
        ends = []
        for word in words:
            symbol += word
            ends.append(len(symbol))
        after = list(range(1, len(symbol) + 1))
        before = list(range(-1, len(symbol) - 1))
        start = 0
        for end in ends:
            if end > start:
                after[end - 1] = before[start] = -1
            start = end

        places: dict[int, list[int]] = {}
        for at, right in enumerate(after):
            if right >= 0:
                found = merges.get((symbol[at], symbol[right]))
                if found:
                    places.setdefault(found[0], []).append(at)
        active = list(places)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            todo = sorted(places.pop(rank))
            for i, at in enumerate(todo):
                right = after[at]
                if symbol[at] < 0 or right < 0:
                    continue
                found = merges.get((symbol[at], symbol[right]))
                if not found or found[0] != rank:
                    continue
                symbol[at], symbol[right] = found[1], -1
                beyond = after[at] = after[right]
                if beyond >= 0:
                    before[beyond] = at
                earlier = False
                for left, end in ((before[at], at), (at, beyond)):
                    if left >= 0 and end >= 0:
                        new = merges.get((symbol[left], symbol[end]))
                        if new:
                            if new[0] not in places:
                                places[new[0]] = []
                                heapq.heappush(active, new[0])
                            places[new[0]].append(left)
                            earlier = earlier or new[0] <= rank
                if earlier:
                    rest = todo[i + 1:]
                    if rest:
                        if rank not in places:
                            places[rank] = []
                            heapq.heappush(active, rank)
                        places[rank] += rest
                    break

        out = []
        start = 0
        for end in ends:
            out.append([s for s in symbol[start:end] if s >= 0])
            start = end
        return out


class WordBpe:
    """Ids and decoded text as the tokenizers library gives them for a vocabulary with word ends."""

    def __init__(self, path: str) -> None:
        whole = Tokenizer.from_file(path)
        self._normal, self._cut = whole.normalizer, whole.pre_tokenizer
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self._end = model["end_of_word_suffix"] or ""
        self._vocab: dict[str, int] = model["vocab"]
        self._token = {i: t for t, i in self._vocab.items()}
        self._added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._token.update({i: t for t, i in self._added.items()})
        self._added_at = re.compile("|".join(map(re.escape, self._added)))
        merges = {}
        for rank, (a, b) in enumerate(model["merges"]):
            merges[self._vocab[a], self._vocab[b]] = (rank, self._vocab[a + b])
        self._index = PairIndex(merges)
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self._pieces = regex.compile(split)
        self._letters = byte_letters()
        # Of a chunk between white space, or of a piece of a text that is not plain: ids and text.
        self._known: dict[str, tuple[bytes, str]] = {}
        self._words: dict[str, tuple[bytes, str]] = {}

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Ids (little-endian unsigned 32-bit) and decoded text of each text."""
        parts = [self._parts(t) for t in texts]
        if len(self._known) > _REMEMBERED:
            self._known.clear()
        self._learn({p for keys in parts for p in keys}.difference(self._known))
        known = self._known
        out = []
        for keys in parts:
            found = [known[k] for k in keys]
            out.append((b"".join([f[0] for f in found]), " ".join([f[1] for f in found if f[1]])))
        return out

    def _parts(self, text: str) -> list[str]:
        if is_plain(text) and "<|" not in text and not _SEPARATORS.search(text):
            return text.lower().split()
        keys = []
        start = 0
        for hit in self._added_at.finditer(text):
            keys += self._cut_normal(text[start:hit.start()])
            keys.append("\n" + hit[0])
            start = hit.end()
        return keys + self._cut_normal(text[start:])

    def _cut_normal(self, text: str) -> list[str]:
        """Pieces as the library cuts them; a leading tab tells them from chunks."""
        if not text:
            return []
        return ["\t" + piece for piece, _ in self._cut.pre_tokenize_str(self._normal.normalize_str(text))]

    def _learn(self, keys: Iterable[str]) -> None:
        """Encodes new keys: their words that are new too are merged as one block."""
        letters, words = self._letters, self._words
        if len(words) > _REMEMBERED:
            words.clear()
        new: list[str] = []
        rows = []
        for key in keys:
            if key[0] == "\n":
                i = self._added[key[1:]]
                self._known[key] = (struct.pack("<I", i), self._token[i])
                continue
            if key[0] == "\t":
                pieces = [key[1:]]
            elif key.isascii():
                pieces = [key] if key.isalpha() else self._pieces.findall(key)
            else:
                pieces = ["".join([letters[b] for b in p.encode()]) for p in self._pieces.findall(key)]
            for piece in pieces:
                if piece not in words:
                    words[piece] = (b"", "")
                    new.append(piece)
            rows.append((key, pieces))
        for word, ids in zip(new, self._index.merge([self._symbols(w) for w in new])):
            words[word] = (struct.pack(f"<{len(ids)}I", *ids), " ".join([self._token[i] for i in ids]))
        for key, pieces in rows:
            if len(pieces) == 1:
                self._known[key] = words[pieces[0]]
            else:
                found = [words[p] for p in pieces]
                self._known[key] = (b"".join([f[0] for f in found]), " ".join([f[1] for f in found if f[1]]))

    def _symbols(self, word: str) -> list[int]:
        """A letter that the vocabulary lacks is left out, as the model has no unknown token."""
        letters = [*word[:-1], word[-1:] + self._end]
        return [self._vocab[c] for c in letters if c in self._vocab]


@functools.lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row per row of `docs`: `ids` (binary, little-endian unsigned 32-bit) and the `decoded` text.

    `tokenizer` is the file of the vocabulary, which every executor can read. A NULL or empty text
    has no ids and decodes to an empty text. Rows are independent of each other: nothing is
    shuffled, repeated rows give repeated results, other columns are not read.
    """

    def rows(batch: pa.RecordBatch) -> dict[str, list]:
        found = word_bpe(tokenizer).encode(batch.column("text").to_pylist())
        return {
            "doc_id": batch.column("doc_id"),
            "ids": [ids for ids, _ in found],
            "decoded": [text for _, text in found],
        }

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_slices(
        docs.select("doc_id", text_or_empty().alias("text")), rows, f"doc_id {kind}, ids binary, decoded string"
    )
