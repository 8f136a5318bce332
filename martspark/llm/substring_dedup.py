"""Removal of word sequences that an earlier document has, by suffix automata of shards of the repeated passages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martspark.llm.common import ship, text_or_empty
from martspark.session import stage

# Words of the grams that anchor a window. Longer grams give more anchors, shorter ones longer passages.
GRAM = 20
# Passages of an anchor in more documents than this are dealt out window by window.
_HOT = 500
# Distinct passages in a shard, whose automaton one task holds. Those of an anchor with more are dealt out likewise.
_SHARD = 1000
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_CHUNK = 1 << 16


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.append(np.ones(1, np.uint64), np.full(n - 1, np.uint64(base))), dtype=np.uint64)


def _gram_hashes(words: list[bytes]) -> np.ndarray:
    """Rolling hashes of all grams, scrambled so that their order says nothing of the words."""
    n = len(words)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=n)
    with np.errstate(over="ignore"):
        # Sums of h[i] * base^-i; the difference over a gram times base^start is its polynomial.
        sums = np.append(np.zeros(1, np.uint64), np.cumsum(h * _powers(_BACK, n), dtype=np.uint64))
        g = (sums[GRAM:] - sums[:-GRAM]) * _powers(_BASE, n - GRAM + 1)
        g ^= g >> np.uint64(33)
        g *= np.uint64(0xFF51AFD7ED558CCD)
        g ^= g >> np.uint64(33)
    return g


def _anchors(grams: np.ndarray, span: int) -> np.ndarray:
    """Place of the least gram of each window of `span` grams, the rightmost on ties."""
    out = []
    for start in range(0, len(grams) - span + 1, _CHUNK):
        part = grams[start: start + _CHUNK + span - 1]
        view = np.lib.stride_tricks.sliding_window_view(part, span)[:, ::-1]
        out.append(start + np.arange(len(view)) + span - 1 - view.argmin(axis=1))
    return np.concatenate(out)


def _anchor_rows(frames: Iterator[pd.DataFrame], window: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        found, docs = [], []
        for doc, text in zip(frame["doc"], frame["text"]):
            words = text.encode("utf-8", "surrogatepass").split()
            if len(words) >= window:
                grams = _gram_hashes(words)
                own = np.unique(grams[np.unique(_anchors(grams, window - GRAM + 1))])
                found.append(own)
                docs += [doc] * len(own)
        if found:
            yield pd.DataFrame({"anchor": np.concatenate(found).view(np.int64), "doc": docs})


def _passage_rows(frames: Iterator[pd.DataFrame], window: int) -> Iterator[pd.DataFrame]:
    """Passages around repeated anchors: all words of the consecutive windows that have the anchor.

    Equal windows have equal anchors. Those of a hot anchor become passages of their own.
    """
    for frame in frames:
        rows = []
        for doc, h, text, repeated, hot in zip(
            frame["doc"], frame["h"], frame["text"], frame["anchors"], frame["hot"]
        ):
            words = text.encode("utf-8", "surrogatepass").split()
            if len(words) < window:  # the anchors are of another text with this id
                continue
            grams = _gram_hashes(words)
            places = _anchors(grams, window - GRAM + 1)
            values = grams[places].view(np.int64)
            is_hot = dict(zip(repeated, hot))
            known = np.isin(values, np.asarray(repeated, dtype=np.int64))
            heads = np.flatnonzero(np.append(True, places[1:] != places[:-1]))
            tails = np.append(heads[1:], len(places))
            for a, b in zip(heads[known[heads]].tolist(), tails[known[heads]].tolist()):
                anchor = int(values[a])
                pieces = [(i, i + 1) for i in range(a, b)] if is_hot[anchor] else [(a, b)]
                for i, j in pieces:
                    passage = b" ".join(words[i: j - 1 + window])
                    digest = xxhash.xxh3_128_digest(passage)
                    p1, p2 = np.frombuffer(digest, dtype="<i8").tolist()
                    rows.append((p1 if is_hot[anchor] else anchor, p1, p2, doc, h, i, passage))
        if rows:
            yield pd.DataFrame(rows, columns=["key", "p1", "p2", "doc", "h", "start", "passage"])


def _window_rows(frames: Iterator[pd.DataFrame], window: int) -> Iterator[pd.DataFrame]:
    """The windows of passages as passages of their own, as those of a hot anchor are."""
    for frame in frames:
        rows = []
        for doc, h, start, passage in zip(frame["doc"], frame["h"], frame["start"], frame["passage"]):
            words = passage.split(b" ")
            for i in range(len(words) - window + 1):
                piece = b" ".join(words[i: i + window])
                p1, p2 = np.frombuffer(xxhash.xxh3_128_digest(piece), dtype="<i8").tolist()
                rows.append((p1, p1, p2, doc, h, start + i, piece))
        if rows:
            yield pd.DataFrame(rows, columns=["key", "p1", "p2", "doc", "h", "start", "passage"])


def _distinct(passages: DataFrame) -> DataFrame:
    """Passages once each with their least document; windows that only one document has drop out."""
    return passages.groupBy("key", "p1", "p2").agg(
        F.min("doc").alias("doc"), F.max("doc").alias("last"), F.first("passage").alias("passage")
    ).where("key != p1 or doc < last").drop("last")


class Automaton:
    """Suffix automaton over sequences of words. `least[s]` is the least document of a state's words."""

    def __init__(self) -> None:
        self.go: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.least: list = [None]

    def _state(self, length: int, go: dict, link: int, least) -> int:
        self.go.append(go)
        self.link.append(link)
        self.length.append(length)
        self.least.append(least)
        return len(self.go) - 1

    def _split(self, p: int, q: int, word) -> int:
        """A copy of q for the shorter words that reach it from p."""
        copy = self._state(self.length[p] + 1, dict(self.go[q]), self.link[q], None)
        while p >= 0 and self.go[p].get(word) == q:
            self.go[p][word] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def add(self, words: list, doc) -> None:
        last = 0
        for word in words:
            q = self.go[last].get(word)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
                if self.least[last] is None or doc < self.least[last]:
                    self.least[last] = doc
                continue
            new = self._state(self.length[last] + 1, {}, 0, doc)
            p = last
            while p >= 0 and word not in self.go[p]:
                self.go[p][word] = new
                p = self.link[p]
            if p >= 0:
                q = self.go[p][word]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
            last = new

    def finish(self) -> None:
        """Words that end a longer word occur wherever that does."""
        for s in sorted(range(1, len(self.go)), key=self.length.__getitem__, reverse=True):
            up, least = self.link[s], self.least[s]
            if up > 0 and least is not None and (self.least[up] is None or least < self.least[up]):
                self.least[up] = least

    def statistics(self, words: list, window: int) -> Iterator:
        """Least document for each window of the sequence, from the longest match that ends at its last word."""
        state = length = 0
        for i, word in enumerate(words):
            while state and word not in self.go[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.go[state]:
                state = self.go[state][word]
                length += 1
            while self.link[state] >= 0 and self.length[self.link[state]] >= window:
                state = self.link[state]
                length = self.length[state]
            if i >= window - 1:
                yield self.least[state] if length >= window else None


def _shard_rows(shard: pd.DataFrame, window: int) -> pd.DataFrame:
    """Least document of each window of the shard's distinct passages."""
    alone = ~shard["key"].duplicated(keep=False).to_numpy()
    words = [p.split(b" ") for p in shard["passage"]]
    docs = shard["doc"].tolist()
    automaton = Automaton()
    for own, w, doc in zip(alone, words, docs):
        if not own:
            automaton.add(w, doc)
    automaton.finish()
    # The automaton of a single passage gives its own document for every window.
    least = [
        [doc] * (len(w) - window + 1) if own else list(automaton.statistics(w, window))
        for own, w, doc in zip(alone, words, docs)
    ]
    return pd.DataFrame({"p1": shard["p1"], "p2": shard["p2"], "least": least})


def _kept_rows(frames: Iterator[pd.DataFrame], window: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        counts, removed, kept = [], [], []
        for text, starts in zip(frame["text"], frame["starts"]):
            words = text.encode("utf-8", "surrogatepass").split()
            n = len(words)
            gone = 0
            if starts is not None and len(starts):
                edge = np.zeros(n + 1, dtype=np.int64)
                np.add.at(edge, np.asarray(starts), 1)
                np.add.at(edge, np.asarray(starts) + window, -1)
                stay = np.cumsum(edge[:-1]) == 0
                words = [w for w, s in zip(words, stay.tolist()) if s]
                gone = n - len(words)
            counts.append(n)
            removed.append(gone)
            kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
        yield pd.DataFrame({"doc_id": frame["doc"], "n_words": counts, "n_removed": removed, "kept": kept})


def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): every row of `docs` without the words covered by a window of
    `window` words that also starts in a document with a smaller doc_id; what is kept is joined by blanks.

    Each window is anchored at the least hash of its grams of GRAM words, so equal windows have equal
    anchors. Anchors that only one document has are left out by counting; what is left are the repeated
    passages, and they are the reference. Its distinct passages are dealt by anchor to shards of bounded
    size, a suffix automaton is built of each, and the passages are streamed through it: the state of a
    window knows the least document that has it. So every automaton meets exactly the words that can match
    it, instead of going to all documents. An anchor in very many documents would bring its passages, which
    differ where the repeated part ends, to one shard; they are dealt window by window, and windows of one
    document drop out. In an automaton the comparison is by words. Passages are told apart by their 128-bit
    digest, though, and where an anchor's key has one distinct passage in a shard, as for every window of a
    hot anchor, there is no automaton: the least document comes from grouping by that digest.

    A NULL or empty text has no words; a text shorter than a window keeps all. Rows with the same id are one
    document, whose texts each lose what an earlier document has; rows without an id are kept whole. An empty table gives no rows. Other columns are not read.
    """
    if window <= GRAM:
        raise ValueError(f"the window must have more than {GRAM} words")
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select(F.col("doc_id").alias("doc"), text_or_empty().alias("text"))
    texts = texts.withColumn("h", F.xxhash64("text"))  # rows may share an id but not the text
    known = texts.where("doc is not null")

    anchors = stage(
        known.drop("h").mapInPandas(lambda f: _anchor_rows(f, window), f"anchor bigint, doc {kind}"), "anchors"
    )
    repeated = (
        anchors.groupBy("anchor").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.count(F.lit(1)).alias("n"))
        .where("a < b").select("anchor", (F.col("n") > _HOT).alias("hot"))
    )
    of_doc = anchors.join(repeated, "anchor").groupBy("doc").agg(
        F.collect_list(F.struct("anchor", "hot")).alias("found")
    ).select("doc", "found.anchor", "found.hot").withColumnRenamed("anchor", "anchors")
    passages = stage(
        known.join(of_doc, "doc").mapInPandas(
            lambda f: _passage_rows(f, window),
            f"key bigint, p1 bigint, p2 bigint, doc {kind}, h bigint, start int, passage binary",
        ), "passages",
    )
    distinct = stage(_distinct(passages), "distinct-passages")
    # An anchor that stands very often in few long documents has as many passages as a hot one.
    crowded = stage(
        distinct.where("key != p1").groupBy("key").count().where(F.col("count") > _SHARD).select("key"), "crowded"
    )
    if not crowded.isEmpty():
        cut = stage(
            passages.join(crowded, "key", "left_semi").mapInPandas(lambda f: _window_rows(f, window), passages.schema),
            "crowded-windows",
        )
        passages = passages.join(crowded, "key", "left_anti").unionByName(cut)
        distinct = stage(distinct.join(crowded, "key", "left_anti").unionByName(_distinct(cut)), "distinct-passages")
    shards = max(1, -(-distinct.count() // _SHARD))
    least = distinct.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).groupBy("shard").applyInPandas(
        lambda s: _shard_rows(s, window), f"p1 bigint, p2 bigint, least array<{kind}>"
    )
    # A passage has one key, so `least` has a row for each; a passage in very many documents is a skewed join.
    starts = (
        passages.select("p1", "p2", "doc", "h", "start").join(least, ["p1", "p2"])
        .select("doc", "h", "start", F.posexplode("least").alias("i", "first"))
        .where("first < doc")
        .groupBy("doc", "h").agg(F.collect_set(F.col("start") + F.col("i")).alias("starts"))
    )
    return texts.join(starts, ["doc", "h"], "left").mapInPandas(
        lambda f: _kept_rows(f, window), f"doc_id {kind}, n_words bigint, n_removed bigint, kept string"
    )
