"""Packing of documents into windows of tokens by the sum-of-squares rule."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from martspark.llm.common import ship, slices, text_or_empty
from martspark.llm.tokens import byte_bpe

END = (1).to_bytes(4, "little")
# A task numbers its windows from its partition number times this.
_NUMBERS = 1 << 36

Piece = tuple  # (doc_id, start, ids, doc_tokens)


class Packer:
    """Windows of `size` tokens. `count[h]` is the number of windows filled up to h tokens.

    A document's full windows are cut off first. Its rest goes where the sum of the squared counts
    of the partially filled levels becomes least: into a window of a level that exists, or into a
    new one. Ties go to the fullest level.
    """

    def __init__(self, size: int) -> None:
        self.size = size
        self.count = np.zeros(size + 1, dtype=np.int64)
        self.open: dict[int, list[list[Piece]]] = defaultdict(list)

    def add(self, doc_id, ids: bytes) -> Iterator[list[Piece]]:
        """Places a document and gives the windows that became full."""
        size, n = self.size, len(ids) // 4
        rest = n % size
        for start in range(0, n - rest, size):
            yield [(doc_id, start, ids[4 * start: 4 * (start + size)], n)]
        if rest:
            full = self._place((doc_id, n - rest, ids[4 * (n - rest):], n), rest)
            if full:
                yield full

    def _place(self, piece: Piece, n: int) -> list[Piece] | None:
        size, count = self.size, self.count
        gain = 2 * count[n:] + 1  # of the level that the window reaches, for start levels 0 .. size - n
        gain[size - n] = 0
        loss = 2 * count[: size - n + 1] - 1
        change = np.where(loss > 0, gain - loss, np.iinfo(np.int64).max)
        change[0] = gain[0]
        level = size - n - int(np.argmin(change[::-1]))
        window = self.open[level].pop() if level else []
        if level:
            count[level] -= 1
        window.append(piece)
        if level + n == size:
            return window
        count[level + n] += 1
        self.open[level + n].append(window)
        return None

    def rest(self) -> Iterator[list[Piece]]:
        """The partially filled windows: the fullest ones keep what was placed in them and are filled up with
        pieces cut from the emptiest. What is left over becomes windows whose lengths are powers of two,
        which need no padding, so no window is padded."""
        fills = [level for level in sorted(self.open, reverse=True) for _ in self.open[level]]
        windows = [w for level in sorted(self.open, reverse=True) for w in self.open[level]]
        n_full, left = divmod(sum(fills), self.size)
        # All open windows together hold the tokens of n_full full ones, so the others fill these exactly.
        supply = [p for w in windows[n_full:] for p in w]
        rooms = [self.size - level for level in fills[:n_full]]
        rooms += [1 << i for i in reversed(range(left.bit_length())) if left >> i & 1]
        kept = windows[:n_full] + [[] for _ in rooms[n_full:]]
        at = taken = 0  # in the supply: a piece, and the ids already taken from it
        for window, room in zip(kept, rooms):
            while room:
                doc_id, start, ids, n = supply[at]
                cut = ids[4 * taken: 4 * (taken + room)]
                window.append((doc_id, start + taken, cut, n))
                room -= len(cut) // 4
                taken += len(cut) // 4
                if 4 * taken == len(ids):
                    at, taken = at + 1, 0
            yield window


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 2048) -> DataFrame:
    """One row per piece of a document: where it begins in the document, its ids (little-endian
    unsigned 32-bit), the document's length, and its window and place in it.

    `tokenizer` is the file of a byte-level vocabulary that every executor can read. Each document
    ends with id 1; a NULL or empty text is that id alone. Each task packs the rows that it reads:
    nothing is shuffled and no rows of a key meet, a lost task is packed anew in the same way. At its
    end the emptiest windows fill the others up, and fewer than `size` tokens go into smaller windows.
    Repeated rows are packed each; other columns are not read. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, "
        "sequence_id bigint, offset bigint"
    )
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(tokenizer).encode
        packer = Packer(size)
        number = TaskContext.get().partitionId() * _NUMBERS
        rows: list[tuple] = []

        def out(windows: Iterator[list[Piece]]) -> None:
            nonlocal number
            for window in windows:
                offset = 0
                for doc_id, start, ids, n in window:
                    rows.append((doc_id, start, len(ids) // 4, ids, n, number, offset))
                    offset += len(ids) // 4
                number += 1

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays(
                [pa.array(column, type=f.type) for column, f in zip(zip(*rows), arrow)], schema=arrow
            )
            rows.clear()
            return made

        for part in slices(batches):
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                out(packer.add(doc_id, encode(text or "") + END))
            if rows:
                yield batch()
        out(packer.rest())
        if rows:
            yield batch()

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, schema)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
