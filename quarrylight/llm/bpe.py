"""Byte-level BPE with a public vocabulary.

A text is cut into pieces by the vocabulary's pattern; each piece starts as a doubly linked list of its bytes, and a
priority queue of (rank, position) gives the pair to merge next. Entries whose pair has changed meanwhile are stale and
skipped, so a piece of n bytes takes O(n log n) steps, however long it is. Texts are encoded whole. NULL and empty
texts give an empty list. No special token is ever produced.
"""

from __future__ import annotations

import base64
import functools
import heapq
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_PIECES = 200_000
CACHE_BYTES = 64  # longer pieces hardly ever come again


class ByteBPE:
    def __init__(self, path: str, pattern: str = PATTERN) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.vocabulary = {rank: token for token, rank in self.ranks.items()}
        self.pieces = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        ends = list(range(1, n + 1))  # end of the symbol that starts here; 0 where no symbol starts
        before = list(range(-1, n))  # start of the symbol before
        queue = [(rank, i, i + 1, i + 2) for i in range(n - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, start, middle, end = heapq.heappop(queue)
            if ends[start] != middle or ends[middle] != end:
                continue  # stale
            ends[start], ends[middle] = end, 0
            if end < n:
                before[end] = start
                if (rank := ranks.get(piece[start : ends[end]])) is not None:
                    heapq.heappush(queue, (rank, start, end, ends[end]))
            if (left := before[start]) >= 0 and (rank := ranks.get(piece[left:end])) is not None:
                heapq.heappush(queue, (rank, left, start, end))
        ids, at = [], 0
        while at < n:
            ids.append(ranks[piece[at : ends[at]]])
            at = ends[at]
        return ids

    def _piece(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self.merge(piece.encode()))
        if len(piece) <= CACHE_BYTES:
            if len(self.known) >= CACHE_PIECES:
                self.known.clear()
            self.known[piece] = ids
        return ids

    def encode_into(self, text: str | None, out: array) -> None:
        if text:
            known, new, extend = self.known.get, self._piece, out.extend
            for piece in self.pieces(text):
                extend(known(piece) or new(piece))

    def encode(self, text: str | None) -> list[int]:
        out = array("i")
        self.encode_into(text, out)
        return out.tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.vocabulary.__getitem__, ids)).decode()


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteBPE:
    """One tokenizer per Python worker."""
    return ByteBPE(path)


def _encode(batches: Iterator[pa.RecordBatch], path: str, only_count: bool) -> Iterator[pa.RecordBatch]:
    bpe = tokenizer(path)
    for batch in batches:
        ids, ends = array("i"), array("i", [0])
        for text in batch.column("_text"):
            bpe.encode_into(text.as_py(), ids)
            ends.append(len(ids))
        offsets = pa.array(ends, pa.int32())
        kept = [batch.column(i) for i in range(batch.num_columns - 1)]
        names = batch.schema.names[:-1]
        if only_count:
            result = pa.compute.subtract(offsets[1:], offsets[:-1])
        else:
            import numpy as np

            values = np.frombuffer(ids, np.int32) if len(ids) else np.empty(0, np.int32)
            result = pa.ListArray.from_arrays(offsets, pa.array(values))
        yield pa.RecordBatch.from_arrays([*kept, result], names=[*names, "n_tokens" if only_count else "ids"])


def _run(documents: DataFrame, key: str, text: str, vocabulary: str, only_count: bool) -> DataFrame:
    from pyspark.sql import functions as F

    import pyarrow.compute  # noqa: F401

    out = "n_tokens int" if only_count else "ids array<int>"
    kind = documents.schema[key].dataType.simpleString()
    picked = documents.select(F.col(key), F.col(text).alias("_text"))
    return picked.mapInArrow(lambda batches: _encode(batches, vocabulary, only_count), f"`{key}` {kind}, {out}")


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = f"{TOKENIZER_DIR}/{VOCABULARY}") -> DataFrame:
    """(key, ids array<int>), one row per row of ``documents``, repeated rows included; other columns are not read."""
    return _run(documents, key, text, vocabulary, False)


def count_tokens(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = f"{TOKENIZER_DIR}/{VOCABULARY}") -> DataFrame:
    """(key, n_tokens int), one row per row of ``documents``."""
    return _run(documents, key, text, vocabulary, True)
