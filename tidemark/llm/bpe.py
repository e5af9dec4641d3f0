"""Byte-level BPE by monoid tree reduction.

A piece of text is halved until the parts are short; the parts are merged by rank and joined
pairwise on the way up.  A sequence of tokens is *the* encoding of its bytes exactly if every
two neighbouring tokens are the encoding of their own joined bytes, so a join only has to
re-encode a window around the seam and may stop as soon as the window's outer tokens agree with
their neighbours.  The window doubles until they do.  Decoding joins bytes, which is associative.
"""

from __future__ import annotations

import base64
import functools
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import table

LEAF_BYTES = 48
#: Entries of the per-task cache of chunks; it is emptied when full, so memory stays bounded.
CACHE_ENTRIES = 300_000
#: A space that ends any match before it and starts a match: text on both sides is not white space.
SEAM = re.compile(r"(?<=\S)(?= \S)")
LOOSE = re.compile(r"\s | \s|^ | $")


class TreeEncoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.findall = regex.compile(pattern).findall
        self.agrees: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def leaf(self, data: bytes) -> list[int]:
        """Merge the lowest-ranked neighbours, leftmost first, until none is left."""
        ranks = self.ranks
        if len(data) > 2 * LEAF_BYTES:
            return self._leaf_heap(data)
        parts = [data[i : i + 1] for i in range(len(data))]
        costs = [ranks.get(parts[i] + parts[i + 1], 1 << 60) for i in range(len(parts) - 1)]
        while costs:
            low = min(costs)
            if low == 1 << 60:
                break
            i = costs.index(low)
            parts[i] += parts.pop(i + 1)
            costs.pop(i)
            if i < len(costs):
                costs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 60)
            if i:
                costs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 60)
        return [ranks[p] for p in parts]

    def _leaf_heap(self, data: bytes) -> list[int]:
        ranks, n = self.ranks, len(data)
        part: list[bytes | None] = [data[i : i + 1] for i in range(n)]
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, i + 1, 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, j, size = heapq.heappop(heap)
            if part[i] is None or after[i] != j or len(part[i]) + len(part[j]) != size:
                continue
            part[i] += part[j]
            part[j] = None
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := ranks.get(both := part[a] + part[b])) is not None:
                    heapq.heappush(heap, (r, a, b, len(both)))
        return [ranks[p] for p in part if p is not None]

    def fits(self, a: int, b: int) -> bool:
        known = self.agrees.get((a, b))
        if known is None:
            if len(self.agrees) > CACHE_ENTRIES:
                self.agrees.clear()
            known = self.agrees[a, b] = self.leaf(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right:
            return left + right
        i = j = 1 if not self.fits(left[-1], right[0]) else 0
        if not i:
            return left + right
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = self.leaf(b"".join(map(self.bytes_of.__getitem__, left[-i:] + right[:j])))
            left_ok = i == len(left) or self.fits(left[-i - 1], window[0])
            right_ok = j == len(right) or self.fits(window[-1], right[j])
            if left_ok and right_ok:
                return left[:-i] + window + right[j:]
            i, j = i if left_ok else 2 * i, j if right_ok else 2 * j

    def tree(self, data: bytes) -> list[int]:
        if len(data) <= LEAF_BYTES:
            return self.leaf(data)
        half = len(data) // 2
        return self.join(self.tree(data[:half]), self.tree(data[half:]))

    def piece(self, match: str) -> bytes:
        """Ids of one match of the pattern, as little-endian unsigned 32-bit integers."""
        found = self.pieces.get(match)
        if found is None:
            data = match.encode()
            whole = self.ranks.get(data)
            ids = [whole] if whole is not None else self.tree(data)
            found = b"".join(i.to_bytes(4, "little") for i in ids)
            if len(self.pieces) >= CACHE_ENTRIES:
                self.pieces.clear()
            if len(match) <= LEAF_BYTES:
                self.pieces[match] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids of a whole text.  It is cut at single spaces first, where the pattern always ends a match."""
        if not text:
            return b""
        if LOOSE.search(text):
            chunks = SEAM.split(text)
        else:
            first, *rest = text.split(" ")
            chunks = [first, *[" " + x for x in rest]]
        cache, out = self.chunks, []
        for chunk in chunks:
            ids = cache.get(chunk)
            if ids is None:
                ids = b"".join(map(self.piece, self.findall(chunk)))
                if len(cache) >= CACHE_ENTRIES:
                    cache.clear()
                if len(chunk) <= LEAF_BYTES:
                    cache[chunk] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I"))) if ids else b""


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@functools.lru_cache(1)
def _encoder(vocabulary: str, pattern: str) -> TreeEncoder:
    """One encoder for all tasks of a Python worker, with the pieces it has met."""
    import public_tokenizers

    return TreeEncoder(load_ranks(public_tokenizers.path(vocabulary)), pattern or public_tokenizers.PATTERN)


def encode_documents(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", pattern: str = "", text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row: id_col, ids (binary, little-endian unsigned 32-bit), n_tokens.

    No shuffle: each task loads the vocabulary (a parameter; bounded) and encodes its rows.
    Null text is empty and has no ids; other columns are ignored; repeated ids give repeated rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(vocabulary, pattern)
        for batch in batches:
            ids = [own.encode(x or "") for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], ["id", "ids", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text].alias("t")).mapInArrow(run, f"id {kind}, ids binary, n_tokens bigint").withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", id_col: str = "doc_id") -> DataFrame:
    """Per row: id_col, ids, n_tokens and the decoded bytes.  Null ids decode to nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(vocabulary, "")
        for batch in batches:
            yield pa.record_batch([*batch.columns, pa.array([own.decode(x or b"") for x in batch.column(1).to_pylist()], pa.binary())], ["id", "ids", "n_tokens", "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(encoded[id_col].alias("id"), "ids", "n_tokens").mapInArrow(run, f"id {kind}, ids binary, n_tokens bigint, decoded binary").withColumnRenamed("id", id_col)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    out = decode_documents(encode_documents(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
