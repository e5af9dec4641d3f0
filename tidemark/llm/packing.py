"""Best-two-fit packing of tokenised documents into sequences of bounded length.

Lengths are whole numbers up to the sequence length, so the packing is planned on their
histogram: at most `max_len` counts, whatever the corpus.  The plan fills a bin greedily with the
largest length that fits, then replaces the bin's smallest document with the two unpacked ones
that fill the widened gap best, and repeats that bin as often as the counts allow.  Pieces then
find their place from their rank among the pieces of their length.
"""

from __future__ import annotations

import bisect
import functools
import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, table

MAX_LEN = 4096
END_ID = 1
CACHE_ENTRIES = 400_000
#: Pieces of one length are ranked in so many independent parts.
SALTS = 128


#: Signs that end a word: after a letter or digit and before white space they are one match of the
#: vocabulary's pattern (an apostrophe may begin another one), so they may stand apart.
SIGNS = re.compile(rb"(?:(?<=[a-z0-9])|(?<=\xc3[\xa0-\xb6\xb8-\xbf]))([!-&(-/:-@\[-`{-~]+)(?=[ \t-\r]|\Z)")

#: A full stop or comma that ends a word and may belong to a longer run of signs, or follows a byte that may be no letter.
DOUBTFUL = re.compile(rb"[.,](?<![a-z0-9][.,])(?<!\xc3[\x80-\x96\x98-\xb6\xb8-\xbf][.,])[ \n]")


def _apart(text: bytes) -> bytes:
    """The text with signs at the ends of words set apart, where that leaves the pattern's matches as they are."""
    if DOUBTFUL.search(text):
        return SIGNS.sub(rb" \1", text)
    for end in (b", ", b". ", b".\n"):
        text = text.replace(end, b" " + end)
    return text


class WordEncoder:
    """Ids of a text by the tokenizers library, one encoding for each distinct word.

    The vocabulary's pattern never matches across white space and its normalisation works within
    words, so the ids of a text are those of its words one after another.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Strings that are one token wherever they stand in a text; such texts are encoded whole.
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def learn(self, texts: list[list[bytes]]) -> None:
        """Encode the words that are new, many in one call.  Words that were met since the last turn of the cache stay."""
        fresh = set().union(*texts).difference(self.cache)
        if len(self.cache) + len(fresh) > CACHE_ENTRIES // 2:
            self.older, self.cache = self.cache, {}
            fresh = set().union(*texts)
        known = fresh & self.older.keys()
        self.cache.update((w, self.older[w]) for w in known)
        plain, rest = [], []
        for w in fresh - known:
            word = w.decode()
            (plain if word.isalpha() and (word.isascii() or word == word.lower()) else rest).append(w)
        # A word of letters is one match, whose last token ends a word: a whole line of them is encoded at once.
        for lo in range(0, len(plain), 2000):
            some = plain[lo : lo + 2000]
            ids = np.array(self.tokenizer.encode(b" ".join(some).decode(), add_special_tokens=False).ids, "<u4")
            raw, at = ids.tobytes(), ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            self.cache.update(zip(some, (raw[i:j] for i, j in zip([0, *at[:-1]], at, strict=True)), strict=True))
        found = self.tokenizer.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False)
        self.cache.update(zip(rest, (np.array(x.ids, "<u4").tobytes() for x in found), strict=True))

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        lower = [t.lower() for t in texts]
        whole = {n for n, t in enumerate(lower) if any(s in t for s in self.special)}
        words = [[] if n in whole else _apart(t).split() for n, t in enumerate(lower)]
        self.learn(words)
        get = self.cache.__getitem__
        out = [b"".join(map(get, x)) for x in words]
        for n in whole:
            out[n] = np.array(self.tokenizer.encode(texts[n].decode(), add_special_tokens=False).ids, "<u4").tobytes()
        return out


@functools.lru_cache(1)
def _encoder(vocabulary: str) -> WordEncoder:
    """One encoder for all tasks of a Python worker, with the words it has met."""
    import public_tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallel part
    return WordEncoder(public_tokenizers.path(vocabulary))


def cut(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", max_len: int = MAX_LEN, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids (binary, little-endian unsigned 32-bit).

    A document is its ids and end_id; only longer ones are cut, at every max_len ids.  Null and
    empty texts are end_id alone.  No shuffle.
    """
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(vocabulary)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            texts = [x or b"" for x in batch.column(1).to_pylist()]
            for lo in range(0, len(texts), 500):
                rows = []
                for key, ids in zip(keys[lo : lo + 500], own.encode_all(texts[lo : lo + 500]), strict=True):
                    ids += end
                    rows += [(key, k, k * max_len, ids[at : at + 4 * max_len]) for k, at in enumerate(range(0, len(ids), 4 * max_len))]
                key, piece, start, ids = zip(*rows, strict=True)
                yield pa.record_batch([pa.array(key, batch.schema.field(0).type), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "piece", "start", "length", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(docs["doc_id"], docs["text"].cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids binary")


def best_two(lengths: list[int], left: Counter, gap: int, more_than: int) -> tuple[int, int] | None:
    """Two lengths still unpacked whose sum is the largest up to gap, if that is over more_than."""
    best, lo, hi = None, 0, bisect.bisect_right(lengths, gap) - 1
    while lo <= hi:
        both = lengths[lo] + lengths[hi]
        if both > gap:
            hi -= 1
            continue
        if both > more_than and (lo != hi or left[lengths[lo]] > 1):
            best, more_than = (lengths[hi], lengths[lo]), both
            if both == gap:
                break
        lo += 1
    return best


def plan(counts: dict[int, int], max_len: int = MAX_LEN) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, uses in a bin, offset of the first, first bin), and the number of bins.

    Each bin pattern uses up at least one length, so there are at most as many patterns as lengths.
    """
    left, rows, bins = Counter({k: v for k, v in counts.items() if v}), [], 0
    ranks: Counter = Counter()
    while left:
        lengths = sorted(left)
        used: Counter = Counter()

        used[lengths[-1]] += 1
        gap = max_len - lengths[-1]
        at = len(lengths)
        while gap and (at := bisect.bisect_right(lengths, gap, 0, at) - 1) >= 0:
            size = lengths[at]
            n = min(left[size] - used[size], gap // size)
            used[size] += n
            gap -= n * size
            at = at if n == 0 else at + 1
            if n == 0 or left[size] == used[size]:
                at = bisect.bisect_left(lengths, size)
        if gap and len(+used) and sum(used.values()) > 1:
            small = min(+used)
            rest = Counter({x: left[x] - used[x] for x in lengths if left[x] > used[x]})
            if two := best_two(sorted(rest), rest, gap + small, small):
                used[small] -= 1
                used.update(two)
        used = +used
        times = min(left[x] // n for x, n in used.items())
        offset = 0
        for size, n in sorted(used.items(), reverse=True):
            rows.append((size, ranks[size], n, offset, bins))
            ranks[size] += times * n
            offset += n * size
            left[size] -= times * n
        left = +left
        bins += times
    return np.array(rows or np.empty((0, 5)), dtype=np.int64).reshape(-1, 5), bins


def pack(pieces: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    """pieces (doc_id, piece, length, ...) with sequence_id and offset (columns of those names are replaced, all others stay).

    The result is whole: every piece gets a place.  What reaches the driver is the histogram of
    lengths (max_len rows at most).  Ranks are counted within (length, salt), so a length that a
    third of all pieces share is dealt over SALTS tasks.  pieces must give the same rows when read
    again: pass a written table.  An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    plain = {c: f"column_{n}" for n, c in enumerate(pieces.drop("sequence_id", "offset").columns)}
    own = ("doc_id", "piece", "length")
    named = {c: c if c in own else v for c, v in plain.items()}
    pieces = pieces.select(*(F.col(f"`{c}`").alias(v) for c, v in named.items()))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)))
    per_salt = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    first = per_salt.select("length", "_salt", F.coalesce(before, F.lit(0)).alias("_first"))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    rows, _ = plan(counts, max_len)
    order = np.lexsort((rows[:, 1], rows[:, 0]))
    known = spark.sparkContext.broadcast(rows[order])
    rank = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")) - 1
    ranked = salted.withColumn("_rank", rank).join(first, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_first")).drop("_salt", "_first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = known.value
        keys = found[:, 0] << 40 | found[:, 1]
        for batch in batches:
            length, own = (batch.column(batch.schema.get_field_index(x)).to_numpy(zero_copy_only=False) for x in ("length", "_rank"))
            row = found[np.searchsorted(keys, length << 40 | own, "right") - 1] if len(length) else found[:0]
            nth = own - row[:, 1]
            seq, offset = row[:, 4] + nth // np.maximum(row[:, 2], 1), row[:, 3] + nth % np.maximum(row[:, 2], 1) * length
            keep = [i for i, n in enumerate(batch.schema.names) if n != "_rank"]
            yield pa.record_batch([*(batch.column(i) for i in keep), pa.array(seq, pa.int64()), pa.array(offset, pa.int64())], [*(batch.schema.names[i] for i in keep), "sequence_id", "offset"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank")
    out = ranked.mapInArrow(run, f"{shape}, sequence_id bigint, offset bigint")
    return out.select(*(F.col(v).alias(c) for c, v in named.items()), "sequence_id", "offset")


def crc_of_ids(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))


def pack_documents(docs: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    """Cut, digest and pack documents (doc_id, text): one row a piece with its digest and place."""
    scratch = Scratch(docs.sparkSession, "pack")
    return pack(scratch.save("pieces", crc_of_ids(cut(docs, max_len=max_len))), max_len)


def op3_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack_documents() over all documents; a null text is its end token alone, rows that repeat are packed each."""
    out = pack_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
