"""Suffix arrays, their checker, LCP arrays and range minima of texts (doc, i, c), also of a single large one.

Nothing is dealt by text: ranks are numbers of sorted ranges over all tasks, and suffixes meet by joins on
(doc, i), so one text of any length is spread like many small ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordering import ranged, with_index
from tidemark.session import staged


def characters(texts: DataFrame, doc: str, text: str) -> DataFrame:
    """doc, i (from 0), c of every character."""
    own = texts.where(F.length(text) > 0).select(F.col(doc).alias("doc"), F.posexplode(F.split(text, "")).alias("i", "c"))
    return own.where("c <> ''").select("doc", F.col("i").cast("bigint").alias("i"), "c")


def _ranked(rows: DataFrame, by: list[str]) -> DataFrame:
    """doc, i, rank: equal ranks for equal `by`, ascending in its order (not dense)."""
    each = ranged(rows.select(*by).distinct(), by).select(*by, F.col("_at").alias("rank"))
    return staged(rows.join(each, by).select("doc", "i", "rank"), "ranks")


def _doubled(chars: DataFrame) -> list[DataFrame]:
    """The ranks of all runs of 1, 2, 4, ... characters (cut at the text's end), until they differ for all suffixes."""
    levels = [_ranked(chars, ["doc", "c"])]
    n = levels[0].count()
    while levels[-1].select("rank").distinct().count() < n:
        own, step = levels[-1], 1 << (len(levels) - 1)
        after = own.select("doc", (F.col("i") - step).alias("i"), F.col("rank").alias("next"))
        pairs = own.join(after, ["doc", "i"], "left").select("doc", "i", "rank", F.coalesce("next", F.lit(-1)).alias("next"))
        levels.append(_ranked(pairs.withColumnRenamed("rank", "own"), ["own", "next"]))
    return levels


def _dense(ranks: DataFrame) -> DataFrame:
    """doc, i, rank from 0 within each text, of ranks that are ascending by text and all different."""
    own = with_index(ranks, ["rank"])
    first = own.groupBy("doc").agg(F.min("idx").alias("first"))
    return own.join(first, "doc").select("doc", "i", (F.col("idx") - F.col("first")).alias("rank"))


def suffix_array(chars: DataFrame) -> DataFrame:
    """doc, i, rank (from 0, per text): prefix doubling, one round for each power of two up to the longest repeat."""
    return _dense(_doubled(chars)[-1])


def check_suffix_array(chars: DataFrame, ranks: DataFrame) -> DataFrame:
    """doc, ok: ranks are a permutation, and neighbours are in order by character and the rank of the rest."""
    after = ranks.select("doc", (F.col("i") - 1).alias("i"), F.col("rank").alias("rest"))
    own = ranks.join(chars, ["doc", "i"]).join(after, ["doc", "i"], "left").withColumn("rest", F.coalesce("rest", F.lit(-1)))
    before = own.select("doc", (F.col("rank") + 1).alias("rank"), F.col("c").alias("pc"), F.col("rest").alias("pr"))
    both = own.join(before, ["doc", "rank"], "left")
    fine = F.col("pc").isNull() | (F.col("pc") < F.col("c")) | ((F.col("pc") == F.col("c")) & (F.col("pr") < F.col("rest")))
    per_rank = both.groupBy("doc", "rank").agg(F.every(fine).alias("fine"), F.count("*").alias("n"))
    whole = (F.max("n") == 1) & (F.min("rank") == 0) & (F.max("rank") == F.count("*") - 1)
    return per_rank.groupBy("doc").agg((F.every("fine") & whole).alias("ok"))


def suffix_and_lcp(chars: DataFrame) -> DataFrame:
    """doc, rank, i, lcp: suffixes in order, with the common prefix of each and the one before (0 for the first).

    Neighbours go through the levels of the doubling from the longest runs down: where theirs are equal, they
    move on by that many characters.
    """
    levels = _doubled(chars)
    own = staged(_dense(levels[-1]), "suffixes")
    before = own.select("doc", (F.col("rank") + 1).alias("rank"), F.col("i").alias("h"))
    pairs = own.join(before, ["doc", "rank"], "left").select("doc", "rank", "i", "h", F.lit(0).cast("bigint").alias("lcp"))
    for k in reversed(range(len(levels))):
        a, b = (levels[k].select("doc", F.col("i").alias(f"at_{x}"), F.col("rank").alias(f"run_{x}")) for x in "ab")
        at = pairs.withColumn("at_a", F.col("i") + F.col("lcp")).withColumn("at_b", F.col("h") + F.col("lcp"))
        met = at.join(a, ["doc", "at_a"], "left").join(b, ["doc", "at_b"], "left")
        pairs = staged(met.select("doc", "rank", "i", "h", F.when(F.col("run_a") == F.col("run_b"), F.col("lcp") + (1 << k)).otherwise(F.col("lcp")).alias("lcp")), "lcp")
    return pairs.select("doc", "rank", "i", "lcp")


def lcp_array(chars: DataFrame) -> DataFrame:
    """doc, rank, lcp: common prefix of each suffix with the one before (0 for the first)."""
    return suffix_and_lcp(chars).select("doc", "rank", "lcp")


#: Values in a block of range minima.
MINIMA_BLOCK = 256


def _blocks(values: DataFrame) -> DataFrame:
    """block, vs: the values (a frame: i, v, dense from 0) of positions block * MINIMA_BLOCK and after, in order."""
    own = values.groupBy(F.expr(f"i div {MINIMA_BLOCK}").alias("block")).agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("x"))
    return staged(own.select("block", F.col("x.v").alias("vs")), "blocks")


def range_minima(values: DataFrame, asked: DataFrame) -> DataFrame:
    """id, v for asked (id, lo, hi, both inclusive): the least v at these positions (values: i, v, dense from 0); no row if there is none.

    A range is the end of one block, whole blocks and the beginning of another one, or a part of one.  Whole blocks are a
    range of their minima, which are values of the next level, so levels shrink MINIMA_BLOCK-fold and a range meets two blocks of each.
    """
    now = asked.where("lo <= hi and hi >= 0").select("id", F.greatest(F.col("lo").cast("bigint"), F.lit(0)).alias("lo"), F.col("hi").cast("bigint").alias("hi"))
    span = now.agg(F.max(F.col("hi") - F.col("lo"))).first()[0]
    level, found = values, []
    while True:
        blocks = _blocks(level)
        ends = now.withColumn("a", F.expr(f"lo div {MINIMA_BLOCK}")).withColumn("b", F.expr(f"hi div {MINIMA_BLOCK}"))
        head = F.struct(F.col("a").alias("block"), (F.col("lo") % MINIMA_BLOCK).alias("first"), F.when(F.col("a") == F.col("b"), F.col("hi") % MINIMA_BLOCK).otherwise(MINIMA_BLOCK - 1).alias("last"))
        tail = F.when(F.col("a") < F.col("b"), F.struct(F.col("b").alias("block"), F.lit(0).cast("bigint").alias("first"), (F.col("hi") % MINIMA_BLOCK).alias("last")))
        pieces = ends.select("id", F.explode(F.array(head, tail)).alias("p")).where("p is not null").select("id", "p.block", F.col("p.first").cast("int").alias("first"), F.col("p.last").cast("int").alias("last"))
        met = pieces.join(blocks, "block").where("first < size(vs)")
        found.append(met.select("id", F.array_min(F.slice("vs", F.col("first") + 1, F.col("last") - F.col("first") + 1)).alias("v")))
        span = -1 if span is None else span // MINIMA_BLOCK - 1
        if span < 0:
            return reduce(DataFrame.unionByName, found).groupBy("id").agg(F.min("v").alias("v"))
        level = blocks.select(F.col("block").alias("i"), F.array_min("vs").alias("v"))
        now = ends.select("id", (F.col("a") + 1).alias("lo"), (F.col("b") - 1).alias("hi")).where("lo <= hi")
