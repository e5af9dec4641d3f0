"""Keyed stores as logs of operations (seq, op, k, v), reduced per key.

put and del set a key's state; ins takes effect only while the key is absent.  The reduction is
two aggregations with partial sums, so a key with most of the log is no bottleneck.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordering import ranged


def reduce_log(log: DataFrame, key: Sequence[str] = ("k",)) -> DataFrame:
    """key columns and v of the keys alive after the log.

    Of each key only the last put or del (by seq) and the first ins after the last del matter.
    """
    last = F.max(F.when(F.col("op") != "ins", F.struct("seq", "op", "v")))
    resets = log.groupBy(*key).agg(last.alias("r"))
    # Inserts after the last reset: the smallest seq above it.
    joined = log.where("op = 'ins'").join(resets.where("r is not null").select(*key, F.col("r.seq").alias("rs")), list(key), "left")
    first = joined.where("rs is null or seq > rs").groupBy(*key).agg(F.min(F.struct("seq", "v")).alias("i"))
    out = resets.join(first, list(key), "left")
    value = F.when(F.col("r.op") == "put", F.col("r.v")).otherwise(F.col("i.v"))
    alive = (F.col("r.op") == "put") | F.col("i").isNotNull()
    return out.where(F.coalesce(alive, F.lit(False))).select(*key, value.alias("v"))


def insert_if_absent(store: DataFrame, new: DataFrame, key: str, seq: str) -> DataFrame:
    """store and the first row (by seq) of every key that it lacks."""
    first = new.groupBy(key).agg(F.min_by(F.struct(*store.columns), seq).alias("x")).select("x.*")
    return store.unionByName(first.join(store, key, "left_anti"))


def upsert(store: DataFrame, new: DataFrame, key: str, seq: str | None = None) -> DataFrame:
    """store with the rows of new instead of its own for their keys; of equal keys in new the smallest seq counts."""
    fresh = new if seq is None else new.groupBy(key).agg(F.min_by(F.struct(*store.columns), seq).alias("x")).select("x.*")
    return store.join(fresh, key, "left_anti").unionByName(fresh.select(*store.columns))


def erase(store: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return store.join(gone, key, "left_anti")


def probe(store: DataFrame, probes: DataFrame, key: str, value: str) -> DataFrame:
    """probes with value of their key, or null, and found."""
    return probes.join(store.select(key, F.col(value), F.lit(True).alias("found")), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def bound(store: DataFrame, probes: DataFrame, key: str, probe_id: str, strict: bool = False, ranges: int | None = None) -> DataFrame:
    """probe_id, key (of the probe) and bound: the smallest key of store not below it (above it, if strict), or null.

    Keys of any type with an order; null keys are no keys, and null probes have no bound.  Keys and probes are
    sorted together by ranges of their own, so neither outliers nor far probes crowd a task; within a range the
    next key is a running minimum from its end, and the first keys of the ranges after it are one row a range.
    """
    kind, none = store.schema[key].dataType, F.lit(None)
    both = store.where(F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.lit(0 if strict else 1).alias("_side"), none.cast(probes.schema[probe_id].dataType).alias("_id"), F.col(key).alias("_own"))
    both = both.unionByName(probes.select(F.col(key).alias("_k"), F.lit(1 if strict else 0).alias("_side"), F.col(probe_id).alias("_id"), none.cast(kind).alias("_own")))
    own = ranged(both, ["_k", "_side", "_id"], ranges)
    near = F.min("_own").over(Window.partitionBy("_part").orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, 0))
    firsts = own.groupBy("_part").agg(F.min("_own").alias("_first"))
    after = firsts.select("_part", F.min("_first").over(Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)).alias("_after"))
    out = own.withColumn("_near", near).where(F.col("_side") == (1 if strict else 0)).join(F.broadcast(after), "_part")
    found = F.when(F.col("_k").isNotNull(), F.coalesce("_near", "_after")).cast(kind)
    return out.select(F.col("_id").alias(probe_id), F.col("_k").cast(probes.schema[key].dataType).alias(key), found.alias("bound"))


def apply_counted(store: DataFrame, log: DataFrame, key: str = "k") -> tuple[DataFrame, DataFrame]:
    """The store (key, v) after a log (seq, op, key, v) of ins, put and del, and one row of counts.

    ins takes effect where the key is absent at that time, also after a del; put always, without looking.
    inserted: ins that took effect; erased: del that found a key.
    """
    start = store.select(F.lit(None).cast("bigint").alias("seq"), F.lit("put").alias("op"), key, F.col("v"))
    every = start.unionByName(log.select(F.col("seq").cast("bigint").alias("seq"), "op", key, "v"))
    w = Window.partitionBy(key).orderBy(F.col("seq").asc_nulls_first())
    # After any step but del the key is there, whichever of them took effect.
    before = every.withColumn("_there", F.coalesce(F.lag("op").over(w) != "del", F.lit(False)))
    counts = before.where("seq is not null").agg(F.count_if((F.col("op") == "ins") & ~F.col("_there")).alias("inserted"), F.count_if((F.col("op") == "del") & F.col("_there")).alias("erased"))
    first = every.agg(F.min("seq")).first()[0]
    out = reduce_log(every.withColumn("seq", F.coalesce("seq", F.lit((first or 0) - 1))), (key,))
    return out, counts


def equal_range(store: DataFrame, probes: DataFrame, key: str, value: str) -> DataFrame:
    """probes with n and values: the none or one value that an unordered store with unique keys holds for each."""
    found = probe(store, probes, key, value)
    return found.withColumn("n", F.col("found").cast("int")).withColumn("values", F.when(F.col("found"), F.array(value)).otherwise(F.array().cast(f"array<{store.schema[value].dataType.simpleString()}>"))).drop(value, "found")


def store_by(rows: DataFrame, hashed: Column, like: Column, seq: str) -> DataFrame:
    """The first row (by seq) of each class of keys that are alike; hashed gives like keys like hashes.

    hashed deals the rows; like tells the keys of one hash apart.  Both are expressions over the columns of rows.
    """
    own = rows.withColumn("_hash", hashed).withColumn("_like", like)
    return own.groupBy("_hash", "_like").agg(F.min_by(F.struct(*rows.columns), seq).alias("x")).select("x.*")


def count_erased(store: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return store.join(gone, key, "left_semi").agg(F.count("*").alias("erased"))


def bucket(hash_column: Column, buckets: int, largest: int) -> Column:
    """floor(buckets * hash / (largest + 1)), of whole numbers only, as a quotient with decimals is rounded up just below the next bucket."""
    product, whole = hash_column.cast("decimal(38,0)") * buckets, F.lit(str(largest + 1)).cast("decimal(38,0)")
    return ((product - F.pmod(product, whole)) / whole).cast("bigint")
