"""Operators on awkward frames, several ranges, and random traces against plain models."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import dataflow as D
from tidemark.operators import keyed as K
from tidemark.operators import sorting as G
from tidemark.operators.ordering import physical_index, running, with_index, with_previous
from tidemark.plans import text_index as X

VALUES = [5, None, 3, 3, 9, -1, None, 7, 0, 3]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(n, v) for n, v in enumerate(VALUES)], "n int, v int").repartition(3)


@pytest.mark.parametrize("ranges", [1, 4, 9])
def test_with_index(awkward, ranges):
    rows = with_index(awkward, ["v", "n"], ranges=ranges).collect()
    want = sorted(range(len(VALUES)), key=lambda n: (VALUES[n] is None, VALUES[n] or 0, n))
    assert [r["n"] for r in sorted(rows, key=lambda r: r["idx"])] == want and sorted(r["idx"] for r in rows) == list(range(10))
    down = with_index(awkward, [F.desc_nulls_first("v"), F.desc("n")], start=5, ranges=ranges).collect()
    assert [r["n"] for r in sorted(down, key=lambda r: r["idx"])] == want[::-1] and min(r["idx"] for r in down) == 5


def test_empty(awkward):
    none = awkward.where("false")
    assert with_index(none, ["n"]).collect() == [] and with_previous(none, ["v"], ["n"], "b").collect() == []
    assert running(none, "v", ["n"], "s").collect() == [] and D.unique(none, ["v"], ["n"]).collect() == []
    assert G.is_sorted(none, F.col("v"), ["n"]).first()[0] is True
    assert K.bound(none.withColumnRenamed("v", "k"), none.withColumnRenamed("v", "k"), "k", "n").collect() == []


@pytest.mark.parametrize("ranges", [1, 5])
def test_previous_and_running(awkward, ranges):
    rows = {r["n"]: r["b"]["v"] if r["b"] else "none" for r in with_previous(awkward, ["v"], ["n"], "b", ranges).collect()}
    assert rows == {n: VALUES[n - 1] if n else "none" for n in range(10)}
    for fold, model in (("sum", sum), ("min", min), ("max", max)):
        got = {r["n"]: r["x"] for r in running(awkward, "v", ["n"], "x", fold, ranges).collect()}
        assert got == {n: model(x for x in VALUES[: n + 1] if x is not None) for n in range(10)}


def test_unique_and_is_sorted(spark, awkward):
    got = sorted(r["n"] for r in D.unique(awkward, ["v"], ["n"]).collect())
    assert got == [n for n in range(10) if n == 0 or VALUES[n] != VALUES[n - 1]]
    rising = spark.range(50).withColumn("v", F.col("id") * 2)
    assert G.is_sorted(rising, F.col("v"), ["id"]).first()[0] and not G.is_sorted(rising, -F.col("v"), ["id"]).first()[0]
    grouped = rising.withColumn("g", F.col("id") % 2).withColumn("v", F.when(F.col("g") == 1, -F.col("v")).otherwise(F.col("v")))
    assert {r["g"]: r["is_sorted"] for r in G.is_sorted(grouped, F.col("v"), ["id"], ["g"]).collect()} == {0: True, 1: False}


def test_physical_index_tells_disorder(spark):
    own = spark.range(100).repartition(4)
    placed = physical_index(G.sort(own, [F.desc("id")]))
    assert all(r["place"] == 99 - r["id"] for r in placed.collect())
    assert not all(r["place"] == r["id"] for r in physical_index(own).collect())


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("ranges", [1, 6])
def test_bound(spark, strict, ranges):
    """An outlier, probes far outside the store, equal keys and null probes."""
    rnd = random.Random(3)
    keys = [rnd.randint(0, 50) for _ in range(60)] + [10**12]
    probes = [*range(-5, 60), -(10**15), 10**11, 10**12, 10**15, None]
    got = K.bound(spark.createDataFrame([(k,) for k in [*keys, None]], "k bigint"), spark.createDataFrame(list(enumerate(probes)), "id int, k bigint"), "k", "id", strict, ranges).collect()
    keys.sort()
    at = bisect.bisect_right if strict else bisect.bisect_left
    want = {n: None if p is None or at(keys, p) == len(keys) else keys[at(keys, p)] for n, p in enumerate(probes)}
    assert {r["id"]: r["bound"] for r in got} == want and len(got) == len(probes)


def test_bound_of_strings(spark):
    store, asked = (spark.createDataFrame([(x, n) for n, x in enumerate(v)], "k string, id int") for v in (["b", "d", "f"], ["a", "b", "c", "g"]))
    got = K.bound(store.select("k"), asked, "k", "id").collect()
    assert {r["k"]: r["bound"] for r in got} == {"a": "b", "b": "b", "c": "d", "g": None}


@pytest.mark.parametrize("seed", [1, 2])
def test_store_trace(spark, seed):
    """A random log of inserts, writes and deletes against a dictionary."""
    rnd = random.Random(seed)
    log = [(n, rnd.choice(["ins", "put", "del"]), rnd.randint(0, 20), rnd.randint(0, 99)) for n in range(400)]
    model, inserted, erased = {k: -k for k in range(0, 20, 3)}, 0, 0
    start = spark.createDataFrame(list(model.items()), "k int, v int")
    for _, op, k, v in log:
        if op == "del":
            erased += model.pop(k, None) is not None
        elif op == "put":
            model[k] = v
        elif k not in model:
            model[k], inserted = v, inserted + 1
    out, counts = K.apply_counted(start, spark.createDataFrame(log, "seq int, op string, k int, v int"))
    assert {r["k"]: r["v"] for r in out.collect()} == model and tuple(counts.first()) == (inserted, erased)


def test_sorter_misuse(spark):
    sorter = G.Sorter(spark, "v int", ["v"])
    with pytest.raises(RuntimeError):
        sorter.rows()
    sorter.push(spark.createDataFrame([(2,), (1,)], "v int"))
    sorter.sort()
    with pytest.raises(RuntimeError):
        sorter.push(spark.createDataFrame([(3,)], "v int"))
    assert [r["v"] for r in sorter.next(1).collect()] == [1] and sorter.size() == 1


def test_parse_size_units(spark):
    rows = spark.createDataFrame([("7",), ("7B",), ("7k",)], "s string")
    for unit, want in (("", [7, 7, 7000]), ("k", [7000, 7, 7000]), ("M", [7 << 20, 7, 7000])):
        assert [r[0] for r in rows.select(S.parse_size(F.col("s"), unit)).collect()] == want


@pytest.mark.parametrize("text", ["mississippi", "aaaaaaaa", "a", "abcab" * 9])
def test_suffixes(spark, text):
    got = X.suffix_and_lcp(X.characters(spark.createDataFrame([(1, text)], "doc int, text string"), "doc", "text")).collect()
    order = sorted(range(len(text)), key=lambda i: text[i:])
    common = [0] + [next((k for k in range(len(text)) if text[a + k : a + k + 1] != text[b + k : b + k + 1] or not text[a + k : a + k + 1]), len(text)) for a, b in zip(order, order[1:], strict=False)]
    assert [(r["i"], r["lcp"]) for r in sorted(got, key=lambda r: r["rank"])] == list(zip(order, common, strict=True))


@pytest.mark.parametrize("largest", [(1 << 32) - 1, (1 << 64) - 1])
def test_bucket_edges(spark, largest):
    """The last hashes below the edge of a bucket are not of the next one."""
    hashes = [h for b in (1, 2, 63, 64) for h in ((b * (largest + 1) // 64) + d for d in (-1, 0, 33, -33)) if h <= largest]
    rows = spark.createDataFrame([(str(h),) for h in hashes], "h string").select("h", K.bucket(F.col("h").cast("decimal(20,0)"), 64, largest).alias("b")).collect()
    assert {int(r["h"]): r["b"] for r in rows} == {h: 64 * h // (largest + 1) for h in hashes}


@pytest.mark.parametrize("n", [1, 256, 700, 70_000])
def test_range_minima(spark, n, monkeypatch):
    """Ranges at the edges of blocks, past the end, before the start, empty ones and null values; what is written keeps to the size of the values."""
    written, staged = [], X.staged

    def counted(df, what="stage"):
        out = staged(df, what)
        written.append(out.agg(F.sum(F.size("vs"))).first()[0] if "vs" in out.columns else out.count())
        return out

    monkeypatch.setattr(X, "staged", counted)
    rnd = random.Random(n)
    values = [None if rnd.random() < 0.1 else rnd.randint(0, 10**9) for _ in range(n)]
    edges = [x for x in (0, 1, 255, 256, 257, 511, 512, 65_535, 65_536, n - 1, n, n + 3) if x <= n + 3]
    asked = [(lo, hi) for lo in edges for hi in edges] + [(-5, 3), (-5, -1), (n, n + 10**6), (None, 3), (3, None)] + [(rnd.randrange(n), rnd.randrange(n)) for _ in range(40)]
    got = X.range_minima(spark.createDataFrame(list(enumerate(values)), "i bigint, v int").repartition(3), spark.createDataFrame([(k, *x) for k, x in enumerate(asked)], "id int, lo bigint, hi bigint")).collect()
    want = {}
    for k, (lo, hi) in enumerate(asked):
        own = [] if lo is None or hi is None or hi < 0 else values[max(lo, 0) : hi + 1]
        if own:
            want[k] = min((v for v in own if v is not None), default=None)
    assert {r["id"]: r["v"] for r in got} == want and len(got) == len(want)
    assert sum(written) <= n + n // 128 + 4
