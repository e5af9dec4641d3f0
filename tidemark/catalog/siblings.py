"""Queries of the operators that are near relatives of another one: each with what is its own."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.catalog import query
from tidemark.catalog.analytics import GRAM_SQL, SUFFIX_SQL, A_SQL, cells, saved, texts
from tidemark.catalog.flow import LINE, LINE_SQL, scratch
from tidemark.catalog.order import MIXED, machine_sql, traffic
from tidemark.functions import scalars as S
from tidemark.operators import dataflow as D
from tidemark.operators import keyed as K
from tidemark.operators import linalg as L
from tidemark.operators import replay as P
from tidemark.operators import sorting as G
from tidemark.operators.ordering import concatenate, physical_index, running, with_index
from tidemark.plans import text_index as X
from tidemark.session import table as t
from tidemark.sources import readers as R
from tidemark.sources import sinks

# --- writers, comparators, batched minima


@query("b7_buffered_writer", "SELECT true AS whole, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total, true AS apart FROM events")
def b7(spark, d):
    """Buckets written by one writer each: nothing is lost, and a key is in one bucket only."""
    path = scratch(spark)
    sinks.write_buckets(t(spark, d, "events").select("user_id", "event_id"), path, 8, "user_id")
    own = spark.read.parquet(path)
    apart = own.groupBy("user_id").agg(F.countDistinct("bucket").alias("b")).agg(F.max("b").alias("b"))
    return own.agg((F.max("bucket") < 8).alias("whole"), F.count("*").alias("n"), F.sum("event_id").alias("total")).crossJoin(apart.select((F.col("b") == 1).alias("apart")))


@query("c14_tuple_comparators", "SELECT x.n_nationkey AS a, y.n_nationkey AS b, x.n_regionkey < y.n_regionkey OR (x.n_regionkey = y.n_regionkey AND x.n_nationkey < y.n_nationkey) AS less, x.n_regionkey > y.n_regionkey OR (x.n_regionkey = y.n_regionkey AND x.n_nationkey > y.n_nationkey) AS greater, x.n_regionkey < y.n_regionkey AS less_first, x.n_regionkey > y.n_regionkey AS greater_first FROM nation x JOIN nation y ON y.n_nationkey = (x.n_nationkey * 7 + 3) % 25")
def c14(spark, d):
    own = t(spark, d, "nation").select(F.struct(F.col("n_regionkey").cast("int").alias("first"), F.col("n_nationkey").cast("int").alias("second")).alias("x"))
    both = own.join(own.withColumnRenamed("x", "y"), F.col("y.second") == (F.col("x.second") * 7 + 3) % 25)
    x, y = F.col("x"), F.col("y")
    return both.select(F.col("x.second").alias("a"), F.col("y.second").alias("b"), (x < y).alias("less"), (x > y).alias("greater"), (x["first"] < y["first"]).alias("less_first"), (x["first"] > y["first"]).alias("greater_first"))


@query("e11_batched_minima", """WITH x AS (SELECT l_quantity AS v, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS i FROM lineitem), q AS (SELECT c_custkey AS id, c_custkey * 2 AS lo, c_custkey * 2 + c_custkey % 50 AS hi FROM customer)
SELECT id, min(v) AS v FROM q JOIN x ON i BETWEEN lo AND hi GROUP BY 1""")
def e11(spark, d):
    own = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("v"))
    values = with_index(own, ["l_orderkey", "l_linenumber", "l_partkey"], "i").select("i", "v")
    asked = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 2).alias("lo"), (F.col("c_custkey") * 2 + F.col("c_custkey") % 50).alias("hi"))
    return X.range_minima(values, asked)


@query("e12_running_sum", "SELECT event_id, CAST(sum(event_id % 7 - 3) OVER (ORDER BY event_id) AS BIGINT) AS total, CAST(max(event_id % 101) OVER (ORDER BY event_id) AS BIGINT) AS most FROM events")
def e12_running(spark, d):
    own = t(spark, d, "events").select("event_id", (F.col("event_id") % 7 - 3).alias("v"), (F.col("event_id") % 101).alias("w"))
    return running(running(own, "v", ["event_id"], "total"), "w", ["event_id"], "most", "max").select("event_id", "total", "most")


# --- G: sorts whose rows are looked at where they really stand

PLACED = f"SELECT {{}}, row_number() OVER (ORDER BY {{}}) - 1 AS place FROM {{}}"


@query("g1_sorted_places", PLACED.format(LINE_SQL, LINE_SQL, "lineitem"))
def g1_places(spark, d):
    return physical_index(G.sort(t(spark, d, "lineitem").select(*LINE), LINE))


@query("g3_own_key", PLACED.format("p_partkey", "p_size, p_partkey", "part"))
def g3(spark, d):
    """The record has its own key: all its fields, sorted as one."""
    own = t(spark, d, "part").select(F.struct("p_size", "p_partkey").alias("key"))
    return physical_index(G.sort(own, ["key"])).select("key.p_partkey", "place")


@query("g9_recursive_merge", PLACED.format("o_orderkey, CAST(o_orderkey % 7 AS INTEGER) AS run", "o_custkey, o_orderkey", "orders"))
def g9(spark, d):
    """Seven sorted runs, three of them merged at a time, until one is left."""
    o, by = t(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey"]
    runs = [o.where(F.col("o_orderkey") % 7 == n).orderBy(*by) for n in range(7)]
    return physical_index(G.merge_recursively(runs, by, 3)).select("o_orderkey", "run", "place")


@query("g11_any_sequence", PLACED.format("v", "v", "(SELECT c_acctbal * 100 + c_custkey * 1e-6 AS v FROM customer)"))
def g11(spark, d):
    own = t(spark, d, "customer").select((F.col("c_acctbal") * 100 + F.col("c_custkey") * F.lit(1e-6)).alias("v"))
    return physical_index(G.sort(own, ["v"]))


@query("g14_one_task_sort", PLACED.format("n_name, n_nationkey", "n_name", "nation"))
def g14(spark, d):
    """A frame that fits in memory, sorted within its only partition."""
    return physical_index(t(spark, d, "nation").select("n_name", "n_nationkey").coalesce(1).sortWithinPartitions("n_name"))


@query("g16_merge_two", "SELECT k, src, row_number() OVER (ORDER BY k, src) - 1 AS place FROM (SELECT c_custkey AS k, 0 AS src FROM customer UNION ALL SELECT p_partkey, 1 FROM part)")
def g16(spark, d):
    two = [t(spark, d, "customer").select(F.col("c_custkey").alias("k")), t(spark, d, "part").select(F.col("p_partkey").alias("k"))]
    return physical_index(G.merge_runs(two, ["k"])).select("k", F.col("run").alias("src"), "place")


@query("g18_generic_shuffle", "SELECT count(*) AS n, count(*) AS places, true AS moved, true AS again FROM events")
def g18(spark, d):
    own = t(spark, d, "events").select("event_id")
    a, b = (G.random_shuffle(own, ["event_id"], 21).select("event_id", F.col("idx").alias(n)) for n in ("a", "b"))
    both = a.join(b, "event_id").join(with_index(own, ["event_id"], "was"), "event_id")
    return both.agg(F.count("*").alias("n"), F.countDistinct("a").alias("places"), (F.count_if(F.col("a") != F.col("was")) * 2 > F.count("*")).alias("moved"), F.every(F.col("a") == F.col("b")).alias("again"))


@query("g21_smallest_first", machine_sql(MIXED, "CASE x.op WHEN 'push' THEN list_sort(list_append(h, x.v)) ELSE h[2:] END", "CASE WHEN x.op = 'pop' AND len(h) > 0 THEN h[1] END", "event_id * 7919 % 10007"))
def g21(spark, d):
    return P.priority_queue_pops(traffic(spark, d, MIXED).withColumn("v", (F.col("seq") * 7919 % 10007).cast("double")), largest=False)


@query("g26_aggregate_push", "SELECT flush, count(*) AS n, max(v) AS most FROM (SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 64 AS flush, o_custkey AS v FROM orders) GROUP BY 1")
def g26(spark, d):
    """Pushes reach the queue 64 at a time; the last batch may be shorter."""
    own = t(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("v"))
    return G.aggregate_push(own, 64, "seq").groupBy("flush").agg(F.count("*").alias("n"), F.max("v").alias("most"))


# --- I: scalars


@query("i5_to_int64", "SELECT * FROM (VALUES ('42', 42, '42'), ('  -7x', -7, '0'), ('+9', 9, '9'), ('9223372036854775807', 9223372036854775807, '9223372036854775807'), ('18446744073709551615', NULL, '18446744073709551615'), ('none', 0, '0')) AS x(s, signed, unsigned)")
def i5(spark, d):
    rows = R.from_rows(spark, ((s,) for s in ("42", "  -7x", "+9", "9223372036854775807", "18446744073709551615", "none")), "s string")
    return rows.select("s", S.to_int64(F.col("s")).alias("signed"), S.to_uint64(F.col("s")).cast("string").alias("unsigned"))


def _mix_sql(value: str, source: str) -> str:
    """The mix on huge integers, step by step, each reduced to 64 bits."""
    whole, sql = 1 << 64, f"SELECT k, CAST({value} AS HUGEINT) AS x FROM {source}"
    for step, n in S.MIX:
        shifted = f"(x % {1 << (64 - n)}) * {1 << n}"
        change = {"xor": f"xor(x, x // {1 << n})", "add": f"(x + {shifted}) % {whole}", "add complement": f"(x + ({whole - 1} - {shifted})) % {whole}"}[step]
        sql = f"SELECT k, {change} AS x FROM ({sql})"
    return f"SELECT k, CAST(x AS VARCHAR) AS hash FROM ({sql})"


@query("i8_mix64", _mix_sql("k * 2654435761", "(SELECT o_orderkey AS k FROM orders)"))
def i8(spark, d):
    own = t(spark, d, "orders").select(F.col("o_orderkey").cast("bigint").alias("k"))
    return own.select("k", S.unsigned(S.mix64(F.col("k") * F.lit(2654435761))).alias("hash"))


# --- J: sequences and stacks


@query("j2_iterator_arithmetic", "SELECT idx, v, lead(v, 5) OVER (ORDER BY idx) AS ahead, lag(v, 3) OVER (ORDER BY idx) AS behind, n - idx AS rest FROM (SELECT c_custkey AS v, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS idx, count(*) OVER () AS n FROM customer)")
def j2(spark, d):
    """Iterators moved by whole numbers are joins on the position; the distance to the end is a difference."""
    own = saved(with_index(t(spark, d, "customer").select("c_acctbal", F.col("c_custkey").alias("v")), ["c_acctbal", "v"]).select("idx", "v"))
    ahead, behind = (own.select((F.col("idx") + by).alias("idx"), F.col("v").alias(n)) for n, by in (("ahead", -5), ("behind", 3)))
    return own.join(ahead, "idx", "left").join(behind, "idx", "left").crossJoin(own.agg(F.count("*").alias("n"))).select("idx", "v", "ahead", "behind", (F.col("n") - F.col("idx")).alias("rest"))


@query("j6_sequence", "SELECT v, row_number() OVER (ORDER BY part, place) - 1 AS idx FROM (SELECT s_suppkey AS v, 0 AS part, -s_suppkey AS place FROM supplier UNION ALL SELECT c_custkey, 1, c_custkey FROM customer)")
def j6(spark, d):
    """Pushed at the front (so the last comes first) and at the back, then read as one stream."""
    front = t(spark, d, "supplier").select(F.col("s_suppkey").alias("v"), (-F.col("s_suppkey")).alias("by"))
    back = t(spark, d, "customer").select(F.col("c_custkey").alias("v"), F.col("c_custkey").alias("by"))
    return with_index(concatenate(front, back), ["src", "by"]).select("v", "idx")


def _waves(spark, groups: int, up: int, waves: int):
    """A log of every group that pushes `up` values and pops them all, so many times."""
    n = 2 * up
    own = spark.range(groups * n * waves).select((F.col("id") % groups).alias("grp"), F.floor(F.col("id") / groups).alias("seq"))
    return own.select("grp", "seq", F.when(F.col("seq") % n < up, "push").otherwise("pop").alias("op"), (F.col("seq") * 10 + F.col("grp")).cast("double").alias("v"))


def _waves_sql(groups: int, up: int, waves: int) -> str:
    n = 2 * up
    return f"SELECT CAST(g.range AS BIGINT) AS grp, CAST(s.range AS BIGINT) AS seq, CAST((s.range // {n} * {n} + {n} - 1 - s.range % {n}) * 10 + g.range AS DOUBLE) AS v FROM range({groups}) g, range({n * waves}) s WHERE s.range % {n} >= {up}"


@query("j8_grow_shrink", _waves_sql(1, 500, 1))
def j8(spark, d):
    return P.stack_pops(_waves(spark, 1, 500, 1))


@query("j9_grow_shrink_pool", _waves_sql(5, 60, 4))
def j9(spark, d):
    """Five stacks that share their buffers and grow and shrink by turns."""
    return P.stack_pops(_waves(spark, 5, 60, 4))


@query("j10_migrating_stack", f"SELECT grp, seq, v, depth > 100 AS outside FROM (SELECT *, CAST(400 - (seq % 400) AS BIGINT) AS depth FROM ({_waves_sql(2, 200, 2)}))")
def j10(spark, d):
    """Past a critical size the content moves out; the pops are those of any stack."""
    pops = P.stack_pops(_waves(spark, 2, 200, 2))
    return pops.withColumn("outside", 400 - F.col("seq") % 400 > 100)


# --- K: keyed stores

STORE = "SELECT s_suppkey AS k, CAST(s_nationkey AS BIGINT) AS v FROM supplier"


def store(spark, d):
    return t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").cast("bigint").alias("v"))


@query("k2_insert_range", f"WITH s AS ({STORE}), n AS (SELECT o_custkey AS k, min_by(o_orderkey, o_orderkey) AS v FROM orders GROUP BY 1) SELECT * FROM s UNION ALL SELECT * FROM n WHERE k NOT IN (SELECT k FROM s)")
def k2(spark, d):
    new = t(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"), F.col("o_orderkey").alias("seq"))
    return K.insert_if_absent(store(spark, d), new, "k", "seq")


#: Keys 0 to 99 are in the store; a key's steps go by number: deleted, inserted, inserted again, overwritten and so on.
STEPS = ["ins", "del", "ins", "ins", "del", "del", "put", "ins", "ins"]


def steps(spark):
    own = spark.range(1800).select(F.col("id").alias("seq"), (F.col("id") % 200).alias("k"), F.floor(F.col("id") / 200).alias("n"))
    return own.select("seq", F.element_at(F.array(*map(F.lit, STEPS)), (F.pmod(F.col("n") + F.col("k"), F.lit(len(STEPS))) + 1).cast("int")).alias("op"), "k", F.col("seq").alias("v"))


def held(spark):
    return spark.range(100).select(F.col("id").alias("k"), (-F.col("id")).alias("v"))


STEPS_SQL = f"""WITH RECURSIVE x AS (SELECT CAST(range AS BIGINT) AS seq, CAST(range % 200 AS BIGINT) AS k, range // 200 AS n, list_value({', '.join(f"'{x}'" for x in STEPS)})[(range // 200 + range % 200) % {len(STEPS)} + 1] AS op FROM range(1800)),
r AS (SELECT CAST(range AS BIGINT) AS k, CAST(-1 AS BIGINT) AS n, range < 100 AS there, CASE WHEN range < 100 THEN CAST(-range AS BIGINT) END AS v, 0 AS inserted, 0 AS erased FROM range(200)
UNION ALL SELECT r.k, x.n, x.op <> 'del', CASE WHEN x.op = 'put' OR (x.op = 'ins' AND NOT r.there) THEN x.seq WHEN x.op = 'ins' THEN r.v END, CAST(x.op = 'ins' AND NOT r.there AS INTEGER), CAST(x.op = 'del' AND r.there AS INTEGER) FROM r JOIN x ON x.k = r.k AND x.n = r.n + 1)
"""


@query("k10_insert_after_delete", STEPS_SQL + "SELECT k, v FROM r WHERE n = (SELECT max(n) FROM r) AND there")
def k10(spark, d):
    """An insert takes effect where the key is absent, also after it was deleted."""
    return K.apply_counted(held(spark), steps(spark))[0]


@query("k10_counts", STEPS_SQL + "SELECT CAST(sum(inserted) AS BIGINT) AS inserted, CAST(sum(erased) AS BIGINT) AS erased FROM r")
def k10_counts(spark, d):
    return K.apply_counted(held(spark), steps(spark))[1]


@query("k11_insert_oblivious", f"WITH s AS ({STORE}), n AS (SELECT o_custkey AS k, max(o_orderkey) AS v FROM orders GROUP BY 1) SELECT * FROM n UNION ALL SELECT * FROM s WHERE k NOT IN (SELECT k FROM n)")
def k11(spark, d):
    """Written without a look at what is there: the last one counts, also over what the store held."""
    new = t(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"), (-F.col("o_orderkey")).alias("seq"))
    return K.upsert(store(spark, d), new, "k", "seq")


@query("k14_equal_range", f"WITH s AS ({STORE}) SELECT p_partkey AS k, CAST(s.k IS NOT NULL AS INTEGER) AS n, CASE WHEN s.k IS NULL THEN CAST([] AS BIGINT[]) ELSE [v] END AS values FROM part LEFT JOIN s ON s.k = p_partkey")
def k14(spark, d):
    return K.equal_range(store(spark, d), t(spark, d, "part").select(F.col("p_partkey").alias("k")), "k", "v")


@query("k15_subscript", f"WITH s AS ({STORE}) SELECT k, v FROM s UNION ALL SELECT DISTINCT c_custkey, CAST(0 AS BIGINT) FROM customer WHERE c_custkey NOT IN (SELECT k FROM s)")
def k15(spark, d):
    """Looking a key up by subscript puts it there with the default value."""
    asked = t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit(0).cast("bigint").alias("v"), F.col("c_custkey").alias("seq"))
    return K.insert_if_absent(store(spark, d), asked, "k", "seq")


# --- L: linear algebra


@query("l7_row_by_column", f"WITH {A_SQL} SELECT CAST(round(sum(x.v * y.v), 4) AS DOUBLE) AS v FROM a x JOIN a y ON x.i = 1 AND y.j = 2 AND x.j = y.i")
def l7(spark, d):
    a = cells(spark, d)
    row, column = a.where("i = 1").select(F.col("j").alias("i"), "v"), a.where("j = 2").select("i", "v")
    return L.dot(row, column).select(F.round("v", 4).alias("v"))


@query("l11_numpy_product", GRAM_SQL)
def l11(spark, d):
    """The product by NumPy in one block, as a check of the others."""
    a = cells(spark, d)
    return L.multiply_blocked(L.transpose(a), a, 1024)


# --- M: user functions


@F.pandas_udf(T.LongType())
def weigh(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series(np.where(a % 2 == 0, a * b, a + c)).astype("int64")


@query("m1_functor_of_three", "SELECT idx, CASE WHEN a % 2 = 0 THEN a * b ELSE a + c END AS value FROM (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS idx, c_custkey AS a FROM customer) JOIN (SELECT row_number() OVER (ORDER BY p_partkey DESC) - 1 AS idx, p_partkey AS b FROM part) USING (idx) JOIN (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS idx, s_suppkey AS c FROM supplier) USING (idx)")
def m1(spark, d):
    """A function of the user's own over three inputs, in Arrow batches."""
    return D.transform(weigh, (t(spark, d, "customer"), ["c_custkey"], "c_custkey"), (t(spark, d, "part"), [F.desc("p_partkey")], "p_partkey"), (t(spark, d, "supplier"), ["s_suppkey"], "s_suppkey"))


@query("m3_generator", "SELECT CAST(range AS BIGINT) AS idx, CAST(range * range % 97 AS BIGINT) AS v FROM range(500)")
def m3(spark, d):
    return R.generate(spark, 500, F.col("idx") * F.col("idx") % 97)


@query("m5_two_outputs", "SELECT 'sum' AS output, CAST(sum(o_custkey) AS BIGINT) AS v FROM orders UNION ALL SELECT 'odd', count(*) FROM orders WHERE o_custkey % 2 = 1")
def m5(spark, d):
    """One node that pushes into two others: its rows are computed once."""
    out = D.node_outputs(t(spark, d, "orders").select("o_custkey"), sum=lambda x: x.agg(F.sum("o_custkey").alias("v")), odd=lambda x: x.agg(F.count_if(F.col("o_custkey") % 2 == 1).alias("v")))
    return out["sum"].select(F.lit("sum").alias("output"), "v").unionByName(out["odd"].select(F.lit("odd").alias("output"), "v"))


@query("m6_sentinels", "SELECT v, row_number() OVER (ORDER BY v NULLS FIRST, last) - 1 AS place FROM (SELECT NULL AS v, 0 AS last UNION ALL SELECT s_acctbal, 0 FROM supplier UNION ALL SELECT CAST('Infinity' AS DOUBLE), 1)")
def m6(spark, d):
    """The comparator's least and greatest values close the sequence at both ends."""
    ends = spark.createDataFrame([(None,), (float("inf"),)], "v double")
    every = t(spark, d, "supplier").select(F.col("s_acctbal").cast("double").alias("v")).unionByName(ends)
    return physical_index(G.sort(every, [F.asc_nulls_first("v")]))


@query("m7_key_extractor", PLACED.format("c_custkey", "right(c_name, 1), c_custkey", "customer"))
def m7(spark, d):
    key = F.right("c_name", F.lit(1))
    return physical_index(G.sort(t(spark, d, "customer").select("c_custkey", key.alias("key")), ["key"], ["c_custkey"])).select("c_custkey", "place")


@query("m8_own_hash", "SELECT min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey % 100")
def m8(spark, d):
    """Keys are alike if they agree modulo 100; their hash is that modulo 7, so unlike keys share hashes too."""
    own = t(spark, d, "orders").select("o_orderkey", "o_custkey")
    return K.store_by(own, F.col("o_custkey") % 100 % 7, F.col("o_custkey") % 100, "o_orderkey").select("o_orderkey")


@query("m9_unique_predicate", "SELECT event_id FROM (SELECT event_id, event_id % 3 AS c, lag(event_id % 3) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b IS NULL OR b <> c")
def m9(spark, d):
    """Alike by a predicate of the user's own: equal modulo 3."""
    own = t(spark, d, "events").select("user_id", "event_id")
    return D.unique_by(own, lambda a, b: a % 3 == b % 3, "event_id", ["event_id"], ["user_id"]).select("event_id")


# --- N: composed


@query("n6_suffix_and_lcp", f"""WITH s AS ({SUFFIX_SQL}), p AS (SELECT doc, rank, i, lag(i) OVER (PARTITION BY doc ORDER BY rank) AS h FROM s)
SELECT doc, rank, i, CASE WHEN h IS NULL THEN CAST(0 AS BIGINT) ELSE CAST(coalesce(list_position(list_transform(range(1, length(text) + 2), lambda k: substr(text, CAST(i + k AS BIGINT), 1) <> substr(text, CAST(h + k AS BIGINT), 1) OR substr(text, CAST(i + k AS BIGINT), 1) = ''), true), 1) - 1 AS BIGINT) END AS lcp FROM p JOIN benchmark ON item_id = doc""")
def n6(spark, d):
    return X.suffix_and_lcp(saved(texts(spark, d)))


@query("n6_one_text", "WITH s AS (SELECT string_agg(text, '' ORDER BY item_id) AS text FROM benchmark) SELECT i - 1 AS i, row_number() OVER (ORDER BY encode(substr(text, i))) - 1 AS rank FROM (SELECT text, unnest(range(1, length(text) + 1)) AS i FROM s)")
def n6_one(spark, d):
    """One text, of all others joined: its suffixes are spread over all tasks."""
    whole = t(spark, d, "benchmark").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("item_id", "text"))), lambda x: x["text"]), "").alias("text"))
    return X.suffix_array(saved(X.characters(whole.withColumn("doc", F.lit(0)), "doc", "text"))).select("i", "rank")


@query("n14_copy_and_sort", PLACED.format("s_suppkey, s_name", "s_name", "supplier") + " UNION ALL SELECT -1, 'copy', count(*) FROM supplier")
def n14(spark, d):
    """A file copied as it is, and a sorted copy of it."""
    plain, ordered, own = scratch(spark), scratch(spark), t(spark, d, "supplier").select("s_suppkey", "s_name")
    own.write.parquet(plain)
    sinks.copy_sorted(spark, plain, ordered, 3, "s_name")
    same = spark.read.parquet(plain).join(own, ["s_suppkey", "s_name"])
    return sinks.read_in_place(spark, ordered).unionByName(same.agg(F.lit(-1).cast("bigint").alias("s_suppkey"), F.lit("copy").alias("s_name"), F.count("*").alias("place")))
