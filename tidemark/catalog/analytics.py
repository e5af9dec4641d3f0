"""Containers, keyed stores, linear algebra, user functions, composed and streaming queries (ids J to N and S)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.catalog.flow import COMPARE_SQL, REDUCED_SQL, event_log, probes, scratch
from tidemark.catalog.order import MIXED, machine_sql, traffic
from tidemark.operators import keyed as K
from tidemark.operators import linalg as L
from tidemark.operators import replay as P
from tidemark.operators import sorting as G
from tidemark.operators.ordering import with_index
from tidemark.plans import applications as A
from tidemark.plans import text_index as X
from tidemark.session import table as t
from tidemark.sources.sinks import export_parts, read_in_place
from tidemark.streaming import incremental as I

# --- J: sequential containers

@query("j1_vector_at", "SELECT idx, o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx FROM orders) WHERE idx IN (0, 17, 900)")
def j1(spark, d):
    return with_index(t(spark, d, "orders").select("o_orderkey"), ["o_orderkey"]).where(F.col("idx").isin(0, 17, 900)).select("idx", "o_orderkey")


@query("j1_vector_resize", "SELECT CAST(range AS BIGINT) AS idx, coalesce(v, 0) AS v FROM range(40) LEFT JOIN (SELECT n_nationkey AS v, row_number() OVER (ORDER BY n_nationkey) - 1 AS idx FROM nation) x ON idx = range")
def j1b(spark, d):
    own = with_index(t(spark, d, "nation").select(F.col("n_nationkey").alias("v")), ["v"])
    return spark.range(40).withColumnRenamed("id", "idx").join(own, "idx", "left").select("idx", F.coalesce("v", F.lit(0)).alias("v"))


ENDS = ["push_back", "push_front", "pop_front", "push_back", "pop_back", "push_front", "pop_back"]


@query("j4_deque", machine_sql(ENDS, "CASE x.op WHEN 'push_back' THEN list_append(h, x.v) WHEN 'push_front' THEN list_prepend(x.v, h) WHEN 'pop_front' THEN h[2:] ELSE h[:len(h) - 1] END", "CASE WHEN len(h) = 0 THEN NULL WHEN x.op = 'pop_front' THEN h[1] WHEN x.op = 'pop_back' THEN h[len(h)] END"))
def j4(spark, d):
    return P.deque_pops(traffic(spark, d, ENDS))


@query("j5_queue", machine_sql(MIXED, "CASE x.op WHEN 'push' THEN list_append(h, x.v) ELSE h[2:] END", "CASE WHEN x.op = 'pop' AND len(h) > 0 THEN h[1] END"))
def j5(spark, d):
    return P.queue_pops(traffic(spark, d, MIXED))


@query("j7_stack", machine_sql(MIXED, "CASE x.op WHEN 'push' THEN list_append(h, x.v) ELSE h[:len(h) - 1] END", "CASE WHEN x.op = 'pop' AND len(h) > 0 THEN h[len(h)] END"))
def j7(spark, d):
    return P.stack_pops(traffic(spark, d, MIXED))


# --- K: keyed stores

def writes(spark, d):
    return t(spark, d, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("v"), F.col("event_id").alias("seq"))


@query("k1_first_writer", "SELECT user_id AS k, min(event_id) AS v FROM events GROUP BY 1")
def k1(spark, d):
    return K.reduce_log(writes(spark, d).withColumn("op", F.lit("ins")))


@query("k3_last_writer", "SELECT user_id AS k, max(event_id) AS v FROM events GROUP BY 1")
def k3(spark, d):
    return K.reduce_log(writes(spark, d).withColumn("op", F.lit("put")))


@query("k4_sorted_bulk", "SELECT o_custkey AS k, min(o_orderkey) AS v FROM orders GROUP BY 1")
def k4(spark, d):
    return G.top_k_per(t(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v")), 1, ["k"], ["v"]).select("k", "v")


@query("k5_erase_count", "SELECT count(*) AS erased FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def k5(spark, d):
    return K.count_erased(t(spark, d, "customer").select(F.col("c_custkey").alias("k")), t(spark, d, "orders").select(F.col("o_custkey").alias("k")), "k")


@query("k6_count", "SELECT p_partkey AS id, CAST(p_partkey IN (SELECT s_suppkey FROM supplier) AS INTEGER) AS n FROM part")
def k6(spark, d):
    store = t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("v"))
    return K.probe(store, t(spark, d, "part").select(F.col("p_partkey").alias("k")), "k", "v").select(F.col("k").alias("id"), F.col("found").cast("int").alias("n"))


@query("k7_equal_range", "SELECT p_partkey AS id, (SELECT min(s_acctbal) FROM supplier WHERE s_acctbal >= p_retailprice) AS lo, (SELECT min(s_acctbal) FROM supplier WHERE s_acctbal > p_retailprice) AS hi FROM part")
def k7(spark, d):
    lo, hi = (K.bound(*probes(spark, d), "k", "id", strict=s).select("id", F.col("bound").alias(n)) for s, n in ((False, "lo"), (True, "hi")))
    return lo.join(hi, "id")


@query("k8_reverse_scan", "SELECT c_custkey AS k, row_number() OVER (ORDER BY c_custkey DESC) - 1 AS idx FROM customer")
def k8(spark, d):
    return with_index(t(spark, d, "customer").select(F.col("c_custkey").alias("k")), [F.desc("k")])


@query("k9_compare_stores", COMPARE_SQL.format(a="s_suppkey", x="supplier", b="n_nationkey", y="nation"))
def k9(spark, d):
    a, b = t(spark, d, "supplier").select(F.col("s_suppkey").alias("v")), t(spark, d, "nation").select(F.col("n_nationkey").alias("v"))
    return G.compare(with_index(a, ["v"]), with_index(b, ["v"]), "v")


@query("k12_log_with_deletes", REDUCED_SQL)
def k12(spark, d):
    return K.reduce_log(event_log(spark, d))


@query("k13_live_size", f"SELECT count(*) AS n FROM ({REDUCED_SQL})")
def k13(spark, d):
    return K.reduce_log(event_log(spark, d)).agg(F.count("*").alias("n"))


@query("k16_bulk_insert", "WITH o AS (SELECT s_suppkey AS k, CAST(s_nationkey AS BIGINT) AS v FROM supplier), n AS (SELECT c_custkey AS k, c_custkey * 2 AS v FROM customer WHERE c_custkey % 3 = 0) SELECT * FROM n UNION ALL SELECT * FROM o WHERE k NOT IN (SELECT k FROM n)")
def k16(spark, d):
    old = t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").cast("bigint").alias("v"))
    return K.upsert(old, t(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") * 2).alias("v")), "k")


# --- L: linear algebra.  a is supplier by line number, b is line number by brand, both of whole quantities.

A_SQL = "a AS (SELECT l_suppkey AS i, CAST(l_linenumber AS BIGINT) AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"
C_SQL = "c AS (SELECT l_suppkey AS i, CAST(l_linenumber AS BIGINT) AS j, CAST(count(*) AS DOUBLE) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)"
Y_SQL = "y AS (SELECT CAST(l_linenumber AS BIGINT) AS i, CAST(count(*) AS DOUBLE) AS v FROM lineitem GROUP BY 1)"


def cells(spark, d):
    return t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("i"), F.col("l_linenumber").cast("bigint").alias("j")).agg(F.sum("l_quantity").alias("v"))


def counts(spark, d):
    own = t(spark, d, "lineitem").where("l_returnflag = 'R'")
    return own.groupBy(F.col("l_suppkey").alias("i"), F.col("l_linenumber").cast("bigint").alias("j")).agg(F.count("*").cast("double").alias("v"))


def column(spark, d):
    return t(spark, d, "lineitem").groupBy(F.col("l_linenumber").cast("bigint").alias("i")).agg(F.count("*").cast("double").alias("v"))


@query("l1_vector_add", f"WITH {Y_SQL} SELECT i, v + 2 * v AS v FROM y")
def l1(spark, d):
    y = column(spark, d)
    return L.add(y, L.scale(y, 2.0), ("i",))


@query("l2_add", f"WITH {A_SQL}, {C_SQL} SELECT i, j, coalesce(a.v, 0) + coalesce(c.v, 0) AS v FROM a FULL JOIN c USING (i, j)")
def l2(spark, d):
    return L.add(cells(spark, d), counts(spark, d))


@query("l2_subtract", f"WITH {A_SQL}, {C_SQL} SELECT i, j, coalesce(a.v, 0) - coalesce(c.v, 0) AS v FROM a FULL JOIN c USING (i, j)")
def l2b(spark, d):
    return L.subtract(cells(spark, d), counts(spark, d))


@query("l3_scale", f"WITH {A_SQL} SELECT i, j, v * 3 AS v FROM a")
def l3(spark, d):
    return L.scale(cells(spark, d), 3.0)


GRAM_SQL = f"WITH {A_SQL} SELECT x.j AS i, y.j AS j, sum(x.v * y.v) AS v FROM a x JOIN a y ON x.i = y.i GROUP BY 1, 2"


@query("l4_multiply", GRAM_SQL)
def l4(spark, d):
    a = cells(spark, d)
    return L.multiply(L.transpose(a), a)


@query("l5_multiply_blocked", GRAM_SQL)
def l5(spark, d):
    a = cells(spark, d)
    return L.multiply_blocked(L.transpose(a), a, 64)


@query("l6_times_column", f"WITH {A_SQL}, {Y_SQL} SELECT a.i, sum(a.v * y.v) AS v FROM a JOIN y ON a.j = y.i GROUP BY 1")
def l6(spark, d):
    return L.times_column(cells(spark, d), column(spark, d))


@query("l6_row_times", f"WITH {A_SQL}, {C_SQL} SELECT a.j AS i, sum(a.v * x.v) AS v FROM a JOIN (SELECT i, sum(v) AS v FROM c GROUP BY 1) x ON a.i = x.i GROUP BY 1")
def l6b(spark, d):
    return L.row_times(counts(spark, d).groupBy("i").agg(F.sum("v").alias("v")), cells(spark, d))


@query("l8_outer", f"WITH {Y_SQL} SELECT p.i, q.i AS j, p.v * q.v AS v FROM y p, y q")
def l8(spark, d):
    return L.outer(column(spark, d), column(spark, d))


@query("l9_transpose", f"WITH {A_SQL} SELECT j AS i, i AS j, v FROM a")
def l9(spark, d):
    return L.transpose(cells(spark, d))


@query("l10_column_major", f"WITH {A_SQL} SELECT row_number() OVER (ORDER BY j, i) - 1 AS idx, v FROM a")
def l10(spark, d):
    return with_index(cells(spark, d), ["j", "i"]).select("idx", "v")


# --- M: user functions

@query("m2_grouped_fold", "SELECT event_type, CAST(sum(event_id % 13) AS BIGINT) AS v FROM events GROUP BY 1")
def m2(spark, d):
    @F.pandas_udf("bigint")
    def fold(v: pd.Series) -> int:
        return int((v % 13).sum())

    return t(spark, d, "events").groupBy("event_type").agg(fold("event_id").alias("v"))


@query("m4_one_to_many", "SELECT n_nationkey AS k, CAST(unnest(range(n_nationkey % 4)) AS BIGINT) AS i FROM nation")
def m4(spark, d):
    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([(k, i) for k in pdf["n_nationkey"] for i in range(k % 4)], columns=["k", "i"])

    return t(spark, d, "nation").select("n_nationkey").mapInPandas(run, "k int, i bigint")


# --- N: composed queries

@query("n1_call_bills", """WITH x AS (SELECT user_id AS caller, CAST(floor(epoch(ts)) AS BIGINT) AS ts, CAST(event_id % 2 + 1 AS INTEGER) AS event FROM events),
p AS (SELECT *, lag(ts) OVER (PARTITION BY caller ORDER BY ts, event) AS since FROM x)
SELECT caller, CAST(sum(CASE WHEN event = 2 AND since IS NOT NULL THEN 2 * (ts - since) // 60 ELSE 0 END) AS BIGINT) AS cents FROM p GROUP BY 1""")
def n1(spark, d):
    e = t(spark, d, "events")
    return A.call_bills(e.select(F.col("user_id").alias("caller"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"), (F.col("event_id") % 2 + 1).cast("int").alias("event")))


@query("n2_call_log", "SELECT CAST(range AS BIGINT) AS caller, CAST(20 AS BIGINT) AS records, CAST(10 AS BIGINT) AS calls, true AS apart, range < 100 AS own FROM range(100)")
def n2(spark, d):
    """Each caller has its calls, which start, end and do not overlap; another seed gives another log."""
    log = A.call_log(spark, 100, 10, 3)
    w = Window.partitionBy("caller").orderBy("ts", "event")
    steps = log.withColumn("before", F.lag("ts").over(w)).withColumn("n", F.row_number().over(w))
    fine = F.every((F.col("event") == 2 - F.col("n") % 2) & (F.col("before").isNull() | (F.col("before") < F.col("ts"))))
    other = A.call_log(spark, 100, 10, 4).groupBy("caller").agg(F.sum("ts").alias("other"))
    own = steps.groupBy("caller").agg(F.count("*").alias("records"), F.count_if(F.col("event") == 2).alias("calls"), fine.alias("apart"), F.sum("ts").alias("sum"))
    return own.join(other, "caller").select("caller", "records", "calls", "apart", (F.col("sum") != F.col("other")).alias("own"))


@query("n1_bill_text", "SELECT * FROM (VALUES ('7; 0 EUR 5 ct'), ('12; 3 EUR 0 ct'), ('30; 123 EUR 45 ct')) AS x(line)")
def n1_text(spark, d):
    return A.bill_text(spark.createDataFrame([(7, 5), (12, 300), (30, 12345)], "caller bigint, cents bigint"))


def texts(spark, d):
    return X.characters(t(spark, d, "benchmark"), "item_id", "text")


def saved(df):
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


SUFFIX_SQL = "SELECT item_id AS doc, i - 1 AS i, row_number() OVER (PARTITION BY item_id ORDER BY encode(substr(text, i))) - 1 AS rank FROM (SELECT item_id, text, unnest(range(1, length(text) + 1)) AS i FROM benchmark)"


@query("n3_suffix_array", SUFFIX_SQL)
def n3(spark, d):
    return X.suffix_array(saved(texts(spark, d)))


@query("n4_suffix_check", "SELECT item_id AS doc, 'right' AS kind, true AS ok FROM benchmark WHERE length(text) > 0 UNION ALL SELECT item_id, 'reversed', length(text) = 1 FROM benchmark WHERE length(text) > 0")
def n4(spark, d):
    chars = saved(texts(spark, d))
    ranks = saved(X.suffix_array(chars))
    n = ranks.groupBy("doc").agg(F.count("*").alias("n"))
    wrong = ranks.join(n, "doc").select("doc", "i", (F.col("n") - 1 - F.col("rank")).alias("rank"))
    right, turned = (X.check_suffix_array(chars, r).withColumn("kind", F.lit(k)) for r, k in ((ranks, "right"), (wrong, "reversed")))
    return right.unionByName(turned)


@query("n5_lcp", f"""WITH s AS ({SUFFIX_SQL}), p AS (SELECT doc, rank, i, lag(i) OVER (PARTITION BY doc ORDER BY rank) AS h FROM s)
SELECT doc, rank, CASE WHEN h IS NULL THEN CAST(0 AS BIGINT) ELSE CAST(coalesce(list_position(list_transform(range(1, length(text) + 2), lambda k: substr(text, CAST(i + k AS BIGINT), 1) <> substr(text, CAST(h + k AS BIGINT), 1) OR substr(text, CAST(i + k AS BIGINT), 1) = ''), true), 1) - 1 AS BIGINT) END AS lcp FROM p JOIN benchmark ON item_id = doc""")
def n5(spark, d):
    return X.lcp_array(saved(texts(spark, d)))


@query("n7_range_minima", """WITH x AS (SELECT o_custkey AS v, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders), q AS (SELECT s_suppkey AS id, s_suppkey * 3 AS lo, s_suppkey * 3 + s_suppkey * 7 AS hi FROM supplier)
SELECT id, min(v) AS v FROM q JOIN x ON i BETWEEN lo AND hi GROUP BY 1""")
def n7(spark, d):
    values = with_index(t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("v")), ["o_orderkey"], "i").select("i", "v")
    asked = t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 3).alias("lo"), (F.col("s_suppkey") * 10).alias("hi"))
    return X.range_minima(values, asked)


@query("n8_random_graph", "SELECT DISTINCT l_partkey % 100 AS src, l_suppkey % 100 AS dst FROM lineitem WHERE l_partkey % 100 <> l_suppkey % 100")
def n8(spark, d):
    return A.random_edges(t(spark, d, "lineitem").select((F.col("l_partkey") % 100).alias("src"), (F.col("l_suppkey") % 100).alias("dst")))


@query("n9_transpose", "SELECT CAST((range % 20) * 50 + range // 20 AS BIGINT) AS idx, CAST(range AS BIGINT) AS v FROM range(1000)")
def n9(spark, d):
    return A.transposed(spark.range(1000).select(F.col("id").alias("idx"), F.col("id").alias("v")), 50, 20)


@query("n10_sorted_characters", "SELECT c, pos, row_number() OVER (ORDER BY encode(c), pos) - 1 AS idx FROM (SELECT substr(s, i, 1) AS c, i - 1 AS pos FROM (SELECT 'Hasta la vista, baby' AS s, unnest(range(1, 21)) AS i))")
def n10(spark, d):
    own = X.characters(spark.createDataFrame([(0, "Hasta la vista, baby")], "k int, s string"), "k", "s")
    return with_index(own.select("c", F.col("i").alias("pos")), ["c", "pos"])


@query("n11_fixpoint", "SELECT o_orderkey AS id, CAST(0 AS BIGINT) AS v FROM orders")
def n11(spark, d):
    return A.until_fixpoint(t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("v")), lambda df: df.select("id", F.expr("v div 2").alias("v")), 64, saved)


@query("n12_squares", "SELECT CAST(range * range AS BIGINT) AS v, row_number() OVER (ORDER BY range * range % 10, range) - 1 AS idx FROM range(1, 1001)")
def n12(spark, d):
    own = spark.range(1, 1001).select("id", (F.col("id") * F.col("id")).alias("v")).withColumn("m", F.col("v") % 10)
    return with_index(own, ["m", "id"]).select("v", "idx")


@query("n13_sort_and_check", "SELECT 'sorted' AS file, true AS is_sorted UNION ALL SELECT 'copied', coalesce(bool_and(b <= o_totalprice), true) FROM (SELECT o_totalprice, lag(o_totalprice) OVER (ORDER BY o_orderkey) AS b FROM orders)")
def n13(spark, d):
    """Files written sorted and as they were, checked by the places of their rows."""
    own, out = t(spark, d, "orders").select("o_totalprice", "o_orderkey"), None
    for name, by in (("sorted", ["o_totalprice", "o_orderkey"]), ("copied", ["o_orderkey"])):
        path = scratch(spark)
        export_parts(own, path, 4, *by)
        checked = G.is_sorted(read_in_place(spark, path), F.col("o_totalprice"), ["place"]).withColumn("file", F.lit(name))
        out = checked if out is None else out.unionByName(checked)
    return out


@query("n15_summary", "SELECT min(o_totalprice) AS least, max(o_totalprice) AS most, count(*) AS n FROM orders")
def n15(spark, d):
    return t(spark, d, "orders").agg(F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most"), F.count("*").alias("n"))


# --- S: the same on streams; a finished stream gives the batch result

def stream(spark, d):
    # A pattern, as a stream's source may not be a plain file.
    return I.read_table(spark, f"{d}/event[s].parquet", t(spark, d, "events").schema)


@query("s1_windowed_counts", "SELECT CAST(epoch(time_bucket(INTERVAL '1 hour', ts)) AS BIGINT) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def s1(spark, d):
    path, own = scratch(spark), stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    counted = I.windowed_counts(own, "ts", "1 hour", "1 hour", by=("event_type",)).writeStream.outputMode("complete")
    counted.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/out")).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").select(F.unix_timestamp("start").alias("start"), "event_type", "n")


@query("s2_keyed_upserts", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def s2(spark, d):
    path = scratch(spark)
    run = I.keyed_upserts(stream(spark, d).select("user_id", "event_id"), "user_id", "event_id", f"{path}/store", f"{path}/log")
    run.awaitTermination()
    last = run.lastProgress["batchId"]
    return spark.read.parquet(f"{path}/store/{last}").select("user_id", "event_id")
