"""Sources, sinks, projections, scans, joins, aggregations and de-duplication (ids A to F)."""

from __future__ import annotations

import uuid

from pyspark.sql import Observation, Window
from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.functions import scalars as S
from tidemark.operators import dataflow as D
from tidemark.operators import keyed as K
from tidemark.operators import sorting as G
from tidemark.operators.ordering import concatenate, with_index, zip_frames
from tidemark.session import shared_dir
from tidemark.session import table as t
from tidemark.sources import readers as R

#: A total order of lineitem.
LINE = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
LINE_SQL = ", ".join(LINE)


def scratch(spark) -> str:
    """A new folder in the shared one of spark.checkpoint.dir."""
    return f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"


# --- A: sources

@query("a1_rows", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, 'c')) AS x(k, v)")
def a1(spark, d):
    return R.from_rows(spark, ((n, c) for n, c in enumerate("abc", 1)), "k int, v string")


@query("a2_range_scan", f"SELECT * FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY {LINE_SQL}) - 1 AS idx FROM lineitem) WHERE idx BETWEEN 100 AND 1099")
def a2(spark, d):
    return with_index(t(spark, d, "lineitem").select(*LINE), LINE).where("idx between 100 and 1099").select("l_orderkey", "l_linenumber", "idx")


@query("a3_small_scan", "SELECT n_nationkey, n_name FROM nation")
def a3(spark, d):
    return t(spark, d, "nation").select("n_nationkey", "n_name")


@query("a4_bounded_generator", "SELECT CAST(range AS BIGINT) AS idx, CAST((range * range) % 97 AS BIGINT) AS v FROM range(1000)")
def a4(spark, d):
    return R.generate(spark, 1000, F.expr("(idx * idx) % 97"))


@query("a5_counter", "SELECT s_name, row_number() OVER (ORDER BY s_suppkey) - 1 AS idx FROM supplier")
def a5(spark, d):
    return with_index(t(spark, d, "supplier"), ["s_suppkey"]).select("s_name", "idx")


@query("a6_generate", "SELECT CAST(range AS BIGINT) AS idx, CAST(range * 3 + 7 AS BIGINT) AS v FROM range(500)")
def a6(spark, d):
    return R.generate(spark, 500, F.col("idx") * 3 + 7)


@query("a7_record_file", "SELECT c_custkey AS key, c_custkey + 42 AS load FROM customer")
def a7(spark, d):
    rows = t(spark, d, "customer").select(F.col("c_custkey").alias("key"), (F.col("c_custkey") + 42).alias("load"))
    packed = rows.select(R.encode_record({"key": 8, "load": 8}).alias("content"))
    return R.decode_records(packed, "content", {"key": 8, "load": 8}).select("key", "load")


@query("a8_rewind", "SELECT CAST(n AS BIGINT) AS n, CAST(total AS BIGINT) AS total, CAST(total AS BIGINT) AS again FROM (SELECT count(*) AS n, sum(user_id) AS total FROM events)")
def a8(spark, d):
    e = t(spark, d, "events")
    return e.agg(F.count("*").alias("n"), F.sum("user_id").alias("total")).join(e.agg(F.sum("user_id").alias("again")))


@query("a9_reverse_scan", "SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) - 1 AS idx FROM events")
def a9(spark, d):
    return with_index(t(spark, d, "events").select("ts", "event_id"), [F.desc("ts"), F.desc("event_id")]).select("event_id", "idx")


@query("a10_both_ways", "WITH x AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS i, row_number() OVER (ORDER BY p_partkey DESC) - 1 AS r FROM part) SELECT a.i AS idx, a.p_partkey AS ahead, b.p_partkey AS back FROM x a JOIN x b ON a.i = b.r")
def a10(spark, d):
    p = t(spark, d, "part")
    return zip_frames((p.select(F.col("p_partkey").alias("ahead")), ["ahead"]), (p.select(F.col("p_partkey").alias("back")), [F.desc("back")]))


@query("a11_sequence_streams", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS ahead, row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS back FROM orders")
def a11(spark, d):
    own = with_index(t(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], "ahead")
    last = F.broadcast(own.agg(F.max("ahead").alias("_top")))
    return own.join(last).select("o_orderkey", "ahead", (F.col("_top") - F.col("ahead")).alias("back"))


#: The events as a log: clicks and views put, purchases delete, all else inserts if absent.
LOG_SQL = "SELECT row_number() OVER (ORDER BY ts, event_id) AS seq, user_id AS k, event_id AS v, CASE event_id % 7 WHEN 0 THEN 'del' WHEN 1 THEN 'put' WHEN 2 THEN 'put' ELSE 'ins' END AS op FROM events"
REDUCED_SQL = f"""WITH log AS ({LOG_SQL}), r AS (SELECT k, max(seq) AS rs, arg_max(op, seq) AS rop, arg_max(v, seq) AS rv FROM log WHERE op <> 'ins' GROUP BY k),
i AS (SELECT log.k, arg_min(log.v, log.seq) AS iv FROM log LEFT JOIN r USING (k) WHERE op = 'ins' AND (rs IS NULL OR seq > rs) GROUP BY log.k),
keys AS (SELECT DISTINCT k FROM log)
SELECT keys.k, CASE WHEN rop = 'put' THEN rv ELSE iv END AS v FROM keys LEFT JOIN r USING (k) LEFT JOIN i USING (k) WHERE rop = 'put' OR iv IS NOT NULL"""


def event_log(spark, d):
    e = t(spark, d, "events").select("ts", "event_id", "user_id")
    op = F.when(F.col("event_id") % 7 == 0, "del").when(F.col("event_id") % 7 <= 2, "put").otherwise("ins")
    return e.select(F.struct("ts", "event_id").alias("seq"), F.col("user_id").alias("k"), F.col("event_id").alias("v"), op.alias("op"))


@query("a12_live_entries", REDUCED_SQL)
def a12(spark, d):
    return K.reduce_log(event_log(spark, d))


@query("a13_text_ingest", "SELECT user_id AS caller, event_id AS callee, CAST(floor(epoch(ts)) AS BIGINT) AS at, CAST(event_id % 2 + 1 AS INTEGER) AS event FROM events")
def a13(spark, d):
    lines = t(spark, d, "events").select(F.concat_ws(" ", "user_id", "event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).cast("string"), (F.col("event_id") % 2 + 1).cast("string")).alias("line"))
    return R.read_text_records(lines, "line", "caller bigint, callee bigint, at bigint, event int")


@query("a14_unary_text", "SELECT CAST(range AS BIGINT) AS i, 'a' AS c FROM range(64)")
def a14(spark, d):
    return R.repeated(spark, "a", 64).select(F.posexplode(F.split("text", "")).alias("i", "c")).where("c <> ''").select(F.col("i").cast("bigint").alias("i"), "c")


@query("a15_random_numbers", "SELECT CAST(range AS BIGINT) AS id, CAST((range * 1664525 + 1013904223) % 4294967296 AS BIGINT) AS r FROM range(1000)")
def a15(spark, d):
    return spark.range(1000).select("id", S.linear_congruential(F.col("id")).alias("r"))


@query("a17_disk_settings", "SELECT * FROM (VALUES ('/a', CAST(1048576000 AS BIGINT), 'syscall'), ('/b', CAST(5000000000 AS BIGINT), 'memory')) AS x(path, size, io)")
def a17(spark, d):
    lines = R.from_rows(spark, [("disk=/a,1000 MiB,syscall",), ("disk=/b,5G,memory",), ("# none",)], "line string")
    part = F.split(F.regexp_replace("line", "^disk=", ""), ",")
    return lines.where(F.col("line").startswith("disk=")).select(part[0].alias("path"), S.parse_size(part[1]).alias("size"), part[2].alias("io"))


# --- B: sinks

@query("b1_materialize", "SELECT o_orderkey, o_custkey FROM orders")
def b1(spark, d):
    path = scratch(spark)
    t(spark, d, "orders").select("o_orderkey", "o_custkey").write.parquet(path)
    return spark.read.parquet(path)


@query("b2_materialize_prefix", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 250")
def b2(spark, d):
    return D.cut(t(spark, d, "orders").select("o_orderkey", "o_orderdate"), 250, ["o_orderdate", "o_orderkey"])


@query("b3_overwrite_prefix", "WITH a AS (SELECT c_custkey AS v, row_number() OVER (ORDER BY c_custkey) - 1 AS idx FROM customer), b AS (SELECT s_suppkey + 1000000 AS n, row_number() OVER (ORDER BY s_suppkey) - 1 AS idx FROM supplier) SELECT idx, coalesce(n, v) AS v FROM a LEFT JOIN b USING (idx)")
def b3(spark, d):
    old = t(spark, d, "customer").select(F.col("c_custkey").alias("v"))
    new = t(spark, d, "supplier").select((F.col("s_suppkey") + 1000000).alias("v"))
    return D.overwrite_prefix(old, new, "v", ["v"], ["v"]).select("idx", "v")


@query("b4_overwrite_cut", "WITH a AS (SELECT c_custkey AS v, row_number() OVER (ORDER BY c_custkey) - 1 AS idx FROM customer), b AS (SELECT s_suppkey + 1000000 AS n, row_number() OVER (ORDER BY s_suppkey) - 1 AS idx FROM supplier) SELECT idx, coalesce(n, v) AS v FROM a LEFT JOIN (SELECT * FROM b WHERE idx < 5) USING (idx)")
def b4(spark, d):
    old = t(spark, d, "customer").select(F.col("c_custkey").alias("v"))
    new = t(spark, d, "supplier").select((F.col("s_suppkey") + 1000000).alias("v"))
    return D.overwrite_prefix(old, new, "v", ["v"], ["v"], 5).select("idx", "v")


@query("b5_discard", "SELECT count(*) AS computed, CAST(0 AS BIGINT) AS kept FROM events")
def b5(spark, d):
    """Every row is computed, as an accumulator in the plan tells, and none is kept."""
    seen = Observation("discarded")
    D.discard(t(spark, d, "events").observe(seen, F.count(F.lit(1)).alias("n")))
    return spark.range(1).select(F.lit(seen.get["n"]).cast("bigint").alias("computed"), F.lit(0).cast("bigint").alias("kept"))


@query("b6_append", "SELECT r_regionkey AS k FROM region UNION ALL SELECT n_nationkey FROM nation")
def b6(spark, d):
    path = scratch(spark)
    t(spark, d, "region").select(F.col("r_regionkey").alias("k")).write.mode("append").parquet(path)
    t(spark, d, "nation").select(F.col("n_nationkey").alias("k")).write.mode("append").parquet(path)
    return spark.read.parquet(path)


@query("b8_export_parts", "SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_partkey) - 1 AS place FROM part")
def b8(spark, d):
    from tidemark.sources.sinks import export_parts, read_in_place

    path = scratch(spark)
    export_parts(t(spark, d, "part").select("p_partkey", "p_name"), path, 4, "p_partkey")
    return read_in_place(spark, path)


@query("b9_text_lines", "SELECT concat_ws(' ', n_nationkey, n_name, n_regionkey) AS value FROM nation")
def b9(spark, d):
    from tidemark.sources.sinks import write_lines

    path = scratch(spark)
    write_lines(t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), path)
    return spark.read.text(path)


# --- C: projections and scans

def numbers(spark, d, name, column, n):
    return t(spark, d, name).select(F.col(column).cast("bigint").alias(n)), [n], n


ZIP_SQL = "{0} AS (SELECT {2}, row_number() OVER (ORDER BY {2}) - 1 AS idx FROM {1})"
SIX = [("part", "p_partkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey"), ("orders", "o_orderkey"), ("documents", "doc_id"), ("events", "event_id")]


def zip_sql(n: int) -> str:
    parts = ", ".join(ZIP_SQL.format(f"x{k}", *SIX[k]) for k in range(n))
    joins = " ".join(f"JOIN x{k} USING (idx)" for k in range(1, n))
    return f"WITH {parts} SELECT idx, CAST({' + '.join(f'{k + 1} * {SIX[k][1]}' for k in range(n))} AS BIGINT) AS value FROM x0 {joins}"


def weigh(*columns):
    out = columns[0]
    for k, c in enumerate(columns[1:], 2):
        out = out + c * k
    return out


def transform_of(n: int):
    def run(spark, d):
        return D.transform(weigh, *(numbers(spark, d, name, c, f"v{k}") for k, (name, c) in enumerate(SIX[:n])))

    return run


@query("c1_transform", "SELECT l_orderkey, CAST(l_linenumber * l_linenumber AS BIGINT) AS square FROM lineitem")
def c1(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") * F.col("l_linenumber")).cast("bigint").alias("square"))


for _n in range(2, 7):
    query(f"c{_n}_transform_{_n}", zip_sql(_n))(transform_of(_n))


@query("c7_choose", "SELECT o_custkey FROM orders")
def c7(spark, d):
    return D.choose(t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), 2)


@query("c8_for_each_fold", "SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(user_id) AS BIGINT) AS users FROM events GROUP BY event_type")
def c8(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("user_id").alias("users"))


@query("c9_mutate_range", "SELECT idx, CASE WHEN idx >= 10 AND idx < 60 THEN v * v ELSE v END AS v FROM (SELECT c_custkey AS v, row_number() OVER (ORDER BY c_custkey) - 1 AS idx FROM customer)")
def c9(spark, d):
    own = with_index(t(spark, d, "customer").select(F.col("c_custkey").alias("v")), ["v"])
    return D.mutate_range(own, "v", lambda v: v * v, 10, 60).select("idx", "v")


@query("c10_find", "SELECT coalesce(min(CASE WHEN o_custkey = 37 THEN idx END), count(*)) AS position FROM (SELECT o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx FROM orders)")
def c10(spark, d):
    return D.find(with_index(t(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"]), "o_custkey", 37)


@query("c11_filter_count", "SELECT CAST(count(*) AS BIGINT) AS dropped FROM events WHERE event_type = 'click'")
def c11(spark, d):
    return D.filtered(t(spark, d, "events"), F.col("event_type") == "click")[1]


@query("c11_filter", "SELECT event_id FROM events WHERE event_type <> 'click'")
def c11b(spark, d):
    return D.filtered(t(spark, d, "events"), F.col("event_type") == "click")[0].select("event_id")


@query("c12_cut", f"SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY {LINE_SQL} LIMIT 100")
def c12(spark, d):
    return D.cut(t(spark, d, "lineitem").select(*LINE), 100, LINE).select("l_orderkey", "l_linenumber")


@query("c13_drop_thirds", "SELECT s_suppkey, row_number() OVER (ORDER BY i) - 1 AS idx FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS i FROM supplier) WHERE i % 3 <> 0")
def c13(spark, d):
    own = with_index(t(spark, d, "supplier").select("s_suppkey"), ["s_suppkey"], "i").where("i % 3 <> 0")
    return with_index(own, ["i"]).select("s_suppkey", "idx")


@query("c15_accumulate", "SELECT o_orderkey, CAST(sum(o_custkey) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS BIGINT) AS running FROM orders")
def c15(spark, d):
    w = Window.partitionBy("o_orderpriority").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return t(spark, d, "orders").select("o_orderkey", F.sum("o_custkey").over(w).alias("running"))


# --- D: joins and inputs side by side

for _n in range(2, 7):
    def _tuple(spark, d, n=_n):
        return zip_frames(*((numbers(spark, d, name, c, c)[0], [c]) for name, c in SIX[:n]))

    query(f"d1_make_tuple_{_n}", "WITH {} SELECT idx, {} FROM x0 {}".format(", ".join(ZIP_SQL.format(f"x{k}", *SIX[k]) for k in range(_n)), ", ".join(SIX[k][1] for k in range(_n)), " ".join(f"JOIN x{k} USING (idx)" for k in range(1, _n))))(_tuple)


@query("d2_make_pairs", "SELECT idx, c_custkey + 5 AS v FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS idx FROM customer)")
def d2(spark, d):
    return with_index(t(spark, d, "customer").select("c_custkey"), ["c_custkey"]).select("idx", (F.col("c_custkey") + 5).alias("v"))


@query("d3_bulk_upsert", "WITH n AS (SELECT o_custkey AS k, arg_min(o_orderkey, o_orderkey) AS v FROM orders GROUP BY 1), o AS (SELECT c_custkey AS k, CAST(c_nationkey AS BIGINT) AS v FROM customer) SELECT coalesce(n.k, o.k) AS k, CASE WHEN n.k IS NOT NULL THEN n.v ELSE o.v END AS v FROM o FULL JOIN n ON o.k = n.k")
def d3(spark, d):
    old = t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("bigint").alias("v"))
    new = t(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"))
    return K.upsert(old, new, "k", "v")


@query("d4_shadowed_merge", "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey * 3 FROM supplier)")
def d4(spark, d):
    return K.erase(t(spark, d, "customer").select(F.col("c_custkey").alias("k")), t(spark, d, "supplier").select((F.col("s_suppkey") * 3).alias("k")), "k")


@query("d5_inverse_permutation", "SELECT row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS rank, c_custkey AS pos FROM customer")
def d5(spark, d):
    return with_index(t(spark, d, "customer").select("c_acctbal", "c_custkey"), ["c_acctbal", "c_custkey"], "rank").select("rank", F.col("c_custkey").alias("pos"))


@query("d6_shifted_join", "SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS following FROM events")
def d6(spark, d):
    return t(spark, d, "events").select("event_id", F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("following"))


@query("d7_merge_three", "SELECT k, src, row_number() OVER (ORDER BY k, src) - 1 AS idx FROM (SELECT o_orderkey AS k, CAST(o_orderkey % 3 AS INTEGER) AS src FROM orders)")
def d7(spark, d):
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    return with_index(concatenate(*(o.where(F.col("k") % 3 == m) for m in range(3))), ["k", "src"])


PROBE_SQL = "SELECT p_partkey AS id, p_retailprice AS k, (SELECT min(s_acctbal) FROM supplier WHERE s_acctbal {} p_retailprice) AS bound FROM part"


def probes(spark, d):
    return t(spark, d, "supplier").select(F.col("s_acctbal").alias("k")), t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("k"))


@query("d8_lower_bound", PROBE_SQL.format(">="))
def d8(spark, d):
    return K.bound(*probes(spark, d), "k", "id")


@query("d8_upper_bound", PROBE_SQL.format(">"))
def d8b(spark, d):
    return K.bound(*probes(spark, d), "k", "id", strict=True)


@query("d9_point_probe", "SELECT o_orderkey AS id, o_custkey AS k, c_nationkey AS v, c_custkey IS NOT NULL AS found FROM orders LEFT JOIN customer ON c_custkey = o_custkey + 3 - 3")
def d9(spark, d):
    store = t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("v"))
    return K.probe(store, t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("k")), "k", "v").select("id", "k", "v", "found")


@query("d10_merge_runs", "SELECT o_orderdate, o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS idx FROM orders")
def d10(spark, d):
    o = t(spark, d, "orders").select("o_orderdate", "o_orderkey")
    runs = [o.where(F.col("o_orderkey") % 4 == n).orderBy("o_orderdate", "o_orderkey") for n in range(4)]
    return with_index(G.merge_runs(runs, ["o_orderdate", "o_orderkey"]).drop("run"), ["o_orderdate", "o_orderkey"])


# --- E: aggregations

@query("e1_group_fold", "SELECT user_id, CAST(sum(CASE WHEN event_type <> before THEN 1 ELSE 0 END) AS BIGINT) AS changes FROM (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) GROUP BY user_id")
def e1(spark, d):
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t(spark, d, "events").select("user_id", F.when(F.col("event_type") != before, 1).otherwise(0).alias("c")).groupBy("user_id").agg(F.sum("c").alias("changes"))


@query("e2_checksum", "SELECT CAST(sum(CAST(l_orderkey AS HUGEINT) * 2654435761 + l_linenumber) % 4294967296 AS BIGINT) AS checksum, CAST(bit_xor(l_orderkey) AS BIGINT) AS mixed FROM lineitem")
def e2(spark, d):
    x = F.sum(F.col("l_orderkey").cast("decimal(38,0)") * 2654435761 + F.col("l_linenumber"))
    return t(spark, d, "lineitem").agg(S.wrap(x, 32).alias("checksum"), F.bit_xor("l_orderkey").alias("mixed"))


@query("e3_size", "SELECT count(*) AS pushed, count(*) - 100 AS remaining FROM orders")
def e3(spark, d):
    return t(spark, d, "orders").agg(F.count("*").alias("pushed"), (F.count("*") - 100).alias("remaining"))


@query("e4_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def e4(spark, d):
    return t(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@query("e5_first_of_key", "SELECT user_id, arg_min(event_id, (epoch_us(ts), event_id)) AS event_id FROM events GROUP BY user_id")
def e5(spark, d):
    return t(spark, d, "events").groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("e6_is_sorted", "SELECT coalesce(bool_and(b IS NULL OR b <= v), true) AS is_sorted FROM (SELECT o_custkey AS v, lag(o_custkey) OVER (ORDER BY o_orderkey) AS b FROM orders)")
def e6(spark, d):
    return G.is_sorted(t(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("o_custkey"), ["o_orderkey"])


COMPARE_SQL = "WITH a AS (SELECT {a} AS v, row_number() OVER (ORDER BY {a}) - 1 AS idx FROM {x}), b AS (SELECT {b} AS v, row_number() OVER (ORDER BY {b}) - 1 AS idx FROM {y}), c AS (SELECT coalesce(a.idx, b.idx) AS idx, CASE WHEN a.v IS NULL THEN -1 WHEN b.v IS NULL THEN 1 WHEN a.v < b.v THEN -1 WHEN a.v > b.v THEN 1 ELSE 0 END AS s FROM a FULL JOIN b ON a.idx = b.idx) SELECT CAST(coalesce((SELECT s FROM c WHERE s <> 0 ORDER BY idx LIMIT 1), 0) AS INTEGER) AS sign"


@query("e7_compare_vectors", COMPARE_SQL.format(a="c_custkey", x="customer", b="s_suppkey", y="supplier"))
def e7(spark, d):
    a, b = t(spark, d, "customer").select(F.col("c_custkey").alias("v")), t(spark, d, "supplier").select(F.col("s_suppkey").alias("v"))
    return G.compare(with_index(a, ["v"]), with_index(b, ["v"]), "v")


@query("e8_compare_maps", COMPARE_SQL.format(a="c_name", x="customer", b="s_name", y="supplier"))
def e8(spark, d):
    a, b = t(spark, d, "customer").select(F.col("c_name").alias("v")), t(spark, d, "supplier").select(F.col("s_name").alias("v"))
    return G.compare(with_index(a, ["v"]), with_index(b, ["v"]), "v")


@query("e9_check_runs", "SELECT CAST(o_orderkey % 4 AS INTEGER) AS run, coalesce(bool_and(b IS NULL OR b <= v), true) AS is_sorted, min_by(v, place) AS first FROM (SELECT *, lag(v) OVER (PARTITION BY o_orderkey % 4 ORDER BY place) AS b FROM (SELECT o_orderkey, o_custkey AS v, row_number() OVER (ORDER BY CASE WHEN o_orderkey % 4 = 3 THEN o_orderkey ELSE o_custkey END, o_orderkey) AS place FROM orders)) GROUP BY 1")
def e9(spark, d):
    """Three runs in the order of their values and one in that of its keys, which is found out."""
    own = t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("v"), (F.col("o_orderkey") % 4).cast("int").alias("run"))
    placed = with_index(own.withColumn("by", F.when(F.col("run") == 3, F.col("o_orderkey")).otherwise(F.col("v"))), ["by", "o_orderkey"], "place")
    return G.check_runs(placed, "run", F.col("v"), "place")


@query("e10_dot_product", "SELECT round(sum(c_acctbal * s_acctbal), 2) AS v FROM customer JOIN supplier ON c_custkey = s_suppkey")
def e10(spark, d):
    from tidemark.operators import linalg as L

    x = t(spark, d, "customer").select(F.col("c_custkey").alias("i"), F.col("c_acctbal").alias("v"))
    y = t(spark, d, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("v"))
    return L.dot(x, y).select(F.round("v", 2).alias("v"))


@query("e12_load_statistics", "SELECT CAST(count(*) AS BIGINT) AS keys, CAST(max(n) AS BIGINT) AS most, round(avg(n), 6) AS mean FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)")
def e12(spark, d):
    return t(spark, d, "events").groupBy("user_id").count().agg(F.count("*").alias("keys"), F.max("count").alias("most"), F.round(F.avg("count"), 6).alias("mean"))


@query("e13_is_heap", "WITH x AS (SELECT c_acctbal AS v, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS idx FROM customer) SELECT bool_and(p.v >= c.v) AS is_heap FROM x c JOIN x p ON p.idx = (c.idx - 1) // 2 WHERE c.idx > 0")
def e13(spark, d):
    own = with_index(t(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("v")), [F.desc("v"), "c_custkey"])
    return G.is_heap(own, "v")


# --- F: de-duplication

@query("f1_unique", "SELECT event_id, event_type FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type")
def f1(spark, d):
    e = t(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    return D.unique(e, ["event_type"], ["ts", "event_id"], ["user_id"]).select("event_id", "event_type")


@query("f1_unique_sorted", "SELECT DISTINCT o_custkey FROM orders")
def f1b(spark, d):
    return D.unique(t(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_custkey", "o_orderkey"]).select("o_custkey")


@query("f2_unique_near", """WITH RECURSIVE x AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, n, event_id, value AS head, true AS keep FROM x WHERE n = 1 UNION ALL SELECT x.user_id, x.n, x.event_id, CASE WHEN abs(x.value - r.head) < 25 THEN r.head ELSE x.value END, abs(x.value - r.head) >= 25 FROM r JOIN x ON x.user_id = r.user_id AND x.n = r.n + 1)
SELECT event_id FROM r WHERE keep""")
def f2(spark, d):
    e = t(spark, d, "events").select("user_id", "ts", "event_id", "value")
    return D.unique_by(e, lambda a, b: abs(a - b) < 25, "value", ["ts", "event_id"], ["user_id"]).select("event_id")


@query("f3_concatenate", "SELECT r_name AS name, 0 AS src FROM region UNION ALL SELECT n_name, 1 FROM nation")
def f3(spark, d):
    return concatenate(t(spark, d, "region").select(F.col("r_name").alias("name")), t(spark, d, "nation").select(F.col("n_name").alias("name")))


@query("f4_insert_if_absent", "WITH s AS (SELECT c_custkey AS k, CAST(c_nationkey AS BIGINT) AS v FROM customer WHERE c_custkey % 2 = 0), n AS (SELECT o_custkey AS k, min(o_orderkey) AS v FROM orders GROUP BY 1) SELECT * FROM s UNION ALL SELECT * FROM n WHERE k NOT IN (SELECT k FROM s)")
def f4(spark, d):
    store = t(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("bigint").alias("v"))
    new = t(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"))
    return K.insert_if_absent(store, new, "k", "v")
