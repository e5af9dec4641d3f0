"""Sorts, merges, top-k, replayed queues, window-like operators and scalar functions (ids G to I)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.catalog.flow import LINE
from tidemark.functions import scalars as S
from tidemark.operators import keyed as K
from tidemark.operators import replay as P
from tidemark.operators import sorting as G
from tidemark.operators.ordering import concatenate, physical_index, with_index
from tidemark.session import table as t
from tidemark.sources import readers as R

# --- G: sorts, merges, top-k

@query("g1_sort", f"SELECT {', '.join(LINE)} FROM lineitem")
def g1(spark, d):
    return G.sort(t(spark, d, "lineitem").select(*LINE), LINE)


@query("g2_key_sort", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey % 1000, o_orderkey) - 1 AS idx FROM orders")
def g2(spark, d):
    own = t(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 1000).alias("key"))
    return with_index(own, ["key", "o_orderkey"]).select("o_orderkey", "idx")


@query("g4_stable_sort", "SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey % 10, o_orderdate, o_orderkey) - 1 AS idx FROM orders")
def g4(spark, d):
    own = with_index(t(spark, d, "orders").select("o_orderkey", "o_orderdate", (F.col("o_custkey") % 10).alias("key")), ["o_orderdate", "o_orderkey"], "before")
    return with_index(own, ["key", "before"]).select("o_orderkey", "idx")


@query("g5_pipelined_sort", "SELECT k, row_number() OVER (ORDER BY k) - 1 AS idx FROM (SELECT event_id * 7919 % 1000003 AS k FROM events)")
def g5(spark, d):
    return with_index(t(spark, d, "events").select((F.col("event_id") * 7919 % 1000003).alias("k")), ["k"])


@query("g6_runs", "SELECT o_orderdate, o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS place FROM orders")
def g6(spark, d):
    """Runs of consecutive ranges: one after another they are the sorted whole."""
    return physical_index(G.sorted_runs(t(spark, d, "orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"], 8).drop("run"))


@query("g7_pushed_runs", "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS idx FROM customer")
def g7(spark, d):
    own = t(spark, d, "customer").select("c_acctbal", "c_custkey")
    sorter = G.Sorter(spark, own.schema, ["c_acctbal", "c_custkey"])
    for m in range(3):
        sorter.push(own.where(F.col("c_custkey") % 3 == m))
    sorter.sort()
    return with_index(sorter.rows(), ["c_acctbal", "c_custkey"]).select("c_custkey", "idx")


@query("g8_presorted_runs", "SELECT k, run, row_number() OVER (ORDER BY k, run) - 1 AS idx FROM (SELECT s_suppkey AS k, 0 AS run FROM supplier UNION ALL SELECT c_custkey, 1 FROM customer)")
def g8(spark, d):
    runs = [t(spark, d, "supplier").select(F.col("s_suppkey").alias("k")), t(spark, d, "customer").select(F.col("c_custkey").alias("k"))]
    return with_index(G.merge_runs(runs, ["k"]), ["k", "run"])


@query("g10_sorter", "SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 20")
def g10(spark, d):
    own = t(spark, d, "customer").select("c_acctbal", "c_custkey")
    sorter = G.Sorter(spark, own.schema, ["c_acctbal", "c_custkey"])
    sorter.push(own)
    sorter.sort()
    sorter.next(10)
    sorter.rewind()
    return sorter.next(20).select("c_custkey")


COMPARATORS = {"first": "a", "first_down": "a DESC", "first_second": "a, b", "second": "b", "second_first": "b, a"}


@query("g12_comparators", "SELECT b, {} FROM (SELECT n_regionkey AS a, n_nationkey AS b FROM nation)".format(", ".join(f"rank() OVER (ORDER BY {o}) AS {n}" for n, o in COMPARATORS.items())))
def g12(spark, d):
    own = t(spark, d, "nation").select(F.col("n_regionkey").alias("a"), F.col("n_nationkey").alias("b"))
    return own.select("b", *(F.expr(f"CAST(rank() OVER (ORDER BY {o}) AS BIGINT)").alias(n) for n, o in COMPARATORS.items()))


@query("g13_computed_order", "SELECT CAST(range AS BIGINT) AS v, row_number() OVER (ORDER BY range % 10, range) - 1 AS idx FROM range(1, 1001)")
def g13(spark, d):
    return with_index(R.counter(spark, 1000, 1).withColumn("m", F.col("v") % 10), ["m", "v"]).select("v", "idx")


@query("g15_multiway_merge", "SELECT k, run, row_number() OVER (ORDER BY k, run, o_orderkey) - 1 AS place, o_orderkey FROM (SELECT o_custkey AS k, CAST(o_orderkey % 5 AS INTEGER) AS run, o_orderkey FROM orders)")
def g15(spark, d):
    o = t(spark, d, "orders")
    own = [o.where(F.col("o_orderkey") % 5 == n).select(F.col("o_custkey").alias("k"), "o_orderkey") for n in range(5)]
    merged = physical_index(G.merge_runs(own, ["k"]))
    # Within a run equal keys may come in any order: they are put in that of their keys.
    w = Window.partitionBy("k", "run")
    least = merged.withColumn("first", F.min("place").over(w)).withColumn("n", F.count("*").over(w)).withColumn("last", F.max("place").over(w))
    whole = least.where(F.col("last") - F.col("first") + 1 == F.col("n"))
    return whole.select("k", "run", "o_orderkey", (F.col("first") + F.row_number().over(w.orderBy("o_orderkey")) - 1).alias("place"))


@query("g17_random_shuffle", """WITH x AS (SELECT c_custkey AS v, row_number() OVER (ORDER BY c_custkey) - 1 AS idx FROM customer)
SELECT CASE WHEN idx >= 10 AND idx < 90 THEN -1 ELSE idx END AS place, CAST(sum(v) AS BIGINT) AS total, count(*) AS n, count(*) AS places, idx >= 10 AND idx < 90 AS moved, true AS again FROM x GROUP BY 1, 5""")
def g17(spark, d):
    """Inside the range most rows move and all places are taken, outside none does; the same seed gives the same order."""
    own = t(spark, d, "customer").select(F.col("c_custkey").alias("v"))
    first, second, other = (G.random_shuffle(own, ["v"], seed, 10, 90).select("v", F.col("idx").alias(n)) for n, seed in (("idx", 7), ("same", 7), ("other", 8)))
    both = with_index(own, ["v"], "was").join(first, "v").join(second, "v").join(other, "v")
    inside = (F.col("idx") >= 10) & (F.col("idx") < 90)
    place = F.when(inside, -1).otherwise(F.col("idx")).alias("place")
    moved = (F.count_if((F.col("idx") != F.col("was")) & (F.col("idx") != F.col("other"))) * 2 > F.count("*")).alias("moved")
    return both.groupBy(place).agg(F.sum("v").alias("total"), F.count("*").alias("n"), F.countDistinct("idx").alias("places"), moved, F.every(F.col("idx") == F.col("same")).alias("again"))


@query("g19_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def g19(spark, d):
    return G.top_k(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), 50, [F.desc("o_totalprice"), "o_orderkey"])


@query("g22_bulk_push", "SELECT v FROM (SELECT c_acctbal AS v FROM customer UNION ALL SELECT s_acctbal FROM supplier) ORDER BY v DESC LIMIT 30")
def g22(spark, d):
    every = concatenate(t(spark, d, "customer").select(F.col("c_acctbal").alias("v")), t(spark, d, "supplier").select(F.col("s_acctbal").alias("v")))
    return G.top_k(every.select("v"), 30, [F.desc("v")])


@query("g23_bulk_pop_rest", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 40)")
def g23(spark, d):
    own = t(spark, d, "customer").select("c_custkey", "c_acctbal")
    return K.erase(own, G.top_k(own, 40, [F.desc("c_acctbal"), "c_custkey"]), "c_custkey").select("c_custkey")


@query("g24_pop_limit", "SELECT c_custkey FROM customer WHERE c_acctbal < 500 ORDER BY c_acctbal, c_custkey LIMIT 25")
def g24(spark, d):
    return G.pop_limit(t(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 500.0, 25, ["c_acctbal", "c_custkey"])[0].select("c_custkey")


@query("g24_complete", "SELECT count(*) <= 25 AS complete FROM customer WHERE c_acctbal < 500")
def g24b(spark, d):
    return G.pop_limit(t(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 500.0, 25, ["c_acctbal", "c_custkey"])[1]


@query("g25_limit_session", """WITH q AS (SELECT c_custkey AS k, c_acctbal AS v, CAST(0 AS BIGINT) AS step FROM customer), p AS (SELECT s_suppkey + 1000000 AS k, s_acctbal AS v, row_number() OVER (ORDER BY s_suppkey) AS step FROM supplier)
SELECT k, step, v < 1000 AS popped FROM (SELECT * FROM q UNION ALL SELECT * FROM p) WHERE v < 1000 UNION ALL SELECT k, NULL, false FROM (SELECT * FROM q UNION ALL SELECT * FROM p) WHERE v >= 1000""")
def g25(spark, d):
    """A session that pops all below a limit while rows are pushed: those pushed below it are popped in it too."""
    queue = t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    pushes = t(spark, d, "supplier").select((F.col("s_suppkey") + 1000000).alias("k"), F.col("s_acctbal").alias("v"), F.col("s_suppkey").alias("seq"))
    popped, left = G.limit_session(queue, pushes, "v", "seq", 1000)
    return popped.select("k", "step", F.lit(True).alias("popped")).unionByName(left.select("k", F.lit(None).cast("bigint").alias("step"), F.lit(False).alias("popped")))


def traffic(spark, d, ops: list[str]):
    """The events of each user as a log: the op is picked by event_id."""
    op = F.element_at(F.array(*map(F.lit, ops)), (F.col("event_id") % len(ops) + 1).cast("int"))
    return t(spark, d, "events").select(F.col("user_id").alias("grp"), F.col("event_id").alias("seq"), op.alias("op"), F.col("event_id").cast("double").alias("v"))


def traffic_sql(ops: list[str]) -> str:
    listed = ", ".join(f"'{o}'" for o in ops)
    return f"SELECT user_id AS grp, event_id AS seq, [{listed}][event_id % {len(ops)} + 1] AS op, CAST({{v}} AS DOUBLE) AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events"


def machine_sql(ops: list[str], change: str, answer: str, v: str = "event_id") -> str:
    """The log read step by step, its content in the list h; change and answer see h, x.op and x.v."""
    return f"""WITH RECURSIVE x AS ({traffic_sql(ops).format(v=v)}),
r AS (SELECT grp, CAST(0 AS BIGINT) AS n, CAST([] AS DOUBLE[]) AS h, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS op, CAST(NULL AS DOUBLE) AS a FROM (SELECT DISTINCT grp FROM x)
UNION ALL SELECT r.grp, x.n, {change}, x.seq, x.op, {answer} FROM r JOIN x ON x.grp = r.grp AND x.n = r.n + 1)
SELECT grp, seq, a AS v FROM r WHERE op LIKE 'pop%'"""


MIXED = ["push", "push", "pop", "push", "pop", "pop", "push"]


@query("g28_priority_replay", machine_sql(MIXED, "CASE x.op WHEN 'push' THEN list_sort(list_append(h, x.v)) ELSE h[:len(h) - 1] END", "CASE WHEN x.op = 'pop' AND len(h) > 0 THEN h[len(h)] END", "event_id * 7919 % 10007"))
def g28(spark, d):
    return P.priority_queue_pops(traffic(spark, d, MIXED).withColumn("v", (F.col("seq") * 7919 % 10007).cast("double")))


@query("g29_top_per_key", "SELECT o_custkey, o_orderkey, place FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 3")
def g29(spark, d):
    best = G.top_k_per(t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), 3, ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"])
    return best.select("o_custkey", "o_orderkey", F.col("place").cast("bigint").alias("place"))


def queue_log(spark, d):
    return t(spark, d, "events").select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, "del").otherwise("ins").alias("op"), F.col("user_id").alias("k"), (F.col("event_id") * 31 % 101).alias("v"))


QUEUE_SQL = "SELECT user_id AS k, max(event_id) AS seq, arg_max(event_id % 3 = 0, event_id) AS gone, arg_max(event_id * 31 % 101, event_id) AS v FROM events GROUP BY 1"


@query("g30_addressable_fifo", f"SELECT k, row_number() OVER (ORDER BY seq) AS place FROM ({QUEUE_SQL}) WHERE NOT gone")
def g30(spark, d):
    return P.addressable_fifo(queue_log(spark, d))


@query("g31_addressable_priority", f"SELECT k, v, row_number() OVER (ORDER BY v, k) AS place FROM ({QUEUE_SQL}) WHERE NOT gone")
def g31(spark, d):
    return P.addressable_priority(queue_log(spark, d))


# --- H: window-like operators

@query("h1_row_number", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events")
def h1(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t(spark, d, "events").select("event_id", (F.row_number().over(w) - 1).cast("bigint").alias("n"))


@query("h2_naming", "SELECT l_orderkey, l_linenumber, l_partkey, dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_returnflag, l_linestatus, l_linenumber) - 1 AS name FROM lineitem")
def h2(spark, d):
    w = Window.partitionBy("l_suppkey").orderBy("l_returnflag", "l_linestatus", "l_linenumber")
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.dense_rank().over(w) - 1).cast("bigint").alias("name"))


@query("h2_names_unique", "SELECT l_suppkey, count(DISTINCT (l_returnflag, l_linestatus, l_linenumber)) = count(*) AS names_unique FROM lineitem GROUP BY 1")
def h2b(spark, d):
    named = t(spark, d, "lineitem").select("l_suppkey", F.dense_rank().over(Window.partitionBy("l_suppkey").orderBy("l_returnflag", "l_linestatus", "l_linenumber")).alias("name"))
    return named.groupBy("l_suppkey").agg((F.max("name") == F.count("*")).alias("names_unique"))


@query("h3_lag_pairs", "SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events")
def h3(spark, d):
    return t(spark, d, "events").select("event_id", F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("before"))


@query("h4_lead", "SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS following FROM orders")
def h4(spark, d):
    return t(spark, d, "orders").select("o_orderkey", F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("following"))


@query("h5_triples", "SELECT o_orderkey, lead(o_orderkey, 1, 0) OVER w AS second, lead(o_orderkey, 2, 0) OVER w AS third FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def h5(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return t(spark, d, "orders").select("o_orderkey", F.lead("o_orderkey", 1, 0).over(w).alias("second"), F.lead("o_orderkey", 2, 0).over(w).alias("third"))


@query("h6_adjacent_check", "SELECT user_id, bool_and(b IS NULL OR b < value) AS is_sorted FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) GROUP BY 1")
def h6(spark, d):
    own = t(spark, d, "events").withColumn("b", F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return own.groupBy("user_id").agg(F.every(F.col("b").isNull() | (F.col("b") < F.col("value"))).alias("is_sorted"))


@query("h7_islands", "SELECT user_id, island, event_type, count(*) AS n FROM (SELECT *, CAST(sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS island FROM (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS c FROM events)) GROUP BY 1, 2, 3")
def h7(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    own = t(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    own = own.withColumn("c", F.when(F.col("event_type") == F.lag("event_type").over(w), 0).otherwise(1)).withColumn("island", F.sum("c").over(w))
    return own.groupBy("user_id", "island", "event_type").agg(F.count("*").alias("n"))


# --- I: scalar functions

@query("i1_split", "SELECT p_partkey, string_split(p_name, ' ')[1] AS head, CAST(len(string_split(p_name, ' ')) AS BIGINT) AS n FROM part")
def i1(spark, d):
    words = F.split("p_name", " ")
    return t(spark, d, "part").select("p_partkey", words[0].alias("head"), F.size(words).cast("bigint").alias("n"))


@query("i2_text_and_back", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS s, o_orderkey AS back FROM orders")
def i2(spark, d):
    return t(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("s")).withColumn("back", F.col("s").cast("bigint"))


@query("i3_parse_size", "SELECT * FROM (VALUES ('7', 7), ('5k', 5000), ('10 GiB', 10737418240), ('3MB', 3000000), ('2 Ti', 2199023255552), ('x', NULL)) AS x(s, size)")
def i3(spark, d):
    rows = R.from_rows(spark, [(s,) for s in ("7", "5k", "10 GiB", "3MB", "2 Ti", "x")], "s string")
    return rows.withColumn("size", S.parse_size(F.col("s")))


@query("i4_format_size", "SELECT * FROM (VALUES (CAST(999 AS BIGINT), '999.000 ', '999.000 '), (CAST(1500 AS BIGINT), '1.500 k', '1.465 Ki'), (CAST(1048576 AS BIGINT), '1.049 M', '1.000 Mi')) AS x(size, si, iec)")
def i4(spark, d):
    rows = R.from_rows(spark, [(999,), (1500,), (1048576,)], "size bigint")
    return rows.withColumn("si", S.format_si(F.col("size"))).withColumn("iec", S.format_iec(F.col("size")))


@query("i6_div_ceil", "SELECT p_partkey, CAST((p_partkey + 6) // 7 AS BIGINT) AS parts, greatest(CAST(p_size AS BIGINT), p_partkey) AS most FROM part")
def i6(spark, d):
    return t(spark, d, "part").select("p_partkey", S.div_ceil(F.col("p_partkey"), F.lit(7)).alias("parts"), F.greatest(F.col("p_size").cast("bigint"), "p_partkey").alias("most"))


@query("i7_log2", "SELECT p_partkey, CAST(len(bin(p_partkey)) - 1 AS INTEGER) AS down, CAST(CASE WHEN p_partkey <= 1 THEN 0 ELSE len(bin(p_partkey - 1)) END AS INTEGER) AS up FROM part WHERE p_partkey > 0")
def i7(spark, d):
    return t(spark, d, "part").where("p_partkey > 0").select("p_partkey", S.ilog2_floor(F.col("p_partkey")).alias("down"), S.ilog2_ceil(F.col("p_partkey")).alias("up"))


@query("i9_power_of_two", "SELECT p_partkey, CASE WHEN p_partkey <= 1 THEN CAST(1 AS BIGINT) ELSE CAST(1 AS BIGINT) << len(bin(p_partkey - 1)) END AS v FROM part")
def i9(spark, d):
    return t(spark, d, "part").select("p_partkey", S.round_up_to_power_of_two(F.col("p_partkey")).alias("v"))


@query("i10_varint", "SELECT o_orderkey, o_orderkey * 1000 AS back, CAST((len(bin(o_orderkey * 1000)) + 6) // 7 AS INTEGER) AS bytes FROM orders WHERE o_orderkey > 0")
def i10(spark, d):
    own = t(spark, d, "orders").where("o_orderkey > 0").select("o_orderkey", S.varint(F.col("o_orderkey") * 1000).alias("code"))
    return own.select("o_orderkey", S.from_varint(F.col("code")).alias("back"), F.length("code").alias("bytes"))


@query("i11_wrap_40_bits", "SELECT o_orderkey, CAST((CAST(o_orderkey AS HUGEINT) * 1099511627 - 5000000000) & 1099511627775 AS BIGINT) AS v FROM orders")
def i11(spark, d):
    return t(spark, d, "orders").select("o_orderkey", S.wrap(F.col("o_orderkey").cast("decimal(38,0)") * 1099511627 - 5000000000, 40).alias("v"))


@query("i12_multiplicative_hash", "SELECT o_orderkey, CAST(CAST(o_orderkey AS HUGEINT) * 2654435761 % 4294967296 AS BIGINT) AS h FROM orders")
def i12(spark, d):
    return t(spark, d, "orders").select("o_orderkey", S.multiplicative_hash(F.col("o_orderkey")).alias("h"))


@query("i13_bucket", "SELECT o_orderkey, CAST(CAST(o_orderkey AS HUGEINT) * 2654435761 % 4294967296 * 64 // 4294967296 AS BIGINT) AS bucket FROM orders")
def i13(spark, d):
    return t(spark, d, "orders").select("o_orderkey", K.bucket(S.multiplicative_hash(F.col("o_orderkey")), 64, (1 << 32) - 1).alias("bucket"))


@query("i14_functors", "SELECT s_suppkey AS same, s_suppkey * s_suppkey AS square, 555 AS filled FROM supplier")
def i14(spark, d):
    return t(spark, d, "supplier").select(F.col("s_suppkey").alias("same"), (F.col("s_suppkey") * F.col("s_suppkey")).alias("square"), F.lit(555).alias("filled"))


@query("i15_permuted_index", "SELECT CAST(range AS BIGINT) AS pos, CAST((range % 20) * 50 + range // 20 AS BIGINT) AS at FROM range(1000)")
def i15(spark, d):
    return R.counter(spark, 1000).select(F.col("v").alias("pos"), S.permuted_index(F.col("v"), 50, 20).alias("at"))


@query("i16_bit_count", "SELECT o_orderkey, CAST(bit_count(o_orderkey) AS INTEGER) AS ones FROM orders")
def i16(spark, d):
    return t(spark, d, "orders").select("o_orderkey", F.bit_count("o_orderkey").alias("ones"))
