"""Roll-ups by category, domain, group and pair."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalframe.operators import rollup
from evalframe.plans.base import query


def ok():
    """1 for a correct row."""
    return F.when(F.col("l_quantity") > 25, 1.0).otherwise(0.0)


@query("select round(avg(m), 6) score from (select k, avg(m) m from (select n.n_regionkey k, c.c_nationkey, avg(case when c_acctbal > 4000 then 1.0 else 0 end) m from customer c join nation n on c.c_nationkey = n.n_nationkey group by 1, 2) group by 1)")
def a27_domain_macro(t):
    rows = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return rollup.macro(rows, ["n_regionkey", "n_nationkey"], F.when(F.col("c_acctbal") > 4000, 1.0).otherwise(0.0)).select(F.round("score", 6).alias("score"))


@query("select round(avg(coalesce(m, 0)), 6) score from nation left join (select s_nationkey, avg(s_acctbal) m from supplier group by 1) on s_nationkey = n_nationkey")
def a25_fixed_keys(t):
    keys = t.nation.select(F.col("n_nationkey").alias("s_nationkey"))
    return rollup.macro_fixed(t.supplier, "s_nationkey", F.col("s_acctbal"), keys).select(F.round("score", 6).alias("score"))


@query("select round(avg(m), 6) score from (select case when k like '%A%' then 'merged' else k end g, avg(m) m from (select event_type k, avg(value) m from events group by 1) group by 1)")
def a26_merged_keys(t):
    by = t.events.groupBy(F.col("event_type").alias("k")).agg(F.avg("value").alias("m"))
    merged = by.groupBy(F.when(F.contains("k", F.lit("A")), "merged").otherwise(F.col("k")).alias("g")).agg(F.avg("m").alias("m"))
    return merged.agg(F.round(F.avg("m"), 6).alias("score"))


@query("select r_name region, n_name nation, c_mktsegment segment, count(*) n, sum(case when c_acctbal > 0 then 1 else 0 end) hits from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, n_name, c_mktsegment)")
def a28_nested_rollup(t):
    rows = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.rollup(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("c_acctbal") > 0, 1).otherwise(0)).alias("hits"))


@query("select l_returnflag a, l_linestatus b, l_linenumber c, count(*) n, round(avg(case when l_quantity > 25 then 1.0 else 0 end), 6) accuracy from lineitem group by cube (l_returnflag, l_linestatus, l_linenumber)")
def a30_cube_cells(t):
    return t.lineitem.cube(F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b"), F.col("l_linenumber").alias("c")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(ok()), 6).alias("accuracy"))


@query("with l as (select 'flag' dim, l_returnflag v, l_quantity q from lineitem union all select 'status', l_linestatus, l_quantity from lineitem union all select 'all', 'all', l_quantity from lineitem) select dim, v, count(*) n, round(avg(case when q > 25 then 1.0 else 0 end), 6) accuracy from l group by 1, 2")
def a31_independent_breakdowns(t):
    rows = t.lineitem.selectExpr("l_quantity", "stack(3, 'flag', l_returnflag, 'status', l_linestatus, 'all', 'all') as (dim, v)")
    return rows.groupBy("dim", "v").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(ok()), 6).alias("accuracy"))


@query("select case when p_size < 10 then 'small' when p_size < 30 then 'middle' else 'large' end band, count(*) n, round(avg(p_retailprice), 6) price from part group by 1")
def a32_derived_bands(t):
    band = F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "middle").otherwise("large")
    return t.part.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p_retailprice"), 6).alias("price"))


@query("select w label, count(*) n, round(avg(p_retailprice), 6) score from (select p_retailprice, unnest(list_distinct(string_split(p_type, ' '))) w from part) group by 1")
def a33_multi_label(t):
    rows = t.part.select("p_retailprice", F.explode(F.array_distinct(F.split("p_type", " "))).alias("label"))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p_retailprice"), 6).alias("score"))


@query("with g as (select l_orderkey, min(case when l_quantity > 25 then 1 else 0 end) lo, max(case when l_quantity > 25 then 1 else 0 end) hi, avg(case when l_quantity > 25 then 1.0 else 0 end) m from lineitem group by 1) select case when lo = 1 then 'correct' when hi = 0 then 'wrong' else 'inconsistent' end state, count(*) n, round(avg(m), 6) soft from g group by 1")
def a36_tri_state(t):
    g = t.lineitem.groupBy("l_orderkey").agg(F.min(ok()).alias("lo"), F.max(ok()).alias("hi"), F.avg(ok()).alias("m"))
    state = F.when(F.col("lo") == 1, "correct").when(F.col("hi") == 0, "wrong").otherwise("inconsistent")
    return g.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("m"), 6).alias("soft"))


@query("select round(count(*) filter (s = 3) / (sum(n) / 3.0), 6) consistent from (select l_orderkey, sum(case when l_quantity > 25 then 1 else 0 end) s, count(*) n from lineitem group by 1)")
def a37_sum_of_three(t):
    g = t.lineitem.groupBy("l_orderkey").agg(F.sum(ok()).alias("s"), F.count(F.lit(1)).alias("n"))
    return g.agg(F.round(F.count_if(F.col("s") == 3) / (F.sum("n") / 3.0), 6).alias("consistent"))


@query("with q as (select l_returnflag c, l_orderkey, avg(case when l_quantity > 25 then 1.0 else 0 end) acc, min(case when l_quantity > 25 then 1.0 else 0 end) every from lineitem group by 1, 2 having count(*) = 2) select c, round(100 * avg(acc) + 100 * avg(every), 6) score from q group by 1")
def a38_pair_accuracy(t):
    q = t.lineitem.groupBy(F.col("l_returnflag").alias("c"), "l_orderkey").agg(F.avg(ok()).alias("acc"), F.min(ok()).alias("both"), F.count(F.lit(1)).alias("n")).where("n = 2")
    return q.groupBy("c").agg(F.round(100 * F.avg("acc") + 100 * F.avg("both"), 6).alias("score"))


@query("with q as (select l_orderkey, max(case when l_linenumber = 1 then l_quantity > 25 end) a, max(case when l_linenumber = 2 then l_quantity > 25 end) b, max(case when l_linenumber = 3 then l_quantity > 25 end) c, max(case when l_linenumber = 4 then l_quantity > 25 end) d from lineitem where l_linenumber <= 4 group by 1 having count(*) = 4) select round(avg(cast(a and not b as int) + cast(d and not c as int)) / 2, 6) question, round(avg(cast(a and not c as int) + cast(d and not b as int)) / 2, 6) image, round(avg(cast(a as int) + cast(not b as int) + cast(not c as int) + cast(d as int)) / 4, 6) as binary, round(avg(cast(a and not b and not c and d as int)), 6) as grouped from q")
def a39_quads(t):
    cell = lambda k: F.max(F.when(F.col("l_linenumber") == k, F.col("l_quantity") > 25)).alias("abcd"[k - 1])
    q = t.lineitem.where("l_linenumber <= 4").groupBy("l_orderkey").agg(*[cell(k) for k in (1, 2, 3, 4)], F.count(F.lit(1)).alias("n")).where("n = 4")
    mean = lambda parts, d: F.round(F.avg(F.expr(" + ".join(f"cast({p} as int)" for p in parts))) / d, 6)
    return q.agg(mean(["(a and not b)", "(d and not c)"], 2).alias("question"), mean(["(a and not c)", "(d and not b)"], 2).alias("image"), mean(["a", "(not b)", "(not c)", "d"], 4).alias("binary"), mean(["(a and not b and not c and d)"], 1).alias("grouped"))


@query("with c as (select count(*) n, count(*) filter (o_orderstatus = 'F') f, count(*) filter (o_orderstatus = 'O') o from orders) select round(f * 1.0 / n, 6) correction, round((f + o) * 1.0 / n, 6) detection, round(f * 1.0 / nullif(f + o, 0), 6) share from c")
def a43_outcome_shares(t):
    f, o, n = F.count_if(F.col("o_orderstatus") == "F"), F.count_if(F.col("o_orderstatus") == "O"), F.count(F.lit(1))
    return t.orders.agg(F.round(f / n, 6).alias("correction"), F.round((f + o) / n, 6).alias("detection"), F.round(f / F.nullif(f + o, F.lit(0)), 6).alias("share"))


@query("select event_type, round(sum(case when value > 5 then 1.0 else 0 end) / count(*) filter (value > 1), 6) answered from events group by 1")
def a44_answered_rows(t):
    return t.events.groupBy("event_type").agg(F.round(F.sum(F.when(F.col("value") > 5, 1.0).otherwise(0.0)) / F.count_if(F.col("value") > 1), 6).alias("answered"))


@query("select o_orderstatus s, round(avg(o_totalprice) / (select avg(o_totalprice) from orders) * 100, 1) relative from orders group by 1")
def a46_relative_score(t):
    base = t.orders.agg(F.avg("o_totalprice").alias("base"))
    return t.orders.groupBy(F.col("o_orderstatus").alias("s")).agg(F.avg("o_totalprice").alias("m")).join(F.broadcast(base)).select("s", F.round(F.col("m") / F.col("base") * 100, 1).alias("relative"))


@query("select event_type, round(avg(case when value >= 3 then 1.0 else 0 end), 6) share, round(avg(value) * 20, 6) scaled from events group by 1")
def a47_rates(t):
    return t.events.groupBy("event_type").agg(F.round(F.avg(F.when(F.col("value") >= 3, 1.0).otherwise(0.0)), 6).alias("share"), F.round(F.avg("value") * 20, 6).alias("scaled"))


@query("select coalesce(event_type, 'total') subtask, count(value) n, round(avg(value) / 10, 6) score from (select event_type, case when event_id % 17 = 0 then null else value end as value from events) group by rollup (event_type)")
def a65_live_score(t):
    rows = t.events.select("event_type", F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("value"))
    return rows.rollup("event_type").agg(F.count("value").alias("n"), F.round(F.avg("value") / 10, 6).alias("score")).select(F.coalesce("event_type", F.lit("total")).alias("subtask"), "n", "score")


@query("select k, round(a, 6) accuracy, round(a - b, 6) gain from (select event_type k, avg(value) a from events group by 1) join (select event_type k, avg(case when event_id % 2 = 0 then value else 0 end) b from events group by 1) using (k)")
def j16_baseline_gain(t):
    acc = t.events.groupBy(F.col("event_type").alias("k")).agg(F.avg("value").alias("a"), F.avg(F.when(F.col("event_id") % 2 == 0, F.col("value")).otherwise(0)).alias("b"))
    return acc.select("k", F.round("a", 6).alias("accuracy"), F.round(F.col("a") - F.col("b"), 6).alias("gain"))


@query("with s as (select o_orderpriority p, o_orderstatus m, avg(o_totalprice) v from orders group by 1, 2) select p, round(max(v) filter (m = 'F'), 4) f, round(max(v) filter (m = 'O'), 4) o, round(max(v) filter (m = 'F') - max(v) filter (m = 'O'), 4) delta from s group by 1")
def j17_run_comparison(t):
    wide = t.orders.groupBy(F.col("o_orderpriority").alias("p")).pivot("o_orderstatus", ["F", "O"]).agg(F.avg("o_totalprice"))
    return wide.select("p", F.round("F", 4).alias("f"), F.round("O", 4).alias("o"), F.round(F.col("F") - F.col("O"), 4).alias("delta"))


@query("with r as (select event_type k, date_trunc('day', ts) d, avg(value) v from events group by 1, 2) select k, d as run, round(v, 6) as value from r where d = (select max(d) from r x where x.k = r.k)")
def s19_latest_run(t):
    from evalframe.sources.io import latest_runs

    runs = t.events.groupBy(F.col("event_type").alias("k"), F.date_trunc("day", "ts").alias("run")).agg(F.round(F.avg("value"), 6).alias("value"))
    return latest_runs(runs, ["k"], "run").select("k", "run", "value")


@query("select l_orderkey as task, list({'n': l_linenumber, 'q': l_quantity} order by l_linenumber, l_quantity)[1].q first_q, count(*) n from lineitem group by 1")
def s16_nested_submission(t):
    from evalframe.sources.io import nested_submission

    rows = t.lineitem.select(F.col("l_orderkey").alias("task"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("q"))
    return nested_submission(rows, "task", ["n", "q"], "n").select("task", F.col("samples")[0]["q"].alias("first_q"), F.size("samples").cast("long").alias("n"))


@query("select k || ',' || m as key, v from (select event_type k, unnest(['mean', 'max']) m, unnest([round(avg(value), 6), max(value)]) v from events group by 1)")
def f46_long_results(t):
    wide = t.events.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("max"))
    return wide.unpivot("event_type", ["mean", "max"], "m", "v").select(F.concat_ws(",", "event_type", "m").alias("key"), "v")
