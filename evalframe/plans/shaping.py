"""Row shaping, look-ups, ranked selection and unions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evalframe.functions import text as T
from evalframe.operators import curate, rollup
from evalframe.plans.base import query


@query("select p_brand, count(*) filter (p_size % 7 <> 0) kept, count(*) filter (p_size % 7 = 0) dropped from part group by 1")
def p05_drop_and_count(t):
    zero = F.col("p_size") % 7 == 0
    return t.part.groupBy("p_brand").agg(F.count_if(~zero).alias("kept"), F.count_if(zero).alias("dropped"))


@query("select count(*) filter (n_nationkey is not null) known, count(*) filter (n_nationkey is null) as unknown from supplier left join (select n_nationkey from nation where n_regionkey < 2) on s_nationkey = n_nationkey")
def p07_unknown_tags(t):
    tag = F.col("n_nationkey")
    rows = t.supplier.join(t.nation.where("n_regionkey < 2").select("n_nationkey"), F.col("s_nationkey") == tag, "left")
    return rows.agg(F.count_if(tag.isNotNull()).alias("known"), F.count_if(tag.isNull()).alias("unknown"))


@query("select event_type, count(*) filter (value > 5) over_5, count(*) filter (value > 6) over_6, count(*) filter (value >= 8) from_8 from events group by 1")
def p10_score_thresholds(t):
    v = F.col("value")
    return t.events.groupBy("event_type").agg(F.count_if(v > 5).alias("over_5"), F.count_if(v > 6).alias("over_6"), F.count_if(v >= 8).alias("from_8"))


@query("select c_custkey, c_name from customer where c_custkey < (select ceil(count(*) * 0.1) from customer)")
def p13_limit_by_fraction(t):
    most = t.customer.agg(F.ceil(F.count(F.lit(1)) * 0.1).alias("most"))
    return t.customer.join(F.broadcast(most), F.col("c_custkey") < F.col("most")).select("c_custkey", "c_name")


@query("select doc_id, lang, source, n_chars from documents")
def p17_without_payload_columns(t):
    return t.documents.drop(*[c for c in t.documents.columns if "text" in c])


@query("select 'ds-' || c_custkey id, coalesce(n_name, 'none') as mode, replace(c_name, 'Customer', 'Client') prompt from customer left join nation on c_nationkey = n_nationkey")
def p21_training_view(t):
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.select(F.concat(F.lit("ds-"), "c_custkey").alias("id"), F.coalesce("n_name", F.lit("none")).alias("mode"), F.replace("c_name", F.lit("Customer"), F.lit("Client")).alias("prompt"))


@query("select conv_id, turn, case when contains(text, ' done.') then text else text || ' done.' end as text from conversations")
def p22_suffix_once(t):
    return t.conversations.select("conv_id", "turn", T.add_suffix_once(F.col("text"), " done.").alias("text"))


@query("select event_id, coalesce(try_cast(json_extract_string(props, '$.k') as double), 0) score from events")
def p23_score_or_zero(t):
    return t.events.select("event_id", F.coalesce(F.get_json_object("props", "$.k").try_cast("double"), F.lit(0.0)).alias("score"))


@query("select conv_id, turn, upper(role[1]) || lower(role[2:]) || ': ' || regexp_replace(text, '[ \\t\\n]+', ' ', 'g') ending from conversations")
def p25_clean_endings(t):
    role = F.concat(F.upper(F.substring("role", 1, 1)), F.lower(F.substr("role", F.lit(2))))
    return t.conversations.select("conv_id", "turn", F.concat(role, F.lit(": "), F.regexp_replace("text", r"[ \t\n]+", " ")).alias("ending"))


@query("select doc_id, coalesce(nullif(lang, 'en'), nullif(source, 'src1')) problem from documents where coalesce(nullif(lang, 'en'), nullif(source, 'src1')) is not null")
def p27_alias_chain(t):
    first = F.coalesce(F.nullif(F.col("lang"), F.lit("en")), F.nullif(F.col("source"), F.lit("src1")))
    return t.documents.select("doc_id", first.alias("problem")).where("problem is not null")


@query("select c_custkey, case when a.s_suppkey is not null then 'given' when b.s_suppkey is not null then 'pool' else 'error' end as found from customer left join supplier a on a.s_suppkey = c_custkey left join supplier b on b.s_suppkey = c_custkey // 7")
def j05_ordered_fallback(t):
    ways = F.array(F.struct(F.lit(0).alias("rank"), F.lit("given").alias("way"), F.col("c_custkey").alias("s_suppkey")), F.struct(F.lit(1).alias("rank"), F.lit("pool").alias("way"), F.floor(F.col("c_custkey") / 7).alias("s_suppkey")))
    hits = t.customer.select("c_custkey", F.inline(ways)).join(t.supplier.select("s_suppkey"), "s_suppkey").groupBy("c_custkey").agg(F.min_by("way", "rank").alias("way"))
    return t.customer.select("c_custkey").join(hits, "c_custkey", "left").select("c_custkey", F.coalesce("way", F.lit("error")).alias("found"))


@query("select o_orderstatus, count(*) n, count(*) filter (c_acctbal > 0) correct from orders join customer on o_custkey = c_custkey group by 1")
def j07_answer_key(t):
    rows = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_acctbal"), "o_custkey")
    return rows.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_acctbal") > 0).alias("correct"))


@query("select d.lang, count(*) n, count(l.quality) judged, sum(l.quality) good from documents d left join labels l on d.doc_id = l.doc_id group by 1")
def j09_left_join_metrics(t):
    rows = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count("quality").alias("judged"), F.sum("quality").alias("good"))


@query("select l_orderkey, l_linenumber, round(max(case when l_linenumber = 1 then l_extendedprice end) over (partition by l_orderkey) - l_extendedprice, 4) contribution from lineitem")
def j10_against_baseline(t):
    base = F.max(F.when(F.col("l_linenumber") == 1, F.col("l_extendedprice"))).over(Window.partitionBy("l_orderkey"))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(base - F.col("l_extendedprice"), 4).alias("contribution"))


OVERLAP = "greatest(0, least(a.l_quantity, b.l_quantity) + 10 - greatest(a.l_quantity, b.l_quantity)) / (greatest(a.l_quantity, b.l_quantity) + 10 - least(a.l_quantity, b.l_quantity))"


def overlaps(t):
    """Overlap share of each line's segment [quantity, quantity + 10] with those of the other flag in its order."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    pairs = rows.alias("a").join(rows.alias("b"), F.expr("a.l_orderkey = b.l_orderkey and a.l_returnflag <> 'N' and b.l_returnflag = 'N'"))
    return pairs.select("a.l_orderkey", "a.l_linenumber", F.expr(OVERLAP).cast("double").alias("iou"))


@query(f"with p as (select a.l_orderkey, a.l_linenumber, {OVERLAP} iou from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_returnflag <> 'N' and b.l_returnflag = 'N') select l_orderkey, count(distinct l_linenumber) filter (iou > 0.3) covered, round(count(distinct l_linenumber) filter (iou > 0.3) * 1.0 / count(distinct l_linenumber), 6) as precision from p group by 1")
def j13_segment_match(t):
    hit = F.count_distinct(F.when(F.col("iou") > 0.3, F.col("l_linenumber")))
    return overlaps(t).groupBy("l_orderkey").agg(hit.alias("covered"), F.round(hit / F.count_distinct("l_linenumber"), 6).alias("precision"))


@query(f"select a.l_orderkey, a.l_linenumber, round(max({OVERLAP}), 6) best from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_returnflag <> 'N' and b.l_returnflag = 'N' group by 1, 2")
def j14_best_match(t):
    return overlaps(t).groupBy("l_orderkey", "l_linenumber").agg(F.round(F.max("iou"), 6).alias("best"))


@query("select round(avg(case when regexp_replace(lower(c_name), '[^a-z]', '', 'g') = 'customer' then 1.0 else 0 end), 6) exact_match from customer")
def a12_exact_match(t):
    return t.customer.agg(F.round(F.avg((F.regexp_replace(F.lower("c_name"), "[^a-z]", "") == "customer").cast("double")), 6).alias("exact_match"))


@query("select round(avg(case when s = ['N'] then 1.0 else 0 end), 6) exact, count(*) n from (select l_orderkey, list_sort(list_distinct(list(l_returnflag))) s from lineitem group by 1)")
def a29_set_equality(t):
    sets = t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_returnflag")).alias("s"))
    return sets.agg(F.round(F.avg((F.col("s") == F.array(F.lit("N"))).cast("double")), 6).alias("exact"), F.count(F.lit(1)).alias("n"))


@query("select o_orderpriority k, round(sum(o_totalprice) filter (o_orderstatus = 'F'), 2) f, round(sum(o_totalprice) filter (o_orderstatus = 'O'), 2) o, round(sum(o_totalprice), 2) total from orders group by 1")
def a45_sums_by_type(t):
    pivot = t.orders.groupBy(F.col("o_orderpriority").alias("k")).pivot("o_orderstatus", ["F", "O"]).agg(F.sum("o_totalprice"))
    total = t.orders.groupBy(F.col("o_orderpriority").alias("k")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return pivot.join(total, "k").select("k", F.round("F", 2).alias("f"), F.round("O", 2).alias("o"), "total")


@query("select round(avg(case when l_quantity > 5 then 1.0 else 0 end), 6) instruction, (select round(avg(case when ok then 1.0 else 0 end), 6) from (select bool_and(l_quantity > 5) ok from lineitem group by l_orderkey)) prompt from lineitem")
def a51_instruction_accuracy(t):
    ok = F.col("l_quantity") > 5
    g = t.lineitem.groupBy("l_orderkey").agg(F.count_if(ok).alias("yes"), F.count(F.lit(1)).alias("n"), F.bool_and(ok).alias("all"))
    return g.agg(F.round(F.sum("yes") / F.sum("n"), 6).alias("instruction"), F.round(F.avg(F.col("all").cast("double")), 6).alias("prompt"))


@query("with b as (select o_orderstatus s, avg(case when o_totalprice > 1000 then 1.0 else 0 end) a from orders group by 1) select count(*) n, case when count(*) = 3 then round(avg(a), 6) end average from b")
def a56_average_if_complete(t):
    b = t.orders.groupBy("o_orderstatus").agg(F.avg((F.col("o_totalprice") > 1000).cast("double")).alias("a"))
    return b.agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) == 3, F.round(F.avg("a"), 6)).alias("average"))


@query("select l_returnflag k, round(avg(l_extendedprice - l_quantity - l_discount), 6) residual, round(avg(l_quantity + l_discount), 6) stages, round(quantile_cont(l_extendedprice, 0.9), 6) p90 from lineitem group by 1")
def a58_stage_times(t):
    stages = F.col("l_quantity") + F.col("l_discount")
    return t.lineitem.groupBy(F.col("l_returnflag").alias("k")).agg(F.round(F.avg(F.col("l_extendedprice") - stages), 6).alias("residual"), F.round(F.avg(stages), 6).alias("stages"), F.round(F.percentile("l_extendedprice", F.lit(0.9)), 6).alias("p90"))


@query("select event_id // 100 as step, round(avg(case when value < 3 then 1.0 else 0 end), 6) low, round(avg(value), 6) mean, max(value) most, round(sum(value), 4) total from events group by 1")
def a59_between_boundaries(t):
    v = F.col("value")
    parts = [F.round(F.avg((v < 3).cast("double")), 6).alias("low"), F.round(F.avg(v), 6).alias("mean"), F.max(v).alias("most"), F.round(F.sum(v), 4).alias("total")]
    return t.events.groupBy(F.floor(F.col("event_id") / 100).alias("step")).agg(*parts)


@query("with r as (select l_orderkey, l_extendedprice p, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber) i, count(*) over (partition by l_orderkey) n from lineitem) select l_orderkey, round(avg(p), 4) score from r where i <= greatest(1, round_even(0.5 * n, 0)) group by 1")
def w18_top_share_mean(t):
    w = Window.partitionBy("l_orderkey")
    rows = t.lineitem.select("l_orderkey", "l_extendedprice", F.row_number().over(w.orderBy(F.desc("l_extendedprice"), "l_linenumber")).alias("i"), F.count(F.lit(1)).over(w).alias("n"))
    return rows.where(F.col("i") <= F.greatest(F.lit(1), F.bround(F.col("n") * 0.5, 0))).groupBy("l_orderkey").agg(F.round(F.avg("l_extendedprice"), 4).alias("score"))


@query("select l_orderkey, l_linenumber, cast(rank as bigint) rank from (select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber) rank from lineitem) where rank <= 2")
def w19_ranked_components(t):
    top = curate.top_by_group(t.lineitem, "l_orderkey", [F.desc("l_extendedprice"), F.col("l_linenumber")], 2)
    return top.select("l_orderkey", "l_linenumber", F.col("rank").cast("long").alias("rank"))


@query("with recursive e as (select 'world' p, 'r' || n_regionkey c from nation union select 'r' || n_regionkey, 'n' || n_nationkey from nation), x as (select p a, c d from e union select x.a, e.c from x join e on x.d = e.p) select a ancestor, count(*) members from x group by 1")
def j20_group_closure(t):
    region, leaf = F.concat(F.lit("r"), "n_regionkey"), F.concat(F.lit("n"), "n_nationkey")
    edges = t.nation.select(F.lit("world").alias("p"), region.alias("c")).union(t.nation.select(region, leaf)).distinct()
    closed = rollup.closure(edges, "p", "c")
    return closed.groupBy(F.col(closed.columns[0]).alias("ancestor")).agg(F.count(F.lit(1)).alias("members"))


@query("select user_id, first(value order by event_id) one, list_aggregate(list(value order by event_id)[1:3], 'sum') three from events group by 1")
def o02_first_responses(t):
    rows = t.events.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("r"))
    first = F.slice(F.col("r")["value"], 1, 3)
    return rows.select("user_id", F.element_at(first, 1).alias("one"), F.aggregate(first, F.lit(0.0), lambda a, x: a + x).alias("three"))


@query("select 'customer' task, c_custkey as id, c_acctbal score from customer union all select 'supplier', s_suppkey, s_acctbal from supplier")
def u03_union_of_tasks(t):
    a = t.customer.select(F.lit("customer").alias("task"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score"))
    return a.unionByName(t.supplier.select(F.lit("supplier").alias("task"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("score")))


@query("select case when source = 'src2' then 'test' else source end as split, count(*) n from documents where source is distinct from 'src1' group by 1")
def u05_remove_and_rename(t):
    split = F.when(F.col("source") == "src2", "test").otherwise(F.col("source"))
    return t.documents.where(~F.col("source").eqNullSafe("src1")).groupBy(split.alias("split")).agg(F.count(F.lit(1)).alias("n"))
