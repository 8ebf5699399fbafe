"""Curation queries: filters, joins, ranked selection, retention."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evalframe.operators import curate, stats
from evalframe.plans.base import query


@query("select source, count(*) n, count(*) filter (length(trim(text)) > 0) kept from documents where source not in ('src1', 'src2') group by 1")
def p01_drop_sources_and_blank(t):
    return t.documents.where(~F.col("source").isin("src1", "src2")).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.length(F.trim("text")) > 0).alias("kept"))


@query("select o_orderkey, case when q is null or sz <= 0 then 1.0 else least(1.0, round(q / sz, 9)) end share from (select o_orderkey, o_totalprice sz, (select sum(greatest(l_quantity, 0) * greatest(l_linenumber, 0)) from lineitem where l_orderkey = o_orderkey) q from orders)")
def p02_area_share(t):
    box = F.array(F.lit(0.0), F.lit(0.0), F.col("l_quantity"), F.col("l_linenumber").cast("double"))
    boxes = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(box).alias("boxes"))
    rows = t.orders.join(boxes, "o_orderkey", "left").withColumn("boxes", F.coalesce("boxes", F.array().cast("array<array<double>>")))
    return rows.select("o_orderkey", F.round(curate.area_share(F.col("boxes"), F.col("o_totalprice"), F.lit(1.0)), 9).alias("share"))


@query("select o_orderkey, case when n is null then 'K=0' when n = 1 then 'K=1' else 'K>=2' end branch from orders left join (select l_orderkey, count(*) n from lineitem group by 1) on l_orderkey = o_orderkey")
def p04_branches(t):
    n = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    branch = F.when(F.col("n").isNull(), "K=0").when(F.col("n") == 1, "K=1").otherwise("K>=2")
    return t.orders.select("o_orderkey").join(n, "o_orderkey", "left").select("o_orderkey", branch.alias("branch"))


@query("select c_mktsegment || '_' || (row_number() over (partition by c_mktsegment order by c_custkey) - 1) question_id, c_custkey src_row from customer")
def p09_running_ids(t):
    rows = curate.positions_in(t.customer.select("c_mktsegment", "c_custkey"), ["c_mktsegment"], ["c_custkey"])
    return rows.select(F.concat_ws("_", "c_mktsegment", "position").alias("question_id"), F.col("c_custkey").alias("src_row"))


@query("select doc_id % 4 shard, count(*) n, min(doc_id) first_id from documents where doc_id >= 10 group by 1")
def p14_skip_and_shard(t):
    parts = [curate.indexed(t.documents, "doc_id", 10, None, 4, k).select(F.lit((k + 10) % 4).cast("long").alias("shard"), "doc_id") for k in range(4)]
    rows = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    return rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


@query("select doc_id % 3 shard, row_number() over (partition by doc_id % 3 order by doc_id) - 1 place, doc_id from documents")
def p15_shard_manifest(t):
    return curate.shard_manifest(t.documents, "doc_id", 3)


@query("select event_type, round(avg(value) filter (event_id % 17 <> 0 and event_id % 19 <> 0), 6) mean, round(avg(coalesce(try_cast(props as double), 0)), 6) coerced from events group by 1")
def p16_sentinels_and_coercion(t):
    valid = (F.col("event_id") % 17 != 0) & (F.col("event_id") % 19 != 0)
    return t.events.groupBy("event_type").agg(F.round(F.avg(F.when(valid, F.col("value"))), 6).alias("mean"), F.round(F.avg(F.coalesce(F.col("props").try_cast("double"), F.lit(0.0))), 6).alias("coerced"))


@query("select p_partkey, q, case q when 1 then p_name when 2 then p_brand when 3 then p_type else cast(p_size as varchar) end as answer from part, (select unnest([1, 2, 3, 4]) q)")
def p26_one_to_four(t):
    return t.part.selectExpr("p_partkey", "stack(4, 1, p_name, 2, p_brand, 3, p_type, 4, cast(p_size as string)) as (q, answer)")


@query("select d.doc_id, l.quality, l.toxic from documents d join labels l on d.doc_id = l.doc_id")
def j01_priority_join(t):
    labels = t.labels.select("doc_id", "quality", "toxic", F.lit(1).alias("file"))
    return curate.priority_join(t.documents.select("doc_id"), labels, ["doc_id"], [F.col("file"), F.col("quality")]).select("doc_id", "quality", "toxic")


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def j02_resume(t):
    return curate.resume(t.documents.select("doc_id"), t.labels, ["doc_id"])


@query("select doc_id, lang from documents where doc_id in (select doc_id from labels where quality = 1)")
def j03_whitelist(t):
    return t.documents.select("doc_id", "lang").join(t.labels.where("quality = 1").select("doc_id"), "doc_id", "left_semi")


@query("select c_custkey, coalesce(n_name, 'none') as nation, coalesce(r_name, 'none') as region from customer left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey")
def j04_dimension_lookup(t):
    n = F.broadcast(t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")))
    return t.customer.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.coalesce("n_name", F.lit("none")).alias("nation"), F.coalesce("r_name", F.lit("none")).alias("region"))


@query("select conv_id, count(*) n, sha256(string_agg(role || ':' || text, chr(10) order by turn)) joined from conversations group by 1")
def j06_regroup_responses(t):
    rows = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(":"), "text").alias("s"))))
    return t.conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(rows["s"], "\n"), 256).alias("joined"))


@query("select o_orderkey % 1000 base, cast(min(case when o_totalprice > 1000 then 1 else 0 end) as int) hit, count(*) n from orders group by 1")
def j08_circular_variants(t):
    return t.orders.groupBy(F.pmod("o_orderkey", F.lit(1000)).alias("base")).agg(F.min(F.when(F.col("o_totalprice") > 1000, 1).otherwise(0)).alias("hit"), F.count(F.lit(1)).alias("n"))


@query("select a.l_orderkey, a.l_linenumber i, b.l_linenumber j from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber < b.l_linenumber")
def j11_pairs_of_group(t):
    a = t.lineitem.select("l_orderkey", F.col("l_linenumber").alias("i"))
    b = t.lineitem.select("l_orderkey", F.col("l_linenumber").alias("j"))
    return a.join(b, "l_orderkey").where("i < j")


@query("select o_orderkey, round(o_totalprice, 4) score_1, round(x, 4) score_2, round(o_totalprice - x, 4) delta from orders join (select l_orderkey, sum(l_extendedprice) x from lineitem group by 1) on l_orderkey = o_orderkey")
def j15_model_delta(t):
    other = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("x"))
    return t.orders.join(other, "o_orderkey").select("o_orderkey", F.round("o_totalprice", 4).alias("score_1"), F.round("x", 4).alias("score_2"), F.round(F.col("o_totalprice") - F.col("x"), 4).alias("delta"))


@query("with s as (select row_number() over (order by s_suppkey) - 1 k, s_suppkey, s_acctbal from supplier) select c_custkey, coalesce(s_acctbal, c_acctbal) score from customer left join s on c_custkey = s.k * 3")
def j18_splice_subset(t):
    new = curate.positions(t.supplier.select("s_suppkey", "s_acctbal"), ["s_suppkey"]).select((F.col("position") * 3).alias("c_custkey"), "s_acctbal")
    return t.customer.join(new, "c_custkey", "left").select("c_custkey", F.coalesce("s_acctbal", "c_acctbal").alias("score"))


@query("select o_orderstatus, rank, o_orderkey from (select o_orderstatus, o_orderkey, cast(row_number() over (partition by o_orderstatus order by o_totalprice desc, o_orderkey) as int) rank from orders) where rank <= 50")
def w01_top_by_status(t):
    return curate.top_by_group(t.orders, "o_orderstatus", [F.desc("o_totalprice"), F.col("o_orderkey")], 50).select("o_orderstatus", "rank", "o_orderkey")


@query()
def w02_top_fraction_sample(t):
    return curate.top_fraction_sample(t.orders, "o_orderstatus", [F.desc("o_totalprice"), F.col("o_orderkey")], 0.3, 40, 7, "o_orderkey").select("o_orderstatus", "o_orderkey")


@query()
def w03_interleave(t):
    return curate.interleave(t.documents.select("doc_id", "source"), "source", "doc_id", 7)


@query("select source, doc_id, lang from (select source, doc_id, lang, row_number() over (partition by source, lang order by doc_id) n from documents) where n = 1")
def w05_first_wins(t):
    return curate.first_wins(t.documents.select("source", "lang", "doc_id"), ["source", "lang"], [F.col("doc_id")]).select("source", "doc_id", "lang")


@query("select l_orderkey, round(avg(l_extendedprice), 6) reward_mean, round(stddev_pop(l_extendedprice), 6) reward_std, count(*) k from lineitem group by 1")
def a55_reward_stats(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.round(F.avg("l_extendedprice"), 6).alias("reward_mean"), F.round(F.stddev_pop("l_extendedprice"), 6).alias("reward_std"), F.count(F.lit(1)).alias("k"))


@query("with s as (select l_orderkey, round(stddev_pop(l_extendedprice), 4) d, count(*) k from lineitem group by 1), c as (select greatest(quantile_cont(d, 0.6), 0.001) cut from s where k > 1) select l_orderkey, k from s, c where k = 1 or d >= cut")
def a53_retention(t):
    s = t.lineitem.groupBy("l_orderkey").agg(F.round(F.stddev_pop("l_extendedprice"), 4).alias("d"), F.count(F.lit(1)).alias("k"))
    return curate.retain(s, F.col("k") == 1, F.col("d"), 0.4, 0.001).select("l_orderkey", "k")


@query("select user_id, event_type from (select user_id, event_type, row_number() over (partition by user_id order by count(*) desc, min(event_id)) r from events group by 1, 2) where r = 1")
def w15_majority_vote(t):
    votes = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("seen"))
    return curate.first_wins(votes, ["user_id"], [F.desc("n"), F.col("seen")]).select("user_id", "event_type")


@query("select user_id, k, max(case when pos <= k and value > 5 then 1 else 0 end) cov, round(avg(case when value > 5 then 1.0 else 0 end) filter (pos <= k), 6) mean from (select user_id, value, row_number() over (partition by user_id order by event_id) pos, count(*) over (partition by user_id) n from events), (select unnest([2, 4, 8]) k) where k <= n group by 1, 2")
def w20_coverage_at_k(t):
    w = Window.partitionBy("user_id")
    rows = t.events.select("user_id", (F.col("value") > 5).cast("int").alias("ok"), F.row_number().over(w.orderBy("event_id")).alias("pos"), F.count(F.lit(1)).over(w).alias("n"))
    each = rows.withColumn("k", F.explode(F.array(*map(F.lit, (2, 4, 8))))).where("k <= n and pos <= k")
    return each.groupBy("user_id", "k").agg(F.max("ok").alias("cov"), F.round(F.avg("ok"), 6).alias("mean"))


@query("select conv_id, turn, cast((row_number() over (order by length(text), conv_id, turn) - 1) // 32 as bigint) batch from conversations")
def w16_length_batches(t):
    rows = t.conversations.select("conv_id", "turn", F.length("text").alias("n"))
    return curate.positions(rows, ["n", "conv_id", "turn"]).select("conv_id", "turn", F.expr("position div 32").alias("batch"))


@query()
def o05_greedy_coreset(t):
    return stats.k_centres(t.embeddings, 20)


@query("select event_type, count(distinct user_id) n from events group by 1 having count(*) > 1")
def a63_duplicate_keys(t):
    return t.events.groupBy("event_type").agg(F.count_distinct("user_id").alias("n"), F.count(F.lit(1)).alias("c")).where("c > 1").select("event_type", "n")


@query("select conv_id, turn, i as window_start, array_to_string(ws[i + 1:i + 16], ' ') tokens from (select conv_id, turn, ws, unnest(range(0, len(ws), 16)) i from (select conv_id, turn, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') ws from conversations) where len(ws) > 0)")
def f39_token_windows(t):
    ws = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    rows = t.conversations.select("conv_id", "turn", ws.alias("ws")).where("size(ws) > 0")
    return rows.select("conv_id", "turn", "ws", F.explode(F.expr("sequence(0L, cast(size(ws) - 1 as bigint), 16L)")).alias("window_start")).selectExpr("conv_id", "turn", "window_start", "array_join(slice(ws, cast(window_start as int) + 1, 16), ' ') as tokens")
