"""Region and action tables: lines of an order are a sample's components, embeddings are 8 x 8 maps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evalframe.operators import advantage, regions
from evalframe.plans.base import query

CELLS = "with cells as (select vec_id, cast((i - 1) // 8 as int) r, cast((i - 1) % 8 as int) c, cast(x as double) p from (select vec_id, unnest(range(1, len(embedding) + 1)) i, unnest(embedding) x from embeddings))"


@query("select l_orderkey, l_linenumber, round(case when count(*) over w < 2 then 0 else (l_extendedprice - avg(l_extendedprice) over w) / (stddev_pop(l_extendedprice) over w + 0.1 + 1e-6) end, 6) advantage from lineitem window w as (partition by l_orderkey)")
def w06_relative_advantage(t):
    return advantage.relative(t.lineitem, "l_orderkey", "l_extendedprice", 0.1).select("l_orderkey", "l_linenumber", F.round("advantage", 6).alias("advantage"))


@query("select l_orderkey, l_linenumber, round(a, 6) advantage from (select l_orderkey, l_linenumber, (l_extendedprice - max(case when l_linenumber = 1 then l_extendedprice end) over w) / (stddev_pop(case when l_linenumber <> 1 then l_extendedprice end) over w + 1e-6 + 1) a from lineitem window w as (partition by l_orderkey)) where l_linenumber <> 1")
def w07_baselined_advantage(t):
    return advantage.baselined(t.lineitem, "l_orderkey", "l_extendedprice", F.col("l_linenumber") == 1, 0.0, 1.0).select("l_orderkey", "l_linenumber", F.round("advantage", 6).alias("advantage"))


@query("select l_orderkey, l_linenumber, round(l_discount / (coalesce(stddev_samp(l_discount) over (partition by l_orderkey), 0) + 1), 6) advantage from lineitem")
def w08_supplement_advantage(t):
    return advantage.supplement(t.lineitem, "l_orderkey", "l_discount").select("l_orderkey", "l_linenumber", F.round("advantage", 6).alias("advantage"))


@query("select l_orderkey, l_linenumber, round(s - m - ln(sum(exp(s - m)) over (partition by l_orderkey)), 6) log_prob from (select l_orderkey, l_linenumber, l_quantity / 10 s, max(l_quantity / 10) over (partition by l_orderkey) m from lineitem)")
def w09_log_policy(t):
    return advantage.log_policy(t.lineitem, "l_orderkey", "l_quantity", 10.0).select("l_orderkey", "l_linenumber", F.round("log_prob", 6).alias("log_prob"))


@query()
def w10_gumbel_sample(t):
    rows = advantage.log_policy(t.lineitem, "l_orderkey", "l_quantity", 10.0)
    return advantage.gumbel_top_k(rows, "l_orderkey", "log_prob", ["l_orderkey", "l_linenumber"], 2, 7).select("l_orderkey", "l_linenumber")


@query("select l_orderkey, l_linenumber, round(g0 + greatest(-1, least(1, g - g0)), 6) height from (select l_orderkey, l_linenumber, ln((l_discount + 0.01) / (0.99 - l_discount)) g, max(case when l_linenumber = 1 then ln((l_discount + 0.01) / (0.99 - l_discount)) end) over (partition by l_orderkey) g0 from lineitem)")
def w11_clipped_heights(t):
    g = F.log((F.col("l_discount") + 0.01) / (0.99 - F.col("l_discount")))
    rows = t.lineitem.withColumn("g", g).withColumn("g0", F.max(F.when(F.col("l_linenumber") == 1, g)).over(Window.partitionBy("l_orderkey")))
    return rows.select("l_orderkey", "l_linenumber", F.round(F.col("g0") + F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("g") - F.col("g0"))), 6).alias("height"))


@query("select l_orderkey, round(least(2 * max(abs(l_discount - b)), 0.1), 6) bar from (select l_orderkey, l_discount, max(case when l_linenumber = 1 then l_discount end) over (partition by l_orderkey) b from lineitem) group by 1")
def w12_noise_bar(t):
    rows = t.lineitem.withColumn("b", F.max(F.when(F.col("l_linenumber") == 1, F.col("l_discount"))).over(Window.partitionBy("l_orderkey")))
    return rows.groupBy("l_orderkey").agg(F.round(F.least(2 * F.max(F.abs(F.col("l_discount") - F.col("b"))), F.lit(0.1)), 6).alias("bar"))


@query("with recursive o as (select user_id, value, row_number() over (partition by user_id order by event_id) n from events), e as (select user_id, n, 0.1 * value s from o where n = 1 union all select o.user_id, o.n, 0.9 * e.s + 0.1 * o.value from e join o on o.user_id = e.user_id and o.n = e.n + 1) select user_id, round(max_by(s, n), 6) ema from e group by 1")
def w13_moving_average(t):
    from evalframe.functions.aggregates import ema

    return t.events.groupBy("user_id").agg(F.round(ema(F.col("value"), F.col("event_id"), 0.9, 0.0), 6).alias("ema"))


@query("select l_orderkey, case when n > 2 then 1 + n + n * (n - 1) / 2 when n = 2 then 3 else 1 end as actions from (select l_orderkey, count(*) n from lineitem group by 1)")
def r06_removal_actions(t):
    own = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    found = regions.removal_actions(t.lineitem.select("l_orderkey", own.alias("comp")), "l_orderkey", "comp")
    return found.groupBy("l_orderkey").agg(F.count(F.lit(1)).cast("double").alias("actions"))


@query("select l_orderkey, l_linenumber, round((sum(l_quantity) over (partition by l_orderkey) - l_quantity) / sum(l_quantity) over (partition by l_orderkey), 6) keep from lineitem")
def r07_keep_area(t):
    whole = F.sum("l_quantity").over(Window.partitionBy("l_orderkey"))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round((whole - F.col("l_quantity")) / whole, 6).alias("keep"))


@query(CELLS + " select * from cells")
def r01_grid(t):
    return regions.grid(t.embeddings, "vec_id", "embedding", 8)


@query(CELLS + ", g as (select *, max(p) over (partition by vec_id) peak, avg(p) over (partition by vec_id) mean from cells) select vec_id, count(*) n, min(r) r1, min(c) c1, max(r) + 1 r2, max(c) + 1 c2 from g where peak >= 0.1 and peak >= 2 * mean and p >= 0.5 * peak group by 1")
def r03_peak_gate(t):
    kept = regions.peak_gate(regions.grid(t.embeddings, "vec_id", "embedding", 8), "vec_id", 0.5, 0.1, 2.0)
    return kept.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("r1"), F.min("c").alias("c1"), (F.max("r") + 1).alias("r2"), (F.max("c") + 1).alias("c2"))


@query(CELLS + ", k as (select vec_id, r, c, p from (select *, max(p) over (partition by vec_id) peak from cells) where p >= 0.5 * peak), l as (with recursive w as (select vec_id, r, c, r * 8 + c l from k union select k.vec_id, k.r, k.c, w.l from w join k on k.vec_id = w.vec_id and abs(k.r - w.r) + abs(k.c - w.c) = 1) select vec_id, r, c, min(l) l from w group by 1, 2, 3) select vec_id, cast(count(distinct l) as bigint) components, max(n) largest from (select vec_id, l, count(*) over (partition by vec_id, l) n from l) group by 1")
def r04_components(t):
    kept = regions.peak_gate(regions.grid(t.embeddings, "vec_id", "embedding", 8), "vec_id", 0.5)
    labelled = regions.label_components(kept, "vec_id")
    return labelled.groupBy("vec_id", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("vec_id").agg(F.count(F.lit(1)).alias("components"), F.max("n").alias("largest"))


COMPONENTS = """, k as (select vec_id, r, c, p from (select *, max(p) over (partition by vec_id) peak from cells) where p >= 0.5 * peak),
w as (with recursive w as (select vec_id, r, c, r * 8 + c l from k union select k.vec_id, k.r, k.c, w.l from w join k on k.vec_id = w.vec_id and abs(k.r - w.r) <= 1 and abs(k.c - w.c) <= 1) select vec_id, r, c, min(l) l from w group by 1, 2, 3),
m as (select vec_id, r, c, p, dense_rank() over (partition by vec_id order by l) comp from w join k using (vec_id, r, c))"""


@query(CELLS + COMPONENTS + """, o as (select *, count(*) over (partition by vec_id, comp) n, row_number() over (partition by vec_id, comp order by p desc, r, c) i from m)
select vec_id, comp, count(*) area, min(r) r1, min(c) c1, max(r) + 1 r2, max(c) + 1 c2, round(avg(p) filter (i <= greatest(1, round_even(0.25 * n, 0))) - 0.5 * greatest(0, count(*) / 64 - 0.02), 6) score from o group by 1, 2""")
def r05_component_stats(t):
    kept = regions.peak_gate(regions.grid(t.embeddings, "vec_id", "embedding", 8), "vec_id", 0.5)
    labelled = regions.label_components(kept, "vec_id", True).join(kept, ["vec_id", "r", "c"])
    return regions.component_stats(labelled, "vec_id", 0.25, 64, 0.5, 0.02).withColumn("score", F.round("score", 6))


@query(CELLS + ", o as (select unnest([-1, 0, 1]) i), w as (select x.vec_id, x.r, x.c, sum(exp(-(a.i * a.i + b.i * b.i) / 2.0) * y.p) s, sum(exp(-(a.i * a.i + b.i * b.i) / 2.0)) t from cells x, o a, o b, cells y where y.vec_id = x.vec_id and y.r = case when x.r + a.i < 0 then 1 when x.r + a.i > 7 then 6 else x.r + a.i end and y.c = case when x.c + b.i < 0 then 1 when x.c + b.i > 7 then 6 else x.c + b.i end group by 1, 2, 3) select vec_id, r, c, round(s / t, 6) p from w")
def r02_smooth(t):
    return regions.smooth(regions.grid(t.embeddings, "vec_id", "embedding", 8), "vec_id", 3, 1.0, 8, 8).select("vec_id", "r", "c", F.round("p", 6).alias("p"))


@query("with s as (select user_id, event_id, epoch(ts) a, epoch(lead(ts) over (partition by user_id order by ts, event_id)) b, epoch(lag(ts) over (partition by user_id order by ts, event_id)) z from events) select user_id, event_id, round(greatest(least(b, a + 86400) - a, 0) / greatest(greatest(b, a + 86400) - a, 1e-8), 6) iou from s where b is not null")
def f28_temporal_iou(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    sec = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = t.events.select("user_id", "event_id", sec.alias("a"), F.lead(sec).over(w).alias("b")).where("b is not null")
    inter = F.greatest(F.least(F.col("b"), F.col("a") + 86400) - F.col("a"), F.lit(0.0))
    return rows.select("user_id", "event_id", F.round(inter / F.greatest(F.greatest(F.col("b"), F.col("a") + 86400) - F.col("a"), F.lit(1e-8)), 6).alias("iou"))


LAYERS = CELLS + ", l as (select vec_id // 4 s, vec_id % 4 v, r, c, p from (select *, max(p) over (partition by vec_id) peak from cells) where p >= 0.4 * peak)"


def layers(t):
    """Four vectors in a row are the layers of one sample."""
    kept = regions.peak_gate(regions.grid(t.embeddings, "vec_id", "embedding", 8), "vec_id", 0.4)
    return kept.select(F.expr("vec_id div 4").alias("s"), (F.col("vec_id") % 4).alias("v"), "r", "c", "p")


@query(LAYERS + ", n as (select s, v, count(*) n from l group by 1, 2), x as (select a.s, a.v a_layer, b.v b_layer, count(*) n from l a join l b on a.s = b.s and a.r = b.r and a.c = b.c and a.v < b.v group by 1, 2, 3) select x.s, a_layer, b_layer, round(x.n / (a.n + b.n - x.n), 6) iou from x join n a on a.s = x.s and a.v = a_layer join n b on b.s = x.s and b.v = b_layer where x.n / (a.n + b.n - x.n) > 0.1")
def j12_overlaps(t):
    found = regions.overlaps(layers(t).withColumn("comp", F.lit(1)), "s", "v", "comp", 0.1)
    return found.select("s", "a_layer", "b_layer", F.round("iou", 6).alias("iou"))


VOTES = ", w as (select s, r, c from l group by 1, 2, 3 having count(distinct v) >= 2), d as (select distinct s, r + i r, c + j c from w, (values (-1), (0), (1)) a(i), (values (-1), (0), (1)) b(j) where r + i between 0 and 7 and c + j between 0 and 7)"


@query(LAYERS + VOTES + " select * from d")
def r08_votes(t):
    return regions.dilated(regions.voted(layers(t), "s", "v", 2), "s", 3, 8, 8)


@query(LAYERS + VOTES + ", g as (select l.s, l.v, l.r, l.c, w.s is not null hit from l left join w on l.s = w.s and l.r = w.r and l.c = w.c) select s, v, r, c from (select *, bool_or(hit) over (partition by s, v) any_hit from g) where hit or not any_hit")
def r09_vote_gate(t):
    rows = layers(t).withColumn("comp", F.col("v"))
    return regions.vote_gate(rows, "s", "comp", regions.voted(rows, "s", "v", 2)).select("s", "v", "r", "c")


@query(LAYERS + " select s, r, c from l where v = 0 and not exists (from l o where o.v = 1 and o.s = l.s and o.r = l.r and o.c = l.c)")
def r11_outside(t):
    rows = layers(t)
    return regions.outside(rows.where("v = 0"), rows.where("v = 1"), "s").select("s", "r", "c")


@query(CELLS + ", k as (select vec_id, min(r) r1, min(c) c1, max(r) + 1 r2, max(c) + 1 c2 from cells where p > 0.3 group by 1) select vec_id, coalesce(r1, 0) r1, coalesce(c1, 0) c1, coalesce(r2, 8) r2, coalesce(c2, 8) c2 from embeddings left join k using (vec_id)")
def r15_bounding_boxes(t):
    cells = regions.grid(t.embeddings, "vec_id", "embedding", 8)
    return regions.bounding_boxes(t.embeddings, cells.where("p > 0.3"), "vec_id", 8, 8)


@query(CELLS + " select vec_id, cast(y as int) r, cast(x as int) c, p from cells, range(5) a(y), range(12) b(x) where r = y * 8 // 5 and c = x * 8 // 12")
def r16_resampled(t):
    return regions.resampled(regions.grid(t.embeddings, "vec_id", "embedding", 8), "vec_id", (8, 8), (5, 12))


@query("with d as (select l_orderkey, list(round(l_extendedprice / 7, 4) order by l_linenumber, l_extendedprice) x from lineitem group by 1) select l_orderkey, x[1] first, round(list_sum(x), 2) total from d")
def r18_rounded(t):
    rows = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_extendedprice") / 7).alias("x")))).alias("parts"))
    out = regions.rounded(rows)
    return out.select("l_orderkey", F.get("parts", 0)["x"].alias("first"), F.round(F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["x"]), 2).alias("total"))


@query("select l_orderkey, count(*) regions, case count(*) when 1 then 1 when 2 then 3 else 1 + count(*) + count(*) * (count(*) - 1) / 2 end as actions, round(sum(l_quantity), 4) area from lineitem group by 1")
def r17_sample_dump(t):
    own = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    parts = t.lineitem.select("l_orderkey", own.alias("comp"), F.col("l_quantity").alias("area"))
    dump = regions.sample_dump(parts, regions.removal_actions(parts, "l_orderkey", "comp"), "l_orderkey")
    area = F.aggregate("regions", F.lit(0.0), lambda a, x: a + x["area"])
    return dump.select("l_orderkey", F.size("regions").cast("long").alias("regions"), F.size("actions").cast("double").alias("actions"), F.round(area, 4).alias("area"))
