"""Merged regions, placebo regions and label grids; embeddings are 8 x 8 maps, four in a row the layers or tokens of one sample."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalframe.operators import labels, region_growth, regions
from evalframe.plans.base import query
from evalframe.plans.regions import CELLS

PARTS = CELLS + """, k as (select vec_id, r, c from (select *, max(p) over (partition by vec_id) peak from cells) where p >= 0.3 * peak),
w as (with recursive w as (select vec_id, r, c, r * 8 + c l from k union select k.vec_id, k.r, k.c, w.l from w join k on k.vec_id = w.vec_id and abs(k.r - w.r) + abs(k.c - w.c) = 1) select vec_id, r, c, min(l) l from w group by 1, 2, 3),
m as (select vec_id // 4 s, vec_id % 4 v, r, c, dense_rank() over (partition by vec_id order by l) comp from w)"""


@query(PARTS + """, a as (select s, v, comp, count(*) area from m group by all having count(*) >= 2),
o as (select *, row_number() over (partition by s order by area desc, v, comp) k from a),
x as (select p.s, least(a.k, b.k) lo, greatest(a.k, b.k) hi from (select i.s, i.v av, i.comp ac, j.v bv, j.comp bc, count(*) n from m i join m j on i.s = j.s and i.r = j.r and i.c = j.c and i.v < j.v group by all) p join o a on a.s = p.s and a.v = av and a.comp = ac join o b on b.s = p.s and b.v = bv and b.comp = bc where n / (a.area + b.area - n) > 0.15),
los as (select s, hi k, list(lo) los from x group by 1, 2), last as (select s, max(k) n from o group by 1),
g as (with recursive g as (select s, 0 k, []::bigint[] seeds, 0::bigint of from last union all select g.s, g.k + 1, case when len(list_intersect(seeds, los)) > 0 then seeds else list_append(seeds, g.k + 1) end, case when len(list_intersect(seeds, los)) > 0 then list_min(list_intersect(seeds, los)) else g.k + 1 end from g join last on last.s = g.s and g.k < n left join los on los.s = g.s and los.k = g.k + 1) select s, k, of from g where k > 0),
u as (select o.s, o.v, o.comp, of from o join g on o.s = g.s and o.k = g.k), z as (select s, of, count(*) members, count(distinct v) votes from u group by 1, 2),
h as (select u.s, u.of, r, c, count(*) n from m join u on m.s = u.s and m.v = u.v and m.comp = u.comp group by all), y as (select h.*, votes, 2 * n >= members half, bool_or(2 * n >= members) over (partition by h.s, h.of) any_half from h join z on h.s = z.s and h.of = z.of),
q as (select s, of, count(*) area, any_value(votes) votes, min(r * 8 + c) first_cell from y where half or not any_half group by 1, 2)
select s, cast(row_number() over (partition by s order by area desc, of) as int) region, area, votes, votes / 4 weight, cast(first_cell as int) first_cell from q qualify row_number() over (partition by s order by area desc, of) <= 4""")
def r10_merged_layers(t):
    kept = regions.peak_gate(regions.grid(t.embeddings, "vec_id", "embedding", 8), "vec_id", 0.3)
    parts = regions.label_components(kept, "vec_id").select(F.expr("vec_id div 4").alias("s"), (F.col("vec_id") % 4).alias("v"), "comp", "r", "c")
    found, cells = region_growth.merged_layers(parts, "s", "v", "comp", 0.15, 4, 4, 2)
    first = cells.groupBy("s", "region").agg(F.min(F.col("r") * 8 + F.col("c")).alias("first_cell"))
    return found.join(first, ["s", "region"])


@query()
def r12_placebo_blobs(t):
    """Two blobs of five cells where a vector's map is low; no SQL: a test compares them with a sequential growth."""
    cells = regions.grid(t.embeddings, "vec_id", "embedding", 8)
    return region_growth.placebo_blobs(cells, regions.peak_gate(cells, "vec_id", 0.9), "vec_id", 5, 2, 0.0, lambda blob: F.xxhash64("vec_id", F.lit(blob), "r", "c"))


@query(CELLS + """, n as (select vec_id // 4 s, vec_id, r, c, greatest(p, 0) p from cells where vec_id % 4 >= 1), e as (select *, p / greatest(max(p) over (partition by vec_id), 1e-12) q from n),
k as (select s, vec_id, r, c from (select *, max(q) over (partition by vec_id) peak, avg(q) over (partition by vec_id) mean from e) where peak / (mean + 1e-8) >= 1.5 and q > 0.8 * peak),
w as (with recursive w as (select vec_id, r, c, r * 8 + c l from k union select k.vec_id, k.r, k.c, w.l from w join k on k.vec_id = w.vec_id and abs(k.r - w.r) <= 1 and abs(k.c - w.c) <= 1) select vec_id, r, c, min(l) l from w group by 1, 2, 3),
one as (select vec_id from w group by 1 having count(distinct l) = 1), u as (select distinct s, r, c from k join one using (vec_id)),
f as (select i, exp(-i * i / 2.0) g from (select unnest([-2, -1, 0, 1, 2]) i)), b as (select s, r + a.i r, c + d.i c, sum(a.g * d.g) p from u, f a, f d where r + a.i between 0 and 7 and c + d.i between 0 and 7 group by 1, 2, 3),
z as (select s, r, c, p > 0.3 * max(p) over (partition by s) near from b), every as (select distinct vec_id // 4 s from embeddings),
l as (select every.s, cast(a.i as int) r, cast(d.i as int) c, u.s is not null hit, coalesce(near, false) near from every cross join range(8) a(i) cross join range(8) d(i) left join u on u.s = every.s and u.r = a.i and u.c = d.i left join z on z.s = every.s and z.r = a.i and z.c = d.i)
select s, r, c, case when not bool_or(hit) over (partition by s) then -100 when hit then 1 when near then -100 else 0 end as "label" from l""")
def r13_single_region_labels(t):
    cells = regions.grid(t.embeddings, "vec_id", "embedding", 8)
    maps = cells.select(F.expr("vec_id div 4").alias("s"), (F.col("vec_id") % 4).alias("token"), "r", "c", F.greatest("p", F.lit(0.0)).alias("p"))
    return labels.single_region_labels(maps, "s", "token", 8, 8, skip=1, ratio=1.5, fraction=0.8)


@query(CELLS + """, i as (select a.vec_id, a.r, a.c, greatest(a.p, 0) * case when a.vec_id % 7 = 0 then 0.01 else 1 end p, abs(b.p) sink, 40 + a.vec_id * 13 % 60 w, 40 + a.vec_id * 29 % 60 h from cells a join cells b on b.vec_id = a.vec_id and b.r = a.c and b.c = a.r),
s as (select *, greatest(cast(trunc(w / greatest(w, h)::double * 8) as int), 1) nw, greatest(cast(trunc(h / greatest(w, h)::double * 8) as int), 1) nh from i),
k as (select *, case when nw > nh then r >= (8 - nh) // 2 and r < least(nh + ceil((8 - nh) / 2), 8) and c < nw when nh > nw then c >= (8 - nw) // 2 and c < least(nw + ceil((8 - nw) / 2), 8) and r < nh else true end inside from s),
g as (select *, case when inside and sink < 0.15 then p else 0 end g from k), f as (select * replace (case when g > 0.8 * max(g) over (partition by vec_id) then g else 0 end as g) from g),
x as (select *, max(g) over w top, coalesce(greatest(min(case when g > 0 then r end) over w - 1, 0), 0) r1, coalesce(greatest(min(case when g > 0 then c end) over w - 1, 0), 0) c1, coalesce(least(max(case when g > 0 then r end) over w + 1, 7), 7) r2, coalesce(least(max(case when g > 0 then c end) over w + 1, 7), 7) c2 from f window w as (partition by vec_id))
select vec_id, r, c, case when not ((c2 - c1 + 1) * (r2 - r1 + 1) < 0.9 * 64 and top >= 5e-3) then -100 when g > 0 then 1 when not (r between r1 and r2 and c between c1 and c2) and case when sink < 0.15 then p else 0 end < 0.5 * top or not inside then 0 else -100 end as "label" from x""")
def r14_pseudo_labels(t):
    cells = regions.grid(t.embeddings, "vec_id", "embedding", 8)
    other = cells.select("vec_id", F.col("c").alias("r"), F.col("r").alias("c"), F.abs("p").alias("sink"))
    rows = cells.join(other, ["vec_id", "r", "c"]).withColumn("p", F.greatest("p", F.lit(0.0)) * F.when(F.col("vec_id") % 7 == 0, 0.01).otherwise(1.0))
    known = labels.letter_box((40 + F.col("vec_id") * 13 % 60), (40 + F.col("vec_id") * 29 % 60), 8)
    return labels.pseudo_labels(rows, "vec_id", 8, 8, known, 0.15, 0.8, 0.5, 0.9).select("vec_id", "r", "c", "label")
