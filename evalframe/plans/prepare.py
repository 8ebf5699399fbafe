"""Preparation and reporting: documents, parts and line items stand for evaluation rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evalframe.operators import captions, curate, shape
from evalframe.operators.spec import EvalSpec
from evalframe.plans.base import query


def md5(seed: int, *keys: str) -> str:
    return f"md5(concat_ws('|', '{seed}', {', '.join(keys)}))"


@query("with q as (select p_partkey, nullif(trim(case when p_partkey % 3 = 0 then null else p_name end), '') a, nullif(trim(case when p_partkey % 5 = 0 then ' ' else p_type end), '') b, p_brand c from part) select p_partkey, coalesce(a, b) question, case when p_partkey % 7 = 0 then null else c end answer, case when coalesce(a, b) is null or p_partkey % 7 = 0 then 'missing_qa' end error from q")
def p03_routed(t):
    rows = t.part.select("p_partkey", F.when(F.col("p_partkey") % 3 != 0, F.col("p_name")).alias("q1"), F.when(F.col("p_partkey") % 5 == 0, " ").otherwise(F.col("p_type")).alias("q2"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_brand")).alias("a1"))
    return shape.routed(rows, {"question": ["q1", "q2"], "answer": ["a1"]}).select("p_partkey", "question", "answer", "error")


@query("select case o_orderpriority when '1-URGENT' then 'v1' when '2-HIGH' then 'v1' when '3-MEDIUM' then 'v2' else 'rest' end as version, count(*) n from orders group by 1")
def p08_labelled(t):
    rows = shape.labelled_by(t.orders, "o_orderpriority", {"1-URGENT": "v1", "2-HIGH": "v1", "3-MEDIUM": "v2"}, "version", "rest")
    return rows.groupBy("version").agg(F.count(F.lit(1)).alias("n"))


@query("select p_partkey, lower(p_name) || ': ' || p_type prompt, p_brand target from part where p_size > 20")
def p11_transform_hook(t):
    spec = EvalSpec("named", lambda: F.concat(F.lower("p_name"), F.lit(": "), "p_type"), lambda: F.col("p_brand"), process_docs=lambda df: df.where("p_size > 20"))
    return spec.docs(t.part).select("p_partkey", "prompt", "target")


@query("select s_suppkey, place from (select s_suppkey, row_number() over (order by s_acctbal, s_suppkey) - 1 place from supplier) where place >= 3 and place < 9")
def p12_sliced(t):
    return shape.sliced(curate.positions(t.supplier.select("s_acctbal", "s_suppkey"), ["s_acctbal", "s_suppkey"], "place"), "place", 3, 9).select("s_suppkey", "place")


@query(f"with u as (select p_partkey, p_type x, substr({md5(3, 'p_partkey')}, 1, 8) d from part) select p_partkey, case when ends_with(x, 'BRASS') then case when d < '80000000' then substr(x, 1, length(x) - 5) else x end when ends_with(x, 'S') then case when d < '40000000' then substr(x, 1, length(x) - 1) else x end when ends_with(x, 'L') then case when d < 'c0000000' then substr(x, 1, length(x) - 1) else x end else x end prompt from u")
def p19_suffixes(t):
    prompt = shape.without_suffix(F.col("p_type"), shape.draw(3, "p_partkey"), [("BRASS", 0.5), ("S", 0.25), ("L", 1.0)], 0.75)
    return t.part.select("p_partkey", prompt.alias("prompt"))


@query(f"""with s as (select s_suppkey k, s_name x, row_number() over (order by {md5(5, 's_suppkey')}, s_suppkey) - 1 place from supplier), n as (select count(*) n from s),
d as (select s_suppkey k, unnest(range(0, 4)) j, ('0x' || substr({md5(6, 's_suppkey')}, 1, 12))::bigint % n.n start, n.n n from supplier, n),
m as (select d.k, j, x, row_number() over (partition by d.k order by j) r from d join s on s.place = (d.start + d.j) % d.n where s.k <> d.k)
select k s_suppkey, string_agg(x, ' | ' order by j) context from m where r <= 3 group by 1""")
def p20_few_shot(t):
    return shape.few_shot(t.supplier, t.supplier, "s_suppkey", "s_name", 3, 5, " | ").select("s_suppkey", "context")


@query(f"with o as (select p_partkey, p_brand, unnest([p_brand, p_type, p_name, 'none']) o, unnest([0, 1, 2, 3]) i from part), r as (select *, row_number() over (partition by p_partkey order by {md5(9, 'p_partkey', 'i')}) r from o), l as (select p_partkey, p_brand, list(o order by r) o from r group by 1, 2) select p_partkey, o[1] first, o[4] last, chr(cast(64 + list_position(o, p_brand) as int)) letter from l")
def p24_shuffled_options(t):
    rows = t.part.select("p_partkey", "p_brand", F.array("p_brand", "p_type", "p_name", F.lit("none")).alias("options"))
    out = shape.shuffled_options(rows, "p_partkey", "options", F.col("p_brand"), 9)
    return out.select("p_partkey", F.get("options", 0).alias("first"), F.get("options", 3).alias("last"), "letter")


@query("select event_type, count(*) n, round(avg(value), 6) mean from events where event_type in ('click', 'view', 'purchase') group by 1")
def p28_by_category(t):
    kept = t.events.where(F.col("event_type").isin("click", "view", "purchase"))
    return kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("with n as (select c_nationkey k, avg(c_acctbal) v from customer where c_custkey % 2 = 1 group by 1), o as (select c_nationkey k, avg(c_acctbal) v from customer where c_custkey % 2 = 0 group by 1) select o.k, round(o.v, 4) old, round(n.v, 4) new, round(n.v - o.v, 4) delta from o join n on o.k = n.k order by delta desc, k")
def o01_changes(t):
    side = lambda odd: t.customer.where(F.col("c_custkey") % 2 == odd).groupBy(F.col("c_nationkey").alias("k")).agg(F.avg("c_acctbal").alias("v"))
    return shape.changes(side(0), side(1), "k", "v").select("k", *[F.round(c, 4).alias(c) for c in ("old", "new", "delta")])


@query("select o_orderkey, place from (select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) - 1 place from orders) where place >= 100 and place < 150 and (place - 100) % 5 = 2")
def o03_head_and_skip(t):
    placed = curate.positions(t.orders.select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"], "place")
    return curate.indexed(placed, "place", 100, 50, 5, 2).select("o_orderkey", "place")


@query(f"select c_custkey from customer order by {md5(11, 'c_custkey')}, c_custkey limit 25")
def o04_seeded_sample(t):
    return shape.sampled(t.customer, "c_custkey", 25, 11).select("c_custkey")


GRAMS = "select p_partkey, k, substr(s, i, k) g, count(*) n from (select p_partkey, s, unnest(range(1, 7)) k from {0}), range(1, 200) r(i) where i + k - 1 <= length(s) group by 1, 2, 3"


@query(f"""with a as (select p_partkey, regexp_replace(p_name, '\\s', '', 'g') s from part), b as (select p_partkey, regexp_replace(lower(p_type), '\\s', '', 'g') s from part),
x as ({GRAMS.format('a')}), y as ({GRAMS.format('b')}),
j as (select coalesce(x.k, y.k) k, sum(least(coalesce(x.n, 0), coalesce(y.n, 0))) m, sum(x.n) p, sum(y.n) r from x full join y on x.p_partkey = y.p_partkey and x.k = y.k and x.g = y.g group by 1),
v as (select avg(m / p) p, avg(m / r) r from j where p > 0 and r > 0) select round(100 * 5 * p * r / (4 * p + r), 6) chrf from v""")
def a10_chrf(t):
    return shape.char_fscore(t.part.withColumn("p_type", F.lower("p_type")), "p_partkey", "p_name", "p_type").select(F.round("chrf", 6).alias("chrf"))


WORDS = "list_filter(string_split(lower(text), ' '), lambda w: w <> '')"


@query(f"""with d as (select conv_id, max(case when turn = 0 then text end) q, max(case when turn = 1 then text end) a from conversations group by 1),
u as (select conv_id, 0 side, {WORDS.replace('text', 'q')} w from d union all select conv_id, 1, {WORDS.replace('text', 'a')} from d),
g as (select conv_id, side, w[i] || chr(10) || w[i + 1] g, count(*) n from (select conv_id, side, w, unnest(range(1, len(w))) i from u) group by 1, 2, 3),
j as (select conv_id, g, sum(n) filter (side = 0) p, sum(n) filter (side = 1) r from g group by 1, 2),
s as (select conv_id, sum(least(coalesce(p, 0), coalesce(r, 0))) m, sum(coalesce(p, 0) + coalesce(r, 0)) t from j group by 1)
select d.conv_id, round(coalesce(2.0 * m / t, 0)::double, 6) rouge from d left join s on d.conv_id = s.conv_id""")
def a11_rouge(t):
    side = lambda k: F.max(F.when(F.col("turn") == k, F.col("text")))
    rows = t.conversations.groupBy("conv_id").agg(side(0).alias("q"), side(1).alias("a"))
    tokens = lambda c: F.filter(F.split(F.lower(c), " "), lambda w: w != "")
    return shape.rouge_n(rows, "conv_id", tokens("q"), tokens("a"), 2).withColumn("rouge", F.round("rouge", 6))


SPOKEN = f"""d as (select conv_id, turn, row_number() over (partition by conv_id order by turn) - 1 i, {WORDS} w from conversations), g as (select conv_id, w from d where i = 0), r as (select conv_id, turn, w from d where i > 0)"""


def spoken(t):
    """A conversation's first turn is the guess; the later ones are its references."""
    first = F.min("turn").over(Window.partitionBy("conv_id"))
    rows = t.conversations.select("conv_id", "turn", F.expr("filter(split(lower(text), ' '), w -> w <> '')").alias("w"), (F.col("turn") == first).alias("lead"))
    return rows.where("lead").select("conv_id", "w"), rows.where("not lead").select("conv_id", "turn", "w")


@query(f"""with {SPOKEN}, s as (select conv_id, -1 turn, w from g union all select conv_id, turn, w from r),
n as (select conv_id, turn, k, array_to_string(w[i:i + k - 1], chr(10)) x, count(*) n from (select conv_id, turn, w, k, unnest(range(1, len(w) - k + 2)) i from s, range(1, 5) t(k) where len(w) >= k) group by all),
f as (select k, x, count(distinct conv_id) df from n where turn >= 0 group by all),
v as (select conv_id, turn, k, x, n, n * ((select ln(count(*)) from g) - ln(coalesce(df, 1))) w from n left join f using (k, x)),
m as (select conv_id, turn, k, sqrt(sum(w * w)) z from v group by all), l as (select conv_id, turn, coalesce(sum(n) filter (k = 2), 0) b from n group by all),
p as (select a.conv_id, b.turn, a.k, sum(least(a.w, b.w) * b.w) dot from v a join v b on a.turn = -1 and b.turn >= 0 and a.conv_id = b.conv_id and a.k = b.k and a.x = b.x group by all),
q as (select p.conv_id, sum(dot / (h.z * o.z) * exp(-(y.b - c.b) * (y.b - c.b) / 72.0)) / 4 s from p join m h on h.conv_id = p.conv_id and h.turn = -1 and h.k = p.k join m o on o.conv_id = p.conv_id and o.turn = p.turn and o.k = p.k join l y on y.conv_id = p.conv_id and y.turn = -1 join l c on c.conv_id = p.conv_id and c.turn = p.turn where h.z > 0 and o.z > 0 group by 1)
select g.conv_id, round(coalesce(10 * s / (select count(*) from r where r.conv_id = g.conv_id), 0), 6) cider from g left join q on q.conv_id = g.conv_id""")
def a11_cider(t):
    guesses, references = spoken(t)
    return captions.consensus(guesses, references, "conv_id", "w", "turn").withColumn("cider", F.round("cider", 6))


@query(f"""with recursive {SPOKEN}, p as (select g.conv_id, r.turn, len(g.w) h, len(r.w) o, list_filter(g.w, lambda x: list_contains(r.w, x)) a, list_filter(r.w, lambda x: list_contains(g.w, x)) b from g join r on r.conv_id = g.conv_id),
t as (select conv_id, turn, 0 i, list_transform(range(0, len(b) + 1), lambda x: 0) e from p
  union all select p.conv_id, p.turn, t.i + 1, list_transform(range(1, len(b) + 2), lambda j: list_max(list_transform(range(1, j + 1), lambda k: case when k > 1 and b[k - 1] = a[t.i + 1] then e[k - 1] + 1 else e[k] end))) from t join p on p.conv_id = t.conv_id and p.turn = t.turn where t.i < len(a)),
m as (select p.conv_id, max(e[-1] / nullif(h, 0)) pr, max(e[-1] / nullif(o, 0)) re from p join t on p.conv_id = t.conv_id and p.turn = t.turn and t.i = len(a) group by 1)
select g.conv_id, round(case when pr > 0 and re > 0 then 2.44 * pr * re / (re + 1.44 * pr) else 0 end, 6) rouge from g left join m on m.conv_id = g.conv_id""")
def a11_rouge_l(t):
    guesses, references = spoken(t)
    rows = guesses.join(references.groupBy("conv_id").agg(F.collect_list("w").alias("refs")), "conv_id", "left")
    return rows.select("conv_id", F.round(captions.rouge_l(F.col("w"), F.col("refs")), 6).alias("rouge"))


@query()
def f30_filled_blanks(t):
    """The first sentence of a conversation's next turn as the blank; no SQL: a test compares runs with the matcher called one by one."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = t.conversations.select("conv_id", "turn", F.col("text").alias("response"), F.substring_index(F.lead("text").over(w), ".", 1).alias("gold"))
    scored = captions.filled_blanks(rows, "response", "gold")
    return scored.select("conv_id", "turn", "found", *[F.round(c, 6).alias(c) for c in ("similarity", "precision", "recall", "f1", "jaccard", "rouge1", "exact_match")])


AREAS = {"1-URGENT": "soon", "2-HIGH": "soon", "3-MEDIUM": "later", "4-NOT SPECIFIED": "later"}


@query(f"with c as (select case o_orderpriority {' '.join(f'when {chr(39)}{k}{chr(39)} then {chr(39)}{v}{chr(39)}' for k, v in AREAS.items())} end area, o_orderpriority, avg(o_totalprice) s from orders group by 1, 2), a as (select area, avg(s) score from c where area is not null group by 1) select area, round(score, 4) score from a union all select null, round(avg(score), 4) from a")
def a34_area_averages(t):
    return shape.area_averages(t.orders, "o_orderpriority", "o_totalprice", AREAS).withColumn("score", F.round("score", 4))


@query("""with q as (select l_orderkey, bool_and(l_quantity > 10) filter (l_linenumber = 1) a, bool_and(l_quantity > 10) filter (l_linenumber = 2) b, bool_and(l_quantity > 10) filter (l_linenumber = 3) c, bool_and(l_quantity > 10) filter (l_linenumber = 4) d from lineitem where l_linenumber <= 4 group by 1 having count(*) = 4),
e as (select unnest([o_orderpriority, o_orderstatus, null]) category, a and b t, c and d v from q join orders on o_orderkey = l_orderkey)
select category, round(avg(t::int), 6) as "text", round(avg(v::int), 6) video, round(avg((t and v)::int), 6) "group" from e group by 1""")
def a40_matrix(t):
    cell = F.element_at(F.array(*map(F.lit, ("pos_text", "neg_text", "pos_video", "neg_video"))), F.col("l_linenumber").cast("int"))
    rows = t.lineitem.where("l_linenumber <= 4").select("l_orderkey", cell.alias("cell"), (F.col("l_quantity") > 10).alias("hit"))
    full = rows.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")).where("n = 4").select("l_orderkey")
    named = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.array("o_orderpriority", "o_orderstatus").alias("cats"))
    out = shape.matrix_scores(rows.join(full, "l_orderkey", "left_semi").join(named, "l_orderkey"), "l_orderkey", "cell", "hit", "cats")
    return out.select("category", *[F.round(c, 6).alias(c) for c in ("text", "video", "group")])


@query("with r as (select p_brand m, 1000 + avg(p_size) * 10 s from part group by 1) select x.m a, y.m b, round(1 / (1 + pow(10, (y.s - x.s) / 400)), 8) p from r x join r y on x.m <> y.m")
def a49_win_rates(t):
    ratings = t.part.groupBy(F.col("p_brand").alias("m")).agg((1000 + F.avg("p_size") * 10).alias("s"))
    return shape.win_rates(ratings, "m", "s").withColumn("p", F.round("p", 8))


@query("select l_orderkey, round(avg(l_discount), 8) l_discount, max(l_linenumber) l_linenumber, sum(l_quantity) l_quantity from lineitem group by 1")
def a60_combined(t):
    return shape.combined(t.lineitem, "l_orderkey", ["l_discount"], ["l_linenumber"], ["l_quantity"]).withColumn("l_discount", F.round("l_discount", 8))


@query("select event_type, round(avg(value), 8) mean from events where value > 1 group by 1")
def a61_mean_length(t):
    rows = t.events.select("event_type", F.when(F.col("value") > 1, F.col("value")).alias("seconds"))
    return shape.spread_means(rows, "event_type", "seconds").withColumn("mean", F.round("mean", 8))


@query("with r as (select o_orderpriority t, unnest(['n', 'mean', 'alias']) m, unnest([cast(count(*) as varchar), cast(cast(max(o_orderkey) as double) as varchar), 'task ' || o_orderpriority]) v from orders group by 1) select t || '/' || m as name, try_cast(v as double) as value, case when try_cast(v as double) is null then v end as \"text\" from r")
def f47_flat_results(t):
    one = t.orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).cast("string").alias("n"), F.max("o_orderkey").cast("double").cast("string").alias("mean"))
    rows = one.select("o_orderpriority", F.create_map(F.lit("n"), "n", F.lit("mean"), "mean", F.lit("alias"), F.concat(F.lit("task "), "o_orderpriority")).alias("metrics"))
    return shape.flat_results(rows, "o_orderpriority", "metrics")


@query("select p_partkey, case when p_size % 2 = 0 then 'choice' else 'text' end kind, p_name as data, case when p_size % 2 = 0 then p_brand || ', ' || p_type end choices, case when p_size % 2 = 1 then p_type end raw, p_brand labels from part")
def f48_report_rows(t):
    rows = t.part.withColumn("kind", F.when(F.col("p_size") % 2 == 0, "choice").otherwise("text"))
    name, brand = lambda: F.col("p_name"), lambda: F.col("p_brand")
    views = {"choice": {"data": name, "choices": lambda: F.concat_ws(", ", "p_brand", "p_type"), "labels": brand}, "text": {"data": name, "raw": lambda: F.col("p_type"), "labels": brand}}
    return shape.report_rows(rows, "p_partkey", "kind", views).select("p_partkey", "kind", "data", "choices", "raw", "labels")


def brand_spec(**more):
    return EvalSpec("brand", lambda: F.concat("p_name", F.lit("?")), lambda: F.col("p_brand"), lambda: F.array("p_brand", "p_type"), **more)


@query("select p_partkey, p_name || '?' request, p_brand target from part")
def x04_task_columns(t):
    return brand_spec().docs(t.part).select("p_partkey", F.col("prompt").alias("request"), "target")


@query("select p_partkey, idx, p_name || '?' request, case idx when 0 then p_brand else p_type end continuation from part, (values (0), (1)) v(idx)")
def x05_requests(t):
    return brand_spec().requests(t.part, "p_partkey")


@query("with s as (select cast(p_brand = 'Brand#' || (1 + p_partkey % 5) || (1 + p_partkey % 5) as double) s from part) select count(*) n, round(100 * avg(s), 6) percent from s")
def x06_aggregate_with_arguments(t):
    spec = brand_spec(metrics={"percent": lambda c, scale, digits: F.round(scale * F.avg(c), digits)}, arguments={"percent": {"scale": 100, "digits": 6}})
    digit = (1 + F.col("p_partkey") % 5).cast("string")
    return spec.aggregate(spec.results(t.part, "p_partkey", lambda: F.concat(F.lit("Brand#"), digit, digit)))


@query("select p_partkey, p_type response, p_brand target, cast(null as double) score from part")
def x07_bypass(t):
    return brand_spec(predict_only=True).results(t.part, "p_partkey", lambda: F.col("p_type"))
