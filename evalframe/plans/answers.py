"""Parsing of answers and judgements, boxes and budgets: row-local expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalframe.functions import text as T
from evalframe.plans.base import query


def turns(t, **columns):
    return t.conversations.select("conv_id", "turn", *[c.alias(k) for k, c in columns.items()])


@query("select conv_id, turn, upper(replace(regexp_replace(text, '^ ', ''), 'ß', 'SS')) as folded, coalesce(map_extract(map {'user': 'question', 'assistant': 'answer'}, role)[1], 'other') as kind from conversations")
def f05_case_and_map(t):
    return turns(t, folded=F.upper(T.drop_leading_blank(F.col("text"))), kind=T.mapped(F.col("role"), {"user": "question", "assistant": "answer"}, "other"))


@query("select p_partkey, rtrim(replace(p_name, p_brand, '')) || ' Answer in one word.' question from part")
def f10_rewritten_question(t):
    return t.part.select("p_partkey", F.concat(F.rtrim(F.replace("p_name", F.col("p_brand"), F.lit(""))), F.lit(" Answer in one word.")).alias("question"))


@query(r"select conv_id, turn, case when regexp_matches(text, '^[0-9]+$') then 'number' when regexp_extract(text, '\(([A-F])\)', 1) <> '' then 'letter' when lower(text) = 'ok' then 'exact' else 'pending' end as rule from conversations")
def f11_rule_cascade(t):
    rule = F.when(F.rlike(F.col("text"), F.lit("^[0-9]+$")), "number").when(F.regexp_extract(F.col("text"), r"\(([A-F])\)", 1) != "", "letter").when(F.lower(F.col("text")) == "ok", "exact").otherwise("pending")
    return turns(t, rule=rule)


@query("select p_partkey, levenshtein(p_name, p_type) d, case when p_type = '' or lower(p_type) = 'none' then 0.0 else round(1 - levenshtein(lower(trim(p_name)), lower(trim(p_type))) / greatest(length(trim(p_name)), length(trim(p_type)), 1), 9) end score from part")
def f23_edit_similarity(t):
    a, b = F.lower(F.trim("p_name")), F.lower(F.trim("p_type"))
    score = F.round(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1)), 9)
    return t.part.select("p_partkey", F.levenshtein("p_name", "p_type").cast("long").alias("d"), F.when((b == "") | (b == "none"), 0.0).otherwise(score).alias("score"))


BOXES = "select l_orderkey, l_linenumber, l_quantity x, l_linenumber * 5.0 y, 20.0 as a, 10.0 as b from lineitem"


@query(f"with r as ({BOXES}), o as (select *, greatest(0, least(x + 10, a + 15) - greatest(x, a)) * greatest(0, least(y + 10, b + 15) - greatest(y, b)) shared from r) select l_orderkey, l_linenumber, round(shared / (325 - shared), 6) iou, shared / (325 - shared) >= 0.3 hit, x + 5 between a and a + 15 and y + 5 between b and b + 15 as centre from o")
def f27_box_overlap(t):
    x, y = F.col("l_quantity"), F.col("l_linenumber") * F.lit(5.0)
    side = lambda p, g: F.greatest(F.lit(0.0), F.least(p + 10, F.lit(g + 15)) - F.greatest(p, F.lit(g)))
    both = side(x, 20.0) * side(y, 10.0)
    iou = both / (325 - both)
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(iou, 6).alias("iou"), (iou >= 0.3).alias("hit"), ((x + 5).between(20, 35) & (y + 5).between(10, 25)).alias("centre"))


@query("select l_orderkey, l_linenumber, round(greatest(0, least(l_quantity + 10, 30) - greatest(l_quantity, 15)) / (greatest(l_quantity + 10, 30) - least(l_quantity, 15) + 1e-8), 6) iou from lineitem")
def f29_segment_overlap(t):
    q = F.col("l_quantity")
    both = F.greatest(F.lit(0.0), F.least(q + 10, F.lit(30.0)) - F.greatest(q, F.lit(15.0)))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(both / (F.greatest(q + 10, F.lit(30.0)) - F.least(q, F.lit(15.0)) + 1e-8), 6).alias("iou"))


@query("select conv_id, turn, greatest(0.0, least(5.0, coalesce(try_cast(regexp_extract(text, '[0-9]+', 0) as double), 0.0))) as clamped, list_transform(regexp_extract_all(string_split(text, chr(10))[1], '[0-9]+')[1:2], lambda x: try_cast(x as double))[1] as one from conversations")
def f31_judge_scores(t):
    first = F.regexp_extract(F.col("text"), "[0-9]+", 0).try_cast("double")
    line = F.element_at(F.split(F.col("text"), "\n"), 1)
    pair = F.slice(F.regexp_extract_all(line, F.lit("[0-9]+"), F.lit(0)), 1, 2)
    return turns(t, clamped=F.greatest(F.lit(0.0), F.least(F.lit(5.0), F.coalesce(first, F.lit(0.0)))), one=F.try_element_at(pair, F.lit(1)).try_cast("double"))


@query("select p_partkey, 'Question: ' || p_name || chr(10) || 'Ground truth: ' || p_brand || chr(10) || 'Answer: ' || p_type || chr(10) || 'Reply 1 or 0.' prompt from part")
def f32_judge_prompt(t):
    return t.part.select("p_partkey", F.format_string("Question: %s\nGround truth: %s\nAnswer: %s\nReply 1 or 0.", "p_name", "p_brand", "p_type").alias("prompt"))


@query("select l_orderkey, bool_or(l_quantity > 45) any_hit, case when bool_or(l_quantity > 45) then 1::double else 0::double end score from lineitem group by 1")
def f38_any_target(t):
    hits = t.lineitem.groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("golds"))
    found = F.exists("golds", lambda q: q > 45)
    return hits.select("l_orderkey", found.alias("any_hit"), found.cast("double").alias("score"))


@query("select p_partkey, list_min(list_filter([8, 16, 32, 64], lambda x: x >= p_size)) tier, least(64, greatest(4, p_size * 2)) want from part")
def f42_crop_tier(t):
    tiers = F.array(*map(F.lit, (8, 16, 32, 64)))
    want = F.least(F.lit(64), F.greatest(F.lit(4), F.col("p_size") * 2))
    return t.part.select("p_partkey", F.array_min(F.filter(tiers, lambda x: x >= F.col("p_size"))).alias("tier"), want.alias("want"))


@query("with b as (select p_partkey, p_size * 4.0 lo, p_size * 4.0 + 12 hi from part), w as (select p_partkey, (lo + hi) / 2 - 14 a from b) select p_partkey, cast(least(greatest(a, 0), 172) as double) x1, cast(least(greatest(a, 0), 172) + 28 as double) x2 from w")
def f43_pixel_box(t):
    low = F.col("p_size") * 4.0 + 6 - 14
    x1 = F.least(F.greatest(low, F.lit(0.0)), F.lit(172.0))
    return t.part.select("p_partkey", x1.alias("x1"), (x1 + 28).alias("x2"))


@query("with c as (select vec_id, unnest(list_transform(embedding, lambda x: cast(x as double))) z from embeddings) select vec_id, round(avg(greatest(z, 0) - z * 0.5 + ln(1 + exp(-abs(z)))), 6) bce from c group by 1")
def f44_mean_map_loss(t):
    z = F.col("z")
    cells = t.embeddings.select("vec_id", F.explode(F.col("embedding").cast("array<double>")).alias("z"))
    return cells.groupBy("vec_id").agg(F.round(F.avg(F.greatest(z, F.lit(0.0)) - z * 0.5 + F.log1p(F.exp(-F.abs(z)))), 6).alias("bce"))


@query("select o_orderkey, round(o_totalprice + coalesce(x, 0), 4) total, round(coalesce(x, 0), 4) stage from orders left join (select l_orderkey, sum(l_quantity) x from lineitem where l_linenumber > 3 group by 1) on l_orderkey = o_orderkey")
def f45_missing_stage_is_zero(t):
    stage = t.lineitem.where("l_linenumber > 3").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("x"))
    x = F.coalesce("x", F.lit(0.0))
    return t.orders.join(stage, "o_orderkey", "left").select("o_orderkey", F.round(F.col("o_totalprice") + x, 4).alias("total"), F.round(x, 4).alias("stage"))


@query("select p_partkey, len(list_filter([p_brand, p_type, 'e'], lambda x: contains(lower(p_name), lower(x)))) > 0 hit from part")
def f51_any_gold_contained(t):
    golds = F.array(F.col("p_brand"), F.col("p_type"), F.lit("e"))
    return t.part.select("p_partkey", F.exists(golds, lambda g: F.contains(F.lower("p_name"), F.lower(g))).alias("hit"))


@query("with p as (select p_partkey, list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+|[#.,]')) a, list_distinct(regexp_extract_all(lower(p_type || ' ' || p_brand), '[a-z0-9]+|[#.,]')) b from part) select p_partkey, case when len(a) = 0 or len(b) = 0 then 0.0 else round(2.0 * len(list_intersect(a, b)) / (len(a) + len(b)), 6) end f1 from p")
def f53_set_token_f1(t):
    tokens = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+|[#.,]"), F.lit(0)))
    a, b = tokens(F.col("p_name")), tokens(F.concat_ws(" ", "p_type", "p_brand"))
    f1 = F.round(2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b)), 6)
    return t.part.select("p_partkey", F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(f1).alias("f1"))


@query("select o_orderkey, list_sort(list_distinct(list(l_returnflag))) = ['A', 'N'] exact, count(distinct l_returnflag) filter (l_returnflag in ('A', 'N')) tp, count(distinct l_returnflag) filter (l_returnflag not in ('A', 'N')) fp from orders join lineitem on o_orderkey = l_orderkey group by 1")
def f54_label_sets(t):
    gold = F.array(F.lit("A"), F.lit("N"))
    s = F.col("s")
    sets = t.orders.select(F.col("o_orderkey").alias("l_orderkey")).join(t.lineitem, "l_orderkey").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_set("l_returnflag")).alias("s"))
    return sets.select("o_orderkey", (s == gold).alias("exact"), F.size(F.array_intersect(s, gold)).cast("long").alias("tp"), F.size(F.array_except(s, gold)).cast("long").alias("fp"))


@query("select p_partkey, case when levenshtein(p_type, p_brand) <= levenshtein(p_type, p_name) then p_brand else p_name end as nearest from part")
def f56_nearest_option(t):
    options = F.transform(F.array("p_brand", "p_name"), lambda o, i: F.struct(F.levenshtein("p_type", o).alias("d"), i.alias("i"), o.alias("o")))
    return t.part.select("p_partkey", F.array_min(options)["o"].alias("nearest"))
