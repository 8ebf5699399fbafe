"""Judge replies, refinement outcomes, nested accuracies and record keys over rows made from the tables: every form of the input occurs."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalframe.functions import aggregates as A
from evalframe.functions import judging as J
from evalframe.operators import curate, rollup, shape
from evalframe.plans.base import query

# One text for both engines.
REPLY = """case p_partkey % 9 when 0 then '7.5 out of 10' when 1 then '-3; ' || p_size || chr(10) || '9' when 2 then chr(10) || ' ' || p_size || ',6.5 then 4'
 when 3 then ' Yes, it is 1' when 4 then 'no number' when 5 then 'x {"score": ' || p_size || ', "why": "a {b}"} y' when 6 then '{"score": }' when 7 then 'yesterday ' || p_partkey else '' end"""
LINE = "string_split(trim(r, ' ' || chr(10)), chr(10))[1]"
PAIR = f"regexp_extract_all({LINE}, '-?[0-9]+(?:[.][0-9]+)?')"


@query(f"""with a as (select p_partkey, {REPLY} r from part), f as (select *, try_cast(regexp_extract(r, '-?[0-9]+([.][0-9]+)?', 0) as double) x, {PAIR} two, try_cast(nullif(regexp_extract(r, '[{{].*[}}]', 0, 's'), '') as json) j from a)
 select p_partkey, case when contains(r, '1') then 1 else 0 end one, starts_with(lower(trim(r)), 'yes') yes, coalesce(x, 0.0) as number, case when x is null then 1.0 else greatest(1.0, least(x, 5.0)) end clamped,
 case when len(two) >= 2 then two[1]::double else -1.0 end a, case when len(two) >= 2 then two[2]::double else -1.0 end b, try_cast(j ->> 'score' as double) said from f""")
def f31_judge_replies(t):
    r = F.col("r")
    pair = J.score_pair(r)
    said = F.try_variant_get(J.json_block(r), "$.score", "double")
    return t.part.selectExpr("p_partkey", f"{REPLY} as r").select("p_partkey", J.binary_score(r).alias("one"), J.says_yes(r).alias("yes"), J.score_in(r).alias("number"), J.score_in(r, 1, 5).alias("clamped"), pair[0].alias("a"), pair[1].alias("b"), said.alias("said"))


PROMPT = "case p_partkey % 3 when 0 then '<image>' else '' end || p_name || ' Select from the following choices.' || case p_partkey % 4 when 0 then '  ' || chr(10) else '' end"


@query(f"with a as (select p_partkey, p_partkey % 2 = 0 v, replace({PROMPT}, '<image>', '') q from part) select p_partkey, case when v then rtrim(replace(q, ' Select from the following choices.', ''), ' ' || chr(10)) || chr(10) || 'Answer with the option''s letter from the given choices directly.' else q end question from a")
def f10_judge_question(t):
    rows = t.part.selectExpr("p_partkey", "case when p_partkey % 2 = 0 then 'letters' else 'words' end as bench", f"{PROMPT} as prompt")
    return rows.select("p_partkey", J.question_for_judge(F.col("prompt"), F.col("bench"), ["letters"]).alias("question"))


KIND = "case p_partkey % 3 when 0 then 'mcq' when 1 then 'zoom' else 'open' end"
TOLD = "case p_partkey % 4 when 0 then '(B) ' || p_brand when 1 then p_brand when 2 then cast(p_size as varchar(9)) || '.0' else '' end"
SAYS = "case p_partkey % 5 when 0 then 'so <answer> (B) it is</answer>' when 1 then 'It is ' || lower(p_brand) when 2 then 'Answer: C' when 3 then ' ' || cast(p_size as varchar(9)) || ' ' else p_brand end"
SPAN = "trim(case when strpos(s, '<answer>') > 0 then substr(s, strpos(s, '<answer>') + 8, strpos(s, '</answer>') - strpos(s, '<answer>') - 8) else s end)"
LETTERS = ["[(]([A-Z])[)]", "([A-Z])[.)[:space:]]", "([A-Z])"]


@query(f"""with a as (select p_partkey, {KIND} k, {TOLD} g, {SAYS} s from part), b as (select *, {SPAN} x from a),
 c as (select *, regexp_extract(g, '^[ (]*([A-F])($|[.)])', 1) gl, coalesce({", ".join(f"nullif(regexp_extract(x, '{p}', 1), '')" for p in LETTERS)}, '') al from b)
 select p_partkey, case when g <> '' and lower(x) = lower(g) or try_cast(x as double) = try_cast(g as double) then 'equal' when k <> 'open' and gl <> '' and gl = al then 'first letter'
 when k = 'zoom' and gl = '' and g <> '' and contains(lower(x), lower(g)) then 'contained' else 'pending' end as rule from c""")
def f11_rule_sources(t):
    rows = t.part.selectExpr("p_partkey", f"{KIND} as k", f"{TOLD} as g", f"{SAYS} as s")
    return rows.select("p_partkey", J.rule_source(F.col("k"), F.col("g"), F.col("s")).alias("rule"))


CATEGORY = "case p_partkey % 5 when 0 then 'Person/Attribute/Color' when 1 then 'person/attribute/size' when 2 then 'Vehicle/Attribute' when 3 then 'OCR' else 'ocr' end"
CHOSEN = "case p_partkey % 7 when 0 then 'E' when 1 then 'b' when 2 then 'The answer is (B)' when 3 then null else 'C' end"


@query(f"""with a as (select p_brand task, p_type subtask, lower({CATEGORY}) c, {CHOSEN} p from part), b as (select task, subtask, case when contains(c, 'attribute') then split_part(c, '/', 1) || '/attribute' else c end category, case when contains(lower(p), 'b') then 1 else 0 end ok, case when p = 'E' then 1 else 0 end e from a)
 select cast(3 - grouping(task) - grouping(subtask) - grouping(category) as int) as level, task, subtask, category, count(*) n, cast(sum(ok) as bigint) hits, cast(sum(e) as bigint) abstained, sum(ok) * 1.0 / count(*) accuracy from b group by rollup (task, subtask, category)""")
def a28_nested_accuracy(t):
    rows = t.part.selectExpr("p_brand", "p_type", f"{CATEGORY} as c", f"{CHOSEN} as p")
    return rollup.nested_accuracy(rows, F.col("p_brand"), F.col("p_type"), F.col("c"), F.col("p"), F.lit("B"))


OUTCOME = "case o_orderkey % 7 when 0 then 'Refinement Failure' when 1 then 'Error Detection Success' when 2 then 'Error Correction Success' when 3 then 'Refinement Success' when 4 then 'False Error Detection' when 5 then 'Validation Success' else null end"
LABEL = "case when o_orderkey % 7 in (4, 5) then 'correct' else 'incorrect' end"


def outcome_share(name: str, of: str) -> str:
    return f"case when count(*) filter (o = '{name}') = 0 then 0.0 else count(*) filter (o = '{name}') * 1.0 / nullif(count(*) filter (l = '{of}'), 0) end"


@query(f"""with a as (select o_orderpriority, {OUTCOME} o, {LABEL} l from orders), s as (select o_orderpriority, {outcome_share('Refinement Failure', 'incorrect')} failure, {outcome_share('Error Detection Success', 'incorrect')} d, {outcome_share('Error Correction Success', 'incorrect')} c,
 {outcome_share('Refinement Success', 'incorrect')} success, {outcome_share('False Error Detection', 'correct')} false_detection, {outcome_share('Validation Success', 'correct')} validation from a group by 1)
 select o_orderpriority, failure, d + c + success detection, c + success correction, success, false_detection, validation, success - false_detection ref_score, (d + c + success + 1 - false_detection) / 2 recall from s""")
def a43_refinement_scores(t):
    rows = t.orders.selectExpr("o_orderpriority", f"{OUTCOME} as o", f"{LABEL} as l")
    return rollup.refinement_scores(rows, ["o_orderpriority"], F.col("o"), F.col("l"))


METRICS = "'acc,none', case when c_acctbal > 4000 then 1e0 else 0e0 end, 'acc_norm,none', case when c_acctbal > 2000 then 1e0 else 0e0 end, 'f1,first', c_acctbal"


@query(f"""with recursive e as (select 'world' p, 'r' || n_regionkey c from nation union select 'r' || n_regionkey, 'n' || n_nationkey from nation), x as (select p a, c d from e union select x.a, e.c from x join e on x.d = e.p),
 m as (select c_nationkey k, 'acc,none' metric, case when c_acctbal > 4000 then 1.0 else 0.0 end v from customer union all select c_nationkey, 'acc_norm,none', case when c_acctbal > 2000 then 1.0 else 0.0 end from customer),
 r as (select 'n' || k node, metric, avg(v) v, case when k <> 3 or metric <> 'acc,none' then stddev_samp(v) / sqrt(count(*)) end se, count(*) n from m group by k, metric)
 select a ancestor, metric, round(case when metric = 'acc,none' then sum(v * n) / sum(n) else avg(v) end, 6) as value, round(case when count(se) = count(*) then sqrt(sum((n - 1) * se * se * n) / (sum(n) - count(se)) / sum(n)) end, 6) stderr, cast(sum(n) as bigint) n from x join r on x.d = r.node group by 1, 2""")
def a20_group_metrics(t):
    """`acc` weighs by size; `norm`, which comes later, holds for acc_norm and doesn't; f1 isn't asked for. One nation's acc has no error."""
    n = t.nation
    region, leaf = F.concat(F.lit("r"), "n_regionkey"), F.concat(F.lit("n"), "n_nationkey")
    edges = n.select(F.lit("world").alias("p"), region.alias("c")).union(n.select(region, leaf)).distinct()
    rows = t.customer.selectExpr("c_nationkey", f"stack(3, {METRICS}) as (metric, v)")
    known = (F.col("c_nationkey") != 3) | (F.col("metric") != "acc,none")
    leaves = rows.groupBy("c_nationkey", "metric").agg(F.avg("v").alias("value"), A.stderr(F.col("v")).alias("se"), F.count("v").alias("n"))
    leaves = leaves.select(F.concat(F.lit("n"), "c_nationkey").alias("node"), "metric", "value", F.when(known, F.col("se")).alias("stderr"), "n")
    found = rollup.consolidate_metrics(leaves, rollup.closure(edges, "p", "c"), [("acc", True), ("norm", False)])
    return found.select("ancestor", "metric", F.round("value", 6).alias("value"), F.round("stderr", 6).alias("stderr"), "n")


RECORD = "source as dataset, '{folder}/' || cast(doc_id % 97 as varchar(9)) || '.jpg' as image, {blank} || lang || {blank} as question"
POOL, SAID = RECORD.format(folder="pool/a", blank="''"), RECORD.format(folder="said", blank="' '")


@query(f"""with p as (select doc_id, {POOL} from documents), s as (select *, parse_filename(image) i, trim(question) q from (select doc_id, n_chars, doc_id % 3 as file, {SAID} from documents where doc_id % 5 <> 0)),
 f as (select dataset, i, q, min({{'file': file, 'line': doc_id, 'v': n_chars}}).v v from s group by 1, 2, 3) select doc_id, v n_chars, f.q is null missed from p left join f on p.dataset is not distinct from f.dataset and parse_filename(p.image) = f.i and trim(p.question) = f.q""")
def j01_record_responses(t):
    pool = t.documents.selectExpr("doc_id", *POOL.split(", "))
    said = t.documents.where("doc_id % 5 <> 0").selectExpr("doc_id as line", "doc_id % 3 as file", "n_chars", *SAID.split(", "))
    met, missed = curate.with_responses(pool, said, ["file", "line"], "n_chars")
    return met.select("doc_id", "n_chars", F.lit(False).alias("missed")).union(missed.select("doc_id", F.lit(None), F.lit(True)))


@query("select user_id, event_type, count(*) n from events group by 1, 2 having count(*) > 1")
def a63_repeated_keys(t):
    return curate.duplicates(t.events, ["user_id", "event_type"])


BATTLES = "p_brand as b, case p_partkey % 4 when 0 then 'model_a' when 1 then 'model_b' when 2 then 'tie' else null end as winner, case p_partkey % 7 when 0 then 'Better++' when 1 then 'Better' when 2 then 'Tie' when 3 then 'Worse' when 4 then 'Worse++' when 5 then 'Unclear' else null end as judgement"


@query(f"""with p as (select 'base' a, {BATTLES} from part) select b model, 'model_b' as side, count(*) n, round(100.0 * count(*) filter (winner = 'model_b') / count(*), 6) rate from p group by 1
 union all select a, 'model_a', count(*), round(100.0 * count(*) filter (winner = 'model_a') / count(*), 6) from p group by 1""")
def a49_battle_rates(t):
    battles = t.part.selectExpr("'base' as a", *BATTLES.split(", "))
    return shape.battle_rates(battles, "a", "b", "winner").select("model", "side", "n", F.round("rate", 6).alias("rate"))


SHARES = ", ".join(f"coalesce(round(100.0 * count(*) filter (judgement = '{label}') / nullif(count(judgement), 0), 6), 0.0) {name}" for label, name in shape.JUDGEMENTS.items())


@query(f"with p as (select {BATTLES} from part) select b, {SHARES} from p group by 1")
def a49_verdict_shares(t):
    rows = shape.verdict_shares(t.part.selectExpr(*BATTLES.split(", ")), ["b"], "judgement")
    return rows.select("b", *[F.round(c, 6).alias(c) for c in shape.JUDGEMENTS.values()])
