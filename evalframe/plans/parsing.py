"""Parsers of answers over made-up responses: every part becomes a response in one of twelve forms and a gold answer in one of four."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalframe.functions import text as T
from evalframe.plans.base import query

# One text for both engines.
LETTER = "chr(cast(65 + p_partkey % 7 as int))"
RESPONSE = f"""case p_partkey % 12
 when 0 then '(' || {LETTER} || ') ' || p_name when 1 then 'The best answer is ' || {LETTER} || '.' when 2 then lower({LETTER})
 when 3 then 'Answer: ' || {LETTER} || ') ' || p_name when 4 then 'x <answer> ' || {LETTER} || ' </answer> so Answer: Z' when 5 then p_name
 when 6 then ' Yes.' when 7 then 'n' when 8 then 'it''s -1,2' || p_partkey || '.50 of the two dont, (or) 3.5 a-b!'
 when 9 then '[1.5, 2, ' || p_partkey || ', 4] or (5, 6), (7, 8)' when 10 then '(1, 2), (3, ' || p_partkey || '.25)'
 else 'so ' || chr(92) || 'boxed{{' || chr(92) || 'frac{{1}}{{' || p_partkey || '}}}} then ' || chr(92) || 'boxed{{00' || p_partkey || '}}' end"""
GOLD = f"case p_partkey % 4 when 0 then {LETTER} || '. ' || p_brand when 1 then p_name when 2 then '' else '-12' || p_partkey || '.5' end"
QUESTION = "'Which? A. ' || p_brand || chr(10) || 'B. ' || p_type || chr(10) || 'C. ' || p_name || chr(10) || 'D. ' || p_brand"
ANSWERS = f"a as (select p_partkey, p_name, p_brand, p_type, {RESPONSE} resp, {GOLD} gold, {QUESTION} question from part)"


def answers(t):
    rows = t.part.selectExpr("p_partkey", "p_name", "p_brand", "p_type", f"{RESPONSE} as resp", f"{GOLD} as gold", f"{QUESTION} as question")
    return rows


def asked(t, **columns):
    return answers(t).select("p_partkey", *[c.alias(k) for k, c in columns.items()])


def picked(source: str, patterns: list[str]) -> str:
    return ", ".join(f"nullif(regexp_extract({source}, '{p}', 1), '')" for p in patterns)


@query(f"with {ANSWERS} select p_partkey, coalesce({picked('resp', [chr(92) + '(([A-Z])' + chr(92) + ')', '([A-Z])[.)' + chr(92) + 's]', '([A-Z])'])}, '') letter from a")
def f07_first_letter(t):
    return asked(t, letter=T.first_letter(F.col("resp")))


@query(rf"with {ANSWERS} select p_partkey, regexp_extract(trim(gold), '^[ (\[]*([A-F])($|[.)\]]|[:\-]\s+)', 1) letter from a")
def f08_gold_letter(t):
    return asked(t, letter=T.gold_letter(F.col("gold")))


SPAN = "trim(case when strpos(resp, '<answer>') > 0 and strpos(resp, '</answer>') > 0 then substr(resp, strpos(resp, '<answer>') + 8, greatest(strpos(resp, '</answer>') - strpos(resp, '<answer>') - 8, 0)) when strpos(resp, 'Answer:') > 0 then substr(resp, strpos(resp, 'Answer:')) else resp end)"


@query(f"with {ANSWERS} select p_partkey, {SPAN} span from a")
def f09_answer_span(t):
    return asked(t, span=T.answer_span(F.col("resp")))


@query(rf"with {ANSWERS}, n as (select p_partkey, trim(regexp_replace(lower(resp), '\s+', ' ', 'g')) r, trim(regexp_replace(lower(gold), '\s+', ' ', 'g')) g from a) select p_partkey, g <> '' and contains(r, g) hit from n")
def f12_containment(t):
    return asked(t, hit=T.contains_normalised(F.col("resp"), F.col("gold")))


SAID = "resp || case p_partkey % 5 when 0 then ' [[A>B]]' when 1 then ' [[A>B]] [[B>A]]' else '' end"
CASCADE = picked("u", [r"^([A-D])\s*[.)\]]*", r"(?:THE\s+)?(?:ANSWER|CHOICE|OPTION)(?:\s+IS)?[\s:]+([A-D])", r"\(([A-D])\)", r"([A-D])\s*(?:\.|\)|\])", r"(?:^|\s)([A-D])(?:\s|$)"])


@query(rf"""with {ANSWERS}, s as (select *, {SAID} said, upper(trim({SAID})) u from a),
e as (select *, string_split(said, chr(92) || 'boxed') p from s),
t as (select *, case when len(p) > 1 then string_split(p[-1], '') else [] end ch, contains(said, chr(92) || 'boxed ') spaced from e),
d as (select *, list_transform(ch, lambda x: case x when '{{' then 1 when '}}' then -1 else 0 end) step from t),
z as (select *, list_filter(range(1, len(ch) + 1), lambda i: ch[i] = '}}' and list_sum(step[1:i]) = 0)[1] fin from d),
b as (select *, case when spaced then string_split(string_split(said, chr(92) || 'boxed ')[-1], '$')[1] when fin is not null and ch[1] = '{{' then array_to_string(ch[2:fin - 1], '') end box, regexp_extract_all(said, '(?is)Answer\s*:\s*(.*)', 1) after, list_distinct(regexp_extract_all(said, '\[\[([AB<>=]+)\]\]', 1)) v from z),
f as (select *, coalesce(box, after[-1]) found from b)
select p_partkey, coalesce({CASCADE}, case when len(regexp_extract_all(u, '[A-D]')) = 1 then regexp_extract(u, '[A-D]') end, case when u[1] in ('A', 'B', 'C', 'D') then u[1] end) letter, {SPAN.replace("resp", "said")} span,
case when regexp_full_match(found, '[0-9]+') then regexp_replace(found, '^0+([0-9])', '\1') else found end boxed, case when len(v) = 1 then v[1] else 'unclear' end verdict from f""")
def f13_letter_cascade(t):
    said = F.expr(SAID)
    return asked(t, letter=T.letter_cascade(said), span=T.answer_span(said), boxed=T.last_boxed(said), verdict=T.pair_verdict(said))


JUDGED = "case p_partkey % 10 when 0 then 'so [[A>B]]' when 1 then '[[A>>B]] as [[A>>B]]' when 2 then '[[A=B]]' when 3 then 'B: [[B>A]]' when 4 then '[[B>>A]]' when 5 then '[[A>B]] or [[B>>A]]' when 6 then 'A=B I think' when 7 then '[[A<B]]' when 8 then '' else p_name end"


@query(rf"""with j as (select p_partkey, {JUDGED} t from part), l as (select p_partkey, t, list_distinct(regexp_extract_all(t, '\[\[([AB<>=]+)\]\]', 1)) v from j), s as (select p_partkey, case when len(v) = 1 then v[1] else t end s from l),
k as (select p_partkey, case when contains(s, 'A>B') then 1 when contains(s, 'A>>B') then 2 when contains(s, 'A=B') then 3 when contains(s, 'B>A') then 4 when contains(s, 'B>>A') then 5 else 6 end k from s)
select p_partkey, cast([-1, -2, 0, 1, 2, 0][k] as int) score, ['model_a', 'model_a', 'tie', 'model_b', 'model_b', 'tie'][k] winner, ['Worse', 'Worse++', 'Tie', 'Better', 'Better++', 'Unclear'][k] judgement from k""")
def f33_pair_outcome(t):
    return t.part.select("p_partkey", T.pair_outcome(F.expr(JUDGED)).alias("o")).select("p_partkey", "o.*")


ANSWER_FORMS = "case p_partkey % 9 when 0 then 'so (' || chr(cast(65 + p_partkey % 4 as int)) || ')' when 1 then 'it is ' || upper(p_type) || ', not ' || p_name when 2 then 'pick:  C or : B' when 3 then 'the NONE!' when 4 then '' when 5 then p_name || '?' when 6 then 'x: E' when 7 then p_brand || p_brand else 'a-' || p_type end"


@query(rf"""with a as (select p_partkey, {ANSWER_FORMS} resp, [p_brand || ' ', p_type, p_name, 'none.', p_brand] choices from part),
m as (select p_partkey, resp, regexp_replace(lower(resp), '[[:punct:]]', '', 'g') s, list_transform(choices, lambda x: regexp_replace(lower(trim(x)), '[[:punct:]]', '', 'g')) c from a),
h as (select *, list_sort(list_filter(list_transform([1, 2, 3, 4, 5], lambda i: {{'at': strpos(s, c[i]), 'i': i}}), lambda x: x.at > 0))[1].i i from m)
select p_partkey, coalesce(nullif(regexp_extract(resp, '\(([A-Z])\)', 1), ''), '(' || chr(64 + list_max(list_filter([1, 2, 3, 4, 5], lambda k: c[k] = c[i]))) || ')', '(' || nullif(regexp_extract(resp, ':\s*([A-E])', 1), '') || ')', '[invalid]') answer from h""")
def f03_choice_cascade(t):
    rows = t.part.selectExpr("p_partkey", f"{ANSWER_FORMS} as resp", "array(p_brand || ' ', p_type, p_name, 'none.', p_brand) as choices")
    return rows.select("p_partkey", T.choice_cascade(F.col("resp"), F.col("choices"), r"\(([A-Z])\)", fold_case=True, drop_marks=True).alias("answer"))


@query(rf"""with {ANSWERS}, n as (select p_partkey, p_partkey % 4 = 0 choice, trim(resp) r, trim(gold) g from a),
m as (select *, coalesce(nullif(upper(regexp_extract(r, '^[(\[]?([A-Da-d])[)\].:,]?(?:\s|$)', 1)), ''), nullif(regexp_extract(r, '\b([A-D])\b', 1), '')) l, nullif(regexp_extract(replace(r, ',', ''), '-?\d+\.?\d*'), '') rn, nullif(regexp_extract(replace(g, ',', ''), '-?\d+\.?\d*'), '') gn from n)
select p_partkey, case when coalesce(case when choice then l = upper(g) when gn is not null then cast(rn as double) = cast(gn as double) else rtrim(lower(r), '.') = lower(g) end, false) then 1.0::double else 0.0::double end score from m""")
def f14_first_number(t):
    return asked(t, score=T.short_score(F.col("resp"), F.col("gold"), F.col("p_partkey") % 4 == 0))


LEADS = "trim(resp)"
for lead in T.ANSWER_LEADS:
    LEADS = f"replace({LEADS}, '{lead}', '')"


@query(rf"""with {ANSWERS}, s as (select p_partkey, {LEADS} s from a)
select p_partkey, coalesce(nullif(regexp_extract(s, '[ABCDE]'), ''), case when len(list_filter(string_split_regex(s, '\s+'), lambda x: x <> '')) > 10 then '' when contains('(a)', lower(s)) then 'A' when contains('(b)', lower(s)) then 'B' when contains('(c)', lower(s)) then 'C' when contains('(d)', lower(s)) then 'D' when contains('(e)', lower(s)) then 'E' else '' end) letter from s""")
def f15_guarded_letter(t):
    return asked(t, letter=T.guarded_letter(F.col("resp")))


OPTIONS = "[p_brand, p_type, p_name, 'none']"
LETTERS = "['A', 'B', 'C', 'D']"


def last_of(where: str, part: str, spot: str) -> str:
    place = f"case when strpos({where}, {spot}) = 0 then 0 else length({where}) - strpos(reverse({where}), reverse({spot})) - length({spot}) + 2 end"
    return f"list_sort(list_filter(list_transform([1, 2, 3, 4], lambda i: {{'at': {place}, 'i': -i, 'x': l[i], 'met': contains({where}, {part})}}), lambda s: s.met), 'desc')[1].x"


STRIPPED = "resp"
for mark in ",.!?;:":
    STRIPPED = f"trim({STRIPPED}, '{mark}')"
STRIPPED = f"trim({STRIPPED}, chr(39))"


@query(rf"""with {ANSWERS}, s as (select p_partkey, ' ' || {STRIPPED} || ' ' r, lower(' ' || {STRIPPED} || ' ') f, {OPTIONS} o, {LETTERS} l from a)
select p_partkey, coalesce({last_of('r', "'(' || l[i] || ')'", "'(' || l[i] || ')'")}, {last_of('r', "l[i] || ' '", "' ' || l[i] || ' '")}, {last_of('r', "l[i] || '.'", "' ' || l[i] || ' '")},
case when len(list_filter(string_split_regex(r, '\s+'), lambda x: x <> '')) > 5 then {last_of('f', "lower(o[i])", "lower(o[i])")} end, l[('0x' || substr(md5(p_partkey || '#7'), 1, 8))::bigint % 4 + 1]) letter from s""")
def f16_parsed_option(t):
    options = F.array("p_brand", "p_type", "p_name", F.lit("none"))
    return asked(t, letter=T.parsed_option(F.col("resp"), options, "ABCD", F.col("p_partkey"), 7))


@query(f"with {ANSWERS}, s as (select p_partkey, replace(lower(trim(resp)), '.', '') s from a), h as (select p_partkey, case when length(s) = 1 then case s when 'y' then 'yes' when 'n' then 'no' else '' end else s[1:4] end h from s) select p_partkey, case when contains(h, 'yes') then 'yes' when contains(h, 'no') then 'no' else 'other' end as label from h")
def f18_yes_no(t):
    return asked(t, label=T.yes_no(F.col("resp")))


def literal(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def normal_sql(source: str) -> str:
    """CTEs n0, n1, n2 for the normal form of column `source` of table a."""
    plain = "x"
    for mark in T.ANSWER_PUNCTUATION:
        plain = f"replace({plain}, {literal(mark)}, case when contains(x, {literal(mark + ' ')}) or contains(x, {literal(' ' + mark)}) then '' else ' ' end)"
    pairs = lambda d: ", ".join(f"{literal(k)}: {literal(v)}" for k, v in d.items())
    numbers = {"none": "0", **{w: str(i) for i, w in enumerate(T.NUMBER_WORDS)}}
    # RE2 has no look-ahead: a stop before a digit is kept by a capture.
    return f"""n0 as (select p_partkey, trim(translate(trim(replace(replace(replace(lower({source}), ',', ''), '?', ''), '''s', ' ''s')), chr(10) || chr(9), '  ')) x from a),
n1 as (select p_partkey, regexp_replace(regexp_replace({plain}, '\\.([^0-9]|$)', '\\1', 'g'), '\\.([^0-9]|$)', '\\1', 'g') x from n0),
n2 as (select p_partkey, array_to_string(list_transform(list_filter(list_transform(list_filter(string_split_regex(lower(x), '\\s+'), lambda w: w <> ''), lambda w: coalesce(map_extract(map {{{pairs(numbers)}}}, w)[1], w)), lambda w: w not in ('a', 'an', 'the')), lambda w: coalesce(map_extract(map {{{pairs(T.CONTRACTIONS)}}}, w)[1], w)), ' ') answer from n1)"""


@query(f"with {ANSWERS}, {normal_sql('resp')} select * from n2")
def f19_normal_answer(t):
    return asked(t, answer=T.normal_answer(F.col("resp")))


FOLDED = "array_to_string(list_filter(string_split_regex(lower(trim({0})), '\\s+'), lambda x: x <> ''), ' ')"


@query(f"with {ANSWERS}, n as (select p_partkey, {FOLDED.format('resp')} r, {FOLDED.format('p_name')} g, greatest(length(resp), length(p_name), 1) m from a), s as (select p_partkey, levenshtein(r, g) d, 1 - levenshtein(r, g) / m v from n) select p_partkey, d, case when v < 0.5 then 0.0::double else round(v, 9) end anls from s")
def f22_anls(t):
    folded = lambda c: F.array_join(T.words(F.lower(T.strip(F.col(c)))), " ")
    return asked(t, d=F.levenshtein(folded("resp"), folded("p_name")).cast("long"), anls=F.round(T.anls(F.col("resp"), F.array("p_name")), 9))


TOKENS = r"list_filter(string_split_regex(regexp_replace(regexp_replace(lower({0}), '[!-/:-@\[-`{{-~]', '', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+'), lambda x: x <> '')"


@query(f"with {ANSWERS}, n as (select p_partkey, {TOKENS.format('resp')} p, {TOKENS.format('gold')} g from a) select p_partkey, round(case when len(p) + len(g) = 0 then 1.0::double else 2.0::double * coalesce(list_sum(list_transform(list_distinct(p), lambda w: least(len(list_filter(p, lambda x: x = w)), len(list_filter(g, lambda x: x = w))))), 0) / (len(p) + len(g)) end, 6) f1 from n")
def f26_token_f1(t):
    return asked(t, f1=F.round(T.token_f1(F.col("resp"), F.col("gold")), 6))


@query(rf"""with {ANSWERS}, s as (select p_partkey, gold, regexp_replace(resp, '[^\w\s]', '', 'g') c, list_transform(regexp_extract_all(question, '\b([A-Z])\.\s+([^\n]*)', 2), lambda x: trim(x)) o from a),
f as (select p_partkey, trim(c) c, o, list_sort(list_filter(list_transform(range(1, len(o) + 1), lambda i: {{'at': strpos(trim(c), o[i]), 'i': i, 'o': o[i]}}), lambda x: x.at > 0))[1].o first from s)
select p_partkey, case when first is null then c else chr(cast(64 + list_max(list_filter(range(1, len(o) + 1), lambda i: o[i] = first)) as int)) end letter from f""")
def f04_option_by_text(t):
    return asked(t, letter=T.option_by_text(F.col("resp"), F.col("question")))


@query(rf"""with {ANSWERS}, s as (select p_partkey, gold, p_name, trim(replace(resp, '*', '')) s from a),
p as (select *, regexp_full_match(s, '[A-Ea-e]') one, nullif(upper(regexp_extract(s, '(?i)Answer:\s*([A-E])\)?\.?\s*(.*)', 1)), '') m from s),
q as (select p_partkey, p_name, nullif(gold[1], '') gl, case when one then upper(s) else m end letter, case when one then '' when m is not null then trim(regexp_extract(s, '(?i)Answer:\s*([A-E])\)?\.?\s*(.*)', 2)) else s end as "text" from p)
select p_partkey, letter, "text", case when coalesce(case when gl is not null and letter is not null then gl = letter and ("text" = '' or lower("text") = lower(p_name)) else lower("text") = lower(p_name) end, false) then 1 else 0 end score from q""")
def f52_letter_and_text(t):
    own, gold = T.letter_and_text(F.col("resp")), T.nonempty(F.substring("gold", 1, 1))
    return asked(t, letter=own["letter"], text=own["text"], score=T.same_answer(F.col("resp"), gold, F.col("p_name")))


NUM = r"(-?\d+(?:\.\d+)?)"
FORMS = [r"\[\s*" + r",\s*".join([NUM] * 4) + r"\s*\]", r"\(\s*" + r",\s*".join([NUM] * 4) + r"\s*\)", r"\(\s*" + NUM + r",\s*" + NUM + r"\),\s*\(\s*" + NUM + r",\s*" + NUM + r"\)"]
CASES = " ".join(f"when regexp_matches(resp, '{p}') then [{', '.join(f'cast(regexp_extract(resp, {chr(39)}{p}{chr(39)}, {i}) as double)' for i in range(1, 5))}]" for p in FORMS)


@query(f"with {ANSWERS}, b as (select p_partkey, case {CASES} else [0.0::double, 0.0::double, 0.0::double, 0.0::double] end b from a) select p_partkey, b[1] x1, b[2] y1, b[3] x2, b[4] y2 from b")
def f55_four_numbers(t):
    box = T.four_numbers(F.col("resp"))
    return asked(t, x1=box[0], y1=box[1], x2=box[2], y2=box[3])


@query(f"with {ANSWERS} select p_partkey, case lower(trim(resp)) {' '.join(f'when {literal(w)} then {literal(str(i))}' for i, w in enumerate(T.NUMBER_WORDS))} else trim(resp) end digits from (select p_partkey, case p_partkey % 3 when 0 then 'Two' when 1 then 'TEN' else resp end resp from a)")
def f57_number_words(t):
    word = F.when(F.col("p_partkey") % 3 == 0, "Two").when(F.col("p_partkey") % 3 == 1, "TEN").otherwise(F.trim("resp"))
    return asked(t, digits=T.digits_for_words(word))


@query(r"with s as (select conv_id, turn, regexp_replace(text, '\s+', chr(10), 'g') x from conversations), l as (select conv_id, turn, x, string_split(x, chr(10)) l from s), v as (select conv_id, turn, [x, trim(array_to_string(l[2:], chr(10)), chr(10)), trim(array_to_string(l[:-2], chr(10)), chr(10)), trim(array_to_string(l[2:-2], chr(10)), chr(10))] v from l) select conv_id, turn, length(v[2]) no_first, length(v[3]) no_last, length(v[4]) inner_only, len(list_filter(v, lambda x: x <> '' and length(x) < 200)) > 0 short from v")
def f50_response_variants(t):
    rows = t.conversations.select("conv_id", "turn", F.regexp_replace("text", r"\s+", "\n").alias("x"))
    v = T.response_variants(F.col("x"))
    return rows.select("conv_id", "turn", F.length(v[1]).cast("long").alias("no_first"), F.length(v[2]).cast("long").alias("no_last"), F.length(v[3]).cast("long").alias("inner_only"), T.any_variant(F.col("x"), lambda x: F.length(x) < 200).alias("short"))


FILE = "'samples_' || replace(lower(p_brand), '#', '_') || '_2024-0' || (1 + p_partkey % 9) || '.jsonl'"
MODEL = "'org/' || p_brand || '/' || p_type || ':' || p_partkey"


@query(rf"with f as (select p_partkey, {FILE} f, {MODEL} m from part) select p_partkey, regexp_extract(f, '^[^_]*_(.*)_[^_]*$', 1) task, replace(regexp_extract(f, '([^_]*)$', 1), '.jsonl', '') stamp, regexp_replace(array_to_string(string_split(m, '/')[-2:], '/'), '[\"<>:/|\\?*\[\]]+', '__', 'g') model, regexp_replace(m, '\W', '_', 'g') safe from f")
def f35_file_names(t):
    rows = t.part.selectExpr("p_partkey", f"{FILE} as f", f"{MODEL} as m")
    return rows.select("p_partkey", T.file_task(F.col("f")).alias("task"), T.file_time(F.col("f")).alias("stamp"), T.safe_model_name(F.col("m")).alias("model"), T.safe_task_name(F.col("m")).alias("safe"))


@query(r"""with x as (select p_partkey, 'does n''t ( ' || p_name || ' ) , " ' || p_type || ' " .' x from part) select p_partkey, regexp_replace(replace(replace(replace(replace(replace(x, ' n''t', 'n''t'), ' )', ')'), '( ', '('), '" ', '"'), ' "', '"'), ' ([''.,])', '\1', 'g') as "text" from x""")
def f40_detokenised(t):
    raw = F.concat(F.lit("does n't ( "), "p_name", F.lit(' ) , " '), "p_type", F.lit(' " .'))
    return t.part.select("p_partkey", T.detokenised(raw).alias("text"))


@query("with s as (select p_partkey, p_partkey * 7 % 12000 n from part), g as (select p_partkey, least(greatest(1 + (n - 512) / 1536.0, 1), 2) a, case when n > 2048 then least(2 * sqrt(n / 2048.0), 4) else least(greatest(1 + (n - 512) / 1536.0, 1), 2) end w from s), k as (select *, greatest(3, cast(round_even(3 * w, 0) as int)) k from g) select p_partkey, round(cast(a as double), 9) sigma, round(w, 9) wide, k + case when k % 2 = 0 then 1 else 0 end kernel from k")
def f41_smoothing(t):
    n = F.col("p_partkey") * 7 % 12000
    wide = T.smoothing_sigma(n, True)
    return t.part.select("p_partkey", F.round(T.smoothing_sigma(n), 9).alias("sigma"), F.round(wide, 9).alias("wide"), T.kernel_size(wide).alias("kernel"))
