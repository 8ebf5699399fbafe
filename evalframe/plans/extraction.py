"""Answer extraction and comparison over texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalframe.functions import choices
from evalframe.functions import text as T
from evalframe.plans.base import query


@query(r"select conv_id, turn, coalesce(nullif(trim(regexp_extract_all(text, '([A-Z][a-z]+)', 1)[1]), ''), '[invalid]') first_word, coalesce(nullif(regexp_extract_all(text, '([0-9]+)', 1)[-1], ''), '[invalid]') last_number from conversations")
def f02_regex_filter(t):
    c = F.col("text")
    return t.conversations.select("conv_id", "turn", T.regex_pick(c, "([A-Z][a-z]+)").alias("first_word"), T.regex_pick(c, "([0-9]+)", 1, -1).alias("last_number"))


@query("select conv_id, turn, lower(regexp_replace(text, '^ ', '')) as folded, coalesce(map_extract(map {'user': 'U', 'assistant': 'A'}, role)[1], '?') as who from conversations")
def f06_filter_pipeline(t):
    return t.conversations.select("conv_id", "turn", T.pipeline(F.col("text"), [T.drop_leading_blank, F.lower]).alias("folded"), T.mapped(F.col("role"), {"user": "U", "assistant": "A"}, "?").alias("who"))


@query("select l_orderkey, l_linenumber, abs(l_extendedprice - l_quantity * 1500) / abs(l_quantity * 1500) <= 0.05 relaxed from lineitem")
def f24_relaxed_equality(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", T.relaxed_equal(F.col("l_extendedprice").cast("string"), (F.col("l_quantity") * 1500).cast("string")).alias("relaxed"))


@query("select l_orderkey, l_linenumber, round(len(list_filter([0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05], lambda x: abs(l_extendedprice - l_quantity * 1500) / abs(l_quantity * 1500) <= x)) / 10, 6) mra from lineitem")
def f25_mean_relative_accuracy(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(T.mean_relative_accuracy(F.col("l_extendedprice"), F.col("l_quantity") * 1500), 6).alias("mra"))


@query("with p as (select p_partkey, list_filter(string_split(lower(p_name), ' '), lambda x: x <> '') a, list_filter(string_split(lower(p_type), ' '), lambda x: x <> '') b from part) select p_partkey, round(case when len(list_distinct(list_concat(a, b))) = 0 then 1 else len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) end, 6) jaccard from p")
def u04_set_scores(t):
    ws = lambda c: T.words(F.lower(c))
    return t.part.select("p_partkey", F.round(T.set_scores(ws("p_name"), ws("p_type"))["jaccard"], 6).alias("jaccard"))


@query("select conv_id, sha256(string_agg(role || text, '' order by turn)) h from conversations group by 1")
def f36_stable_hash(t):
    rows = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", "text").alias("s"))))
    return t.conversations.groupBy("conv_id").agg(F.sha2(F.array_join(rows["s"], ""), 256).alias("h"))


@query("""with r as (select vec_id, ['a', 'bbb', 'cc', 'dddddd'] ch, list_transform(embedding[1:8], lambda x: abs(cast(x as double))) l, vec_id % 2 = 0 two, vec_id % 6 g from embeddings),
o as (select vec_id, ch, two, g, case when two then [l[1], l[3], l[5], l[7]] else l[1:4] end c, case when two then [l[1] - l[2], l[3] - l[4], l[5] - l[6], l[7] - l[8]] end d from r),
p as (select *, list_position(c, list_min(c)) - 1 pred, list_transform([1, 2, 3, 4], lambda i: c[i] / length(ch[i])) n from o)
select vec_id, cast(pred as int) pred, cast(list_position(n, list_min(n)) - 1 as int) pred_norm, case when pred = g then 1.0::double else 0 end acc, case when list_position(n, list_min(n)) - 1 = g then 1.0::double else 0 end acc_norm,
cast(g < 4 and coalesce(c[g + 1] < 0.1, false) as int) exact_match, case when two then case when list_position(d, list_max(d)) - 1 = g then 1.0::double else 0 end end acc_mutual, g >= 4 gold_missing from p""")
def f37_choice_by_loss(t):
    """Eight losses of a vector: four choices with and without their question in even rows, four choices alone in odd ones."""
    ch = F.array(*map(F.lit, ("a", "bbb", "cc", "dddddd")))
    every = F.expr("transform(slice(embedding, 1, if(vec_id % 2 = 0, 8, 4)), x -> abs(double(x)))")
    own = F.expr("transform(filter(slice(embedding, 1, if(vec_id % 2 = 0, 8, 4)), (x, i) -> vec_id % 2 = 1 or i % 2 = 0), x -> abs(x) < 0.1D)")
    scored = choices.choice_by_loss(every, ch, choices.gold_places(ch, F.col("vec_id") % 6, "place"), own)
    return t.embeddings.select("vec_id", scored.alias("s")).select("vec_id", "s.*")


@query("select page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) host, case when contains(lower(html), 'news') then 'news' when contains(lower(html), 'blog') then 'blog' else 'other' end as subject, length(regexp_extract(html, '<title>(.*?)</title>', 1)) title_length from pages")
def f34_page_subjects(t):
    return t.pages.select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), T.first_listed(F.col("html"), ["news", "blog"], "other").alias("subject"), F.length(F.regexp_extract("html", "<title>(.*?)</title>", 1)).cast("long").alias("title_length"))


@query("select p_partkey, case when contains(p_name, p_brand) then p_name else p_name || ' ' || p_brand end as named, p_name || chr(10) || 'A. ' || p_brand || chr(10) || 'B. ' || p_type as prompt from part")
def p18_prompts(t):
    return t.part.select("p_partkey", F.when(F.contains("p_name", "p_brand"), F.col("p_name")).otherwise(F.concat_ws(" ", "p_name", "p_brand")).alias("named"), T.option_prompt(F.col("p_name"), F.array("p_brand", "p_type")).alias("prompt"))


@query("select doc_id, length(text) chars, strlen(text) bytes, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) words from documents")
def f39_text_sizes(t):
    return t.documents.select("doc_id", F.length("text").cast("long").alias("chars"), F.octet_length("text").cast("long").alias("bytes"), F.size(F.filter(F.split("text", r"\s+"), lambda x: x != "")).cast("long").alias("words"))


@query("select event_id, json_extract_string(props, '$.k') k from events")
def f49_json_fields(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query()
def f20_soft_accuracy(t):
    answers = t.events.groupBy("user_id").agg(F.collect_list("event_type").alias("all"), F.max_by("event_type", "event_id").alias("last"))
    return answers.select("user_id", F.round(T.soft_accuracy(F.col("all"), F.col("last")), 6).alias("score"))


@query()
def f17_numbers(t):
    return t.documents.select("doc_id", T.numbers(F.col("text")).alias("numbers"))
