"""Aggregations over row scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalframe.functions import aggregates as A
from evalframe.functions import text as T
from evalframe.operators import ngrams, resampling, rollup, stats
from evalframe.plans.base import query


@query("""select event_type as key, cast(grouping(event_type) as int) overall, round(100 * avg(case when value > 5 then 1.0 else 0 end), 6) accuracy,
round(100 * stddev_samp(case when value > 5 then 1.0 else 0 end) / sqrt(count(*)), 6) stderr, count(*) n from events group by grouping sets ((event_type), ())""")
def a23_accuracy_by_category(t):
    return rollup.micro(t.events, "event_type", F.when(F.col("value") > 5, 1.0).otherwise(0.0)).withColumn("accuracy", F.round("accuracy", 6)).withColumn("stderr", F.round("stderr", 6))


@query("select round(avg(m), 6) score from (select event_type, avg(case when value > 5 then 1.0 else 0 end) m from events group by 1)")
def a24_macro_average(t):
    return rollup.macro(t.events, ["event_type"], F.when(F.col("value") > 5, 1.0).otherwise(0.0)).select(F.round("score", 6).alias("score"))


@query("select event_type, round(avg(value), 6) mean, round(exp(-avg(value / 100)), 6) perplexity, round(exp(-sum(value) / sum(value + 1)), 6) weighted_perplexity, round(stddev_pop(value), 6) pop, round(stddev_samp(value) / sqrt(count(value)), 6) stderr, round(quantile_cont(value, 0.5), 6) median from events group by 1")
def a01_means_and_deviations(t):
    v = F.col("value")
    parts = {"mean": A.mean(v), "perplexity": A.perplexity(v / 100), "weighted_perplexity": A.weighted_perplexity(v, v + 1), "pop": F.stddev_pop(v), "stderr": A.stderr(v), "median": F.percentile(v, F.lit(0.5))}
    return t.events.groupBy("event_type").agg(*[F.round(c, 6).alias(k) for k, c in parts.items()])


@query("select user_id, list(value order by event_id)[cast(floor(count(*) / 2) as int) + 1] middle from events group by 1")
def a02_middle_of_unsorted(t):
    return t.events.groupBy("user_id").agg(A.middle(F.col("value"), F.col("event_id")).alias("middle"))


@query("select lang, round(-(sum(-n_chars / 10.0) / sum(strlen(text))) / ln(2), 6) bits from documents group by 1")
def a05_bits_per_byte(t):
    return t.documents.groupBy("lang").agg(F.round(A.bits_per_byte(-F.col("n_chars") / 10, F.col("text")), 6).alias("bits"))


YES = "with r as (select d.lang, d.n_chars >= 1000 p, l.quality = 1 g, l.toxic = 1 x from labels l join documents d on l.doc_id = d.doc_id), c as (select lang, count(*) filter (p and g) tp, count(*) filter (p and not g) fp, count(*) filter (not p and g) fn, count(*) filter (not p and not g) tn from r group by 1)"


def judged(t):
    return t.labels.join(t.documents.select("doc_id", "lang", "n_chars"), "doc_id").select("lang", (F.col("n_chars") >= 1000).alias("p"), (F.col("quality") == 1).alias("g"))


@query(YES + "select lang, round(2.0 * tp / (2 * tp + fp + fn), 6) f1, round(case when (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 then 0 else (tp * tn - fp * fn) / sqrt(cast(tp + fp as double) * (tp + fn) * (tn + fp) * (tn + fn)) end, 6) matthews from c")
def a06_f1_and_matthews(t):
    return judged(t).groupBy("lang").agg(F.round(A.f1(F.col("p"), F.col("g")), 6).alias("f1"), F.round(A.matthews(F.col("p"), F.col("g")), 6).alias("matthews"))


@query(YES + "select round(sum(tp) * 1.0 / sum(tp + fp), 6) as precision, round(sum(tp) * 1.0 / sum(tp + fn), 6) recall, round(sum(tp + tn) * 1.0 / sum(tp + fp + fn + tn), 6) accuracy, round(sum(tp + fn) * 1.0 / sum(tp + fp + fn + tn), 6) gold_yes_ratio from c")
def a41_yes_no_scores(t):
    c = A.counts(F.col("p"), F.col("g"))
    every = c["tp"] + c["fp"] + c["fn"] + c["tn"]
    parts = {"precision": c["tp"] / (c["tp"] + c["fp"]), "recall": c["tp"] / (c["tp"] + c["fn"]), "accuracy": (c["tp"] + c["tn"]) / every, "gold_yes_ratio": (c["tp"] + c["fn"]) / every}
    return judged(t).agg(*[F.round(v, 6).alias(k) for k, v in parts.items()])


@query(YES + "select round(avg(tp / (tp + fp + 1e-8)), 6) macro_precision, round(avg(tp / (tp + fn + 1e-8)), 6) macro_recall, round(sum(tp) / (sum(tp) + sum(fp) + 1e-8), 6) micro_precision, round(sum(tp) / (sum(tp) + sum(fn) + 1e-8), 6) micro_recall from c")
def a42_micro_macro_precision(t):
    c = judged(t).groupBy("lang").agg(*[v.alias(k) for k, v in A.counts(F.col("p"), F.col("g")).items()])
    one = lambda a, b: F.avg(F.col(a) / (F.col(a) + F.col(b) + 1e-8))
    whole = lambda a, b: F.sum(a) / (F.sum(a) + F.sum(b) + 1e-8)
    return c.agg(F.round(one("tp", "fp"), 6).alias("macro_precision"), F.round(one("tp", "fn"), 6).alias("macro_recall"), F.round(whole("tp", "fp"), 6).alias("micro_precision"), F.round(whole("tp", "fn"), 6).alias("micro_recall"))


@query("with c as (select l_returnflag g, l_linestatus p, count(*) n from lineitem group by 1, 2), x as (select case g when 'N' then 'O' else 'F' end gold, p, n from c), k as (select gold, p, sum(n) n from x group by 1, 2), s as (select sum(n) s, sum(n) filter (gold = p) c from k), a as (select sum(pk * tk) pt from (select v, coalesce(p.n, 0) pk, coalesce(t.n, 0) tk from (select distinct gold v from k union select distinct p from k) u left join (select p, sum(n) n from k group by 1) p on p.p = v left join (select gold, sum(n) n from k group by 1) t on t.gold = v)), b as (select sum(n * n) pp from (select p, sum(n) n from k group by 1)), d as (select sum(n * n) tt from (select gold, sum(n) n from k group by 1)) select round((cast(c as double) * s - pt) / sqrt((cast(s as double) * s - pp) * (cast(s as double) * s - tt)), 6) matthews from s, a, b, d")
def a07_multiclass_matthews(t):
    rows = t.lineitem.select(F.when(F.col("l_returnflag") == "N", "O").otherwise("F").alias("gold"), F.col("l_linestatus").alias("pred"))
    return stats.matthews_many(rows, "pred", "gold").select(F.round("matthews", 6).alias("matthews"))


@query("select event_type, round(avg((least(value, 10) / 10 - (case when event_id % 2 = 0 then 1 else 0 end)) ** 2 + (1 - least(value, 10) / 10 - (case when event_id % 2 = 1 then 1 else 0 end)) ** 2), 6) brier from events group by 1")
def a08_brier(t):
    p = F.least("value", F.lit(10.0)) / 10
    return t.events.groupBy("event_type").agg(F.round(F.avg(A.brier(F.array(p, 1 - p), (F.col("event_id") % 2).cast("int"))), 6).alias("brier"))


@query("select round(avg(case when ok then 1.0 else 0 end), 6) accuracy, count(*) as groups from (select l_orderkey, bool_and(l_quantity > 5) ok from lineitem group by 1)")
def a13_all_correct(t):
    return rollup.consistent(t.lineitem, ["l_orderkey"], F.col("l_quantity") > 5).withColumn("accuracy", F.round("accuracy", 6))


@query("with g as (select c_nationkey k, stddev_samp(c_acctbal) / sqrt(count(*)) se, count(*) n, avg(c_acctbal) m from customer group by 1) select round(sqrt(sum((n - 1) * se * se * n) / (sum(n) - count(*)) / sum(n)), 6) pooled, round(sum(m * n) / sum(n), 6) weighted from g")
def a17_pooled_stderr(t):
    g = t.customer.groupBy("c_nationkey").agg(A.stderr(F.col("c_acctbal")).alias("se"), F.count("c_acctbal").alias("n"), F.avg("c_acctbal").alias("m"))
    return g.agg(F.round(A.pooled_stderr(F.col("se"), F.col("n")), 6).alias("pooled"), F.round(A.weighted_mean(F.col("m"), F.col("n")), 6).alias("weighted"))


@query()
def a18_combined_stderr(t):
    g = t.customer.groupBy("c_nationkey").agg(A.stderr(F.col("c_acctbal")).alias("se"), F.count("c_acctbal").alias("n"), F.avg("c_acctbal").alias("m"))
    return g.agg(F.round(A.combined_stderr(F.col("m"), F.col("se"), F.col("n"), F.col("c_nationkey")), 6).alias("combined"))


@query()
def a15_bootstrap_stderr(t):
    """No SQL: a test compares the errors with the closed form of a mean."""
    return resampling.bootstrap(t.events, "event_type", ["value"], F.col("value") / F.col("n"), resampling.rounds_of("accuracy", 2000))


@query("select event_type, i as round, count(*) n, cast(count(*) as double) drawn from events, range(1, 101) r(i) where value is not null group by 1, 2")
def a16_resample_sizes(t):
    """Rounds of a corpus score, of which a hundred are enough: each draws as many rows as there are."""
    rows = t.events.withColumn("drawn", F.when(F.col("value").isNotNull(), 1.0))
    return resampling.resampled(rows, "event_type", ["value", "drawn"], resampling.rounds_of("bleu", 100_000)).select("event_type", "round", "n", "drawn")


@query("with recursive e as (select 'world' p, 'r' || n_regionkey c from nation union select 'r' || n_regionkey, 'n' || n_nationkey from nation), x as (select p a, c d from e union select x.a, e.c from x join e on x.d = e.p), r as (select 'n' || c_nationkey node, avg(c_acctbal) v, stddev_samp(c_acctbal) / sqrt(count(*)) se, count(*) n from customer group by 1) select a ancestor, round(sum(v * n) / sum(n), 6) weighted, round(avg(v), 6) plain, round(case when count(se) = count(*) then sqrt(sum((n - 1) * se * se * n) / (sum(n) - count(se)) / sum(n)) end, 6) stderr, cast(sum(n) as bigint) n from x join r on x.d = r.node group by 1")
def a20_group_consolidation(t):
    n = t.nation
    region, leaf = F.concat(F.lit("r"), "n_regionkey"), F.concat(F.lit("n"), "n_nationkey")
    edges = n.select(F.lit("world").alias("p"), region.alias("c")).union(n.select(region, leaf)).distinct()
    leaves = t.customer.groupBy(F.concat(F.lit("n"), "c_nationkey").alias("node")).agg(F.avg("c_acctbal").alias("value"), A.stderr(F.col("c_acctbal")).alias("stderr"), F.count("c_acctbal").alias("n"))
    found = rollup.consolidate(leaves, rollup.closure(edges, "p", "c"))
    return found.select("ancestor", F.round("weighted", 6).alias("weighted"), F.round("plain", 6).alias("plain"), F.round("stderr", 6).alias("stderr"), "n")


@query("select o_orderpriority k, case when count(distinct o_orderstatus = 'F') = 1 then bool_and(o_orderstatus = 'F') end higher, count(*) original, least(100, count(*)) effective from orders group by 1")
def a21_agreement_and_counts(t):
    h = F.col("o_orderstatus") == "F"
    return t.orders.groupBy(F.col("o_orderpriority").alias("k")).agg(F.when(F.count_distinct(h) == 1, F.bool_and(h)).alias("higher"), F.count(F.lit(1)).alias("original"), F.least(F.lit(100), F.count(F.lit(1))).alias("effective"))


@query("with w as (select doc_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') ws from documents), g as (select distinct doc_id, array_to_string(ws[i:i + 7], ' ') s from (select doc_id, ws, unnest(range(1, len(ws) - 6)) i from w where len(ws) >= 8)), b as (select distinct item_id, array_to_string(ws[i:i + 7], ' ') s from (select item_id, ws, unnest(range(1, len(ws) - 6)) i from (select item_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') ws from benchmark) where len(ws) >= 8)) select doc_id, count(distinct s) hits from g semi join b using (s) group by 1")
def j19_contaminated_documents(t):
    return ngrams.contaminated(t.documents, "doc_id", t.benchmark, 8)


@query("select o_orderpriority k, round(100.0 * sum(levenshtein(o_orderstatus || o_orderpriority, o_orderpriority || o_orderstatus)) / sum(length(o_orderpriority || o_orderstatus)), 6) cer from orders group by 1")
def a50_character_error_rate(t):
    ref, hyp = F.concat("o_orderpriority", "o_orderstatus"), F.concat("o_orderstatus", "o_orderpriority")
    return t.orders.groupBy(F.col("o_orderpriority").alias("k")).agg(F.round(100 * F.sum(F.levenshtein(hyp, ref)) / F.sum(F.length(ref)), 6).alias("cer"))


@query()
def a50_word_error_rate(t):
    """No SQL: a test compares distances with a sequential table."""
    rows = stats.turn_pairs(t.conversations)
    return rows.groupBy("role").agg(F.round(100 * F.sum(stats.word_distance(F.col("prev"), F.col("text"))) / F.sum(F.size(T.words(F.col("prev")))), 6).alias("wer"))


@query()
def a09_bleu_of_turns(t):
    return ngrams.bleu(stats.turn_pairs(t.conversations), "role", "text", "prev")


@query("select round(1 - 1 / (1 + 10 ** (400 * log10((sum(w) / count(*)) / (1 - sum(w) / count(*))) / 400)) , 6) wins, round(1000 + 400 * log10((sum(w) / count(*)) / (1 - sum(w) / count(*))), 4) rating from (select case o_orderstatus when 'F' then 1.0 when 'O' then 0.0 else 0.5 end w from orders)")
def a48_rating_of_two(t):
    return stats.two_player_rating(t.orders, F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "O", 0.0).otherwise(0.5))


@query()
def a48_bradley_terry(t):
    return stats.bradley_terry(stats.battles(t.orders), "a", "b", "w", "1-URGENT")


@query("with e as (select cast(vec_id as bigint) v, label, list_transform(embedding, lambda x: cast(x as double)) e from embeddings), c as (select label, i, avg(x) m from (select label, unnest(range(1, len(e) + 1)) i, unnest(e) x from e) group by 1, 2), d as (select v, e.label, sum(x * m) dot, sqrt(sum(x * x)) a, sqrt(sum(m * m)) b from (select v, label, unnest(range(1, len(e) + 1)) i, unnest(e) x from e) e join c on e.label = c.label and e.i = c.i group by 1, 2) select label, round(100 * avg(dot / (a * b)), 5) cosine from d group by 1")
def a64_cosine_to_centroid(t):
    return stats.cosine_to_centroid(t.embeddings)


@query("with a as (select c_custkey // 1000 k, count(*) n, sha256(string_agg('sample_' || c_custkey || sha256(c_name), '' order by c_custkey)) s from customer group by 1), b as (select k // 1000 k, sum(n) n, sha256(string_agg(s, '' order by k)) s from a group by 1) select '0' z, cast(sum(n) as bigint) n, sha256(string_agg(s, '' order by k)) fingerprint from b")
def a62_task_fingerprint(t):
    part = F.concat(F.lit("sample_"), "c_custkey", F.sha2("c_name", 256))
    return stats.fingerprint(t.customer, "c_custkey", part).select(F.lit("0").alias("z"), "n", "fingerprint")


@query("select event_type, quantile_cont(value, 0.75) cut, count(*) n from events group by 1")
def a52_quantile_cut(t):
    return t.events.groupBy("event_type").agg(F.percentile("value", F.lit(0.75)).alias("cut"), F.count(F.lit(1)).alias("n"))


@query("select user_id, round(sum(value) / nullif(sum(event_id % 7 + 1), 0), 6) throughput, round(avg(value / (event_id % 7 + 1)), 6) per_row from events group by 1")
def a57_throughput(t):
    latency = F.col("event_id") % 7 + 1
    return t.events.groupBy("user_id").agg(F.round(F.sum("value") / F.nullif(F.sum(latency), F.lit(0)), 6).alias("throughput"), F.round(F.avg(F.col("value") / latency), 6).alias("per_row"))


@query("select event_type, min(value) lo, max(value) hi, count(*) filter (value <> floor(value)) frac, count(distinct user_id) users, count(*) - count(distinct user_id) dup from events group by 1")
def a54_distributions(t):
    v = F.col("value")
    return t.events.groupBy("event_type").agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count_if(v != F.floor(v)).alias("frac"), F.count_distinct("user_id").alias("users"), (F.count(F.lit(1)) - F.count_distinct("user_id")).alias("dup"))
