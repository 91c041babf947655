"""Queries on replies, dialogs, gates and budgets, registered with the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers, text
from ..operators import evals, guard, logs, ranking
from .catalogue import DECIMALS, QRELS, _qrels, bm25_sql, bm25_topk, query

#: Replies of a judge made of the log: JSON, fenced JSON, words, and nothing.
REPLIES = """r as (select event_id, case event_id % 7 when 0 then '{"supported": ' || (value > 50)::varchar || '}' when 1 then '```json' || chr(10) || '{"answer": ' || value || ',}' || chr(10) || '```'
when 2 then 'Well.' || chr(10) || ' No, ' || event_type when 3 then 'yes: ' || event_type when 4 then 'It says {"result": "true"} here' when 5 then event_type else '{"relevant": ' || (value > 20)::varchar || ', "supported": null}' end as reply, value from events)"""


def _replies(t):
    n, value, kind = F.col("event_id") % 7, F.col("value"), F.col("event_type")
    said = F.when(n == 0, F.concat(F.lit('{"supported": '), (value > 50).cast("string"), F.lit("}")))
    said = said.when(n == 1, F.concat(F.lit('```json\n{"answer": '), value.cast("string"), F.lit(",}\n```")))
    said = said.when(n == 2, F.concat(F.lit("Well.\n No, "), kind)).when(n == 3, F.concat(F.lit("yes: "), kind)).when(n == 4, 'It says {"result": "true"} here').when(n == 5, kind)
    return t("events").select("event_id", said.otherwise(F.concat(F.lit('{"relevant": '), (value > 20).cast("string"), F.lit(', "supported": null}'))).alias("reply"))


@query(f"with {REPLIES} select event_id, case event_id % 7 when 0 then value > 50 when 1 then value > 0.5 when 2 then false when 3 then true when 4 then true when 6 then value > 20 end as verdict from r")
def reply_verdict(t):
    return _replies(t).select("event_id", answers.verdict(F.col("reply")).alias("verdict"))


@query(f"with {REPLIES} select event_id, case when event_id % 7 = 6 then (value > 20)::int::double end as grade from r")
def reply_grade(t):
    return _replies(t).select("event_id", answers.grade(F.col("reply")).alias("grade"))


@query("select event_id, (props->>'k')::bigint as k from events")
def json_rescue(t):
    reply = F.concat(F.lit("Here it is: "), F.regexp_replace("props", "}$", ", }"), F.lit(" - done"))
    return t("events").select("event_id", F.try_variant_get(answers.json_object(reply), "$.k", "bigint").alias("k"))


@query("select conv_id, turn, trim(text, chr(32) || chr(9) || chr(10) || chr(13)) as body from conversations where not contains(text, '【')")
def answer_section(t):
    whole = F.concat(F.lit("intro\n【结论】"), F.col("text"), F.lit("\n【依据】none"))
    return t("conversations").where(~F.contains("text", F.lit("【"))).select("conv_id", "turn", answers.section(whole, "结论", ["来源", "依据"]).alias("body"))


@query(r"""with l as (select conv_id, turn, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') as items from conversations)
select conv_id, turn, len(items)::int as n, md5(array_to_string(items, '|')) as digest from l""")
def numbered_items(t):
    parts = F.filter(F.transform(F.split("text", "\n"), F.trim), lambda x: x != "")
    written = F.array_join(F.transform(parts, lambda x, i: F.concat((i + 1).cast("string"), F.lit(") "), x)), "\n")
    return t("conversations").select("conv_id", "turn", answers.numbered_items(written).alias("x")).select("conv_id", "turn", F.size("x").alias("n"), F.md5(F.array_join("x", "|")).alias("digest"))


@query("select event_id, event_type as kind, props as value from events")
def line_values(t):
    reply = F.concat(F.lit("first\n Kind : "), F.col("event_type"), F.lit(" \nVALUE:"), F.col("props"))
    return t("events").select("event_id", answers.line_value(reply, "kind").alias("kind"), answers.line_value(reply, "value").alias("value"))


@query(r"""with l as (select conv_id, turn, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(trim(x), '^[0-9.\-、）):： ]+', '')), lambda x: length(x) >= 4)[:3] as found from conversations),
u as (select conv_id, turn, unnest([text] || found) as v, generate_subscripts([text] || found, 1) as i from l), d as (select conv_id, turn, v, min(i) as i from u group by all)
select conv_id, turn, count(*)::int as n, md5(string_agg(v, '|' order by i)) as digest from d group by all""")
def query_variants(t):
    asked = t("conversations").select("conv_id", "turn", answers.query_variants(F.col("text"), F.col("text"), 3).alias("v"))
    return asked.select("conv_id", "turn", F.size("v").alias("n"), F.md5(F.array_join("v", "|")).alias("digest"))


@query("select event_id, value as first, event_id::double as second, 2::int as n from events")
def relevance_scores(t):
    shown = F.concat(F.lit("[1] 相关度="), F.col("value").cast("string"), F.lit(" x\n[2] 相关度="), F.col("event_id").cast("string"), F.lit(" 相关度=. y"))
    found = t("events").select("event_id", answers.relevance_scores(shown).alias("s"))
    return found.select("event_id", F.get("s", F.lit(0)).alias("first"), F.get("s", F.lit(1)).alias("second"), F.size("s").alias("n"))


@query("select p_partkey, left(coalesce(nullif(trim(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'dataset'), 48) || '-' || left(sha256(p_name), 10) as slug, left(sha1(p_brand || '|' || p_size || '|sparse=' || (p_size > 20)::int), 12) as model from part")
def dataset_slugs(t):
    return t("part").select("p_partkey", answers.dataset_slug(F.col("p_name")).alias("slug"), answers.model_fingerprint(F.col("p_brand"), F.col("p_size"), F.col("p_size") > 20).alias("model"))


@query("""select doc_id, left(sha256(source || '#' || doc_id || '#' || left(text, 256)), 16) as generated,
case when doc_id % 3 = 0 then 'parent:' || source when doc_id % 3 = 1 then 'chunk:' || doc_id else 'orphan:' || sha1(source || '|' || n_chars || '|' || text) end as evidence from documents""")
def evidence_keys(t):
    n, source = F.col("doc_id") % 3, F.col("source")
    key = answers.evidence_key(F.when(n == 0, source), F.when(n < 2, F.col("doc_id")), source, F.col("n_chars"), F.col("text"))
    return t("documents").select("doc_id", answers.generated_id(source, F.col("doc_id"), F.col("text")).alias("generated"), key.alias("evidence"))


@query("""with m as (select *, row_number() over (partition by conv_id order by turn desc) as back from conversations)
select conv_id, md5(string_agg(case role when 'user' then '用户' when 'assistant' then '助手' else role end || ': ' || left(text, 150), chr(10) order by turn)) as digest from m where back <= 6 group by conv_id""")
def dialog_lines(t):
    names = {"user": answers.ROLES["human"], "assistant": answers.ROLES["ai"]}
    return answers.dialog(t("conversations"), "conv_id", "turn", "role", "text", names).select("conv_id", F.md5("dialog").alias("digest"))


# Metrics and gates.
@query(f"""with {QRELS}, lex as ({bm25_sql('')}), e as (select qid, count(distinct doc_id) as n from qrels group by qid), g as (select qid, count(*) as n from lex group by qid),
h as (select l.qid, max(1.0 / l.rank) as rr, sum(1 / log2(l.rank + 1)) as dcg from lex l semi join qrels q on q.qid = l.qid and q.doc_id = l.doc_id group by l.qid)
select e.qid, round(coalesce(rr, 0), 6)::double as rr, round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(e.n, g.n) + 1), lambda r: 1 / log2(r + 1))), 6)::double as ndcg from e join g using (qid) left join h using (qid)""")
def mrr_ndcg(t):
    ranked = bm25_topk(t).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("found"))
    rr, ndcg = evals.binary_ranked(F.col("expected"), F.col("found"))
    return _qrels(t).groupBy("qid").agg(F.collect_set("doc_id").alias("expected")).join(ranked, "qid").select("qid", F.round(rr, DECIMALS).alias("rr"), F.round(ndcg, DECIMALS).alias("ndcg"))


@query("""with x as (select l_orderkey as qid, l_suppkey as doc_id, row_number() over w - 1 as pos, count(*) over (partition by l_orderkey) as n, case when l_linenumber % 3 > 0 then l_discount end as given from lineitem window w as (partition by l_orderkey order by l_linenumber, l_suppkey, l_discount))
select qid, doc_id, coalesce(given, n - pos)::double as score from x qualify row_number() over (partition by qid, doc_id order by pos) = 1""")
def run_records(t):
    place = F.struct("l_linenumber", "l_suppkey", F.col("l_discount").cast("double").alias("given"))
    runs = t("lineitem").groupBy(F.col("l_orderkey").alias("qid")).agg(F.array_sort(F.collect_list(place)).alias("x"))
    return evals.run_records(runs.select("qid", F.col("x.l_suppkey").alias("doc_ids"), F.transform("x", lambda x: F.when(x["l_linenumber"] % 3 > 0, x["given"])).alias("scores")))


@query("select event_id, case when event_id % 5 > 0 then greatest(0, least(1, (event_id % 5 - event_id % 3) / (event_id % 5))) end::double as coverage from events")
def facet_coverage(t):
    n = F.col("event_id")
    return t("events").select("event_id", evals.facet_coverage(n % 5, F.when(n % 3 > 0, n % 3)).alias("coverage"))


@query("""select o_orderkey, array_to_string(list_filter([case when o_orderstatus <> 'F' then 'sampled_corpus' end, case when o_orderkey % 2 = 0 then 'query_limit_applied' end, case when o_custkey % 3 = 0 then 'nonstandard_split' end,
case when o_custkey % 2 = 0 then 'evaluation_depth_too_small' end, case when o_orderkey % 5 = 0 then 'retrieval_depth_too_small' end], lambda x: x is not null), ',') as reasons from orders""")
def comparability(t):
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    runs = t("orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", "full").otherwise("sampled").alias("corpus_mode"), F.when(key % 2 == 0, key).alias("query_limit"), F.lit(None).cast("long").alias("doc_limit"),
        F.lit(False).alias("deduplicated"), F.when(customer % 3 > 0, "test").alias("split"), key.alias("selected_query_count"), key.alias("source_query_count"), F.lit("public_quality").alias("benchmark_protocol"),
        F.when(customer % 2 > 0, 100).otherwise(10).alias("evaluation_depth"), F.lit(200).alias("top_k"), F.when(key % 5 > 0, 100).alias("leg_depth"),
    )
    return runs.select("o_orderkey", F.array_join(evals.not_comparable(evals.protocol_checks("test", 100)), ",").alias("reasons"))


@query("""with v as (select user_id, avg(value) filter (event_id % 2 = 0) / 200 as base, avg(value) filter (event_id % 2 = 1) / 200 as now from events group by user_id)
select user_id, coalesce(now between 0 and 1 and now >= base - 0.02, false) as passed from v""")
def baseline_gate(t):
    mean = lambda rest: F.avg(F.when(F.col("event_id") % 2 == rest, F.col("value"))) / 200
    return t("events").groupBy("user_id").agg(mean(0).alias("base"), mean(1).alias("now")).select("user_id", evals.baseline_gate(F.col("now"), F.col("base")).alias("passed"))


@query("""with v as (select user_id, avg(value) filter (event_id % 2 = 0) as ab, avg(value) filter (event_id % 2 = 1) as ba from events group by user_id)
select user_id, round(ab - ba, 6) as delta, coalesce(abs(ab - ba) <= 1e-9, false) as independent from v""")
def paired_orders(t):
    runs = t("events").select("user_id", F.when(F.col("event_id") % 2 == 0, "AB").otherwise("BA").alias("o"), "value")
    return evals.order_pairs(runs, "user_id", "o", "value")


@query("""with p as (select *, min(value) over w as low, max(value) over w as high from events window w as (partition by user_id))
select event_id, round(case when high - low > 1e-12 then (value - low) / (high - low) else greatest(0, least(1, (value + 1) / 2)) end, 6) as scaled from p""")
def token_score_scaled(t):
    return ranking.token_score_scaled(t("events"), "user_id", "value").select("event_id", F.round("scaled", DECIMALS).alias("scaled"))


@query("""with s as (select user_id, case when value <= 100 then value / 100 when event_id % 3 = 0 then 0.5 when event_id % 2 = 0 then 1 / (1 + exp(-(value - 150) / 50)) end as r from events)
select user_id, round(max(r), 6)::double as most, round(avg(r), 6)::double as mean from s group by user_id""")
def relevance_summary(t):
    n, value = F.col("event_id"), F.col("value")
    score = ranking.relevance(value / 100, F.when(n % 3 == 0, 0.5), (value - 150) / 50, n % 2 == 0)
    return t("events").groupBy("user_id").agg(F.round(F.max(score), DECIMALS).alias("most"), F.round(F.avg(score), DECIMALS).alias("mean"))


@query(r"""with recursive m as (select conv_id, row_number() over (partition by conv_id order by turn) as i, turn, (floor(length(text) / 4) + 1)::bigint as cost from conversations),
f(conv_id, i, turn, used, kept) as (select conv_id, 0::bigint, -1::bigint, 0::bigint, false from (select distinct conv_id from m) union all
select f.conv_id, m.i, m.turn, f.used + case when f.used + m.cost <= 150 then m.cost else 0 end, f.used + m.cost <= 150 from f join m on m.conv_id = f.conv_id and m.i = f.i + 1),
t as (select conv_id, max(used) as used from f group by conv_id) select f.conv_id, f.turn, t.used from f join t using (conv_id) where kept""")
def token_pack_skip(t):
    rows = t("conversations").withColumn("cost", text.token_estimate(F.col("text")))
    return ranking.packed_skipping(rows.where(F.length("text") > 0), "conv_id", "turn", "turn", "cost", 150)


@query("""select event_type, count(*) as n, round(count(*) / nullif(date_diff('microsecond', min(ts), max(ts)) / 1e6, 0), 6) as per_second, round(avg(value), 6) as mean, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95, quantile_disc(value, 0.99) as p99 from events group by event_type""")
def load_report(t):
    return logs.load_report(t("events"), "event_type", "ts", "value")


# Guards.
@query(f"select doc_id, regexp_matches(text, '{guard.HARD}') as hard from documents")
def hard_claim(t):
    return t("documents").select("doc_id", guard.hard_claim(F.col("text")).alias("hard"))


@query("select conv_id, turn, not regexp_matches(lower(text), 'the|data') and regexp_matches(lower(text), 'hack|exploit|bypass|绕过|破解') as blocked from conversations")
def topic_gate(t):
    return t("conversations").select("conv_id", "turn", guard.off_topic(F.col("text"), ["the", "Data"]).alias("blocked"))


@query("select event_id, case when event_id % 3 = 0 then event_type || ' 仅供参考' else event_type || '!' end as answer from events")
def disclaimer(t):
    answer = F.when(F.col("event_id") % 3 == 0, F.concat("event_type", F.lit(" 仅供参考"))).otherwise(F.col("event_type"))
    return t("events").select("event_id", guard.with_disclaimer(answer, "!").alias("answer"))


@query("""select event_id, case when event_id % 4 = 0 then 'confident' when event_type = 'click' then 'contradiction' when event_type = 'error' and (event_id % 3 = 0 or value / 300 < 0.5) then 'uncertain' else 'confident' end as signal from events""")
def self_reflection(t):
    n, kind = F.col("event_id"), F.col("event_type")
    said = F.when(kind == "click", "It holds. However, it may not.").when(kind == "error", "Perhaps so.").otherwise("It holds.")
    claims = F.array(F.when(n % 4 == 0, "it is fine").otherwise("the gap is 5 mm"))
    return t("events").select("event_id", guard.reflection(claims, said, F.when(n % 3 > 0, F.col("value") / 300)).alias("signal"))


@query("""with c as (select conv_id, case when turn % 3 > 0 then turn % 2 = 0 end as supported from conversations where turn % 4 <> 1)
select conv_id, coalesce(round(count(*) filter (not supported) / nullif(count(supported), 0), 6), 0.0) as share from c group by conv_id""")
def hallucination(t):
    turn = F.col("turn")
    flags = t("conversations").where("turn % 4 <> 1").groupBy("conv_id").agg(F.collect_list(F.struct(F.when(turn % 3 > 0, turn % 2 == 0).alias("s"))).alias("x"))
    return flags.select("conv_id", F.round(guard.hallucination(F.transform("x", lambda _: F.lit(True)), F.col("x.s")), DECIMALS).alias("share"))
