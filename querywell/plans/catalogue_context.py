"""Queries on what surrounds an answer: sections, budgets, pooled vectors, memories, seeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, vectors
from ..operators import chunking, generations, graph, logs, ranking
from .catalogue import DECIMALS, TOKENS, passages, query

TERMS = "list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+|[\\x{4e00}-\\x{9fff}]'))"


@query(f"""with d as (select doc_id as id, length(lang) as level, text, {TERMS} as t from documents), b as (select item_id as qid, text as query, {TERMS} as q from benchmark),
s as (select qid, id, level, round((len(list_intersect(q, t)) + contains(lower(text), lower(query))::int) / (len(q) + 1), 6) as score from d, b where len(list_intersect(q, t)) > 0)
select qid, id, score, row_number() over (partition by qid order by score desc, level desc, id)::int as rank from s qualify rank <= 5""")
def summary_score(t):
    nodes = t("documents").select(F.col("doc_id").alias("id"), F.length("lang").alias("level"), "text")
    return ranking.summary_scored(nodes, passages(t), 5)


@query("""select event_id, array_to_string(list_filter(['view', 'click', 'error'], lambda x: x <> event_type and not (event_id % 2 = 0 and x = 'click')), ',') as missing from events""")
def facets_uncovered(t):
    matched = F.array(F.array("event_type"), F.when(F.col("event_id") % 2 == 0, F.array(F.lit("click"))).otherwise(F.array().cast("array<string>")))
    return t("events").select("event_id", F.array_join(ranking.uncovered(F.array(*map(F.lit, ("view", "click", "error"))), matched), ",").alias("missing"))


@query("select doc_id from documents where doc_id % 2 = 1 and (text is null or left(text, 80) not in (select left(text, 80) from documents where doc_id % 2 = 0 and text is not null))")
def memory_dedupe(t):
    d = t("documents").select("doc_id", "text")
    return ranking.without_retrieved(d.where("doc_id % 2 = 1"), d.where("doc_id % 2 = 0"), "text").select("doc_id")


@query("""with f as (select event_id as id, case when event_id % 3 > 0 then event_id * 2 end as trace_id, event_id + 1 as message_id from events where event_type = 'click'),
i as (select event_id as inference_id, event_id as trace_id, event_id as message_id from events)
select f.id, coalesce(a.inference_id, b.inference_id) as inference_id from f left join i a using (trace_id) left join i b on b.message_id = f.message_id""")
def feedback_fallback(t):
    e, n = t("events"), F.col("event_id")
    given = e.where("event_type = 'click'").select(n.alias("id"), F.when(n % 3 > 0, n * 2).alias("trace_id"), (n + 1).alias("message_id"))
    return logs.joined_feedback(given, e.select(n.alias("inference_id"), n.alias("trace_id"), n.alias("message_id")))


@query("""select event_id, case when event_id % 2 = 0 and ts < timestamp '2024-01-15 00:00:00' - interval 120 second then 'failed' when event_id % 2 = 0 then 'processing' else 'ready' end as status from events""")
def stale_recovery(t):
    jobs = t("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_id") % 2 == 0, "processing").otherwise("ready").alias("status"))
    return generations.recovered(jobs, "status", "ts", F.lit("2024-01-15 00:00:00").cast("timestamp")).select("event_id", "status")


def _estimate(x: str) -> str:
    cjk = f"len(regexp_extract_all({x}, '[\\x{{4e00}}-\\x{{9fff}}]'))"
    return f"case when length({x}) = 0 then 0 else (floor({cjk} / 1.5 + (length({x}) - {cjk}) / 4) + 1)::int end"


@query(f"""with d as (select doc_id, replace(text, chr(10), chr(10) || chr(10)) as c from documents), p as (select doc_id, c, unnest(string_split(c, chr(10) || chr(10))) as part, generate_subscripts(string_split(c, chr(10) || chr(10)), 1) as i from d),
s as (select *, sum({_estimate('part')} + 2) over (partition by doc_id order by i) as used from p)
select doc_id, md5(case when {_estimate('any_value(c)')} <= 120 then any_value(c) else string_agg(part, chr(10) || chr(10) order by i) filter (i = 1 or used <= 120) || chr(10) || '...[内容已按 token 预算截断]' end) as digest from s group by doc_id""")
def context_budget(t):
    context = F.regexp_replace("text", "\n", "\n\n")
    return t("documents").select("doc_id", F.md5(text.within_budget(context, 120)).alias("digest"))


@query(r"""with l as (select doc_id, generate_subscripts(x, 1) - 1 as place, unnest(x) as raw from (select doc_id, string_split(text, chr(10)) as x from documents)), k as (select * from l where trim(raw) <> ''),
m as (select doc_id, place, trim(raw) as raw, max(case when place % 6 = 1 then place end) over w as a, max(case when place % 6 = 4 then place end) over w as b from k window w as (partition by doc_id order by place)),
s as (select m.*, case when a is null and b is null then null when b > a or a is null then b else a end as h from m),
n as (select s.*, x.raw as ta, y.raw as tb from s left join k x on x.doc_id = s.doc_id and x.place = s.a left join k y on y.doc_id = s.doc_id and y.place = s.b)
select doc_id, place::int as place, raw as body from n where h is null union all
select doc_id, min(place)::int as place, case when a is null then trim(any_value(tb)) when b > a then trim(any_value(ta)) || ' -> ' || trim(any_value(tb)) else trim(any_value(ta)) end || chr(10) || chr(10) || string_agg(raw, chr(10) order by place) as body from n where h is not null and place % 6 not in (1, 4) group by doc_id, a, b""")
def title_merge(t):
    rows = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "raw")).where(F.trim("raw") != "")
    mark = F.when(F.col("place") % 6 == 1, "# ").when(F.col("place") % 6 == 4, "## ").otherwise("")
    return chunking.merged_by_title(rows.select("doc_id", "place", F.concat(mark, F.trim("raw")).alias("line")))


@query("""with t as (select label as doc, vec_id * 10 as "begin", vec_id * 10 + 8 as "end", embedding as vec from embeddings where label is not null and vec_id > 0), s as (select doc, g as span, g * 100 as "begin", g * 100 + 50 as "end" from (select doc, unnest(range(0, max("end") // 100 + 1)) as g from t group by doc)),
o as (select s.doc, s.span, (t."begin" < s."end" and t."end" > s."begin") as over, unnest(vec)::double as x, generate_subscripts(vec, 1) as i from s join t using (doc)),
m as (select doc, span, i, coalesce(avg(x) filter (over), avg(x)) as x from o group by all) select doc, span, round(sum(x * i), 6) as weighted from m group by all""")
def mean_pool(t):
    n = F.col("vec_id")
    tokens = t("embeddings").where("label is not null and vec_id > 0").select(F.col("label").alias("doc"), (n * 10).alias("begin"), (n * 10 + 8).alias("end"), F.col("embedding").alias("vec"))
    spans = tokens.groupBy("doc").agg(F.max("end").alias("most")).select("doc", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("most") / 100))).alias("span"))
    spans = spans.select("doc", "span", (F.col("span") * 100).alias("begin"), (F.col("span") * 100 + 50).alias("end"))
    weights = F.transform("vec", lambda _, i: (i + 1).cast("double"))
    return chunking.pooled(tokens, spans).select("doc", "span", F.round(vectors.dot(F.col("vec"), weights), DECIMALS).alias("weighted"))


@query(f"""with e as (select distinct unnest({TOKENS}) as name from benchmark), q as (select distinct conv_id, turn, unnest({TOKENS}) as name from conversations)
select conv_id * 1000 + turn as qid, md5(name) as id from q join e using (name) where length(name) >= 4""")
def keyword_seeds(t):
    entities = t("benchmark").select(F.explode(text.tokens(F.col("text"))).alias("name")).distinct().where(F.length("name") >= 4)
    asked = t("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.col("text").alias("query"))
    return graph.keyword_seeds(entities.select(F.md5("name").alias("id"), "name"), asked)
