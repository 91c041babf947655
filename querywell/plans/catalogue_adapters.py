"""Queries over question sets, title links, feedback and the figures of a run, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.checks import element_tree
from ..functions.maths import probability
from ..operators import adapters, guard
from .catalogue import DECIMALS, QRELS, SQL, _qrels, query
from .catalogue_channels import retrieval_workflow
from .catalogue_stores import FOUND, _found

# Conversations as questions with passages: every other turn is selected, one question in four has no answer.
TURNS = r"""r as (select conv_id as qid, turn as place, left(text, 1000) as text, turn % 2 = 1 and role = 'assistant' as selected, conv_id % 4 > 0 as answered from conversations where trim(left(text, 1000)) <> ''),
k as (select *, left(sha1(trim(regexp_replace(text, '\s+', ' ', 'g'))), 12) as id from r where qid in (select qid from r where selected and answered))"""
EXPECTED = "select qid, array_to_string(list(id order by place), ',') as expected from (select qid, id, min(place) as place from {rows} group by qid, id qualify row_number() over (partition by qid order by min(place)) <= 3) group by qid"


def _turns(t):
    chosen = (F.col("turn") % 2 == 1) & (F.col("role") == "assistant")
    return adapters.selected_passages(t("conversations").select(F.col("conv_id").alias("qid"), F.col("turn").alias("place"), "text", chosen.alias("selected"), (F.col("conv_id") % 4 > 0).alias("answered")))


@query(f"with {TURNS} {EXPECTED.format(rows='k where selected and answered')}")
def passage_cases(t):
    return _turns(t)[0].select("qid", F.array_join("expected", ",").alias("expected"))


@query(f"with {TURNS} select id, md5(min(text)) as body from k group by id")
def passage_chunks(t):
    return _turns(t)[1].select("id", F.md5("text").alias("body"))


# Ten documents a question; their languages are the titles, of which the question's support one or none.
@query(r"""with r as (select doc_id // 10 as qid, doc_id as place, lang as title, left(array_to_string(string_split(text, '. '), ' '), 1000) as text, case doc_id // 10 % 3 when 0 then 'en' when 1 then 'fr' else 'none' end as s from documents),
k as (select *, left(sha1(trim(regexp_replace(text, '\s+', ' ', 'g'))), 12) as id, coalesce(title = s, false) as fact, row_number() over (partition by qid order by place) as n from r where trim(text) <> ''),
f as (select * from k where fact or (n <= 2 and qid not in (select qid from k where fact))) """ + EXPECTED.format(rows="f"))
def supported_cases(t):
    q = F.floor(F.col("doc_id") / 10)
    supports = F.when(q % 3 == 0, F.array(F.lit("en"))).when(q % 3 == 1, F.array(F.lit("fr"))).otherwise(F.array(F.lit("none")))
    rows = t("documents").select(q.alias("qid"), F.col("doc_id").alias("place"), F.col("lang").alias("title"), F.split("text", r"\. ").alias("sentences"), supports.alias("supports"))
    return adapters.supported_passages(rows)[0].select("qid", F.array_join("expected", ",").alias("expected"))


# Documents as contexts, their full stops as ends of sentences; some answers have no place.
@query(r"""with recursive d as (select doc_id as qid, translate(text, '.', '。') as x, substr(translate(text, '.', '。'), doc_id % 97 + 1, 12) as gold, case when doc_id % 5 > 0 then doc_id % 97 else -1 end as start from documents where text <> ''),
p as (select qid, list_concat(regexp_extract_all(x, '[^。！？!?]*[。！？!?]'), [regexp_extract(x, '[^。！？!?]*$')]) as s from d where gold <> ''),
r(qid, n, k, part) as (select qid, 1, 0, s[1] from p union all
select r.qid, n + 1, case when part <> '' and length(part) + length(s[n + 1]) > 400 then k + 1 else k end, case when part <> '' and length(part) + length(s[n + 1]) > 400 then case when length(part) > 40 then right(part, 40) else '' end else part end || s[n + 1] from r join p using (qid) where n < len(s)),
c as (select qid, k, part, sum(length(part)) over (partition by qid order by k) as past from (select qid, k, arg_max(part, n) as part from r group by qid, k)),
i as (select c.*, left(sha1(trim(regexp_replace(left(trim(part, chr(32) || chr(9) || chr(10) || chr(13)), 1000), '\s+', ' ', 'g'))), 12) as id, case when start >= past - length(part) and start < past then 0 when contains(part, gold) then 1 end as miss from c join d using (qid))
select qid, arg_min(id, miss * 1000000 + k) as expected from i where miss is not null group by qid""")
def span_cases(t):
    n = F.col("doc_id")
    context = F.translate("text", ".", "。")
    rows = t("documents").select(n.alias("qid"), F.lit("q").alias("question"), context.alias("context"), F.substring(context, (n % 97 + 1).cast("int"), F.lit(12)).alias("gold"), F.when(n % 5 > 0, n % 97).otherwise(-1).alias("start"))
    return adapters.span_passages(rows)[0].select("qid", F.get("expected", F.lit(0)).alias("expected"))


# A hundred documents are the elements of one; one in four is a title.
@query("""with recursive x as (select doc_id // 100 as doc, doc_id as idx, case when doc_id % 5 > 0 and doc_id % 100 > doc_id % 3 then doc_id - 1 - doc_id % 3 end as parent, doc_id % 4 = 0 as is_title, lang from documents where lang is not null),
e as (select x.doc, x.idx, p.idx as parent, x.is_title, x.lang from x left join x p on p.idx = x.parent),
w(idx, doc, title, path) as (select idx, doc, case when is_title then idx end, case when is_title then lang else '' end from e where parent is null union all
select e.idx, e.doc, case when e.is_title then e.idx else w.title end, case when not e.is_title then w.path when w.path = '' then e.lang else w.path || ' -> ' || e.lang end from e join w on e.parent = w.idx)
select doc, idx, title, path from w""")
def title_links(t):
    n = F.col("doc_id")
    rows = t("documents").where("lang is not null").select(F.floor(n / 100).alias("doc"), n.alias("idx"), F.when((n % 5 > 0) & (n % 100 > n % 3), n - 1 - n % 3).alias("parent"), (n % 4 == 0).alias("is_title"), F.col("lang").alias("body"))
    linked = element_tree(rows.select("idx", "parent")).select("idx", "parent").join(rows.drop("parent"), "idx")
    return adapters.title_links(linked)


@query("select conv_id, turn, contains(lower(text), 'who') or contains(lower(text), 'que') or regexp_matches(text, '(?i)\\b(?:what|wer|quel)\\b') as identity, contains(lower(text), 'data') or regexp_matches(text, '[0-9]{3,}') as domain from conversations where text is not null")
def query_matches(t):
    rows = t("conversations").where("text is not null")
    identity = adapters.matches(F.col("text"), ["Who", "que"], [r"(?i)\b(?:what|wer|quel)\b"])
    return rows.select("conv_id", "turn", identity.alias("identity"), adapters.matches(F.col("text"), ["data"], [r"[0-9]{3,}"]).alias("domain"))


@query(f"with {FOUND} select id, md5(left(coalesce(content, ''), 500)) as content, source, title, case when rerank_prob between 0 and 1 then rerank_prob end::double as score, rerank_score is not null as rerank_applied from f")
def answer_sources(t):
    return _found(t).select("id", F.md5(F.substring(F.coalesce("content", F.lit("")), 1, 500)).alias("content"), "source", "title", probability(F.col("rerank_prob")).alias("score"), F.col("rerank_score").isNotNull().alias("rerank_applied"))


@query("""with f as (select event_id as trace, case when event_id % 3 = 0 then ' fixed ' when event_id % 3 = 1 then ' ' end as corrected from events where event_type = 'error'), i as (select event_id as trace, user_id as query, 'a' || user_id as answer, case when event_id % 4 > 0 then value / 100 end as faithfulness from events)
select trace, query, coalesce(nullif(trim(corrected), ''), answer) as reference, coalesce(faithfulness < 0.5, false) as miss from f join i using (trace)""")
def feedback_flywheel(t):
    n = F.col("event_id")
    feedback = t("events").select(n.alias("trace"), (F.col("event_type") == "error").alias("negative"), F.when(n % 3 == 0, " fixed ").when(n % 3 == 1, " ").alias("corrected"))
    logged = t("events").select(n.alias("trace"), F.col("user_id").alias("query"), F.concat(F.lit("a"), "user_id").alias("answer"), F.when(n % 4 > 0, F.col("value") / 100).alias("faithfulness"))
    return adapters.flywheel(feedback, logged)


@query(f"""with l as ({SQL['escalation_level']}) select event_id, level, level in ('high', 'critical') as escalated, 'a' || event_id || case when level in ('high', 'critical') then chr(10) || chr(10) || 'A person will look at this.' else '' end as answer from l""")
def escalation_hook(t):
    kind = F.col("event_type")
    level = guard.escalation(kind == "error", kind != "signup", ~((kind == "view") & (F.col("value") < 10)), F.lit(50))
    rows = t("events").select("event_id", "event_type", "value", F.concat(F.lit("a"), "event_id").alias("answer"))
    return adapters.escalated(rows, level, "answer", "A person will look at this.").select("event_id", "level", "escalated", "answer")


@query(f"""with w as ({SQL['retrieval_workflow']}), {QRELS}, p as (select distinct qid, doc_id from qrels), h as (select w.qid, w.rank, w.retried, d.source, p.doc_id is not null as held from w join documents d on d.doc_id = w.doc_id left join p on p.qid = w.qid and p.doc_id = w.doc_id),
q as (select qid, bool_or(held) as hit, count(*) filter (held) / count(*) as precision, min(case when held then rank end) as first, bool_or(retried) as retried from h group by qid)
select count(*) as queries, round(avg(hit::int), 6) as hit_rate, round(avg(precision), 6) as precision, round(avg(coalesce(1.0 / first, 0)), 6)::double as mrr, count(*) filter (retried) as retries, (select count(distinct source) from h) as sources from q""")
def run_figures(t):
    held = _qrels(t).select("qid", "doc_id").distinct().withColumn("held", F.lit(True))
    rows = retrieval_workflow(t).join(t("documents").select("doc_id", "source"), "doc_id").join(held, ["qid", "doc_id"], "left").withColumn("held", F.coalesce("held", F.lit(False)))
    each = rows.groupBy("qid").agg(F.bool_or("held").alias("hit"), (F.count_if("held") / F.count(F.lit(1))).alias("precision"), F.min(F.when(F.col("held"), F.col("rank"))).alias("first"), F.bool_or("retried").alias("retried"))
    mean = lambda x: F.round(F.avg(x), DECIMALS)
    figures = each.agg(F.count(F.lit(1)).alias("queries"), mean(F.col("hit").cast("int")).alias("hit_rate"), mean("precision").alias("precision"), mean(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"), F.count_if("retried").alias("retries"))
    return figures.crossJoin(rows.agg(F.count_distinct("source").alias("sources")))  # one row each
