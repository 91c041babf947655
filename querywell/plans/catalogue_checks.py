"""Queries over text checks, evaluation rows and page parts, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F


from ..functions import checks
from ..operators import evals, guard
from .catalogue import DECIMALS, query
from .catalogue_stores import _ranked


@query(r"""select doc_id, regexp_matches(text, '(^|[^0-9])[1-9][0-9]{5}(19|20)[0-9]{2}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])[0-9]{3}[0-9Xx]([^0-9]|$)') as id_card, regexp_matches(text, '(^|[^0-9])1[3-9][0-9]{9}([^0-9]|$)') as phone,
regexp_matches(text, '(^|[^0-9])[1-9][0-9]{15,18}([^0-9]|$)') as bank_card, regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') as email,
regexp_matches(text, '(^|[^0-9])(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}([^0-9]|$)') as ip, regexp_matches(text, '\b[EeGgKkPpHh][0-9]{8}\b') as passport from documents""")
def pii_kinds(t):
    return t("documents").select("doc_id", *(guard.found(F.col("text"), k).alias(k) for k in guard.PATTERNS))


@query(r"""select doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10))) as text from documents""")
def page_text(t):
    return t("documents").select("doc_id", F.md5(checks.page_text(F.col("text"))).alias("text"))


@query(r"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as place from documents),
r as (select *, len(list_filter(regexp_split_to_array(line, '\||\t| {2,}'), lambda c: trim(c) <> '')) >= 2 as is_row from l),
g as (select *, sum((is_row is distinct from prev)::int) over (partition by doc_id order by place) as run from (select *, lag(is_row) over (partition by doc_id order by place) as prev from r)),
b as (select doc_id, run, min(place) as first, count(*) as n from g where is_row group by doc_id, run having count(*) >= 2)
select doc_id, 'page_' || doc_id || '_table_' || row_number() over (partition by doc_id order by first) as id, first::int as first, n from b""")
def table_blocks(t):
    return checks.table_blocks(t("documents"))


@query(r"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as place from documents),
c as (select doc_id, place, list_filter(list_transform(regexp_split_to_array(line, '\||\t| {2,}'), lambda c: trim(c)), lambda c: c <> '') as cells from l), r as (select * from c where len(cells) >= 2),
w as (select doc_id, max(len(cells)) as w, min(place) as first from r group by doc_id), m as (select doc_id, place, first, w, '| ' || array_to_string(list_resize(cells, w, ''), ' | ') || ' |' as line from r join w using (doc_id))
select doc_id, md5(concat_ws(chr(10), max(line) filter (where place = first), '|' || repeat(' --- |', any_value(w)), string_agg(line, chr(10) order by place) filter (where place > first))) as markdown from m group by doc_id""")
def table_markdown(t):
    cells = F.filter(F.transform(F.split("line", r"\||\t| {2,}"), lambda c: F.trim(c)), lambda c: c != "")
    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line")).select("doc_id", "place", cells.alias("cells")).where(F.size("cells") >= 2)
    rows = lines.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "cells"))), lambda x: x["cells"]).alias("rows"))
    return rows.select("doc_id", F.md5(checks.markdown_table(F.col("rows"))).alias("markdown"))


@query(r"""select doc_id, left(trim(regexp_replace(text, '[\x00-\x1F\x7F]', ' ', 'g')), 100) as description from documents""")
def description_plain(t):
    return t("documents").select("doc_id", checks.description(F.col("text")).alias("description"))


@query("select doc_id, greatest(1, floor(length(text) / 3.2))::int as tokens from documents where text is not null")
def chunker_tokens(t):
    return t("documents").where("text is not null").select("doc_id", checks.chunk_tokens(F.col("text")).alias("tokens"))


INTENT = """select conv_id, turn, case when regexp_matches(lower(text), 'document|manual|quelle|dans') then 'rag' when regexp_matches(lower(text), '(^|[^a-z0-9_])(hello|thanks|la)([^a-z0-9_]|$)') then 'chat' end as intent from conversations"""


@query(INTENT)
def keyword_intent(t):
    return t("conversations").select("conv_id", "turn", checks.keyword_intent(F.col("text"), ["document", "manual", "quelle", "dans"], ["hello", "thanks", "la"]).alias("intent"))


@query(r"""select conv_id, turn, case when turn % 5 = 0 then 'hyde' when trim(coalesce(text, '')) = '' then null when regexp_matches(trim(text), '[A-Z]{2,}-[0-9]+') then null when contains(trim(text), 'que') then 'hyde' when length(trim(text)) <= 12 and contains(trim(text), 'la') then 'multi_query' end as transform from conversations""")
def transform_decision(t):
    explicit = F.when(F.col("turn") % 5 == 0, "hyde")
    return t("conversations").select("conv_id", "turn", checks.transform_decision(explicit, F.col("text"), r"[A-Z]{2,}-[0-9]+", ["que"], ["la"]).alias("transform"))


@query("""select doc_id, case when length(text) <= 50 then 'allow' when contains(text, 'The') and contains(text, 'of') then 'allow' when contains(text, 'The') then 'sanitize:cut' else 'sanitize:unstructured' end as action from documents where text is not null""")
def structure_check(t):
    return t("documents").where("text is not null").select("doc_id", checks.structure(F.col("text"), ["The"], ["of"]).alias("action"))


@query("""select event_id, case when event_id % 7 = 0 then 'escalate' when event_id % 3 = 0 then 'sanitize' when event_id % 5 = 0 then 'sanitize' when event_id % 11 = 0 then 'sanitize' else 'allow' end as action, event_id % 11 = 0 as redacted from events""")
def output_verdict(t):
    n = F.col("event_id")
    action, redacted = checks.output_verdict(n % 7 == 0, n % 3 == 0, n % 5 == 0, n % 11 == 0)
    return t("events").select("event_id", action.alias("action"), redacted.alias("redacted"))


@query("""with s as (select event_id, case when event_id % 4 = 0 then null else event_id % 3 end as hard, case when event_id % 9 = 0 then null else least(event_id % 3, event_id % 2) end as ok from events)
select event_id, case when hard is null then 1.0 when ok is null then null when hard = 0 then 1.0 else round(ok / hard, 6) end::double as grounding from s""")
def grounding(t):
    n = F.col("event_id")
    hard, ok = F.when(n % 4 > 0, n % 3), F.when(n % 9 > 0, F.least(n % 3, n % 2))
    return t("events").select("event_id", F.round(checks.grounding(hard, ok), DECIMALS).alias("grounding"))


@query("""select event_id, signal, amount from (select event_id, unnest(['is_relevant', 'rewrite_attempt', 'answer_length', 'has_reasoning']) as signal, unnest([(value > 20)::int::double, (event_id % 3)::double, round(value, 4), (user_id % 2)::double]) as amount from events)""")
def quality_signals(t):
    e = t("events").select("event_id", (F.col("value") > 20).cast("int").cast("double").alias("is_relevant"), (F.col("event_id") % 3).cast("double").alias("rewrite_attempt"), F.round("value", 4).alias("answer_length"), (F.col("user_id") % 2).cast("double").alias("has_reasoning"))
    return e.unpivot("event_id", ["is_relevant", "rewrite_attempt", "answer_length", "has_reasoning"], "signal", "amount")


@query("""with m as (select conv_id, turn, role, left(coalesce(text, ''), 150) as text, row_number() over (partition by conv_id order by turn desc) as n from conversations)
select conv_id, md5(string_agg(role || ': ' || text, chr(10) order by turn)) as history from m where n <= 6 group by conv_id""")
def condense_history(t):
    last = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    rows = t("conversations").withColumn("n", last).where("n <= 6")
    line = F.struct("turn", F.concat("role", F.lit(": "), F.substring(F.coalesce("text", F.lit("")), 1, 150)).alias("line"))
    joined = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(line)).alias("x"))
    return joined.select("conv_id", F.md5(F.array_join(F.transform("x", lambda x: x["line"]), "\n")).alias("history"))


@query("""select channel, count(*) as n from (select unnest(['colbert', 'raptor', 'ppr']) as channel, unnest([case when event_id % 3 = 0 then 'contributed' else 'unavailable_or_no_match' end, case when event_id % 5 = 0 then 'disabled' else 'unavailable_or_no_match' end, 'contributed']) as status from events) where status = 'unavailable_or_no_match' group by channel""")
def unavailable_channels(t):
    n = F.col("event_id")
    status = F.create_map(F.lit("colbert"), F.when(n % 3 == 0, "contributed").otherwise("unavailable_or_no_match"), F.lit("raptor"), F.when(n % 5 == 0, "disabled").otherwise("unavailable_or_no_match"), F.lit("ppr"), F.lit("contributed"))
    return evals.unavailable(t("events").select(status.alias("status")), "status")


@query("select coalesce(case when event_id % 4 > 0 then event_type end, 'hybrid') as channel, count(*) as n from events group by 1")
def channel_counts(t):
    found = F.when(F.col("event_id") % 4 > 0, F.col("event_type"))
    return t("events").groupBy(F.coalesce(found, F.lit("hybrid")).alias("channel")).agg(F.count(F.lit(1)).alias("n"))


@query("""with r as (select user_id as qid, bool_or(event_type = 'view') as colbert, bool_or(event_type = 'error' and value > 50) as raptor from events group by user_id)
select qid, case when qid % 2 > 0 then 'disabled' when colbert then 'contributed' else 'unavailable_or_no_match' end as colbert, case when qid % 3 = 0 then 'disabled' when raptor then 'contributed' else 'unavailable_or_no_match' end as raptor from r""")
def channel_status(t):
    each = t("events").groupBy(F.col("user_id").alias("qid")).agg(F.bool_or(F.col("event_type") == "view").alias("a"), F.bool_or((F.col("event_type") == "error") & (F.col("value") > 50)).alias("b"))
    return each.select("qid", evals.channel_status(F.col("qid") % 2 == 0, F.col("a")).alias("colbert"), evals.channel_status(F.col("qid") % 3 > 0, F.col("b")).alias("raptor"))


@query("""with v as (select event_type as variant, row_number() over (order by event_type) - 1 as k, count(*) over () as n from (select distinct event_type from events))
select r.range::int as round, ((v.k - r.range + v.n) % v.n)::int as position, v.variant from v, range(0, (select max(n) from v)) r""")
def balanced_schedule(t):
    return evals.balanced_schedule(t("events").select(F.col("event_type").alias("variant")).distinct(), "variant")


@query("""with m as (select user_id % 10 as ds, avg(value) as quality from events group by 1), g as (select unnest([10.0, 60.0]) as k), w as (select unnest([0.3, 0.5, 0.7]) as weight)
select ds, k::double as k, weight::double as weight, round(quality * weight / k, 6)::double as score from m, g, w""")
def calibration_grid(t):
    means = t("events").groupBy((F.col("user_id") % 10).alias("ds")).agg(F.avg("value").alias("quality"))
    grid = evals.grid(means, k=[10.0, 60.0], weight=[0.3, 0.5, 0.7])
    return grid.select("ds", "k", "weight", F.round(F.col("quality") * F.col("weight") / F.col("k"), DECIMALS).alias("score"))


@query("""select qid, id, round(least(1.0, greatest(0.0, (s + 1) / 2)), 7) as relevancy from (select qid, vec_id as id, round(list_dot_product(embedding::double[], e::double[]) / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product(e::double[], e::double[]))), 6) as s, row_number() over (partition by qid order by round(list_dot_product(embedding::double[], e::double[]) / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product(e::double[], e::double[]))), 6) desc, vec_id::varchar) as n from embeddings, (select vec_id as qid, embedding as e from embeddings where vec_id % 20 = 0)) where n <= 3""")
def answer_relevancy(t):
    return _ranked(t, 3).select("qid", "id", F.round(evals.answer_relevancy(F.col("score")), 7).alias("relevancy"))


@query("""with b as (select user_id, avg(value) as v, count(*) as n, max(event_id) as id from events group by user_id)
select user_id, case when user_id % 13 = 0 then 'schema_version' when user_id % 7 = 0 then 'config' when user_id % 5 = 0 then 'digest' when v > 25 then 'metrics' end as reason from b""")
def baseline_validation(t):
    u = F.col("user_id")
    each = t("events").groupBy("user_id").agg(F.avg("value").alias("v"))
    checks_ = {"schema_version": u % 13 > 0, "config": u % 7 > 0, "digest": u % 5 > 0, "metrics": F.col("v") <= 25}
    return each.select("user_id", evals.first_failure(checks_).alias("reason"))


@query("""with r as (select user_id % 10 as ds, event_type as variant, avg(value) as score from events group by 1, 2), m as (select user_id % 10 as ds, event_type as variant, count(*) as ndcg from events where event_id % 2 = 0 and user_id % 10 < 8 group by 1, 2)
select r.ds, r.variant, round(r.score, 6) as score, m.ndcg from r left join m using (ds, variant)""")
def metrics_attached(t):
    key = (F.col("user_id") % 10).alias("ds"), F.col("event_type").alias("variant")
    runs = t("events").groupBy(*key).agg(F.round(F.avg("value"), DECIMALS).alias("score"))
    metrics = t("events").where("event_id % 2 = 0 and user_id % 10 < 8").groupBy(*key).agg(F.count(F.lit(1)).alias("ndcg"))
    return runs.join(metrics, ["ds", "variant"], "left").select("ds", "variant", "score", "ndcg")


@query("""with f as (select doc_id, case when doc_id % 3 = 0 then ['The', 'zzz'] when doc_id % 3 = 1 then [] else ['of', 'de', 'zzz', 'la'] end as keys, text from documents where text is not null)
select doc_id, case when len(keys) = 0 then 1.0 else round(len(list_filter(keys, lambda k: contains(text, k))) / len(keys), 6) end::double as coverage from f""")
def section_coverage(t):
    n = F.col("doc_id")
    keys = F.when(n % 3 == 0, F.array(F.lit("The"), F.lit("zzz"))).when(n % 3 == 1, F.array().cast("array<string>")).otherwise(F.array(*map(F.lit, ["of", "de", "zzz", "la"])))
    rows = t("documents").where("text is not null").select("doc_id", "text", keys.alias("keys"))
    return rows.select("doc_id", F.round(evals.coverage(F.col("text"), F.col("keys")), DECIMALS).alias("coverage"))


@query("""with e as (select page_id, list_distinct(regexp_extract_all(lower(url), '[a-z0-9]+')) as w from pages), q as (select unnest(['en', 'example', 'page', 'm']) as term)
select page_id, round(len(list_intersect(w, ['en', 'example', 'page', 'm'])) / 4.0, 6)::double as score, row_number() over (order by len(list_intersect(w, ['en', 'example', 'page', 'm'])) desc, page_id)::int as rank from e where len(list_intersect(w, ['en', 'example', 'page', 'm'])) > 0 qualify rank <= 20""")
def ocr_fallback(t):
    words = F.array_distinct(F.regexp_extract_all(F.lower("url"), F.lit("[a-z0-9]+"), F.lit(0)))
    score = F.size(F.array_intersect(words, F.array(*map(F.lit, ["en", "example", "page", "m"])))) / 4.0
    top = t("pages").select("page_id", F.round(score, DECIMALS).alias("score")).where("score > 0").orderBy(F.desc("score"), "page_id").limit(20)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "page_id")))  # twenty rows


@query("""with c as (select doc_id as idx, case when doc_id % 5 > 0 then doc_id - (doc_id % 7) + 2 end as parent from documents)
select idx, case when parent is not null and parent < idx and parent in (select idx from c) then parent end as parent, coalesce(parent >= idx and parent in (select idx from c), false) as forward from c""")
def element_tree(t):
    n = F.col("doc_id")
    rows = t("documents").select(n.alias("idx"), F.when(n % 5 > 0, n - n % 7 + 2).alias("parent"))
    return checks.element_tree(rows)
