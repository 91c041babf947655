"""More queries over the supplied tables, registered with the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import maths, text
from ..operators import evals, generations, graph, guard, lexical, ranges, ranking, stores
from .catalogue import CHANNELS, DECIMALS, GENERATIONS, QRELS, RUNS, TOKENS, _channels, _generations, _qrels, _runs, bm25_sql, bm25_topk, passages, query

VARIANTS = f"""{CHANNELS}, u as (select qid, 1 as variant, 'chunk:' || doc_id as key, rank from lex union all select qid, 2, 'chunk:' || doc_id, rank from bag)"""


@query(f"""with {VARIANTS}, s as (select qid, key, round(sum(1 / (60 + rank)), 9) as score, min(variant * 100 + rank) as seen from u group by qid, key)
select qid, key, score, row_number() over (partition by qid order by score desc, seen)::int as rank from s""")
def rrf_unweighted(t):
    a, b = (c.withColumn("variant", F.lit(n)) for n, c in enumerate(_channels(t), 1))
    return ranking.unweighted_rrf(a.unionByName(b))


@query(f"""with {VARIANTS}, w as (select *, case variant when 1 then 0.7 else 0.3 end::double as weight from u), al as (select qid, sum(weight) as total from (select distinct qid, variant, weight from w) group by qid),
s as (select qid, key, round(sum(weight / total / (60 + rank)), 9) as score, min(variant * 100 + rank) as seen from w join al using (qid) group by qid, key)
select qid, key, score, row_number() over (partition by qid order by score desc, seen)::int as rank from s""")
def rrf_weighted(t):
    a, b = (c.withColumn("channel", F.lit(n)).withColumn("weight", F.lit(w)) for n, w, c in zip((1, 2), (0.7, 0.3), _channels(t)))
    return ranking.weighted_rrf(a.unionByName(b))


@query(f"""with {VARIANTS}, s as (select qid, key, round(sum(case variant when 1 then 1.0 else 0.8 end::double / (60 + rank)), 9) as score from u group by qid, key)
select qid, key, score, row_number() over (partition by qid order by score desc, key)::int as rank from s""")
def graph_low_high_rrf(t):
    return graph.low_high(*_channels(t))


@query("""with e as (select event_id, user_id, case when event_id % 6 > 0 then least(value / 100, 1.0) end as score from events),
w as (select *, score is null as degraded, count(*) filter (score >= 0.3) over (partition by user_id) as passed, row_number() over (partition by user_id order by score desc nulls last, event_id) as best from e)
select event_id, degraded from w where degraded or score >= 0.3 or (passed = 0 and best = 1)""")
def per_doc_select(t):
    rows = t("events").select("event_id", "user_id", F.when(F.col("event_id") % 6 > 0, F.least(F.col("value") / 100, F.lit(1.0))).alias("score"))
    return ranking.per_doc_select(rows, "user_id", "score", "event_id").select("event_id", "degraded")


@query(f"""with {QRELS}, p as (select distinct qid, doc_id from qrels), j as (select distinct doc_id from p),
r as (select q.qid, d.doc_id, case when d.doc_id in (select doc_id from j) then 0 else 1 end as judged from (select distinct qid from p) q, documents d where (q.qid, d.doc_id) not in (select (qid, doc_id) from p))
select qid, doc_id, row_number() over (partition by qid order by judged, sha256('seed:' || qid || ':' || doc_id))::int as place from r qualify place <= 5""")
def hard_negatives(t):
    return ranking.hard_negatives(t("documents"), _qrels(t).select("qid", "doc_id").distinct(), 5).select("qid", "doc_id", "place")


@query(f"with {GENERATIONS} select source, count(*) as n, count(*) filter (status = 'ready') as ready from g group by source")
def generation_counts(t):
    return _generations(t).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "ready").alias("ready"))


@query("select distinct c_nationkey as source from customer where c_nationkey not in (select n_nationkey from nation where n_regionkey < 3)")
def missing_sources(t):
    return generations.missing(t("customer").select(F.col("c_nationkey").alias("source")), t("nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("source")))


@query("select user_id, event_id, ts from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def latest_per_user(t):
    return generations.latest(t("events").select("user_id", "event_id", "ts"), "user_id", "ts", "event_id")


@query("select o_orderkey from orders order by o_orderdate desc, o_orderkey limit 20 offset 40")
def offset_paging(t):
    return t("orders").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(40).limit(20).select("o_orderkey")


@query("select doc_id, source, n_chars from documents where text like '%the%' and n_chars >= 500 and lang in ('en', 'fr') order by n_chars desc, doc_id limit 25")
def memory_like_topk(t):
    found = t("documents").where(F.col("text").like("%the%") & (F.col("n_chars") >= 500) & F.col("lang").isin("en", "fr"))
    return found.orderBy(F.desc("n_chars"), "doc_id").limit(25).select("doc_id", "source", "n_chars")


@query("""select a.event_id, b.event_id as inference_id, a.event_type from events a join events b on a.user_id = b.user_id and b.event_id = a.event_id - 1 where a.event_type in ('click', 'purchase')""")
def feedback_join(t):
    e = t("events")
    logged = e.select("user_id", F.col("event_id").alias("inference_id"))
    marked = e.where(F.col("event_type").isin("click", "purchase")).select("event_id", "user_id", "event_type", (F.col("event_id") - 1).alias("inference_id"))
    return marked.join(logged, ["user_id", "inference_id"]).select("event_id", "inference_id", "event_type")


@query("select k, sum(v)::bigint as n from (select unnest(map_entries(m)).key as k, unnest(map_entries(m)).value as v from (select map {event_type: event_id % 7, 'all': 1} as m from events)) group by k")
def nested_count_sum(t):
    counts = t("events").select(F.explode(F.create_map(F.col("event_type"), F.col("event_id") % 7, F.lit("all"), F.lit(1).cast("bigint"))).alias("k", "v"))
    return counts.groupBy("k").agg(F.sum("v").alias("n"))


@query("select coalesce(nullif(event_type, 'view'), 'unknown') as route, count(*) as total, count(*) filter (value > 20) as sampled from events group by 1")
def route_stats(t):
    rows = t("events").select(F.coalesce(F.nullif("event_type", F.lit("view")), F.lit("unknown")).alias("route"), "value")
    return rows.groupBy("route").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("value") > 20).alias("sampled"))


@query(f"""with {RUNS}, b as (select dataset, avg(score) as q, quantile_disc(score, 0.95) as l from runs where variant = 'view' group by 1), v as (select dataset, variant, avg(score) as q, quantile_disc(score, 0.95) as l from runs group by all)
select v.dataset, v.variant, b.q - v.q <= 0.02 and v.l <= 1.25 * b.l as promoted from v join b using (dataset)""")
def promotion_gate(t):
    runs = _runs(t)
    slow = ranges.quantiles(runs, ["dataset", "variant"], "score", {"l": 0.95}).drop("n")
    each = runs.groupBy("dataset", "variant").agg(F.avg("score").alias("q")).join(slow, ["dataset", "variant"])
    return evals.promotion_gate(each, "dataset", "q", "l", each.where("variant = 'view'")).select("dataset", "variant", "promoted")


@query(f"""with {RUNS}, e as (select variant, position, avg(score) as m from runs group by all) select variant, count(*) as orders, round(max(m) - min(m), 6) as spread, round(max(m) - min(m), 6) <= 1e-9 as independent from e group by variant""")
def order_independence(t):
    return evals.order_independent(_runs(t), "variant", "position", "score")


@query(f"""with {QRELS}, lex as ({bm25_sql('')}), r as (select l.qid, list(case when q.doc_id is not null then 1.0 / l.rank end order by l.rank) as x from lex l left join (select distinct qid, doc_id from qrels) q on q.qid = l.qid and q.doc_id = l.doc_id group by l.qid)
select qid, round(list_avg(list_filter(x, lambda v: v is not null)), 6)::double as precision from r""")
def rank_aware_precision(t):
    hits = bm25_topk(t).join(_qrels(t).select("qid", "doc_id").distinct().withColumn("hit", F.lit(True)), ["qid", "doc_id"], "left")
    listed = hits.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.coalesce("hit", F.lit(False)).alias("hit")))), lambda x: x["hit"]).alias("x"))
    return listed.select("qid", F.round(evals.rank_aware_precision(F.col("x")), DECIMALS).alias("precision"))


@query("select user_id, round(count(*) filter (event_type = 'purchase') / nullif(count(*) filter (event_type <> 'view'), 0), 6) as faithfulness from events group by user_id")
def faithfulness(t):
    verdict = F.when(F.col("event_type") != "view", F.col("event_type") == "purchase")
    votes = t("events").groupBy("user_id").agg(F.count_if(verdict).alias("yes"), F.count(verdict).alias("judged"))
    return votes.select("user_id", F.round(F.try_divide("yes", "judged"), DECIMALS).alias("faithfulness"))


@query(f"""with lex as ({bm25_sql('')}) select l.qid, round(len(list_filter(string_split(b.text, ''), lambda c: contains(d.text, c))) / length(b.text), 6) as overlap from lex l join documents d using (doc_id) join benchmark b on b.item_id = l.qid where l.rank = 1""")
def answer_overlap(t):
    top = bm25_topk(t).where("rank = 1").join(t("documents").select("doc_id", F.col("text").alias("top")), "doc_id").join(t("benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("reference")), "qid")
    return top.select("qid", F.round(evals.char_overlap(F.col("reference"), F.col("top")), DECIMALS).alias("overlap"))


@query(f"with lex as ({bm25_sql('')}) select qid, max(case when rank <= 5 and contains(d.text, b.text) then 1 else 0 end)::int as hit from lex join documents d using (doc_id) join benchmark b on b.item_id = qid group by qid")
def hit_rate(t):
    held = _qrels(t).select("qid", "doc_id").distinct().withColumn("h", F.lit(1))
    return bm25_topk(t).join(held, ["qid", "doc_id"], "left").groupBy("qid").agg(F.max(F.when(F.col("rank") <= 5, F.coalesce("h", F.lit(0))).otherwise(0)).alias("hit"))


@query("""with e as (select event_id, (event_id % 10) / 10.0 as a, (event_id % 7) / 7 as b, (event_id % 5) / 5 as c, (event_id % 3) / 3 as d, (event_id % 4) / 4 as h from events)
select event_id, round(greatest(0, least(1, (a * 0.3 + b * 0.4 + c * 0.15 + d * 0.15) * (1 - 0.5 * h))), 5)::double as score from e""")
def composite_score(t):
    n = F.col("event_id")
    score = maths.composite_score((n % 10) / 10, (n % 7) / 7, (n % 5) / 5, (n % 3) / 3, (n % 4) / 4)
    return t("events").select("event_id", F.round(score, 5).alias("score"))


@query("select event_id, case when event_id % 5 = 0 then 'proceed' when value / 100 >= 0.3 then 'proceed' when (event_id % 10) / 10.0 < 0.5 then 'chat' else 'refuse' end as shunt from events")
def generate_shunt(t):
    best = F.when(F.col("event_id") % 5 > 0, F.col("value") / 100)
    return t("events").select("event_id", F.when(best.isNull() | (best >= 0.3), "proceed").when((F.col("event_id") % 10) / 10 < 0.5, "chat").otherwise("refuse").alias("shunt"))


@query(f"select conv_id, turn, regexp_matches(text, '{text.COREFERENCE}') as refers from conversations")
def coreference(t):
    return t("conversations").select("conv_id", "turn", text.has_coreference(F.col("text")).alias("refers"))


@query(f"""with d as (select doc_id, list_distinct({TOKENS}) as t from documents), b as (select item_id as qid, list_distinct({TOKENS}) as q from benchmark)
select qid, doc_id, round(len(list_intersect(q, t)) / len(q), 6) as score from d, b where len(list_intersect(q, t)) > 0 qualify row_number() over (partition by qid order by round(len(list_intersect(q, t)) / len(q), 6) desc, doc_id) <= 5""")
def term_overlap_topk(t):
    return lexical.shared_words(t("documents"), passages(t), 5).select("qid", "doc_id", "score")


@query("select conv_id, turn, list_aggregate(list_transform(['the', 'de', 'und'], lambda k: case when contains(lower(text), k) then 1 else 0 end), 'sum') / 3 as coverage from conversations")
def keyword_coverage(t):
    keys = F.array(*map(F.lit, ("the", "de", "und")))
    return t("conversations").select("conv_id", "turn", text.keyword_coverage(F.col("text"), keys).alias("coverage"))


# Digests of 4096 texts each, of 4096 such digests each, and of those.
@query("""with r as (select item_id % 4 as source, item_id, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as d from benchmark),
b as (select source, item_id // 4096 as k, sha256(string_agg(d, '|' order by item_id)) as d from r group by all), c as (select source, k // 4096 as k, sha256(string_agg(d, '|' order by k)) as d from b group by source, k // 4096)
select source, sha256(string_agg(d, '|' order by k)) as digest from c group by source""")
def corpus_digest(t):
    rows = t("benchmark").select((F.col("item_id") % 4).alias("source"), "item_id", "text")
    return stores.corpus_digest(rows, "source", "item_id", text.collapsed(F.col("text")))


@query("select p_partkey, round(p_size * 1.8::double + 32, 2) as fahrenheit, round(p_retailprice / 25.4, 4) as inches, round(p_retailprice::decimal(12, 2) * 0.145038, 4)::double as psi from part")
def unit_conversion(t):
    return t("part").select("p_partkey", F.round(F.col("p_size") * 1.8 + 32, 2).alias("fahrenheit"), F.round(F.col("p_retailprice") / 25.4, 4).alias("inches"), F.expr("cast(round(cast(p_retailprice as decimal(12, 2)) * 0.145038, 4) as double)").alias("psi"))


@query("select conv_id, turn, md5('<<' || chr(10) || replace(replace(text, '<<', '\\<<'), '>>', '\\>>') || chr(10) || '>>') as digest from conversations")
def fenced_evidence(t):
    return t("conversations").select("conv_id", "turn", F.md5(text.fenced(F.col("text"), "<<", ">>")).alias("digest"))


@query("select doc_id, contains(text, source) or contains(source, text) as cited from documents")
def citation_check(t):
    return t("documents").select("doc_id", guard.cited(F.col("source"), F.array("text")).alias("cited"))
