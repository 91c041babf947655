"""Queries over the supplied tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import maths, text, vectors
from ..operators import chunking, evals, generations, graph, guard, lexical, logs, ranges, ranking
from ..sources.readers import html_sections
from .planner import evidence_state, planned

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

CJK = r"[\x{4e00}-\x{9fff}]"
TOKENS = rf"list_filter(regexp_extract_all(lower(text), '[a-zA-Z0-9_]+|{CJK}+'), lambda t: length(t) >= 2 or regexp_matches(t, '^{CJK}'))"
DECIMALS = 6


def query(sql: str | None = None):
    def register(f):
        name = f.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return f

    return register


def queries() -> dict:
    from . import catalogue_adapters, catalogue_answers, catalogue_channels, catalogue_checks, catalogue_context, catalogue_judged, catalogue_more, catalogue_pages, catalogue_records, catalogue_splits, catalogue_stores  # noqa: F401  register their own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)


def passages(t) -> DataFrame:
    return t("benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


# Lexical search.
BM25 = rf"""
with d as (select doc_id, source, {TOKENS} as t from documents), st as (select count(*) as n, avg(len(t)) as avgdl from d),
tf as (select doc_id, source, len(t) as dl, term, count(*) as tf from (select doc_id, source, t, unnest(t) as term from d) group by all),
df as (select term, count(*) as df from tf group by term),
q as (select item_id as qid, term, count(*) as qf from (select item_id, unnest({TOKENS}) as term from benchmark) group by all),
s as (select qid, doc_id, round(sum(qf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as score
  from tf join df using (term) join q using (term), st {{where}} group by qid, doc_id)
select qid, doc_id, score, row_number() over (partition by qid order by score desc, doc_id)::int as rank from s where score > 0
qualify rank <= 10"""


def bm25_sql(where: str) -> str:
    return BM25.replace("{where}", where)


@query(bm25_sql(""))
def bm25_topk(t):
    return lexical.bm25_topk(t("documents"), passages(t))


@query(bm25_sql("where source in ('src0', 'src1')"))
def bm25_topk_source_filter(t):
    return lexical.bm25_topk(t("documents"), passages(t), keep=F.col("source").isin("src0", "src1"))


@query(rf"""with tf as (select distinct doc_id, unnest({TOKENS}) as term from documents), n as (select count(*) as n from documents)
select term, count(*) as df, round(ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1), 6) as idf from tf, n group by term""")
def bm25_term_stats(t):
    return lexical.term_stats(t("documents")).select("term", "df", F.round("idf", DECIMALS).alias("idf"))


@query(f"select doc_id, len({TOKENS})::int as dl from documents")
def bm25_doc_lengths(t):
    return lexical.doc_stats(t("documents"))


@query(rf"""with d as (select doc_id, term, count(*) as tf from (select doc_id, unnest({TOKENS}) as term from documents) group by all),
q as (select item_id as qid, term, count(*) as qf from (select item_id, unnest({TOKENS}) as term from benchmark) group by all)
select qid, doc_id, sum(tf * qf)::double as score, row_number() over (partition by qid order by sum(tf * qf) desc, doc_id::varchar)::int as rank from d join q using (term) group by qid, doc_id qualify rank <= 10""")
def sparse_dot_topk(t):
    return lexical.sparse_topk(t("documents"), passages(t))


# Dense search: the query set is every vector whose id is divisible by 20.
DENSE = """with q as (select vec_id as qid, embedding as e from embeddings where vec_id % 20 = 0),
s as (select qid, vec_id as id, round({score}, 6) as score from embeddings, q {where})
select qid, id, score, row_number() over (partition by qid order by score desc, id::varchar)::int as rank from s qualify rank <= 10"""
IP = "list_dot_product(embedding::double[], e::double[])"


def _vectors(t):
    e = t("embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label"), e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))


@query(DENSE.format(score=IP, where=""))
def dense_topk_ip(t):
    return ranking.dense_topk(*_vectors(t))


@query(DENSE.format(score=f"{IP} / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product(e::double[], e::double[])))", where=""))
def dense_topk_cosine(t):
    return ranking.dense_topk(*_vectors(t), by="cosine")


@query(DENSE.format(score=IP, where="where label in (0, 1)"))
def dense_filtered(t):
    return ranking.dense_topk(*_vectors(t), keep=F.col("label").isin(0, 1))


@query()
def mmr_rerank(t):
    found, asked = _vectors(t)
    pool = ranking.dense_topk(found, asked, k=40).join(found.select("id", "vec"), "id").select("qid", "id", "vec", "score")
    return ranking.mmr(pool, asked, 10)


# A label's vectors as a token matrix; at most 64 tokens of a query and 512 of a document count.
@query("""with n as (select *, row_number() over (partition by label order by vec_id) as n from embeddings where label is not null),
m as (select label, list(embedding::double[] order by vec_id) filter (n <= 64) as v, list(embedding::double[] order by vec_id) as w from n where n <= 512 group by label),
c as (select a.label as a, b.label as b, unnest(a.v) as q, b.w as d from m a, m b)
select a, b, round(avg(list_max(list_transform(d, lambda x: list_dot_product(q, x) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(x, x)))))), 6) as score from c group by a, b""")
def maxsim(t):
    first = t("embeddings").where("label is not null").withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).where("n <= 512")
    tokens = first.select("label", "n", vectors.unit(vectors.doubles(F.col("embedding"))).alias("v"))
    best = tokens.where("n <= 64").select(F.col("label").alias("a"), "n", F.col("v").alias("q")).join(tokens.select(F.col("label").alias("b"), F.col("v").alias("d")))
    most = best.groupBy("a", "b", "n").agg(F.max(vectors.dot(F.col("q"), F.col("d"))).alias("most"))
    return most.groupBy("a", "b").agg(F.round(F.avg("most"), DECIMALS).alias("score"))


# Fusion: lexical and shared-word channels over the same passages, and a graph channel for some.
CHANNELS = f"""lex as ({bm25_sql('')}), bag as ({SQL['sparse_dot_topk']})"""


def _channels(t):
    lex = bm25_topk(t).select("qid", F.concat(F.lit("chunk:"), F.col("doc_id")).alias("key"), "rank")
    return lex, sparse_dot_topk(t).select("qid", F.concat(F.lit("chunk:"), F.col("doc_id")).alias("key"), "rank")


@query(f"""with {CHANNELS}, u as (select qid, 'chunk:' || doc_id as key, 0.5 / (60 + rank) as part from lex union all select qid, 'chunk:' || doc_id, 0.5 / (60 + rank) from bag),
s as (select qid, key, round(sum(part) / 1.0, 9) as score from u group by qid, key) select *, row_number() over (partition by qid order by score desc, key)::int as rank from s""")
def rrf_two_channel(t):
    lex, bag = _channels(t)
    return ranking.rrf([(lex, 0.5, True), (bag, 0.5, True)])


@query(f"""with {CHANNELS}, g as (select qid, 'chunk:' || doc_id as key, rank from lex where qid % 2 = 0 and rank <= 3),
u as (select qid, 'chunk:' || doc_id as key, 0.5 / (60 + rank) as part from lex union all select qid, 'chunk:' || doc_id, 0.5 / (60 + rank) from bag union all select qid, key, 0.4 / (60 + rank) from g),
s as (select qid, key, round(sum(part) / (1.0 + case when qid in (select qid from g) then 0.4 else 0.0 end), 9) as score from u group by qid, key) select *, row_number() over (partition by qid order by score desc, key)::int as rank from s""")
def rrf_three_channel(t):
    lex, bag = _channels(t)
    return ranking.rrf([(lex, 0.5, True), (bag, 0.5, True), (lex.where("qid % 2 = 0 and rank <= 3"), 0.4, False)])


# Scores in pools: events of a user and type, with the value as a logit.
@query("""select event_id, case when hi = lo then 0.5 else round((value - lo) / (hi - lo), 6) end as scaled
from (select *, min(value) over w as lo, max(value) over w as hi from events window w as (partition by user_id))""")
def minmax_pool(t):
    return ranking.min_max(t("events").select("event_id", "user_id", "value"), "user_id", "value").select("event_id", F.round("scaled", DECIMALS).alias("scaled"))


@query("""with e as (select event_id, user_id, case when event_type <> 'signup' then value / 10 - 2 end as logit from events),
w as (select *, min(logit) over (partition by user_id) as lo, max(logit) over (partition by user_id) as hi from e),
p as (select *, logit is null or (1 / (1 + exp(-logit)) >= 0.35 and (hi = lo or (logit - lo) / (hi - lo) >= 0.3)) as ok from w)
select event_id, user_id, round(logit, 6) as logit from p
qualify ok or (logit is not null and max(case when ok and logit is not null then 1 else 0 end) over (partition by user_id) = 0 and row_number() over (partition by user_id, logit is null order by logit desc nulls last) = 1)""")
def rerank_dual_sieve(t):
    rows = t("events").select("event_id", "user_id", F.when(F.col("event_type") != "signup", F.col("value") / 10 - 2).alias("logit"))
    return ranking.dual_sieve(rows, "user_id", "logit").select("event_id", "user_id", F.round("logit", DECIMALS).alias("logit"))


@query("""with e as (select event_id, case when event_id % 3 > 0 then 1 / (1 + exp(-(value / 10 - 2))) end as a, case when event_id % 5 > 0 then least(value / 100, 1.0) end as b, case when event_id % 7 > 0 then (event_id % 10) / 10.0 end as c from events),
w as (select *, (case when a is null then 0 else 0.5 end + case when b is null then 0 else 0.4 end + case when c is null then 0 else 0.1 end)::double as total from e)
select event_id, round(case when total > 0 then (coalesce(a * 0.5, 0) + coalesce(b * 0.4, 0) + coalesce(c * 0.1, 0)) / total end, 6)::double as fused from w""")
def fused_relevance(t):
    n = F.col("event_id")
    a = F.when(n % 3 > 0, maths.sigmoid(F.col("value") / 10 - 2))
    b = F.when(n % 5 > 0, F.least(F.col("value") / 100, F.lit(1.0)))
    c = F.when(n % 7 > 0, (n % 10) / 10)
    return t("events").select("event_id", F.round(maths.fused_relevance(a, b, c), DECIMALS).alias("fused"))


@query("""select o_orderkey, round(case when age <= 0 then o_totalprice else o_totalprice * greatest(0.1, least(1.0, pow(0.5, age / 180.0))) end, 1) as score
from (select *, date_diff('day', o_orderdate, timestamp '1998-12-31') as age from orders)""")
def time_decay_rank(t):
    age = F.datediff(F.lit("1998-12-31").cast("date"), "o_orderdate").cast("double")
    return t("orders").select("o_orderkey", F.round(ranking.time_decayed(None, F.col("o_totalprice"), age), 1).alias("score"))


VERSIONS = """v as (select p_partkey as id, p_brand as family, case p_partkey % 4 when 0 then 'obsolete' when 1 then 'draft' when 2 then 'active' end as status,
case p_partkey % 3 when 0 then 'official' when 1 then 'internal' else '2' end as authority, 'r' || p_size as revision, p_retailprice as relevance from part)"""


def _versions(t):
    n = F.col("p_partkey")
    status = F.when(n % 4 == 0, "obsolete").when(n % 4 == 1, "draft").when(n % 4 == 2, "active")
    authority = F.when(n % 3 == 0, "official").when(n % 3 == 1, "internal").otherwise("2")
    return t("part").select(n.alias("id"), F.col("p_brand").alias("family"), status.alias("status"), authority.alias("authority"), F.concat(F.lit("r"), "p_size").alias("revision"), F.lit(None).cast("string").alias("effective_date"), F.col("p_retailprice").alias("relevance"))


RANKS = "case status when 'obsolete' then 0 when 'draft' then 1 else 2 end as s, case authority when 'official' then 5.0 when 'internal' then 3.0 else 2.0 end as a, regexp_replace(revision, '[^0-9]', '', 'g')::bigint as r"


@query(f"with {VERSIONS} select family, id, row_number() over (partition by family order by s desc, a desc, r desc, revision desc, relevance desc, id)::int as rank from (select *, {RANKS} from v)")
def authority_rank(t):
    return ranking.authority_order(_versions(t), "family").select("family", "id", "rank")


@query(f"with {VERSIONS} select family, a::double as authority, count(distinct revision) as revisions from (select *, {RANKS} from v) where s = 2 group by family, a having count(distinct revision) > 1")
def version_conflict(t):
    return ranking.version_conflicts(_versions(t))


@query(rf"""with lex as ({bm25_sql('')}), h as (select l.qid, l.doc_id, l.score, case when d.doc_id % 5 > 0 then 'parent:' || d.source else 'orphan:' || d.doc_id end as key, case when d.doc_id % 5 > 0 then d.source end as p, d.lang from lex l join documents d using (doc_id)),
b as (select * from h qualify row_number() over (partition by qid, key order by score desc, doc_id) = 1)
select qid, key, doc_id as id, score, case when p is not null and p < 'src5' then 'section ' || p else lang end as content from b""")
def parent_expand(t):
    docs = t("documents").select("doc_id", F.col("lang").alias("text"), F.when(F.col("doc_id") % 5 > 0, F.col("source")).alias("parent_id"))
    hits = bm25_topk(t).join(docs, "doc_id").select("qid", F.col("doc_id").alias("id"), "parent_id", "text", "score")
    parents = t("documents").where("source < 'src5'").select(F.col("source").alias("parent_id"), F.concat(F.lit("section "), "source").alias("content")).distinct()
    return ranking.parent_expanded(hits, parents)


@query(f"with lex as ({bm25_sql('')}), b as (select l.qid, l.doc_id, l.score, d.source from lex l join documents d using (doc_id) qualify row_number() over (partition by qid, source order by score desc, doc_id) = 1) select qid, doc_id, score, source, row_number() over (partition by qid order by score desc, doc_id)::int as rank from b qualify rank <= 5")
def best_per_source(t):
    hits = bm25_topk(t).select("qid", "doc_id", "score").join(t("documents").select("doc_id", "source"), "doc_id")
    return ranking.best_per_source(hits, "qid", "source", "score", "doc_id", 5).select("qid", "doc_id", "score", "source", "rank")


@query(f"""with lex as ({bm25_sql('')}), h as (select l.qid, l.doc_id as id, l.rank, d.source as key, case when d.lang in ('en', 'fr') then d.lang end as facet from lex l join documents d using (doc_id)),
f as (select * from h qualify row_number() over (partition by qid, key order by rank) = 1), g as (select qid, facet, min_by(id, rank) as id from f where facet is not null group by all)
select qid, id, key, rank, row_number() over (partition by qid order by case when (qid, id) in (select (qid, id) from g) then 0 else 1 end, rank)::int as place from f qualify place <= 4""")
def select_evidence(t):
    hits = bm25_topk(t).join(t("documents").select("doc_id", "source", "lang"), "doc_id")
    matched = F.when(F.col("lang").isin("en", "fr"), F.array("lang")).otherwise(F.array().cast("array<string>"))
    return ranking.selected(hits.select("qid", F.col("doc_id").alias("id"), F.col("source").alias("key"), "rank", matched.alias("matched")), 4)


@query(f"""with lex as ({bm25_sql('')}), k as (select l.qid, l.doc_id, l.score, (floor(length(d.text) / 4) + 1)::int as n from lex l join documents d using (doc_id))
select qid, doc_id, (sum(n + 2) over w)::bigint as used from k window w as (partition by qid order by score desc, doc_id rows between unbounded preceding and current row) qualify used <= 2000 or row_number() over (partition by qid order by score desc, doc_id) = 1""")
def token_pack_break(t):
    hits = bm25_topk(t).join(t("documents").select("doc_id", text.token_estimate(F.col("text")).alias("n")), "doc_id")
    return ranking.packed(hits, "qid", "n", "score", "doc_id", 2000).select("qid", "doc_id", "used")


# Queries and their plans.
QUESTIONS = "q as (select conv_id * 1000 + turn as qid, case turn % 8 when 0 then 'How to ' || text when 1 then 'Compare red and blue' when 2 then 'see figure 3' when 3 then 'error ABC-12-X9' when 4 then 'overview of it' when 5 then 'a and b and c and d' when 6 then 'x' else text end as query from conversations)"
CLASS = r"""case when length(trim(query)) < 2 then 'ambiguous' when regexp_matches(lower(query), '(图\s*\d+|表\s*\d+|截图|曲线|图像|diagram|chart|figure|image)') then 'visual'
when regexp_matches(lower(query), '(总结|概述|综述|整份|全文|核心主题|overall|summari[sz]e|overview)') then 'global_summary' when regexp_matches(lower(query), '(比较|对比|区别|差异|\bvs\.?\b|versus|difference between)') then 'comparison'
when regexp_matches(lower(query), '(如何|怎样|步骤|流程|操作方法|how to|steps? to|procedure)') then 'procedure' when regexp_matches(query, '[A-Z]{2,}[A-Z0-9]*([-_.:/][A-Z0-9]+)+') or regexp_matches(query, '(?i)\b(0x)?[0-9a-f]{6,}\b') then 'exact'
when regexp_matches(lower(query), '(两跳|三跳|关系链|关联路径|通过.+影响|multi[- ]?hop)') then 'multi_hop' when len(regexp_extract_all(lower(query), '(并且|同时|且|以及|\band\b)')) >= 3 then 'multi_constraint' else 'semantic' end"""


def _questions(t):
    n, body = F.col("turn") % 8, F.col("text")
    asked = F.when(n == 0, F.concat(F.lit("How to "), body)).when(n == 1, "Compare red and blue").when(n == 2, "see figure 3").when(n == 3, "error ABC-12-X9").when(n == 4, "overview of it").when(n == 5, "a and b and c and d").when(n == 6, "x").otherwise(body)
    return t("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), asked.alias("query"))


@query(f"with {QUESTIONS} select qid, {CLASS} as query_class from q")
def query_class(t):
    return _questions(t).select("qid", text.query_class(F.col("query")).alias("query_class"))


@query(f"""with {QUESTIONS}, c as (select qid, {CLASS} as query_class from q)
select qid, query_class, case query_class when 'exact' then 0.3 when 'comparison' then 0.45 when 'multi_constraint' then 0.45 when 'multi_hop' then 0.4 when 'global_summary' then 0.4 when 'visual' then 0.4 else 0.5 end::double as dense,
case query_class when 'exact' then 0.7 when 'comparison' then 0.4 when 'multi_constraint' then 0.4 when 'multi_hop' then 0.3 when 'global_summary' then 0.25 when 'visual' then 0.3 else 0.5 end::double as sparse,
case when query_class in ('comparison', 'multi_constraint', 'multi_hop', 'global_summary') then 15 else 10 end::int as candidate_k, query_class = 'ambiguous' as degraded from c""")
def channel_plan(t):
    return planned(_questions(t)).select("qid", "query_class", "dense", "sparse", "candidate_k", "degraded")


@query(f"""with {QUESTIONS}, c as (select qid, {CLASS} as query_class from q), h as (select user_id as u, max(1 / (1 + exp(-(value / 10 - 4)))) as rel from events where event_type = 'view' group by user_id)
select qid, case when rel is null then 'empty' when rel < 0.35 then 'weak' else 'accept' end as state from c left join h on qid % 200 = u""")
def corrective_state(t):
    seen = t("events").where("event_type = 'view'").select(F.col("user_id").alias("u"), maths.sigmoid(F.col("value") / 10 - 4).alias("relevance"))
    asked = _questions(t)
    hits = asked.join(seen.groupBy("u").agg(F.max("relevance").alias("relevance")), F.col("qid") % 200 == F.col("u")).select("qid", "relevance", F.lit(False).alias("conflict"))
    return evidence_state(hits, planned(asked)).select("qid", "state")


@query(r"""select item_id, regexp_matches(text, '[A-Z]{2,}[A-Z0-9]*([-_.:/][A-Z0-9]+)+') or regexp_matches(text, '(?i)\b(0x)?[0-9a-f]{6,}\b') as exact from benchmark""")
def exact_identifier(t):
    return t("benchmark").select("item_id", text.exact_identifier(F.col("text")).alias("exact"))


@query("""with e as (select event_id, case when event_id % 4 > 0 then least(value / 100, 1.0) end as r, case when event_id % 3 > 0 then (event_id % 11) / 10.0 end as g, (event_id % 10) / 10.0 as i from events),
w as (select *, case when g is null then 0.8 else 0.4 end as wr from e), x as (select *, (coalesce(r * wr, 0) + coalesce(g * 0.4, 0) + i * 0.2) / (case when r is null then 0 else wr end + case when g is null then 0 else 0.4 end + 0.2) as c from w)
select event_id, round(c, 6)::double as confidence, case when round(c, 6) >= 0.8 then 'high' when round(c, 6) >= 0.5 then 'medium' else 'low' end as level from x""")
def confidence_blend(t):
    n = F.col("event_id")
    c = maths.answer_confidence(F.when(n % 4 > 0, F.least(F.col("value") / 100, F.lit(1.0))), F.when(n % 3 > 0, (n % 11) / 10), (n % 10) / 10)
    return t("events").select("event_id", F.round(c, DECIMALS).alias("confidence")).select("*", maths.confidence_level(F.col("confidence")).alias("level"))


# Evaluation: relevant documents of a passage are those that hold it.
QRELS = "qrels as (select item_id as qid, d.doc_id, 1 + coalesce(l.quality, 0) as grade from benchmark b join documents d on contains(d.text, b.text) left join labels l on l.doc_id = d.doc_id)"


def _qrels(t):
    asked = t("benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("passage"))
    held = lexical.holders(t("documents"), asked)
    return held.join(t("labels").select("doc_id", "quality"), "doc_id", "left").select("qid", "doc_id", (1 + F.coalesce("quality", F.lit(0))).alias("grade"))


@query(f"""with {QRELS}, lex as ({bm25_sql('')}), e as (select qid, list(distinct doc_id) as e from qrels group by qid), f as (select qid, list(doc_id) as f from lex group by qid)
select item_id as qid, case when e is not null and f is not null then round(len(list_intersect(e, f)) / len(f), 6) end as context_precision, case when e is not null then round(case when f is null then 0 else len(list_intersect(e, f)) / len(e) end, 6) end as context_recall
from benchmark left join e on e.qid = item_id left join f on f.qid = item_id""")
def context_pr(t):
    expected = _qrels(t).groupBy("qid").agg(F.collect_set("doc_id").alias("e"))
    found = bm25_topk(t).groupBy("qid").agg(F.collect_list("doc_id").alias("f"))
    rows = passages(t).select("qid").join(expected, "qid", "left").join(found, "qid", "left")
    none = F.array().cast("array<bigint>")
    p, r = evals.context_precision_recall(F.coalesce("e", none), F.coalesce("f", none))
    return rows.select("qid", F.round(p, DECIMALS).alias("context_precision"), F.round(r, DECIMALS).alias("context_recall"))


@query(f"""with {QRELS}, lex as ({bm25_sql('')}), g as (select qid, doc_id, max(grade) as grade from qrels group by qid, doc_id), i as (select *, row_number() over (partition by qid order by grade desc, doc_id) as place from g),
ideal as (select qid, sum(case when place <= 10 then grade / log2(place + 1) else 0 end) as ideal, count(*) as n from i group by qid),
got as (select l.qid, sum(grade / log2(rank + 1)) as dcg, min(rank) as first, count(*) as deep from lex l join i on i.qid = l.qid and i.doc_id = l.doc_id group by l.qid)
select qid, round(coalesce(dcg / ideal, 0), 6) as ndcg, round(coalesce(1 / first, 0), 6) as rr, round(coalesce(deep / n, 0), 6) as recall from ideal left join got using (qid)""")
def graded_ndcg10(t):
    return evals.ranked_metrics(bm25_topk(t).select("qid", "doc_id", "rank"), _qrels(t))


RUNS = "runs as (select event_id, user_id, event_type as variant, user_id % 3 as dataset, user_id % 4 as position, least(value / 100, 1.0) as score, event_id % 17 = 0 as error from events)"


def _runs(t):
    return t("events").select("event_id", "user_id", F.col("event_type").alias("variant"), (F.col("user_id") % 3).alias("dataset"), (F.col("user_id") % 4).alias("position"), F.least(F.col("value") / 100, F.lit(1.0)).alias("score"), (F.col("event_id") % 17 == 0).alias("error"))


@query(f"with {RUNS} select variant, count(*) as total, sum(case when score >= 0.2 and not error then 1 else 0 end)::bigint as passed, round(avg(score), 6) as average, count(*) - sum(case when score >= 0.2 and not error then 1 else 0 end)::bigint as failed from runs group by variant")
def eval_report(t):
    return evals.report(_runs(t), "variant", 0.2)


@query(f"with {RUNS} select dataset, variant, round(median(score), 6) as median, round(min(score), 6) as worst, count(score) as runs from runs group by dataset, variant")
def variant_medians(t):
    return evals.medians(_runs(t), "dataset", "variant", metric="score")


@query(f"""with {RUNS}, m as (select dataset, variant, avg(score) as s from runs group by all)
select a.dataset, a.variant, round(a.s - b.s, 6) as delta, round((a.s - b.s) / b.s, 6) as relative from m a join m b on a.dataset = b.dataset and b.variant = 'view' where a.variant <> 'view'""")
def reference_delta(t):
    means = _runs(t).groupBy("dataset", "variant").agg(F.avg("score").alias("s"))
    return evals.reference_delta(means, "dataset", "variant", "s", "view")


@query(f"""with {RUNS}, o as (select user_id, avg(score) as s from runs where position < 2 and variant = 'view' group by 1), n as (select user_id, avg(score) as s from runs where position < 3 and variant = 'click' group by 1)
select user_id, round(o.s, 6) as old, round(n.s, 6) as new, round(n.s - o.s, 6) as delta, o.s - n.s > 0.05 as regressed from o full join n using (user_id)""")
def run_compare(t):
    mean = lambda rows: rows.groupBy("user_id").agg(F.avg("score").alias("s"))
    return evals.compared(mean(_runs(t).where("position < 2 and variant = 'view'")), mean(_runs(t).where("position < 3 and variant = 'click'")), "user_id", "s")


@query("""with u as (select user_id, round(avg(value), 6) as quality, count(*)::double as price from events group by user_id)
select user_id, quality, price from u a where not exists (select 1 from u b where b.price <= a.price and b.quality >= a.quality and (b.price < a.price or b.quality > a.quality))""")
def pareto(t):
    rows = t("events").groupBy("user_id").agg(F.round(F.avg("value"), DECIMALS).alias("quality"), F.count(F.lit(1)).cast("double").alias("price"))
    return evals.pareto(rows, "user_id", "quality", "price")


@query(f"""with {RUNS}, p as (select variant, position, quantile_disc(score, 0.95) as p95 from runs group by all)
select variant, round(min(p95), 6) as least, round(max(p95), 6) as most, round(median(p95), 6) as middle, (round(max(p95), 6) - round(min(p95), 6)) / round(min(p95), 6) > 0.25 as warning from p group by variant""")
def position_drift(t):
    return evals.drift(_runs(t), "variant", "position", "score")


# Logs.
@query("select event_type, count(*) as n, round((select count(*) from events where event_type = 'purchase') / (select count(*) from events), 6) as positive_rate from events group by event_type")
def feedback_stats(t):
    return logs.rates(t("events"), "event_type", "purchase")


@query("""with w as (select * from events qualify row_number() over (partition by event_type order by event_id) > 1)
select event_type, count(*) as n, round(median(value), 6) as p50, round(quantile_disc(value, 0.95), 6) as p95 from w group by event_type""")
def latency_summary(t):
    return logs.latency_summary(t("events"), "event_type", "value", "event_id")


@query("select date_trunc('day', ts) as day, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95, quantile_disc(value, 0.99) as p99 from events group by 1")
def percentile_report(t):
    rows = t("events").select(F.date_trunc("day", "ts").alias("day"), "value")
    return ranges.quantiles(rows, ["day"], "value", {f"p{round(100 * p)}": p for p in (0.5, 0.95, 0.99)}).drop("n")


@query("select user_id, sum(json_extract(props, '$.k')::bigint)::bigint as tokens, round(sum(json_extract(props, '$.k')::bigint) / 1e6 * 2.5, 9) as cost from events group by user_id")
def token_cost(t):
    used = t("events").select("user_id", F.get_json_object("props", "$.k").cast("bigint").alias("k")).groupBy("user_id").agg(F.sum("k").alias("tokens"))
    return used.select("user_id", "tokens", F.round(maths.cost(F.col("tokens"), F.lit(2.5)), 9).alias("cost"))


@query("select user_id, round(sum(value), 4) as duration, count(*) as skills, count(*) filter (event_type = 'error') as errors, count(*) filter (event_type = 'error') = 0 as ok from events group by user_id")
def trace_summary(t):
    errors = F.count_if(F.col("event_type") == "error")
    return t("events").groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("duration"), F.count(F.lit(1)).alias("skills"), errors.alias("errors"), (errors == 0).alias("ok"))


@query("""with g as (select user_id, ts, case when lag(ts) over w is null or ts > lag(ts) over w + interval 12 hours then 1 else 0 end as new from events window w as (partition by user_id order by ts)),
n as (select *, sum(new) over (partition by user_id order by ts)::bigint as session from g) select user_id, session, min(ts) as "begin", max(ts) as "end", count(*) as n from n group by user_id, session""")
def session_gap_windows(t):
    return logs.sessions(t("events"), "user_id", "ts", 720)


@query("select conv_id, count(*) as n, max(turn) as last_turn from conversations group by conv_id")
def sessions_list(t):
    return t("conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.max("turn").alias("last_turn"))


@query("select conv_id, turn, row_number() over (partition by conv_id order by turn desc)::int as idx from conversations qualify idx <= 3")
def session_latest_n(t):
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return t("conversations").select("conv_id", "turn", F.row_number().over(order).alias("idx")).where("idx <= 3")


@query("select conv_id, left(replace(min_by(text, turn), chr(10), ' '), 50) as title from conversations where role = 'user' group by conv_id")
def session_title(t):
    first = t("conversations").where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    return first.select("conv_id", F.substring(F.replace("text", F.lit("\n"), F.lit(" ")), 1, 50).alias("title"))


@query("select conv_id, turn, case when count(*) over (partition by conv_id) > 5 and row_number() over (partition by conv_id order by turn desc) > 3 then 'old' else 'recent' end as part from conversations")
def history_compress_split(t):
    return logs.history_split(t("conversations"), 5, 3).select("conv_id", "turn", "part")


@query("""with f as (select *, sum(case when event_type = 'error' then 0 else 1 end) over (partition by user_id order by event_id) as run from events)
select user_id, event_id, 2::int as failures from f where event_type = 'error' qualify row_number() over (partition by user_id, run order by event_id) = 2""")
def circuit_openings(t):
    return logs.circuit_states(t("events"), "user_id", "event_id", F.col("event_type") == "error", 2)


@query("select event_id from events where event_type = 'error' or ('0x' || substr(md5(event_id::varchar), 1, 7))::bigint / 268435456.0 < 0.1")
def sampling_rule(t):
    return logs.sampled(t("events"), F.col("event_id"), F.col("event_type") == "error", 0.1).select("event_id")


# Graph: parts and suppliers that share an order line, weighted by lines; nations and regions.
EDGES = "e as (select l_partkey as src, 1000000 + l_suppkey as dst, count(*)::double as weight from lineitem group by all)"


def _edges(t):
    lines = t("lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 1000000).alias("dst"))
    lines = lines.repartition(graph.parts_of(lines), "src", "dst")  # Pairs hardly repeat, so lines are not summed before.
    return lines.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))


@query(f"with {EDGES} select dst as id, max(weight) as weight from e where src < 10 group by dst")
def neighbors_1hop(t):
    return graph.neighbours(_edges(t), t("part").where("p_partkey < 10").select(F.col("p_partkey").alias("id")))


@query(f"with {EDGES} select src, dst, max(weight) as weight from (select * from e union all select dst, src, weight from e) group by src, dst")
def adjacency_symmetric(t):
    return graph.adjacency(_edges(t), t("lineitem").count())


BORDERS = "b as (select n_nationkey as src, 1000 + n_regionkey as dst from nation)"


def _borders(t):
    return t("nation").select(F.col("n_nationkey").alias("src"), (F.col("n_regionkey") + 1000).alias("dst"), F.lit(1.0).alias("weight"))


@query(f"""with recursive {BORDERS}, l as (select src, dst from b union select dst, src from b), w(id, hops) as (select 0, 0 union select l.dst, w.hops + 1 from w join l on l.src = w.id where w.hops < 3)
select id, min(hops)::int as hops from w group by id""")
def bfs_reach(t):
    return graph.reach(_borders(t), t("nation").where("n_nationkey = 0").select(F.col("n_nationkey").alias("id")), 3)


@query(f"""with {BORDERS}, l as (select src, dst from b union select dst, src from b), p as (select x.n_nationkey as a, y.n_nationkey as b from nation x, nation y where x.n_nationkey < 3 and x.n_nationkey < y.n_nationkey)
select a, b, array_to_string([a, m.dst, b], '>') as path from p join l m on m.src = a join l n on n.src = m.dst and n.dst = b""")
def shortest_paths(t):
    x, y = (t("nation").select(F.col("n_nationkey").alias(c)) for c in "ab")
    found = graph.shortest_paths(_borders(t), x.where("a < 3").join(y, F.col("a") < F.col("b")), 3)
    return found.select("a", "b", F.array_join(found["path"].cast("array<string>"), ">").alias("path"))


@query()
def ppr(t):
    seeds = t("part").where("p_partkey < 5").select(F.col("p_partkey").alias("id"))
    return graph.pagerank(_edges(t), seeds, rounds=100, rows=t("lineitem").count()).select("id", F.round("rank", DECIMALS).alias("rank"), "converged")


# Chunks.
@query(r"""select doc_id, (place - 1)::int as place, trim(body) as body from (select doc_id, unnest(string_split(text, chr(10))) as body, generate_subscripts(string_split(text, chr(10)), 1) as place from documents) where length(trim(body)) > 0""")
def para_split(t):
    return chunking.paragraphs(t("documents"), "\n")


@query("""with d as (select doc_id, source, text, unnest(case when length(text) <= 3840 then [0] else range(0, greatest(length(text) - 120, 1)::bigint, 780) end) as start from documents where length(text) > 0)
select doc_id, left(sha1(source || '::' || doc_id), 16) as parent_id, (start // 780)::int as place, sha1(case when length(text) <= 3840 then text else substr(text, start::bigint + 1, 900) end) as chunk from d""")
def recursive_window_chunks(t):
    return chunking.window_chunks(t("documents")).select("doc_id", "parent_id", "place", F.sha1("chunk").alias("chunk"))


@query(r"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as place from documents)
select doc_id, place::int as place, len(list_filter(regexp_split_to_array(line, '\||\t| {2,}'), lambda c: trim(c) <> '')) >= 2 as is_row from l""")
def table_rows(t):
    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    return lines.select("doc_id", "place", chunking.table_row(F.col("line")).alias("is_row"))


@query("select doc_id, md5('【source】' || source || ' | 【lang】' || lang || chr(10) || chr(10) || text) as indexed from documents")
def contextual_text(t):
    return t("documents").select("doc_id", F.md5(chunking.contextual(F.col("text"), {"source": F.col("source"), "lang": F.col("lang")})).alias("indexed"))


@query("""with p as (select source, doc_id, left(text, 600) as part, ((row_number() over (partition by source order by doc_id) - 1) // 8)::bigint as node from documents),
l as (select source, node, left(string_agg(part, chr(10) order by doc_id), 1600) as summary, count(*) as children, 1::int as level from p group by source, node),
r as (select source, 0::bigint as node, left(string_agg(left(summary, 600), chr(10) order by node), 1600) as summary, count(*) as children, 2::int as level from l group by source having count(*) > 1)
select source, node, md5(summary) as summary, children, level from (select * from l union all select * from r)""")
def summary_tree(t):
    return chunking.summary_tree(t("documents")).select("source", "node", F.md5("summary").alias("summary"), "children", "level")


@query()
def html_section_rows(t):
    return html_sections(t("pages"))


# Identities and duplicates.
@query(r"select doc_id, left(sha1(trim(regexp_replace(text, '\s+', ' ', 'g'))), 12) as content_id, 'chunk:' || doc_id as doc_key, left(md5(left(text, 500)), 12) as variant_key, source || '|' || lang || '|' || left(sha1(text), 16) as fusion_key from documents")
def content_ids(t):
    body = F.col("text")
    return t("documents").select("doc_id", text.content_id(body).alias("content_id"), text.doc_key(F.col("doc_id"), body).alias("doc_key"), text.variant_identity(body).alias("variant_key"), text.fusion_identity(F.col("source"), F.col("lang"), body).alias("fusion_key"))


@query("select n_nationkey, left(sha1(lower(trim(n_name)) || '::nation'), 16) as id from nation")
def entity_ids(t):
    return t("nation").select("n_nationkey", text.entity_id(F.col("n_name"), F.lit("Nation")).alias("id"))


@query("select min(doc_id) as doc_id, count(*) as copies, md5(text) as digest from documents group by text")
def dedupe_exact(t):
    return t("documents").groupBy(F.md5("text").alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query(r"select page_id, replace(regexp_extract(url, '([^/\\]*)$', 1), '..', '_') as name from pages")
def filename_secure(t):
    return t("pages").select("page_id", text.secure_filename(F.col("url")).alias("name"))


@query(f"select doc_id, case when length(text) = 0 then 0 else (floor(len(regexp_extract_all(text, '{CJK}')) / 1.5 + (length(text) - len(regexp_extract_all(text, '{CJK}'))) / 4) + 1)::int end as n from documents")
def token_estimate(t):
    return t("documents").select("doc_id", text.token_estimate(F.col("text")).alias("n"))


# Guardrails.
@query(r"""select doc_id, regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') as email, regexp_matches(text, '(?:^|[^0-9])1[3-9][0-9]{9}(?:$|[^0-9])') as phone, regexp_matches(text, '(?:^|[^0-9])[1-9][0-9]{15,18}(?:$|[^0-9])') as bank_card,
regexp_matches(text, '(?:^|[^0-9])(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}(?:$|[^0-9])') as ip from documents""")
def pii_flag(t):
    return t("documents").select("doc_id", *(guard.found(F.col("text"), k).alias(k) for k in ("email", "phone", "bank_card", "ip")))


@query(r"select doc_id, md5(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[已脱敏:email]', 'g')) as digest from documents")
def pii_redact_email(t):
    return t("documents").select("doc_id", F.md5(F.regexp_replace("text", guard.PATTERNS["email"], "[已脱敏:email]")).alias("digest"))


@query(f"select conv_id, turn, case when length(text) > 2000 then 'block:length' when regexp_matches(text, '{guard.INJECTION}') then 'block:injection' else 'allow' end as verdict from conversations")
def input_verdict(t):
    return t("conversations").select("conv_id", "turn", guard.verdict(F.col("text")).alias("verdict"))


CLAIMS = f"""list_filter(list_transform(regexp_split_to_array(text, '{text.CLAIM_ENDS}'), lambda p: regexp_replace(regexp_replace(regexp_replace(p, '{text.CLAIM_MARKS[0]}', '', 'g'), '{text.CLAIM_MARKS[1]}', ''), '{text.CLAIM_MARKS[2]}', '')), lambda p: length(p) >= 4)"""


@query(f"""with p as (select conv_id, turn, {CLAIMS} as c from conversations)
select conv_id, turn, len(c)::int as claims, md5(array_to_string(c, '|')) as digest from p""")
def claim_split(t):
    return t("conversations").select("conv_id", "turn", text.claims(F.col("text")).alias("c")).select("conv_id", "turn", F.size("c").alias("claims"), F.md5(F.array_join("c", "|")).alias("digest"))


@query("select event_id, case when event_type = 'error' then 'critical' when event_type = 'signup' then 'high' when event_type = 'view' and value < 10 then 'medium' else 'none' end as level from events")
def escalation_level(t):
    kind = F.col("event_type")
    return t("events").select("event_id", guard.escalation(kind == "error", kind != "signup", ~((kind == "view") & (F.col("value") < 10)), F.lit(50)).alias("level"))


# Samples and versions.
@query("select item_id from benchmark order by sha256('seed:' || item_id) limit 20")
def stable_sample(t):
    return generations.hash_sample(t("benchmark"), "item_id", 20).select("item_id")


GENERATIONS = """g as (select o_orderkey as id, o_custkey as source, case o_orderstatus when 'O' then 'building' when 'F' then 'ready' else 'retired' end as status, o_orderdate as "at" from orders)"""


def _generations(t):
    s = F.col("o_orderstatus")
    return t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("source"), F.when(s == "O", "building").when(s == "F", "ready").otherwise("retired").alias("status"), F.col("o_orderdate").alias("at"))


@query(f"""with {GENERATIONS} select source, id from g where status = 'ready' qualify row_number() over (partition by source order by "at" desc, id desc) = 1""")
def generation_publish(t):
    return generations.active(_generations(t)).select("source", "id")


@query(f"""with {GENERATIONS} select id from g where "at" < timestamp '1996-01-01' and id not in (select id from g where status = 'ready' qualify row_number() over (partition by source order by "at" desc, id desc) = 1)""")
def anti_join_gc(t):
    return generations.garbage(_generations(t), F.lit("1996-01-01").cast("timestamp")).select("id")


@query("select doc_id, source, lang from documents where source not in (select source from documents where source in ('src1', 'src2') and doc_id % 2 = 0) union all select doc_id + 1000000, source, 'new' from documents where source in ('src1', 'src2') and doc_id % 2 = 0")
def replace_by_source(t):
    docs = t("documents").select("doc_id", "source", "lang")
    new = docs.where(F.col("source").isin("src1", "src2") & (F.col("doc_id") % 2 == 0)).select((F.col("doc_id") + 1000000).alias("doc_id"), "source", F.lit("new").alias("lang"))
    return generations.replaced(docs, new)


@query("select l_partkey as id, l_suppkey as source, count(*) as mentions, max_by(l_returnflag, l_orderkey * 10 + l_linenumber) filter (l_returnflag <> 'N') as description from lineitem group by all")
def entity_upsert(t):
    flag = F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag"))
    rows = t("lineitem").select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("source"), flag.alias("description"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    return generations.merged_entities(rows)
