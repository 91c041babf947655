"""Queries over evidence, stores, graph and summary rows, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine, doubles
from ..operators import evidence, graph, ranking, stores
from ..operators.ranges import numbered
from .catalogue import DECIMALS, _vectors, query

# Evidence: documents, with scores of some.
FOUND = """f as (select doc_id as id, text as content, source, lang as title, case when doc_id % 4 > 0 then (doc_id % 13) / 10.0 end as grade, case when doc_id % 3 > 0 then (doc_id % 10) / 10.0 end as rerank_prob, case when doc_id % 5 > 0 then doc_id % 7 - 3.0 end as rerank_score from documents)"""
SCORED = """p as (select id, left(coalesce(content, ''), 4000) as content, left(coalesce(source, ''), 500) as source, left(coalesce(title, ''), 500) as title,
round(coalesce(case when grade between 0 and 1 then grade end, case when rerank_prob between 0 and 1 then rerank_prob end, 1 / (1 + exp(-rerank_score))), 6)::double as score, length(coalesce(content, '')) > 4000 or length(coalesce(source, '')) > 500 or length(coalesce(title, '')) > 500 as degraded from f)"""


def _found(t):
    n = F.col("doc_id")
    return t("documents").select(n.alias("id"), F.col("text").alias("content"), "source", F.col("lang").alias("title"), F.when(n % 4 > 0, (n % 13) / 10).alias("grade"), F.when(n % 3 > 0, (n % 10) / 10).alias("rerank_prob"), F.when(n % 5 > 0, (n % 7 - 3).cast("double")).alias("rerank_score"))


def _scored(t):
    return evidence.projected(_found(t)).withColumn("score", F.round("score", DECIMALS))


@query(f"with {FOUND}, {SCORED} select id, md5(content) as content, source, title, score, degraded from p")
def evidence_rows(t):
    return _scored(t).select("id", F.md5("content").alias("content"), "source", "title", "score", "degraded")


@query(f"with {FOUND} select id, content is not null and source is not null and title is not null and length(content) <= 4000 and length(source) <= 500 and length(title) <= 500 and (grade is null or grade between 0 and 1) as valid from f")
def evidence_valid(t):
    return _found(t).select("id", F.coalesce(evidence.valid(F.col("content"), F.col("source"), F.col("title"), F.col("grade")), F.lit(False)).alias("valid"))


@query(f"""with {FOUND}, i as (select id, source, content is not null and title is not null and id % 97 > 0 as ok, length(content) > 4000 or coalesce(grade > 1, false) as degraded from f where source is not null)
select source, bool_and(ok) as usable, not bool_and(ok) or bool_or(degraded) as degraded from i group by source""")
def evidence_lists(t):
    rows = _found(t).where("source is not null")
    ok = F.col("content").isNotNull() & F.col("title").isNotNull() & (F.col("id") % 97 > 0)
    return evidence.normalised(rows.select("source", ok.alias("ok"), ((F.length("content") > 4000) | F.coalesce(F.col("grade") > 1, F.lit(False))).alias("degraded")), "source")


@query(f"""with {FOUND}, {SCORED}, n as (select *, row_number() over (partition by source order by id) as number from p where content <> '' and id % 6 > 0)
select source, id, number::int as number, printf('[证据%d] 来源=%s | 标题=%s | 相关度=%.4f', number, source, title, coalesce(score, 0.0)) as line from n""")
def evidence_lines(t):
    rows = _scored(t).withColumn("content", F.when(F.col("id") % 6 > 0, F.col("content")))
    return evidence.lines(rows, "source", "id")


@query(f"with {FOUND} select id, md5(coalesce(content, '')) as content, coalesce(source, '') as source, case when grade between 0 and 1 then grade end::double as score from f")
def evidence_documents(t):
    from ..functions.maths import probability

    return _found(t).select("id", F.md5(F.coalesce("content", F.lit(""))).alias("content"), F.coalesce("source", F.lit("")).alias("source"), probability(F.col("grade")).cast("double").alias("score"))


@query("select conv_id, turn, length(text) <= 4000 as safe from conversations where text is not null")
def wire_safe_text(t):
    return t("conversations").where("text is not null").select("conv_id", "turn", (F.length("text") <= evidence.CONTENT).alias("safe"))


@query(r"""with x as (select doc_id, text, len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z]+')), ['the','this','these','those','is','are','must','shall','before','after','only','when','if','with','and','not','how','to'])) as n from documents)
select doc_id, case when regexp_matches(text, '[^\P{L}a-zA-Z\x{4e00}-\x{9fff}]') then null when regexp_matches(text, '[\x{4e00}-\x{9fff}]') then case when not regexp_matches(text, '\b[A-Za-z]{2,}([ -]+[A-Za-z]{2,})+\b') then 'zh' end when n >= 2 then 'en' end as language from x""")
def procedure_language(t):
    return t("documents").select("doc_id", evidence.language(F.col("text")).alias("language"))


@query("""with e as (select event_id, user_id, case when event_id % 11 = 0 then 'en' else 'zh' end as lang, case when event_id % 3 > 0 then (event_id % 100) / 100.0 else 0.005 end as score from events where event_id % 4 = 0),
s as (select *, max((lang = 'zh' and score >= 0.9)::int) over (partition by user_id) as strong from e), b as (select *, max((lang <> 'zh' and (strong = 0 or score > 0.01))::int) over (partition by user_id) as bad from s)
select event_id from b where bad = 0 and lang = 'zh'""")
def evidence_gate(t):
    n = F.col("event_id")
    rows = t("events").where("event_id % 4 = 0").select("event_id", "user_id", F.when(n % 11 == 0, "en").otherwise("zh").alias("lang"), F.when(n % 3 > 0, (n % 100) / 100).otherwise(0.005).alias("score"))
    return evidence.eligible(rows, "user_id", "zh").select("event_id")


@query(r"""with s as (select doc_id, unnest(string_split(text, '. ')) as body, generate_subscripts(string_split(text, '. '), 1) as place from documents),
f as (select *, sum((place = 1 or not regexp_matches(body, '^(The|It|Es|La|El)( |$)'))::int) over (partition by doc_id order by place)::bigint as clause from s)
select doc_id, clause, md5(string_agg(body, '' order by place)) as body from f group by doc_id, clause""")
def reference_groups(t):
    sentences = t("documents").select("doc_id", F.posexplode(F.split("text", r"\. ")).alias("place", "body"))
    return evidence.reference_groups(sentences, "doc_id", "place", r"^(The|It|Es|La|El)( |$)").select("doc_id", "clause", F.md5("body").alias("body"))


# Entities are vectors, their chunks the documents of four ids each; edges join ids that follow by sevens.
CHUNKS = "c as (select doc_id // 4 as id, source, doc_id as ordinal, lang as chunk from documents)"
ENTITIES = "n as (select vec_id as id, 'src' || (vec_id % 8) as source, label, embedding from embeddings)"
LINKS = "l as (select a.vec_id as src, b.vec_id as dst, 1.0 / (1 + a.vec_id % 3) as weight from embeddings a join embeddings b on b.vec_id = a.vec_id * 7 + 1 union all select b.vec_id, a.vec_id, 1.0 / (1 + a.vec_id % 3) from embeddings a join embeddings b on b.vec_id = a.vec_id * 7 + 1)"


def _chunks(t):
    return t("documents").select(F.floor(F.col("doc_id") / 4).alias("id"), "source", F.col("doc_id").alias("ordinal"), F.col("lang").alias("chunk"))


def _entities(t):
    return t("embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("src"), (F.col("vec_id") % 8).cast("string")).alias("source"), "label", "embedding")


def _links(t):
    ids = t("embeddings").select("vec_id")
    a = ids.select(F.col("vec_id").alias("src"), (F.col("vec_id") * 7 + 1).alias("dst"), (F.lit(1.0) / (1 + F.col("vec_id") % 3)).alias("weight"))
    known = a.join(ids.select(F.col("vec_id").alias("dst")), "dst").select("src", "dst", "weight")
    return known.unionByName(known.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


@query(f"with {CHUNKS}, {ENTITIES} select n.id, n.source, c.ordinal from n left join c on c.id = n.id and c.source = n.source")
def graph_scan(t):
    return _entities(t).join(_chunks(t), ["id", "source"], "left").select("id", "source", "ordinal")


@query(f"with {CHUNKS}, {ENTITIES} select n.id, n.source, (select arg_min(chunk, ordinal) from c where c.id = n.id and c.source = n.source) as chunk from n")
def chunk_of_entity(t):
    return stores.chunk_of(_entities(t).select("id", "source"), _chunks(t)).select("id", "source", "chunk")


@query(f"with {CHUNKS}, {ENTITIES} select n.id, c.ordinal from n join c on c.id = n.id where c.source in ('src0', 'src1', 'src2')")
def chunks_of_entity(t):
    return _entities(t).select("id").join(_chunks(t).where(F.col("source").isin("src0", "src1", "src2")), "id").select("id", "ordinal")


@query("select label, count(*) as n, bool_and(len(embedding) = 64) as usable from embeddings group by label")
def matrix_guard(t):
    return t("embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.size("embedding") == 64).alias("usable"))


COSINES = "a as (select qid, vec_id as id, list_dot_product(embedding::double[], e::double[]) / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product(e::double[], e::double[]))) as s from embeddings, (select vec_id as qid, embedding as e from embeddings where vec_id % 20 = 0)), k as (select *, row_number() over (partition by qid order by round(s, 6) desc, id::varchar) as rank from a)"


def _ranked(t, k):
    return ranking.dense_topk(*_vectors(t), k=k, by="cosine")


@query(f"with {COSINES} select qid, id from k where rank <= 5")
def semantic_seeds(t):
    return _ranked(t, 5).select("qid", "id")


@query(f"with {COSINES}, {CHUNKS}, w as (select qid, id, rank, row_number() over (partition by qid order by rank)::int as place from k where rank <= 20 and id in (select id from c where source in ('src0', 'src1', 'src2', 'src3'))) select qid, id, place from w where place <= 10")
def entity_search(t):
    return _with_text(t, _ranked(t, 20))


def _with_text(t, ranked):
    """Of the first 20 entities of a query the first ten with a text."""
    with_text = _chunks(t).where(F.col("source").isin("src0", "src1", "src2", "src3")).select("id").distinct()
    kept = ranked.join(with_text, "id", "left_semi")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).where("place <= 10").select("qid", "id", "place")


@query(f"""with {COSINES}, {CHUNKS}, {LINKS}, m as (select qid, avg(s) as score from a group by qid), s as (select qid, id from k where rank <= 5),
r as (select s.qid, l.dst as id, max(l.weight) as weight from s join l on l.src = s.id group by all), o as (select * from r where (qid, id) not in (select (qid, id) from s)),
f as (select qid, o.id, c.ordinal as chunk, round(m.score * 0.5 * o.weight, 6) as score from o join c on c.id = o.id join m using (qid))
select qid, id, chunk, score, row_number() over (partition by qid order by score desc, id, chunk)::int as rank from f qualify rank <= 10""")
def neighbour_chunks(t):
    return _near_chunks(t, _ranked(t, 5))


def _near_chunks(t, ranked):
    """Chunks of the neighbours of a query's first five entities."""
    vectors, asked = _vectors(t)
    # The mean cosine to all entities is the product with the mean of their unit vectors: one pass, no pairs.
    v = doubles(F.col("vec"))
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    at = vectors.select(F.posexplode(F.transform(v, lambda x: x / length)).alias("at", "x")).groupBy("at").agg(F.avg("x").alias("x"))
    mean = at.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda z: z["x"]).alias("mean"))
    q = doubles(F.col("qvec"))
    size = F.sqrt(F.aggregate(q, F.lit(0.0), lambda s, x: s + x * x))
    scores = asked.crossJoin(F.broadcast(mean)).select("qid", (F.aggregate(F.zip_with(q, "mean", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) / size).alias("score"))
    chunks = _chunks(t).select("id", F.col("ordinal").alias("chunk"))
    return stores.neighbour_chunks(scores, ranked.where("rank <= 5").select("qid", "id"), _links(t), chunks, 10).select("qid", "id", "chunk", "score", "rank")


@query("""with i as (select l_orderkey as chunk, l_linenumber as n, l_partkey as name from lineitem), p as (select distinct chunk, name from i),
r as (select chunk, name as a, lead(name) over (partition by chunk order by n, name) + case when n % 5 = 0 then 1000000 else 0 end as b from i)
select distinct substr(sha1(r.a::varchar || '::near::' || r.b::varchar), 1, 16) as id, r.a, r.b from r join p x on x.chunk = r.chunk and x.name = r.a join p y on y.chunk = r.chunk and y.name = r.b""")
def build_relations(t):
    items = t("lineitem").select(F.col("l_orderkey").alias("chunk"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("name"))
    named = F.lead("name").over(Window.partitionBy("chunk").orderBy("n", "name")) + F.when(F.col("n") % 5 == 0, 1000000).otherwise(0)
    said = items.select("chunk", F.col("name").alias("a"), named.alias("b"))
    return graph.resolved_relations(said, items.select("chunk", "name").distinct(), "near")


# Summary nodes of eight documents of a source each; their provenance is those in some languages.
NODES = "d as (select doc_id, source, lang, (row_number() over (partition by source order by doc_id) - 1) // 8 as node from documents where source is not null), s as (select distinct source, node, source || '/' || node as id from d), v as (select source || '/' || node as id, doc_id as ordinal, source, doc_id // 2 as chunk from d where lang in ('en', 'fr'))"


def _nodes(t):
    rows = t("documents").where("source is not null").select("doc_id", "source", "lang")
    d = numbered(rows, "source", [F.col("doc_id").asc()]).select("doc_id", "source", "lang", F.floor(F.col("number") / 8).alias("node"))
    d = d.withColumn("id", F.concat_ws("/", "source", F.col("node").cast("string")))
    return d.select("id", "source").distinct(), d.where("lang in ('en', 'fr')").select(F.col("id").alias("node"), F.col("doc_id").alias("ordinal"), "source", F.floor(F.col("doc_id") / 2).alias("chunk"))


@query(f"with {NODES} select s.id, v.ordinal, row_number() over (partition by s.id order by v.ordinal)::int as place from s join v on v.id = s.id")
def summary_provenance(t):
    nodes, provenance = _nodes(t)
    met = nodes.select(F.col("id").alias("node")).join(provenance.select("node", "ordinal"), "node")
    return met.select(F.col("node").alias("id"), "ordinal", F.row_number().over(Window.partitionBy("node").orderBy("ordinal")).alias("place"))


@query(f"with {NODES} select id from s where not exists (select 1 from v where v.id = s.id and v.ordinal % 5 = 0)")
def provenance_missing(t):
    nodes, provenance = _nodes(t)
    return nodes.select("id").join(provenance.where("ordinal % 5 = 0").select(F.col("node").alias("id")), "id", "left_anti")


@query(f"""with {NODES}, q as (select source as qid, id as node, row_number() over (partition by source order by md5(id)) as rank from s qualify rank <= 3),
m as (select q.qid, v.source, v.chunk, min((rank, ordinal)) as begin_at from q join v on v.id = q.node group by all)
select qid, chunk, row_number() over (partition by qid order by begin_at, chunk)::int as place from m qualify place <= 6""")
def summary_chunks(t):
    nodes, provenance = _nodes(t)
    ranked = nodes.select(F.col("source").alias("qid"), F.col("id").alias("node"), F.row_number().over(Window.partitionBy("source").orderBy(F.md5("id"))).cast("long").alias("rank")).where("rank <= 3")
    return stores.raw_chunks(ranked, provenance, 6).select("qid", "chunk", "place")


@query("""with g as (select o_orderkey as id, o_custkey as source, o_orderstatus as status, md5(o_orderkey::varchar) as hash from orders), a as (select source, max(id) as id from g where status = 'F' group by source), n as (select l_orderkey as id, l_linenumber as node, l_partkey as page from lineitem)
select a.source, n.node, n.page from a join g on g.id = a.id and g.status = 'F' join n on n.id = g.id where a.source % 3 = 0""")
def active_nodes(t):
    g = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("source"), F.col("o_orderstatus").alias("status"))
    pointer = g.where("status = 'F'").groupBy("source").agg(F.max("id").alias("id"))
    ready = pointer.where("source % 3 = 0").join(g.where("status = 'F'").select("id"), "id")
    return ready.join(t("lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("node"), F.col("l_partkey").alias("page")), "id").select("source", "node", "page")


# Stores.
@query("""with o as (select event_id::varchar as id, event_type as query from events where event_id % 3 = 0), n as (select case when event_id % 7 = 0 then '' else (event_id // 2)::varchar end as id, max(event_type) as query from events where event_id % 5 = 0 group by 1)
select id, query from o union all select id, query from n where id <> '' and id not in (select id from o)""")
def cases_appended(t):
    e = t("events").withColumn("key", F.col("event_id").cast("string"))
    old = e.where("event_id % 3 = 0").select(F.col("key").alias("id"), F.col("event_type").alias("query"))
    key = F.when(F.col("event_id") % 7 == 0, "").otherwise(F.floor(F.col("event_id") / 2).cast("string"))
    new = e.where("event_id % 5 = 0").groupBy(key.alias("id")).agg(F.max("event_type").alias("query"))
    return stores.appended(old, new, "id")


CANDIDATES = "c as (select event_id as id, event_type as query, case when event_id % 3 > 0 then ' ' else 'fix ' || user_id end as corrected from events where event_type = 'error')"


def _candidates(t):
    corrected = F.when(F.col("event_id") % 3 > 0, " ").otherwise(F.concat(F.lit("fix "), F.col("user_id").cast("string")))
    return t("events").where("event_type = 'error'").select(F.col("event_id").alias("id"), F.col("event_type").alias("query"), corrected.alias("corrected"))


@query(f"with {CANDIDATES}, g as (select 'fb_' || event_id as id, 'known' as query, 'x' as reference from events where event_id % 50 = 0) select * from g union all select 'fb_' || id, query, corrected from c where trim(corrected) <> '' and 'fb_' || id not in (select id from g)")
def golden_promoted(t):
    golden = t("events").where("event_id % 50 = 0").select(F.concat(F.lit("fb_"), F.col("event_id").cast("string")).alias("id"), F.lit("known").alias("query"), F.lit("x").alias("reference"))
    return stores.promoted_candidates(golden, _candidates(t))[0]


@query(f"with {CANDIDATES} select id, query from c where trim(corrected) = ''")
def candidates_left(t):
    c = _candidates(t)
    return stores.promoted_candidates(c.select(F.col("id").cast("string").alias("id"), "query", F.lit("").alias("reference")).limit(0), c)[1].select("id", "query")


@query("""select a.p_partkey as collection, case when r.p_partkey is null then 'registry_missing' when r.m <> a.p_brand then 'model_mismatch' when r.d <> a.p_size then 'dimension_mismatch' when r.s <> (a.p_partkey % 2 = 0) then 'sparse_mismatch' else 'compatible' end as reason
from part a left join (select p_partkey, case when p_partkey % 7 = 0 then 'other' else p_brand end as m, case when p_partkey % 5 = 0 then 64 else p_size end as d, p_partkey % 6 = 0 as s from part where p_partkey % 4 > 0) r using (p_partkey)""")
def embedding_registry(t):
    n = F.col("p_partkey")
    asked = t("part").select(n.alias("collection"), F.col("p_brand").alias("model"), F.col("p_size").alias("dimension"), (n % 2 == 0).alias("sparse"))
    held = t("part").where(n % 4 > 0).select(n.alias("collection"), F.when(n % 7 == 0, "other").otherwise(F.col("p_brand")).alias("model"), F.when(n % 5 == 0, 64).otherwise(F.col("p_size")).alias("dimension"), (n % 6 == 0).alias("sparse"))
    return stores.registry_verdict(asked, held)


@query("select vec_id as id, round(case when vec_id % 2 = 0 and vec_id % 3 > 0 then -embedding[1]::double else embedding[1]::double end, 6) as first from embeddings")
def embedding_update(t):
    n = F.col("id")
    new = _entities(t).where(n % 2 == 0).select("id", F.when(n % 3 > 0, F.transform("embedding", lambda x: -x)).otherwise(F.slice("embedding", 1, 0)).alias("embedding"))
    return stores.updated_embeddings(_entities(t), new).select("id", F.round(F.col("embedding")[0].cast("double"), DECIMALS).alias("first"))


@query("select p_partkey as id, p_size + (select count(*) from events where user_id = p_partkey) as count from part")
def access_counts(t):
    return stores.access_counts(t("part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("count")), t("events").select(F.col("user_id").alias("id")))


@query("""with e as (select event_id, user_id, case when event_type in ('view', 'error') then 'llm' else 'retriever' end as service, value < 60 as up from events),
s as (select *, coalesce(last_value(case when service = 'llm' then up end ignore nulls) over w, true) as llm, coalesce(last_value(case when service = 'retriever' then up end ignore nulls) over w, true) as ret from e window w as (partition by user_id order by event_id)),
r as (select *, sum((llm and ret)::int) over (partition by user_id order by event_id) as run from s)
select user_id, event_id, case when llm and ret then 'full' else first_value(case when not (llm and ret) then case when not llm then 'cached' else 'simplified' end end ignore nulls) over (partition by user_id, run order by event_id rows between unbounded preceding and current row) end as mode from r""")
def service_modes(t):
    service = F.when(F.col("event_type").isin("view", "error"), "llm").otherwise("retriever")
    return stores.service_modes(t("events"), "user_id", "event_id", service, F.col("value") < 60)


@query("""select user_id, count(*) filter (event_type = 'error') as pending, max(event_id) filter (event_type = 'error') as newest from events where user_id % 2 = 0 group by user_id having count(*) filter (event_type = 'error') > 0""")
def escalations_pending(t):
    open_ = t("events").where("event_type = 'error' and user_id % 2 = 0")
    return open_.groupBy("user_id").agg(F.count(F.lit(1)).alias("pending"), F.max("event_id").alias("newest"))


@query("select doc_id, substr(sha256(source), 1, 16) as fingerprint from documents where source is not null")
def filter_fingerprint(t):
    return t("documents").where("source is not null").select("doc_id", F.substring(F.sha2("source", 256), 1, 16).alias("fingerprint"))
