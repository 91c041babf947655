"""Queries over facets, channels, second passes, page vectors and procedures, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import answers, cleaning, text, vectors
from ..operators import channels, chunking, graph, lexical, ranking
from ..operators.state import cut
from ..operators.workflow import corrective_search
from .catalogue import DECIMALS, SQL, TOKENS, _edges, bm25_sql, bm25_topk, bm25_topk_source_filter, passages, ppr, query, sparse_dot_topk
from .catalogue_stores import CHUNKS, _chunks, _near_chunks, _ranked, _with_text
from .planner import evidence_state

SOURCES = ("src0", "src1", "src2", "src3")
SELECT = """f as (select * from r qualify row_number() over (partition by qid, key order by rank) = 1)"""


# A passage's first four sentences are its facets.
@query(f"""with facets as (select item_id * 4 + n - 1 as item_id, text from (select item_id, unnest(string_split(text, '. ')) as text, generate_subscripts(string_split(text, '. '), 1) as n from benchmark) where n <= 4),
lex as ({bm25_sql('').replace('from benchmark', 'from facets')}), h as (select l.qid // 4 as qid, l.qid % 4 as facet, l.doc_id as id, d.source as key, l.score from lex l join documents d using (doc_id)),
e as (select qid, id, key, max(score) as score, list(facet) as m from h group by qid, id, key), r as (select *, row_number() over (partition by qid order by score desc, id)::int as rank from e), {SELECT},
c as (select qid, id, rank, unnest(m) as facet from f), g as (select qid, facet, min_by(id, rank) as id from c group by qid, facet)
select qid, id, key, rank, row_number() over (partition by qid order by case when (qid, id) in (select (qid, id) from g) then 0 else 1 end, rank)::int as place from f qualify place <= 4""")
def facet_retrieval(t):
    parts = t("benchmark").select("item_id", F.posexplode(F.split("text", r"\. ")).alias("n", "query")).where("n < 4")
    hits = lexical.bm25_topk(t("documents"), parts.select((F.col("item_id") * 4 + F.col("n")).alias("qid"), "query"))
    found = hits.join(t("documents").select("doc_id", "source"), "doc_id")
    found = found.select(F.floor(F.col("qid") / 4).alias("qid"), (F.col("qid") % 4).alias("facet"), F.col("doc_id").alias("id"), F.col("source").alias("key"), "score")
    return channels.by_facet(found, 4)


@query(f"""with lex as ({bm25_sql('')}), bag as ({SQL['sparse_dot_topk']}), few as ({SQL['bm25_topk_source_filter']}),
u as (select qid, 1 as channel, 0.65::double as weight, doc_id as id, rank from lex union all select qid, 2, 0.35, doc_id, rank from bag where qid % 2 = 0 and rank <= 5 union all select qid, 3, 0.3, doc_id, rank from few where rank <= 3),
al as (select qid, sum(weight) as total from (select distinct qid, channel, weight from u) group by qid), s as (select qid, id, round(sum(weight / total / (60 + rank)), 9) as score, min(channel * 100 + rank) as seen from u join al using (qid) group by qid, id),
r as (select qid, id, source as key, row_number() over (partition by qid order by score desc, seen)::int as rank from s join documents on doc_id = id), {SELECT}
select qid, id, key, rank, row_number() over (partition by qid order by rank)::int as place from f qualify place <= 4""")
def optional_channels(t):
    few = bm25_topk_source_filter(t).where("rank <= 3")
    bag = sparse_dot_topk(t).where("qid % 2 = 0 and rank <= 5")
    every = None
    for n, (part, weight) in enumerate(((bm25_topk(t), 0.65), (bag, 0.35), (few, 0.3)), 1):
        rows = part.select("qid", F.lit(n).alias("channel"), F.lit(weight).alias("weight"), F.col("doc_id").alias("id"), "rank")
        every = rows if every is None else every.unionByName(rows)
    return channels.augmented(every, t("documents").select(F.col("doc_id").alias("id"), F.col("source").alias("key")), 4)


# A first pass over two sources; where it finds nothing, little or conflicting things, one over all of them.
@query(f"""with few as ({SQL['bm25_topk_source_filter']}), wide as ({bm25_sql('')}), m as (select qid, max(score) as most, bool_or(doc_id % 50 = 0) as conflict from few group by qid),
a as (select qid from m where not conflict and most / 100 >= 0.35) select qid, doc_id, rank, false as retried from few where qid in (select qid from a) union all select qid, doc_id, rank, true from wide where qid not in (select qid from a)""")
def retrieval_workflow(t):
    docs = t("documents")
    plans = t("benchmark").select(F.col("item_id").alias("qid"), F.lit("multi_query").alias("retry_action"))

    def judge(hits):
        return evidence_state(hits.select("qid", (F.col("score") / 100).alias("relevance"), (F.col("doc_id") % 50 == 0).alias("conflict")), plans)

    few = lambda asked: lexical.bm25_topk(docs, asked, keep=F.col("source").isin("src0", "src1"))
    rows = corrective_search(passages(t), few, lambda asked: lexical.bm25_topk(docs, asked), lambda hits: hits, judge)
    return rows.select("qid", "doc_id", "rank", "retried")


# The same with the stage of authority: a document's source says its status and authority, its number its revision.
KINDS = "case source when 'src0' then 'obsolete' when 'src1' then 'draft' else 'current' end as status, case when doc_id % 3 = 0 then 'official' when doc_id % 3 = 1 then 'internal' else 'draft' end as authority"
AUTHORITY = "case status when 'obsolete' then 0 when 'draft' then 1 else 2 end desc, case authority when 'official' then 5 when 'internal' then 3 else 1 end desc, doc_id % 7 desc, 'r' || (doc_id % 7) desc, score desc, doc_id"


@query(f"""with few as ({SQL['bm25_topk_source_filter']}), wide as ({bm25_sql('')}), k as (select doc_id, {KINDS} from documents),
m as (select qid, max(score) as most, bool_or(doc_id % 50 = 0) as conflict from few group by qid), a as (select qid from m where not conflict and most / 100 >= 0.35),
h as (select qid, doc_id, score, false as retried from few where qid in (select qid from a) union all select qid, doc_id, score, true from wide where qid not in (select qid from a)),
w as (select qid, case when bool_or(doc_id % 50 = 0) then 'conflict' when max(score) / 100 < 0.35 then 'weak' else 'accept' end as state from h group by qid)
select qid, doc_id, retried, state, row_number() over (partition by qid order by {AUTHORITY})::int as rank from h join k using (doc_id) join w using (qid)""")
def corrective_search_authority(t):
    docs = t("documents")
    plans = t("benchmark").select(F.col("item_id").alias("qid"), F.lit("multi_query").alias("retry_action"))
    n = F.col("doc_id")
    kinds = docs.select(
        "doc_id", F.when(F.col("source") == "src0", "obsolete").when(F.col("source") == "src1", "draft").otherwise("current").alias("status"),
        F.when(n % 3 == 0, "official").when(n % 3 == 1, "internal").otherwise("draft").alias("authority"), F.concat(F.lit("r"), (n % 7).cast("string")).alias("revision"), F.lit(None).cast("string").alias("effective_date"),
    )

    def judge(hits):
        return evidence_state(hits.select("qid", (F.col("score") / 100).alias("relevance"), (F.col("doc_id") % 50 == 0).alias("conflict")), plans)

    def ranked(hits):
        return ranking.authority_order(hits.drop("rank").join(kinds, "doc_id"), "qid", "score", "doc_id").select("qid", "doc_id", "score", "rank")

    few = lambda asked: lexical.bm25_topk(docs, asked, keep=F.col("source").isin("src0", "src1"))
    return corrective_search(passages(t), few, lambda asked: lexical.bm25_topk(docs, asked), ranked, judge).select("qid", "doc_id", "retried", "state", "rank")


@query(f"with lex as ({bm25_sql('')}) select qid, doc_id, rank, false as rerank_applied, 'timeout' as rerank_error from lex where rank <= 3")
def rerank_fallback(t):
    return channels.without_rerank(bm25_topk(t).select("qid", "doc_id", "rank"), 3, "timeout")


@query(f"""with low as ({SQL['entity_search']}), high as ({SQL['neighbour_chunks']}), {CHUNKS}, o as (select id, min(ordinal) as key from c where source in {SOURCES} group by id),
u as (select qid, key, 1.0::double / (60 + place) as part from low join o using (id) union all select qid, chunk, 0.8::double / (60 + rank) from high),
s as (select qid, key, round(sum(part), 9) as score from u group by qid, key) select qid, key, score, row_number() over (partition by qid order by score desc, key)::int as rank from s""")
def graph_retrieve(t):
    first = _chunks(t).where(F.col("source").isin(*SOURCES)).groupBy("id").agg(F.min("ordinal").alias("key"))
    ranked = cut(_ranked(t, 20).select("qid", "id", "rank"))  # one search for both channels
    low = _with_text(t, ranked).join(first, "id").select("qid", "key", F.col("place").alias("rank"))
    return graph.low_high(low, _near_chunks(t, ranked).select("qid", F.col("chunk").alias("key"), "rank"))


@query()
def ppr_chunks(t):
    held = t("documents").select((F.col("doc_id") % 200 + 1).alias("id"), "source", F.col("doc_id").alias("ordinal"), "text")
    return channels.ranked_chunks(ppr(t).select("id", "rank"), held, 10)


# Hops and paths over the edges of order lines.
EDGES = "e as (select distinct l_partkey as src, 1000000 + l_suppkey as dst from lineitem), l as (select src, dst from e union select dst, src from e)"


@query(f"""with recursive {EDGES}, w(id, hops) as (select distinct src, 0 from e where src < 5 union select l.dst, w.hops + 1 from w join l on l.src = w.id where w.hops < 2)
select id, min(hops)::int as hops from w group by id""")
def edge_reach(t):
    edges = _edges(t)
    return graph.reach(edges, edges.where("src < 5").select(F.col("src").alias("id")).distinct(), 2, t("lineitem").count())


@query(f"""with {EDGES}, p as (select a.src as a, b.src as b from (select distinct src from e where src < 5) a, (select distinct src from e where src between 5 and 60) b)
select a, b, a || '>' || min(m.dst) || '>' || b as path from p join l m on m.src = a join l n on n.src = m.dst and n.dst = b group by a, b""")
def edge_paths(t):
    edges = _edges(t)
    ends = edges.select("src").distinct()
    pairs = ends.where("src < 5").select(F.col("src").alias("a")).join(ends.where("src between 5 and 60").select(F.col("src").alias("b")))  # a few seeds
    found = graph.shortest_paths(edges, pairs, 2, t("lineitem").count())
    return found.select("a", "b", F.array_join(found["path"].cast("array<string>"), ">").alias("path"))


# Pages of sixteen vectors, two in three of them active; a label's first 64 vectors ask.
@query("""with q as (select label as qid, embedding::double[] as q from embeddings where label is not null qualify row_number() over (partition by label order by vec_id) <= 64),
p as (select vec_id // 16 as page, list(embedding::double[] order by vec_id) as d from embeddings group by vec_id // 16 having vec_id // 16 % 3 <> 0),
s as (select qid, page, round(avg(list_max(list_transform(d, lambda x: list_dot_product(q, x) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(x, x)))))), 6) as score from q, p group by qid, page)
select qid, page, score, row_number() over (partition by qid order by score desc, page)::int as rank from s qualify rank <= 5""")
def visual_pages(t):
    unit = vectors.unit(vectors.doubles(F.col("embedding")))
    e = t("embeddings").select("vec_id", "label", F.floor(F.col("vec_id") / 16).alias("page"), unit.alias("v"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "v"))), lambda x: x["v"]).alias("tokens")
    active = e.select("page").distinct().where("page % 3 <> 0")
    asked = e.where("label is not null").withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).where("n <= 64")
    return channels.token_matched(e.join(active, "page").groupBy("page").agg(listed), asked.groupBy(F.col("label").alias("qid")).agg(listed), 5)


@query("""with p as (select page_id, page_id // 10 as generation, sha256(html) as held, case when page_id % 37 = 5 then 'x' else sha256(html) end as stated from pages where page_id % 23 <> 4)
select generation, count(*) = max(page_id) - min(page_id) + 1 and count(distinct page_id) = count(*) and bool_and(held = stated) as valid from p group by generation""")
def pages_valid(t):
    n = F.col("page_id")
    held = F.sha2("html", 256)
    rows = t("pages").where(n % 23 != 4).select("page_id", F.floor(n / 10).alias("generation"), held.alias("held"), F.when(n % 37 == 5, "x").otherwise(held).alias("stated"))
    return channels.valid_pages(rows, "generation", "page_id", F.col("held"), F.col("stated"))


@query("select page_id, sha256(html) as asset, length(left(html, 16000)) as kept from pages where length(html) > 0")
def pages_staged(t):
    return t("pages").where(F.length("html") > 0).select("page_id", F.sha2("html", 256).alias("asset"), F.length(F.substring("html", 1, 16000)).cast("long").alias("kept"))


@query(r"""with n as (select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as normal, case when doc_id % 3 = 0 then 'm' || doc_id end as known from documents), c as (select normal, min(doc_id) as id from n where doc_id % 2 = 0 group by normal)
select doc_id, coalesce(known, c.id::varchar, left(sha1(normal), 12)) as id from n left join c using (normal)""")
def corpus_ids(t):
    n = F.col("doc_id")
    rows = t("documents").select("doc_id", "text", text.collapsed(F.col("text")).alias("normal"), F.when(n % 3 == 0, F.concat(F.lit("m"), n)).alias("known"))
    return channels.corpus_ids(rows, rows.where("doc_id % 2 = 0").select(n.alias("id"), "normal"), "known", "normal", text.content_id(F.col("text"))).select("doc_id", "id")


# Procedures: the lines of a document are its clauses, with roles and sources by place.
ROLES = ["step", "main_rule", "step", "record", "limit", "omit", "scope"]


@query(f"""with u as (select doc_id, n as clause, 's' || (n % 3) as source, trim(line) as body, {ROLES}[1 + (n + doc_id) % 7] as r from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as n from documents) where trim(line) <> ''),
v as (select *, case when r in ('main_rule', 'scope') or (r = 'step' and regexp_matches(body, '{channels.CONSTRAINT}')) then 'lead' else r end as role from u), w as (select *, row_number() over (partition by doc_id, role, source order by clause) = 1 as first from v where doc_id in (select doc_id from v where role = 'lead'))
select doc_id, list_position(['lead', 'step', 'record', 'limit'], role)::int as place, md5('**' || ['Rules and scope', 'Procedure', 'Records and purposes', 'Conditions and boundaries'][list_position(['lead', 'step', 'record', 'limit'], role)] || '**' || chr(10) || chr(10) || string_agg(body, ' ' order by clause) || string_agg('[' || source || ']', '' order by clause) filter (first)) as block
from w where role <> 'omit' group by doc_id, role""")
def procedure_blocks(t):
    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("clause", "line")).where(F.trim("line") != "")
    role = F.element_at(F.array(*map(F.lit, ROLES)), (1 + (F.col("clause") + F.col("doc_id")) % 7).cast("int"))
    units = lines.select("doc_id", "clause", F.concat(F.lit("s"), F.col("clause") % 3).alias("source"), F.trim("line").alias("body"), role.alias("role"))
    return channels.procedure_blocks(units, "doc_id").select("doc_id", "place", F.md5("block").alias("block"))


@query("""with c as (select conv_id, turn, trim(text) as body, [1 + turn % 3, 1 + conv_id % 3, 1 + (turn + conv_id) % 5] as ids, ['a', 'b', '', 'd'] as s from conversations),
n as (select *, list_transform(ids, lambda i: case when s[i] = '' then '证据' || i else s[i] end) as names from c)
select conv_id, turn, case when body <> '' and list_max(ids) <= 4 then md5(body || array_to_string(list_transform(list_filter(names, lambda x, i: list_position(names, x) = i), lambda x: '[' || x || ']'), '')) end as paragraph from n""")
def cited_paragraph(t):
    a, b = F.col("turn"), F.col("conv_id")
    ids = F.array(*((1 + x).cast("int") for x in (a % 3, b % 3, (a + b) % 5)))
    body = cleaning.cited_paragraph(F.trim("text"), ids, F.array(*map(F.lit, ["a", "b", "", "d"])))
    return t("conversations").select("conv_id", "turn", F.md5(body).alias("paragraph"))


@query("""select conv_id, turn, md5(trim(text, chr(32) || chr(9) || chr(10) || chr(13))) as summary, 2::int as details, role as second, 0::int as steps, conv_id::varchar as notes from conversations where not contains(text, '【')""")
def structured_answer(t):
    whole = F.concat(F.lit("x\n【结论】"), F.col("text"), F.lit("\n【依据】1. one\n2. "), F.col("role"), F.lit("\n【备注】"), F.col("conv_id").cast("string"))
    rows = t("conversations").where(~F.contains("text", F.lit("【"))).select("conv_id", "turn", cleaning.structured_answer(whole, ["结论", "依据", "步骤", "备注", "来源", "缺口"]).alias("a"))
    return rows.select("conv_id", "turn", F.md5("a.summary").alias("summary"), F.size("a.details").alias("details"), F.get("a.details", F.lit(1)).alias("second"), F.size("a.steps").alias("steps"), F.col("a.notes").alias("notes"))


@query("select conv_id, turn, md5(trim(text, chr(32) || chr(9) || chr(10) || chr(13))) as body from conversations where not regexp_matches(text, '[⚠🤔💡]')")
def boilerplate_free(t):
    rows = t("conversations").where(~F.col("text").rlike("[⚠🤔💡]"))
    said = F.concat(F.lit("Ask a person. "), F.col("text"), F.lit("\n\n> 💡 this may be "), F.col("role"), F.lit(" only"))
    return rows.select("conv_id", "turn", F.md5(cleaning.without_boilerplate(said, ["Ask a person."])).alias("body"))


@query(r"select page_id, trim(regexp_replace(replace(replace(regexp_extract(replace(url, '\', '/'), '([^/]*)/*$', 1), '<', '‹'), '>', '›'), '\s+', ' ', 'g')) as name from pages")
def metadata_clean(t):
    return t("pages").select("page_id", cleaning.metadata_value(F.col("url"), is_source=True).alias("name"))


@query("""select conv_id, turn, case turn % 5 when 0 then true when 1 then true when 2 then false when 3 then contains(lower(text), 'yes') else false end as relevant from conversations where text is not null and left(trim(text), 1) <> '{'""")
def batch_grades(t):
    n = F.col("turn") % 5
    reply = F.when(n == 0, '{"score": " Yes "}').when(n == 1, '{"binary_score": "maybe", "relevant": true}').when(n == 2, '{"answer": "not relevant", "relevance": "yes"}').when(n == 3, F.col("text")).otherwise('{"other": "yes"}')
    rows = t("conversations").where(F.col("text").isNotNull() & (F.substring(F.trim("text"), 1, 1) != "{"))
    return rows.select("conv_id", "turn", cleaning.relevant(reply).alias("relevant"))


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) as piece, generate_subscripts(string_split(text, chr(10)), 1) as n from documents), s as (select *, sum(length(piece) + 1) over (partition by doc_id order by n) as past from l)
select doc_id, (n - 1)::int as place, (past - 1 - length(piece))::int as "begin", (past - 1)::int as "end" from s where piece <> ''""")
def late_spans(t):
    pieces = t("documents").select("doc_id", "text", F.split("text", "\n").alias("pieces"))
    spans = pieces.select("doc_id", F.posexplode(channels.piece_spans("text", "pieces")).alias("place", "s"))
    return spans.select("doc_id", "place", "s.begin", "s.end").where(F.col("begin") < F.col("end"))


@query("""with e as (select source, case when doc_id % 4 > 0 then lang || n_chars % 50 end as element_id, trim(text, chr(32) || chr(9) || chr(10) || chr(13)) as body from documents)
select source, count(*) as n, count(element_id) - count(distinct element_id) as duplicates, sum(length(body))::bigint as chars from e group by source""")
def elements_normal(t):
    rows = t("documents").select("source", F.when(F.col("doc_id") % 4 > 0, F.concat("lang", F.col("n_chars") % 50)).otherwise("").alias("element_id"), "text")
    clean = rows.select("source", F.nullif("element_id", F.lit("")).alias("element_id"), answers.stripped(F.col("text")).alias("body"))
    return clean.groupBy("source").agg(F.count(F.lit(1)).alias("n"), (F.count("element_id") - F.count_distinct("element_id")).alias("duplicates"), F.sum(F.length("body")).alias("chars"))


# The lexical statistics of a corpus from which a source went and to which half of it came back.
@query(rf"""with tf as (select distinct doc_id, unnest({TOKENS}) as term from documents where source <> 'src1' or doc_id % 2 = 0) select term, count(*) as df from tf group by term""")
def incremental_stats(t):
    docs = t("documents")
    whole = lexical.term_stats(docs).select("term", "df")
    gone = lexical.term_stats(docs.where("source = 'src1'")).select("term", "df")
    back = lexical.term_stats(docs.where("source = 'src1' and doc_id % 2 = 0")).select("term", "df")
    return lexical.updated_stats(whole, gone, back)
