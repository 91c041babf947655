"""Queries over records that are kept and the small functions they are made with, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers, text, vectors
from ..operators import records, stores
from ..sources.readers import replay
from .catalogue import DECIMALS, SQL, TOKENS, dense_topk_ip, query
from .catalogue_splits import own_folder

SAID = "a as (select conv_id * 1000 + turn as id, role as question, case turn % 3 when 0 then '【cause】' || text || '【next】more' when 1 then 'intro cause: ' || text || '【cause】 ' else '【effect】' || text || chr(10) || '【cause】second' end as answer, text from conversations where text is not null and not contains(text, '【') and not contains(text, 'cause'))"


def _said(t):
    turn = F.col("turn")
    answer = F.when(turn % 3 == 0, F.concat(F.lit("【cause】"), "text", F.lit("【next】more"))).when(turn % 3 == 1, F.concat(F.lit("intro cause: "), "text", F.lit("【cause】 ")))
    answer = answer.otherwise(F.concat(F.lit("【effect】"), "text", F.lit("\n【cause】second")))
    rows = t("conversations").where("text is not null and not contains(text, '【') and not contains(text, 'cause')")
    return rows.select((F.col("conv_id") * 1000 + turn).alias("id"), F.col("role").alias("question"), answer.alias("answer"))


FACTS = rf"""with {SAID}, x as (select id, question, unnest(case id % 1000 % 3 when 0 then [{{'s': 'cause', 'b': text}}] when 1 then [{{'s': 'cause', 'b': ''}}] else [{{'s': 'cause', 'b': 'second'}}, {{'s': 'effect', 'b': text}}] end) as f from a),
y as (select id, question, f.s as section, regexp_replace(f.b, '^\s+|\s+$', '', 'g') as body from x)"""


@query(f"{FACTS} select id, section, md5(section || ': ' || body) as content from y where body <> ''")
def memory_facts(t):
    return records.facts(_said(t), ["cause", "effect"]).select("id", "section", F.md5("content").alias("content"))


# The facts of two batches, the second of which brings some of the first again.
@query(f"{FACTS} select md5(section || ': ' || body) as content, question, min(id) as at from y where body <> '' group by all")
def memories_kept(t):
    found = records.facts(_said(t), ["cause", "effect"]).select(F.lit("fact").alias("kind"), "content", "question", F.col("id").alias("at"))
    store = records.Records(found.sparkSession, own_folder(found))
    store.remember(found.where("at % 2 = 0"), 0)
    store.remember(found, 1)
    return store.memories().select(F.md5("content").alias("content"), "question", "at")


# A run for each kind of event: its values are the scores. The last three of them.
@query("""with r as (select event_type as run_id, case event_type when 'click' then 1 when 'error' then 2 when 'purchase' then 3 when 'signup' then 4 else 5 end as place, value / 100 as score from events)
select run_id, place::bigint as at, count(*) as total, count(*) filter (score >= 0.6) as passed, count(*) - count(*) filter (score >= 0.6) as failed, round(coalesce(avg(score), 0), 6) as average from r where place > 2 group by all""")
def run_history(t):
    events = t("events").select("event_type", F.col("event_id").alias("case_id"), (F.col("value") / 100).alias("score"))
    store = records.Records(events.sparkSession, own_folder(events))
    for n, kind in enumerate(("click", "error", "purchase", "signup", "view"), 1):
        store.save_run(events.where(F.col("event_type") == kind), kind, "nightly", n, n)
    return store.history(3).select("run_id", "at", "total", "passed", "failed", F.round("average", DECIMALS).alias("average"))


@query("select event_id, event_id % 3 > 0 and event_id % 4 = 0 as refuse from events")
def refusals(t):
    n = F.col("event_id")
    scores = F.when(n % 4 > 0, F.array("value"))
    return t("events").select("event_id", records.should_refuse(n % 3 > 0, scores).alias("refuse"))


@query("""select conv_id, turn, case when turn % 5 = 4 then null else conv_id::varchar end as id, case when turn % 5 = 4 then null when turn % 2 = 0 then md5(text) else md5('') end as query, case when turn % 5 = 4 then null when turn % 3 = 0 then role else 'rag_query' end as intent,
case when turn % 5 = 4 then null when turn % 3 = 1 then turn else 0 end::int as sources, case when turn % 5 = 4 then null when turn % 3 = 2 then 2 else 0 end::int as tags, case when turn % 5 = 4 then null else 'medium' end as difficulty from conversations where text is not null""")
def cases_parsed(t):
    turn = F.col("turn")
    raw = F.to_json(F.struct(F.col("conv_id").alias("id"), F.when(turn % 2 == 0, F.col("text")).alias("query"), F.when(turn % 3 == 0, F.col("role")).alias("expected_intent"), F.when(turn % 3 == 1, turn).alias("expected_min_sources"), F.when(turn % 3 == 2, F.array(F.lit("a"), F.lit("b"))).alias("tags")))
    case = records.case_from_json(F.when(turn % 5 == 4, F.concat(F.lit("["), raw, F.lit("]"))).otherwise(raw))
    rows = t("conversations").where("text is not null").select("conv_id", "turn", case.alias("c"))
    return rows.select("conv_id", "turn", "c.id", F.md5("c.query").alias("query"), F.col("c.expected_intent").alias("intent"), F.col("c.expected_min_sources").alias("sources"), F.when(F.col("c").isNotNull(), F.size("c.tags")).alias("tags"), "c.difficulty")


@query("""select event_id, json_extract_string(props, '$.k') as k, event_type as kind, (event_id % 2 = 0)::varchar as even, 3::int as n from events""")
def metadata_columns(t):
    raw = F.concat(F.expr("substr(props, 1, length(props) - 1)"), F.lit(',"list":[1],"nothing":null,"deep":{"a":1},"_late_chunk_dense":"v","kind":"'), F.col("event_type"), F.when(F.col("event_id") % 2 == 0, '","even":true}').otherwise('","even":false}'))
    rows = t("events").select("event_id", records.scalar_metadata(raw).alias("m"))
    return rows.select("event_id", F.col("m")["k"].alias("k"), F.col("m")["kind"].alias("kind"), F.col("m")["even"].alias("even"), F.size("m").alias("n"))


@query(r"""with l as (select doc_id, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 as place from documents),
m as (select doc_id, place, case place % 3 when 0 then '| ' || replace(raw, ' ', ' | ') || ' |' when 1 then replace(raw, ' ', chr(9)) else raw end as line from l),
c as (select doc_id, place, list_filter(list_transform(case when contains(line, '|') then string_split(line, '|') when contains(line, chr(9)) then string_split(line, chr(9)) when regexp_matches(line, '\s{2,}') then regexp_split_to_array(line, '\s{2,}') else [] end, lambda c: regexp_replace(c, '^\s+|\s+$', '', 'g')), lambda c: c <> '') as cells from m)
select doc_id, place::int as place, len(cells)::int as n, md5(array_to_string(cells, '|')) as cells from c""")
def table_row_cells(t):
    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "raw"))
    line = F.when(F.col("place") % 3 == 0, F.concat(F.lit("| "), F.replace("raw", F.lit(" "), F.lit(" | ")), F.lit(" |"))).when(F.col("place") % 3 == 1, F.replace("raw", F.lit(" "), F.lit("\t"))).otherwise(F.col("raw"))
    rows = lines.select("doc_id", "place", records.row_cells(line).alias("cells"))
    return rows.select("doc_id", "place", F.size("cells").alias("n"), F.md5(F.array_join("cells", "|")).alias("cells"))


# The dense hits again by two token vectors a document: its own, and its own from the end.
@query(f"""with h as ({SQL['dense_topk_ip']}), e as (select vec_id, embedding::double[] as v, list_reverse(embedding::double[]) as r from embeddings),
s as (select h.qid, h.id, h.rank, greatest(list_dot_product(q.v, d.v), list_dot_product(q.v, d.r)) as raw from h join e q on q.vec_id = h.qid join e d on d.vec_id = h.id where h.rank <= 4),
m as (select *, min(raw) over (partition by qid) as low, max(raw) over (partition by qid) as high, row_number() over (partition by qid order by round(raw, 9) desc, rank) as place from s)
select h.qid, h.id, coalesce(m.place, h.rank)::int as place, round(case when high - low > 1e-12 then (raw - low) / (high - low) when raw is not null then greatest(0, least(1, (raw + 1) / 2)) end, 5)::double as score, m.place is not null as applied from h left join m on m.qid = h.qid and m.id = h.id""")
def late_rerank(t):
    vecs = t("embeddings").select("vec_id", vectors.doubles(F.col("embedding")).alias("v"))
    hits = dense_topk_ip(t).select("qid", "id", "rank")
    rows = records.late_rerank(hits, vecs.select(F.col("vec_id").alias("qid"), F.array("v").alias("tokens")), vecs.select(F.col("vec_id").alias("id"), F.array("v", F.reverse("v")).alias("tokens")), 4)
    return rows.select("qid", "id", "place", F.round("score", 5).alias("score"), "applied")


@query("""select doc_id, md5(replace(replace(text, chr(92), chr(92) || chr(92)), '"', chr(92) || '"')) as escaped, md5(text) as plain, left(sha1(coalesce(source, 'none') || '|' || (doc_id % 9) || '|sparse=' || (doc_id % 2)), 12) as model, left(sha256(coalesce(source, '') || '#' || doc_id || '#' || left(text, 256)), 16) as id from documents where text is not null and not contains(text, '<think>') and trim(text) = text""")
def small_functions(t):
    n = F.col("doc_id")
    rows = t("documents").where("text is not null and not contains(text, '<think>') and trim(text) = text")
    thought = F.concat(F.lit("<think>first\nthis</think>"), "text", F.lit("<THINK></THINK>"))
    return rows.select("doc_id", F.md5(text.secure_filter_value(F.col("text"))).alias("escaped"), F.md5(text.strip_think(thought)).alias("plain"), answers.model_fingerprint(F.coalesce("source", F.lit("none")), n % 9, n % 2).alias("model"), answers.generated_id(F.col("source"), n, F.col("text")).alias("id"))


@query("select event_id, case when event_id % 2 = 0 then [event_type, 'right'] else ['left', event_type] end as held, 3::int as n from events")
def state_merged(t):
    one = lambda *pairs: F.create_map(*(F.lit(x) if isinstance(x, str) else x for p in pairs for x in p))
    even, kind = F.col("event_id") % 2 == 0, F.col("event_type")
    left = F.when(even, one(("a", kind), ("b", "left"))).otherwise(one(("a", "left"), ("c", "left")))
    right = F.when(even, one(("b", "right"), ("c", "right"))).otherwise(one(("b", kind), ("c", "right")))
    rows = t("events").select("event_id", stores.merged_state(left, right).alias("m"))
    return rows.select("event_id", F.array(F.col("m")["a"], F.col("m")["b"]).alias("held"), F.size("m").alias("n"))


@query("""select doc_id, list_distinct(string_split(case when doc_id % 2 = 0 then 'red' || (doc_id % 5) || '|blue' else 'one' || (doc_id % 3) || '|two|one' || (doc_id % 3) end, '|')).len()::int as n, case when doc_id % 2 = 0 then 'red' || (doc_id % 5) else 'one' || (doc_id % 3) end as first from documents""")
def facet_parts(t):
    n = F.col("doc_id")
    asked = F.when(n % 2 == 0, F.concat(F.lit("比较 red"), (n % 5).cast("string"), F.lit(" and blue"))).otherwise(F.concat(F.lit("one"), (n % 3).cast("string"), F.lit("、two，one"), (n % 3).cast("string")))
    rows = t("documents").select("doc_id", text.facets(asked).alias("f"))
    return rows.select("doc_id", F.size("f").alias("n"), F.get("f", F.lit(0)).alias("first"))


# Conversations as a replay log of JSON lines, with comments and broken lines between them.
@query("""select conv_id || '/' || turn as id, md5(text) as answer, 2::int as contexts, md5(role || '|' || text) as held from conversations where text is not null and turn % 4 <> 3""")
def replay_rows(t):
    turn = F.col("turn")
    context = F.array(F.col("role"), F.to_json(F.struct(F.col("text").alias("content"))))
    line = F.to_json(F.struct(F.concat_ws("/", F.col("conv_id").cast("string"), turn.cast("string")).alias("id"), F.col("text").alias("query"), F.col("text").alias("answer"), F.to_json(context).alias("contexts")))
    rows = t("conversations").where("text is not null").select(F.when(turn % 4 < 3, line).otherwise(F.concat(F.when(turn % 8 == 3, "# ").otherwise("{broken "), line)).alias("value"))
    folder = own_folder(rows)
    rows.write.text(folder)
    found = replay(rows.sparkSession, folder)
    return found.select("id", F.md5("answer").alias("answer"), F.size("contexts").alias("contexts"), F.md5(F.array_join("contexts", "|")).alias("held"))


# Benchmark passages as memories for the turns of conversations.
@query(rf"""with q as (select distinct conv_id * 1000 + turn as id, unnest({TOKENS}) as term from conversations), m as (select distinct item_id as memory, length(text) as weight, unnest({TOKENS}) as term from benchmark),
s as (select id, memory, weight, count(*) as shared from q join m using (term) where length(term) >= 4 group by all), r as (select *, row_number() over (partition by id order by shared desc, weight desc, memory) as place from s qualify place <= 5),
l as (select id, list(memory order by place) as memories from r group by id)
select c.id, coalesce(array_to_string(memories, ','), '') as memories from (select conv_id * 1000 + turn as id from conversations) c left join l on l.id = c.id""")
def memories_for_questions(t):
    questions = t("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("question"))
    memories = t("benchmark").select(F.col("item_id").alias("memory"), F.col("text").alias("content"), F.length("text").alias("weight"))
    return records.enriched(questions, memories).select("id", F.array_join(F.transform("memories", lambda m: m.cast("string")), ",").alias("memories"))
