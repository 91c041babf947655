"""Queries over splits of texts and over streamed replies, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import splitting
from ..operators.state import shared_folder
from ..streaming.ingestion import Ingestion
from ..streaming.lexical_index import LexicalIndex
from ..streaming.replies import MOST_BYTES, paragraphs
from ..streaming.sessions import session_states
from .catalogue import TOKENS, query

# Sentences with their neighbours, their distances, the threshold of each text, and the segments.
SEGMENTS = rf"""s as (
  select doc_id, list_filter(string_split(regexp_replace(text, '([.?!])[\x20\x09-\x0D]+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') as parts from documents where length(text) > 0 <where>
), one as (select doc_id, unnest(parts) as part, generate_subscripts(parts, 1) as i, len(parts) as n from s),
terms as (select doc_id, i, n, unnest({TOKENS.replace('text', 'part')}) as term from one),
counted as (select doc_id, i, n, ('0x' || left(md5(term), 2))::int % 64 as b, count(*) as c from terms group by all),
near as (select doc_id, w, b, sum(c)::double as c from (select doc_id, n, b, c, unnest([i - 1, i, i + 1]) as w from counted) where w between 1 and n group by all),
square as (select doc_id, w, sum(c * c) as sq from near group by all),
dots as (select x.doc_id, x.w, sum(x.c * y.c) as dot from near x join near y on x.doc_id = y.doc_id and y.w = x.w + 1 and x.b = y.b group by all),
far as (
  select o.doc_id, o.i, case when coalesce(x.sq, 0) * coalesce(y.sq, 0) > 0 then round(1 - coalesce(dot, 0) / sqrt(x.sq * y.sq), 9)
    when coalesce(x.sq, 0) + coalesce(y.sq, 0) = 0 then 0 else 1 end as far
  from one o left join square x on x.doc_id = o.doc_id and x.w = o.i left join square y on y.doc_id = o.doc_id and y.w = o.i + 1
    left join dots d on d.doc_id = o.doc_id and d.w = o.i where o.i < o.n
), cuts as (select doc_id, i, far > quantile_cont(far, 0.95) over (partition by doc_id) + 1e-9 as cut from far),
placed as (
  select o.doc_id, o.part, o.i, coalesce(sum(cut::int) over (partition by o.doc_id order by o.i rows between unbounded preceding and 1 preceding), 0)::int as place
  from one o left join cuts c on c.doc_id = o.doc_id and c.i = o.i
), segments as (select doc_id, place, string_agg(part, ' ' order by i) as chunk from placed group by all)"""


@query(f"with {SEGMENTS.replace('<where>', '')} select doc_id, place, sha1(chunk) as chunk from segments")
def semantic_chunks(t):
    return splitting.semantic_chunks(t("documents")).select("doc_id", "place", F.sha1("chunk").alias("chunk"))


@query()
def recursive_chunks(t):
    return splitting.recursive_chunks(t("documents")).select("doc_id", "place", F.sha1("chunk").alias("chunk"))


def sized_sql(measure: str, keep: int) -> str:
    return f"""with {SEGMENTS.replace('<where>', f'and {measure} > {keep}')},
chunks as (select * from segments union all select doc_id, 0, text from documents where length(text) > 0 and {measure} <= {keep})
select doc_id, left(sha1(source || '::' || ('0x' || left(sha1(text), 8))::bigint), 16) as parent_id, place, sha1(chunk) as chunk, count(*) over (partition by doc_id) = 1 as whole
from chunks join documents using (doc_id)"""


@query(sized_sql("length(text)", 3840))
def sized_chunks(t):
    return splitting.sized_chunks(t("documents")).withColumn("chunk", F.sha1("chunk"))


@query(sized_sql("greatest(1, floor(length(text) / 3.2))", 1200))
def token_sized_chunks(t):
    return splitting.sized_chunks(t("documents"), splitting.KEEP_TOKENS, splitting.tokens_of).withColumn("chunk", F.sha1("chunk"))


# Replies of eight lines each, cut into pieces as they would stream in.
@query(f"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as place from documents),
e as (select doc_id, place // 8 as block, place % 8 as number, '{{"text":' || to_json(line)::varchar || ',"source_ids":[' || (place % 3 + 1) || ']}}' as e, line from l),
r as (select doc_id, block, '{{"conditions":[{{"text":"on ' || block || '","source_ids":[1]}}],"answer":[' as head, list(e order by number) as es, list(line order by number) as lines from e group by doc_id, block),
t as (select *, head || array_to_string(es, ',') || ']}}' as reply from r),
p as (select *, unnest(lines) as line, generate_subscripts(lines, 1) as i from t),
q as (select *, length(head) + list_sum(list_transform(es[1:i], lambda x: length(x))) + i as ends from p)
select doc_id || '/' || block as stream_id, (i - 1)::int as number, md5(line) as digest, (i = 1)::int as conditions, null::varchar as status from q where strlen(left(reply, (((ends - 1) // 61 + 1) * 61)::bigint)) <= {MOST_BYTES}
union all
select doc_id || '/' || block, null, null, 0, case when strlen(reply) > {MOST_BYTES} then 'generation_buffer_limit' when block % 5 = 4 then 'incomplete_generation' else 'complete' end from t""")
def reply_paragraphs(t):
    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    one = F.struct("place", F.struct(F.col("line").alias("text"), F.array(F.col("place") % 3 + 1).alias("source_ids")).alias("x"))
    replies = lines.groupBy("doc_id", F.floor(F.col("place") / 8).alias("block")).agg(F.transform(F.array_sort(F.collect_list(one)), lambda e: e["x"]).alias("answer"))
    head = F.array(F.struct(F.concat(F.lit("on "), F.col("block").cast("string")).alias("text"), F.array(F.lit(1)).alias("source_ids")))
    whole = replies.select("doc_id", "block", F.to_json(F.struct(head.alias("conditions"), "answer")).alias("reply"))
    last = F.floor((F.length("reply") - 1) / 61)
    pieces = whole.select("*", last.alias("last"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("seq"))
    finish = F.when(F.col("seq") == F.col("last"), F.when(F.col("block") % 5 == 4, "length").otherwise("stop"))
    parts = pieces.select(F.concat_ws("/", F.col("doc_id").cast("string"), F.col("block").cast("string")).alias("stream_id"), "seq", F.col("reply").substr((F.col("seq") * 61 + 1).cast("int"), F.lit(61)).alias("piece"), finish.alias("finish"))
    return paragraphs(parts).select("stream_id", "number", F.md5("paragraph.text").alias("digest"), F.size("conditions").alias("conditions"), "status")


# Each user's events as the messages of a session.
@query("""with m as (select user_id, ts, event_id, case event_type when 'click' then 'user' when 'view' then 'assistant' else event_type end as role, event_id || ' ' || props as text from events where user_id is not null),
p as (select *, row_number() over (partition by user_id order by ts) as place, count(*) over (partition by user_id) as n from m),
w as (select *, n > 10 and place <= n - 6 as old, case role when 'user' then '用户' when 'assistant' then '助手' else role end || ': ' || left(text, 200) as line from p)
select user_id::varchar as session_id, floor(epoch(min(ts)))::bigint as created_at, floor(epoch(max(ts)))::bigint as last_active, coalesce(left(min_by(text, ts) filter (where role = 'user'), 50), '') as title, count(*)::bigint as messages,
  md5(coalesce(left(string_agg(line, chr(10) order by ts) filter (where old), 3000), '')) as dialog, md5(string_agg(text, chr(10) order by ts) filter (where not old)) as recent, false as expired from w group by user_id""")
def session_history(t):
    role = F.when(F.col("event_type") == "click", "user").when(F.col("event_type") == "view", "assistant").otherwise(F.col("event_type"))
    messages = t("events").select(F.col("user_id").alias("session_id"), F.col("ts").alias("at"), role.alias("role"), F.concat_ws(" ", F.col("event_id").cast("string"), "props").alias("text"))
    second = lambda c: F.floor(c).alias(c)
    return session_states(messages).select("session_id", second("created_at"), second("last_active"), "title", "messages", F.md5("dialog").alias("dialog"), F.md5(F.array_join("recent", "\n")).alias("recent"), "expired")


def own_folder(df) -> str:
    return f"{shared_folder(df.sparkSession).rstrip('/')}/batches-{uuid.uuid4().hex}"


# Four batches: half of the documents; the others, with a source taken away; some again with other texts; one batch in place of all.
@query(rf"""with live as (select doc_id, case when doc_id % 10 = 3 then text || ' renewed words' else text end as text from documents where doc_id % 2 = 1 or coalesce(source, '') <> 'src1'),
tf as (select doc_id, unnest({TOKENS}) as term from live)
select term, count(distinct doc_id)::bigint as df, (select count(*) from live)::bigint as n, (select round(avg(len({TOKENS})), 6) from live) as mean_length from tf group by term""")
def lexical_index_batches(t):
    docs = t("documents").select("doc_id", "source", "text", F.lit(False).alias("removed"))
    index = LexicalIndex(docs.sparkSession, own_folder(docs))
    gone = docs.sparkSession.createDataFrame([(None, "src1", None, True)], docs.schema)
    renewed = docs.where("doc_id % 10 = 3").withColumn("text", F.concat("text", F.lit(" renewed words")))
    for n, changes in enumerate((docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1").unionByName(gone), renewed)):
        index.apply(changes, n)
    index.compact(3)
    totals = index.totals().select("n", F.round("mean_length", 6).alias("mean_length"))
    return index.term_stats().join(F.broadcast(totals))


# Documents as files in two batches: some of a kind that is not taken, some under one name, copies.
FILES = "case when doc_id % 11 = 0 then 'pdf' when doc_id % 2 = 0 then 'md' else 'txt' end"


@query(rf"""with f as (select doc_id, doc_id % 2 as batch, 'file' || (case when doc_id % 13 = 0 then doc_id % 26 + 100000000 else doc_id end) || '.' || {FILES} as filename, sha256(text) as file_hash, strlen(text)::bigint as size_bytes, not contains({FILES}, 'pdf') as allowed, text from documents where text is not null),
a as (select *, allowed and row_number() over (partition by batch, filename, allowed order by file_hash, doc_id::varchar) = 1 as f1 from f),
b as (select *, f1 and row_number() over (partition by batch, file_hash, f1 order by filename) = 1 as f2 from a),
c as (select * from b where batch = 0),
late as (select *, allowed and filename not in (select filename from c where f2 and regexp_matches(text, '\S')) and file_hash not in (select file_hash from c where f2 and regexp_matches(text, '\S')) as fresh from f where batch = 1),
d as (select *, fresh and row_number() over (partition by filename, fresh order by file_hash, doc_id::varchar) = 1 as f1 from late),
e as (select *, f1 and row_number() over (partition by file_hash, f1 order by filename) = 1 as f2 from d),
j as (select doc_id, batch, filename, file_hash, size_bytes, allowed, f2, text from b where batch = 0 union all select doc_id, batch, filename, file_hash, size_bytes, allowed, f2, text from e),
{SEGMENTS.replace('<where>', 'and length(text) > 3840')},
n as (select doc_id, count(*) as n from segments group by doc_id)
select filename, file_hash, case when not allowed then 'rejected' when not f2 then 'duplicate' when not regexp_matches(text, '\S') then 'failed' else 'indexed' end as status, size_bytes,
  case when allowed and f2 and regexp_matches(text, '\S') then coalesce(n, 1) else 0 end::bigint as chunks, batch::bigint as batch from j left join n using (doc_id)""")
def ingested_files(t):
    kind = F.when(F.col("doc_id") % 11 == 0, "pdf").when(F.col("doc_id") % 2 == 0, "md").otherwise("txt")
    number = F.when(F.col("doc_id") % 13 == 0, F.col("doc_id") % 26 + 100_000_000).otherwise(F.col("doc_id"))
    path = F.concat(F.lit("in/"), F.col("doc_id").cast("string"), F.lit("/file"), number.cast("string"), F.lit("."), kind)
    files = t("documents").where("text is not null").select("doc_id", path.alias("path"), F.col("text").cast("binary").alias("content"))
    store = Ingestion(files.sparkSession, own_folder(files))
    for n in (0, 1):
        store.apply(files.where(F.col("doc_id") % 2 == n).drop("doc_id"), n)
    return store.registry()
