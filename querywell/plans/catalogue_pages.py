"""Queries over the text of pages and over procedures of clauses, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import channels, lexical
from .catalogue import DECIMALS, TOKENS, passages, query
from .catalogue_channels import ROLES

BARE = r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '<[^>]*>', ' ', 'g')"


# Pages by the share of a passage's words that their text holds, where no page vectors are at hand.
@query(rf"""with p as (select page_id, list_distinct({TOKENS.replace('text', 'body')}) as w from (select page_id, {BARE} as body from pages)), q as (select item_id as qid, list_distinct({TOKENS}) as w from benchmark),
t as (select page_id, unnest(w) as term from p), a as (select qid, len(w) as n, unnest(w) as term from q), s as (select qid, page_id, round(count(*) / any_value(n), 6) as score from a join t using (term) group by qid, page_id)
select qid, page_id, score, row_number() over (partition by qid order by score desc, page_id)::int as rank from s qualify rank <= 5""")
def page_text_topk(t):
    body = F.col("html")
    for pattern in (r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", r"<[^>]*>"):
        body = F.regexp_replace(body, pattern, " ")
    pages = t("pages").select(F.col("page_id").alias("doc_id"), body.alias("text"), F.lit(True).alias("keep"))
    asked = passages(t).select("qid", F.array_distinct(tokens(F.col("query"))).alias("words")).where(F.size("words") > 0)
    hits = lexical.scored_topk(pages, asked.select("qid", F.array_join("words", " ").alias("query")), 5, lambda n, avgdl, df: lambda tf, term, dl: np.ones(len(tf)), with_statistics=False)
    sizes = asked.select("qid", F.size("words").alias("n"))
    return hits.join(sizes, "qid").select("qid", F.col("doc_id").alias("page_id"), F.round(F.col("score") / F.col("n"), DECIMALS).alias("score"), "rank")


# Procedures whose clauses got just one role each; of some documents a role is missing, or one too many was given.
@query(f"""with u as (select doc_id, n as clause, 's' || (n % 3) as source, trim(line) as body, {ROLES}[1 + (n + doc_id) % 7] as r from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as n from documents) where trim(line) <> ''),
k as (select * from u where doc_id % 4 >= 2), v as (select *, case when r in ('main_rule', 'scope') or (r = 'step' and regexp_matches(body, '{channels.CONSTRAINT}')) then 'lead' else r end as role from k),
w as (select *, row_number() over (partition by doc_id, role, source order by clause) = 1 as first from v where doc_id in (select doc_id from v where role = 'lead'))
select doc_id, list_position(['lead', 'step', 'record', 'limit'], role)::int as place, md5('**' || ['Rules and scope', 'Procedure', 'Records and purposes', 'Conditions and boundaries'][list_position(['lead', 'step', 'record', 'limit'], role)] || '**' || chr(10) || chr(10) || string_agg(body, ' ' order by clause) || string_agg('[' || source || ']', '' order by clause) filter (first)) as block
from w where role <> 'omit' group by doc_id, role""")
def procedures_rendered(t):
    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("clause", "line")).where(F.trim("line") != "")
    units = lines.select("doc_id", "clause", F.concat(F.lit("s"), F.col("clause") % 3).alias("source"), F.trim("line").alias("body"))
    role = F.element_at(F.array(*map(F.lit, ROLES)), (1 + (F.col("clause") + F.col("doc_id")) % 7).cast("int"))
    first = units.groupBy("doc_id").agg(F.min("clause").alias("first"))
    given = units.join(first, "doc_id").where("not (doc_id % 4 = 0 and clause = first)").select("doc_id", "clause", role.alias("role"))
    given = given.unionByName(first.where("doc_id % 4 = 1").select("doc_id", F.lit(-1).alias("clause"), F.lit("step").alias("role")))
    return channels.procedure_blocks(channels.with_roles(units, given, "doc_id"), "doc_id").select("doc_id", "place", F.md5("block").alias("block"))
