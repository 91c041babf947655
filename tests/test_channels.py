"""Facets, channels, passes, pages, procedures and replies on small fixtures, odd rows among them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from querywell.functions import cleaning
from querywell.operators import channels, lexical


def test_ranked_chunks_are_those_of_a_plain_loop(spark):
    rng = np.random.default_rng(5)
    ranks = {i: round(float(r), 2) for i, r in enumerate(rng.random(12))}  # ties
    chunks = [(int(rng.integers(0, 14)), f"s{n % 2}", n, [None, "", "a", "b", f"t{n}"][n % 5]) for n in range(60)]
    got = channels.ranked_chunks(spark.createDataFrame(list(ranks.items()), "id int, rank double"), spark.createDataFrame(chunks, "id int, source string, ordinal int, text string"), 9).collect()
    seen, want = set(), []
    for i in sorted(ranks, key=lambda i: (-ranks[i], i)):
        for _, source, n, text in sorted((c for c in chunks if c[0] == i), key=lambda c: c[2]):
            if text and (source, text) not in seen:
                seen.add((source, text))
                want.append((i, n))
    assert [(r["id"], r["ordinal"]) for r in got] == want[:9]


def test_ranked_chunks_join_digests_and_no_texts(spark):
    ranks, chunks = spark.createDataFrame([(1, 0.5)], "id int, rank double"), spark.createDataFrame([(1, "s", 0, "a")], "id int, source string, ordinal int, text string")
    plan = channels.ranked_chunks(ranks, chunks, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("sha2(")


def test_token_matching_gives_the_known_mean(spark):
    pages = spark.createDataFrame([(1, [[1.0, 0.0], [0.0, 1.0]]), (2, [[-1.0, 0.0]]), (3, [])], "page int, tokens array<array<double>>")
    asked = spark.createDataFrame([(7, [[1.0, 0.0], [0.0, 1.0]]), (8, []), (9, None)], "qid int, tokens array<array<double>>")
    got = {(r["qid"], r["page"]): (r["score"], r["rank"]) for r in channels.token_matched(pages, asked, 5).collect()}
    assert got == {(7, 1): (1.0, 1), (7, 2): (-0.5, 2)}


def test_facets_are_covered_before_the_rest(spark):
    rows = [(1, "A", 10, "k1", 0.99), (1, "A", 11, "k2", 0.98), (1, "B", 12, "k3", 0.7), (1, "B", 10, "k1", 0.5), (1, "A", 13, "k3", 0.1)]
    got = channels.by_facet(spark.createDataFrame(rows, "qid int, facet string, id int, key string, score double"), 2).orderBy("place").collect()
    assert [r["id"] for r in got] == [10, 11]  # 10 covers both facets
    lone = spark.createDataFrame([r for r in rows if r[2] != 10] + [(1, "A", 10, "k1", 0.99)], "qid int, facet string, id int, key string, score double")
    assert [r["id"] for r in channels.by_facet(lone, 2).orderBy("place").collect()] == [10, 12]
    assert channels.by_facet(lone.where("false"), 2).count() == 0


def test_second_pass_only_where_the_first_is_not_accepted(spark):
    first, second = (spark.createDataFrame(x, "qid int, id int") for x in ([(1, 5), (2, 6)], [(1, 7), (2, 8), (3, 9)]))
    states = spark.createDataFrame([(1, "accept"), (2, "weak"), (3, "empty")], "qid int, state string")
    assert sorted(map(tuple, channels.with_second_pass(first, states, second).collect())) == [(1, 5, False), (2, 8, True), (3, 9, True)]


def test_pages_need_one_row_each_without_gaps_and_with_their_hash(spark):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("b", 1, "x"), ("b", 3, "x"), ("c", 1, "x"), ("c", 1, "x"), ("d", 1, None)]
    df = spark.createDataFrame(rows, "g string, page int, held string").withColumn("stated", F.coalesce("held", F.lit("x")))
    got = dict(channels.valid_pages(df, "g", "page", F.col("held"), F.col("stated")).collect())
    assert got == {"a": True, "b": False, "c": False, "d": False}


def test_ids_of_retrieved_texts(spark):
    found = spark.createDataFrame([("m", "t"), ("", "t"), (None, "u"), (None, None)], "known string, normal string")
    corpus = spark.createDataFrame([(3, "t"), (2, "t"), (9, None)], "id int, normal string")
    got = [r["id"] for r in channels.corpus_ids(found, corpus, "known", "normal", F.lit("f")).orderBy(F.desc_nulls_last("known"), "normal").collect()]
    assert sorted(got) == ["2", "f", "f", "m"]


def test_procedures_need_a_lead_and_name_sources_once(spark):
    rows = [(1, 1, "b", "Open it.", "step"), (1, 2, "a", "You must wait.", "step"), (1, 3, "b", "Close it.", "step"), (1, 4, "a", "never", "omit"), (2, 1, "a", "Open it.", "step")]
    got = channels.procedure_blocks(spark.createDataFrame(rows, "p int, clause int, source string, body string, role string"), "p").orderBy("place").collect()
    assert [(r["p"], r["block"]) for r in got] == [(1, "**Rules and scope**\n\nYou must wait.[a]"), (1, "**Procedure**\n\nOpen it. Close it.[b]")]


def test_spans_of_pieces_in_turn(spark):
    rows = [("ab ab c", ["ab", "", "ab", "c"]), ("ab", ["b", "a"]), (None, ["a"]), ("", []), ("x", None)]
    got = [r[0] and [tuple(s) for s in r[0]] for r in spark.createDataFrame(rows, "t string, p array<string>").select(channels.piece_spans("t", "p")).collect()]
    assert got == [[(0, 2), (2, 2), (3, 5), (6, 7)], None, None, [], None]


@pytest.mark.parametrize("reply, want", [('{"score": "YES"}', True), ('{"answer": "not relevant", "relevance": "yes"}', False), ('{"other": "yes"}', False), ("well, Yes", True), ("{broken yes", True), (None, False), ("", False)])
def test_grades(spark, reply, want):
    assert spark.createDataFrame([(reply,)], "r string").select(cleaning.relevant(F.col("r"))).first()[0] is want


def test_values_and_paragraphs(spark):
    one = spark.createDataFrame([("dir\\sub/Ａ<b>​\x07 c.md", "<think>x</think> text ")], "v string, t string")
    value, para, unknown, blank = one.select(
        cleaning.metadata_value(F.col("v"), is_source=True), cleaning.cited_paragraph(F.col("t"), F.array(F.lit(2), F.lit(1), F.lit(2)), F.array(F.lit("a"), F.lit(""))),
        cleaning.cited_paragraph(F.col("t"), F.array(F.lit(3)), F.array(F.lit("a"))), cleaning.cited_paragraph(F.lit(" "), F.array(F.lit(1)), F.array(F.lit("a"))),
    ).first()
    assert (value, para, unknown, blank) == ("A‹b› c.md", "text[证据2][a]", None, None)
    answer = one.select(cleaning.structured_answer(F.lit("no titles"), ["结论", "依据"])).first()[0]
    assert answer is None
    text = one.select(cleaning.without_boilerplate(F.lit("Yes.\n\n> ⚠️ 提示: maybe\nmore\n\nKept. Ask a person."), [" Ask a person. ", ""])).first()[0]
    assert text == "Yes.\n\n\n\nKept."


def test_statistics_follow_the_documents(spark):
    docs = spark.createDataFrame([(1, "red blue"), (2, "red"), (3, "green"), (4, None)], "doc_id int, text string")
    whole, gone = (lexical.term_stats(d).select("term", "df") for d in (docs, docs.where("doc_id in (1, 3)")))
    added = lexical.term_stats(docs.where("doc_id = 1")).select("term", "df")
    assert dict(lexical.updated_stats(whole, gone, added).collect()) == {"red": 2, "blue": 1}
