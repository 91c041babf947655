"""Question sets, title links and feedback on small fixtures, odd rows among them."""

import re

import pytest
from pyspark.sql import functions as F

from querywell.functions import text
from querywell.operators import adapters


def ids(spark, *texts):
    return [spark.createDataFrame([(x,)], "t string").select(text.content_id(F.col("t"))).first()[0] for x in texts]


def test_passages_of_questions_without_answer_or_choice_are_left_out(spark):
    rows = [(1, 0, "a b", True, True), (1, 1, "c", False, True), (1, 2, "a  b", True, True), (2, 0, "d", True, False), (3, 0, "e", None, True), (4, 0, " ", True, True), (5, 0, None, True, True)]
    rows += [(6, n, f"p{n}", True, True) for n in range(5)]
    cases, chunks = adapters.selected_passages(spark.createDataFrame(rows, "qid int, place int, text string, selected boolean, answered boolean"))
    assert dict(cases.collect()) == {1: ids(spark, "a b"), 6: ids(spark, "p0", "p1", "p2")}
    assert {r["id"] for r in chunks.collect()} == set(ids(spark, "a b", "c", *(f"p{n}" for n in range(5))))


def test_supported_paragraphs_or_the_first_two(spark):
    rows = [(1, 0, "x", ["A."], ["y"]), (1, 1, "y", ["B.", "C."], ["y"]), (2, 0, "x", ["D."], []), (2, 1, "y", ["E."], []), (2, 2, "z", ["F."], []), (3, 0, None, ["G."], None), (4, 0, "x", None, ["x"])]
    cases, chunks = adapters.supported_passages(spark.createDataFrame(rows, "qid int, place int, title string, sentences array<string>, supports array<string>"))
    assert dict(cases.collect()) == {1: ids(spark, "B. C."), 2: ids(spark, "D.", "E."), 3: ids(spark, "G.")}
    assert chunks.count() == 6


def test_title_links_are_those_of_a_plain_walk(spark):
    rows = [(d, i, None if i % 9 == 0 else i - 1 - (i * d) % min(i % 9, 3), i % 4 == d, f"t{i}") for d in (1, 2) for i in range(40)]
    rows += [(3, i, i - 1 if i else None, None if i == 5 else i % 7 == 0, None if i == 7 else f"t{i}") for i in range(70)]  # deep
    rows += [(4, 0, 9, True, "a"), (4, 1, 1, False, "b"), (4, 3, 2, True, "c"), (4, 4, 3, False, "d")]  # after, itself, unknown
    by = {(d, i): (p, bool(t), b) for d, i, p, t, b in rows}

    def walk(d, i):
        titles, near = [], None
        while i is not None:
            p, is_title, body = by[d, i]
            p = p if (d, p) in by and p < i else None
            if is_title:
                near = i if near is None else near
                titles.insert(0, body or "")
            i = p
        return near, " -> ".join(titles)

    got = adapters.title_links(spark.createDataFrame(rows, "doc int, idx int, parent int, is_title boolean, body string")).collect()
    assert {(r["doc"], r["idx"]): (r["title"], r["path"]) for r in got} == {k: walk(*k) for k in by}
    assert adapters.title_links(spark.createDataFrame([], "doc int, idx int, parent int, is_title boolean, body string")).count() == 0


def test_feedback_and_escalation(spark):
    feedback = spark.createDataFrame([("a", True, " "), ("b", True, "better"), ("c", False, None), ("d", True, None), ("e", None, None)], "trace string, negative boolean, corrected string")
    logged = spark.createDataFrame([("a", "q", "x", 0.4), ("b", "q", "x", 0.5), ("c", "q", "x", 0.1), ("e", "q", "x", 0.1), ("a", "q", "y", float("nan"))], "trace string, query string, answer string, faithfulness double")
    got = sorted((r["trace"], r["reference"], r["miss"]) for r in adapters.flywheel(feedback, logged).collect())
    assert got == [("a", "x", True), ("a", "y", False), ("b", "better", False)]
    rows = spark.createDataFrame([("high", "x"), ("low", "x"), (None, "x"), ("critical", None)], "l string, answer string")
    out = [tuple(r) for r in adapters.escalated(rows, F.col("l"), "answer", "w").select("answer", "escalated").collect()]
    assert out == [("x\n\nw", True), ("x", False), ("x", False), ("\n\nw", True)]


@pytest.mark.parametrize("query, want", [("WHO are you", True), ("12345", True), ("none", False), (None, False), ("", False)])
def test_matches(spark, query, want):
    assert spark.createDataFrame([(query,)], "q string").select(adapters.matches(F.col("q"), ["who"], [r"\d{4}"])).first()[0] is want


def test_contexts_in_overlapping_chunks(spark):
    def plain(context):
        out, now = [], ""
        for s in re.split("(?<=[。！？!?])", context):
            if now and len(now) + len(s) > 400:
                out.append(now)
                now = (now[-40:] if len(now) > 40 else "") + s
            else:
                now += s
        return out + [now] if now else out

    texts = ["", "no end", "a" * 399 + "。b", "x。" * 700, "y" * 900 + "！" + "z?" * 5, ("w" * 120 + "。") * 9, "q" * 30 + "。" + "r" * 500 + "。"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in texts], "t string").select(adapters.context_chunks(F.col("t"))).collect()]
    assert got == [plain(x) for x in texts]
    rows = [(1, "q", texts[5], "www", 300), (2, "q", texts[5], "www", -1), (3, "q", texts[5], "none", -1), (4, "", "c", "c", 0), (5, "q", None, "c", 0), (6, "q", "c", None, 0)]
    cases, chunks = adapters.span_passages(spark.createDataFrame(rows, "qid int, question string, context string, gold string, start int"))
    parts = ids(spark, *plain(texts[5]))
    assert dict(cases.collect()) == {1: [parts[0]], 2: [parts[0]]} and {r["id"] for r in chunks.collect()} == set(parts)
