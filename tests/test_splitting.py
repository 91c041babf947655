"""Splits of texts: hand-checked cuts, a plain version, and what holds for every text."""

import random
import re

import numpy as np
import pytest

from querywell.operators import splitting


def plain_chunks(text, size, overlap, separators, measure):
    """The same rule, each level as lists."""
    if not text:
        return []
    at = next(k for k, s in enumerate(separators) if s == "" or s in text)
    sep, later = separators[at], separators[at + 1 :]
    pieces = [p for p in (re.split(f"(?={re.escape(sep)})", text) if sep else list(text)) if p]
    if sep and len(sep) > 1:  # a lookahead may also cut inside a run of the separator
        parts = text.split(sep)
        pieces = [p for p in [parts[0], *(sep + x for x in parts[1:])] if p]
    out, run = [], []

    def pack(run):
        start = 0
        for end in range(len(run)):
            if end > start and sum(map(measure, run[start : end + 1])) > size:
                out.append("".join(run[start:end]))
                while start < end and (sum(map(measure, run[start:end])) > overlap or sum(map(measure, run[start : end + 1])) > size):
                    start += 1
        if run:
            out.append("".join(run[start:]))

    for p in pieces:
        if measure(p) < size:
            run.append(p)
        else:
            pack(run)
            run = []
            out.extend(plain_chunks(p, size, overlap, later, measure) if later else [p])
    pack(run)
    return [c.strip() for c in out if c.strip()]


@pytest.mark.parametrize(("size", "overlap"), [(10, 0), (10, 4), (25, 12), (3, 1)])
def test_recursive_pieces_equal_the_plain_rule(size, overlap):
    rng = random.Random(size)
    letters = ["a", "bc", "def ", " ", "\n", "\n\n", ".", "。", "！", ",", "，", ";", "xyzxyzxyzxyzxyz"]
    for _ in range(300):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(40)))
        got = splitting.recursive_pieces(text, size, overlap)
        assert got == plain_chunks(text, size, overlap, splitting.SEPARATORS, len)
        assert all(0 < len(c) <= size and c in text for c in got)


def test_recursive_pieces_by_hand():
    assert splitting.recursive_pieces("one two three four", 9, 4) == ["one two", "three", "four"]
    assert splitting.recursive_pieces("aa bb cc dd", 6, 3) == ["aa bb", "bb cc", "cc dd"]
    assert splitting.recursive_pieces("first part\n\nsecond part", 15, 0) == ["first part", "second part"]
    assert splitting.recursive_pieces("甲乙。丙丁。戊己", 4, 0) == ["甲乙", "。丙丁", "。戊己"]
    assert splitting.recursive_pieces("abcdefghij", 4, 2) == ["abcd", "cdef", "efgh", "ghij"]
    assert splitting.recursive_pieces("", 4, 2) == [] and splitting.recursive_pieces(" \n ", 4, 2) == []
    words = [f"word{k}" for k in range(2000)]
    tokens = splitting.recursive_pieces(" ".join(words), 900, 120, measure=splitting.tokens_of)
    assert len(tokens) > 1 and all(any(w in c for c in tokens) for w in words)


def test_chunks_of_given_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    chunks = lambda overlap: {d: [c for _, c in sorted(x)] for d, x in grouped(splitting.recursive_chunks(docs, overlap=overlap).collect()).items()}
    assert {d: "".join("".join(c).split()) for d, c in chunks(0).items()} == {d: "".join(t.split()) for d, t in texts.items() if t.strip()}
    assert all(c == plain_chunks(texts[d], 900, 120, splitting.SEPARATORS, len) for d, c in chunks(120).items() if len(texts[d]) < 6000)


def grouped(rows):
    found = {}
    for r in rows:
        found.setdefault(r["doc_id"], []).append((r["place"], r["chunk"]))
    return found


def test_segments_begin_where_the_words_change():
    one = ["Cats purr and cats sleep."] * 12
    two = ["Stocks fell while bonds rose."] * 12
    pieces = splitting.semantic_pieces(" ".join(one + two), 90)
    assert len(pieces) > 1 and " ".join(pieces) == " ".join(one + two) and not any("Cats" in p and "Stocks" in p for p in pieces)
    assert splitting.semantic_pieces("Only one sentence here.") == ["Only one sentence here."]
    assert splitting.semantic_pieces(" ".join(one)) == [" ".join(one)]  # nothing is farther than the threshold
    assert splitting.semantic_pieces("") == []


def test_breakpoints_use_the_given_vectors():
    vectors = np.array([[1.0, 0]] * 4 + [[0, 1.0]] * 4)
    assert splitting.breakpoints(vectors, 80).tolist() == [False, False, False, True, False, False, False]
    assert splitting.breakpoints(vectors[:1]).tolist() == []
    nothing = np.zeros((3, 2))
    assert not splitting.breakpoints(nothing).any()


def test_sized_chunks_keep_small_texts_and_carry_the_parent(spark):
    rng = random.Random(1)
    long = " ".join(f"{rng.choice(['Rain', 'Snow', 'Trade', 'Music'])} {rng.random()} goes on." for _ in range(300))
    unbroken = "x" * 5000
    rows = [(1, "s", "short text"), (2, "s", long), (3, None, "short"), (4, "s", None), (5, "s", ""), (6, "s", unbroken)]
    got = splitting.sized_chunks(spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 place", "2 chunk", "3 pieces")).collect()
    by = {d: sorted((r["place"], r["chunk"]) for r in got if r["doc_id"] == d) for d in range(1, 7)}
    assert [c for _, c in by[1]] == ["short text"] and not by[4] and not by[5] and [c for _, c in by[6]] == [unbroken]
    assert len(by[2]) > 1 and " ".join(c for _, c in by[2]) == long
    assert {r["parent_id"] is None for r in got if r["doc_id"] == 3} == {True} and len({r["parent_id"] for r in got if r["doc_id"] == 2}) == 1
    parts = splitting.sized_chunks(spark.createDataFrame(rows, "doc_id long, source string, text string"), by_subject=False).where("doc_id = 6").collect()
    assert [len(r["chunk"]) for r in sorted(parts, key=lambda r: r["place"])][:5] == [900] * 5
