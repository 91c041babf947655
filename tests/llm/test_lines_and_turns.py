"""Line dedup, fill-in-the-middle and conversation repair against plain versions and odd tables."""

import itertools
import random
import re
from collections import Counter, defaultdict
from hashlib import sha256
from zlib import crc32

import pytest

from querywell.llm import conversations, fill_middle, line_dedup

DOCS = "doc_id long, text string"
CLASH = ["'x' position", "'x' row_key", "'x' h1", "'x' part", "'x' place", "'x' kept", "'x' line", "'x' output", "'x' form", "'x' n", "'x' gone", "'x' copy", "'x' cost", "'x' range_number"]


def digest(text):
    return sha256(text.encode()).hexdigest()


# Lines ---------------------------------------------------------------------------------------------------------------


def plain_lines(rows, chars=20, least=3):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\v\f\r"))
    order = lambda d: -1 if d is None else d
    held = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            held[key(line)].add(order(d))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [k for k, line in enumerate(lines) if len(key(line)) < chars or len(held[key(line)]) < least or order(d) == max(held[key(line)])]
        out.append((d, len(lines), len(lines) - len(stay), digest("\n".join(lines[k] for k in stay))))
    return Counter(out)


def made_documents(seed, n=120):
    rng = random.Random(seed)
    pool = ["a line of words that comes again", "A LINE of words that comes again ", "\tanother line which is often seen\r", "short", "", "   ", "żółta linia powtarza się tutaj", "two documents hold this line only", "nineteen characters", "exactly twenty chars", "Ünicode Ä upper stays as it is!!"]
    rows = [(rng.choice([None, *range(n)]) if rng.random() < 0.2 else k, "\n".join(rng.choice([*pool, f"only here {k} {rng.random()}"]) for _ in range(rng.randrange(1, 12)))) for k in range(n)]
    return [*rows, (900, None), (901, ""), (902, "\n"), (902, "\n"), (903, "\n".join(["one line many times in this text"] * 200 + [f"line number {k} of a long text" for k in range(300)] + ["a line of words that comes again"]))]


@pytest.mark.parametrize(("prefixes", "part_rows"), [(1 << 16, 256), (4, 3), (1, 1)])
def test_line_dedup_equals_the_plain_rule(spark, prefixes, part_rows):
    rows = made_documents(1)
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", *CLASH)
    got = line_dedup.line_dedup(docs, prefixes=prefixes, part_rows=part_rows).collect()
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], digest(r["text"])) for r in got) == plain_lines(rows)


def test_line_dedup_of_given_documents_and_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = Counter(tuple(r) for r in line_dedup.line_dedup_digests(docs).collect())
    assert got == plain_lines([(r["doc_id"], r["text"]) for r in docs.collect()]) and any(r[2] for r in got)
    assert line_dedup.line_dedup_digests(docs.limit(0)).count() == 0
    assert line_dedup.line_dedup(spark.createDataFrame([(1, None)], DOCS)).collect()[0][1:3] == (1, 0)


def test_bitmaps_hold_only_words_that_lose_a_line(spark):
    repeated = "this line is in all three of them"
    rows = [(1, "\n".join([repeated] + [f"own line {k} of the first document" for k in range(200)] + [repeated])), (2, repeated), (3, repeated)]
    kept = {tuple((w["word"], w["bits"]) for w in r["kept"]) for r in line_dedup.keep_bitmaps(spark.createDataFrame(rows, DOCS)).collect()}
    assert kept == {((0, ~1), (3, ~(1 << 9))), ((0, ~1),)}


def test_a_line_in_two_documents_stays(spark):
    line = "held by two documents, so it stays"
    rows = [(1, f"{line}\n{line}"), (2, line), (1, line)]
    assert all(r["n_dropped"] == 0 for r in line_dedup.line_dedup(spark.createDataFrame(rows, DOCS)).collect())


# Fill in the middle --------------------------------------------------------------------------------------------------


def test_rotation_exchanges_two_blocks():
    for n in range(7):
        for a, b, c in itertools.combinations_with_replacement(range(n + 1), 3):
            block = bytearray(range(n))
            fill_middle.rotate(block, a, b, c)
            assert list(block) == [*range(a), *range(b, c), *range(a, b), *range(c, n)]


def plain_fill(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(tokens)
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    form = "spm" if h4 % 100 < 80 else "psm"
    return doc_id, n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_fill_middle_equals_the_plain_rule_and_comes_back(spark, sf_dir):
    rng = random.Random(3)
    letters = [*"ab \n\t.<>PSM", "é", "日", "𝒳", "\u0085", " ", "<S", "<P", "M>"]
    rows = [(k, "".join(rng.choice(letters) for _ in range(rng.randrange(0, 60)))) for k in range(1500)]
    rows += [(None, "no id but some words here"), (None, None), (7000, None), (7001, " \n "), (7002, "has <P> inside"), (7002, "has <P> inside"), (7003, "x" * 300_000), (7004, "word " * 200_000)]
    rows += [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    made = fill_middle.fill_middle(spark.createDataFrame(rows, DOCS).selectExpr("*", *CLASH))
    got = made.withColumn("restored", fill_middle.restored_text()).collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter(plain_fill(*r) for r in rows)
    assert Counter((r["doc_id"], r["restored"]) for r in got) == Counter((d, t or "") for d, t in rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_middle_digests(spark.createDataFrame([], DOCS)).count() == 0


# Conversations -------------------------------------------------------------------------------------------------------


def brute(rows, most=2):
    """All edits with up to so many insertions in each gap."""
    best = None
    options = []
    for initial, fault in rows:
        must = fault in ("blank", "duplicate")
        extra = 5 if fault == "truncated" else 0
        options.append([(2, "D", "")] + ([] if must else [(extra, "K", initial), (1 + extra, "R", "u"), (1 + extra, "R", "a")]))
    fills = [x for k in range(most + 1) for x in itertools.product("ua", repeat=k)]
    for edits in itertools.product(*options):
        for gaps in itertools.product(fills, repeat=len(rows) + 1):
            cost = sum(e[0] for e in edits) + 5 * sum(map(len, gaps))
            roles = "".join(gaps[0]) + "".join(e[2] + "".join(g) for e, g in zip(edits, gaps[1:]))
            if re.fullmatch("(s?(ua)+)?", roles):
                audit = "I" * len(gaps[0]) + "".join(e[1] + "I" * len(g) for e, g in zip(edits, gaps[1:]))
                best = min(best or (cost, audit), (cost, audit))
    return best


def test_the_agenda_finds_the_cheapest_and_least_edits():
    kinds = list(itertools.product(("s", "u", "a", "t"), (None, "truncated"))) + [("u", "blank"), ("a", "duplicate")]
    for n in range(3):
        for rows in itertools.product(kinds, repeat=n):
            assert conversations.repair(list(rows)) == brute(rows), rows
    rng = random.Random(4)
    for _ in range(60):
        rows = [rng.choice(kinds) for _ in range(4)]
        assert conversations.repair(rows) == brute(rows, 1), rows


def plain_repairs(rows):
    """conv_id, turn, role, text rows -> the result, by a table of the best (cost, audit) for each row and state."""
    convs = defaultdict(list)
    for c, t, role, text in rows:
        convs[c]
        one = lambda x: " " if x is None else x
        draw = crc32(f"{one(c)}:{one(t)}".encode()) % 20
        text = "" if draw == 1 else re.sub("[.!?]", "", one(text)) if draw == 2 else one(text)
        role = "user" if draw == 4 else one(role)
        convs[c] += [(t, role, text)] * (0 if draw == 0 else 2 if draw == 3 else 1)
    out = []
    for c, found in convs.items():
        key = lambda r: (r[0] is not None, r[0] or 0, sha256(f"{len(r[1])}\n{r[1]}\n{r[2]}".encode()).digest())
        found.sort(key=key)
        seen, faults = set(), []
        for _, role, text in found:
            bare = text.strip(" \t\n\v\f\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else None if bare[-1] in ".!?" else "truncated")
            seen.add((role, text))
        best = {"": (0, "")}

        def insert(best):
            for _ in range(3):
                for q, (cost, audit) in list(best.items()):
                    role = "a" if q == "u" else "u"
                    best[role] = min(best.get(role, (9e9, "")), (cost + 5, audit + "I"))
            return best

        for (_, role, _), fault in zip(found, faults):
            now, best = insert(best), {}
            for q, (cost, audit) in now.items():
                put = lambda r, k, e: best.__setitem__(r, min(best.get(r, (9e9, "")), (cost + k, audit + e)))
                put(q, 2, "D")
                if fault not in ("blank", "duplicate"):
                    extra, due = 5 * (fault == "truncated"), "a" if q == "u" else "u"
                    put(due, extra + (role[:1] != due), "K" if role[:1] == due else "R")
                    if q == "" and role[:1] == "s":
                        put("s", extra, "K")
        best = insert(best)
        cost, audit = min(best[q] for q in ("", "a") if q in best)
        lines, state, at = [], "", iter(found)
        for e in audit:
            due = {"u": "user", "a": "assistant"}["a" if state == "u" else "u"]
            row = None if e == "I" else next(at)
            if e == "K" and state == "" and row[1][:1] == "s":
                state = "s"
                lines.append(f"{row[1]}:{row[2]}")
            elif e != "D":
                state = due[0]
                lines.append(f"{row[1] if e == 'K' else due}:{'' if e == 'I' else row[2]}")
        turns = [t for t, *_ in found if t is not None]
        initials = [r[1][:1] for r in found]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((c, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest("\n".join(lines))))
    return Counter(out)


def made_turns(seed):
    rng = random.Random(seed)
    rows = []
    for c in [None, *range(60)]:
        for t in range(rng.choice([1, 2, 3, 5, 9])):
            turn = rng.choice([None, t, t, t, t + 3])
            rows.append((c, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "unknown"]), rng.choice(["Words.", "More words!", "cut off", "", "  ", None, "Is it?", "odd end. ", "end. \n", f"own {c} {t}."])))
    rows += [(500, t, ["user", "assistant"][t % 2], f"Turn {t % 50}." if t % 7 else "cut") for t in range(1500)]
    return rows + rows[:3]


@pytest.mark.parametrize(("block", "fan"), [(512, 64), (7, 2), (1, 3)])
def test_repairs_equal_the_plain_rule(spark, block, fan):
    rows = made_turns(5)
    got = conversations.repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", *CLASH), block, fan)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == plain_repairs(rows)


def test_given_conversations_and_empty_tables(spark, sf_dir):
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert Counter(tuple(r) for r in conversations.repaired(given).collect()) == plain_repairs([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in given.collect()])
    assert conversations.repaired(given.limit(0)).count() == 0
    gone = next(c for c in range(1000) if crc32(f"{c}:0".encode()) % 20 == 0)
    row = conversations.repaired(spark.createDataFrame([(gone, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")).collect()
    assert [tuple(r) for r in row] == [(gone, 0, 0, 0, 0, 0, 0, "", digest(""))]
