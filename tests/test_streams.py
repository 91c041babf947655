"""Streams with state: each against its batch twin or a plain version; replays, late pieces, expiry, restarts."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from querywell.streaming import replies, sessions
from querywell.streaming.ingestion import Ingestion, incoming
from querywell.streaming.lexical_index import LexicalIndex
from querywell.streaming.versions import Batches


T = 1_700_000_000


def run(stream, name, folder, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def files_of(rows, folder, parts):
    """The rows in so many files, in order."""
    for k, part in enumerate(parts):
        rows.where(part).coalesce(1).write.mode("append").json(str(folder / f"n={k}"))


# Replies -------------------------------------------------------------------------------------------------------------


def reply(paragraphs, conditions=(), tail="}", spaces=""):
    one = lambda x: json.dumps({"text": x, "source_ids": [1, 2]}, ensure_ascii=False)
    return f'{spaces}{{{spaces}"conditions"{spaces}:{spaces}[{",".join(map(one, conditions))}]{spaces},{spaces}"answer"{spaces}:{spaces}[{(spaces + "," + spaces).join(map(one, paragraphs))}{spaces}]{spaces}{tail}'


def read(text, cuts, finish="stop"):
    r, out = replies.Reply(), []
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(text)])):
        out += replies.Reply.arrived(r, k, text[a:b], finish if b == len(text) else None)
        r = replies.Reply(r.saved())
    return [x["paragraph"]["text"] for x in out if x["paragraph"]], [x["status"] for x in out if "status" in x]


@pytest.mark.parametrize("spaces", ["", " ", "\n  "])
def test_replies_do_not_depend_on_the_pieces(spaces):
    rng = random.Random(1)
    texts = ['plain', 'with "quotes" and \\ back', "brackets ]}[{ , inside", "日本 é 𝒳", "", "line\nbreak"]
    whole = reply(texts, ["if so", "a ] b"], spaces=spaces)
    for _ in range(60):
        cuts = sorted(rng.sample(range(1, len(whole)), rng.randrange(0, 25)))
        assert read(whole, cuts) == (texts, ["complete"])
    assert read(whole, range(1, len(whole))) == (texts, ["complete"])


def test_replies_that_go_wrong():
    good = reply(["a", "b"])
    assert read(good, [], "length") == (["a", "b"], ["incomplete_generation"])
    assert read(good[:-4], []) == (["a"], ["incomplete_answer"])
    assert read(good + " x", []) == (["a", "b"], ["incomplete_answer"])
    assert read(good.replace("},{", "};{"), [40]) == ([], ["invalid_paragraph_delimiter"])
    assert read('{"conditions":[],"answer":[]}', []) == ([], ["incomplete_answer"])
    assert read('{"conditions":[],"answer":["a"]}', []) == ([], ["invalid_paragraph"])
    assert read('{"conditions":[],"answer":[{"text":"a","source_ids":[true]},{}]}', []) == ([], ["invalid_paragraph"])
    assert read('{"conditions":{},"answer":[{}]}', []) == ([], ["invalid_conditions"])
    assert read('{"answer":[]}', []) == ([], ["incomplete_answer"])
    long = reply(["x" * 20_000, "y" * 20_000])
    assert read(long, range(1000, len(long), 1000)) == (["x" * 20_000], ["generation_buffer_limit"])


def test_streamed_replies_equal_whole_ones_whatever_the_order(spark, tmp_path):
    rng = random.Random(2)
    rows = []
    for k in range(25):
        text = reply([f"paragraph {j} of {k}" for j in range(rng.randrange(1, 6))], ["given that"] * (k % 2), tail="}" if k % 5 else "")
        cuts = [0, *sorted(rng.sample(range(1, len(text)), 6)), len(text)]
        rows += [(f"s{k}", j, text[a:b], "stop" if b == len(text) else None) for j, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    doubled = rows + rng.sample(rows, 40)
    rng.shuffle(doubled)
    schema = "stream_id string, seq long, piece string, finish string"
    table = spark.createDataFrame(doubled, schema).withColumn("file", F.monotonically_increasing_id() % 4).withColumn("at", F.lit(1_700_000_000))
    table.repartition(4, "file").drop("file").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema + ", at long").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")).withColumn("at", F.timestamp_seconds("at"))
    run(replies.released_paragraphs(stream), "released", tmp_path / "c")
    plain = lambda df: Counter((r["stream_id"], r["number"], json.dumps(r["paragraph"]), len(r["conditions"]), r["status"]) for r in df.collect())
    got = plain(spark.table("released"))
    assert got == plain(replies.paragraphs(spark.createDataFrame(rows, schema))) and sum(got.values()) > 50


def test_idle_replies_end(spark, tmp_path):
    schema = "stream_id string, seq long, piece string, finish string, at long"
    whole = reply(["a", "b"])
    for k, part in enumerate([[("s", 0, whole[:-3], None, T), ("t", 0, whole, "stop", T)], [("u", 0, whole, "stop", T + 5000)], [("v", 0, whole, "stop", T + 9000)]]):
        spark.createDataFrame(part, schema).coalesce(1).write.json(str(tmp_path / f"in/n={k}"))
    stream = spark.readStream.schema(schema + ", n int").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")).withColumn("at", F.timestamp_seconds("at"))
    run(replies.released_paragraphs(stream), "idle", tmp_path / "c")
    ends = Counter((r["stream_id"], r["status"]) for r in spark.table("idle").where("status is not null").collect())
    assert ends == Counter({("s", "incomplete_generation"): 1, **{(x, "complete"): 1 for x in "tuv"}})


# Sessions ------------------------------------------------------------------------------------------------------------


def plain_state(messages):
    line = lambda r, t: f"{ {'user': '用户', 'assistant': '助手'}.get(r, r) }: {t[:200]}"
    n = len(messages)
    old, recent = (messages[:-6], messages[-6:]) if n > 10 else ([], messages)
    title = next((t.replace("\n", " ")[:50] for _, r, t in messages if r == "user" and t), "")
    return messages[0][0], messages[-1][0], title, n, "\n".join(line(r, t) for _, r, t in old)[:3000], [t for _, _, t in recent]


def made_sessions(seed):
    rng = random.Random(seed)
    out = {}
    for k in range(12):
        n = rng.choice([1, 9, 10, 11, 16, 60])
        out[f"s{k}"] = [(1_700_000_000.0 + 10 * j, rng.choice(["user", "assistant", "system"]), " ".join(["word"] * rng.randrange(0, 90)) + str(j)) for j in range(n)]
    return out


def test_session_states_equal_the_plain_rule(spark):
    made = made_sessions(1)
    rows = [(s, *m) for s, ms in made.items() for m in ms]
    random.Random(3).shuffle(rows)
    got = sessions.session_states(spark.createDataFrame([*rows, (None, 1.0, "user", "x")], "session_id string, at double, role string, text string")).collect()
    assert {r["session_id"]: tuple(r)[1:7] for r in got} == {s: plain_state(ms) for s, ms in made.items()}


def test_live_sessions_end_like_the_batch_and_expire(spark, tmp_path):
    made = made_sessions(2)
    rows = sorted((m[0], s, m[1], m[2]) for s, ms in made.items() for m in ms)
    schema = "at double, session_id string, role string, text string"
    late = [(1_700_100_000.0, "later", "user", "hello"), (1_700_200_000.0, "last", "user", "hello")]
    for k, part in enumerate([rows[:80], rows[80:], late[:1], late[1:]]):
        spark.createDataFrame(part, schema).coalesce(1).write.json(str(tmp_path / f"in/n={k}"))
    stream = spark.readStream.schema(schema + ", n int").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")).withColumn("at", F.timestamp_seconds("at"))
    run(sessions.live_sessions(stream), "live", tmp_path / "c", "update")
    got = spark.table("live").collect()
    last = {}
    for r in got:
        if not r["expired"]:
            last[r["session_id"]] = max(last.get(r["session_id"], r), r, key=lambda x: x["messages"])
    assert {s: tuple(last[s])[1:7] for s in made} == {s: plain_state(ms) for s, ms in made.items()}
    gone = {r["session_id"] for r in got if r["expired"]}
    assert set(made) <= gone and "last" not in gone


# Tables that grow by batches -----------------------------------------------------------------------------------------


def test_batches_are_seen_once_and_whole(spark, tmp_path):
    store = Batches(spark, str(tmp_path / "t"))
    one = lambda k: spark.createDataFrame([(k,)], "x int")
    assert store.read("a", "x int").count() == 0 and not store.done(0)
    store.commit(0, {"a": one(1)})
    store.commit(0, {"a": one(9)})  # a replay
    one(5).write.parquet(str(tmp_path / "t/a/batch=1-cut-off"))  # an attempt that failed before its line
    store.commit(1, {"a": one(2), "b": one(3)})
    assert sorted(r["x"] for r in store.read("a", "x int").collect()) == [1, 2]
    store.commit(2, {"a": one(7)}, replaces=True)
    assert [r["x"] for r in store.read("a", "x int").collect()] == [7] and [r["x"] for r in store.read("b", "x int").collect()] == [3]


CHANGES = "doc_id string, source string, text string, removed boolean"


def test_the_index_follows_its_changes(spark, tmp_path):
    rng = random.Random(4)
    words = [f"word{k}" for k in range(30)]
    index, live = LexicalIndex(spark, str(tmp_path / "i")), {}
    for batch in range(4):
        changes = [(f"d{rng.randrange(20)}", f"s{rng.randrange(3)}", " ".join(rng.choices(words, k=rng.randrange(0, 9))), False) for _ in range(8)]
        changes += [(f"d{rng.randrange(20)}", None, None, True)] + ([(None, f"s{batch % 3}", None, True)] if batch else [])
        table = spark.createDataFrame(changes, CHANGES)
        added = {}
        for d, s, t, removed in changes:
            if not removed:
                added[d] = max(added.get(d, (t, s)), (t, s))
        sources = {s for d, s, _, removed in changes if removed and d is None}
        named = {d for d, *_ in changes if d}
        live = {d: x for d, x in live.items() if d not in named and x[1] not in sources} | added
        index.apply(table, batch)
        index.apply(table, batch)  # a replay
        want = Counter(w for t, _ in live.values() for w in set(t.split()))
        assert {r["term"]: r["df"] for r in index.term_stats().collect()} == dict(want)
        total = index.totals().first()
        assert total["n"] == len(live) and total["mean_length"] == pytest.approx(sum(len(t.split()) for t, _ in live.values()) / max(1, len(live)))
    index.compact(4)
    assert {r["term"]: r["df"] for r in index.term_stats().collect()} == dict(want) and len(index.store.folders("terms")) == 1
    index.apply(spark.createDataFrame([(None, s, None, True) for s in ("s0", "s1", "s2")], CHANGES), 5)
    assert index.term_stats().count() == 0 and index.totals().first()["n"] == 0


def test_an_index_that_follows_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(f"d{k}", "s", f"word{k % 5} common", False) for k in range(20)], CHANGES)
    rows.repartition(4).write.json(str(tmp_path / "in"))
    index = LexicalIndex(spark, str(tmp_path / "i"))
    stream = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    for checkpoint in ("c1", "c2"):  # the second run reads all again under batch numbers that are done
        index.follow(stream).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start().awaitTermination()
    assert {r["term"]: r["df"] for r in index.term_stats().collect()} == {"common": 20, **{f"word{k}": 4 for k in range(5)}}


def test_files_are_taken_in_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    put = lambda name, text: (folder / name).write_bytes(text if isinstance(text, bytes) else text.encode())
    put("a.md", "# Title\n\nSome text.")
    put("b.txt", "Some other text.")
    put("c.txt", "Some other text.")  # the content of b
    put("d.exe", "no")
    put("e.html", "<html><script>no()</script><p>Words &amp; more</p></html>")
    put("f.txt", "  \n ")
    put("g.txt", b"broken \xff bytes")
    put("h.txt", "Sentence that is long enough to count. " * 200)
    store = Ingestion(spark, str(tmp_path / "store"))
    for _ in range(2):  # the second run finds nothing new
        store.follow(incoming(spark, str(folder))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    status = {r["filename"]: (r["status"], r["chunks"]) for r in store.registry().collect()}
    assert status == {"a.md": ("indexed", 1), "b.txt": ("indexed", 1), "c.txt": ("duplicate", 0), "d.exe": ("rejected", 0), "e.html": ("indexed", 1), "f.txt": ("failed", 0), "g.txt": ("indexed", 1), "h.txt": status["h.txt"]} and status["h.txt"][0] == "indexed"
    put("f.txt", "now it has text")
    put("z.md", "# Title\n\nSome text.")  # the content of a
    (folder / "new").mkdir()
    store.follow(incoming(spark, str(folder))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    later = {(r["filename"], r["status"]) for r in store.registry().where("batch > 0").collect()}
    assert ("z.md", "duplicate") in later
    assert "no()" not in " ".join(r["chunk"] for r in store.chunks().collect())
    before = store.chunks().select("source", "chunk").collect()
    store.reindex(incoming(spark, str(folder), stream=False), 9)
    again = {r["filename"]: r["status"] for r in store.registry().collect()}
    assert again["f.txt"] == "indexed" and again["z.md"] == "duplicate" and {tuple(r) for r in before} <= {tuple(r) for r in store.chunks().select("source", "chunk").collect()}
