"""Each operator against a plain version on small tables, and its odd cases."""

import random
import re
from collections import Counter, defaultdict
from hashlib import sha256
from zlib import crc32

import duckdb
import numpy as np
import pytest

from querywell.llm import decontaminate, html_extract, language_id, licenses, mixing, pii, quality, simhash, token_counts, vector_dedup
from querywell.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "  \n\t ", "en", "a", 4), (4, "!!! ??? ---", "en", "a", 11), (None, "words without an id", "en", "b", 19), (5, "the same text twice", "en", "a", 19), (5, "the same text twice", "en", "a", 19), (6, "the same text twice", "fr", None, 19), (7, "word " * 30_000, "en", "a", 150_000)]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with extra columns named like those the operators make."""
    clash = ", ".join(f"'x' {c}" for c in "size n_tokens fp bucket component_id spans __cands taken part key site score keep".split())
    return spark.createDataFrame(ODD, DOCS).selectExpr("*", *clash.split(", "))


def empty(df):
    return df.limit(0)


def test_token_counts_equal_the_encoder(spark, docs, odd):
    counter = token_counts.PieceCounter(token_counts.MODEL)
    whole = lambda t: len(counter.encoder.encode(t or ""))
    rows = token_counts.token_counts(docs).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"]: (r["n_tokens"], r["n_bytes"]) for r in rows} == {d: (whole(t), len((t or "").encode())) for d, t in texts.items()}
    got = Counter(tuple(r) for r in token_counts.token_counts(odd).collect())
    assert got == Counter((d, len((t or "").encode()), whole(t), whole(t) > 4096) for d, t, *_ in ODD)
    assert token_counts.token_counts(empty(odd)).count() == 0


def test_spliced_chunks_equal_whole_encoding(docs):
    rng = random.Random(5)
    small = token_counts.PieceCounter(token_counts.MODEL, huge=0, chunk=200, overlap=4)
    texts = [r["text"] for r in docs.limit(40).collect()]
    texts += ["".join(rng.choice("ab \n日本é.𝒳0") for _ in range(3000)), "a" * 5000, "日本" * 1500, " " * 3000, "ab" * 1000 + " c", "x\ny" * 900, "👍🏽é" * 500]
    for t in texts:
        assert small.count_huge(t) == len(small.encoder.encode(t)), t[:40]


def test_decontamination_recall_and_precision(spark, docs, odd, sf_dir):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = decontaminate.Items([(r["item_id"], r["text"]) for r in benchmark.collect()], 0.8, 5, 3, 16, 3)
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, benchmark).collect()}
    rng, planted = random.Random(1), []
    texts = {r["item_id"]: decontaminate.words_of(r["text"]) for r in benchmark.collect()}
    for n in range(200):  # passages with a seventh of the words changed
        item = rng.choice(items.ids)
        words = list(texts[item])
        for at in rng.sample(range(len(words)), int(0.15 * len(words))):
            words[at] = b"zzz%d" % n
        planted.append((n, item, "front matter of a text " + b" ".join(words).decode() + " and what follows it here"))
    rows = [(n, text, None, None, None) for n, _, text in planted]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(spark.createDataFrame(rows, DOCS), benchmark).collect()}
    assert len(got & {(n, i) for n, i, _ in planted}) >= 0.95 * len(planted)

    brute = set()
    for r in docs.collect():
        ids = np.array([items.vocabulary.get(w, 0) for w in decontaminate.words_of(r["text"])], dtype=int)
        for k, w in enumerate(items.words):
            inside = np.r_[0, np.cumsum(np.isin(ids, w))]
            starts = np.flatnonzero(inside[len(w) :] - inside[: -len(w)] >= len(w) - items.most[k]) if len(ids) >= len(w) else []
            if any(decontaminate.edit_distance(w, ids[s : s + len(w)], items.most[k]) <= items.most[k] for s in starts):
                brute.add((r["doc_id"], items.ids[k]))
    assert found <= brute and len(found) >= 0.95 * len(brute) and found
    kept = {r["doc_id"] for r in decontaminate.drop_contaminated(docs, benchmark).collect()}
    assert kept == {r["doc_id"] for r in docs.collect()} - {d for d, _ in found}
    assert decontaminate.contaminated(odd, benchmark).count() == 0 and decontaminate.contaminated(empty(odd), benchmark).count() == 0
    assert decontaminate.contaminated(docs, empty(benchmark)).count() == 0 and decontaminate.drop_contaminated(odd, empty(benchmark)).count() == len(ODD)
    same = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, benchmark, block_chars=1500).collect()}
    assert same == found  # in several blocks


def test_edit_distance():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 12))] for _ in range(2))
        d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        assert decontaminate.edit_distance(np.array(a), np.array(b), 5) == min(6, d[-1][-1])


def test_language_of_held_out_documents(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = language_id.language_id(docs).collect()
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {d for d in truth if crc32(str(d).encode()) % 5 == 0}
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.language_id(odd).collect()}
    assert [got[d] for d in (1, 2, 3, 4)] == ["und"] * 4 and got[7] in ("en", "fr")
    assert language_id.language_id(empty(odd)).count() == 0
    assert Counter(r["doc_id"] for r in language_id.drop_unidentified(odd).collect()) == Counter([None, 5, 5, 6, 7])


def test_grams_and_pieces():
    text = "Hello, Wörld 12 hello"
    words = re.findall(r"[^\W\d_]+", text.lower())
    plain = Counter(g for w in words for n in (1, 2, 3) for p in [f" {w} "] for g in [p[k : k + n] for k in range(len(p) - n + 1)] if g != " ")
    pack = lambda g: sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
    keys, counts = language_id.grams(text)
    assert dict(zip(keys.tolist(), counts.tolist())) == {pack(g): n for g, n in plain.items() if len(g) < 3 or g[1] != " "}


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def _brute_vectors(rows, cosine):
    ok = {}
    for v, e, lab in rows:
        if v is not None and lab is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e):
            x = np.array(e, dtype=np.float32).astype(float)
            ok[v] = lab, x / np.sqrt(x @ x)
    links = defaultdict(set)
    for a, (la, x) in ok.items():
        for b, (lb, y) in ok.items():
            if a != b and la == lb and len(x) == len(y) and x @ y >= cosine:
                links[a].add(b)
    component = {}
    for v in sorted(ok):
        if v not in component:
            wave = [v]
            while wave:
                u = wave.pop()
                if component.setdefault(u, v) == v:
                    wave += [w for w in links[u] if w not in component]
    return {v: (len(links[v]), component.get(v, v), component.get(v, v) == v) for v, *_ in rows}


@pytest.mark.parametrize("interval", [4096, 50])
def test_vector_groups_equal_brute_force(spark, sf_dir, interval):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in table.collect()]
    rng = np.random.default_rng(3)
    base = rng.normal(size=64)
    rows += [(10_000 + k, (base + rng.normal(size=64) * 0.25).tolist(), 1) for k in range(120)]
    rows += [(20_000 + k, base.tolist(), k % 2) for k in range(60)]
    rows += [(30_000, None, 1), (30_001, [0.0] * 64, 1), (30_002, [float("nan")] * 64, 1), (30_003, [1.0, None], 1), (30_004, base.tolist(), None), (30_005, [], 1), (30_006, [1.0, 2.0], 1), (30_007, [2.0, 4.0], 1)]
    got = vector_dedup.vector_groups(_vectors(spark, rows).selectExpr("*", "1 n", "2 rep", "3 links"), interval_rows=interval)
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got.collect()} == _brute_vectors(rows, 0.93)


def test_vector_groups_of_nothing(spark):
    assert vector_dedup.vector_groups(_vectors(spark, [(1, [1.0], 1)]).limit(0)).count() == 0
    one = vector_dedup.vector_groups(_vectors(spark, [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1)])).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0) for r in one) == [(0, 0, 0), (1, 1, 1), (1, 1, 1)]


def _plain_pii(text):
    def luhn(d):
        return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0

    rules = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    ]
    found = sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(rules) for m in re.finditer(p, text or "") if ok(m[0]))
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in found)


TRICKY = ["a@b.com@c.d e@f", "a@b.c_d@e.f x..y@-.-", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.4 1.2.3", "4111 1111 1111 1111, 4111-1111-1111-1111 4111  1111 1111 1111", "12 3456789012345 67", "+1 (988) 555-2485 +1 2 +49 30 1234567.", "é𝒳 +1 415 555 2671 ü a@b.io", "9" * 3000, "1 " * 3000, "a" * 20000 + "@x", "++1 988 555 2485 +4111111111111111", "10.0.0.1 4111111111111111 z@z.zz", "call me at (415) 555-2671 or 415-555-2671 today", "john at example dot com", "x" * 100 + "1.1.1.1 " * 900]


def test_pii_base_equals_plain_rules(spark, odd):
    rows = [(k, t, None, None, None) for k, t in enumerate(TRICKY)] + [(100 + r["doc_id"], r["text"], None, None, None) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = pii.pii_spans(spark.createDataFrame(rows, DOCS)).collect()
    texts = {d: t for d, t, *_ in rows}
    assert len(got) == len(rows)
    for r in got:
        plain = _plain_pii(texts[r["doc_id"]])
        assert r["base_sha256"] == sha256(plain.encode()).hexdigest(), (texts[r["doc_id"]][:80], r["spans"], plain)
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [len(re.findall(k + ":", plain)) for k in pii.KINDS]
        assert set(filter(None, plain.split(","))) <= set(r["spans"].split(","))
    assert pii.pii_spans(odd).count() == len(ODD) and pii.pii_spans(empty(odd)).count() == 0


def test_redaction(spark, odd):
    rows = [(1, "é mail a@b.com, 10.0.0.1 and 4111111111111111.", "en", "s", 9), (2, None, "en", "s", 0), (3, "clean", "en", "s", 5)]
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pii.redacted(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[1][0] == "é mail [EMAIL], [IP] and [CARD]." and got[1][1] == len(got[1][0])
    assert got[2][0] is None and got[3] == ("clean", 5)
    clashing = odd.selectExpr("*", *(f"'y' {c}" for c in "row base loose tried parts wide masked clean spans2 m0 g0 p0 free extra".split()))
    out = pii.redacted(clashing)
    assert out.columns == clashing.columns and out.count() == len(ODD) and {r["base"] for r in out.collect()} == {"y"}


def _plain_fingerprint(text):
    from xxhash import xxh64_intdigest

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    shingles = [words[k : k + 3] for k in range(len(words) - 2)] or ([words] if words else [])
    hashes = [xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


@pytest.mark.parametrize("bucket_rows", [4096, 3])
def test_simhash_groups_equal_brute_force(spark, docs, odd, bucket_rows):
    rows = [(r["doc_id"], r["text"], None, None, None) for r in docs.collect()]
    rng = random.Random(4)
    for k in range(60):  # near copies
        words = rows[7][1].split(" ")
        words[rng.randrange(len(words))] = "changed"
        rows.append((50_000 + k, " ".join(words), None, None, None))
    rows += [(60_000, None, None, None, None), (60_001, "", None, None, None), (60_002, "É a", None, None, None)]
    prints = {d: _plain_fingerprint(t) for d, t, *_ in rows}
    component: dict = {}
    for d in sorted(prints):
        if d not in component:
            wave = [d]
            while wave:
                u = wave.pop()
                if component.setdefault(u, d) == d:
                    wave += [w for w in prints if w not in component and (prints[u] ^ prints[w]).bit_count() <= 3]
    got = simhash.simhash_groups(spark.createDataFrame(rows, DOCS), bucket_rows=bucket_rows).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {d: (f"{prints[d]:016x}", component[d]) for d in prints}


def test_simhash_odd_rows(spark, odd):
    got = Counter((r["doc_id"], r["component_id"]) for r in simhash.simhash_groups(odd).collect())
    assert got[(5, 5)] == 2 and got[(6, 5)] == 1 and got[(3, 1)] == 1 and got[(2, 1)] == 1 and sum(got.values()) == len(ODD)
    kept = Counter(r["doc_id"] for r in simhash.drop_near_copies(odd).collect())
    assert kept[5] == 1 and kept[6] == 0 and kept[1] == 1 and kept[2] == 0 and kept[7] == 1 and kept[None] == 1
    assert simhash.simhash_groups(empty(odd)).count() == 0


def test_masks_cover_every_pair_within_the_radius():
    rng = random.Random(9)
    for level in range(4):
        found = [m & ((1 << 64) - 1) for m in simhash.masks(level)]
        assert len(found) == 15
        for _ in range(3000):
            difference = sum(1 << b for b in rng.sample(range(64), 3))
            assert any(m & difference == 0 for m in found)


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (102, 101), (7, 7)] + [(500, n) for n in range(501, 600)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {n: 0 for n in range(1, 41)} | {101: 100, 102: 100} | {n: 500 for n in range(501, 600)}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_quality_ranks_labelled_documents(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    train, test = labels.where("crc32(cast(doc_id as string)) % 2 = 0"), {d: q for d, q in truth.items() if crc32(str(d).encode()) % 2}
    rows = {r["doc_id"]: r for r in quality.quality(docs, train).collect()}
    assert len(rows) == docs.count()
    assert sum(rows[d]["keep"] == bool(q) for d, q in test.items()) >= 0.95 * len(test)
    assert quality.quality(odd, labels).count() == len(ODD) and quality.quality(empty(odd), labels).count() == 0
    assert {r["score"] for r in quality.quality(odd, empty(labels)).collect()} == {0.5}


def test_sparse_sites_shrink(spark):
    good = [(k, "calm prose of plain words here", "en", "big", 0) for k in range(200)]
    bad = [(1000 + k, "calm prose of plain words here", "en", "poor", 0) for k in range(200)]
    few = [(2000, "calm prose of plain words here", "en", "few", 0), (2001, "calm prose of plain words here", "en", "few", 0)]
    labels = spark.createDataFrame([(d, 1 if k % 10 else 0, 0) for k, (d, *_) in enumerate(good)] + [(d, 0 if k % 10 else 1, 0) for k, (d, *_) in enumerate(bad)] + [(2000, 0, 0)], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in quality.quality(spark.createDataFrame(good + bad + few, DOCS), labels).collect()}
    assert rows[1]["p_site"] > 0.85 and rows[1000]["p_site"] < 0.15 and 0.15 < rows[2001]["p_site"] < 0.5 and rows[2000]["p_site"] > rows[2001]["p_site"]


def test_mixing_equals_sql(spark, docs, odd):
    for table, rows_each in ((docs, 8192), (docs, 5), (odd, 2), (empty(odd), 8192)):
        got = sorted((tuple(r) for r in mixing.mixed(table, range_rows=rows_each).collect()), key=str)
        con = duckdb.connect()
        import pyarrow as pa

        rows = table.select("doc_id", "text", "source").collect()
        con.register("docs", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "source": pa.array([r[2] for r in rows], pa.string())}))
        want = sorted(map(tuple, con.execute(mixing.MIX_SQL.format(docs="docs")).fetchall()), key=str)
        assert got == want
        taken, targets = Counter(), {}
        for _, source, size, total, target, t in got:
            assert 0 <= t <= 3 * size
            taken[source] += t
            targets[source] = target
        assert all(abs(taken[s] - targets[s]) <= 0.5 for s in targets)


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href=/a>Menu item</a></ul></nav><div class="cookie-notice">We use cookies on this site a lot</div>
{open}<h1>A headline &amp; more</h1><p>First   paragraph with <b>bold</b> words,<br>broken &#233; line.<p>Second paragraph that goes on for a while &lt;ok&gt;.
<div class="ad"><p>Buy this now, it is very good and cheap</p></div><aside>Related things to read</aside><ul><li>One item<li>Two items</ul><form><label>Mail</label><input></form>
<p>Last words of the article.</p>{close}<section id="comments"><p>A reader says something quite long about it all here</p></section><footer>Copyright &copy; all</footer></body></html>"""
BODY = "A headline & more\nFirst paragraph with bold words, broken é line.\nSecond paragraph that goes on for a while <ok>.\nOne item\nTwo items\nLast words of the article."


def test_html_main_text(spark):
    weights = html_extract.learned_weights(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    for edges in (("<article>", "</article>"), ("<main>", "</main>"), ('<div class="post-body">', "</div>")):
        assert html_extract.main_text(PAGE.format(open=edges[0], close=edges[1]), weights) == BODY
    assert html_extract.main_text(PAGE.format(open="<article>", close="</article>").split("Last words")[0] + "<p>Cut &am", weights).startswith(BODY[:100])
    for h in (None, "", "<<<>>>", "<p", "plain", "<script>x", "</p></div>", "<!-- open"):
        assert html_extract.main_text(h, weights) == ("plain" if h == "plain" else html_extract.main_text(h, weights))


def test_html_pages_equal_their_template(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    from html import unescape

    rows = {r["page_id"]: r for r in html_extract.extracted(pages).collect()}
    assert len(rows) == pages.count()
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", r["html"], re.S)
        if article and "</article>" in r["html"]:
            blocks = [" ".join(unescape(re.sub(r"<[^>]+>", "", re.sub(r"<br>", " ", b))).split()) for b in re.split(r"</?(?:p|h1|h2|li|ul|ol|blockquote|table|tr|td|div)\b[^>]*>", article[1])]
            assert rows[r["page_id"]]["text"] == "\n".join(b for b in blocks if b), r["page_id"]
        assert rows[r["page_id"]]["n_chars"] == len(rows[r["page_id"]]["text"])
    odd = spark.createDataFrame([(1, None, None), (None, "u", ""), (2, "u", "<p>x y</p>"), (2, "u", "<p>x y</p>")], "page_id long, url string, html string").selectExpr("*", "'c' text", "1 n_chars")
    assert Counter(r["text"] for r in html_extract.extracted(odd).collect()) == Counter({"": 2, "x y": 2})
    assert html_extract.extracted(odd.limit(0)).count() == 0


def test_licenses_of_planted_paragraphs(spark, odd):
    lines = {
        1: ("Licensed under the Apache License, Version 2.0.", "Apache"), 2: ("Released under the MIT License.", "MIT"), 3: ("This work is licensed under the GNU General Public License, version 3.", "GPL"),
        4: ("Licensed under CC BY-NC 4.0.", "CC-BY-NC"), 5: ("This file is licensed under the Mozilla Public License 2.0 as stated below.", "MPL"), 6: ("SPDX-License-Identifier: BSD-3-Clause", "BSD"),
        7: ("He lost his driver licence and the license plate of the car.", None), 8: ("The gnu and the apache met in the public park.", None), 9: ("All of this is mit and under the of and", None), 10: ("Her poetic license was version two of a creative common work.", None),
    }
    rows = [(d, f"Some words first.\n{t}\nSome words after.", "en", "s", 0) for d, (t, _) in lines.items()]
    got = {(r["doc_id"], r["paragraph"]): r["family"] for r in licenses.license_scan(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {(d, 1): f for d, (_, f) in lines.items() if f}
    assert licenses.license_scan(odd).count() == 0 and licenses.license_scan(empty(odd)).count() == 0


def test_license_lines_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    plain = {r["doc_id"] for r in docs.collect() if re.search(r"(?i)licensed under|released under the|all rights reserved", r["text"])}
    assert {r["doc_id"] for r in licenses.license_scan(docs).collect()} == plain
