"""Each operator against a brute-force version, and its defined cases."""

import hashlib
import html
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from treeframe.llm import chat, common, extraction, licenses, mixing, neighbours, packing, quality, repeats, simhash, warc
from treeframe.llm.components import components

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, texts, **other):
    rows = [(i, t, other.get("lang", "en"), other.get("source", f"src{i % 3}"), len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def prose(rnd, n, size=400):
    return " ".join(f"w{rnd.randrange(size)}" for _ in range(n))


ODD = [None, "", " \n\t ", "\x0b", "word", "Ünï cödé 語 words", "a\n\na\na \n b", "x " * 5000, "MIT License", "q" * 3000]


# licenses


def brute_places(text, phrases):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    found = [(i, label) for p, label in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found}))


def test_licenses_against_brute_force(spark):
    rnd = random.Random(1)
    pool = ["MIT", "license", "apache", "General", "public", "GNU", "the", "x", "License,", "mit.license", "é"]
    texts = ODD + [" ".join(rnd.choice(pool) for _ in range(rnd.randrange(60))) for _ in range(300)] + list(licenses.TEMPLATES.values())
    rows = licenses.license_scan(docs(spark, texts)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_places(texts[r.doc_id], licenses.PHRASES)
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_license_templates_are_found_within_other_text(spark):
    rnd = random.Random(2)
    names = list(licenses.TEMPLATES)
    rows = licenses.license_scan(docs(spark, [prose(rnd, 50) + " " + licenses.TEMPLATES[k] + " " + prose(rnd, 50) for k in names])).collect()
    for r in rows:
        assert names[r.doc_id].removesuffix("-short") in r.labels.split(",")
        assert r.spans[0].first_word >= 50


def test_automaton_matching_statistics():
    rnd = random.Random(3)
    strings = [[rnd.randrange(3) for _ in range(rnd.randrange(1, 12))] for _ in range(6)]
    sam = licenses.Automaton(strings)
    for k, s in enumerate(strings):
        for a in range(len(s)):
            state = 0
            for b in range(a, len(s)):
                state = sam.next[state][s[b]]
                part = s[a : b + 1]
                want = {(j, e) for j, t in enumerate(strings) for e in range(len(part) - 1, len(t)) if t[e - len(part) + 1 : e + 1] == part}
                assert sam.ends[state] == want, (k, a, b)


# near-duplicates


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, most):
    at = {i: i for i in fps}

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i, a in fps.items():
        for j, b in fps.items():
            if j < i and (a ^ b).bit_count() <= most:
                p, q = root(i), root(j)
                at[max(p, q)] = min(p, q)
    return {i: root(i) for i in fps}


def test_simhash_against_brute_force(spark):
    rnd = random.Random(4)
    texts = ODD + [prose(rnd, rnd.randrange(1, 80)) for _ in range(60)]
    for t in texts[20:40]:
        w = t.split()
        w[rnd.randrange(len(w))] = "other"
        texts += [" ".join(w), t.upper()]
    fps = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    want = brute_components(fps, 4)
    rows = simhash.near_duplicates(docs(spark, texts)).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{fps[i]:016x}", want[i]) for i in fps}
    kept = simhash.keep_one(docs(spark, texts)).collect()
    assert {r.doc_id for r in kept} == set(want.values())


@pytest.mark.parametrize("m,most_rows", [(5, 50_000), (6, 50_000), (7, 50_000), (5, 40)])
def test_links_of_planted_fingerprints(spark, m, most_rows):
    rnd = random.Random(5)
    values = {rnd.getrandbits(64) for _ in range(60)}
    for v in list(values)[:40]:
        for _ in range(6):
            x = v
            for b in rnd.sample(range(64), rnd.randrange(1, 6)):
                x ^= 1 << b
            values.add(x)
    fps = dict(enumerate(sorted(values)))
    signed = [(v - (1 << 64) if v >> 63 else v, i) for i, v in fps.items()]
    edges = simhash.linked(spark.createDataFrame(signed, "_tf_fp bigint, _tf_rep bigint"), m=m, most_rows=most_rows)
    got = {r.u: r.component for r in components(edges).collect()}
    want = brute_components(fps, 4)
    assert {i: got.get(i, i) for i in fps} == want


def test_trie_walk_finds_each_component():
    rnd = np.random.default_rng(6)
    base = rnd.integers(0, 1 << 63, 20, dtype=np.uint64)
    values = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rnd.integers(0, 60, 20).astype(np.uint64)) for _ in range(30)]))
    links = simhash.trie_links(values, 0, 4, block=64)
    want = brute_components({i: int(v) for i, v in enumerate(values)}, 4)
    at = dict(enumerate(range(len(values))))
    for a, b in links:
        assert int(values[a] ^ values[b]).bit_count() <= 4
        x, y = at[a], at[b]
        at = {k: (min(x, y) if v in (x, y) else v) for k, v in at.items()}
    assert at == want


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 100)]
    got = {r.u: r.component for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {i: 100 for i in (*range(101, 140), 200)}


def test_keep_one_judges_texts_that_share_an_id_apart(spark):
    a, b = (prose(random.Random(k), 60) for k in (19, 20))
    for rows, want in (
        ([(1, a), (5, a), (5, b), (7, b), (8, b)], [(1, a), (5, b)]),
        ([(5, a), (5, b), (5, b), (5, b), (7, a), (8, b)], [(5, a), (5, b)]),
        ([(5, a), (5, a), (5, b), (5, b), (None, a)], [(None, a), (5, a), (5, b)]),
    ):
        kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
        assert sorted(map(tuple, kept), key=str) == sorted(want, key=str)


# quality


def brute_metrics(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen = {}
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality_metrics_and_verdicts(spark):
    rnd = random.Random(7)
    texts = ODD + [prose(rnd, 60) for _ in range(300)] + ["| ".join(prose(rnd, 60).split()) for _ in range(15)] + [prose(rnd, 20, 3) for _ in range(20)] + [prose(rnd, 30) + "\n" + prose(rnd, 9) + "\n" + prose(rnd, 9) for _ in range(20)]
    rows = quality.quality_rules(docs(spark, texts, source="s")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        m = brute_metrics(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == m
        assert r.base_failed == (m[0] < 10 or 100 * m[4] > 20 * m[0])
        assert not (r.base_failed and r.kept)
    kept = {r.doc_id for r in rows if r.kept}
    assert set(range(len(ODD), len(ODD) + 300)) <= kept and not kept & set(range(len(ODD) + 300, len(ODD) + 315))
    again = quality.keep_good(docs(spark, texts, source="s"))
    assert again.columns == ["doc_id", "text", "lang", "source", "n_chars"] and {r.doc_id for r in again.collect()} == kept


def test_quality_limits_of_a_junk_source_are_pulled_toward_its_language(spark):
    rnd = random.Random(8)
    clean = [(i, prose(rnd, 60), "en", f"src{i % 3}", 0) for i in range(900)]
    junk = [(1000 + i, "".join(w + ("| " if k % 10 <= i % 8 + 1 else " ") for k, w in enumerate(prose(rnd, 60).split())) if i % 5 else prose(rnd, 60), "en", "junk", 0) for i in range(300)]
    df = spark.createDataFrame(clean + junk, DOCS)
    bad = {r[0] for r in junk if "|" in r[1]}
    floors = {**quality.FLOORS, "symbols": 20}
    # alone, the source's own sketch admits what most of its documents hold
    assert bad <= {r.doc_id for r in quality.keep_good(df, floors=floors).collect()}
    kept = {r.doc_id for r in quality.keep_good(df, floors=floors, pull=1.5).collect()}
    assert kept == {r[0] for r in clean + junk} - bad


def test_quality_handles_null_groups_empty_tables_and_clashing_names(spark):
    rows = [(1, None, None, None, "x"), (None, "a b c d e f g h i j k", None, "s", "y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, kept string")
    assert quality.keep_good(df).collect() == [rows[1]]
    assert quality.quality_rules(df.limit(0)).count() == 0


# WARC


def test_warc_round_trip(spark):
    pages = [(1, "http://a/é", "<html><title>T</title><p>one &amp; two<p>three<script>x</script></html>"), (2, None, None), (3, "http://b\r\nX: y", "\r\n\r\n")]
    made = warc.responses(spark.createDataFrame(pages, "page_id bigint, url string, html string"))
    source = {r.page_id: warc.parse(bytes(r.record)) for r in made.collect()}
    rows = warc.derivatives(made, id_col="page_id").collect()
    assert sorted((r.page_id, r.record_type) for r in rows) == [(i, k) for i in (1, 2, 3) for k in ("conversion", "metadata")]
    ids = set()
    for r in rows:
        headers, block = warc.parse(bytes(r.record))
        old, message = source[r.page_id]
        assert headers["WARC-Type"] == r.record_type and int(headers["Content-Length"]) == len(block) == r.content_length
        assert headers["WARC-Block-Digest"] == warc.digest(block) == r.block_digest
        assert headers["WARC-Refers-To"] == old["WARC-Record-ID"] == r.refers_to
        assert headers["WARC-Target-URI"] == old["WARC-Target-URI"]
        assert r.source_digest == old["WARC-Payload-Digest"] == warc.digest(message.partition(b"\r\n\r\n")[2])
        if r.record_type == "metadata":
            facts = dict(x.split(": ", 1) for x in block.decode().split("\r\n") if x)
            assert facts["source-warc-record-id"] == old["WARC-Record-ID"]
        ids.add(r.record_id)
    assert len(ids) == 6
    text = next(warc.parse(bytes(r.record))[1] for r in rows if r.page_id == 1 and r.record_type == "conversion")
    assert text.decode() == "T\none & two\nthree"
    assert warc.derive(None)[0]["refers_to"] == ""


def test_warc_keeps_repeated_and_http_headers_and_the_charset():
    payload = "<p>caf\u00e9 \u20ac</p>".encode("cp1252")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1\r\nSet-Cookie: a\r\nset-cookie: b\r\n\r\n" + payload
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Concurrent-To: <x>\r\nWARC-Concurrent-To: <y>\r\nContent-Length: {len(block)}\r\n\r\n"
    meta, text = (warc.parse(r["record"])[1].decode() for r in warc.derive(head.encode() + block))
    assert text == "caf\u00e9 \u20ac"
    for line in ("source-warc-concurrent-to: <x>", "source-warc-concurrent-to: <y>", "http-header-content-type: text/html; charset=ISO-8859-1", "http-header-set-cookie: a", "http-header-set-cookie: b", "http-status: 200"):
        assert line in meta.split("\r\n")


def test_warc_of_odd_headers():
    made = [warc.derive(x) for x in (b"WARC/1.1\r\nContent-Length: x\r\n\r\nbody", b"WARC/1.1\r\ncontent-length: -3\r\nwarc-record-id: <i>\r\n\r\nbody two", b"\r\n\r\n", b"WARC/1.1", b"")]
    assert [warc.parse(r[1]["record"])[1] for r in made] == [b"body", b"body two", b"", b"", b""]
    assert [r[0]["refers_to"] for r in made] == ["", "<i>", "", "", ""]
    assert len({x["record_id"] for r in made[:4] for x in r}) == 8
    import gzip

    block = b"HTTP/1.1 200 OK\r\nCONTENT-ENCODING: gzip\r\n\r\n" + gzip.compress(b"<p>packed")
    assert warc.parse(warc.derive(b"WARC/1.1\r\n\r\n" + block)[1]["record"])[1] == b"packed"
    assert warc.parse(warc.derive(b"WARC/1.1\r\n\r\n" + block[:44])[1]["record"])[1] == b""


def independent(record):
    """Headers and block of a record, read apart from the operator's own reader."""
    import email

    at = record.index(b"\r\n\r\n")
    line, _, rest = record[:at].partition(b"\r\n")
    head = email.message_from_bytes(rest + b"\r\n\r\n")
    size = int(head["Content-Length"])
    assert line == b"WARC/1.1" and record[at + 4 + size :] == b"\r\n\r\n"
    return head, record[at + 4 : at + 4 + size]


def test_warc_records_by_an_independent_reader(spark):
    import base64
    from html.parser import HTMLParser

    class Text(HTMLParser):
        def __init__(self):
            super().__init__()
            self.lines, self.hidden = [""], 0

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("script", "style")
            self.lines[-1] += " " * (tag == "script")  # what is hidden parts words
            if tag in ("p", "div", "h1", "li"):
                self.lines.append("")

        def handle_endtag(self, tag):
            self.hidden -= tag in ("script", "style")
            if tag in ("p", "div", "h1", "li"):
                self.lines.append("")

        def handle_data(self, data):
            if not self.hidden:
                self.lines[-1] += data

    rnd = random.Random(26)
    pages = []
    for i in range(40):
        parts = [rnd.choice(["<p>{}</p>", "<div>{}</div>", "<li>{}", "<h1>{}</h1>", "<script>{}</script>", "<b>{}</b> "]).format(html.escape(prose(rnd, rnd.randrange(6)) + rnd.choice(["", " & <x> é"]))) for _ in range(rnd.randrange(12))]
        pages.append((i, f"http://h/{i}", "".join(parts)))
    made = warc.responses(spark.createDataFrame(pages, "page_id bigint, url string, html string"))
    source = {r.page_id: independent(bytes(r.record)) for r in made.collect()}
    sha = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    rows = warc.derivatives(made, id_col="page_id").collect()
    assert len(rows) == 2 * len(pages)
    for r in rows:
        head, block = independent(bytes(r.record))
        old, message = source[r.page_id]
        assert head["WARC-Refers-To"] == old["WARC-Record-ID"] and head["WARC-Block-Digest"] == sha(block)
        assert old["WARC-Payload-Digest"] == sha(message.split(b"\r\n\r\n", 1)[1]) == r.source_digest
        if r.record_type == "conversion":
            reader = Text()
            reader.feed(pages[r.page_id][2])
            assert block.decode().split("\n") == ([x for x in (" ".join(x.split()) for x in reader.lines) if x] or [""])
        else:
            assert f"source-warc-payload-digest: {old['WARC-Payload-Digest']}" in block.decode().split("\r\n")


# repeats


def brute_removals(texts):
    first = {}
    for d, t in texts:
        for i in range(len(t) - 49):
            first[t[i : i + 50]] = min(d, first.get(t[i : i + 50], d))
    out = {}
    for d, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - 49):
            if first[t[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(c for c, x in zip(t, gone, strict=True) if not x)
        out[d] = (len(t), sum(gone), sum(1 for i, x in enumerate(gone) if x and (not i or not gone[i - 1])), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("batch", [7, 10_000])
def test_repeats_against_brute_force(spark, batch):
    rnd = random.Random(8)
    base = ["".join(rnd.choice("abcdé") for _ in range(300)) for _ in range(6)]
    texts = [x or "" for x in ODD]
    for _ in range(200):
        k, x = rnd.random(), list(rnd.choice(base))
        if k < 0.15:
            x = ["ab"] * rnd.randint(0, 80)
        elif k < 0.25:
            x = ["a"] * rnd.randint(0, 200)
        else:
            for _ in range(rnd.randint(0, 5)):
                x[rnd.randrange(len(x))] = rnd.choice("abcd")
            p = rnd.randrange(200)
            x = x[p : p + rnd.randint(40, 250)] + list(rnd.choice(base)[rnd.randrange(200) :][: rnd.randint(0, 90)])
        texts.append("".join(x))
    ids = rnd.sample(range(1000), len(texts))
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id bigint, text string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        rows = repeats.removals(df).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r[0]: tuple(r[1:]) for r in rows} == brute_removals([(i, t.encode()) for i, t in zip(ids, texts, strict=True)])


def test_repeats_null_ids_repeated_rows_and_pieces(spark, monkeypatch):
    t = prose(random.Random(9), 60)
    df = spark.createDataFrame([(1, t), (1, t), (None, t), (2, "x" + t), (3, None)], "doc_id bigint, text string")
    rows = repeats.removals(df).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in rows) == [(0, 0), (1, 0), (1, 0), (2, len(t)), (3, 0)]
    assert repeats.removals(df.limit(0)).count() == 0
    monkeypatch.setattr(repeats, "_PIECE", 64)
    data = [t.encode(), b"short", t.encode()[7:]]
    got = {(int(i), int(a) + k): int(h) for own, at, n, hs in repeats.runs(data) for i, a, c, h in zip(own, at, n, hs, strict=True) for k in range(c)}
    monkeypatch.undo()
    want = {(int(i), int(a) + k): int(h) for own, at, n, hs in repeats.runs(data) for i, a, c, h in zip(own, at, n, hs, strict=True) for k in range(c)}
    assert got == want and len(got) == sum(max(0, len(x) - 49) for x in data)


def test_matching_statistics_of_the_run_index():
    rnd = random.Random(10)
    strings = [bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(50, 70))) for _ in range(30)]
    index = repeats.RunIndex(strings, np.arange(len(strings)))
    assert len(index.head) <= index.ends[-1]
    # patterns that cross no end: the strings' own parts, reversed halves swapped in by position
    end = index.ends - 1
    begin = end - np.array([len(s) for s in strings])
    for who, at, size, row in index.stream(begin, end):
        for w, p, n, r in zip(who.tolist(), at.tolist(), size.tolist(), row.tolist(), strict=True):
            assert n == end[w] - p
            if n >= 50:
                part = strings[w][p - begin[w] :][:50]
                assert index.owner_at(np.array([r]))[0] == min(i for i, s in enumerate(strings) if part in s)


@pytest.mark.parametrize("n", [1, 12, 211])
def test_keys_of_partitions(spark, n):
    keys = common.keys_of_partitions(n)
    df = spark.createDataFrame([(int(k),) for k in keys], "k int").select(F.pmod(F.hash("k"), F.lit(n)).alias("p"))
    assert sorted(r.p for r in df.collect()) == list(range(n))


def test_statistics_of_foreign_strings():
    rnd = random.Random(22)
    base = bytes(rnd.choice(b"abc") for _ in range(70))
    strings, foreign = [], []
    for to in (strings, foreign):
        for _ in range(25):
            x = bytearray(base)
            for _ in range(rnd.randrange(4)):
                x[rnd.randrange(70)] = rnd.choice(b"abcz" if to is foreign else b"abc")
            to.append(bytes(x[rnd.randrange(10) : 60 + rnd.randrange(10)]))
    index = repeats.RunIndex(strings, np.arange(len(strings)))
    size = np.array([len(x) + 1 for x in foreign])
    end = np.cumsum(size) - 1
    begin = end + 1 - size
    text = np.frombuffer(b"\0".join([*foreign, b""]), np.uint8).astype(np.int16) + np.int16(1)
    got = {(w, p - begin[w]): n for who, at, ns, _ in index.stream(begin, end, text) for w, p, n in zip(who.tolist(), at.tolist(), ns.tolist(), strict=True)}
    want = {(w, p): max(k for k in range(len(x) - p + 1) if any(x[p : p + k] in s for s in strings)) for w, x in enumerate(foreign) for p in range(len(x))}
    assert got == want
    early = {(w, p - begin[w]): n for who, at, ns, _ in index.stream(begin, end, text, 50) for w, p, n in zip(who.tolist(), at.tolist(), ns.tolist(), strict=True)}
    assert {k: n for k, n in early.items() if n >= 50} == {k: n for k, n in want.items() if n >= 50} and len(early) < len(got)


@pytest.mark.parametrize("listed", [True, False])
@pytest.mark.parametrize("size,kinds", [(26, 600), (40, 600), (49, 600), (120, 3)])
def test_repeats_of_a_crowded_anchor(spark, size, kinds, listed):
    rnd = random.Random(23)
    word = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    phrase = "a common phrase, with its own letters: " + word(120)
    around = [(word(60), word(60)) for _ in range(kinds)]
    texts = [a + phrase[:size] + b for a, b in (rnd.choice(around) for _ in range(600))]
    texts += [a[-12:] + phrase[:size] + b[:25] + word(9) for a, b in (rnd.choice(around) for _ in range(200))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 25)
    try:
        rows = repeats.removals(df, most=20, listed=listed).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r[0]: tuple(r[1:]) for r in rows} == brute_removals([(i, t.encode()) for i, t in enumerate(texts)])


def test_without_repeats_keeps_columns(spark):
    t = prose(random.Random(11), 60)
    df = docs(spark, [t, t, "new words " + t + " end of it", None, "é" * 40])
    out = {r.doc_id: r for r in repeats.without_repeats(df).collect()}
    assert sorted(out) == [0, 2, 3, 4] and out[0].text == t and out[3].text is None
    assert out[2].text == "new words  end of it" and out[2].n_chars == len(out[2].text)


def test_without_repeats_loses_only_the_characters_that_are_cut(spark):
    t = prose(random.Random(21), 60)
    # é and è share their first byte, é and ĩ their last: each span ends within a character
    df = docs(spark, [t + "é", "a\ufffdb " + t + "è c\ufffd", "ĩ" + t[:99], t[-80:] + "ê"])
    out = {r.doc_id: r for r in repeats.without_repeats(df).collect()}
    assert sorted(out) == [0, 1, 2] and out[0].text == t + "é"
    assert out[1].text == "a\ufffdb  c\ufffd" and out[1].n_chars == len(out[1].text)
    assert out[2].text == "ĩ"


# chats


def test_chats_keep_maximal_conversations(spark):
    a = [("user", "hi"), ("assistant", "yes"), ("user", "go")]
    convs = {1: a[:1], 2: a, 3: a[:2], 4: a, 5: [("user", "hi"), ("assistant", "no")], 6: [("user", None)], 7: [("user", "")], 8: [(None, "hi")]}
    rows = [(c, i, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    rows += [(9, i * 3000, "user", str(i)) for i in range(5)] + [(10, i * 3000, "user", str(i)) for i in range(4)] + rows[:3] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    out = chat.format_chats(df).collect()
    assert {r.conv_id for r in out} == {2, 5, 6, 7, 8, 9, None}
    assert "".join(r.rendered for r in sorted((r for r in out if r.conv_id == 2), key=lambda r: r.turn)) == "<|user|>\nhi<|end|>\n<|assistant|>\nyes<|end|>\n<|user|>\ngo<|end|>\n"
    assert chat.format_chats(df.limit(0)).count() == 0


# neighbours


def test_neighbours_against_brute_force(spark):
    rnd = np.random.default_rng(12)
    x = rnd.normal(size=(3000, 16)) * rnd.uniform(0.5, 2, (3000, 1))
    x[100:900] = x[100]  # many copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(3000, None), (3020, [0.0] * 16), (3040, [float("nan")] + [1.0] * 15), (3060, [None] + [1.0] * 15), (None, [1.0] * 16), (3080, [1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = neighbours.search(df, is_query=F.col("vec_id") % 20 == 0, shard_rows=1200, query_rows=64).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert sorted(by) == list(range(0, 3000, 20)) and all(len(v) == 20 for v in by.values())
    hits = 0
    for q, found in by.items():
        s = x @ x[q]
        order = [i for i in np.lexsort((np.arange(3000), -s)) if i != q][:20]
        assert all(abs(score - s[i]) < 1e-9 for i, score in found)
        assert found == sorted(found, key=lambda v: (-v[1], v[0]))
        hits += len({i for i, _ in found} & set(order))
    assert hits >= 0.9 * 20 * len(by)
    few = neighbours.search(df.limit(5), is_query=F.col("vec_id") == 0).collect()
    assert [r["rank"] for r in sorted(few, key=lambda r: r["rank"])] == [1, 2, 3, 4]
    assert neighbours.search(df.where("vec_id = 3000"), is_query=F.lit(True)).count() == 0


def test_neighbours_rerank_a_tenth(spark):
    rnd = np.random.default_rng(24)
    x = rnd.normal(size=(20_000, 64))
    seen = []

    class Counted(neighbours.Files):
        def distances(self, perm):
            out = super().distances(perm)
            seen.append(len(out))
            return out

    # the operator's own parts, on one shard: the share that is reranked holds the nearest
    most = np.sqrt((x * x).sum(axis=1)).max()
    lifted = neighbours.lifted(x, most)
    pivots = lifted[rnd.permutation(len(x))[: neighbours.PIVOTS]]
    files = Counted(neighbours.permutations(lifted, pivots, neighbours.PREFIX), len(pivots))
    hits, take = 0, int(neighbours.SHARE * len(x))
    assert 2 * take < len(x)
    for i in range(0, 20_000, 400):
        zero = np.r_[x[i] / np.linalg.norm(x[i]), 0]
        distance = files.distances(neighbours.permutations(zero[None], pivots, neighbours.PREFIX)[0])
        score = x @ x[i]
        score[i] = -np.inf
        hits += len(set(np.argsort(-score)[:20].tolist()) & set(np.argpartition(distance, take)[:take].tolist()))
    assert hits >= 0.9 * 20 * 50 and len(seen) == 50
    rows = [(i, v.tolist()) for i, v in enumerate(x[:6000])]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), is_query=F.col("vec_id") % 200 == 0, shard_rows=3000).collect()
    hits = 0
    for q in range(0, 6000, 200):
        score = x[:6000] @ x[q]
        score[q] = -np.inf
        hits += len(set(np.argsort(-score)[:20].tolist()) & {r.vec_id for r in got if r.query_id == q})
    assert hits >= 0.9 * 20 * 30


# packing


def test_ranges_spread_equal_keys_by_id():
    import pyarrow as pa

    rnd = random.Random(25)
    rows = [(rnd.choice([1, 1, 1, 5, 9]), rnd.choice([None, *range(50)]), rnd.randrange(100)) for _ in range(500)]
    sample = pa.table({"k": pa.array([r[0] for r in rows], pa.int64()), "i": pa.array([r[1] for r in rows], pa.int64()), "n": pa.array([r[2] for r in rows], pa.int64())})
    bounds = packing._bounds(sample, 8)
    got = packing._range(bounds, sample.column(0).combine_chunks(), sample.column(1).combine_chunks()).tolist()
    pairs = [(k, -(1 << 63) if i is None else i) for k, i, _ in rows]
    assert got == [sum(tuple(b) <= p for b in bounds.tolist()) for p in pairs]
    size = {}
    for (_, _, n), g in zip(rows, got, strict=True):
        size[g] = size.get(g, 0) + n
    assert len(size) == 8 and max(size.values()) < 2 * sum(size.values()) / 8
    assert len(packing._bounds(sample.slice(0, 0), 8)) == 0


def test_hilbert_order_visits_each_cell_once_and_moves_by_one():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(np.meshgrid(*[range(1 << bits)] * dims, indexing="ij")).reshape(dims, -1).T
        keys = packing.hilbert(cells, bits)
        path = cells[np.argsort(keys)]
        assert sorted(keys) == list(range(len(cells))) and (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_packing_keeps_each_token_once(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.default_tokenizer())
    plain.encode_special_tokens = True
    rnd = random.Random(13)
    texts = ODD + ["<|endoftext|> it's  two  spaces \n new", " lead", "trail ", "a\xa0b c", "1 2 33 don't"] + [prose(rnd, rnd.randrange(900)) for _ in range(40)]
    ids = [np.array([*(plain.encode(t or "", add_special_tokens=False).ids), 0], "<u4") for t in texts]
    rows = packing.pack(docs(spark, texts), tokenizer=packing.default_tokenizer(), parts=3).collect()
    by, sequences = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for i, own in enumerate(ids):
        at = 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[at : at + r.length].tobytes())
            at += r.length
        assert at == len(own)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and at & (at - 1) == 0
    assert packing.pack(docs(spark, texts).limit(0), tokenizer=packing.default_tokenizer()).count() == 0


def test_queries_pack_the_ids_of_the_tokenizer_by_default(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    default = Tokenizer.from_file(packing.default_tokenizer())
    end = "<|endoftext|>"
    texts = [f"a {end} b", end, f"{end}{end}  x", f"word{end}word, <|endoftext | {end[:-1]}", f" {end}\n\n{end} ", f"it's\u00a0{end}  two", "plain text", "", None]
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    for out in (packing.op8_packing(spark, str(tmp_path)), corpus_pipeline.packing_stage(spark, docs(spark, texts), "")):
        got = out.collect()
        for i, t in enumerate(texts):
            ids = np.array([*default.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
            own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
            assert [(r.doc_tokens, r.ids_crc32) for r in own] == [(len(ids), zlib.crc32(ids[r.start : r.start + r.length].tobytes())) for r in own]
            assert sum(r.length for r in own) == len(ids)


# extraction

PAGES = {
    "<html><body><nav><a href=x>menu</a></nav><article><h1>Head &amp; tail</h1><p><b>One  two<br>three<p>four</article><footer>&copy; x</footer>": "Head & tail\nOne two three\nfour",
    "<div id='sidebar'>side</div><div class=ad>buy</div><main><p>Text.</p><form><input>send</form><p>More.</p><section class='comments'><p>nice post</p></section></main>": "Text.\nMore.",
    "": "",
    "<script>var t='<p>no</p>'</script><style>p{}</style>": "",
}


def test_extraction_of_known_pages(spark):
    pages = [*PAGES, None]
    df = spark.createDataFrame([(i, "u", p) for i, p in enumerate(pages)], "page_id bigint, url string, html string")
    for r in extraction.extract(df).collect():
        assert r.text == PAGES.get(pages[r.page_id], "") and r.n_chars == len(r.text)


def test_extraction_by_density_without_named_article():
    rnd = random.Random(14)
    paragraphs = [prose(rnd, 60) for _ in range(5)]
    page = "<ul>" + "".join(f"<li><a href=/{i}>item {i}</a></li>" for i in range(9)) + "</ul><div>" + "".join(f"<p>{html.escape(p)}</p>" for p in paragraphs) + "</div><div>short</div><div><a href=#>up</a></div>"
    assert extraction.main_text(page) == "\n".join(paragraphs)


def test_extraction_keeps_links_within_the_article():
    page = "<nav><a href=x>menu</a></nav><article><h1><a href=x>Title</a></h1><p>See <a href=y>A &amp;&amp;&amp;&eacute;   b</a>.</p><p><a href=z>all linked</a></p><p>Text.</p><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></article><p>outside</p>"
    assert extraction.main_text(page) == "Title\nSee A &&&é b.\nall linked\nText.\nOne\nTwo"
    weights = [x[1] for x in extraction.lines_of("<p>ab <a href=x>&amp;&eacute;&amp;   c</a> de</p>") if x[0]]
    assert weights == [6]  # 'ab ' and ' de'


def test_extraction_keeps_short_lines_at_the_edges_of_the_container():
    rnd = random.Random(17)
    lead, *more = [prose(rnd, 60) for _ in range(4)]
    own = ["A title", "By someone", lead, *more, "Short one.", "Short two.", "first item", "second item", "The end."]
    tags = ["h1", *["p"] * 7, "li", "li", "p"]
    body = "".join(f"<{t}>{html.escape(x)}</{t}>" for t, x in zip(tags, own, strict=True))
    page = f"<div><p>outside</p></div><div>{body}<ul><li><a href=x>link</a></li></ul></div><div><p>outside</p></div>"
    assert extraction.main_text(page) == "\n".join(own)


def test_extraction_weighs_articles_and_drops_noise_around_them():
    rnd = random.Random(18)
    own = [prose(rnd, 60) for _ in range(4)]
    body = "".join(f"<p>{x}</p>" for x in own)
    teasers = "".join(f"<article><h3><a href=/{i}>Card {i}</a></h3><p>Read this too.</p></article>" for i in range(4))
    said = prose(rnd, 80)
    for page in (
        f"<div>{body}</div><div>{teasers}</div>",
        f"<article>{body}</article><div><p>{said[:200]}</p></div>",
        f"<article>{body}</article><div class=comments><article class=comment><p>{said}</p></article><article><p>{said}<div>x</article></div>",
        f"<article>{body}</article><article class='comment'><p>{said}</p></article>",
        f"<div class=ad>never closed<article>{body}</article>",
        f"<main><nav>never closed<article>{body}</article></main><footer>{said}</footer>",
    ):
        assert extraction.main_text(page) == "\n".join(own), page[:40]
    assert extraction.main_text(f"<main><h1>Title</h1><article>{body}</article></main>") == "\n".join(["Title", *own])


def test_extraction_of_unclosed_tags_in_one_pass():
    import time

    for odd in ("<a ", "<a x='", '<a x="', "<a x=\">", "<script", "<!--", "<p title='>", "<![CDATA[", "</"):
        began = time.time()
        extraction.main_text("<p>one</p>" + odd * 120_000)
        extraction.main_text("<p>one</p>" + odd * 120_000 + ">")
        warc.visible("<p>one</p>" + odd * 120_000)
        assert time.time() - began < 6, odd
    assert extraction.main_text('<p>one <a href="x>two</a> three</p><p class="b">four</p>') == "one two three\nfour"
    assert extraction.main_text('<p data-x="a > b" title="<b>">one</p><p>2 < 3</p>') == "one\n2 < 3"


def test_extraction_reads_class_names_word_by_word():
    rnd = random.Random(27)
    own = [prose(rnd, 60) for _ in range(4)]
    body = "".join(f"<p>{x}</p>" for x in own)
    said = prose(rnd, 200)
    for page in (
        f"<div class='layout has-sidebar'>{body}<div class='left-sidebar'><p>{said[:300]}</p></div></div>",
        f"<div class='page-header-layout'><div>{body}</div></div><div class='site-footer'><p>{said[:300]}</p></div>",
        f"<div>{body}</div><section class='post-comments'><p>{said}</p><p>{said}</p></section>",
    ):
        assert extraction.main_text(page) == "\n".join(own), page[:40]
    page = f"<article><div class='entry-header'><h1>Head</h1></div>{body}<div class='share'>share me</div></article>"
    assert extraction.main_text(page) == "\n".join(["Head", *own])


def brute_main(lines, window=3):
    """Surge and dive over (text, weight) lines of one container, from their definition."""
    sums = [sum(w for _, w in lines[i : i + window]) for i in range(len(lines))]
    if not any(sums):
        return ""
    limit = min(120, 0.3 * max(sums))
    inside = [i for i, (t, w) in enumerate(lines) if 3 * w >= limit and any(sums[j] >= limit for j in range(max(0, i - window + 1), i + 1))]
    return inside[0], inside[-1]


def test_extraction_against_brute_line_blocks():
    rnd = random.Random(28)
    for _ in range(200):
        lines = []
        for _ in range(rnd.randrange(1, 25)):
            text = prose(rnd, rnd.choice([1, 2, 5, 30, 60]))
            lines.append((text, 0 if rnd.random() < 0.5 else len(text)))
        # each line in a container of its own, so that nothing adjoins
        page = "".join(f"<div><p>{t if w else f'<a href=x>{t}</a>'}</p></div>" for t, w in lines)
        edges = brute_main(lines)
        want = "" if edges == "" else "\n".join(t for t, _ in lines[edges[0] : edges[1] + 1])
        assert extraction.main_text(page) == want


# mixing


def test_mixing_budgets_and_prefixes(spark):
    rnd = random.Random(15)
    rows = [(i, prose(rnd, rnd.randrange(40)), rnd.choice(["en", "de", None]), rnd.choice(["src0", "src1", "src2", None]), 0) for i in range(800)] + [(None, "a b", "en", "src0", 0), (900, None, "xx", "src0", 0)]
    df = spark.createDataFrame(rows, DOCS)
    out = mixing.mix(df, max_epochs=3, budget_percent=150).collect()
    words = {r[0]: len((r[1] or "").split()) for r in rows}
    leaves = {}
    for i, _, lang, source, _ in rows:
        digit = hashlib.md5((source or "").encode()).hexdigest()[0]
        domain = "d0" if digit < "4" else "d1" if digit < "8" else "d2" if digit < "c" else "d3"
        leaves.setdefault((domain, lang, source), []).append(i)
    weight = lambda level, k: mixing.WEIGHTS[level].get(k, mixing.WEIGHTS[level][""])

    def fill(budget, nodes):  # nodes: name to (weight, limit); rounds of proportional shares
        got, open_ = {}, dict(nodes)
        left = budget
        while open_:
            full = {k: c for k, (w, c) in open_.items() if c * sum(x for x, _ in open_.values()) <= left * w}
            if not full:
                return got | {k: left * w // sum(x for x, _ in open_.values()) for k, (w, _) in open_.items()}
            got |= full
            left -= sum(full.values())
            open_ = {k: v for k, v in open_.items() if k not in full}
        return got

    cap = {k: 3 * sum(words[i] for i in v) for k, v in leaves.items()}
    under = lambda p: sum(c for k, c in cap.items() if k[: len(p)] == p)
    budgets = {(): sum(words[r[0]] for r in rows) * 150 // 100}
    for depth, level in enumerate(("domain", "lang", "source")):
        nxt = {}
        for p, b in budgets.items():
            nodes = {k[: depth + 1]: (weight(level, k[depth]), under(k[: depth + 1])) for k in leaves if k[:depth] == p}
            nxt |= fill(b, nodes)
        budgets = nxt
    got = {r.doc_id: r.copies for r in out}
    for k, ids in leaves.items():
        size = sum(words[i] for i in ids)
        if not size:
            continue
        epochs, rest = divmod(budgets[k], size)
        order = sorted(ids, key=lambda i: hashlib.md5(f"{mixing.SEED}:{epochs}:{'null' if i is None else i}".encode()).hexdigest())
        run = 0
        for i in order:
            run += words[i]
            assert got.get(i, 0) == min(3, epochs + (run <= rest)), (k, i)
    again = mixing.mix_rows(df, max_epochs=3, budget_percent=150).collect()
    assert len(again) == sum(got.values()) and again[0].__fields__ == df.columns
    assert mixing.mix(df.limit(0)).count() == 0


# pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    rnd = random.Random(16)
    texts = [prose(rnd, 120, 4000) for _ in range(60)]
    passage = prose(rnd, 55, 4000)
    texts += [texts[0], texts[1] + " extra", "too short", "| ".join(prose(rnd, 80).split()), texts[2][:200] + " " + passage + " " + prose(rnd, 40, 4000), passage + " " + prose(rnd, 60, 4000)]
    now = docs(spark, texts, source="s")
    for name, stage in p.STAGES:
        before, now = now, stage(spark, now, "").cache()
        if name != "packing":
            assert now.columns == before.columns
        if name == "quality":
            assert {r.doc_id for r in before.collect()} - {r.doc_id for r in now.collect()} == {62, 63}
        if name == "simhash":
            want = set(brute_components({r.doc_id: brute_fingerprint(r.text) for r in before.collect()}, 4).values())
            assert {r.doc_id for r in now.collect()} == want
        if name == "repeats":
            want = brute_removals([(r.doc_id, r.text.encode()) for r in before.collect()])
            assert {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in now.collect()} == {i: w[3] for i, w in want.items() if w[1] < w[0]}
        if name == "mixing":
            assert 0 < now.count() <= before.count()
    assert {r.doc_id for r in now.collect()} == {r.doc_id for r in before.collect()}
