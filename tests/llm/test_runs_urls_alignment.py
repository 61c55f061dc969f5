"""Operators 11 to 13 against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factorloom.llm import alignment, runs, urlrules
from factorloom.llm.common import documents
from factorloom.llm.registry import QUERIES

SF = "/root/testdata/sf0.01"


def all_runs(s):
    """By definition: for each period the maximal stretches, without those that a smaller period has too."""
    n, out, smaller = len(s), [], {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if s[i] != s[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and s[j] == s[j + q]:
                j += 1
            start, end = i, j + q
            if end - start >= 2 * q and not any(a <= start and end <= b for p, (a, b) in smaller.get("all", [])if q % p == 0):
                smaller.setdefault("all", []).append((q, (start, end)))
                if end - start >= max(6, 4 * q):
                    out.append((start, end - start, q))
            i = j
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=70))
def test_runs_of_few_words(s):
    assert runs.find_runs(s) == all_runs(s)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 4), min_size=1, max_size=9), st.integers(1, 9)), max_size=6))
def test_runs_of_repeated_blocks(blocks):
    s = [x for b, k in blocks for x in b * k]
    assert runs.find_runs(s) == all_runs(s)


def test_runs_of_long_sequences():
    assert runs.find_runs([7] * 200_000) == [(0, 200_000, 1)]
    r = random.Random(3)
    block = [r.randrange(50) for _ in range(5_000)]
    assert runs.find_runs([99] + block * 5 + block[:17] + [98]) == [(1, 25_017, 5_000)]
    fib = [0], [0, 1]
    for _ in range(12):
        fib = fib[1], fib[1] + fib[0]
    assert runs.find_runs(fib[1]) == all_runs(fib[1])


def test_extender_survives_collisions(monkeypatch):
    monkeypatch.setattr(runs.Extender, "_alike", lambda self, i, j, size: True)
    for seed in range(30):
        r = random.Random(seed)
        s = [r.randrange(2) for _ in range(40)] + [1, 0] * 6
        assert runs.find_runs(s) == all_runs(s)


def runs_by_hand(doc_id, text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = all_runs(words) if n <= 400 else None
    if found is None:
        return None
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    rest = " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(listed), sha(rest))


def test_runs_of_documents(spark):
    texts = {r["doc_id"]: r["text"] for r in documents(spark, SF).select("doc_id", "text").collect()}
    out = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op11_periodic_runs"](spark, SF).collect()}
    assert out.keys() == texts.keys()
    tried = with_runs = 0
    for i, t in texts.items():
        want = runs_by_hand(i, t)
        if want is not None:
            assert out[i] == want, i
            tried += 1
            with_runs += want[0] > 0
    assert tried > 500 and with_runs > 20


def test_runs_of_odd_rows(spark):
    rows = [(0, None), (None, "a b a b a b a b a b"), (2, ""), (2, ""), (3, "\x1c x\x1cx"), (5, "é é é é é é é"), (6, "go \n go\tgo go go")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, [tuple(x) for x in r["runs"]]) for r in runs.detect(docs).collect())
    assert got == [(-1, [(0, 10, 2)]), (0, []), (2, []), (2, []), (3, []), (5, [(0, 7, 1)]), (6, [])]
    assert runs.digests(docs.filter("doc_id = 0")).first()[1:] == (0, None, None, None, None, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"").hexdigest())
    assert runs.digests(docs.limit(0)).count() == 0


URLS = [
    "http://a.com/x", "http://COM/en/1", "https://www.Example.com/en/?q", "https://x.www.example.com/en/a#b", "https://example.com/en/", "https://example.com/en", "https://notexample.com/en/",
    "ftp://net/es/", "http://a.b.net/fr/x://y", "http://net", "http://net/", "http://.com/", "http://a..com/", "http://com./x", "no scheme/com/", "://com/a", "http://u@net:80/es/", "", None, "http://",
    "http://É.net/es/É", "http://net/ES/", "http://example.com?/en/", "http://x.com/" + "a/" * 3000, "." .join(["http://x"] + ["y"] * 3000 + ["com/"]), "http://com-x.net/fr/", "http://com\n/x", "http://example.com/en/\n?",
]
MANY = [(h, p, v) for h, v in (("com", "block"), ("example.com", "allow"), ("b.example.com", "block"), ("org", "allow"), ("x-y.org", "block")) for p in ("/", "/a", "/a/", "/a/b", "/ab", "/a/b/c/", "/b")]


def by_rules(url, rules, default):
    import re

    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[2], max(fits)[3]) if fits else (host, path, None, default)


def test_urls_by_hand(spark):
    from pyspark.sql import functions as F

    pages = spark.createDataFrame([*enumerate(URLS), (None, "http://a.com/x"), (0, URLS[0]), (0, URLS[0])], "page_id long, url string").withColumn("html", F.lit("")).withColumn("host", F.lit(1)).withColumn("rule", F.lit(2)).withColumn("key", F.lit(3))
    want = sorted((i, *map(str, by_rules(u, urlrules.RULES, "allow"))) for i, u in [*enumerate(URLS), (-1, "http://a.com/x"), (0, URLS[0]), (0, URLS[0])])
    got = sorted((-1 if r["page_id"] is None else r["page_id"], *map(str, tuple(r)[1:])) for r in urlrules.judge(pages, urlrules.rule_table(spark)).collect())
    assert got == want
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r["verdict"] for r in urlrules.judge(pages, none, "block").collect()} == {"block"}
    assert urlrules.judge(pages.limit(0), urlrules.rule_table(spark)).count() == 0


def test_urls_of_nested_rules(spark):
    """Rules that are open over many ranges, and a url that holds a third of all rows."""
    r = random.Random(1)
    hosts = ["com", "example.com", "a.example.com", "b.example.com", "c.b.example.com", "org", "x-y.org", "x.org", "z.x-y.org", "net"]
    urls = [f"http://{r.choice(hosts)}{''.join(r.choice(['/a', '/b', '/', '/c', 'b']) for _ in range(r.randrange(5)))}" for _ in range(1500)] + ["http://b.example.com/a/b/c/d"] * 750
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(5)
    rules = spark.createDataFrame([*MANY, MANY[0], ("", "/", "block"), (None, "/", "block"), ("com", None, "block"), ("com", "/a", "allow")], "host string, path string, verdict string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["page_id"]: tuple(r)[1:] for r in urlrules.judge(pages, rules, "none").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {i: by_rules(u, MANY, "none") for i, u in enumerate(urls)}


def by_definition(texts):
    """Op 13 from whole texts: offsets, all occurrence pairs, sets of documents."""
    import base64

    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found = []
    for text in texts:
        groups = []
        if text:
            a = t.encode(" " + text, add_special_tokens=False).ids
            b = sp.encode(text)
            as_bytes = [ranks[i] for i in a], [bytes([int(p[3:5], 16)]) if len(p) == 6 and p[:3] == "<0x" and p[5] == ">" else p.replace("▁", " ").encode() for p in map(sp.id_to_piece, b)]
            if all(b"".join(x) == (" " + text).encode() for x in as_bytes):
                ends = [[], []]
                for side in (0, 1):
                    at = 0
                    for x in as_bytes[side]:
                        at += len(x)
                        ends[side].append(at)
                cuts = set(ends[0]) & set(ends[1])
                i = j = 0
                for cut in sorted(cuts):
                    p, q = i, j
                    while i < len(a) and ends[0][i] <= cut:
                        i += 1
                    while j < len(b) and ends[1][j] <= cut:
                        j += 1
                    groups.append((a[p:i], b[q:j]))
        found.append(groups)
    holds = defaultdict(set)
    for k, groups in enumerate(found):
        for a, b in groups:
            for x in set(a):
                for y in set(b):
                    holds[x, y].add(k)
    best = Counter()
    for (x, _), d in holds.items():
        best[x] = max(best[x], len(d))
    out = []
    for groups in found:
        links = [(x, y) for a, b in groups for x in a for y in b]
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        counts = [len(holds[p]) for p in links]
        out.append((sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(n == best[p[0]] for n, p in zip(counts, links)), sum(counts), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return out


ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "x\n  y", "x\n y", "<|endoftext|> and <s> </s> <unk> <0x41>", "▁x y", "don't we'll 's 12 34", "é ñ 𝔘 \u3000 \u00a0x\u00a0 y", "日本語のテキスト 混ぜる", "\x00 \x1c a\x1cb \x85 c",
    "x" * 3000, "ab" * 900 + " " + "ba" * 300, " " * 500 + "z", "the the the the", "the the the the", "unbelievable unbelief un believable", "\r\n\r\n a\tb \t c", "🙂🙃 🙂", "aaaa \u2028 bbbb",
]


@pytest.mark.parametrize("hot", [1 << 16, 3, 0])
def test_alignment_of_odd_rows(spark, monkeypatch, hot):
    """hot: all, some and none of the groups are broadcast."""
    monkeypatch.setattr(alignment, "HOT", hot)
    docs = spark.createDataFrame([(k if k % 7 else None, t, 1, "x") for k, t in enumerate(ODD)], "doc_id int, text string, row int, groups string").repartition(3)
    got = Counter((r["doc_id"], *tuple(r)[1:]) for r in alignment.align(docs).collect())
    assert got == Counter((k if k % 7 else None, *x) for k, x in enumerate(by_definition(ODD)))
    assert alignment.align(docs.limit(0)).count() == 0


def test_alignment_of_documents(spark):
    docs = documents(spark, SF).select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op13_tokenizer_alignment"](spark, SF).collect()}
    assert got == dict(zip((r["doc_id"] for r in docs), by_definition([r["text"] for r in docs])))


def test_alignment_dictionary_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNKS", 5)
    x = alignment.Aligner(alignment.a_path(), alignment.b_path())
    for t in [t for t in ODD if t] * 2:
        fresh = alignment.Aligner(alignment.a_path(), alignment.b_path())
        assert alignment._document(x, alignment._parts(x, [t])[0]) == alignment._document(fresh, alignment._parts(fresh, [t])[0])
        before = len(x.said)
        alignment._parts(x, [t])
        assert len(x.said) <= max(before, 5) + len(set(alignment.chunks(t)))


def test_url_sql(spark):
    out = QUERIES["op12_url_rules"](spark, SF)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{Path(SF) / 'pages.parquet'}'")
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, con.execute(urlrules.sql()).fetchall()))
