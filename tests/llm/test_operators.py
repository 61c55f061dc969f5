"""The operators against brute force, libraries, round trips and held-out rows."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.llm import bpe, brown, exact_dedup, langid, licenses, minhash, mixing, mpegts, pii, secrets
from factorloom.llm.common import documents, maybe_among, portions

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, "/root/testdata/sf0.01").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def test_tree_is_the_library(spark):
    from tokenizers import Tokenizer

    t, c = Tokenizer.from_file(bpe.default_path()), bpe.codec(bpe.default_path())
    r = random.Random(5)
    bits = ["a", "b", "the", "'s", "'", "ll", "'ve", " ", "  ", "\n", "1", "23", "é", "中", "文", "!", "...", "-", "<|endoftext|>", "<|endof", "text|>", "𝔘", "ß", "\x1c", "re"]
    for _ in range(600):
        s = r.choice(bits) * r.randint(1, 300) if r.random() < 0.3 else "".join(r.choice(bits) * r.choice([1, 1, r.randint(1, 60)]) for _ in range(r.randint(0, 60)))
        parts = bpe.leaves(s, c.special, r.choice([3, 7, 16, 40, 100]))
        got = bpe.tree(c, [(p, f, np.array(c.encode(p), np.int32)) for p, f in parts]).tolist()
        want = t.encode(s, add_special_tokens=False).ids
        assert got == want and c.decode(got) == t.decode(want, skip_special_tokens=False)


def test_spread_texts_are_encoded_like_whole_ones(spark, docs, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    got = {r["doc_id"]: r for r in bpe.digests(docs, leaf=300, spread=1000).collect()}
    for (i, s), e in zip(texts.items(), t.encode_batch(list(texts.values()), add_special_tokens=False), strict=True):
        assert got[i]["n_tokens"] == len(e.ids) and got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, e.ids)).encode()).hexdigest() and got[i]["decoded_sha256"] == hashlib.sha256(s.encode()).hexdigest()


def test_round_trip(spark, docs, texts):
    some = docs.filter("doc_id < 50")
    assert {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(some, leaf=500, spread=2000)).collect()} == {i: t for i, t in texts.items() if i < 50}


def near_by_force(texts: dict) -> dict:
    sets = {}
    for i, t in texts.items():
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    holders = collections.defaultdict(list)
    for i, s in sets.items():
        shared = collections.Counter(j for x in s for j in holders[x])
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                up[max(top(i), top(j))] = min(top(i), top(j))
        for x in s:
            holders[x].append(i)
    return {i: (len(s), top(i)) for i, s in sets.items()}


def test_near_components(spark, docs, texts):
    want = near_by_force(texts)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_components(docs).collect()} == want


def test_near_components_of_a_large_group(spark):
    r = random.Random(4)
    base = [f"w{r.randint(0, 500)}" for _ in range(120)]
    texts = {}
    for i in range(700):
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(len(w))] = f"x{r.randint(0, 10**6)}"
        texts[i] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in minhash.near_components(df).collect()} == near_by_force(texts)


def test_registers_estimate_jaccard():
    r = np.random.default_rng(1)
    errors = []
    for _ in range(60):
        both, a, b = (r.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2) for n in (300, 50, 50))
        x, y = np.unique(np.concatenate([both, a])), np.unique(np.concatenate([both, b]))
        errors.append(float(minhash.estimate((minhash.registers(x) == minhash.registers(y)).sum())) - 0.75)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_filter_never_misses(spark):
    keys = spark.range(0, 1000, 7).select(F.col("id").alias("k")).unionByName(spark.createDataFrame([(None,)], "k long"))
    rows = spark.range(1000).unionByName(spark.createDataFrame([(None,)], "id long"))
    got = {r["id"] for r in maybe_among(rows, "id", keys).filter("maybe").collect()}
    assert got >= {None, *range(0, 1000, 7)} and len(got) < 200


def test_copies_by_content_when_digests_collide(spark, docs):
    want = sorted(map(tuple, exact_dedup.exact_dedup(docs).collect()))
    weak = lambda c: F.pmod(F.length(c), F.lit(7)).cast("string").cast("binary")
    assert sorted(map(tuple, exact_dedup.exact_dedup(docs, hot_rows=3, digest=weak).collect())) == want
    assert sorted(map(tuple, exact_dedup.exact_dedup(docs, hot_rows=1, salts=3).collect())) == want


def test_kept_documents_keeps_one_row_of_repeats(spark):
    rows = [(1, "a b"), (1, "a b"), (2, "a  b"), (3, None), (4, "")]
    got = exact_dedup.kept_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(2, "a  b"), (3, None)], key=str)


def test_mix_meets_its_targets(spark, docs, texts):
    got = mixing.mix(docs).toPandas()
    again = mixing.mix(docs.repartition(5)).toPandas()
    key = ["doc_id", "taken"]
    assert got[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()
    assert (got["taken"] <= 3 * got["size"]).all() and len(got) == len(texts)
    assert all(n == len(WORD.findall(texts[i])) for i, n in zip(got["doc_id"], got["size"], strict=True))
    got["source"] = got["doc_id"].map({r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()})
    for _, g in got.groupby("source"):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= max(2 * mixing.BLOCK, 0.02 * g["target"].iloc[0])
    assert math.isclose(got.groupby("source")["target"].first().sum(), got["size"].sum())


def test_targets_by_the_loop(spark):
    size = {"a": 10, "b": 1000, "c": 500, "d": 3, "e": 700, None: 50}
    rows = [(i, " ".join(["w"] * n), s) for i, (s, n) in enumerate(size.items())]
    got = {r["source"]: r["target"] for r in mixing.sources(spark.createDataFrame([(s, len(t.split())) for _, t, s in rows], "source string, size long")).collect()}
    names, total = ["a", "b", "c", "d", "e", None], sum(size.values())
    weight = {n: (5, 2, 1)[k % 3] for k, n in enumerate(names)}
    capped: set = set()
    while True:
        rest = [n for n in names if n not in capped]
        left = total - sum(3 * size[n] for n in capped)
        want = {n: 3 * size[n] for n in capped} | {n: left * weight[n] / sum(weight[m] for m in rest) for n in rest}
        over = {n for n in rest if want[n] > 3 * size[n] + 1e-9}
        if not over:
            break
        capped |= over
    assert all(math.isclose(got[n], want[n], rel_tol=1e-9) for n in names)


def test_permutations_are_permutations():
    for n in (1, 2, 3, 17, 256, 1000):
        assert sorted(mixing.permute(np.arange(n), np.full(n, n), np.full(n, 5)).tolist()) == list(range(n))


def test_small_sources_meet_their_targets(spark):
    rows = [(i, " ".join(["w"] * n), f"s{i}") for i, n in enumerate([40, 80, 120, 200, 250, 300])] + [(10, "", None), (10, "", None), (11, None, "s1"), (0, " ".join(["w"] * 40), "s0")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    assert len(got) == len(rows) and (got["taken"] <= 3 * got["size"]).all() and math.isclose(got.groupby("target")["taken"].sum().sum(), 1030, rel_tol=0.02)
    for target, g in got.groupby("target"):
        assert abs(g["taken"].sum() - target * g["source_size"].nunique()) <= max(3, 0.02 * target)


def test_taken_by_force(spark, docs):
    """The blocks that the slots name, cut from each source's words in their order."""
    counted = mixing._counted(docs)
    known = mixing.packed(mixing.sources(counted.select("source", (F.col("size") * F.col("copies")).alias("size"))))
    table = {r["source"]: r for r in known.collect()}
    slots = mixing.slots(known).collect()
    assert collections.Counter(r["rank"] for r in slots) == {r["rank"]: r["quota"] for r in table.values() if r["quota"]}
    assert sorted(r["shard"] * mixing.SHARD + r["slot"] for r in slots) == list(range(len(slots)))
    times, want = collections.Counter((r["rank"], r["block"]) for r in slots), collections.Counter()
    assert max(times.values()) <= 3 and all(0 <= b < next(r["blocks"] for r in table.values() if r["rank"] == k) for k, b in times)
    line = collections.defaultdict(dict)
    for r in mixing.placed(counted).collect():
        for k in range(r["size"]):
            assert line[r["source"]].setdefault(r["at"] + k, r["doc_id"]) == r["doc_id"]
    for s, words in line.items():
        assert sorted(words) == list(range(table[s]["source_size"]))
        for at, i in words.items():
            want[i] += times[table[s]["rank"], at // table[s]["length"]]
    assert {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect() if r["taken"]} == {i: n for i, n in want.items() if n}


def test_draws_do_not_depend_on_cells(spark):
    known = mixing.packed(mixing.sources(spark.createDataFrame([(f"s{i}", 997 * (i + 1)) for i in range(40)], "source string, size long"))).cache()
    few, many = (collections.Counter(r["rank"] for r in mixing.slots(known, cell=c).collect()) for c in (64, 1 << 20))
    assert few == many == {r["rank"]: r["quota"] for r in known.collect() if r["quota"]}


def test_rows_are_numbered_in_order(spark):
    rows = spark.range(1000).select((F.col("id") * 37 % 1000).alias("x")).repartition(5)
    assert sorted((r["x"], r["pos"], r["before"]) for r in mixing.running(rows, [F.col("x")], {"before": F.col("x")}).collect()) == [(i, i, i * (i - 1) // 2) for i in range(1000)]


def test_mixed_documents_are_what_the_mix_takes(spark, docs):
    taken = collections.Counter()
    for r in mixing.mixed_documents(docs).collect():
        taken[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect() if r["taken"]} == dict(taken)


def test_streams_hold_their_payload(texts):
    for t in [b"", b"a" * 576, b"b" * 577, *(s.encode() for s in list(texts.values())[:80])]:
        p = mpegts.payload_of(t)
        m = mpegts.mux_bytes(p)
        d = mpegts.demux_bytes(m)
        assert d["payload"] == p and d["errors"] == 0 and len(m) % 188 == 0 and len(p) % 576 == 0
        assert d["access"].tolist() == list(range(0, len(p) // 576, 12)) and d["pts"].tolist() == [3600 * i for i in range(len(p) // 576)]
    broken = bytearray(m)
    broken[188 * 3 + 3] ^= 1
    assert mpegts.demux_bytes(bytes(broken))["errors"] and mpegts.demux_bytes(b"x" * 400)["errors"]


def test_tables_over_several_packets_and_repeats(spark):
    payload = mpegts.payload_of(b"some text" * 500)
    plain = mpegts.mux_bytes(payload)
    more = b"\x05\x04abcd" * 40  # descriptors that make the map longer than a packet
    body = (0xE000 | mpegts.DATA_PID).to_bytes(2, "big") + (0xF000 | len(more)).to_bytes(2, "big") + more + bytes([mpegts.STREAM_TYPE]) + (0xE000 | mpegts.DATA_PID).to_bytes(2, "big") + b"\xf0\x00"
    section = mpegts._section(2, 1, body)
    first = mpegts._table_packet(mpegts.PMT_PID, section[:183])
    second = (bytes([mpegts.SYNC, mpegts.PMT_PID >> 8, mpegts.PMT_PID & 255, 0x11]) + section[183:]).ljust(188, b"\xff")
    wide = plain[:188] + first + second + plain[376:]
    d = mpegts.demux_bytes(wide)
    assert len(section) > 183 and d["payload"] == payload and d["errors"] == 0
    twice = plain[: 188 * 4] + plain[188 * 3 : 188 * 4] + plain[188 * 4 :]
    assert mpegts.demux_bytes(twice)["payload"] == payload and mpegts.demux_bytes(twice)["errors"] == 0
    rows = spark.createDataFrame([(1, "some text" * 2000), (2, None)], "doc_id long, text string")
    points = {r["doc_id"]: r for r in mpegts.access_points(mpegts.mux(rows)).collect()}
    said = {r["doc_id"]: r["access"] for r in mpegts.demux(mpegts.mux(rows)).collect()}
    assert points[1]["access_units"] == [0, 12, 24] and points[1]["access_pts"] == [0, 43200, 86400] and said == {1: "0:0,12:43200,24:86400", 2: "0:0"}


def test_languages_of_held_out_rows(spark, docs):
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = [r for r in langid.identify(docs).collect() if r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in got)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in got) / len(got) > 0.98 and all(0 <= r["score"] <= 1 for r in got)


def test_language_model(spark, docs, texts):
    words = {i: [*WORD.findall(t.translate(LOWER)), None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in words}
    c = collections.Counter(w for i, ws in words.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    got = {r["doc_id"]: r for r in brown.score(docs, size=50_000).collect()}
    for i, ws in words.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(w in c for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel_tol=1e-9)
    none = {r["doc_id"]: r["score"] for r in brown.score(docs, size=50_000, rounds=0).collect()}
    rows = [i for i in words if held[i]]
    assert sum(got[i]["score"] for i in rows) > sum(none[i] for i in rows) > sum(got[i]["base_score"] for i in rows)


def test_language_model_by_force(spark, docs):
    some = docs.filter("doc_id < 120")
    plain, salted = (brown.fit(some, size=3000, salted=n) for n in (20_000, 3))
    assert plain.rounds == salted.rounds and len(plain.rounds) == 1 + brown.ROUNDS and max(plain.rounds) > plain.rounds[0]
    cls, count = {}, {}
    for r in plain.packed.join(plain.answers, "chunk").collect():
        every = np.concatenate([brown._unpack(p["counts"], np.int64) for p in r["parts"]])
        for w, c, n in zip(np.frombuffer(r["words"], np.uint64).tolist(), brown._classes_of(r["parts"]).tolist(), every.tolist(), strict=True):
            assert cls.setdefault(w, c) == c and count.setdefault(w, n) == n
    texts = {r["doc_id"]: r["text"] for r in some.collect()}
    tokens = {i: [*(brown.xxhash.xxh3_64_intdigest(w.encode()) for w in WORD.findall(t.translate(LOWER))), brown.END] for i, t in texts.items()}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 5 != 1]
    seen, n = collections.Counter(w for i in train for w in tokens[i]), sum(len(tokens[i]) for i in train)
    assert {w: c for w, c in count.items() if c} == dict(seen)
    pairs = collections.Counter((cls[a], cls[b]) for i in train for a, b in zip([brown.END, *tokens[i]], tokens[i]))
    size = collections.Counter()
    for w, c in seen.items():
        size[cls[w]] += c
    share = {c: (size[c] + 1e-9) / (n + brown.CLASSES * 1e-9) for c in range(brown.CLASSES)}
    unknown = min(0.5, max(sum(c == 1 for c in seen.values()), 0.5) / n)
    want = {}
    for i, ws in tokens.items():
        total, before = 0.0, brown.END_CLASS
        for w in ws:
            c = cls[w]
            if c == brown.CLASSES:
                p = unknown
            else:
                of = share[c] if before == brown.CLASSES else (pairs[before, c] + brown.PULL * share[c]) / (size[before] + brown.PULL)
                p = of * (1 - unknown) * seen[w] / size[c]
            total, before = total + math.log10(p), c
        want[i] = total
    got = {r["doc_id"]: r["score"] for r in brown.score(some, model=plain).collect()}
    assert all(math.isclose(got[i], want[i], rel_tol=1e-6) for i in want)
    assert not [t for t in spark.catalog.listTables() if t.name == plain.table]


def test_class_model_is_a_distribution():
    pairs = np.zeros((brown.CLASSES + 1, brown.CLASSES + 1))
    pairs[:5, :5] = np.arange(25).reshape(5, 5)
    assert np.allclose((10 ** brown.transitions(pairs, 7, 300)).sum(1), 1)


def test_personal_data(spark, docs, texts):
    got = {r["doc_id"]: r for r in pii.detect(docs).collect()}
    for i, t in texts.items():
        want = sorted((m.start(), k, m.end()) for k, kind in enumerate(pii.KINDS) for m in pii.PATTERNS[kind].finditer(t) if pii._valid(kind, m.group()))
        said = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert got[i]["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert set(said.split(",") if said else []) <= set(got[i]["spans"].split(","))


def test_gradients():
    m = pii.Model(3)
    m.w = {k: v.astype(float) for k, v in m.w.items()}
    x, y = pii.examples(["call +49 (30) 1234567 or write a.b@c.de, 10.0.0.1"] * 3)
    x, y = x[:4, :12], y[:4, :12]
    _, g = m.gradients(x, y)
    for k in m.w:
        i = (int(x[0, 3]), 5) if k.startswith("x") else tuple(s // 2 for s in m.w[k].shape)
        w = m.w[k][i]
        m.w[k][i] = w + 1e-5
        a = m.gradients(x, y)[0]
        m.w[k][i] = w - 1e-5
        b = m.gradients(x, y)[0]
        m.w[k][i] = w
        assert math.isclose(g[k][i], (a - b) / 2e-5, rel_tol=1e-4, abs_tol=1e-7)


def test_emissions_are_those_of_the_states():
    m = pii.Model(4)
    x, _ = pii.examples(["call +49 (30) 1234567 or write a.b@c.de, 10.0.0.1"] * 3)
    hs, _ = m.states(x[:5])
    want = np.concatenate([hs[0], hs[1][::-1]], -1).transpose(1, 0, 2) @ m.w["out"] + m.w["bias"]
    assert np.allclose(m.emissions(x[:5]).transpose(2, 0, 1), want, atol=1e-4)


def test_secret_windows_and_allow_list(spark):
    rows = [(1, "key zX9k2Lq8Wm4Rt7Yb1NpQ end"), (2, "id 123e4567-e89b-12d3-a456-426614174000"), (3, "x1x1x1x1x1x1x1x1x1x1x1x1"), (4, "EXAMPLEzX9k2Lq8Wm4Rt7Yb1N")]
    got = {r["doc_id"]: r["spans"] for r in secrets.digest(secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got == {1: "entropy_base64:4:24", 2: "", 3: "", 4: ""}


def test_addresses_of_numbers_in_linear_time():
    plain, r = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), random.Random(8)
    for _ in range(3000):
        s = "".join(r.choice("..12 9x٣") for _ in range(r.randint(0, 30)))
        assert [m.span() for m in pii.PATTERNS["ip"].finditer(s)] == [m.span() for m in plain.finditer(s)]
    assert pii.base_spans("1" * 300_000 + ". 10.0.0.1")[-1] == (300_002, 1, 300_010)


def test_portions_hold_all_rows_once():
    import pyarrow as pa

    r = random.Random(9)
    sizes = [r.choice([0, 1, 5, 40]) for _ in range(200)]
    b = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(["x" * n for n in sizes])], ["doc_id", "text"])
    parts = [p.to_pydict() for p in portions(b, 1, 7, 30)]
    assert [i for p in parts for i in p["doc_id"]] == list(range(200))
    assert all(len(p["text"]) == 1 or len(p["text"]) <= 7 and sum(map(len, p["text"])) <= 30 for p in parts)


MIT = """MIT License

Copyright (c) 2020 A. Name

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE FOR ANY CLAIM."""
BSD = """Copyright (c) 2020, A. Name

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
APACHE = """Copyright 2020 A. Name

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language."""
GPL = """This program is free software{} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{} either version {} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""


def test_languages_learned_are_bounded(spark):
    """300 junk labels of a row each: the languages with the most rows are learned, ties by code, and every row is predicted."""
    words = {"en": "the cat sat on the mat and the dog", "de": "der hund und die katze sind nicht hier", "fr": "le chat est sur la table avec nous"}
    rows = [(i, f"{t} {i}", lang) for i, (lang, t) in enumerate([*words.items()] * 40)]
    rows += [(1000 + i, f"qx{i} zz{i} jj", f"x{i:03}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = langid.train(docs, max_langs=5)
    learned = sorted(n for m in model.members.values() for n in m)
    free = sorted({lang for i, _, lang in rows if i >= 1000 and zlib.crc32(str(i).encode()) % 5})
    assert learned == sorted([*words, *free[:2]])
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, model).collect()}
    assert len(got) == len(rows) and set(got.values()) <= set(learned)
    assert all(got[i] == lang for i, _, lang in rows if i < 1000)


BSD_FORM = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. {} may be used to endorse or promote products derived from this software without specific prior written permission.
"""


def test_names_expressions_and_choices_of_licenses(spark, tmp_path):
    """Whoever the third clause names; SPDX expressions, deprecated identifiers and exceptions; short notices. The SQL agrees."""
    import duckdb

    cases = {
        BSD_FORM.format("Neither the name of Google Inc. nor the names of its contributors"): "BSD-3-Clause",
        BSD_FORM.format("Neither the name of the University of\n   California, Berkeley nor the names of\n   its contributors"): "BSD-3-Clause",
        BSD_FORM.format("Neither the name of the copyright holder nor the names of its contributors"): "BSD-3-Clause",
        BSD_FORM.split("3. ")[0]: "BSD-2-Clause",
        "SPDX-License-Identifier: MIT OR Apache-2.0": "MIT,Apache-2.0",
        "/* SPDX-License-Identifier: (GPL-2.0-only OR BSD-3-Clause) */": "GPL-2.0-only,BSD-3-Clause",
        "// SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception AND MIT": "MIT,Apache-2.0",
        "SPDX-License-Identifier: GPL-2.0": "GPL-2.0-only",
        "SPDX-License-Identifier: GPL-2.0+": "GPL-2.0-or-later",
        "SPDX-License-Identifier: LGPL-2.1-or-later OR MPL-2.0": "LGPL-2.1-or-later,MPL-2.0",
        "SPDX-License-Identifier: MIT OR Nothing-1.0": "MIT",
        "License: MIT": "MIT",
        "Licensed under EPL-2.0": "EPL-2.0",
        "This project is licensed under the Eclipse Public License v 2.0.": "EPL-2.0",
        "licence: Artistic License 2.0": "Artistic-2.0",
        "released under the Common Development and Distribution License 1.0": "CDDL-1.0",
        "License: WTFPL": "WTFPL",
        "Code is MIT licensed.": "MIT",
        "The library is Apache 2.0 licensed": "Apache-2.0",
        "Licensed under either of Apache License, Version 2.0 or MIT license at your option.": "MIT,Apache-2.0",
        "Dual-licensed under the MIT license or the Apache License 2.0": "MIT,Apache-2.0",
        "We are licensed to fly.": "", "the license mit or not": "", "This is licensed": "", "Neither the name of the game nor the names of its contributors matter.": "",
    }
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    found = {t: set(got[i]["licenses"].split(",")) for i, t in enumerate(cases)}
    assert found == {t: set(v.split(",")) for t, v in cases.items()}
    docs.toPandas().to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = con.execute(licenses.sql())
    names = [c[0] for c in want.description]
    for r in want.fetchall():
        row = dict(zip(names, r, strict=True))
        assert got[row["doc_id"]].asDict() == row


def test_wrapped_and_unwrapped_licenses(spark):
    wanted = {
        MIT: ("mit_title mit_grant mit_condition as_is", "MIT", "permissive"),
        BSD: ("bsd_grant bsd_source bsd_binary bsd_name", "BSD-3-Clause", "permissive"),
        APACHE: ("apache2_notice apache2_use apache2_copy apache2_as_is", "Apache-2.0", "permissive"),
        GPL.format(";", ";", 2): ("gpl2_free gpl_hope", "GPL-2.0-or-later", "copyleft"),
        GPL.format(":", ",", 3): ("gpl3_free gpl_hope", "GPL-3.0-or-later", "copyleft"),
    }
    forms = {
        "wrapped": lambda t: t,
        "unwrapped": lambda t: "\n\n".join(" ".join(p.split()) for p in t.split("\n\n")),
        "remark": lambda t: "\n".join(" * " + line for line in t.split("\n")),
        "crlf": lambda t: t.replace("\n", " \r\n"),
    }
    cases = [(f"{name} {w[1]}", f(t), w) for t, w in wanted.items() for name, f in forms.items()]
    cases += [("apart", "The MIT\n\nLicense", ("", "", "none")), ("within", "it is not licensed under the MIT\nlicense", ("", "", "none"))]
    docs = spark.createDataFrame([(i, t) for i, t, _ in cases], "doc_id string, text string")
    got = {r["doc_id"]: (r["sentence_ids"], r["licenses"], r["license_class"]) for r in licenses.scan(docs).collect()}
    assert got == {i: w for i, _, w in cases}


def test_sentences_without_a_cue(spark):
    docs = spark.createDataFrame([(1, "Use it\nas you like.")], "doc_id long, text string")
    out = licenses.scan(docs, (("free", "use it as you like"),), (("Free", "permissive", ("free",)),)).first()
    assert (out["n_sentences"], out["licenses"]) == (1, "Free")


@pytest.fixture(scope="module")
def trained(texts):
    some = [t for t in texts.values() if t and any(c in t for c in "0123456789@")]
    return pii.Model().fit(*pii.examples(some[: pii.SAMPLE_ROWS]))


def test_added_spans_of_held_out_rows(trained, texts):
    """Personal data that no pattern finds, one in each of 200 texts that were not learned from."""
    r, some = np.random.default_rng(5), [t for t in texts.values() if t and " " in t][-200:]
    right = found = 0
    for t in some:
        kind, v = pii._written(r)
        i = int(r.choice([m.start() for m in re.finditer(" ", t)]))
        put = t[:i] + " " + v + t[i:]
        base = pii.base_spans(put)
        got = [x for x in pii.added(put, pii.model_spans(trained, [put])[0]) if not any(x[0] < e and s < x[2] for s, _, e in base)]
        found += len(got)
        right += (i + 1, kind, i + 1 + len(v)) in got
    assert right / len(some) >= 0.75 and right / found >= 0.9


def test_pieces_are_one_path(trained, texts):
    some = [t for t in texts.values() if t][:40] + ["we met there and jane dot doe at example dot com was the address"]
    x, head = pii._windows(some)
    score = pii._scores(trained, x, head, np.arange(len(x))).transpose(2, 0, 1).reshape(-1, len(pii.TAGS)).copy()
    score[x[:, : pii.STRIDE].ravel() == 14] = pii._OUTSIDE
    every = np.concatenate([pii._OUTSIDE[None], score, pii._OUTSIDE[None]])[None]
    path = trained.path(every)[0, 1:-1]
    for k in range(len(pii.KINDS)):
        lead = score[:, 0] - score[:, 1 + 2 * k : 3 + 2 * k].max(1)
        for block in (97, 1 << 16):
            is_open = pii._open(lead, pii._gain(trained.w["trans"], k), block)
            assert not ((path[~is_open] == 1 + 2 * k) | (path[~is_open] == 2 + 2 * k)).any()
    begin = np.append(np.flatnonzero(head), len(head)) * pii.STRIDE
    want = [[] for _ in some]
    for s, k, e in pii._path_spans(path):
        n = int(np.searchsorted(begin, s, "right")) - 1
        want[n].append((s - int(begin[n]), k, e - int(begin[n])))
    got = pii.model_spans(trained, some)
    assert all(set(g) <= set(w) for g, w in zip(got, want, strict=True)) and any(got)


def test_stretches_cover_all_places():
    keep = np.concatenate([np.arange(5, 9), np.arange(100, 100 + 3 * pii.PIECE)])
    parts = list(pii._stretches(keep))
    assert sorted(i for _, _, lo, hi in parts for i in range(lo, hi)) == keep.tolist() and all(b - a <= pii.PIECE + pii.MARGIN for a, b, _, _ in parts)


def test_windows_do_not_depend_on_neighbours(trained):
    texts = ["", "no digits here", "x " * 300 + "write to name (at) host.org " + "y " * 200]
    assert [pii.model_spans(trained, [t])[0] for t in texts] == pii.model_spans(trained, texts)


def test_written_out_data_is_spelled():
    assert pii.spelled("email", "jane dot doe at example dot com") and pii.spelled("ip", "10 [.] 0 (dot) 0 dot 17") and pii.spelled("phone", "plus four nine three zero one two three four five")
    assert not pii.spelled("email", "at home") and not pii.spelled("ip", "300 dot 1 dot 1 dot 1") and not pii.spelled("card", "one two three")


def test_unknown_languages_are_rejected(spark, docs):
    rows = [(10**7, "Привет как дела сегодня хорошо", None, "s", 1), (10**7 + 1, "中文文本没有学过的语言", None, "s", 1), (10**7 + 2, "12 ?", None, "s", 1)]
    more = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    kept = {r["doc_id"] for r in langid.keep_known(more).collect()}
    assert 10**7 + 2 not in kept and kept >= {r["doc_id"] for r in docs.collect()}
    english = {r["doc_id"] for r in langid.keep_known(docs, languages=("en",)).collect()}
    assert english == {r["doc_id"] for r in langid.predict(docs, langid.train(docs)).filter("lang_pred = 'en'").collect()}
    unlabelled = spark.createDataFrame([(1, "words", None), (2, "12", None)], "doc_id long, text string, lang string")
    assert [r["doc_id"] for r in langid.keep_known(unlabelled).collect()] == [1]


def test_long_candidates_and_many_matches(spark):
    r = random.Random(1)
    long = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(1_000_000))
    got = {x["doc_id"]: x for x in secrets.digest(secrets.scan(spark.createDataFrame([(1, f"key {long} end"), (2, "token=abcdef123 " * 100_000)], "doc_id long, text string"))).collect()}
    assert got[1]["spans"] == "entropy_base64:4:1000004"
    assert got[2]["n_assign"] == 100_000 and got[2]["spans"].endswith(f"assign:{99_999 * 16}:{99_999 * 16 + 15}")


def test_notices_headers_and_lines(spark):
    cases = {
        "This project is released under the MIT License, see LICENSE.": "MIT",
        "// SPDX-License-Identifier: LGPL-2.1-or-later\nint main;": "LGPL-2.1-or-later",
        "# This Source Code Form is subject to the terms of the Mozilla Public\n# License, v. 2.0. If a copy of the MPL was not distributed with this\n# file, You can obtain one at https://mozilla.org/MPL/2.0/.": "MPL-2.0",
        GPL.format(";", ";", 3).replace("GNU General Public License as", "GNU Affero General Public License as"): "AGPL-3.0-or-later",
        GPL.format(";", ";", "2.1").replace("This program", "This library").replace("GNU General Public License as", "GNU Lesser General Public License as"): "LGPL-2.1-or-later",
        "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.": "ISC",
        "                                 Apache License\n                           Version 2.0, January 2004": "Apache-2.0",
        "This is free and unencumbered software released into the public domain.": "Unlicense",
        "Distributed under the Boost Software License, Version 1.0.": "BSL-1.0",
        "Available under CC0 1.0.": "CC0-1.0",
    }
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "doc_id long, text string")
    assert [r["licenses"] for r in licenses.scan(docs).orderBy("doc_id").collect()] == list(cases.values())
    fired = spark.createDataFrame([(i, " ".join(rule)) for i, (_, _, rule) in enumerate(licenses.RULES)], "doc_id long, ids string").collect()
    texts = {k: s for k, s in reversed(licenses.SENTENCES)}
    each = spark.createDataFrame([(r["doc_id"], "\n".join(texts[k] for k in r["ids"].split())) for r in fired if all(k in texts for k in r["ids"].split())], "doc_id long, text string")
    assert each.count() == len(licenses.RULES)
    for r in licenses.scan(each).collect():
        assert licenses.RULES[r["doc_id"]][0] in r["licenses"].split(",")


def test_small_sets_at_the_threshold_are_candidates():
    """100,000 pairs of 3 to 40 shingles with a Jaccard index of exactly 0.75: each shares a band, and none is dropped by its estimate."""
    r = np.random.default_rng(11)
    shapes = [(3 * k, a, k - a) for k in range(1, 11) for a in (k, k - k // 2)]  # shared, only here, only there
    lost = 0
    for n in range(100_000):
        c, a, b = shapes[n % len(shapes)]
        h = r.integers(0, 2**64, size=c + a + b, dtype=np.uint64)
        x, y = np.sort(h[: c + a]), np.sort(np.concatenate([h[:c], h[c + a :]]))
        same = minhash.registers(x) == minhash.registers(y)
        met = same.reshape(-1, minhash.ROWS).all(1).any() or (minhash.second(x) == minhash.second(y)).reshape(-1, minhash.ROWS).all(1).any()
        lost += not met or (min(len(x), len(y)) >= minhash.TINY and minhash.estimate(same.sum()) < minhash.LEAST)
    assert lost == 0
