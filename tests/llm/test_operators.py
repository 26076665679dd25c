"""Each operator of the subpackage against brute force or an exact round trip, and its defined results for odd inputs."""

import hashlib
import os
import random
import re
import struct
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from scanweave.llm import bpe, chat, components, decontaminate, licenses, lines, quality, queries, simhash, suffixes, tiff, toxicity

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(rb"[0-9a-z_\x80-\xff]+")
SCHEMA = "doc_id long, text string, source string, fp string, hash int, n int, id string, line string, word string"


def frame(spark, rows):
    """Documents with columns whose names the operators use inside."""
    full = [(i, t, s, "x", 1, 2, "y", "z", "w") for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["th", "er", "on", "an", "ing", "ou", "re"]) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, a repeated id, ties."""
    long = words(1, 30_000)
    rows = [(1, "The same text here. " * 15, "a"), (1, "The same text here. " * 15, "a"), (2, None, "b"), (None, "no id " * 50, None), (3, "", "a"), (4, long, "c"), (4, "other", "d"), (5, "  \n\t ", "a")]
    return frame(spark, rows)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def all_texts(df):
    return [(r["doc_id"], r["text"] or "") for r in df.collect()]


# Components and SimHash


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, k) for k in range(101, 130)] + [(7, 7), (3, 4)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == dict.fromkeys(range(21), 0) | dict.fromkeys(range(100, 130), 100)
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def reference_fingerprint(text):
    own = [w for w in re.split(r"[\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in text)) if w]
    shingles = [" ".join(own[i : i + 3]) for i in range(max(1, len(own) - 2))] if own else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reference_components(fps):
    """(doc_id, fingerprint) pairs to the least id reachable, by comparing all pairs."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 2:
                root[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            best[find(i)] = min(d, best.get(find(i), d))
    return [best.get(find(i)) for i in range(len(fps))]


def test_simhash_equals_brute_force(spark, documents, odd):
    for df in (documents, odd):
        fps = [(d, reference_fingerprint(t)) for d, t in all_texts(df)]
        want = sorted(((d, f"{fp:016x}", c) for (d, fp), c in zip(fps, reference_components(fps), strict=True)), key=str)
        got = simhash.near_duplicates(df).select("doc_id", "fingerprint", "component_id").collect()
        assert sorted(map(tuple, got), key=str) == want


@pytest.mark.parametrize("most", [1, 16])
def test_links_of_small_and_large_buckets_give_the_same_components(spark, most, monkeypatch):
    monkeypatch.setattr(simhash, "PAIRS_UP_TO", most)
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(6)]
    fps = sorted({b ^ sum(1 << r.randrange(64) for _ in range(r.randint(0, 3))) for b in base for _ in range(25)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    comps = {x["node"]: x["root"] for x in components.connected_components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))).collect()}
    want = reference_components(list(zip(range(len(fps)), fps, strict=True)))
    got = [comps.get(s, s) for s in signed]
    assert len(set(got)) == len(set(want)) == len(set(zip(got, want, strict=True)))


def test_one_document_of_each_group_stays(spark, odd):
    kept = sorted((r["doc_id"] or 0, (r["text"] or "")[:5]) for r in simhash.representatives(odd).collect())
    assert [k for k, _ in kept].count(1) == 1 and (2, "") in kept and not any(k in (3, 5) for k, _ in kept)
    assert simhash.representatives(odd.limit(0)).count() == 0 and simhash.representatives(odd).columns == odd.columns


# Line dedup


def test_line_dedup_equals_sql_by_both_ways(spark, documents):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF_DIR}/documents.parquet'")
    want = sorted(duck.sql(lines.ORACLE).fetchall())
    for limit in (0, 1000):
        out = lines.line_dedup(documents, shared_lines=limit)
        got = out.select("doc_id", "__lines", "__removed", F.sha2(F.coalesce("text", F.lit("")), 256))
        assert sorted(map(tuple, got.collect())) == want


def test_line_dedup_of_odd_rows(spark, odd):
    boiler = "Read our terms."
    rows = [(10 + i, f"{words(i, 30)}\n{boiler}\n\n{words(50 + i, 30)}", f"s{i}") for i in range(9)] + [(90, boiler, "s1"), (91, None, "s2"), (92, f"{boiler}\n{words(3, 30)}", None)]
    for limit in (0, 1000):
        got = {r["doc_id"]: r for r in lines.line_dedup(frame(spark, rows), shared_lines=limit).collect()}
        assert all(got[10 + i]["__removed"] == 1 and boiler not in got[10 + i]["text"] for i in range(9))
        assert got[90]["text"] == boiler and got[91]["text"] is None and got[91]["__lines"] == 0 and got[92]["__removed"] == 1
        assert lines.line_dedup(odd, shared_lines=limit).count() == 8 and lines.line_dedup(odd.limit(0), shared_lines=limit).count() == 0


def test_near_threshold_lines_are_counted_exactly(spark):
    rows = [(i, f"line {n}\nown {i}", f"s{k}") for n in (7, 8, 30) for k in range(n) for i in [1000 * n + k]]
    own = spark.createDataFrame([(str(i), 0, s, t) for i, t, s in rows], "doc_id string, text_hash long, site string, text string")
    found = lines.spread_lines(lines._lines(own), 8)
    hashes = {r["line_hash"] for r in found.collect()}
    want = {r["h"] for r in spark.createDataFrame([("line 8",), ("line 30",)], "l string").select(F.xxhash64("l").alias("h")).collect()}
    assert hashes == want


# Quality


def test_resampling_keeps_good_and_drops_junk(spark, documents):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    kept = {r["doc_id"] for r in quality.resample(documents, labels).collect()}
    known = labels.filter("quality IS NOT NULL").collect()
    good, bad = ({r["doc_id"] for r in known if r["quality"] == q} for q in (1, 0))
    assert len(good - kept) <= 0.02 * len(good) and len(bad & kept) <= 0.1 * len(bad)
    assert {r["doc_id"] for r in quality.sampled_documents(documents, labels).collect()} == kept


def test_resampling_of_odd_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.resample(odd, none).count() == 8 and quality.resample(odd.limit(0), none).count() == 0
    labels = spark.createDataFrame([(4, 1), (None, 1), (1, None), (99, 1)], "doc_id long, quality int")
    assert quality.sampled_documents(odd, labels).columns == odd.columns


@pytest.mark.parametrize("k", [1, 500, 999, 1000])
def test_kth_largest(spark, k):
    values = [random.Random(k).gauss(0, 1) for _ in range(900)] + [0.5] * 100
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert quality.kth_largest(df, "v", k, bins=8, exact_below=5) == sorted(values, reverse=True)[k - 1]


# Decontamination


def reference_overlaps(docs, items):
    out = set()
    for d, text in docs:
        tokens = WORD.findall(text.lower().encode())
        for i, own in items:
            item = WORD.findall(own.lower().encode())
            if not item:
                continue
            width = min(13, len(item))
            need = -(-width * 8 // 10)
            for shift in range(-len(item), len(tokens)):
                equal = [0 <= shift + q < len(tokens) and tokens[shift + q] == item[q] for q in range(len(item))]
                if sum(equal) >= need and any(sum(equal[q : q + width]) >= need for q in range(len(item) - width + 1)):
                    out.add((d, i))
                    break
    return out


def test_decontamination_equals_brute_force(spark):
    items = [(i, words(100 + i, 12 + 5 * i)) for i in range(5)] + [(9, "too short"), (None, words(300, 20)), (10, None), (11, "")]
    r = random.Random(2)
    docs = []
    for d in range(40):
        passage = items[d % 5][1].split(" ")
        for _ in range(len(passage) * (d % 4) // 12):
            passage[r.randrange(len(passage))] = "zzz"
        docs.append((d, f"{words(d, 40)} {' '.join(passage).upper()}, {words(500 + d, 40)}", "a"))
    docs += [(90, words(7, 200), "a"), (91, None, "b"), (None, items[2][1], "c"), (92, "", "a")]
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, hash int")
    df = frame(spark, docs)
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.contaminated(df, benchmark).collect()}
    want = reference_overlaps([(d, t or "") for d, t, _ in docs], [(i, t or "") for i, t in items])
    assert got == want and (None, 2) in got
    left = {x["doc_id"] for x in decontaminate.clean_documents(df, benchmark).collect()}
    assert left == {d for d, _, _ in docs} - {d for d, _ in got if d is not None}
    assert decontaminate.contaminated(df.limit(0), benchmark).count() == 0 and decontaminate.contaminated(df, benchmark.limit(0)).count() == 0


# BPE


@pytest.mark.parametrize("limits", [{"chars": 1}, {"chars": 2000, "places": 2}, {}])
def test_bpe_equals_the_tokenizers_library(spark, odd, limits):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    strange = ["It's <|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", "İSTANBUL ΣΑΣ é Å ... ,. a., b.. 3.5, x\x1cy z w\r\nq\tr", "Ünï, cödé. 漢字😀", "you'll we're,"]
    df = odd.unionByName(frame(spark, [(100 + i, t, "a") for i, t in enumerate(strange)]))
    got = sorted(map(tuple, bpe.round_trip(df, path, bpe.pieces(spark, path), **limits).collect()), key=str)
    want = []
    for d, t in all_texts(df):
        ids = library.encode(t, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    encoded = bpe.encode(df, path, **limits)
    decoded = bpe.decode(encoded, bpe.pieces(spark, path))
    assert {hashlib.sha256(r["decoded"].encode()).hexdigest() for r in decoded.collect()} == {w[3] for w in want}


def test_bpe_of_an_empty_table(spark, odd):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    assert bpe.round_trip(odd.limit(0), path, bpe.pieces(spark, path)).count() == 0
    ids = spark.createDataFrame([([320, 99_999_999],), (None,), ([],)], "ids array<int>")
    assert [r["decoded"] for r in bpe.decode(ids, bpe.pieces(spark, path)).collect()] == ["a</w>", "", ""]


# TIFF


@pytest.mark.parametrize("data", [b"", b"a", b"aaaa" * 5000, bytes(range(256)) * 300, os.urandom(70_000), b"ab" * 3])
def test_codecs_round_trip(data):
    assert tiff.unlzw(tiff.lzw(data), len(data)) == data
    assert tiff.unpackbits(tiff.packbits(data), len(data)) == data


def test_every_form_is_read_back():
    seen = set()
    for k in range(60):
        payload = (words(k, 200) * (1 + k % 40)).encode()[: 576 * 200]
        payload += b"\xff" * (-len(payload) % 576)
        pages = tiff.read(tiff.store(payload, page_rows=100))
        assert b"".join(p["pixels"] for p in pages) == payload and [p["page"] for p in pages] == list(range(len(pages)))
        seen |= {(p["compression"], p["predictor"], p["tiled"]) for p in pages}
    assert seen == set(tiff.FORMS)


def test_big_endian_sixteen_bit_predictor_and_damage():
    rows = np.array([[1, 500, 499, 70], [9, 9, 9, 60_000]], dtype=">u2")
    diff = rows.astype(np.uint16).copy()
    diff[:, 1:] -= rows[:, :-1].astype(np.uint16)
    strip = zlib.compress(diff.astype(">u2").tobytes())
    tags = [(256, 3, 1, 4 << 16), (257, 3, 1, 2 << 16), (258, 3, 1, 16 << 16), (259, 3, 1, 8 << 16), (273, 4, 1, 8), (277, 3, 1, 1 << 16), (278, 3, 1, 2 << 16), (279, 4, 1, len(strip)), (317, 3, 1, 2 << 16)]
    at = 8 + len(strip)
    data = b"MM\0*" + struct.pack(">I", at) + strip + struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHII", *x) for x in tags) + b"\0\0\0\0"
    page = tiff.read(data)[0]
    assert page["pixels"] == rows.tobytes() and (page["width"], page["height"], page["bits"]) == (4, 2, 16)
    assert all(tiff.read(d)[-1]["error"] for d in (b"", b"JUNK0000", data[:-20], data[:8] + b"\0" * 9 + data[17:]))


def test_media_of_odd_rows(spark, odd):
    rows = tiff.payload_digests(tiff.stored(odd)).collect()
    want = []
    for d, t in all_texts(odd):
        raw = t.encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        want.append((d, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
    assert sorted([tuple(r)[:5] for r in rows], key=str) == sorted(want, key=str)
    assert tiff.payload_digests(tiff.stored(odd.limit(0))).count() == 0
    media = spark.createDataFrame([(1, None), (2, bytearray(b"no")), (3, bytearray(tiff.store(b"a" * 576)))], "doc_id long, media binary")
    pages = {r["doc_id"]: r for r in tiff.pages(media).collect()}
    assert set(pages) == {2, 3} and pages[2]["error"] and bytes(pages[3]["pixels"]) == b"a" * 576


# Suffix arrays


def test_suffix_dedup_equals_brute_force(spark, documents, odd):
    shared = words(77, 60)
    more = [(200 + i, f"{words(i, 30)} {shared[: 190 + 5 * i]} {words(90 + i, 30)}", "a") for i in range(8)]
    more += [(300, "ab" * 400, "a"), (301, "x" * 700, "a"), (302, "x" * 199, "b"), (303, f"\0{'y' * 300}\0{'y' * 300}é", "b")]
    for df, groups in ((documents, 20_000), (odd.unionByName(frame(spark, more)), 20_000), (odd.unionByName(frame(spark, more)), 1)):
        got = suffixes.suffix_dedup(df, group_contexts=groups).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
        own = all_texts(df)
        want = [(d, len(t.encode()), *b) for (d, t), b in zip(own, suffixes.brute_force([t.encode() for _, t in own]), strict=True)]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert suffixes.suffix_dedup(odd.limit(0)).count() == 0


def test_suffix_order_is_sorted():
    r = random.Random(5)
    text = np.array([r.choice([1, 2, 3]) for _ in range(300)] + [0], dtype=np.int16)
    order = suffixes.suffix_order(text, np.ones(len(text), dtype=bool), 400)
    assert order.tolist() == sorted(range(301), key=lambda i: text[i:].tolist())


# Toxicity


def test_toxicity_learns_and_holds_out(spark, documents):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    model = toxicity.fit(documents, labels)
    scored = {r["doc_id"]: r for r in model.score(documents).collect()}
    known = [r for r in labels.collect() if r["toxic"] is not None]
    hit = [scored[r["doc_id"]]["predicted"] == r["toxic"] for r in known]
    assert np.mean(hit) > 0.9 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in scored.values())
    again = {r["doc_id"]: r["score"] for r in toxicity.fit(documents, flipped).score(documents).collect()}
    assert all(abs(again[d] - r["score"]) < 1e-9 for d, r in scored.items())


def test_toxicity_of_odd_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] for r in toxicity.fit(odd, none).score(odd).collect()] == [0.0] * 8
    assert toxicity.fit(odd.limit(0), none).score(odd.limit(0)).count() == 0
    f = toxicity.features("", {}, {})
    assert len(f) == len(toxicity.NAMES) and all(np.isfinite(f))
    assert toxicity.plain("1d10t!") == "idiot" and toxicity.plain("i.d.i.o.t") == "idiot" and toxicity.plain("2024") == ""


# Chat


def test_layouts_become_turns(spark):
    two = [("user", "hi"), ("assistant", "yo")]
    records = {
        '{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":"yo"}]}': two,
        '{"conversations":[{"from":"human","value":"hi"},{"from":"gpt","value":"yo"}]}': two,
        '{"prompt":"hi","completion":"yo"}': two, '{"instruction":"hi","input":"there","output":"yo"}': [("user", "hi\n\nthere"), ("assistant", "yo")],
        '{"system":"be","prompt":"hi","response":"yo"}': [("system", "be"), *two], '{"text":"hi","role":null}': [("", "hi")],
        '{"question":"hi","answer":null}': [("user", "hi"), ("assistant", "")], '{"a":1}': [(None, None)], "not json": [(None, None)], None: [(None, None)], "[]": [(None, None)],
    }
    df = spark.createDataFrame([(i, r, 1) for i, r in enumerate(records)], "k long, record string, role int")
    got = {}
    for r in sorted(chat.canonical_turns(df, ("k",)).collect(), key=lambda r: (r["k"], r["part"])):
        got.setdefault(r["k"], []).append((r["role"], r["text"]))
    assert [got[i] for i in range(len(records))] == list(records.values())
    assert chat.canonical_turns(df.limit(0), ("k",)).count() == 0


def test_formatting_is_reversible(spark):
    texts = ["", "\\", "\\\\<|end|>", "<|turn|>x<|body|><|en\\d|>", "</s>[INST] ok [/INST]", "<<SYS>>\n<</SYS>>", "a\\<s>", "😀<|im_end|>é"]
    rows = [(1, i, r, t) for i, t in enumerate(texts) for r in ["assistant" if i % 2 else "us<|body|>er\n"]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(0))
    out = chat.parsed(chat.formatted(df)).orderBy("turn").collect()
    assert [(r["role"], r["text"]) for r in out] == [(r, t) for _, _, r, t in rows]
    assert [r["loss_text"] for r in out] == [t if i % 2 else None for i, t in enumerate(texts)]


def test_conversations_of_odd_rows(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", None), (1, 1, "assistant", "b"), (None, 0, None, "x"), (2, None, "system", ""), (2, 5, "assistant", "z")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, record int").repartition(3)
    got = {r["conv_id"]: r for r in chat.conversation_digests(chat.formatted(chat.canonical_turns(chat.turn_records(df), ("conv_id", "turn")))).collect()}
    want = hashlib.sha256(b"user\nq\nassistant\n\nassistant\nb\n").hexdigest()
    assert got[1]["turns_sha256"] == want and got[1]["loss_chars"] == 1 and got[None]["n_turns"] == 1 and got[2]["n_turns"] == 2


def test_chat_query_reads_back_every_conversation(spark):
    conv = {}
    for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").collect():
        conv.setdefault(r["conv_id"], []).append((r["turn"], r["role"] or "", r["text"] or ""))
    said = "</s>[INST] ok [/INST]"
    conv[-1] = [(0, "user", said), (1, "assistant", said)]
    for r in queries.op9_chat_format(spark, SF_DIR).collect():
        turns = sorted(conv.pop(r["conv_id"]))
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in turns).encode()).hexdigest()
        assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert not conv


# Licences


def test_notices_are_found_and_ordinary_text_is_not(spark, odd):
    notices = {
        "mit": "Released under the MIT License.", "gpl": "This work is licensed under the GNU General Public License, version 3.",
        "apache": "Licensed under the Apache License, Version 2.0.", "cc-by-nc": "Licensed under CC BY-NC 4.0.", "proprietary": "All rights reserved.",
    }
    rows = [(1000 + i, f"{words(i, 40)}\n{n}\n{words(60 + i, 40)}", "a") for i, n in enumerate(notices.values())]
    df = odd.unionByName(frame(spark, [*rows, (2000, "The library is free and the public may use it.", "a")]))
    got = {r["doc_id"]: r for r in licenses.licenses(df).collect() if r["doc_id"] is not None and r["doc_id"] >= 1000}
    assert [got[1000 + i]["family"] for i in range(len(notices))] == list(notices) and got[2000]["family"] == "none"
    assert licenses.licenses(df).count() == df.count() and licenses.licenses(odd.limit(0)).count() == 0


# Resampling against a version by hand


def test_resampling_equals_brute_force(spark, documents):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    rows = all_texts(documents)
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1}
    counts = np.zeros((2, quality.BUCKETS))
    found = [quality.ngram_buckets(t.encode()) for _, t in rows]
    for (d, _), at in zip(rows, found, strict=True):
        np.add.at(counts[1], at, 1)
        if d in good:
            np.add.at(counts[0], at, 1)
    expected = counts[1] * counts[0].sum() / counts[1].sum()
    p = (counts[0] + quality.PRIOR) / (counts[0] + quality.PRIOR).sum()
    q = (expected + quality.PRIOR) / (expected + quality.PRIOR).sum()
    weights = [float(np.log(p / q)[at].sum()) for at in found]

    def gumbel(d, text):
        buffer = d & (1 << 64) - 1, zlib.crc32(text.encode()), quality.SEED
        h = 42
        for value, size in zip(buffer, (8, 8, 4), strict=True):
            h = xxhash.xxh64_intdigest(value.to_bytes(size, "little"), h)
        h = (h - (1 << 64) if h >> 63 else h) % (1 << 52)
        return -np.log(-np.log((h + 0.5) / (1 << 52)))

    keys = sorted(((w + gumbel(d, t), d) for w, (d, t) in zip(weights, rows, strict=True)), reverse=True)
    for share in (0.1, 0.5, 0.87):
        k = -int(-share * len(rows) // 1)
        got = {r["doc_id"]: r for r in quality.resample(documents, labels, share=share).collect()}
        assert {d for key, d in keys if key >= keys[k - 1][0] - 1e-9} == set(got)
        assert all(abs(got[d]["gumbel_key"] - key) < 1e-6 for key, d in keys[:k])
