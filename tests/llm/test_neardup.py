"""The near-dedup stage against brute-force 5-word Jaccard similarity, and its rows of equal or missing ids."""

import random

import pytest

import corpus_pipeline
from scanweave.llm import neardup, simhash

SF_DIR = "/root/testdata/sf0.001"


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def groups(rows):
    """Brute force: the root of each row of (doc_id, text)."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both, any_ = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if (not any_ or 5 * both >= 4 * any_) and find(i) != find(j):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def wanted(rows):
    best = {}
    for g, (d, _) in zip(groups(rows), rows, strict=True):
        best[g] = min(best.get(g, d), d)
    return sorted(best.values())


def variants(n_copies, edits, seed=5, n_words=150):
    """Changed copies of one text, and other texts that share a passage with them."""
    r = random.Random(seed)
    base = [f"w{r.randrange(5000)}" for _ in range(n_words)]
    rows = []
    for _ in range(n_copies):
        own = list(base)
        for _ in range(r.randint(*edits)):
            own[r.randrange(n_words)] = f"x{r.randrange(10**6)}"
        rows.append(" ".join(own))
    rows += [" ".join([*base[:30], *(f"y{r.randrange(10**6)}" for _ in range(90))]) for _ in range(n_copies)]
    return list(enumerate(rows))


@pytest.mark.parametrize("most", [1, 16])
def test_changed_copies_equal_brute_force(spark, most, monkeypatch):
    monkeypatch.setattr(neardup.links, "__defaults__", (most,))
    rows = [(i, t) for k, e in enumerate([(1, 3), (2, 6), (5, 9)]) for i, t in ((1000 * k + i, t) for i, t in variants(40, e, seed=k))]
    got = neardup.representatives(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == wanted(rows)


def test_stage_equals_brute_force_on_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted(r["doc_id"] for r in neardup.representatives(docs).collect()) == wanted(rows)


def test_rows_are_told_apart_by_id_and_text(spark):
    a, b, c = ("alpha beta gamma delta " * 3 + "a", "one two three four five six seven", "uno dos tres cuatro cinco seis")
    rows = [(1, a), (1, b), (1, a), (2, a), (None, a), (None, c), (None, c)]
    got = neardup.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, a), (1, b), (None, c)], key=str)


def test_lines_that_share_too_little_are_not_paired(spark, monkeypatch):
    """Many texts with one line in common: their bands never meet, so no pair is verified; the copies among them are found."""
    monkeypatch.setattr(neardup.links, "__defaults__", (1,))
    verified = []
    monkeypatch.setattr(neardup, "_verify", lambda c, once, nodes, do=neardup._verify: verified.append(c.count()) or do(c, once, nodes))
    rows = [(i, f"the page you asked for was moved to {i % 1500}") for i in range(2000)]
    got = neardup.representatives(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(1500))
    assert sum(verified) == 0


def test_bands_that_meet_hold_every_possible_pair(spark):
    r = random.Random(11)
    rows = []
    for node in range(400):
        size = r.randint(1, 300)
        rows.append((node % 3, node, size, r.randint(0, size // 5)))
    banded = neardup._banded(spark.createDataFrame(rows, "key long, node long, size int, pos int")).collect()
    meeting = {(m["key"], m["band"], m["other"]) for m in neardup._meeting(spark.createDataFrame(banded)).collect()}
    for a in banded:
        for b in banded:
            if a["key"] == b["key"] and a["node"] != b["node"] and 9 * min(a["size"] - a["pos"], b["size"] - b["pos"]) >= 4 * (a["size"] + b["size"]):
                assert (a["key"], a["band"], b["band"]) in meeting


def test_the_pipelines_stage_starts_from_simhash(spark, monkeypatch):
    """SimHash's pairs are verified before the exact search, which meets only what they leave apart; the rows equal brute force."""
    called, verified = [], []
    monkeypatch.setattr(simhash, "candidates", lambda *tables, do=simhash.candidates: called.append(do(*tables)) or called[-1])
    monkeypatch.setattr(neardup, "_verify", lambda c, once, nodes, do=neardup._verify: verified.append({(r["u"], r["v"]) for r in c.collect()}) or do(c, once, nodes))
    r = random.Random(3)
    base = [[f"w{r.randrange(10**6)}" for _ in range(600)] for _ in range(5)]
    copies = [(100 * k + i, " ".join([*words[:-1], f"x{i}"])) for k, words in enumerate(base) for i in range(6)]
    rows = [*copies, *((1000 + i, t) for i, t in variants(20, (1, 6)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(x["doc_id"] for x in corpus_pipeline.near_dedup_stage(spark, docs, SF_DIR).collect()) == wanted(rows)
    near = {(x["u"], x["v"]) for x in called[0].collect()}
    assert near and verified[0] == near and not any(near & later for later in verified[1:])
