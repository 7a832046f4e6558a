import hashlib
import random
import re

import pytest

from daymosaic.llm import substrings as S


def brute(docs, window):
    """Every window in document order."""
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in docs}
    seen, out = set(), set()
    for i in sorted(words):
        ws = words[i]
        gone = [False] * len(ws)
        for p in range(len(ws) - window + 1):
            key = tuple(ws[p:p + window])
            if key in seen:
                gone[p:p + window] = [True] * window
            seen.add(key)
        kept = " ".join(w for w, g in zip(ws, gone) if not g)
        out.add((i, len(ws), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def made(seed, n=60, vocabulary=3000):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary)}"
    shared = [[word() for _ in range(rng.randint(15, 70))] for _ in range(6)]
    docs = []
    for i in range(n):
        ws = [word() for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            a = rng.randint(0, 10)
            ws += p[a:] + [word() for _ in range(rng.randint(0, 5))]
        if i % 7 == 0:
            ws += ["a", "b"] * 30
        docs.append((rng.randrange(10 ** 6) * 100 + i, (" " if i % 2 else "\n").join(ws)))
    return docs + [(1, None), (2, ""), (3, docs[5][1]), (4, "é" + docs[6][1]), (5, "same " * 500)]


@pytest.mark.parametrize("seed,held,hot,vocabulary", [(1, 200_000, 1e-4, 3000), (2, 5, 1e-4, 3000), (3, 200_000, -1, 3000),
                                                    (4, 200_000, 1e-4, 2)])
def test_equals_all_windows(spark, monkeypatch, seed, held, hot, vocabulary):
    monkeypatch.setattr(S, "HELD", held)
    if hot < 0:  # every repeated anchor is dealt out by window
        monkeypatch.setattr(S, "HOT", 0)
        monkeypatch.setattr(S, "max", lambda *a: -1 if a == (1000, 0) else max(*a), raising=False)
    docs = made(seed, vocabulary=vocabulary)
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, n_words int").repartition(5)
    assert {tuple(r) for r in S.dedup(df).collect()} == brute(docs, 20)


def test_query_equals_all_windows_on_the_tables(spark):
    from daymosaic.llm.suite import QUERIES
    d = "/root/testdata/sf0.01"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = {tuple(r) for r in QUERIES["op7_substring_dedup"](spark, d).collect()}
    assert got == brute(docs, 20) and sum(r[2] for r in got) > 0


def test_nulls_repeats_and_empty_table(spark):
    text = " ".join(f"x{i}" for i in range(40))
    df = spark.createDataFrame([(None, text), (7, text), (7, text), (8, text)], "doc_id long, text string")
    got = sorted([(str(r["doc_id"]), r["n_removed"], r["text"]) for r in S.dedup(df, with_text=True).collect()])
    assert got == [("7", 0, text), ("7", 0, text), ("8", 40, ""), ("None", 0, text)]
    assert S.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
