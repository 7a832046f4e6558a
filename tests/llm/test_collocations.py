import random
import re
from collections import Counter, defaultdict

import pytest

from daymosaic.llm import collocations as C

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def brute(docs, least, first=2000, longest=5):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(str.maketrans(UPPER, LOWER))):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f[lang].update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    out = set()
    for lang, count in f.items():
        many = {p: a for p, a in count.items() if a >= least}
        rows = []
        for p, a in many.items():
            inside = (q for q in many if len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q))))
            if len(p) < 2 or any(100 * many[q] >= 100 * a for q in inside):
                continue
            cuts = [(1000 * a * n[lang] // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for rank, (s, a, p, x, y) in enumerate(sorted(rows)[:first], 1):
            out.add((lang, rank, p.decode(), -a, x, y, n[lang], -s))
    return out


def made(seed, vocabulary=12, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["É", "é", "THE", "the", " x", "\x00", "a\x1cb"]
    word = lambda: rng.choice(words)
    parts = [" ".join(word() for _ in range(rng.randint(2, 8))) for _ in range(5)]
    docs = []
    for _ in range(n):
        t = "".join(rng.choice([word(), rng.choice(parts)]) + rng.choice([" ", " ", "\t", "  ", ", ", "\n", "\r", "."])
                    for _ in range(rng.randint(0, 40)))
        docs.append((rng.choice(["en", "de", None, "und", ""]), t))
    return docs + [("en", None), ("en", ""), (None, "  "), ("fr", ". , !"), ("x", "same " * 900)]


@pytest.mark.parametrize("seed,held,hot,vocabulary", [(1, 4_000_000, 1e-4, 12), (2, 50, 1e-4, 12), (3, 300, 1.0, 40), (4, 1, 0.05, 3)])
def test_equals_brute_force(spark, monkeypatch, seed, held, hot, vocabulary):
    monkeypatch.setattr(C, "HELD", held)
    monkeypatch.setattr(C, "HOT", hot)
    docs = made(seed, vocabulary)
    df = spark.createDataFrame([(*d, 1, "p") for d in docs], "lang string, text string, n int, phrase string").repartition(4)
    got = {tuple(r) for r in C.collocations(df, least=4).collect()}
    assert got == brute(docs, 4) and got


def test_first_rows_and_longest(spark, monkeypatch):
    monkeypatch.setattr(C, "RANKED", 3)
    docs = made(7)
    df = spark.createDataFrame(docs, "lang string, text string").repartition(4)
    assert {tuple(r) for r in C.collocations(df, least=3, first=7, longest=3).collect()} == brute(docs, 3, 7, 3)


def test_products_above_64_bits_are_exact(spark):
    known = spark.createDataFrame([("e", "a b", 2, 10 ** 12 + 7, 0), ("e", "a", 1, 3 * 10 ** 12 + 1, 0), ("e", "b", 1, 10 ** 12 + 9, 0)],
                                  "lang string, phrase string, m int, a long, top long")
    sizes = spark.createDataFrame([("e", 10 ** 14 + 3)], "lang string, n long")
    old, C.phrases = C.phrases, lambda *a: (known, sizes)
    try:
        got = C.collocations(known.withColumn("text", known.phrase)).first()
    finally:
        C.phrases = old
    assert got["score"] == 1000 * (10 ** 12 + 7) * (10 ** 14 + 3) // ((3 * 10 ** 12 + 1) * (10 ** 12 + 9))


def test_empty_and_rare(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert C.collocations(empty).count() == 0
    few = spark.createDataFrame([("en", "one two three")] * 99, "lang string, text string")
    assert C.collocations(few).count() == 0
    assert [r["phrase"] for r in C.collocations(few, least=99).collect()] == ["one two three"]
