import random
import re

import pytest

from daymosaic.llm import minhash as M


def grams(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(rows, percent=85):
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def up(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * len(a | sets[j]):
                root[up(i)] = up(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[up(k)] = min(i, least.get(up(k), i))
    return sorted(((i, len(s), c, i == c if c is not None and i is not None else c is None)
                   for k, ((i, _), s) in enumerate(zip(rows, sets)) for c in [least.get(up(k)) if s else i]), key=str)


def got(df, **kw):
    return sorted(map(tuple, M.near_duplicates(df, **kw).collect()), key=str)


def edited(rng, words, share, word):
    return [word() if rng.random() < share else w for w in words]


def made(seed, groups=8, alone=40):
    """Copies edited once or in a chain, members of a template that are not copies, shared passages, short texts."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    passage = [word() for _ in range(120)]
    texts = [[word() for _ in range(rng.randint(0, 300))] + passage * (i % 2) for i in range(alone)]
    for g in range(groups):
        base = [word() for _ in range(rng.choice([8, 30, 70, 150, 400]))]
        chain = base
        for k in range(rng.randint(2, 12)):
            chain = edited(rng, chain, 0.012, word)
            texts += [edited(rng, base, rng.choice([0.0, 0.01, 0.02, 0.03]), word), chain, base + [word()] * (k % 3)]
        texts += [edited(rng, base, 0.06, word) for _ in range(15)]
    texts += [["a"], ["A"], ["a", "b"], ["a", "b", "c", "d"], ["a", "b", "c", "d"], ["same"] * 400, ["same"] * 9, ["same"] * 5, ["same"] * 4]
    rows = [(rng.randrange(10 ** 6) * 1000 + i, (" " if i % 3 else "\n ").join(t)) for i, t in enumerate(texts)]
    return rows + [(5, None), (6, ""), (7, " \t"), (None, rows[0][1]), (None, "only here without an id"), (None, None), (3, rows[9][1]), (3, rows[9][1]),
                   (None, rows[60][1].upper())]


@pytest.mark.parametrize("seed,block,held,met", [(1, 4096, 1 << 22, 512), (2, 5, 300, 3), (3, 4096, 1 << 22, 1)])
def test_equals_all_pairs(spark, monkeypatch, seed, block, held, met):
    monkeypatch.setattr(M, "BLOCK", block)
    monkeypatch.setattr(M, "HELD", held)
    monkeypatch.setattr(M, "MET", met)
    rows = made(seed)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, node string").repartition(5)
    assert got(df) == brute(rows)


def test_copies_of_a_text_that_is_no_hub(spark):
    """Copies that are near a text in the middle only, among many of its kind."""
    rng = random.Random(5)
    word = lambda: f"v{rng.randrange(10 ** 6)}"
    base = [word() for _ in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 60):
        t = list(base)
        for at in range(i * 3 % 190, 200, 67):
            t[at] = word()
        rows.append((i, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(df) == brute(rows)


def test_sketches_overlap_as_they_must():
    assert M.least_overlap(64, 85) > 25
    rng = random.Random(1)
    hasher = M.Hasher()
    for _ in range(200):
        n = rng.randint(5, 600)
        a = [f"x{rng.randrange(10 ** 9)}".encode() for _ in range(n)]
        b = list(a)
        for i in rng.sample(range(n), max(1, n // 80)):
            b[i] = b"y%d" % rng.randrange(10 ** 9)
        x, y = (M.shingle_hashes(h[:, 0], 5, hasher) for h in M.words_hashed([b" ".join(a), b" ".join(b)]))
        both = len(set(x.tolist()) & set(y.tolist()))
        if 100 * both >= 85 * (len(x) + len(y) - both):
            must = min(-(-85 * len(x) // 100), M.least_overlap(M.KEPT, 85))
            assert len(set(x[:M.KEPT].tolist()) & set(y[:M.KEPT].tolist())) >= must


def test_query_equals_all_pairs_and_empty_table(spark):
    from daymosaic.llm.suite import QUERIES
    d = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    found = sorted(map(tuple, QUERIES["op12_minhash_dedup"](spark, d).collect()), key=str)
    assert found == brute(rows) and sum(not r[3] for r in found) > 10
    assert got(spark.createDataFrame([], "doc_id long, text string")) == []
