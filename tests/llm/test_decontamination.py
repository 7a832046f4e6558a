import random
import re

import pytest

from daymosaic.llm import decontamination as D


def plain_score(a, b):
    """Smith-Waterman cell by cell."""
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_equals_cell_by_cell():
    import numpy as np
    rng = random.Random(1)
    for _ in range(200):
        a = [rng.randrange(1, 6) for _ in range(rng.randint(1, 12))]
        b = [rng.randrange(1, 6) for _ in range(rng.randint(1, 20))]
        s, i, j = D.align(np.array(a), np.array(b))
        assert s == plain_score(a, b)
        assert not s or plain_score(a, b[i:j]) == s


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[at] = "changed"
        elif kind == 1:
            words.insert(at, "added")
        else:
            del words[at]
    return words


def made(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "a"]) if rng.random() < 0.4 else f"w{rng.randrange(4000)}"
    items = [(i, [word() for _ in range(rng.randint(15, 50))]) for i in range(30)]
    docs = []
    for i in range(150):
        ws = [word() for _ in range(rng.randint(20, 200))]
        if i % 2:
            _, item = rng.choice(items)
            at = rng.randrange(len(ws))
            ws[at:at] = edited(rng, item, rng.choice([0, 0, 1, 3]))
        docs.append((i, " ".join(ws).capitalize() + "."))
    docs += [(1000 + i, " ".join(["Intro,"] + [w.upper() for w in items[0][1]])) for i in range(200)]  # a hot item
    return docs, [(i, " ".join(ws)) for i, ws in items]


@pytest.mark.parametrize("block", [20_000, 7])
def test_equals_aligning_everything(spark, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK", block)
    docs, items = made(2)
    df = spark.createDataFrame([(*d, 9) for d in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([*items, (98, None), (99, "too short")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in D.contaminated(df, bench).collect()}
    split = lambda t: re.findall(r"[^\W_]+", t.lower())
    want = {(d, i) for d, t in docs for i, s in items
            if len(set(split(s)) & set(split(t))) and plain_score(split(s), split(t)) / (2 * len(split(s))) >= D.THRESHOLD}
    assert set(got) == want and len(want) > 250
    for (d, i), r in got.items():
        assert 0 <= r["start"] < r["end"] <= len(dict(docs)[d])


def test_query_finds_every_exact_copy(spark):
    from daymosaic.llm.suite import QUERIES
    d = "/root/testdata/sf0.01"
    split = lambda t: re.findall(r"[^\W_]+", t.lower())
    docs = {r["doc_id"]: " " + " ".join(split(r["text"])) + " " for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    items = {r["item_id"]: " " + " ".join(split(r["text"])) + " " for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()}
    want = {(i, k) for i, t in docs.items() for k, s in items.items() if s in t}
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in QUERIES["op3_decontamination"](spark, d).collect()}
    assert want and want <= set(got) and all(got[x] == 1.0 for x in want)


def test_nulls_repeats_and_empty_tables(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    df = spark.createDataFrame([(None, "alpha beta gamma delta"), (1, None), (2, "alpha beta gamma delta"),
                                (2, "alpha beta gamma delta"), (3, "İ " * 9 + "alpha beta gamma delta")], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in D.contaminated(df, bench).collect()) == ["2", "2", "3", "None"]
    assert sorted(str(r["doc_id"]) for r in D.clean(df, bench).collect()) == ["1", "None"]
    assert D.contaminated(df.limit(0), bench).count() == 0 and D.contaminated(df, bench.limit(0)).count() == 0
