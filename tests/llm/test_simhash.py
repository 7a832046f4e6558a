import random
import re

import numpy as np
import pytest
import xxhash

from daymosaic.llm import simhash as S


def plain_fp(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    if not words:
        return 0
    sh = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64(s, seed=42).intdigest() for s in sh]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hs) > len(hs))


def plain_components(rows, bits=2):
    """rows: (id, fp); every pair."""
    up = {f: f for _, f in rows}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f
    fps = sorted(up)
    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if (a ^ b).bit_count() <= bits:
                up[max(root(a), root(b))] = min(root(a), root(b))
    low = {}
    for d, f in rows:
        if d is not None:
            low[root(f)] = min(low.get(root(f), d), d)
    return {(d, f"{f:016x}", low.get(root(f))) for d, f in rows}


def test_fingerprint_is_the_contract():
    for t in ["", None, "one", "Two words", "three Words here", "É A b c\x0bd", "a b c d e f " * 5000, "x\x1cy z w"]:
        assert S.fingerprint((t or "").encode().lower().split(), 3) == plain_fp(t)


def test_query_equals_all_pairs(spark):
    from daymosaic.llm.suite import QUERIES
    d = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], plain_fp(r["text"])) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = {tuple(r) for r in QUERIES["op4_simhash_dedup"](spark, d).collect()}
    assert got == plain_components(rows) and len({c for _, _, c in got}) < len(got)


@pytest.mark.parametrize("small", [False, True])
def test_crowded_fingerprints_lose_no_link(spark, monkeypatch, small):
    if small:  # many shards, deep trees, pairs of blocks
        for name, n in (("SAMPLE", 200), ("SHARD", 20), ("TASK", 120), ("BLOCK", 16)):
            monkeypatch.setattr(S, name, n)
    rng = random.Random(5)
    fps, centre = [], rng.getrandbits(64)
    for _ in range(300):
        fps.append(centre)
        for _ in range(rng.choice([0, 1, 2, 2, 3, 4])):
            fps[-1] ^= 1 << rng.randrange(64)
    fps += [rng.getrandbits(64) for _ in range(300)]
    fps += [f ^ (1 << rng.randrange(64)) for f in fps[300:400]]
    chain = rng.getrandbits(64)
    for i in range(40):
        chain ^= 3 << i
        fps.append(chain)
    x = np.array(fps, dtype=np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(f, i) for i, f in enumerate(x)], "fp long, first long").dropDuplicates(["fp"])
    got = S.components(S.stars(df, 2).selectExpr("fp a", "hub b")).collect()
    root = {r["node"]: r["root"] for r in got}
    mine = {}
    for f, u in zip(x, fps):
        mine.setdefault(root.get(f, f), set()).add(u)
    want = {}
    for _, f, c in plain_components(list(enumerate(fps))):
        want.setdefault(c, set()).add(int(f, 16))
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_long_paths_become_one_component(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 201), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in S.components(df).collect()}
    assert all(got[i] == 0 for i in range(101)) and got[201] == got[200] == 200


def test_settled_labels_are_not_stored_again(spark, monkeypatch):
    stored, materialise = [], S.materialise
    monkeypatch.setattr(S, "materialise", lambda df, label: stored.append(label) or materialise(df, label))
    star = spark.createDataFrame([(0, i) for i in range(1, 50)], "a long, b long")
    assert {r["root"] for r in S.components(star).collect()} == {0} and stored.count("labels") == 1
    path = spark.createDataFrame([(i, i + 1) for i in range(5)], "a long, b long")
    assert {r["root"] for r in S.components(path).collect()} == {0}
    assert stored.count("lows") == stored.count("labels")  # of each call one round less than the lows, and the first labels


def test_nulls_repeats_and_empty_table(spark):
    df = spark.createDataFrame([(5, None, "a"), (3, "", "b"), (4, " \n", "c"), (None, "one two", "d"), (9, "One two", "e"),
                                (9, "One two", "e")], "doc_id long, text string, fingerprint string")
    got = sorted(map(tuple, S.near_duplicates(df).collect()), key=str)
    assert {r[2] for r in got if r[1] == "0" * 16} == {3} and [r[2] for r in got if r[1] != "0" * 16] == [9, 9, 9]
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_layers_meet_apart(spark):
    """Fingerprints of one layer are linked as all pairs of it; equal distances across layers are not."""
    rng = np.random.default_rng(11)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = base ^ (np.uint64(1) << rng.integers(0, 63, 300).astype(np.uint64))
    rows = [(int(x.view(np.int64)), i % 3) for i, x in enumerate(base)]
    rows += [(int(x.view(np.int64)), i % 3 if i % 2 else (i + 1) % 3) for i, x in enumerate(near)]
    df = spark.createDataFrame(rows, "fp long, layer int").repartition(4)
    want = {tuple(sorted((rows[i][0], rows[300 + i][0]))) for i in range(300) if i % 2}
    for shard in (16, S.SHARD):
        got = S.stars(df, 1, layers=3, shard=shard).filter("fp <> hub").collect()
        assert {tuple(sorted((r["fp"], r["hub"]))) for r in got} == want
