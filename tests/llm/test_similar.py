import random

import numpy as np
import pytest

from daymosaic.llm import simhash, similar


def jaccard(a, b, size=5):
    sets = [{tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10 ** 6)}"
    return words


def test_recall_and_precision_against_jaccard(spark):
    rng = random.Random(2)
    docs, pairs = [], []
    for i in range(150):
        a = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(150, 400))]
        b = edited(rng, a, rng.randint(0, 8))
        docs += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
        pairs.append((2 * i, 2 * i + 1, jaccard(" ".join(a), " ".join(b))))
    hub = [f"h{rng.randrange(3000)}" for _ in range(400)]
    docs += [(1000 + i, " ".join(edited(rng, hub, 3))) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in similar.near_copies(df).collect()}
    assert len(got) == len(docs)
    near = [(a, b) for a, b, j in pairs if j >= 0.8]
    assert sum(got[a] == got[b] for a, b in near) >= 0.9 * len(near) and len(near) > 60
    assert not [1 for a, b, j in pairs if j < 0.7 and got[a] == got[b]]
    assert sum(got[1000 + i] == got[1000] for i in range(200)) >= 198
    assert all(got[2 * i] == 2 * i for i in range(150))  # unrelated texts stay


def test_nulls_repeats_and_empty_table(spark):
    text = " ".join(f"x{i}" for i in range(50))
    df = spark.createDataFrame([(5, None), (3, ""), (4, " \n"), (None, text), (9, text), (8, text.upper()), (7, "short"), (9, text)],
                               "doc_id long, text string")
    got = sorted(map(tuple, similar.near_copies(df).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (4, 3), (None, 8), (9, 8), (9, 8), (8, 8), (7, 7)], key=str)
    kept = simhash.one_of_each(df, similar.near_copies(df)).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["3", "7", "8", "None"]
    assert similar.near_copies(df.limit(0)).count() == 0


def exact_components(texts):
    """Smallest id reachable over pairs of true Jaccard similarity 0.8 and more."""
    ids = sorted(texts)
    root = {i: i for i in ids}
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if jaccard(texts[a], texts[b]) >= 0.8]
    for _ in ids:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return root


def components_of(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    return {r["doc_id"]: r["component_id"] for r in similar.near_copies(df).collect()}


def test_decision_is_the_true_jaccard_near_the_bar(spark):
    rng = random.Random(5)
    texts = {}
    for i in range(250):
        a = [f"w{rng.randrange(10 ** 6)}" for _ in range(rng.choice([8, 12, 25, 60, 204]))]
        b = list(a)
        # a replaced last word changes one shingle, one in the middle up to five: similarities around 0.8, also on it
        n = max(1, round(len(a) * rng.uniform(0.05, 0.14)))
        b[-n:] = [f"v{rng.randrange(10 ** 6)}" for _ in range(n)]
        texts[2 * i], texts[2 * i + 1] = " ".join(a), " ".join(b)
    sims = [jaccard(texts[2 * i], texts[2 * i + 1]) for i in range(250)]
    assert sum(0.75 < s < 0.8 for s in sims) > 20 and sum(0.8 <= s < 0.85 for s in sims) > 20
    got = components_of(spark, texts)
    assert [got[2 * i] == got[2 * i + 1] for i in range(250)] == [s >= 0.8 for s in sims]


@pytest.mark.parametrize("held", [similar.HELD, 4000])
def test_pairs_in_a_template_group(spark, monkeypatch, held):
    monkeypatch.setattr(similar, "HELD", held)
    rng = random.Random(6)
    template = [f"t{i}" for i in range(300)]
    texts = {}
    for i in range(60):  # any two of different i share the template alone: 0.57
        a = template + [f"w{rng.randrange(10 ** 6)}" for _ in range(110)]
        texts[2 * i], texts[2 * i + 1] = " ".join(a), " ".join(edited(rng, a, 4))
    want = exact_components(texts)
    assert 0.5 < jaccard(texts[0], texts[2]) < 0.65
    assert sum(want[2 * i + 1] == 2 * i for i in range(60)) == 60
    assert components_of(spark, texts) == want


def test_components_are_joined_by_their_roots_alone(spark, monkeypatch):
    """The links between components go by the components' roots: what is joined already is not walked through again."""
    walked, components, first_links = [], simhash.components, similar.first_links

    def record(edges):
        found = components(edges)
        walked.append(([tuple(r) for r in edges.select("a", "b").collect()], {r["node"]: r["root"] for r in found.collect()}))
        return found
    monkeypatch.setattr(simhash, "components", record)
    monkeypatch.setattr(similar, "first_links", lambda *a: first_links(*a).filter("pmod(a, 4) = 0"))  # the others are left to find
    rng = random.Random(8)
    copied = [f"c{i}" for i in range(200)]
    texts = {i: " ".join(edited(rng, copied, 1)) for i in range(30)}
    texts |= {100 + i: f"apart {i} " + " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(90)) for i in range(20)}
    assert components_of(spark, texts) == exact_components(texts)
    _, (links, first), (more, _) = walked
    assert links and more and all(first.get(x, x) == x for pair in more for x in pair) and all(a != b for a, b in more)


def test_links_join_what_all_pairs_join():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 40, (5, 60))
    sets = [np.unique(np.concatenate([rng.permutation(base[k % 5])[:52], rng.integers(0, 1 << 40, 4)])) for k in range(50)]
    union, zero = simhash.Union(50), np.zeros(50, dtype=np.int64)
    for i in range(50):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if both / (len(sets[i]) + len(sets[j]) - both) >= 0.7:
                union.join(np.array([i]), np.array([j]))
    got = simhash.Union(50)
    got.join(*similar.links(sets, np.arange(50), zero, 0.7))
    assert got.roots().tolist() == union.roots().tolist() and len(set(union.roots())) < 50


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_tables_against_true_jaccard(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    ids = sorted(texts)
    words = {i: texts[i].encode().lower().split() for i in ids}
    sets = {i: {b" ".join(w[k:k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    root = {i: i for i in ids}
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if min(len(sets[a]), len(sets[b])) >= 0.8 * max(
        len(sets[a]), len(sets[b])) and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    for _ in ids:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert {r["doc_id"]: r["component_id"] for r in similar.near_copies(docs).collect()} == root


def test_candidates_meet_on_the_trees(spark, monkeypatch):
    """Equal samples have equal fingerprints, and what the trees join is compared, and nothing else."""
    a = np.arange(1, 400, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    one, two = (similar.sample_fingerprints(x, 4) for x in (a, np.concatenate([a[20:], a[:5] + np.uint64(1)])))
    assert len(one) == len(set(one.tolist())) == similar.LAYERS and 4 < (one == two).sum() < similar.LAYERS
    text = " ".join(f"x{i}" for i in range(60))
    df = spark.createDataFrame([(1, text), (2, text + " end"), (3, "some other words of a text")], "doc_id long, text string")
    calls, stars = [], simhash.stars
    monkeypatch.setattr(simhash, "stars", lambda *x: calls.append(x[1:]) or stars(*x))
    assert sorted(map(tuple, similar.near_copies(df).collect())) == [(1, 1), (2, 1), (3, 3)]
    assert calls == [(similar.RADIUS, similar.LAYERS, similar.SHARD)]
