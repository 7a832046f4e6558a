import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from daymosaic.llm import packing as K

QUICK = (P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def optimum(items, capacity):
    best = [len(items)]
    items = sorted(items, reverse=True)

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for r in {r for r in bins if r >= items[i]}:
            rest = list(bins)
            rest.remove(r)
            go(i + 1, [*rest, r - items[i]])
        go(i + 1, [*bins, capacity - items[i]])
    go(0, [])
    return best[0]


def test_plan_is_optimal_on_small_sets():
    rng = random.Random(3)
    for _ in range(300):
        capacity = rng.choice([10, 20, 50])
        hist = Counter(rng.randint(1, capacity) for _ in range(rng.randint(0, 11)))
        plan = K.complete(hist, capacity)
        used = Counter()
        for filling, m in plan:
            assert sum(l * k for l, k in filling) <= capacity
            for l, k in filling:
                used[l] += k * m
        assert used == hist
        assert sum(m for _, m in plan) == optimum(list(hist.elements()), capacity)


def test_large_histogram_meets_the_bound_closely():
    rng = random.Random(4)
    hist = Counter(rng.randint(1, 2048) for _ in range(20000))
    n = sum(m for _, m in K.complete(hist))
    assert K.lower_bound(hist, 2048) <= n <= sum(m for _, m in K.best_fit(hist, 2048))
    assert n <= K.lower_bound(hist, 2048) * 1.001 + 1


TEXTS = ["", None, "a  b", " a ", "a \n \nb", "it's <|endoftext|> x", "word " * 3000, "x" * 5000, " " * 700 + "y", "é ü ñ",
         "tokens, and tokens", "tokens, and tokens"] + ["alpha beta gamma " * n for n in range(1, 40)]


def checked(rows, texts, capacity):
    """The contract, with ids from tokenizers alone."""
    tok = Tokenizer.from_file(QUICK[0])
    places = {}
    for r in rows:
        ids = tok.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids + [0]
        cut = np.array(ids[r["start"]:r["start"] + r["length"]], dtype="<u4").tobytes()
        assert r["ids_crc32"] == zlib.crc32(cut)
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in places.values():
        at = 0
        for o, n in sorted(p):
            assert o == at
            at += n
        assert at <= capacity
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
    assert set(by) == set(texts)
    for doc, ps in by.items():
        n = len(tok.encode(texts[doc] or "", add_special_tokens=False).ids) + 1
        ps.sort()
        assert [p[0] for p in ps] == list(range(len(ps))) and sum(p[2] for p in ps) == n
        assert all(p[2] == capacity for p in ps[1:]) and [p[1] for p in ps] == [sum(q[2] for q in ps[:i]) for i in range(len(ps))]
    return len(places)


@pytest.mark.parametrize("tokenizer", [QUICK, QUICK[:1]])
def test_contract_on_odd_texts(spark, tokenizer):
    df = spark.createDataFrame([(i, t, "p", 1) for i, t in enumerate(TEXTS)],
                               "doc_id long, text string, piece string, length int").repartition(4)
    checked(K.best_fit_pack(df, tokenizer, 64).collect(), dict(enumerate(TEXTS)), 64)


def test_query_on_the_tables(spark):
    from daymosaic.llm.suite import QUERIES
    d = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = QUERIES["op6_best_fit_packing"](spark, d).collect()
    n = checked(rows, texts, 2048)
    assert n <= -(-sum(r["length"] for r in rows) // 2048) + 1


def test_sequences_hold_the_ids(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    packed = K.pack(K.materialise(K.pieces(df, QUICK, 64, with_ids=True), "pieces"), 64)
    seqs = {r["sequence_id"]: r["ids"] for r in K.sequences(packed).collect()}
    for r in packed.collect():
        assert seqs[r["sequence_id"]][r["offset"]:r["offset"] + r["length"]] == r["ids"]


def test_empty_table_null_ids_and_repeats(spark):
    assert K.best_fit_pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(None, "a"), (1, "b"), (1, "b")], "doc_id long, text string")
    rows = K.best_fit_pack(df).collect()
    assert len(rows) == 3 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 3
