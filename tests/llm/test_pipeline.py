import corpus_pipeline as C
import pytest

from daymosaic.llm import decontamination, language_id, secrets
from tests.llm.test_packing import checked

D = "/root/testdata/sf0.001"


def groups(texts):
    """The smallest id reachable over pairs whose sets of five-word shingles have a similarity of at least 0.8."""
    words = {i: (t or "").encode().lower().split() for i, t in texts.items()}
    sets = {i: {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    same = {}
    for i, s in sets.items():
        same.setdefault(frozenset(s), []).append(i)
    ids = [min(g) for g in same.values()]
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and root(i) != root(j) and (both := len(a & b)) / max(
                    1, len(a) + len(b) - both) >= 0.8:
                up[max(root(i), root(j))] = min(root(i), root(j))
    return {i: root(min(g)) for g in same.values() for i in g}


@pytest.mark.parametrize("folder", [D, "/root/testdata/sf0.01"])
def test_run_equals_the_stages_in_plain_python(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    pages, bench = spark.read.parquet(f"{folder}/pages.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ok = {r["doc_id"] for r in language_id.identify(docs, pages).collect() if r["accepted"]}
    texts = {i: t for i, t in texts.items() if i in ok}
    assert len(texts) > 0.95 * docs.count()
    least = groups(texts)
    texts = {i: t for i, t in texts.items() if least[i] == i}
    items = decontamination.Items([(r["item_id"], r["text"]) for r in bench.collect()], 3)
    every = {k * len(items.ids) + i for k, ps in enumerate(items.places) for i, _ in ps}
    texts = {i: t for i, t in texts.items() if not decontamination.search(t, items, every, decontamination.THRESHOLD)}
    texts = {i: secrets.redact(t, secrets.spans(t)) for i, t in texts.items()}
    checked(C.run(spark, folder).collect(), texts, 2048)


def test_stages_keep_columns_and_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = "the cat and the dog and the house of the man"
    rows = [(1, text, "en", "s", 5), (1, text, "en", "s", 5), (2, text, "en", "s", 5), (3, None, None, None, None),
            (None, text, "en", "s", 5), (4, "a man of the house and a cat token=abcdefgh", "en", None, None)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in C.STAGES[:-1]:
        docs = C.materialise(stage(spark, docs, D), name)
        assert docs.schema.simpleString() == spark.createDataFrame([], schema).schema.simpleString()
    got = sorted(map(tuple, docs.collect()), key=str)
    assert got == sorted([(1, text, "en", "s", 5), (None, text, "en", "s", 5),
                          (4, "a man of the house and a cat [assign]", "en", None, 37)], key=str)
    empty = spark.createDataFrame([], schema)
    for name, stage in C.STAGES:
        empty = C.materialise(stage(spark, empty, D), name)
        assert empty.count() == 0
