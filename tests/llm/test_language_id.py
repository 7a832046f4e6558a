import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from daymosaic.llm import language_id as G

D = "/root/testdata/sf0.01"


def test_fusion_equals_the_formula_row_by_row(spark):
    docs, pages = (spark.read.parquet(f"{D}/{t}.parquet") for t in ("documents", "pages"))
    names, logs = G.fit(docs, "doc_id", "text", "lang")
    got = {r["doc_id"]: r for r in G.identify(docs, pages).collect()}
    extra = {r["doc"]: r for r in G.page_evidence(pages).collect()}
    rows = []
    for r in docs.collect():
        g, _ = G.trigrams([r["text"]])
        ll = logs.astype(np.float32)[g].sum(axis=0, dtype=np.float64) * (min(len(g), G.EVIDENCE) / max(1, len(g)))
        q = np.exp(ll - ll.max())
        e = extra.get(r["doc_id"])
        host = e["page_host"] if e else r["source"]
        parts = host.split(".")
        keys = (parts[-1], ".".join(parts[-2:]), host) if len(parts) > 1 else ("", host, host)
        rows.append((r["doc_id"], ll, q / q.sum(), e["page_declared"] if e else r["lang"], keys))
    by, said, total = defaultdict(float), defaultdict(float), sum(q for _, _, q, _, _ in rows)
    for _, _, q, d, (s, m, h) in rows:
        for key in ((s,), (s, m), (s, m, h)):
            by[key] = by[key] + q
        said[d] = said[d] + q
    root = total.copy()
    root[-1] = 0
    root = (1 - G.NONE_PRIOR) * (root + 1) / (root + 1).sum()
    root[-1] = G.NONE_PRIOR
    for i, ll, _, d, (s, m, h) in rows:
        p = root
        for key in ((s,), (s, m), (s, m, h)):
            p = (by[key] + G.UNITS * p) / (by[key].sum() + G.UNITS)
        x = ll + np.log(p) + np.log((said[d] + 0.5) / (total + 1))
        assert got[i]["language"] == names[int(x.argmax())]
        assert math.isclose(got[i]["posterior"], 1 / np.exp(x - x.max()).sum(), rel_tol=1e-4)


def test_known_languages_are_found_and_kept(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = G.identify(docs.withColumnRenamed("lang", "declared").withColumnRenamed("source", "host"), None, declared_col="declared",
                      host_col="host").collect()
    assert np.mean([r["language"] == truth[r["doc_id"]] for r in rows]) > 0.98
    assert np.mean([r["accepted"] for r in rows]) > 0.98


def test_evidence_decides_where_texts_do_not(spark):
    base = [(i, "the cat and the dog and the house", "en", "a.uk") for i in range(60)]
    base += [(100 + i, "der hund und die katze und das haus", "de", "b.de") for i in range(60)]
    odd = [(1000, "xq", None, "www.b.de"), (1001, "xq", None, "a.uk"), (1002, "", "de", "b.de"), (1003, None, None, None),
           (1004, "漢字仮名交" * 30, None, None), (None, "the cat and the dog", None, None), (1005, "der hund und die katze", "en", "a.uk")]
    df = spark.createDataFrame(base + odd, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: (r["language"], r["accepted"]) for r in G.identify(df).collect()}
    assert got[1000] == ("de", True) and got[1001] == ("en", True)   # an address suffix seen before
    assert got[1002] == ("de", False) and got[1003][1] is False      # no letters are not accepted
    assert got[1004] == ("und", False) and got[None] == ("en", True) and got[1005][0] == "de"


def test_trigrams_do_not_cross_texts():
    texts = ["", "a", "Ab c1d", "é" * 5, "!!", "long text " * 50]
    g, begin = G.trigrams(texts)
    for i, t in enumerate(texts):
        assert Counter(g[begin[i]:begin[i + 1]].tolist()) == Counter(G.trigrams([t])[0].tolist())


@pytest.mark.parametrize("rows", [[], [(1, None, None, None)], [(1, "x", "", ""), (1, "x", "", "")]])
def test_empty_and_null_tables(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert G.identify(df, spark.createDataFrame([], "page_id long, url string, html string")).count() == len(rows)


def test_a_small_language_is_a_class_in_any_table(spark, monkeypatch):
    monkeypatch.setattr(G, "SAMPLE", 200)
    monkeypatch.setattr(G, "SHARE", 0.05)
    monkeypatch.setattr(G, "HELD", 1)
    rows = [(i, "the man and the house of the dog with the cat", "en", None) for i in range(3000)]
    rows += [(3000 + i, "kuca pored reke gde zive ljudi i psi", "sr", None) for i in range(30)]
    rows += [(4000 + i, "zzz qqq", "odd", None) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert G.fit(docs, "doc_id", "text", "lang")[0] == ["en", "sr", G.UND]
    got = {r["doc_id"]: r for r in G.identify(docs).collect()}
    assert all(got[3000 + i]["language"] == "sr" and got[3000 + i]["accepted"] for i in range(30))
    assert all(got[i]["language"] == "en" for i in range(0, 3000, 100))
