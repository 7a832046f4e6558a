"""Language identification by Bayesian evidence fusion.

Log posterior = text likelihood (letter trigrams) + log P(declared language | language) + log prior of the host. Priors are
smoothed along global, address suffix, registered domain, host: each level adds its expected counts to a few units of the level
above. Expected counts are grouped sums of the texts' own posteriors over all rows, so any number of hosts is one aggregation.
A class ``und`` with even trigrams stands for texts of no known language.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daymosaic.llm.base import batch, materialise, query, slices, table

#: Texts of each declared language that the trigram model is fitted on, at most about so many, the first by a hash of their id.
SAMPLE = 20_000
BUCKETS = 1 << 15
#: Trigrams that a text's likelihood counts for at most: neighbours overlap and repeat, so more are not independent.
EVIDENCE = 200
#: Units of the level above that smooth a level's counts; prior of ``und``; least posterior that is accepted.
UNITS, NONE_PRIOR, CONFIDENT = 20.0, 0.01, 0.5
#: Share of the rows that makes a host or declared language hot.
HOT = 1e-3
#: A declared language is a class if it has this share of the declared texts, or so many texts, however many there are.
SHARE, ENOUGH = 0.001, 20
#: Languages that a task counts before it sends them.
HELD = 200
UND = "und"
OUTSIDE = re.compile(r"[\W\d_]+")


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all texts' letters in lower case, one after the other, and where each text begins."""
    clean = [" " + OUTSIDE.sub(" ", t.lower()).strip() + " " for t in texts]
    clean = [c if len(c) > 2 else "" for c in clean]
    n = np.array([max(0, len(c) - 2) for c in clean], dtype=np.int64)
    x = np.frombuffer("".join(clean).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    if len(x) < 3:
        return np.empty(0, dtype=np.int64), np.zeros(len(texts) + 1, dtype=np.int64)
    h = (x[:-2] * np.uint64(0x9E3779B1) + x[1:-1]) * np.uint64(0x85EBCA77) + x[2:]
    h = (h * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - 15)
    keep = np.ones(len(h), dtype=bool)
    ends = np.cumsum([len(c) for c in clean])
    for e in ends[:-1]:  # trigrams over a border of texts
        keep[max(0, e - 2):e] = False
    return h[keep].astype(np.int64), np.concatenate([[0], np.cumsum(n)])


def fit(docs: DataFrame, id_col: str, text_col: str, declared_col: str) -> tuple[list[str], np.ndarray]:
    """Classes and the log probabilities of the trigrams by class; ``und`` is the last."""
    said = F.lower(F.trim(F.col(declared_col).cast("string")))
    known = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), said.alias("lang"), F.col(text_col).cast("string").alias("text"))
    sizes = known.filter((F.col("lang") != "") & (F.col("lang") != UND)).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    sizes = materialise(sizes, "languages")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    most = F.least(F.lit(1.0), F.lit(SAMPLE) / F.col("n")) * (1 << 30)
    classes = materialise(sizes.filter(F.col("n") >= min(SHARE * total, ENOUGH)).select("lang", most.alias("most")), "classes")
    names = sorted(r["lang"] for r in classes.collect())
    sample = known.join(F.broadcast(classes), "lang").filter(
        F.pmod(F.xxhash64("id"), F.lit(1 << 30)) <= F.col("most")).select("lang", "text")
    fields = [("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())]

    def counted(held):
        for l, c in held.items():
            at = np.flatnonzero(c)
            yield batch(fields, [l] * len(at), pa.array(at.astype(np.int32)), pa.array(c[at]))

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for b in slices(batches):
            langs, texts = b.column("lang").to_pylist(), b.column("text").to_pylist()
            for l in set(langs):
                g, _ = trigrams([t for t, x in zip(texts, langs) if x == l])
                held[l] = held.get(l, np.zeros(BUCKETS, dtype=np.int64)) + np.bincount(g, minlength=BUCKETS)
            if len(held) > HELD:
                yield from counted(held)
                held = {}
        yield from counted(held)

    got = materialise(sample.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(
        F.sum("n").alias("n")), "trigrams")
    logs = np.zeros((BUCKETS, len(names) + 1))
    rows = got.toArrow() if names else None
    for i, l in enumerate(names):
        at = np.array(rows.column("lang").to_pylist()) == l
        logs[rows.column("bucket").to_numpy()[at], i] = rows.column("n").to_numpy()[at]
    logs = np.log((logs + 0.5) / (logs + 0.5).sum(axis=0))
    return [*names, UND], logs


def likelihoods(docs: DataFrame, names: list[str], logs: np.ndarray, id_col: str, text_col: str, declared_col: str,
                host_col: str | None) -> DataFrame:
    """doc_id, declared, host, letters, ll (log likelihood by class) and q (its posterior without other evidence)."""
    host = F.col(host_col).cast("string") if host_col else F.lit(None).cast("string")
    df = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(declared_col).cast("string").alias("declared"),
                     host.alias("host"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(logs.astype(np.float32))
    fields = [("doc_id", pa.int64()), ("declared", pa.string()), ("host", pa.string()), ("letters", pa.int64()),
              ("ll", pa.list_(pa.float64())), ("q", pa.list_(pa.float64()))]

    def run(batches):
        logs = sent.value
        for b in slices(batches):
            g, begin = trigrams(b.column("text").to_pylist())
            n = np.diff(begin)
            sums = np.zeros((len(n), logs.shape[1]))
            some = np.flatnonzero(n)
            if len(some):
                sums[some] = np.add.reduceat(logs[g], begin[some], axis=0, dtype=np.float64)
            ll = sums * np.where(n > 0, np.minimum(n, EVIDENCE) / np.maximum(n, 1), 0.0)[:, None]
            q = np.exp(ll - ll.max(axis=1, keepdims=True))
            q /= q.sum(axis=1, keepdims=True)
            yield batch(fields, b.column("doc_id"), b.column("declared"), b.column("host"), pa.array(n), list(ll), list(q))

    return df.mapInArrow(run, "doc_id bigint, declared string, host string, letters bigint, ll array<double>, q array<double>")


def page_evidence(pages: DataFrame) -> DataFrame:
    """doc, page_declared, page_host: the markup language and host of the document whose number the address's last part starts with.

    Of several pages of a document the one with the smallest page_id counts.
    """
    host = F.lower(F.regexp_extract("url", r"://([^/?#]*)", 1))
    p = pages.filter(F.col("url").isNotNull()).select(
        F.expr("try_cast(regexp_extract(url, '/([0-9]+)(?:[.][a-z]+)?/?(?:[?#].*)?$', 1) as bigint)").alias("doc"),
        F.struct("page_id", F.lower(F.regexp_extract("html", r"(?i)<html[^>]*\slang=[\"']?([a-z]+)", 1)).alias("lang"),
                 host.alias("host")).alias("p"))
    return p.filter("doc is not null").groupBy("doc").agg(F.min("p").alias("p")).select(
        "doc", F.nullif("p.lang", F.lit("")).alias("page_declared"), F.nullif("p.host", F.lit("")).alias("page_host"))


def join_hot(rows: DataFrame, values: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join with a table of one row for each key, whose row counts are known.

    Keys with over a HOT share of all rows are fewer than its inverse and are broadcast; the others are joined by
    shuffle, none of them heavy.
    """
    total = sizes.agg(F.sum("size")).first()[0] or 0.0
    hot = sizes.filter(F.col("size") > HOT * total).select(*keys)
    few = materialise(values.join(F.broadcast(hot), keys, "left_semi"), "hot")
    head = rows.join(F.broadcast(few), keys)
    tail = rows.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(values, keys)
    return head.unionByName(tail)


def identify(docs: DataFrame, pages: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
             declared_col: str = "lang", host_col: str | None = "source") -> DataFrame:
    """doc_id, language, posterior, accepted, declared, host for every row.

    Where ``pages`` has the document's page, its markup language and host stand in for the declared language and the source.
    A null or empty text leaves the other evidence, and is not accepted; a null declared language or host is no
    evidence; ties go to the first language by name; null ids and repeated rows are judged each. An empty
    table gives an empty result. Other columns are not read.
    """
    names, logs = fit(docs, id_col, text_col, declared_col)
    rows = likelihoods(docs, names, logs, id_col, text_col, declared_col, host_col)
    if pages is not None:
        rows = materialise(rows, "likelihoods")
        e = page_evidence(pages)
        rows = rows.join(e, rows.doc_id == e.doc, "left").withColumns({
            "declared": F.coalesce("page_declared", "declared"), "host": F.coalesce("page_host", "host")})
    label = F.split("host", "[.]")
    rows = rows.select("doc_id", "letters", "ll", "q", F.coalesce(F.lower("declared"), F.lit("")).alias("declared"),
                       F.coalesce("host", F.lit("")).alias("host"))
    rows = materialise(rows.withColumns({
        "domain": F.when(F.size(label) > 1, F.array_join(F.slice(label, -2, 2), ".")).otherwise(F.col("host")),
        "suffix": F.when(F.size(label) > 1, F.element_at(label, -1)).otherwise(F.lit(""))}), "evidence")
    k = len(names)
    sums = [F.sum(F.col("q")[i]).alias(f"n{i}") for i in range(k)]
    again = [F.sum(f"n{i}").alias(f"n{i}") for i in range(k)]
    n = F.array(*(F.col(f"n{i}") for i in range(k)))

    hosts = materialise(rows.groupBy("suffix", "domain", "host").agg(*sums), "hosts")
    root = np.array([v or 0.0 for v in hosts.agg(*again).first()], dtype=float)
    root[-1] = 0.0
    root = (1 - NONE_PRIOR) * (root + 1) / (root + 1).sum()
    root[-1] = NONE_PRIOR

    def level(keys: list[str], above: DataFrame | None, name: str) -> DataFrame:
        """Prior of a level: its counts and UNITS of the prior above."""
        g = hosts.groupBy(*keys).agg(*again).select(*keys, n.alias("n"))
        up = F.array(*map(F.lit, root.tolist())) if above is None else F.col("above")
        if above is not None:
            g = g.join(above, keys[:-1])
        total = F.aggregate("n", F.lit(0.0), lambda a, x: a + x)
        return g.select(*keys, F.zip_with("n", up, lambda x, p: (x + UNITS * p) / (total + UNITS)).alias(name))

    prior = level(["suffix"], None, "above")
    prior = level(["suffix", "domain"], prior, "above")
    prior = level(["suffix", "domain", "host"], prior, "prior")
    said = rows.groupBy("declared").agg(*sums).select("declared", n.alias("n"))
    all_ = F.array(*map(F.lit, [float(v or 0.0) + 1.0 for v in hosts.agg(*again).first()]))
    said = said.select("declared", "n", F.when(F.col("declared") == "", F.array_repeat(F.lit(1.0), k)).otherwise(
        F.zip_with("n", all_, lambda x, t: (x + F.lit(0.5)) / t)).alias("said"))
    # a declared language is a class, or one of many odd values; hosts may be many and one may hold most rows
    sizes = hosts.select("suffix", "domain", "host", sum((F.col(f"n{i}") for i in range(k)), F.lit(0.0)).alias("size"))
    rows = join_hot(rows, prior, sizes, ["suffix", "domain", "host"])
    said_sizes = said.select("declared", F.aggregate("n", F.lit(0.0), lambda a, x: a + x).alias("size"))
    fused = join_hot(rows, said.drop("n"), said_sizes, ["declared"]).withColumn("s", F.zip_with(
        "ll", F.zip_with("prior", "said", lambda p, d: F.ln(p) + F.ln(d)), lambda a, b: a + b))
    top = F.array_max("s")
    z = F.aggregate("s", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("s")))
    language = F.element_at(F.array(*map(F.lit, names)), F.array_position("s", top).cast("int"))
    out = fused.select("doc_id", language.alias("language"), (F.lit(1.0) / z).alias("posterior"), "letters",
                       F.nullif("declared", F.lit("")).alias("declared"), F.nullif("host", F.lit("")).alias("host"))
    accepted = (F.col("letters") > 0) & (F.col("language") != UND) & (F.col("posterior") >= CONFIDENT)
    return out.select("doc_id", "language", "posterior", accepted.alias("accepted"), "declared", "host")


def known_only(docs: DataFrame, pages: DataFrame | None = None, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents whose language is accepted, all columns as they were. Rows with a null id are kept."""
    bad = identify(docs, pages, id_col=id_col, **options).filter(~F.col("accepted")).select(F.col("doc_id").alias("bad"))
    bad = materialise(bad.distinct(), "rejected")
    return docs.join(bad, docs[id_col].cast("bigint") == bad.bad, "left_anti")


@query("op10_language_id")
def op10(spark, d) -> DataFrame:
    return identify(table(spark, d, "documents"), table(spark, d, "pages"))
