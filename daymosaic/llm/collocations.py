"""Phrase collocations by stripes.

A stripe belongs to a prefix of words and counts, word by word, what follows it; what is left out or missing (the end of a
piece, words that cannot make a frequent phrase) is counted together as the rest. A task builds the stripes of its texts, and
stripes of one prefix are merged elementwise. One merged stripe holds the counts of the prefix's extensions, the prefix's own
count (the sum of all) and the largest extension, which says whether a longer phrase covers the prefix.

Prefixes of 0 to ``longest`` - 1 words take one pass each. A phrase is frequent only if the phrases without its first and
without its last word are, so a pass leaves out positions that a bitmap of the pass before rules out; the bitmap has at most
2**28 bits, and a fuller one only lets more positions pass. Stripes of the empty prefix and of prefixes with over a
ten-thousandth of all words are cut into segments by the next word, so no merged stripe holds a hot prefix whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daymosaic.llm.base import LOWER, UPPER, batch, materialise, query, slices, table
from daymosaic.llm.language_id import join_hot
from daymosaic.llm.substrings import FILTER_BITS, bit_filter, has
from daymosaic.operators.joins import join_small

UND = "und"
#: Words that a task holds before it sends their stripes.
HELD = 2_000_000
#: A prefix is hot with more than this share of all words, so there are fewer hot ones than its inverse.
HOT = 1e-4
#: Segments of a hot prefix's stripe, and of the empty prefix's.
SEGMENTS, WORDS = 64, 1024
#: Parts that a language's phrases are ranked in before the parts' first ones are ranked together.
RANKED = 64
MASK, BASE = (1 << 64) - 1, 0x9E3779B97F4A7C15
ROW = [("lang", pa.string()), ("prefix", pa.binary()), ("seg", pa.int32()), ("words", pa.list_(pa.binary())),
       ("counts", pa.list_(pa.int32())), ("rest", pa.int64())]
MERGED = [("lang", pa.string()), ("prefix", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("hash", pa.int64())]

#: Bytes by kind (of a word, blank, end of a piece) and in lower case.
KIND, SMALL = np.zeros(256, dtype=np.uint8), np.arange(256, dtype=np.uint8)
KIND[list(b" \t")], KIND[list(b".,;:!?\n\x0b\x0c\r")] = 1, 2
SMALL[65:91] += 32


def lang_hash(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"))


def word_hash(word: bytes, lang: int) -> int:
    return (xxhash.xxh3_64_intdigest(word) ^ lang) * BASE & MASK


def extend(h: int, word: int) -> int:
    """The hash of a phrase from that of its words but the last, and the last one's."""
    return (h * BASE + word) & MASK


def numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each value among the distinct ones, and these."""
    d = pa.array(x).dictionary_encode()
    return d.indices.to_numpy().astype(np.int64), d.dictionary.to_numpy()


def words_of(texts: pa.BinaryArray) -> tuple[pa.BinaryArray, np.ndarray, np.ndarray]:
    """The words of all texts in lower case; for each a number that rises from piece to piece, and its text's place."""
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[ends[0]:ends[-1]]
    begin = ends[:-1] - ends[0]
    kind = KIND[data]
    word = kind == 0
    fresh = word.copy()
    fresh[1:] &= ~word[:-1]
    fresh[begin[begin < len(data)]] = word[begin[begin < len(data)]]
    start = np.flatnonzero(fresh)
    text = np.searchsorted(begin, start, "right") - 1
    kept = np.cumsum(word, dtype=np.int32)
    offsets = np.append(kept[start] - 1, kept[-1] if len(kept) else 0).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(SMALL[data[word]])])
    return found, np.cumsum(kind == 2)[start] + text, text


class Words:
    """The words of a task's texts, the piece that each is in, and its language."""

    def __init__(self):
        self.chunks: list[pa.BinaryArray] = []
        self.pieces: list[np.ndarray] = []
        self.at: list[np.ndarray] = []
        self.langs: dict[str, int] = {}
        self.held = self.last = 0

    def add(self, b: pa.RecordBatch) -> None:
        found, piece, text = words_of(b.column("text"))
        if len(found):
            langs = np.array([self.langs.setdefault(x, len(self.langs)) for x in b.column("lang").to_pylist()], dtype=np.int32)
            self.chunks.append(found)
            self.pieces.append(piece + self.last + 1)
            self.at.append(langs[text])
            self.last = int(self.pieces[-1][-1])
            self.held += len(found)


def counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, least first, and how often each occurs."""
    x = np.sort(x)
    begin = np.flatnonzero(np.concatenate(([len(x) > 0], x[1:] != x[:-1])))
    return x[begin], np.diff(np.append(begin, len(x)))


def local_stripes(held: Words, m: int, bitmap: np.ndarray | None, bits: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The stripes of all prefixes of m words in the texts held."""
    coded = pa.chunked_array(held.chunks, pa.binary()).combine_chunks().dictionary_encode()
    code, vocabulary = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    lang, piece, size = np.concatenate(held.at), np.concatenate(held.pieces), len(vocabulary) + 1
    word = np.array([xxhash.xxh3_64_intdigest(w) for w in vocabulary.to_pylist()], dtype=np.uint64)
    seed = np.array([lang_hash(x) for x in held.langs], dtype=np.uint64)
    prefix, nxt, parents = lang.astype(np.int64), code + 1, []
    if m:
        h = (word[code] ^ seed[lang]) * np.uint64(BASE)
        gram = h.copy()
        for j in range(1, m):
            gram[:-j] = gram[:-j] * np.uint64(BASE) + h[j:]
        inside = np.zeros(len(code) + 1, dtype=bool)  # m words of one piece begin here
        inside[:max(0, len(code) - m + 1)] = piece[m - 1:] == piece[:max(0, len(code) - m + 1)]
        some = np.flatnonzero(inside)
        inside[some] = has(bitmap, bits, gram[some])
        at = np.flatnonzero(inside)
        after = np.minimum(at + m, len(code) - 1)
        nxt = np.where(inside[at + 1] & (piece[after] == piece[at]) & (at + m < len(code)), code[after] + 1, 0)
        prefix = lang[at].astype(np.int64) * size + code[at]
        del h, gram, inside, some, after
        for j in range(1, m):  # a prefix is the number of the one before and a word
            prefix, values = numbered(prefix)
            parents.append(values)
            prefix = prefix * size + code[at + j]
        if m > 1:
            prefix, values = numbered(prefix)
            parents.append(values)
    if not len(prefix):
        return
    pair, n = counted(prefix * size + nxt)
    prefix, nxt = np.divmod(pair, size)
    at, own = np.unique(prefix, return_inverse=True)  # from here on each prefix once
    path, left = [], at
    for values in parents[::-1]:
        left, last = np.divmod(values[left], size)
        path.insert(0, last)
    if m == 1:
        left, last = np.divmod(left, size)
        path = [last]
    gram = np.zeros(len(at), dtype=np.uint64)
    for c in path:
        gram = gram * np.uint64(BASE) + (word[c] ^ seed[left]) * np.uint64(BASE)
    is_hot = np.isin(gram, hot) if m else np.ones(len(at), dtype=bool)
    parts = SEGMENTS if m else WORDS
    seg = np.where(is_hot[own] & (nxt > 0), word[nxt - 1] % np.uint64(parts), np.uint64(0)).astype(np.int64)
    row = own * parts + seg
    if is_hot.any():
        order = np.argsort(row, kind="stable")
        own, nxt, n, seg, row = own[order], nxt[order], n[order], seg[order], row[order]
    begins = np.concatenate(([True], row[1:] != row[:-1]))
    row, begin = np.cumsum(begins) - 1, np.flatnonzero(begins)
    some, stripe = nxt > 0, own[begin]
    offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row[some], minlength=len(begin))))).astype(np.int32))
    text = pc.binary_join_element_wise(*[vocabulary.take(pa.array(c[stripe])) for c in path], b" ") if m else (
        pa.array([b""] * len(begin), pa.binary()))
    out = batch(ROW, pa.array(list(held.langs), pa.string()).take(pa.array(left[stripe])), text, pa.array(seg[begin].astype(np.int32)),
                pa.ListArray.from_arrays(offsets, vocabulary.take(pa.array(nxt[some] - 1))),
                pa.ListArray.from_arrays(offsets, pa.array(n[some].astype(np.int32))),
                pa.array(np.bincount(row, weights=n * ~some, minlength=len(begin)).astype(np.int64)))
    yield from slices([out], 20_000)


def stripes(texts: DataFrame, m: int, bitmap: np.ndarray | None, bits: int, hot: np.ndarray) -> DataFrame:
    """lang, prefix, seg, words, counts, rest: what each task counts after the prefixes of m words."""
    sent = texts.sparkSession.sparkContext.broadcast((bitmap, bits, hot))

    def run(batches):
        bitmap, bits, hot = sent.value
        held = Words()
        for b in slices(batches):
            held.add(b)
            if held.held >= HELD:
                yield from local_stripes(held, m, bitmap, bits, hot)
                held = Words()
        if held.held:
            yield from local_stripes(held, m, bitmap, bits, hot)

    kinds = "lang string, prefix binary, seg int, words array<binary>, counts array<int>, rest bigint"
    return texts.mapInArrow(run, kinds)


class Stripes:
    """Partial stripes in order of their keys, to be merged elementwise. The last key stays open until another one comes."""

    def __init__(self, least: int):
        self.least = least
        self.key: tuple | None = None
        self.words, self.counts, self.rest = pa.array([], pa.binary()), np.empty(0, dtype=np.int64), 0

    def add(self, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """The merged stripes of all keys but the last."""
        key = [numbered_text(b.column("lang")), numbered_text(b.column("prefix")), b.column("seg").to_numpy()]
        new = np.concatenate(([True], np.any([k[1:] != k[:-1] for k in key], axis=0)))
        group, first = np.cumsum(new) - 1, np.flatnonzero(new)
        keys = list(zip(*(b.column(c).take(pa.array(first)).to_pylist() for c in ("lang", "prefix", "seg"))))
        ends = b.column("words").offsets.to_numpy()
        row = np.repeat(group, np.diff(ends))
        words, counts = b.column("words").flatten(), b.column("counts").flatten().to_numpy().astype(np.int64)
        rest = np.bincount(group, weights=b.column("rest").to_numpy()).astype(np.int64)
        if self.key is not None:
            if keys[0] != self.key:
                keys, row, rest = [self.key, *keys], row + 1, np.concatenate(([0], rest))
            row = np.concatenate((np.zeros(len(self.counts), dtype=np.int64), row))
            words, counts = pa.concat_arrays([self.words, words]), np.concatenate((self.counts, counts))
            rest[0] += self.rest
        # elementwise: one entry for each key and word
        coded = words.dictionary_encode()
        size = max(1, len(coded.dictionary))
        number, pair = numbered(row * size + coded.indices.to_numpy())
        n = np.bincount(number, weights=counts, minlength=len(pair)).astype(np.int64)
        row, word = np.divmod(pair, size)
        last = row == len(keys) - 1
        self.key, self.rest = keys[-1], int(rest[-1])
        self.words, self.counts = coded.dictionary.take(pa.array(word[last])), n[last]
        if len(keys) > 1:
            yield self.closed(keys[:-1], row[~last], word[~last], n[~last], rest[:-1], coded.dictionary)

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.key is not None:
            yield self.closed([self.key], np.zeros(len(self.counts), dtype=np.int64), np.arange(len(self.counts)), self.counts,
                              np.array([self.rest]), self.words)

    def closed(self, keys, row, word, n, rest, vocabulary) -> pa.RecordBatch:
        total, top = rest + np.bincount(row, weights=n, minlength=len(keys)).astype(np.int64), np.zeros(len(keys), dtype=np.int64)
        np.maximum.at(top, row, n)
        out = [(lang, prefix.decode("utf-8", "surrogatepass"), None, t, x) for (lang, prefix, _), t, x in zip(keys, total.tolist(), top.tolist())]
        many = np.flatnonzero(n >= self.least)
        hashes: dict[int, int] = {}
        for k, w, c in zip(row[many].tolist(), vocabulary.take(pa.array(word[many])).to_pylist(), n[many].tolist()):
            lang, prefix, _ = keys[k]
            seed = lang_hash(lang)
            if k not in hashes:
                h = 0
                for p in prefix.split(b" ") if prefix else ():
                    h = extend(h, word_hash(p, seed))
                hashes[k] = h
            x = extend(hashes[k], word_hash(w, seed))
            out.append((lang, out[k][1], w.decode("utf-8", "surrogatepass"), c, x - (x >> 63 << 64)))
        return batch(MERGED, *map(list, zip(*out)))


def numbered_text(column: pa.Array) -> np.ndarray:
    return column.dictionary_encode().indices.to_numpy()


def merge(rows: DataFrame, least: int) -> DataFrame:
    """lang, prefix, word, n, hash: extensions with at least ``least``, and for each stripe or segment a row without a word,
    whose n is its sum and whose hash is its largest count."""
    def run(batches):
        stripes = Stripes(least)
        for b in batches:
            if b.num_rows:
                yield from stripes.add(b)
        yield from stripes.end()

    dealt = rows.repartition("lang", "prefix", "seg").sortWithinPartitions("lang", "prefix", "seg")
    return dealt.mapInArrow(run, "lang string, prefix string, word string, n bigint, hash bigint")


def phrases(docs: DataFrame, least: int, longest: int, text_col: str, lang_col: str) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, m, a, top) of all phrases of up to ``longest`` words that occur ``least`` times; and (lang, n).

    ``top`` is the count of the phrase's most frequent extension by a word to the right, as far as that is frequent.
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UND)).alias("lang"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    bitmap, bits, hot, found, sizes, total = None, 0, np.empty(0, dtype=np.uint64), [], None, 0
    for m in range(longest):
        merged = materialise(merge(stripes(texts, m, bitmap, bits, hot), least), "stripes")
        sums = merged.filter("word is null").groupBy("lang", "prefix").agg(F.sum("n").alias("a"), F.max("hash").alias("top"))
        longer = merged.filter("word is not null")
        if m == 0:
            sizes = materialise(sums.select("lang", F.col("a").alias("n")), "sizes")
            total = sizes.agg(F.sum("n")).first()[0] or 0
        else:
            found.append(sums.filter(F.col("a") >= least).select(
                "lang", F.col("prefix").alias("phrase"), F.lit(m).alias("m"), "a", "top"))
        if m == longest - 1:
            text = F.when(F.col("prefix") == "", F.col("word")).otherwise(F.concat_ws(" ", "prefix", "word"))
            found.append(longer.select("lang", text.alias("phrase"), F.lit(longest).alias("m"), F.col("n").alias("a"),
                                       F.lit(0).cast("bigint").alias("top")))
        else:
            hot = longer.filter(F.col("n") > HOT * total).toArrow().column("hash").to_numpy().view(np.uint64)
            bitmap, bits = bit_filter(longer, "hash", longer.count(), FILTER_BITS)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out, sizes


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, cover: int = 100, first: int = 2000,
                 text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to ``longest`` words.

    a, l and r are the counts of the phrase and of its two parts at the cut that scores lowest (ties: the first cut), n the words
    of the language, score floor(1000 * a * n / (l * r)). A phrase inside a longer one that has ``cover`` percent of its count
    is left out; by one word more suffices, as counts only fall with length.

    Null texts are empty, a null language is ``und``, other columns (ids too) are not read. Every row counts, repeated ones
    too. A text of any length is counted whole. Ties go by count, then by the phrase's bytes. An empty table gives no rows.
    """
    known, sizes = phrases(docs, least, longest, text_col, lang_col)
    known = materialise(known, "phrases")
    left = known.filter("m > 1").select("lang", F.expr("substr(phrase, instr(phrase, ' ') + 1)").alias("phrase"), "a").groupBy(
        "lang", "phrase").agg(F.max("a").alias("before"))
    longer = F.greatest("top", F.coalesce("before", F.lit(0)))
    alive = materialise(known.filter("m > 1").join(left, ["lang", "phrase"], "left").filter(
        (longer < least) | (100 * longer < cover * F.col("a"))).select("lang", "phrase", "m", "a"), "alive")
    cuts = alive.select("lang", "phrase", "m", "a", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", F.explode(F.array(
            F.struct(F.lit("l").alias("side"), F.expr("substring_index(phrase, ' ', k)").alias("part")),
            F.struct(F.lit("r").alias("side"), F.expr("substring_index(phrase, ' ', k - m)").alias("part")))).alias("x"))
    cuts = materialise(cuts.select("lang", "phrase", "a", "k", "x.side", "x.part"), "cuts")
    parts = known.select("lang", F.col("phrase").alias("part"), F.col("a").alias("c"))
    both = join_hot(cuts, parts, cuts.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("size")), ["lang", "part"])
    both = both.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("side") == "l", F.col("c"))).alias("l"),
                                                        F.max(F.when(F.col("side") == "r", F.col("c"))).alias("r"))
    big = lambda c: F.col(c).cast("decimal(19,0)")
    scored = join_small(both, sizes, ["lang"], "inner").withColumns({
        "above": (F.col("a") * 1000).cast("decimal(19,0)") * big("n"), "below": big("l") * big("r")})
    scored = scored.withColumn("score", F.expr("above div below")).groupBy("lang", "phrase", "a", "n").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(RANKED))).orderBy(*order)
    some = scored.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= first)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))
    return ranked.filter(F.col("rank") <= first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
split AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
sizes AS (SELECT lang, sum(len(w)) AS n FROM split GROUP BY lang),
lengths AS (SELECT unnest([1, 2, 3, 4, 5]) AS m),
starts AS (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM split, lengths WHERE len(w) >= m),
f AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS a FROM starts GROUP BY ALL HAVING count(*) >= 100),
tokens AS (SELECT *, string_split(phrase, ' ') AS t FROM f),
inside AS (SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, array_to_string(t[1:m - 1], ' ') AS phrase, a FROM tokens
    UNION ALL SELECT lang, array_to_string(t[2:m], ' '), a FROM tokens) GROUP BY ALL),
alive AS (SELECT c.* FROM tokens c LEFT JOIN inside i USING (lang, phrase) WHERE m >= 2 AND (longer IS NULL OR longer < a)),
cuts AS (SELECT lang, phrase, a, t, m, unnest(range(1, m)) AS k FROM alive),
scored AS (SELECT c.lang, c.phrase, c.a, c.k, l.a AS l, r.a AS r, n,
    (1000 * c.a::HUGEINT * n::HUGEINT) // (l.a::HUGEINT * r.a::HUGEINT) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.t[1:k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.t[k + 1:c.m], ' ') JOIN sizes s ON s.lang = c.lang),
one AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER w AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM one
WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER w <= 2000"""


@query("op11_collocations", SQL)
def op11(spark, d) -> DataFrame:
    return collocations(table(spark, d, "documents"))
