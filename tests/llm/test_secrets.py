import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import zlib

import pytest

from daymosaic.llm import secrets as S


def brute(text):
    """The contract read literally."""
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                         text, re.I | re.A):
        if len(m.group(2)) >= 8:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for i, (k, rx, n) in enumerate([("access", "AKIA[A-Z0-9]+", 16), ("hex", "[0-9a-f]+", 32)]):
        out += [(m.start(), i + 1, f"{k}:{m.start()}:{m.end()}") for m in re.finditer(rx, text) if len(m.group()) >= n]
    return ",".join(x[2] for x in sorted(out))


KEY = "AKIA" + "Z" * 16
TEXTS = ["", None, "token=abcdefgh", "é token = 'abcdefgh' x", "token=short", "token=abc token: \"12345678\"",
         "TOKEN=secret: abcdefgh12", KEY + " " + "a" * 40, "AKIAshort AKIA" + "Q" * 12, "apiKey:abcdefgh.=-/",
         "password=" + "0123456789abcdef" * 3, "pa\u017f\u017fword=abcdefgh", "x " * 30000 + "token=abcdefgh"]


def test_base_spans_equal_brute_force(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, spans string")
    got = {r["doc_id"]: r for r in S.digest(S.scan(df)).collect()}
    for i, t in enumerate(TEXTS):
        want = brute(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [
            want.count(k + ":") for k in ("assign", "access", "hex")]
        assert set(filter(None, want.split(","))) <= set(got[i]["spans"].split(","))


def test_query_equals_brute_force_on_the_tables(spark):
    from daymosaic.llm.suite import QUERIES
    d = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = QUERIES["op8_secret_scans"](spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["base_sha256"] == hashlib.sha256(brute(texts[r["doc_id"]]).encode()).hexdigest()


WRAPS = {
    "percent": lambda s: "".join(f"%{b:02x}" for b in s.encode()),
    "escape": lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
    "wide": lambda s: "".join(chr(ord(c) + 0xFEE0) for c in s),
    "entity": lambda s: "".join(f"&#{ord(c)};" for c in s),
    "base64": lambda s: base64.b64encode(s.encode()).decode(),
    "gzip": lambda s: base64.b64encode(gzip.compress(s.encode())).decode(),
    "double": lambda s: base64.urlsafe_b64encode(zlib.compress(zlib.compress(s.encode()))).decode().rstrip("="),
}


@pytest.mark.parametrize("a", WRAPS)
@pytest.mark.parametrize("b", [None, *WRAPS])
def test_nested_layers_map_back(a, b):
    wrapped = WRAPS[a](f"x {KEY} y")
    if b == "wide" == a:
        return  # look-alikes exist for ASCII only
    if b:
        wrapped = WRAPS[b](wrapped)
    text = "né " + wrapped + " end"
    found = [m for m in S.spans(text) if m[0] == "access"]
    assert len(found) == 1 and not found[0][3]
    _, s, e, _ = found[0]
    assert 3 <= s < e <= 3 + len(wrapped)
    if (a, b) == ("percent", None):
        assert text[s:e] == WRAPS["percent"](KEY)
    assert KEY not in S.redact(text, S.spans(text)) and S.redact(text, S.spans(text)).startswith("né ")


def test_worklist_ends_and_large_layers_are_reported(monkeypatch):
    assert S.spans("%25" * 2000 + "41") == []
    monkeypatch.setattr(S, "MAX_LAYER", 1000)
    bomb = base64.b64encode(zlib.compress(b"a" * 5000)).decode()
    assert [m[0] for m in S.spans("x " + bomb)] == ["oversize"]


def test_odd_escapes_do_not_fail():
    assert S.spans("\\ud800 \\u{110000} %ff%fe %c3 &#99999999; &#1114112; \\ud83d\\ude00 \u00ad") == []


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, spans string, kind string")
    assert S.digest(S.scan(df)).count() == 0
    twice = spark.createDataFrame([(None, "token=abcdefgh"), (1, None), (1, None)], "doc_id long, text string")
    assert S.scan(twice, with_text=True).count() == 3


GOT = "token=abcdefgh12345678"


def found_in(text):
    return [text[a:b] for _, a, b, own in S.spans(text) if not own]


@pytest.mark.parametrize("newline", ["\n", "\r\n", "\n  "])
@pytest.mark.parametrize("width", [64, 76])
def test_wrapped_base64(width, newline):
    rng = random.Random(1)
    for lead in (40, 50, 57, 70):  # the finding lies over a line break or not
        raw = ("x" * lead + " " + GOT + " " + "".join(rng.choice("abc ") for _ in range(120))).encode()
        code = base64.b64encode(raw).decode()
        text = "see:\n" + newline.join(code[i:i + width] for i in range(0, len(code), width)) + "\nend"
        marks = [m for m in S.spans(text) if not m[3]]
        assert [m[0] for m in marks] == ["assign"]
        inside = text[marks[0][1]:marks[0][2]].replace("\r", "").replace("\n", "").replace(" ", "")
        assert inside in code and len(inside) in range(29, 34)
    noise = "".join(rng.choice("abcdefghij klmnop") for _ in range(900))
    for pack in (gzip.compress, zlib.compress, bz2.compress, lzma.compress):
        code = base64.b64encode(pack((noise + GOT).encode())).decode()
        for head in ("", "some_long_word_before_it\n"):
            assert len(found_in(head + newline.join(code[i:i + width] for i in range(0, len(code), width)))) == 1


def test_all_streams_and_what_follows_them():
    import zstandard
    for pack in (gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.ZstdCompressor().compress):
        for raw in (pack(b"nothing in here") + pack(GOT.encode()), pack(b"nothing in here") + b" then " + GOT.encode()):
            assert found_in(base64.b64encode(raw).decode())


def test_layers_that_are_not_clean_utf8():
    for raw in (b"caf\xe9 " + GOT.encode(), GOT.encode() + b"\x00\x01", GOT.encode("utf-16"), GOT.encode("utf-16-le"),
                GOT.encode("utf-16-be"), b"\x07" + GOT.encode("utf-16-be")):
        assert len(found_in("a: " + base64.b64encode(raw).decode() + " z")) == 1, raw
    assert not S.spans(base64.b64encode(bytes(random.Random(3).randrange(256) for _ in range(3000))).decode())


def test_letters_glued_to_base64():
    code = base64.b64encode(GOT.encode()).decode().rstrip("=")
    for glue in ("x", "xy", "xyz", "xyzw"):
        assert len(found_in(glue + code)) == 1 and len(found_in(code + glue)) == 1
