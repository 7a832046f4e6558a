"""URL filters: pattern rules indexed by their rarest literal token.

A pattern is literal text with ``*`` (any run), ``^`` (a character that is not a letter, digit, ``_``, ``-``, ``.`` or
``%``, or the end), a leading ``||`` (start of the host or of one of its labels) and ``|`` at either end (start or end
of the address). It is matched against host and path. A token is a run of ASCII letters and digits; a token of a
pattern may index it only if every fitting address holds it as a whole token, so neither neighbour is ``*`` or an open
end. Of those, the one that the fewest addresses hold is taken, after one counting pass over all addresses.
Rules without such a token are tried on every address.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daymosaic.llm.base import LOWER, ORACLE, UPPER, batch, query, table

#: Rules travel to every task; more than this is refused, not truncated.
MAX_RULES = 500_000

#: The rules of the contract: (action, host and path).
SITE_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
              ("block", "net/es/"), ("block", "net/fr/")]
#: Patterns that judge what no site rule fits; the longest wins, and nothing blocks the rest.
PATTERN_RULES = [("block", "||ads-track."), ("block", "||adserver."), ("block", "/doubleclick/"), ("block", "/popunder^"),
                 ("block", "||*.ads-track."), ("allow", "/robots.txt|")]

TOKEN = re.compile(r"[A-Za-z0-9]+")
NAMES = [("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()),
         ("verdict", pa.string()), ("pattern", pa.string())]


@dataclass(frozen=True)
class Rule:
    action: str
    text: str
    pattern: str
    site: bool
    regex: str
    tokens: tuple[str, ...]


def make_rule(action: str, text: str, site: bool) -> Rule:
    """``site`` rules are plain host and path prefixes; nothing in them is a wildcard."""
    body = text if site else text.removeprefix("||").strip("|")
    head = site or text.startswith("||")
    start = "" if not head and not text.startswith("|") else r"\A(?:[^/]*\.)?" if head else r"\A"
    end = r"\Z" if not site and text.endswith("|") and len(text) > 1 else ""
    wild = {} if site else {"*": ".*", "^": r"(?:[^A-Za-z0-9_.%-]|\Z)"}
    regex = start + "".join(wild.get(c) or re.escape(c) for c in body) + end
    tokens = []
    for m in TOKEN.finditer(body):
        left = body[m.start() - 1] if m.start() else ("|" if start else "*")
        right = body[m.end()] if m.end() < len(body) else ("|" if end else "*")
        if site or "*" not in (left, right):
            if m.end() < len(body) or end:
                tokens.append(m.group().lower())
    return Rule(action, text, text, site, regex, tuple(dict.fromkeys(tokens)))


def make_rules(site_rules=SITE_RULES, pattern_rules=PATTERN_RULES) -> list[Rule]:
    rules = [make_rule(a, t, True) for a, t in site_rules] + [make_rule(a, t, False) for a, t in pattern_rules]
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} can be sent to every task")
    return rules


def addresses(pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
    """page_id, host and path of each url; both empty for null or without ``://``."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    df = pages.select(F.col(id_col).cast("bigint").alias("page_id"), url.alias("u"))
    rest = F.when(F.locate("://", "u") > 0, F.expr("substring(u, locate('://', u) + 3)")).otherwise("")
    return df.select("page_id", rest.alias("rest")).select(
        "page_id", F.translate(F.regexp_extract("rest", r"^([^/?#]*)", 1), UPPER, LOWER).alias("host"),
        F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"))


def token_counts(urls: DataFrame, tokens: set[str]) -> dict[str, int]:
    """How many addresses hold each token of the rules; at most one row for each token reaches the driver."""
    def count(batches: Iterator[pa.RecordBatch]):
        n = Counter()
        for b in batches:
            for host, path in zip(b.column("host").to_pylist(), b.column("path").to_pylist()):
                n.update({t.lower() for t in TOKEN.findall(host + path)} & tokens)
        yield batch([("token", pa.string()), ("n", pa.int64())], list(n), list(n.values()))
    part = urls.select("host", "path").mapInArrow(count, "token string, n bigint")
    return {r["token"]: r["n"] for r in part.groupBy("token").agg(F.sum("n").alias("n")).collect()}


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[Rule] | None = None,
          otherwise: str = "allow") -> DataFrame:
    """One row for each row of ``pages``: page_id, host, path, rule (the longest fitting site rule), verdict, pattern
    (the longest fitting pattern where no site rule fits; ties to the smaller text).

    Null ids stay null, null or odd urls have an empty host and path, repeated rows are judged each, an empty table
    gives an empty result; other columns are not read.
    """
    rules = make_rules() if rules is None else rules
    urls = addresses(pages, id_col, url_col)
    held = token_counts(urls, {t for r in rules for t in r.tokens})

    def run(batches: Iterator[pa.RecordBatch]):
        index, always = defaultdict(list), []
        for r in rules:
            entry = (r, re.compile(r.regex, re.S))
            rarest = min(r.tokens, key=lambda t: (held.get(t, 0), t), default=None)
            (always if rarest is None else index[rarest]).append(entry)
        for b in batches:
            host, path = b.column("host").to_pylist(), b.column("path").to_pylist()
            out = []
            for h, p in zip(host, path):
                at = h + p
                found = list(always)
                for t in {t.lower() for t in TOKEN.findall(at)}:
                    found += index.get(t, ())
                fit = [r for r, rx in found if rx.search(at)]
                key = lambda r: (-len(r.text), r.text)
                site = min((r for r in fit if r.site), key=key, default=None)
                other = None if site else min((r for r in fit if not r.site), key=key, default=None)
                out.append((site and site.text, (site or other).action if site or other else otherwise,
                            other and other.text))
            cols = zip(*out) if out else ([], [], [])
            yield batch(NAMES, b.column("page_id"), b.column("host"), b.column("path"), *map(list, cols))

    return urls.mapInArrow(run, "page_id bigint, host string, path string, rule string, verdict string, pattern string")


def _like(rule: str) -> str:
    host, path = rule.split("/", 1)
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}'))"


ORACLE["op2_url_filters"] = f"""
WITH a AS (SELECT page_id, coalesce(url, '') AS u FROM pages),
b AS (SELECT page_id, CASE WHEN strpos(u, '://') > 0 THEN substr(u, strpos(u, '://') + 3) ELSE '' END AS rest FROM a),
c AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM b),
d AS (SELECT *, CASE {' '.join(f"WHEN {_like(r)} THEN '{r}'"
                               for _, r in sorted(SITE_RULES, key=lambda x: (-len(x[1]), x[1])))} END AS rule FROM c),
e AS (SELECT *, CASE WHEN rule IS NOT NULL THEN NULL
  WHEN regexp_matches(host || path, '^([^/]*\\.)?[^\\n]*\\.ads-track\\.') THEN '||*.ads-track.'
  {' '.join(f"WHEN regexp_matches(host || path, '{rx}') THEN '{t}'" for t, rx in [
      ('/doubleclick/', '/doubleclick/'), ('||ads-track.', '^([^/]*[.])?ads-track[.]'),
      ('/robots.txt|', '/robots[.]txt$'), ('||adserver.', '^([^/]*[.])?adserver[.]'),
      ('/popunder^', '/popunder([^A-Za-z0-9_.%-]|$)')])} END AS pattern FROM d)
SELECT page_id, host, path, rule, CASE {' '.join(f"WHEN rule = '{r}' THEN '{a}'" for a, r in SITE_RULES)}
  WHEN pattern = '/robots.txt|' THEN 'allow' WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, pattern
FROM e"""


@query("op2_url_filters")
def op2(spark, d) -> DataFrame:
    return judge(table(spark, d, "pages"))
