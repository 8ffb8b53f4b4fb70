"""URL verdicts from host rules and from pattern rules indexed by their rarest literal token."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithic.llm.common import Task

#: Bytes of rules that may be broadcast; larger lists are joined.
MOST_BYTES = 32 << 20

#: Host rules: (rule, verdict); the rule is a host, a slash and the beginning of a path.
HOST_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

#: Pattern rules for pages that no host rule judges. Literal text, with ``*`` for
#: anything and ``^`` for a separator or an end.
PATTERN_RULES = (
    "^porn^", "^xxx^", "^adult^", "^sex^", "^escort^", "^casino^", "^poker^", "^betting^", "^viagra^", "^cialis^",
    "^warez^", "^torrent^", "^crack^*^download^", "^phishing^", "^malware^", "^doubleclick^", "^adserver^", "^banner^ads^",
    "^click^track^", "^utm_medium=affiliate^", "^wp-login.php^", "^login^redirect^", "^cart^checkout^", "^search^q=",
    "^calendar^month=", "^calendar^*^month=", ".exe^", ".apk^", ".iso^",
)


@dataclass(frozen=True)
class PatternRule:
    pattern: str
    regex: str
    tokens: tuple[str, ...]


def parse_rule(pattern: str) -> PatternRule:
    """The regular expression of a pattern and those literal tokens that any match must hold whole.

    A token is a run of a-z and 0-9. Only runs with a separator, a literal of another kind
    or an end on both sides count: beside ``*`` the url's token may go on.
    """
    pieces = re.findall(r"[a-z0-9]+|[*^]|[^a-z0-9*^]+", pattern.lower())
    regex = "".join(".*" if p == "*" else "(?:[^a-z0-9]|^|$)" if p == "^" else re.escape(p) for p in pieces)
    bare = lambda i: 0 <= i < len(pieces) and pieces[i] != "*"
    tokens = [p for i, p in enumerate(pieces) if p[0].isalnum() and bare(i - 1) and bare(i + 1)]
    return PatternRule(pattern, regex, tuple(dict.fromkeys(tokens)))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://`` or a url."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    has = F.instr(url, "://") > 0
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    head = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    after = F.substring(rest, F.length(head) + 1, F.length(rest))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(has, F.translate(head, upper, lower)).otherwise(""), F.when(has, F.regexp_extract(after, r"^([^?#]*)", 1)).otherwise("")


class _Count:
    """Of the wanted tokens, how many urls hold each."""

    def __init__(self, wanted) -> None:
        self.wanted = wanted

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, total = self.wanted.value, Counter()
        for batch in batches:
            for url, n in Counter(batch["url"].to_pylist()).items():
                for token in wanted.intersection(_TOKEN(url)):
                    total[token] += n
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array(list(total.values()), pa.int64())], ["token", "n"])


_TOKEN = re.compile("[a-z0-9]+").findall


class Index:
    """Pattern rules under one token each, host rules under their host."""

    def __init__(self, host_rules, rules: list[PatternRule], counts: dict[str, int]) -> None:
        self.hosts: dict[str, list[tuple[str, str, str]]] = {}
        for text, verdict in host_rules:
            host, _, path = text.partition("/")
            self.hosts.setdefault(host, []).append((f"/{path}", text, verdict))
        self.under: dict[str, list[int]] = {}
        self.rest: list[int] = []
        for i, rule in enumerate(rules):
            (self.under.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t)), []) if rule.tokens else self.rest).append(i)
        self.rules = [(r.pattern, r.regex) for r in rules]

    def listed(self, host: str, path: str) -> tuple[str | None, str | None]:
        """The longest host rule that fits, and its verdict."""
        found: tuple[str | None, str | None] = (None, None)
        at = 0
        while host and at >= 0:
            for start, text, verdict in self.hosts.get(host[at:], ()):
                if path.startswith(start) and (found[0] is None or (len(text), text) > (len(found[0]), found[0])):
                    found = text, verdict
            at = host.find(".", at) + 1 or -1
        return found

    def pattern(self, url: str, compiled: dict) -> str | None:
        """The first pattern rule that matches; only candidates that a token of the url fetches are tried."""
        tried = sorted([*self.rest, *(i for t in set(_TOKEN(url)) for i in self.under.get(t, ()))])
        for i in tried:
            if i not in compiled:
                compiled[i] = re.compile(self.rules[i][1])
            if compiled[i].search(url):
                return self.rules[i][0]
        return None


class _Judge:
    def __init__(self, index) -> None:
        self.index = index

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, compiled = self.index.value, {}
        for batch in batches:
            known: dict[tuple, tuple] = {}
            out = []
            for key in zip(*[batch[c].to_pylist() for c in ("host", "path", "url")], strict=True):
                if key not in known:
                    rule, verdict = index.listed(*key[:2])
                    pattern = None if rule is not None else index.pattern(key[2], compiled)
                    known[key] = rule, verdict or ("allow" if pattern is None else "block"), pattern
                out.append(known[key])
            columns = [pa.array(c, pa.string()) for c in zip(*out, strict=True)] or [pa.array([], pa.string())] * 3
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["host"], batch["path"], *columns], ["page_id", "host", "path", "rule", "verdict", "pattern"])


def judge(pages: DataFrame, host_rules=HOST_RULES, patterns=PATTERN_RULES, most: int = MOST_BYTES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, pattern.

    The longest host rule that fits decides. Else the page is blocked if a pattern rule
    matches its url and allowed if none does. Each pattern rule stands under that of its
    tokens which the fewest urls hold; a url's tokens look up candidate rules there, and no
    other rule's regular expression runs. ``pattern`` is the first rule in order that
    matched, only where no host rule fits.

    Null urls and urls without ``://`` have an empty host and path; patterns still see
    their text. Repeated rows are judged alike, an empty table gives an empty result,
    other columns are not read. Rules of ``most`` bytes at most are sent to the executors,
    and the plan has no shuffle but for the counts of rule tokens; longer lists become
    tables that are joined with the distinct urls by token and by host, and only rules
    without a token, which have to see every url, stand in the plan one by one.
    """
    rules = [parse_rule(p) for p in patterns]
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), F.lower(F.coalesce(F.col("url").cast("string"), F.lit(""))).alias("url"))
    if sum(len(r.pattern) + len(r.regex) for r in rules) + sum(len(t) for t, _ in host_rules) > most:
        return _joined(rows, host_rules, rules)
    share = pages.sparkSession.sparkContext.broadcast
    counted = rows.select("url").mapInArrow(Task(_Count(share({t for r in rules for t in r.tokens}))), "token string, n long")
    counts = {r["token"]: r["n"] for r in counted.groupBy("token").agg(F.sum("n").alias("n")).collect()}  # a row for each token of a rule at most
    fields = [pages.schema["page_id"], *[T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict", "pattern")]]
    return rows.mapInArrow(Task(_Judge(share(Index(host_rules, rules, counts)))), T.StructType(fields))


def _joined(rows: DataFrame, host_rules, rules: list[PatternRule]) -> DataFrame:
    """The same with the rules as tables: nothing of their size is broadcast by this code, nor comes back to the driver."""
    spark = rows.sparkSession
    listed = spark.createDataFrame([(t.partition("/")[0], "/" + t.partition("/")[2], t, v) for t, v in host_rules], "on string, start string, rule string, listed string")
    table = spark.createDataFrame([(i, r.pattern, r.regex, list(r.tokens)) for i, r in enumerate(rules)], "at int, pattern string, regex string, tokens array<string>")
    urls = rows.select("host", "path", "url").distinct()
    found = F.regexp_extract_all("url", F.lit("([a-z0-9]+)"), 1)
    tokens = urls.select("url").distinct().select("url", F.explode(F.array_distinct(found)).alias("token"))
    wanted = table.select("at", F.explode("tokens").alias("token"))
    counts = tokens.join(wanted.select("token").distinct(), "token").groupBy("token").agg(F.count("*").alias("n"))
    under = wanted.join(counts, "token", "left").groupBy("at").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "token"))["token"].alias("token"))
    fetched = tokens.join(table.join(under, "at"), "token").where(F.rlike("url", F.col("regex")))
    matched = fetched.groupBy("url").agg(F.min(F.struct("at", "pattern")).alias("first"))
    labels = F.split("host", "[.]")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = urls.select("host", "path").distinct().select("host", "path", F.explode(ends).alias("on")).join(listed, "on").where(F.startswith("path", "start"))
    fits = fits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule"), "rule", "listed")).alias("best")).select("host", "path", "best.rule", "best.listed")
    out = rows.join(fits, ["host", "path"], "left").join(matched, "url", "left")
    first = F.col("first")
    for i, r in enumerate(rules):
        if not r.tokens:  # a rule without a token has to see every url
            first = F.least(first, F.when(F.rlike("url", F.lit(r.regex)), F.struct(F.lit(i).alias("at"), F.lit(r.pattern).alias("pattern"))))
    pattern = F.when(F.col("rule").isNull(), first["pattern"])
    return out.select("page_id", "host", "path", "rule", F.coalesce("listed", F.when(pattern.isNotNull(), "block").otherwise("allow")).alias("verdict"), pattern.alias("pattern"))


def oracle(host_rules=HOST_RULES, patterns=PATTERN_RULES) -> str:
    """DuckDB SQL that tries every rule on every page."""
    said = [f"('{t}', '{v}', '{t.partition('/')[0]}', '/{t.partition('/')[2]}')" for t, v in host_rules]
    tried = [f"({i}, '{r.pattern}', '{r.regex}')" for i, r in enumerate(map(parse_rule, patterns))]
    return f"""
WITH cut AS (SELECT page_id, lower(coalesce(url, '')) AS url, coalesce(url, '') AS raw, instr(coalesce(url, ''), '://') AS pos FROM pages),
rest AS (SELECT page_id, url, pos, substr(raw, pos + 3) AS rest FROM cut),
head AS (SELECT page_id, url, pos, rest, regexp_extract(rest, '^([^/?#]*)', 1) AS head FROM rest),
p AS (SELECT page_id, url, CASE WHEN pos > 0 THEN translate(head, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
  CASE WHEN pos > 0 THEN regexp_extract(substr(rest, length(head) + 1), '^([^?#]*)', 1) ELSE '' END AS path FROM head),
rules(rule, verdict, h, t) AS (VALUES {', '.join(said)}),
listed AS (SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, t) GROUP BY ALL),
patterns(pos, pattern, regex) AS (VALUES {', '.join(tried)}),
hit AS (SELECT page_id, url, arg_min(pattern, pos) AS pattern FROM p JOIN patterns ON regexp_matches(url, regex) GROUP BY ALL)
SELECT p.page_id, p.host, p.path, l.rule, coalesce(l.verdict, CASE WHEN hit.pattern IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
  CASE WHEN l.rule IS NULL THEN hit.pattern END AS pattern
FROM p LEFT JOIN listed l ON p.page_id = l.page_id AND p.host = l.host AND p.path = l.path LEFT JOIN hit ON p.page_id = hit.page_id AND p.url = hit.url
"""
