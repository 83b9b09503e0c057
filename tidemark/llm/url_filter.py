"""URL filter: allow and block rules by host and path prefix, the longest match first.

The rules are a trie over reversed host labels and then path segments. What follows a
path's last slash may be a part of a segment; a node finds it by the lengths that its
rules have there, the longest first. The trie is broadcast as the list of its rules and
built once in each worker process. More than `MOST_RULES` rules are dealt to as many
tries as they need, and the pages pass one after the other, each row keeping the longest
match so far, so that a worker and the driver hold one trie at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._spark import cut, table

#: Rules of a trie, about (with its rules it takes some 900 bytes for each).
MOST_RULES = 500_000


class Rule(NamedTuple):
    """host in lower case; path as a prefix, from its slash on."""

    verdict: str
    host: str
    path: str

    def __str__(self) -> str:
        return self.host + self.path


# The rules of the query.
RULES = [Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/")]

_PARTS = re.compile(r"://([^/?#]*)([^?#]*)", re.DOTALL)
_FOLD = {c: c + 32 for c in range(0x41, 0x5B)}


def split_url(url: str | None) -> tuple[str, str]:
    """(host with A-Z lower-cased, path); both empty without ://."""
    m = _PARTS.search(url or "")
    return (m[1].translate(_FOLD), m[2]) if m else ("", "")


class Node:
    """Labels, then under `path` segments; `own` is the rule that ends here, `ends` those with a part of a segment more, by that part."""

    __slots__ = ("labels", "path", "segments", "own", "ends", "sizes")

    def __init__(self):
        self.labels = self.path = self.segments = self.own = self.ends = self.sizes = None


class Trie:
    """Nodes of host labels from the right, then of path segments; what a node doesn't have costs it nothing."""

    def __init__(self, rules: list[Rule]):
        self.root = Node()
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.split(".")) if rule.host else ():
                if node.labels is None:
                    node.labels = {}
                node = node.labels.get(label) or node.labels.setdefault(label, Node())
            node.path = node = node.path or Node()
            *segments, rest = rule.path.split("/")
            for segment in segments:
                if node.segments is None:
                    node.segments = {}
                node = node.segments.get(segment) or node.segments.setdefault(segment, Node())
            # what follows the last slash may be a part of a segment
            held = (node.ends or {}).get(rest) if rest else node.own
            if held is not None and (rule.verdict, str(rule)) >= (held.verdict, str(held)):
                continue
            if not rest:
                node.own = rule
                continue
            if node.ends is None:
                node.ends, node.sizes = {}, []
            node.ends[rest] = rule
            if len(rest) not in node.sizes:
                node.sizes.append(len(rest))
                node.sizes.sort(reverse=True)

    def find(self, host: str, path: str) -> Rule | None:
        """The rule that fits with the longest host and path together; of equals the one with the longer host, then allow before block."""
        best, size = None, (-1, -1)
        segments = path.split("/")
        node: Node | None = self.root
        labels = reversed(host.split(".")) if host else iter(())
        while node is not None:
            at, k = node.path, 0
            while at is not None:
                fits = at.own
                for n in at.sizes or ():
                    if n <= len(segments[k]) and (rule := at.ends.get(segments[k][:n])) is not None:
                        fits = rule
                        break
                if fits is not None and (new := (len(fits.host) + len(fits.path), len(fits.host))) > size:
                    best, size = fits, new
                at = at.segments.get(segments[k]) if at.segments and k < len(segments) - 1 else None
                k += 1
            node = node.labels.get(label) if node.labels and (label := next(labels, None)) is not None else None
        return best


_JUDGED = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()), ("size", pa.int64())])
_JUDGED_SQL = "page_id long, host string, path string, rule string, verdict string, size long"


_tries: dict[str, Trie] = {}


def _trie(key: str, rules: list[tuple]) -> Trie:
    """A worker process keeps the last trie that it built."""
    if key not in _tries:
        _tries.clear()
        _tries[key] = Trie([Rule(*r) for r in rules])
    return _tries[key]


def _tries_of(spark: SparkSession, rules: list[Rule] | DataFrame) -> Iterator[tuple]:
    """(broadcast rules, a key for them) of each trie; one if the rules fit into it, even without any."""
    if isinstance(rules, DataFrame):
        rules = rules.select("verdict", "host", "path").distinct()
        total = rules.count()
        parts = 1 if total <= MOST_RULES else -(-2 * total // MOST_RULES)
        part = F.pmod(F.xxhash64("host", "path"), F.lit(parts).cast("long"))
        blocks = ([tuple(r) for r in rules.where(part == k).collect()] for k in range(parts))
    else:
        blocks = ([tuple(r) for r in rules[k : k + MOST_RULES]] for k in range(0, max(1, len(rules)), MOST_RULES))
    for held in blocks:
        yield spark.sparkContext.broadcast(held), hashlib.sha256(repr(sorted(held)).encode()).hexdigest()


def filter_urls(pages: DataFrame, rules: list[Rule] | DataFrame = RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of each row of pages.

    A rule fits its host and all subdomains where the URL's path starts with the
    rule's; the longest wins, of equals the longer host, of equal rules allow. Without a
    rule that fits, rule is null and the verdict the default. A null URL or one without
    :// has an empty host and path; a very long one is split like others; null ids stay;
    repeated rows are judged each; an empty table gives no rows. Other columns are not
    read. Rules are a list, or a table with verdict, host and path, of any length.
    """

    def of(sent, key: str, first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trie = _trie(key, sent.value)
            for batch in batches:
                if first:
                    parts = [split_url(x) for x in batch.column("url").to_pylist()]
                    best = [(None, default, -1)] * len(parts)
                else:
                    parts = list(zip(*(batch.column(c).to_pylist() for c in ("host", "path")), strict=True))
                    best = list(zip(*(batch.column(c).to_pylist() for c in ("rule", "verdict", "size")), strict=True))
                for k, p in enumerate(parts):
                    if (r := trie.find(*p)) is not None:
                        # by length, then by the host's; the same rule may come twice, with either verdict
                        new = (str(r), r.verdict, (len(r.host) + len(r.path)) << 31 | len(r.host))
                        if new[2] > best[k][2] or new[2] == best[k][2] and new[1] < best[k][1]:
                            best[k] = new
                columns = [pa.array([x[k] for x in parts], pa.string()) for k in (0, 1)] + [pa.array([x[k] for x in best], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))]
                yield pa.record_batch([batch.column("page_id"), *columns], schema=_JUDGED)

        return run

    rows, out = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")), None
    for sent, key in _tries_of(pages.sparkSession, rules):
        out = (rows if out is None else cut(out)).mapInArrow(of(sent, key, out is None), _JUDGED_SQL)
    return out.drop("size")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


OP8_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), rules(verdict, rhost, rpath) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), numbered AS (
  SELECT row_number() OVER () AS n, * FROM parts
), fits AS (
  SELECT n, rhost || rpath AS rule, verdict,
         row_number() OVER (PARTITION BY n ORDER BY length(rhost || rpath) DESC) AS k
  FROM numbered JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM numbered LEFT JOIN (SELECT * FROM fits WHERE k = 1) USING (n)
"""
