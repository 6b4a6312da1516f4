"""URL filter over a sorted array of digests.

A rule is a host and a path prefix with a verdict.  It fits its host and every subdomain when the url's path starts
with the rule's path; of the rules that fit, the longest wins (then the longer host).  A url no rule fits is allowed.

The index is one file: the 64-bit xxhash of every ``host + path`` rule, sorted, beside the stored strings and verdicts.
It is shipped to each executor as a Spark file and memory-mapped by the workers.  A url's candidate keys are its host
suffixes times the rule path lengths that occur; all keys of a batch are probed by one vectorised binary search, and
a hit counts only if the stored string agrees, so colliding digests can't change a verdict.

Above MAX_INDEX_RULES rules nothing is shipped: candidate keys are joined with the rule table by a shuffle.

Defined cases: a null url or one without ``://`` has an empty host and path, fits no rule and is allowed; repeated rows
are judged each; an empty rule list allows everything; repeated rules count once, block before allow.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import cut, table

#: (host, path, verdict) of the query.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
#: Rules that one index file may hold; with 100 bytes a rule it stays under 200 MB.
MAX_INDEX_RULES = 2_000_000
DEFAULT = "allow"
VERDICTS = ("block", "allow")

SCHEMA = "page_id long, host string, path string, rule string, verdict string"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def host_suffixes(host: str) -> list[str]:
    out = [host]
    at = host.find(".")
    while at >= 0:
        out.append(host[at + 1 :])
        at = host.find(".", at + 1)
    return out


class DigestIndex:
    """Sorted digests, stored strings (``host`` NUL ``path``) and verdicts of the rules in one memory-mapped file."""

    def __init__(self, path: str):
        head = np.fromfile(path, dtype=np.int64, count=3)
        n, n_lengths, n_blob = map(int, head)
        at = 24
        self.lengths = np.memmap(path, np.int64, "r", at, (n_lengths,)).tolist() if n_lengths else []
        at += 8 * n_lengths
        if not n:
            self.keys = np.empty(0, np.uint64)
            return
        self.keys = np.memmap(path, np.uint64, "r", at, (n,))
        at += 8 * n
        self.starts = np.memmap(path, np.int64, "r", at, (n + 1,))
        at += 8 * (n + 1)
        self.verdicts = np.memmap(path, np.uint8, "r", at, (n,))
        at += n
        self.blob = np.memmap(path, np.uint8, "r", at, (n_blob,))

    @staticmethod
    def write(rules: list[tuple[str, str, str]], path: str) -> None:
        best = {}
        for host, prefix, verdict in rules:
            key = f"{host}\0{prefix}".encode()
            best[key] = min(VERDICTS.index(verdict), best.get(key, 1))
        rows = sorted((xxhash.xxh64_intdigest(k), k, v) for k, v in best.items())
        lengths = sorted({len(p) for _, p, _ in rules})
        blob = b"".join(k for _, k, _ in rows)
        with open(path, "wb") as f:
            np.array([len(rows), len(lengths), len(blob)], np.int64).tofile(f)
            np.array(lengths, np.int64).tofile(f)
            np.array([h for h, _, _ in rows], np.uint64).tofile(f)
            np.cumsum([0, *(len(k) for _, k, _ in rows)]).astype(np.int64).tofile(f)
            np.array([v for _, _, v in rows], np.uint8).tofile(f)
            f.write(blob)

    def find(self, keys: list[bytes], digests: np.ndarray) -> np.ndarray:
        """Index of each key among the rules, or -1."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.keys) or not len(keys):
            return out
        at = np.searchsorted(self.keys, digests, "left")
        hits = np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == digests))
        for i in hits:
            j = int(at[i])
            while j < len(self.keys) and self.keys[j] == digests[i]:  # equal digests lie side by side
                if self.blob[self.starts[j] : self.starts[j + 1]].tobytes() == keys[i]:
                    out[i] = j
                    break
                j += 1
        return out

    def judge(self, hosts: list[str], paths: list[str]) -> tuple[list[str | None], list[str]]:
        owner, keys = [], []
        for i, (host, path) in enumerate(zip(hosts, paths)):
            suffixes = host_suffixes(host) if host else []
            for n in self.lengths:
                if n > len(path):
                    break
                keys.extend(f"{s}\0{path[:n]}".encode() for s in suffixes)
                owner.extend([i] * len(suffixes))
        found = self.find(keys, np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys)))
        rules: list[str | None] = [None] * len(hosts)
        verdicts, rank = [DEFAULT] * len(hosts), [(-1, -1)] * len(hosts)
        for k in np.flatnonzero(found >= 0):
            host, path = keys[k].decode().split("\0", 1)
            i, r = owner[k], (len(host) + len(path), len(host))
            if r > rank[i]:
                rank[i], rules[i], verdicts[i] = r, host + path, VERDICTS[self.verdicts[found[k]]]
        return rules, verdicts


def _judge_batches(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    index = DigestIndex(SparkFiles.get(name))
    for b in batches:
        rules, verdicts = index.judge(b.column(1).to_pylist(), b.column(2).to_pylist())
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), b.column(2), pa.array(rules, pa.string()), pa.array(verdicts, pa.string())],
            ["page_id", "host", "path", "rule", "verdict"],
        )


def judge_pages(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule (null where none fits) and verdict of every row of pages."""
    spark = pages.sparkSession
    host, path = url_parts(F.col(url_col))
    parts = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    if len(rules) > MAX_INDEX_RULES:
        return judge_by_join(parts, spark.createDataFrame(rules, "rule_host string, rule_path string, rule_verdict string"))
    name = f"url-rules-{uuid.uuid4().hex}.bin"
    local = os.path.join(tempfile.mkdtemp(prefix="url-rules-"), name)
    DigestIndex.write(rules, local)
    spark.sparkContext.addFile(local)
    return parts.mapInArrow(lambda batches: _judge_batches(batches, name), SCHEMA)


def judge_by_join(parts: DataFrame, rules: DataFrame) -> DataFrame:
    """The same verdicts by a shuffled join of candidate keys, for rule lists of any size."""
    longest = parts.agg(F.max(F.length("path"))).first()[0] or 0  # longer rules can't fit
    n = F.length("rule_path")
    lengths = sorted(r[0] for r in rules.where(n <= longest).select(n).distinct().collect())
    known = F.split(F.lit(",".join(map(str, lengths))), ",") if lengths else F.array()
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), ".")
    )
    prefixes = F.transform(
        F.filter(known.cast("array<int>"), lambda n: n <= F.length("path")), lambda n: F.substring("path", F.lit(1), n)
    )
    row = cut(parts.withColumn("row", F.monotonically_increasing_id()))  # numbered once: both sides read the same rows
    keyed = row.where("host != ''").select("row", F.explode(suffixes).alias("rule_host"), prefixes.alias("p"))
    keyed = keyed.select("row", "rule_host", F.explode("p").alias("rule_path"))
    once = rules.groupBy("rule_host", "rule_path").agg(F.max("rule_verdict").alias("rule_verdict"))  # block before allow
    rule = F.concat("rule_host", "rule_path")
    best = keyed.join(once, ["rule_host", "rule_path"]).groupBy("row").agg(
        F.max_by(F.struct(rule.alias("rule"), F.col("rule_verdict").alias("verdict")), F.struct(F.length(rule), F.length("rule_host"))).alias("b")
    )
    return row.join(best, "row", "left").select(
        "page_id", "host", "path", "b.rule", F.coalesce("b.verdict", F.lit(DEFAULT)).alias("verdict")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_pages(table(spark, sf_dir, "pages"), RULES)


ORACLE_SQL = r"""
WITH u AS (
  SELECT page_id,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
p AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u),
r(h, p, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
                      ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
m AS (
  SELECT x.page_id, x.host, x.path, r.h || r.p AS rule, r.v,
         row_number() OVER (PARTITION BY x.page_id ORDER BY length(r.h || r.p) DESC, length(r.h) DESC) AS k
  FROM p x LEFT JOIN r ON (x.host = r.h OR ends_with(x.host, '.' || r.h)) AND starts_with(x.path, r.p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1
"""
