"""URL allow and block rules as a sorted digest array.

``build_index`` turns a table of rules into one file: the 64-bit xxhash keys of ``host + path`` in
ascending order, and the rules' full strings in the same order. Every task memory-maps that file, probes
all candidate keys of a batch of URLs with one vectorised binary search, and confirms each hit against
the stored string, so that colliding digests never decide anything. The file may be larger than a
worker's memory; only the pages that probes touch are read.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from fityard.runtime import shared_dir

RULE_SCHEMA = "host string, path string, verdict string"
VERDICTS = ("block", "allow")  # position = stored byte
_LOWER = {i: i + 32 for i in range(65, 91)}


def url_parts(url: str | None) -> tuple[str, str]:
    """Host (after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased) and path (from there up
    to ``? #`` or the end). Both are empty for a null or a URL without ``://``."""
    if url is None:
        return "", ""
    at = url.find("://")
    if at < 0:
        return "", ""
    rest = re.split(r"[?#]", url[at + 3:], maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


def _digests(keys: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(k.encode()) for k in keys), dtype=np.uint64, count=len(keys))


def build_index(spark: SparkSession, rules: DataFrame) -> str:
    """Write the rules' digest array to the shared folder, hand it to the executors, return its name.

    ``rules`` has host, path and verdict (``allow`` or ``block``). Hosts are lower-cased (A-Z). Nulls in
    host or path count as empty; a rule with an empty host or an unknown verdict is an error; of several
    rules with equal host and path, ``block`` counts. The rules come to the driver sorted, one partition
    at a time, and go into the file as they come.
    """
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            bad = [r for r in rows if not r["host"] or r["verdict"] not in VERDICTS]
            if bad:
                raise ValueError(f"not a rule: {bad[0]}")
            host = [r["host"].translate(_LOWER) for r in rows]
            rule = [h + (r["path"] or "") for h, r in zip(host, rows)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(_digests(rule).view(np.int64) ^ np.int64(-1 << 63)), pa.array(rule),
                 pa.array([h.count(".") + 1 for h in host], pa.int32()),
                 pa.array([len(r["path"] or "") for r in rows], pa.int32()),
                 pa.array([VERDICTS.index(r["verdict"]) for r in rows], pa.int32())],
                names=["key", "rule", "labels", "path_size", "verdict"])

    table = (rules.select("host", "path", "verdict")
             .mapInArrow(keyed, "key bigint, rule string, labels int, path_size int, verdict int")
             .groupBy("key", "rule", "labels", "path_size").agg({"verdict": "min"})
             .withColumnRenamed("min(verdict)", "verdict").orderBy("key", "rule"))
    keys, strings, ends, verdicts, labels, sizes = [], [], [], [], set(), set()
    end = 0
    for row in table.toLocalIterator():
        text = row["rule"].encode()
        end += len(text)
        keys.append((row["key"] ^ (-1 << 63)) & (1 << 64) - 1)
        strings.append(text)
        ends.append(end)
        verdicts.append(row["verdict"])
        labels.add(row["labels"])
        sizes.add(row["path_size"])
    head = json.dumps({"n": len(keys), "labels": sorted(labels), "path_sizes": sorted(sizes)}).encode()
    head += b" " * (-(len(head) + 8) % 8)
    name = f"url-rules-{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/fityard/{name}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    for part in (len(head).to_bytes(8, "little"), head, np.array(keys, np.uint64).tobytes(),
                 np.array([0, *ends], np.int64).tobytes(), np.array(verdicts, np.uint8).tobytes(),
                 b"".join(strings)):
        out.write(bytearray(part))
    out.close()
    spark.sparkContext.addFile(target.toString())
    return name


class DigestArray:
    """The memory-mapped file of ``build_index``."""

    def __init__(self, path: str):
        raw = np.memmap(path, dtype=np.uint8, mode="r")
        at = 8 + int(raw[:8].view(np.int64)[0])
        head = json.loads(bytes(raw[8:at]))
        n = head["n"]
        self.labels, self.path_sizes = head["labels"], head["path_sizes"]
        self.keys = raw[at:at + 8 * n].view(np.uint64)
        at += 8 * n
        self.ends = raw[at:at + 8 * (n + 1)].view(np.int64)
        at += 8 * (n + 1)
        self.verdicts = raw[at:at + n]
        self.strings = raw[at + n:]

    def find(self, wanted: list[str]) -> np.ndarray:
        """Position of each string, -1 where it isn't a rule."""
        out = np.full(len(wanted), -1, dtype=np.int64)
        if not wanted or not len(self.keys):
            return out
        digest = _digests(wanted)
        at = np.searchsorted(self.keys, digest)
        hit = np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == digest))
        for i in hit:
            k, text = int(at[i]), wanted[i].encode()
            while k < len(self.keys) and self.keys[k] == digest[i]:
                if bytes(self.strings[self.ends[k]:self.ends[k + 1]]) == text:
                    out[i] = k
                    break
                k += 1
        return out

    def candidates(self, host: str, path: str) -> list[str]:
        """Every ``host + path`` that could be a rule for the URL, longest first: the host's own name and
        its parents with as many labels as some rule has, the path's beginnings as long as some rule's."""
        names = host.split(".") if host else []
        hosts = [".".join(names[-k:]) for k in self.labels if k <= len(names)]
        found = {h + path[:m] for h in hosts if h for m in self.path_sizes if m <= len(path)}
        return sorted(found, key=lambda x: (-len(x), x))


@lru_cache(maxsize=2)
def _mapped(path: str) -> DigestArray:
    return DigestArray(path)


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
               default: str = "allow") -> DataFrame:
    """``(id_col, host, path, rule, verdict)`` for every row.

    A rule fits its host and all subdomains, if the path begins with the rule's; the longest rule that
    fits wins. ``rule`` is its host and path together, null if none fits; then the verdict is ``default``.
    Null URLs, URLs without ``://`` and empty hosts fit no rule. Null ids and repeated rows are judged like
    others; other columns are not read; without rules everything gets ``default``. Nothing is shuffled
    but the rules.
    """
    name = build_index(pages.sparkSession, rules)
    kind = pages.schema[id_col].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _mapped(SparkFiles.get(name))
        for batch in batches:
            parts = [url_parts(u) for u in batch.column(1).to_pylist()]
            sets = [index.candidates(h, p) for h, p in parts]
            found = index.find([c for s in sets for c in s])
            rule, verdict, at = [], [], 0
            for s in sets:
                k = next((k for k in range(at, at + len(s)) if found[k] >= 0), None)
                rule.append(None if k is None else s[k - at])
                verdict.append(default if k is None else VERDICTS[index.verdicts[found[k]]])
                at += len(s)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([h for h, _ in parts], pa.string()),
                 pa.array([p for _, p in parts], pa.string()), pa.array(rule, pa.string()),
                 pa.array(verdict, pa.string())], names=["id", "host", "path", "rule", "verdict"])

    rows = pages.select(pages[id_col].alias("id"), pages[url_col].cast("string").alias("url"))
    out = rows.mapInArrow(judge, f"id {kind}, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("id", id_col)
