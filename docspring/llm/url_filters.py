"""URL filters (10): rules behind a sorted array of 64-bit xxhash digests. The array is memory-mapped, candidates are
probed by vectorised binary search, and what is found is confirmed against the stored strings."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspring.llm.common import lower_ascii, shared_dir

#: Rules in one file. Longer lists make several files, each with the next range of digests; all are memory-mapped.
RULES_A_FILE = 1_000_000
ALLOW, BLOCK = "allow", "block"


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A to Z lower-cased; empty without a "://" or url."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to "?", "#" or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_key(rule: str) -> bytes:
    """A rule's bytes, its host in lower case (A to Z), as urls' hosts are."""
    host, slash, path = rule.partition("/")
    return ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host) + slash + path).encode()


class RuleFile:
    """Sorted digests, then offsets, verdicts and the rules' bytes, in one file."""

    MAGIC = b"DSURLF01"

    @staticmethod
    def build(rules: Iterable[tuple[str, str]], hashed: Callable[[bytes], int] = xxhash.xxh3_64_intdigest, most: int = RULES_A_FILE) -> list[bytes]:
        """rules: (host and path in one, verdict). Of repeated rules the first counts. One file for each `most` rules, at least one."""
        first: dict[bytes, str] = {}
        for rule, verdict in rules:
            if "/" not in rule or verdict not in (ALLOW, BLOCK):
                raise ValueError(f"not a rule: {rule!r} {verdict!r}")
            first.setdefault(rule_key(rule), verdict)
        ordered = sorted(first, key=lambda k: (hashed(k), k))
        out = []
        for lo in range(0, max(1, len(ordered)), most):
            keys = ordered[lo : lo + most]
            digests = np.array([hashed(k) for k in keys], np.uint64)
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys], dtype=np.int64)]).astype(np.int64)
            verdicts = np.array([first[k] == BLOCK for k in keys], np.uint8)
            lengths = np.unique([len(k.partition(b"/")[2]) + 1 for k in keys]).astype(np.int64)
            out.append(RuleFile.MAGIC + np.array([len(keys), len(lengths)], np.int64).tobytes() + digests.tobytes() + offsets.tobytes() + lengths.tobytes() + verdicts.tobytes() + b"".join(keys))
        return out

    def __init__(self, path: str, hashed: Callable[[bytes], int] = xxhash.xxh3_64_intdigest):
        self.hashed = hashed
        raw = np.memmap(path, np.uint8, "r")
        if raw[:8].tobytes() != self.MAGIC:
            raise ValueError(f"not a rule file: {path}")
        n, m = raw[8:24].view(np.int64).tolist()
        at = 24
        self.digests, at = raw[at : at + 8 * n].view(np.uint64), at + 8 * n
        self.offsets, at = raw[at : at + 8 * (n + 1)].view(np.int64), at + 8 * (n + 1)
        #: bytes of the rules' paths: no other prefix of a path needs a probe
        self.lengths, at = raw[at : at + 8 * m].view(np.int64).tolist(), at + 8 * m
        self.verdicts, at = raw[at : at + n], at + n
        self.bytes = raw[at:]

    def probe(self, keys: list[bytes], digests: np.ndarray | None = None) -> np.ndarray:
        """The rule that each key is, or -1."""
        digests = np.fromiter(map(self.hashed, keys), np.uint64, len(keys)) if digests is None else digests
        found = np.full(len(keys), -1)
        if not len(self.digests):
            return found
        at = np.searchsorted(self.digests, digests)
        for i in np.flatnonzero(self.digests[np.minimum(at, len(self.digests) - 1)] == digests).tolist():
            k = at[i]
            while k < len(self.digests) and self.digests[k] == digests[i]:  # digests may collide; strings decide
                if self.bytes[self.offsets[k] : self.offsets[k + 1]].tobytes() == keys[i]:
                    found[i] = k
                    break
                k += 1
        return found


class Rules:
    """All files of one list of rules."""

    def __init__(self, paths: list[str]):
        self.files = [RuleFile(p) for p in paths]
        self.lengths = sorted({n for f in self.files for n in f.lengths}, reverse=True)

    def verdicts(self, keys: list[bytes]) -> list[str | None]:
        """For each key the verdict of the rule that it is."""
        digests = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
        out: list[str | None] = [None] * len(keys)
        for f in self.files:
            found = f.probe(keys, digests)
            for j in np.flatnonzero(found >= 0).tolist():
                out[j] = BLOCK if f.verdicts[found[j]] else ALLOW
        return out


def candidates(host: str, path: str, lengths: list[int]) -> list[bytes]:
    """Every rule that could fit, the one that wins first: the host and the domains above it, each with the path's prefixes.
    lengths: bytes of the rules' paths."""
    if not host or not path.startswith("/"):
        return []
    labels, whole = host.split("."), path.encode()
    prefixes = [whole[:n] for n in lengths if n <= len(whole)]
    found = [((h := ".".join(labels[i:]).encode()) + p, len(h)) for i in range(len(labels)) for p in prefixes]
    # characters of the rule, then of its host: a byte that goes on with a character doesn't count
    return [k for k, _ in sorted(found, key=lambda x: (-sum(b & 0xC0 != 0x80 for b in x[0]), -x[1]))]


_held: dict[tuple[str, ...], Rules] = {}


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], default: str = ALLOW, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, url, host, path, rule (null if none fits) and verdict, for each row of pages.

    A rule is a host and the beginning of a path ("example.org/fr/") with a verdict. It fits that host and all hosts under
    it, where the url's path starts with the rule's; of several the one of most characters wins, of equally long ones that
    with the longer host, and of a repeated rule the first. Urls that none fits get the default. A null url, or one without "://", has an empty host and path, and no rule. Repeated rows are judged each; an
    empty table gives no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    plain = pages.select(pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("url"))
    plain = plain.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    names = tuple(ship(spark, blob) for blob in RuleFile.build(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if names not in _held:
            _held[names] = Rules([SparkFiles.get(n) for n in names])
        held = _held[names]
        for batch in batches:
            keys: list[bytes] = []
            owner: list[int] = []
            for i, (host, path) in enumerate(zip(batch["host"].to_pylist(), batch["path"].to_pylist(), strict=True)):
                got = candidates(host, path, held.lengths)
                keys += got
                owner += [i] * len(got)
            rule: list[str | None] = [None] * batch.num_rows
            verdict = [default] * batch.num_rows
            for i, key, found in zip(owner, keys, held.verdicts(keys), strict=True):
                if found is not None and rule[i] is None:  # the first of a url's wins
                    rule[i], verdict[i] = key.decode(), found
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=[*batch.schema.names, "rule", "verdict"])

    kinds = ", ".join(f"{k} {v}" for k, v in plain.dtypes)
    return plain.mapInArrow(run, f"{kinds}, rule string, verdict string")


def ship(spark: SparkSession, blob: bytes) -> str:
    """Into the shared folder, and from there to each executor that runs a task, also those that start later."""
    name = f"rules-{uuid.uuid4().hex}.bin"
    path = f"{shared_dir(spark)}/docspring/{name}"
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    try:
        out.write(bytearray(blob))
    finally:
        out.close()
    spark.sparkContext.addFile(path)
    return name
