"""Line dedup (7): winnowing over line hashes, in DataFrame operations alone.

Of every RUN consecutive lines the one with the least hash is their fingerprint, so two places that share such a run share
its fingerprint. Only runs whose fingerprint occurs at two places or more go on; each is matched with the earliest place of
the same run, matches that overlap grow into longer ones both ways, and all but the earliest are deleted. With a bound in
words, shorter runs above it and whole documents of fewer lines are matched as well, by their hashes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspring.llm.common import WORD, Scratch

#: Consecutive lines that are deleted if they stand somewhere earlier.
RUN = 3
#: What is trimmed off a line before it is compared: the characters that separate words.
TRIM = " \t\x0b\x0c\r"


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(TRIM))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with __id and __hash, which name a document: its id (null sorts last) and a hash of its text."""
    return docs.withColumns({"__id": F.coalesce(docs[id_col].cast("long"), F.lit((1 << 63) - 1)), "__hash": F.xxhash64(F.coalesce(docs[text_col], F.lit("")))})


def short_runs(base: DataFrame, run: int, words: int) -> DataFrame:
    """key, place: runs of fewer than `run` lines with more than `words` words, and whole documents of fewer than `run` lines."""
    at, size = F.sequence(F.lit(0), F.size("lines") - 1), F.size("lines")

    def runs(n: int | Column, kind: int, good: Callable[[Column], Column]) -> Column:
        hashes = lambda i: F.transform(F.slice("lines", i + 1, n), lambda x: x["h"])
        return F.transform(F.filter(at, good), lambda i: F.struct(F.xxhash64(F.lit(kind), hashes(i)).alias("key"), i.alias("start"), (n if isinstance(n, Column) else F.lit(n)).alias("n")))

    def wordy(n: int) -> Callable[[Column], Column]:
        return lambda i: (i + n <= size) & (F.aggregate(F.slice("lines", i + 1, n), F.lit(0), lambda a, x: a + x["words"]) > words)

    rows = [*(runs(n, n, wordy(n)) for n in range(1, run)), runs(size, 0, lambda i: (i == 0) & (size < run))]
    found = base.select("__id", "__hash", F.explode(F.concat(*rows)).alias("r"))
    return found.select("r.key", F.struct("__id", "__hash", "r.start", "r.n").alias("place"))


def later_lines(docs: DataFrame, run: int = RUN, id_col: str = "doc_id", text_col: str = "text", words: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """__id, __hash and gone: the numbers (from 0) of the lines to delete, for the documents that have any.

    Places are ordered by doc_id, then line. Lines are compared without the spaces around them; those without a word take
    no part and stay. Documents of fewer than `run` lines have no runs, unless `words` is given: then runs of fewer lines
    but more words than that go too, and documents of fewer lines that are copies of an earlier one.
    """
    docs = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    id_col, text_col = "id", "text"
    lines = F.transform(F.split(F.coalesce(docs[text_col], F.lit("")), "\n", -1), lambda x, i: F.struct(F.xxhash64(trimmed(x)).alias("h"), i.alias("line"), (trimmed(x) != "").alias("full"), *([] if words is None else [F.regexp_count(x, F.lit(WORD)).alias("words")])))
    names = ["h", "line", *([] if words is None else ["words"])]
    plain = F.transform(F.filter(lines, lambda x: x["full"]), lambda x: F.struct(*(x[c].alias(c) for c in names)))
    base = keyed(docs, id_col, text_col).select("__id", "__hash", plain.alias("lines")).where(F.size("lines") >= (run if words is None else 1)).distinct()
    base = (scratch or Scratch(docs.sparkSession)).stored(base, "lines")
    long = base if words is None else base.where(F.size("lines") >= run)

    starts = F.sequence(F.lit(0), F.size("lines") - run)
    least = lambda i: F.array_min(F.slice("lines", i + 1, run))  # noqa: E731  of equal hashes the first line
    prints = long.select(F.explode(F.array_distinct(F.transform(starts, least))).alias("p")).groupBy(F.col("p.h").alias("print")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("print")

    of = lambda i: F.struct(least(i)["h"].alias("print"), F.xxhash64(F.transform(F.slice("lines", i + 1, run), lambda x: x["h"])).alias("key"), i.alias("start"))
    runs = long.select("__id", "__hash", F.explode(F.transform(starts, of)).alias("r")).select("__id", "__hash", "r.print", "r.key", "r.start")
    runs = runs.join(prints.hint("merge"), "print", "left_semi").select("key", F.struct("__id", "__hash", "start", F.lit(run).alias("n")).alias("place"))
    if words is not None:
        runs = runs.unionByName(short_runs(base, run, words))
    first = runs.groupBy("key").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = runs.join(first.hint("merge"), "key").where(F.col("place") > F.col("first")).select("place.*")
    grown = later.groupBy("__id", "__hash").agg(F.collect_set(F.struct("start", "n")).alias("spans"))
    # the numbers among lines with a word, then among all lines
    which = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1))))
    found = grown.join(base.hint("merge"), ["__id", "__hash"]).select("__id", "__hash", which.alias("which"), "lines")
    return found.select("__id", "__hash", F.transform("which", lambda i: F.col("lines")[i]["line"]).alias("gone"))


def line_dedup(docs: DataFrame, run: int = RUN, id_col: str = "doc_id", text_col: str = "text", words: int | None = None) -> DataFrame:
    """docs with the later repeats of runs of `run` lines or more deleted from the texts, and with `words` those of shorter
    runs of more words and of whole shorter documents; __lines and __gone count the lines before and those deleted.

    Null texts stay null. Rows of one doc_id and text are one document, whatever their number; rows of one doc_id with
    different texts are different documents. An empty table gives no rows. All columns are kept, whatever their names, but
    __lines and __gone, which are replaced. A text's lines must fit into a row of Spark's.
    """
    names = [c for c in docs.columns if c not in ("__lines", "__gone")]
    scratch = Scratch(docs.sparkSession)
    gone = scratch.stored(later_lines(docs, run, id_col, text_col, words, scratch), "gone")
    scratch.drop(gone)
    # the caller's columns go in a struct, so that none clashes with those used here
    packed = docs.select(F.struct(*(docs[c] for c in names if c != text_col)).alias("row"), docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    rows = keyed(packed, "id", "text").withColumn("split", F.split("text", "\n", -1)).drop("text", "id")
    # the same join at every size, and one that Spark splits where many copies meet
    joined = rows.join(gone.hint("merge"), ["__id", "__hash"], "left")
    kept = F.array_except(F.sequence(F.lit(0), F.size("split") - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.array_join("split", "\n")).otherwise(F.array_join(F.transform(kept, lambda i: F.col("split")[i]), "\n"))
    counts = [F.coalesce(F.size("split"), F.lit(0)).cast("long").alias("__lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("__gone")]
    return joined.select(*(text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in names), *counts)
