"""Spelling variant grouping (12): words of a corpus one edit apart, by a positional q-gram inverted index with a count filter.

One edit leaves the first or the last half of the shorter word as it is, so words are dealt into shards by their halves, as
long positional grams, together with the lengths that may meet. In a shard the rest of each word has its bigrams, padded at
both ends, in an inverted index by gram, place and length. Two rests one edit apart share at least max(lengths) - 1 of them at
places that differ by one at most; so it is enough to merge, by a heap, the few shortest postings of a word's grams, those that
no partner can miss all of, and to count the other grams for what comes out. What is left is verified. Crowded shards are
dealt again by halves of the rests.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from heapq import merge

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspring.llm.common import Scratch, lower_ascii, partitions, trimmed

#: Least code points and occurrences of a word, and how many times as frequent a form must be.
LEAST_LENGTH, LEAST_COUNT, TIMES = 7, 2, 10
#: Words of a shard above which it is dealt again, as long as its rests have more than one letter (the longer ones two): of 90
#: letters there are 8,190 such rests, so no shard is larger than this.
CROWDED = 9_000
#: Fixed value: what the contract counts as letters of a word.
RUN = r"[A-Za-zÀ-ÿ]"


def damaged(run: Column, key: Column) -> Column:
    """The lower-cased run; where 31 divides the checksum of "<key>:<run>", without one letter that the checksum names."""
    h = F.crc32(F.concat(key, F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % 31 == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n. Runs of fewer letters can't become words, so they are left out before they are counted; counts are summed in
    each task first."""
    key = F.coalesce(docs[id_col].cast("string"), F.lit(""))
    runs = docs.select(key.alias("key"), F.explode(F.regexp_extract_all(F.coalesce(docs[text_col].cast("string"), F.lit("")), F.lit(f"({RUN}{{{least_length},}})"), 1)).alias("run"))
    words = runs.select(damaged(lower_ascii("run"), F.col("key")).alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def dealt(rest: Column, prefix: Column, shorter: Column, long: Column, word: Column) -> Column:
    """Two rows for the shards that share the first and the last half of `shorter` letters of a rest."""
    head = F.floor(shorter / 2).cast("int")
    tail = shorter - head
    size = F.length(rest)
    row = lambda side, common, left, n: F.struct(F.concat(prefix, F.lit(side), common).alias("shard"), left.alias("rest"), n.alias("shorter"), long.alias("long"), word.alias("word"))
    return F.array(row("<", F.substr(rest, F.lit(1), head), F.substr(rest, head + 1), tail), row(">", F.substr(rest, size - tail + 1), F.substr(rest, F.lit(1), size - tail), head))


def shards(words: DataFrame) -> DataFrame:
    """shard, rest, shorter, long, word, n: each word in the shards of its length and, as the longer one, of a length less."""
    size = F.length("word")
    roles = [dealt(F.col("word"), F.concat(m.cast("string"), F.lit(":")), m, F.lit(is_long), F.col("word")) for m, is_long in ((size, False), (size - 1, True))]
    return words.select("n", F.explode(F.concat(*roles)).alias("s")).select("s.*", "n")


def spread(words: DataFrame, scratch: Scratch, crowded: int = CROWDED) -> DataFrame:
    """shards() with the crowded ones dealt again, as often as there are any that can be."""
    held, done = scratch.stored(shards(words), "shards"), None
    while True:
        full = held.where("shorter > 1").groupBy("shard").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > crowded).select("shard")
        full = scratch.stored(full, "crowded")
        if full.isEmpty():
            return held if done is None else done.unionByName(held)
        rest = held.join(full, "shard", "left_anti")
        done = rest if done is None else done.unionByName(rest)
        again = held.join(full, "shard", "left_semi").select("n", F.explode(dealt(F.col("rest"), F.concat("shard", F.lit("/")), F.col("shorter"), F.col("long"), F.col("word"))).alias("s")).select("s.*", "n")
        held = scratch.stored(again, "shards")


def one_edit(a: str, b: str) -> bool:
    """Whether b, as long as a or one longer, is a with exactly one letter replaced or put in."""
    i, n = 0, len(a)
    while i < n and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] and i < n if len(b) == n else a[i:] == b[i + 1 :]


def grams(rest: str) -> list[str]:
    padded = f"\x02{rest}\x03"
    return [padded[i : i + 2] for i in range(len(padded) - 1)]


def merged(postings: list[list[int]]) -> Iterator[int]:
    """The numbers in any of some sorted postings, once each."""
    last = -1
    for k in merge(*postings):
        if k != last:
            last = k
            yield k


def near_rests(short: list[str], long: list[str]) -> Iterator[tuple[int, int, bool]]:
    """Pairs one edit apart, as numbers in `short` and in `short` (the second greater) or `long` (then True). All of `short` have
    one length, and all of `long` one letter more."""
    if not short:
        return
    n = len(short[0])
    index: dict[tuple[bool, int, str], list[int]] = defaultdict(list)
    for is_long, rests in ((False, short), (True, long)):
        for k, rest in enumerate(rests):
            for i, g in enumerate(grams(rest)):
                index[is_long, i, g].append(k)
    none: list[int] = []
    for k, rest in enumerate(short):
        own = grams(rest)
        # equal lengths: n - 1 of n + 1 grams at their places, so at least one of any three
        need = n - 1
        if need > 0:
            lists = sorted((index[False, i, g] for i, g in enumerate(own)), key=len)[: len(own) - need + 1]
            found = merged([x[bisect_right(x, k) :] for x in lists])
        else:
            found = range(k + 1, len(short))
        for j in found:
            if sum(a == b for a, b in zip(own, grams(short[j]), strict=True)) >= need and one_edit(rest, short[j]):
                yield k, j, False
        if not long:
            continue
        # a letter more: n of n + 1 grams, at their place or the next, so at least one of any two
        need = n
        if need > 0:
            pairs = sorted(((index.get((True, i, g), none), index.get((True, i + 1, g), none)) for i, g in enumerate(own)), key=lambda x: len(x[0]) + len(x[1]))[: len(own) - need + 1]
            found = merged([x for p in pairs for x in p if x])
        else:
            found = range(len(long))
        for j in found:
            other = grams(long[j])
            if sum(g in (other[i], other[i + 1]) for i, g in enumerate(own)) >= need and one_edit(rest, long[j]):
                yield k, j, True


def first_shared(shard: str, a: str, b: str) -> bool:
    """Whether this shard is the first by which the pair meets: at no step it goes by the last halves where the first are equal."""
    short, long = sorted((a, b), key=len)
    low, high = 0, len(short)  # of the shorter word's rest; the longer one's begins at the same letter
    for step in shard.partition(":")[2].split("/"):
        half = (high - low) // 2
        if step[0] == "<":
            low += half
        else:
            if short[low : low + half] == long[low : low + half]:
                return False
            high = low + half
    return True


def near_words(words: DataFrame, scratch: Scratch) -> DataFrame:
    """word, n_near and best (the near word of the largest n, of equal ones the first in code-point order, with its n), for the
    words that have a near one. words has word and n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows = None, []
        out: list[tuple[str, int, int, str]] = []

        def close() -> None:
            if len(rows) < 2:
                return
            sides = [[r for r in rows if not r[1]], [r for r in rows if r[1]]]
            found: dict[str, list] = {}

            def link(a: tuple, b: tuple) -> None:
                had = found.get(a[2])
                key = (-b[3], b[2])
                if had is None:
                    found[a[2]] = [1, key]
                else:
                    had[0] += 1
                    had[1] = min(had[1], key)

            for i, j, is_long in near_rests([r[0] for r in sides[0]], [r[0] for r in sides[1]]):
                a, b = sides[0][i], sides[is_long][j]
                if first_shared(shard, a[2], b[2]):
                    link(a, b)
                    link(b, a)
            out.extend((w, c, -minus, best) for w, (c, (minus, best)) in found.items())

        def flushed() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "n_near", "form_n", "form"])
            out.clear()
            return made

        for batch in batches:
            for name, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != shard:
                    close()
                    shard, rows = name, []
                    if len(out) >= 10_000:
                        yield flushed()
                rows.append(tuple(row))
        close()
        if out:
            yield flushed()

    dealt_out = spread(words, scratch)
    ordered = dealt_out.repartition(partitions(words.sparkSession), "shard").sortWithinPartitions("shard")
    found = ordered.select("shard", "rest", "long", "word", "n").mapInArrow(trimmed(run), "word string, n_near long, form_n long, form string")
    first = F.min(F.struct((-F.col("form_n")).alias("minus"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("best")).select("word", "n_near", F.struct(F.col("best.form").alias("word"), (-F.col("best.minus")).alias("n")).alias("best"))


def rooted(forms: DataFrame, most: int, scratch: Scratch, times: int = TIMES) -> DataFrame:
    """word and root: forms (word, form) followed to their ends. Each step multiplies n by `times` at least, so the largest n
    bounds the steps, and each round doubles those taken."""
    steps, n = 0, most
    while n >= LEAST_COUNT:
        steps, n = steps + 1, n // max(times, 2)
    held, taken = forms.select("word", F.col("form").alias("root")), 1
    while taken < steps:
        onward = held.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        held = scratch.stored(held.join(onward, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")), "roots")
        taken *= 2
    return held


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: int = TIMES) -> DataFrame:
    """word, n, n_near, form, form_n and root of each word of the corpus.

    Words are runs of letters with A to Z lower-cased, of LEAST_LENGTH letters and LEAST_COUNT occurrences at least, after the
    contract's damage, which depends on document and run. Two are near if they differ by exactly one letter put in, taken out
    or replaced. A word's form is its near word of the largest n (of equal ones the first in code-point order) if that n is
    `times` the word's or more, and its root is the last of the forms that follow each other. Null texts have no words, a null id
    counts as the empty string, repeated rows count repeatedly; an empty table gives no rows; other columns, whatever their
    names, are ignored. Runs of any length are taken whole.
    """
    scratch = Scratch(docs.sparkSession)
    words = scratch.stored(word_counts(docs, id_col, text_col), "words")
    near = scratch.stored(near_words(words, scratch), "near")
    known = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("best.n") >= times * F.col("n"), F.col("best")).alias("form"))
    known = scratch.stored(known.select("word", "n", "n_near", F.col("form.word").alias("form"), F.col("form.n").alias("form_n")), "forms")
    most = words.agg(F.max("n")).head()[0] or 0
    roots = rooted(known.where("form is not null"), most, scratch, times)
    out = scratch.stored(known.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word")), "variants")
    scratch.drop(out)
    return out
