"""Language ID (9): the language family first, then one-versus-one linear support vector machines within the family.

Features are the frequencies of letter trigrams over the whole text. Both levels are linear, so a text's margins are the
mean of its trigrams' weights and every text is read once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docspring.llm.common import as_bytes, slices

#: The bounded sample that the machines are fitted on: rows at most, over all languages (but one of each) and of one.
SAMPLE_ROWS = 3000
SAMPLE_ROWS_A_LANGUAGE = 500
BUCKETS = 8192
#: Texts whose trigrams are counted at a time.
TEXTS = 128
SCALE = 12.0
UNKNOWN = "und"

#: Families of the languages by their codes. A code that isn't here is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "finnic": "fi et",
    "turkic": "tr az kk ky uz tk",
    "indic": "hi bn ur mr gu pa ne",
    "semitic": "ar he mt am",
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

#: Byte -> symbol: 0 for what is no letter, 1 to 26 for a to z, the others for bytes of other letters.
_SYMBOLS = np.zeros(256, np.uint32)
for _b in range(256):
    if chr(_b).isascii() and chr(_b).isalpha():
        _SYMBOLS[_b] = ord(chr(_b).lower()) - 96
    elif _b >= 128:
        _SYMBOLS[_b] = 27 + (_b & 63) % 37
_GRAMS = 1 << 18


def family(language: str) -> str:
    return _FAMILY_OF.get(language.lower().split("-")[0].split("_")[0], language)


def bucket_of_gram() -> np.ndarray:
    """The bucket of each of the 64**3 trigrams."""
    x = np.arange(_GRAMS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(51)).astype(np.int64)


def grams_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams with a letter in them, for all texts one after the other, and where each text's begin (one more at the end)."""
    data = b"   ".join(texts) + b"   "
    s = _SYMBOLS[np.frombuffer(data, np.uint8)]
    grams = (s[:-2] << 12) | (s[1:-1] << 6) | s[2:]
    kept = grams > 0
    begins = np.concatenate([[0], np.cumsum([len(x) + 3 for x in texts])])
    begins[-1] = len(grams)
    counts = np.concatenate([[0], np.cumsum(kept)])
    return grams[kept], counts[begins]


def fit_machine(x: np.ndarray, rows: np.ndarray, y: np.ndarray, norms: np.ndarray, cost: float = 10.0, rounds: int = 40) -> np.ndarray:
    """Linear support vector machine over these rows of x by dual coordinate descent; y is +1 or -1, norms are those of the
    rows of x with a one for the bias, and the last weight is the bias. x itself isn't copied."""
    alpha, w, bias = np.zeros(len(rows)), np.zeros(x.shape[1], np.float64), 0.0
    limits = np.where(y > 0, cost * len(y) / max(1, 2 * (y > 0).sum()), cost * len(y) / max(1, 2 * (y < 0).sum()))
    order = np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(rows)):
            row = x[rows[i]]
            new = min(max(alpha[i] - (y[i] * (row @ w + bias) - 1) / norms[rows[i]], 0.0), limits[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w += step * row
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return np.append(w, bias).astype(np.float32)


@dataclass
class Model:
    """languages and families in order; machines[k] says what column k of the weights tells apart: ("family", f, None) is
    f against the rest, (f, a, b) is a (positive) against b within f."""

    languages: list[str]
    machines: list[tuple[str, str, str | None]]
    weights: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, languages: list[str]) -> Model:
        names = sorted(set(languages))
        families = sorted({family(a) for a in names})
        labels = np.array(languages)
        of = np.array([family(a) for a in languages])
        norms = np.einsum("ij,ij->i", x, x).astype(np.float64) + 1
        machines, columns = [], []
        if len(families) > 1:
            for f in families:
                machines.append(("family", f, None))
                columns.append(fit_machine(x, np.arange(len(x)), np.where(of == f, 1.0, -1.0), norms))
        for f in families:
            for a, b in combinations([n for n in names if family(n) == f], 2):
                rows = np.flatnonzero((labels == a) | (labels == b))
                machines.append((f, a, b))
                columns.append(fit_machine(x, rows, np.where(labels[rows] == a, 1.0, -1.0), norms))
        return Model(names, machines, np.array(columns, np.float32).T if columns else np.zeros((BUCKETS + 1, 0), np.float32))

    def margins(self, texts: list[bytes], bucket: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """Ranges of texts and their margins: trigrams are counted into the buckets of TEXTS texts at a time, and the counts
        multiplied by the weights, so memory grows with texts and buckets, not with machines."""
        for lo in range(0, len(texts), TEXTS):
            grams, begins = grams_of(texts[lo : lo + TEXTS])
            n, sizes = len(begins) - 1, np.diff(begins)
            at = np.repeat(np.arange(n, dtype=np.int64) * BUCKETS, sizes) + bucket[grams]
            counts = np.bincount(at, minlength=n * BUCKETS).reshape(n, BUCKETS).astype(np.float32)
            yield lo, lo + n, (counts @ self.weights[:-1]) * (SCALE / np.maximum(1, sizes))[:, None] + self.weights[-1]

    def decide(self, margins: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Languages and scores of rows of margins. Votes decide within a family, then the margins' sum, then the name."""
        families = sorted({family(a) for a in self.languages})
        first = [k for k, m in enumerate(self.machines) if m[0] == "family"]
        sure = 1 / (1 + np.exp(-2 * np.clip(margins, -30, 30)))
        if first:
            shares = sure[:, first]
            chosen, score = margins[:, first].argmax(axis=1), shares.max(axis=1)
        else:
            chosen, score = np.zeros(len(margins), np.int64), np.ones(len(margins))
        out = np.empty(len(margins), object)
        for f, name in enumerate(families):
            rows, members = np.flatnonzero(chosen == f), [a for a in self.languages if family(a) == name]
            votes, sums, shares = (np.zeros((len(rows), len(members))) for _ in range(3))
            for k, (scope, a, b) in enumerate(self.machines):
                if scope == name and b is not None:
                    i, j, m = members.index(a), members.index(b), margins[rows, k]
                    votes[:, i] += m >= 0
                    votes[:, j] += m < 0
                    sums[:, i] += m
                    sums[:, j] -= m
                    shares[:, i] += sure[rows, k]
                    shares[:, j] += 1 - sure[rows, k]
            best = np.lexsort((-np.arange(len(members))[None, :].repeat(len(rows), 0), sums, votes), axis=1)[:, -1] if len(rows) else np.zeros(0, np.int64)
            out[rows] = np.array(members, object)[best]
            if len(members) > 1:
                score[rows] = score[rows] * shares[np.arange(len(rows)), best] / (len(members) - 1)
        return out.tolist(), np.clip(score, 0.0, 1.0)


def has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode())


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS, rows_a_language: int = SAMPLE_ROWS_A_LANGUAGE) -> DataFrame:
    """lang and text of labelled rows, by a hash of id and text: as many of each language, within both bounds, but one of each
    language at least. Rows of one id are rows each. docs has doc_id, text, lang.

    A language's rows are thinned to some 2 * n + 200 of n asked for, by their hash, before any are ranked."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("c"), F.min("h").alias("least"))
    each = max(1, min(rows_a_language, rows // max(1, counts.count())))
    share = F.lit(2 * each + 200) / F.col("c")
    # one row for each language, all of which the model holds
    thin = labelled.join(F.broadcast(counts), "lang").where((F.lit(0.5) + F.col("h") / F.lit(2.0**64) <= share) | (F.col("h") == F.col("least")))
    ranked = thin.withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("h", "text")))
    return ranked.where(F.col("n") <= each).select("lang", "text")


def features(docs: DataFrame) -> tuple[np.ndarray, list[str]]:
    """Trigram frequencies in buckets of the sampled rows' whole texts (columns lang, text). The driver holds SAMPLE_ROWS of them,
    and one more for each language beyond that number: every value of lang is a language, stray ones too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = bucket_of_gram()
        for batch in batches:
            rows = []
            for text in as_bytes(batch.column(1)):
                grams, _ = grams_of([text])
                rows.append((np.bincount(bucket[grams], minlength=BUCKETS) * (SCALE / max(1, len(grams)))).astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["lang", "x"])

    got = docs.select("lang", "text").mapInArrow(run, "lang string, x binary").orderBy("lang", "x").collect()
    x = np.array([np.frombuffer(r.x, np.float16) for r in got], np.float32).reshape(len(got), BUCKETS)
    return x, [r.lang for r in got]


def train(docs: DataFrame, rows: int = SAMPLE_ROWS, rows_a_language: int = SAMPLE_ROWS_A_LANGUAGE) -> Model | None:
    """docs: doc_id, text, lang of the rows to learn from; every value of lang is learned. None without a labelled row."""
    x, languages = features(sample(docs, rows, rows_a_language))
    return Model.fit(x, languages) if languages else None


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score for each row.

    A null text, one without a letter, and every text without a model are "und" with score 0. Ties go to the language first
    by name. Repeated rows get the same answer; an empty table gives no rows; other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights for each machine, whatever the number of rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, bucket = held.value, bucket_of_gram().astype(np.int32)
        for batch in batches:
            texts = as_bytes(batch.column(1))
            for lo, hi in slices(texts):
                part = texts[lo:hi]
                known = [bool(model) and x is not None and has_letter(x) for x in part]
                names, scores = [UNKNOWN] * len(part), np.zeros(len(part))
                at = [i for i, k in enumerate(known) if k]
                for first, last, margins in model.margins([part[i] for i in at], bucket) if at else ():
                    got, sure = model.decide(margins)
                    for i, name in zip(at[first:last], got, strict=True):
                        names[i] = name
                    scores[at[first:last]] = sure
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
