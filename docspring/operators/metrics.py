"""Four measures of answers from verdicts on statements: which passages bear them out, and in what rank.

Answers and references are cut into statements. Each statement meets each passage of its question in a row of its own, a judge
says of every row whether the passage bears the statement out, and the measures are aggregates of those verdicts. The judge is
a column, so it may be a model called in batches (judge_by) or the lexical stand-in, whose measures have names of their own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docspring.functions import calls, text

#: Least share of a statement's distinct words that a passage must have, for the lexical judge.
SHARE = 0.5
# The names of the measures, in the order of reports.
NAMES = ("faithfulness", "answer_relevancy", "context_precision", "context_recall")

Judge = Callable[[Column, Column], Column]


def statements(of: Column | str) -> Column:
    """array of the sentences and lines of a text, without white space around them and without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(text.col(of), F.lit("")), r"(?<=[.!?])\s+|\n+"), text.strip), lambda s: s != "")


def lexical(statement: Column, passage: Column) -> Column:
    """The stand-in: the passage has SHARE of the statement's distinct words. A statement without a word isn't borne out."""
    words = F.array_distinct(text.tokens(statement))
    return F.coalesce((F.size(words) > 0) & (F.size(F.array_intersect(words, F.array_distinct(text.tokens(passage)))) >= SHARE * F.size(words)), F.lit(False))


def judge_by(make: Callable[[], calls.Transport], limits: calls.Limits = calls.Limits()) -> Judge:
    """A model as the judge: a request is JSON with statement and passage, a reply that begins with yes, true or 1 bears it out.
    What fails has no verdict, and counts in no measure."""
    call = calls.attempted(make, "verdict", limits)

    def judge(statement: Column, passage: Column) -> Column:
        reply = F.lower(text.strip(call(F.to_json(F.struct(statement.alias("statement"), passage.alias("passage"))))["value"]))
        return F.when(reply.isNotNull(), reply.rlike("^(yes|true|1)"))

    return judge


def verdicts(samples: DataFrame, judge: Judge = lexical) -> DataFrame:
    """query_id, part, statement_no, rank and borne_out from samples (query_id, question, generated_answer, ground_truth_answer,
    retrieved_contexts). Parts: "answer" and "reference" against each passage (rank from 1), "question" is the answer's statements
    against the question (rank 0)."""
    part = lambda name, c: F.transform(statements(c), lambda s, i: F.struct(F.lit(name).alias("part"), i.alias("statement_no"), s.alias("statement")))
    passages = F.transform(F.coalesce("retrieved_contexts", F.array().cast("array<string>")), lambda p, i: F.struct((i + 1).alias("rank"), p.alias("passage")))
    said = samples.select("query_id", F.explode(F.concat(part("answer", "generated_answer"), part("reference", "ground_truth_answer"))).alias("s"), passages.alias("passages"))
    pairs = said.select("query_id", "s.part", "s.statement_no", "s.statement", F.explode("passages").alias("p")).select("query_id", "part", "statement_no", "statement", "p.rank", "p.passage")
    about = samples.select("query_id", F.explode(part("question", "generated_answer")).alias("s"), F.col("question").alias("passage")).select("query_id", "s.part", "s.statement_no", "s.statement", F.lit(0).alias("rank"), "passage")
    # whether a statement speaks of the question: the question's words, looked for in the statement
    turned = about.select("query_id", "part", "statement_no", F.col("passage").alias("statement"), "rank", F.col("statement").alias("passage"))
    return pairs.unionByName(turned).select("query_id", "part", "statement_no", "rank", judge(F.col("statement"), F.col("passage")).alias("borne_out"))


def measures(samples: DataFrame, judge: Judge = lexical, prefix: str = "lexical_") -> DataFrame:
    """samples with four measures, null where there is nothing to measure:

    faithfulness, the share of the answer's statements that a passage bears out; context_recall, the same of the reference's;
    context_precision, the mean over the passages that bear out a statement of the reference of the share of such passages up to
    their rank; answer_relevancy, the share of the answer's statements that speak of the question."""
    held = verdicts(samples, judge).where("borne_out is not null")
    by_statement = held.groupBy("query_id", "part", "statement_no").agg(F.max("borne_out").alias("borne_out"))
    share = lambda part: F.avg(F.when(F.col("part") == part, F.col("borne_out").cast("double")))
    shares = by_statement.groupBy("query_id").agg(share("answer").alias(NAMES[0]), share("question").alias(NAMES[1]), share("reference").alias(NAMES[3]))
    useful = held.where("part = 'reference'").groupBy("query_id", "rank").agg(F.max("borne_out").cast("int").alias("useful"))
    so_far = F.avg("useful").over(W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    ranked = useful.withColumn("share", so_far).groupBy("query_id").agg(F.coalesce(F.avg(F.when(F.col("useful") == 1, F.col("share"))), F.lit(0.0)).alias(NAMES[2]))
    # samples without a statement or passage have no verdicts: their measures are null
    joined = samples.join(shares, "query_id", "left").join(ranked, "query_id", "left")
    return joined.select(*samples.columns, *(F.col(n).alias(f"{prefix}{n}") for n in NAMES))
