"""Ingest, answering and evaluation as plans."""

from __future__ import annotations

import datetime
import json
import math
import os
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspring.config import Settings
from docspring.functions import calls, geometry, ids, models, vectors
from docspring.operators import batching, cache, chunking, dense, evaluation, folds, layout, metrics, rerank, sparse, structured, tables
from docspring.plans import answers, retrieval
from docspring.schemas import TABLES
from docspring.sources import documents, index, points
from docspring.staging import Staging


def parse_documents(files: DataFrame, parsers: Mapping[str, Callable], caption: Callable | None = None, summary: Callable | None = None, text_tables: bool = False, staging: Staging | None = None) -> dict[str, DataFrame]:
    """spans, pages, tables, images and notes of all files. parsers: pages, and any of spans, markdown, tables, images. With
    text_tables and no parser of tables, they are found in the spans' layout. caption and summary make transports (functions.calls)
    that take pictures' bytes and tables' texts. Every parser and model runs once for each file: outputs are staged, in a folder
    that the caller may give and drop."""
    spark, staging = files.sparkSession, staging or Staging(files.sparkSession, "parse")
    pages, notes = documents.page_texts(files, parsers["pages"], staging)
    out = {"pages": pages, "notes": notes}
    spans = layout.page_spans(pages).withColumn("metadata", F.lit(None).cast("map<string,string>"))
    for name, read in (("spans", documents.layout_spans), ("markdown", documents.markdown_span)):
        if name in parsers:
            more, problems = read(files, parsers[name], staging)
            spans, out["notes"] = spans.unionByName(more), out["notes"].unionByName(problems)
    boxed = spans.where("y0 is not null").withColumn("span_pos", F.xxhash64("span_id"))
    out["spans"] = spans
    for name, read, key in (("tables", documents.table_blocks, "table_id"), ("images", documents.image_blocks, "xref")):
        if name in parsers:
            blocks, problems = read(files, parsers[name], staging)
            out["notes"] = out["notes"].unionByName(problems)
        elif name == "tables" and text_tables:
            found = tables.stream_tables(boxed)
            blocks = found.select(*(F.col(f.name) if f.name in found.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(TABLES)))
        else:
            continue
        anchors = blocks.withColumn("anchor_id", F.concat_ws("#", F.col("page_index").cast("string"), F.col(key).cast("string")))
        near = layout.with_page_fallback(anchors, boxed, layout.nearest_neighbors(anchors.where("y0 is not null"), boxed))
        snippets = layout.neighbor_snippets(near, spans).drop("page_index")
        given = [c for c in ("contextual_snippet_above", "contextual_snippet_below") if c in blocks.columns]
        out[name] = anchors.drop(*given).join(snippets, ["doc_id", "anchor_id"], "left")
    if "images" in out:
        out["images"], dropped = layout.labelled_images(out["images"])
        out["notes"] = out["notes"].unionByName(dropped)
        if caption is not None:
            tried = staging.stored(out["images"].withColumn("__c", calls.attempted(caption, "caption")(F.col("content"))), "captions")
            out["images"], out["notes"] = tried.withColumn("caption", F.col("__c.value")).drop("__c"), out["notes"].unionByName(failed(tried, "__c", "images"))
    if "tables" in out and summary is not None:
        body = F.coalesce("as_markdown", "as_csv")
        tried = staging.stored(out["tables"].withColumn("__s", calls.attempted(summary, "summary")(body)), "summaries")
        out["tables"], out["notes"] = tried.withColumn("summary", F.coalesce("__s.value", "summary")).drop("__s"), out["notes"].unionByName(failed(tried, "__s", "tables"))
    return {"notes": documents.empty_notes(spark), **out}


def failed(tried: DataFrame, reply: str, stage: str) -> DataFrame:
    """Notes on the rows whose model call failed."""
    return tried.where(F.col(f"{reply}.error").isNotNull()).select("doc_id", F.lit(stage).alias("stage"), F.col(f"{reply}.error").alias("note"))


def build_chunks(parts: Mapping[str, DataFrame], settings: Settings, staging: Staging | None = None) -> tuple[DataFrame, DataFrame]:
    """Narrative, table and image chunks in corpus order, and notes. The order stands in a staged table, which the caller drops
    if it gives the folder."""
    narrative, notes = chunking.narrative_chunks(parts["spans"].where("y0 is not null"), parts["pages"], settings.chunk_size, settings.chunk_overlap)
    more = {}
    numbered = lambda df, key: df.withColumns({"pdf_sha256": F.col("doc_id"), "source": F.col("doc_id"), "n": F.row_number().over(W.partitionBy("doc_id").orderBy("page_index", key))})
    if settings.index_tables and "tables" in parts:
        more["tables"] = structured.table_chunks(numbered(parts["tables"], "table_id"))
    if settings.index_images and "images" in parts:
        more["images"] = structured.image_chunks(numbered(parts["images"], "xref"), settings.image_min_area_px, need_label=settings.require_figure_label)
    return chunking.union_chunks(narrative, more.get("tables"), more.get("images"), staging), notes


def ingest(parts: Mapping[str, DataFrame], embedder: Callable[[], Callable[[list[str]], list[list[float]]]], settings: Settings) -> DataFrame:
    """Chunks with vectors into the index and the collection, both from one table. The model gets requests within the limits of
    texts and tokens. No chunks, or a chunk without a vector, is an error."""
    spark = parts["pages"].sparkSession
    staging = Staging(spark, "ingest")
    try:
        return _ingested(build_chunks(parts, settings, staging)[0], embedder, settings, staging)
    finally:
        staging.drop()


def _ingested(chunks: DataFrame, embedder: Callable[[], Callable[[list[str]], list[list[float]]]], settings: Settings, staging: Staging) -> DataFrame:
    spark = chunks.sparkSession
    rows = staging.stored(chunks.drop("embedding"), "chunks")
    requests = folds.embed_batches(rows.withColumn("corpus", F.lit("all")), settings.embed_batch_size, settings.embed_max_tokens)
    numbered = rows.join(requests.select("chunk_pos", "batch_no"), "chunk_pos")
    made = staging.stored(models.embedded_requests(numbered, embedder).drop("batch_no"), "embedded")
    sizes = made.agg(F.count(F.lit(1)).alias("n"), F.count("embedding").alias("vectors"), F.max(F.size("embedding")).alias("size")).head()
    if not sizes.n:
        raise ValueError("the documents gave no chunks")
    if sizes.vectors != sizes.n or not sizes.size:
        raise RuntimeError("the embedder gave no vectors")
    index.save_index(made, settings.index_path)
    points.reset(spark, f"{settings.index_path}/collections/{settings.collection}", sizes.size)
    points.upsert(made, f"{settings.index_path}/collections/{settings.collection}")
    return index.load_index(spark, settings.index_path)


def answer(spark: SparkSession, question: str, chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], settings: Settings, generate: Callable[[list[str]], list] = models.extractive_answers, refine: Callable[[list[str]], list[str]] | None = models.never_refines, tables: index.TermTables | None = None, store: cache.AnswerCache | None = None) -> dict:
    """One question by the plan for many. A model without an answer is an error here."""
    terms, _ = (tables or index.TermTables()).get(spark, settings.index_path)
    staging = Staging(spark, "answer")
    try:
        told, hits = answers.answered(spark.createDataFrame([("q", question)], "query_id string, query string"), chunks, lambda: embed, terms, settings, generate, refine, store, staging=staging)
        row = told.head()
        if row.error:
            raise RuntimeError(row.error)
        return {"answer": row.answer, "hits": hits.orderBy("rank").collect(), "similarity": row.similarity, "notes": [row.note]}
    finally:
        staging.drop()


def capped(gold: DataFrame, rows: int | None) -> DataFrame:
    """The first questions by id, as many as are asked for; all without a number."""
    return gold if rows is None else gold.orderBy("query_id").limit(rows)


def evaluate(gold: DataFrame, chunks: DataFrame, dense_legs: DataFrame, terms: sparse.TermIndex, settings: Settings, generate: Callable[[list[str]], list[str]] = models.extractive_answers, judge: Callable[[list[str]], list[str]] | None = None, rows: int | None = None, verdict: metrics.Judge = metrics.lexical, prefix: str = "lexical_") -> dict:
    """All questions in one plan: hits, contexts, answers, and the report of report_of().

    gold has query_id and the columns of labelled questions; dense_legs has query_id, chunk_pos and rank for them."""
    gold = capped(gold, rows)
    if gold.isEmpty():
        raise SystemExit(2)
    asked = retrieval.questions(gold.select("query_id", F.col("question").alias("query")), settings)
    hits = retrieval.hybrid(asked, chunks, dense_legs, terms, settings)
    made = models.batch_udf(lambda: generate, "string")
    told = answers.prompts(hits, asked).select("query_id", made("prompt").alias("generated_answer"))
    out = gold.join(folds.hit_texts(hits), "query_id", "left").join(told, "query_id", "left")
    return report_of(out, settings, judge, verdict, prefix)


def report_of(samples: DataFrame, settings: Settings, judge: Callable[[list[str]], list[str]] | None = None, verdict: metrics.Judge = metrics.lexical, prefix: str = "lexical_") -> dict:
    """The report's six parts from samples (query_id, question, page_number, context_content_type, generated_answer,
    ground_truth_answer, retrieved_contexts). Measures by the lexical verdict bear its prefix; with a judge of statements, give
    that verdict and an empty prefix. The report holds a row for each question; write_report() is for sets of any size."""
    staging = Staging(samples.sparkSession, "evaluation")
    try:
        return _report(staging.stored(metrics.measures(samples, verdict, prefix), "scored"), settings, [f"{prefix}{m}" for m in metrics.NAMES], judge)
    finally:
        staging.drop()


def write_report(samples: DataFrame, path: str, settings: Settings, verdict: metrics.Judge = metrics.lexical, prefix: str = "lexical_") -> str:
    """The report of any number of samples: what has a bounded size as JSON and Markdown at path, and a row for each question as
    lines of JSON in a folder beside it, written by all tasks. Returns that folder, which the report names."""
    spark, names, folder = samples.sparkSession, [f"{prefix}{m}" for m in metrics.NAMES], f"{os.path.splitext(path)[0]}_rows"
    staging = Staging(spark, "evaluation")
    try:
        scored = staging.stored(metrics.measures(samples, verdict, prefix), "scored")
        rows = scored.select("query_id", F.col("question").alias("user_input"), "page_number", "context_content_type", "generated_answer", *names)
        rows.write.mode("overwrite").json(folder)
        report = _summary(scored, settings, names)
        least = [r.asDict() for r in evaluation.worst(rows, 5, names[0], "query_id").collect()]
        index.write_text(spark, path, json.dumps(report | {"per_row_ragas_folder": os.path.basename(folder)}, indent=2, default=str))
        index.write_text(spark, f"{os.path.splitext(path)[0]}.md", evaluation.markdown_report(spark, report | {"per_row_ragas": least}))
    finally:
        staging.drop()
    return folder


def _report(scored: DataFrame, settings: Settings, names: list[str], judge: Callable[[list[str]], list[str]] | None) -> dict:
    per_row = [r.asDict() for r in scored.select("query_id", F.col("question").alias("user_input"), "page_number", "context_content_type", "generated_answer", *names).orderBy("query_id").collect()]
    judged = []
    if judge is not None:
        from docspring.functions.text import is_judged, judge_scores

        asked_judge = scored.where(is_judged("context_content_type"))
        replies = asked_judge.withColumn("r", calls.attempted(lambda: judge, "judge")(F.to_json(F.struct("question", "ground_truth_answer", "generated_answer"))))
        for r in replies.select("query_id", judge_scores("r.value").alias("scores"), "r.error").collect():
            judged.append({"query_id": r.query_id, "scores": r.scores.asDict() if r.scores else {"error": r.error or "no scores"}})
    return _summary(scored, settings, names) | {"per_row_ragas": per_row, "llm_judge": judged}


def _summary(scored: DataFrame, settings: Settings, names: list[str]) -> dict:
    """The parts of a report whose size doesn't depend on the number of questions."""
    mean = evaluation.dataset_mean(scored, names).head().asDict()
    return {
        "generated_at_utc": datetime.datetime.now(datetime.UTC).isoformat(), "retrieval_config": settings.snapshot(),
        "ragas_summary_mean": {k: v if v is not None else math.nan for k, v in mean.items()},
        "ragas_by_context_content_type": [r.asDict() for r in evaluation.mean_by_type(scored, names).orderBy("context_content_type").collect()],
    }


def patch_records(pages: DataFrame, settings: Settings) -> DataFrame:
    """Tiles of rasterised pages (pdf_sha256, source_filename, page_index, pixmap_page_width, pixmap_page_height), with their ids."""
    some = pages.where(F.col("page_index") < max(1, settings.patch_max_pages))
    tiles = some.select("*", F.explode(geometry.patch_grid("pixmap_page_width", "pixmap_page_height", settings.patch_size_px, settings.patch_stride_px)).alias("t"))
    flat = tiles.select(*pages.columns, "t.*", F.lit(float(settings.patch_dpi)).alias("dpi"), F.lit(settings.patch_size_px).alias("patch_size_px"), F.lit(settings.patch_stride_px).alias("stride_px"), F.lit("image/png").alias("mime"))
    return flat.withColumn("patch_id", ids.patch_id("pdf_sha256", "page_index", "row_index", "col_index", "dpi"))


def ingest_patches(patches: DataFrame, encoder: Callable[[], Callable[[list], list[list[float]]]], path: str, text_size: int, image: str = "png") -> None:
    """Encodes and writes patches; image and text vectors must have one size."""
    made = models.embedded(patches, encoder, image).drop(image)
    index.upsert_patches(made.withColumn("embedding", models.checked_dimension(F.col("embedding"), text_size)), path)


def retrieve_patches_batch(patches: DataFrame, queries: list[tuple[str, list[float]]], settings: Settings, pdf_sha256: str | None = None) -> DataFrame:
    """query_id, the patches' columns, score, maxsim and rank: the payload filter first, then each question's coarse list, then
    late interaction (or the coarse order without it)."""
    rows = patches if pdf_sha256 is None else patches.where(F.col("pdf_sha256") == pdf_sha256)
    coarse = dense.batch_topk(rows, queries, settings.visual_prefetch, "cosine", "patch_id").drop("rank").join(rows, "patch_id")
    if settings.maxsim:
        asked = patches.sparkSession.createDataFrame([(q, [float(x) for x in v]) for q, v in queries], "query_id string, query_vector array<double>")
        return rerank.maxsim_rerank(coarse.join(asked, "query_id"), F.col("query_vector"), settings.maxsim_slots, settings.visual_top_k, "patch_id").drop("query_vector")
    return retrieval.ranked(coarse, [F.desc("score"), F.col("patch_id")], settings.visual_top_k)


def retrieve_patches(patches: DataFrame, query: list[float], settings: Settings, pdf_sha256: str | None = None) -> tuple[DataFrame, dict[str, str]]:
    """The same for one question, and how its list was made; where no patch has a vector there is nothing to rerank."""
    some = patches if pdf_sha256 is None else patches.where(F.col("pdf_sha256") == pdf_sha256)
    top = retrieve_patches_batch(patches, [("q", query)], settings, pdf_sha256).drop("query_id", "rank")
    if not settings.maxsim:
        return top, {"rerank": "cosine"}
    if some.where(F.col("embedding").isNotNull()).isEmpty():
        return top, {"rerank": "maxsim_failed"}
    return top, {"rerank": "maxsim", "slots": str(settings.maxsim_slots)}


def report_rows(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """Rows and their scores side by side; a row without scores, or the other way round, is an error."""
    return batching.aligned(rows, scores, "query_id")


def hashed_embedder(size: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """The hashing stand-in for a text model, as a batch function."""
    import hashlib
    import re

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * size
            for w in re.findall(r"\w+", (t or "").lower()):
                v[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % size] += 1.0
            n = max(math.sqrt(sum(x * x for x in v)), vectors.FLOOR)
            out.append([x / n for x in v])
        return out

    return embed
