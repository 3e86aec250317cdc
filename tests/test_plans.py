"""Sources, sinks, whole plans and the registered queries."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from docspring.config import Settings
from docspring.functions import models
from docspring.operators import cache, dense, metrics, sparse
from docspring.plans import corpus, retrieval
from docspring.sources import documents, index, manifests, points, segments
from docspring.streaming import ingest


def parse_pages(doc_id, content):
    for i, t in enumerate(content.decode().split("\f")):
        yield {"page_index": i, "text": t}


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    (d / "a.pdf").write_bytes(("revenue grew strongly this year. " * 12 + "\f" + "costs fell in the second quarter. " * 12).encode())
    (d / "b.pdf").write_bytes(b"\xff\xfe broken")
    (d / "c.txt").write_text("not read")
    return documents.binary_documents(spark, str(d))


def test_ingest_and_answer(spark, files, tmp_path):
    parts = corpus.parse_documents(files, {"pages": parse_pages})
    assert files.count() == 2 and parts["notes"].count() == 1 and "UnicodeDecodeError" in parts["notes"].head().note
    settings = Settings(chunk_size=200, chunk_overlap=20, index_path=str(tmp_path / "idx"), cache_path=str(tmp_path / "cache"))
    chunks = corpus.ingest(parts, corpus.hashed_embedder, settings)
    assert {r.page_start for r in chunks.collect()} == {0, 1}
    held = points.points(spark, f"{settings.index_path}/collections/{settings.collection}")
    assert held.count() == chunks.select("chunk_id").distinct().count()
    tables, embed = index.TermTables(), corpus.hashed_embedder()
    assert [tables.get(spark, settings.index_path)[1] for _ in range(2)] == [False, True]
    store = cache.AnswerCache(settings.cache_path)
    got = corpus.answer(spark, "what fell in the second quarter", chunks, embed, settings, tables=tables, store=store)
    assert "costs fell" in got["answer"] and got["hits"][0].page_start == 1 and got["notes"] == ["multi_hop_done"]
    again = corpus.answer(spark, "what fell in the second quarter", chunks, embed, settings, tables=tables, store=store)
    assert again["notes"] == ["cache_hit"] and again["hits"] == [] and again["answer"] == got["answer"]
    paged = corpus.answer(spark, "what fell in the second quarter on pages 1-1", chunks, embed, settings, tables=tables, store=store)
    assert {h.page_start for h in paged["hits"]} == {0}
    with pytest.raises(ValueError):
        corpus.ingest({**parts, "pages": parts["pages"].limit(0), "spans": parts["spans"].limit(0)}, corpus.hashed_embedder, settings)


def test_parsers_and_models_run_once(spark, tmp_path):
    """Each parser sees each file once however often its rows are read; captions and summaries that fail are notes on their rows."""
    log = tmp_path / "calls"
    log.mkdir()

    def logged(name):
        with open(log / name, "a") as f:
            f.write("x")

    def pages(doc_id, content):
        logged("pages")
        yield {"page_index": 0, "text": content.decode()}

    def images(doc_id, content):
        logged("images")
        for i in range(3):
            yield {"xref": i, "page_index": 0, "y0": 30.0, "y1": 40.0, "content": b"picture %d" % i, "width_px": 500, "height_px": 500}

    def spans(doc_id, content):
        yield {"span_id": "s", "page_index": 0, "x0": 0.0, "y0": 10.0, "x1": 9.0, "y1": 20.0, "text": "Figure 1: here", "extractor": "lines"}
        for r in range(2):
            for c in range(2):
                yield {"span_id": f"c{r}{c}", "page_index": 1, "x0": 50.0 * c, "y0": 20.0 * r, "x1": 50.0 * c + 30, "y1": 20.0 * r + 12, "text": f"cell {r} {c}", "extractor": "lines"}

    def caption():
        return lambda blobs: [ValueError("dark") if bytes(b).endswith(b"1") else f"shows {bytes(b).decode()}" for b in blobs]

    files = spark.createDataFrame([(d, f"text of {d}".encode()) for d in "abc"], "doc_id string, content binary")
    parts = corpus.parse_documents(files, {"pages": pages, "images": images, "spans": spans}, caption=caption, text_tables=True)
    got = {(r.doc_id, r.xref): r.caption for r in parts["images"].collect()}
    assert got == {(d, i): None if i == 1 else f"shows picture {i}" for d in "abc" for i in range(3)}
    notes = parts["notes"].where("stage = 'images'").collect()
    assert {(r.doc_id, r.note) for r in notes} == {(d, "caption: ValueError: dark") for d in "abc"} and parts["pages"].count() == 3
    assert [r.rows for r in parts["tables"].collect()] == [[["cell 0 0", "cell 0 1"], ["cell 1 0", "cell 1 1"]]] * 3
    chunks, _ = corpus.build_chunks(parts, Settings())
    assert chunks.where("chunk_kind = 'pdf_image'").count() == 9 and chunks.where("chunk_kind = 'pdf_table'").count() == 3
    assert (log / "pages").read_text() == (log / "images").read_text() == "xxx"


def test_index_manifest(spark, tmp_path):
    path = str(tmp_path / "i")
    with pytest.raises(FileNotFoundError):
        index.load_index(spark, path)
    index.save_index(spark.createDataFrame([("c", 0, "t"), ("c", 1, "u")], "chunk_id string, chunk_pos long, text string"), path)
    assert index.load_index(spark, path).count() == 2
    before = index.freshness_key(spark, path)
    assert before == index.freshness_key(spark, path) and before.startswith(path)
    (tmp_path / "i" / "manifest.json").write_text(json.dumps({"format": "old"}))
    (tmp_path / "i" / ".manifest.json.crc").unlink(missing_ok=True)
    with pytest.raises(RuntimeError):
        index.load_index(spark, path)


def test_gold_questions(spark, tmp_path):
    (tmp_path / "g.csv").write_text('Question,Ground_Truth_Context,Ground_Truth_Answer,Page_Number,Context_Content_Type\n" why, ""so""? ","a\nb",,4; 8,text\n ,x,y,1,table\n')
    got = documents.gold_questions(spark, str(tmp_path / "g.csv")).collect()
    assert [tuple(r) for r in got] == [('why, "so"?', "a\nb", "", "4; 8", "text")]
    (tmp_path / "h.csv").write_text("Question\nx\n")
    with pytest.raises(ValueError):
        documents.gold_questions(spark, str(tmp_path / "h.csv"))


def test_requests_keep_their_limits(spark, tmp_path):
    """The model is called with the batches of the fold, whole and in order."""
    rows = spark.createDataFrame([(i, "x" * n, b) for i, (n, b) in enumerate([(3, 0), (5, 0), (7, 1), (2, 1), (1, 1), (9, 2)])], "chunk_pos long, text string, batch_no long")
    calls = lambda: lambda texts: [[float(len(texts)), float(len(t))] for t in texts]
    got = {r.chunk_pos: list(r.embedding) for r in models.embedded_requests(rows, calls).collect()}
    assert got == {0: [2, 3], 1: [2, 5], 2: [3, 7], 3: [3, 2], 4: [3, 1], 5: [1, 9]}


def point_batch(spark, *rows):
    return spark.createDataFrame(rows, "chunk_id string, chunk_pos long, text string, embedding array<float>")


def test_upsert_keeps_the_other_points(spark, tmp_path):
    path, batch = str(tmp_path / "c"), lambda *rows: point_batch(spark, *rows)
    points.reset(spark, path, 2, buckets=8)
    assert points.points(spark, path) is None
    assert points.upsert(batch(("a", 0, "old", [1.0, 0.0]), ("b", 1, "b", [1.0, 0.0])), path).count() == 2
    got = {r.chunk_id: r.text for r in points.upsert(batch(("a", 0, "x", [1.0, 0.0]), ("a", 1, "new", [1.0, 0.0]), ("c", 2, "c", [1.0, 0.0])), path).collect()}
    assert got == {"a": "new", "b": "b", "c": "c"}
    with pytest.raises(Exception, match="size 2"):
        points.upsert(batch(("d", 0, "d", [1.0])), path)
    assert points.upsert(batch(), path).count() == 3
    points.reset(spark, path, 3)
    assert points.points(spark, path) is None and points.state(spark, path)["size"] == 3


def test_upsert_rewrites_its_buckets_alone_and_bears_a_crash(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "c")
    points.reset(spark, path, 1, buckets=16)
    points.upsert(point_batch(spark, *((f"c{i}", i, "first", [float(i)]) for i in range(200))), path)
    before = points.state(spark, path)["files"]
    points.upsert(point_batch(spark, ("c5", 5, "second", [5.0])), path)
    after = points.state(spark, path)["files"]
    assert sum(after[b] != before[b] for b in before) == 1

    def crash(*_):
        raise OSError("the machine is gone")

    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(manifests, "commit", crash)
        points.upsert(point_batch(spark, *((f"c{i}", i, "third", [float(i)]) for i in range(200))), path)
    texts = [r.text for r in points.points(spark, path).collect()]
    assert len(texts) == 200 and texts.count("first") == 199 and texts.count("second") == 1
    held = manifests.read(spark, path)
    manifests.commit(spark, path, held)
    with pytest.raises(RuntimeError, match="another writer"):
        manifests.commit(spark, path, held)
    assert points.upsert(point_batch(spark, *((f"c{i}", i, "fourth", [float(i)]) for i in range(200))), path).where("text = 'fourth'").count() == 200
    for _ in range(3):  # what no manifest names is deleted
        points.upsert(point_batch(spark, ("c5", 5, "last", [5.0])), path)
    assert len(manifests.versions(spark, path)) == 2 and len(os.listdir(f"{path}/data")) <= 3


def term_rows(index):
    return {(r.term, r.df, round(r.idf, 9)) for r in sparse.term_stats(index).collect()}


def test_terms_grow_by_what_changes(spark, tmp_path):
    """After changes of several kinds the index equals one made anew, and only what changed was tokenised."""
    rnd = random.Random(3)
    say = lambda: " ".join(f"w{int(rnd.paretovariate(0.8)) % 50}" for _ in range(rnd.randrange(1, 12)))
    texts = {f"d{i:03}": [say() for _ in range(rnd.randrange(1, 4))] for i in range(60)}

    def chunks(held):
        rows = [(d, k, f"{d}-{k}", t) for d, some in sorted(held.items()) for k, t in enumerate(some)]
        return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "chunk_pos long, doc_id string, n int, chunk_id string, text string")

    asked = spark.createDataFrame([(f"q{i}", say()) for i in range(8)], "query_id string, query string")
    grown = segments.SegmentedTerms(spark, str(tmp_path / "g"), span=8)

    def check():
        now = chunks(texts)
        fresh = sparse.term_index(now, str(tmp_path / "f"), span=8)
        index = grown.index(now)
        assert term_rows(index) == term_rows(fresh) and (index.n, index.avgdl, index.mean) == pytest.approx((fresh.n, fresh.avgdl, fresh.mean))
        got = [[(r.query_id, r.score) for r in sparse.sparse_topk(asked, x, 4).orderBy("query_id", "rank").collect()] for x in (index, fresh)]
        assert got[0] == got[1]

    assert grown.upsert(chunks(texts)) == {"new": 60, "changed": 0, "dead": 0, "same": 0}
    check()
    texts["d003"], texts["d007"], texts["x"] = [say()], [*texts["d007"], say()], [say(), say()]
    del texts["d011"]
    assert grown.upsert(chunks(texts), whole=True) == {"new": 1, "changed": 2, "dead": 1, "same": 57}
    last = grown.state()["segments"][-1]
    assert {r.doc_id for r in spark.read.parquet(f"{grown.path}/parts/{last}/slots").collect()} == {"d003", "d007", "x"}
    check()
    assert grown.upsert(chunks({"d003": texts["d003"]})) == {"new": 0, "changed": 0, "dead": 0, "same": 1} and len(grown.state()["segments"]) == 2
    del texts["x"]
    grown.delete(spark.createDataFrame([("x",), ("unknown",)], "doc_id string"))
    texts["d003"] = [say()]
    grown.upsert(chunks({"d003": texts["d003"]}))
    check()
    grown.compact()
    assert len(grown.state()["segments"]) == 1 and not grown.state()["deaths"]
    check()
    texts["d020"] = [say()]
    grown.upsert(chunks(texts), whole=True)
    check()
    empty = segments.SegmentedTerms(spark, str(tmp_path / "e"))
    empty.upsert(chunks({}))
    assert empty.index().n == 0 and sparse.sparse_topk(asked, empty.index(), 3).count() == 0


def test_evaluate(spark, sf_dir, tmp_path):
    from docspring import queries

    chunks = queries.chunk_rows(queries.documents(spark, sf_dir))
    gold = queries.asked(spark, sf_dir).where("query_id < 3").select("query_id", F.col("query").alias("question"), F.col("query").alias("ground_truth_context"), F.lit("a").alias("ground_truth_answer"), F.lit("1").alias("page_number"), F.lit("table").alias("context_content_type"))
    terms = sparse.term_index(chunks, str(tmp_path / "t"))
    legs = dense.hashed_topk(dense.hashed_vectors(terms.postings(dense.bucket_of("term").alias("bucket")), "chunk_pos"), gold.select("query_id", F.col("question").alias("query")), 24)
    report = corpus.evaluate(gold, chunks, legs, terms, Settings(), judge=lambda rows: ["no scores here"] * len(rows))
    assert len(report["per_row_ragas"]) == 3 and set(report["ragas_summary_mean"]) == {f"lexical_{m}" for m in metrics.NAMES} and all(0 <= x <= 1 for x in report["ragas_summary_mean"].values() if x == x) and len(report["llm_judge"]) == 3 and all("error" in r["scores"] for r in report["llm_judge"])
    with pytest.raises(SystemExit):
        corpus.evaluate(gold.limit(0), chunks, legs, terms, Settings())


def test_dense_fallback(spark, sf_dir, tmp_path):
    from docspring import queries

    chunks = queries.chunk_rows(queries.documents(spark, sf_dir))
    asked = retrieval.questions(queries.asked(spark, sf_dir).where("query_id < 2"), Settings())
    legs = dense.hashed_topk(dense.hashed_vectors(sparse.term_index(chunks, str(tmp_path / "t")).postings(dense.bucket_of("term").alias("bucket")), "chunk_pos"), asked, 24)
    local, remote = retrieval.dual(asked, chunks, legs, legs, None, Settings())
    assert local.count() == remote.count() == 10


def test_patches(spark, tmp_path):
    pages = spark.createDataFrame([("sha", "a.pdf", i, 300, 200) for i in range(3)], "pdf_sha256 string, source_filename string, page_index int, pixmap_page_width int, pixmap_page_height int")
    settings = Settings(patch_size_px=128, patch_stride_px=128, patch_max_pages=2, maxsim_slots=2, visual_top_k=3)
    patches = corpus.patch_records(pages, settings)
    assert patches.count() == 12 and patches.select("patch_id").distinct().count() == 12
    corpus.ingest_patches(patches.withColumn("png", F.col("patch_id")), lambda: lambda blobs: [[float(len(b)), 1.0, 0.0, float(ord(b[-1]))] for b in blobs], str(tmp_path / "v"), 4)
    held = spark.read.parquet(str(tmp_path / "v" / "patches"))
    top, how = corpus.retrieve_patches(held, [1.0, 0.0, 0.0, 1.0], settings, "sha")
    assert top.count() == 3 and how["rerank"] == "maxsim" and corpus.retrieve_patches(held, [1.0] * 4, settings, "x")[1]["rerank"] == "maxsim_failed"


def test_stream(spark, tmp_path):
    pages = spark.createDataFrame([(d, 0, " ".join(f"{d}{i}" for i in range(150))) for d in "de"], "doc_id string, page_index int, text string")
    pages.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # nothing new the second time
        ingest.stream_chunks(ingest.page_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"), Settings(chunk_size=200, chunk_overlap=20), once=True, terms=str(tmp_path / "terms")).awaitTermination(120)
    assert segments.SegmentedTerms(spark, str(tmp_path / "terms")).index().n == spark.read.parquet(str(tmp_path / "out")).count()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.select("doc_id").distinct().count() == 2 and got.count() == got.select("chunk_id").distinct().count()


def test_every_query_has_a_schema(spark, sf_dir):
    import __spark_entry__ as entry
    from docspring import queries

    assert set(queries.ORACLE_SQL) == set(queries.QUERIES) <= set(entry.queries())
    assert entry.entry(spark).columns == ["query_id", "chunk_pos", "score", "bonus", "rank"]


def test_whole_plans_as_queries(spark, sf_dir):
    """Queries that no other test calls give rows of their stated columns."""
    from docspring import queries

    columns = {"trace_rows": 3, "cache_eligible": 2, "labelled_images": 2, "chunk_payload": 12, "row_cap": 1, "extractor_union": 4, "constructed_chunks": 5, "cache_paths": 3, "ingest": 6, "dual_retrieval": 4, "multi_hop_retrieval": 3}
    for name, n in columns.items():
        got = queries.QUERIES[name](spark, sf_dir)
        assert len(got.columns) == n and got.limit(1).count() == 1, name


def test_library_stands_without_the_training_operators(tmp_path):
    """A copy without their folders and pipeline imports, with all other queries and their SQL; without the pipeline's module
    alone the operators' queries stay."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    say = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sum(k.startswith('op') for k in e.queries()), 'pipeline' in e.queries())"

    def said(folder):
        env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": os.pathsep.join(x for x in os.environ.get("PYTHONPATH", "").split(os.pathsep) if x and not x.startswith(root))}
        got = subprocess.run([sys.executable, "-c", say], cwd=folder, env=env, capture_output=True, text=True, timeout=120)
        assert got.returncode == 0, got.stderr
        return got.stdout.split()

    from docspring import queries

    n = len(queries.QUERIES)
    for name in ("docspring", "tests"):
        shutil.copytree(os.path.join(root, name), tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    assert said(tmp_path) == [str(n), str(n), "0", "False"]
    if os.path.isdir(os.path.join(root, "docspring", "llm")):
        shutil.copytree(os.path.join(root, "docspring", "llm"), tmp_path / "docspring" / "llm")
        found = said(tmp_path)
        assert int(found[2]) >= 10 and int(found[0]) == n + int(found[2]) and found[3] == "False"


def test_report_of_any_size_keeps_its_rows_out_of_the_driver(spark, tmp_path):
    """Rows stand as lines beside the report, written by tasks; the JSON and the Markdown have what is bounded."""
    rows = [(i, "What is it?", "1", "table" if i % 3 else "text", "It is red. It is old.", "It is red.", ["It is red."] if i % 2 else []) for i in range(40)]
    samples = spark.createDataFrame(rows, "query_id long, question string, page_number string, context_content_type string, generated_answer string, ground_truth_answer string, retrieved_contexts array<string>").repartition(4)
    folder = corpus.write_report(samples, str(tmp_path / "report.json"), Settings())
    whole, held = corpus.report_of(samples, Settings()), json.loads((tmp_path / "report.json").read_text())
    lines = [json.loads(x) for f in (tmp_path / "report_rows").glob("part-*.json") for x in f.read_text().splitlines()]
    assert folder == str(tmp_path / "report_rows") and held["per_row_ragas_folder"] == "report_rows" and "per_row_ragas" not in held
    assert sorted(lines, key=lambda r: r["query_id"]) == [{k: v for k, v in r.items() if v is not None} for r in whole["per_row_ragas"]] and len(lines) == 40
    assert held["ragas_summary_mean"] == whole["ragas_summary_mean"] and held["ragas_by_context_content_type"] == whole["ragas_by_context_content_type"]
    assert (tmp_path / "report.md").read_text().startswith("# Evaluation report")
