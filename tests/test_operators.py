"""Operators on small inline rows."""

import hashlib
import json
import math
import random
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspring.config import Settings
from docspring.functions import calls, geometry, ids, payload, text, vectors
from docspring.operators import batching, cache, cells, chunking, dense, evaluation, folds, fusion, layout, metrics, rerank, sparse, structured, tables
from docspring.plans import retrieval


def one(spark, c):
    return spark.range(1).select(c.alias("v")).head().v


def test_settings():
    assert Settings.from_env({"DOCSPRING_TOP_K": "7", "DOCSPRING_HYBRID": "false", "DOCSPRING_PAGE_FILTER_MIN": ""}) == Settings(top_k=7, hybrid=False)
    for bad in ({"chunk_size": 100}, {"cache_threshold": 0.2}, {"rrf_k": 0}):
        with pytest.raises(ValueError):
            Settings(**bad)
    assert Settings(index_path="/a/b/idx").snapshot()["index_path"] == "idx" and len(Settings().snapshot()) == 23


def test_clean_and_windows(spark):
    assert one(spark, text.clean_text(F.lit("\0 a \t b\x1c\n"))) == "a b"
    # the tail lies wholly within the window before, and is kept
    assert [(w.start, w.text) for w in one(spark, text.windows(F.lit("abcdefghij"), 4, 2))] == [(0, "abcd"), (2, "cdef"), (4, "efgh"), (6, "ghij"), (8, "ij")]
    assert one(spark, text.windows(F.lit(""), 4, 2)) == [] and text.window_step(5, 9) == 1
    assert one(spark, text.tokens(F.lit("Été_1, l'eau—x"))) == ["été_1", "l", "eau", "x"]


@pytest.mark.parametrize("s,want", [("see Figure 3: x", True), ("Fig. 2", True), ("Fig 4", True), ("figure12", True), ("fig: 3", False), ("figure-3", False), ("Figure\n3", False), ("prefigure 3", False), ("_figure 3", True), ("a heading", False)])
def test_figure_cue(spark, s, want):
    assert one(spark, text.has_figure_cue(F.lit(None).cast("string"), F.lit(s))) is want


@pytest.mark.parametrize("s,want", [("A Chart here", "figure_ref"), ("Fig. 2 shows", "narrative"), ("see fig.2", "figure_ref"), ("$110,547 million", "table_dense"), ("Table 4", "table_dense"), ("cost $5 only", "numeric_heavy"), ("US$5", "table_dense"), ("plain", "narrative"), ("x" * 800 + " chart", "narrative")])
def test_content_type(spark, s, want):
    assert one(spark, text.content_type(F.lit(s))) == want
    assert one(spark, text.content_type(F.lit("plain"), F.lit("pdf_Table:x"))) == "table_dense"


def test_page_clause(spark):
    row = one(spark, text.strip_page_clause(F.lit("revenue only on pages 8 - 4 and page 5")))
    assert (row.query, row.lo, row.hi) == ("revenue and page 5", 4, 8)
    assert one(spark, text.strip_page_clause(F.lit(" page 5"))).lo is None


def test_clip_and_wrap(spark):
    assert one(spark, text.clip(F.lit(" a\0b "), 10)) == "ab"
    assert one(spark, F.length(text.clip(F.lit("x" * 50), 40))) == 39
    assert one(spark, text.untrusted_eval(F.lit("a b!c"), F.lit("t"), 9)) == "<<<UNTRUSTED_EVAL_DATA field=a_b_c>>>\nt\n<<<END_UNTRUSTED_EVAL_DATA field=a_b_c>>>"
    assert one(spark, text.section_hint(F.lit("\n  \n" + "y" * 100))) == "y" * 95 + "…"
    assert one(spark, text.section_hint(F.lit(" \n"))) is None
    assert one(spark, text.safe_label(F.lit("<>"))) == "unknown"


def test_judge_scores(spark):
    body = '{"factual_alignment_with_reference": 5, "completeness_vs_reference": 1, "handling_of_visual_or_numeric_claims": 2, "clarity": 3, "overall": 4}'
    assert one(spark, text.judge_scores(F.lit(f"```json\n{body}\n```"))).asDict()["overall"] == 4
    assert one(spark, text.judge_scores(F.lit(body.replace("5", "6")))) is None
    assert one(spark, text.judge_scores(F.lit("nothing"))) is None


def test_ids(spark):
    import hashlib
    import uuid

    assert one(spark, ids.point_uuid(F.lit("abc"))) == str(uuid.uuid5(uuid.NAMESPACE_URL, "rag:abc"))
    assert one(spark, ids.chunk_id(F.lit("t"), F.lit(1), F.lit(2), F.lit("s"))) == hashlib.sha256(b"t|1|2|s").hexdigest()[:24]
    assert one(spark, ids.patch_id(F.lit("d"), F.lit(0), F.lit(1), F.lit(2), F.lit(144))) == "p6-" + hashlib.sha256(b"d|p=0|r=1|c=2|dpi=144.0").hexdigest()[:26]
    assert ids.cache_path("a/c.json", "i", "x").startswith("a/c_") and ids.cache_path("a/c.json", "i", "x") != ids.cache_path("a/c.json", "j", "x")


def test_vectors(spark):
    a = lambda *x: F.array(*(F.lit(float(v)) for v in x))
    assert one(spark, vectors.cosine(a(1, 0), a(0, 2))) == 0 and one(spark, vectors.cosine(a(1, 0), a(3, 0))) == 1
    assert one(spark, vectors.cosine(a(1, 0), a(1, 0, 0))) == 0 and one(spark, vectors.cosine(a(0, 0), a(1, 0))) == 0
    assert one(spark, vectors.maxsim(vectors.slots(a(1, 0, 0, 1), 2), vectors.slots(a(1, 0, 0, 1), 2))) == pytest.approx(2)
    with pytest.raises(Exception, match="slots"):
        one(spark, vectors.slots(a(*range(10)), 8))


def test_grid(spark):
    tiles = one(spark, geometry.patch_grid(F.lit(300), F.lit(200), 128, 128))
    assert [(t.row_index, t.col_index, t.width_px, t.height_px) for t in tiles] == [(0, 0, 128, 128), (0, 1, 128, 128), (0, 2, 44, 128), (1, 0, 128, 72), (1, 1, 128, 72), (1, 2, 44, 72)]
    assert one(spark, geometry.patch_count(F.lit(500), F.lit(500), 256, 192)) == 9
    for bad in ((32, 16), (128, 8), (128, 200)):
        with pytest.raises(ValueError):
            geometry.check_grid(*bad)


@pytest.mark.parametrize("raw,uint,number", [("true", 7, 0.0), ('"3"', 7, 3.0), ("-1", 7, -1.0), ("4", 4, 4.0), ("4.0", 4, 4.0), ("4.5", 7, 4.5), ("600000", 7, 600000.0), ("null", 7, 0.0), ("1e300", 7, 1e9), ("[1]", 7, 0.0)])
def test_payload(spark, raw, uint, number):
    v = F.parse_json(F.lit(raw))
    assert one(spark, payload.strict_uint(v, 7)) == uint and one(spark, payload.strict_float(v)) == number


def test_patch_placement(spark):
    p = one(spark, payload.patch_placement(F.parse_json(F.lit('{"page_index": 2, "width_px": 0, "x0_px": "9"}'))))
    assert (p.page_index, p.width_px, p.x0_px, p.pixmap_page_width) == (2, 1, 0, 1)


def legs(spark, rows):
    return spark.createDataFrame([("q", *r) for r in rows], "query_id string, chunk_id string, rank int")


def test_fusion(spark):
    got = fusion.fuse([legs(spark, [("a", 1), ("b", 2)]), legs(spark, [("b", 1), ("c", 2), ("a", 3)])], 60, [1.0, 3.0]).orderBy("fused_rank").collect()
    assert [r.chunk_id for r in got] == ["b", "a", "c"] and got[0].rrf == pytest.approx(1 / 62 + 3 / 61)
    tie = fusion.fuse([legs(spark, [("x", 1)]), legs(spark, [("y", 1)])]).orderBy("fused_rank").collect()
    assert [r.chunk_id for r in tie] == ["x", "y"]  # the first leg goes first
    twice = fusion.fuse([legs(spark, [("a", 1), ("a", 2)])]).head()
    assert twice.rrf == pytest.approx(1 / 61 + 1 / 62)
    with pytest.raises(ValueError):
        fusion.fuse([legs(spark, [])], 60, [1.0, 2.0])


def test_windows(spark):
    def window(*ends):
        w = one(spark, fusion.intersect_columns(*(F.lit(x).cast("long") for x in ends)))
        return w and (w.lo, w.hi)

    assert window(9, 11, None, None) == (9, 11) and window(None, 4, None, None) == (0, 4) and window(*[None] * 4) is None
    assert window(9, 11, 0, 4) is None  # disjoint: no filter
    assert window(2, 8, 5, 20) == (5, 8)
    asked = spark.createDataFrame([("q", "what on pages 4-8"), ("r", "what")], "query_id string, query string")
    got = {r.query_id: (r.query, r.lo, r.hi) for r in retrieval.questions(asked, Settings(page_filter_min=6, page_filter_max=None)).collect()}
    assert got == {"q": ("what", 5, 7), "r": ("what", 5, fusion.OPEN)}


def test_filter_falls_back(spark):
    hits = spark.createDataFrame([("q", 1, 0, 0), ("q", 2, 5, 6), ("r", 1, 9, 9)], "query_id string, rank int, page_start int, page_end int")
    got = fusion.filter_or_all(hits, fusion.overlaps(F.lit(5), F.lit(5)), 5).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.filtered) for r in got] == [("q", 2, True), ("r", 1, False)]
    ends = spark.createDataFrame([(None, None)], "page_start int, page_end int").select(fusion.overlaps(F.lit(0), F.lit(0)).alias("v"))
    assert ends.head().v is True


def test_merge_passes(spark):
    got = fusion.merge_passes(legs(spark, [("a", 1), ("b", 2), ("", 3)]), legs(spark, [("b", 1), ("", 2), ("c", 3)]), 5).orderBy("merged_rank").collect()
    assert [r.chunk_id for r in got] == ["a", "b", "", "", "c"]
    full = fusion.merge_passes(legs(spark, [("a", 1), ("b", 2)]), legs(spark, [("z", 1)]), 2).collect()
    assert {r.chunk_id for r in full} == {"a", "b"}  # a full first pass leaves no room


def corpus(spark):
    rows = [(0, "c0", "alpha beta beta"), (1, "c1", "gamma"), (2, "c2", "alpha delta"), (3, "c3", "epsilon"), (4, "c4", "zeta"), (5, " ", "alpha")]
    return spark.createDataFrame(rows, "chunk_pos long, chunk_id string, text string")


def test_bm25_keeps_zeros_and_counts_repeats(spark, tmp_path):
    terms = sparse.term_index(corpus(spark), str(tmp_path / "t"))
    asked = spark.createDataFrame([("q", "beta beta nothing"), ("n", "nothing")], "query_id string, query string")
    got = sparse.sparse_topk(asked, terms, 3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.chunk_pos, r.score > 0) for r in got] == [("n", 0, False), ("n", 1, False), ("n", 2, False), ("q", 0, True), ("q", 1, False), ("q", 2, False)]
    n, dl, avg = 5, 3, 8 / 5
    idf = math.log(n - 1 + 0.5) - math.log(1.5)
    assert got[3].score == pytest.approx(2 * idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * dl / avg)), abs=1e-6)
    again = sparse.load_terms(spark, str(tmp_path / "t"))
    assert (again.n, again.avgdl, again.mean) == (terms.n, terms.avgdl, terms.mean)


def plain_bm25(texts: dict[int, str], query: str) -> list[tuple[float, int]]:
    """All chunks by score, then number."""
    words = {i: t.split() for i, t in texts.items()}
    n, avg = len(words), sum(map(len, words.values())) / len(words)
    df = Counter(w for ws in words.values() for w in set(ws))
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    out = []
    for i, ws in words.items():
        score = 0.0
        for w in query.split():
            tf = ws.count(w)
            score += (floor if raw.get(w, 0) < 0 else raw.get(w, 0)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ws) / avg))
        out.append((-round(score, 9), i))
    return sorted(out)


@pytest.fixture(scope="module")
def zipf():
    """Chunks whose neighbours are alike, and questions of frequent and rare words."""
    rnd = random.Random(12)
    word = lambda topic: "the" if rnd.random() < 0.3 else f"w{int(rnd.paretovariate(0.7)) % 40}" if rnd.random() < 0.5 else f"t{topic}x{rnd.randrange(12)}"
    texts = {i: " ".join(word(i // 40) for _ in range(rnd.randrange(3, 30))) for i in range(900)}
    return texts, {f"q{j}": " ".join(rnd.choice(texts[rnd.randrange(900)].split()) for _ in range(rnd.randrange(1, 5))) + " the" for j in range(25)}


def test_bm25_reads_a_part_of_the_blocks(spark, tmp_path, zipf):
    texts, asked = zipf
    chunks = spark.createDataFrame([(i, f"c{i}", t) for i, t in texts.items()], "chunk_pos long, chunk_id string, text string")
    questions = spark.createDataFrame(list(asked.items()), "query_id string, query string")
    index = sparse.term_index(chunks, str(tmp_path / "t"), span=16)
    assert index.blocks.agg(F.max(F.size("ats"))).head()[0] <= 16 and index.blocks.where("term = 'the'").count() > 50  # a frequent term is spread
    got = {}
    for r in sparse.sparse_topk(questions, index, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.chunk_pos))
    for q, text in asked.items():
        assert [(pytest.approx(s, abs=1e-8), i) for s, i in got[q]] == plain_bm25(texts, text)[:5], text
    every = sparse.block_bounds(questions, index).select("query_id", "block").distinct().count()
    _, rest = sparse.block_plan(questions, index, 5)
    read = rest.select("query_id", "block").distinct().count() + sparse.SEEDS * len(asked)
    assert read < 0.6 * every, (read, every)


def test_blocks_of_terms_take_no_more_tasks_memory(spark, tmp_path, zipf, monkeypatch):
    """Postings and vectors are made in tasks whose share doesn't grow with the corpus, and without a row for each word that Spark
    would have to aggregate or sort; ranges of words, tasks and batches may end anywhere."""
    texts, _ = zipf
    monkeypatch.setattr(sparse, "CHUNKS_OF_TASK", 64)
    monkeypatch.setattr(sparse, "WORDS", 50)
    some = texts | {900: "", 901: None, 902: "end Été", 5000: "far end end"}
    rows = spark.createDataFrame([(i, f"c{i}", t) for i, t in some.items()], "chunk_pos long, chunk_id string, text string")
    made = sparse.posting_blocks(rows, len(some), span=16)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Generate" not in plan and "explode" not in plan
    assert made.rdd.getNumPartitions() == sparse.parts_of(len(some)) == 15
    index = sparse.term_index(rows, str(tmp_path / "t"), span=16)
    want = sorted((w, i, n, len(words)) for i, t in some.items() for words in [(t or "").lower().split()] for w, n in Counter(words).items())
    assert sorted(map(tuple, index.postings().collect())) == want
    heads = {(r.term, r.block): (r.n, r.tokens, r.max_tf, r.min_dl) for r in index.blocks.collect()}
    every = {}
    for w, i, tf, dl in want:
        every.setdefault((w, i // 16), []).append((tf, dl))
    assert heads == {k: (len(v), sum(x[0] for x in v), max(x[0] for x in v), min(x[1] for x in v)) for k, v in every.items()}
    by_blocks = sorted(map(tuple, dense.block_vectors(index).collect()))
    assert by_blocks == sorted(map(tuple, dense.hashed_vectors(index.postings(dense.bucket_of("term").alias("bucket")), "chunk_pos").collect())) and len(by_blocks) == 902
    none = sparse.term_index(rows.limit(0), str(tmp_path / "n"), span=16)
    assert none.blocks.count() == 0 and dense.block_vectors(none).count() == 0


def test_bm25_negative_scores_lose_to_zeros(spark, tmp_path):
    chunks = spark.createDataFrame([(i, f"c{i}", "same" if i < 3 else "") for i in range(4)], "chunk_pos long, chunk_id string, text string")
    asked = spark.createDataFrame([("q", "same")], "query_id string, query string")
    got = sparse.sparse_topk(asked, sparse.term_index(chunks, str(tmp_path / "t")), 2).orderBy("rank").collect()
    assert got[0].chunk_pos == 3 and got[0].score == 0 and got[1].score < 0


def test_bonus_overrides_rank(spark):
    hits = spark.createDataFrame([("q", 1, "narrative", "narrative", "", "show the chart of revenue"), ("q", 2, "figure_visual", "pdf_image", "Revenue by year", "show the chart of revenue"), ("q", 3, "narrative", None, "revenue", "show the chart of revenue")], "query_id string, rank int, content_type string, chunk_kind string, section_hint string, query string")
    got = rerank.metadata_rerank(hits).orderBy("rank").collect()
    assert [round(r.bonus, 2) for r in got] == [1.6, 0.25, 0.0]
    kept, note = rerank.cross_encoder_rerank(hits, None)
    assert kept is hits and note
    scored, _ = rerank.cross_encoder_rerank(hits.withColumn("text", F.col("section_hint")), lambda pairs: [float(len(t)) for _, t in pairs])
    assert [r.section_hint for r in scored.orderBy("rank").collect()] == ["Revenue by year", "revenue", ""]


def test_dense_clamps_and_breaks_ties(spark):
    vecs = spark.createDataFrame([(i, [float(i % 2), 1.0]) for i in range(5)], "chunk_pos long, embedding array<float>")
    q = F.array(F.lit(0.0), F.lit(1.0))
    assert [r.chunk_pos for r in dense.l2_topk(vecs, q, 99).collect()] == [0, 2, 4, 1, 3]
    for metric in ("l2", "cosine"):
        got = dense.batch_topk(vecs, [("q", [0.0, 1.0]), ("r", [1.0, 0.0])], 2, metric).orderBy("query_id", "rank").collect()
        assert [(r.query_id, r.chunk_pos) for r in got] == [("q", 0), ("q", 2), ("r", 1), ("r", 3)]
        named = dense.batch_topk(vecs.withColumn("chunk_pos", F.concat(F.lit("p"), F.col("chunk_pos").cast("string"))), [("q", [0.0, 1.0])], 2, metric).orderBy("rank").collect()
        assert [r.chunk_pos for r in named] == ["p0", "p2"]
    assert dense.batch_topk(vecs, [], 2).count() == 0


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_cells_equal_a_scan(spark, tmp_path, metric):
    """Vectors in clusters, some equal, some without a length: the same rows as by a scan, from a part of the rings."""
    rnd = np.random.default_rng(4)
    centers = rnd.normal(size=(20, 8)) * 6
    x = centers[rnd.integers(0, 20, 4000)] + rnd.normal(size=(4000, 8)) * 0.3
    x[:40], x[40:300] = 0.0, x[300]
    vecs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None)], "chunk_pos long, embedding array<double>").repartition(5)
    asked = [(str(i), x[i].tolist()) for i in range(0, 4000, 100)]
    made = cells.build(vecs, str(tmp_path / "c"), metric, ring=64)
    got = sorted(map(tuple, cells.nearest(made, asked, 7).select("query_id", "chunk_pos", "score", "rank").collect()))
    want = sorted(map(tuple, dense.batch_topk(vecs, asked, 7, metric).select("query_id", "chunk_pos", "score", "rank").collect()))
    assert got == want and len(got) == 280
    plain = [q for q in asked if np.linalg.norm(q[1]) > 0 and not np.array_equal(q[1], x[300])]
    first, rest = cells.plan(made, np.array([v for _, v in plain]), 7)
    rings = made.rings.count()
    assert made.rings.agg(F.max("n")).head()[0] <= 64 and rest.count() + cells.SEEDS * len(plain) < 0.3 * rings * len(plain)
    assert cells.nearest(made, [], 3).count() == 0
    with pytest.raises(ValueError):
        cells.nearest(made, [("q", [1.0])], 3)
    none = cells.build(vecs.limit(0), str(tmp_path / "n"), metric)
    assert cells.nearest(none, [("q", [1.0] * 8)], 3).count() == 0


def test_queries_go_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK", 2)
    vecs = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(7)], "chunk_pos long, embedding array<float>")
    got = dense.batch_topk(vecs, [(str(i), [float(i), 1.0]) for i in range(5)], 1).collect()
    assert {(r.query_id, r.chunk_pos) for r in got} == {(str(i), i) for i in range(5)}


def test_maxsim_of_all_pairs(spark, monkeypatch):
    """Over the edges of blocks and tiles, with nulls on both sides, as the columns' function gives it; queries stand in no plan."""
    monkeypatch.setattr(dense, "BLOCK", 7)
    monkeypatch.setattr(dense, "TILE", (3, 16))
    x = np.random.default_rng(5).normal(size=(150, 12))
    x[:3] = 0.0
    vecs = spark.createDataFrame([(i, None if i in (20, 77) else v.tolist()) for i, v in enumerate(x)], "chunk_pos long, embedding array<double>")
    asked = vecs.where("chunk_pos % 10 = 0").select(F.col("chunk_pos").cast("string").alias("query_id"), F.col("embedding"))
    got = dense.maxsim_pairs(vecs, asked, 4)
    want = vecs.crossJoin(asked.withColumnRenamed("embedding", "q")).select("query_id", "chunk_pos", F.round(vectors.maxsim(vectors.slots("q", 4), vectors.slots("embedding", 4)), 9).alias("maxsim"))
    key = lambda df: sorted(df.collect(), key=lambda r: (r[0], r[1]))
    assert key(got.withColumn("maxsim", F.round("maxsim", 9))) == key(want) and got.count() == 15 * 150
    assert dense.maxsim_pairs(vecs, asked.limit(0), 4).count() == 0
    with pytest.raises(Exception, match="slots"):
        dense.maxsim_pairs(vecs, asked, 5).count()


def test_newest_bears_the_whole_table(spark, sf_dir):
    """The newest of all events, without one window over the table."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.pmod("event_id", F.lit(97)).cast("double").alias("created_ts"), F.col("event_id").alias("pos"))
    top = cache.newest(events, 256)
    want = sorted((-(r.event_id % 97), -r.event_id) for r in events.collect())[:256]
    assert {r.event_id for r in top.collect()} == {-i for _, i in want} and len(want) == 256
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Window" not in plan


def test_cache(spark, tmp_path):
    store = cache.AnswerCache(str(tmp_path / "c"), 3)
    assert store.lookup(spark, [1.0, 0.0], 0.9) is None
    for i in range(5):
        store.put(spark, [1.0, i / 100], f"a{i}", now=i)
    assert sorted(r.answer for r in cache.newest(store.table(spark), 3).collect()) == ["a2", "a3", "a4"]  # first in, first out
    assert store.lookup(spark, [1.0, 0.0], 0.95)[0] == "a2" and store.lookup(spark, [0.0, 1.0], 0.95) is None
    assert store.lookup(spark, [1.0, 0.0, 0.0], 0.5) is None
    five = spark.createDataFrame([("a", [1.0], i) for i in range(5)], "answer string, embedding array<double>, pos long")
    with pytest.raises(ValueError, match="evict"):
        cache.probe(five.select(F.lit("q").alias("query_id"), "embedding"), five, most=4)
    assert cache.eligible(None, None, None) and not cache.eligible((1, 2), None, None)


def test_cache_of_several_sessions(spark, tmp_path, monkeypatch):
    """Writers at once, a compaction while another session writes, and one that breaks off: no entry is lost or counted twice."""
    stores = [cache.AnswerCache(str(tmp_path / "c"), 100, segments=50) for _ in range(3)]
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda i: stores[i % 3].put(spark, [1.0, float(i)], f"a{i}", now=i), range(12)))
    answers = lambda: sorted(r.answer for r in stores[0].table(spark).collect())
    every = sorted(f"a{i}" for i in range(12))
    assert answers() == every
    remove = cache.deleted

    def writes_meanwhile(s, path):
        if len(answers()) == 12:
            stores[1].put(s, [0.0, 1.0], "meanwhile")
        remove(s, path)

    with monkeypatch.context() as m:
        m.setattr(cache, "deleted", writes_meanwhile)
        stores[0].compact(spark)
    assert answers() == sorted([*every, "meanwhile"]) and len(stores[0]._listed(spark)) == 2
    with monkeypatch.context() as m:
        m.setattr(cache, "deleted", lambda *_: None)  # broken off before it deletes
        stores[2].compact(spark)
    assert answers() == sorted([*every, "meanwhile"])
    small = cache.AnswerCache(str(tmp_path / "c"), 4, segments=2)
    small.put(spark, [5.0, 5.0], "last", now=1000)
    assert len(small._listed(spark)) == 1 and answers() == ["a10", "a11", "last", "meanwhile"]


def test_measures_of_answers(spark):
    """Shares and rank-weighted precision from verdicts, by the lexical judge and by a model that fails now and then."""
    rows = [("q", "when did costs fall", "Costs fell in spring. The moon is far away!", "Costs fell in spring.\nRevenue grew.", ["nothing of it", "in spring costs fell", "revenue grew a lot"]), ("none", "what", "", None, None), ("bare", "costs fall", "Costs fall.", "", ["costs fall"])]
    samples = spark.createDataFrame(rows, "query_id string, question string, generated_answer string, ground_truth_answer string, retrieved_contexts array<string>")
    got = {r.query_id: tuple(r)[5:] for r in metrics.measures(samples).collect()}
    assert got == {"q": (0.5, 0.0, pytest.approx((1 / 2 + 2 / 3) / 2), 1.0), "none": (None, None, None, None), "bare": (1.0, 1.0, None, None)}

    def judge(requests):
        pairs = [json.loads(r) for r in requests]
        if len(pairs) > 2:
            raise ConnectionError("too many")
        return [ValueError("unsure") if "moon" in p["statement"] else "Yes." if p["passage"].split()[-1].strip(".!") in p["statement"].lower() else "no" for p in pairs]

    by_model = metrics.measures(samples, metrics.judge_by(lambda: judge, calls.Limits(tries=2)), "")
    assert by_model.columns[5:] == list(metrics.NAMES)
    q = by_model.where("query_id = 'q'").head()
    assert (q.faithfulness, q.context_recall) == (1.0, 0.5)  # the statement on which the judge fails counts in neither


def test_neighbours_by_a_sweep(spark):
    """Against all pairs, with ties, overlaps and pages without spans; the plan joins no anchors with spans."""
    rnd = random.Random(9)
    box = lambda: (float(y := rnd.randrange(40)), float(y + rnd.randrange(6)))
    spans = [(d, p, f"s{i}", i, *box()) for i, (d, p) in enumerate((rnd.choice("ab"), rnd.randrange(3)) for _ in range(150))] + [("a", 0, "bare", 999, None, None)]
    anchors = [(d, p, i, *box()) for i, (d, p) in enumerate((rnd.choice("abc"), rnd.randrange(4)) for _ in range(80))]
    got = layout.nearest_neighbors(spark.createDataFrame(anchors, "doc_id string, page_index int, anchor_id long, y0 double, y1 double"), spark.createDataFrame(spans, "doc_id string, page_index int, span_id string, span_pos long, y0 double, y1 double"))
    want = {}
    for d, p, i, y0, y1 in anchors:
        here = [s for s in spans if s[:2] == (d, p) and s[4] is not None]
        pick = lambda gaps: min(gaps, default=(None, None, None))[2]
        want[i] = pick([(y0 - s[5], s[3], s[2]) for s in here if y0 - s[5] >= -2]), pick([(s[4] - y1, s[3], s[2]) for s in here if s[4] - y1 >= -2])
    assert {r.anchor_id: (r.above_id, r.below_id) for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("Window ") == 2  # above with below


def test_context_stops_at_the_first_overflow(spark):
    hits = spark.createDataFrame([("q", i + 1, "x" * n, 3, 4, "narrative", None) for i, n in enumerate((50, 5000, 10))], "query_id string, rank int, text string, page_start int, page_end int, content_type string, chunk_kind string")
    packed = folds.packed_context(hits, 1000)
    assert [r.rank for r in packed.collect()] == [1]
    assert folds.context_text(packed).head().context.startswith("[1] pages 3–4 · narrative · narrative\nxxx")


def test_embed_batches(spark):
    rows = spark.createDataFrame([("c", i, "x" * n) for i, n in enumerate([4] * 5)], "corpus string, chunk_pos long, text string")
    assert [r.batch_no for r in folds.embed_batches(rows, 2).orderBy("chunk_pos").collect()] == [0, 0, 1, 1, 2]
    big = spark.createDataFrame([("c", i, "x" * 3000) for i in range(3)], "corpus string, chunk_pos long, text string")
    assert [r.batch_no for r in folds.embed_batches(big, 250, 2000).orderBy("chunk_pos").collect()] == [0, 1, 2]
    with pytest.raises(Exception, match="budget"):
        folds.embed_batches(big, 250, 100).collect()
    rnd = random.Random(1)
    sizes = [(rnd.choice(["a", "b", None]), i, rnd.randrange(1, 120)) for i in range(600)]
    many = spark.createDataFrame([(g, i, "x" * n) for g, i, n in sizes], "corpus string, chunk_pos long, text string")
    want = {}
    for g in ("a", "b", None):
        n = used = no = 0
        for _, i, size in (x for x in sizes if x[0] == g):
            if n == 9 or n and used + size // 2 + 1 > 300:
                n, used, no = 0, 0, no + 1
            n, used, want[i] = n + 1, used + size // 2 + 1, no
    for span in (1, 7, 50, 10_000):  # ranges of any size give the same fold
        assert {r.chunk_pos: r.batch_no for r in folds.embed_batches(many, 9, 300, span=span).collect()} == want
    with pytest.raises(ValueError):
        folds.embed_batches(big, 0)


SPAN = "doc_id string, span_id string, page_index int, x0 double, y0 double, x1 double, y1 double, text string, span_pos long"


def test_layout(spark):
    spans = spark.createDataFrame([("d", "s10", 0, 0.0, 5.0, 1.0, 6.0, "ten", 1), ("d", "s2", 0, 0.0, 5.0, 1.0, 6.0, "two", 2), ("d", "s0", 0, 0.0, 90.0, 9.0, 95.0, "low " * 200, 3), ("d", "n", 0, None, None, None, None, "none", 4)], SPAN)
    assert [r.span_id for r in layout.reading_order(spans).orderBy("reading_no").collect()] == ["s10", "s2", "s0", "n"]
    anchors = spark.createDataFrame([("d", "t", 0, 7.0, 80.0), ("d", "bare", 0, None, None)], "doc_id string, anchor_id string, page_index int, y0 double, y1 double")
    near = layout.with_page_fallback(anchors, spans, layout.nearest_neighbors(anchors.where("y0 is not null"), spans))
    got = {r.anchor_id: (r.above_id, r.below_id) for r in near.collect()}
    assert got == {"t": ("s10", "s0"), "bare": ("s10", "s0")}
    texts = {r.anchor_id: r.contextual_snippet_below for r in layout.neighbor_snippets(near, spans).collect()}
    assert len(texts["t"]) == 399 and texts["t"].endswith("...[truncated]")


def test_layout_runs_count_cleaned_texts(spark):
    spans = spark.createDataFrame([("d", "s1", 0, 0.0, 0.0, 1.0, 1.0, "a" + " " * 30 + "b", 0), ("d", "s2", 0, 0.0, 2.0, 1.0, 3.0, "c" * 20, 1)], SPAN)
    assert [r.text for r in chunking.layout_runs(spans, 40).collect()] == ["a b " + "c" * 20]


def test_chunks(spark):
    pages = spark.createDataFrame([("d", 0, "alpha " * 20), ("d", 1, " "), ("d", 2, "beta " * 20), ("e", 0, "short")], "doc_id string, page_index int, text string")
    got = chunking.page_chunks(pages, 80, 10).where("doc_id = 'd'").orderBy("n").collect()
    assert [r.page_start for r in got] == [0, 0, 2, 2] and all(r.chunk_kind == "narrative" for r in got)
    spans = spark.createDataFrame([("d", "a", 0, 0.0, 0.0, 1.0, 1.0, "x" * 30, 0), ("d", "b", 1, 0.0, 0.0, 1.0, 1.0, "y" * 30, 1), ("d", "c", 1, 0.0, 5.0, 1.0, 6.0, "z" * 5, 2)], SPAN)
    runs = chunking.layout_runs(spans, 40).orderBy("run").collect()
    assert [(r.text, r.page_start, r.page_end) for r in runs] == [("x" * 30, 0, 0), ("y" * 30 + " " + "z" * 5, 1, 1)]
    made, notes = chunking.narrative_chunks(spans, pages, 40, 10)
    assert {r.structure_note for r in made.where("doc_id = 'd'").collect()} == {"layout_reading_order"} and [r.doc_id for r in notes.collect()] == ["e"]
    whole = chunking.union_chunks(made).orderBy("chunk_pos").collect()
    assert [r.chunk_pos for r in whole] == list(range(len(whole)))
    assert chunking.status(made.limit(0)) == "narrative_only"
    assert chunking.payload(chunking.union_chunks(made).withColumn("text", F.col("text"))).head().metadata.chunk_id


def test_tables_and_images(spark):
    t = spark.createDataFrame([("d", 1, "sha", "a.pdf", "t1", 2, "pymupdf", [["Year", "Year", ""], ["1", None, "x"]], None, None, None, None), ("d", 2, "sha", "a.pdf", "t2", 2, "pymupdf", None, " ", "", None, None)], "doc_id string, n int, pdf_sha256 string, source string, table_id string, page_index int, extractor string, rows array<array<string>>, as_markdown string, as_csv string, summary string, contextual_snippet_above string")
    chunk = structured.table_chunks(t).collect()
    assert len(chunk) == 1 and "TABLE · page 3 · pymupdf\ntable_id=t1\n\n| Year | Year |  |\n| --- | --- | --- |\n| 1 |  | x |" == chunk[0].text and chunk[0].section_hint == "page 3"
    made = structured.table_exports(t).where("n = 1").head()
    assert made.as_csv == "Year,Year.1,\n1,,x\n" and '"Year.1":""' in made.as_json
    image = "doc_id string, n int, pdf_sha256 string, source string, xref long, page_index int, x0 double, y0 double, x1 double, y1 double, mime_type string, width_px int, height_px int, caption string, caption_model string, contextual_snippet_above string, contextual_snippet_below string"
    rows = [("d", 1, "s", "a", 1, 0, 0.0, 0.0, 9.0, 9.0, None, None, None, None, None, None, None), ("d", 2, "s", "a", 2, 0, 0.0, 0.0, 900.0, 900.0, None, None, None, None, None, None, None), ("d", 3, "s", "a", 3, 0, 0.0, 0.0, 9.0, 9.0, None, None, None, "a bar", None, None, None), ("d", 4, "s", "a", 4, 0, 0.0, 0.0, 1.0, 1.0, "image/png", 200, 200, None, None, "Figure 2: x", None)]
    images = spark.createDataFrame(rows, image)
    assert [r.n for r in structured.image_chunks(images).orderBy("n").collect()] == [3, 4]
    assert [r.n for r in structured.image_chunks(images, need_label=True).collect()] == [4]
    kept, dropped = layout.labelled_images(images)
    assert kept.count() == 1 and dropped.count() == 3


def test_evaluation(spark, tmp_path):
    nan = float("nan")
    rows = spark.createDataFrame([(1, None, nan), (2, None, 0.5), (3, "t", nan)], "row_no int, context_content_type string, faithfulness double")
    got = {r.context_content_type: r.faithfulness for r in evaluation.mean_by_type(rows, ["faithfulness"]).collect()}
    assert got[None] == 0.5 and math.isnan(got["t"])
    assert [r.row_no for r in evaluation.worst(rows).collect()] == [2] and evaluation.worst(rows, 0).count() == 0
    whole = dict.fromkeys(evaluation.CRITERIA, 4)
    report = {"retrieval_config": {"a|b": 1}, "ragas_summary_mean": {"zeta": nan, "faithfulness": 0.5}, "ragas_by_context_content_type": [{"context_content_type": "t", "faithfulness": 0.25}], "per_row_ragas": [{"faithfulness": nan}, {"faithfulness": 0.1, "user_input": "why\n?"}], "llm_judge": [{"scores": {"error": "x"}}, {"scores": whole}]}
    evaluation.write_report(spark, str(tmp_path / "r.json"), report)
    md = (tmp_path / "r.md").read_text()
    assert "a\\|b" in md and "| faithfulness | 0.500 |\n| zeta | — |" in md and "Failures: **1**" in md and "why<br>?" in md
    assert "_No scores._" in evaluation.markdown_report(spark, {})


def test_multi_hop(spark):
    asked = spark.createDataFrame([("q", "first question", None, None), ("r", "other", None, None)], "query_id string, query string, lo long, hi long")
    search = lambda df: df.select("query_id", F.when(F.col("query") == "more", "b").otherwise("a").alias("chunk_id"), F.lit(1).alias("rank"), F.col("query").alias("text"))
    notes_of = lambda refine: {r.query_id: (r.note, r.follow_length) for r in retrieval.multi_hop(asked, search, refine, Settings())[1].collect()}
    hits, notes = retrieval.multi_hop(asked, search, lambda prompts: ["\n more \nless" if "first" in p else "done." for p in prompts], Settings())
    assert {(r.query_id, r.chunk_id) for r in hits.collect()} == {("q", "a"), ("q", "b"), ("r", "a")}
    assert {r.query_id: (r.note, r.follow_length) for r in notes.collect()} == {"q": ("multi_hop_second_pass", 4), "r": ("multi_hop_done", None)}
    assert notes.where("query_id = 'q'").head().follow_sha256 == hashlib.sha256(b"more").hexdigest()

    def fails(prompts):
        raise RuntimeError("no model")

    assert notes_of(fails) == {"q": ("multi_hop_failed: RuntimeError: no model", None), "r": ("multi_hop_failed: RuntimeError: no model", None)}
    assert notes_of(lambda prompts: [ValueError("x") if "first" in p else "FIRST QUESTION" for p in prompts])["q"][0] == "multi_hop_failed: ValueError: x"
    assert set(notes_of(lambda prompts: ["Other" for p in prompts]).values()) == {("multi_hop_second_pass", 5), ("multi_hop_done", None)}
    assert set(notes_of(None).values()) == {("multi_hop_disabled", None)}
    none, told = retrieval.multi_hop(asked, lambda df: search(df).limit(0), fails, Settings())
    assert none.count() == 0 and {r.note for r in told.collect()} == {"multi_hop_empty"}
    assert retrieval.dense_pool(Settings(top_k=20), True) == 50 and retrieval.dense_pool(Settings(), False) == 5


def test_alignment(spark):
    a, b = spark.range(3).withColumn("x", F.lit(1)), spark.range(3).withColumn("y", F.lit(2))
    assert batching.aligned(a, b, "id").count() == 3
    with pytest.raises(Exception, match="same rows"):
        batching.aligned(a, b.where("id < 2"), "id").collect()
    rows = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new")], "chunk_id string, chunk_pos long, text string")
    assert [r.text for r in batching.keep_last(rows, "chunk_id", "chunk_pos").collect()] == ["new"]


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_positions_are_dense_over_many_partitions(spark, coalesce, tmp_path):
    """400,000 rows over many range partitions: no row is lost, and every number occurs once, in the order of the keys."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        rows = spark.range(400_000).select((F.col("id") * 7919 % 400_000).alias("doc_id"), F.lit(0).alias("kind_no"), F.repeat(F.lit("x"), 50).alias("text"))
        got = chunking.positioned(rows, ["kind_no", "doc_id"]).select("chunk_pos", "doc_id")
        assert got.where("chunk_pos = doc_id").count() == got.count() == 400_000
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert chunking.positioned(rows.limit(0), ["doc_id"]).count() == 0


@pytest.mark.parametrize(("size", "overlap"), [(40, 10), (50, 45), (7, 0)])
def test_page_windows_against_one_string(spark, size, overlap):
    """Pages of many lengths, blank ones, one of several windows: the windows of the joined text and the pages of their middles."""
    rnd, step = random.Random(size), size - overlap
    docs = {f"d{d}": {p * 2: "".join(rnd.choice("abé🎉  \n") for _ in range(rnd.choice([0, 3, 20, 400]))) for p in range(rnd.randrange(1, 9))} for d in range(12)}
    docs["long"] = {p: f"page {p} " * rnd.randrange(1, 6) for p in range(700)}
    rows = [(d, p, t) for d, pages in docs.items() for p, t in pages.items()]
    got = {(r.doc_id, r.n): (r.text, r.page_start) for r in chunking.page_chunks(spark.createDataFrame(rows, "doc_id string, page_index int, text string").repartition(5), size, overlap).collect()}
    want = {}
    for d, pages in docs.items():
        whole, starts = "", []
        for p, t in sorted(pages.items()):
            if t := " ".join(t.split()):
                whole += "\n\n" if whole else ""
                starts.append((len(whole), p))
                whole += t
        for n in range(-(-len(whole) // step)):
            w = whole[n * step : n * step + size]
            if w.strip():
                want[d, n] = w.strip(), max(s for s in starts if s[0] <= n * step + len(w) // 2)[1]
    assert got == want


def test_a_document_of_many_pages(spark):
    """200 MB in one document: no row holds more than some windows of it."""
    pages = spark.range(40_000).select(F.lit("d").alias("doc_id"), F.col("id").cast("int").alias("page_index"), F.concat(F.lit("p"), F.col("id").cast("string"), F.repeat(F.lit(" wordswords"), 454)).alias("text"))
    got = chunking.page_chunks(pages).agg(F.count(F.lit(1)).alias("n"), F.max("page_start").alias("last"), F.count_if(F.length("text") > 1200).alias("over")).head()
    total = sum(1 + len(str(i)) + 454 * 11 for i in range(40_000)) + 2 * 39_999
    assert got.n == -(-total // 1000) and got.last == 39_999 and got.over == 0


def test_tables_in_text(spark):
    """A head over two columns, a missing cell, a cell of two words; prose and a single row are no tables."""
    rows = [("a", 0, 100, 10, "Year"), ("b", 60, 140, 10, "Sums of all"), ("c", 0, 30, 30, "2020"), ("d", 60, 90, 31, "1.5"), ("e", 110, 140, 29, "2.5"), ("f", 0, 30, 50, "2021"), ("g", 111, 125, 50, "3"), ("h", 126, 140, 50, "mn"), ("p", 0, 300, 120, "A line of prose."), ("q", 0, 300, 140, "Another one."), ("x", 0, 30, 400, "alone"), ("y", 60, 90, 400, "here"), ("z", None, None, None, "no box")]
    rows[0] = ("a", 0, 30, 10, "Year")
    spans = spark.createDataFrame([("d", 3, i, *(None if v is None else float(v) for v in (x0, y, x1, None if y is None else y + 12)), t) for i, x0, x1, y, t in rows], "doc_id string, page_index int, span_id string, x0 double, y0 double, x1 double, y1 double, text string")
    got = tables.stream_tables(spans).collect()
    assert [(r.table_id, r.rows) for r in got] == [("stream-p3-0", [["Year", "Sums of all", ""], ["2020", "1.5", "2.5"], ["2021", "", "3 mn"]])]
    assert got[0].filled == pytest.approx(7 / 9) and (got[0].x0, got[0].y0, got[0].x1, got[0].y1) == (0, 10, 140, 62)
    assert tables.stream_tables(spans.limit(0)).count() == 0


def test_calls_keep_order_and_lose_only_what_fails():
    limits, sent = calls.Limits(items=3, size=10, tries=3), []
    fails = iter([True, False, True, True] + [False] * 50)

    def transport(requests):
        sent.append(list(requests))
        if next(fails):
            raise ConnectionError("down")
        return [KeyError(r) if r == "bad" else r.upper() for r in requests]

    requests = ["a", None, "bb", "ccc", "d" * 12, "bad", "e", "f"]
    got = calls.replies(requests, transport, limits)
    assert [type(x).__name__ if isinstance(x, Exception) else x for x in got] == ["A", None, "BB", "CCC", "D" * 12, "KeyError", "E", "F"]
    assert sent[0] == sent[1] == ["a", "bb", "ccc"]  # tried again as it was
    assert sent[2] == sent[3] == sent[4] == ["d" * 12] and sent[5] == ["bad", "e", "f"] and sent[6:] == [["bad"], ["bad"]]

    def breaks(requests):
        if "poison" in requests:
            raise ValueError("all of it")
        return list(requests)

    got = calls.replies(["a", "poison", "b", "c"], breaks, calls.Limits(items=4, tries=1))
    assert [got[0], got[2], got[3]] == ["a", "b", "c"] and isinstance(got[1], ValueError)
    assert isinstance(calls.replies(["x"], lambda r: [], calls.Limits(tries=1))[0], RuntimeError)
    assert [len(x) for x in calls.batches_of(["ab"] * 7 + [None, "x" * 99], calls.Limits(items=5, size=6))] == [3, 3, 1, 1]
