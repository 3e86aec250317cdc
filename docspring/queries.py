"""One query for each operator over the test tables, and the SQL that must give the same rows."""

from __future__ import annotations

import base64
import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docspring.config import Settings
from docspring.functions import calls, geometry, ids, models, payload, text, vectors
from docspring.operators import batching, cache, cells, chunking, dense, evaluation, folds, fusion, layout, metrics, rerank, sparse, structured, tables
from docspring.plans import answers, corpus, retrieval
from docspring.sources import documents as sources
from docspring.sources import index, points, segments
from docspring.staging import scratch

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a query under its function's name."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


CUES = ["Figure 3: margins. ", "Table 12 shows it. ", "About US$5 million more. ", "Sold for $ 5 each. ", ""]


def cued(docs: DataFrame) -> DataFrame:
    """Documents with words in front that the classifiers look for."""
    cue = F.element_at(F.array(*(F.lit(c) for c in CUES)), (F.pmod("doc_id", F.lit(5)) + 1).cast("int"))
    return docs.withColumn("text", F.concat(cue, "text"))


CUED = "(SELECT doc_id, source, ['" + "', '".join(CUES) + "'][(doc_id % 5)::INT + 1] || text AS text FROM documents)"
TOKEN = r"[\p{L}\p{N}_]+"


def chunk_rows(docs: DataFrame) -> DataFrame:
    """Documents as chunks: pages, types and kinds follow from the id."""
    page = F.pmod("doc_id", F.lit(40)).cast("int")
    kinds = ["narrative", "figure_ref", "table_structured", "figure_visual"]
    of = F.element_at(F.array(*(F.lit(k) for k in kinds)), (F.pmod("doc_id", F.lit(4)) + 1).cast("int"))
    kind = F.when(of == "table_structured", "pdf_table").when(of == "figure_visual", "pdf_image").otherwise("narrative")
    return docs.select(F.col("doc_id").alias("chunk_pos"), F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id"), "text", page.alias("page_start"), (page + F.pmod("doc_id", F.lit(3)).cast("int")).alias("page_end"), of.alias("content_type"), kind.alias("chunk_kind"), text.section_hint("text").alias("section_hint"))


CHUNKS = """chunks AS (SELECT doc_id AS chunk_pos, 'c' || doc_id AS chunk_id, text, (doc_id % 40)::INT AS page_start, (doc_id % 40 + doc_id % 3)::INT AS page_end,
    ['narrative', 'figure_ref', 'table_structured', 'figure_visual'][(doc_id % 4)::INT + 1] AS content_type,
    ['narrative', 'narrative', 'pdf_table', 'pdf_image'][(doc_id % 4)::INT + 1] AS chunk_kind, CASE WHEN length(line) > 96 THEN substr(line, 1, 95) || '…' ELSE line END AS section_hint
    FROM (SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1] AS line FROM documents))"""


# --- text functions ---


@query("SELECT doc_id, md5(trim(regexp_replace(replace(chr(9) || text || chr(10), chr(0), ''), '\\s+', ' ', 'g'))) AS cleaned FROM documents")
def clean_text(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.md5(text.clean_text(F.concat(F.lit("\t"), "text", F.lit("\n")))).alias("cleaned"))


@query(f"SELECT doc_id, len(regexp_extract_all(lower(text), '{TOKEN}')) AS n_tokens, len(list_distinct(regexp_extract_all(lower(text), '{TOKEN}'))) AS n_distinct FROM documents")
def token_counts(spark, sf_dir):
    words = text.tokens("text")
    return documents(spark, sf_dir).select("doc_id", F.size(words).cast("long").alias("n_tokens"), F.size(F.array_distinct(words)).cast("long").alias("n_distinct"))


@query("WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents), f AS (SELECT doc_id, arg_min(line, n) AS line FROM l WHERE line <> '' GROUP BY doc_id) SELECT d.doc_id, CASE WHEN length(line) > 96 THEN substr(line, 1, 95) || '…' ELSE line END AS section_hint FROM documents d LEFT JOIN f ON d.doc_id = f.doc_id")
def section_hint(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.section_hint("text").alias("section_hint"))


@query(rf"""SELECT doc_id, CASE WHEN regexp_matches(substr(text, 1, 800), '(?i)\b(figure|fig\.|chart|graph|diagram)\b') THEN 'figure_ref'
    WHEN regexp_matches(substr(text, 1, 800), '(?i)\b(table\s+\d+|schedule\s+[ivx\d]|million\b|billion\b|\$\s*[\d,]+)\b') THEN 'table_dense'
    WHEN regexp_matches(substr(text, 1, 800), '\$\s*\d') THEN 'numeric_heavy' ELSE 'narrative' END AS content_type FROM {CUED}""")
def content_type(spark, sf_dir):
    return cued(documents(spark, sf_dir)).select("doc_id", text.content_type("text").alias("content_type"))


@query("SELECT doc_id, md5(CASE WHEN length(trim(text, E' \\n\\t')) > 500 THEN substr(trim(text, E' \\n\\t'), 1, 485) || '...[truncated]' ELSE trim(text, E' \\n\\t') END) AS clipped FROM documents")
def clip_text(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.md5(text.clip("text", 500)).alias("clipped"))


@query("WITH t AS (SELECT doc_id, trim(text, E' \\n\\t') AS t FROM documents) SELECT doc_id, md5('<<<UNTRUSTED_PDF_LAYOUT_TEXT role=sec_' || doc_id || '>>>' || chr(10) || CASE WHEN length(t) > 2500 THEN substr(t, 1, 2485) || '...[truncated]' ELSE t END || chr(10) || '<<<END_UNTRUSTED_PDF_LAYOUT_TEXT role=sec_' || doc_id || '>>>') AS block FROM t")
def untrusted_blocks(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", F.md5(text.untrusted_layout(F.concat(F.lit("sec #*"), F.col("doc_id").cast("string")), "text")).alias("block"))


@query(r"""WITH q AS (SELECT item_id, text || CASE item_id % 4 WHEN 0 THEN ' only on pages 9-4' WHEN 1 THEN ' pages 3 to 12 and page 5' WHEN 2 THEN ' page 7' ELSE '' END AS query FROM benchmark),
    m AS (SELECT item_id, query, regexp_matches(query, '(?i)\b(?:only\s+)?(?:on\s+)?pages?\s*(\d+)\s*(?:-|–|to)\s*(\d+)\b') AS has, regexp_extract(query, '(?i)\bpages?\s*(\d+)\s*(?:-|–|to)\s*(\d+)\b', 1) AS a, regexp_extract(query, '(?i)\bpages?\s*(\d+)\s*(?:-|–|to)\s*(\d+)\b', 2) AS b FROM q)
    SELECT item_id, CASE WHEN has THEN trim(regexp_replace(regexp_replace(query, '(?i)\b(?:only\s+)?(?:on\s+)?pages?\s*(\d+)\s*(?:-|–|to)\s*(\d+)\b', ' ', 'g'), '\s+', ' ', 'g')) ELSE query END AS query,
           CASE WHEN has THEN least(a::BIGINT, b::BIGINT) END AS lo, CASE WHEN has THEN greatest(a::BIGINT, b::BIGINT) END AS hi FROM m""")
def page_clause(spark, sf_dir):
    end = F.element_at(F.array(*(F.lit(x) for x in (" only on pages 9-4", " pages 3 to 12 and page 5", " page 7", ""))), (F.pmod("item_id", F.lit(4)) + 1).cast("int"))
    return table(spark, sf_dir, "benchmark").select("item_id", text.strip_page_clause(F.concat("text", end)).alias("p")).select("item_id", "p.query", "p.lo", "p.hi")


@query("SELECT doc_id, start, md5(substr(text, start + 1, 1200)) AS piece FROM (SELECT doc_id, text, unnest(range(0, length(text), 1000))::INT AS start FROM documents)")
def chunk_windows(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.explode(text.windows("text", 1200, 200)).alias("w"))
    return rows.select("doc_id", "w.start", F.md5("w.text").alias("piece"))


@query("SELECT doc_id, left(sha256(text || '|' || doc_id % 7 || '|' || (doc_id % 7 + 1) || '|' || source), 24) AS chunk_id, left(sha256(source || chr(0) || 't' || doc_id || chr(0) || doc_id % 7), 24) AS table_chunk_id, 'p6-' || left(sha256(source || '|p=1|r=2|c=' || doc_id || '|dpi=144.0'), 26) AS patch_id FROM documents")
def chunk_ids(spark, sf_dir):
    page = F.pmod("doc_id", F.lit(7))
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", ids.chunk_id("text", page, page + 1, "source").alias("chunk_id"), ids.table_chunk_id("source", F.concat(F.lit("t"), docs.doc_id.cast("string")), page).alias("table_chunk_id"), ids.patch_id("source", F.lit(1), F.lit(2), "doc_id", F.lit(144)).alias("patch_id"))


@query("""WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('rag:c' || doc_id)) AS h FROM documents)
    SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || ['8', '9', 'a', 'b'][strpos('0123456789abcdef', substr(h, 17, 1))::INT - 1 - 4 * ((strpos('0123456789abcdef', substr(h, 17, 1)) - 1) // 4)::INT + 1] || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM h""")
def point_uuid(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", ids.point_uuid(F.concat(F.lit("c"), docs.doc_id.cast("string"))).alias("point_id"))


@query(rf"""SELECT doc_id, coalesce(nullif(trim(regexp_replace(source || ' <b>' || doc_id || '</b>; p. 4 & 8 {{x}}', '[^\p{{L}}\p{{N}}_\s\-;,./()%+]', '', 'g')), ''), 'unknown') AS label, regexp_matches(CASE doc_id % 3 WHEN 0 THEN 'Table & text' WHEN 1 THEN 'Multi-Modal' ELSE 'text' END, '(?i)image|figure|visual|table|combination|multi-modal|multimodal') AS judged FROM documents""")
def safe_labels(spark, sf_dir):
    docs = documents(spark, sf_dir)
    kind = F.when(F.pmod("doc_id", F.lit(3)) == 0, "Table & text").when(F.pmod("doc_id", F.lit(3)) == 1, "Multi-Modal").otherwise("text")
    return docs.select("doc_id", text.safe_label(F.concat("source", F.lit(" <b>"), docs.doc_id.cast("string"), F.lit("</b>; p. 4 & 8 {x}"))).alias("label"), text.is_judged(kind).alias("judged"))


@query("SELECT doc_id, md5(replace(replace(CASE WHEN length(trim(text, E' \\n')) > 100 THEN substr(trim(text, E' \\n'), 1, 88) || '… [truncated]' ELSE trim(text, E' \\n') END, '|', '\\|'), chr(10), '<br>')) AS cell, CASE WHEN doc_id % 5 = 0 THEN '—' ELSE printf('%.3f', doc_id / 8.0) END AS metric FROM documents")
def report_cells(spark, sf_dir):
    value = F.when(F.pmod("doc_id", F.lit(5)) == 0, F.lit(float("nan"))).otherwise(F.col("doc_id") / 8.0)
    return documents(spark, sf_dir).select("doc_id", F.md5(text.table_cell("text", 100)).alias("cell"), text.metric_cell(value).alias("metric"))


# --- chunking over conversations: a conversation is a document, a turn is a page ---


def pages_of(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page_index"), "text")


@query(r"""WITH p AS (SELECT conv_id AS doc_id, turn::INT AS page, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations WHERE trim(regexp_replace(text, '\s+', ' ', 'g')) <> ''),
    s AS (SELECT doc_id, page, t, coalesce(sum(length(t) + 2) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM p),
    w AS (SELECT doc_id, string_agg(t, chr(10) || chr(10) ORDER BY page) AS whole FROM p GROUP BY doc_id),
    c AS (SELECT doc_id, unnest(range(0, length(whole), 250)) AS pos, whole FROM w),
    x AS (SELECT doc_id, pos, substr(whole, pos + 1, 300) AS raw FROM c),
    j AS (SELECT x.doc_id, pos, raw, max(page) FILTER (start <= pos + length(raw) // 2) AS page FROM x JOIN s ON x.doc_id = s.doc_id GROUP BY x.doc_id, pos, raw)
    SELECT doc_id, (pos // 250)::INT AS n, page AS page_start, left(sha256(trim(raw, E' \n') || '|' || page || '|' || page || '|' || doc_id), 24) AS chunk_id FROM j WHERE trim(raw, E' \n') <> ''""")
def page_asof_chunks(spark, sf_dir):
    return chunking.page_chunks(pages_of(spark, sf_dir), 300, 50).select("doc_id", "n", "page_start", "chunk_id")


def spans_of(spark, sf_dir) -> DataFrame:
    pages = pages_of(spark, sf_dir)
    y = F.pmod(F.col("page_index") * 37, F.lit(11)).cast("double")
    return pages.select("doc_id", F.concat(F.lit("s"), F.col("page_index").cast("string")).alias("span_id"), (F.col("page_index") / 3).cast("int").alias("page_index"), F.lit(1.0).alias("x0"), y.alias("y0"), F.lit(9.0).alias("x1"), (y + 1).alias("y1"), "text")


@query(r"""WITH RECURSIVE o AS (SELECT conv_id AS doc_id, (turn // 3)::INT AS page, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn // 3, (turn * 37) % 11, 's' || turn) AS n FROM conversations WHERE trim(regexp_replace(text, '\s+', ' ', 'g')) <> ''),
    f AS (SELECT doc_id, n, page, t, length(t)::BIGINT AS used, 0::BIGINT AS run FROM o WHERE n = 1
          UNION ALL SELECT o.doc_id, o.n, o.page, o.t, CASE WHEN f.used + 2 + length(o.t) > 1200 THEN length(o.t) ELSE f.used + 2 + length(o.t) END, CASE WHEN f.used + 2 + length(o.t) > 1200 THEN f.run + 1 ELSE f.run END FROM f JOIN o ON o.doc_id = f.doc_id AND o.n = f.n + 1)
    SELECT doc_id, run, md5(trim(regexp_replace(string_agg(t, chr(10) || chr(10) ORDER BY n), '\s+', ' ', 'g'))) AS run_text, min(page) AS page_start, max(page) AS page_end FROM f GROUP BY doc_id, run""")
def layout_runs(spark, sf_dir):
    return chunking.layout_runs(spans_of(spark, sf_dir)).select("doc_id", "run", F.md5("text").alias("run_text"), "page_start", "page_end")


@query("SELECT conv_id AS doc_id, 's' || turn AS span_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn // 3, (turn * 37) % 11, 's' || turn) AS reading_no FROM conversations")
def reading_order(spark, sf_dir):
    return layout.reading_order(spans_of(spark, sf_dir)).select("doc_id", "span_id", "reading_no")


# --- boxes made of events ---


def boxes(spark, sf_dir) -> DataFrame:
    e = F.col("event_id")
    y = F.pmod(e * 131, F.lit(997)).cast("double")
    return table(spark, sf_dir, "events").select((e / 100).cast("long").alias("doc_id"), e, F.pmod(e, F.lit(3)).cast("int").alias("page_index"), F.pmod(e * 17, F.lit(50)).cast("double").alias("x0"), y.alias("y0"), (F.pmod(e * 17, F.lit(50)) + 30).cast("double").alias("x1"), (y + F.pmod(e, F.lit(23))).alias("y1"), F.concat(F.lit("s"), e.cast("string")).alias("span_id"), e.alias("span_pos"), "event_type")


BOXES = "b AS (SELECT event_id // 100 AS doc_id, event_id, (event_id % 3)::INT AS page_index, ((event_id * 17) % 50)::DOUBLE AS x0, ((event_id * 131) % 997)::DOUBLE AS y0, ((event_id * 17) % 50 + 30)::DOUBLE AS x1, ((event_id * 131) % 997 + event_id % 23)::DOUBLE AS y1, 's' || event_id AS span_id, event_id AS span_pos, event_type FROM events)"
NEAR = f"""{BOXES}, a AS (SELECT doc_id, event_id AS anchor_id, page_index, y0, y1 FROM b WHERE event_id % 10 = 0), s AS (SELECT * FROM b WHERE event_id % 10 <> 0),
    p AS (SELECT a.doc_id, a.anchor_id, s.span_id, s.span_pos, a.y0 - s.y1 AS up, s.y0 - a.y1 AS down FROM a LEFT JOIN s ON a.doc_id = s.doc_id AND a.page_index = s.page_index),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, anchor_id ORDER BY CASE WHEN up >= -2 THEN up END NULLS LAST, span_pos) AS nu, row_number() OVER (PARTITION BY doc_id, anchor_id ORDER BY CASE WHEN down >= -2 THEN down END NULLS LAST, span_pos) AS nd FROM p),
    n AS (SELECT doc_id, anchor_id, max(span_id) FILTER (nu = 1 AND up >= -2) AS above_id, max(span_id) FILTER (nd = 1 AND down >= -2) AS below_id FROM r GROUP BY doc_id, anchor_id)"""


def neighbors_of(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    b = boxes(spark, sf_dir)
    spans = b.where("event_id % 10 <> 0")
    return layout.nearest_neighbors(b.where("event_id % 10 = 0").withColumnRenamed("event_id", "anchor_id"), spans), spans


@query(f"WITH {NEAR} SELECT doc_id, anchor_id, above_id, below_id FROM n")
def nearest_neighbors(spark, sf_dir):
    return neighbors_of(spark, sf_dir)[0].select("doc_id", "anchor_id", "above_id", "below_id")


@query(f"WITH {NEAR}, t AS (SELECT span_id, repeat(event_type || ' ' || event_id || ' ', 40) AS t FROM b), c AS (SELECT span_id, CASE WHEN length(trim(t)) > 400 THEN substr(trim(t), 1, 385) || '...[truncated]' ELSE trim(t) END AS t FROM t) SELECT anchor_id, u.t AS above, d.t AS below FROM n LEFT JOIN c u ON above_id = u.span_id LEFT JOIN c d ON below_id = d.span_id")
def neighbor_snippets(spark, sf_dir):
    near, spans = neighbors_of(spark, sf_dir)
    texts = spans.withColumn("text", F.repeat(F.concat("event_type", F.lit(" "), F.col("event_id").cast("string"), F.lit(" ")), 40))
    return layout.neighbor_snippets(near, texts).select("anchor_id", F.col("contextual_snippet_above").alias("above"), F.col("contextual_snippet_below").alias("below"))


@query(f"WITH {BOXES}, o AS (SELECT doc_id, page_index, arg_min(span_id, (y0, x0, span_id)) AS first_id, arg_max(span_id, (y0, x0, span_id)) AS last_id, count(*) AS n FROM b WHERE event_id % 10 <> 0 GROUP BY doc_id, page_index) SELECT event_id AS anchor_id, first_id AS above_id, CASE WHEN n > 1 THEN last_id END AS below_id FROM b LEFT JOIN o USING (doc_id, page_index) WHERE event_id % 10 = 0")
def page_fallback(spark, sf_dir):
    b = boxes(spark, sf_dir)
    anchors = b.where("event_id % 10 = 0").select("doc_id", F.col("event_id").alias("anchor_id"), "page_index", F.lit(None).cast("double").alias("y0"), F.lit(None).cast("double").alias("y1"))
    spans = b.where("event_id % 10 <> 0")
    return layout.with_page_fallback(anchors, spans, layout.nearest_neighbors(anchors, spans)).select("anchor_id", "above_id", "below_id")


GRID = """g AS (SELECT event_id // 100 AS doc_id, ((event_id // 20) % 5)::INT AS page_index, 's' || event_id AS span_id, event_type AS text, (event_id % 20) // 4 AS r, event_id % 4 AS c, event_id // 20 AS page_no, event_id FROM events WHERE event_id % 11 <> 0),
    b AS (SELECT doc_id, page_index, span_id, text, CASE WHEN r = 2 AND page_no % 3 = 0 THEN 0 ELSE c * 60 + (event_id * 17) % 7 END::DOUBLE AS x0, CASE WHEN r = 2 AND page_no % 3 = 0 THEN 250 WHEN r = 0 AND c = 1 AND page_no % 4 = 0 THEN 170 ELSE c * 60 + (event_id * 17) % 7 + 30 END::DOUBLE AS x1, (r * 20 + (event_id * 13) % 3 + CASE WHEN r > 3 AND page_no % 5 = 0 THEN 90 ELSE 0 END)::DOUBLE AS y0, (r * 20 + (event_id * 13) % 3 + 12 + CASE WHEN r > 3 AND page_no % 5 = 0 THEN 90 ELSE 0 END)::DOUBLE AS y1 FROM g)"""


def grid(spark, sf_dir) -> DataFrame:
    """Events as words in a grid on pages: some are missing, some rows are one wide line, some heads span columns, some rows
    stand far below."""
    e = F.col("event_id")
    r, c, page = F.floor((e % 20) / 4), e % 4, F.floor(e / 20)
    x = (c * 60 + (e * 17) % 7).cast("double")
    wide = (r == 2) & (page % 3 == 0)
    y = (r * 20 + (e * 13) % 3 + F.when((r > 3) & (page % 5 == 0), 90).otherwise(0)).cast("double")
    return table(spark, sf_dir, "events").where(e % 11 != 0).select(
        F.floor(e / 100).alias("doc_id"), (page % 5).cast("int").alias("page_index"), F.concat(F.lit("s"), e.cast("string")).alias("span_id"), F.col("event_type").alias("text"),
        F.when(wide, 0.0).otherwise(x).alias("x0"), F.when(wide, 250.0).when((r == 0) & (c == 1) & (page % 4 == 0), 170.0).otherwise(x + 30).alias("x1"), y.alias("y0"), (y + 12).alias("y1"),
    )


@query(f"""WITH {GRID}, a AS (SELECT *, CASE WHEN y0 + 3 < max(y1 - 3) OVER (PARTITION BY doc_id, page_index ORDER BY y0 + 3, y1 - 3, span_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM b),
    rw AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page_index ORDER BY y0 + 3, y1 - 3, span_id) - 1 AS row_no FROM a),
    ca AS (SELECT *, CASE WHEN x0 < 6 + max(x1) OVER (PARTITION BY doc_id, page_index, row_no ORDER BY x0, x1, span_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM rw),
    ce AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, page_index, row_no ORDER BY x0, x1, span_id) - 1 AS cell_no FROM ca),
    rs AS (SELECT doc_id, page_index, row_no, max(cell_no) + 1 AS cells, min(y0) AS top, max(y1) AS bottom FROM ce GROUP BY ALL HAVING max(cell_no) >= 1),
    rn AS (SELECT *, CASE WHEN lag(row_no) OVER w = row_no - 1 AND top - lag(bottom) OVER w <= 2 * (bottom - top) THEN 0 ELSE 1 END AS new FROM rs WINDOW w AS (PARTITION BY doc_id, page_index ORDER BY row_no)),
    tn AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page_index ORDER BY row_no) - 1 AS table_no FROM rn),
    tb AS (SELECT *, max(cells) OVER t AS most FROM tn WINDOW t AS (PARTITION BY doc_id, page_index, table_no) QUALIFY count(*) OVER t >= 2),
    cl AS (SELECT ce.doc_id, ce.page_index, table_no, ce.row_no, cell_no, span_id, text, x0, x1, y0, cells = most AS whole FROM ce JOIN tb ON ce.doc_id = tb.doc_id AND ce.page_index = tb.page_index AND ce.row_no = tb.row_no),
    pa AS (SELECT *, CASE WHEN x0 < max(x1) OVER (PARTITION BY doc_id, page_index, table_no ORDER BY x0, x1, span_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS step FROM cl WHERE whole),
    pn AS (SELECT *, sum(step) OVER (PARTITION BY doc_id, page_index, table_no ORDER BY x0, x1, span_id) - 1 AS column_no FROM pa),
    cs AS (SELECT doc_id, page_index, table_no, column_no, min(x0) AS lo, max(x1) AS hi FROM pn GROUP BY doc_id, page_index, table_no, column_no),
    co AS (SELECT * FROM cs QUALIFY count(*) OVER (PARTITION BY doc_id, page_index, table_no) >= 2),
    jo AS (SELECT cl.*, column_no FROM cl JOIN co ON cl.doc_id = co.doc_id AND cl.page_index = co.page_index AND cl.table_no = co.table_no QUALIFY row_number() OVER (PARTITION BY cl.doc_id, cl.page_index, cl.table_no, row_no, cell_no, span_id ORDER BY least(x1, hi) - greatest(x0, lo) DESC, column_no) = 1)
    SELECT doc_id, page_index, 'stream-p' || page_index || '-' || table_no AS table_id, (row_no - min(row_no) OVER (PARTITION BY doc_id, page_index, table_no))::BIGINT AS row_no, column_no::BIGINT AS column_no, text
    FROM (SELECT doc_id, page_index, table_no, row_no, column_no, string_agg(text, ' ' ORDER BY x0, y0, span_id) AS text FROM jo GROUP BY doc_id, page_index, table_no, row_no, column_no)""")
def stream_tables(spark, sf_dir):
    """The texts of all tables' cells, put into whole tables and taken out again."""
    found = tables.stream_tables(grid(spark, sf_dir))
    cells = found.select("doc_id", "page_index", "table_id", F.posexplode("rows").alias("row_no", "row")).select("doc_id", "page_index", "table_id", "row_no", F.posexplode("row").alias("column_no", "text"))
    return cells.where("text <> ''").select("doc_id", "page_index", "table_id", F.col("row_no").cast("long").alias("row_no"), F.col("column_no").cast("long").alias("column_no"), "text")


@query(f"WITH {BOXES}, i AS (SELECT doc_id, page_index, event_id % 5 AS xref, (event_id % 2)::DOUBLE AS x0, (event_id % 4)::DOUBLE AS y0, event_id FROM b) SELECT doc_id, page_index, xref, x0, y0, min(event_id) AS event_id FROM i GROUP BY ALL")
def distinct_images(spark, sf_dir):
    e = F.col("event_id")
    images = boxes(spark, sf_dir).select("doc_id", "page_index", F.pmod(e, F.lit(5)).alias("xref"), F.pmod(e, F.lit(2)).cast("double").alias("x0"), F.pmod(e, F.lit(4)).cast("double").alias("y0"), F.lit(1.0).alias("x1"), F.lit(1.0).alias("y1"), e, e.alias("image_pos"))
    return layout.distinct_images(images).select("doc_id", "page_index", "xref", "x0", "y0", "event_id")


@query(f"WITH {BOXES} SELECT doc_id, page_index, event_type AS cells, arg_min(event_id, (event_id % 2, event_id)) AS event_id FROM b GROUP BY ALL")
def distinct_tables(spark, sf_dir):
    e = F.col("event_id")
    tables = boxes(spark, sf_dir).withColumn("rows", F.array(F.array("event_type"))).withColumn("flavor_rank", F.pmod(e, F.lit(2))).withColumn("table_pos", e)
    return layout.distinct_tables(tables).select("doc_id", "page_index", F.col("event_type").alias("cells"), "event_id")


# --- sparse and dense legs ---


def asked(spark, sf_dir) -> DataFrame:
    """The benchmark's items as questions."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query"))


ASKED = "asked AS (SELECT item_id::VARCHAR AS query_id, text AS query FROM benchmark)"
TERMS = f"""{CHUNKS}, words AS (SELECT chunk_pos, unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS term FROM chunks), terms AS MATERIALIZED (SELECT chunk_pos, term, count(*) AS tf FROM words GROUP BY ALL),
    lens AS MATERIALIZED (SELECT chunk_pos, len(regexp_extract_all(lower(text), '{TOKEN}')) AS dl FROM chunks), stats AS MATERIALIZED (SELECT count(*) AS n, sum(dl) / count(*) AS avgdl FROM lens),
    raws AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM terms GROUP BY term), stats), mean AS MATERIALIZED (SELECT avg(raw) AS mean FROM raws),
    idfs AS MATERIALIZED (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END AS idf FROM raws, mean)"""
SPARSE = f"""{TERMS}, qterms AS (SELECT query_id, unnest(regexp_extract_all(lower(query), '{TOKEN}')) AS term FROM asked),
    part AS (SELECT query_id, terms.chunk_pos, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM qterms JOIN terms USING (term) JOIN idfs USING (term) JOIN lens ON lens.chunk_pos = terms.chunk_pos, stats GROUP BY query_id, terms.chunk_pos),
    bm AS (SELECT asked.query_id, chunks.chunk_pos, coalesce(round(score, 9), 0.0) AS score FROM asked CROSS JOIN chunks LEFT JOIN part ON part.query_id = asked.query_id AND part.chunk_pos = chunks.chunk_pos),
    sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_pos) AS rank FROM bm QUALIFY rank <= 24)"""


@dataclass(frozen=True)
class Corpus:
    """Chunks, the index of their terms and their stand-in vectors."""

    chunks: DataFrame
    terms: sparse.TermIndex
    vectors: DataFrame


_corpora: dict[tuple[str, str], tuple[str, Corpus]] = {}


def indexed(spark, sf_dir) -> Corpus:
    """Made once for each session and state of the table."""
    session, key = (spark.sparkContext.applicationId, sf_dir), index.freshness_key(spark, f"{sf_dir}/documents.parquet")
    if (held := _corpora.get(session)) and held[0] == key:
        return held[1]
    chunks, path = chunk_rows(documents(spark, sf_dir)), scratch(spark, "terms")
    terms = sparse.term_index(chunks, path)
    dense.block_vectors(terms).write.parquet(f"{path}/vectors")
    made = Corpus(chunks, terms, spark.read.parquet(f"{path}/vectors"))
    _corpora.clear()
    _corpora[session] = (key, made)
    return made


@query(f"WITH {TERMS} SELECT term, df, round(idf, 6) AS idf FROM idfs")
def term_stats(spark, sf_dir):
    return sparse.term_stats(indexed(spark, sf_dir).terms).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {ASKED}, {SPARSE} SELECT query_id, rank, chunk_pos, round(score, 6) AS score FROM sparse")
def bm25_topk(spark, sf_dir):
    got = sparse.sparse_topk(asked(spark, sf_dir), indexed(spark, sf_dir).terms, 24)
    return got.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_pos", F.round("score", 6).alias("score"))


def scaled(spark, sf_dir) -> DataFrame:
    """Vectors of three lengths, so that distance and cosine order them differently."""
    factor = (1 + F.pmod("vec_id", F.lit(3))).cast("double")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_pos"), F.transform(F.col("embedding").cast("array<double>"), lambda x: x * factor).alias("embedding"), "label")


SCALED = "scaled AS (SELECT vec_id AS chunk_pos, list_transform(embedding::DOUBLE[], lambda x: x * (1 + vec_id % 3)) AS embedding, label FROM embeddings)"


def questions_of(vecs: DataFrame) -> list[tuple[str, list[float]]]:
    """The stated set of queries: every vector whose id is divisible by 100."""
    return [(str(r.chunk_pos), list(r.embedding)) for r in vecs.where("chunk_pos % 100 = 0").orderBy("chunk_pos").collect()]


def nearest(spark, sf_dir, k: int, metric: str) -> DataFrame:
    vecs = scaled(spark, sf_dir)
    got = dense.batch_topk(vecs.select("chunk_pos", "embedding"), questions_of(vecs), k, metric)
    return got.select("query_id", "chunk_pos", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


ASKING = "(SELECT chunk_pos, embedding FROM scaled WHERE chunk_pos % 100 = 0) q"


@query(f"WITH {SCALED}, s AS (SELECT q.chunk_pos AS query_id, s.chunk_pos, round(list_sum(list_transform(list_zip(s.embedding, q.embedding), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 9) AS score FROM scaled s, {ASKING}) SELECT query_id::VARCHAR AS query_id, chunk_pos, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_pos) AS rank FROM s QUALIFY rank <= 24")
def dense_l2_topk(spark, sf_dir):
    return nearest(spark, sf_dir, 24, "l2")


@query(f"WITH {SCALED}, s AS (SELECT q.chunk_pos AS query_id, s.chunk_pos, round(list_dot_product(s.embedding, q.embedding) / (sqrt(list_dot_product(s.embedding, s.embedding)) * sqrt(list_dot_product(q.embedding, q.embedding))), 9) AS score FROM scaled s, {ASKING}) SELECT query_id::VARCHAR AS query_id, chunk_pos, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_pos) AS rank FROM s QUALIFY rank <= 10")
def dense_cosine_topk(spark, sf_dir):
    return nearest(spark, sf_dir, 10, "cosine")


def by_cells(spark, sf_dir, k: int, metric: str) -> DataFrame:
    vecs = scaled(spark, sf_dir)
    made = cells.build(vecs.select("chunk_pos", "embedding"), scratch(spark, "cells"), metric)
    got = cells.nearest(made, questions_of(vecs), k)
    return got.select("query_id", "chunk_pos", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(ORACLE_SQL["dense_l2_topk"])
def cells_l2_topk(spark, sf_dir):
    """The same vectors as by the scan, from the cells that can hold them."""
    return by_cells(spark, sf_dir, 24, "l2")


@query(ORACLE_SQL["dense_cosine_topk"])
def cells_cosine_topk(spark, sf_dir):
    return by_cells(spark, sf_dir, 10, "cosine")


def unscaled(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_pos"), F.col("embedding").cast("array<double>").alias("embedding"), "label")


def slots_sql(candidates: str) -> str:
    """query_id, vec_id, maxsim over pairs with the vectors qv and ev: cosines of slots of eight, the best of each, summed."""
    part = lambda v, i: f"{v}[8*{i}+1:8*{i}+8]"
    a, b = part("qv", "i"), part("ev", "j")
    cos = f"list_dot_product({a}, {b}) / (greatest(sqrt(list_dot_product({a}, {a})), 1e-12) * greatest(sqrt(list_dot_product({b}, {b})), 1e-12))"
    return f"x AS (SELECT query_id, vec_id, i, max({cos}) AS m FROM {candidates}, range(8) a(i), range(8) b(j) GROUP BY query_id, vec_id, i), ms AS (SELECT query_id, vec_id, sum(m) AS maxsim FROM x GROUP BY query_id, vec_id)"


@query(f"WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT q.vec_id AS query_id, e.vec_id, q.v AS qv, e.v AS ev FROM e, e q WHERE q.vec_id % 100 = 0), {slots_sql('p')} SELECT query_id::VARCHAR AS query_id, vec_id, round(maxsim, 6) AS maxsim FROM ms")
def maxsim(spark, sf_dir):
    """The stated queries against all vectors, in tiles of both."""
    vecs = unscaled(spark, sf_dir)
    queries = vecs.where("chunk_pos % 100 = 0").select(F.col("chunk_pos").alias("query_id"), "embedding")
    got = dense.maxsim_pairs(vecs.select("chunk_pos", "embedding"), queries, 8)
    return got.select("query_id", F.col("chunk_pos").alias("vec_id"), F.round("maxsim", 6).alias("maxsim"))


@query(f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings), c AS (SELECT q.vec_id AS query_id, e.vec_id, q.v AS qv, e.v AS ev, round(list_cosine_similarity(e.v, q.v), 9) AS score FROM e, e q WHERE q.vec_id % 100 = 0 AND e.label = 3),
    p AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id::VARCHAR) <= 96), {slots_sql('p')},
    s AS (SELECT ms.query_id, ms.vec_id, round(maxsim, 9) AS maxsim, score FROM ms JOIN p ON p.query_id = ms.query_id AND p.vec_id = ms.vec_id)
    SELECT query_id::VARCHAR AS query_id, vec_id, round(maxsim, 6) AS maxsim, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s.maxsim DESC, s.score DESC, vec_id::VARCHAR) AS rank FROM s QUALIFY rank <= 6""")
def visual_retrieval(spark, sf_dir):
    """The payload filter stands below the cut, then the coarse list, then late interaction."""
    vecs = unscaled(spark, sf_dir)
    patches = vecs.select(F.col("chunk_pos").cast("string").alias("patch_id"), "embedding", F.col("label").cast("string").alias("pdf_sha256"))
    top = corpus.retrieve_patches_batch(patches, questions_of(vecs), Settings(), "3")
    return top.select("query_id", F.col("patch_id").cast("long").alias("vec_id"), F.round("maxsim", 6).alias("maxsim"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


# --- fusion and the whole retrieval ---


DENSE = f"""dw AS (SELECT chunk_pos, ('0x' || left(md5(term), 8))::BIGINT % 64 AS bucket, sum(tf) AS tf FROM terms GROUP BY ALL), qw AS (SELECT query_id, ('0x' || left(md5(term), 8))::BIGINT % 64 AS bucket, count(*) AS qtf FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '{TOKEN}')) AS term FROM asked) GROUP BY ALL),
    dn AS (SELECT chunk_pos, sqrt(sum(tf * tf)) AS norm FROM dw GROUP BY chunk_pos), qn AS (SELECT query_id, sqrt(sum(qtf * qtf)) AS qnorm FROM qw GROUP BY query_id),
    hc AS (SELECT query_id, chunk_pos, round(sum(tf * qtf) / (any_value(norm) * any_value(qnorm)), 9) AS score FROM dw JOIN qw USING (bucket) JOIN dn USING (chunk_pos) JOIN qn USING (query_id) GROUP BY query_id, chunk_pos),
    dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_pos) AS rank FROM hc QUALIFY rank <= 24)"""
FUSED = f"""{SPARSE}, {DENSE}, legs AS (SELECT query_id, chunk_pos, 1.0 / (60 + rank) AS share, rank AS seen FROM dense UNION ALL SELECT query_id, chunk_pos, 1.0 / (60 + rank), 1000000 + rank FROM sparse),
    summed AS (SELECT query_id, chunk_pos, round(sum(share::DOUBLE), 12) AS rrf, min(seen) AS first_seen FROM legs GROUP BY query_id, chunk_pos), fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, first_seen) AS rank FROM summed)"""


def legs_of(spark, sf_dir):
    held, queries = indexed(spark, sf_dir), asked(spark, sf_dir)
    return held.chunks, queries, held.terms, dense.hashed_topk(held.vectors, queries, 24)


@query(f"WITH {ASKED}, {FUSED} SELECT query_id, chunk_pos, round(rrf, 9) AS rrf, rank FROM fused")
def rrf_hybrid(spark, sf_dir):
    _, queries, terms, left = legs_of(spark, sf_dir)
    got = fusion.fuse([left, sparse.sparse_topk(queries, terms, 24)], key="chunk_pos")
    return got.select("query_id", "chunk_pos", F.round("rrf", 9).alias("rrf"), F.col("fused_rank").cast("long").alias("rank"))


FILTER = """flagged AS (SELECT d.query_id, d.chunk_pos, d.rank, c.page_end >= 5 * d.query_id::INT AND c.page_start <= 5 * d.query_id::INT + {wide} AS ok FROM dense d JOIN chunks c USING (chunk_pos)),
    kept AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY query_id) AS passed FROM flagged) SELECT query_id, chunk_pos, rank, passed > 0 AS filtered, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM kept WHERE ok OR passed = 0 QUALIFY n <= 5"""


@query(f"WITH {ASKED}, {TERMS}, {DENSE}, {FILTER.format(wide=0)}")
def page_filter_fallback(spark, sf_dir):
    chunks, queries, _, found = legs_of(spark, sf_dir)
    lo = 5 * F.col("query_id").cast("int")
    kept = fusion.filter_or_all(found.join(chunks, "chunk_pos"), fusion.overlaps(lo, lo), 5)
    return kept.select("query_id", "chunk_pos", F.col("rank").cast("long").alias("rank"), "filtered", F.row_number().over(W.partitionBy("query_id").orderBy("rank")).cast("long").alias("n"))


@query("SELECT item_id, CASE WHEN a <= b THEN a END AS lo, CASE WHEN a <= b THEN b END AS hi FROM (SELECT item_id, greatest(item_id % 9, 4) AS a, least(item_id % 9 + 3, CASE WHEN item_id % 2 = 0 THEN 5 ELSE 1000000000 END) AS b FROM benchmark)")
def page_windows(spark, sf_dir):
    """Disjoint windows are no filter."""
    n = F.pmod("item_id", F.lit(9))
    hi = F.when(F.col("item_id") % 2 == 0, F.lit(5))
    return table(spark, sf_dir, "benchmark").select("item_id", fusion.intersect_columns(n, n + 3, F.lit(4), hi).alias("w")).select("item_id", F.col("w.lo").cast("long").alias("lo"), F.col("w.hi").cast("long").alias("hi"))


BONUS = f"""bonus AS (SELECT q.query_id, c.chunk_pos, CASE WHEN contains(lower(q.query), 'figure') AND contains(c.content_type, 'figure') THEN 1.5 ELSE 0 END + CASE WHEN regexp_matches(lower(q.query), 'chart|graph|diagram|plot|visual|image') AND (contains(c.content_type, 'figure') OR contains(c.content_type, 'visual') OR c.chunk_kind = 'pdf_image') THEN 1.35 ELSE 0 END
    + CASE WHEN contains(lower(q.query), 'table') AND contains(c.content_type, 'table') THEN 1.5 ELSE 0 END + 0.25 * len(list_filter(list_distinct(regexp_extract_all(lower(q.query), '{TOKEN}')), lambda t: length(t) > 3 AND contains(lower(c.section_hint), t))) AS bonus FROM q2 q, chunks c)"""
Q2 = "q2 AS (SELECT query_id, query || CASE query_id::INT % 3 WHEN 0 THEN ' figure chart' WHEN 1 THEN ' table' ELSE ' image' END AS query FROM asked)"


def with_cue(queries: DataFrame) -> DataFrame:
    n = F.pmod(F.col("query_id").cast("int"), F.lit(3))
    return queries.withColumn("query", F.concat("query", F.when(n == 0, " figure chart").when(n == 1, " table").otherwise(" image")))


@query(f"WITH {ASKED}, {TERMS}, {DENSE}, {Q2}, {BONUS} SELECT d.query_id, d.chunk_pos, round(bonus, 6)::DOUBLE AS bonus, row_number() OVER (PARTITION BY d.query_id ORDER BY bonus DESC, d.rank) AS rank FROM dense d JOIN bonus b ON b.query_id = d.query_id AND b.chunk_pos = d.chunk_pos")
def metadata_boost(spark, sf_dir):
    chunks, queries, _, found = legs_of(spark, sf_dir)
    hits = found.join(chunks, "chunk_pos").join(with_cue(queries), "query_id")
    return rerank.metadata_rerank(hits).select("query_id", "chunk_pos", F.round("bonus", 6).alias("bonus"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH a0 AS (SELECT item_id::VARCHAR AS query_id, text || CASE item_id % 3 WHEN 0 THEN ' figure chart' WHEN 1 THEN ' table' ELSE ' image' END AS query FROM benchmark), asked AS (SELECT query_id, query FROM a0), q2 AS (SELECT * FROM asked), {FUSED}, {BONUS},
    flagged AS (SELECT f.*, page_start <= 12 AND page_end >= 3 AS ok FROM fused f JOIN chunks c USING (chunk_pos)), k AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY query_id) AS passed FROM flagged),
    cut AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM k WHERE query_id::INT % 2 = 1 OR ok OR passed = 0 QUALIFY n <= 24)
    SELECT c.query_id, c.chunk_pos, round(rrf, 9) AS score, round(bonus, 6)::DOUBLE AS bonus, row_number() OVER (PARTITION BY c.query_id ORDER BY bonus DESC, c.rank) AS rank FROM cut c JOIN bonus b ON b.query_id = c.query_id AND b.chunk_pos = c.chunk_pos QUALIFY row_number() OVER (PARTITION BY c.query_id ORDER BY bonus DESC, c.rank) <= 5""")
def hybrid_full(spark, sf_dir):
    """Every question, half of them with a page clause, through the whole retrieval as one plan."""
    held, queries, settings = indexed(spark, sf_dir), with_cue(asked(spark, sf_dir)), Settings()
    clause = F.when(F.col("query_id").cast("int") % 2 == 0, F.lit(" on pages 4-13")).otherwise(F.lit(""))
    plain = retrieval.questions(queries.withColumn("query", F.concat("query", clause)), settings)
    hits = retrieval.hybrid(plain, held.chunks, dense.hashed_topk(held.vectors, plain, settings.dense_pool), held.terms, settings)
    return hits.select("query_id", "chunk_pos", F.round("score", 9).alias("score"), F.round("bonus", 6).alias("bonus"), F.col("rank").cast("long").alias("rank"))


@query("WITH a AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank FROM events QUALIFY rank <= 3), b AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rank FROM events QUALIFY rank <= 4), u AS (SELECT *, 1 AS pass FROM a UNION ALL SELECT *, 2 FROM b), o AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY pass, rank) AS n FROM u QUALIFY n = 1) SELECT user_id::VARCHAR AS query_id, event_type AS chunk_id, row_number() OVER (PARTITION BY user_id ORDER BY pass, rank) AS rank FROM o QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY pass, rank) <= 3")
def multi_hop_merge(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("query_id"), F.col("event_type").alias("chunk_id"), "event_id")
    first = retrieval.ranked(events, [F.col("event_id")], 3)
    second = retrieval.ranked(events, [F.desc("event_id")], 4)
    return fusion.merge_passes(first, second, 3).select("query_id", "chunk_id", F.col("merged_rank").cast("long").alias("rank"))


@query("WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), c AS (SELECT vec_id, v FROM e ORDER BY vec_id % 97 DESC, vec_id DESC LIMIT 256), s AS (SELECT e.vec_id AS query_id, c.vec_id AS pos, round(list_cosine_similarity(e.v, c.v), 9) AS similarity FROM e, c) SELECT query_id::VARCHAR AS query_id, 'a' || arg_max(pos, (similarity, -pos)) AS answer, round(max(similarity), 6) AS similarity FROM s GROUP BY query_id HAVING max(similarity) >= 0.5")
def cache_probe(spark, sf_dir):
    """Every vector asks the cache, which holds as many entries as its limit allows."""
    vecs = table(spark, sf_dir, "embeddings")
    entries = vecs.select(F.concat(F.lit("a"), F.col("vec_id").cast("string")).alias("answer"), "embedding", F.col("vec_id").alias("pos"), F.pmod("vec_id", F.lit(97)).cast("double").alias("created_ts"))
    queries = vecs.select(F.col("vec_id").cast("string").alias("query_id"), "embedding")
    return cache.probe(queries, cache.newest(entries, 256), 0.5).select("query_id", "answer", F.round("similarity", 6).alias("similarity"))


@query(ORACLE_SQL["cache_probe"])
def cache_table(spark, sf_dir):
    """The same, from a cache that grew by three additions and was put together."""
    vecs = table(spark, sf_dir, "embeddings")
    entries = vecs.select("vec_id", F.concat(F.lit("a"), F.col("vec_id").cast("string")).alias("answer"), "embedding", F.col("vec_id").alias("pos"), F.pmod("vec_id", F.lit(97)).cast("double").alias("created_ts"))
    store = cache.AnswerCache(scratch(spark, "answers"), 256, segments=2)
    for k in range(3):
        store.append(entries.where(F.col("vec_id") % 3 == k))
    return store.lookups(vecs.select(F.col("vec_id").cast("string").alias("query_id"), "embedding"), 0.5).select("query_id", "answer", F.round("similarity", 6).alias("similarity"))


@query("SELECT event_id, value FROM events QUALIFY row_number() OVER (ORDER BY event_id % 97 DESC, event_id DESC) <= 256")
def cache_evict(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "value", F.pmod("event_id", F.lit(97)).cast("double").alias("created_ts"), F.col("event_id").alias("pos"))
    return cache.newest(rows, 256).select("event_id", "value")


@query("SELECT left(sha256(source || lang), 24) AS chunk_id, max(doc_id) AS doc_id FROM documents GROUP BY 1")
def upsert_keeps_last(spark, sf_dir):
    rows = documents(spark, sf_dir).select(ids.digest(F.col("source"), F.col("lang")).alias("chunk_id"), F.col("doc_id").alias("chunk_pos"))
    return batching.keep_last(rows, "chunk_id", "chunk_pos").select("chunk_id", F.col("chunk_pos").alias("doc_id"))


@query("SELECT 'c' || doc_id % (SELECT count(*) // 2 FROM documents) AS chunk_id, coalesce(max(doc_id) FILTER (doc_id % 3 = 0), max(doc_id)) AS doc_id, CASE WHEN count(*) FILTER (doc_id % 3 = 0) > 0 THEN 'second' ELSE 'first' END AS batch, 2::INT AS dimensions FROM documents GROUP BY 1")
def upsert_buckets(spark, sf_dir):
    """Documents in two batches, two to a point: what the second names replaces what the first gave, whichever comes later."""
    docs, path = documents(spark, sf_dir), scratch(spark, "points")
    half = docs.count() // 2
    rows = docs.select("doc_id", F.concat(F.lit("c"), (F.col("doc_id") % half).cast("string")).alias("chunk_id"), F.col("doc_id").alias("chunk_pos"), F.array(F.col("doc_id").cast("double"), F.lit(1.0)).alias("embedding"))
    points.reset(spark, path, 2)
    points.upsert(rows.where("doc_id % 3 <> 0").withColumn("batch", F.lit("first")), path)
    got = points.upsert(rows.where("doc_id % 3 = 0").withColumn("batch", F.lit("second")), path)
    return got.select("chunk_id", "doc_id", "batch", F.size("embedding").alias("dimensions"))


@query(ORACLE_SQL["term_stats"])
def incremental_terms(spark, sf_dir):
    """A tenth of the documents come later, a tenth change, some go: the index grows by those alone and has the frequencies of one
    made anew."""
    final = chunk_rows(documents(spark, sf_dir)).withColumn("doc_id", F.col("chunk_pos").cast("string"))
    d = F.col("chunk_pos")
    before = final.where(d % 10 != 1).withColumn("text", F.when(d % 10 == 0, F.concat(F.lit("once "), F.reverse("text"))).otherwise(F.col("text")))
    more = final.where(d % 50 == 0).withColumns({"chunk_pos": -1 - d, "doc_id": F.concat(F.lit("gone"), d.cast("string"))})
    grown = segments.SegmentedTerms(spark, scratch(spark, "segments"))
    grown.upsert(before.unionByName(more))
    grown.upsert(final, whole=True)
    return sparse.term_stats(grown.index()).select("term", "df", F.round("idf", 6).alias("idf"))


# --- folds, tables, images, evaluation ---


@query("""WITH RECURSIVE w AS (SELECT source, doc_id, text, unnest(range(0, length(text), 1000)) AS start FROM documents), c AS (SELECT source, doc_id * 1000000 + start // 1000 AS chunk_pos, greatest(1, floor(length(substr(text, start + 1, 1200)) / 2.0)::BIGINT + 1) AS need FROM w),
    o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY chunk_pos) AS n FROM c),
    f AS (SELECT source, chunk_pos, n, need, 1 AS cnt, need AS used, 0::BIGINT AS batch_no FROM o WHERE n = 1 UNION ALL
          SELECT o.source, o.chunk_pos, o.n, o.need, CASE WHEN f.cnt = 12 OR f.used + o.need > 5000 THEN 1 ELSE f.cnt + 1 END, CASE WHEN f.cnt = 12 OR f.used + o.need > 5000 THEN o.need ELSE f.used + o.need END, CASE WHEN f.cnt = 12 OR f.used + o.need > 5000 THEN f.batch_no + 1 ELSE f.batch_no END FROM f JOIN o ON o.source = f.source AND o.n = f.n + 1)
    SELECT source, chunk_pos, need, batch_no FROM f""")
def embed_batches(spark, sf_dir):
    """The windows of all documents, in requests of at most 12 texts and 5,000 tokens."""
    cut = documents(spark, sf_dir).select("source", "doc_id", F.posexplode(text.windows("text", 1200, 200)).alias("n", "w"))
    rows = cut.select("source", (F.col("doc_id") * 1_000_000 + F.col("n")).alias("chunk_pos"), "w.text")
    return folds.embed_batches(rows, 12, 5000, "source", "chunk_pos", span=200_000_000).select("source", "chunk_pos", "need", "batch_no")


PACK = f"""{CHUNKS}, h AS (SELECT chunk_pos % 50 AS query_id, *, row_number() OVER (PARTITION BY chunk_pos % 50 ORDER BY chunk_pos) AS rank FROM chunks),
    b AS (SELECT *, '[' || rank || '] pages ' || page_start || '–' || page_end || ' · ' || content_type || ' · ' || chunk_kind || chr(10) || text AS block FROM h),
    u AS (SELECT *, sum(length(block) + 2) OVER (PARTITION BY query_id ORDER BY rank) - 2 > 12000 AS over FROM b), k AS (SELECT *, bool_or(over) OVER (PARTITION BY query_id ORDER BY rank) AS stop FROM u)"""


def hits_of(spark, sf_dir) -> DataFrame:
    rows = chunk_rows(documents(spark, sf_dir)).withColumn("query_id", F.pmod("chunk_pos", F.lit(50)))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("chunk_pos")))


@query(f"WITH {PACK} SELECT query_id, md5(string_agg(block, chr(10) || chr(10) ORDER BY rank)) AS context, bool_or(chunk_kind = 'pdf_table') AS table_context, bool_or(chunk_kind = 'pdf_image') AS visual_context FROM k WHERE NOT stop GROUP BY query_id")
def context_pack(spark, sf_dir):
    return folds.context_text(folds.packed_context(hits_of(spark, sf_dir))).select("query_id", F.md5("context").alias("context"), "table_context", "visual_context")


@query(f"WITH {PACK} SELECT query_id, md5(string_agg(text, chr(0) ORDER BY rank)) AS texts, count(*) AS n FROM h GROUP BY query_id")
def retrieved_texts(spark, sf_dir):
    got = folds.hit_texts(hits_of(spark, sf_dir))
    return got.select("query_id", F.md5(F.array_join("retrieved_contexts", "\0")).alias("texts"), F.size("retrieved_contexts").cast("long").alias("n"))


@query("SELECT n_regionkey AS region, '| ' || n_regionkey || ' | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || trim(n_name) || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation GROUP BY n_regionkey")
def table_markdown(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("r"))
    cells = F.concat(F.array(F.array(F.col("n_regionkey").cast("string"), F.lit("name"))), F.transform("r", lambda x: F.array(x["n_nationkey"].cast("string"), x["n_name"])))
    return rows.select(F.col("n_regionkey").alias("region"), structured.rows_markdown(cells).alias("markdown"))


@query("SELECT n_regionkey AS region, 'Year,Year.1,' || chr(10) || string_agg(n_nationkey || ',\"' || n_name || ', x\",' || n_regionkey, chr(10) ORDER BY n_nationkey) || chr(10) AS csv FROM nation GROUP BY n_regionkey")
def table_exports(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("r"))
    cells = F.concat(F.array(F.array(F.lit("Year"), F.lit("Year"), F.lit(""))), F.transform("r", lambda x: F.array(x["n_nationkey"].cast("string"), F.concat(x["n_name"], F.lit(", x")), F.col("n_regionkey").cast("string"))))
    return structured.table_exports(rows.withColumn("rows", cells)).select(F.col("n_regionkey").alias("region"), F.col("as_csv").alias("csv"))


def table_blocks(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "nation")
    return rows.select(F.col("n_regionkey").cast("string").alias("doc_id"), F.col("n_nationkey").cast("int").alias("n"), F.concat(F.lit("t"), F.col("n_nationkey").cast("string")).alias("table_id"), F.pmod("n_nationkey", F.lit(4)).cast("int").alias("page_index"), F.lit("sha").alias("pdf_sha256"), F.lit("a.pdf").alias("source"), F.lit("pymupdf").alias("extractor"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("| "), "n_name", F.lit(" |"))).alias("as_markdown"), F.when(F.col("n_nationkey") % 3 != 1, F.col("n_name")).alias("as_csv"), F.lit(None).cast("array<array<string>>").alias("rows"), F.when(F.col("n_nationkey") % 5 == 0, F.lit("Sum\nup")).alias("summary"), F.when(F.col("n_nationkey") % 4 == 0, F.lit(" near ")).alias("contextual_snippet_above"))


@query("""WITH t AS (SELECT *, coalesce(CASE WHEN n_nationkey % 2 = 0 THEN '| ' || n_name || ' |' END, CASE WHEN n_nationkey % 3 <> 1 THEN n_name END, '') AS body FROM nation)
    SELECT n_nationkey, left(sha256('sha' || chr(0) || 't' || n_nationkey || chr(0) || n_nationkey % 4), 24) AS chunk_id, 'TABLE · page ' || (n_nationkey % 4 + 1) || ' · pymupdf' || chr(10) || 'table_id=t' || n_nationkey || CASE WHEN n_nationkey % 5 = 0 THEN chr(10) || 'Summary: Sum' || chr(10) || 'up' ELSE '' END || CASE WHEN n_nationkey % 4 = 0 THEN chr(10) || 'Nearby text (above): near' ELSE '' END || chr(10) || chr(10) || body AS text, CASE WHEN n_nationkey % 5 = 0 THEN 'Sum' ELSE 'page ' || (n_nationkey % 4 + 1) END AS section_hint FROM t WHERE body <> ''""")
def table_chunks(spark, sf_dir):
    return structured.table_chunks(table_blocks(spark, sf_dir)).select(F.col("n").cast("long").alias("n_nationkey"), "chunk_id", "text", "section_hint")


@query("SELECT row_number() OVER (ORDER BY kind_no, doc_id, n) - 1 AS chunk_pos, doc_id, n, kind_no FROM (SELECT 0 AS kind_no, conv_id::VARCHAR AS doc_id, turn AS n FROM conversations UNION ALL SELECT 1, n_regionkey::VARCHAR, n_nationkey FROM nation WHERE NOT (n_nationkey % 2 = 1 AND n_nationkey % 3 = 1))")
def chunk_union(spark, sf_dir):
    narrative = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").cast("int").alias("n"), "text", F.lit("narrative").alias("chunk_kind"))
    tables = structured.table_chunks(table_blocks(spark, sf_dir)).select("doc_id", "n", "text", "chunk_kind")
    return chunking.union_chunks(narrative, tables).select("chunk_pos", "doc_id", F.col("n").cast("long").alias("n"), F.when(F.col("chunk_kind") == "pdf_table", 1).otherwise(0).alias("kind_no"))


FIGURES = "(SELECT doc_id, ['see Figure 3: x', 'fig. 12', 'figure12 here', 'prefigure 3', 'fig: 3', 'Fig 4 and', 'figures: a 5', 'no cue'][(doc_id % 8)::INT + 1] AS cue FROM documents)"


def figures(spark, sf_dir) -> DataFrame:
    cues = ["see Figure 3: x", "fig. 12", "figure12 here", "prefigure 3", "fig: 3", "Fig 4 and", "figures: a 5", "no cue"]
    return documents(spark, sf_dir).select("doc_id", F.element_at(F.array(*(F.lit(c) for c in cues)), (F.pmod("doc_id", F.lit(8)) + 1).cast("int")).alias("cue"))


@query(rf"SELECT doc_id, regexp_matches(lower(cue), '(^|[^\p{{L}}\p{{N}}])(?:(?:figures?[ :.]|fig[. ])[ \t\r\n:.\-]{{0,23}}\p{{Nd}}|(?:figures?|fig)\p{{Nd}})') AS cued FROM {FIGURES}")
def figure_gate(spark, sf_dir):
    return figures(spark, sf_dir).select("doc_id", text.has_figure_cue("cue").alias("cued"))


@query(f"SELECT doc_id, (doc_id % 130) * (doc_id % 90) AS area FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN cue END AS caption, CASE WHEN doc_id % 5 = 0 THEN cue END AS above FROM {FIGURES}) WHERE (caption IS NOT NULL OR above IS NOT NULL) AND ((doc_id % 130) * (doc_id % 90) >= 2000 OR caption IS NOT NULL)")
def image_gate(spark, sf_dir):
    d = F.col("doc_id")
    images = figures(spark, sf_dir).select(d, F.when(d % 3 == 0, F.col("cue")).alias("caption"), F.when(d % 5 == 0, F.col("cue")).alias("contextual_snippet_above"), F.lit(" ").alias("contextual_snippet_below"), F.lit(0).alias("width_px"), F.lit(None).cast("int").alias("height_px"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), (d % 130).cast("double").alias("x1"), (d % 90).cast("double").alias("y1"))
    return structured.indexed_images(images, 2000).select("doc_id", structured.image_area().alias("area"))


@query("SELECT doc_id, 'FIGURE · page ' || (doc_id % 9 + 1) || ' · xref ' || doc_id || ' · image' || chr(10) || chr(10) || 'Approximate size: 100×' || (doc_id % 200 + 90) || 'px (area ≈ ' || 100 * (doc_id % 200 + 90) || ')' || CASE WHEN doc_id % 3 = 0 THEN chr(10) || chr(10) || 'Visual description (model: unknown):' || chr(10) || source ELSE '' END || chr(10) || chr(10) || 'Nearby document text (above figure): ' || lang AS text, left(sha256('sha' || chr(0) || 'img' || chr(0) || doc_id || chr(0) || doc_id % 9), 24) AS chunk_id FROM documents")
def image_chunks(spark, sf_dir):
    d = F.col("doc_id")
    images = documents(spark, sf_dir).select(d, d.alias("n"), d.alias("xref"), (d % 9).cast("int").alias("page_index"), F.lit("sha").alias("pdf_sha256"), "source", F.lit(None).cast("string").alias("mime_type"), F.lit(None).cast("string").alias("caption_model"), F.when(d % 3 == 0, F.col("source")).alias("caption"), F.col("lang").alias("contextual_snippet_above"), F.lit(None).cast("string").alias("contextual_snippet_below"), F.lit(100).alias("width_px"), (d % 200 + 90).cast("int").alias("height_px"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"))
    return structured.image_chunks(images, 8192).select("doc_id", "text", "chunk_id")


def scores_of(spark, sf_dir) -> DataFrame:
    """Scores by document; some are NaN, some types null."""
    rows = table(spark, sf_dir, "labels").join(documents(spark, sf_dir).select("doc_id", "lang"), "doc_id")
    value = F.when(F.col("doc_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("quality") + (F.col("doc_id") % 10) / 16.0)
    return rows.select("doc_id", F.col("doc_id").alias("row_no"), F.when(F.col("doc_id") % 11 != 0, F.col("lang")).alias("context_content_type"), value.alias("faithfulness"), F.col("toxic").cast("double").alias("context_recall"))


METRICS = "m AS (SELECT doc_id, CASE WHEN doc_id % 11 <> 0 THEN lang END AS context_content_type, CASE WHEN doc_id % 7 <> 0 THEN quality + (doc_id % 10) / 16.0 END AS faithfulness, toxic::DOUBLE AS context_recall FROM labels JOIN documents USING (doc_id))"


def samples_of(spark, sf_dir) -> DataFrame:
    """Conversations as samples: the first user's text asks, the last turn answers, the first answer is the reference, and two
    turns of three are the passages."""
    turns, t = table(spark, sf_dir, "conversations"), F.struct("turn", "text")
    first = lambda role: F.coalesce(F.min(F.when(F.col("role") == role, t))["text"], F.lit(""))
    passages = F.transform(F.array_sort(F.collect_list(F.when(F.col("turn") % 3 != 2, t))), lambda x: x["text"])
    return turns.groupBy(F.col("conv_id").alias("query_id")).agg(first("user").alias("question"), F.coalesce(F.max(t)["text"], F.lit("")).alias("generated_answer"), first("assistant").alias("ground_truth_answer"), passages.alias("retrieved_contexts"))


SAMPLES = """t AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations),
    s AS (SELECT conv_id AS query_id, coalesce(max(text) FILTER (role = 'user' AND k = 1), '') AS question, coalesce(max(text) FILTER (back = 1), '') AS answer, coalesce(max(text) FILTER (role = 'assistant' AND k = 1), '') AS reference FROM t GROUP BY conv_id),
    p AS (SELECT conv_id AS query_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank, text AS passage FROM conversations WHERE turn % 3 <> 2)"""
VERDICTS = rf"""x AS (SELECT query_id, 'answer' AS part, answer AS t FROM s UNION ALL SELECT query_id, 'reference', reference FROM s),
    y AS (SELECT query_id, part, unnest(regexp_split_to_array(regexp_replace(t, '([.!?])\s+', '' || chr(10), 'g'), '
+')) AS raw, generate_subscripts(regexp_split_to_array(regexp_replace(t, '([.!?])\s+', '' || chr(10), 'g'), '
+'), 1) AS no FROM x),
    st AS (SELECT query_id, part, no, list_distinct(regexp_extract_all(lower(raw), '{TOKEN}')) AS w FROM y WHERE trim(raw, E' 
	
') <> ''),
    v AS (SELECT st.query_id, part, no, rank, len(w) > 0 AND len(list_intersect(w, list_distinct(regexp_extract_all(lower(passage), '{TOKEN}')))) >= 0.5 * len(w) AS good FROM st JOIN p ON p.query_id = st.query_id
          UNION ALL SELECT st.query_id, 'question', no, 0, len(q) > 0 AND len(list_intersect(q, w)) >= 0.5 * len(q) FROM (SELECT st.*, list_distinct(regexp_extract_all(lower(question), '{TOKEN}')) AS q FROM st JOIN s ON s.query_id = st.query_id WHERE part = 'answer') st)"""


@query(f"""WITH {SAMPLES}, {VERDICTS}, b AS (SELECT query_id, part, no, max(good::INT) AS good FROM v GROUP BY query_id, part, no),
    h AS (SELECT query_id, avg(good) FILTER (part = 'answer') AS faithfulness, avg(good) FILTER (part = 'question') AS answer_relevancy, avg(good) FILTER (part = 'reference') AS context_recall FROM b GROUP BY query_id),
    u AS (SELECT query_id, rank, max(good::INT) AS useful FROM v WHERE part = 'reference' GROUP BY query_id, rank), r AS (SELECT *, avg(useful) OVER (PARTITION BY query_id ORDER BY rank) AS share FROM u),
    c AS (SELECT query_id, coalesce(avg(share) FILTER (useful = 1), 0) AS context_precision FROM r GROUP BY query_id)
    SELECT s.query_id, round(faithfulness, 6) AS lexical_faithfulness, round(answer_relevancy, 6) AS lexical_answer_relevancy, round(context_precision, 6) AS lexical_context_precision, round(context_recall, 6) AS lexical_context_recall
    FROM s LEFT JOIN h ON h.query_id = s.query_id LEFT JOIN c ON c.query_id = s.query_id""")
def answer_measures(spark, sf_dir):
    got = metrics.measures(samples_of(spark, sf_dir))
    return got.select("query_id", *(F.round(f"lexical_{n}", 6).alias(f"lexical_{n}") for n in metrics.NAMES))


@query(f"WITH {METRICS} SELECT context_content_type, round(avg(faithfulness), 6) AS faithfulness, round(avg(context_recall), 6) AS context_recall FROM m GROUP BY 1")
def eval_mean_by_type(spark, sf_dir):
    got = evaluation.mean_by_type(scores_of(spark, sf_dir), ["faithfulness", "context_recall"])
    return got.select("context_content_type", F.round("faithfulness", 6).alias("faithfulness"), F.round("context_recall", 6).alias("context_recall"))


@query(f"WITH {METRICS} SELECT round(avg(faithfulness), 6) AS faithfulness, round(avg(context_recall), 6) AS context_recall FROM m")
def eval_mean(spark, sf_dir):
    return evaluation.dataset_mean(scores_of(spark, sf_dir), ["faithfulness", "context_recall"]).select(*(F.round(c, 6).alias(c) for c in ("faithfulness", "context_recall")))


@query(f"WITH {METRICS} SELECT doc_id, faithfulness FROM m WHERE faithfulness IS NOT NULL ORDER BY faithfulness, doc_id LIMIT 5")
def worst_rows(spark, sf_dir):
    return evaluation.worst(scores_of(spark, sf_dir)).select("doc_id", "faithfulness")


def judged(spark, sf_dir) -> DataFrame:
    d = F.col("doc_id")
    score = lambda k: F.when(d % 13 != k, (d + k) % 5 + 1).cast("int").alias(evaluation.CRITERIA[k])
    return table(spark, sf_dir, "labels").select("doc_id", *(score(k) for k in range(5)), F.when(d % 17 == 0, F.lit("failed")).alias("error"))


@query("WITH s AS (SELECT doc_id, " + ", ".join(f"CASE WHEN doc_id % 13 <> {k} THEN (doc_id + {k}) % 5 + 1 END AS c{k}" for k in range(5)) + ", CASE WHEN doc_id % 17 = 0 THEN 'failed' END AS error FROM labels), w AS (SELECT *, error IS NULL AND c0 + c1 + c2 + c3 + c4 IS NOT NULL AS whole FROM s) SELECT count(*) AS judged, count(error) AS failures, count(*) FILTER (whole) AS numeric, " + ", ".join(f"round(avg(c{k}) FILTER (whole), 2) AS {c}" for k, c in enumerate(evaluation.CRITERIA)) + " FROM w")
def judge_means(spark, sf_dir):
    return evaluation.judge_means(judged(spark, sf_dir))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE (doc_id % 5 + 1)::INT END AS factual_alignment_with_reference, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 3 END AS clarity FROM documents")
def judge_json(spark, sf_dir):
    d = F.col("doc_id")
    good = F.concat(F.lit('```json\n{"factual_alignment_with_reference": '), (d % 5 + 1).cast("string"), F.lit(', "completeness_vs_reference": 2, "handling_of_visual_or_numeric_claims": 5, "clarity": 3, "overall": 1}\n```'))
    reply = F.when(d % 4 == 0, F.lit('{"clarity": 9}')).otherwise(good)
    return documents(spark, sf_dir).select("doc_id", text.judge_scores(reply).alias("s")).select("doc_id", "s.factual_alignment_with_reference", "s.clarity")


@query("SELECT table_id, name AS \"column\", rows, numbers FROM (SELECT p_size % 5 AS table_id, count(*) AS rows, count(*) AS numbers, 'price' AS name FROM part GROUP BY 1 UNION ALL SELECT 100 + p_size % 5, count(*), count(*) FILTER (p_partkey % 3 <> 0), 'mixed' FROM part GROUP BY 1)")
def numeric_columns(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    key = (F.col("p_size") % 5).cast("long")
    rows = [part.select(key.alias("table_id"), F.lit(n).alias("column"), F.col("p_partkey").alias("row_no"), v.alias("value")) for n, v in (("name", F.col("p_name")), ("price", F.col("p_retailprice").cast("string")))]
    rows += [part.select((key + 100).alias("table_id"), F.lit(n).alias("column"), F.col("p_partkey").alias("row_no"), v.alias("value")) for n, v in (("name", F.col("p_name")), ("mixed", F.when(F.col("p_partkey") % 3 == 0, F.lit("n/a")).otherwise(F.col("p_partkey").cast("string"))))]
    return structured.numeric_columns(rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3]))


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN event_id % 400 WHEN 5 THEN 12 ELSE 7 END AS page_index, CASE event_id % 6 WHEN 0 THEN event_id::DOUBLE WHEN 1 THEN 0 WHEN 2 THEN 2.5 WHEN 3 THEN -1e9 WHEN 4 THEN 0 ELSE 12 END AS score FROM events")
def payload_sanitize(spark, sf_dir):
    e = F.col("event_id")
    cases = F.when(e % 6 == 0, F.concat(F.lit('{"p": '), (e % 400).cast("string"), F.lit(', "s": '), e.cast("string"), F.lit("}"))).when(e % 6 == 1, F.lit('{"p": true, "s": false}')).when(e % 6 == 2, F.lit('{"p": "3", "s": "2.5"}')).when(e % 6 == 3, F.lit('{"p": -4, "s": -1e300}')).when(e % 6 == 4, F.lit('{"p": 900000, "s": null}')).otherwise(F.lit('{"p": 12.0, "s": 12}'))
    v = table(spark, sf_dir, "events").select("event_id", F.parse_json(cases).alias("v"))
    get = lambda k: F.try_variant_get(F.col("v"), f"$.{k}", "variant")
    return v.select("event_id", payload.strict_uint(get("p"), 7).alias("page_index"), payload.strict_float(get("s")).alias("score"))


@query("SELECT n_nationkey, r * 1::INT AS row_index, c AS col_index, c * 192 AS x0_px, r * 192 AS y0_px, least(256, 500 + 37 * n_nationkey - c * 192) AS width_px, least(256, 300 + 53 * n_nationkey - r * 192) AS height_px FROM nation, range(20) a(r), range(20) b(c) WHERE r * 192 < 300 + 53 * n_nationkey AND c * 192 < 500 + 37 * n_nationkey")
def patch_grid(spark, sf_dir):
    sizes = table(spark, sf_dir, "nation").select("n_nationkey", (500 + 37 * F.col("n_nationkey")).cast("int").alias("w"), (300 + 53 * F.col("n_nationkey")).cast("int").alias("h"))
    return sizes.select("n_nationkey", F.explode(geometry.patch_grid("w", "h", 256, 192)).alias("t")).select("n_nationkey", "t.*")


@query("SELECT n_nationkey, (ceil((500 + 37 * n_nationkey) / 192.0) * ceil((300 + 53 * n_nationkey) / 192.0))::BIGINT AS n, round(10 + 192 * 595.0 / (500 + 37 * n_nationkey), 6) AS x0, round(20 + (64 + 256) * 842.0 / (300 + 53 * n_nationkey), 6) AS y1 FROM nation")
def patch_rects(spark, sf_dir):
    w, h = (500 + 37 * F.col("n_nationkey")).cast("int"), (300 + 53 * F.col("n_nationkey")).cast("int")
    rect = geometry.pdf_rect(*(F.lit(float(x)) for x in (10, 20, 605, 862)), w, h, F.lit(192), F.lit(64), F.lit(256), F.lit(256))
    return table(spark, sf_dir, "nation").select("n_nationkey", geometry.patch_count(w, h, 256, 192).alias("n"), F.round(rect["x0"], 6).alias("x0"), F.round(rect["y1"], 6).alias("y1"))


# --- sources, sinks and whole plans ---


@query("SELECT item_id::VARCHAR AS query_id, sha256(text) AS query_sha256, length(text) AS query_char_length FROM benchmark")
def trace_rows(spark, sf_dir):
    return index.trace_rows(asked(spark, sf_dir))


CLAUSED = "CASE item_id % 4 WHEN 0 THEN ' only on pages 9-4' WHEN 1 THEN ' pages 3 to 12 and page 5' ELSE '' END"


@query(rf"SELECT item_id::VARCHAR AS query_id, NOT regexp_matches(text || {CLAUSED}, '(?i)\bpages?\s*(\d+)\s*(?:-|–|to)\s*(\d+)\b') AND item_id % 3 <> 0 AND item_id % 5 <> 0 AS eligible FROM benchmark")
def cache_eligible(spark, sf_dir):
    n = F.col("item_id")
    clause = F.when(n % 4 == 0, " only on pages 9-4").when(n % 4 == 1, " pages 3 to 12 and page 5").otherwise("")
    rows = table(spark, sf_dir, "benchmark").select("item_id", text.strip_page_clause(F.concat("text", clause)).alias("p"))
    return rows.select(n.cast("string").alias("query_id"), cache.eligible_column(F.col("p.lo"), F.when(n % 3 == 0, n), F.when(n % 5 == 0, n)).alias("eligible"))


@query(rf"WITH f AS (SELECT doc_id, doc_id % 3 <> 0 AND regexp_matches(lower(cue), '(^|[^\p{{L}}\p{{N}}])(?:(?:figures?[ :.]|fig[. ])[ \t\r\n:.\-]{{0,23}}\p{{Nd}}|(?:figures?|fig)\p{{Nd}})') AS kept FROM {FIGURES}) SELECT doc_id, CASE WHEN NOT kept THEN 'image without figure label: xref ' || doc_id END AS note FROM f")
def labelled_images(spark, sf_dir):
    """Images that the parse keeps, and a note on each that it drops."""
    d = F.col("doc_id")
    images = figures(spark, sf_dir).select(d, d.alias("xref"), F.when(d % 3 == 1, F.col("cue")).alias("contextual_snippet_above"), F.when(d % 3 == 2, F.col("cue")).alias("contextual_snippet_below"))
    kept, dropped = layout.labelled_images(images)
    return kept.select("doc_id", F.lit(None).cast("string").alias("note")).unionByName(dropped.select("doc_id", "note"))


@query(f"WITH {CHUNKS} SELECT md5(text) AS text, chunk_id, page_start, page_end, 'a.pdf' AS source, 'note' AS structure_note, content_type, section_hint, chunk_kind, CASE WHEN chunk_pos % 2 = 0 THEN 't' || chunk_pos END AS table_id, 'a,b' AS table_csv_preview, chunk_pos AS image_xref FROM chunks")
def chunk_payload(spark, sf_dir):
    pos = F.col("chunk_pos")
    rows = chunk_rows(documents(spark, sf_dir)).withColumns({"source": F.lit("a.pdf"), "structure_note": F.lit("note"), "table_id": F.when(pos % 2 == 0, F.concat(F.lit("t"), pos.cast("string"))), "table_csv_preview": F.lit("a,b"), "image_xref": pos})
    return chunking.payload(rows).select(F.md5("text").alias("text"), "metadata.*")


@query("SELECT item_id::VARCHAR AS query_id FROM benchmark ORDER BY 1 LIMIT 10")
def row_cap(spark, sf_dir):
    """The cap on rows is the feature: an evaluation of the first ten questions."""
    return corpus.capped(asked(spark, sf_dir), 10).select("query_id")


def whole_page(doc_id: str, content: bytes):
    yield {"page_index": 0, "text": content.decode()}


def line_spans(doc_id: str, content: bytes):
    for i, line in enumerate(content.decode().split("\n")):
        yield {"span_id": f"line-{i}", "page_index": 0, "x0": 0.0, "y0": float(i), "x1": 1.0, "y1": i + 1.0, "text": line, "extractor": "lines"}


def files_of(spark, sf_dir) -> DataFrame:
    return documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), F.encode("text", "UTF-8").alias("content"))


@query("SELECT doc_id::VARCHAR AS doc_id, 'pypdf-page-0' AS span_id, 'pypdf' AS extractor, md5(text) AS text FROM documents WHERE trim(text, E' \\n\\t') <> '' UNION ALL SELECT doc_id::VARCHAR, 'line-' || (i - 1), 'lines', md5(line) FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)")
def extractor_union(spark, sf_dir):
    parts = corpus.parse_documents(files_of(spark, sf_dir), {"pages": whole_page, "spans": line_spans})
    return parts["spans"].select("doc_id", "span_id", "extractor", F.md5("text").alias("text"))


@query(rf"""SELECT doc_id, left(sha256(text || '|' || doc_id % 7 || '|' || (doc_id % 7 + 1) || '|' || source), 24) AS chunk_id, CASE WHEN length(line) > 96 THEN substr(line, 1, 95) || '…' ELSE line END AS section_hint,
    CASE WHEN regexp_matches(substr(text, 1, 800), '(?i)\b(figure|fig\.|chart|graph|diagram)\b') THEN 'figure_ref' WHEN regexp_matches(substr(text, 1, 800), '(?i)\b(table\s+\d+|schedule\s+[ivx\d]|million\b|billion\b|\$\s*[\d,]+)\b') OR doc_id % 6 = 0 THEN 'table_dense' WHEN regexp_matches(substr(text, 1, 800), '\$\s*\d') THEN 'numeric_heavy' ELSE 'narrative' END AS content_type, 'narrative' AS chunk_kind
    FROM (SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1] AS line FROM {CUED})""")
def constructed_chunks(spark, sf_dir):
    page = F.pmod("doc_id", F.lit(7)).cast("int")
    rows = cued(documents(spark, sf_dir)).select("doc_id", F.lit(0).alias("n"), "text", page.alias("page_start"), (page + 1).alias("page_end"), "source", F.when(F.col("doc_id") % 6 == 0, "a Table by layout").otherwise("page").alias("structure_note"))
    return chunking.constructed(rows).select("doc_id", "chunk_id", "section_hint", "content_type", "chunk_kind")


@query("SELECT doc_id, 'data/cache_' || left(sha256('/srv/index' || chr(0) || source), 16) || '.json' AS path, 'data/cache/' || left(sha256('/srv/index' || chr(0) || source), 16) AS folder FROM documents")
def cache_paths(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", ids.cache_paths("data/cache.json", "/srv/index", "source").alias("path"), ids.cache_paths("data/cache", "/srv/index", "source").alias("folder"))


@query(r"""WITH RECURSIVE p AS (SELECT conv_id AS doc_id, turn::INT AS page, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations WHERE conv_id % 2 = 1 AND trim(regexp_replace(text, '\s+', ' ', 'g')) <> ''),
    s AS (SELECT doc_id, page, t, coalesce(sum(length(t) + 2) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM p),
    w AS (SELECT doc_id, string_agg(t, chr(10) || chr(10) ORDER BY page) AS whole FROM p GROUP BY doc_id),
    x AS (SELECT doc_id, pos, substr(whole, pos + 1, 1200) AS raw FROM (SELECT doc_id, unnest(range(0, length(whole), 1000)) AS pos, whole FROM w)),
    j AS (SELECT x.doc_id, pos, raw, max(page) FILTER (start <= pos + length(raw) // 2) AS page FROM x JOIN s ON x.doc_id = s.doc_id GROUP BY x.doc_id, pos, raw),
    o AS (SELECT conv_id AS doc_id, (turn // 3)::INT AS page, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn // 3, (turn * 37) % 11, 's' || turn) AS n FROM conversations WHERE conv_id % 2 = 0 AND trim(regexp_replace(text, '\s+', ' ', 'g')) <> ''),
    f AS (SELECT doc_id, n, page, t, length(t)::BIGINT AS used, 0::BIGINT AS run FROM o WHERE n = 1
          UNION ALL SELECT o.doc_id, o.n, o.page, o.t, CASE WHEN f.used + 2 + length(o.t) > 1200 THEN length(o.t) ELSE f.used + 2 + length(o.t) END, CASE WHEN f.used + 2 + length(o.t) > 1200 THEN f.run + 1 ELSE f.run END FROM f JOIN o ON o.doc_id = f.doc_id AND o.n = f.n + 1),
    r AS (SELECT doc_id, run, trim(regexp_replace(string_agg(t, chr(10) || chr(10) ORDER BY n), '\s+', ' ', 'g')) AS t, min(page) AS page_start, max(page) AS page_end FROM f GROUP BY doc_id, run),
    l AS (SELECT doc_id, run, page_start, page_end, unnest(range(0, length(t), 1000)) AS pos, t FROM r),
    every AS (
        SELECT 0 AS kind_no, doc_id::VARCHAR AS doc_id, pos // 1000 AS n, page AS page_start, page AS page_end, trim(raw, E' \n') AS t FROM j
        UNION ALL SELECT 0, doc_id::VARCHAR, row_number() OVER (PARTITION BY doc_id ORDER BY run, pos) - 1, page_start, page_end, trim(substr(t, pos + 1, 1200), E' \n') FROM l),
    chunked AS (SELECT kind_no, doc_id, n, page_start, page_end, left(sha256(t || '|' || page_start || '|' || page_end || '|' || doc_id), 24) AS chunk_id FROM every WHERE t <> ''
        UNION ALL SELECT 1, n_regionkey::VARCHAR, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey % 4, 't' || n_nationkey), (n_nationkey % 4)::INT, (n_nationkey % 4)::INT, left(sha256(n_regionkey || chr(0) || 't' || n_nationkey || chr(0) || n_nationkey % 4), 24) FROM nation WHERE NOT (n_nationkey % 2 = 1 AND n_nationkey % 3 = 1))
    SELECT row_number() OVER (ORDER BY kind_no, doc_id, n) - 1 AS chunk_pos, doc_id, page_start, page_end, chunk_id, 64::INT AS dimensions FROM chunked""")
def ingest(spark, sf_dir):
    """Spans, pages and tables to chunks with vectors, the index and the collection; read back from the index. Every other
    document has no spans, so both ways of cutting are taken."""
    named = lambda df: df.withColumn("doc_id", F.col("doc_id").cast("string"))
    parts = {"pages": named(pages_of(spark, sf_dir)), "spans": named(spans_of(spark, sf_dir).where("doc_id % 2 = 0")), "tables": table_blocks(spark, sf_dir).drop("n")}
    chunks = corpus.ingest(parts, corpus.hashed_embedder, Settings(index_path=scratch(spark, "index")))
    return chunks.select("chunk_pos", "doc_id", "page_start", "page_end", "chunk_id", F.size("embedding").alias("dimensions"))


@query(f"WITH {ASKED}, {FUSED} SELECT 'local' AS leg, query_id, chunk_pos, rank FROM fused WHERE rank <= 5 UNION ALL SELECT 'remote', query_id, chunk_pos, rank FROM dense WHERE rank <= 5")
def dual_retrieval(spark, sf_dir):
    chunks, queries, terms, found = legs_of(spark, sf_dir)
    settings = Settings(metadata_boost=False)
    local, remote = retrieval.dual(retrieval.questions(queries, settings), chunks, found, found, terms, settings)
    leg = lambda name, df: df.select(F.lit(name).alias("leg"), "query_id", "chunk_pos", F.col("rank").cast("long").alias("rank"))
    return leg("local", local).unionByName(leg("remote", remote))


ENDS = "trim(array_to_string(string_split(replace(text, chr(10), ' '), ' ')[-3:], ' '))"


def last_words(prompts: list[str]) -> list[str]:
    """Stands in for the model: asks for the question's last three words, if its length is even."""
    asked_for = [p.removeprefix("Question: ").partition("\nPassages so far:")[0] for p in prompts]
    return [" ".join(q.replace("\n", " ").split(" ")[-3:]) if len(q) % 2 == 0 else models.DONE for q in asked_for]


@query(f"""WITH asked AS (SELECT item_id::VARCHAR AS query_id, text AS query FROM benchmark UNION ALL SELECT 'f' || item_id, {ENDS} FROM benchmark WHERE length(text) % 2 = 0), {TERMS}, {DENSE},
    u AS (SELECT query_id, chunk_pos, 1 AS pass, rank FROM dense WHERE rank <= 3 AND query_id[1] <> 'f' UNION ALL SELECT query_id[2:], chunk_pos, 2, rank FROM dense WHERE rank <= 3 AND query_id[1] = 'f'),
    o AS (SELECT query_id, chunk_pos, pass, rank FROM u QUALIFY row_number() OVER (PARTITION BY query_id, chunk_pos ORDER BY pass) = 1)
    SELECT query_id, 'c' || chunk_pos AS chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY pass, rank) AS rank FROM o QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pass, rank) <= 5""")
def multi_hop_retrieval(spark, sf_dir):
    """A second pass by each question's own follow-up, for those that the model asks one for."""
    held = indexed(spark, sf_dir)

    def search(questions: DataFrame) -> DataFrame:
        return dense.hashed_topk(held.vectors, questions, 3).join(held.chunks.select("chunk_pos", "chunk_id", "text"), "chunk_pos")

    hits, _ = retrieval.multi_hop(retrieval.questions(asked(spark, sf_dir), Settings()), search, last_words, Settings())
    return hits.select("query_id", "chunk_id", F.col("merged_rank" if "merged_rank" in hits.columns else "rank").cast("long").alias("rank"))


class Flaky:
    """A transport that fails on schedule: every third call as a whole, and for good on texts whose length 7 divides."""

    def __init__(self):
        self.calls = 0

    def __call__(self, texts: list[str]) -> list:
        self.calls += 1
        if self.calls % 3 == 0:
            raise ConnectionError("try again")
        return [ValueError("not this one") if len(t) % 7 == 0 else hashlib.md5(t.encode()).hexdigest() for t in texts]


@query("SELECT doc_id, CASE WHEN length(text) % 7 <> 0 THEN md5(text) END AS value, CASE WHEN length(text) % 7 = 0 THEN 'summary: ValueError: not this one' END AS error FROM documents")
def batched_replies(spark, sf_dir):
    """Every text through a model that fails now and then: replies stay with their rows, and what fails for good is a note."""
    call = calls.attempted(Flaky, "summary", calls.Limits(items=8, size=20_000, tries=4))
    return documents(spark, sf_dir).select("doc_id", call("text").alias("r")).select("doc_id", "r.value", "r.error")


# --- answers, reports and model legs as whole plans ---

HYBRID, _, _TOP = ORACLE_SQL["hybrid_full"].rpartition("\n    SELECT c.query_id")
NEAREST_STORED = """vecs AS (SELECT query_id, bucket, qtf / qnorm AS x FROM qw JOIN qn USING (query_id)),
    near AS (SELECT a.query_id, b.query_id AS entry, round(sum(a.x * b.x), 9) AS similarity FROM vecs a JOIN vecs b USING (bucket) WHERE a.query_id::INT % 2 = 1 AND b.query_id::INT % 4 = 1 GROUP BY ALL),
    cached AS (SELECT query_id, arg_max(entry, (similarity, -entry::INT)) AS entry, max(similarity) AS similarity FROM near GROUP BY query_id HAVING max(similarity) >= 0.92)"""


@query(f"""{HYBRID}, full_hits AS (SELECT c.query_id{_TOP}), {NEAREST_STORED},
    first AS (SELECT h.query_id, text, length('[1] pages ' || page_start || '–' || page_end || ' · ' || content_type || ' · ' || chunk_kind || chr(10) || text) AS size FROM full_hits h JOIN chunks USING (chunk_pos) WHERE rank = 1)
    SELECT q.query_id, CASE WHEN entry IS NOT NULL THEN 'stored ' || entry WHEN size > 12000 OR size IS NULL OR trim(text, E' \n\t') = '' THEN 'The report doesn''t say.' ELSE substr(trim(text, E' \n\t'), 1, 512) END AS answer, round(similarity, 6) AS similarity, CASE WHEN entry IS NOT NULL THEN 'cache_hit' ELSE 'multi_hop_done' END AS note
    FROM asked q LEFT JOIN cached c ON c.query_id = q.query_id LEFT JOIN first f ON f.query_id = q.query_id""")
def answered_questions(spark, sf_dir):
    """All questions in one plan, half of them with a page clause: a quarter of the answers are in the cache before, the others
    come from the retrieval and the stand-in model."""
    held, queries, settings = indexed(spark, sf_dir), with_cue(asked(spark, sf_dir)), Settings()
    n = F.col("query_id").cast("int")
    store = cache.AnswerCache(scratch(spark, "answers"))
    stored = queries.where(n % 4 == 1).withColumn("embedding", models.batch_udf(corpus.hashed_embedder, "array<double>")("query"))
    store.append(stored.select("embedding", F.concat(F.lit("stored "), "query_id").alias("answer"), n.cast("long").alias("pos")))
    clause = F.when(n % 2 == 0, F.lit(" on pages 4-13")).otherwise(F.lit(""))
    told, _ = answers.answered(queries.withColumn("query", F.concat("query", clause)), held.chunks, corpus.hashed_embedder, held.terms, settings, store=store, vectors=held.vectors, metric="cosine")
    return told.select("query_id", "answer", F.round("similarity", 6).alias("similarity"), "note")


@query(f"""WITH {PACK}, asked AS (SELECT DISTINCT query_id, 'what of ' || query_id AS query FROM h), packed AS (SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS context, bool_or(chunk_kind = 'pdf_table') AS has_table, bool_or(chunk_kind = 'pdf_image') AS has_figure FROM k WHERE NOT stop GROUP BY query_id)
    SELECT a.query_id, md5('{answers.RULES.strip().replace("'", "''")}' || chr(10) || CASE WHEN has_table THEN '{answers.TABLES.strip()}' || chr(10) ELSE '' END || CASE WHEN has_figure THEN '{answers.FIGURES.strip().replace("'", "''")}' || chr(10) ELSE '' END || '{answers.OPENED.strip()}' || chr(10) || coalesce(context, '') || chr(10) || '{answers.CLOSED.strip().replace(chr(10), "' || chr(10) || '")} ' || query || chr(10) || '{answers.CITE.strip()}') AS prompt
    FROM asked a LEFT JOIN packed p ON p.query_id = a.query_id""")
def prompt_texts(spark, sf_dir):
    hits = hits_of(spark, sf_dir)
    of = hits.select("query_id").distinct().withColumn("query", F.concat(F.lit("what of "), F.col("query_id").cast("string")))
    return answers.prompts(hits, of).select("query_id", F.md5("prompt").alias("prompt"))


def overlap_scores(pairs: list[tuple[str, str]]) -> list[float]:
    return [models.overlap_score(q, t) for q, t in pairs]


@query(rf"""WITH {ASKED}, {TERMS}, {DENSE}, o AS (SELECT d.query_id, d.chunk_pos, d.rank, len(list_intersect(list_distinct(regexp_extract_all(lower(query), '{TOKEN}')), list_distinct(regexp_extract_all(lower(text), '{TOKEN}')))) / len(list_distinct(regexp_extract_all(lower(query), '{TOKEN}'))) AS score FROM dense d JOIN asked q USING (query_id) JOIN chunks c USING (chunk_pos))
    SELECT query_id, chunk_pos, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS rank FROM o""")
def cross_encoder(spark, sf_dir):
    """The dense leg in the order of a model's scores of pairs."""
    chunks, queries, _, found = legs_of(spark, sf_dir)
    hits, note = rerank.cross_encoder_rerank(found.join(chunks, "chunk_pos").join(queries, "query_id"), overlap_scores)
    return hits.select("query_id", "chunk_pos", F.col("rank").cast("long").alias("rank"))


def labels_seen(requests: list[str]) -> list[str]:
    """Stands in for a model that sees: what it was shown, in order."""
    out = []
    for r in requests:
        parts = json.loads(r)["parts"]
        shown = [base64.b64decode(x["image_base64"]).decode() for x in parts if x.get("image_base64")]
        out.append(parts[1]["text"].split("\n")[1] + ": " + (" ".join(shown) or parts[-1]["text"]))
    return out


@query(f"""{ORACLE_SQL["visual_retrieval"].rpartition("    SELECT query_id::VARCHAR AS query_id, vec_id, round(maxsim, 6)")[0].rstrip()},
    top AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY s.maxsim DESC, s.score DESC, vec_id::VARCHAR) AS rank FROM s QUALIFY rank <= 6), told AS (SELECT query_id, string_agg('crop-' || vec_id, ' ' ORDER BY rank) AS seen FROM top GROUP BY query_id)
    SELECT query_id::VARCHAR AS query_id, 'what is on ' || query_id || ': ' || seen AS answer FROM told UNION ALL SELECT 'none', 'what is on none: {answers.NO_CROPS}'""")
def visual_replies(spark, sf_dir):
    """The patches that late interaction ranks first go, as pictures, to a model that sees; one question has none."""
    vecs = unscaled(spark, sf_dir)
    patches = vecs.select(F.col("chunk_pos").cast("string").alias("patch_id"), "embedding", F.col("label").cast("string").alias("pdf_sha256"))
    top = corpus.retrieve_patches_batch(patches, questions_of(vecs), Settings(), "3").withColumn("png", F.encode(F.concat(F.lit("crop-"), "patch_id"), "UTF-8"))
    names = vecs.where("chunk_pos % 100 = 0").select(F.col("chunk_pos").cast("string").alias("query_id")).unionByName(spark.createDataFrame([("none",)], "query_id string"))
    of = names.withColumn("query", F.concat(F.lit("what is on "), "query_id"))
    return answers.visual_answers(of, top, labels_seen).select("query_id", "answer")


@query(r"SELECT trim(text, E' \n\t') AS question, 'see ' || chr(34) || item_id || chr(34) || ', there' AS ground_truth_context, '' AS ground_truth_answer, item_id::VARCHAR AS page_number, CASE WHEN item_id % 2 = 0 THEN 'table' ELSE '' END AS context_content_type FROM benchmark WHERE item_id % 7 <> 0".replace("\\n", "\n").replace("\\t", "\t"))
def gold_csv(spark, sf_dir):
    """Labelled questions through a CSV file with quotes, commas, line ends, spaces and empty fields; blank ones are dropped."""
    n = F.col("item_id")
    rows = table(spark, sf_dir, "benchmark").select(F.when(n % 7 == 0, "  ").otherwise(F.concat(F.lit("  "), "text", F.lit(" "))).alias("Question"), F.concat(F.lit('see "'), n.cast("string"), F.lit('", there')).alias("Ground_Truth_Context"), F.lit(None).cast("string").alias("Ground_Truth_Answer"), F.concat(F.lit(" "), n.cast("string")).alias("Page_Number"), F.when(n % 2 == 0, "table").alias("Context_Content_Type"))
    path = scratch(spark, "gold")
    rows.write.csv(path, header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return sources.gold_questions(spark, path)


@query("SELECT doc_id, length(text) AS chars, quality FROM documents JOIN labels USING (doc_id)")
def aligned_rows(spark, sf_dir):
    """Texts and labels side by side, by key; a row on one side only would be an error."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    texts = documents(spark, sf_dir).select("doc_id", F.length("text").alias("chars")).join(labels.select("doc_id"), "doc_id", "left_semi")
    return batching.aligned(texts, labels, "doc_id").select("doc_id", "chars", "quality")


def size_and_place(blobs: list[bytes]) -> list[list[float]]:
    """Stands in for a picture encoder."""
    return [[float(x) for x in bytes(b).decode().split("x")] for b in blobs]


@query("""WITH n AS (SELECT n_nationkey, p AS page_index, 500 + 37 * n_nationkey AS w, 300 + 53 * n_nationkey AS h FROM nation, range(3) x(p)), t AS (SELECT *, r.r AS row_index, c.c AS col_index FROM n, range(20) r(r), range(20) c(c) WHERE r.r * 192 < h AND c.c * 192 < w)
    SELECT 'p6-' || left(sha256('sha' || n_nationkey || '|p=' || page_index || '|r=' || row_index || '|c=' || col_index || '|dpi=144.0'), 26) AS patch_id, page_index::INT AS page_index, least(256, w - col_index * 192)::INT AS width_px, round(least(256, w - col_index * 192) + row_index + 0.5, 6)::DOUBLE AS total FROM t""")
def patch_ingest(spark, sf_dir):
    """Pages to patches with vectors, and read back; the pages beyond the limit are left out."""
    n = F.col("n_nationkey")
    pages = table(spark, sf_dir, "nation").select(F.concat(F.lit("sha"), n.cast("string")).alias("pdf_sha256"), F.lit("a.pdf").alias("source_filename"), F.explode(F.array(*map(F.lit, range(5)))).alias("page_index"), (500 + 37 * n).cast("int").alias("pixmap_page_width"), (300 + 53 * n).cast("int").alias("pixmap_page_height"))
    path, patches = scratch(spark, "patches"), corpus.patch_records(pages, Settings(patch_max_pages=3))
    pictured = patches.withColumn("png", F.encode(F.concat_ws("x", "width_px", "row_index", F.lit("0.5")), "UTF-8"))
    corpus.ingest_patches(pictured, lambda: size_and_place, path, 3)
    held = spark.read.parquet(f"{path}/patches")
    return held.select("patch_id", "page_index", "width_px", F.round(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(ORACLE_SQL["answer_measures"].rpartition("\n    SELECT s.query_id")[0] + """,
    m AS (SELECT s.query_id, faithfulness, answer_relevancy, context_precision, context_recall, CASE WHEN s.query_id % 3 = 0 THEN 'table' ELSE 'text' END AS kind FROM s LEFT JOIN h ON h.query_id = s.query_id LEFT JOIN c ON c.query_id = s.query_id),
    parts AS (SELECT 'row' AS part, query_id::VARCHAR AS name, faithfulness, answer_relevancy, context_precision, context_recall FROM m UNION ALL SELECT 'type', kind, avg(faithfulness), avg(answer_relevancy), avg(context_precision), avg(context_recall) FROM m GROUP BY kind UNION ALL SELECT 'mean', '', avg(faithfulness), avg(answer_relevancy), avg(context_precision), avg(context_recall) FROM m)
    SELECT part, name, round(faithfulness, 6) AS lexical_faithfulness, round(answer_relevancy, 6) AS lexical_answer_relevancy, round(context_precision, 6) AS lexical_context_precision, round(context_recall, 6) AS lexical_context_recall FROM parts""")
def evaluation_report(spark, sf_dir):
    """Samples to measures, the report as JSON and Markdown, and the JSON read back: rows, means by type, and the mean."""
    rows = samples_of(spark, sf_dir).withColumns({"page_number": F.lit("1"), "context_content_type": F.when(F.col("query_id") % 3 == 0, "table").otherwise("text")})
    path = f"{scratch(spark, 'report')}/report.json"
    folder = corpus.write_report(rows, path, Settings())
    one = spark.read.json(path, multiLine=True, primitivesAsString=True)
    cells = lambda at: [F.round(at[f"lexical_{m}"].try_cast("double"), 6).alias(f"lexical_{m}") for m in metrics.NAMES]
    each = lambda part, key: one.select(F.explode(key).alias("x"))
    lines = spark.read.schema(", ".join(["query_id string", *(f"lexical_{m} string" for m in metrics.NAMES)])).json(folder)
    types = each("type", "ragas_by_context_content_type")
    out = lines.select(F.lit("row").alias("part"), F.col("query_id").alias("name"), *cells(F.struct(*lines.columns)))
    out = out.unionByName(types.select(F.lit("type").alias("part"), F.col("x.context_content_type").alias("name"), *cells(F.col("x"))))
    return out.unionByName(one.select(F.lit("mean").alias("part"), F.lit("").alias("name"), *cells(F.col("ragas_summary_mean"))))
