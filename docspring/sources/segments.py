"""A term index that grows: a segment of postings for each change, places that died, and sums over both."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docspring.operators import sparse
from docspring.operators.chunking import positioned
from docspring.sources import manifests
from docspring.staging import Staging


def deaths_of(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """term, df, tokens of the postings that died, from rows (term, block, ats, tfs) in order of blocks: of each block first its
    dead places, in a row without a term. A task holds one block's places."""
    key, gone = None, np.zeros(span, bool)
    for batch in batches:
        block, sizes = batch.column(1).to_numpy(), batch.column(2).value_lengths().to_numpy()
        edges = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1), len(block)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            if lo == hi:
                continue
            if block[lo] != key:
                key, gone[:] = block[lo], False
                if not batch.column(0)[int(lo)].is_valid:
                    gone[batch.column(2)[int(lo)].values.to_numpy()] = True
                    lo += 1
            if lo == hi or not gone.any():
                continue
            ats, tfs = (batch.column(c).slice(lo, hi - lo).flatten().to_numpy() for c in (2, 3))
            row, hit = np.repeat(np.arange(hi - lo), sizes[lo:hi]), gone[ats]
            df, tokens = np.bincount(row, hit, hi - lo).astype(np.int64), np.bincount(row, hit * tfs, hi - lo).astype(np.int64)
            some = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(some)), pa.array(df[some]), pa.array(tokens[some])], names=["term", "df", "tokens"])


class SegmentedTerms:
    """Under path: a folder for each segment with blocks (postings), slots (slot, doc_id, no) and docs (doc_id, a digest of its
    chunks); for each change a folder of what died: slots, docs (doc_id, the segment) and terms (with how often they died). A slot
    is a chunk's place for good, no its number within its document. Only changed documents are tokenised.

    Frequencies are sums over segments less what died. What a change counts is the changed documents' words; to take off the words
    that died, the postings are scanned for the dead's blocks, and nothing is tokenised for it."""

    def __init__(self, spark: SparkSession, path: str, span: int = sparse.SPAN):
        self.spark, self.path, self.span = spark, path.rstrip("/"), span

    # --- what is there ---

    def state(self) -> dict:
        return manifests.read(self.spark, self.path) or {"version": 0, "span": self.span, "next_block": 0, "segments": [], "deaths": [], "n": 0, "tokens": 0, "parts": []}

    def table(self, held: dict, kind: str, name: str, schema: str) -> DataFrame:
        some = [f"{self.path}/parts/{x}/{name}" for x in held[kind]]
        return self.spark.read.schema(schema).parquet(*some) if some else self.spark.createDataFrame([], schema)

    def blocks(self, held: dict) -> DataFrame:
        return self.table(held, "segments", "blocks", sparse.BLOCKS)

    def live_slots(self, held: dict) -> DataFrame:
        """slot, doc_id, no."""
        every = self.table(held, "segments", "slots", "slot long, doc_id string, no long")
        return every.join(self.table(held, "deaths", "slots", "slot long"), "slot", "left_anti")

    def live_docs(self, held: dict) -> DataFrame:
        """doc_id and digest."""
        every = self.table(held, "segments", "docs", "doc_id string, segment string, digest string")
        return every.join(self.table(held, "deaths", "docs", "doc_id string, segment string"), ["doc_id", "segment"], "left_anti")

    # --- changes ---

    @staticmethod
    def with_no(chunks: DataFrame) -> DataFrame:
        """Chunks with an id, and no: their place within the document, by chunk_pos, or n where they have no number yet."""
        no = F.row_number().over(W.partitionBy("doc_id").orderBy("chunk_pos")) if "chunk_pos" in chunks.columns else F.col("n")
        return chunks.where(F.trim("chunk_id") != "").withColumns({"doc_id": F.col("doc_id").cast("string"), "no": no.cast("long")})

    @staticmethod
    def digests(chunks: DataFrame) -> DataFrame:
        """doc_id and a digest of its chunks in order, made of sums, so that no task holds a document's chunks."""
        row = F.struct("no", "text")
        return chunks.groupBy("doc_id").agg(F.concat_ws(":", F.count(F.lit(1)), F.bit_xor(F.xxhash64(F.lit(1), row)), F.bit_xor(F.xxhash64(F.lit(2), row))).alias("digest"))

    def upsert(self, chunks: DataFrame, whole: bool = False) -> dict:
        """Chunks (doc_id, chunk_pos or n, chunk_id, text) of some documents take the place of what those had; with `whole` the
        documents that chunks don't name die. Returns how many documents are new, changed, dead and as they were."""
        held, staging = self.state(), Staging(self.spark, "segments")
        try:
            return self._upsert(held, staging, staging.stored(self.with_no(chunks).select("doc_id", "no", "text"), "rows"), whole)
        finally:
            staging.drop()

    def _upsert(self, held: dict, staging: Staging, rows: DataFrame, whole: bool) -> dict:
        old = self.live_docs(held).withColumnRenamed("digest", "was")
        both = staging.stored(self.digests(rows).join(old, "doc_id", "full"), "changes")
        differs = F.col("digest").isNotNull() & (F.col("was").isNull() | (F.col("was") != F.col("digest")))
        fresh = both.where(differs)
        gone = both.where(F.col("was").isNotNull() & (differs | (F.lit(whole) & F.col("digest").isNull())))
        counts = both.agg(F.count_if(F.col("digest").isNotNull() & F.col("was").isNull()).alias("new"), F.count_if(differs & F.col("was").isNotNull()).alias("changed"), F.count_if(F.col("was").isNotNull() & F.col("digest").isNull() & F.lit(whole)).alias("dead"), F.count_if(F.col("was") == F.col("digest")).alias("same")).head().asDict()
        if not (counts["new"] or counts["changed"] or counts["dead"]):
            return counts
        state = dict(held)
        if counts["changed"] or counts["dead"]:
            state = self.buried(state, gone)
        if counts["new"] or counts["changed"]:
            state = self.added(state, rows.join(fresh.select("doc_id"), "doc_id", "left_semi"), fresh, staging)
        self.committed(state)
        return counts

    def delete(self, doc_ids: DataFrame) -> None:
        """These documents (doc_id) die."""
        held = self.state()
        gone = self.live_docs(held).join(doc_ids.select(F.col("doc_id").cast("string").alias("doc_id")).distinct(), "doc_id", "left_semi")
        if not gone.isEmpty():
            self.committed(self.buried(dict(held), gone))

    def committed(self, state: dict) -> dict:
        """The state as the next version, with its terms' frequencies summed once for all readers."""
        name = f"v{uuid.uuid4().hex}"
        grown, died = self.table(state, "segments", "terms", "term string, df long"), self.table(state, "deaths", "terms", "term string, df long")
        terms = grown.unionByName(died.withColumn("df", -F.col("df"))).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        sparse.vocabulary_of(terms, state["n"]).sortWithinPartitions("term").write.parquet(f"{self.path}/parts/{name}")
        mean = self.spark.read.parquet(f"{self.path}/parts/{name}").agg(F.avg("raw").alias("mean")).head().mean
        made = manifests.commit(self.spark, self.path, state | {"vocabulary": name, "mean": mean or 0.0, "parts": [*state["segments"], *state["deaths"], name]})
        manifests.swept(self.spark, self.path, "parts", set(made["parts"]))
        return made

    def buried(self, state: dict, gone: DataFrame) -> dict:
        """The state with the slots of these documents (doc_id, segment) dead, and their terms' counts, from the postings of their
        blocks."""
        name = f"d{uuid.uuid4().hex}"
        out = f"{self.path}/parts/{name}"
        gone.select("doc_id", "segment").write.parquet(f"{out}/docs")
        self.live_slots(state).join(self.spark.read.parquet(f"{out}/docs"), "doc_id", "left_semi").select("slot").write.parquet(f"{out}/slots")
        dead = self.spark.read.parquet(f"{out}/slots").select(F.floor(F.col("slot") / state["span"]).cast("long").alias("block"), F.pmod("slot", F.lit(state["span"])).cast("int").alias("at"))
        died = dead.groupBy("block").agg(F.collect_list("at").alias("ats"))  # a span at most
        none = [F.lit(None).cast(t).alias(c) for c, t in (("term", "string"), ("tfs", "array<int>"))]
        rows = self.blocks(state).select("term", "block", "ats", "tfs").unionByName(died.select("block", "ats", *none))
        dealt = rows.repartition(sparse.parts_of(state["next_block"] * state["span"]), "block").sortWithinPartitions("block", F.col("term").isNotNull())
        counted = dealt.select("term", "block", "ats", "tfs").mapInArrow(lambda batches: deaths_of(batches, state["span"]), "term string, df long, tokens long")
        counted.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tokens").alias("tokens")).write.parquet(f"{out}/terms")
        sums = self.spark.read.parquet(f"{out}/terms").agg(F.sum("tokens").alias("t")).head()
        return state | {"deaths": [*state["deaths"], name], "n": state["n"] - dead.count(), "tokens": state["tokens"] - (sums.t or 0)}

    def added(self, state: dict, rows: DataFrame, docs: DataFrame, staging: Staging) -> dict:
        """The state with a segment of these rows (doc_id, no, text), in slots after all others."""
        name, span = f"s{uuid.uuid4().hex}", state["span"]
        out, start = f"{self.path}/parts/{name}", state["next_block"] * span
        placed = positioned(rows, ["doc_id", "no"], "slot", staging).withColumn("slot", F.col("slot") + start)
        placed.select("slot", "doc_id", "no").write.parquet(f"{out}/slots")
        n = self.spark.read.parquet(f"{out}/slots").count()
        sparse.posting_blocks(placed.withColumnRenamed("slot", "chunk_pos"), n, span).write.parquet(f"{out}/blocks")
        docs.select("doc_id", F.lit(name).alias("segment"), "digest").write.parquet(f"{out}/docs")
        blocks = self.spark.read.parquet(f"{out}/blocks")
        blocks.groupBy("term").agg(F.sum("n").alias("df")).write.parquet(f"{out}/terms")
        tokens = blocks.agg(F.sum("tokens").alias("t")).head().t or 0
        return state | {"segments": [*state["segments"], name], "next_block": state["next_block"] - (-n // span), "n": state["n"] + n, "tokens": state["tokens"] + tokens}

    def compact(self) -> None:
        """One segment in place of all, without what died. Postings are filtered where they are; nothing is tokenised."""
        held = self.state()
        if len(held["segments"]) < 2 and not held["deaths"]:
            return
        name = f"s{uuid.uuid4().hex}"
        out = f"{self.path}/parts/{name}"
        self.live_slots(held).write.parquet(f"{out}/slots")
        self.live_docs(held).select("doc_id", F.lit(name).alias("segment"), "digest").write.parquet(f"{out}/docs")
        live = F.filter(F.arrays_zip("ats", "tfs", "dls"), lambda e: F.col("gone").isNull() | ~F.array_contains("gone", e["ats"]))
        rows = self.blocks(held).join(self.dead(held).withColumnRenamed("ats", "gone"), "block", "left").select("term", "block", live.alias("e")).where(F.size("e") > 0)
        sizes = [F.size("e").cast("long").alias("n"), F.aggregate("e.tfs", F.lit(0).cast("long"), lambda a, x: a + x).alias("tokens"), F.array_max("e.tfs").alias("max_tf"), F.array_min("e.dls").alias("min_dl")]
        made = rows.select("term", "block", *sizes, F.col("e.ats").alias("ats"), F.col("e.tfs").alias("tfs"), F.col("e.dls").alias("dls"))
        made.repartitionByRange("block", "term").sortWithinPartitions("term", "block").write.parquet(f"{out}/blocks")
        self.spark.read.parquet(f"{out}/blocks").groupBy("term").agg(F.sum("n").alias("df")).write.parquet(f"{out}/terms")
        self.committed(held | {"segments": [name], "deaths": []})

    # --- reading ---

    def dead(self, held: dict) -> DataFrame:
        slots = self.table(held, "deaths", "slots", "slot long")
        return slots.groupBy(F.floor(F.col("slot") / held["span"]).cast("long").alias("block")).agg(F.collect_list(F.pmod("slot", F.lit(held["span"])).cast("int")).alias("ats"))

    def index(self, chunks: DataFrame | None = None) -> sparse.TermIndex:
        """The index as it is now. With the corpus' chunks its rows carry their chunk_pos, without it the slots."""
        held = self.state()
        schema = "term string, df long, raw double"
        name = held.get("vocabulary")
        vocabulary = self.spark.read.schema(schema).parquet(f"{self.path}/parts/{name}") if name else self.spark.createDataFrame([], schema)
        slots = self.live_slots(held)
        numbers = None
        if chunks is not None:
            now = self.with_no(chunks).select("doc_id", "no", F.col("chunk_pos").cast("long").alias("chunk_pos"))
            numbers = slots.join(now, ["doc_id", "no"]).select("slot", "chunk_pos")
        positions = numbers.select("chunk_pos") if numbers is not None else slots.select(F.col("slot").alias("chunk_pos"))
        return sparse.TermIndex(self.blocks(held), vocabulary, positions, held["n"], held["tokens"] / max(held["n"], 1), held.get("mean", 0.0), held["span"], self.dead(held) if held["deaths"] else None, numbers)
