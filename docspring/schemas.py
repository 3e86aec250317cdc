"""Row types of the engine, as Spark schemas. Pages are counted from 0; boxes have their origin at the top left."""

BBOX = "page_index int, x0 double, y0 double, x1 double, y1 double"
PAGES = "doc_id string, page_index int, text string"
SPANS = f"doc_id string, span_id string, {BBOX}, text string, extractor string, metadata map<string,string>"
TABLES = f"doc_id string, table_id string, {BBOX}, extractor string, rows array<array<string>>, as_markdown string, as_csv string, as_html string, as_json array<map<string,string>>, summary string, text_above_id string, text_below_id string, metadata map<string,string>"
IMAGES = f"doc_id string, xref bigint, {BBOX}, mime_type string, width_px int, height_px int, content binary, caption string, caption_model string, text_above_id string, text_below_id string, contextual_snippet_above string, contextual_snippet_below string"
NOTES = "doc_id string, stage string, note string"
CHUNKS = (
    "chunk_pos bigint, chunk_id string, text string, page_start int, page_end int, source string, structure_note string, content_type string, "
    "section_hint string, chunk_kind string, table_id string, table_csv_preview string, image_xref bigint, embedding array<float>"
)
HITS = "query_id string, rank int, chunk_id string, text string, score double, metadata map<string,string>"
PATCHES = (
    "patch_id string, pdf_sha256 string, source_filename string, page_index int, row_index int, col_index int, x0_px int, y0_px int, width_px int, height_px int, "
    "pixmap_page_width int, pixmap_page_height int, dpi double, patch_size_px int, stride_px int, mime string, png_len int"
)
CACHE = "embedding array<double>, answer string, created_ts double"
GOLD_ROWS = "question string, ground_truth_context string, ground_truth_answer string, page_number string, context_content_type string"
EVAL_ROWS = f"{GOLD_ROWS}, generated_answer string, retrieved_contexts array<string>, notes array<string>"
JUDGE = "factual_alignment_with_reference int, completeness_vs_reference int, handling_of_visual_or_numeric_claims int, clarity int, overall int"

CHUNK_KINDS = ("narrative", "pdf_table", "pdf_image")
