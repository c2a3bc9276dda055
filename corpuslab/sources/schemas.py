"""Schemas of the pipeline's tables, as DDL."""

from __future__ import annotations

DIAGRAM = "struct<diagram_index: int, box_2d: array<double>, description: string, labels: array<string>>"
NAMED = "struct<theorems: array<string>, definitions: array<string>, vocabulary: array<struct<term_ar: string, term_en: string>>, standards: array<string>>"
BLOCK = f"struct<block_index: int, content_type: string, heading_ar: string, problem_numbers: array<int>, text_ar: string, math_expressions: array<string>, diagrams: array<{DIAGRAM}>, named_elements: {NAMED}, continues_to_next_page: boolean, continued_from_prev_page: boolean>"
PAGE = f"book string, page_number int, unit_number int, unit_title_ar string, lesson_number string, lesson_title_ar string, lesson_title_en string, standard string, content_blocks array<{BLOCK}>"
OCR_PAGE = "book string, page_number int, text string"
MANIFEST = "book string, page_number int, diagram_index int, diagram_type string, description string, local_path string, cloudinary_url string"
CER_SHEET = "page int, block int, ground_truth string, vlm_text string, ocr_text string"
JUDGE_SCORE = "qa_id string, system string, metric string, judge_status string, score double, retries_used int, raw_response string, line long"

#: Table names of a run's artifacts, by stage.
ARTIFACTS = {
    "ingest": ("pages", "bbox", "manifest", "chunks", "embedding_texts", "provenance", "vectors"),
    "qa": ("tasks", "candidates", "validated", "rejected", "dataset", "gold_proposed", "gold_b1", "gold_b2", "unmapped", "summary"),
    "retrieval": ("records", "summary", "comparison"),
    "judge": ("scores", "calls", "summary", "comparison", "manifest"),
}
