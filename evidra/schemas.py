"""Fixed schemas of the exchanged records; nothing is inferred."""

from __future__ import annotations

BLOCK = "doc_id STRING, source_file STRING, block_id STRING, order_idx INT, block_type STRING, page_start INT, page_end INT, section_path STRING, text STRING, char_len INT, text_hash STRING, section_title STRING, section_id STRING, table_struct STRUCT<rows: ARRAY<ARRAY<STRING>>, header_rows: ARRAY<INT>>"
CHUNK = "chunk_id STRING, doc_id STRING, source_file STRING, chunk_idx INT, page_start INT, page_end INT, section_paths ARRAY<STRING>, section_ids ARRAY<STRING>, block_ids ARRAY<STRING>, block_types ARRAY<STRING>, overlap_tokens_requested INT, overlap_tokens_used INT, overlap_from_chunk_id STRING, prefix STRING, body STRING, text STRING, token_len_payload INT, text_hash STRING"
CORPUS = "chunk_id STRING, text STRING"
DOCUMENT = "doc_id STRING, pmid STRING, title STRING, abstract STRING, text STRING, journal STRING, year STRING, source STRING"
TASK_A = "id STRING, task STRING, question STRING, answer STRING, gold_evidence ARRAY<STRUCT<doc_id: STRING, chunk_id: STRING>>"
TASK_B = "id STRING, question STRING, required_slots STRING, slot_A STRING, slot_B STRING, slot_C STRING, slot_nuggets MAP<STRING, ARRAY<STRING>>, slot_evidence MAP<STRING, ARRAY<STRING>>"
ADVERSARIAL = "id STRING, base_id STRING, question STRING, adversarial_category STRING, target_response_type STRING, primary_failure_mode STRING, embedded_wrong_claim STRING, target_constraint STRING, nonsense_subtype STRING"
QRELS = "query_id STRING, doc_id STRING, relevance STRING"
HIT = "STRUCT<rank: INT, chunk_id: STRING, score: DOUBLE>"
TRACE_A = f"query_id STRING, question STRING, run STRING, mode STRING, gold_chunk_ids ARRAY<STRING>, retrieved ARRAY<{HIT}>"
TRACE_B = f"query_id STRING, question STRING, run STRING, required_slots STRING, slots ARRAY<STRUCT<label: STRING, gold_ids: ARRAY<STRING>>>, retrieved ARRAY<{HIT}>"
TRACE_DOC = f"query_id STRING, question STRING, run STRING, gold_docs ARRAY<STRING>, retrieved_chunks ARRAY<{HIT}>, retrieved_docs ARRAY<STRUCT<rank: INT, doc_id: STRING, score: DOUBLE>>"
GENERATION = "id STRING, question STRING, prompt STRING, raw_output STRING, answer_raw STRING, citations_raw ARRAY<STRING>, pred_answer STRING, citations ARRAY<STRING>, invalid_citations ARRAY<STRING>, num_citations INT, explicit_nic BOOLEAN, forced_nic_empty_retrieval BOOLEAN, forced_nic_no_valid_citations BOOLEAN, forced_not_in_context BOOLEAN, is_grounded BOOLEAN, final_status STRING, retrieved ARRAY<STRUCT<chunk_id: STRING, score: DOUBLE>>, contexts ARRAY<STRING>, context_ids ARRAY<STRING>, context_scores ARRAY<DOUBLE>, prompt_chars INT, prompt_words INT, prompt_token_est INT, llm_latency_s DOUBLE, llm_info MAP<STRING, STRING>, error STRING"
