"""Schemas of the engine's tables. Files are read with these, never by inference."""

KNOWLEDGE_ITEMS = "id string, type string, category string, title string, content string, source_file string, line_number int, created_at timestamp, metadata map<string,string>, edges array<struct<type:string,target:string,direction:string>>, is_vectorized boolean, parent_id string, year int, version string"
FEEDBACK = "id long, question string, answer string, is_resolved boolean, suggested_content string, created_at timestamp, resolved_at timestamp"
FILE_VECTORS = "file_path string, content_hash string, vectors array<array<float>>, doc_count int, updated_at timestamp"
ASSETS = "asset_id string, file_name string, file_path string, file_size long, md5_hash string, sha256_hash string, mime_type string, category string, status string, error_message string, retry_count int, tags array<string>, security_level string, expiry_date timestamp, owner string, notes string, version int, parent_asset_id string, is_active boolean, created_at timestamp, updated_at timestamp, summary string"
EXPERIMENTS = "config_id string, config_name string, description string, chunk_size int, overlap_ratio double, splitter_type string, embedding_model string, vector_weight_bm25 double, vector_weight_tfidf double, vector_weight_faiss double, asset_ids array<string>, index_name string, is_shadow boolean, status string, created_at timestamp, updated_at timestamp"
QUESTIONS = "qa_id string, set_id string, question string, expected_answer string, relevant_asset_ids array<string>, relevant_chunk_ids array<string>, difficulty int, source string, created_at timestamp"
EVALUATIONS = "eval_id string, config_id string, set_id string, question string, retrieved_chunk_ids array<string>, expected_chunk_ids array<string>, hits int, hit_rate double, mrr double, score_distribution map<string,int>, k_value int, evaluated_at timestamp"
MAPPINGS = "mapping_id string, asset_id string, chunk_id string, chunk_index int, original_page_number int, original_line_start int, original_line_end int, original_bounding_box struct<x0:double,y0:double,x1:double,y1:double>, chunk_preview string, created_at timestamp"
TASKS = "task_id string, task_type string, asset_id string, config_id string, status string, progress double, input_params string, output_result string, error_message string, started_at timestamp, completed_at timestamp, created_at timestamp"
