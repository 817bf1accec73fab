"""Explicit schemas of the stored tables, in DDL form (nothing is inferred)."""
CHUNKS = (
    "id string, title string, content string, category string, source_url string, source_type string, "
    "page_type string, breadcrumb string, content_hash string, section_heading string, keywords array<string>, "
    "chunk_index int, total_chunks int, page_number int, parent_page_id string, vector_id string, "
    "namespace string, embedding_model string, last_scraped_at timestamp, created_at timestamp, "
    "updated_at timestamp, synced_at timestamp")
VECTORS = ("id string, namespace string, embedding array<float>, meta struct<title:string,category:string,"
                  "source_url:string,content_hash:string,chunk_index:int,total_chunks:int>")
PAGES = ("id string, url string, title string, parent_url string, content_hash string, sync_status string, "
                "crawl_status string, crawl_depth int, chunk_count int, last_scraped_at timestamp, "
                "created_at timestamp, deleted_at timestamp")
FRONTIER = ("url string, depth int, priority int, status string, error string, created_at timestamp")
FAILURES = ("run_id string, url string, error_category string, error_details string, status_code int, "
                   "attempted_at timestamp")
RUNS = ("id string, status string, pages_crawled int, pages_skipped int, pages_failed int, "
               "chunks_created int, started_at timestamp, completed_at timestamp")
RETRIEVAL_LOG = ("id string, query string, intent string, confidence string, response_length int, "
                        "retrieval_ms int, total_ms int, cache_hit boolean, created_at timestamp")
RETRIEVAL_HITS = ("log_id string, hit_no int, chunk_id string, score double, source_url string")
CONVERSATIONS = ("id string, session_id string, user_message string, bot_response string, persona string, "
                        "language string, response_source string, is_unanswered boolean, feedback string, "
                        "created_at timestamp")
UNANSWERED = ("id string, conversation_id string, question_text string, language string, persona string, "
                     "tier string, resolved boolean, resolved_entry_id string, resolved_at timestamp, "
                     "created_at timestamp")
FEEDBACK = ("conversation_id string, session_id string, feedback string, created_at timestamp")
DOCUMENTS = ("id string, name string, version string, source_type string, document_hash string, "
                    "status string, is_active boolean, total_pages int, total_chunks int, total_tokens int, "
                    "namespace_distribution map<string,bigint>, created_at timestamp, updated_at timestamp")
CONFIG = ("key string, value string, updated_at timestamp")
EVENTS = ("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
