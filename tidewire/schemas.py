"""Schemas of the stored tables, as DDL, and their natural keys."""

from __future__ import annotations

SCHEMAS = {
    "sources": "id int, slug string, name string, homepage string, enabled boolean, created_at timestamp, last_run_at timestamp, last_success_at timestamp, last_error string",
    "articles": "id bigint, source_id int, url string, discovered_url string, title string, intro string, author string, section string, keywords string, categories array<string>, image_url string, image_path string, image_width int, image_height int, published_at timestamp, first_seen_at timestamp, updated_at timestamp",
    "seen_urls": "url string, source_id int, status string, reason string, attempts int, first_seen_at timestamp, last_attempt_at timestamp",
    "ignored_images": "url string, source_id int, created_at timestamp",
    "http_cache": "url string, etag string, last_modified string, content_hash string, checked_at timestamp",
    "scrape_runs": "id bigint, source_id int, started_at timestamp, finished_at timestamp, candidates int, new_articles int, failed int, error string",
    "job_sources": "id int, slug string, name string, homepage string, enabled boolean, last_run_at timestamp, last_success_at timestamp, last_error string, last_count int",
    "jobs": "id bigint, source_id int, url string, title string, employer string, pay string, description string, location string, open_date date, close_date date, close_note string, pdf_url string, first_seen_at timestamp, last_seen_at timestamp, detail_fetched_at timestamp, removed_at timestamp",
    "candidates": "url string, key string, via string, title string, summary string, image_url string, published_at timestamp, author string, tags array<string>",
    "postings": "url string, title string, employer string, pay string, description string, location string, open_date date, close_date date, close_note string, pdf_url string, detail_url string, reference string",
}
KEYS = {"sources": "slug", "articles": "url", "seen_urls": "url", "ignored_images": "url", "http_cache": "url", "scrape_runs": "id", "job_sources": "slug", "jobs": "url"}
