"""Declared schemas of every table that the engine reads or writes."""

from __future__ import annotations

from pyspark.sql.types import StructType

_ENTRY = "site string, page_url string, pos int, depth int, url string, canon string, name string, is_dir boolean, size bigint, mtime timestamp, unknown boolean, origin string"
_PAGES = "site string, url string, html string, fetched_at timestamp"
_SITE = "slug string, url string, urls array<string>, title string, max_depth int, max_file_bytes bigint, max_files int, include string, exclude string, follow_external boolean, note string"
_SITES = f"defaults struct<{_SITE}>, sites array<struct<{_SITE}>>"
_CAPTURE = "kind string, name string, url string, date string, size string"
#: Reports are read as text and cast leniently; these are the types after it.
_MANIFEST = "url string, local_path string, name string, size bigint, sha256 string, status string, remote_mtime timestamp, http_status int, content_type string, dupe_of string, dupe_method string, error string, duration_s double"
_DUPLICATES = "sha256 string, size bigint, kept_url string, kept_path string, duplicate_url string, duplicate_path string, method string, action string"
_CANDIDATES = "`group` string, size bigint, name_similarity double, kept_name string, kept_url string, candidate_name string, candidate_url string, reason string"
_RECORD = "local_path string, size bigint, sha256 string, name string, remote_mtime string, etag string, last_modified string, content_type string, head string, tail string, fetched_at string, listed_size bigint, duplicate_of string, dedupe_method string"
_STATE = f"site string, updated string, files map<string,struct<{_RECORD}>>"
_SUMMARY = "site string, url string, title string, note string, entry_urls array<string>, started string, finished string, elapsed_s double, listing_pages bigint, documents_discovered bigint, documents_fetched bigint, documents_bytes bigint, bytes_downloaded_this_run bigint, duplicates bigint, duplicate_bytes_collapsed bigint, candidate_duplicates bigint, errors bigint, status_counts map<string,bigint>, dry_run boolean"
_COPY = "site string, sha256 string, size bigint, duplicate_url string, duplicate_path string, kept_url string, kept_path string, method string, action string"
_GLOBAL = f"sites array<struct<{_SUMMARY}>>, totals map<string,bigint>, duplicate_groups map<string,array<struct<{_COPY}>>>"
_ERRORS = "url string, stage string, error string"
STATUSES = ("downloaded", "duplicate", "unchanged", "skipped", "dry_run", "error")
REPORT_FILES = ("manifest.csv", "manifest.json", "summary.json", "state.json", "duplicates.csv", "candidate_duplicates.csv", "errors.log")


def __getattr__(name: str) -> StructType:
    """MANIFEST, STATE and so on, made when first asked for: DDL needs a running session."""
    ddl = globals().get(f"_{name}")
    if name.startswith("_") or not isinstance(ddl, str):
        raise AttributeError(name)
    return globals().setdefault(name, StructType.fromDDL(ddl))
