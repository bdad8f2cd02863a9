"""Schemas of the event log and of the tables derived from it."""

from __future__ import annotations

CHUNK = "struct<offset:bigint,length:bigint,hash:binary>"
LOG = (
    "seq long, kind string, at long, v int, path string, from_path string, to_path string, size long, mtime_us long, root_hash binary, "
    f"chunks array<{CHUNK}>, files long, bytes long, duration_us long, files_done long, bytes_done long, current_path string, "
    "total_files long, total_bytes long, patterns array<string>, mode string"
)
FILES = "id long, path string, size long, mtime_us long, root_hash binary, deleted_at_us long, indexed_at_us long"
FILE_CHUNKS = "file_id long, ordinal int, offset long, length long, chunk_hash binary"
LOCATIONS = "id long, path string, added_at_us long, removed_at_us long, scan_started_at_us long, last_scanned_at_us long, ignore_patterns array<string>, index_mode string"
SCAN = "path string, size long, mtime_us long"

CONTENT_KINDS = ("file_indexed", "file_modified")
FILE_KINDS = (*CONTENT_KINDS, "file_moved", "file_deleted")
LOCATION_KINDS = ("location_added", "location_removed", "location_scan_started", "location_scan_completed", "location_ignore_set", "location_mode_set")
KINDS = (*FILE_KINDS, *LOCATION_KINDS, "location_scan_progress")
MODES = ("shallow", "content")
SORTS = ("path", "size", "mtime_us", "indexed_at_us")


def columns(ddl: str) -> list[str]:
    """Column names of a DDL string."""
    out, depth, word = [], 0, ""
    for c in ddl + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(word.split()[0])
            word = ""
        else:
            word += c
    return out


def one_of(value: str, allowed: tuple[str, ...], what: str) -> str:
    if value not in allowed:
        raise ValueError(f"{what} must be one of {', '.join(allowed)}, not {value!r}")
    return value
