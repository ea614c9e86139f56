"""Media locations: kinds of URL, data URLs, fingerprints and cache keys."""

from __future__ import annotations

import base64
import hashlib
import json
import mimetypes
import os
import urllib.parse
import urllib.request

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_path(url: Column) -> Column:
    """The path of a file: URL or of plain text; null for http, https and data URLs."""
    return (
        F.when(F.startswith(url, F.lit("file://")), F.try_url_decode(F.regexp_replace(F.regexp_replace(url, r"^file://[^/]*", ""), r"\+", "%2B")))
        .when(F.startswith(url, F.lit("http://")) | F.startswith(url, F.lit("https://")) | F.startswith(url, F.lit("data:")), F.lit(None).cast("string"))
        .otherwise(url)
    )


def mime_type(path: Column) -> Column:
    """By extension, video/mp4 if unknown."""
    known = {".mp4": "video/mp4", ".webm": "video/webm", ".mov": "video/quicktime", ".avi": "video/x-msvideo", ".mkv": "video/x-matroska", ".wav": "audio/x-wav", ".mpeg": "video/mpeg"}
    kinds = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(F.try_element_at(kinds, F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))), F.lit("video/mp4"))


def data_url(content: Column, path: Column) -> Column:
    """Bytes as a data: URL, without the line breaks that base64 inserts."""
    return F.concat(F.lit("data:"), mime_type(path), F.lit(";base64,"), F.regexp_replace(F.base64(content), r"[\r\n]", ""))


def local_file(url: str) -> str:
    """The path that a file: URL names, its escapes resolved and its host left out; other text as it is."""
    return urllib.request.url2pathname(urllib.parse.urlparse(url).path) if url.startswith("file://") else url


def file_data_url(path: str) -> str:
    """The same for one file of the machine that asks: media must lie in a folder that all executors see. FileNotFoundError if it is missing."""
    with open(path, "rb") as f:
        return f"data:{mimetypes.guess_type(path)[0] or 'video/mp4'};base64,{base64.b64encode(f.read()).decode()}"


def fingerprint(path: str) -> dict:
    at = os.stat(path)
    return {"path": os.path.realpath(path), "mtime_ns": at.st_mtime_ns, "size": at.st_size}


def cache_key(parts: dict) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()[:16]


def cache_key_column(*columns: str) -> Column:
    """The same for rows: the columns as JSON in the order of their names."""
    return F.substring(F.sha2(F.to_json(F.struct(*sorted(columns))), 256), 1, 16)


def cached_name(url: Column, etag: Column) -> Column:
    """Name of a cached download: hash of the URL, and of its etag if there is one."""
    return F.concat(F.sha2(url, 256), F.coalesce(F.concat(F.lit("."), F.sha2(etag, 256)), F.lit("")))


def extension(path: Column, dot: bool = True, lower: bool = True) -> Column:
    found = F.regexp_extract(path, r"(\.[^./]+)$" if dot else r"\.([^./]+)$", 1)
    return F.lower(found) if lower else found
