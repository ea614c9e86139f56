"""Files of other places kept in a folder, and libraries that may be absent."""

from __future__ import annotations

import hashlib
import importlib
import json
import os
import tempfile
import urllib.request
from types import ModuleType


def optional(name: str) -> ModuleType | None:
    """A library, or None where it is not installed."""
    try:
        return importlib.import_module(name)
    except ImportError:
        return None


def needed(name: str, purpose: str) -> ModuleType:
    """A library; RuntimeError that says what it is for where it is not installed."""
    found = optional(name)
    if found is None:
        raise RuntimeError(f"{purpose} needs {name}, which is not installed")
    return found


def cached_file(url: str, folder: str, timeout: float = 60.0) -> str:
    """The path of a copy of what a URL names, fetched where the folder has none for its present ETag.

    Names are as ``functions.paths.cached_name`` makes them; beside each lies a JSON file with url and etag. A copy is
    complete or absent: it is written under another name first. OSError where the URL can't be had.
    """
    os.makedirs(folder, exist_ok=True)
    with urllib.request.urlopen(urllib.request.Request(url, method="HEAD"), timeout=timeout) as answer:
        etag = answer.headers.get("ETag")
    name = hashlib.sha256(url.encode()).hexdigest() + ("." + hashlib.sha256(etag.encode()).hexdigest() if etag else "")
    path = os.path.join(folder, name)
    if not os.path.exists(path):
        with urllib.request.urlopen(url, timeout=timeout) as answer, tempfile.NamedTemporaryFile(dir=folder, delete=False) as part:
            while piece := answer.read(1 << 20):
                part.write(piece)
        with open(f"{path}.json", "w", encoding="utf-8") as f:
            json.dump({"url": url, "etag": etag}, f)
        os.replace(part.name, path)
    return path
