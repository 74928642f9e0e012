"""JSON paths and content signatures."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

SIGNATURE_HEX_DIGITS = 16


def json_path(raw: Column | str, path: str) -> Column:
    """One value out of a JSON document by ``$.a.b`` path (NULL when absent).

    Every call re-parses the document, so hot paths are better kept as their
    own column at write time.
    """
    c = F.col(raw) if isinstance(raw, str) else raw
    return F.get_json_object(c, path)


def content_signature(*names: str) -> Column:
    """First 16 hex digits of SHA-256 over canonical JSON of the named columns.

    Canonical means keys in sorted order, compact separators, UTF-8 text
    (``to_json`` writes non-ASCII characters as they are).
    """
    ordered = [F.col(n).alias(n) for n in sorted(names)]
    return F.substring(F.sha2(F.to_json(F.struct(*ordered)), 256), 1, SIGNATURE_HEX_DIGITS)


def config_signature(material: dict[str, Any]) -> str:
    """Signature of an extractor configuration (a driver-side constant)."""
    text = json.dumps(material, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    return hashlib.sha256(text.encode("utf-8")).hexdigest()[:SIGNATURE_HEX_DIGITS]
