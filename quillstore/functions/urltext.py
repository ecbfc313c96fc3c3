"""Percent-decoding of request targets."""

from __future__ import annotations

import re

_PART = re.compile(rb"%([0-9A-Fa-f]{2})|%|[^%]+")


def percent_decoded(text: str, query: bool = False) -> str | None:
    """The decoded text; None for a bad escape or bytes that aren't UTF-8. In a query, ``+`` is a space."""
    raw = text.encode()
    parts = []
    for part in _PART.finditer(raw.replace(b"+", b" ") if query else raw):
        if part[0] == b"%":
            return None
        parts.append(bytes.fromhex(part[1].decode()) if part[1] else part[0])
    try:
        return b"".join(parts).decode()
    except UnicodeDecodeError:
        return None
