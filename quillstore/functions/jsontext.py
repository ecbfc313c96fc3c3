"""Exact JSON text: strict reading, canonical writing, dotted paths.

Numbers keep the text they were written with, object keys keep their order, and a present null
differs from a missing field. Python's own scanner does the reading; hooks keep what it would lose, and
one walk over the result refuses what it would let pass: repeated keys, lone surrogates, NaN and
the infinities, and values under more than ``MAX_DEPTH`` containers.
"""

from __future__ import annotations

import json
import re

# Fixed values of the data model.
MAX_DEPTH = 64
MAX_DOC_BYTES = 16_777_216
#: Longer texts can't be asked for over HTTP, so they are left out of the flattened fields.
MAX_FIELD_BYTES = 16_384


class JsonTextError(ValueError):
    """The text isn't one acceptable JSON value."""


class Number(str):
    """A number, as written."""


class Members(tuple):
    """An object: (key, value) pairs in order."""

    def get(self, key: str):
        """The value of ``key``, or ``MISSING``."""
        return next((v for k, v in self if k == key), MISSING)


MISSING = object()


def _members(pairs):
    if len({k for k, _ in pairs}) < len(pairs):
        raise JsonTextError("an object names a key twice")
    return Members(pairs)


def _no_constant(name):
    raise JsonTextError(f"{name} is no JSON number")


_decoder = json.JSONDecoder(object_pairs_hook=_members, parse_int=Number, parse_float=Number, parse_constant=_no_constant)
_BLANK = " \t\n\r"
_SURROGATE = re.compile("[\ud800-\udfff]")


def parse(text: str):
    """The value of ``text``; JsonTextError if it is anything but one value between white space."""
    try:
        value, end = _decoder.raw_decode(text, len(text) - len(text.lstrip(_BLANK)))
    except RecursionError:
        raise JsonTextError("nested too deeply") from None
    except json.JSONDecodeError as e:
        raise JsonTextError(f"{e.msg} at character {e.pos}") from None
    if text[end:].strip(_BLANK):
        raise JsonTextError(f"more text after the value at character {end}")
    layer, depth = [value], 0
    while layer:
        if depth > MAX_DEPTH:
            raise JsonTextError("nested too deeply")
        below = []
        for v in layer:
            if isinstance(v, Members):
                for k, item in v:
                    if _SURROGATE.search(k):
                        raise JsonTextError("a key holds half a surrogate pair")
                    below.append(item)
            elif isinstance(v, list):
                below += v
            elif isinstance(v, str) and _SURROGATE.search(v):
                raise JsonTextError("a string holds half a surrogate pair")
        layer, depth = below, depth + 1
    return value


# The escapes that the canonical form has names for; other control characters are \u00xx.
_NAMED = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
_TO_ESCAPE = re.compile(r'["\\\x00-\x1f]')


def quote(text: str) -> str:
    """``text`` as a JSON string."""
    return '"' + _TO_ESCAPE.sub(lambda m: _NAMED.get(m[0]) or f"\\u{ord(m[0]):04x}", text) + '"'


def write(value) -> str:
    """Canonical text: no white space, numbers as they came."""
    if value is None or value is True or value is False:
        return {None: "null", True: "true", False: "false"}[value]
    if isinstance(value, Number):
        return str(value)
    if isinstance(value, str):
        return quote(value)
    if isinstance(value, Members):
        return "{" + ",".join(f"{quote(k)}:{write(v)}" for k, v in value) + "}"
    return "[" + ",".join(map(write, value)) + "]"


def at_path(value, path: str):
    """What a dotted path leads to through objects, or ``MISSING``."""
    for key in path.split("."):
        value = value.get(key) if isinstance(value, Members) else MISSING
        if value is MISSING:
            break
    return value


def comparable(value) -> str:
    """What a filter compares: a string's own text, else the canonical text."""
    return str(value) if isinstance(value, str) else write(value)


def matches(value, path: str, wanted: str) -> bool:
    found = at_path(value, path)
    return found is not MISSING and comparable(found) == wanted


def flatten(value: Members, longest: int = MAX_FIELD_BYTES) -> dict[str, str]:
    """Every addressable path with its comparable text; those longer than ``longest`` bytes are left out."""
    found: dict[str, str] = {}

    def visit(members: Members, prefix: str) -> None:
        for key, item in members:
            if "." in key:
                continue
            text = comparable(item)
            if len(text) <= longest and len(text.encode()) <= longest:
                found[prefix + key] = text
            if isinstance(item, Members):
                visit(item, prefix + key + ".")

    visit(value, "")
    return found
