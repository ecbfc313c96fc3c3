"""Schemas of what the store keeps."""

from __future__ import annotations

#: One mutation. ``part`` is the partition column: "c_" and the collection's name, since bare names may look like numbers.
LOG = "part string, collection string, batch bigint, pos bigint, op string, id string, doc string, fields map<string,string>"


def part_of(collection: str) -> str:
    return f"c_{collection}"
