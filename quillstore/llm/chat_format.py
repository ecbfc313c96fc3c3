"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with offsets, and its loss mask comes from
intersecting the sorted spans of assistant texts with the token spans by binary search. Control strings are
special tokens of the encoder, so no token straddles a text's end.

Template: ``[INST]user[/INST]``, ``<s>assistant</s>``, ``<<SYS>>system<</SYS>>``, and for any other role
``[ROLE]name[TURN]text[/ROLE]``. A control string inside a text (or a role's name) gets a word joiner (U+2060) after
its first character, one more if there are some already; taking one away restores the text exactly.

Rows are dealt by conv_id, sorted, and streamed, so a task holds one conversation at a time; memory
is bound by the longest conversation. Turns come by turn, then role, then text, nulls first. Null roles and texts are
empty. A row with a null conv_id belongs to no conversation that is known, so it is one of its own, with a null conv_id: however many
there are, they spread. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .token_counts import tokenizer_path

TOKENIZER = "byte_bpe_50k.json"
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER = ("[ROLE]", "[TURN]", "[/ROLE]")
CONTROL = tuple(sorted({*itertools.chain.from_iterable(MARKS.values()), *OTHER, "<|endoftext|>"}))
JOINER = "\u2060"

def _heads(joiners: str) -> str:
    """A control string's first character, where joiners (as a pattern) and the rest follow."""
    after = {h: "|".join(re.escape(c[1:]) for c in CONTROL if c[0] == h) for h in "[<"}
    return "|".join(rf"{re.escape(h)}(?={joiners}(?:{rest}))" for h, rest in after.items())


_ESCAPE = re.compile(_heads(f"{JOINER}*"))
_UNESCAPE = re.compile(f"({_heads(f'{JOINER}+')}){JOINER}")
_MARK = re.compile("|".join(re.escape(c) for c in sorted(CONTROL, key=len, reverse=True)))


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0] + JOINER, text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation as text, and the spans of its assistant texts."""
    parts: list[str] = []
    spans, at = [], 0
    for role, text in turns:
        text = escape(text)
        if role in MARKS:
            head, tail = MARKS[role]
        else:
            head, tail = OTHER[0] + escape(role) + OTHER[1], OTHER[2]
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(text)))
        parts += (head, text, tail)
        at += len(head) + len(text) + len(tail)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    heads = {head: role for role, (head, _) in MARKS.items()}
    turns, role, at = [], None, 0
    for mark in _MARK.finditer(formatted):
        piece = unescape(formatted[at : mark.start()])
        if mark[0] in heads:
            role = heads[mark[0]]
        elif mark[0] == OTHER[1]:
            role = piece
        elif mark[0] != OTHER[0]:
            turns.append((role, piece))
        at = mark.end()
    return turns


class Encoder:
    """Encodes with offsets. One lives in each worker process."""

    _by_path: dict[str, "Encoder"] = {}

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.add_special_tokens(list(CONTROL))

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in cls._by_path:
            cls._by_path[path] = cls(path)
        return cls._by_path[path]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and bounds of each token in code points."""
        found = self.tokenizer.encode(text, add_special_tokens=False)
        return np.array(found.ids, np.int32), np.array(found.offsets, np.int32).reshape(-1, 2)


def loss_mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """True for the tokens that lie in a span; both come sorted."""
    mask = np.zeros(len(offsets), bool)
    bounds = np.array(spans, np.int64).reshape(-1, 2)
    first = np.searchsorted(offsets[:, 1], bounds[:, 0], side="right")
    last = np.searchsorted(offsets[:, 0], bounds[:, 1], side="left")
    for a, b in zip(first.tolist(), last.tolist()):
        mask[a:b] = True
    return mask


def masked_text(formatted: str, offsets: np.ndarray, mask: np.ndarray) -> str:
    """The text of the tokens under the mask, unescaped run by run."""
    turns = np.flatnonzero(np.diff(np.r_[0, mask.astype(np.int8), 0]))
    return "".join(unescape(formatted[offsets[a, 0] : offsets[b - 1, 1]]) for a, b in turns.reshape(-1, 2).tolist())


SCHEMA = "conv_id long, formatted string, ids array<int>, bounds array<int>, mask array<boolean>"


def format_conversations(conversations: DataFrame, path: str | None = None) -> DataFrame:
    """Per conversation: conv_id, formatted, ids, bounds (begin and end of each token, in turn) and mask."""
    common.ship(conversations.sparkSession)
    path = path or tokenizer_path(TOKENIZER)
    # Numbers the rows that belong to no known conversation.
    lone = F.when(conversations["conv_id"].cast("long").isNull(), F.monotonically_increasing_id())
    rows = conversations.select(conversations["conv_id"].cast("long").alias("conv_id"), lone.alias("lone"), conversations["turn"].cast("long").alias("turn"), *[F.coalesce(conversations[c].cast("string"), F.lit("")).alias(c) for c in ("role", "text")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        each = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "lone", "role", "text"))))
        out: list[tuple] = []
        held = 0
        for (conv_id, _), group in itertools.groupby(each, key=lambda r: r[:2]):
            formatted, spans = render([r[2:] for r in group])
            ids, offsets = encoder.encode(formatted)
            out.append((conv_id, formatted, ids, offsets.ravel(), loss_mask(offsets, spans)))
            held += len(formatted)
            if held > 1 << 20:
                yield _batch(out)
                out, held = [], 0
        if out:
            yield _batch(out)

    return rows.repartition("conv_id", "lone").sortWithinPartitions("conv_id", "lone", "turn", "role", "text").mapInArrow(work, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_()))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["conv_id", "formatted", "ids", "bounds", "mask"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sha = lambda text: hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
    for batch in batches:
        rows = []
        for conv_id, formatted, bounds, mask in zip(*(batch.column(c) for c in ("conv_id", "formatted", "bounds", "mask"))):
            formatted = formatted.as_py()
            turns = parse(formatted)
            loss = masked_text(formatted, bounds.values.to_numpy().reshape(-1, 2), np.array(mask.values.to_numpy(zero_copy_only=False), bool))
            rows.append((conv_id.as_py(), len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(formatted)))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    formatted = format_conversations(common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))
    return formatted.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


_CONTROL_SQL = r"\[\x{2060}*(?:INST\]|/INST\]|ROLE\]|TURN\]|/ROLE\])|<\x{2060}*(?:s>|/s>|<SYS>>|</SYS>>|\|endoftext\|>)"
ORACLE = f"""
WITH c AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS lone, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, NULL, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '{_CONTROL_SQL}')) + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15
    ELSE 19 + length(role) + len(regexp_extract_all(role, '{_CONTROL_SQL}')) END AS chars FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id, lone
"""
