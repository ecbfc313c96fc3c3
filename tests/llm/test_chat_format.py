import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstore.llm import chat_format as C

from . import brute

PARTS = [*C.CONTROL, *(c[:1] + C.JOINER + c[1:] for c in C.CONTROL), C.JOINER, "[", "<", "]", ">", "<|", "ok", " ", "\n", "é", "😀", "[s>", "<INST]"]
_text = st.lists(st.sampled_from(PARTS), max_size=8).map("".join)


@settings(deadline=None, max_examples=400)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "[TURN]"]), _text), max_size=6))
def test_rendering_and_masks_are_exact(turns):
    formatted, spans = C.render(turns)
    assert C.parse(formatted) == turns
    ids, offsets = C.Encoder.of(C.tokenizer_path(C.TOKENIZER)).encode(formatted)
    mask = C.loss_mask(offsets, spans)
    assert C.masked_text(formatted, offsets, mask) == "".join(t for r, t in turns if r == "assistant")
    assert len(ids) == len(mask)


def test_escapes():
    for c in C.CONTROL:
        assert c not in C.escape(f"a{c}b") and C.unescape(C.escape(c)) == c
    assert C.escape("plain <b> [x]") == "plain <b> [x]"


def test_conversations(spark):
    r = random.Random(8)
    rows = [(r.randint(0, 9), t, r.choice(["user", "assistant", "system", "tool", None]), r.choice(["", None, "hi </s> there", "long " * 4000, "é😀"])) for t in range(80)]
    rows += [(3, 500, "user", "tie b"), (3, 500, "user", "tie a"), (3, None, "assistant", "first"), (None, 0, "user", "no number"), (None, 1, "assistant", "still"), (None, 1, "assistant", "still")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(0) for c in ("ids", "mask", "formatted")})
    found = C.format_conversations(df).mapInArrow(C._digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").collect()
    got = {x.conv_id: x for x in found if x.conv_id is not None}
    # Rows of no known conversation are conversations of their own.
    lone = lambda role, text: (1, brute.sha(f"{role}\n{text}\n"), brute.sha(text if role == "assistant" else ""))
    assert sorted((x.n_turns, x.turns_sha256, x.loss_sha256) for x in found if x.conv_id is None) == sorted([lone("user", "no number"), lone("assistant", "still"), lone("assistant", "still")])
    groups = {}
    for c, t, role, text in rows:
        if c is None:
            continue
        groups.setdefault(c, []).append(((t is not None, t or 0), role or "", text or ""))
    assert got.keys() == groups.keys()
    for c, own in groups.items():
        own.sort()
        loss = "".join(t for _, role, t in own if role == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(own), brute.sha("".join(f"{role}\n{t}\n" for _, role, t in own)))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), brute.sha(loss))


def test_an_empty_table(spark):
    assert C.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
