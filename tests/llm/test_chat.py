import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, start string"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="\\#<>/turn: \n</a\U0001f600"), st.text(alphabet="user:\\# \n"))
def test_escape_round_trip(text, role):
    segment = chat.OPEN + chat.escape(role) + chat.MIDDLE + chat.escape(text) + chat.CLOSE
    assert chat.parse_segment(segment) == (role, text)
    assert re.sub(r"(?s)\\.", "", segment).count("</turn>") == 1


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
        digest = hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own).encode()).hexdigest()
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        out[conv] = (len(own), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_cases(spark):
    rows = [(1, 1, "assistant", "b\\", "x"), (1, 0, "user", None, "x"), (1, 2, "assistant", "### assistant: </turn>", "x"), (2, 0, "user", "only", "x"), (None, 0, None, "n", "x"), (3, None, "assistant", "a" * 100_000 + "\\###", "x"), (4, 0, "assistant", "same", "x"), (4, 0, "assistant", "same", "x"), (4, 0, "user", "", "x")]
    segments = chat.format_turns(spark.createDataFrame(rows, SCHEMA))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(segments).collect()}
    assert got == brute(rows)


def test_examples_are_prefixes(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "a: 1"), (1, 3, "user", "r"), (1, 4, "assistant", "b"), (2, 0, "user", "no reply")]
    segments = chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    full = {(r.conv_id, r.example): r for r in chat.render(segments).collect()}
    assert sorted(full) == [(1, 0), (1, 1)]
    assert full[1, 1].text.startswith(full[1, 0].text)
    assert [chat.unescape(full[1, k].text[full[1, k].loss_start : full[1, k].loss_stop]) for k in (0, 1)] == ["a: 1", "b"]
    assert {(r.example, r.n_chars) for r in chat.examples(segments).collect()} == {(k, len(full[1, k].text)) for k in (0, 1)}


def test_empty(spark):
    assert chat.read_back(chat.format_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_mask_is_read_from_examples(spark, monkeypatch):
    """Each assistant turn is an example with its context and its reply; an expansion that loses them leaves no text under the mask."""
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a: 1"), (1, 2, "user", "r"), (1, 3, "assistant", "")]
    segments = chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    full = {r.example: r for r in chat.render(segments).collect()}
    told = {r.example: r for r in chat.expand(segments).where("segment IS NULL").collect()}
    assert sorted(told) == [0, 1]
    assert all(told[k].n_chars == len(full[k].text) and full[k].text[told[k].context_chars :].startswith(chat.escape(("a: 1", "")[k])) for k in (0, 1))
    assert chat.read_back(segments).first().loss_chars == 4
    plain = chat.expand
    monkeypatch.setattr(chat, "expand", lambda s: plain(s).where("segment IS NOT NULL"))
    r = chat.read_back(segments).first()
    assert (r.n_turns, r.loss_chars, r.n_examples) == (4, 0, 0)
