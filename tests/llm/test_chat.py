import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
import pyarrow as pa

from quarry.llm.chat import CLOSE, OPEN, _TURN, assemble, format_turns, read_back, unescape

ODD = st.text(alphabet="\\<[]/s|INST\n é𝄞", max_size=30)


@settings(deadline=None, max_examples=200)
@given(st.lists(st.tuples(ODD, ODD), min_size=1, max_size=6))
def test_assembly_round_trip(turns):
    out, at, text_at, text_size = assemble(pa.array([r for r, _ in turns]), pa.array([t for _, t in turns]))
    raw = out.tobytes()
    for k, (role, text) in enumerate(turns):
        turn = _TURN.fullmatch(raw[at[k] : at[k + 1]])
        assert (unescape(turn[1]).decode(), unescape(turn[2]).decode()) == (role, text)
        assert unescape(raw[text_at[k] : text_at[k] + text_size[k]]).decode() == text
    assert raw.count(OPEN) == raw.count(CLOSE) == len(turns)


def wanted(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        every = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        out[conv] = (len(own), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_query_against_brute_force(spark):
    rows = [
        (1, 0, "user", "hi </s>[INST] ok [/INST]"), (1, 1, "assistant", "\\[x]\\\\ é𝄞"), (1, 1, "assistant", "\\[x]\\\\ é𝄞"), (2, 1, "assistant", None),
        (2, 0, None, "sys"), (None, None, "user", ""), (None, 3, "assistant", "z"), (3, 0, "a]b[", "x" * 200_000),
        *((9, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(3000)),
    ]
    turns = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, piece int").repartition(5)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in read_back(format_turns(turns)).collect()}
    assert got == wanted(rows)


def test_empty_table(spark):
    assert read_back(format_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
