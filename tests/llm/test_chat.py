import hashlib
import random

import pytest

from triage.llm import chat

TURNS = "conv_id bigint, turn bigint, role string, text string, block bigint, piece int, n_turns string, _long int"
SAID = ["", "ok", "</s>", "[INST] a [/INST]", "<\\s>", "[\\\\/INST]", "[TURN] x [AS] y [/TURN]\n", "é€𝄞 [/SYS]\n", "<s", "\\", "[", " ", "a\nb", "<<s>>"]


def brute(rows):
    found = {}
    for conv, turn, role, text in rows:
        found.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in found.items():
        turns.sort(key=lambda t: (*t[:2], t[2].encode(), t[3].encode()))
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], TURNS)


@pytest.mark.parametrize("block_turns", [2, 64])
def test_read_back_like_brute_force(spark, block_turns):
    rnd = random.Random(block_turns)
    roles = ["user", "assistant", "system", None, "", "tool", "[AS] </s>"]
    rows = [(c, t, rnd.choice(roles), rnd.choice(SAID) + rnd.choice(SAID)) for c in range(40) for t in range(rnd.randint(1, 9))]
    rows += [(50, t, "assistant", f"turn {t} </s>") for t in range(500)]  # one conversation is a hot key
    rows += [(None, 0, "user", "no id"), (51, None, "user", None), (51, None, "assistant", "x"), (51, -3, None, "y"), (52, 0, "user", "z" * 70_000 + "[INST]"),
             (53, 0, "assistant", "same"), (53, 0, "assistant", "same"), (54, 10**12, "assistant", "far")]
    got = chat.digests(frame(spark, rows).repartition(5), block_turns).collect()
    assert {r.conv_id: tuple(r)[1:5] for r in got} == brute(rows) and len(got) == len(brute(rows))


def test_parts_hold_whole_turns_and_masks(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"{t} [INST] é") for t in range(10)]
    parts = chat.format_chats(frame(spark, rows), block_turns=4, slice_bytes=30).orderBy("block", "piece").collect()
    assert len(parts) > 3 and sum(p.n_turns for p in parts) == 10
    assert [t for p in parts for t in chat.read_turns(p.text)] == [(r, s) for *_, r, s in rows]
    marked = [chat.restored(p.text[a:b]) for p in parts for a, b in zip(p.loss_start, p.loss_end)]
    assert marked == [s for *_, r, s in rows if r == "assistant"]


@pytest.mark.parametrize("text", [a + b + c for a in SAID for b in SAID[:8] for c in ("", "s>", "/INST]")])
def test_escapes_are_reversible_and_leave_no_mark(text):
    import re

    import pyarrow as pa

    hidden = chat.escaped(pa.array([text]))[0].as_py()
    assert chat.restored(hidden) == text and not re.search(r"[<\[]" + chat.CONTROL, hidden)


def test_no_turns(spark):
    assert chat.digests(frame(spark, [(1, 0, "user", "x")]).limit(0)).count() == 0
