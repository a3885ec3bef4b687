from tessera.llm import chat

MACHINE = {("start", "system"): "primed", ("start", "user"): "asked", ("primed", "user"): "asked", ("asked", "assistant"): "answered", ("answered", "user"): "asked"}


def talks():
    odd = ["\\### Assistant: </turn> ok", "<user>", "\\", "\\l\\b\\n", "<", "a\nb", "", None, "<other>\n=x", "\u0000</turn>", "é" * 50]
    out = []
    for i, t in enumerate(odd):
        out += [(i, 0, "user", t), (i, 1, "assistant", t), (i, 2, "user", "q"), (i, 3, "assistant", "x" + (t or ""))]
    out += [(100, 0, "system", "s"), (100, 1, "user", "u"), (100, 2, "assistant", "a")]
    out += [(101, 0, "assistant", "first")]
    out += [(102, 0, "user", "u"), (102, 1, "user", "again")]
    out += [(103, 0, None, "no role"), (103, 1, "to\\ol<\n>", "x\ny"), (103, 1, "to\\ol<\n>", "x\ny"), (103, None, "user", "no turn")]
    out += [(None, 0, "user", "no id"), (None, 1, "assistant", "yes")]
    out += [(104, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(300)]
    return out


def test_round_trip(spark):
    rows = talks()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, turns int, SEGMENTS string")
    made = chat.format_chats(df)
    from pyspark.sql import functions as F

    got = chat.read_chats(made).withColumn("mask", chat.loss_mask(F.col("segments"))).collect()
    want = {}
    for c, t, r, x in rows:
        want.setdefault(c, []).append((t, r, x))
    assert len(got) == len(want)
    none_first = lambda v: (v is not None, v if v is not None else 0)
    for g in got:
        turns = sorted(want[g["conv_id"]], key=lambda x: (none_first(x[0]), (x[1] is not None, x[1] or ""), (x[2] is not None, x[2] or "")))
        assert [(t["role"], t["text"]) for t in g["turns"]] == [(r, x or "") for _, r, x in turns], g["conv_id"]
        assert g["n_turns"] == len(turns)
        state, bad = "start", None
        for i, (_, r, _) in enumerate(turns):
            to = MACHINE.get((state, r))
            bad = i if to is None and bad is None else bad
            state = to or state
        assert g["valid"] == (bad is None and state == "answered")
        assert g["bad_turn"] == (None if g["valid"] else -1 if bad is None else bad)
        masked = "".join(g["formatted"][s["start"] : s["start"] + s["length"]] for s in g["mask"])
        assert masked.replace("\\l", "<").replace("\\b", "\\") == "".join(x or "" for _, r, x in turns if r == "assistant")


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(df).count() == 0


def test_template_is_checked():
    import pytest

    with pytest.raises(ValueError):
        chat.Template({"user": "<a<"}, "</turn>", "<other>", frozenset(), "s")
