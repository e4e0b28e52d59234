from tessera.llm.chat import CONTROL, format_conversations, read_back

TEXTS = ["", " ", "a", r"back\slash", r"\[INST]", r"\\</s>", "</s>[INST] ok [/INST]", "[NEXT]", " [NEXT] x", "<s", "<<SYS>>\n<</SYS>>",
         "line\nline\n", "<<ROLE>> user [NEXT] hi <</ROLE>>\n", "é日🙂 [/INST]\n<s> x </s>\n", *CONTROL]


def _read(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    return {r.conv_id: r for r in read_back(format_conversations(df)).collect()}


def test_round_trip(spark):
    roles = ["user", "assistant", "assistant", "system", "tool", "user", None, "", "odd [NEXT] role"]
    rows = [(c, t, roles[(t + c) % len(roles)], TEXTS[(t * 3 + c) % len(TEXTS)], "x") for c in range(12) for t in range(c * 3 + 1)]
    out = _read(spark, rows)
    for c in range(12):
        want = [(r or "", t) for cc, _, r, t, _ in rows if cc == c]
        assert [(x.role, x.text) for x in out[c].turns] == want
        assert out[c].loss_text == "".join(t for r, t in want if r == "assistant")
        spans = [out[c].formatted[s.start - 1:s.start - 1 + s.len] for s in out[c].loss_mask]
        assert len(spans) == sum(r == "assistant" for r, _ in want)


def test_nulls_ties_and_repeats(spark):
    rows = [(1, 0, "user", None, None), (1, 0, "user", None, None), (1, 0, "assistant", "b", None), (1, None, "user", "first", None),
            (None, 0, "user", "no id", None)]
    out = _read(spark, rows)
    assert [(x.role, x.text) for x in out[1].turns] == [("user", "first"), ("assistant", "b"), ("user", ""), ("user", "")]
    assert out[None].turns[0].text == "no id"


def test_same_role_turns_share_a_block(spark):
    out = _read(spark, [(1, 0, "user", "a", None), (1, 1, "user", "b", None), (1, 2, "assistant", "c", None)])
    assert out[1].formatted == "[INST] a [NEXT] b [/INST]\n<s> c </s>\n"


def test_empty(spark):
    assert _read(spark, []) == {}


def test_long_conversations(spark):
    """Thousands of turns, of one role or alternating: running offsets across pieces, and texts of many bytes a character."""
    rows = [(c, t, "assistant" if c or t % 2 else "user", TEXTS[t % len(TEXTS)] * (t % 3), "x") for c in (0, 1) for t in range(3000)]
    rows += [(2, 0, "assistant", "é日🙂" * 300_000, "x"), (2, 1, "assistant", "end", "x")]
    out = _read(spark, rows)
    for c in range(3):
        want = [(r, t) for cc, _, r, t, _ in rows if cc == c]
        assert [(x.role, x.text) for x in out[c].turns] == want
        assert out[c].loss_text == "".join(t for r, t in want if r == "assistant")
        assert len(out[c].loss_mask) == sum(r == "assistant" for r, _ in want)
