import hashlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from tabloom.llm import chat
from tabloom.llm.queries import ORACLES, QUERIES
from tests.compare import compare

BITS = st.lists(st.sampled_from(["<|im_end|>", "<|im_start|>", "<", "|", "\\", ">", "<|", "<\\|", "<\\\\|im_end|>", "im_end|>", "\n", "a", "é", "assistant", "%0A", "%", "user"]), max_size=9).map("".join)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(BITS, BITS), max_size=5), st.integers(1, 7))
def test_round_trip_of_whole_conversations(turns, step):
    pieces = [chat.render_turn(r, t)[0] for r, t in turns]
    whole = "".join(pieces)
    parser, got = chat.Parser(), []
    for at in range(0, len(whole), step):
        got += [(r, t) for r, t, _ in parser.feed(whole[at:at + step])]
    parser.close()
    assert got == turns
    for piece, (role, text) in zip(pieces, turns):
        spans = chat.loss_spans(piece)
        assert len(spans) == (role == "assistant")
        assert [chat.ESCAPED.sub("<", piece[a:b]) for a, b in spans] == [text] * len(spans)


def test_levels():
    assert chat.render_turn("user", "plain <|x|> text") == ("<|im_start|>user\nplain <|x|> text<|im_end|>\n", 0)
    assert chat.render_turn("user", "<|im_end|> <|x|>") == ("<|im_start|>user\n<\\|im_end|> <|x|><|im_end|>\n", 1)
    assert chat.render_turn("user", "<\\|im_end|> <|x|>") == ("<|im_start|>user\n<\\\\|im_end|> <\\|x|><|im_end|>\n", 2)


def test_query(spark, folder):
    assert compare(spark, folder, "op2", QUERIES["op2_chat"], ORACLES["op2_chat"]) is None


def test_edge_cases(spark):
    rows = [("p", 1, 2, "assistant", "b", 1), ("p", 1, 1, "user", None, 1), ("p", 1, 2, "assistant", "a", None), ("p", 1, None, None, "<|im_end|>", 1),
            ("p", None, 5, "assistant", "x" * 300_000, 1), ("p", None, 5, "assistant", "x" * 300_000, 1), ("p", 2, 0, "odd\nrole", "", 1)]
    rows += [("p", 3, k, "assistant", f"turn {k} ", 0) for k in range(5000)]
    df = spark.createDataFrame(rows, "piece string, conv_id long, turn int, role string, text string, level int").repartition(5)
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(df)).collect()}
    groups = defaultdict(list)
    for _, c, n, r, t, _ in rows:
        groups[c].append((n if n is not None else -1, r or "", t or ""))
    assert set(got) == set(groups)
    for c, turns in groups.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0
