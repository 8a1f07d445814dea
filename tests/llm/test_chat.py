import hashlib

from hypothesis import given
from hypothesis import strategies as st

from screenloom.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string, piece string, first int"
HARD = st.text(alphabet="<|\\>n\nim_startend a", max_size=30)


@given(HARD)
def test_escape_round_trip(text):
    assert chat.unescape(chat.escape(text)) == text
    assert "<|" not in chat.escape(text)
    assert chat.unescape(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", ""]), HARD), max_size=6))
def test_pieces_join_to_the_whole_rendering(turns):
    for context in (1, 3, None):
        r = chat.Renderer(chat.chat_markup, context)
        text, got = "", []
        for role, t in turns:
            piece, a, e, rewritten = r.add(role, t)
            assert not rewritten
            got.append(chat.unescape(piece[a:e]))
            text += piece
        assert text == chat.chat_markup(turns) and got == [t for _, t in turns]


def test_a_template_that_rewrites_history_is_found():
    def last_marked(turns):
        return "".join(f"[{r}]{t};" for r, t in turns[:-1]) + "".join(f"<last {r}>{t};" for r, t in turns[-1:])

    r = chat.Renderer(last_marked, None)
    assert [r.add("user", f"t{k}")[3] for k in range(3)] == [False, True, True]

    def grows(turns):
        return "BEGIN " + "".join(f"[{r}]{t};" for r, t in turns)

    r = chat.Renderer(grows, 1)
    out = [r.add("user", t) for t in ("a", "b", "c", "d")]
    assert "".join(x[0] for x in out) == "BEGIN [user]a;[user]b;[user]c;[user]d;" and not any(x[3] for x in out)
    assert [x[0][x[1] : x[2]] for x in out] == ["a", "b", "c", "d"]


def test_digests_on_hard_rows(spark):
    rows = [
        (1, 2, "assistant", "two <|im_end|>\\n", "x", 1), (1, 1, "user", "<|im_start|>assistant\nno", "x", 1), (1, 2, "assistant", "two <|im_end|>\\n", "x", 1),
        (2, None, None, None, None, None), (2, 0, "assistant", None, None, None), (None, 0, "assistant", "é😀", "", 0),
        (3, 0, "as\nsistant", "x", "", 0), (4, 0, "assistant", "long " * 50000, "", 0),
    ] + [(9, k, "assistant" if k % 2 else "user", f"turn {k}", "", 0) for k in range(3000)]
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(spark.createDataFrame(rows, SCHEMA).repartition(4))).collect()}
    want = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    assert got.keys() == want.keys()
    for c, turns in want.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        r = got[c]
        assert (r.n_turns, r.loss_chars, r.formatted_chars, r.rewritten) == (len(turns), len(loss), len(chat.chat_markup(turns)), False)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_empty_table(spark):
    assert chat.read_back(chat.format_turns(spark.createDataFrame([], SCHEMA))).count() == 0


def test_a_template_that_drops_older_turns_is_found_by_default(spark):
    def last_three(turns):
        return "".join(f"[{r}]{t};" for r, t in turns[-3:])

    rows = [(1, k, "user", f"t{k}", "", 0) for k in range(5)]
    got = chat.format_turns(spark.createDataFrame(rows, SCHEMA), last_three).collect()
    assert [r.rewritten for r in got] == [False, False, False, True, True]


def test_a_text_or_role_with_the_probe_keeps_its_mask(spark):
    hard = chat.PROBE + chat.PROBE[-1] * 3
    turns = [("user", "see " + chat.PROBE), ("assistant", "my answer"), (hard, hard), ("assistant", hard), ("assistant", chat.PROBE)]
    rows = [(1, k, role, text) for k, (role, text) in enumerate(turns)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    [got] = chat.read_back(chat.format_turns(frame)).collect()
    want = "".join(t for r, t in turns if r == "assistant")
    assert got.loss_chars == len(want) and got.loss_sha256 == hashlib.sha256(want.encode()).hexdigest() and not got.rewritten


def test_a_template_that_rewrites_is_told_even_with_a_stated_context(spark):
    def forgetful(turns):
        return "".join(f"<{r}>{t}\n" for r, t in turns[-2:]) if len(turns) > 2 else chat.chat_markup(turns)

    rows = [(c, k, "assistant" if k % 2 else "user", f"text {k}") for c in (1, 2) for k in range(5 if c == 1 else 2)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(frame, forgetful, context=1)).collect()}
    assert got[1].rewritten and got[1].turns_sha256 is None and got[1].loss_sha256 is None and got[1].n_turns == 5
    assert not got[2].rewritten and got[2].loss_chars == len("text 1")


def test_long_conversations_read_back_beyond_the_whole_prefixes(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", f"text {k} <|x") for k in range(3 * chat.WHOLE)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole, window = (chat.read_back(chat.format_turns(frame, context=c)).first() for c in (None, 1))
    assert whole == window and whole.loss_chars == sum(len(r[3]) for r in rows if r[2] == "assistant")


def test_the_query_sees_rewriting_at_any_turn(spark, monkeypatch):
    """A short conversation and a long one go by one rule."""
    markup, turns = chat.chat_markup, 2 * chat.WHOLE

    def forgets_late(turns_so_far):
        return markup(turns_so_far[-2:] if len(turns_so_far) == turns else turns_so_far)

    rows = [(c, k, "assistant" if k % 2 else "user", f"text {k}") for c, n in ((1, turns), (2, turns - 1)) for k in range(n)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    monkeypatch.setattr(queries, "table", lambda *_: frame)
    monkeypatch.setattr(chat, "chat_markup", forgets_late)
    got = {r.conv_id: r for r in queries.op9_chat_format(spark, "").collect()}
    assert got.keys() == {-1, 1, 2} and {c: r.rewritten for c, r in got.items()} == {-1: False, 1: True, 2: False}
    assert got[1].turns_sha256 is None and got[2].n_turns == turns - 1


def test_a_stated_context_is_the_same_for_every_turn():
    def last_three(turns):
        return "".join(f"[{r}]{t};" for r, t in turns[-3:])

    r = chat.Renderer(last_three, 1)
    assert [r.add("user", f"t{k}")[3] for k in range(3 * chat.WHOLE)] == [False] * 3 + [True] * (3 * chat.WHOLE - 3)
    assert len(r.turns) <= chat.WHOLE + 1
