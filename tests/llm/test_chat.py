import hashlib
import random
from collections import defaultdict

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import chat

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "conv_id long, turn long, role string, text string"
CONTROLS = [chat.BEGIN, chat.MIDDLE, chat.END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "|>", "<|"]


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("<>|[]/\\sINSTYturnexd a\n")), max_size=40) | st.lists(st.sampled_from([*CONTROLS, "\\", "<", "x"]), max_size=8).map("".join))
def test_escape_is_reversible_and_breaks_controls(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text
    assert not any(c in out for c in CONTROLS)


def digests(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        turns.sort()
        said = "".join(t[3] for t in turns if t[2] == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{t[2]}\n{t[3]}\n" for t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


def rows_of(seed, n):
    rng = random.Random(seed)
    words = ["ok", "</s>[INST] ok [/INST]", "été", "\\", "<|end|>", "long answer", "\n", "x" * 30]
    out = []
    for conv in range(n):
        for turn in range(rng.randint(1, 14)):
            role = "system" if turn == 0 and conv % 2 else ("user", "assistant")[turn % 2]
            out.append((conv, turn, role, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))))
    return out


def test_round_trip(spark):
    rows = rows_of(1, 40) + [(-7, 0, "user", CONTROLS[4]), (-7, 1, "assistant", None), (900, None, None, None), (None, 0, "assistant", "no id"), (901, 0, "user", "twice"), (901, 0, "user", "twice"), (902, 0, "assistant", "w " * 3000)]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "0 as window_no", "'a' as loss")
    windows = chat.format_windows(frame, PATH, budget=120, history=2)
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(windows).collect()}
    assert got == digests(rows)
    for w in windows.collect():
        assert w["over_budget"] == (w["n_tokens"] > 120) and (not w["over_budget"] or w["n_new"] == 1)
    by_conv = defaultdict(list)
    for w in windows.collect():
        by_conv[w["conv_id"]].append(w)
    assert any(len(v) > 2 for v in by_conv.values())
    for conv, own in by_conv.items():
        own.sort(key=lambda w: w["window_no"])
        first = chat.TURN.findall(own[0]["text"])[0]
        for w in own[1:]:
            if first[0] == "system":
                assert chat.TURN.findall(w["text"])[0] == first and w["n_repeated"] >= 1
            spans = [w["text"][s["start"] : s["end"]] for s in w["loss"]]
            assert spans == [m[1] for m in chat.TURN.findall(w["text"])[w["n_repeated"] :] if m[0] == "assistant" and m[1]]


def test_history_gives_way_to_the_budget():
    """Turns of 80, 10, 10 and 90 tokens, a budget of 100: the last one stands alone, within it."""
    state = chat.Windows("c", 100, 2)
    rows = [w for role, size in (("user", 80), ("assistant", 10), ("user", 10), ("assistant", 90)) for w in state.feed(role, str(size), size)] + [state.close()]
    assert [(w[4], w[5], w[6], w[7]) for w in rows] == [(0, 3, 100, False), (1, 1, 100, False)]
    state = chat.Windows("c", 100, 2)
    rows = [w for role, size in (("user", 80), ("assistant", 10), ("user", 10), ("assistant", 95)) for w in state.feed(role, str(size), size)] + [state.close()]
    assert [(w[4], w[5], w[6], w[7]) for w in rows] == [(0, 3, 100, False), (0, 1, 95, False)]
    state = chat.Windows("c", 100, 2)
    rows = [w for role, size in (("system", 20), ("user", 60), ("assistant", 10), ("user", 90)) for w in state.feed(role, str(size), size)] + [state.close()]
    assert [(w[4], w[5], w[6], w[7]) for w in rows] == [(0, 3, 90, False), (1, 1, 110, True)]


def test_string_ids(spark):
    rows = [("a", 1, "user", "x"), ("b", 1, "assistant", "y"), (None, 1, "user", "z")]
    out = chat.read_back(chat.format_windows(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string"), PATH))
    assert sorted((r["conv_id"] or "", r["n_turns"]) for r in out.collect()) == [("", 1), ("a", 1), ("b", 1)]


def test_one_long_conversation_in_small_batches(spark):
    rows = [(1, k, ("user", "assistant")[k % 2], f"turn {k} " * 5) for k in range(3000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        out = chat.read_back(chat.format_windows(spark.createDataFrame(rows, SCHEMA), PATH, budget=200)).first()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert tuple(out)[1:5] == digests(rows)[1]


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert chat.read_back(chat.format_windows(empty, PATH)).count() == 0
