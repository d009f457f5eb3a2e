import hashlib
from collections import defaultdict

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecspark.llm import chat as C

ROWS = "conv_id long, turn long, role string, text string"
odd = st.lists(st.sampled_from(["<", "|", "\\", "<|im_end|>", "<|im_start|>", "\n", "n", "user", ">", "é"])).map("".join)


@given(odd)
def test_escapes_are_reversible(text):
    assert C.unescape(C.escape(text)) == text and "<|" not in C.escape(text)
    assert C.unescape_role(C.escape_role(text)) == text and "\n" not in C.escape_role(text)


@given(st.lists(st.tuples(odd, odd), max_size=5))
def test_conversations_read_back(turns):
    assert C.parse("".join(C.format_turn(r, [C.Text(t)]).formatted for r, t in turns)) == turns


def test_parts_become_ordered_placeholders():
    flat = C.Flatten(patch=10, audio_rate=2, page_tokens=100)([C.Text("a <|image_0|> "), C.Image("i.png", 25, 11), C.Audio("s.wav", 3.0), C.Text("b"), C.Document("d.pdf", 4), C.Image("j.png")])
    assert "".join(flat.content) == "a <\\|image_0|> <|image_0|><|audio_1|>b<|document_2|><|image_3|>"
    assert flat.attachments == [("image", "i.png", 6), ("audio", "s.wav", 6), ("document", "d.pdf", 400), ("image", "j.png", 1)]
    turn = C.format_turn("assistant", [C.Text("x<|"), C.Image("i", 1, 1), C.Text("y")])
    assert [C.unescape(turn.formatted[a:b]) for a, b in turn.loss] == ["x<|", "y"] and turn.attachments == [("image", "i", 1)]
    assert not C.format_turn("user", [C.Text("x")]).loss


def brute(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn if turn is not None else float("-inf"), role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        said = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


def test_digests(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", f"{c} <|im_end|>\n é {t}" * (t + 1)) for c in range(30) for t in range(c % 7 + 1)]
    rows += [(-1, 0, "user", C.CONTROL), (-1, 1, "assistant", C.CONTROL), (None, 3, "user", "x"), (None, None, None, None), (90, 1, "assistant", None), (90, 1, "assistant", "tie"), (90, 1, "assistant", "tie"), (91, 0, "", "😀" * 10_000)]
    df = spark.createDataFrame(rows, ROWS).select("*", F.lit(1).alias("formatted"), F.lit(2).alias("n_turns")).repartition(5)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in C.digests(df).collect()}
    assert got == brute(rows)
    assert C.digests(df.where("false")).count() == 0
    pieces = C.format_conversations(df).where("conv_id = -1").orderBy("turn").collect()
    assert C.parse("".join(p["formatted"] for p in pieces)) == [("user", C.CONTROL), ("assistant", C.CONTROL)]
    p = pieces[1]
    assert [C.unescape(p["formatted"][a:b]) for a, b in p["loss_spans"]] == [C.CONTROL] and not pieces[0]["loss_spans"]


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = brute([*rows, (-1, 0, "user", C.CONTROL), (-1, 1, "assistant", C.CONTROL)])
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in C.op6_chat_format(spark, sf).collect()}
    assert got == want
