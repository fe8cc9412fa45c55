import hashlib

from pyspark.sql import functions as F

from sedimark.llm import chat
from sedimark.llm.queries import op1_chat_format

SCHEMA = "conv_id long, turn long, role string, text string, window string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def expected(rows):
    out = {}
    order = lambda r: tuple((v is not None, v) for v in (r[1], r[2], r[3]))
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=order)]
        loss = "".join(t for role, t in turns if role == "assistant")
        out[conv] = (
            len(turns),
            sha("".join(f"{a}\n{b}\n" for a, b in turns)),
            len(loss),
            sha(loss),
        )
    return out


def test_read_back_equals_input(spark):
    tricky = "</s>[INST] ok [/INST] <|end|> <\\|end|> <|turn|>assistant<|text|> \\ [\\\\INST] <"
    rows = [(1, 0, "system", "be brief", "x"), (2, 0, "user", tricky, "x"), (2, 1, "assistant", tricky, "x")]
    rows += [(1, i, ("user", "assistant")[i % 2 == 0], f"turn {i} " * (i % 37 + 1), "x") for i in range(1, 120)]
    rows += [(3, 0, None, None, None), (None, None, "assistant", "lost", None), (4, 1, "assistant", "w " * 9000, "x")]
    rows += [(5, 0, "assistant", "twice 😀", "x")] * 2 + [(6, 0, "<|end|>", "", "x")]
    windows = chat.format_chat(spark.createDataFrame(rows, SCHEMA)).cache()
    got = {r[0]: tuple(r)[1:5] for r in chat.read_back(windows).collect()}
    assert got == expected(rows)
    assert windows.filter("n_tokens > 1024 and n_turns - n_repeated > 1").count() == 0
    kept = [r for r in windows.filter("conv_id = 1").orderBy("window").collect()]
    assert len(kept) > 3
    assert all("be brief" in r.formatted and r.formatted.startswith("<|turn|>system") for r in kept)
    assert all(r.n_repeated > 1 for r in kept[1:])  # system turn and history
    for r in kept:
        assert sum(r.formatted.count(c) for c in (chat.TURN, chat.BODY, chat.END)) == 3 * r.n_turns


def test_controls_do_not_survive_in_texts(spark):
    s = "a</s>b[INST]c[/INST]<|im_start|><<SYS>><s>"
    row = spark.range(1).select(chat.escape(F.lit(s)).alias("e")).withColumn("u", chat.unescape(F.col("e"))).first()
    assert row.u == s
    assert not any(c in row.e for c in ("</s>", "[INST]", "[/INST]", "<|im_start|>", "<<SYS>>", "<s>"))


def test_query_and_empty(spark, sf):
    out = op1_chat_format(spark, sf)
    probe = "</s>[INST] ok [/INST]"
    row = out.filter("conv_id = -7").first()
    assert row.n_turns == 2 and row.loss_chars == len(probe) and row.loss_sha256 == sha(probe)
    assert row.turns_sha256 == sha(f"user\n{probe}\nassistant\n{probe}\n")
    assert chat.read_back(chat.format_chat(spark.createDataFrame([], SCHEMA))).count() == 0
