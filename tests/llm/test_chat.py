import hashlib
import random

import pytest
from conftest import DATA, rows
from pyspark.sql import functions as F

from plumbline.llm import chat
from plumbline.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"


def test_query_equals_sql(spark, duck):
    df = QUERIES["op12_chat_format"](spark, DATA)
    found = duck.execute(ORACLE_SQL["op12_chat_format"])
    assert rows(df.columns, df.collect()) == rows([c[0] for c in found.description], found.fetchall())


def test_main_path_is_native(spark):
    df = chat.read_back(chat.formatted(spark.createDataFrame([(1, 0, "user", "a")], SCHEMA)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def hostile(rng):
    parts = [*chat.CONTROL, "\\", "\\\\", "<", "[", "|", ">", "a", "é", "\n", "", " ", "/s>", "INST]", "end|>"]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(12)))


def test_hostile_texts_come_back(spark):
    rng = random.Random(5)
    given = [(c, t, rng.choice(["user", "assistant", "assistant", "system", hostile(rng)]), hostile(rng)) for c in range(60) for t in range(rng.randrange(1, 9))]
    rng.shuffle(given)
    back = chat.read_back(chat.formatted(spark.createDataFrame(given, SCHEMA))).collect()
    for r in back:
        own = sorted(x[1:] for x in given if x[0] == r.conv_id)
        assert [(t.role, t.text) for t in r.turns] == [(x[1], x[2]) for x in own]
        assert r.learned == "".join(x[2] for x in own if x[1] == "assistant")
        blocks = 1 + sum(a[1] != b[1] for a, b in zip(own, own[1:]))
        assert r.formatted.count(chat.START) == r.formatted.count(chat.END) == blocks and r.formatted.count(chat.NEXT) == len(own) - blocks
        assert not any(c in r.formatted for c in chat.CONTROL if c not in (chat.START, chat.MESSAGE, chat.NEXT, chat.END))
        assert all(a["end"] <= b["start"] for a, b in zip(r.loss, r.loss[1:]))


def test_odd_rows(spark):
    wide = spark.createDataFrame(
        [(None, None, None, None, 1, "x"), (None, 0, "assistant", "b", 2, "x"), (1, 1, "assistant", "y", 1, "x"), (1, 1, "assistant", "x", 1, "x"), (1, 0, "user", "", 1, "x"), (1, 0, "user", "", 1, "x")],
        SCHEMA + ", turns long, formatted string",
    )
    found = {r.conv_id: r for r in chat.read_back(chat.formatted(wide)).collect()}
    assert [(t.role, t.text) for t in found[None].turns] == [("", ""), ("assistant", "b")]
    assert [(t.role, t.text) for t in found[1].turns] == [("user", ""), ("user", ""), ("assistant", "x"), ("assistant", "y")] and found[1].learned == "xy"
    assert found[1].formatted == "<|start|>user<|message|><|next|><|end|><|start|>assistant<|message|>x<|next|>y<|end|>"
    assert chat.formatted(wide.where("conv_id = 2")).count() == 0


def test_long_conversation(spark):
    given = spark.range(3000).select(F.lit(4).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("</s>"), F.repeat(F.lit("ü"), 50)).alias("text"))
    r = chat.read_back(chat.formatted(given)).first()
    assert len(r.turns) == 3000 and r.learned == ("</s>" + "ü" * 50) * 2000


def test_quoting_conversation(spark):
    r = QUERIES["op12_chat_format"](spark, DATA).where("conv_id = -7").first()
    text = "</s>[INST] ok [/INST]"
    assert r.n_turns == 2 and r.loss_chars == len(text) and r.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert r.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


@pytest.mark.parametrize("bad", [("a",), ("<a<",), ("<a\\",), ("<a", "<ab"), ("<",)])
def test_control_strings_that_cannot_be_undone(bad):
    with pytest.raises(ValueError):
        chat.check_control(bad)
