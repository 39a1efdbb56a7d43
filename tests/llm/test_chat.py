import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from conftest import SF
from tabscore.llm import chat

CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]"]
SCHEMA = "conv_id long, turn long, role string, text string, formatted int, turns int, said int, written int"


def awkward():
    """Texts of control strings, their parts, backslashes and other characters in any order."""
    rng = random.Random(3)
    parts = [*CONTROLS, "<", "[", "\\", "\\\\", "<\\s>", "[\\/INST]", "s>", "/", "INST]", " ", "\n", "é", "😀", "a", "$1", ""]
    texts = [*parts, "</s>[INST] ok [/INST]", "<\\\\/s>", "<</s>", "[[INST]]", "\\</s>", "x\\", " [/INST]", "</s></s>"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    return [*texts, None, "word " * 20_000 + "</s>" * 300]


def table(spark, rows):
    return spark.createDataFrame([(*r, 0, 0, 0, 0) for r in rows], SCHEMA).repartition(3)


def read_back(formatted):
    """A parser of its own: the turns of a rendered conversation, the loss text, and the mask's characters."""
    assert formatted.startswith("<s>")
    rest, turns = formatted[3:], []
    while rest:
        if rest.startswith("[INST] "):
            role, body, close = "user", rest[7:], " [/INST]"
        elif rest.startswith("[ROLE]"):
            role, body = rest[6:].split("[/ROLE] ", 1)
            close = "</s>"
        else:
            assert rest[0] == " "
            role, body, close = "assistant", rest[1:], "</s>"
        text, rest = body.split(close, 1)
        assert not any(c in x for c in CONTROLS for x in (role, text))
        turns.append([re.sub(r"(<|\[)\\(?=\\*/?(s>|INST\]|ROLE\]))", r"\1", x) for x in (role, text)])
    return turns


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_every_text_comes_back(spark):
    rng = random.Random(4)
    texts = awkward()
    roles = ["user", "assistant", "system", None, "", "a\nb", "[INST]", "user ", "x[/ROLE] y", "</s>"]
    rows = [(i // 7, i, rng.choice(roles), t) for i, t in enumerate(texts)]
    rows += [(0, 0, "user", "tie"), (0, 0, "user", "tie"), (0, None, "assistant", "first"), (None, 1, "user", "x"), (None, 1, None, None)]
    by_conv = {}
    for conv, turn, role, text in rows:
        by_conv.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = chat.format_conversations(table(spark, rows))
    digests = {r.conv_id: r for r in chat.digests(out).collect()}
    found = out.withColumn("mask", chat.loss_mask(F.col("turns"))).collect()
    assert {r.conv_id for r in found} == set(by_conv) and len(found) == len(by_conv)
    for r in found:
        want = [[role, text] for _, _, role, text in sorted(by_conv[r.conv_id])]
        assert read_back(r.formatted) == want
        assert [[t.role, t.text] for t in r.turns] == want
        said = [text for role, text in want if role == "assistant"]
        at, masked = 0, []
        for run in r["mask"]:
            if run.loss:
                masked.append(r.formatted[at : at + run.length])
            at += run.length
        assert at == len(r.formatted)
        assert len(masked) == len(said) and all(x == y for x, y in zip(masked, said) if "\\" not in x)
        d = digests[r.conv_id]
        assert (d.n_turns, d.formatted_chars) == (len(want), len(r.formatted))
        assert d.turns_sha256 == sha("".join(f"{role}\n{text}\n" for role, text in want))
        assert (d.loss_chars, d.loss_sha256) == (len("".join(said)), sha("".join(said)))


def test_only_conflicting_texts_are_escaped(spark):
    texts = ["plain <b> [x] \\ text", "</s>", "[\\INST]"]
    rows = [(i, 0, "assistant", t) for i, t in enumerate(texts)]
    out = {r.conv_id: r.formatted for r in chat.format_conversations(table(spark, rows)).collect()}
    assert out == {0: "<s> plain <b> [x] \\ text</s>", 1: "<s> <\\/s></s>", 2: "<s> [\\\\INST]</s>"}


@pytest.mark.parametrize("broken", ["", "x", "<s>x", "<s>[INST] a</s>", "<s>[ROLE]a</s>", "<s>[INST] [/INST]", "<s> a[INST]</s>"])
def test_the_parser_refuses_what_the_grammar_does_not_give(spark, broken):
    turns = spark.range(1).select(chat.parse(F.lit(broken)).alias("t")).first().t
    assert not turns or any(t.text is None for t in turns)


def test_a_turn_that_no_form_saves_raises(spark, monkeypatch):
    monkeypatch.setattr(chat, "FORMS", chat.FORMS[:1])
    with pytest.raises(Exception, match="no form of a turn"):
        chat.format_conversations(table(spark, [(1, 0, "user", "a</s>b")])).collect()


def test_empty_table(spark):
    out = chat.digests(chat.format_conversations(table(spark, [])))
    assert out.count() == 0


def test_no_python_worker(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet")
    plan = chat.digests(chat.format_conversations(rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert plan.count("Exchange hashpartitioning") == 1
