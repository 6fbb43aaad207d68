"""Reply trees: paths, ranks and formatted texts against a walk in Python."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat

MESSAGE = "conv_id long, message_id long, parent_id long, role string, text string, score double, piece string, c long, n int"
NASTY = ["", "ok", "</s>[INST] ok [/INST]", "<\\s>", "<\\\\/s>[", "[\\INST]\\", "<", "</s", "s>", "[/INST", "\\", "<<s>>\n", "😀é</s>\t", "$1 \\$0 [INST]"]


def forest(seed, conversations=12):
    """Random trees, with orphans, cycles, messages that answer themselves, nulls and repeated rows."""
    rng, rows = random.Random(seed), []
    for c in [None, *range(conversations)]:
        n = rng.choice((1, 2, 5, 40))
        for m in range(n):
            parent = rng.choice([None, m, 999]) if m == 0 else rng.choice((m - 1, m - 1, rng.randrange(m)))
            text, role = rng.choice([None, *NASTY]), rng.choice(("user", "assistant", "assistant", None, "tool [INST]"))
            rows.append((c, m, parent, role, text, rng.choice((None, 0.5, 1.0, 2.0, float("nan"))), "x", 1, 2))
        if rng.random() < 0.4:
            rows += [(c, 100, 102, "user", "a", 9.0, "x", 1, 2), (c, 101, 100, "user", "b", 9.0, "x", 1, 2), (c, 102, 101, "user", "c", 9.0, "x", 1, 2), (c, 103, 102, "assistant", "below", 9.0, "x", 1, 2)]
        if rng.random() < 0.4:
            rows += [rows[-1]] * 2
    return rows


def walked(rows, best):
    """By conversation and leaf: the turns of its path, root first."""
    by = defaultdict(lambda: defaultdict(list))
    for c, m, p, role, text, score, *_ in rows:
        by[c][m].append((p, role or "", text or "", None if score != score else score))
    out = {}
    for c, nodes in by.items():
        parent = {m: min((p for p, *_ in own if p is not None), default=None) for m, own in nodes.items()}
        parent = {m: p if p in nodes and p != m else None for m, p in parent.items()}
        roots = defaultdict(list)
        for leaf in nodes.keys() - set(parent.values()):
            path = [leaf]
            while parent[path[-1]] is not None and len(path) <= len(nodes):
                path.append(parent[path[-1]])
            if len(path) > len(nodes):
                continue
            scores = [sum(own) / len(own) for m in path if (own := [s for *_, s in nodes[m] if s is not None])]
            mean = sum(scores) / len(scores) if scores else None
            roots[path[-1]].append((mean is None, -(mean or 0), -len(path), leaf, path))
        for own in roots.values():
            for *_, leaf, path in sorted(own)[:best]:
                out[c, leaf] = [(r, t) for m in reversed(path) for r, t in sorted((r, t) for _, r, t, _ in nodes[m])]
    return out


@pytest.mark.parametrize("best", [1, 2, None])
def test_branches_against_a_walk(spark, best):
    rows = forest(5 if best else 6)
    template = chat.Template()
    out = chat.conversations(spark.createDataFrame(rows, MESSAGE), best, template)
    read = out.select("conv_id", "leaf.message_id", "formatted", "loss", template.turns(F.col("formatted")).alias("turns"), template.learned(F.col("formatted"), F.col("loss")).alias("learned")).collect()
    want = walked(rows, best)
    assert {(r.conv_id, r.message_id): [(t.role, t.text) for t in r.turns] for r in read} == want and len(read) == len(want)
    for r in read:
        turns = want[r.conv_id, r.message_id]
        assert r.learned == "".join(t for role, t in turns if role == "assistant")
        assert all(r.formatted[s.start - len("[/INST]"):s.start] == "[/INST]" and r.formatted[s.start + s.length:].startswith("</s>") for s in r.loss)
        assert r.formatted.count("</s>") == r.formatted.count("<s>") == r.formatted.count("[INST]") == len(turns)


def test_long_chain_takes_few_joins(spark, monkeypatch):
    made = []
    monkeypatch.setattr(chat, "stored", lambda df, own=chat.stored: made.append(1) or own(df))
    rows = spark.range(700).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    out = chat.of_turns(rows).select(chat.Template().turns(F.col("formatted")).alias("t")).first()
    assert [t.text for t in out.t] == [str(k) for k in range(700)] and len(made) <= 12


def test_rows_by_turn(spark):
    rows = [(1, 2, "assistant", "later"), (1, 0, "user", None), (1, None, "user", "no turn"), (1, 0, "user", None), (None, 5, None, "x"), (1, 0, "system", "s")]
    df = spark.createDataFrame([(*r, "f", 3) for r in rows], "conv_id long, turn long, role string, text string, formatted string, leaf int")
    got = {r.conv_id: [tuple(t) for t in r.t] for r in chat.of_turns(df).select("conv_id", chat.Template().turns(F.col("formatted")).alias("t")).collect()}
    assert got == {1: [("system", "s"), ("user", ""), ("user", ""), ("assistant", "later"), ("user", "no turn")], None: [("", "x")]}


def test_no_rows(spark):
    assert chat.conversations(spark.createDataFrame([], MESSAGE)).count() == 0
    assert chat.of_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_escapes_are_reversible(spark):
    rng = random.Random(1)
    texts = NASTY + ["".join(rng.choice("<>/s[]INT\\ \n|") for _ in range(rng.randrange(60))) for _ in range(3000)] + ["<" * 200_000 + "s>", "[" + "\\" * 200_000 + "INST]"]
    other = chat.Template("<|start|>", "<|middle|>", "<|end|>", ("<|start|>", "<|middle|>", "<|end|>"), "~")
    for template in (chat.Template(), other):
        df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", template.escaped(F.col("t")))
        for r in df.withColumn("back", template.plain(F.col("e"))).collect():
            assert r.back == r.t and not any(c in r.e for c in template.controls)


@pytest.mark.parametrize("controls", [("<<", "</s>"), ("<a[", "[b"), ("\\x", "</s>"), ("x",)])
def test_ambiguous_controls_are_refused(controls):
    with pytest.raises(ValueError):
        chat.Template(controls[0], controls[-1], controls[-1], controls)
