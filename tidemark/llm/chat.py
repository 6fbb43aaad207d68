"""Conversations out of trees of replies, in DataFrame functions only.

Each message may name the one it replies to. Self-joins enumerate the paths from root to leaf: jumps of 1, 2, 4, ... messages
upwards are joined out of shorter ones, and a leaf's path is opened by the jumps from the longest to the shortest, so a tree of depth d takes about
2 log2(d) joins of ids alone. Branches are ranked by the mean score of their messages; each chosen one is formatted as one text, in which
control strings mark the turns and are escaped inside roles and texts, and a mask of spans says which characters a model learns from.

Cases: a null conv_id is a conversation of its own; null texts and roles are empty. A parent that is null, not there, or the message itself
makes a root. Messages on a cycle, or below one, have no root and are on no path. Rows that share a message id are one message,
whose turns follow one another by role and text, and whose parent is the lowest one named. Equal scores: the longer
branch first, then the lower leaf; no scores count as the lowest. An empty table gives no rows. Extra columns are left out. A path is one row of the result, so it
has to fit in a task; a tree hasn't.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored

ASSISTANT = "assistant"


@dataclass(frozen=True)
class Template:
    """A turn is start, role, middle, text, end. In roles and texts a ``mark`` goes behind the first character of each control string, and of each that has marks there."""

    start: str = "<s>[INST]"
    middle: str = "[/INST]"
    end: str = "</s>"
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]")
    mark: str = "\\"

    def __post_init__(self) -> None:
        firsts = {c[0] for c in self.controls}
        if any(len(c) < 2 or firsts & {*c[1:]} or self.mark in c for c in self.controls) or len(self.mark) != 1:
            raise ValueError("a control string may hold first characters of control strings in its first place only, and no mark")
        if any(re.sub("|".join(map(re.escape, self.controls)), "", x) for x in (self.start, self.middle, self.end)) or not self.middle or not self.end:
            raise ValueError("start, middle and end consist of control strings")

    def _pattern(self, marks: str) -> str:
        own = re.escape(self.mark)
        rests = {f: "|".join(re.escape(c[1:]) for c in self.controls if c[0] == f) for f in sorted({c[0] for c in self.controls})}
        return "(" + "|".join(f"{re.escape(f)}(?={own}{marks}(?:{rest}))" for f, rest in rests.items()) + ")"

    def escaped(self, text: Column) -> Column:
        return F.regexp_replace(text, self._pattern("*"), "$1" + self.mark.replace("\\", "\\\\"))

    def plain(self, text: Column) -> Column:
        return F.regexp_replace(text, self._pattern("+") + re.escape(self.mark), "$1")

    def turns(self, formatted: Column) -> Column:
        """The turns of a formatted text, as array of struct(role, text)."""

        def turn(piece: Column) -> Column:
            two = F.split(piece, re.escape(self.middle), 2)
            return F.struct(self.plain(F.substring(two[0], F.lit(len(self.start) + 1), F.length(two[0]))).alias("role"), self.plain(two[1]).alias("text"))

        pieces = F.split(formatted, re.escape(self.end), -1)
        return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)

    def learned(self, formatted: Column, loss: Column) -> Column:
        """All text under the mask, without escapes."""
        return F.array_join(F.transform(loss, lambda s: self.plain(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def links_of_turns(rows: DataFrame) -> DataFrame:
    """The links (c, m, p, score) of ``as_turns``: each replies to the one before. No text is shuffled for them."""
    order = as_turns(rows).select("c", "m").distinct()
    return order.select("c", "m", F.lag("m").over(Window.partitionBy("c").orderBy("m")).alias("p"), F.lit(None).cast("double").alias("score"))


def as_turns(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) as c, m, role, text; m orders the messages of a conversation: turn (null last), role, digest of the text."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    m = F.struct(F.col("turn").isNull().alias("late"), F.col("turn"), role.alias("role"), F.md5(text).alias("text"))
    return rows.select(F.struct("conv_id").alias("c"), m.alias("m"), role.alias("role"), text.alias("text"))


def as_replies(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``messages`` (conv_id, message_id, parent_id, role, text, score if there is one) as links (c, m, p, score) and turns (c, m, role, text)."""
    score = F.col("score").cast("double") if "score" in messages.columns else F.lit(None).cast("double")
    key = [F.struct("conv_id").alias("c"), F.struct("message_id").alias("m")]
    above = F.when(F.col("parent_id").isNotNull(), F.struct(F.col("parent_id").cast(messages.schema["message_id"].dataType).alias("message_id")))
    links = messages.select(*key, above.alias("p"), F.when(~F.isnan(score), score).alias("score"))
    turns = messages.select(*key, *[F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) for x in ("role", "text")])
    return links.groupBy("c", "m").agg(F.min("p").alias("p"), F.avg("score").alias("score")), turns


def paths(links: DataFrame) -> DataFrame:
    """Every message of every path from a root to a leaf of ``links`` (c, m, p): c, leaf, m, above (0 for the leaf itself)."""
    up = links.where(F.col("p").isNotNull() & ~F.col("p").eqNullSafe(F.col("m"))).select("c", "m", F.col("p").alias("up"))
    there = links.select("c", F.col("m").alias("up"))
    jumps, n = [stored(up.join(there, ["c", "up"], "left_semi").select("c", "m", "up"))], links.count()
    while 1 << (len(jumps) - 1) <= n and not jumps[-1].isEmpty():
        half = jumps[-1]
        jumps.append(stored(half.alias("a").join(half.alias("b"), (F.col("a.c") == F.col("b.c")) & (F.col("a.up") == F.col("b.m"))).select("a.c", "a.m", "b.up")))
    leaves = links.select("c", "m").join(jumps[0].select("c", F.col("up").alias("m")), ["c", "m"], "left_anti")
    rootless = jumps[-1].select("c", "m")  # a jump of more messages than there are: a cycle
    out = leaves.join(rootless, ["c", "m"], "left_anti").select("c", F.col("m").alias("leaf"), "m", F.lit(0).cast("bigint").alias("above"))
    for k in range(len(jumps) - 2, -1, -1):
        own, longer = F.struct("m", "above"), F.struct(F.col("up").alias("m"), (F.col("above") + (1 << k)).alias("above"))
        both = out.join(jumps[k], ["c", "m"], "left").select("c", "leaf", F.explode(F.when(F.col("up").isNull(), F.array(own)).otherwise(F.array(own, longer))).alias("x"))
        out = both.select("c", "leaf", "x.m", "x.above")
    return out


def best_paths(on_path: DataFrame, links: DataFrame, best: int | None = 1) -> DataFrame:
    """The rows of ``on_path`` on the ``best`` branches of each root by mean score (all, if None), with that score as ``path_score``."""
    scored = on_path.join(links.select("c", "m", "score"), ["c", "m"])
    each = scored.groupBy("c", "leaf").agg(F.avg("score").alias("path_score"), F.count("*").alias("n"), F.max_by("m", "above").alias("root"))
    if best is not None:
        order = Window.partitionBy("c", "root").orderBy(F.desc_nulls_last("path_score"), F.desc("n"), "leaf")
        each = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return on_path.join(each.select("c", "leaf", "path_score"), ["c", "leaf"])


def formatted(on_path: DataFrame, turns: DataFrame, template: Template) -> DataFrame:
    """One row a path: conv_id, leaf, path_score, formatted, loss (array of struct(start, length), in characters)."""
    role, text = template.escaped(F.col("role")), template.escaped(F.col("text"))
    rows = on_path.join(turns, ["c", "m"]).select("c", "leaf", "path_score", "above", "role", "text", role.alias("er"), text.alias("et"))
    head = F.concat(F.lit(template.start), F.col("er"), F.lit(template.middle))
    rows = rows.withColumn("head", F.length(head).cast("long")).withColumn("piece", F.concat(head, F.col("et"), F.lit(template.end)))
    order = Window.partitionBy("c", "leaf").orderBy(F.desc("above"), "role", "text")
    ends = F.sum(F.length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    span = F.when(F.col("role") == ASSISTANT, F.struct((F.col("end") - F.length("piece") + F.col("head")).cast("int").alias("start"), F.length("et").alias("length")))
    placed = rows.withColumn("end", ends).withColumn("n", F.row_number().over(order)).withColumn("span", span)
    each = placed.groupBy("c", "leaf").agg(
        F.first("path_score").alias("path_score"), F.sort_array(F.collect_list(F.struct("n", "piece", "span"))).alias("turns")
    )
    loss = F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull())
    return each.select("c.conv_id", "leaf", "path_score", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), loss.alias("loss"))


def conversations(messages: DataFrame, best: int | None = 1, template: Template | None = None) -> DataFrame:
    """The ``best`` branches of each tree of ``messages`` (conv_id, message_id, parent_id, role, text, score), each as one formatted conversation."""
    links, turns = as_replies(messages)
    links = stored(links)
    return formatted(best_paths(paths(links), links, best), turns, template or Template())


def of_turns(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """``rows`` (conv_id, turn, role, text), each replying to the one before, formatted."""
    links = stored(links_of_turns(rows))
    return formatted(best_paths(paths(links), links), as_turns(rows), template or Template())


def digest(out: DataFrame, template: Template) -> DataFrame:
    """What a reader gets back from formatted conversations, as counts and digests."""
    read = out.withColumn("turns", template.turns(F.col("formatted"))).withColumn("learned", template.learned(F.col("formatted"), F.col("loss")))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
