"""Chat formatting: a finite-state machine over roles and a declarative template.

Every turn becomes three segments, opening, text and closing, each with a loss flag.
Control strings inside roles and texts are escaped reversibly: a control string is cut
after its first character by a backslash, and one that was already cut gets one more.
``read_back`` parses the formatted string and undoes that.

Cases. Null texts and roles count as empty. Turns are ordered by number, nulls first;
turns of one number by role, then text, and repeated rows stay repeated. A null
conversation id is a conversation of its own. A conversation whose roles break the
turn order, or hold unknown roles, is formatted all the same, with ``valid`` false and
the place of the first offending turn. Other columns are not looked at. An empty table
gives an empty result. One conversation is one value, so it is put together in one
task; all other work is done by row before.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm.common import hex_sha256, read, text_or_empty


@dataclass(frozen=True)
class Template:
    opening: str = "<|im_start|>"
    after_role: str = "\n"
    closing: str = "<|im_end|>\n"
    # Beginnings of everything a model's tokenizer may read as control text.
    control: tuple[str, ...] = ("<|", "<s>", "</s>", "[INST]", "[/INST]")
    loss_roles: tuple[str, ...] = ("assistant",)
    # state -> role -> next state; a missing entry is an error.
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "system", "user": "user"},
            "system": {"user": "user"},
            "user": {"assistant": "assistant"},
            "assistant": {"user": "user"},
        }
    )
    accepting: tuple[str, ...] = ("assistant",)

    def _cut_pattern(self) -> tuple[str, str]:
        heads = "".join(sorted({re.escape(c[0]) for c in self.control}))
        tails = "|".join(sorted({re.escape(c[1:]) for c in self.control}))
        return heads, tails

    def escape(self, text: Column) -> Column:
        heads, tails = self._cut_pattern()
        return F.regexp_replace(text, rf"([{heads}])(\\*)({tails})", r"$1$2\\$3")

    def unescape(self, text: Column) -> Column:
        heads, tails = self._cut_pattern()
        return F.regexp_replace(text, rf"([{heads}])(\\*)\\({tails})", "$1$2$3")

    # A role ends at ``after_role``, so that string inside a role gets a control string of its own.
    def escape_role(self, role: Column) -> Column:
        return F.replace(self.escape(role), F.lit(self.after_role), F.lit("<|nl|>"))

    def unescape_role(self, role: Column) -> Column:
        return self.unescape(F.replace(role, F.lit("<|nl|>"), F.lit(self.after_role)))


def _states(template: Template, turns: Column) -> Column:
    """State after the last turn and the index of the first turn that has no move (-1: none)."""
    move = F.create_map(
        *[F.lit(x) for state, by_role in template.moves.items() for role, to in by_role.items() for x in (f"{state}>{role}", to)]
    )

    def step(state: Column, turn: Column) -> Column:
        to = F.try_element_at(move, F.concat(state["state"], F.lit(">"), turn["role"]))
        return F.struct(
            F.coalesce(to, F.lit("error")).alias("state"),
            (state["seen"] + 1).alias("seen"),
            F.when((state["bad"] < 0) & to.isNull(), state["seen"]).otherwise(state["bad"]).alias("bad"),
        )

    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("seen"), F.lit(-1).alias("bad"))
    return F.aggregate(turns, start, step)


def format_chats(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation: conv_id, valid, bad_turn, segments of text and loss, formatted."""
    role, text = text_or_empty("role"), text_or_empty("text")
    rows = turns.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            role.alias("role"),
            text.alias("text"),
            F.concat(F.lit(template.opening), template.escape_role(role), F.lit(template.after_role)).alias("head"),
            template.escape(text).alias("body"),
            role.isin(*template.loss_roles).alias("loss"),
        ).alias("turn"),
    )
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))

    def segments(turn: Column) -> Column:
        def segment(text: Column, loss: Column) -> Column:
            return F.struct(text.alias("text"), loss.alias("loss"))

        return F.array(
            segment(turn["head"], F.lit(False)),
            segment(turn["body"], turn["loss"]),
            segment(F.lit(template.closing), F.lit(False)),
        )

    end = _states(template, F.col("turns"))
    return (
        grouped.withColumn("end", end)
        .withColumn("segments", F.flatten(F.transform("turns", segments)))
        .select(
            "conv_id",
            ((F.col("end.bad") < 0) & F.col("end.state").isin(*template.accepting)).alias("valid"),
            F.col("end.bad").alias("bad_turn"),
            "segments",
            F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        )
    )


def read_back(chats: DataFrame, template: Template = Template()) -> DataFrame:
    """``chats`` with turns (role, text) parsed from ``formatted`` and the unescaped text under the loss."""

    def parse(piece: Column) -> Column:
        at = F.locate(template.after_role, piece)
        text = F.substring(
            piece, at + F.lit(len(template.after_role)),
            F.length(piece) - at - F.lit(len(template.after_role) - 1 + len(template.closing)),
        )
        return F.struct(
            template.unescape_role(F.substring(piece, F.lit(1), at - 1)).alias("role"),
            template.unescape(text).alias("text"),
        )

    pieces = F.split("formatted", re.escape(template.opening))
    loss = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: template.unescape(s["text"]))
    return chats.withColumn("pieces", F.slice(pieces, F.lit(2), F.size(pieces))).select(
        "*", F.transform("pieces", parse).alias("turns"), F.array_join(loss, "").alias("loss_text")
    ).drop("pieces")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], turns.schema)
    parsed = read_back(format_chats(turns.unionByName(planted)))
    listing = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return parsed.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        hex_sha256(listing).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        hex_sha256(F.col("loss_text")).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
