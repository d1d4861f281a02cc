"""Chat formatting: a finite-state machine over roles, and text segments with loss flags from a declarative template."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let


@dataclass(frozen=True)
class Turn:
    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """How turns are marked. A role without an entry is written between `role`, `named` and `role_close`.

    moves: the states that may follow each state, a state being the role last seen; ends: the states a valid conversation ends in.
    """

    turns: dict[str, Turn] = field(default_factory=lambda: {"system": Turn("<<SYS>>", "<</SYS>>"), "user": Turn("[INST]", "[/INST]"), "assistant": Turn("<s>", "</s>", True)})
    role: str = "<<ROLE>>"
    named: str = "<<TEXT>>"
    role_close: str = "<</ROLE>>"
    start: str = "start"
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    ends: tuple[str, ...] = ("assistant",)

    @property
    def controls(self) -> list[str]:
        return [*(x for t in self.turns.values() for x in (t.open, t.close)), self.role, self.named, self.role_close]

    @property
    def pattern(self) -> str:
        return "|".join(re.escape(x) for x in self.controls)

    def _split(self) -> tuple[str, str]:
        heads = "".join(sorted({re.escape(x[0]) for x in self.controls}))
        rests = "|".join(sorted({re.escape(x[1:]) for x in self.controls}))
        return f"([{heads}])", f"(?=(?:{rests}))"

    def escape(self, text: Column) -> Column:
        """Put one more backslash behind the first character of each control string, whatever backslashes are there already."""
        head, rest = self._split()
        return F.regexp_replace(text, head + r"(\\*)" + rest, r"$1\\$2")

    def unescape(self, text: Column) -> Column:
        head, rest = self._split()
        return F.regexp_replace(text, head + r"\\(\\*)" + rest, "$1$2")


SEGMENT = "struct<text:string,loss:boolean>"


def format_conversations(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, valid, segments (array of text and loss flag, in order) and formatted (their texts as one string).

    turns: conv_id, turn, role, text. valid: the finite-state machine accepts the roles; other conversations are formatted too.
    Control strings inside texts and role names are escaped, so read_back() gives every turn as it was.

    Null text or role: empty. A null turn comes first; rows with equal turns come by role and text, repeated rows each count. Rows of
    a null conv_id are one conversation. An empty table gives none. Other columns are not read.
    """
    t = template or Template()
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    own = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), empty("role"), empty("text"))
    gathered = own.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    moves = F.create_map(*(F.lit(x) for a, bs in t.moves.items() for b in bs for x in (f"{a} {b}", b)))
    state = F.aggregate("turns", F.lit(t.start), lambda s, x: F.coalesce(moves[F.concat(s, F.lit(" "), x["role"])], F.lit("")))
    segment = lambda text, loss=False: F.struct(text.alias("text"), F.lit(loss).alias("loss"))

    def written(x: Column) -> Column:
        text = t.escape(x["text"])
        out = F.array(segment(F.concat(F.lit(t.role), t.escape(x["role"]), F.lit(t.named))), segment(text), segment(F.lit(t.role_close)))
        for role, mark in t.turns.items():
            out = F.when(x["role"] == role, F.array(segment(F.lit(mark.open)), segment(text, mark.loss), segment(F.lit(mark.close)))).otherwise(out)
        return out

    made = gathered.select("conv_id", state.isin(*t.ends).alias("valid"), F.flatten(F.transform("turns", written)).alias("segments"))
    return made.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: Column, template: Template | None = None) -> Column:
    """The turns of a formatted string: array of role and text."""
    t = template or Template()
    opens = {m.open: role for role, m in t.turns.items()}
    roles = F.create_map(*(F.lit(x) for kv in opens.items() for x in kv))
    marks = F.regexp_extract_all(formatted, F.lit(t.pattern), F.lit(0))

    def turns(parts: Column) -> Column:
        at = F.transform(marks, lambda m, i: F.struct(m.alias("mark"), F.get(parts, i).alias("before"), F.get(parts, i + 1).alias("text")))
        kept = F.filter(at, lambda x: x["mark"].isin(*opens, t.named))
        return F.transform(kept, lambda x: F.struct(F.coalesce(roles[x["mark"]], t.unescape(x["before"])).alias("role"), t.unescape(x["text"]).alias("text")))

    return let(F.split(formatted, t.pattern, -1), turns)


def loss_text(segments: Column, template: Template | None = None) -> Column:
    t = template or Template()
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: t.unescape(s["text"])), "")


def op3_chat_formatting(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    made = format_conversations(rows.unionByName(extra)).withColumn("turns", read_back(F.col("formatted"))).withColumn("loss", loss_text(F.col("segments")))
    line = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    long = lambda c, name: c.cast("long").alias(name)
    return made.select(
        "conv_id", long(F.size("turns"), "n_turns"), F.sha2(line, 256).alias("turns_sha256"), long(F.length("loss"), "loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), long(F.length("formatted"), "formatted_chars"), "valid",
    )
