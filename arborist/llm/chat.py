r"""Chat formatting by a finite-state machine over roles, from a declarative template.

A state is the role of the turn before, START before the first. The template says for each state which
roles may follow and what such a turn is written as: the text before it, after it, and whether it is
learned from. A turn that may not follow is written between markers with its role, learned from if its
role is anywhere, and reported; the machine goes on from its role. Each turn becomes segments of text, each with a loss
flag: only a text that is learned from has it.

Control strings (all of the template's markers) are escaped where they stand in texts: a backslash
follows the first character of each, and each backslash is doubled. So a control string in the
output is a marker, and reading back needs nothing but the template: what follows is told from the state by the
markers, a text ends before the next control string, and a backslash is dropped unless doubled.

Turns are formatted in blocks of BLOCK turn numbers, so a conversation of any length is many tasks;
a block that isn't a conversation's first is given its state from the roles alone. Within a task, rows come
sorted and are never gathered. Reading back hashes a conversation from its first to its last turn, and a
hash of a sequence can't be taken in parts: conversations of one block are read where they were
formatted, longer ones are brought together by conversation and streamed.

Defined cases: a null text or role is the empty one; turns go by number, nulls first, then role and
a hash of the text; repeated rows are turns like any other; null conv_ids are one conversation; a
conversation may begin and end with any role; a very long text is one segment; an empty table gives no row; columns of other names are not looked
at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from hashlib import sha256
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, text_of

#: The state before the first turn: no role, not even the empty one.
START = None
#: Turn numbers that are formatted together.
BLOCK = 256


@dataclass(frozen=True)
class Written:
    """How a turn is written: what stands before and after its text, and whether it is learned from."""

    before: str
    after: str
    learned: bool = False


@dataclass(frozen=True)
class Template:
    """moves: for each state the roles that may follow and how they are written; out_of_turn: what
    stands before the role, between role and text, and after the text, of any other turn."""

    moves: dict[str | None, dict[str, Written]]
    controls: tuple[str, ...]
    out_of_turn: tuple[str, str, str] = ("<|turn|>", "<|text|>", "<|end|>")
    own: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "own", (*self.controls, *self.out_of_turn))
        if any(len(c) < 2 or "\\" in c for c in self.own):
            raise ValueError("a control string has two characters at least, and no backslash")
        written = [w for roles in self.moves.values() for w in roles.values()]
        for w in written:
            if not self.control.search(w.after):
                raise ValueError(f"no control string ends a text before {w.after!r}")
        befores = {w.before for w in written if w.before} | {w.after for w in written} | set(self.out_of_turn)
        afters = {w.after for w in written} | set(self.out_of_turn[1:])
        for c in self.own:
            for i in range(1, len(c)):
                if any(x.endswith(c[:i]) for x in befores) or any(x.startswith(c[i:]) or c[i:].startswith(x) for x in afters):
                    raise ValueError(f"with {c!r}, the end of a text can't be told from a marker")

    @cached_property
    def learned(self) -> frozenset[str]:
        """The roles that are learned from."""
        return frozenset(role for roles in self.moves.values() for role, w in roles.items() if w.learned)

    @cached_property
    def control(self) -> re.Pattern:
        return re.compile("|".join(map(re.escape, sorted(self.own, key=len, reverse=True))))

    @cached_property
    def _to_escape(self) -> re.Pattern:
        return re.compile(r"\\|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in self.own))

    def escaped(self, text: str) -> str:
        return self._to_escape.sub(lambda m: m[0] + "\\", text)

    def segments(self, state: str | None, role: str, text: str) -> tuple[bool, list[tuple[str, bool]]]:
        """Whether the role may follow the state, and the turn's segments with their loss flags."""
        way = self.moves.get(state, {}).get(role)
        if way is None:
            begin, middle, end = self.out_of_turn
            return False, [(begin + self.escaped(role) + middle, False), (self.escaped(text), role in self.learned), (end, False)]
        return True, [(way.before, False), (self.escaped(text), way.learned), (way.after, False)]

    def read(self, state: str | None, output: str) -> Iterator[tuple[str, str]]:
        """role, text of each turn in the output."""
        at = 0
        while at < len(output):
            begin, middle, end = self.out_of_turn
            if output.startswith(begin, at):
                cut, stop = output.index(middle, at), output.index(end, at)
                role, text = output[at + len(begin) : cut], output[cut + len(middle) : stop]
                state, at = unescaped(role), stop + len(end)
            else:
                ways = [(w, role) for role, w in self.moves.get(state, {}).items() if output.startswith(w.before, at)]
                way, state = max(ways, key=lambda x: len(x[0].before))
                at += len(way.before)
                stop = self.control.search(output, at).start() - self.control.search(way.after).start()
                text, at = output[at:stop], stop + len(way.after)
            yield state, unescaped(text)


def unescaped(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


_ASKED = Written("<s>[INST] ", " [/INST]")
#: Markers and turn order of a widely used instruction format.
INSTRUCTION = Template(
    moves={
        START: {"system": Written("<s>[INST] <<SYS>>\n", "\n<</SYS>>\n\n"), "user": _ASKED},
        "system": {"user": Written("", " [/INST]")},
        "user": {"assistant": Written(" ", "</s>", learned=True)},
        "assistant": {"user": _ASKED},
    },
    controls=("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"),
)

_FORMATTED = "block long, blocks long, place long, in_order boolean, segments array<struct<text: string, loss: boolean>>"
_SEGMENTS = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))


def _later_blocks(rows: DataFrame) -> DataFrame:
    """conv_id, block, blocks, state: of every block of the conversations with more than one, the
    number of blocks and the role before. Only roles are read, and rows are grouped before they move."""
    ends = rows.groupBy("conv_id", "block").agg(F.max_by("role", F.struct("turn", "role")).alias("role"))
    own = Window.partitionBy("conv_id")
    found = ends.withColumns({"state": F.lag("role").over(own.orderBy("block")), "blocks": F.count("*").over(own)})
    return found.where("blocks > 1").select("conv_id", "block", "blocks", "state")


def formatted(conversations: DataFrame, template: Template = INSTRUCTION, block: int = BLOCK) -> DataFrame:
    """A row per turn: conv_id, block, blocks (of the conversation), place (within the block),
    in_order (the role may follow), segments (text, loss)."""
    small_batches(conversations.sparkSession)
    rows = conversations.select("conv_id", "turn", text_of("role").alias("role"), text_of().alias("text"), F.floor(F.col("turn") / block).cast("long").alias("block"))
    states = _later_blocks(rows).select("conv_id", F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.col("state").alias("role"), F.lit(None).cast("string").alias("text"), "block", "blocks")
    # a row without a text stands before each block of a longer conversation, and carries its state
    both = rows.withColumn("blocks", F.lit(None).cast("long")).unionByName(states)
    dealt = both.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", F.col("text").isNotNull(), "turn", "role", F.xxhash64("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state, blocks, place = (), START, 1, 0
        for batch in batches:
            out, kept = [], []
            columns = [batch.column(x).to_pylist() for x in ("conv_id", "block", "role", "text", "blocks")]
            for i, (conv, own, role, text, n) in enumerate(zip(*columns)):
                if held != (conv, own):
                    held, state, blocks, place = (conv, own), START, 1, 0
                if text is None:
                    state, blocks = role, n
                    continue
                fits, segments = template.segments(state, role, text)
                out.append((own, blocks, place, fits, [{"text": t, "loss": x} for t, x in segments if t or x]))
                kept.append(i)
                state, place = role, place + 1
            if out:
                block_, blocks_, places, fit, segments = zip(*out)
                arrays = [pa.array(x, pa.int64()) for x in (block_, blocks_, places)] + [pa.array(fit, pa.bool_()), pa.array(segments, _SEGMENTS)]
                yield pa.RecordBatch.from_arrays([batch.column("conv_id").take(pa.array(kept)), *arrays], ["conv_id", "block", "blocks", "place", "in_order", "segments"])

    return dealt.mapInArrow(task, T.StructType([rows.schema["conv_id"], *T.StructType.fromDDL(_FORMATTED)]))


_READ = "n_turns long, in_order boolean, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(output: DataFrame, template: Template = INSTRUCTION) -> DataFrame:
    """Per conversation, from the segments alone: n_turns, in_order (all turns), digests of the turns
    and of the text under the loss mask, and the characters of both."""
    columns = ["conv_id", *T.StructType.fromDDL(_READ).names]

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(x).to_pylist() for x in ("conv_id", "in_order", "segments")))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, id_type = [], None

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal id_type
            for batch in batches:
                id_type = batch.column("conv_id").type
                yield batch

        def packed() -> pa.RecordBatch:
            ids, *rest = zip(*done)
            return pa.RecordBatch.from_arrays([pa.array(ids, id_type), *map(pa.array, rest)], columns)

        for conv, own in groupby(rows_of(seen()), key=itemgetter(0)):
            turns, loss, state, n, fit, chars, learned = sha256(), sha256(), START, 0, True, 0, 0
            for _, fits, segments in own:
                written = "".join(s["text"] for s in segments)
                for role, text in template.read(state, written):
                    turns.update(f"{role}\n{text}\n".encode())
                    state, n = role, n + 1
                for text in (unescaped(s["text"]) for s in segments if s["loss"]):
                    loss.update(text.encode())
                    learned += len(text)
                fit, chars = fit and fits, chars + len(written)
            done.append((conv, n, fit, turns.hexdigest(), learned, loss.hexdigest(), chars))
            if len(done) == 1024:
                yield packed()
                done = []
        if done:
            yield packed()

    schema = T.StructType([output.schema["conv_id"], *T.StructType.fromDDL(_READ)])
    here = output.where("blocks = 1")
    brought = output.where("blocks > 1").repartition("conv_id").sortWithinPartitions("conv_id", "block", "place")
    return here.mapInArrow(task, schema).unionByName(brought.mapInArrow(task, schema))


#: A conversation made of control strings.
PROBE = (-7, "</s>[INST] ok [/INST]")


def with_probe(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The conversations and the probe: a turn of the user, then one of the assistant."""
    conv_id, text = PROBE
    rows = spark.createDataFrame([(conv_id, i, role, text) for i, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(rows)


def op12(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    return read_back(formatted(with_probe(spark, conversations)))


def _sql(template: Template = INSTRUCTION) -> str:
    """The same rows in DuckDB: markers counted by state and role, escapes by occurrence."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    ways = ", ".join(
        f"({'NULL' if state is START else quote(state)}, {quote(role)}, {len(w.before) + len(w.after)}, {w.learned})" for state, roles in template.moves.items() for role, w in roles.items()
    )
    escapes = lambda x: " + ".join([f"(length({x}) - length(replace({x}, '\\', '')))", *(f"(length({x}) - length(replace({x}, {quote(c)}, ''))) // {len(c)}" for c in template.own)])
    learned = ", ".join(map(quote, sorted(template.learned)))
    probe = ", ".join(f"({PROBE[0]}, {i}, '{role}', {quote(PROBE[1])})" for i, role in enumerate(("user", "assistant")))
    return rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES {probe}) t(conv_id, turn, role, text)),
s AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role) AS state FROM c),
way AS (SELECT * FROM (VALUES {ways}) t(state, role, chars, learned)),
w AS (
  SELECT s.*, way.chars AS marks, coalesce(way.learned, s.role IN ({learned})) AS learned
  FROM s LEFT JOIN way ON s.role = way.role AND s.state IS NOT DISTINCT FROM way.state)
SELECT conv_id, count(*) AS n_turns, bool_and(marks IS NOT NULL) AS in_order,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (learned), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role) FILTER (learned), '')) AS loss_sha256,
  CAST(sum(length(text) + {escapes("text")} + coalesce(marks, {sum(map(len, template.out_of_turn))} + length(role) + {escapes("role")})) AS BIGINT) AS formatted_chars
FROM w GROUP BY conv_id
"""


SQL = _sql()
