"""Conversation structure repair: the cheapest edits that turn a conversation into an optional system turn and pairs.

The grammar ``(s?(ua)+)?`` over the initials of roles has four states: nothing yet, after s, after u, after a. A forward
Viterbi pass over a conversation's turns carries, for each state, the least (cost, audit string) that leads to it; the
audit string has the initial of each edit, so ties go to the string that is least in ASCII. Each turn is a layer:
Keep, Rerole and Delete lead into it, and Insert closes it. Two inserts are enough between turns, as a third would only
come back to a state that was there.

Conversations are dealt by their id and sorted by turn, both of which may spill; a worker sees the turns one by one. Of
a conversation it holds four costs, four hashes of the text repaired so far and the audit strings' differing ends, but no
turns. That one conversation's turns go to one task is asked for by the hash over its whole repaired text.

Of two strings with the same cost none begins with the other: both have a letter for each turn, so the longer one would
have more inserts and cost more. So what is least for a prefix of the turns stays least whatever follows.
"""

from __future__ import annotations

import hashlib
import os.path
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrasift.llm.common import BATCH_BYTES, map_batches

#: Costs of edits; a truncated turn that stays costs ``TRUNCATED`` more.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
#: States before a turn of the user; before one of the assistant there is USER alone.
BEFORE_USER = (START, SYSTEM, ASSISTANT)
#: Pairs of initials that may follow one another.
LEGAL = {"su", "ua", "au"}
#: Turns after which the common beginning of the audit strings is set apart.
TRIM = 256
SPACES = " \t\n\v\f\r"
#: A character that is no white space.
VISIBLE = r"[^\x20\x09-\x0D]"
_BLANK = re.compile(VISIBLE)

RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


@dataclass
class Path:
    """The cheapest edits that lead to a state: their cost, the end of their audit string, a hash of what they give."""

    cost: int
    audit: str
    text: object


def _said(path: Path, begun: bool, role: str, text: str) -> object:
    """The hash of the repaired text with one more turn."""
    more = path.text.copy()
    more.update((f"\n{role}:{text}" if begun else f"{role}:{text}").encode("utf-8", "surrogatepass"))
    return more


@dataclass
class Walk:
    """The forward pass over one conversation."""

    #: One path for each state, or None.
    paths: list = field(default_factory=lambda: [Path(0, "", hashlib.sha256()), None, None, None])
    #: What all audit strings begin with.
    common: list[str] = field(default_factory=list)
    turns: int = 0
    counts: dict[str, int] = field(default_factory=lambda: dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0))
    initial: str | None = None
    first: int | None = None
    last: int | None = None
    distinct: int = 0

    def __post_init__(self) -> None:
        self.paths = self.closed(self.paths)

    @staticmethod
    def best(paths: list, options: list[tuple[int, int, str, str | None, str]]) -> Path | None:
        """The least of (state before, cost, letter, role said or None, text) by cost, then audit string."""
        found = min(((paths[s].cost + cost, paths[s].audit + letter, s, role, text) for s, cost, letter, role, text in options if paths[s]), key=lambda x: x[:2], default=None)
        if found is None:
            return None
        cost, audit, before, role, text = found
        return Path(cost, audit, paths[before].text if role is None else _said(paths[before], before != START, role, text))

    def closed(self, paths: list) -> list:
        """Inserted turns behind a layer, first of the user, then of the assistant."""
        for state, before, role in ((USER, BEFORE_USER, "user"), (ASSISTANT, (USER,), "assistant")):
            inserted = self.best(paths, [(s, INSERT, "I", role, "") for s in before])
            if inserted and (paths[state] is None or (inserted.cost, inserted.audit) < (paths[state].cost, paths[state].audit)):
                paths[state] = inserted
        return paths

    def turn(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        """One more turn; ``seen`` if its role and text were there before."""
        if turn is not None:
            self.distinct += turn != self.last
            self.first, self.last = (turn if self.first is None else self.first), turn
        initial = role[:1]
        self.counts["illegal"] += self.initial is not None and self.initial + initial not in LEGAL
        self.initial = initial
        visible = _BLANK.search(text) is not None
        fault = "blank" if not visible else "duplicate" if seen else "truncated" if text.rstrip(SPACES)[-1] not in ".!?" else None
        if fault:
            self.counts[fault] += 1
        options: list[list] = [[(s, DELETE, "D", None, "")] for s in range(4)]
        if fault not in ("blank", "duplicate"):
            more = TRUNCATED if fault else 0
            for letter, cost, initials in (("K", KEEP, {"s": role, "u": role, "a": role}), ("R", REROLE, {"u": "user", "a": "assistant"})):
                for to, state, before in (("s", SYSTEM, (START,)), ("u", USER, BEFORE_USER), ("a", ASSISTANT, (USER,))):
                    if to in initials and (letter == "R" or to == initial):
                        options[state] += [(s, cost + more, letter, initials[to], text) for s in before]
        self.paths = self.closed([self.best(self.paths, found) for found in options])
        self.turns += 1
        if self.turns % TRIM == 0:
            self.trim()

    def trim(self) -> None:
        """Drops paths that can't be the cheapest any more, and sets apart what the others have in common.

        Whatever follows the state after an assistant's turn does as well as what follows SYSTEM, and as what follows START
        once a kept system turn is deleted instead.
        """
        done = self.paths[ASSISTANT].cost
        for state, more in ((START, DELETE), (SYSTEM, 0)):
            if self.paths[state] and self.paths[state].cost > done + more:
                self.paths[state] = None
        same = len(os.path.commonprefix([path.audit for path in self.paths if path]))
        if same:
            self.common.append(next(path for path in self.paths if path).audit[:same])
            for path in self.paths:
                if path:
                    path.audit = path.audit[same:]

    def result(self) -> tuple:
        path = min((p for p in (self.paths[START], self.paths[ASSISTANT]) if p), key=lambda p: (p.cost, p.audit))
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return (gaps, *self.counts.values(), path.cost, "".join([*self.common, path.audit]), path.text.hexdigest())


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by conversation and turn; a conversation may go on in the next batch."""
    schema, walk, now, ids, results = None, None, None, None, []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*results, strict=True))
        names = [f.split()[0] for f in RESULT.split(", ")]
        kinds = [pa.int64()] * 6 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(columns[0], ids), *(pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True))], ["conv_id", *names])

    for rows in batches:
        schema = schema or rows.schema
        ids = schema.field("conv_id").type
        for conv, turn, role, text, there, seen in zip(*(rows.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "there", "seen")), strict=True):
            if walk is None or conv != now:
                if walk is not None:
                    results.append((now, *walk.result()))
                walk, now = Walk(), conv
            if there:
                walk.turn(turn, role, text, seen)
        if len(results) >= 1000:
            yield batch()
            results = []
    if walk is not None:
        results.append((now, *walk.result()))
        yield batch()


def repair(turns: DataFrame, there: Column | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: one row for each conversation.

    ``turns`` has conv_id, turn, role and text; turns are taken in their order, null ones first, equal ones by role and text.
    A null role or text counts as one space, a null conv_id as a conversation of its own. Repeated rows are duplicates,
    other columns aren't looked at. Rows for which ``there`` isn't true only name their conversation: one without any
    other has zeros, an empty audit string and the hash of no text. An empty table gives no rows.

    Each turn has its first fault alone: blank, duplicate (role and text were there before), truncated (it doesn't end
    in one of .!? before white space). ``audit`` has the initials of the cheapest edits: Keep, Rerole, Delete, Insert.
    """
    space = F.lit(" ")
    rows = turns.select(
        turns["conv_id"].alias("conv_id"),
        turns["turn"].cast("long").alias("turn"),
        F.coalesce(turns["role"], space).alias("role"),
        F.coalesce(turns["text"], space).alias("text"),
        F.coalesce(F.lit(True) if there is None else there, F.lit(False)).alias("there"),
    )
    alike = Window.partitionBy("conv_id", "there", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    dealt = rows.repartition("conv_id").withColumn("seen", F.row_number().over(alike) > 1)
    ordered = dealt.sortWithinPartitions(F.col("conv_id"), F.col("turn").asc_nulls_first(), "role", "text", "seen")
    kind = rows.schema["conv_id"].dataType.simpleString()
    return map_batches(ordered, _walked, f"conv_id {kind}, {RESULT}", BATCH_BYTES)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Applies the audit string of each conversation to its turns, which come in order."""
    for rows in batches:
        convs, out = rows.column("conv_id"), []
        for i, (turns, audit) in enumerate(zip(rows.column("turns").to_pylist(), rows.column("audit").to_pylist(), strict=True)):
            now, at = START, iter(turns)
            for n, letter in enumerate(audit):
                turn = next(at) if letter != "I" else None
                if letter == "D":
                    continue
                # an inserted or reroled turn is the user's unless it follows one
                role = turn["role"] if letter == "K" else "assistant" if now == USER else "user"
                now = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[:1]]
                out.append((i, n, role, turn["text"] if turn else ""))
        if out:
            row, place, role, text = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([convs.take(pa.array(row)), pa.array(place, pa.int64()), pa.array(role, pa.string()), pa.array(text, pa.string())], ["conv_id", "place", "role", "text"])


def repaired_turns(turns: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, place, role, text: the turns that stay or are inserted, in the order of ``place``, from what ``repair`` found.

    A conversation's turns are held in one row here, as its repaired text is to be read as a whole.
    """
    space = F.lit(" ")
    rows = turns.select(turns["conv_id"].alias("conv_id"), F.struct(turns["turn"].cast("long").alias("turn"), F.coalesce(turns["role"], space).alias("role"), F.coalesce(turns["text"], space).alias("text")).alias("at"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("at"), lambda x, y: _order(x, y)).alias("turns"))
    joined = grouped.join(found.select(F.col("conv_id").alias("found_id"), "audit"), F.col("conv_id").eqNullSafe(F.col("found_id"))).drop("found_id")
    kind = T.StructType([rows.schema["conv_id"], *T._parse_datatype_string("place long, role string, text string").fields])
    return map_batches(joined, _edited, kind, BATCH_BYTES)


def _order(x: Column, y: Column) -> Column:
    """-1, 0 or 1: by turn, null first, then by role and text."""
    def key(c: str) -> Column:
        return F.when(x[c] < y[c], -1).when(x[c] > y[c], 1).otherwise(0)

    turn = F.when(x["turn"].isNull() & y["turn"].isNull(), 0).when(x["turn"].isNull(), -1).when(y["turn"].isNull(), 1).otherwise(key("turn"))
    return F.when(turn != 0, turn).when(key("role") != 0, key("role")).otherwise(key("text"))


def damaged(conversations: DataFrame, kinds: int = 20) -> DataFrame:
    """conv_id, turn, role, text, there: conversations with faults, set by crc32 of ``conv_id:turn`` modulo ``kinds``.

    0 drops a turn (its row stays, with ``there`` false), 1 empties its text, 2 takes .!? out of it, 3 repeats it, 4 gives
    it to the user. Nulls count as one space.
    """
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(*(conversations[c].alias(c) for c in ("conv_id", "turn", "role", "text")))
    fault = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % kinds
    marked = rows.withColumn("fault", fault)
    return marked.select(
        "conv_id",
        "turn",
        F.when(F.col("fault") == 4, "user").otherwise(text_of("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace(text_of("text"), "[.!?]", "")).otherwise(text_of("text")).alias("text"),
        (F.col("fault") != 0).alias("there"),
        F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")
