"""Conversation structure repair: cheapest edits to a legal order of roles, streamed by conversation.

A conversation's rows by turn (nulls first) are to give role initials ``(s?(ua)+)?``: an optional
system turn, then user and assistant in turn. Edits: Keep (0), Rerole to user or assistant (2),
Delete (3; blank and repeated rows must go), Insert an empty user or assistant turn (2); a
truncated row that stays adds 1. Of equally cheap edits the ASCII-least sequence of initials counts.

Four states say which role comes next. The cost to go from each state is computed
from the last row to the first; a row's best edit in every state is two bits, so a row leaves one
byte. A second walk from the first row follows these bytes. Since in each state only one role
can be inserted or given, equal edits lead to one state, and the least
initial at every row is the least sequence.

Spark sorts each conversation's rows twice into one stream: rows without their texts from last to first, then
whole rows from first to last. ``mapInPandas`` carries the state across batches, so memory does not
grow with a conversation but for its bytes; these go to an unnamed file in the shared folder
beyond ``SPILL_BYTES`` (a store that is not mounted keeps them in memory, one byte a row).
Whether role and text were seen in an earlier turn comes from an aggregation over digests before.

Cases: null role or text is one space; null conv_id is a conversation of its own; null turns come
first and count for no gap; rows of one turn are ordered by a hash of role and text (equal
rows are next to each other); initials other than s, u and a can not be kept; an empty table has no
conversations. Rows of one conversation with equal MD5 digests count as equal texts.
"""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genomeframe.llm.token_files import local_path
from genomeframe.session import materialize, shared_folder

SPILL_BYTES = 4 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
SPACE = r"\x20\x09-\x0D"
#: Faults of a row; the first that holds counts.
FINE, BLANK, DUPLICATE, CUT = range(4)
#: States: nothing yet, after system, after user, after assistant. The state after the role that may come next.
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = (USER, USER, ASSISTANT, USER)
_ROLES = {USER: "user", ASSISTANT: "assistant"}
_LETTERS = "DIKR"
_NAMES = {"s", "u", "a"}
_LEGAL = {"su", "ua", "au"}


def _kept(state: int, initial: str) -> int | None:
    """The state after a kept row, or None if the role may not come here."""
    if initial == "s":
        return SYSTEM if state == START else None
    return _NEXT[state] if initial == _ROLES[_NEXT[state]][0] else None


def _step(after: tuple[int, ...], initial: str, fault: int) -> tuple[tuple[int, ...], int]:
    """Costs to go from each state before a row, given those after it, and the edits as a byte."""
    stays = TRUNCATED if fault == CUT else 0
    options: list[dict[int, int]] = []
    for state in range(4):
        found = {0: DELETE + after[state]}
        if fault not in (BLANK, DUPLICATE):
            kept = _kept(state, initial)
            if kept is not None:
                found[2] = KEEP + stays + after[kept]
            found[3] = REROLE + stays + after[_NEXT[state]]
        options.append(found)
    cost = [min(o.values()) for o in options]
    for _ in range(3):  # an inserted turn leads to the next state at the same row
        cost = [min(c, INSERT + cost[_NEXT[q]]) for q, c in enumerate(cost)]
    edits = 0
    for state, found in enumerate(options):
        found[1] = INSERT + cost[_NEXT[state]]
        edits |= min(e for e, c in found.items() if c == cost[state]) << (2 * state)
    return tuple(cost), edits


class Backpointers:
    """A stack of bytes; what exceeds ``most`` lies in an unnamed file of ``folder``."""

    def __init__(self, folder: str | None, most: int):
        self.folder, self.most = folder, most
        self.top, self.file, self.spilled = bytearray(), None, 0

    def push(self, value: int) -> None:
        self.top.append(value)
        if len(self.top) >= self.most and self.folder is not None:
            if self.file is None:
                os.makedirs(self.folder, exist_ok=True)
                self.file = tempfile.TemporaryFile(dir=self.folder)
            self.file.seek(self.spilled)
            self.file.write(self.top)
            self.spilled += len(self.top)
            self.top = bytearray()

    def pop(self) -> int:
        if not self.top:
            n = min(self.most, self.spilled)
            self.spilled -= n
            self.file.seek(self.spilled)
            self.top = bytearray(self.file.read(n))
        return self.top.pop()


Sink = Callable[[str, str, str], None]


class Conversation:
    """One conversation in the stream: ``back`` for rows from last to first, then ``walk`` from first to last."""

    known: dict[tuple, tuple[tuple[int, ...], int, int]] = {}

    def __init__(self, name: str, folder: str | None, most: int):
        self.name, self.bytes = name, Backpointers(folder, most)
        self.cost, self.base = (0, 2 * INSERT, INSERT, 0), 0
        self.faults, self.illegal = [0, 0, 0, 0], 0
        self.later: str | None = None
        self.turn, self.first, self.last, self.turns = None, None, None, 0
        self.state, self.audit = START, io.StringIO()

    def back(self, has_turn: int, turn: int, times: int, fault: int, initial: str) -> None:
        if not times:
            return
        if has_turn:
            self.last = turn if self.last is None else self.last
            self.first = turn
            if turn != self.turn:
                self.turn, self.turns = turn, self.turns + 1
        for i in range(times):
            # all but the first of equal rows repeat it
            own = fault if i == times - 1 or fault == BLANK else DUPLICATE
            self.faults[own] += 1
            if self.later is not None and initial + self.later not in _LEGAL:
                self.illegal += 1
            self.later = initial
            key = self.cost, initial if initial in _NAMES else "", own
            if key not in self.known:
                cost, edits = _step(*key)
                low = min(cost)
                self.known[key] = tuple(c - low for c in cost), low, edits
            self.cost, more, edits = self.known[key]
            self.base += more
            self.bytes.push(edits)

    def walk(self, times: int, role: str, text: str, sink: Sink) -> None:
        for _ in range(times):
            edits = self.bytes.pop()
            while (edit := edits >> 2 * self.state & 3) == 1:
                self._insert(sink)
            self.audit.write(_LETTERS[edit])
            if edit == 2:
                self.state = _kept(self.state, role[:1])
                sink("K", role, text)
            elif edit == 3:
                self.state = _NEXT[self.state]
                sink("R", _ROLES[self.state], text)

    def _insert(self, sink: Sink) -> None:
        self.state = _NEXT[self.state]
        self.audit.write("I")
        sink("I", _ROLES[self.state], "")

    def end(self, sink: Sink) -> None:
        while self.state in (SYSTEM, USER):
            self._insert(sink)

    def figures(self) -> dict:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return {
            "conv": self.name,
            "gaps": gaps,
            "blank": self.faults[BLANK],
            "duplicate": self.faults[DUPLICATE],
            "truncated": self.faults[CUT],
            "illegal": self.illegal,
            "cost": self.base + self.cost[START],
        }


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with faults by a hash of conversation and turn, and ``times``: how often each stands (0: not)."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        (F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20).alias("_kind"),
    )
    kind = F.col("_kind")
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("times"),
    )


def _events(rows: DataFrame) -> DataFrame:
    """The stream: per conversation slim rows from last to first, then whole rows from first to last."""
    times = F.col("times").cast("long") if "times" in rows.columns else F.lit(1).cast("long")
    rows = rows.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv"),
        F.col("turn").isNotNull().cast("int").alias("has_turn"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        times.alias("times"),
    ).withColumn("tie", F.xxhash64("role", "text"))
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    ended = F.col("text").rlike(rf"[.!?][{SPACE}]*\z")
    fault = F.when(blank, BLANK).when(~ended, CUT).otherwise(FINE)
    slim = rows.select(
        "conv", "has_turn", "turn", "role", F.md5("text").alias("digest"), "tie", "times", fault.alias("fault")
    )
    place = ["conv", "has_turn", "turn", "role", "digest", "tie"]
    slim = slim.groupBy(*place).agg(F.sum("times").alias("times"), F.max("fault").alias("fault"))
    slim = materialize(slim, "conversation-rows")
    same = ["conv", "role", "digest"]
    repeated = (
        slim.filter("times > 0")
        .groupBy(*same)
        .agg(F.min(F.struct("has_turn", "turn")).alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
        .select(*same, "first")
    )
    again = F.coalesce(F.struct("has_turn", "turn") > F.col("first"), F.lit(False)) & (F.col("fault") != BLANK)
    nothing = F.lit(None).cast("string")
    backward = slim.join(repeated, same, "left").select(
        "conv",
        F.lit(0).alias("pass"),
        (1 - F.col("has_turn")).alias("o1"),
        F.bitwise_not("turn").alias("o2"),
        F.bitwise_not("tie").alias("o3"),
        "times",
        F.when(again, DUPLICATE).otherwise(F.col("fault")).alias("fault"),
        F.left("role", F.lit(1)).alias("role"),
        nothing.alias("text"),
    )
    forward = rows.filter("times > 0").select(
        "conv",
        F.lit(1).alias("pass"),
        F.col("has_turn").alias("o1"),
        F.col("turn").alias("o2"),
        F.col("tie").alias("o3"),
        "times",
        F.lit(FINE).alias("fault"),
        "role",
        "text",
    )
    order = ["conv", "pass", "o1", "o2", "o3"]
    return backward.unionByName(forward).repartition("conv").sortWithinPartitions(*order)


def _streamed(events: DataFrame, begin: Callable, schema: str, most: int) -> DataFrame:
    """``begin(conversation)`` gives a sink for its repaired rows and a function for the rows it gives at its end."""
    try:
        folder = local_path(shared_folder(events.sparkSession))
    except ValueError:  # a store that is not mounted
        folder = None
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: Conversation | None = None
        out: list[dict] = []
        for batch in batches:
            for conv, second, o1, o2, _, times, fault, role, text in zip(*(batch[c].tolist() for c in batch.columns)):
                if now is None or conv != now.name:
                    if now is not None:
                        now.end(sink)
                        close()
                    now = Conversation(conv, folder, most)
                    sink, close = begin(now, out)
                if second:
                    now.walk(times, role, text, sink)
                else:
                    now.back(1 - o1, ~o2, times, fault, role)
                if len(out) >= 5_000:
                    yield pd.DataFrame(out, columns=columns)
                    out.clear()
        if now is not None:
            now.end(sink)
            close()
            yield pd.DataFrame(out, columns=columns)

    return events.mapInPandas(run, schema)


def _named(rows: DataFrame, kind) -> DataFrame:
    """``conv`` back to the conversation's own id."""
    own = F.when(F.col("conv") != "", F.col("conv").substr(F.lit(2), F.length("conv"))).cast(kind)
    return rows.select(own.alias("conv_id"), *(c for c in rows.columns if c != "conv"))


def repaired(rows: DataFrame, most: int = SPILL_BYTES) -> DataFrame:
    """conv_id, place (from 0), edit (K, R or I), role and text of every row after the repair."""

    def begin(now: Conversation, out: list[dict]):
        place = 0

        def sink(edit: str, role: str, text: str) -> None:
            nonlocal place
            out.append({"conv": now.name, "place": place, "edit": edit, "role": role, "text": text})
            place += 1

        return sink, lambda: None

    schema = "conv string, place long, edit string, role string, text string"
    return _named(_streamed(_events(rows), begin, schema, most), rows.schema["conv_id"].dataType)


def report(rows: DataFrame, most: int = SPILL_BYTES) -> DataFrame:
    """Per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit and the digest of its repaired rows."""

    def begin(now: Conversation, out: list[dict]):
        digest, first = hashlib.sha256(), True

        def sink(edit: str, role: str, text: str) -> None:
            nonlocal first
            digest.update(f"{'' if first else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
            first = False

        def close() -> None:
            out.append(now.figures() | {"audit": now.audit.getvalue(), "repaired_sha256": digest.hexdigest()})

        return sink, close

    counts = ", ".join(f"{c} long" for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    schema = f"conv string, {counts}, audit string, repaired_sha256 string"
    return _named(_streamed(_events(rows), begin, schema, most), rows.schema["conv_id"].dataType)
