"""Conversation structure repair: rows stream by conversation and turn, the cheapest edits are chosen by dynamic programming."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from tempfile import SpooledTemporaryFile

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshlark.functions.worker import ship
from meshlark.session import spread

ship(__name__)
BLANKS = " \t\n\u000b\f\r"
#: States of what is repaired so far: nothing, a system row, ... a user row, ... an assistant row. It may end in the first or last.
START, SYSTEM, USER, ASSISTANT = range(4)
#: What a role's initial leads to from each state.
AFTER = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: The only role that an inserted or rerolled row may take in each state, and the state it leads to.
WANTED = ["user", "user", "assistant", "user"]
THEN = [USER, USER, ASSISTANT, USER]
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
LEGAL = {"su", "ua", "au"}
IN_MEMORY = 1 << 20  # bytes of one conversation's backpointers before they go to the task's scratch file
OUT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class Written:
    """The digest of the repaired rows, joined by newlines."""

    def __init__(self, digest=None, some: bool = False):
        self.digest, self.some = digest or hashlib.sha256(), some

    def with_rows(self, *rows: bytes) -> Written:
        out = Written(self.digest.copy(), self.some)
        for row in rows:
            out.digest.update(b"\n" + row if out.some else row)
            out.some = True
        return out


class Conversation:
    """One conversation as its rows come by: counts, and for each state the cheapest way to it.

    A way is (cost, rank, digest). Ways that end before the same row spell different edits, none of which begins
    another, so their alphabetical order is that of their ranks, and later edits cannot change it. A step back needs
    one byte a state: the state before, the inserted rows and the edit.
    """

    def __init__(self, in_memory: int = IN_MEMORY):
        self.back = SpooledTemporaryFile(max_size=in_memory)
        self.rows = 0
        self.ways = {START: (0, 0, Written())}
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.most = self.initial = None

    def add(self, turn, role: str, text: str, fault: str) -> None:
        if turn is not None:
            self.turns += turn != self.most
            self.least = turn if self.least is None else self.least
            self.most = turn
        self.blank += fault == "blank"
        self.duplicate += fault == "duplicate"
        self.truncated += fault == "truncated"
        initial = role[:1]
        self.illegal += self.rows > 0 and self.initial + initial not in LEGAL
        self.initial = initial
        self._edit(role, text, fault)
        self.rows += 1

    def _edit(self, role: str, text: str, fault: str) -> None:
        found: dict[int, list] = {}
        extra = TRUNCATED if fault == "truncated" else 0
        for before, (cost, rank, _) in self.ways.items():
            state, inserted = before, 0
            while inserted < 3:
                edits = [("D", state, DELETE)]
                if fault in ("", "truncated"):
                    edits.append(("R", THEN[state], REROLE + extra))
                    if state in AFTER.get(role[:1], ()):
                        edits.append(("K", AFTER[role[:1]][state], extra))
                for edit, after, price in edits:
                    found.setdefault(after, []).append((cost + inserted * INSERT + price, rank, "I" * inserted + edit, before))
                state, inserted = THEN[state], inserted + 1
        best = {after: min(ways) for after, ways in found.items()}
        order = sorted(best, key=lambda s: best[s][1:3])
        step, ways = bytearray(4), {}
        for place, after in enumerate(order):
            cost, _, edits, before = best[after]
            n = len(edits) - 1
            step[after] = before | n << 2 | "DKR".index(edits[-1]) << 4
            rows, state = [], before
            for _ in range(n):
                rows.append(f"{WANTED[state]}:")
                state = THEN[state]
            if edits[-1] != "D":
                rows.append(f"{role if edits[-1] == 'K' else WANTED[state]}:{text}")
            digest = self.ways[before][2]
            ways[after] = (cost, place, digest.with_rows(*(x.encode() for x in rows)) if rows else digest)
        self.back.write(step)
        self.ways = ways

    def result(self) -> tuple:
        """The row of OUT."""
        ends = []
        for state, (cost, rank, digest) in self.ways.items():
            tail = []
            while state not in (START, ASSISTANT):
                tail.append(f"{WANTED[state]}:".encode())
                state = THEN[state]
            ends.append((cost + INSERT * len(tail), rank, tail, digest))
        cost, rank, tail, digest = min(ends, key=lambda e: e[:2])
        state = next(s for s, way in self.ways.items() if way[1] == rank)
        edits = self._edits(state) + "I" * len(tail)
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return (gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, edits, digest.with_rows(*tail).digest.hexdigest())

    def _edits(self, state: int) -> str:
        """The edits on the way to ``state``, read from the last row back, a block of the file at a time."""
        out, many = [], 1 << 16
        for first in range((self.rows - 1) // many * many if self.rows else -1, -1, -many):
            self.back.seek(first * 4)
            steps = self.back.read(min(many, self.rows - first) * 4)
            part = []
            for k in range(len(steps) - 4, -1, -4):
                step = steps[k + state]
                part.append("DKR"[step >> 4] + "I" * (step >> 2 & 3))
                state = step & 3
            out.append("".join(part))
        return "".join(out)[::-1]

    def close(self) -> None:
        self.back.close()


COLUMNS = ["conv_id", *[c.split()[0] for c in OUT.split(", ")]]


def _repair(in_memory: int):
    def repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, now = None, None

        def finished() -> tuple:
            row = (key, *now.result())
            now.close()
            return row

        for batch in batches:
            done = []
            for conv_id, there, turn, role, text, fault in zip(*(batch[c].tolist() for c in batch.columns), strict=True):
                if now is None or conv_id != key:
                    if now:
                        done.append(finished())
                    key, now = conv_id, Conversation(in_memory)
                if there:
                    now.add(turn and int(turn), role, text, fault)
            yield pd.DataFrame(done, columns=COLUMNS)
        if now:
            yield pd.DataFrame([finished()], columns=COLUMNS)

    return repair


def faulty(turns: DataFrame) -> DataFrame:
    """Rows of (conv_id, there, turn, role, text) with their first ``fault``: blank, duplicate, truncated or the empty string.

    Rows lie together by conversation; duplicates are found by a sort on role and text within each task, so no set of
    texts is held. Rows that are not ``there`` stand for their conversation alone and have no fault.
    """
    by_text = Window.partitionBy("conv_id", "there", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    last = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    fault = F.when(~F.col("there"), "").when(F.btrim("text", F.lit(BLANKS)) == "", "blank").when(
        F.row_number().over(by_text) > 1, "duplicate").when(~last.isin(".", "!", "?"), "truncated").otherwise("")
    return spread(turns, "conv_id").withColumn("fault", fault)


def repair(turns: DataFrame, in_memory: int = IN_MEMORY) -> DataFrame:
    """One row a conversation of (conv_id, turn, role, text, there): its faults and its cheapest repair.

    Rows are ordered by turn, nulls first, then role and text; null role and text count as one space. Edits: keep a
    row (0), change its role to user or assistant (3), delete it (4; blank and duplicate rows must go), insert an
    empty user or assistant row (3); a truncated row that stays costs 3 more. What is left begins with at most one
    system row and alternates user, assistant, ending with assistant, by the roles' first letters. Of equally cheap
    repairs the one whose audit, the edits' initials in order, is least stays. ``repaired_sha256`` is the digest of the
    repaired rows as ``role:text``, joined by newlines. ``there`` tells whether the row is present (null: no); a conversation of
    which no row is has zeros, an empty audit and the digest of nothing. A null conv_id is a conversation too.

    Rows stream through a task by conversation and turn. What is held of a conversation is four ways and four bytes a
    row, beyond ``in_memory`` bytes in a scratch file of the running task, which a new attempt writes anew. Columns of
    other names are dropped; an empty table gives no rows.
    """
    blank = lambda c: F.coalesce(c, F.lit(" ")).alias(c)
    rows = turns.select("conv_id", F.coalesce("there", F.lit(False)).alias("there"), F.col("turn").cast("long").alias("turn"), blank("role"), blank("text"))
    lean = lambda c: F.when(F.col("there"), F.col(c)).alias(c)
    sent = faulty(rows).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", F.col("fault") == "duplicate").select(
        F.col("conv_id").cast("string"), "there", F.col("turn").cast("string"), lean("role"), lean("text"), "fault")
    kind = turns.schema["conv_id"].dataType.simpleString()
    return sent.mapInPandas(_repair(in_memory), f"conv_id string, {OUT}").withColumn("conv_id", F.col("conv_id").cast(kind))
