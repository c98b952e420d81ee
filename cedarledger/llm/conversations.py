"""Repair of conversation structure by a forward Viterbi pass over four grammar states.

A conversation is well formed if the initials of its roles read `(s?(ua)+)?`. Rows are damaged, or taken as they are; faulty rows
are found; and the cheapest edits are sought that leave a well-formed conversation: keep, give another role, delete, insert. The
pass goes through a conversation in order and carries for each state (nothing yet, system, user, assistant) the least (cost,
audit), an audit being the initials of the edits so far. After each row the layer is closed by inserts; two at most, since a third
comes back to a state that is cheaper already. Appending the same edits keeps the order of two audits of one cost, because an audit
that goes on where another ends has inserts more and so costs more; so the least audit of each state is all that is needed.

Rows of a conversation are sorted by Spark and streamed, not collected. What all carried audits agree on is settled and goes to
the hash of the repaired conversation, and only rows whose edits are still open are held. A state that can't win any more is let
go: everything that follows nothing or a system turn can follow an assistant turn too, for one deletion more at most. Whether a row
repeats an earlier one is found by a window over (conversation, role, text), so that no task keeps a conversation's texts. The hash
is over one conversation's text in order, which only one task can compute; it streams.

Null role or text counts as one space, a null part of the key of the damage as one space too. Rows of one turn are ordered by
role, then text, nulls of turn first; rows of a null conv_id are one conversation. Extra columns are ignored. A conversation
without rows left has zeros, an empty audit and the hash of nothing. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .exchange import partitions

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 60
SPACE = "\t\n\x0b\x0c\r "
#: state that an expected turn leads to, and its role
NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
DROP, BLANK, STRIP, REPEAT, AS_USER = range(5)
RESULT = "conv_id {}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def kept_as(turns: DataFrame) -> DataFrame:
    """Rows as they are: conv_id, turn, role, text, copies."""
    said = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    return turns.select("conv_id", "turn", said("role"), said("text"), F.lit(1).alias("copies"))


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: how often the row occurs after damage, 0 to 2."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.encode(F.concat_ws(":", part("conv_id"), part("turn")), "UTF-8")) % 20
    own = turns.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), code.alias("_code"))
    code = F.col("_code")
    return own.select(
        "conv_id", "turn", F.when(code == AS_USER, "user").otherwise(F.col("role")).alias("role"),
        F.when(code == BLANK, "").when(code == STRIP, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(code == DROP, 0).when(code == REPEAT, 2).otherwise(1).alias("copies")
    )


def _repeats() -> Column:
    """Whether a row that occurs has role and text of an earlier one that does."""
    same = Window.partitionBy("conv_id", "role", F.sha2(F.encode("text", "UTF-8"), 256), F.col("copies") > 0).orderBy(F.asc_nulls_first("turn"))
    return F.row_number().over(same) > 1


class Conversation:
    """Takes the rows of one conversation in order; result() gives its row."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.least = self.most = self.turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before = None  # role initial of the row before
        self.layer = [(0, "")] + [(FAR, "")] * 3
        self.close()
        self.open: list[tuple[str, str]] = []  # rows whose edits aren't settled
        self.settled: list[str] = []
        self.state, self.first, self.hash = NOTHING, True, hashlib.sha256()

    def add(self, turn, role: str, text: str, repeats: bool) -> None:
        if turn is not None and turn != self.turn:
            self.least = turn if self.least is None else self.least
            self.most, self.turn, self.turns = turn, turn, self.turns + 1
        initial = role[:1]
        if self.before is not None and self.before + initial not in LEGAL:
            self.illegal += 1
        self.before = initial
        end = len(text.rstrip(SPACE))
        blank, truncated = end == 0, end > 0 and text[end - 1] not in ".!?"
        self.blank += blank
        self.duplicate += repeats and not blank
        truncated = truncated and not repeats
        self.truncated += truncated
        self.open.append((role, text))
        self.step(initial, blank or repeats, TRUNCATED if truncated else 0)
        self.settle()

    def step(self, initial: str, must_go: bool, more: int) -> None:
        """The layer after one more row."""
        old = self.layer
        new = [(c + DELETE, a + "D") for c, a in old]
        if not must_go:
            for state, (c, a) in enumerate(old):
                if c >= FAR:
                    continue
                to = NEXT[state]
                if initial == "s" and state == NOTHING:
                    new[SYSTEM] = min(new[SYSTEM], (c + more, a + "K"))
                if initial == ROLES[to][0]:
                    new[to] = min(new[to], (c + more, a + "K"))
                new[to] = min(new[to], (c + more + REROLE, a + "R"))
        self.layer = new
        self.close()
        done = new[ASSISTANT][0]
        if done < new[SYSTEM][0]:
            new[SYSTEM] = (FAR, "")
        if done + DELETE < new[NOTHING][0]:
            new[NOTHING] = (FAR, "")

    def close(self) -> None:
        """Bounded inserts: what one leads to, then what a second leads to."""
        layer = self.layer
        for _ in range(2):
            for state, (c, a) in list(enumerate(layer)):
                if c < FAR:
                    layer[NEXT[state]] = min(layer[NEXT[state]], (c + INSERT, a + "I"))

    def settle(self, audit: str | None = None) -> None:
        """Edits that all carried audits begin with, or the given ones, are made."""
        alive = [a for c, a in self.layer if c < FAR]
        edits = os.path.commonprefix(alive) if audit is None else audit
        if not edits:
            return
        used = 0
        for e in edits:
            if e == "I":
                role, text = ROLES[NEXT[self.state]], ""
            else:
                role, text = self.open[used]
                used += 1
                if e == "D":
                    continue
                if e == "R":
                    role = ROLES[NEXT[self.state]]
            self.state = SYSTEM if e == "K" and self.state == NOTHING and role[:1] == "s" else NEXT[self.state]
            self.hash.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
            self.first = False
        del self.open[:used]
        self.settled.append(edits)
        if audit is None:
            self.layer = [(c, a[len(edits):]) for c, a in self.layer]

    def result(self) -> tuple:
        cost, audit = min(self.layer[NOTHING], self.layer[ASSISTANT])
        self.settle(audit)
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return (
            self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(self.settled),
            self.hash.hexdigest()
        )


def repaired(turns: DataFrame) -> DataFrame:
    """One row a conversation; turns as kept_as() or damaged() give them."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    marked = turns.withColumn("repeats", _repeats())
    ordered = marked.repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions(
        F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text", "repeats"
    )

    def run(batches):
        now, out, schema = None, [], None

        def rows():
            columns = zip(*out) if out else [[]] * 9
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema)], NAMES)
            out.clear()
            return batch

        for batch in batches:
            schema = [batch.schema.field(0).type, *[pa.int64()] * 6, pa.string(), pa.string()]
            for conv, turn, role, text, copies, repeats in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or conv != now.conv_id:
                    if now is not None:
                        out.append(now.result())
                    now = Conversation(conv)
                for i in range(copies):
                    now.add(turn, role, text, repeats or i > 0)
            yield rows()
        if now is not None:
            out.append(now.result())
            yield rows()

    NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return ordered.select("conv_id", "turn", "role", "text", "copies", "repeats").mapInArrow(run, RESULT.format(kind))
