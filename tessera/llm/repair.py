"""Conversation structure repair by a forward Viterbi search over four grammar states.

A repaired conversation's role initials read ``(s?(ua)+)?``: nothing, or user
and assistant in turns, with a system row before them at most. Rows come in
their order; a layer holds for each state (nothing yet, after s, after u,
after a) the cheapest edits that lead there, with their audit string. A row is
kept, given another role or deleted; each layer is closed by insert
transitions, two in a row at most, as a third leads back to a dearer state.

Rows of a conversation stream through a task in order: besides the layer,
whose audit strings share all but their ends, nothing of them is held, unless
their texts are asked for. So a conversation may have any number of rows.
"""

from __future__ import annotations

import hashlib
import os
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import free, session, table

#: States of the grammar, and where a role's initial leads from each.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
ROLES = {"u": "user", "a": "assistant"}
#: Costs of the edits: their initials make the audit string.
RETYPE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
#: Pairs of neighbouring role initials that are legal.
LEGAL = {"su", "ua", "au"}
BLANKS = " \t\n\v\f\r"
#: Rows after which what all audit strings share is set aside.
SHARED = 64

COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class Path(NamedTuple):
    """The cheapest edits to a state: their cost, the end of their audit string, and what they have emitted."""

    cost: int
    audit: str
    trail: Digest | Texts


class Digest:
    """SHA-256 of the repaired rows so far, without the rows."""

    __slots__ = ("hash", "any")

    def __init__(self, hash_=None, any_: bool = False):
        self.hash, self.any = hash_ or hashlib.sha256(), any_

    def then(self, role: str, text: str) -> Digest:
        new = self.hash.copy()
        new.update(f"{chr(10) * self.any}{role}:{text}".encode("utf-8", "surrogatepass"))
        return Digest(new, True)

    def rows(self) -> list | None:
        return None

    def digest(self) -> str:
        return self.hash.hexdigest()


class Texts(Digest):
    """The digest, and the repaired rows themselves as a chain."""

    __slots__ = ("chain",)

    def __init__(self, hash_=None, any_: bool = False, chain: tuple = ()):
        super().__init__(hash_, any_)
        self.chain = chain

    def then(self, role: str, text: str) -> Texts:
        new = super().then(role, text)
        return Texts(new.hash, True, (self.chain, role, text))

    def rows(self) -> list:
        out, at = [], self.chain
        while at:
            at, role, text = at
            out.append({"role": role, "text": text})
        return out[::-1]


class Conversation:
    """One conversation's counts and its layer, row by row."""

    def __init__(self, texts: bool):
        self.turns: tuple[int, int, int] | None = None  # smallest, largest, number of different
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.last: str | None = None
        self.audit: list[str] = []
        self.n = 0
        self.layer: dict[int, Path] = close({START: Path(0, "", Texts() if texts else Digest())})

    def row(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        if turn is not None:
            low, high, n = self.turns or (turn, turn, 1)
            self.turns = (low, turn, n + (turn != high))
        end = text.rstrip(BLANKS)[-1:]
        blank, cut_off = not end, end not in ".!?"
        duplicate = seen and not blank
        cut_off = cut_off and not (blank or duplicate)
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += cut_off
        initial = role[:1]
        if self.last is not None:
            self.illegal += self.last + initial not in LEGAL
        self.last = initial
        self.layer = close(step(self.layer, role, text, blank or duplicate, cut_off))
        self.n += 1
        if self.n % SHARED == 0:
            shared = os.path.commonprefix([p.audit for p in self.layer.values()])
            self.audit.append(shared)
            self.layer = {s: p._replace(audit=p.audit[len(shared) :]) for s, p in self.layer.items()}

    def result(self) -> dict:
        best = min((p for s, p in self.layer.items() if s in (START, ASSISTANT)), key=lambda p: p[:2])
        gaps = self.turns[1] - self.turns[0] + 1 - self.turns[2] if self.turns else 0
        gaps = (gaps + (1 << 63)) % (1 << 64) - (1 << 63)  # as numbers of 64 bits go round
        counts = (gaps, self.blank, self.duplicate, self.truncated, self.illegal, best.cost)
        return dict(zip(COUNTS, counts, strict=True)) | {"audit": "".join(self.audit) + best.audit, "repaired_sha256": best.trail.digest(), "repaired": best.trail.rows()}


def better(layer: dict[int, Path], state: int, path: Path, role: str | None = None, text: str = "") -> None:
    """Puts a path, and the row it emits last, into the layer if it is the cheapest to its state; of equals the least audit."""
    if state not in layer or path[:2] < layer[state][:2]:
        layer[state] = path if role is None else path._replace(trail=(path.trail, role, text))


def emitted(layer: dict[int, Path]) -> dict[int, Path]:
    """The layer with what its winners emit."""
    return {s: p._replace(trail=p.trail[0].then(*p.trail[1:])) if isinstance(p.trail, tuple) else p for s, p in layer.items()}


def step(layer: dict[int, Path], role: str, text: str, must_go: bool, cut_off: bool) -> dict[int, Path]:
    """The layer after a row: deleted, kept or given another role."""
    new: dict[int, Path] = {}
    for state, (cost, audit, trail) in layer.items():
        better(new, state, Path(cost + DELETE, audit + "D", trail))
        if must_go:
            continue
        for initial, to in NEXT[state].items():
            if role[:1] == initial:
                better(new, to, Path(cost + CUT_OFF * cut_off, audit + "K", trail), role, text)
            elif initial in ROLES:
                better(new, to, Path(cost + RETYPE + CUT_OFF * cut_off, audit + "R", trail), ROLES[initial], text)
    return emitted(new)


def close(layer: dict[int, Path]) -> dict[int, Path]:
    """The layer with rows inserted after it: a user row first, then an assistant row."""
    for initial in "ua":
        new = dict(layer)
        for state, (cost, audit, trail) in layer.items():
            if initial in NEXT[state]:
                better(new, NEXT[state][initial], Path(cost + INSERT, audit + "I", trail), ROLES[initial])
        layer = emitted(new)
    return layer


def damage(rows: DataFrame) -> DataFrame:
    """Rows ``(conv_id, turn, role, text, gone)`` damaged by crc32(``conv_id:turn``) % 20; nulls count as one space.

    0 drops a row (it stays as ``gone``, so that its conversation is known),
    1 empties its text, 2 removes its ``[.!?]``, 3 repeats it, 4 makes it a
    user's.
    """
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fault = F.crc32(F.concat_ws(":", *named).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(fault == 4, "user").otherwise(role)
    copies = F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (fault == 0).alias("gone"), copies.alias("copy")).drop("copy")


def repair(rows: DataFrame, texts: bool = True) -> DataFrame:
    """One row for each conversation of ``rows(conv_id, turn, role, text[, gone])``: counts, audit and repaired rows.

    ``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256, repaired)``; ``repaired`` is an array of (role, text), or
    null without ``texts``: then a conversation's texts are never held
    together. Rows go by turn, nulls first; those of one turn by role and
    text. Null roles and texts count as one space, a null conv_id is a
    conversation of its own; repeated rows are duplicates; ``gone`` rows count
    for nothing but that their conversation is there; a conversation without
    other rows has zeros, an empty audit and the hash of nothing; texts of any
    length are taken whole; other columns are ignored; an empty table gives an
    empty result.

    One shuffle by conversation; duplicates and the order of rows are sorts
    within its partitions, which spill. A conversation is hashed as a whole,
    so its rows pass one task, as a stream.
    """
    session(rows)
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
    dealt = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role, text, gone.alias("gone")).repartition("conv_id")
    (seen,) = free(dealt, "seen")
    # What is dealt by conversation is dealt by conversation, role and text too: the window needs no shuffle of its own.
    place = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.asc_nulls_first("turn")))
    ordered = dealt.withColumn(seen, place > 1).sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", seen)

    def run(batches):
        schema = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string()), ("repaired", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))])
        current, conversation = None, None
        for batch in batches:
            done = []
            for conv_id, turn, role, text, gone, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conversation is None or conv_id != current:
                    if conversation is not None:
                        done.append({"conv_id": current} | conversation.result())
                    current, conversation = conv_id, Conversation(texts)
                if not gone:
                    conversation.row(turn, role, text, again)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if conversation is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": current} | conversation.result()], schema)

    kinds = "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string, repaired array<struct<role: string, text: string>>"
    return ordered.select("conv_id", "turn", "role", "text", "gone", seen).mapInArrow(run, kinds)


def op11(spark, sf_dir: str) -> DataFrame:
    return repair(damage(table(spark, sf_dir, "conversations")), texts=False).drop("repaired")


def _best(*paths: str) -> str:
    """SQL: the least of paths, which are structs (cost, audit, rows)."""
    return f"list_sort([{', '.join(paths)}])[1]"


def _then(path: str, cost: str, edit: str, row: str = "''") -> str:
    """SQL: a path after an edit that emits ``row``."""
    rows = path + ".t" if row == "''" else f"CASE WHEN {path}.t = '' THEN {row} ELSE {path}.t || chr(10) || {row} END"
    return f"{{'c': {path}.c + {cost}, 'a': {path}.a || '{edit}', 't': {rows}}}"


def _sql() -> str:
    """The whole query as SQL: the bytes' checksums by a table, layers by a recursion over the rows of conversations."""
    never = "{'c': 1000000000::BIGINT, 'a': '', 't': ''}"

    def into(initial: str, *states: str) -> list[str]:
        out = []
        for state in (f"p.{s}" for s in states):
            keep = _then(state, "r.cut", "K", "(r.role || ':' || r.text)")
            out.append(f"CASE WHEN r.role[1] = '{initial}' AND NOT r.bad THEN {keep} ELSE {never} END")
            if initial in ROLES:
                retype = _then(state, "r.cut + 2", "R", f"('{ROLES[initial]}:' || r.text)")
                out.append(f"CASE WHEN r.role[1] <> '{initial}' AND NOT r.bad THEN {retype} ELSE {never} END")
        return out

    gone = [_then(f"p.q{i}", "3", "D") for i in range(4)]
    closed_u = _best("w.q2", *(_then(f"w.q{i}", "2", "I", "'user:'") for i in (0, 1, 3)))
    closed_a = _best("w.q3", _then("w.q2", "2", "I", "'assistant:'"))
    start = "SELECT conv_id, 0::BIGINT AS k, {'c': 0::BIGINT, 'a': '', 't': ''} AS q0, " + f"{never} AS q1, {{'c': 2::BIGINT, 'a': 'I', 't': 'user:'}} AS q2, {{'c': 4::BIGINT, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:'}} AS q3 FROM (SELECT DISTINCT conv_id FROM hashed)"
    moved = f"SELECT p.conv_id, r.k, {gone[0]} AS q0, {_best(gone[1], *into('s', 'q0'))} AS q1, {_best(gone[2], *into('u', 'q0', 'q1', 'q3'))} AS q2, {_best(gone[3], *into('a', 'q2'))} AS q3 FROM dp p JOIN rows r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.k = p.k + 1"
    return f"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([i] || range(8), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) x(i)
), hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT),
      lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]))) % 20 AS h
  FROM conversations, crc
), damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hashed WHERE h <> 0
), placed AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM damaged
), faults AS (
  SELECT *, body = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AND body <> '' AS dup,
    lag(role[1]) OVER (PARTITION BY conv_id ORDER BY k) || role[1] AS pair FROM placed
), rows AS MATERIALIZED (
  SELECT *, blank OR dup AS bad, (NOT blank AND NOT dup AND right(body, 1) NOT IN ('.', '!', '?'))::BIGINT AS cut FROM faults
), dp AS (
  {start}
  UNION ALL
  SELECT conv_id, k, q0, q1, q2, {closed_a} AS q3 FROM (SELECT conv_id, k, q0, q1, {closed_u} AS q2, q3 FROM ({moved}) w) w
), ends AS (
  SELECT conv_id, arg_max({_best("q0", "q3")}, k) AS e FROM dp GROUP BY conv_id
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank::BIGINT)::BIGINT AS blank, sum(dup::BIGINT)::BIGINT AS duplicate,
    sum(cut)::BIGINT AS truncated, coalesce(sum((pair NOT IN ('su', 'ua', 'au'))::BIGINT), 0)::BIGINT AS illegal FROM rows GROUP BY conv_id
)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  e.e.c AS cost, e.e.a AS audit, sha256(e.e.t) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""


OP11_SQL = _sql()
