"""Chat formatting: a finite-state machine over roles and a declarative template."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced


@dataclass(frozen=True)
class Role:
    """How a turn of a role is marked, whether its text counts in the loss, and
    which roles may follow it."""

    open: str
    loss: bool
    then: tuple[str, ...]


@dataclass(frozen=True)
class Template:
    """All of the format is here: markers, loss flags and the state machine."""

    roles: dict[str, Role]
    start: tuple[str, ...]
    end: tuple[str, ...]
    close: str = " </turn>\n"
    control: tuple[str, ...] = ("###", "</turn>")
    #: marks a role that the template doesn't know; its name follows, escaped
    other: str = "### @"
    colon: str = ": "
    escape: str = "\\"
    special: re.Pattern = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "special", re.compile("|".join(map(re.escape, (self.escape, *self.control)))))


DEFAULT = Template(
    roles={
        "system": Role("### System: ", False, ("user",)),
        "user": Role("### User: ", False, ("assistant",)),
        "assistant": Role("### Assistant: ", True, ("user",)),
    },
    start=("system", "user"),
    end=("user", "assistant"),
)


def escaped(text: str, t: Template = DEFAULT) -> str:
    """Every escape sign and control string gets an escape sign before it."""
    return t.special.sub(lambda m: t.escape + m[0], text)


def unescaped(text: str, t: Template = DEFAULT) -> str:
    """Inverse of :func:`escaped`."""
    return re.sub(re.escape(t.escape) + f"({t.special.pattern})", lambda m: m[1], text)


def segments(role: str, text: str, t: Template = DEFAULT) -> list[tuple[str, bool]]:
    """The output of one turn as (segment, counts in the loss)."""
    known = t.roles.get(role)
    mark = known.open if known else t.other + escaped(role, t).replace(t.colon, t.escape + t.colon) + t.colon
    return [(mark, False), (escaped(text, t), bool(known and known.loss)), (t.close, False)]


class Reader:
    """Reads formatted text back, piece by piece: feed() yields (role, text) of
    each turn that is complete."""

    def __init__(self, t: Template = DEFAULT):
        self.t, self.rest = t, ""
        esc = re.escape(t.escape)
        self.stop = re.compile(f"{esc}(?:{t.special.pattern})|({re.escape(t.close)})")
        self.name = re.compile(f"{esc}(?:{t.special.pattern}|{re.escape(t.colon)})|({re.escape(t.colon)})")

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        self.rest += piece
        while turn := self._turn():
            yield turn

    def _turn(self) -> tuple[str, str] | None:
        t, s = self.t, self.rest
        at = next(((name, len(r.open)) for name, r in t.roles.items() if s.startswith(r.open)), None)
        if at is None:
            if not s.startswith(t.other) or not (end := next((m for m in self.name.finditer(s, len(t.other)) if m[1]), None)):
                return None
            at = unescaped(s[len(t.other) : end.start()].replace(t.escape + t.colon, t.colon), t), end.end()
        role, begin = at
        end = next((m for m in self.stop.finditer(s, begin) if m[1]), None)
        if end is None:
            return None
        self.rest = s[end.end() :]
        return role, unescaped(s[begin : end.start()], t)


class _Conversation:
    """State of one conversation: a few hashes and counters, however many turns it has."""

    def __init__(self, conv_id, t: Template):
        self.conv_id, self.t, self.reader = conv_id, t, Reader(t)
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0
        self.valid, self.last = True, None

    def add(self, role: str | None, text: str | None) -> None:
        t, role, text = self.t, role or "", text or ""
        allowed = t.start if self.last is None else t.roles[self.last].then if self.last in t.roles else ()
        self.valid &= role in allowed
        self.last = role
        parts = segments(role, text, t)
        self.chars += sum(len(s) for s, _ in parts)
        for r, x in self.reader.feed("".join(s for s, _ in parts)):
            self.n += 1
            self.turns.update(f"{r}\n{x}\n".encode())
            if r in t.roles and t.roles[r].loss:
                self.loss_chars += len(x)
                self.loss.update(x.encode())

    def row(self) -> tuple:
        ok = self.valid and self.last in self.t.end
        return self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, ok


def _sorted(conversations: DataFrame) -> DataFrame:
    # A conversation is read as a stream, in order: no task holds one whole.
    return conversations.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_segments(conversations: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """The formatted corpus: one row for each segment, ``(conv_id, turn_no,
    segment_no, text, loss, turn_valid)``.

    Turns are ordered by turn, then role, then text, nulls first; repeated rows
    are turns of their own. A null text is empty, a null role is the role "".
    ``turn_valid`` is the state machine's verdict on the turn (unknown roles are
    marked by the template's general marker and never valid). Concatenating the
    segments of a conversation gives its text. A null conv_id is one
    conversation; conv_id may be of any type. Texts and conversations of any
    length are read in order, some rows at a time. An empty table gives an empty table; other columns are ignored.
    """

    schema = f"conv_id {dict(conversations.dtypes)['conv_id']}, turn_no long, segment_no int, text string, loss boolean, turn_valid boolean"
    names = ["conv_id", "turn_no", "segment_no", "text", "loss", "turn_valid"]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_()]

    def rows(batches):
        last = seen = None
        n = 0
        for b in sliced(batches):
            out = []
            for conv_id, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if seen is None or conv_id != seen[0]:
                    seen, last, n = (conv_id,), None, 0
                role = role or ""
                allowed = template.start if last is None else template.roles[last].then if last in template.roles else ()
                out += [(conv_id, n, k, s, loss, role in allowed) for k, (s, loss) in enumerate(segments(role, text or "", template))]
                last, n = role, n + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [b.schema.field("conv_id").type, *kinds], strict=True)], names=names)

    return _sorted(conversations).mapInArrow(rows, schema)


def format_digests(conversations: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Formats every conversation, reads the output back and returns, per
    conversation, digests of what was read: ``(conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars, valid)``. Cases as in
    :func:`format_segments`; ``valid`` is the state machine's verdict on the
    whole conversation."""
    schema = f"conv_id {dict(conversations.dtypes)['conv_id']}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]

    def batch(out, kind):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate([kind, *kinds])], names=names)

    def rows(batches):
        now = kind = None
        for b in sliced(batches):
            out, kind = [], b.schema.field("conv_id").type
            for conv_id, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        out.append(now.row())
                    now = _Conversation(conv_id, template)
                now.add(role, text)
            if out:
                yield batch(out, kind)
        if now is not None:
            yield batch([now.row()], kind)

    return _sorted(conversations).mapInArrow(rows, schema)


#: The contract's own conversation.
PROBE_ID, PROBE_TEXT = -7, r"\### Assistant: </turn> ok"


def op10_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(PROBE_ID).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE_TEXT).alias("text"),
    )
    return format_digests(rows.unionByName(probe))


OP10_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), checked AS (
  SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn)) AS loss_sha256,
       CAST(sum(CASE role WHEN 'system' THEN 12 WHEN 'user' THEN 10 ELSE 15 END + 9
           + length(regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g'))) AS BIGINT) AS formatted_chars,
       bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user')
                     WHEN before IN ('system', 'assistant') THEN role = 'user' ELSE role = 'assistant' END
                AND (after IS NOT NULL OR role IN ('user', 'assistant'))) AS valid
FROM checked GROUP BY conv_id
"""
