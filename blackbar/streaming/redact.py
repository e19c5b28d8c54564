"""Redaction of chunk streams with Structured Streaming.

Chunks arrive in any order and possibly twice. Per stream the state holds the few pending
bytes, the next expected ``seq`` and chunks that came early; output rows are those of
the batch operator ``redact_chunked``. The per-stream step is the only Python here.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from blackbar.functions.patterns import NESTED, TOKEN, Dictionary, as_dictionary, match_regex, suffix_regex
from blackbar.functions.utf8 import TRUNCATED
from blackbar.operators.chunks import DEFAULT_CAPACITY

IDLE_MS = 15_000
RETAIN_MS = 3_600_000
_BATCH_ROWS = 10_000

_STATE = (
    "pending binary, next_seq bigint, status string, "
    "early_seq array<bigint>, early_chunk array<binary>, early_eof array<boolean>"
)
_TAIL = re.compile(f"(?:{TRUNCATED})$")


@dataclass
class StreamState:
    pending: bytes = b""
    next_seq: int = 0
    status: str = "open"
    early: dict[int, tuple[bytes, bool]] = field(default_factory=dict)

    def as_row(self) -> tuple:
        seqs = sorted(self.early)
        return (
            self.pending,
            self.next_seq,
            self.status,
            seqs,
            [self.early[s][0] for s in seqs],
            [self.early[s][1] for s in seqs],
        )

    @classmethod
    def from_row(cls, row: tuple) -> StreamState:
        pending, next_seq, status, seqs, chunks, eofs = row
        early = {s: (bytes(c), e) for s, c, e in zip(seqs, chunks, eofs)}
        return cls(bytes(pending), next_seq, status, early)


@dataclass(frozen=True)
class StreamRules:
    """What the step needs of a dictionary, small enough to travel with the task."""

    match: re.Pattern | None
    partial: re.Pattern | None
    long: tuple[bytes, ...]
    longest: int
    token: bytes
    capacity: int
    early_bytes: int | None


def stream_rules(
    words: list[bytes], token: bytes, capacity: int, early_bytes: int | None = None
) -> StreamRules:
    suffix = suffix_regex([w.decode("latin-1") for w in words if len(w) <= NESTED])
    return StreamRules(
        re.compile(match_regex([w.decode("latin-1") for w in words]).encode("latin-1")) if words else None,
        # The end of the text is spelled differently in Java.
        re.compile(suffix[:-2].encode("latin-1") + rb"\Z") if suffix else None,
        tuple(w for w in words if len(w) > NESTED),
        max(map(len, words), default=0),
        token,
        capacity,
        early_bytes,
    )


def _cut_off(data: bytes) -> int:
    """Bytes of an unfinished last character."""
    for n in (3, 2, 1):
        if n <= len(data) and _TAIL.fullmatch(data[-n:].hex().upper()):
            return n
    return 0


_PROBE = 16


def _begun(data: bytes, word: bytes) -> int:
    """Length of the longest end of ``data`` that is a proper prefix of ``word``."""
    data = data[-(len(word) - 1) :]
    probe = word[:_PROBE]
    at = data.find(probe)
    while at >= 0:
        if word.startswith(data[at:]):
            return len(data) - at
        at = data.find(probe, at + 1)
    return next((n for n in range(min(_PROBE - 1, len(data)), 0, -1) if probe.startswith(data[-n:])), 0)


def push(state: StreamState, chunk: bytes, eof: bool, rules: StreamRules) -> bytes:
    """Take the next chunk; returns what may be sent and sets the status."""
    source = state.pending + chunk
    state.pending = b""
    tail = _cut_off(source)
    try:
        source[: len(source) - tail].decode("utf-8")
    except UnicodeDecodeError:
        state.status = "invalid_utf8"
        return b""
    sent, last = [], 0
    for m in rules.match.finditer(source) if rules.match else ():
        sent += (source[last : m.start()], rules.token)
        last = m.end()
    held = tail
    if rules.partial is not None:
        m = rules.partial.search(source, max(last, len(source) - rules.longest + 1))
        held = max(held, len(m.group()) if m else 0)
    for word in rules.long:
        held = max(held, _begun(source[last:], word))
    if eof:
        state.status = "rejected_at_end" if tail else "completed"
        held = 0 if not tail else held
    cut = len(source) - held
    sent.append(source[last:cut])
    if state.status == "open":
        state.pending = source[cut:]
        if len(state.pending) > rules.capacity:
            state.status, state.pending = "buffer_limit", b""
            return b""
    return b"".join(sent)


def advance(
    state: StreamState, arrivals: Iterable[tuple[int, bytes, bool]], rules: StreamRules
) -> Iterator[tuple[int, bytes, str]]:
    """Rows for the chunks that have their turn: ``(seq, redacted, status)``.

    Chunks already taken are dropped, chunks ahead of their turn wait in the state, and
    chunks beyond the end of a stream are answered with ``late``.
    """


    def ready() -> Iterator[tuple[int, bytes, str]]:
        while state.status == "open" and state.next_seq in state.early:
            chunk, eof = state.early.pop(state.next_seq)
            sent = push(state, chunk, eof, rules)
            yield state.next_seq, sent, state.status
            state.next_seq += 1

    for seq, chunk, eof in arrivals:
        if seq >= state.next_seq:
            state.early.setdefault(seq, (chunk, eof))
            yield from ready()
    yield from ready()
    if state.status == "open":
        waiting = sum(len(c) for c, _ in state.early.values())
        if rules.early_bytes is not None and waiting > rules.early_bytes:
            state.status, state.pending = "reorder_limit", b""
            yield state.next_seq, b"", state.status
    if state.status != "open":
        for seq in sorted(state.early):
            yield seq, b"", "late"
        state.early = {}


def redact_stream(
    chunks: DataFrame,
    vault: DataFrame | Dictionary,
    key: str = "stream_id",
    seq: str = "seq",
    chunk: str = "chunk",
    eof: str = "eof",
    token: str = TOKEN,
    capacity: int = DEFAULT_CAPACITY,
    early_bytes: int | None = None,
    idle_ms: int | None = IDLE_MS,
    retain_ms: int = RETAIN_MS,
) -> DataFrame:
    """``key, seq, redacted BINARY, status`` rows as they become safe to send.

    ``seq`` counts from 0 without gaps; the ``eof`` row ends a stream. Chunks that come early
    wait in the state; a caller who must bound it sets ``early_bytes``, beyond which a stream
    ends with reorder_limit. A stream without
    new chunks for ``idle_ms`` is ended with idle_timeout and its pending bytes are not
    sent. An ended stream is remembered for ``retain_ms`` to recognise late chunks.
    ``idle_ms=None`` sets no timers: for runs over landed data with an ``availableNow``
    trigger, which does not come to an end while timers are set.
    """
    d = as_dictionary(vault)
    rules = stream_rules([w.encode() for w in d.words], token.encode(), capacity, early_bytes)
    # The step travels with the query, so workers need not have this package installed.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    rows = chunks.select(
        key,
        F.col(seq).cast("bigint").alias("seq"),
        F.coalesce(F.col(chunk), F.expr("X''")).alias("chunk"),
        F.coalesce(F.col(eof), F.lit(False)).alias("eof"),
    )

    def step(
        group: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        current = StreamState.from_row(state.get) if state.exists else StreamState()
        if state.hasTimedOut:
            if current.status != "open":
                state.remove()
                return
            current.status, current.pending = "idle_timeout", b""
            out = [(current.next_seq, b"", current.status)]
            out += list(advance(current, [], rules))
        else:
            arrivals = (
                (int(s), bytes(c), bool(e))
                for batch in batches
                for s, c, e in zip(batch["seq"], batch["chunk"], batch["eof"])
            )
            out = advance(current, arrivals, rules)
        block: list[tuple] = []
        for row in out:
            block.append(row)
            if len(block) == _BATCH_ROWS:
                yield _frame(group, block)
                block = []
        if block:
            yield _frame(group, block)
        state.update(current.as_row())
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms if current.status == "open" else retain_ms)

    def _frame(group: tuple, block: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(block, columns=["seq", "redacted", "status"])
        frame.insert(0, key, group[0])
        return frame

    key_type = chunks.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandasWithState(
        step,
        outputStructType=f"`{key}` {key_type}, seq bigint, redacted binary, status string",
        stateStructType=_STATE,
        outputMode="append",
        timeoutConf=(
            GroupStateTimeout.NoTimeout
            if idle_ms is None
            else GroupStateTimeout.ProcessingTimeTimeout
        ),
    )
