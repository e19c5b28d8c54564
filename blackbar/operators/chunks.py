"""Ordered byte chunks of many streams: cut, check, redact, account.

A chunk table has a stream key, an integer order ``seq`` (unique within the stream) and a
BINARY ``chunk``; chunks may cut characters and patterns anywhere. Results never depend
on where a stream was cut. No operator gathers a stream in one task: what a chunk needs
to know about the bytes before it (a few bytes, or a small state) is computed by an
ordered scan over narrow rows, then joined back to the chunk on (stream, seq), which is
spread evenly however long a stream is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blackbar.functions.patterns import (
    TOKEN,
    Dictionary,
    as_bytes_text,
    as_dictionary,
    bytes_text,
    quote_replacement,
    text_bytes,
)
from blackbar.functions.utf8 import (
    TRUNCATED,
    truncated_tail,
    utf8_state,
    well_formed,
    without_tail,
)
from blackbar.plans.ordered import ordered_scan, recut
from blackbar.session import cut_lineage

Vault = DataFrame | Dictionary

DEFAULT_CAPACITY = 64 * 1024
EMPTY = "X''"
# Numbers to a block and bytes to a stretch within which small chunks are joined.
_PACK_BITS = 10
_PACK_BYTES = 64 * 1024


# -- cutting -----------------------------------------------------------------------


def slice_segments(
    df: DataFrame, keys: list[str], bin_col: str, max_bytes: int, piece_no: str = "piece_no"
) -> DataFrame:
    """Cut every value into pieces of at most ``max_bytes``; an empty value has none."""
    if max_bytes <= 0:
        raise ValueError("max_bytes must be positive")
    starts = F.sequence(F.lit(0), F.octet_length(bin_col) - 1, F.lit(max_bytes))
    pieces = F.transform(
        starts,
        lambda start, no: F.struct(
            no.alias(piece_no),
            F.col(bin_col).substr(start + 1, F.lit(max_bytes)).alias("bytes"),
        ),
    )
    return df.where(F.octet_length(bin_col) > 0).select(*keys, F.inline(pieces))


def chunk_table(
    df: DataFrame, key: str, text_col: str, max_bytes: int
) -> DataFrame:
    """Texts as a chunk table: ``stream_id, seq, chunk``."""
    binary = df.select(
        F.col(key).alias("stream_id"), F.encode(text_col, "UTF-8").alias("_bytes")
    )
    return slice_segments(binary, ["stream_id"], "_bytes", max_bytes, "seq").select(
        "stream_id", F.col("seq").cast("bigint").alias("seq"), F.col("bytes").alias("chunk")
    )


# -- character checks --------------------------------------------------------------


def classify_utf8(df: DataFrame, bin_col: str) -> DataFrame:
    """Add ``utf8_state`` and ``valid_len`` (bytes before a cut-off last character)."""
    state = utf8_state(F.col(bin_col))
    return df.withColumn("utf8_state", state).withColumn(
        "valid_len",
        F.when(F.col("utf8_state") == "valid", F.octet_length(bin_col)).when(
            F.col("utf8_state") == "incomplete",
            F.octet_length(bin_col) - truncated_tail(F.col(bin_col)),
        ),
    )


_SCANNED = (
    "struct<lead:binary,only:boolean,pend:binary,tail:binary,ok:boolean,ended:boolean>"
)
_PARTIAL = f"^(?:{TRUNCATED})$"


def _described(rows: DataFrame, chunk: str, size: int) -> DataFrame:
    """Add ``_seen``: all that later chunks and checks need to know of a chunk.

    A leading run of continuation bytes (``lead``; ``only``: nothing else) belongs to the
    previous character. The rest starts a character of its own and is judged without
    context (``ok``); it may end in a cut-off character (``pend``). ``tail`` holds the
    last bytes.
    """
    lead = F.regexp_extract(F.hex(F.substring(chunk, 1, 4)), "^(?:[89AB].)*", 0)
    cut = F.octet_length("_pend")
    rest_ok = well_formed(F.col("_rest")) | (
        (cut > 0) & well_formed(without_tail(F.col("_rest"), cut))
    )
    return (
        rows.withColumn("_lead", F.unhex(lead))
        .withColumn("_rest", F.col(chunk).substr(F.octet_length("_lead") + 1, F.octet_length(chunk)))
        .withColumn("_pend", _suffix(F.col("_rest"), truncated_tail(F.col("_rest"))))
        .withColumn(
            "_seen",
            F.struct(
                F.col("_lead").alias("lead"),
                (F.octet_length(chunk) == F.octet_length("_lead")).alias("only"),
                F.col("_pend").alias("pend"),
                F.substring(chunk, -size, size).alias("tail"),
                rest_ok.alias("ok"),
                F.col("_eof").alias("ended"),
            ),
        )
        .drop("_lead", "_rest", "_pend")
    )


def _seam_ok(before: Column, seen: Column) -> Column:
    """Whether the character cut off before may go on with the lead of the next chunk."""
    seam = F.concat(before["pend"], seen["lead"])
    return well_formed(seam) | (seen["only"] & F.rlike(F.hex(seam), F.lit(_PARTIAL)))


def _pending_character(before: Column, seen: Column) -> Column:
    """Bytes of a character still cut off after the next chunk."""
    seam = F.concat(before["pend"], seen["lead"])
    return (
        F.when(~seen["only"], seen["pend"])
        .when(well_formed(seam), F.expr(EMPTY))
        .otherwise(seam)
    )


def _joined(size: int):
    """Description of two neighbouring stretches of a stream taken as one."""

    def combine(a, b):
        return F.struct(
            F.when(a["only"], F.substring(F.concat(a["lead"], b["lead"]), 1, 4))
            .otherwise(a["lead"])
            .alias("lead"),
            (a["only"] & b["only"]).alias("only"),
            F.when(a["only"] & b["only"], F.expr(EMPTY))
            .otherwise(_pending_character(a, b))
            .alias("pend"),
            F.substring(F.concat(a["tail"], b["tail"]), -size, size).alias("tail"),
            (a["ok"] & b["ok"] & (a["only"] | _seam_ok(a, b))).alias("ok"),
            (a["ended"] | b["ended"]).alias("ended"),
        )

    return combine


def _nothing_seen() -> Column:
    return F.struct(
        F.expr(EMPTY).alias("lead"),
        F.lit(True).alias("only"),
        F.expr(EMPTY).alias("pend"),
        F.expr(EMPTY).alias("tail"),
        F.lit(True).alias("ok"),
        F.lit(False).alias("ended"),
    )


# -- hold-back scalar --------------------------------------------------------------


def safe_boundary(df: DataFrame, col: str, vault: Vault) -> DataFrame:
    """Split a text into ``safe`` and ``held``: what may be sent now and what must wait.

    Held is the longest proper prefix of any pattern that ends the text; a text no longer
    than the longest pattern is held whole.
    """
    d = as_dictionary(vault)
    text = F.col(col)
    if d.max_bytes <= 1:
        return df.withColumn("safe", text).withColumn("held", F.lit(""))
    partial = d.any_pending(text, as_bytes=False)
    held = F.when(F.octet_length(text) <= d.max_bytes, F.length(text)).otherwise(partial)
    return (
        df.withColumn("_held", held)
        .withColumn("safe", text.substr(F.lit(1), F.length(text) - F.col("_held")))
        .withColumn(
            "held", text.substr(F.length(text) - F.col("_held") + 1, F.col("_held"))
        )
        .drop("_held")
    )


# -- redaction of chunked streams --------------------------------------------------


def _suffix(binary: Column, length: Column) -> Column:
    return binary.substr(F.octet_length(binary) - length + 1, length)


def _checked_chunks(chunks: DataFrame, key: str, seq: str, chunk: str, eof: str | None) -> DataFrame:
    """Chunks without a key or a number are refused: no stream could take them in order."""
    missing = F.col(key).isNull() | F.col(seq).isNull()
    refused = F.raise_error(F.lit(f"a chunk has no {key} or no {seq}"))
    return chunks.select(
        F.when(missing, refused).otherwise(F.col(key)).alias(key),
        F.col(seq).cast("bigint").alias(seq),
        F.coalesce(F.col(chunk), F.expr(EMPTY)).alias(chunk),
        (F.coalesce(F.col(eof), F.lit(False)) if eof else F.lit(False)).alias("_eof"),
    )


def _plain_chunks(chunks: DataFrame, key: str, seq: str, chunk: str, eof: str | None) -> DataFrame:
    """One row per (key, seq), as chunks may be delivered twice; of different ones the least."""
    rows = _checked_chunks(chunks, key, seq, chunk, eof)
    return rows.groupBy(key, seq).agg(F.min(chunk).alias(chunk), F.bool_or("_eof").alias("_eof"))


def packed_chunks(chunks: DataFrame, key: str, seq: str, chunk: str) -> DataFrame:
    """Chunks, each once, joined with their neighbours under the first one's number.

    For work that does not depend on where a stream was cut: small chunks cost far more as
    rows than as bytes. Neighbours share a block of numbers and a stretch of ``_PACK_BYTES``,
    so what is joined is bounded by that and one chunk. One shuffle serves all steps.
    """
    rows = _checked_chunks(chunks, key, seq, chunk, None).select(
        key, F.shiftright(seq, _PACK_BITS).alias("_block"), seq, chunk
    )
    once = rows.repartition(key, "_block").groupBy(key, "_block", seq).agg(F.min(chunk).alias(chunk))
    earlier = Window.partitionBy(key, "_block").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.octet_length(chunk)).over(earlier), F.lit(0).cast("bigint"))
    stretch = F.call_function("div", start, F.lit(_PACK_BYTES).cast("bigint"))
    return (
        once.withColumn("_stretch", stretch)
        .groupBy(key, "_block", "_stretch")
        .agg(
            F.min(seq).alias(seq),
            F.expr(f"listagg(`{chunk}`) WITHIN GROUP (ORDER BY `{seq}`)").alias(chunk),
        )
        .select(key, seq, chunk)
    )


def chunk_status(
    chunks: DataFrame, size: int, key: str, seq: str, chunk: str, eof: str | None
) -> DataFrame:
    """Per chunk up to the end of its stream: ``key, seq, context, cut, cut_after, status``.

    ``context`` holds the last ``size`` bytes before the chunk; ``cut`` and ``cut_after``
    count the bytes of a cut-off character before and after it. ``status`` says whether
    the stream ends with the chunk: open, completed, rejected_at_end (a cut-off character
    at the end) or invalid_utf8; chunks after a failing one are left out.
    """
    size = max(size, 3)
    described = _described(_plain_chunks(chunks, key, seq, chunk, eof), chunk, size)
    scanned = ordered_scan(
        described.select(key, seq, "_seen"),
        [key],
        seq,
        F.col("_seen"),
        _SCANNED,
        _nothing_seen(),
        _joined(size),
        "_before",
        carry=["_seen"],
        last="_last",
    )
    before, seen = F.col("_before"), F.col("_seen")
    # A stream that begins with continuation bytes has no character to put them in.
    fine_so_far = before["ok"] & (F.octet_length(before["lead"]) == 0)
    fits = seen["ok"] & _seam_ok(before, seen)
    cut_after = F.octet_length(_pending_character(before, seen))
    status = (
        F.when(~fits, "invalid_utf8")
        .when(~(seen["ended"] if eof else F.col("_last")), "open")
        .when(cut_after > 0, "rejected_at_end")
        .otherwise("completed")
    )
    return scanned.where(fine_so_far & ~before["ended"]).select(
        key,
        seq,
        before["tail"].alias("context"),
        F.octet_length(before["pend"]).alias("cut"),
        cut_after.alias("cut_after"),
        status.alias("status"),
    )


def redact_chunked(
    chunks: DataFrame,
    vault: Vault,
    key: str = "stream_id",
    seq: str = "seq",
    chunk: str = "chunk",
    eof: str | None = None,
    token: str = TOKEN,
) -> DataFrame:
    """Redact streams of chunks: ``key, seq, redacted BINARY, status``.

    Row by row this is what a stream processor sends when the chunk arrives: the bytes
    that can no longer become part of a match. Joined in order they are the redaction of
    the whole stream, wherever it was cut. A stream ends at its last chunk, or at its
    ``eof`` row if that column is named. A stream that turns out not to be UTF-8 has
    output up to the failing chunk only; bytes still pending there are not sent. A chunk
    delivered twice counts once; a null key or ``seq`` is an error.
    """
    d = as_dictionary(vault)
    size = max(d.live_bytes - 1, 3)
    status = chunk_status(chunks, size, key, seq, chunk, eof)
    if d.chains:
        status = cut_lineage(status)
    rows = _plain_chunks(chunks, key, seq, chunk, eof).drop("_eof").join(status, [key, seq])
    context = F.col("context")
    pending = (
        F.coalesce(F.col("_state"), F.lit(0))
        if d.chains
        else d.pending_bytes(bytes_text(context))
    )
    if d.chains:
        states = _pending_states(rows, d, size, key, seq, chunk)
        rows = rows.join(states, [key, seq])

    held_before = F.greatest(pending, F.col("cut"))
    source = F.concat(_suffix(context, held_before), F.col(chunk))
    rows = rows.withColumn("_source", source)
    text = bytes_text(F.col("_source"))
    held = F.when(F.col("status") == "completed", 0).otherwise(
        F.greatest(_pending_after(text, d), F.col("cut_after"))
    )
    sent = text.substr(F.lit(1), F.length(text) - held)
    if d.byte_regex is not None:
        sent = F.regexp_replace(sent, d.byte_regex, quote_replacement(as_bytes_text(token)))
    redacted = F.when(F.col("status") == "invalid_utf8", F.expr(EMPTY)).otherwise(text_bytes(sent))
    return rows.select(key, seq, redacted.alias("redacted"), "status")


def _pending_after(text: Column, d: Dictionary) -> Column:
    """Bytes of a text, read from a clean start, that may still grow into a match."""
    if d.chains:
        # Only what follows the last match can: matches take their bytes away.
        text = F.element_at(F.split(text, d.byte_regex, -1), -1)
    return d.pending_bytes(text)


def _pending_states(
    rows: DataFrame, d: Dictionary, size: int, key: str, seq: str, chunk: str
) -> DataFrame:
    """Pending bytes before each chunk when live patterns can overlap.

    Then the bytes just before do not settle it. Each chunk becomes a function from
    pending length before to pending length after, tabulated for the lengths that its
    context allows; functions compose associatively, so an ordered scan runs them.
    """
    def after(n):
        start = bytes_text(_suffix(F.col("context"), n))
        reached = _pending_after(F.concat(start, bytes_text(F.col(chunk))), d)
        possible = (n == 0) | (
            (F.octet_length("context") >= n)
            & (d.pending_bytes(start) == F.length(start))
        )
        return F.when(possible, reached).otherwise(F.lit(0))

    lengths = F.sequence(F.lit(0), F.lit(d.live_bytes - 1))
    table = cut_lineage(rows.select(key, seq, F.transform(lengths, after).alias("_table")))
    scanned = ordered_scan(
        table,
        [key],
        seq,
        F.col("_table"),
        "array<int>",
        lengths,
        lambda a, b: F.transform(a, lambda n: F.element_at(b, n + 1)),
        "_run",
    )
    return scanned.select(key, seq, F.element_at("_run", 1).alias("_state"))


def redacted_pieces(
    redacted: DataFrame, piece_bytes: int, key: str = "stream_id", seq: str = "seq"
) -> DataFrame:
    """The redacted streams on a fixed grid: ``key, piece_no, redacted``; the same
    however the input was cut."""
    return recut(redacted, [key], seq, "redacted", piece_bytes)


# -- held bytes --------------------------------------------------------------------


def hold_limit(
    chunks: DataFrame,
    vault: Vault,
    capacity: int = DEFAULT_CAPACITY,
    key: str = "stream_id",
    seq: str = "seq",
    chunk: str = "chunk",
) -> DataFrame:
    """Per stream: ``peak_held`` bytes and ``exceeded_seq``, the chunk whose arrival left
    more than ``capacity`` bytes held (null if none).

    Follows the hold-back rule of ``safe_boundary`` chunk by chunk, up to the first chunk
    that is not valid UTF-8. How much is held after a chunk depends on how much was held
    before only while the two together are no longer than the longest pattern.
    """
    if capacity <= 0:
        raise ValueError("capacity must be positive")
    d = as_dictionary(vault)
    longest = d.max_bytes
    size = longest + 3
    status = chunk_status(chunks, size, key, seq, chunk, None)
    live = status.where("status <> 'invalid_utf8'").select(key, seq, "context", "cut_after")
    rows = _plain_chunks(chunks, key, seq, chunk, None).drop("_eof").join(live, [key, seq])

    joined = F.concat(F.col("context"), F.substring(chunk, -size, size))
    tail = F.col("cut_after")
    whole = bytes_text(without_tail(joined, tail))
    partial = d.any_pending(whole, as_bytes=True)
    n = F.octet_length(chunk)

    measured = rows.select(
        key, seq, n.alias("_n"), tail.alias("_tail"), partial.alias("_partial")
    )

    def after(held):
        whole_source = held + F.col("_n") - F.col("_tail")
        if longest <= 1:
            moved = F.col("_tail")
        else:
            moved = F.when(whole_source <= longest, held + F.col("_n")).otherwise(
                F.col("_tail") + F.col("_partial")
            )
        return F.when(F.col("_n") == 0, held).otherwise(moved)

    # Beyond ``size`` nothing is ever held, so the table covers every state.
    lengths = F.sequence(F.lit(0), F.lit(size))
    table = cut_lineage(measured.select(key, seq, F.transform(lengths, after).alias("_table")))
    before = ordered_scan(
        table,
        [key],
        seq,
        F.col("_table"),
        "array<int>",
        lengths,
        lambda a, b: F.transform(a, lambda held: F.element_at(b, held + 1)),
        "_run",
        carry=["_table"],
    )
    held = F.element_at("_table", F.element_at("_run", 1) + 1)
    return before.select(key, seq, held.alias("_held")).groupBy(key).agg(
        F.max("_held").alias("peak_held"),
        F.min(F.when(F.col("_held") > capacity, F.col(seq))).alias("exceeded_seq"),
    )
