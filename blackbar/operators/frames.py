"""Chat-completion event frames: decode, explode, render, assemble, redact per choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blackbar.functions.patterns import TOKEN, bytes_text, text_bytes
from blackbar.operators.chunks import Vault, packed_chunks, redact_chunked
from blackbar.plans.ordered import ordered_scan, recut, running_sum
from blackbar.session import cut_lineage

# The frame contract.
FRAME_TYPE = (
    "struct<id:string,object:string,created:bigint,model:string,"
    "choices:array<struct<index:bigint,finish_reason:string,"
    "delta:struct<role:string,content:string,"
    "tool_call:struct<name:string,arguments:string,"
    "function:struct<name:string,arguments:string>>>>>>"
)
DONE = "[DONE]"
PIECE_CHARS = 1024 * 1024
_CONTENT = -1  # tool_index of the content lane inside keys, where null is not allowed


_BLANK = "(?:\\r?\\n){2,}"


def _without_fields(text: Column) -> Column:
    return F.regexp_replace(text, r"(?m)^(?::|(?:event|id|retry)(?=:|$)).*(?:\r?\n|$)", "")


def _payload(event: Column) -> Column:
    return F.regexp_replace(event, "(?m)^data: ?", "")


def split_sse(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Event-stream text -> one row per event: ``keys, event_no, frame`` without ``data: ``.

    Comment lines and the fields event, id and retry are not part of a frame; an event without
    any other line is none.
    """
    events = F.filter(F.split(_without_fields(F.col(col)), _BLANK), lambda e: F.trim(e) != "")
    return df.select(*keys, F.posexplode(F.transform(events, _payload)).alias("event_no", "frame"))


_LINES = "struct<head:binary,tail:binary,ends:bigint>"
# Between a line feed that ends a blank line and what follows.
_END = r"(?<=\n\r?\n)"


def _line_ends(text: Column) -> Column:
    """How many blank lines end in a text, its first line counting as begun before it."""
    return F.regexp_count(text, F.lit(_END)).cast("bigint")


def _joined_lines(a: Column, b: Column) -> Column:
    """Two neighbouring stretches of a stream as one; a blank line may end at the seam."""
    seam = bytes_text(F.concat(a["tail"], b["head"]))
    at_seam = _line_ends(seam) - _line_ends(bytes_text(a["tail"])) - _line_ends(bytes_text(b["head"]))
    return F.struct(
        F.substring(F.concat(a["head"], b["head"]), 1, 2).alias("head"),
        F.substring(F.concat(a["tail"], b["tail"]), -2, 2).alias("tail"),
        (a["ends"] + b["ends"] + at_seam).alias("ends"),
    )


def split_sse_chunks(
    chunks: DataFrame, key: str = "stream_id", seq: str = "seq", chunk: str = "chunk"
) -> DataFrame:
    """Event streams in chunks cut anywhere -> ``key, event_no, frame``, as ``split_sse`` of the whole.

    Small neighbours are joined first. A chunk then needs to know the two bytes before it and how
    many blank lines ended there; both come from one ordered scan over narrow rows. It is then cut
    behind its own blank lines, and the parts of an event meet by (key, number), so only one event
    or stretch is ever joined in a task and a stream is never gathered. Chunks delivered twice count once; a null key or ``seq`` is an
    error, null chunks are empty. Bytes that are not UTF-8 become replacement characters.
    Unlike in ``split_sse``, a stream of nothing but line ends has no event, and a first event
    of comments alone leaves no line end before the next.
    """
    rows = cut_lineage(packed_chunks(chunks, key, seq, chunk))
    text = bytes_text(F.col(chunk))
    seen = F.struct(
        F.substring(chunk, 1, 2).alias("head"), F.substring(chunk, -2, 2).alias("tail"), _line_ends(text).alias("ends")
    )
    nothing = F.struct(
        F.expr("X''").alias("head"), F.expr("X''").alias("tail"), F.lit(0).cast("bigint").alias("ends")
    )
    before = ordered_scan(rows, [key], seq, seen, _LINES, nothing, _joined_lines, "_before")
    placed = rows.join(before, [key, seq])
    context = bytes_text(F.col("_before.tail"))
    parts = F.split(F.concat(context, text), _END, -1)
    first = F.col("_before.ends") - _line_ends(context)
    pieces = F.transform(
        parts,
        lambda part, no: F.struct(
            (first + no).alias("_event"),
            # what was seen before the chunk stands in front of the parts it reaches into
            F.when(no == 0, F.substr(part, F.length(context) + 1)).otherwise(part).alias("_part"),
        ),
    )
    events = (
        placed.select(key, seq, F.inline(pieces))
        .where(F.length("_part") > 0)
        .groupBy(key, "_event")
        .agg(F.expr(f"listagg(_part, '') WITHIN GROUP (ORDER BY `{seq}`)").alias("_text"))
    )
    whole = F.regexp_replace(text_bytes(F.col("_text")).cast("string"), _BLANK + r"\z", "")
    frames = events.select(key, "_event", _without_fields(F.make_valid_utf8(whole)).alias("_text")).where(
        "_text rlike '[^ \\\\r\\\\n]'"
    )
    frames = cut_lineage(frames)
    return running_sum(frames, [key], "_event", F.lit(1), "event_no").select(
        key, F.col("event_no").cast("bigint").alias("event_no"), _payload(F.col("_text")).alias("frame")
    )


def parse_sse_chunks(
    chunks: DataFrame,
    key: str = "stream_id",
    seq: str = "seq",
    chunk: str = "chunk",
    default_index: int | None = None,
) -> DataFrame:
    """Chunks of event streams -> typed frames: ``key, event_no, frame, done, malformed, fields``."""
    return decode_frames(split_sse_chunks(chunks, key, seq, chunk), "frame", default_index)


def _kind(variant: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(variant, path, "variant"))


def _optional(kind: Column, *allowed: str) -> Column:
    """Absent, JSON null or one of the allowed kinds."""
    return kind.isNull() | kind.isin("VOID", *allowed)


def _object(kind: Column) -> Column:
    return F.coalesce(kind.startswith("OBJECT"), F.lit(False))


def _optional_object(kind: Column, fields: Column) -> Column:
    return kind.isNull() | (kind == "VOID") | (_object(kind) & fields)


def _valid_choice(choice: Column, index_required: bool) -> Column:
    def kind(path):
        return _kind(choice, path)

    counted = (kind("$.index") == "BIGINT") & (
        F.try_variant_get(choice, "$.index", "bigint") >= 0
    )
    index = F.coalesce(counted, F.lit(not index_required))

    def named(at):
        return F.coalesce(kind(f"{at}.name") == "STRING", F.lit(False)) & _optional(
            kind(f"{at}.arguments"), "STRING"
        )

    function = _optional_object(kind("$.delta.tool_call.function"), named("$.delta.tool_call.function"))
    tool = _optional_object(kind("$.delta.tool_call"), named("$.delta.tool_call") & function)
    delta = _optional_object(
        kind("$.delta"),
        _optional(kind("$.delta.role"), "STRING")
        & _optional(kind("$.delta.content"), "STRING")
        & tool,
    )
    return (
        _object(kind("$"))
        & index
        & _optional(kind("$.finish_reason"), "STRING")
        & delta
    )


def valid_frame(frame: Column, index_required: bool = True) -> Column:
    """Whether a text is one JSON object that keeps the frame contract.

    Parsing alone is too lenient (numbers become strings, trailing text is ignored), so
    the kinds of the parsed values are checked. Unknown fields are allowed.
    """
    parsed = F.try_parse_json(F.concat(F.lit("["), frame, F.lit("]")))
    top = F.try_variant_get(parsed, "$", "array<variant>")
    choices_kind = _kind(parsed, "$[0].choices")
    choices = F.try_variant_get(parsed, "$[0].choices", "array<variant>")
    valid = (
        (F.size(top) == 1)
        & _object(_kind(parsed, "$[0]"))
        & _optional(_kind(parsed, "$[0].id"), "STRING")
        & _optional(_kind(parsed, "$[0].object"), "STRING")
        & _optional(_kind(parsed, "$[0].created"), "BIGINT")
        & _optional(_kind(parsed, "$[0].model"), "STRING")
        & (
            choices_kind.isNull()
            | (
                choices_kind.startswith("ARRAY")
                & F.forall(choices, lambda c: _valid_choice(c, index_required))
            )
        )
    )
    return F.coalesce(valid, F.lit(False))


def decode_frames(
    df: DataFrame, col: str = "frame", default_index: int | None = None
) -> DataFrame:
    """Add the typed fields, ``done`` and ``malformed`` to rows of one frame each.

    Malformed rows are kept with null fields. ``default_index`` accepts choices without
    an index and gives them that one.
    """
    done = F.trim(F.col(col)) == DONE
    valid = valid_frame(F.col(col), default_index is None)
    rows = df.withColumn("done", F.coalesce(done, F.lit(False))).withColumn(
        "malformed", ~(valid | F.col("done"))
    )
    sound = F.when(~F.col("malformed") & ~F.col("done"), F.col(col))
    rows = rows.withColumn("_p", F.from_json(sound, FRAME_TYPE))
    choices = F.coalesce("_p.choices", F.array().cast(_choices_type()))
    if default_index is not None:
        choices = F.transform(
            choices,
            lambda c: c.withField("index", F.coalesce(c["index"], F.lit(default_index).cast("bigint"))),
        )
    fields = [F.col(f"_p.{name}").alias(name) for name in ("id", "object", "created", "model")]
    kept = [c for c in rows.columns if c != "_p"]
    return rows.select(
        *kept, *fields, F.when(F.col("_p").isNotNull(), choices).alias("choices")
    )


def _choices_type() -> str:
    return FRAME_TYPE[FRAME_TYPE.index("choices:") + len("choices:"):-1]


def parse_sse_frames(
    df: DataFrame, keys: list[str], col: str, default_index: int | None = None
) -> DataFrame:
    """Event-stream text -> typed frames: ``keys, event_no, frame, done, malformed, fields``."""
    return decode_frames(split_sse(df, keys, col), "frame", default_index)


def explode_choices(frames: DataFrame, keys: list[str]) -> DataFrame:
    """One row per choice of each sound frame, with flat role, content and tool columns."""
    return frames.select(*keys, F.posexplode("choices").alias("choice_no", "c")).select(
        *keys,
        "choice_no",
        F.col("c.index").alias("choice_index"),
        F.col("c.finish_reason").alias("finish_reason"),
        F.col("c.delta.role").alias("role"),
        F.col("c.delta.content").alias("content"),
        F.col("c.delta.tool_call.name").alias("tool_name"),
        F.col("c.delta.tool_call.arguments").alias("tool_arguments"),
        F.col("c.delta.tool_call.function.name").alias("function_name"),
        F.col("c.delta.tool_call.function.arguments").alias("function_arguments"),
    )


def render_sse_json(df: DataFrame, out: str = "frame") -> DataFrame:
    """Add ``out``: the frame fields as JSON; absent fields are left out, choices never."""
    fields = [F.col(c) for c in ("id", "object", "created", "model")]
    choices = F.coalesce("choices", F.array().cast(_choices_type())).alias("choices")
    return df.withColumn(out, F.to_json(F.struct(*fields, choices)))


def render_sse(frame_json: Column) -> Column:
    return F.concat(F.lit("data: "), frame_json, F.lit("\n\n"))


def lane_fragments(choice_rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Text fragments per lane: ``keys, choice_index, tool_index, seq, fragment``.

    The content of a choice is one lane (``tool_index`` -1), the arguments of its tool
    call another (a delta has room for a single call, so tool 0), and those of the call's
    function a third (1). Fragments of one ``seq``
    are joined, so ``seq`` is unique within a lane.
    """
    lanes = F.array(
        F.struct(F.lit(_CONTENT).alias("tool_index"), F.col("content").alias("_text")),
        F.struct(F.lit(0).alias("tool_index"), F.col("tool_arguments").alias("_text")),
        F.struct(F.lit(1).alias("tool_index"), F.col("function_arguments").alias("_text")),
    )
    place = [F.col(c) for c in ("event_no", "choice_no") if c in choice_rows.columns]
    rows = choice_rows.select(
        *keys, "choice_index", seq, F.struct(*place).alias("_place"), F.inline(lanes)
    ).where(F.col("_text").isNotNull())
    return rows.groupBy(*keys, "choice_index", "tool_index", seq).agg(
        F.expr("listagg(_text, '') WITHIN GROUP (ORDER BY _place)").alias("fragment")
    )


def assemble_messages(
    choice_rows: DataFrame, keys: list[str], seq: str, piece_chars: int = PIECE_CHARS
) -> DataFrame:
    """Whole messages per choice and tool: ``keys, choice_index, tool_index, piece_no, message``.

    A message up to ``piece_chars`` characters is one row (piece 0); a longer one goes on
    in further pieces of that length. ``tool_index`` is null for content.
    """
    lane = [*keys, "choice_index", "tool_index"]
    # Decoding frames costs far more than writing their text once.
    fragments = cut_lineage(lane_fragments(choice_rows, keys, seq))
    whole = recut(fragments, lane, seq, "fragment", piece_chars)
    return whole.select(
        *keys,
        "choice_index",
        _tool_index(),
        "piece_no",
        F.col("fragment").alias("message"),
    )


def _tool_index() -> Column:
    return F.when(F.col("tool_index") != _CONTENT, F.col("tool_index")).alias("tool_index")


def redact_by_choice(
    choice_rows: DataFrame, keys: list[str], seq: str, vault: Vault, token: str = TOKEN
) -> DataFrame:
    """Redact each choice's content and tool arguments across frames.

    Gives ``keys, choice_index, tool_index, seq, redacted STRING, status``: a pattern cut
    by the frame boundary is found, and the lanes of a stream do not mix.
    """
    lane = [*keys, "choice_index", "tool_index"]
    fragments = cut_lineage(lane_fragments(choice_rows, keys, seq)).select(
        F.struct(*lane).alias("lane"), seq, F.encode("fragment", "UTF-8").alias("chunk")
    )
    rows = redact_chunked(fragments, vault, "lane", seq, "chunk", token=token)
    return rows.select("lane.*", seq, F.col("redacted").cast("string").alias("redacted"), "status").select(
        *keys, "choice_index", _tool_index(), seq, "redacted", "status"
    )
