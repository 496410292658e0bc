"""Chat formatting: records of many layouts become canonical turns, then marked text.

A layout is known by the fingerprint of its schema, a hash of all nested field paths. The
fingerprint selects a declarative mapping, two or three SQL expressions that turn a record
into an array of (role, text); a schema without a mapping is an error that names its
paths. JSON records carry their schema in themselves, so each is fingerprinted on its own
and records of different layouts may be mixed in one column.

The template writes a turn as

    <|start|>ROLE<|message|>TEXT<|end|>

Inside roles and texts a backslash is doubled, and one is put behind every `<` or `[` that
could open a control string (this template's or the usual `</s>`, `[INST]`, `<<SYS>>`).
No control string is left in a text, and dropping those backslashes restores it exactly.

Defined results: a NULL role or text is empty; a conversation without turns formats to the
empty string; turns with the same number are ordered by role, then text, and repeated rows
stay repeated. Rows without a conversation id form one conversation with id NULL. Another
column makes another layout, which has to be declared or the column left out; very long texts are formatted whole; an empty frame gives an empty frame; a JSON list
of messages that is empty shows no paths inside it and so has no layout. Everything here is built from DataFrame functions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, MESSAGE, END = "<|start|>", "<|message|>", "<|end|>"
TURNS = "array<struct<role:string,text:string>>"

# A bracket that opens a control string: <| </ <s> << [/ [INST].
_OPENS = r"([<\[])(?=[|/]|s>|<SYS>>|INST\])"


def field_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """All nested field paths, `[]` for an array's elements and `{}` for a map's values."""
    if isinstance(schema, T.StructType):
        return [p for f in schema for p in field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, f"{prefix}[]")
    if isinstance(schema, T.MapType):
        return field_paths(schema.valueType, f"{prefix}{{}}")
    return [prefix]


def fingerprint(paths: Iterable[str]) -> str:
    """SHA-256 of the sorted, distinct paths, one per line."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


@dataclass(frozen=True)
class Layout:
    """How records with exactly these field paths become turns.

    A record layout gives `turns`, an expression of type array<struct<role,text>>. A layout
    with a row per turn gives `order`, `role` and `text` instead.
    """

    name: str
    paths: tuple[str, ...]
    key: str
    turns: str | None = None
    order: str | None = None
    role: str | None = None
    text: str | None = None

    @property
    def fingerprint(self) -> str:
        return fingerprint(self.paths)


def _pair(user: str, assistant: str) -> str:
    return (
        f"array(named_struct('role', 'user', 'text', {user}), named_struct('role', 'assistant', 'text', {assistant}))"
    )


_WITH_INPUT = "concat(instruction, if(coalesce(input, '') = '', '', concat('\\n\\n', input)))"
_MESSAGES = "transform(messages, m -> named_struct('role', m.role, 'text', m.content))"
_SHARED = (
    "transform(conversations, m -> named_struct('role', case m.`from` when 'human' then 'user' "
    "when 'gpt' then 'assistant' else m.`from` end, 'text', m.`value`))"
)

LAYOUTS = (
    Layout("rows by turn", ("conv_id", "turn", "role", "text"), "conv_id", None, "turn", "role", "text"),
    Layout("messages", ("conv_id", "messages[].role", "messages[].content"), "conv_id", _MESSAGES),
    Layout("from and value", ("id", "conversations[].from", "conversations[].value"), "id", _SHARED),
    Layout("prompt and response", ("id", "prompt", "response"), "id", _pair("prompt", "response")),
    Layout("prompt and completion", ("id", "prompt", "completion"), "id", _pair("prompt", "completion")),
    Layout("instruction", ("id", "instruction", "output"), "id", _pair("instruction", "output")),
    Layout(
        "instruction with input", ("id", "instruction", "input", "output"), "id", _pair(_WITH_INPUT, "output")
    ),
)

# Schemas from which JSON records are read once their fingerprint is known.
_JSON_FIELDS = (
    "conv_id bigint, id bigint, messages array<struct<role:string,content:string>>, "
    "conversations array<struct<from:string,value:string>>, prompt string, response string, "
    "completion string, instruction string, input string, output string"
)


def layout_of(schema: T.StructType, layouts: Sequence[Layout] = LAYOUTS) -> Layout:
    """The layout whose fingerprint is that of the schema."""
    paths = field_paths(schema)
    known = {each.fingerprint: each for each in layouts}
    if (found := known.get(fingerprint(paths))) is None:
        raise ValueError(f"no layout is declared for the field paths {sorted(paths)}")
    return found


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _OPENS, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _turn(role: Column, text: Column) -> Column:
    return F.concat(
        F.lit(START),
        escape(F.coalesce(role, F.lit(""))),
        F.lit(MESSAGE),
        escape(F.coalesce(text, F.lit(""))),
        F.lit(END),
    )


_NO_SPANS = "array<struct<start:bigint,length:bigint>>"


def _masked(turns: Column) -> Column:
    """(start, length) in code points of the texts under the loss mask, markers left out,
    from an array of (role, marked turn)."""
    none = F.array().cast(_NO_SPANS)
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("spans"))

    def step(done: Column, turn: Column) -> Column:
        head = F.length(F.substring_index(turn["marked"], MESSAGE, 1)) + len(MESSAGE)
        size = F.length(turn["marked"]).cast("bigint")
        span = F.struct(
            (done["at"] + head).cast("bigint").alias("start"),
            (size - head - len(END)).cast("bigint").alias("length"),
        )
        own = F.when(turn["role"] == "assistant", F.array(span)).otherwise(none)
        return F.struct((done["at"] + size).alias("at"), F.concat(done["spans"], own).alias("spans"))

    return F.aggregate(turns, zero, step, lambda done: done["spans"])


def _mark(turns: Column) -> Column:
    return F.transform(
        F.coalesce(turns, F.array().cast(TURNS)),
        lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), _turn(t["role"], t["text"]).alias("marked")),
    )


def _format(turns: DataFrame, *others: str) -> DataFrame:
    """key, turns (role, marked) -> key, formatted, loss_spans."""
    return turns.select(
        "key",
        F.array_join(F.transform("turns", lambda t: t["marked"]), "").alias("formatted"),
        _masked(F.col("turns")).alias("loss_spans"),
        *others,
    )


def format_chats(records: DataFrame, layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """key, formatted, loss_spans: a row per conversation of a frame with a known schema.

    `loss_spans` are (start, length) pairs in code points from 0: the escaped texts of the
    assistant. Rows of a conversation are put in order of turn, role and text (NULL turns
    first) and marked then; what meets is no more than the conversation that is returned.
    """
    layout = layout_of(records.schema, layouts)
    key = F.expr(layout.key).alias("key")
    if layout.turns is not None:
        return _format(records.select(key, _mark(F.expr(layout.turns).cast(TURNS)).alias("turns")))
    rows = records.select(
        key,
        F.expr(layout.order).alias("turn"),
        F.coalesce(F.expr(layout.role), F.lit("")).alias("role"),
        F.coalesce(F.expr(layout.text), F.lit("")).alias("text"),
    )
    # Sorted as they are said; marks come afterwards, as an end mark would sort among the texts.
    sorted_rows = rows.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("said"))
    marked = F.transform("said", lambda t: F.struct(t["role"].alias("role"), _turn(t["role"], t["text"]).alias("marked")))
    return _format(sorted_rows.select("key", marked.alias("turns")))


def json_fingerprint(record: Column) -> Column:
    """The fingerprint of one JSON record's own field paths; NULL where it is no object.

    The record's schema is written out by the engine; types are cut from it, so that a
    field is the same whether it holds a string or null.
    """
    shape = F.schema_of_variant(F.try_parse_json(record))
    names = F.regexp_replace(shape, r": (?!OBJECT<|ARRAY<)[A-Z_]+(\(\d+,\d+\))?", "")
    names = F.regexp_replace(names, r"ARRAY<(?!OBJECT<|ARRAY<)[A-Z_]+(\(\d+,\d+\))?>", "ARRAY<>")
    return F.when(shape.startswith("OBJECT<"), F.sha2(names, 256))


def layout_shape(layout: Layout) -> str:
    """What `json_fingerprint` hashes for a record of the layout."""
    tree: dict = {}
    for path in layout.paths:
        at = tree
        for part in path.split("."):
            at = at.setdefault(part, {})

    def text(node: dict) -> str:
        fields = []
        for name in sorted(node, key=lambda n: n.removesuffix("[]")):
            inner = text(node[name]) if node[name] else ""
            bare = name.removesuffix("[]")
            fields.append(f"{bare}: ARRAY<{inner}>" if name != bare else f"{bare}: {inner}" if inner else bare)
        return f"OBJECT<{', '.join(fields)}>"

    return text(tree)


def format_json(records: DataFrame, column: str = "record", layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """key, formatted, loss_spans, layout from JSON records of mixed layouts.

    Records whose fingerprint is not declared are returned with a NULL layout and empty
    text, so that they can be counted and looked into.
    """
    known = records.select(json_fingerprint(F.col(column)).alias("print"), F.from_json(column, _JSON_FIELDS).alias("r"))
    key, turns, name = F.lit(None).cast("bigint"), F.array().cast(TURNS), F.lit(None).cast("string")
    for each in (each for each in layouts if each.turns is not None):
        is_it = F.col("print") == hashlib.sha256(layout_shape(each).encode()).hexdigest()
        key = F.when(is_it, F.expr(each.key).cast("bigint")).otherwise(key)
        turns = F.when(is_it, F.coalesce(F.expr(each.turns).cast(TURNS), F.array().cast(TURNS))).otherwise(turns)
        name = F.when(is_it, F.lit(each.name)).otherwise(name)
    return _format(
        known.select("print", "r.*").select(key.alias("key"), _mark(turns).alias("turns"), name.alias("layout")),
        "layout",
    )


def read_turns(formatted: Column) -> Column:
    """The turns, as they were before formatting, from formatted text alone."""
    pieces = F.split(formatted, r"\Q" + END + r"\E")
    whole = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        parts = F.split(piece, r"\Q" + MESSAGE + r"\E", 2)
        return F.struct(
            unescape(F.substring(parts[0], F.lit(len(START) + 1), F.length(parts[0]))).alias("role"),
            unescape(parts[1]).alias("text"),
        )

    return F.transform(whole, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))),
        ),
        "",
    )
