r"""Chat formatting: schema fingerprints select declarative mappings to canonical turns, and a template joins them.

A layout is known by the fingerprint, a hash, of its nested field paths. It fits a record, or a
table's schema, whose own paths have the same fingerprint as far as the layout knows them; of
those that fit, the one with most paths is taken. The template puts each turn between ``<|im_start|>`` and ``<|im_end|>``. Inside roles and texts
``<|`` becomes ``<\|``, after every backslash has been doubled, so that no control string but the
template's own is left and reading gives back what was written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.shared import own

BEGIN, END = "<|im_start|>", "<|im_end|>"
#: The role whose texts are under the loss mask.
TRAINED = "assistant"
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """``paths``: the field paths that tell the layout. ``turns``: SQL over ``record`` (JSON) that gives its turns; null
    for a table with a row for each turn, whose paths are its id, position, role and text."""

    name: str
    paths: tuple[str, ...]
    turns: str | None = None

    @property
    def fingerprint(self) -> str:
        return fingerprint_of(self.paths)


def fingerprint_of(paths: Iterable[str]) -> str:
    return hashlib.md5(",".join(sorted(set(paths))).encode()).hexdigest()


def _messages(field: str, role: str, text: str) -> str:
    source = f"from_json(record, '`{field}` array<struct<`{role}`:string,`{text}`:string>>').`{field}`"
    return f"transform({source}, x -> named_struct('role', x.`{role}`, 'text', x.`{text}`))"


def _fields(*pairs: tuple[str, str]) -> str:
    return "array(" + ", ".join(f"named_struct('role', '{role}', 'text', {text})" for role, text in pairs) + ")"


def _get(name: str) -> str:
    return f"get_json_object(record, '$.{name}')"


#: Layouts of JSON records, and of tables with a record in each row.
RECORDS = (
    Layout("messages", ("messages[].role", "messages[].content"), _messages("messages", "role", "content")),
    Layout("dialogue", ("conversations[].from", "conversations[].value"), _messages("conversations", "from", "value")),
    Layout("instruction", ("instruction", "input", "output"), _fields(("user", f"concat_ws('\\n\\n', {_get('instruction')}, nullif({_get('input')}, ''))"), ("assistant", _get("output")))),
    Layout("instruction_only", ("instruction", "output"), _fields(("user", _get("instruction")), ("assistant", _get("output")))),
    Layout("prompt", ("prompt", "completion"), _fields(("user", _get("prompt")), ("assistant", _get("completion")))),
    Layout("prompt_response", ("prompt", "response"), _fields(("user", _get("prompt")), ("assistant", _get("response")))),
    Layout("question", ("question", "answer"), _fields(("user", _get("question")), ("assistant", _get("answer")))),
)
#: Layouts of tables with a row for each turn.
ROWS = (
    Layout("rows", ("conv_id", "turn", "role", "text")),
    Layout("speaker_rows", ("conversation_id", "index", "speaker", "content")),
    Layout("content_rows", ("id", "turn", "role", "content")),
)
#: All layouts, those with most paths first: whichever fits first is the most specific.
LAYOUTS = tuple(sorted((*ROWS, *RECORDS), key=lambda x: -len(x.paths)))
#: Columns that may hold the id of a table with a record in each row.
IDS = ("conv_id", "conversation_id", "id")
#: Names of speakers in other layouts, and their canonical roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}


def schema_paths(schema: T.StructType) -> list[str]:
    """The nested field paths of a schema, arrays marked by ``[]``."""

    def walk(kind: T.DataType, path: str) -> list[str]:
        if isinstance(kind, T.ArrayType):
            return walk(kind.elementType, f"{path}[]")
        if isinstance(kind, T.StructType):
            return [x for f in kind.fields for x in walk(f.dataType, f"{path}.{f.name}" if path else f.name)]
        return [path]

    return sorted(walk(schema, ""))


def layout_of(schema: T.StructType) -> Layout | None:
    """The most specific layout whose fingerprint is that of the schema's own paths, as far as the layout knows them."""
    paths = set(schema_paths(schema))
    return next((x for x in LAYOUTS if fingerprint_of(paths.intersection(x.paths)) == x.fingerprint), None)


def record_paths(record: str = "record") -> Column:
    """A JSON record's field paths, as far as any layout knows them; those of an array's elements together. Null for what isn't an object."""
    tops = sorted({p.split("[")[0] for x in RECORDS for p in x.paths})
    nested = {p.split("[")[0] for x in RECORDS for p in x.paths if "[" in p}

    def paths(key: str) -> str:
        if key not in nested:
            return f"array('{key}')"
        parsed = f"from_json({record}, '`{key}` array<map<string,string>>').`{key}`"
        return f"transform(array_distinct(flatten(transform(coalesce({parsed}, array()), m -> coalesce(map_keys(m), array())))), x -> concat('{key}[].', x))"

    keys = f"json_object_keys({record})"
    each = ", ".join(f"if(array_contains({keys}, '{key}'), {paths(key)}, array())" for key in tops)
    return F.expr(f"if({keys} is null, null, flatten(array({each})))")


def record_layout(paths: Column) -> Column:
    """The name of the layout that ``layout_of`` would give, by hashes of a record's own paths."""
    known = [x for x in LAYOUTS if x.turns]
    own_hash = lambda x: F.md5(F.array_join(F.array_sort(F.array_distinct(F.array_intersect(paths, F.array(*map(F.lit, x.paths))))), ","))
    return F.coalesce(*[F.when(own_hash(x) == x.fingerprint, F.lit(x.name)) for x in known])


def _canonical_roles(turns: Column, renamed: bool = True) -> Column:
    """Without null roles and texts, and with ``renamed`` other layouts' names of speakers replaced."""
    if not renamed:
        return F.transform(turns, lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.transform(turns, lambda t: F.struct(F.coalesce(F.try_element_at(names, t["role"]), t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))


def turns_of_records(records: DataFrame) -> DataFrame:
    """(conv_id, record) to (conv_id, layout, turns): each JSON record by the layout its fingerprint selects.

    Null and missing roles and texts become empty, fields beside a layout's own are ignored. A record of no
    known layout, malformed or null, has a null layout and no turns.
    """
    name = F.col("layout")
    turns = F.coalesce(*[F.when(name == x.name, F.expr(x.turns)) for x in RECORDS], F.array().cast(TURNS))
    rows = own(records, "conv_id", "record").withColumn("paths", record_paths()).withColumn("layout", record_layout(F.col("paths")))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), "layout", _canonical_roles(turns).alias("turns"))


def turns_of_table(rows: DataFrame) -> DataFrame:
    """A table to (conv_id, layout, turns), by the layout that its schema's fingerprint selects.

    With a row for each turn, turns are in order of position, ties of role and text, null
    positions first; repeated rows are turns of their own. With a record in each row, nested or flat, its
    layout's columns are read as a record. Null roles and texts become empty; a column named
    role of a table of turns is taken as it is. Rows of turns without an id form one conversation.
    """
    layout = layout_of(rows.schema)
    if layout is None:
        raise ValueError(f"no known layout among {schema_paths(rows.schema)}")
    if layout.turns:
        key = next((c for c in IDS if c in rows.columns), None)
        if key is None:
            raise ValueError(f"no column of {IDS}")
        fields = sorted({p.split("[")[0] for p in layout.paths})
        record = F.to_json(F.struct(*[F.col(f"`{c}`") for c in fields]), {"ignoreNullFields": "false"})
        return turns_of_records(rows.select(F.col(f"`{key}`").alias("conv_id"), record.alias("record")))
    conv, turn, role, text = layout.paths
    blank = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    put = F.struct(F.col(f"`{turn}`").isNotNull().alias("placed"), F.col(f"`{turn}`").cast("long").alias("turn"), blank(role).alias("role"), blank(text).alias("text"))
    grouped = rows.groupBy(F.col(f"`{conv}`").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(put)).alias("rows"))
    turns = F.transform("rows", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return grouped.select("conv_id", F.lit(layout.name).alias("layout"), _canonical_roles(turns, role != "role").alias("turns"))


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _header(role: Column) -> Column:
    """A role must stay in its line."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def _role(header: Column) -> Column:
    return unescape(F.regexp_replace(header, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def format_chats(chats: DataFrame) -> DataFrame:
    """(conv_id, turns) to (conv_id, formatted, mask): the text, and the loss mask as run lengths, one pair for each turn.

    A pair is ``plain`` code points outside the loss, and then ``learnt`` under it, null where the
    turn isn't trained on. What is left of the text after the last pair is outside. Lengths need
    no running sum, so that time is linear in the turns. Null roles and texts are empty ones
    (``turns_of_table`` makes them so), repeated turns stay, no turns give an empty text; extra columns are
    ignored, and an empty table gives an empty result.
    """
    opening = lambda t: F.concat(F.lit(BEGIN), _header(t["role"]), F.lit("\n"))
    closing = F.lit(END + "\n")
    parts = F.transform("turns", lambda t: F.struct(opening(t).alias("head"), escape(t["text"]).alias("body"), (t["role"] == TRAINED).alias("trained")))
    rows = chats.select("conv_id", parts.alias("parts"))
    formatted = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], closing)), "")

    def lengths(p: Column, i: Column) -> Column:
        body = F.char_length(p["body"])
        plain = F.when(i > 0, len(END) + 1).otherwise(0) + F.char_length(p["head"]) + F.when(p["trained"], 0).otherwise(body)
        return F.struct(plain.alias("plain"), F.when(p["trained"], body).alias("learnt"))

    return rows.select("conv_id", formatted.alias("formatted"), F.transform("parts", lengths).alias("mask"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """The inverse of ``format_chats``: (conv_id, formatted, mask) to (conv_id, formatted, turns, trained).

    trained has the texts under the mask, unescaped, in order. Texts are cut at the template's
    own marks, which no text can hold, and the mask's lengths count from there. A null or empty
    ``formatted`` has no turns; repeated rows are read alike; extra columns are ignored.
    """
    pieces = F.filter(F.split("formatted", r"<\|im_start\|>"), lambda p: p != "")
    rows = formatted.select("conv_id", "formatted", F.arrays_zip(pieces.alias("piece"), F.col("mask")).alias("parts"))
    head = lambda p: F.substring_index(p, "\n", 1)
    body = lambda p: F.substring(p, F.char_length(head(p)) + 2, F.char_length(p) - F.char_length(head(p)) - len(END) - 2)
    turns = F.transform("parts", lambda x: F.struct(_role(head(x["piece"])).alias("role"), unescape(body(x["piece"])).alias("text")))

    def learnt(x: Column, i: Column) -> Column:
        """The piece begins after BEGIN; the pair's plain part began with the end of the turn before."""
        start = x["mask"]["plain"] - F.when(i > 0, len(END) + 1).otherwise(0) - len(BEGIN)
        return F.when(x["mask"]["learnt"].isNotNull(), unescape(F.substring(x["piece"], start + 1, x["mask"]["learnt"])))

    trained = F.filter(F.transform("parts", learnt), lambda t: t.isNotNull())
    return rows.select("conv_id", "formatted", turns.alias("turns"), trained.alias("trained"))
