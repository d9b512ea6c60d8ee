"""Chat formatting: records of many layouts become canonical turns, and turns one marked-up text with a loss mask.

A record's layout is known by its schema fingerprint, the hash of its nested field paths; each known fingerprint selects a declarative mapping to turns, row
by row. Records are JSON texts or typed columns: the paths of a typed column are those of its type, or, where a column is wide enough for several layouts,
those of the fields that the row has; values are taken as they are, whatever their size. The template escapes the escape sign and the opening of its control
strings inside texts and roles, so that a text that holds control strings can neither end a turn nor start one, and reads back as it was.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

from brickwise.functions.arrays import cut, let, running_totals

TURNS = "array<struct<role:string,text:string>>"
TURN, TEXT, END, OPENING = "<|turn|>", "<|text|>", "<|end|>", "<|"
#: Names of roles in layouts of other makers.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}
#: Bytes of a JSON record that the parser surely holds; a larger one that it doesn't parse fails the query instead of becoming null.
SURE_BYTES = 16_000_000


@dataclass(frozen=True)
class Messages:
    """A layout with a list of turns: an example record, the names of the list, the role, the text and the order (or None), and whether roles have other
    names.
    """

    example: str
    items: str
    role: str
    text: str
    order: str | None = None
    renamed: bool = True

    def turns(self, record: Column) -> Column:
        names = [*([f"{self.order}: bigint"] if self.order else []), f"{self.role}: string", f"{self.text}: string"]
        return self._canonical(F.try_variant_get(record, f"$.{self.items}", f"array<struct<{', '.join(names)}>>"))

    def typed_turns(self, record: Column) -> Column:
        names = [*([(self.order, "long")] if self.order else []), (self.role, "string"), (self.text, "string")]
        return self._canonical(F.transform(record[self.items], lambda x: F.struct(*[x[n].cast(t).alias(n) for n, t in names])))

    def _canonical(self, found: Column) -> Column:
        role = _role if self.renamed else (lambda x: x)
        return F.transform(F.array_sort(found) if self.order else found, lambda x: _turn(role(x[self.role]), x[self.text]))


@dataclass(frozen=True)
class Fields:
    """A layout with one field per turn: an example record, and (role, fields joined by a blank line) in order."""

    example: str
    parts: tuple[tuple[str, tuple[str, ...]], ...]

    def turns(self, record: Column) -> Column:
        return self._canonical(lambda name: F.try_variant_get(record, f"$.{name}", "string"))

    def typed_turns(self, record: Column) -> Column:
        return self._canonical(lambda name: record[name].cast("string"))

    def _canonical(self, field: Callable[[str], Column]) -> Column:
        get = lambda name: F.coalesce(field(name), F.lit(""))
        texts = [(role, F.array_join(F.filter(F.array(*map(get, names)), lambda x: x != ""), "\n\n")) for role, names in self.parts]
        return F.array(*[_turn(F.lit(role), text) for role, text in texts])


LAYOUTS: tuple[Messages | Fields, ...] = (
    Messages('{"turns":[{"turn":0,"role":"","text":""}]}', "turns", "role", "text", "turn", renamed=False),
    Messages('{"messages":[{"role":"","content":""}]}', "messages", "role", "content"),
    Messages('{"conversations":[{"from":"","value":""}]}', "conversations", "from", "value"),
    Fields('{"prompt":"","completion":""}', (("user", ("prompt",)), ("assistant", ("completion",)))),
    Fields('{"prompt":"","response":""}', (("user", ("prompt",)), ("assistant", ("response",)))),
    Fields('{"question":"","answer":""}', (("user", ("question",)), ("assistant", ("answer",)))),
    Fields('{"instruction":"","output":""}', (("user", ("instruction",)), ("assistant", ("output",)))),
    Fields('{"instruction":"","input":"","output":""}', (("user", ("instruction", "input")), ("assistant", ("output",)))),
    Fields('{"system":"","instruction":"","input":"","output":""}', (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Fields('{"system":"","prompt":"","response":""}', (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
)


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _role(role: Column) -> Column:
    out = role
    for name, canonical in ROLES.items():
        out = F.when(role == name, canonical).otherwise(out)
    return out


def schema_fingerprint(record: Column) -> Column:
    """Hash of a variant's nested field paths, whatever the types of their values; null for null."""
    paths = F.regexp_replace(F.schema_of_variant(record), r"\b(?:VOID|BOOLEAN|BIGINT|DOUBLE|FLOAT|STRING|DECIMAL\([0-9, ]+\))(?=[,>]|$)", "_")
    return F.when(record.isNotNull(), F.xxhash64(paths))


def type_fingerprint(example: object) -> str:
    """Hash of the nested field paths of a record's type, or of an example record in JSON."""

    def paths(x: object, at: str) -> set[str]:
        if isinstance(x, StructType):
            return set().union(*(paths(f.dataType, f"{at}.{f.name}") for f in x.fields))
        if isinstance(x, dict):
            return set().union(*(paths(v, f"{at}.{k}") for k, v in x.items()))
        if isinstance(x, ArrayType | list):
            return paths(x.elementType if isinstance(x, ArrayType) else x[0], f"{at}[]")
        return {at}

    return hashlib.sha256("\n".join(sorted(paths(example, "$"))).encode()).hexdigest()


def _paths(kind: DataType, at: str) -> list[str]:
    if isinstance(kind, StructType):
        return [p for f in kind.fields for p in _paths(f.dataType, f"{at}.{f.name}")]
    return _paths(kind.elementType, f"{at}[]") if isinstance(kind, ArrayType) else [at]


def row_fingerprint(record: Column, kind: StructType) -> Column:
    """Hash of the nested field paths of the fields that a row of a wide record has; fields that are null are ones that it hasn't."""
    none = F.array().cast("array<string>")
    held = [F.when(record[f.name].isNotNull(), F.array(*map(F.lit, _paths(f.dataType, f"$.{f.name}")))).otherwise(none) for f in kind.fields]
    return F.sha2(F.array_join(F.array_sort(F.concat(*held)), "\n"), 256)


def _fits(layout: Messages | Fields, kind: StructType) -> bool:
    return set(json.loads(layout.example)) <= set(kind.names)


def canonical_turns(record: Column, kind: DataType | None = None) -> Column:
    """Turns (role, text) of a record of a known layout, a JSON text or a column of the type ``kind``.

    A type that is a layout's is that layout for all rows, nulls in it included; of a type that has the fields of several, each row's own fields tell. Null
    for malformed records and unknown layouts; null roles and texts become empty. A JSON text of over ``SURE_BYTES`` bytes that can't be
    parsed fails the query, as it may be too large for the parser rather than malformed: pass such records as typed columns.
    """
    if kind is not None and not isinstance(kind, StringType):
        known = {type_fingerprint(json.loads(layout.example)): layout for layout in LAYOUTS}
        if layout := known.get(type_fingerprint(kind)):
            return F.when(record.isNotNull(), layout.typed_turns(record))

        def chosen(print_: Column) -> Column:
            out = F.lit(None).cast(TURNS)
            for name, layout in known.items():
                if isinstance(kind, StructType) and _fits(layout, kind):
                    out = F.when(print_ == name, layout.typed_turns(record)).otherwise(out)
            return out

        return F.when(record.isNotNull(), let(row_fingerprint(record, kind), chosen)) if isinstance(kind, StructType) else F.lit(None).cast(TURNS)
    parsed = F.try_parse_json(record)
    print_ = schema_fingerprint(parsed)
    out = F.lit(None).cast(TURNS)
    for layout in reversed(LAYOUTS):
        out = F.when(print_ == schema_fingerprint(F.parse_json(F.lit(layout.example))), layout.turns(parsed)).otherwise(out)
    lost = parsed.isNull() & (F.octet_length(record) > SURE_BYTES)
    return F.when(lost, F.raise_error(F.lit("a JSON record is too large to parse, or malformed")).cast(TURNS)).otherwise(out)


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\e")), F.lit(OPENING), F.lit("\\l|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l|"), F.lit(OPENING)), F.lit("\\e"), F.lit("\\"))


def render(turns: Column) -> Column:
    """The marked-up text of an array of turns."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT), escape(t["text"]), F.lit(END))), "")


def loss_mask(turns: Column) -> Column:
    """Array of (start, end) in code points of the rendered text: the texts of the assistant's turns."""
    fixed = len(TURN) + len(TEXT) + len(END)
    sizes = F.transform(turns, lambda t: F.struct((t["role"] == "assistant").alias("learnt"), F.length(escape(t["role"])).alias("role"),
        F.length(escape(t["text"])).alias("text")))

    def spans(sized: Column) -> Column:
        before = running_totals(F.transform(sized, lambda s: (s["role"] + s["text"] + fixed).cast("long")))
        start = lambda s, at: at + len(TURN) + s["role"] + len(TEXT)
        placed = F.zip_with(sized, before, lambda s, at: F.struct(start(s, at).cast("long").alias("start"), (start(s,
            at) + s["text"]).cast("long").alias("end"), s["learnt"].alias("learnt")))
        return F.transform(F.filter(placed, lambda p: p["learnt"]), lambda p: F.struct(p["start"], p["end"]))

    return F.when(turns.isNotNull(), let(sizes, spans))


def read_back(formatted: Column) -> Column:
    """The turns of a marked-up text."""
    pieces = F.split(formatted, r"<\|end\|>", -1)
    fields = lambda p: F.split(F.substring(p, F.lit(len(TURN) + 1), F.length(p)), r"<\|text\|>", 2)
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.struct(unescape(F.get(fields(p), F.lit(0))).alias("role"),
        unescape(F.get(fields(p), F.lit(1))).alias("text")))


def records_of(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, record): the turn rows of each conversation as one record, of one of several layouts by the id's hash: a typed column that is wide enough for
    all.

    Conversations whose roles a layout would rename, and those that are no prompt and answer, take a layout that keeps them as they are. Turns that tie are
    ordered by role, then text; nulls come first and become empty. A conversation is one row: as large as a row may be, two gigabytes.
    """
    item = F.struct(F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col),
        F.lit("")).alias("text"))
    whole = conversations.groupBy(F.col(id_col)).agg(F.array_sort(F.collect_list(item)).alias("_bw_items"))
    items, roles = F.col("_bw_items"), F.transform("_bw_items", lambda t: t["role"])
    plain = ~F.exists(roles, lambda r: r.isin(*ROLES))
    kind = F.pmod(F.xxhash64(id_col), F.lit(6))
    pair, three = (roles == F.array(*map(F.lit, names)) for names in (("user", "assistant"), ("system", "user", "assistant")))
    layout = F.when((kind == 0) & plain, "messages").when((kind == 1) & plain, "conversations").when((kind == 2) & pair, "completion").when((kind == 3) & pair,
        "output").when((kind >= 4) & three, "response").otherwise("turns")
    text = lambda i: F.get(items, F.lit(i))["text"]
    fields = {
        "turns": {"turns": items}, "messages": {"messages": F.transform(items, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))},
        "conversations": {"conversations": F.transform(items, lambda t: F.struct(t["role"].alias("from"), t["text"].alias("value")))},
        "completion": {"prompt": text(0), "completion": text(1)}, "output": {"instruction": text(0), "output": text(1)},
        "response": {"system": text(0), "prompt": text(1), "response": text(2)},
    }
    columns: dict[str, Column] = {}
    for name, held in fields.items():
        for field, value in held.items():
            before = columns.get(field)
            columns[field] = F.when(F.col("_bw_layout") == name, value) if before is None else before.when(F.col("_bw_layout") == name, value)
    return whole.withColumn("_bw_layout", layout).select(id_col, F.struct(*[c.alias(n) for n, c in columns.items()]).alias("record"))


def format_records(records: DataFrame, record_col: str = "record") -> DataFrame:
    """``records`` with ``formatted`` (the marked-up text) and ``loss_mask``; both are null for unknown layouts."""
    turned = records.withColumn("_bw_turns", canonical_turns(F.col(record_col), records.schema[record_col].dataType))
    return turned.withColumn("formatted", render(F.col("_bw_turns"))).withColumn("loss_mask", loss_mask(F.col("_bw_turns"))).drop("_bw_turns")


def digests(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Per record, read back from its output: number and digest of the turns, size and digest of the text under the loss mask, size of the output."""
    turns = read_back(F.col("formatted"))
    whole = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join(F.transform(cut(F.col("formatted"), F.col("loss_mask")), unescape), "")
    return formatted.select(
        id_col, F.size(turns).cast("long").alias("n_turns"), F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt.cast("binary"), 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
    )
