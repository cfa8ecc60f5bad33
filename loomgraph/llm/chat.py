"""Chat formatting with DataFrame functions alone.

Layouts are told apart by a fingerprint: the SHA-256 of the sorted nested field paths of a record,
as far as any mapping knows them. It selects a declarative :class:`Mapping` into canonical turns,
``array<struct<role, text>>``.
:func:`format_chat` writes turns with a template that marks them and escapes control strings
inside texts; :func:`read_back` recovers turns and the text under the loss mask from the output.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEAD, TAIL = "<|im_start|>", "<|im_end|>\n"
TURNS = "array<struct<role:string,text:string>>"


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths; an array's elements are written as ``[]``."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return [at]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


@dataclass(frozen=True)
class Mapping:
    """How a layout becomes turns. ``turns``: (role, paths whose texts are joined by a blank
    line) in order, for flat layouts; ``messages``: (array, role field, text field)."""

    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    messages: tuple[str, str, str] | None = None
    #: other names of roles, in lower case, with their canonical names
    roles: tuple[tuple[str, str], ...] = ()

    def paths(self) -> list[str]:
        if self.messages:
            array, role, text = self.messages
            return [f"{array}[].{role}", f"{array}[].{text}"]
        return [p for _, paths in self.turns for p in paths]


#: Names of roles in the from/value layout.
ROLES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"), ("chatgpt", "assistant"))
#: Known layouts.
MAPPINGS = [
    Mapping(messages=("messages", "role", "content")),
    Mapping(messages=("messages", "role", "text")),
    Mapping(messages=("conversations", "from", "value"), roles=ROLES),
    Mapping(turns=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping(turns=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping(turns=(("user", ("question",)), ("assistant", ("answer",)))),
    Mapping(turns=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping(turns=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping(turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping(turns=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping(turns=(("system", ("system",)),)),
    Mapping(turns=(("user", ("prompt",)),)),
    Mapping(turns=(("assistant", ("response",)),)),
]


def registry(mappings: list[Mapping] | None = None) -> dict[str, Mapping]:
    return {fingerprint(m.paths()): m for m in mappings or MAPPINGS}


def _role(x: Column, roles: tuple[tuple[str, str], ...]) -> Column:
    known = F.create_map(*[F.lit(v) for kv in roles for v in kv])[F.lower(x)] if roles else F.lit(None)
    return F.coalesce(known, x, F.lit(""))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.cast("string").alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _apply(m: Mapping, get) -> Column:
    if m.messages:
        array, role, text = m.messages
        return F.transform(get(array, f"array<struct<`{role}`:string,`{text}`:string>>"), lambda x: _turn(_role(x[role], m.roles), x[text]))
    built = [_turn(F.lit(role), F.concat_ws("\n\n", *[F.when(get(p, "string") != "", get(p, "string")) for p in paths])) for role, paths in m.turns]
    system = len(m.turns) > 1 and m.turns[0][0] == "system"
    whole = F.array(*built)
    return F.when(F.coalesce(get("system", "string"), F.lit("")) == "", F.array(*built[1:])).otherwise(whole) if system else whole


def _chosen(paths: Column, mappings: list[Mapping] | None, get, nothing: Column) -> tuple[Column, Column]:
    """The fingerprint of a record's field paths, and its turns by the mapping that it selects;
    without paths ``nothing``, without a mapping null."""
    layout = F.sha2(F.concat_ws("\n", F.array_sort(F.array_distinct(paths))), 256)
    turns = F.when(F.size(paths) == 0, nothing)
    for key, m in registry(mappings).items():
        turns = turns.when(layout == key, _apply(m, get))
    return layout, turns


def _known(mappings: list[Mapping] | None) -> list[str]:
    return sorted({p for m in mappings or MAPPINGS for p in m.paths()})


def turns_of_columns(df: DataFrame, payload: list[str], mappings: list[Mapping] | None = None) -> DataFrame:
    """``df`` with ``layout`` and ``turns``, for records in columns. A row's layout is made of
    the ``payload`` columns that aren't null in it, so rows of several layouts may stand in one
    table; fields that no mapping knows don't count. Where that selects no mapping, the layout of
    all ``payload`` columns does, with null as an empty text. A row without a mapping, or with
    null in all of ``payload``, has null turns, see :func:`unmapped`; an empty array is no turns.
    Raises ``ValueError`` if no mapping knows any field. Input columns named layout or turns are
    replaced, unless they are part of ``payload``; an empty table gives an empty result."""
    known = set(_known(mappings))
    present = {c: [p for p in field_paths(df.schema[c].dataType, c) if p in known] for c in payload}
    if not any(present.values()):
        raise ValueError(f"no mapping for the layout {sorted(p for c in payload for p in field_paths(df.schema[c].dataType, c))}")
    none = F.array().cast("array<string>")
    paths = F.flatten(F.array(*[F.when(F.col(c).isNotNull(), F.array(*map(F.lit, found))).otherwise(none) for c, found in present.items() if found]))
    missing = {p.partition("[]")[0] for p in known} - {c for c, found in present.items() if found}
    get = lambda p, kind: F.lit(None).cast(kind) if p in missing else F.col(p).cast(kind)
    layout, turns = _chosen(paths, mappings, get, F.lit(None).cast(TURNS))
    whole = registry(mappings).get(fingerprint([p for found in present.values() for p in found]))
    if whole:
        turns = turns.when(F.size(paths) > 0, _apply(whole, get))
    return df.select("*", layout.alias("_made_layout"), turns.alias("_made_turns")).drop("layout", "turns").withColumnsRenamed({"_made_layout": "layout", "_made_turns": "turns"})


def _has(field: str):
    return lambda x: F.try_variant_get(x, f"$.{field}", "variant").isNotNull()


def turns_of_json(df: DataFrame, json_col: str, mappings: list[Mapping] | None = None) -> DataFrame:
    """``df`` with ``layout`` (a record's fingerprint) and ``turns`` for JSON records of several
    layouts; fields that no mapping knows don't count. A record that is null, isn't JSON or has
    an unknown layout has null turns, see :func:`unmapped`; one with an empty array of messages
    has no turns. Input columns named layout or turns are replaced; an empty table gives an empty
    result."""
    v = F.try_parse_json(json_col)
    found, empty = [], F.lit(False)
    for p in _known(mappings):
        array, _, field = p.partition("[].")
        if field:
            items = F.try_variant_get(v, f"$.{array}", "array<variant>")
            there = F.exists(items, _has(field))
            empty = empty | F.coalesce(F.size(items) == 0, F.lit(False))
        else:
            there = F.try_variant_get(v, f"$.{p}", "variant").isNotNull()
        found.append(F.when(F.coalesce(there, F.lit(False)), F.lit(p)))
    layout, turns = _chosen(F.array_compact(F.array(*found)), mappings, lambda p, kind: F.try_variant_get(v, f"$.{p}", kind), F.when(empty, F.array().cast(TURNS)))
    return df.select("*", F.when(v.isNotNull(), layout).alias("_made_layout"), turns.alias("_made_turns")).drop("layout", "turns").withColumnsRenamed({"_made_layout": "layout", "_made_turns": "turns"})


def unmapped(df: DataFrame, turns_col: str = "turns") -> DataFrame:
    """The records whose layout no mapping knows, which :func:`format_chat` leaves out."""
    return df.filter(F.col(turns_col).isNull())


def escape(text: Column) -> Column:
    """A backslash becomes ``\\s``; the first character of a control string ``\\l`` or ``\\b``."""
    text = F.replace(text, F.lit("\\"), F.lit("\\s"))
    text = F.regexp_replace(text, r"<(?=\||/?s>|</?SYS>>)", r"\\l")
    return F.regexp_replace(text, r"\[(?=/?INST\])", r"\\b")


def unescape(text: Column) -> Column:
    for code, plain in (("\\l", "<"), ("\\b", "["), ("\\n", "\n"), ("\\s", "\\")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def format_rows(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``conv, formatted, spans`` of one row per turn. A null role or text is empty; rows of one
    turn number go by role, then text, as they are before any escape; rows that repeat are turns
    of their own; rows of a null conversation are one conversation; null turn numbers come last.
    Spans: (start, end, loss) in code points of each turn's text in ``formatted``, loss for
    assistants. Other columns are ignored; an empty table gives an empty result.
    """
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    part = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), plain(role).alias("raw_role"), plain(text).alias("raw_text"))
    part = part.select("*", _escape_role(F.col("raw_role")).alias("role"), escape(F.col("raw_text")).alias("text"))
    part = part.withColumn("head", F.concat(F.lit(HEAD), "role", F.lit("\n")))
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_last("turn"), "raw_role", "raw_text")
    size = F.length("head") + F.length("text") + F.lit(len(TAIL))
    before = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = part.withColumn("no", F.row_number().over(order)).withColumn("start", before + F.length("head"))
    made = part.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("no", F.concat("head", "text", F.lit(TAIL)).alias("piece"), "start", (F.col("start") + F.length("text")).alias("end"), (F.col("role") == "assistant").alias("loss")))).alias("all"))
    spans = F.transform("all", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["loss"].alias("loss")))
    return made.select("conv", F.concat_ws("", F.col("all.piece")).alias("formatted"), spans.alias("spans"))


def format_chat(df: DataFrame, id_col: str, turns_col: str = "turns") -> DataFrame:
    """:func:`format_rows` for a column of canonical turns. A record with null or no turns is left
    out; records of one id are one conversation, their turns merged by number."""
    rows = df.select(F.col(id_col).alias("conv"), F.posexplode(turns_col).alias("turn", "t")).select("conv", "turn", "t.role", "t.text")
    return format_rows(rows, "conv", "turn", "role", "text")


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv, turns, loss_texts`` from ``formatted`` and ``spans`` alone."""
    # What follows the last tail is empty.
    pieces = F.expr(r"filter(split(formatted, '<\\|im_end\\|>\\n'), (x, i) -> x <> '')")
    turns = F.transform("pieces", lambda x: _turn(unescape(F.substring_index(F.substring(x, len(HEAD) + 1, 2147483647), "\n", 1)), unescape(F.substring(x, F.instr(x, "\n") + 1, F.lit(2147483647)))))
    # A piece starts where the text before it ends, one tail later.
    zero = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.element_at(F.col("spans"), i)["end"] + len(TAIL))
    marked = F.transform(F.arrays_zip("pieces", "spans"), lambda x, i: F.when(x["spans"]["loss"], unescape(F.substring(x["pieces"], (x["spans"]["start"] - zero(i) + 1).cast("int"), (x["spans"]["end"] - x["spans"]["start"]).cast("int")))))
    return formatted.withColumn("pieces", pieces).select("conv", "formatted", turns.alias("turns"), F.filter(marked, lambda x: x.isNotNull()).alias("loss_texts"))


def digest(read: DataFrame) -> DataFrame:
    """Counts and digests of what :func:`read_back` gave."""
    told = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    loss = F.concat_ws("", "loss_texts")
    return read.select(F.col("conv").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
