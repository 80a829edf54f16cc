"""Chat formatting: schema fingerprints choose declarative mappings into canonical turns.

The nested field paths of a data set, or of each JSON record, are hashed after paths that no mapping knows were
dropped; the hash is looked up in a table of all layouts, which names a ``Mapping`` that says, as data, how that layout
becomes an array of (role, text) turns. Everything here is built-in column functions.

The template is ``<s>[INST] role [/INST]text</s>`` for each turn. Control strings inside roles and texts get one
more backslash after their first character (``</s>`` becomes ``<\\/s>``, ``<\\/s>`` becomes ``<\\\\/s>``), which
``unescape`` undoes exactly. The loss mask is spans of code points of the formatted text.

Defined cases: a null role or text is empty; a conversation without turns formats to an empty string; rows with a
null conversation id form one conversation; equal turn numbers are ordered by role, then text; an empty table gives
an empty result. Extra columns and keys are ignored, also those that belong to a layout that is incomplete; where
several layouts are complete, the one with most paths counts. Texts of any length are whole; a conversation is one row,
so its turns are folded in one task, in time that grows with its length times its turns.
"""

from __future__ import annotations

import hashlib
import itertools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The markers of the template, and the pattern of the strings that texts must not hold bare.
BEGIN, HEAD_END, END = "<s>[INST] ", " [/INST]", "</s>"
CONTROL = r"([<\[])(\\*)(/?s>|/?INST\])"
ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\])"

TURNS = "array<struct<role:string,text:string>>"


def field_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Paths of the leaves, ``[]`` for array elements: ``messages[].role``."""
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, f"{prefix}[]")
    return [prefix]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Mapping:
    """``pairs``: (role, fields joined by a blank line) for one record with fixed fields, of which those in ``optional``
    may be missing.

    ``items``: (array, role field, text field) for a record that nests its turns.
    ``rows``: (order, role, text) for one row per turn.
    """

    name: str
    pairs: tuple[tuple[str, tuple[str, ...]], ...] = ()
    optional: tuple[str, ...] = ()
    items: tuple[str, str, str] | None = None
    rows: tuple[str, str, str] | None = None
    roles: dict[str, str] = field(default_factory=dict)

    @property
    def paths(self) -> tuple[str, ...]:
        if self.items:
            return f"{self.items[0]}[].{self.items[1]}", f"{self.items[0]}[].{self.items[2]}"
        return self.rows or tuple(f for _, fields in self.pairs for f in fields)

    def layouts(self) -> list[frozenset[str]]:
        """The sets of paths that are this layout."""
        needed = [p for p in self.paths if p not in self.optional]
        return [frozenset(needed) | set(some) for n in range(len(self.optional) + 1) for some in itertools.combinations(self.optional, n)]


MAPPINGS = (
    Mapping("prompt", pairs=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("question", pairs=(("user", ("question",)), ("assistant", ("answer",)))),
    Mapping("instruction", pairs=(("user", ("instruction", "input")), ("assistant", ("output",))), optional=("input",)),
    Mapping("messages", items=("messages", "role", "content")),
    Mapping("from_value", items=("conversations", "from", "value"), roles={"human": "user", "gpt": "assistant"}),
    Mapping("turn_rows", rows=("turn", "role", "text")),
)


def layout_table(mappings: tuple[Mapping, ...] = MAPPINGS) -> dict[str, Mapping]:
    """Fingerprints of all layouts and of all unions of layouts, with the mapping of most paths among them, of equals that of
    rows, as it would lose turns to be read otherwise."""
    table: dict[str, Mapping] = {}
    for n in range(1, len(mappings) + 1):
        for some in itertools.combinations(mappings, n):
            for sets in itertools.product(*(m.layouts() for m in some)):
                best = max(zip(some, sets), key=lambda x: (len(x[1]), x[0].rows is not None))[0]
                table.setdefault(fingerprint(list(frozenset().union(*sets))), best)
    return table


def known_paths(have: set[str], mappings: tuple[Mapping, ...]) -> list[str]:
    """The paths of ``have`` that belong to a complete layout."""
    return [p for p in have if any(p in s and s <= have for m in mappings for s in m.layouts())]


def select_mapping(schema: T.StructType, mappings: tuple[Mapping, ...] = MAPPINGS) -> Mapping:
    """The mapping that the table of layouts has for the fingerprint of the schema's known paths."""
    have = set(field_paths(schema))
    found = layout_table(mappings).get(fingerprint(known_paths(have, mappings)))
    if found is None:
        raise ValueError(f"no layout has the fingerprint of {sorted(have)}")
    return found


def _text(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def _renamed(m: Mapping, role: Column) -> Column:
    return F.coalesce(*[F.when(role == k, F.lit(v)) for k, v in m.roles.items()], role)


def canonical_turns(df: DataFrame, id_col: str, mappings: tuple[Mapping, ...] = MAPPINGS, mapping: Mapping | None = None) -> DataFrame:
    """(conv_id, turns) of a data set in any known layout, or in that of ``mapping``."""
    m = mapping or select_mapping(df.schema, mappings)
    rename = lambda role: _renamed(m, role)
    if m.rows:
        order, role, text = m.rows
        turn = F.struct(F.col(order).alias("n"), rename(_text(role)).alias("role"), _text(text).alias("text"))
        grouped = df.groupBy(F.col(id_col).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("ts"))
        return grouped.select("conv_id", F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    if m.items:
        array, role, text = m.items
        turns = F.transform(F.col(array), lambda t: F.struct(rename(_text(t[role])).alias("role"), _text(t[text]).alias("text")))
        return df.select(F.col(id_col).alias("conv_id"), F.coalesce(turns, F.array().cast(TURNS)).alias("turns"))
    joined = lambda fields: F.array_join(F.filter(F.array(*[_text(f) for f in fields]), lambda x: x != ""), "\n\n")
    return df.select(F.col(id_col).alias("conv_id"), F.array(*[F.struct(F.lit(r).alias("role"), joined([f for f in fs if f in df.columns]).alias("text")) for r, fs in m.pairs]).alias("turns"))


def record_paths(v: Column) -> Column:
    """The paths of a record's keys: ``key``, or ``key[].field`` for each field of an array's objects; an empty array is
    ``key[]``. Values may be of any type, also null."""
    def inside(e: Column) -> Column:
        items = F.try_variant_get(e["value"], "$", "array<map<string,variant>>")
        fields = F.array_distinct(F.flatten(F.transform(items, lambda x: F.coalesce(F.map_keys(x), F.array().cast("array<string>")))))
        nested = F.transform(fields, lambda f: F.concat(e["key"], F.lit("[]."), f))
        return F.when(items.isNull(), F.array(e["key"])).when(F.size(items) == 0, F.array(F.concat(e["key"], F.lit("[]")))).otherwise(nested)

    return F.flatten(F.transform(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), inside))


def record_layout(paths: Column, mappings: tuple[Mapping, ...] = MAPPINGS) -> Column:
    """The hash of a record's known paths, as ``fingerprint`` has it: those of a complete layout, or an empty array."""
    arrays = [f"{m.items[0]}[]" for m in mappings if m.items]
    have = lambda names: F.size(F.array_intersect(paths, F.array(*map(F.lit, sorted(names))))) == len(names)
    sets = [s for m in mappings if not m.rows for s in m.layouts()] + [frozenset([a]) for a in arrays]
    known = F.flatten(F.array(*[F.when(have(s), F.array(*map(F.lit, sorted(s)))).otherwise(F.array().cast("array<string>")) for s in sets]))
    return F.substring(F.sha2(F.array_join(F.array_sort(F.array_distinct(known)), "\n"), 256), 1, 16)


def record_turns(v: Column, m: Mapping) -> Column:
    """Turns of a record by a mapping; what isn't a string is text as JSON."""
    said = lambda x, path: F.coalesce(F.try_variant_get(x, path, "string"), F.nullif(F.to_json(F.try_variant_get(x, path, "variant")), F.lit("null")), F.lit(""))
    if m.items:
        array, role, text = m.items
        turn = lambda x: F.struct(_renamed(m, said(x, f"$['{role}']")).alias("role"), said(x, f"$['{text}']").alias("text"))
        return F.transform(F.try_variant_get(v, f"$['{array}']", "array<variant>"), turn)
    joined = lambda fields: F.array_join(F.filter(F.array(*[said(v, f"$['{f}']") for f in fields]), lambda x: x != ""), "\n\n")
    return F.array(*[F.struct(F.lit(r).alias("role"), joined(fields).alias("text")) for r, fields in m.pairs])


def canonical_records(df: DataFrame, id_col: str, payload: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """(conv_id, turns, layout) of JSON records in mixed layouts, each by the hash of its own paths.

    ``turns`` is null where no layout is complete; ``layout`` is the hash then too, so that such records can be counted.
    """
    nested = tuple(m for m in mappings if not m.rows)
    table = layout_table(nested)
    empty = {fingerprint([f"{m.items[0]}[]"]): m for m in nested if m.items}
    parsed = df.select(F.col(id_col).alias("conv_id"), F.try_parse_json(payload).alias("v"))
    keyed = parsed.select("conv_id", "v", record_layout(F.coalesce(record_paths(F.col("v")), F.array().cast("array<string>")), nested).alias("layout"))
    turns = F.coalesce(*[F.when(F.col("layout").isin([h for h, x in (table | empty).items() if x is m]), record_turns(F.col("v"), m)) for m in nested])
    return keyed.select("conv_id", turns.cast(TURNS).alias("turns"), "layout")


def escape(c: Column) -> Column:
    return F.regexp_replace(c, CONTROL, r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, ESCAPED, r"$1$2$3")


def format_turns(canonical: DataFrame, learn_role: str = "assistant") -> DataFrame:
    """(conv_id, turns, formatted, loss_spans): the mask is spans in code points of ``formatted``, one for each text to
    learn."""
    parts = F.transform("turns", lambda t: F.struct(F.concat(F.lit(BEGIN), escape(t["role"]), F.lit(HEAD_END)).alias("head"), escape(t["text"]).alias("body"), (t["role"] == learn_role).alias("learn")))
    df = canonical.select("conv_id", "turns", parts.alias("parts"))
    sizes = F.aggregate(
        F.transform("parts", lambda p: F.struct(F.length(p["head"]).cast("long").alias("h"), F.length(p["body"]).cast("long").alias("b"), p["learn"].alias("learn"))),
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + p["h"] + p["b"] + len(END)).alias("at"),
            F.when(p["learn"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + p["h"]).alias("start"), (acc["at"] + p["h"] + p["b"]).alias("end"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return df.select("conv_id", "turns", F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("formatted"), sizes.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse ``formatted`` and cut it by its mask: (conv_id, formatted, parsed turns, learnt texts)."""
    pieces = F.split("formatted", END)
    df = formatted.select("conv_id", "formatted", "loss_spans", F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))).alias("pieces"))
    head = lambda x: F.substring_index(x, HEAD_END, 1)
    turn = lambda x: F.struct(unescape(F.substr(head(x), F.lit(len(BEGIN) + 1))).alias("role"), unescape(F.substr(x, F.length(head(x)) + len(HEAD_END) + 1)).alias("text"))
    cut = lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    return df.select("conv_id", "formatted", F.transform("pieces", turn).alias("parsed"), F.transform("loss_spans", cut).alias("learnt"))


def digest(parsed: DataFrame) -> DataFrame:
    """The columns of the contract from what was read back."""
    learnt = F.array_join("learnt", "")
    said = F.array_join(F.transform("parsed", lambda p: F.concat(p["role"], F.lit("\n"), p["text"], F.lit("\n"))), "")
    return parsed.select(
        "conv_id",
        F.size("parsed").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
