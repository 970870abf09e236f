"""Chat formatting by schema fingerprints.

A record's nested field paths (``messages[].role``) are hashed; the fingerprint
selects a declarative mapping that says where turns, roles and texts are, and
the mapping turns the record into canonical turns (ordinal, role, text).  Both
whole tables (paths from the schema) and JSON records of mixed layouts in one
column (paths from each record) go through the same registry.

The template marks turns with control strings.  The same strings inside texts
are escaped by a backslash after their first character, and ones that already
carry backslashes by one more, so the escape is exactly reversible and no
control string is left.  Roles are URL-encoded (plain roles stay as they are).

Everything is a DataFrame or Column expression.

Defined results: a null text is empty; a null role is ''; turns with equal
ordinals are ordered by role, then text; equal rows are turns of their own; a
null conversation id is a conversation; an empty table gives no rows; columns
that no mapping names are ignored, and where they resemble another layout the
mapping with most paths wins, then the first one listed.  A JSON record of no
known layout has null turns.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"
#: Control strings of common templates that must not appear inside a text, by first character: the rest as a pattern.
CONTROLS = {"<": r"\|im_start\|>|\|im_end\|>|\|startoftext\|>|\|endoftext\|>|/?s>|</?SYS>>", r"\[": r"/?INST\]"}
#: Roles of other layouts and their canonical names.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns.

    ``rows``: one row per turn, the columns (id, ordinal, role, text).
    ``turns``: an array field and the fields of role and text in it.
    ``fields``: (role, field) pairs of single-turn layouts, in order; a null or
    empty optional field adds nothing, or is put after the one before when it
    has the same role.
    """
    name: str
    paths: tuple[str, ...]
    optional: tuple[str, ...] = ()
    rows: tuple[str, str, str, str] | None = None
    turns: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, str], ...] = ()


MAPPINGS = (
    Mapping("turn rows", ("conv_id", "turn", "role", "text"), rows=("conv_id", "turn", "role", "text")),
    Mapping("messages", ("messages[].role", "messages[].content"), turns=("messages", "role", "content")),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), ("system",),
            turns=("conversations", "from", "value"), fields=(("system", "system"),)),
    Mapping("instruction", ("instruction", "output"), ("input", "system"),
            fields=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("prompt response", ("prompt", "response"), ("system",),
            fields=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("prompt completion", ("prompt", "completion"), ("system",),
            fields=(("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
)


def fingerprint(paths) -> str:
    """SHA-256 of the sorted field paths."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def field_paths(schema: T.StructType, prefix: str = "") -> list[str]:
    """The nested field paths of a schema; ``[]`` marks an array's elements."""
    out = []
    for f in schema:
        kind, path = f.dataType, prefix + f.name
        while isinstance(kind, T.ArrayType):
            kind, path = kind.elementType, path + "[]"
        out += field_paths(kind, path + ".") if isinstance(kind, T.StructType) else [path]
    return out


def registry(mappings=MAPPINGS) -> dict[str, Mapping]:
    """Fingerprint -> mapping, for every choice of a mapping's optional paths; the first one listed wins."""
    out: dict[str, Mapping] = {}
    for m in mappings:
        for bits in range(1 << len(m.optional)):
            some = [p for i, p in enumerate(m.optional) if bits >> i & 1]
            out.setdefault(fingerprint([*m.paths, *some]), m)
    return out


def select_mapping(paths, mappings=MAPPINGS) -> Mapping | None:
    """By the fingerprint of the known paths; with paths of several layouts, the fullest mapping among them."""
    known = {p for m in mappings for p in (*m.paths, *m.optional)}
    seen = known & set(paths)
    exact = registry(mappings).get(fingerprint(seen))
    held = [m for m in mappings if set(m.paths) <= seen]
    return exact or max(held, key=lambda m: len(m.paths), default=None)


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _role(c: Column) -> Column:
    names = F.create_map(*(F.lit(x) for kv in ROLE_NAMES.items() for x in kv))
    return F.coalesce(names[c.cast("string")], c.cast("string"), F.lit(""))


def _single(m: Mapping, get) -> Column:
    """The turns of ``m.fields``: fields of one role that follow one another become one turn, a blank line between."""
    runs: list[tuple[str, list[str]]] = []
    for role, field in m.fields:
        if runs and runs[-1][0] == role:
            runs[-1][1].append(field)
        else:
            runs.append((role, [field]))
    turns = []
    for role, names in runs:
        parts = [get(n) for n in names]
        text = F.array_join(F.filter(F.array(*parts), lambda s: F.coalesce(s, F.lit("")) != ""), "\n\n")
        needed = any(n in m.paths for n in names)
        turn = F.struct(F.lit(role).alias("role"), text.alias("text"))
        turns.append(turn if needed else F.when(text != "", turn))
    return F.filter(F.array(*turns), lambda t: t.isNotNull())


def _variant_turns(record: Column, field: str, role: str, text: str) -> Column:
    """The turns of a JSON record's array field."""
    return F.transform(F.try_variant_get(record, "$." + field, "array<variant>"), lambda t: F.struct(
        _role(F.try_variant_get(t, "$." + role, "string")).alias("role"),
        _text(F.try_variant_get(t, "$." + text, "string")).alias("text")))


def table_turns(df: DataFrame, id_col: str | None = None, mappings=MAPPINGS) -> DataFrame:
    """(conv_id, ordinal, role, text): one row per turn of a table whose schema a mapping knows."""
    m = select_mapping(field_paths(df.schema), mappings)
    if m is None:
        raise ValueError(f"no mapping for the fields {sorted(field_paths(df.schema))}")
    col = lambda c: F.col(f"`{c}`")
    if m.rows:
        ident, ordinal, role, text = m.rows
        return df.select(col(id_col or ident).alias("conv_id"), col(ordinal).cast("long").alias("ordinal"),
                         _role(col(role)).alias("role"), _text(col(text)).alias("text"))
    present = set(field_paths(df.schema))
    get = lambda n: col(n).cast("string") if n in present else F.lit(None).cast("string")
    turns = _single(m, get) if m.fields else F.expr("cast(array() as array<struct<role:string,text:string>>)")
    if m.turns:
        field, role, text = m.turns
        turns = F.concat(turns, F.transform(F.coalesce(col(field), F.array()), lambda t: F.struct(
            _role(t[role]).alias("role"), _text(t[text]).alias("text"))))
    return (df.select(col(id_col or "id").alias("conv_id"), F.posexplode(turns).alias("ordinal", "t"))
            .select("conv_id", F.col("ordinal").cast("long").alias("ordinal"), "t.role", "t.text"))


def json_turns(df: DataFrame, record: str, mappings=MAPPINGS) -> DataFrame:
    """``df`` with layout (the mapping's name) and turns (array of role, text) of each JSON record; null if unknown.

    Each record gets its own fingerprint, of the known paths that hold a value in
    any element, or else of all that are there, null ones and those of empty
    lists included.  Where neither is exact, the fullest mapping whose paths are
    all among them is taken.
    """
    mappings = tuple(m for m in mappings if not m.rows)
    known = sorted({p for m in mappings for p in (*m.paths, *m.optional)})
    none = F.expr("cast(array() as array<struct<role:string,text:string>>)")
    v = F.try_parse_json(F.col(f"`{record}`"))
    get = lambda path: F.try_variant_get(F.col("_v"), path, "string")

    def held(path: str, kind: str) -> Column:
        """Whether the record has the path: as a string in any element, or (kind variant) at all."""
        field, _, inner = path.partition("[].")
        if not inner:
            return F.try_variant_get(F.col("_v"), "$." + field, kind).isNotNull()
        items = F.try_variant_get(F.col("_v"), "$." + field, "array<variant>")
        some = F.exists(items, lambda t: F.try_variant_get(t, "$." + inner, kind).isNotNull())
        if kind == "string":
            return some
        return some | (F.size(items) == 0) | F.is_variant_null(F.try_variant_get(F.col("_v"), "$." + field, "variant"))

    exact, fullest = [], []
    for kind in ("string", "variant"):
        seen = F.col(f"_{kind}")
        exact.append(F.coalesce(*(F.when(F.sha2(F.array_join(seen, "\n"), 256) == key, mappings.index(m))
                                  for key, m in registry(mappings).items())))
        fullest.append(F.coalesce(*(F.when(F.size(F.array_except(F.array(*map(F.lit, m.paths)), seen)) == 0, mappings.index(m))
                                    for m in sorted(mappings, key=lambda m: -len(m.paths)))))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    for i, m in enumerate(mappings):
        these = _single(m, lambda n: get("$." + n)) if m.fields else none
        if m.turns:
            these = F.concat(these, F.coalesce(_variant_turns(F.col("_v"), *m.turns), none))
        layout = F.when(F.col("_m") == i, F.lit(m.name)).otherwise(layout)
        turns = F.when(F.col("_m") == i, these).otherwise(turns)
    paths = {f"_{kind}": F.array_compact(F.array(*(F.when(held(p, kind), F.lit(p)) for p in known))) for kind in ("string", "variant")}
    return (df.withColumn("_v", v).withColumns(paths).withColumn("_m", F.coalesce(*exact, *fullest))
            .withColumn("layout", layout).withColumn("turns", turns).drop("_v", "_m", *paths))


def escape(text: Column) -> Column:
    """``text`` without any control string; :func:`unescape` gives it back."""
    for first, rest in CONTROLS.items():
        text = F.regexp_replace(text, rf"{first}(\\*+)({rest})", rf"{first}$1\\$2")
    return text


def unescape(text: Column) -> Column:
    for first, rest in CONTROLS.items():
        text = F.regexp_replace(text, rf"{first}\\(\\*+)({rest})", rf"{first}$1$2")
    return text


def format_turns(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans): one text per conversation, and the code points [start, end) that a loss covers.

    A turn's place is a running sum within its conversation, so long
    conversations cost time in proportion to their length.
    """
    head = F.concat(F.lit(START), F.url_encode("role"), F.lit("\n"))
    t = (turns.select("conv_id", "ordinal", "role", "text", escape(F.col("text")).alias("body"))
         .select("*", F.concat(head, "body", F.lit(END + "\n")).alias("segment"))
         .select("*", F.length("segment").alias("n"), F.length("body").alias("body_n")))
    order = ("ordinal", "role", "text")
    in_order = Window.partitionBy("conv_id").orderBy(*order)
    t = t.select("*", F.row_number().over(in_order).alias("i"),
                 F.sum("n").over(in_order.rowsBetween(Window.unboundedPreceding, 0)).alias("to"))
    stop = F.col("to") - len(END) - 1
    span = F.when(F.col("role") == loss_role, F.struct((stop - F.col("body_n")).alias("start"), stop.alias("end")))
    g = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("i", "segment", span.alias("span")))).alias("s"))
    return g.select("conv_id", F.array_join(F.transform("s", lambda x: x["segment"]), "").alias("formatted"),
                    F.filter(F.transform("s", lambda x: x["span"]), lambda x: x.isNotNull()).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text: array of struct(role, text), unescaped."""
    blocks = F.split(formatted, r"<\|im_end\|>\n", -1)

    def turn(b):
        cut = F.instr(b, "\n")
        return F.struct(F.url_decode(F.substr(b, F.lit(len(START) + 1), cut - len(START) - 1)).alias("role"),
                        unescape(F.substr(b, cut + 1)).alias("text"))
    return F.transform(F.slice(blocks, 1, F.size(blocks) - 1), turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(
        F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def digest(formatted: DataFrame) -> DataFrame:
    """What a reader gets back from the formatted texts, as counts and hashes."""
    back = formatted.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"),
                            loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))
