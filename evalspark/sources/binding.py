"""Binding JSON request bodies to declared types, as a JSON decoder of a statically typed service does.

``from_json`` alone is not that: it takes a number for a text field, ignores what
follows the first value of a body, and knows field names in one spelling
only.  So the declared schema is read with a *variant* at each scalar's place,
and each variant is checked by path against the declared type:

- a name matches a field whatever its case, at its own place in the body only;
- of repeated names the last one in the body counts;
- unknown fields are ignored, whatever they hold;
- null leaves a field absent; a null body is an empty document;
- text must be text, an integer an integer literal of 64 bits, a number finite;
- anything but white space after the body refuses it.

One pass of the parser binds a body and checks its types; a second one
(:func:`one_value`) only skips through the tokens.

Checking a variant at every scalar's place is most of that work.  :func:`bind_at_once` reads a body
with the declared types themselves if nothing in it is spelt in a way that these would take
otherwise, and leaves the rest, refused bodies among them, to :func:`bind`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CORRUPT = "_corrupt_record"
#: Strict JSON: no single quotes, no NaN.
_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT, "allowSingleQuotes": "false",
            "allowNonNumericNumbers": "false"}
#: A key with a letter that has another lower case.  Quotes open a key or a value only after one of ``{[,:``
#: and those inside of text are escaped, so the pattern can't begin within a value.
_OTHER_CASE = r'[{,]\s*"[^"\\]*[A-Z\x{17F}\x{212A}][^"\\]*"\s*:'
#: A key with an escape or a capital, from the last of these on.  Without backtracking: a pattern that begins at every key costs
#: more than parsing the body.
_ODD_KEY = r'[A-Z\\][^"\\A-Z]*+"\s*+:'
#: Letters beside capitals that have a declared one as their lower case.
_FOLDING = ("\u017f", "\u212a")
#: Between bound texts, and a text among them that reads like a value that is none.
_SEP = "\x01"
_LIKE_VALUE = r"\x01(?:[\[{]|(?:true|false|-?+[0-9]++(?:\.[0-9]++)?+(?:[eE][-+]?+[0-9]++)?+)(?:\x01|$))"
#: Names that no plain body can hold as a key.
_BODY, _END = "Body", "End"


def field_names(schema: T.DataType) -> set[str]:
    """All field names of a schema, at any depth."""
    if isinstance(schema, T.ArrayType):
        return field_names(schema.elementType)
    if isinstance(schema, T.StructType):
        return {f.name for f in schema}.union(*[field_names(f.dataType) for f in schema])
    return set()


def with_declared_names(body: Column, schema: T.StructType) -> Column:
    """The body with every key that differs from a declared name only by case spelt as declared.

    Keys of unknown objects may change too; they are ignored in any case.  The order of keys stays, so the
    last of repeated names stays the last.
    """
    spelt = reduce(lambda b, n: F.regexp_replace(b, rf'([{{,]\s*")(?iu:{n})("\s*:)', f"$1{n}$2"), sorted(field_names(schema)), body)
    return F.when(body.rlike(_OTHER_CASE), spelt).otherwise(body)


def variant_schema(dt: T.DataType) -> T.DataType:
    """The declared type with a variant at each scalar's place."""
    if isinstance(dt, T.ArrayType):
        return T.ArrayType(variant_schema(dt.elementType))
    if isinstance(dt, T.StructType):
        return T.StructType([T.StructField(f.name, variant_schema(f.dataType)) for f in dt])
    return T.VariantType()


def _scalar(v: Column, dt: T.DataType) -> Column:
    name = {T.StringType: "string", T.LongType: "bigint", T.DoubleType: "double"}[type(dt)]
    return F.try_variant_get(v, "$", name)


def _wrong_scalar(v: Column, dt: T.DataType) -> Column:
    own = F.schema_of_variant(v)
    if isinstance(dt, T.StringType):
        return ~own.isin("STRING", "VOID")
    if isinstance(dt, T.LongType):
        return ~own.isin("BIGINT", "VOID")
    number = own.isin("BIGINT", "DOUBLE", "FLOAT") | own.startswith("DECIMAL")
    return ~((own == "VOID") | (number & (F.abs(_scalar(v, dt)) < float("inf"))))


def bound(c: Column, dt: T.DataType) -> Column:
    """Column ``c`` (of ``variant_schema(dt)``) as ``dt``."""
    if isinstance(dt, T.ArrayType):
        return F.transform(c, lambda x: bound(x, dt.elementType))
    if isinstance(dt, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[bound(c[f.name], f.dataType).alias(f.name) for f in dt]))
    return _scalar(c, dt)


def wrong(c: Column, dt: T.DataType) -> Column:
    """Whether a scalar somewhere in ``c`` has another type than declared (absent ones have none)."""
    if isinstance(dt, T.ArrayType):
        found = F.exists(c, lambda x: wrong(x, dt.elementType))
    elif isinstance(dt, T.StructType):
        found = reduce(lambda a, b: a | b, [wrong(c[f.name], f.dataType) for f in dt])
    else:
        found = _wrong_scalar(c, dt)
    return F.coalesce(found, F.lit(False))


def one_value(body: Column) -> Column:
    """Whether the body is one JSON value, given that it can be read as the value of an object's only key.

    What may follow a first value without the parser noticing is what closes the surrounding; in an
    object that is ``}``, here it is ``]``, so a body that passes both is followed by nothing.
    """
    return F.coalesce(F.json_array_length(F.concat(F.lit("["), body, F.lit("]"))) == 1, F.lit(False))


def bind(df: DataFrame, schema: T.StructType, col: str = "doc", into: str = "d") -> DataFrame:
    """Bind the JSON text ``col`` to a struct ``into`` and say in ``reject`` why a body is refused (NULL: it is not).

    ``into`` is NULL for a refused body and for the body ``null``.
    """
    whole = T.StructType([T.StructField("body", variant_schema(schema)), T.StructField(_CORRUPT, T.StringType())])
    text = with_declared_names(F.col(col), schema)
    parsed = F.from_json(F.concat(F.lit('{"body":'), text, F.lit("}")), whole, _OPTIONS)
    out = df.withColumn("__p", parsed).withColumn("__one", one_value(F.col(col)))
    body = F.col("__p.body")
    # only a body that does not bind is looked at again, to tell why
    is_object = F.schema_of_variant(F.try_parse_json(F.col(col))).startswith("OBJECT")
    reason = (F.when(F.col(col).isNull(), "no body")
              .when(~F.col("__one"), "not a JSON object")
              .when(F.col(f"__p.{_CORRUPT}").isNotNull(), F.when(is_object, "wrong type").otherwise("not a JSON object"))
              .when(wrong(body, schema), "wrong type"))
    return (out.withColumn("reject", reason)
            .withColumn(into, F.when(F.col("reject").isNull(), bound(body, schema))).drop("__p", "__one"))


def text_names(schema: T.DataType) -> set[str] | None:
    """The names of all text fields of a schema, at any depth; None if it has lists of text."""
    if isinstance(schema, T.ArrayType):
        return None if isinstance(schema.elementType, T.StringType) else text_names(schema.elementType)
    if not isinstance(schema, T.StructType):
        return set()
    inner = [text_names(f.dataType) for f in schema]
    if None in inner:
        return None
    return {f.name for f in schema if isinstance(f.dataType, T.StringType)}.union(*inner)


def plain_keys(body: Column) -> Column:
    """Whether every key is spelt without escapes and letters of another case.  Text that looks like such a key makes a body
    not plain too, which costs time only."""
    return ~reduce(lambda a, b: a | b, [body.contains(p) for p in _FOLDING], body.rlike(_ODD_KEY))


def plain_texts(body: Column, texts: set[str]) -> Column:
    """Whether every field named as one of ``texts`` holds text or null wherever it stands, and no key is set off from its colon."""
    odd = body.rlike(r'"\s++:')
    return ~(odd | body.rlike(rf'":(?=\s*+[^"n\s])(?<="(?:{"|".join(sorted(texts))})":)')) if texts else ~odd


def plain(body: Column, texts: set[str]) -> Column:
    """:func:`plain_keys` and :func:`plain_texts`."""
    return plain_keys(body) & plain_texts(body, texts)


def texts_of(c: Column, dt: T.DataType) -> list[Column]:
    """The texts in ``c`` (of type ``dt``), those of a list joined by :data:`_SEP`."""
    if isinstance(dt, T.ArrayType):
        inner = lambda x: F.concat_ws(_SEP, *texts_of(x, dt.elementType))
        return [F.array_join(F.transform(c, inner), _SEP)] if text_names(dt.elementType) else []
    if isinstance(dt, T.StructType):
        return [t for f in dt for t in texts_of(c[f.name], f.dataType)]
    return [c] if isinstance(dt, T.StringType) else []


def other_than_text(body: Column, c: Column, schema: T.StructType, texts: set[str]) -> Column:
    """Whether a text of ``c`` may have been another value in the body that it was read from.

    With the declared types a parser takes any value for a text.  Only where a text reads like a number, a boolean, a list or an
    object is the body itself searched (:func:`plain_texts`).
    """
    like = F.concat_ws(_SEP, F.lit(""), *texts_of(c, schema)).rlike(_LIKE_VALUE)
    return like & ~plain_texts(body, texts)


def off_double(c: Column, dt: T.DataType) -> Column:
    """Whether a number somewhere in ``c`` (of type ``dt``) is beyond a double or a negative zero (a decimal has none)."""
    if isinstance(dt, T.ArrayType):
        found = F.exists(c, lambda x: off_double(x, dt.elementType))
    elif isinstance(dt, T.StructType):
        found = reduce(lambda a, b: a | b, [off_double(c[f.name], f.dataType) for f in dt])
    elif isinstance(dt, T.DoubleType):
        found = (F.abs(c) == float("inf")) | ((c == 0) & c.cast("string").startswith("-"))
    else:
        found = F.lit(False)
    return F.coalesce(found, F.lit(False))


def fitted(c: Column, schema: T.StructType) -> Column:
    """The fields of ``schema`` from a struct that has more; NULL stays NULL."""
    return F.when(c.isNotNull(), F.struct(*[c[f.name].alias(f.name) for f in schema]))


def bind_at_once(df: DataFrame, schema: T.StructType, col: str = "doc", into: str = "d") -> DataFrame:
    """:func:`bind`, with plain bodies that fit the declared types read with these."""
    texts = text_names(schema)
    if texts is None:
        return bind(df, schema, col, into)
    item = T.StructType([*schema.fields, T.StructField(_END, T.LongType())])
    whole = T.StructType([T.StructField(_BODY, T.ArrayType(item)), T.StructField(_CORRUPT, T.StringType())])
    body = F.col(col)
    # a second item of the array is this one only if the body is one value and nothing else, as it holds neither name
    text = F.concat(F.lit(f'{{"{_BODY}":['), body, F.lit(f',{{"{_END}":1}}]}}'))
    read = F.when(plain_keys(body), F.from_json(text, whole, _OPTIONS))
    items = F.col(f"__q.{_BODY}")
    first = F.get(items, 0)
    whole_read = F.col(f"__q.{_CORRUPT}").isNull() & (F.size(items) == 2) & (F.get(items, 1)[_END] == 1)
    taken = F.coalesce(whole_read & ~off_double(first, schema) & ~other_than_text(body, first, schema, texts), F.lit(False))
    rest = df.withColumn("__q", read).withColumn("__taken", taken).withColumn("__rest", F.when(~F.col("__taken"), body))
    out = bind(rest, schema, "__rest", "__bound")
    return out.select(*[F.col(f"`{c}`") for c in df.columns],
                      F.when(~F.col("__taken"), F.col("reject")).alias("reject"),
                      F.when(F.col("__taken"), fitted(first, schema)).otherwise(F.col("__bound")).alias(into))
