"""JSON access with Python-dict semantics, on Spark's VARIANT type.

A raw record is kept as JSON text (bronze). It is parsed once per record with
``try_parse_json`` into a VARIANT, and fields are read with ``variant_get``.
Unlike ``from_json``, the variant keeps the difference between an absent key
and a key holding JSON ``null``, and it keeps each value's JSON type, which the
feed rules need (Python truthiness, ``int()`` versus ``float()`` coercion).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(raw: Column | str) -> Column:
    """JSON text -> VARIANT; unparsable text gives NULL."""
    return F.try_parse_json(F.col(raw) if isinstance(raw, str) else raw)


def field(v: Column, key: str) -> Column:
    """The value under ``key`` as VARIANT (SQL NULL when the key is absent)."""
    return F.try_variant_get(v, f"$.{key}" if key.isidentifier() else f"$['{key}']", "variant")


_STAGED = re.compile(r"^Column<'_f_(\w+)'>$")


def _staged(x: Column, prefix: str) -> Column | None:
    """The precomputed column for a staged field (see ``stage_fields``), if any."""
    m = _STAGED.match(str(x))
    return F.col(f"_{prefix}_{m.group(1)}") if m else None


def stage_fields(df, raw_col: str, keys: list[str], keep: list[str]):
    """Parse a JSON record once and stage, per key, its value, type, truthiness and text.

    Each stage is its own projection; the optimizer keeps them apart because
    their expressions are expensive and referenced several times, so every
    lookup runs once per record and the rules downstream stay small enough for
    whole-stage code generation. Returns ``(df, getter)``; ``getter(key)`` is
    the staged VARIANT column, which the functions of this module recognise.
    """
    shape = ", ".join(f"`{k}` variant" for k in keys)
    parsed = df.select(*keep, F.col(raw_col).alias("_raw"), F.from_json(raw_col, shape).alias("_v"))
    vals = parsed.select(*keep, "_raw", *[F.col(f"_v.{k}").alias(f"_f_{k}") for k in keys])
    typed = vals.select("*", *[kind_of(F.col(f"_f_{k}")).alias(f"_t_{k}") for k in keys],
                        *[F.try_variant_get(F.col(f"_f_{k}"), "$", "string").alias(f"_s_{k}") for k in keys])
    done = typed.select("*", *[_truthy_text(F.col(f"_f_{k}"), F.col(f"_s_{k}")).alias(f"_b_{k}") for k in keys])
    return done, (lambda k: F.col(f"_f_{k}"))


def kind_of(x: Column) -> Column:
    """JSON type of a VARIANT value: STRING, NUMBER, BOOLEAN, VOID, ARRAY<..> or OBJECT<..>."""
    t = F.schema_of_variant(x)
    return F.when(t.startswith("DECIMAL") | t.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT"),
                  F.lit("NUMBER")).otherwise(t)


def vtype(x: Column) -> Column:
    """JSON type of a VARIANT value (see ``kind_of``); staged fields reuse their column."""
    st = _staged(x, "t")
    return st if st is not None else kind_of(x)


def is_null_or_absent(x: Column) -> Column:
    return x.isNull() | F.is_variant_null(x)


def as_string(x: Column) -> Column:
    st = _staged(x, "s")
    return st if st is not None else F.try_variant_get(x, "$", "string")


def as_double(x: Column) -> Column:
    return F.try_variant_get(x, "$", "double")


def is_numeric(x: Column) -> Column:
    return vtype(x) == F.lit("NUMBER")


def is_string(x: Column) -> Column:
    return vtype(x) == F.lit("STRING")


def is_array(x: Column) -> Column:
    return vtype(x).startswith("ARRAY")


def truthy(x: Column) -> Column:
    """Python truthiness of a JSON value (``bool(d.get(k))``); never NULL."""
    st = _staged(x, "b")
    return st if st is not None else _truthy(x, vtype(x))


def _truthy(x: Column, t: Column) -> Column:
    return (
        F.when((x.isNull() | F.is_variant_null(x)), F.lit(False))
        .when(t == "BOOLEAN", F.try_variant_get(x, "$", "boolean"))
        .when(t == "STRING", F.length(F.try_variant_get(x, "$", "string")) > 0)
        .when(t.startswith("ARRAY"), F.array_size(F.try_variant_get(x, "$", "array<variant>")) > 0)
        .when(t.startswith("OBJECT"), t != F.lit("OBJECT<>"))
        .otherwise(F.coalesce(as_double(x) != 0, F.lit(True)))
    )


def _truthy_text(x: Column, s: Column) -> Column:
    """Truthiness read off the value's text; its type is asked for only where the text leaves it open."""
    open_ = s.isin("false", "[]", "{}") | F.substring(s, 1, 1).isin("0", "-")
    return (F.when(s.isNull(), F.lit(False)).when(s == "", F.lit(False)).when(~open_, F.lit(True))
            .otherwise(_truthy(x, kind_of(x))))


def text_or(x: Column, default: Column | str) -> Column:
    """``str(d.get(k) or default)``: the value as text when truthy, else the default."""
    d = F.lit(default) if isinstance(default, str) else default
    return F.when(truthy(x), as_string(x)).otherwise(d)


def string_list(x: Column) -> Column:
    """A JSON array as ARRAY<STRING> (elements rendered as text); non-arrays -> NULL."""
    return F.when(is_array(x), F.try_variant_get(x, "$", "array<string>"))


def json_record(fields: list[tuple[str, Column]], nulls: list[tuple[str, Column]] | None = None) -> Column:
    """JSON object text from typed columns in one ``to_json`` call.

    A NULL value leaves its key out. A key may be listed several times with
    different types (e.g. a number for some rows, text for others) as long as
    at most one of them is non-NULL per row. ``nulls`` lists (key, condition)
    pairs that write an explicit JSON ``null`` when the condition holds.
    """
    text = F.to_json(F.struct(*[c.alias(k) for k, c in fields]))
    if not nulls:
        return text
    extra = F.concat_ws("", *[F.when(cond, F.lit(f',"{k}":null')) for k, cond in nulls])
    # the serialised text is referenced once: splice before the closing brace
    spliced = F.regexp_replace(text, r"\}$", F.concat(extra, F.lit("}")))
    return F.regexp_replace(spliced, r"^\{,", F.lit("{"))
