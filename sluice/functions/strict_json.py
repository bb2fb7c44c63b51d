"""Strict-JSON column functions (native Spark expressions, no Python rows).

The envelope is decoded once with ``from_json`` into VARIANT fields; the JSON
type of each field is then read with ``schema_of_variant``. This keeps the
strictness of a typed decoder: a string where an integer is expected, or a
number where a string is expected, is a decode error instead of a silent cast.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def computed_once(c: Column) -> Column:
    """Return ``c`` unchanged, but stop the optimizer from copying its expression.

    Catalyst pushes a filter on a derived column below the projection that
    derives it by inlining the expression, and repeats that for every
    reference; for a parsed envelope that copies ``from_json`` hundreds of
    times. A (trivially true) non-deterministic guard keeps the projection
    where it is, so the value is computed once per row and later filters stay
    above it.
    """
    return F.when(F.spark_partition_id() >= 0, c)


def is_single_json_value(text: Column) -> Column:
    """True when ``text`` is exactly one JSON value (no trailing text, no single quotes, no NaN).

    ``from_json`` ignores text after the first complete value, so the text is
    parsed inside two different wrappers: as the only element of ``[...]`` and
    as the value of ``{"x": ...}``. Text that closes the array early (``1] [2``)
    breaks the object wrapper and text that closes the object early
    (``1} {"y":2``) breaks the array wrapper; ``{..} x``, ``{..},{..}``, empty
    and non-JSON text fail both.
    """
    arr = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>", _STRICT)
    obj = F.from_json(F.concat(F.lit('{"x":'), text, F.lit("}")), "x string", _STRICT)
    # malformed input leaves the field NULL; so does a JSON null, which is one value
    in_obj = obj["x"].isNotNull() | (F.trim(text) == "null")
    return F.coalesce((F.size(arr) == 1) & in_obj, F.lit(False))


def top_level_kind(text: Column) -> Column:
    """JSON kind of a well-formed value from its first non-blank character."""
    c = F.substring(F.ltrim(text), 1, 1)
    return (F.when(c == "{", "object").when(c == "[", "array").when(c == '"', "string")
            .when(c == "n", "null").when(c.isin("t", "f"), "bool").otherwise("number"))


# schema_of_variant head word -> JSON kind
_KIND_OF = {"VOID": "null", "STRING": "string", "BIGINT": "int", "INT": "int", "SMALLINT": "int",
            "TINYINT": "int", "BOOLEAN": "bool", "ARRAY": "array", "OBJECT": "object"}
# JSON kind -> the word a typed decoder uses for it in an error text
_WORD_OF = {"string": "string", "int": "number", "number": "number", "bool": "bool", "array": "array",
            "object": "object"}


def _lit_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def variant_kind(v: Column) -> Column:
    """JSON kind of a VARIANT field: NULL (absent), null, string, int, number, bool, array, object.

    One lookup of the head word of ``schema_of_variant`` (VOID, STRING,
    BIGINT, ..., ARRAY<..>, OBJECT<..>, DECIMAL(p,s), DOUBLE) in a literal map;
    each input expression appears once, so the generated code stays small.
    """
    head = F.substring_index(F.substring_index(F.schema_of_variant(v), "<", 1), "(", 1)
    return F.coalesce(F.element_at(_lit_map(_KIND_OF), head), F.when(v.isNotNull(), F.lit("number")))


def kind_word(kind: Column) -> Column:
    """The word a typed decoder uses for a JSON kind in its error text."""
    return F.element_at(_lit_map(_WORD_OF), kind)


def field_type_error(v: Column, struct_name: str, field: str, target: str,
                     kind: Column | None = None) -> Column:
    """Decode-error text when a VARIANT field does not fit ``target`` ('int' or 'string'), else NULL.

    null and absent always fit (zero value); an int target accepts integer
    literals only; a string target accepts strings only. ``kind``: the field's
    precomputed ``variant_kind`` (saves recomputing it).
    """
    k = variant_kind(v) if kind is None else kind
    fit = "int" if target == "int" else "string"
    words = {kk: ww for kk, ww in _WORD_OF.items() if kk != fit}
    word = F.element_at(_lit_map(words), k)  # NULL when the kind fits, or for null / absent
    if target == "int":  # a non-integer number names its literal
        word = F.concat(word, F.when(word == "number", F.concat(F.lit(" "), v.cast("string"))).otherwise(F.lit("")))
    # concat is NULL when ``word`` is NULL, i.e. when there is no error
    return F.concat(F.lit("json: cannot unmarshal "), word,
                    F.lit(f" into Go struct field {struct_name}.{field} of type {target}"))


def value_type_error(kind: Column, go_type: str) -> Column:
    """Error text when a whole value is not an object (null is accepted), else NULL."""
    return F.when(~kind.isin("object", "null"),
                  F.concat(F.lit("json: cannot unmarshal "), kind_word(kind),
                           F.lit(f" into Go value of type {go_type}")))


def json_string(c: Column) -> Column:
    """JSON text of a string column (quoted and escaped), ``null`` for NULL."""
    j = F.to_json(F.array(c.cast("string")))
    return j.substr(F.lit(2), F.length(j) - 2)


# Raw control characters never occur in valid JSON text, so they can stand for what a JSON library would re-render.
_PAIR, _QUOTE, _NUMBER, _ESCAPE = "\x01", "\x02", "\x03", "\x04"


def _swap(c: Column, pairs) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def _outside_strings(text: Column, change) -> Column:
    """Apply ``change`` to the parts of valid JSON text (escaped quotes swapped away) that lie outside strings."""
    parts = F.transform(F.split(text, '"', -1), lambda x, i: F.when(i % 2 == 0, change(x)).otherwise(x))
    return F.array_join(parts, '"')


def compact_json(text: Column) -> Column:
    """Valid JSON text without the white space between tokens; every literal, escape and repeated key as written."""
    t = _swap(text, [("\\\\", _PAIR), ('\\"', _QUOTE)])
    t = _outside_strings(t, lambda x: F.regexp_replace(x, "[ \\t\\r\\n]+", ""))
    return _swap(t, [(_QUOTE, '\\"'), (_PAIR, "\\\\")])


#: Letters beyond ASCII that fold to an ASCII letter, as a typed decoder folds member names.
_FOLDS = ("\u017f\u212a", "sk")


def fold_key(key: Column) -> Column:
    """A member name as it is compared: without case."""
    return F.lower(F.translate(key, *_FOLDS))


def members(text: Column) -> Column:
    """Members of a JSON object in document order, repeated ones too: array of (key folded, value VARIANT, kind). NULL if ``text`` is no object.

    The text is decoded inside ``{"x": ...}``, which is one of the two wrappers of ``is_single_json_value``.
    """
    each = F.map_entries(F.from_json(F.concat(F.lit('{"x":'), text, F.lit("}")), "x MAP<STRING, VARIANT>", _STRICT)["x"])
    return F.transform(each, lambda e: F.struct(fold_key(e["key"]).alias("key"), e["value"].alias("value"), variant_kind(e["value"]).alias("kind")))


def is_only_value(text: Column, found: Column) -> Column:
    """``is_single_json_value`` of a text whose ``members`` are known: one parse less for objects."""
    arr = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>", _STRICT)
    return F.when(found.isNotNull(), F.coalesce(F.size(arr) == 1, F.lit(False))).otherwise(is_single_json_value(text))


def member_json(text: Column, key: str, kind: Column) -> Column:
    """Text of a top-level member (the last of that name, in any case) of a valid JSON object, as written but for white space.

    ``kind`` is the member's JSON kind. Escapes and numbers are swapped for control characters before the text is decoded, so that
    the decoder copies them unchanged; what it escapes itself is read back as a JSON string.
    """
    t = _swap(text, [("\\\\", _PAIR), ('\\"', _QUOTE), ("\\", _ESCAPE)])
    t = _outside_strings(t, lambda x: F.regexp_replace(
        F.regexp_replace(x, "[ \\t\\r\\n]+", ""), "(-?[0-9][0-9.eE+-]*)", f'"{_NUMBER}$1{_NUMBER}"'))
    each = F.map_entries(F.from_json(t, "MAP<STRING, STRING>", {**_STRICT, "allowUnquotedControlChars": "true"}))
    raw = F.try_element_at(F.filter(each, lambda e: fold_key(e["key"]) == key), F.lit(-1))["value"]
    back = [(f'"{_NUMBER}', ""), (f'{_NUMBER}"', ""), (_ESCAPE, "\\"), (_QUOTE, '\\"'), (_PAIR, "\\\\")]
    # inside an object control characters, and those beyond 16 bits, come back as escapes, in a lone string as themselves
    inner = F.get(F.from_json(F.concat(F.lit('["'), F.replace(raw, F.lit('"'), F.lit('\\"')), F.lit('"]')), "array<string>", _STRICT), F.lit(0))
    return (F.when(kind.isin("object", "array"), _swap(inner, back))
            .when(kind == "string", F.concat(F.lit('"'), _swap(raw, back), F.lit('"')))
            .otherwise(F.replace(raw, F.lit(_NUMBER), F.lit(""))))
