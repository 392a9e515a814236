"""Reading model replies: JSON text to typed columns.

An absent key and a key with a null value are told apart throughout, so
replies are kept as VARIANT: an absent key is SQL NULL, a null value is not.
"""

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_END = "~end of reply~"
# Strict JSON, of any length.
_STRICT = {"maxStringLen": str(2**31 - 1), "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
# Number text as it is accepted for amounts, with single
# underscores between digits.
_NUMBER = (
    r"^\s*[+-]?(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)"
    r"(?:[eE][+-]?\d+(?:_\d+)*)?\s*$"
)
# What stands for an absent key.
_DEFAULTS = {"merchant": "Unknown", "currency": "USD", "category": "Other"}


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def keep_last_keys(spark: SparkSession) -> None:
    """Where a key is repeated in JSON, its last value counts: a setting of the session.

    Without it such JSON counts as unreadable. The jobs of ``plans`` and ``parse_messages`` call it.
    """
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def strict_json(text: Column) -> Column:
    """VARIANT of a text that is exactly one JSON value, else NULL. Texts may be as long as Spark's own.

    Spark's parser stops after the first value. Wrapping the text in an array
    with a closing marker makes anything after that value visible.
    """
    wrapped = F.from_json(F.concat(F.lit("["), text, F.lit(f',"{_END}"]')), "variant", _STRICT)

    def first_of_two(array):
        ended = F.try_variant_get(array, "$[1]", "string") == _END
        whole = ended & F.variant_get(array, "$[2]", "variant").isNull()
        return F.when(whole, F.variant_get(array, "$[0]", "variant"))

    return _once(wrapped, first_of_two)


def strict_object(text: Column) -> Column:
    """VARIANT of a text that is exactly one JSON object, else NULL."""
    return F.when(text.rlike(r"^\s*\{"), strict_json(text))


def kind(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN or VOID; the name of its type for a number."""
    return F.substring_index(F.schema_of_variant(value), "<", 1)


def reply_object(reply: Column) -> Column:
    """The JSON object in a reply, or NULL.

    That is the span from the first ``{`` to the last ``}``, unless the whole
    reply is JSON of another kind.
    """
    span = strict_json(F.regexp_extract(reply, r"(?s)(\{.*\})", 1))
    open_brace = reply.rlike(r"^\s*\{")
    return F.when(open_brace | strict_json(reply).isNull(), span)


def field(obj: Column, key: str) -> Column:
    """The value under ``key`` as VARIANT; SQL NULL only where the key is absent."""
    return F.variant_get(obj, f"$.{key}", "variant")


def field_text(obj: Column, key: str) -> Column:
    """The value under ``key`` as text; NULL for an absent key and for null.

    Booleans become 1 and 0, nested values their JSON text.
    """
    is_boolean = F.schema_of_variant(field(obj, key)) == "BOOLEAN"
    truth = F.try_variant_get(obj, f"$.{key}", "boolean").cast("int").cast("string")
    return F.when(is_boolean, truth).otherwise(F.try_variant_get(obj, f"$.{key}", "string"))


def field_or_default(obj: Column, key: str) -> Column:
    """Text under ``key``; its default where the key is absent.

    A null value stays NULL.
    """
    default = F.lit(_DEFAULTS[key])
    return F.when(field(obj, key).isNull(), default).otherwise(field_text(obj, key))


def number(value: Column) -> Column:
    """A JSON number, boolean or number text as double; else NULL."""
    of_kind = kind(value)
    text = F.try_variant_get(value, "$", "string")
    plain = F.replace(F.trim(text), F.lit("_"), F.lit(""))
    truth = F.try_variant_get(value, "$", "boolean").cast("int").cast("double")
    return (
        F.when(of_kind == "STRING", F.when(text.rlike(_NUMBER), plain.try_cast("double")))
        .when(of_kind == "BOOLEAN", truth)
        .when(~of_kind.isin("OBJECT", "ARRAY", "VOID"), F.try_variant_get(value, "$", "double"))
    )


def to_cents(amount: Column) -> Column:
    """Whole cents, ties to even; NULL where there is no finite amount."""
    cents = F.rint(amount * 100)
    finite = ~F.isnan(cents) & (F.abs(cents) < F.lit(float(2**63)))
    return F.when(finite, cents).cast("bigint")


def amount_cents(obj: Column) -> Column:
    return to_cents(number(field(obj, "amount")))


def intent_object(reply: Column) -> Column:
    """The JSON value in a reply to a question, code fences removed; NULL if
    it is not a JSON object or has no keys."""
    fence = F.lit("```")
    bare = F.replace(F.replace(reply, F.lit("```json"), F.lit("")), fence, F.lit(""))
    value = strict_object(F.when(F.contains(reply, F.lit("```json")), bare).otherwise(reply))
    return _once(value, lambda v: F.when(F.to_json(v) != "{}", v))


def intent_text(obj: Column, key: str) -> Column:
    """A search parameter as text; NULL for every value that means "no filter"."""

    def text(value):
        shown = F.try_variant_get(value, "$", "string")
        of_kind = kind(value)
        empty = {"STRING": [""], "BOOLEAN": ["false"], "OBJECT": ["{}"], "ARRAY": ["[]"]}
        nothing = F.try_variant_get(value, "$", "double") == 0
        for name, texts in empty.items():
            nothing = F.when(of_kind == name, shown.isin(texts)).otherwise(nothing)
        return F.when(~nothing, shown)

    return _once(field(obj, key), text)
