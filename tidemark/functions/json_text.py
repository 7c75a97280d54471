"""Checks of JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# JSON as the standard has it. A repeated key is allowed there; the last one counts.
STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
SEAL = "end of text"


def _sealed(text: Column, seal: Column) -> Column:
    """The text as the first element of an array whose last is a seal made from the text.

    Parsers read the first value of a text and leave the rest. Text that closes the array early or holds several
    values does not leave the seal as the second element.
    """
    return F.concat(F.lit("["), text, F.lit(","), seal, F.lit("]"))


def _mark(text: Column) -> Column:
    return F.xxhash64(text).cast("string")


def is_one_value(text: Column) -> Column:
    """Whether a text is exactly one JSON value."""
    seal = F.concat(F.lit('"'), _mark(text), F.lit('"'))
    read = F.from_json(_sealed(text, seal), "array<string>", STRICT)
    # A one-element array binds what was read, so that it is read once.
    whole = F.transform(F.array(read), lambda r: (F.size(r) == 2) & F.get(r, F.lit(1)).eqNullSafe(_mark(text)))
    return F.coalesce(F.get(whole, F.lit(0)), F.lit(False))


def ends_there(text: Column) -> Column:
    """Whether nothing comes after the first JSON value of a text, which is passed over, not made."""
    sealed = _sealed(text, F.concat(F.lit('"'), _mark(text), F.lit('"')))
    return F.coalesce(F.get_json_object(sealed, "$[1]") == _mark(text), F.lit(False))


def one_object(text: Column, fields: str) -> Column:
    """The fields (a struct type) of a text that is exactly one JSON object, else null; parsed once."""
    inner = fields.strip().removeprefix("struct<").removesuffix(">")
    seal = F.concat(F.lit(f'{{"{SEAL}":"'), _mark(text), F.lit('"}'))
    read = F.from_json(_sealed(text, seal), f"array<struct<{inner}, `{SEAL}`: string>>", STRICT)

    def value(r: Column) -> Column:
        sealed = F.get(r, F.lit(1)).getField(SEAL).eqNullSafe(_mark(text))
        return F.when((F.size(r) == 2) & sealed, F.get(r, F.lit(0)))

    return F.get(F.transform(F.array(read), value), F.lit(0))


def one_variant(text: Column) -> Column:
    """A text that is exactly one JSON value as a variant, else null; parsed once.

    Repeated keys need ``spark.sql.variant.allowDuplicateKeys``, else such a text gives null too.
    """
    seal = F.concat(F.lit('"'), _mark(text), F.lit('"'))
    read = F.try_parse_json(_sealed(text, seal))

    def value(v: Column) -> Column:
        sealed = F.try_variant_get(v, "$[1]", "string").eqNullSafe(_mark(text))
        return F.when(sealed & F.try_variant_get(v, "$[2]", "variant").isNull(), F.try_variant_get(v, "$[0]", "variant"))

    return F.get(F.transform(F.array(read), value), F.lit(0))


def may_go_on(text: Column) -> Column:
    """Whether text may come after the first JSON object of a text; false for flat objects, whose end is plain."""
    closing = F.length(text) - F.length(F.replace(text, F.lit("}")))
    return ~(F.rtrim(text).endswith("}") & (closing == 1))
