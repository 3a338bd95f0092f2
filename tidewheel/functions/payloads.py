"""Message payloads, ids and replies as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewheel.schemas import CLIENT_ID, REPLY_ERROR

# What an integer parser skips before the number, and the number.
_BLANKS = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]*"
_DECIMAL = rf"^{_BLANKS}([+-]?[0-9]+)"
_HEXADECIMAL = rf"^{_BLANKS}([+-]?)0[xX]([0-9a-fA-F]+)"


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# A quoted text, and a JSON object without nested ones once texts are empty.
_QUOTED = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_FLAT_OBJECT = r"^\s*\{[^{}]*\}\s*$"
# What a decimal number parser takes: digits, a fraction, an exponent, or the names of
# values that are no finite numbers; no type letters.
_NUMBER = (
    r"(?i)^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?\s*$"
    r"|^\s*[+-]?(?:inf|infinity|nan)\s*$"
)
_QUOTED_BOOLEAN = r':\s*"(?:true|false)"\s*[,}]'
# What nearly all messages look like: an object without a brace inside, even in texts, and
# values that only have characters of plain numbers, joined.
_PLAIN_OBJECT = r"^\s*+\{[^{}]*+\}\s*$"
_PLAIN_NUMBERS = r"^[0-9.+\-eE,]*+$"


def feature_map(value: str | Column) -> Column:
    """A flat JSON object as a map of texts, in the object's own order."""
    text = _column(value).cast("string")
    bare = F.regexp_replace(text, _QUOTED, '""')
    flat = F.when(text.rlike(_PLAIN_OBJECT), True).otherwise(bare.rlike(_FLAT_OBJECT))
    return F.when(flat, F.from_json(text, "map<string,string>"))


def numbers(texts: str | Column, value: str | Column) -> Column:
    """Values of a JSON object, taken as texts from ``value``, as doubles. JSON true and
    false are 1 and 0; the texts "true" and "false", like all that is no number, are
    NULL."""
    told = _column(value).cast("string").rlike(_QUOTED_BOOLEAN)

    def number(v: Column) -> Column:
        return (
            F.when(v.rlike(_NUMBER), F.trim(v).try_cast("double"))
            .when(~told & (v == "true"), F.lit(1.0))
            .when(~told & (v == "false"), F.lit(0.0))
        )

    def plain(v: Column) -> Column:
        return v.try_cast("double")

    # A one-element transform binds the texts, which are then worked out once a message.
    def each(own: Column) -> Column:
        simple = F.array_join(own, ",").rlike(_PLAIN_NUMBERS)
        return F.when(simple, F.transform(own, plain)).otherwise(F.transform(own, number))

    return F.get(F.transform(F.array(_column(texts)), each), F.lit(0))


def json_features(value: str | Column) -> Column:
    """Values of a JSON object as doubles; one that is no number becomes NULL."""
    return numbers(F.map_values(feature_map(value)), value)


def feature_error(names: str | Column, features: str | Column, n_features: int) -> Column:
    """Why a message's features cannot be scored; NULL if they can."""
    keys, x = _column(names), _column(features)
    return (
        F.when(keys.isNull(), F.lit("bad_value"))
        .when(F.size(keys) != n_features, F.lit("feature_count"))
        .when(F.size(F.array_distinct(keys)) != n_features, F.lit("repeated_key"))
        .when(F.exists(x, lambda v: v.isNull()), F.lit("bad_feature"))
    )


def parsed_json(value: str | Column) -> Column:
    """The text as a variant, NULL unless all of it is one JSON value.

    The JSON parser stops after the first value of a text. Parsing the text as an
    array's first element, closed by the text's own hash, rules out a remainder.
    """
    text = _column(value).cast("string")
    closed = F.try_parse_json(
        F.concat(F.lit("["), text, F.lit(","), F.xxhash64(text), F.lit("]"))
    )
    whole = F.try_variant_get(closed, "$[1]", "bigint") == F.xxhash64(text)
    return F.when(whole, F.try_variant_get(closed, "$[0]", "variant"))


def json_or_raw(value: str | Column) -> Column:
    """Canonical JSON text, or the text itself if it is not JSON; "" if absent."""
    return F.coalesce(
        F.to_json(parsed_json(value)), _column(value).cast("string"), F.lit("")
    )


def json_boolean(value: str | Column) -> Column:
    """TRUE or FALSE for a JSON boolean, else NULL."""
    parsed = parsed_json(value)
    return F.when(
        F.schema_of_variant(parsed) == "BOOLEAN",
        F.try_variant_get(parsed, "$", "boolean"),
    )


def correlation_id(
    millis: str | Column, *key: str | Column, client: str = CLIENT_ID
) -> Column:
    """Id ``client-<ms>-<hex>``. The hex digits are a hash of the row's key, not a
    random number, so a task that runs again gives its rows the same ids."""
    digits = F.md5(F.concat_ws("|", *[_column(k).cast("string") for k in key]))
    return F.concat_ws("-", F.lit(client), _column(millis).cast("string"), digits)


def parse_int_prefix(text: str | Column) -> Column:
    """Integer at the start of a text, decimal or 0x-prefixed; 0 if there is none. One
    beyond a bigint is the bigint nearest to it."""
    t = _column(text)
    hex_digits = F.regexp_extract(t, _HEXADECIMAL, 2)
    negative = F.regexp_extract(t, _HEXADECIMAL, 1) == "-"
    sign = F.when(negative, -1).otherwise(1)
    long_hex = F.length(F.ltrim(hex_digits, F.lit("0"))) > 15
    from_hex = F.when(long_hex, _limit(negative)).otherwise(
        F.conv(F.right(hex_digits, F.lit(15)), 16, 10).try_cast("bigint") * sign
    )
    digits = F.regexp_extract(t, _DECIMAL, 1)
    from_decimal = F.when(
        digits != "", F.coalesce(digits.try_cast("bigint"), _limit(digits.startswith("-")))
    )
    maybe_hex = F.contains(t, F.lit("0x")) | F.contains(t, F.lit("0X"))
    return F.coalesce(
        F.when(maybe_hex & (hex_digits != ""), from_hex).otherwise(from_decimal),
        F.lit(0).cast("bigint"),
    )


def _limit(negative: Column) -> Column:
    return F.when(negative, F.lit(-(2**63))).otherwise(F.lit(2**63 - 1))


def json_payload(fields: Sequence[str]) -> Column:
    """A record as a JSON object of texts, in field order."""
    return F.to_json(F.struct(*[F.col(f).cast("string").alias(f) for f in fields]))


def reply_envelope(ok: str | Column, result: str | Column) -> Column:
    """``{"ok":true,"result":...}`` or ``{"ok":false,"error":...}``.

    ``result`` is a boolean, a variant, or raw text, which becomes a JSON string.
    """
    return F.when(
        _column(ok),
        F.to_json(
            F.struct(F.lit(True).alias("ok"), _column(result).alias("result")),
            {"ignoreNullFields": "false"},
        ),
    ).otherwise(
        F.to_json(F.struct(F.lit(False).alias("ok"), F.lit(REPLY_ERROR).alias("error")))
    )
