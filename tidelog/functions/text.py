"""Text, identity and number expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that Python's str.strip() removes.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
#: Fixed value: the UUID name space "URL" of RFC 4122.
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
UUID_TEXT = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def strip(text: Column) -> Column:
    """Without white space at either end, as Unicode and Python understand it."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def exchange_key(exchange: Column) -> Column:
    return F.lower(strip(exchange))


def symbol_key(symbol: Column) -> Column:
    return F.upper(strip(symbol))


def ascii_json(text: Column) -> Column:
    """A JSON string in ASCII, escaped as Python's json.dumps does by default."""

    def unit(code: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(code), 4, "0")))

    def escaped(char: Column) -> Column:
        code = F.ascii(char)
        rest = code - 0x10000
        return (
            F.when(char == '"', '\\"')
            .when(char == "\\", "\\\\")
            .when(char == "\n", "\\n")
            .when(char == "\r", "\\r")
            .when(char == "\t", "\\t")
            .when(char == "\f", "\\f")
            .when(char == "\b", "\\b")
            .when((code >= 32) & (code < 127), char)
            .when(code < 0x10000, unit(code))
            .otherwise(F.concat(unit(F.shiftright(rest, 10) + 0xD800), unit(rest.bitwiseAND(0x3FF) + 0xDC00)))
        )

    plain = text.rlike(r'^[ !#-\[\]-~]*$')
    body = F.when(plain, text).otherwise(F.array_join(F.transform(F.split(text, ""), escaped), ""))
    return F.concat(F.lit('"'), body, F.lit('"'))


def uuid5_hex(name: Column) -> Column:
    """The 32 hex digits of the version 5 UUID of ``name`` in the URL name space."""
    digest = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_URL)), F.encode(name, "utf-8")))
    variant = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3) + 8
    return F.concat(
        F.substring(digest, 1, 12), F.lit("5"), F.substring(digest, 14, 3), F.lower(F.hex(variant)), F.substring(digest, 18, 15)
    )


def trade_identity_hex(exchange: Column, symbol: Column, source_event_id: Column) -> Column:
    """Hex digits of the trade's event identifier; null if any part is null.

    Version 5 UUID over the compact JSON list of a fixed kind, a fixed version and the three
    normalised parts.
    """
    parts = [exchange_key(exchange), symbol_key(symbol), strip(source_event_id)]
    name = F.concat(F.lit('["market.trade.raw","v1",'), *[x for p in parts for x in (ascii_json(p), F.lit(","))][:-1], F.lit("]"))
    return uuid5_hex(name)


def hyphenated(digits: Column) -> Column:
    return F.concat_ws("-", *[F.substring(digits, start, n) for start, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def written_uuid5_hex(text: Column) -> Column:
    """Hex digits of a well written version 5 UUID, else null. Braces, a urn prefix and missing hyphens are let pass."""
    digits = F.regexp_replace(F.lower(strip(text)), r"^urn:uuid:|[{}-]", "")
    return F.when(digits.rlike("^[0-9a-f]{12}5[0-9a-f]{19}$"), digits)


def number(text: Column) -> Column:
    """A decimal notation as double, else null ("1d", "0x1" and words are none)."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(_NUMBER), trimmed.try_cast("double"))


def reading(payload: Column, *names: str) -> list[Column]:
    """Members of a JSON object as numbers, parsed once."""
    parsed = F.from_json(payload, ", ".join(f"{n} string" for n in names))
    return [number(parsed[n]) for n in names]


def instant(text: Column) -> Column:
    """An ISO date-time that carries Z or an offset as timestamp; null for naive or impossible ones."""
    zoned = F.trim(text).rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt][0-9:.]+([Zz]|[+-][0-9]{2}:?[0-9]{2})$")
    return F.when(zoned, F.upper(F.trim(text)).try_cast("timestamp"))
