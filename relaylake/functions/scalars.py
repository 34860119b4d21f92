"""Scalar functions on event columns, as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

REPLACEABLE, ADDRESSABLE, EPHEMERAL = (10000, 19999), (30000, 39999), (20000, 29999)
GIFT_WRAP, AUTH_KIND, DELETION, VANISH = 1059, 22242, 5, 62


def hex_encode(binary: Column) -> Column:
    return F.lower(F.hex(binary))


def is_hex(text: Column) -> Column:
    return text.rlike("^([0-9a-f]{2})+$")


def hex_decode(text: Column) -> Column:
    """Bytes of lower-case hex; null for anything else, upper case and the empty text too."""
    return F.when(is_hex(text), F.unhex(text))


def classify_kind(kind: Column) -> Column:
    inside = lambda r: kind.between(*r)
    return (
        F.when(kind == DELETION, "deletion").when(kind == VANISH, "vanish").when(kind.isin(0, 3) | inside(REPLACEABLE), "replaceable")
        .when(inside(EPHEMERAL), "ephemeral").when(inside(ADDRESSABLE), "addressable").otherwise("regular")
    )


def parse_i64(text: Column) -> Column:
    """Optional sign and digits, in range; null otherwise."""
    return F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("bigint"))


def tag_values(tags: Column, name: str) -> Column:
    """Second fields of the tags of that name, in order."""
    hits = F.filter(tags, lambda t: (F.get(t, F.lit(0)) == name) & (F.size(t) >= 2))
    return F.transform(hits, lambda t: F.get(t, F.lit(1)))


def expiry(tags: Column) -> Column:
    """The first expiration that parses; null where there is none, or where it is 0."""
    parsed = F.transform(tag_values(tags, "expiration"), parse_i64)
    return F.nullif(F.get(F.filter(parsed, lambda x: x.isNotNull()), F.lit(0)), F.lit(0).cast("bigint"))


def d_value(kind: Column, tags: Column) -> Column:
    """The address part of an addressable event, "" without a d tag; null for other kinds."""
    return F.when(kind.between(*ADDRESSABLE), F.coalesce(F.get(tag_values(tags, "d"), F.lit(0)), F.lit("")))


def is_protected(tags: Column) -> Column:
    return F.exists(tags, lambda t: F.get(t, F.lit(0)) == "-")


def has_p_tag(tags: Column, pubkeys: list[str]) -> Column:
    if not pubkeys:
        return F.lit(False)
    return F.exists(tags, lambda t: F.coalesce((F.get(t, F.lit(0)) == "p") & F.get(t, F.lit(1)).isin(pubkeys), F.lit(False)))


def json_escape(text: Column, nip01_strict: bool = False) -> Column:
    """Body of a JSON string: two-character escapes for quote, backslash, line feed, return and tab.

    Other control characters become four hex digits; with ``nip01_strict`` backspace
    and form feed get their short escapes.
    """
    out = text
    for raw, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(code))
    short = {8: "\\b", 12: "\\f"} if nip01_strict else {}
    rest = out
    for c in range(32):
        if c not in (9, 10, 13):
            rest = F.replace(rest, F.lit(chr(c)), F.lit(short.get(c, f"\\u{c:04x}")))
    return F.when(out.rlike("[\\x00-\\x1f]"), rest).otherwise(out)


def json_string(text: Column, nip01_strict: bool = False) -> Column:
    return F.concat(F.lit('"'), json_escape(text, nip01_strict), F.lit('"'))


def tags_json(tags: Column, nip01_strict: bool = False) -> Column:
    one = lambda t: F.concat(F.lit("["), F.array_join(F.transform(t, lambda s: json_string(s, nip01_strict)), ","), F.lit("]"))
    return F.concat(F.lit("["), F.array_join(F.transform(tags, one), ","), F.lit("]"))


def canonical_json(pubkey: Column, created_at: Column, kind: Column, tags: Column, content: Column, nip01_strict: bool = False) -> Column:
    return F.concat(
        F.lit('[0,"'), pubkey, F.lit('",'), created_at.cast("string"), F.lit(","), kind.cast("string"), F.lit(","), tags_json(tags, nip01_strict), F.lit(","), json_string(content, nip01_strict), F.lit("]")
    )


def event_id(pubkey: Column, created_at: Column, kind: Column, tags: Column, content: Column) -> Column:
    return F.sha2(canonical_json(pubkey, created_at, kind, tags, content), 256)


def event_json() -> Column:
    """The event object with its keys in wire order."""
    c = F.col
    return F.concat(
        F.lit('{"id":"'), c("id"), F.lit('","pubkey":"'), c("pubkey"), F.lit('","created_at":'), c("created_at").cast("string"), F.lit(',"kind":'), c("kind").cast("string"),
        F.lit(',"tags":'), tags_json(c("tags")), F.lit(',"content":'), json_string(c("content")), F.lit(',"sig":"'), c("sig"), F.lit('"}'),
    )


def event_frame(sub_id: Column) -> Column:
    return F.concat(F.lit('["EVENT",'), json_string(sub_id), F.lit(","), event_json(), F.lit("]"))


def coordinate(value: Column) -> Column:
    """(kind, pubkey, d) of "kind:pubkey:d", null unless the kind is addressable and the key is lower-case hex."""
    parts = F.split(value, ":", 3)
    number = F.regexp_extract(F.get(parts, F.lit(0)), "^\\+?([0-9]+)$", 1).try_cast("int")
    good = (F.size(parts) == 3) & number.between(*ADDRESSABLE) & F.get(parts, F.lit(1)).rlike("^[0-9a-f]{64}$")
    return F.when(good, F.struct(number.alias("kind"), F.get(parts, F.lit(1)).alias("pubkey"), F.get(parts, F.lit(2)).alias("d")))


def url_domain(url: Column) -> Column:
    """Host with its port: what stands between "://", if any, and the next slash."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(url)
    return F.substring_index(rest, "/", 1)


def content_limit(kind: Column, default: int, by_kind: Mapping[int, int]) -> Column:
    out = F.lit(default)
    for k, limit in by_kind.items():
        out = F.when(kind == k, limit).otherwise(out)
    return out


def with_derived(events):
    """Add kind_class, d_value, expiry and is_protected."""
    kind, tags = F.col("kind"), F.col("tags")
    return events.withColumns({"kind_class": classify_kind(kind), "d_value": d_value(kind, tags), "expiry": expiry(tags), "is_protected": is_protected(tags)})
