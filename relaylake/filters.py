"""The filter language: parsing, validation and compilation to a Catalyst predicate."""

from __future__ import annotations

import json
import re
from collections.abc import Collection, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions.scalars import GIFT_WRAP, has_p_tag

_HEX = re.compile(r"[0-9a-f]*")


class Invalid(ValueError):
    """A request that breaks the grammar; its text is the notice to send."""


def _whole(value) -> bool:
    return isinstance(value, int) and not isinstance(value, bool)


def hex_prefix(value: str, name: str) -> str:
    """Check a prefix: lower-case hex of even length, 2 to 64 characters."""
    if not value:
        raise Invalid(f"invalid: {name} empty string")
    if len(value.encode()) > 64:
        raise Invalid(f"invalid: {name} too long")
    if len(value.encode()) % 2:
        raise Invalid(f"invalid: {name} odd-length hex prefix")
    if not _HEX.fullmatch(value):
        raise Invalid(f"invalid: {name} not lowercase hex")
    return value


@dataclass(frozen=True)
class Filter:
    """A conjunction. None means no constraint, an empty list matches nothing."""

    ids: Sequence[str] | None = None
    authors: Sequence[str] | None = None
    kinds: Sequence[int] | None = None
    since: int | None = None
    until: int | None = None
    limit: int | None = None
    tags: Mapping[str, Sequence[str]] = field(default_factory=dict)

    @classmethod
    def parse(cls, value, max_values: int = 256) -> Filter:
        """From a JSON object (or its text); unknown keys are ignored."""
        if isinstance(value, str):
            try:
                value = json.loads(value)
            except ValueError:
                raise Invalid("invalid: not valid JSON") from None
        if not isinstance(value, dict):
            raise Invalid("invalid: filter not an object")
        made, tags = {}, {}
        for key, given in value.items():
            if key in ("ids", "authors", "kinds") or (key[:1] == "#" and len(key) == 2 and key[1].isascii()):
                name = key if key[0] != "#" else "tag filter"
                if not isinstance(given, list):
                    raise Invalid(f"invalid: {name} not an array")
                if len(given) > max_values:
                    raise Invalid(f"invalid: too many values in {key}")
            if key in ("ids", "authors"):
                noun = "id" if key == "ids" else "pubkey"
                if not all(isinstance(x, str) for x in given):
                    raise Invalid(f"invalid: {noun} in {key} not a string")
                made[key] = [hex_prefix(x, f"{key} entry") for x in given]
            elif key == "kinds":
                if not all(_whole(x) and x >= 0 for x in given):
                    raise Invalid("invalid: kind not a non-negative integer")
                if any(x > 65535 for x in given):
                    raise Invalid("invalid: kind out of range for u16")
                made[key] = given
            elif key in ("since", "until"):
                if not _whole(given) or not -(2**63) <= given < 2**63:
                    raise Invalid(f"invalid: {key} not an integer")
                made[key] = given
            elif key == "limit":
                if not _whole(given) or given < 0:
                    raise Invalid("invalid: limit not a non-negative integer")
                made[key] = given
            elif key[:1] == "#" and len(key) == 2 and key[1].isascii():
                if not all(isinstance(x, str) for x in given):
                    raise Invalid("invalid: tag filter value not a string")
                tags[key[1]] = given
        return cls(**made, tags=tags)

    def clamped(self, most: int) -> int:
        return most if self.limit is None else min(self.limit, most)

    def predicate(self) -> Column:
        """The conjunction over columns id, pubkey, kind, created_at and tags; constant parts fold away."""
        parts: list[Column] = []
        if self.since is not None:
            parts.append(F.col("created_at") >= self.since)
        if self.until is not None:
            parts.append(F.col("created_at") <= self.until)
        if self.kinds is not None:
            parts.append(F.col("kind").isin(sorted(set(self.kinds))) if self.kinds else F.lit(False))
        for name, given in (("pubkey", self.authors), ("id", self.ids)):
            if given is not None:
                parts.append(_prefixes(F.col(name), given))
        parts += [_tag(name, values) for name, values in self.tags.items()]
        return reduce(lambda a, b: a & b, parts, F.lit(True))

    @property
    def may_hold_gift_wraps(self) -> bool:
        return self.kinds is None or GIFT_WRAP in self.kinds


def _prefixes(column: Column, given: Sequence[str]) -> Column:
    full = sorted({x for x in given if len(x) == 64})
    parts = [column.isin(full)] if full else []
    parts += [column.startswith(x) for x in sorted({x for x in given if len(x) < 64})]
    return reduce(lambda a, b: a | b, parts, F.lit(False)) if parts else F.lit(False)


def _tag(name: str, values: Sequence[str]) -> Column:
    if not values:
        return F.lit(False)
    wanted = sorted(set(values))
    return F.exists("tags", lambda t: F.coalesce((F.get(t, F.lit(0)) == name) & F.get(t, F.lit(1)).isin(wanted), F.lit(False)))


def any_of(filters: Sequence[Filter]) -> Column:
    return reduce(lambda a, b: a | b, [f.predicate() for f in filters], F.lit(False))


def gift_wrap_visible(auth_pubkeys: Sequence[str]) -> Column:
    """Kind 1059 shows to the authenticated keys that a p tag names."""
    return (F.col("kind") != GIFT_WRAP) | has_p_tag(F.col("tags"), list(auth_pubkeys))


#: Kinds of keys by which events meet filters, most selective first.
ID, AUTHOR, TAG, KIND, ANY = "i", "a", "t", "k", "*"


def probe_keys(f: Filter) -> list[str]:
    """Keys of a filter, one of which every event that it takes has."""
    if f.ids is not None and all(len(x) == 64 for x in f.ids):
        return [ID + x for x in f.ids]
    if f.authors is not None and all(len(x) == 64 for x in f.authors):
        return [AUTHOR + x for x in f.authors]
    if f.tags:
        name, values = min(f.tags.items(), key=lambda x: len(x[1]))
        return [f"{TAG}{name}{x}" for x in values]
    if f.kinds is not None:
        return [f"{KIND}{x}" for x in f.kinds]
    return [ANY]


def event_keys(used: Collection[str] = (ID, AUTHOR, TAG, KIND, ANY)) -> Column:
    """The keys of an event of the kinds ``used``, over columns id, pubkey, kind and, for tags, tags."""
    own = {ID: F.concat(F.lit(ID), "id"), AUTHOR: F.concat(F.lit(AUTHOR), "pubkey"), KIND: F.concat(F.lit(KIND), F.col("kind").cast("string")), ANY: F.lit(ANY)}
    single = F.array(*[key for kind, key in own.items() if kind in used]).cast("array<string>")
    if TAG not in used:
        return single
    name, value = (lambda t, k=k: F.get(t, F.lit(k)) for k in (0, 1))
    tags = F.transform(F.filter("tags", lambda t: (F.octet_length(name(t)) == 1) & value(t).isNotNull()), lambda t: F.concat(F.lit(TAG), name(t), value(t)))
    return F.array_union(single, F.coalesce(tags, F.array().cast("array<string>")))


FILTER_ROW = "sub_id string, n int, ids array<string>, authors array<string>, kinds array<int>, since bigint, until bigint, tags array<struct<name: string, values: array<string>>>, auth array<string>"


def filter_row(name: str, f: Filter, n: int, auth_pubkeys: Sequence[str] = ()) -> tuple:
    sets = lambda x: None if x is None else sorted(set(x))
    return (name, n, sets(f.ids), sets(f.authors), sets(f.kinds), f.since, f.until, [(k, sets(v)) for k, v in f.tags.items()], list(auth_pubkeys))


def meets(of: str, tagged: bool = True) -> Column:
    """Whether an event meets the filter in the struct column ``of``, of FILTER_ROW; for any number of filters it is one expression.

    Where no filter has tags or authenticated keys, not ``tagged``, an event's tags are not read.
    """
    c = lambda name: F.col(f"{of}.{name}")
    prefix = lambda name, column: c(name).isNull() | F.exists(c(name), lambda x: F.startswith(F.col(column), x))
    has = lambda want, values: F.exists("tags", lambda t: F.coalesce((F.get(t, F.lit(0)) == want) & F.array_contains(values, F.get(t, F.lit(1))), F.lit(False)))
    parts = [
        c("since").isNull() | (F.col("created_at") >= c("since")),
        c("until").isNull() | (F.col("created_at") <= c("until")),
        c("kinds").isNull() | F.array_contains(c("kinds"), F.col("kind")),
        prefix("authors", "pubkey"),
        prefix("ids", "id"),
        *([F.forall(c("tags"), lambda t: has(t["name"], t["values"]))] if tagged else []),
        (F.col("kind") != GIFT_WRAP) | has(F.lit("p"), c("auth")) if tagged else F.col("kind") != GIFT_WRAP,
    ]
    return F.coalesce(reduce(lambda a, b: a & b, parts), F.lit(False))
