"""Canonical style and component labels, scopes, identifiers, content hashes."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def lookup(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def token(c: Column) -> Column:
    """Trimmed, in lower case, with one space for any run of spaces, hyphens and underscores."""
    return F.trim(F.regexp_replace(F.lower(c), r"[\s_-]+", " "))


def canonical_labels(labels: Column, aliases: dict[str, str], regular: str = "regular") -> Column:
    """Aliases replaced, first of equals kept, the regular label only if alone."""
    known = F.array_distinct(F.transform(labels, lambda x: F.coalesce(lookup(aliases)[token(x)], token(x))))
    return F.when(F.size(known) > 1, F.array_remove(known, regular)).otherwise(known)


def scopes(labels: Column, parts: Column) -> Column:
    """label -> 'part' for labels in parts, else 'whole'."""
    return F.map_from_entries(F.transform(labels, lambda x: F.struct(x, F.when(F.array_contains(parts, x), "part").otherwise("whole"))))


def missing_labels(required: Column, states: Column) -> Column:
    """Required labels without a state, or of state 'unknown'."""
    return F.filter(required, lambda x: F.coalesce(states[x], F.lit("unknown")) == "unknown")


def is_complete(required: Column, states: Column, review: Column) -> Column:
    return (F.size(missing_labels(required, states)) == 0) & review.isin("reviewed", "reviewed_regular")


def is_sha256(c: Column) -> Column:
    return c.rlike("^[0-9a-f]{64}$")


def content_id(fields: dict[str, Column]) -> Column:
    """SHA-256 of the fields as compact JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])), 256)


def canonical_json(value: object) -> bytes:
    """Compact JSON with sorted keys, for ids that must not depend on an engine's number format."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


def canonical_id(value: object) -> str:
    return hashlib.sha256(canonical_json(value)).hexdigest()


def uuid5(namespace: uuid.UUID, name: Column) -> Column:
    """Name-based UUID of version 5, by SHA-1."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12))


#: Names of ligatures in old files that are not the present name in lower case.
OLD_LIGATURES = {"long_s_t": "LONG_ST", "LONG_S_T": "LONG_ST"}
#: The present names that old files hold in lower case.
LIGATURES = ("FI", "FL", "FF", "FFI", "FFL", "CT", "ST", "LONG_S_S", "LONG_S_I", "SP", "QU")


def ligature_kind(raw: Column) -> Column:
    """The present name of a kind of ligature; others stay as they are."""
    return F.coalesce(lookup(OLD_LIGATURES | {x.lower(): x for x in LIGATURES})[raw], raw)


def letter_spaced(graphemes: Column, start: Column, end: Column) -> Column:
    """graphemes[start:end] without its spaces if visible graphemes and single spaces take turns in it, three or more in
    all, beginning and ending with a visible one; else null."""
    region = F.slice(graphemes, start + 1, F.greatest(end - start, F.lit(0)))
    turns = F.aggregate(F.transform(region, lambda x, i: (i % 2 == 1) == (x == " ")), F.lit(True), lambda a, x: a & x)
    inside = (start >= 0) & (start < end) & (end <= F.size(graphemes))
    return F.when(inside & (F.size(region) >= 3) & (F.size(region) % 2 == 1) & turns, F.array_remove(region, " "))


def small_caps_ranges(spans: Column, length: Column) -> Column:
    """(start, end) of the spans (label, state, start, end) that are known small capitals, inside the text."""
    known = F.filter(spans, lambda x: (x["label"] == "small_caps") & (x["state"] == "positive") & (x["end"] <= length))
    return F.transform(known, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
