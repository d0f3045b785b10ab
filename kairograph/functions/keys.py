"""Identity keys and text normalisation as pure columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold(text: Column) -> Column:
    """Case folding: lower case, and the one letter of our languages that folds to two."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize_alias(text: Column) -> Column:
    return collapse(fold(F.regexp_replace(text, r"[^\p{L}\p{N}_\s'\-]", " ")))


def name_key(text: Column) -> Column:
    return collapse(fold(text))


def normalize_label(text: Column) -> Column:
    """Display-name key: without a leading article, punctuation as spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "^the ", ""), "[^a-z0-9]+", " "))


def snake_case(text: Column) -> Column:
    out = F.lower(F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9A-Za-z]+", "_"), F.lit("_")))
    return F.when(out == "", F.lit("unknown")).otherwise(out)


def slug(text: Column) -> Column:
    out = F.btrim(F.regexp_replace(fold(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.substring(F.when(out == "", F.lit("self_model")).otherwise(out), 1, 80)


def stable_uuid(prefix: str, group: Column, value: Column) -> Column:
    digest = F.substring(F.sha1(F.concat(group, F.lit("\0"), value)), 1, 12)
    return F.concat_ws("_", F.lit(prefix), slug(value), digest)


def uuid5_url(text: Column) -> Column:
    """RFC 4122 version 5 identifier in the URL namespace."""
    namespace = F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8"))
    h = F.substring(F.sha1(F.concat(namespace, text.cast("binary"))), 1, 32)
    variant = F.lower(F.conv((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)).cast("string"), 10, 16))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def qualifier_hash(canonical_json: Column) -> Column:
    """Stable hash of sorted-key JSON; empty for no qualifiers."""
    empty = F.coalesce(canonical_json, F.lit("")).isin("", "{}")
    return F.when(empty, F.lit("")).otherwise(F.substring(F.sha2(canonical_json, 256), 1, 16))


def canonical_qualifiers(qualifiers: Column) -> Column:
    """Sorted-key JSON of a map<string,string>."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(qualifiers))))


def fact_key(group: Column, subject: Column, predicate: Column, obj: Column, qhash: Column | None = None) -> Column:
    parts = [F.trim(F.coalesce(p, F.lit(""))) for p in (group, subject, F.lower(predicate), obj)]
    key = F.concat_ws("::", *parts)
    return key if qhash is None else F.when(F.coalesce(qhash, F.lit("")) == "", key).otherwise(F.concat_ws("::", key, qhash))


def slot_key(group: Column, subject: Column, canonical: Column, qhash: Column) -> Column:
    return F.concat_ws("::", *[F.trim(F.coalesce(p, F.lit(""))) for p in (group, subject, F.lower(canonical), qhash)])
