"""Value sets as sorted arrays of hashes: building, set algebra and overlap measures.

A null set gives null. JSON that cannot be read gives an empty set, so one bad row fails no job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from valprint.functions.hashing import MASK, normalized_all, value_hash, value_hash_normalized


def build(value: Column | str, normalize: bool = False) -> Column:
    """Aggregate: the set of the group's values, null skipped; of nothing an empty set."""
    return F.array_sort(F.collect_set(value_hash_normalized(value) if normalize else value_hash(value)))


def _strings(json: Column) -> Column:
    """The string elements of a JSON array; other elements are left out."""
    items = F.try_variant_get(F.try_parse_json(json), "$", "array<variant>")
    return F.transform(F.filter(items, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: x.cast("string"))


def from_json_array(json: Column | str, normalize: bool = False) -> Column:
    """The set of the strings in a JSON array."""
    json = F.col(json) if isinstance(json, str) else json
    strings = _strings(json)
    hashes = F.transform(normalized_all(strings) if normalize else strings, value_hash)
    empty = F.array().cast("array<bigint>")
    return F.when(json.isNotNull(), F.coalesce(F.array_sort(F.array_distinct(hashes)), empty))


def from_array(hashes: Column | str) -> Column:
    """A set of ready hashes; nulls are left out and numbers cut to 32 bits."""
    hashes = F.col(hashes) if isinstance(hashes, str) else hashes
    return F.array_sort(F.array_distinct(F.transform(F.filter(hashes, lambda x: x.isNotNull()), lambda x: x.cast("long").bitwiseAND(F.lit(MASK)))))


def to_array(s: Column) -> Column:
    return s


def cardinality(s: Column) -> Column:
    return F.size(s).cast("long")


def intersect(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def difference(a: Column, b: Column) -> Column:
    """What of a is not in b: the residue."""
    return F.array_sort(F.array_except(a, b))


def intersection_cardinality(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)).cast("long")


def containment(probe: Column, reference: Column) -> Column:
    """The part of the probe that the reference holds; 0 for an empty probe."""
    return F.when(F.size(probe) == 0, 0.0).otherwise(F.size(F.array_intersect(probe, reference)) / F.size(probe))


def jaccard(a: Column, b: Column) -> Column:
    """Common part of the union; 1 for two empty sets."""
    common = F.size(F.array_intersect(a, b))
    whole = F.size(a) + F.size(b) - common
    return F.when(whole == 0, 1.0).otherwise(common / whole)


def contains(s: Column, h: Column) -> Column:
    """Whether a hash is in a set; false if either is null."""
    return F.coalesce(F.array_contains(s, h), F.lit(False))


def containment_json(json: Column, reference: Column, normalize: bool = False) -> Column:
    """containment() of a JSON array, or of one plain value if the text does not begin with a bracket."""
    one = F.array(value_hash_normalized(json) if normalize else value_hash(json))
    return containment(F.when(F.substring(json, 1, 1) == "[", from_json_array(json, normalize)).otherwise(one), reference)


def probe_all(probe: Column, references: Column) -> Column:
    """Array of idx, containment and jaccard of a set against each reference set; null ones keep their place unseen."""
    each = F.transform(references, lambda r, i: F.struct(i.alias("idx"), containment(probe, r).alias("containment"), jaccard(probe, r).alias("jaccard"), r.isNull().alias("skip")))
    return F.transform(F.filter(each, lambda x: ~x["skip"]), lambda x: F.struct(x["idx"].alias("idx"), x["containment"].alias("containment"), x["jaccard"].alias("jaccard")))



def merge(s: Column | str) -> Column:
    """Aggregate: the union of the group's sets."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(s))))
