"""Column functions: canonical values, identifiers, derived features, text forms.  All null- and zero-safe."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Col = Column | str


def c(x: Col) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x: Col) -> Column:
    """A double; unparsable text, NaN and infinities become null."""
    v = c(x).try_cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)


def half_even(x: Col, decimals: int) -> Column:
    scale = 10.0**decimals
    return F.rint(c(x) * scale) / scale + 0.0  # no negative zero


def on_grid(x: Col, step: float, tolerance: float = 1e-8) -> Column:
    q = c(x) / step
    return F.abs(q - F.rint(q)) <= tolerance


def sample_id(split: Col, shard: Col, row: Col) -> Column:
    return F.format_string("%s/%s/%04d", c(split), c(shard), c(row).cast("long"))


def image_identity(modality: str, digest: Col) -> Column:
    return F.concat(F.lit(modality + ":"), F.coalesce(c(digest), F.lit("")))


def image_ref(split: Col, shard: Col, row: Col, modality: str, path: Col) -> Column:
    return F.concat(sample_id(split, shard, row), F.lit(f"#{modality}:"), F.coalesce(c(path), F.lit("embedded")))


def difference(a: Col, b: Col) -> Column:
    return c(a) - c(b)


def ratio(a: Col, b: Col) -> Column:
    return F.try_divide(c(a), c(b))


def out_of_bounds(x: Col, low: float, high: float) -> Column:
    """Null is not out of bounds."""
    return F.coalesce(~c(x).between(low, high), F.lit(False))


def pair_key(a: Col, b: Col) -> Column:
    """``a|b``; null if either is null."""
    return F.concat(c(a).cast("string"), F.lit("|"), c(b).cast("string"))


def unordered_key(a: Col, b: Col) -> Column:
    return pair_key(F.least(c(a), c(b)), F.greatest(c(a), c(b)))


def pair_id(a: Col, b: Col) -> Column:
    """An id that does not depend on the order of the two; null for a sample with itself."""
    return F.when(c(a) != c(b), F.concat(F.lit("cf_"), F.substring(F.sha2(unordered_key(a, b), 256), 1, 24)))


def stable_id(prefix: str, fields: dict[str, Col]) -> Column:
    """A hash of the compact JSON of ``fields`` in the order of their names; null fields are left out."""
    payload = F.to_json(F.struct(*(c(v).alias(k) for k, v in sorted(fields.items()))))
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(payload, 256), 1, 16))


def bits_of_hex(h: Col) -> Column:
    """A bigint from up to 16 hex digits; anything else is null."""
    return F.when(c(h).rlike("^[0-9A-Fa-f]{1,16}$"), F.conv(c(h), 16, -10).cast("bigint"))


def hamming_hex(a: Col, b: Col) -> Column:
    """Differing bits of two hex fingerprints; 64 where either cannot be read."""
    return F.coalesce(F.bit_count(bits_of_hex(a).bitwiseXOR(bits_of_hex(b))), F.lit(64)).cast("int")


def ease_bin(x: Col) -> Column:
    """The bins below -2, below 2, below 15 and above."""
    return F.when(c(x).isNull(), None).when(c(x) < -2, "tight").when(c(x) < 2, "close").when(c(x) < 15, "regular").otherwise("loose")


def flags(rules: Sequence[tuple[str, Column]]) -> Column:
    """Names of the rules that hold, in their order, as array<string>."""
    return F.filter(F.array(*(F.when(F.coalesce(cond, F.lit(False)), name) for name, cond in rules)), lambda x: x.isNotNull())


def with_flag(existing: Col, flag: str, cond: Column) -> Column:
    """``existing`` with ``flag`` appended, if ``cond`` holds and it is not there yet."""
    have = F.coalesce(c(existing), F.array().cast("array<string>"))
    return F.when(F.coalesce(cond, F.lit(False)), F.array_union(have, F.array(F.lit(flag)))).otherwise(have)


def serialize(fields: dict[str, Col]) -> Column:
    """``KEY=value`` words with six decimals, ``NA`` for null."""
    return F.concat_ws(" ", *(F.concat(F.lit(k + "="), F.when(c(v).isNotNull(), F.format_string("%.6f", c(v).cast("double"))).otherwise("NA")) for k, v in fields.items()))


def parse_pairs(text: Col) -> Column:
    """map<string,string> of ``KEY=value`` words; of equal keys the last counts."""
    words = F.regexp_extract_all(c(text), F.lit(r"([A-Z_]+=[^\s]+)"), F.lit(1))
    placed = F.transform(words, lambda w, i: F.struct(F.substring_index(w, "=", 1).alias("k"), F.regexp_replace(w, "^[A-Z_]+=", "").alias("v"), i.alias("i")))
    last = F.filter(placed, lambda e: ~F.exists(placed, lambda o: (o["k"] == e["k"]) & (o["i"] > e["i"])))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["k"], e["v"])))


def json_object(text: Col) -> Column:
    """From the first ``{`` to the last ``}`` of a free text, null unless that is JSON."""
    found = F.regexp_extract(c(text), r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(found).isNotNull() & (found != ""), found)


def null_nan(x: Col) -> Column:
    return F.when(F.isnan(c(x)), None).otherwise(c(x))


def realized_delta(before: Col, after: Col, key: str) -> Column:
    """after[key] - before[key] of two map columns; null if either is missing."""
    return F.try_element_at(c(after), F.lit(key)) - F.try_element_at(c(before), F.lit(key))


def utility(target_error: Col, side_effect: Col, edit: Col, side_weight: float = 0.5, edit_weight: float = 0.05) -> Column:
    """Linear utility: no error, side effect or edit is best; null where the outcome is."""
    return -(F.abs(c(target_error)) + side_weight * F.abs(c(side_effect)) + edit_weight * F.abs(c(edit)))
