"""Duplicate and leakage annotation by key, split overlap, set operations, manifest validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import with_flag
from tessera.functions.scratch import cut, release


def annotate(df: DataFrame, keys: dict[str, str | list[str]], split: str | Column = "split", leaks: list[str] | None = None, train: str = "train", held: str = "eval", flags: list[str] | None = None) -> DataFrame:
    """Adds duplicate_<name> and leakage_<name> for each ``keys`` entry name -> key column, or columns of a joint key.

    A key with a null part is neither.  ``leaks`` names the entries that get a leakage column (default: all); ``flags``
    names the columns that are wanted (default: all), and entries without one are not counted.

    The rows are written once.  Each entry's keys are counted by a map-side aggregation; most keys are in one state
    (single, repeated, or in both splits), and only the others are joined back, so keys that are nearly all single or
    nearly all in both splits shuffle no rows.  Rows are written again between two joins, which leaves one shuffle of
    them on disk at a time; the last entry to be joined is the first of ``keys``.
    """
    split = F.col(split) if isinstance(split, str) else split
    parts = {name: [key] if isinstance(key, str) else key for name, key in keys.items()}
    columns = {name: [f"duplicate_{name}", *([f"leakage_{name}"] if leaks is None or name in leaks else [])] for name in parts}
    columns = {name: kept for name, found in columns.items() if (kept := [c for c in found if flags is None or c in flags])}
    added = [c for found in columns.values() for c in found]
    if not added:
        return df
    known = lambda cols: reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in cols))
    rows = cut(df)
    others, usual = {}, {}
    for name in columns:
        keyed = rows.filter(known(parts[name])).groupBy(*parts[name]).agg((F.count(F.lit(1)) > 1).alias("_dup"), F.coalesce(F.max(split == train) & F.max(split == held), F.lit(False)).alias("_leak"))
        keyed = cut(keyed)
        states = keyed.groupBy("_dup", "_leak").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "_dup", "_leak").first()  # of three at most
        usual[name] = (states["_dup"], states["_leak"]) if states else (False, False)
        others[name] = cut(keyed.filter((F.col("_dup") != usual[name][0]) | (F.col("_leak") != usual[name][1])))
        release(keyed)
    out = rows
    for name in reversed(columns):
        if out is not rows:
            last, out = rows, cut(out)
            release(last)
            rows = out
        of = {f"duplicate_{name}": ("_dup", usual[name][0]), f"leakage_{name}": ("_leak", usual[name][1])}
        held_ = [F.when(known(parts[name]), F.coalesce(of[c][0], F.lit(of[c][1]))).otherwise(False).alias(c) for c in columns[name]]
        out = out.join(others[name], parts[name], "left").select(*(c for c in out.columns), *held_)
    return out.select(*df.columns, *added)


def any_of(prefix: str, names: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.col(f"{prefix}_{n}") for n in names))


def downgrade(df: DataFrame, names: list[str], status: str = "quality_status", flags: str = "quality_flags") -> DataFrame:
    """Duplicates and leaks get a flag; a VALID row that has one becomes SUSPICIOUS."""
    dup, leak = any_of("duplicate", names), any_of("leakage", names)
    out = df.withColumn(flags, with_flag(flags, "possible_duplicate", dup)).withColumn(flags, with_flag(flags, "train_eval_leakage", leak))
    return out.withColumn(status, F.when((F.col(status) == "VALID") & (dup | leak), "SUSPICIOUS").otherwise(F.col(status)))


def flag_totals(df: DataFrame, flags: list[str]) -> DataFrame:
    """(flag, rows) for boolean columns, in one pass."""
    row = df.agg(*(F.coalesce(F.sum(F.col(f).cast("long")), F.lit(0)).alias(f) for f in flags))
    return row.select(F.explode(F.array(*(F.struct(F.lit(f).alias("flag"), F.col(f).alias("rows")) for f in flags))).alias("x")).select("x.*")


def split_overlap(df: DataFrame, key: str, split: str = "split", train: str = "train", held: str = "eval") -> DataFrame:
    """Distinct non-null keys that both splits have."""
    keys = df.filter(F.col(key).isNotNull())
    return keys.filter(F.col(split) == train).select(key).intersect(keys.filter(F.col(split) == held).select(key))


def validate_manifest(df: DataFrame, key: str, split: str, hashes: list[str], expected: dict[str, int] | None = None) -> DataFrame:
    """One row: rows, rows per split, unique, duplicate and null ids, rows with all hashes, and whether it is consistent."""
    per_split = {s: F.sum((F.col(split) == s).cast("long")).alias(f"n_{s}") for s in (expected or {"train": 0, "eval": 0})}
    row = df.agg(
        F.count(F.lit(1)).alias("n_rows"), *per_split.values(), F.count_distinct(key).alias("unique_ids"), F.sum(F.col(key).isNull().cast("long")).alias("null_ids"),
        F.sum(reduce(lambda a, b: a & b, (F.col(h).isNotNull() for h in hashes)).cast("long")).alias("hashed_rows"),
    )
    row = row.withColumn("duplicate_ids", F.col("n_rows") - F.col("null_ids") - F.col("unique_ids"))
    ok = (F.col("duplicate_ids") == 0) & (F.col("null_ids") == 0)
    for s, n in (expected or {}).items():
        ok = ok & (F.col(f"n_{s}") == n)
    return row.withColumn("consistent", ok)


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that one side lacks: (key, missing_in)."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("missing_in", F.lit("right")).unionByName(b.join(a, key, "left_anti").withColumn("missing_in", F.lit("left")))
