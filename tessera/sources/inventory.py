"""Source inventory, shard guard, locators, order-insensitive fingerprints, schema contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def with_locator(df: DataFrame) -> DataFrame:
    """Adds source_shard_id (file name without ending) and source_row_id (0-based row of the file)."""
    return df.withColumns({"source_shard_id": F.regexp_replace("_metadata.file_name", r"\.parquet$", ""), "source_row_id": F.col("_metadata.row_index")})


def inventory(df: DataFrame) -> DataFrame:
    """Per file: path, bytes and rows."""
    return df.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")).agg(F.count(F.lit(1)).alias("rows"))


def require_shards(df: DataFrame, expected: int) -> None:
    """Raises unless the source has exactly ``expected`` files."""
    found = df.select("_metadata.file_path").distinct().count()
    if found != expected:
        raise ValueError(f"{found} shards found, {expected} expected")


def fingerprint(df: DataFrame, frozen_from: int, columns: list[str] | None = None) -> DataFrame:
    """One row: n, an order-insensitive hash of ``columns`` (XOR alone would lose repeated rows, so a sum stands beside it),
    the gate.  A row's hash is the first 15 hex digits of the MD5 of its values joined by ``|``."""
    joined = F.concat_ws("|", *(F.col(c).cast("string") for c in columns or df.columns))
    h = F.conv(F.substring(F.md5(joined.cast("binary")), 1, 15), 16, 10).cast("bigint")
    row = df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("xor_hash"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("sum_hash"))
    return row.withColumn("gate", F.when(F.col("n") >= frozen_from, "FROZEN").otherwise("PARTIAL"))


def file_fingerprints(spark: SparkSession, path: str, chunk: int = 1 << 20) -> DataFrame:
    """(path, bytes, chunks, root) of files: the root of a binary Merkle tree over their chunks, in hex.

    A leaf is the SHA-256 of a zero byte and a chunk, a node that of a one byte and its two children; a node without a
    partner goes up as it is.  A file is read whole by one task; Spark lists no empty files, so those have no row.
    """
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), "content")
    count = F.greatest(F.lit(1), F.ceil(F.col("bytes") / chunk)).cast("int")
    node = lambda mark, data: F.unhex(F.sha2(F.concat(F.lit(bytearray([mark])), data), 256))
    leaves = F.transform(F.sequence(F.lit(0), count - 1), lambda i: node(0, F.substring("content", i * chunk + 1, F.lit(chunk))))

    def up(level: Column, _: Column) -> Column:
        pairs = F.sequence(F.lit(0), ((F.size(level) - 1) / 2).cast("int"))
        joined = lambda i: F.when(2 * i + 1 < F.size(level), node(1, F.concat(F.get(level, 2 * i), F.get(level, 2 * i + 1)))).otherwise(F.get(level, 2 * i))
        return F.when(F.size(level) == 1, level).otherwise(F.transform(pairs, joined))

    # A file has less than 2 ** 31 bytes, so 31 levels lead to the root whatever the chunk.
    root = F.aggregate(F.sequence(F.lit(1), F.lit(31)), F.col("leaves"), up, lambda level: F.lower(F.hex(F.get(level, F.lit(0)))))
    return files.withColumns({"leaves": leaves, "chunks": count}).select("path", "bytes", "chunks", root.alias("root"))


def dataset_fingerprint(files: DataFrame) -> DataFrame:
    """One row: files, bytes, and the SHA-256 of all roots in the order of the files' names; a file is one short row here."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    roots = F.array_sort(F.collect_list(F.struct(name.alias("name"), "root")))
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.sha2(F.array_join(F.transform(roots, lambda r: r["root"]), ""), 256).alias("root"))


def split_gate(df: DataFrame, split: str, shard: str, expected_rows: dict[str, int], expected_shards: dict[str, int]) -> DataFrame:
    """Per expected split its rows and shards against what is expected, and ``gate``: FROZEN if every split has both and no
    row belongs to another split, else PARTIAL."""
    counts = df.groupBy(F.col(split).alias("split")).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(shard).alias("shards"))
    wanted = df.sparkSession.createDataFrame([(s, n, expected_shards[s]) for s, n in expected_rows.items()], "split string, expected_rows bigint, expected_shards bigint")
    both = counts.join(F.broadcast(wanted), "split", "full").na.fill(0, ["rows", "shards"])
    met = F.coalesce((F.col("rows") == F.col("expected_rows")) & (F.col("shards") == F.col("expected_shards")), F.lit(False))
    whole = both.agg(F.when(F.bool_and(met), "FROZEN").otherwise("PARTIAL").alias("gate"))
    return both.join(F.broadcast(whole)).select("split", "rows", "shards", "expected_rows", "expected_shards", met.alias("met"), "gate")


def schema_difference(found: T.StructType, wanted: T.StructType) -> list[str]:
    """What a schema lacks, has too much, or has in another type; empty if the contract holds."""
    f, w = ({x.name: x.dataType.simpleString() for x in s.fields} for s in (found, wanted))
    return [f"missing {n}" for n in w if n not in f] + [f"extra {n}" for n in f if n not in w] + [f"{n} is {f[n]}, not {w[n]}" for n in w if n in f and f[n] != w[n]]


def contract_report(df: DataFrame, wanted: T.StructType) -> DataFrame:
    """Per column of the table or the contract: state (ok, missing, extra or the types that differ), and over all rows how many
    are null and how many hold a value that the wanted type cannot take.  One scan."""
    found = {f.name: f.dataType for f in df.schema}
    goal = {f.name: f.dataType for f in wanted}
    parts = []
    for name in dict.fromkeys([*goal, *found]):
        if name not in found:
            state, nulls, bad = "missing", F.count(F.lit(1)), F.lit(0).cast("long")
        elif name not in goal:
            state, nulls, bad = "extra", F.count_if(F.col(name).isNull()), F.lit(0).cast("long")
        else:
            state = "ok" if found[name] == goal[name] else f"{found[name].simpleString()}, not {goal[name].simpleString()}"
            nulls, bad = F.count_if(F.col(name).isNull()), F.count_if(F.col(name).isNotNull() & F.col(name).try_cast(goal[name]).isNull())
        parts.append(F.struct(F.lit(name).alias("column"), F.lit(state).alias("state"), nulls.alias("nulls"), bad.alias("bad")))
    return df.agg(F.array(*parts).alias("all")).select(F.explode("all").alias("x")).select("x.*")


def conform(df: DataFrame, wanted: T.StructType) -> DataFrame:
    """Columns of ``wanted`` in its order and types: missing ones are null, missing or null booleans false."""
    cols = []
    for x in wanted.fields:
        v = F.col(x.name).cast(x.dataType) if x.name in df.columns else F.lit(None).cast(x.dataType)
        cols.append((F.coalesce(v, F.lit(False)) if isinstance(x.dataType, T.BooleanType) else v).alias(x.name))
    return df.select(*cols)


def assemble(parts: list[DataFrame], wanted: T.StructType) -> DataFrame:
    """Shard outputs of differing schemas as one table of the contract."""
    out = conform(parts[0], wanted)
    for p in parts[1:]:
        out = out.unionByName(conform(p, wanted))
    return out


def write_contract(df: DataFrame, wanted: T.StructType, path: str) -> None:
    conform(df, wanted).write.mode("overwrite").parquet(path)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def look_up(ids: DataFrame, manifest: DataFrame, key: str = "id") -> DataFrame:
    """Rows of wanted ids (repeats once); raises if an id is unknown."""
    wanted = ids.select(key).distinct()
    unknown = wanted.join(manifest.select(key), key, "left_anti").limit(5).collect()
    if unknown:
        raise KeyError(f"unknown ids, such as {[r[key] for r in unknown]}")
    return manifest.join(wanted, key, "left_semi")


def verify_bytes(rows: DataFrame, raw: DataFrame, on: list[str], content: str, expected: str) -> DataFrame:
    """Rehydrated rows with ``intact``: whether the bytes still have the hash of the manifest."""
    return rows.join(raw.select(*on, content), on, "left").withColumn("intact", F.coalesce(F.sha2(content, 256) == F.col(expected), F.lit(False)))


def freeze(tables: list[DataFrame], errors: str) -> tuple[DataFrame, DataFrame]:
    """Tables of one lattice as (all rows, rows with errors); a missing column is null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out, out.filter(F.size(F.coalesce(errors, F.array())) > 0)
