"""Secret scans: three fixed patterns, and a battery of randomness tests for tokens that no pattern names.

DataFrame functions only.  Candidate tokens get an inferred encoding (hex, base32, base64) and four figures: a
chi-squared statistic against a uniform alphabet, the number of runs of character classes, the lag-1 serial
correlation of the symbols' ranks, and the length.  Each test asks how surprising the token would be if it were
ordinary writing, whose letters are far from uniform, whose classes seldom change, and whose neighbours are
correlated; the three p-values are combined by Fisher's method.  False discoveries are held per length band: the
Benjamini-Hochberg bound of a band comes from a histogram of log p-values with a fixed number of bins, so the corpus
is counted by one aggregation and only ``len(BANDS) * BINS`` rows are ever brought together.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, read_table, text_or_empty

# The patterns of the base kinds, with the group that counts and its least length.
ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""^(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
# Runs of hex digits are maximal, so asking for 16 in the pattern finds the same runs as dropping shorter ones later.
HEX = r"[0-9a-f]{16,}"
KINDS = ["assign", "access", "hex", "random"]

#: Candidates of the battery, at least MIN_LENGTH symbols.
MIN_LENGTH = 20
TOKEN = rf"[A-Za-z0-9+/_=-]{{{MIN_LENGTH},}}"
#: Marks between letters, and capitals that begin a word: both are left out where changes of class are counted.
JOINT = r"(?<=[A-Za-z])[-_/+=](?=[A-Za-z])"
HUMP = r"(?<![A-Z])[A-Z](?=[a-z])"
#: False discovery rate, and the upper ends of the length bands that it is held in.
FDR = 0.01
BANDS = [24, 32, 48, 64, 128]
#: Bins of -ln p for the Benjamini-Hochberg bound, BIN_WIDTH wide.
BINS, BIN_WIDTH = 400, 0.25
#: Matches that are placed together.
RUN = 64
_FOUND = "array<struct<start:int,end:int,found:string>>"


def spans(text: Column, pattern: str) -> Column:
    """All matches of ``pattern`` as array<struct<start, end, found>> in code points, end exclusive.

    The pieces between the matches and the matches themselves alternate, so running lengths give the places.  They are
    taken in runs of ``RUN``, so that no array grows by one element at a time.
    """
    parts = F.arrays_zip(F.transform(F.split(text, pattern, -1), F.char_length).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    start = lambda at, kind: F.struct(at.alias("at"), F.array().cast(kind).alias("out"))

    def step(acc: Column, part: Column) -> Column:
        begin = acc["at"] + F.coalesce(part["gap"], F.lit(0))
        end = begin + F.coalesce(F.char_length(part["found"]), F.lit(0))
        one = F.array(F.struct(begin.alias("start"), end.alias("end"), part["found"].alias("found")))
        return F.struct(end.alias("at"), F.when(part["found"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], one)).alias("out"))

    def run(acc: Column, some: Column) -> Column:
        return F.aggregate(some, start(acc["at"], _FOUND), step, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

    runs = F.transform(F.sequence(F.lit(1), F.size(parts), F.lit(RUN)), lambda i: F.slice(parts, i, RUN))
    long = F.aggregate(runs, start(F.lit(0), f"array<{_FOUND}>"), run, lambda acc: F.flatten(acc["out"]))
    return F.when(F.size(parts) <= RUN, F.aggregate(parts, start(F.lit(0), _FOUND), step, lambda acc: acc["out"])).otherwise(long)


def base_spans(text: Column) -> dict[str, Column]:
    """The three fixed kinds; matches whose counted part is too short are dropped after matching."""
    size = lambda x: F.char_length(x)
    return {
        "assign": F.filter(spans(text, ASSIGN), lambda m: size(F.regexp_extract(m["found"], ASSIGN_VALUE, 1)) >= 12),
        "access": F.filter(spans(text, ACCESS), lambda m: size(m["found"]) >= 18),
        "hex": spans(text, HEX),
    }


def _upper_normal(z: Column) -> Column:
    """ln P(Z > z): the logistic form of Bowling et al. in the middle, the Mills ratio in the upper tail."""
    tail = -z * z / 2 - F.log(F.greatest(z, F.lit(1.0))) - 0.5 * math.log(2 * math.pi)
    middle = -F.log1p(F.exp(F.least(0.07056 * z * z * z + 1.5976 * z, F.lit(700.0))))
    return F.when(z > 5, tail).otherwise(middle)


def battery(tokens: DataFrame) -> DataFrame:
    """Adds encoding, chi2, runs, serial and evidence (-ln of the combined p) to rows with a string column ``found``.

    Null or empty tokens get the encoding ``none`` and evidence 0.
    """
    t = F.col("found")
    # Words joined by case or by marks change class where a word begins: such capitals and marks are no sign of chance.
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "=+$", ""), JOINT, ""), HUMP, "a")
    encoding = (
        F.when(t.isNull() | (F.length(t) == 0), "none").when(t.rlike(r"^[0-9]+$"), "decimal")
        .when(t.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$"), "hex").when(t.rlike(r"^[A-Z2-7]+=*$"), "base32").otherwise("base64")
    )
    k = F.when(F.col("encoding") == "hex", 16).when(F.col("encoding") == "base32", 32).when(F.col("encoding") == "decimal", 10).otherwise(64)
    codes = F.transform(F.split(F.regexp_replace(t, "=+$", ""), ""), F.ascii)
    kind = lambda c: F.when((c >= 48) & (c <= 57), 0).when((c >= 65) & (c <= 90), 1).when((c >= 97) & (c <= 122), 2).otherwise(3)
    rank = lambda c: F.when(c <= 57, c - 48).when(c <= 90, c - 55).otherwise(c - 61)
    d = tokens.withColumns({"encoding": encoding, "_codes": codes, "_plain": F.transform(F.split(plain, ""), F.ascii)})
    d = d.withColumns({"_n": F.greatest(F.size("_codes"), F.lit(1)).cast("double"), "_k": k.cast("double")})
    d = d.withColumn("_squares", F.aggregate(
        F.array_distinct("_codes"), F.lit(0.0),
        lambda a, c: a + F.pow(F.size(F.filter(F.col("_codes"), lambda x: x == c)).cast("double"), F.lit(2.0)),
    ))
    pairs = lambda x: F.zip_with(F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))), F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    d = d.withColumns({"_pairs": pairs("_codes"), "_joins": pairs("_plain")}).withColumn("_mean", F.aggregate("_codes", F.lit(0.0), lambda a, c: a + rank(c)) / F.col("_n"))
    d = d.withColumns({
        "chi2": F.col("_k") * F.col("_squares") / F.col("_n") - F.col("_n"),
        "runs": F.size(F.filter("_joins", lambda p: kind(p["a"]) != kind(p["b"]))) + 1,
        "_var": F.aggregate("_codes", F.lit(0.0), lambda a, c: a + F.pow(rank(c) - F.col("_mean"), F.lit(2.0))),
        "_cov": F.aggregate("_pairs", F.lit(0.0), lambda a, p: a + (rank(p["a"]) - F.col("_mean")) * (rank(p["b"]) - F.col("_mean"))),
    })
    d = d.withColumn("serial", F.coalesce(F.try_divide("_cov", "_var"), F.lit(1.0)))
    # Ordinary writing: letters hit an alphabet of k symbols with sum of squares about 0.065 (a language's letters),
    # classes change about every twelfth symbol, and neighbours move together or apart by about a quarter.
    excess = F.greatest(F.col("_k") * 0.065 - 1, F.lit(0.6))
    mean, sd = F.col("_k") - 1 + F.col("_n") * excess, F.sqrt(2 * (F.col("_k") - 1) + 4 * F.col("_n") * excess)
    ln_uniform = _upper_normal((mean - F.col("chi2")) / sd)
    m = F.greatest(F.col("_n") - 1, F.lit(1.0))
    c = F.greatest(F.size("_plain") - 1, F.lit(1)).cast("double")
    ln_runs = _upper_normal((F.col("runs") - 1 - c / 12) / F.sqrt(c * 11 / 144))
    ln_serial = _upper_normal((0.25 - F.abs("serial")) * F.sqrt(m))
    # Fisher: X = -sum ln p is a gamma variable with shape 3; its tail is exp(-X) (1 + X + X^2 / 2).
    x = -(ln_uniform + ln_runs + ln_serial)
    evidence = F.greatest(x - F.log(1 + x + x * x / 2), F.lit(0.0))
    # A run of decimals is a number, which says nothing about a key; all other tokens are left to the tests.
    d = d.withColumn("evidence", F.when(F.col("encoding").isin("none", "decimal"), 0.0).otherwise(evidence))
    return d.drop("_codes", "_plain", "_n", "_k", "_squares", "_pairs", "_joins", "_mean", "_var", "_cov")


def band(length: Column) -> Column:
    """Index of the length band, 0 for the shortest."""
    return sum((length > b).cast("int") for b in BANDS)


def discovery_bounds(tokens: DataFrame, fdr: float = FDR) -> DataFrame:
    """Per length band the least evidence that Benjamini-Hochberg accepts; bands without a discovery are absent."""
    bins = tokens.groupBy("band", F.least(F.floor(F.col("evidence") / BIN_WIDTH), F.lit(BINS - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    above = Window.partitionBy("band").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    counted = bins.withColumns({"passed": F.sum("n").over(above), "tested": F.sum("n").over(Window.partitionBy("band"))})
    ok = F.exp(-F.col("bin") * BIN_WIDTH) * F.col("tested") <= fdr * F.col("passed")
    return counted.filter(ok & (F.col("bin") > 0)).groupBy("band").agg((F.min("bin") * BIN_WIDTH).alias("bound"))


_SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"


def _hit(text: Column) -> Column:
    """Whether a text can hold anything that is looked for."""
    return ((text.contains("=") | text.contains(":")) & text.rlike(ASSIGN)) | (text.contains("AKIA") & text.rlike(ACCESS)) | text.rlike(HEX) | text.rlike(TOKEN)


def _base_and_tokens(text: Column) -> tuple[Column, Column]:
    """Spans of the fixed kinds, and the candidates of the battery that touch none of them."""
    tag = lambda k, found: F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(k)).alias("rank"), F.lit(k).alias("kind"), m["end"].alias("end")))
    return F.concat(*(tag(k, v) for k, v in base_spans(text).items())), spans(text, TOKEN)


def _judged(rows: DataFrame, fdr: float) -> DataFrame:
    """``rows`` (base, tokens, ...) with ``spans``: the base ones and the tokens that the battery discovers, in order.

    Tokens are named by their row, so what is shuffled is tokens, and the rows that have one.
    """
    free = F.filter("tokens", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    rows = rows.withColumn("tokens", free).withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows, "secret-rows")
    found = battery(rows.filter(F.size("tokens") > 0).select("row", F.explode("tokens").alias("m")).select("row", "m.start", "m.end", "m.found"))
    found = materialize(found.withColumn("band", band(F.col("end") - F.col("start"))).drop("found"), "secret-tokens")
    passed = found.join(F.broadcast(discovery_bounds(found, fdr)), "band").filter(F.col("evidence") >= F.col("bound"))
    added = passed.groupBy("row").agg(F.collect_list(F.struct("start", F.lit(3).alias("rank"), F.lit("random").alias("kind"), "end")).alias("added"))
    none = F.expr(f"cast(array() as {_SPANS})")
    some = rows.filter(F.size("tokens") > 0).join(added, "row", "left").withColumn("spans", F.array_sort(F.concat("base", F.coalesce("added", none)))).drop("added")
    return some.unionByName(rows.filter(F.size("tokens") == 0).withColumn("spans", F.array_sort("base"))).drop("row", "base", "tokens")


def scan(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """Per row of ``docs``: doc_id and spans, array<struct<start, rank, kind, end>> in reading order.

    ``rank`` is the kind's place in KINDS.  Kinds are matched on their own, so spans of different kinds may overlap;
    a random token that touches a base span is left out.  Null and empty texts have no spans; an empty table gives
    an empty result; rows that repeat a text get equal spans; a very long text is matched whole, its spans in runs; other columns of ``docs`` are not read.  Texts are read
    once and never shuffled.
    """
    base, tokens = _base_and_tokens(F.col("text"))
    rows = docs.select("doc_id", text_or_empty().alias("text")).withColumn("hit", _hit(F.col("text")))
    empty = lambda kind: F.expr(f"cast(array() as {kind})")
    return _judged(rows.select("doc_id", F.when(F.col("hit"), base).otherwise(empty(_SPANS)).alias("base"), F.when(F.col("hit"), tokens).otherwise(empty(_FOUND)).alias("tokens")), fdr)


def redact(docs: DataFrame, fdr: float = FDR, mask: str = "[secret]") -> DataFrame:
    """``docs`` with every found span replaced by ``mask``; other columns and rows stay; n_chars follows the text.

    Where spans overlap or touch, one mask stands for all of them.  Rows without a candidate pass through where they
    are read; the others are kept whole beside their spans, so no text has to be joined back by a key.
    """
    text = F.col("text")
    base, tokens = _base_and_tokens(text)
    rows = docs.select(F.struct("*").alias("doc"), text_or_empty().alias("text"))
    found = _judged(rows.filter(_hit(text)).select("doc", "text", base.alias("base"), tokens.alias("tokens")), fdr)
    empty = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        plain = F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), F.lit(mask))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] < acc["at"], acc["out"]).otherwise(plain).alias("out"))

    masked = F.aggregate("spans", empty, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))
    found = found.select("doc", F.when(F.size("spans") > 0, masked).alias("new"))
    new = {"text": F.col("new")} | ({"n_chars": F.char_length("new").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    changed = found.select(*(F.when(F.col("new").isNull(), F.col("doc")[c]).otherwise(new[c]).alias(c) if c in new else F.col("doc")[c].alias(c) for c in docs.columns))
    return rows.filter(~_hit(text)).select("doc.*").unionByName(changed)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read_table(spark, sf_dir, "documents"))
    joined = lambda s: F.array_join(F.transform(s, lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda m: m["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(joined(F.filter("spans", lambda m: m["rank"] < 3)), 256).alias("base_sha256"), joined("spans").alias("spans"),
    )
