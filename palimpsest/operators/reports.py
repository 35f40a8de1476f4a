"""Reports over measured values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def pivot(metrics: DataFrame, row: str, names: list[str]) -> DataFrame:
    """A row for each value of a column, a column for each name; `not measured` where there is none."""
    out = metrics.groupBy(row).pivot("name", sorted(names)).agg(F.first("value"))
    return out.fillna("not measured", sorted(names))


def latest(runs: DataFrame, by: str, at: str) -> DataFrame:
    """The row of each group with the latest time; none counts as the earliest."""
    return runs.groupBy(by).agg(F.max_by(F.struct(*runs.columns), F.coalesce(F.col(at), F.lit(-(1 << 62)))).alias("r")).select("r.*")


#: Fixed value: bytes that the least object takes; a control that shows less was not measured.
LEAST_OBJECT = 16.0


def gate(expected: DataFrame, measured: DataFrame, controls: DataFrame | None = None, least: float = LEAST_OBJECT) -> DataFrame:
    """name, limit -> verdict: missing, violation (null or above the limit) or ok.

    controls: names whose values must be there and at least `least`; a control that shows nothing means a broken instrument.
    """
    seen = measured.select("name", "value", F.lit(True).alias("seen"))
    verdict = F.when(F.col("seen").isNull(), "missing").when(F.col("value").isNull() | (F.col("value") > F.col("limit")), "violation").otherwise("ok")
    out = expected.join(seen, "name", "left").select("name", "limit", "value", verdict.alias("verdict"))
    if controls is None:
        return out
    verdict = F.when(F.col("value").isNull(), "missing").when(F.col("value") < least, "violation").otherwise("ok")
    own = controls.select("name").join(seen, "name", "left").select("name", F.lit(None).cast(expected.schema["limit"].dataType).alias("limit"), "value", verdict.alias("verdict"))
    return out.unionByName(own)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """The objects of JSON files, each a whole document or a list of them; a file that doesn't parse raises."""
    return spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path)


SUITE = "_name string, _tests int, _failures int, _errors int, _skipped int"


def read_suites(spark: SparkSession, path: str) -> DataFrame:
    """name, tests, failures, errors and skipped of the test suites of XML files; counts that are not there are null."""
    found = spark.read.format("xml").option("rowTag", "testsuite").option("mode", "FAILFAST").schema(SUITE).load(path)
    return found.select(*[F.col(f"_{n}").alias(n) for n in ("name", "tests", "failures", "errors", "skipped")])


def dumped(names: list[str], separator: str = ":") -> Column:
    """A row as text."""
    return F.concat_ws(separator, *[F.col(n).cast("string") for n in names])


def deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """name and after - before of counters in both."""
    return before.select("name", F.col("value").alias("old")).join(after.select("name", F.col("value").alias("new")), "name").select("name", (F.col("new") - F.col("old")).alias("delta"))


def nearest_rank(rows: DataFrame, value: str, ranks=(50, 99)) -> DataFrame:
    out = [F.expr(f"cast(percentile_disc({p / 100}) within group (order by {value}) as bigint)").alias(f"p{p}") for p in ranks]
    return rows.agg(*out, F.max(value).cast("bigint").alias("max"), F.count("*").alias("n"))


def counter(line: Column, name: str) -> Column:
    """The number of name=<number> in a line, null if it isn't there."""
    return F.regexp_extract(line, rf"\b{name}=([0-9]+)", 1).try_cast("bigint")


def formatted(value: Column, unit: Column) -> Column:
    """A measured value as text, by its unit, which may be null; `not measured` where there is no value."""
    text = (
        F.when(unit == "bytes", F.format_string("%.1f MiB", value / 1048576.0))
        .when(unit == "ms", F.format_string("%.2f ms", value))
        .when(unit == "count", F.format_string("%d", value.cast("bigint")))
        .otherwise(F.format_string("%.3f", value))
    )
    return F.when(value.isNull(), "not measured").otherwise(text)


def duration_ms(text: Column) -> Column:
    """A number with ms, s, m, h or d, in milliseconds; null for anything else."""
    n = F.regexp_extract(text, r"^([0-9]+)(ms|s|m|h|d)$", 1)
    unit = F.regexp_extract(text, r"^([0-9]+)(ms|s|m|h|d)$", 2)
    worth = F.coalesce(*[F.when(unit == u, v) for u, v in (("ms", 1), ("s", 1000), ("m", 60000), ("h", 3600000), ("d", 86400000))])
    return F.when(n != "", n.cast("bigint") * worth)


def admitted(shards: DataFrame, budget: int) -> DataFrame:
    """The first shards, by id, whose rows together stay in a budget. Shards are rows of a manifest: one task."""
    from pyspark.sql import Window as W

    return shards.withColumn("total", F.sum("n").over(W.orderBy("id").rowsBetween(W.unboundedPreceding, 0))).filter(F.col("total") <= budget)


def peak_after_gc(samples: DataFrame) -> DataFrame:
    return samples.groupBy("gc").agg(F.sum("bytes").alias("bytes")).agg(F.max("bytes").alias("peak"), F.count("*").alias("collections"))


def crash_summary(outcomes: DataFrame, run: str, at: str) -> DataFrame:
    """Of each run's outcomes (verified, delay): how many, how many verified, and their delays in order, as text.

    A run's outcomes are the restarts of one report, so its list is short.
    """
    delays = F.transform(F.sort_array(F.collect_list(F.when(F.col("delay").isNotNull(), F.struct(at, "delay")))), lambda s: s["delay"].cast("string"))
    return outcomes.groupBy(run).agg(F.count_if("verified").alias("verified"), F.count("*").alias("total"), F.array_join(delays, ", ").alias("delays"))


def vacuity(iterations: DataFrame, by: str, required: int) -> DataFrame:
    """by, lossy and verdict: failed, or vacuous if all passed but fewer than required lost anything, or ok."""
    out = iterations.groupBy(by).agg(F.count_if("lossy").alias("lossy"), F.count_if(~F.coalesce("passed", F.lit(False))).alias("__failed"))
    return out.select(by, "lossy", F.when(F.col("__failed") > 0, "failed").when(F.col("lossy") < required, "vacuous").otherwise("ok").alias("verdict"))


def suite_passed() -> Column:
    """Whether a suite ran at least one test, and none failed, broke or was skipped; counts that are not there don't pass."""
    none = [F.col(c) == 0 for c in ("failures", "errors", "skipped")]
    return F.coalesce(none[0] & none[1] & none[2] & (F.col("tests") >= 1), F.lit(False))


def exact(actual: DataFrame, expected: DataFrame, identity: list[str]) -> DataFrame:
    """what and n: rows missing and unexpected (as sets), and identities that actual rows repeat. All 0: an exact match."""
    names = expected.columns
    sides = actual.select(*names, F.lit(True).alias("__a"), F.lit(False).alias("__e")).unionByName(expected.select(*names, F.lit(False).alias("__a"), F.lit(True).alias("__e")))
    sides = sides.groupBy(*names).agg(F.max("__a").alias("__a"), F.max("__e").alias("__e"))
    counts = sides.agg(F.count_if(~F.col("__a")).alias("missing"), F.count_if(~F.col("__e")).alias("unexpected"))
    repeated = actual.groupBy(*identity).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("n")).select(F.lit("repeated").alias("what"), "n")
    return counts.unpivot([], ["missing", "unexpected"], "what", "n").unionByName(repeated)


def per_second(n: Column, elapsed_ms: Column) -> Column:
    """Throughput; null if no time went by."""
    return F.when(elapsed_ms > 0, n * 1000.0 / elapsed_ms)
