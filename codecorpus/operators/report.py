"""Run summaries, error reports, step chains, bottlenecks and throughput trends."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import exact_mean, exact_sum, is_plain, js_round
from ..session import ensure_checkpoint_dir
from .rows import explode_once


def run_summary(log: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Units, successes, failures, tokens and time of a run log (ok, tokens, ms)."""
    return log.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("ok")).alias("succeeded"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("tokens"),
        F.coalesce(exact_sum(F.col("ms")), F.lit(0.0)).alias("ms"),
    )


def error_metrics(errors: DataFrame) -> DataFrame:
    """Errors and recoverable ones: in total, by step and by code, in one pass."""
    sets = errors.groupingSets(
        [[], [F.col("step")], [F.col("code")]], F.col("step"), F.col("code")
    ).agg(
        F.grouping_id().alias("g"),
        F.count(F.lit(1)).alias("errors"),
        F.count_if("recoverable").alias("recoverable"),
    )
    scope = F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "step").otherwise("code")
    return sets.select(
        scope.alias("scope"), F.coalesce("step", "code", F.lit("all")).alias("name"),
        "errors", "recoverable",
    )


@dataclass(frozen=True)
class Step:
    """A step of a chain: how it changes the text, and when and how seriously it fails."""

    name: str
    apply: Callable[[Column], Column]
    error: Callable[[Column], Column] | None = None  # message, or null where the step works
    recoverable: bool = True
    error_code: str = "UNKNOWN_ERROR"


def start_chain(units: DataFrame) -> DataFrame:
    return units.withColumns({
        "ok": F.lit(True),
        "warnings": F.array().cast("array<string>"),
        "error": F.lit(None).cast("struct<step:string,code:string,message:string>"),
    })


def run_step(units: DataFrame, step: Step) -> DataFrame:
    """Run one step on every unit that is still ok.

    A recoverable failure keeps the text that came in and leaves a warning; any other one
    stops the unit, keeps its last good text and records the error.
    """
    code = F.col("code")
    message = step.error(code) if step.error else F.lit(None).cast("string")
    checked = units.withColumn("_m", F.when(F.col("ok"), message))
    failed = F.col("_m").isNotNull()
    note = F.concat(F.lit(f"Step '{step.name}' failed but was recovered: "), F.col("_m"))
    changes: dict[str, Column] = {
        "code": F.when(F.col("ok") & ~failed, step.apply(code)).otherwise(code),
    }
    if step.recoverable:
        changes["warnings"] = F.when(
            failed, F.array_append("warnings", note)).otherwise(F.col("warnings"))
    else:
        changes["ok"] = F.col("ok") & ~failed
        changes["error"] = F.when(failed, F.struct(
            F.lit(step.name).alias("step"), F.lit(step.error_code).alias("code"),
            F.col("_m").alias("message"),
        )).otherwise(F.col("error"))
    return checked.withColumns(changes).drop("_m")


def compose(*transforms: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """One transform that applies the given ones in order."""
    return lambda df: reduce(lambda acc, t: acc.transform(t), transforms, df)


def run_steps(units: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """Run a chain of steps over all units, one result per unit, without a shuffle."""
    chain = compose(*[lambda df, s=s: run_step(df, s) for s in steps])
    return chain(start_chain(units))


def split_failed(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(finished units, error rows of stopped ones)."""
    return (
        results.filter("ok").drop("error"),
        results.filter(~F.col("ok")).select("unit_id", "error.*"),
    )


# Bottleneck rules (type, severity, metric, above, up to, impact), first rule
# of a metric that holds; then our own words: what was measured, its unit, what may help.
BOTTLENECKS = (
    ("memory", "high", "heap_mb", 1000.0, None, 0.8,
     "Heap use is high", " MB", "Process in smaller chunks, or stream instead of holding whole texts"),
    ("memory", "medium", "heap_mb", 500.0, 1000.0, 0.4,
     "Heap use is raised", " MB", "Watch the heap, and trim what is kept if it grows"),
    ("cpu", "high", "cpu", 0.9, None, 0.7,
     "CPU is nearly used up", " %", "Run fewer tasks at a time, or give them more cores"),
    ("io", "medium", "seconds", 300.0, None, 0.6,
     "The run takes long", " s", "Spread the work over more tasks, or reuse cached answers"),
)


def bottlenecks(samples: DataFrame) -> DataFrame:
    """Bottlenecks of samples (run_id, sample_id, heap_mb, cpu, seconds), none to three each: type,
    severity, impact, the rounded measure, a description with it, and a suggestion. A null
    measure is no bottleneck."""
    def rule(kind: str, severity: str, metric: str, above: float, upto: float | None, impact: float,
             words: str, unit: str, advice: str) -> Column:
        hit = F.col(metric) > above
        if upto is not None:
            hit = hit & (F.col(metric) <= upto)
        measured = js_round(F.col(metric) * (100 if metric == "cpu" else 1))
        return F.when(hit, F.struct(
            F.lit(kind).alias("type"), F.lit(severity).alias("severity"),
            F.lit(impact).alias("impact"), measured.alias("measured"),
            F.concat(F.lit(f"{words}: "), measured.cast("string"), F.lit(unit)).alias("description"),
            F.lit(advice).alias("suggestion"),
        ))

    found = F.array_compact(F.array(*[rule(*r) for r in BOTTLENECKS]))
    return explode_once(samples, "run_id", "sample_id", array=found, name="b").select(
        "run_id", "sample_id", "b.*")


def metric_means(metrics: DataFrame) -> DataFrame:
    """Mean per metric name; 0 where a name has no value."""
    return metrics.groupBy("name").agg(
        F.coalesce(exact_mean(F.col("value")), F.lit(0.0)).alias("mean"),
        F.count("value").alias("samples"),
    )


# The trend window, its split, and the advice limits.
TREND_SAMPLES = 5
TREND_LEAD = 4
TREND_LIMIT = 0.1
BUSY = 0.8


def _trend(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    w = W.partitionBy(*keys).orderBy("ts", "sample_id")
    value = F.col("throughput").cast("double")
    decimal = F.when(is_plain(value), value).cast("decimal(28,18)")

    def mean(first: int, last: int) -> Column:
        frame, n = w.rowsBetween(first, last), last - first + 1
        total = F.when(F.count(decimal).over(frame) == n, F.sum(decimal).over(frame).cast("double"))
        return F.coalesce(total, F.sum(value).over(frame)) / n  # the frame's order is fixed

    full = F.count(value).over(w.rowsBetween(-TREND_LEAD, 0)) == TREND_SAMPLES
    earlier, recent = mean(-TREND_LEAD, -3), mean(-2, 0)
    return samples.withColumn("trend", F.when(full, F.try_divide(recent - earlier, earlier)))


def _borrowed(ranged: DataFrame, cols: Sequence[str]) -> DataFrame:
    """For each range, the four samples in front of it of the run it starts with.

    Works on the last four samples of every range, so its size depends on the number of
    ranges only, and so do its two windows without a key. A run that enters a range from
    the left is the last run of each range it comes from.
    """
    last = W.partitionBy("range").orderBy(F.desc("run_id"), F.desc("ts"), F.desc("sample_id"))
    tails = ranged.withColumn("k", F.row_number().over(last)).filter(F.col("k") <= TREND_LEAD)
    everything = W.partitionBy(F.lit(0))
    numbered = tails.withColumn(
        "g", F.row_number().over(everything.orderBy("range", "run_id", "ts", "sample_id")))
    starts = ranged.groupBy("range").agg(F.min("run_id").alias("run_id"))
    ends = numbered.groupBy("range").agg(F.max("g").alias("g"))
    wanted = (
        starts.join(ends, "range")
        .withColumn("g", F.lag("g").over(everything.orderBy("range")))
        .filter(F.col("g").isNotNull())
        .select(F.col("range").alias("to_range"), "run_id",
                F.explode(F.sequence(F.col("g") - (TREND_LEAD - 1), F.col("g"))).alias("g"))
    )
    return wanted.join(numbered, ["g", "run_id"]).select(*cols, F.col("to_range").alias("range"))


def throughput_trend(samples: DataFrame, partitions: int | None = None) -> DataFrame:
    """Trend over the last five samples of a run and what to do about it.

    Columns run_id, ts, sample_id, throughput, cpu, memory. A run may hold a large part of
    all samples, so runs are not the unit of work: samples are range-partitioned by (run,
    time), and each range borrows the four samples before it of the run that reaches into
    it. The ranges are pinned by a checkpoint because they are read more than once.
    """
    spark = samples.sparkSession
    ensure_checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = ["run_id", "ts", "sample_id", "throughput", "cpu", "memory"]
    ranged = (
        samples.select(*cols)
        .repartitionByRange(n, "run_id", "ts", "sample_id")
        .withColumn("range", F.spark_partition_id())
        .checkpoint()
    )
    lead = _borrowed(ranged, cols).withColumn("borrowed", F.lit(True))
    both = ranged.withColumn("borrowed", F.lit(False)).unionByName(lead)
    out = _trend(both, ["range", "run_id"]).filter(~F.col("borrowed"))
    idle = (F.col("cpu") < BUSY) & (F.col("memory") < BUSY)
    return out.select(
        "run_id", "sample_id", "trend",
        F.when(F.col("trend") < -TREND_LIMIT, "reduce")
        .when((F.col("trend") > TREND_LIMIT) & idle, "increase")
        .when(F.col("trend").isNotNull(), "keep").alias("advice"),
    )


def format_errors(errors: DataFrame) -> DataFrame:
    """Adds a readable text to error rows (step, message, suggestions, recoverable)."""
    # fixed values: the sentences and their signs
    hints = F.when(
        F.size("suggestions") > 0,
        F.concat(F.lit("\n\n💡 Suggestions:\n"), F.array_join(
            F.transform("suggestions", lambda s: F.concat(F.lit("  • "), s)), "\n")),
    ).otherwise("")
    tail = F.when(
        F.col("recoverable"), "\n\n🔄 This error is recoverable - attempting to continue..."
    ).otherwise("")
    return errors.withColumn("text", F.concat(
        F.lit("❌ Error in "), F.col("step"), F.lit(": "), F.col("message"), hints, tail))
