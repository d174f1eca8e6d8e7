"""Entropy and pressure anomalies of metric series (survey W2-W4, R9-R11).

Series are keyed by repository, scope, subject and key.  All lookbacks work in
time buckets of equal depth, so one busy series is spread over as many tasks as its rows need.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import finite, fixed
from ..functions.scores import z_score
from ..operators.running import DAY, answer, asof_join, evened, micros, moments, value_parts
from ..operators.shared import materialized

SERIES = ["repo_id", "scope", "subject_id", "key"]
BASELINE_WINDOW = 7 * DAY
MIN_SAMPLES = 4


@dataclass(frozen=True)
class Profile:
    """Fixed values of one anomaly kind."""

    warn: float
    error: float
    warn_floor: float
    error_floor: float
    warn_margin: float  # minimum distance of the warn line from the mean
    error_margin: float
    warn_slack: float  # how far below the line a crossing must start
    error_slack: float
    clear_floor: float
    clear_margin: float
    z_warn: float
    z_error: float
    step_warn: float  # minimum rise that counts as acceleration
    step_error: float
    step_by_stddev: bool


ENTROPY = Profile(60, 80, 45, 65, 6, 10, 8, 10, 35, 3, 2.25, 3.25, 6, 10, True)
PRESSURE = Profile(75, 85, 45, 60, 7, 12, 7, 10, 30, 4, 2.1, 3.1, 6, 12, False)


def with_previous(df: DataFrame) -> DataFrame:
    """Add the last value strictly before each row (0 when there is none)."""
    looked = asof_join(df, df.select(*SERIES, "at", "sha", "value"), SERIES, "at", "at", ["value"],
                       name="_prev", strict=True, tie="sha")
    return looked.select(*df.columns, finite(F.col("_prev.value")).alias("previous_value"))


def settled(df: DataFrame, **values: Column) -> DataFrame:
    """The frame with more columns, each computed once a row.

    Columns of a plain projection are written out at every later mention, also inside the filters that
    move below it; thresholds built on each other then grow into one expression too long to be compiled.
    What a generator gives stays a column.
    """
    return df.select("*", F.inline(F.array(F.struct(*[v.alias(name) for name, v in values.items()]))))


def lookbacks(df: DataFrame, stored: bool = False) -> DataFrame:
    """Every reading with its previous value, the value a day before and the
    sums of the seven days before it, all from one pass.

    A reading asks at its own time; it counts as the previous value and enters
    the sums right after that, leaves them seven days later, and becomes the
    day-before value 24 hours later.  Readings that are ``stored`` are dealt out evenly first.
    """
    found = answer(_marks(evened(df, ["sha", "at"]) if stored else df), SERIES, ["_n", "_s", "_q"], ["_prev", "_day"], counted=_marks(df))
    mean, dev = moments()
    return settled(found.select("_row.*", finite("_prev").alias("previous_value"), finite("_day").alias("day_before"), "_n", "_s", "_q"),
                   baseline_mean=mean, baseline_stddev=dev, baseline_samples=F.col("_n")).drop("_n", "_s", "_q")


def _marks(df: DataFrame) -> DataFrame:
    """The four marks of every reading (``lookbacks``)."""
    v, none = F.col("value"), F.lit(None).cast("double")
    day, ask, leave, enter = (F.col("_side") == i for i in range(4))
    # the parts of a reading are computed before it is dealt out, the columns of a mark only where they are asked for
    dealt = df.select("*", micros("at").alias("_at"), *value_parts(v), F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("_side"))
    part = lambda name: F.when(enter, F.col(name)).when(leave, -F.col(name)).otherwise(0).cast(dealt.schema[name].dataType).alias(name)
    return dealt.select(
        *SERIES, (F.col("_at") + F.when(day, DAY).when(leave, BASELINE_WINDOW).otherwise(0)).alias("_t"), "_side",
        F.when(ask, "").otherwise(F.col("sha")).alias("_tie"), F.when(ask, F.struct(*df.columns)).alias("_row"),
        *[part(name) for name in ("_n", "_s", "_q")], F.when(enter, v).otherwise(none).alias("_prev"), F.when(day, v).otherwise(none).alias("_day"))


def assess(df: DataFrame, profile: Profile) -> DataFrame:
    """Add thresholds, z-score and severity to every row of the series.

    Needs the series columns, ``at``, ``sha`` and ``value``.
    """
    out = _assessed(df, lambda name: F.lit(getattr(profile, name)))
    return out.drop("baseline_24h") if profile.step_by_stddev else out


def assess_indexes(metrics: DataFrame) -> DataFrame:
    """``assess`` of the entropy and the pressure series at once: one pass over the readings, each row by its own profile.

    The readings are kept in the shared folder: the lookbacks count them before they place them.
    """
    rows = materialized(metrics.filter(_is_entropy() | _is_pressure()).select(*SERIES, "at", "sha", "value"), "readings")
    entropy = F.col("key") == "code_entropy_index"
    return _assessed(rows, lambda name: F.when(entropy, F.lit(getattr(ENTROPY, name))).otherwise(F.lit(getattr(PRESSURE, name))), stored=True)


def _assessed(df: DataFrame, fixed_value, stored: bool = False) -> DataFrame:
    number = lambda name: fixed_value(name).cast("double")
    by_stddev = fixed_value("step_by_stddev")
    earlier = F.when(F.col("day_before") != 0, F.col("day_before")).otherwise(F.col("previous_value"))
    rolled = lookbacks(df, stored).withColumn("baseline_24h", F.when(~by_stddev, earlier))
    step = F.col("value") - F.when(by_stddev, F.col("previous_value")).otherwise(F.col("baseline_24h"))
    mean, dev, x, prev = F.col("baseline_mean"), F.col("baseline_stddev"), F.col("value"), F.col("previous_value")
    known = F.col("baseline_samples") >= MIN_SAMPLES

    def line(name, factor):
        adapted = F.greatest(number(f"{name}_floor"), mean + F.greatest(dev * factor, number(f"{name}_margin")))
        return F.when(known, adapted).otherwise(number(name))

    clear = F.greatest(number("clear_floor"), mean + F.greatest(dev * 1.15, number("clear_margin")))
    rolled = settled(rolled, _warn=line("warn", 2), _error=line("error", 3), _clear=clear,
                     delta=fixed(step, 2), z_score=fixed(z_score(x, mean, dev), 2))
    warn, error, delta, z = F.col("_warn"), F.col("_error"), F.col("delta"), F.col("z_score")
    least = lambda name, factor: F.when(by_stddev, F.greatest(number(name), dev * factor)).otherwise(number(name))
    is_error = (x >= error) & ((prev < error - number("error_slack")) | (delta >= least("step_error", 1.5)) | (z >= number("z_error")))
    is_warn = (x >= warn) & ((prev < warn - number("warn_slack")) | (delta >= least("step_warn", 1)) | (z >= number("z_warn")))
    return rolled.select(
        *df.columns, "previous_value", fixed("baseline_24h", 2).alias("baseline_24h"), "delta", fixed(mean, 2).alias("baseline_mean"),
        fixed(dev, 2).alias("baseline_stddev"), "baseline_samples", "z_score",
        fixed(warn, 2).alias("warn_threshold"), fixed(error, 2).alias("error_threshold"),
        fixed("_clear", 2).alias("clear_threshold"),
        F.when(is_error, "error").when(is_warn, "warn").alias("anomaly"),
    )


def _is_entropy():
    return (F.col("key") == "code_entropy_index") & F.col("scope").isin("repo", "module")


def _is_pressure():
    return (F.col("key") == "pressure_index") & (F.col("scope") == "module")


def entropy_series(metrics: DataFrame) -> DataFrame:
    rows = metrics.filter(_is_entropy())
    return rows.select(*SERIES, "at", "sha", "value")


def pressure_series(metrics: DataFrame) -> DataFrame:
    rows = metrics.filter(_is_pressure())
    return rows.select(*SERIES, "at", "sha", "value")


def assess_entropy(metrics: DataFrame) -> DataFrame:
    return assess(entropy_series(metrics), ENTROPY)


def assess_pressure(metrics: DataFrame) -> DataFrame:
    return assess(pressure_series(metrics), PRESSURE)
