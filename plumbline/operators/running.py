"""Running sums and lookups along time, split into time buckets of equal depth.

A plain window over a series sorts the whole series in one task.  Here the
work inside a bucket runs per (key, bucket), one summary row per (key, bucket)
carries the state across buckets, and the two are joined back on the bucket.
A first count by (key, hour) says where the buckets of a key begin: each
holds about ``DEPTH`` marks, so a series that has a third of all rows within an hour is
spread over as many tasks as its rows need, a sparse one is one bucket, and
nothing is dropped.

Everything is placed on a time line as *marks*: a mark may ask (it carries the
row to answer in ``_row``), add to sums, or set a value others look back for.
One pass answers any mix of them, so a plan that needs several lookbacks reads
its input once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialized

DAY = 86_400_000_000
HOUR = 3_600_000_000
MINUTE = 60_000_000
#: Marks that a bucket is to hold.
DEPTH = 1 << 18
#: Partitions for each bucket's worth of marks.
SPREAD = 4


def micros(at) -> Column:
    return F.unix_micros((F.col(at) if isinstance(at, str) else at).cast("timestamp"))


def slots(marks: DataFrame, keys: list[str], slot_us: int = HOUR) -> DataFrame:
    """How many marks (``_n``) every key has in each time slot (``_slot``)."""
    slot = F.floor(F.col("_t") / slot_us).cast("bigint")
    return marks.groupBy(*keys, slot.alias("_slot")).agg(F.count(F.lit(1)).alias("_n"))


def bucketed(marks: DataFrame, keys: list[str], depth: int, slot_us: int = HOUR, counts: DataFrame | None = None) -> DataFrame:
    """The marks with ``_bucket``: runs of time slots of one key that hold about ``depth`` marks.

    Slots are counted before anything is sorted (``counts``, where that has been done).  A slot with more marks than that
    is cut into as many equal parts as it needs; only the keys that need more than one bucket
    are looked up, and their bucket starts are one array.
    """
    counts = slots(marks, keys, slot_us) if counts is None else counts
    before = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    running = counts.withColumn("_sum", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    nth = lambda c: F.floor(c / depth)
    parts = F.least(nth(F.col("_sum") + F.col("_n") - 1) - nth(F.col("_sum")) + 1, F.lit(slot_us))
    # a slot begins a bucket where the running count passes a multiple of the depth
    step = F.floor(F.lit(slot_us) / parts)
    starts = running.filter((nth(F.col("_sum") + F.col("_n") - 1) > nth(F.col("_sum") - 1)) & (F.col("_sum") + F.col("_n") > depth)).select(
        *keys, F.explode(F.transform(F.sequence(F.lit(0), (parts - 1).cast("int")), lambda i: F.col("_slot") * slot_us + i * step)).alias("_start"))
    packed = starts.groupBy(*keys).agg(F.collect_list("_start").alias("_starts"))
    known = marks.join(packed, keys, "left")
    passed = F.size(F.filter("_starts", lambda s: s <= F.col("_t")))
    return known.withColumn("_bucket", F.when(F.col("_starts").isNull(), 0).otherwise(passed).cast("bigint")).drop("_starts")


def evened(rows: DataFrame, by: list[str], most: int = DEPTH) -> DataFrame:
    """The rows of a stored table in tasks of about ``most``.

    A split of a column file holds far more rows than one of text, and what a task deals out it holds until it is written.
    """
    parts = -(-rows.count() // most)
    return rows.repartition(parts, *by) if parts > rows.rdd.getNumPartitions() else rows


def dealt(marks: DataFrame, keys: list[str], depth: int, counted: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """The marks with ``_bucket``, and whether any key has more than one.

    The counts of the slots are kept, so the marks are counted once and the bucket starts have a known
    size.  Buckets are dealt out over partitions that grow in number with the marks: a task
    sorts a few buckets, however large the table is.
    """
    counts = materialized(slots(marks if counted is None else counted, keys), "slots")
    each = counts.groupBy(*keys).agg(F.sum("_n").alias("_n"))
    most, total = each.agg(F.coalesce(F.max("_n"), F.lit(0)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    several = most > depth
    placed = bucketed(marks, keys, depth, counts=counts) if several else marks.withColumn("_bucket", F.lit(0).cast("bigint"))
    parts = SPREAD * -(-total // depth)
    if parts > int(marks.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        placed = placed.repartition(parts, *keys, *(["_bucket"] if several else []))
    return placed, several


def answer(
    marks: DataFrame, keys: list[str], sums: list[str], lasts: list[str], bucket_us: int | None = None, depth: int = DEPTH,
    counted: DataFrame | None = None,
) -> DataFrame:
    """The asking marks with all sums and the last set values placed before them.

    ``marks`` has the keys, ``_t`` (microseconds), ``_side`` (order at equal
    times), ``_tie`` (order at equal sides), ``_row`` (null for marks that do
    not ask), and the named columns: numbers or null for ``sums``, values or
    null for ``lasts``.  Buckets are of equal depth unless ``bucket_us`` fixes their length;
    where no key has more than one, nothing is carried.  ``counted`` are the same marks by a plainer plan, to count them.
    """
    if bucket_us is None:
        placed, several = dealt(marks, keys, depth, counted)
    else:
        placed, several = marks.withColumn("_bucket", F.floor(F.col("_t") / bucket_us).cast("bigint")), True
    ordered = Window.partitionBy(*keys, "_bucket").orderBy("_t", "_side", "_tie")
    inside = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = placed.select(
        *keys, "_bucket", "_t", "_row", *[F.sum(s).over(inside).alias(f"_in_{s}") for s in sums],
        *[F.last(v, ignorenulls=True).over(inside).alias(f"_in_{v}") for v in lasts],
        *([F.lead(F.lit(True)).over(ordered).isNull().alias("_end")] if several else []))
    asks = F.col("_row").isNotNull()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    if not several:
        return local.filter(asks).select("_row", "_t", *[zero(f"_in_{s}").alias(s) for s in sums], *[F.col(f"_in_{v}").alias(v) for v in lasts])

    # the last mark of a bucket has its whole sums and last values: the marks are placed and sorted once for both
    local = materialized(local.filter(asks | F.col("_end")), "answered")
    across = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = materialized(local.filter("_end").select(
        *keys, "_bucket", *[F.sum(f"_in_{s}").over(across).alias(f"_pre_{s}") for s in sums],
        *[F.last(f"_in_{v}", ignorenulls=True).over(across).alias(f"_pre_{v}") for v in lasts]), "carried")
    both = local.filter(asks).join(carried, [*keys, "_bucket"], "left")
    return both.select(
        "_row", "_t", *[(zero(f"_in_{s}") + zero(f"_pre_{s}")).alias(s) for s in sums],
        *[F.coalesce(f"_in_{v}", f"_pre_{v}").alias(v) for v in lasts])


def asof_join(
    left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str,
    payload: list[str], *, name: str = "asof", strict: bool = False, tie: str | None = None,
    forward: bool = False, within_us: int | None = None, bucket_us: int | None = None, depth: int = DEPTH,
) -> DataFrame:
    """Each left row with the nearest right row at or before it (survey J7, W2, W4).

    ``strict`` excludes equal times, ``forward`` looks for the first right row
    at or after instead, ``within_us`` blanks matches further away, ``tie``
    decides between right rows of the same time (the greatest wins).  The
    match is a struct column holding ``right_at`` and the payload.
    """
    if forward and tie:
        raise ValueError("a forward lookup takes no tie-break")
    sign = -1 if forward else 1
    match = F.struct(F.col(right_at), *[F.col(p) for p in payload if p != right_at])
    r = right.select(*keys, (micros(right_at) * sign).alias("_t"), F.lit(2 if strict else 0).alias("_side"),
                     (F.col(tie).cast("string") if tie else F.lit("")).alias("_tie"), match.alias("_match"))
    l = left.select(*keys, (micros(left_at) * sign).alias("_t"), F.lit(1).alias("_side"), F.lit("").alias("_tie"),
                    F.struct(*left.columns).alias("_row"))
    found = answer(l.unionByName(r, allowMissingColumns=True), keys, [], ["_match"], bucket_us, depth)
    m = F.col("_match")
    if within_us is not None:
        m = F.when(F.abs(F.col("_t") - micros(m[right_at]) * sign) <= within_us, m)
    return found.select("_row.*", m.alias(name))


def value_parts(value: Column, sign: int = 1) -> list[Column]:
    """Count, sum and sum of squares of a value as exact decimals.

    Six places for the value and twelve for its square: the sums come out the
    same in any order and leave no residue when a value is taken out again.
    """
    v = value.cast("decimal(18,6)")
    return [F.lit(sign).cast("bigint").alias("_n"), (v * sign).cast("decimal(28,6)").alias("_s"),
            (v * v * sign).cast("decimal(38,12)").alias("_q")]


def moments(n="_n", s="_s", q="_q") -> tuple[Column, Column]:
    """Mean and population deviation from the three sums, 0 for no rows."""
    count = F.col(n).cast("double")
    mean = F.coalesce(F.try_divide(F.col(s).cast("double"), count), F.lit(0.0))
    spread = F.coalesce(F.try_divide(F.col(q).cast("double"), count), F.lit(0.0)) - mean * mean
    return mean, F.sqrt(F.greatest(spread, F.lit(0.0)))


def mark(t: Column, side: int, tie: Column | None = None, **values: Column) -> Column:
    """One mark as a struct; absent values must be given as typed nulls."""
    return F.struct(t.alias("_t"), F.lit(side).alias("_side"), (F.lit("") if tie is None else tie).alias("_tie"),
                    *[v.alias(k) for k, v in values.items()])


def open_intervals(
    probes: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str,
    name: str = "open_count", bucket_us: int | None = None, depth: int = DEPTH,
) -> DataFrame:
    """How many intervals hold each probe's time, both ends inclusive (survey J6).

    Starts at or before the probe minus ends before it: a stabbing count
    without forming one probe-interval pair.
    """
    one = F.lit(1).cast("bigint")
    ends = F.filter(
        F.array(mark(micros(start), 0, _open=one), mark(micros(end), 2, _open=-one)), lambda m: m["_t"].isNotNull())
    changes = intervals.select(*keys, F.inline(ends))
    asks = probes.select(*keys, micros(at).alias("_t"), F.lit(1).alias("_side"), F.lit("").alias("_tie"),
                         F.struct(*probes.columns).alias("_row"))
    counted = answer(asks.unionByName(changes, allowMissingColumns=True), keys, ["_open"], [], bucket_us, depth)
    return counted.select("_row.*", F.col("_open").alias(name))
