"""Time-line, spacing and neighbour operators against brute force."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import knn
from plumbline.operators.edges import bucket_entropy, edge_diff
from plumbline.operators.knn import PivotIndex, _best, _same, knn_join
from plumbline.operators.merge import insert_absent, replace_keeping, upsert
from plumbline.operators.running import DAY, HOUR, asof_join, bucketed, open_intervals
from plumbline.operators.spacing import coalesced, keep_spaced, quiet_after, quiet_before
from plumbline.plans import anomaly

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def hot(rng, n, horizon, keys=4):
    """Rows of which most belong to one key."""
    return [("hot" if rng.random() < 0.7 else f"k{rng.randrange(keys)}", rng.randrange(horizon)) for _ in range(n)]


@pytest.mark.parametrize("strict,forward", [(False, False), (True, False), (False, True), (True, True)])
def test_asof_join(spark, strict, forward):
    rng = random.Random(7)
    left = [(i, k, at(s)) for i, (k, s) in enumerate(hot(rng, 300, 4000))]
    right = [(k, at(s), f"{i:04d}") for i, (k, s) in enumerate(hot(rng, 200, 4000))]
    right = list({(k, t): (k, t, v) for k, t, v in right}.values())
    l = spark.createDataFrame(left, "id int, k string, at timestamp")
    r = spark.createDataFrame(right, "k string, at timestamp, v string")
    got = {x["id"]: x["v"] for x in asof_join(l, r, ["k"], "at", "at", ["v"], strict=strict, forward=forward, bucket_us=HOUR // 6).select("id", "asof.v").collect()}
    for i, k, t in left:
        if forward:
            fit = [(u, v) for kk, u, v in right if kk == k and (u > t or (u == t and not strict))]
            want = min(fit)[1] if fit else None
        else:
            fit = [(u, v) for kk, u, v in right if kk == k and (u < t or (u == t and not strict))]
            want = max(fit)[1] if fit else None
        assert got[i] == want


@pytest.mark.parametrize("strict,forward", [(False, False), (True, True)])
def test_asof_join_in_buckets_of_equal_depth(spark, strict, forward):
    """Buckets of 20 marks give the rows of one bucket, ties and null keys included."""
    rng = random.Random(11)
    left = [(i, k, at(s)) for i, (k, s) in enumerate(hot(rng, 400, 900))] + [(1000, None, at(5))]
    right = [(k, at(s), f"{i:04d}") for i, (k, s) in enumerate(hot(rng, 300, 900))]
    right = list({(k, t): (k, t, v) for k, t, v in right}.values())
    l = spark.createDataFrame(left, "id int, k string, at timestamp")
    r = spark.createDataFrame(right, "k string, at timestamp, v string")
    look = lambda depth: {x["id"]: x["v"] for x in asof_join(l, r, ["k"], "at", "at", ["v"], strict=strict, forward=forward, depth=depth).select("id", "asof.v").collect()}
    assert look(20) == look(1 << 18) and len(look(20)) == 401


def test_a_busy_hour_is_several_buckets(spark):
    busy = spark.range(6000).select(F.lit("hot").alias("k"), (F.col("id") % 3600 * 1_000_000).alias("_t"))
    calm = spark.range(50).select(F.lit("calm").alias("k"), (F.col("id") * HOUR * 24).alias("_t"))
    got = {(x["k"], x["_bucket"]): (x["n"], x["a"], x["b"]) for x in bucketed(busy.union(calm), ["k"], 1000).groupBy("k", "_bucket").agg(
        F.count("*").alias("n"), F.min("_t").alias("a"), F.max("_t").alias("b")).collect()}
    assert got["calm", 0][0] == 50 and len([k for k in got if k[0] == "calm"]) == 1
    hot_ones = [x for k, x in sorted(got.items()) if k[0] == "hot"]
    assert len(hot_ones) == 6
    assert sum(n for n, _, _ in hot_ones) == 6000 and max(n for n, _, _ in hot_ones) <= 1200
    assert all(x[2] < y[1] for x, y in zip(hot_ones, hot_ones[1:]))


def test_asof_within(spark):
    l = spark.createDataFrame([(1, at(100)), (2, at(5000))], "id int, at timestamp").withColumn("k", F.lit("a"))
    r = spark.createDataFrame([("a", at(40), 9)], "k string, at timestamp, v int")
    out = asof_join(l, r, ["k"], "at", "at", ["v"], within_us=60_000_000)
    assert {x["id"]: x["v"] for x in out.select("id", "asof.v").collect()} == {1: 9, 2: None}


def test_open_intervals(spark):
    rng = random.Random(3)
    probes = [(i, k, at(s)) for i, (k, s) in enumerate(hot(rng, 200, 5000))]
    spans = [(k, at(s), None if rng.random() < 0.2 else at(s + rng.randrange(1500))) for k, s in hot(rng, 200, 5000)]
    p = spark.createDataFrame(probes, "id int, k string, at timestamp")
    s = spark.createDataFrame(spans, "k string, a timestamp, b timestamp")
    got = {x["id"]: x["open_count"] for x in open_intervals(p, s, ["k"], "at", "a", "b", bucket_us=HOUR // 6).collect()}
    for i, k, t in probes:
        assert got[i] == sum(kk == k and a <= t and (b is None or b >= t) for kk, a, b in spans)


def series(spark, rows):
    df = spark.createDataFrame(rows, "at timestamp, sha string, value double")
    return df.select(F.lit("r").alias("repo_id"), F.lit("module").alias("scope"), F.lit("m").alias("subject_id"), F.lit("k").alias("key"), "at", "sha", "value")


def test_lookbacks_match_brute_force(spark):
    rng = random.Random(11)
    times = rng.sample(range(0, 20 * 86400), 150)
    rows = [(at(t), f"s{i:03d}", round(rng.random() * 100, 2)) for i, t in enumerate(times)]
    rows += [(at(7 * 86400 + rows_t), f"x{i}", 50.0) for i, rows_t in enumerate(times[:20])]  # exactly seven days later
    got = {x["sha"]: x for x in anomaly.lookbacks(series(spark, rows)).collect()}
    for t, sha, _ in rows:
        before = sorted((u, s, v) for u, s, v in rows if u < t)
        window = [v for u, _, v in before if u >= t - dt.timedelta(days=7)]
        g = got[sha]
        assert g["previous_value"] == (before[-1][2] if before else 0.0)
        day = [b for b in sorted((u, s, v) for u, s, v in rows) if b[0] <= t - dt.timedelta(hours=24)]
        assert g["day_before"] == (day[-1][2] if day else 0.0)
        assert g["baseline_samples"] == len(window)
        assert g["baseline_mean"] == pytest.approx(np.mean(window) if window else 0.0, abs=1e-9)
        assert g["baseline_stddev"] == pytest.approx(np.std(window) if window else 0.0, abs=1e-6)


def test_anomaly_golden_cases(spark):
    rows = [(at(3600 * i), f"s{i}", 50.0) for i in range(4)] + [(at(3600 * 5), "now", 60.0)]
    now = [x for x in anomaly.assess(series(spark, rows), anomaly.ENTROPY).collect() if x["sha"] == "now"][0]
    assert (now["anomaly"], now["warn_threshold"], now["error_threshold"], now["z_score"], now["clear_threshold"]) == ("warn", 56.0, 65.0, 4.0, 53.0)
    first = anomaly.assess(series(spark, [(at(0), "a", 80.0)]), anomaly.PRESSURE).first()
    assert (first["anomaly"], first["warn_threshold"], first["error_threshold"], first["z_score"], first["delta"], first["clear_threshold"]) == (
        "warn", 75.0, 85.0, 4.0, 80.0, 30.0)


def greedy(rows, gap_ms):
    kept, last = [], {}
    for i, (k, s, must) in sorted(enumerate(rows), key=lambda e: (e[1][1], not e[1][2], e[0])):
        if must or k not in last or s * 1000 - last[k] >= gap_ms:
            if not (k in last and last[k] == s * 1000):
                kept.append(i)
            last[k] = s * 1000
    return sorted(kept)


@pytest.mark.parametrize("seed,forced", [(1, 0.0), (2, 0.05), (3, 0.3)])
def test_keep_spaced(spark, seed, forced):
    rng = random.Random(seed)
    rows = [(k, s, rng.random() < forced) for k, s in hot(rng, 600, 6 * 3600)]
    df = spark.createDataFrame([(i, k, at(s), m) for i, (k, s, m) in enumerate(rows)], "id int, k string, at timestamp, must boolean")
    got = keep_spaced(df, ["k"], "at", 900_000, tie="id", forced="must", chunk_ms=1_800_000)
    assert sorted(x["id"] for x in got.collect()) == greedy(rows, 900_000)


def test_keep_spaced_timeline(spark):
    """Repeats at 0, 10, 16, 20 minutes: let through, drop, let through, drop."""
    df = spark.createDataFrame([(m, "f", at(60 * m)) for m in (0, 10, 16, 20)], "id int, k string, at timestamp")
    assert sorted(x["id"] for x in keep_spaced(df, ["k"], "at", 900_000, tie="id").collect()) == [0, 16]


@pytest.mark.parametrize("seed", [1, 2])
def test_coalesced_equals_the_timer(spark, seed):
    """Against a walk with one pending timer a key; times in milliseconds, with ties and a row without a time."""
    rng = random.Random(seed)
    rows = [(i, k, s) for i, (k, s) in enumerate(hot(rng, 500, 60_000))]
    rows += [(500, "hot", rows[0][2]), (501, "k0", None)]
    df = spark.createDataFrame([(i, k, None if s is None else T0 + dt.timedelta(milliseconds=s)) for i, k, s in rows], "id int, k string, at timestamp")
    due, want = {}, {}
    for s, i, k in sorted((s, i, k) for i, k, s in rows if s is not None):
        if k in due and s < due[k][0]:
            want[due[k][1]][0] += 1
        else:
            due[k] = (s + 120, i)
            want[i] = [0, T0 + dt.timedelta(milliseconds=s + 120)]
    got = {r["id"]: [r["absorbed"], r["fires_at"]] for r in coalesced(df, ["k"], "at", tie="id").collect()}
    assert got == want


def test_keep_spaced_keeps_every_forced_row_of_a_millisecond(spark):
    """Forced rows of one millisecond all stay; of the others the earliest counts, whatever its id."""
    rows = [(9, 100, False), (1, 200, False), (2, 300, True), (3, 400, True), (4, 1_500_000_000, False), (0, 1_500_000_300, False)]
    df = spark.createDataFrame([(i, "k", T0 + dt.timedelta(microseconds=u), m) for i, u, m in rows], "id int, k string, at timestamp, must boolean")
    assert sorted(x["id"] for x in keep_spaced(df, ["k"], "at", 900_000, tie="id", forced="must").collect()) == [2, 3, 4, 9]
    assert sorted(x["id"] for x in keep_spaced(df, ["k"], "at", 900_000, tie="id").collect()) == [4, 9]
    got = {r["id"]: (r["absorbed"], r["fires_at"]) for r in coalesced(df, ["k"], "at", 900_000, tie="id").collect()}
    assert got == {9: (3, T0 + dt.timedelta(seconds=900)), 4: (1, T0 + dt.timedelta(seconds=2400))}


def test_keep_spaced_over_many_splits(spark):
    """A chunk whose rows come from many splits is walked in one piece, also where small partitions stay apart and entry times are broadcast."""
    n, step = 60_000, 997
    df = spark.range(0, n, 1, 16).select(F.lit("k").alias("k"), "id", F.timestamp_millis(F.lit(1_704_067_200_000) + F.col("id") * 7919 % n * step).alias("at"))
    left, kept = -900_000, []
    for t, i in sorted((i * 7919 % n * step, i) for i in range(n)):
        if t - left >= 900_000:
            left = t
            kept.append(i)
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.autoBroadcastJoinThreshold": "100k"}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        assert sorted(x["id"] for x in keep_spaced(df, ["k"], "at", 900_000, tie="id").collect()) == sorted(kept)
    finally:
        for name in settings:
            spark.conf.unset(name)


@pytest.mark.parametrize("k,floor", [(3, -2.0), (4, 0.9), (50, -2.0)])
def test_best_of_a_block_equals_a_full_sort(k, floor):
    """Ties, copies, a vector without direction, one that is no number, and an id that is there twice."""
    rng = np.random.default_rng(k)
    cand = rng.normal(size=(40, 6))
    cand /= np.sqrt((cand * cand).sum(axis=1, keepdims=True))
    cand[::5], cand[3], cand[7] = cand[0], 0.0, np.nan
    ids = np.array(sorted([f"{i:02d}" for i in range(39)] + ["05"]), dtype=object)
    mine = ids[[0, 3, 5, 6, 10, 12]]
    own = cand[[0, 3, 5, 6, 10, 12]]
    row, place, score = _best(own, cand, cand.astype("float32"), k, floor, _same(mine, ids))
    full = np.round(np.clip(own @ cand.T, -1.0, 1.0), 12)
    want = []
    for i in range(len(own)):
        able = [j for j in range(40) if ids[j] != mine[i] and full[i, j] >= floor]
        want += [(i, j) for j in sorted(able, key=lambda j: (-full[i, j], j))[:k]]
    assert list(zip(row.tolist(), place.tolist())) == want
    assert np.abs(score - full[row, place]).max(initial=0.0) <= 1e-12


def test_throttle_and_debounce(spark):
    df = spark.createDataFrame([(i, "k", at(s)) for i, s in enumerate((0, 1, 2, 10, 11, 30))], "id int, k string, at timestamp")
    assert sorted(x["id"] for x in quiet_before(df, ["k"], "at", 2_000_000).collect()) == [0, 3, 5]
    assert sorted((x["id"], x["burst_size"]) for x in quiet_after(df, ["k"], "at", "2 seconds", "id").collect()) == [(2, 3), (4, 2), (5, 1)]


@pytest.mark.parametrize("min_score", [None, 0.3])
def test_knn_matches_brute_force(spark, min_score):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 8))
    v = np.vstack([base[i % 6] + rng.normal(scale=0.4, size=8) for i in range(120)])
    rows = [(f"{i:03d}", "a" if i % 3 else "b", [float(x) for x in v[i]], f"h{i % 10}") for i in range(120)]
    df = spark.createDataFrame(rows, "id string, g string, v array<double>, m string")
    out = knn_join(df, df, 4, id="id", vec="v", group=["g"], min_score=min_score, mark="m", block_rows=16).collect()
    got = {}
    for x in out:
        got.setdefault(x["query_id"], []).append((x["rank"], x["neighbour_id"], x["neighbour_mark"]))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    sim = np.round(unit @ unit.T, 12)
    for i, (name, g, _, _) in enumerate(rows):
        others = [(-sim[i, j], rows[j][0], rows[j][3]) for j in range(120) if j != i and rows[j][1] == g and (min_score is None or sim[i, j] >= min_score)]
        want = [(n, m) for _, n, m in sorted(others)[:4]]
        assert [(n, m) for _, n, m in sorted(got.get(name, []))] == want


def test_edges(spark):
    old = spark.createDataFrame([("f", "a->b"), ("f", "a->c")], "f string, edge string")
    new = spark.createDataFrame([("f", "a->c"), ("f", "a->d"), ("f", "a->d")], "f string, edge string")
    assert sorted((x["edge"], x["change"]) for x in edge_diff(old, new, ["f"]).collect()) == [("a->b", "removed"), ("a->d", "added")]
    counts = spark.createDataFrame([("m", "x")] * 3 + [("m", "y")] + [("n", "x")], "k string, t string")
    got = {x["k"]: x["entropy"] for x in bucket_entropy(counts, ["k"], "t").collect()}
    assert got["m"] == pytest.approx(0.811278, abs=1e-6) and got["n"] == 0.0


def test_merges(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, v string, ver int")
    change = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id int, v string, ver int")
    assert {x["id"]: x["v"] for x in upsert(base, change, ["id"], ["ver"]).collect()} == {1: "a", 2: "d", 3: "e"}
    nulls = spark.createDataFrame([(1, None, 5)], "id int, s string, n int")
    more = spark.createDataFrame([(1, None, 6), (1, "x", 7), (1, "x", 8)], "id int, s string, n int")
    assert [(x["s"], x["n"]) for x in insert_absent(nulls, more, ["id", "s"], ["n"]).collect()] == [("x", 7)]
    new = spark.createDataFrame([(1, "proposed"), (2, "proposed")], "id int, status string")
    old = spark.createDataFrame([(1, "accepted"), (3, "applied")], "id int, status string")
    assert {x["id"]: x["status"] for x in replace_keeping(new, old, ["id"], "status", ["accepted", "applied"]).collect()} == {1: "accepted", 2: "proposed"}


def test_hot_key_is_split(spark):
    """A series far longer than one bucket runs in more than one window partition."""
    df = spark.range(20_000).select(F.lit("hot").alias("k"), (F.lit(T0).cast("timestamp") + F.make_dt_interval(secs=F.col("id") * 60)).alias("at"), F.col("id").alias("v"))
    out = asof_join(df, df, ["k"], "at", "at", ["v"], strict=True, bucket_us=DAY)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" in plan and "_bucket" in plan
    assert out.filter(F.coalesce("asof.v", F.lit(-1)) != F.col("v") - 1).count() == 0


def clustered(n, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 50, 16))
    v = np.vstack([centres[i % len(centres)] + rng.normal(scale=0.05, size=16) for i in range(n)])
    v[:3] = 0.0  # no direction: score 0 with all
    v[3:9] = v[9]  # equal vectors
    return v


def brute_neighbours(v, k):
    size = np.linalg.norm(v, axis=1, keepdims=True)
    unit = np.divide(v, size, out=np.zeros_like(v), where=size > 0)
    sim = np.round(np.clip(unit @ unit.T, -1.0, 1.0), 12)
    return {f"{i:05d}": [f"{j:05d}" for j in sorted((j for j in range(len(v)) if j != i), key=lambda j: (-sim[i, j], j))[:k]] for i in range(len(v))}


def test_pivot_index_is_exact_and_visits_few_segments(spark):
    seen = {}
    for n in (500, 2000):
        v = clustered(n)
        df = spark.createDataFrame([(f"{i:05d}", "g", [float(x) for x in v[i]]) for i in range(n)], "id string, g string, v array<double>")
        got = {}
        for x in knn_join(df, df, 5, id="id", vec="v", group=["g"], block_rows=64).collect():
            got.setdefault(x["query_id"], {})[x["rank"]] = x["neighbour_id"]
        assert {q: [r[i] for i in sorted(r)] for q, r in got.items()} == brute_neighbours(v, 5)
        rows = df.select(F.col("id").alias("_id"), F.col("v").alias("_v"))
        index = PivotIndex(rows, n, 64)
        placed = rows.withColumn("_at", index.place("_v"))
        index.measure(placed)
        asked = placed.select("_v", F.col("_at.segment").alias("_cell"), F.lit(0.97).alias("_bound"))
        seen[n] = asked.agg(F.sum(F.size(index.visits("_v", "_bound", "_cell")))).first()[0] / n
        assert seen[n] < 0.35 * index.segment.max()
    assert seen[2000] < 2.5 * seen[500] + 1


def test_knn_of_few_queries_and_two_frames(spark):
    v = clustered(300, 8)
    df = spark.createDataFrame([(f"{i:05d}", "g" if i % 2 else None, [float(x) for x in v[i]]) for i in range(300)], "id string, g string, v array<double>")
    some = df.filter("id < '00040'")
    pick = lambda block: sorted(map(tuple, knn_join(some, df, 3, id="id", vec="v", group=["g"], block_rows=block, min_score=0.5).collect()))
    assert pick(32) == pick(10_000)
    assert knn_join(df.limit(0), df, 3, id="id", vec="v", group=["g"], block_rows=32).count() == 0
    assert knn_join(df, df.limit(0), 3, id="id", vec="v", group=["g"], block_rows=32).count() == 0


@pytest.mark.parametrize("k", [1, 3])
def test_bounds_of_each_row_leave_the_best_as_they_are(k):
    r = np.random.default_rng(5)
    cand = knn._unit(np.round(r.normal(size=(300, 8)), 1))
    own = cand[::7]
    want = _best(own, cand, cand.astype("float32"), k, -2.0, None)
    least = np.array([want[2][want[0] == i].min() for i in range(len(own))])
    found = _best(own, cand, cand.astype("float32"), k, least, None)
    assert all((a == b).all() for a, b in zip(want, found))


def test_angles_are_held_for_a_bounded_number_of_rows(monkeypatch):
    monkeypatch.setattr(knn, "SLAB", 100)
    vectors = pd.Series(list(np.random.default_rng(2).normal(size=(95, 4))))
    pivots = knn._unit(np.random.default_rng(3).normal(size=(10, 4)))
    parts = list(knn._slabs(vectors, pivots))
    assert all(angles.size <= 100 for _, angles in parts)
    assert (np.concatenate([angles for _, angles in parts]) == knn._angles(vectors, pivots)).all()


@pytest.mark.parametrize("kind", ["float32", "float64"])
def test_packed_vectors_are_the_same_numbers(kind):
    r = np.random.default_rng(4)
    counts = np.where(r.random(384) < 0.3, r.integers(-9, 10, 384), 0)
    vectors = [counts / np.sqrt((counts * counts).sum()), r.normal(size=384), np.zeros(384), np.zeros(0), np.array([np.nan, 0.0, np.inf, 1.0]),
               np.repeat(r.normal(size=400), 2), np.full(1000, 1 / 3), np.eye(1, 300, 299)[0]]
    for v in vectors:
        v = v.astype(kind)
        assert knn._unpack(knn._pack(v)).tobytes() == v.astype("float64").tobytes()
    assert len(knn._pack(vectors[0].astype(kind))) < 384


def test_vectors_are_not_sent_once_for_each_segment(spark, monkeypatch):
    """No segment is ruled out; what all tasks get, with all repeats, grows with the blocks of candidates, which have several segments."""
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps

    sent = []

    def apply(self, *a, f=PandasCogroupedOps.applyInPandas):
        sent.extend(side._df.count() for side in (self._gd1, self._gd2))
        return f(self, *a)

    monkeypatch.setattr(PandasCogroupedOps, "applyInPandas", apply)
    v = np.random.default_rng(9).normal(size=(600, 16))
    df = spark.createDataFrame([(f"{i:05d}", "g", [float(x) for x in v[i]]) for i in range(600)], "id string, g string, v array<double>")
    got = {}
    for x in knn_join(df, df, 5, id="id", vec="v", group=["g"], block_rows=32).collect():
        got.setdefault(x["query_id"], {})[x["rank"]] = x["neighbour_id"]
    assert {q: [r[i] for i in sorted(r)] for q, r in got.items()} == brute_neighbours(v, 5)
    assert sum(sent) < 18 * 600


def test_copies_of_a_block_leave_the_best_as_they_are():
    """Many equal vectors, ids that are there twice, two cells of which some queries visit one; scores and order of a full sort."""
    r = np.random.default_rng(12)
    v = np.round(r.normal(size=(90, 6)), 1)
    v[20:70] = v[20]
    ids = [f"{i:03d}" for i in range(85)] + ["022", "022", "021", "001", "084"]
    cell = np.where(np.arange(90) % 3 == 0, 4, 2)
    cell[20:70] = 2
    rows = pd.DataFrame({"_id": ids, "_v": [knn._pack(x) for x in v], "_m": None, "_cell": cell}).sample(frac=1, random_state=1)
    asked = rows.drop(columns="_cell").assign(_cells=[np.array([2, 4] if i % 2 else [2]) for i in range(90)])
    got = {}
    for x in knn._pairs(asked, rows, 4, -2.0, False).itertuples():
        got.setdefault(x.query_id, []).append((x.neighbour_id, round(x.score, 10)))
    unit = dict(zip(rows.index, knn._matrix(rows["_v"])))
    want = {}
    for q in asked.index:
        able = [(-round(float(np.clip(unit[q] @ unit[c], -1, 1)), 12), rows["_id"][c]) for c in rows.index if rows["_id"][c] != asked["_id"][q] and rows["_cell"][c] in asked["_cells"][q]]
        want.setdefault(asked["_id"][q], []).extend((n, round(-s, 10)) for s, n in sorted(able)[:4])
    assert {q: sorted(x) for q, x in got.items()} == {q: sorted(x) for q, x in want.items()}
