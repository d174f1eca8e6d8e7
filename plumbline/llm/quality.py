"""Quality classifier with hierarchical empirical Bayes over sites.

Three kinds of evidence meet in a document's posterior:

1. Its text.  A naive Bayes model over the presence of words and of shape
   features gives log likelihood ratios for quality and for toxicity.  It is
   fitted on at most ``labelled_rows`` labelled documents (chosen by hash) and
   keeps the ``features`` words that tell the classes apart best.
2. Its path, and 3. its host.  Over all documents, each (host, path) counts its
   good documents: a label counts 1, the text model's probability of an
   unlabelled document counts ``soft_weight``.  Host rates shrink toward the
   global rate, path rates toward their host's, with as much weight as the
   spread of the rates supports (method of moments), so that a sparse site
   falls back to what is above it.

The posterior's log odds are those of the path rate plus the text's ratio.
Everything on sites is grouped aggregation; only a few global sums reach the
driver.  ``documents`` has no URL, so its ``source`` is taken as the host and
the language as the path below it.

Defined cases: a null text has no evidence but its site's; a null host or path
is a site of its own; rows without label, or with a null in it, are unlabelled;
several labels of a document count as the lowest quality and highest toxicity;
without any labels every rate is 1/2; repeated rows are scored each; other
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, small_batches, steps, stored

LABELLED_ROWS = 20_000
FEATURES = 5_000
SOFT_WEIGHT = 0.25
#: Documents that must have a feature for it to count.
LEAST_SEEN = 8
#: Bound of a text's log likelihood ratio.
FIRMEST = 12.0
WORD = re.compile(r"\w+")


def features(text: str) -> set[str]:
    """The words of a text, and its shape in coarse steps; shape features start with a blank."""
    found = WORD.findall(text)
    out = set(map(str.lower, found))
    n, letters = max(len(text), 1), sum(map(len, found))
    marks = n - letters - text.count(" ") - text.count("\n")
    upper = sum(map(str.isupper, found))
    out.update((
        f" marks {min(9, 20 * marks // n)}", f" upper {10 * upper // max(len(found), 1)}",
        f" distinct {10 * len(out) // max(len(found), 1)}", f" size {len(found).bit_length()}",
        f" bars {min(9, 50 * text.count('|') // n)}", f" word {min(15, letters // max(len(found), 1))}",
        f" lines {min(9, 100 * text.count(chr(10)) // n)}"))
    return out


def labels_of(labels: DataFrame) -> DataFrame:
    """One complete label per document."""
    whole = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    return whole.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS, most: int = FEATURES) -> dict:
    """Per class: base log odds, and feature -> (ratio if present)."""
    small_batches(docs.sparkSession)
    sample = labels_of(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled_rows)
    # bounded by labelled_rows, at most 20 bytes a row
    known = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(sample), "doc_id")
    schema = pa.schema([("feature", pa.string()), ("n", pa.int64()), ("good", pa.int64()), ("toxic", pa.int64())])

    def count(batches):
        for batch in steps(batches, 64 << 20):
            seen, good, toxic = Counter(), Counter(), Counter()
            for text, q, t in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                found = features(text) | {""}  # the empty feature counts documents
                seen.update(found)
                if q:
                    good.update(found)
                if t:
                    toxic.update(found)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(list(seen.values())), pa.array([good[f] for f in seen]),
                                              pa.array([toxic[f] for f in seen])], schema=schema)

    counts = known.mapInArrow(count, "feature string, n long, good long, toxic long").groupBy("feature").agg(
        F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    counts = counts.where((F.col("n") >= LEAST_SEEN) | (F.col("feature") == ""))
    counts = stored(counts, "features")
    total = counts.where(F.col("feature") == "").first()
    model = {}
    for kind in ("good", "toxic"):
        n, k = (total["n"], total[kind]) if total else (0, 0)
        if not 0 < k < n:
            model[kind] = {}
            continue
        yes, no = (F.col(kind) + 0.5) / (k + 1), (F.col("n") - F.col(kind) + 0.5) / (n - k + 1)
        ratio = F.log(yes / no)
        share = F.col("n") / n  # how far the two classes' shares are apart, in standard errors
        apart = F.abs(F.col(kind) / k - (F.col("n") - F.col(kind)) / (n - k))
        strength = F.when(share >= 1, 0.0).otherwise(apart / F.sqrt(share * (1 - share) * (1 / k + 1 / (n - k))))
        best = counts.where(F.col("feature") != "").select("feature", ratio.alias("ratio"), strength.alias("strength"))
        best = best.where((F.col("strength") >= 5) & ((F.col("ratio") > 0) | F.lit(kind == "good")))  # nothing speaks against toxicity
        best = best.orderBy(F.desc("strength"), "feature").limit(most)
        model[kind] = {r["feature"]: r["ratio"] for r in best.collect()}
    return model


def evidence(docs: DataFrame, model: dict) -> DataFrame:
    """The frame with ``good_ratio`` and ``toxic_ratio`` of its whole texts."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def fill(part):
        out = ([], [])
        for text in part.column(at):
            found = features(text.as_py()) if text.is_valid else set()
            for values, weights in zip(out, (shared.value["good"], shared.value["toxic"])):
                ratio = math.fsum(sorted(weights[f] for f in found & weights.keys()))
                values.append(max(-FIRMEST, min(FIRMEST, ratio)))
        return [pa.array(v, pa.float64()) for v in out]

    return add_columns(docs, [T.StructField("good_ratio", T.DoubleType()), T.StructField("toxic_ratio", T.DoubleType())], fill)


def _weight(groups: DataFrame, n: str, rate: str, center: str) -> float:
    """How many documents the rate above a group is worth: from the spread of the groups' rates beyond chance."""
    p, m = F.col(center), F.col(n)
    s = groups.where(m > 0).agg(F.sum(m * (F.col(rate) - p) ** 2).alias("seen"), F.sum(p * (1 - p)).alias("chance"),
                                F.sum(m * p * (1 - p)).alias("scale")).first()
    if not s["scale"] or s["seen"] is None:
        return 1.0
    between = max(s["seen"] - s["chance"], 0.0) / s["scale"]  # share of the variance that is between groups
    return 1e4 if between <= 1e-4 else min(1e4, max(1.0, 1 / between - 1))


def site_rates(scored: DataFrame, kind: str) -> DataFrame:
    """(host, path, rate): posterior means of all paths, shrunk to their host's and the global rate."""
    paths = scored.groupBy("host", "path").agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col(kind)).alias("k"))
    paths = stored(paths, f"paths-{kind}")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("k").alias("host_k"))
    total = paths.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    base = (total["k"] + 0.5) / (total["n"] + 1) if total["n"] else 0.5
    hosts = hosts.withColumn("base", F.lit(base)).withColumn("own", F.col("host_k") / F.col("host_n"))
    a = _weight(hosts, "host_n", "own", "base")
    hosts = hosts.withColumn("host_rate", (F.col("host_k") + a * base) / (F.col("host_n") + a)).select("host", "host_rate")
    paths = paths.join(hosts, "host").withColumn("own", F.col("k") / F.col("n"))
    b = _weight(paths, "n", "own", "host_rate")
    return paths.select("host", "path", "host_rate", ((F.col("k") + b * F.col("host_rate")) / (F.col("n") + b)).alias("rate"))


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", labelled_rows: int = LABELLED_ROWS) -> DataFrame:
    """doc_id, posteriors of quality and toxicity, the site's rates, and whether the document is kept."""
    model = fit(docs, labels, labelled_rows)
    site = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))
    rows = evidence(docs.select("doc_id", site(host).alias("host"), site(path).alias("path"), "text"), model)
    rows = stored(rows.drop("text"), "evidence")
    own = labels_of(labels)
    known = own.agg(F.avg("quality").alias("good"), F.avg("toxic").alias("toxic")).first()
    odds = lambda p: F.log(p / (1 - p))
    chance = lambda x: 1 / (1 + F.exp(-x))
    firm = lambda p: min(max(0.5 if p is None else p, 0.01), 0.99)
    joined = rows.join(own, "doc_id", "left")
    out = rows
    for kind, label in (("good", "quality"), ("toxic", "toxic")):
        prior = math.log(firm(known[kind]) / (1 - firm(known[kind])))
        counted = joined.select(
            "host", "path", F.when(F.col(label).isNull(), SOFT_WEIGHT).otherwise(1.0).alias("weight"),
            F.coalesce(F.col(label).cast("double"), chance(F.col(f"{kind}_ratio") + prior)).alias(kind))
        rates = site_rates(counted, kind).select("host", "path", F.col("host_rate").alias(f"host_{kind}"), F.col("rate").alias(f"path_{kind}"))
        out = out.join(rates, ["host", "path"], "left")
        out = out.withColumn(f"p_{kind}", chance(odds(F.col(f"path_{kind}")) + F.col(f"{kind}_ratio")))
    return out.select("doc_id", F.col("p_good").alias("p_quality"), F.col("p_toxic"), F.col("host_good").alias("host_quality"),
                      F.col("path_good").alias("path_quality"), ((F.col("p_good") >= 0.5) & (F.col("p_toxic") < 0.5)).alias("keep"))
