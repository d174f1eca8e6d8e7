"""Domain tables derived from the generic fixture tables.

Every table is a deterministic projection of the given parquet files; the
checks repeat the same projections in SQL.  ``as_of`` stands in for the wall
clock.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import paths
from .spread import spread

AS_OF = "2024-01-31 00:00:00"
MODULES = ["domain", "web", "infra", "shared", "core", "jobs"]
EXTENSIONS = [".ts", ".py", ".css", ".json", ".md", ".js", ".go"]
CATEGORIES = ["SECRET_PLACEHOLDER", "LOCAL_ENDPOINT", "DEBUG_CONFIG", ""]
REFACTOR_TYPES = ["DEDUPE_CLUSTER", "INVERT_BOUNDARY", "EXTRACT_MODULE"]


def pick(values: list[str], index) -> Column:
    """The value at a zero-based position."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def text(c) -> Column:
    return c.cast("string")


class Workspace:
    """Lazy domain tables over one folder of fixture tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    @property
    def as_of(self) -> Column:
        return F.lit(AS_OF).cast("timestamp")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        e = spread(self.table("events")).select(
            "event_id", F.col("ts").cast("timestamp").alias("at"), "user_id", "event_type", "value", k.alias("k"),
            F.concat(F.lit("repo-"), text(F.col("user_id") % 10)).alias("repo_id"),
            pick(MODULES, F.floor(F.col("user_id") / 10) % 6).alias("module"),
        )
        k = F.col("k")
        path = F.concat(F.lit("src/"), F.col("module"), F.lit("/f"), text(k % 7), pick(EXTENSIONS, k % 7))
        e = e.withColumn("file_path", path)
        return e.select(
            "*",
            F.concat("file_path", F.lit(":fn"), text(k % 4), F.lit(":"), text(k % 4 * 10 + 1)).alias("symbol_id"),
            F.concat(F.lit("c"), text(F.floor(F.col("event_id") / 5))).alias("sha"),
            pick(S.PROVENANCES, k % 5).alias("provenance"),
        )

    @cached_property
    def repos(self) -> DataFrame:
        n = F.col("n_nationkey")
        local = n % 3 != 0
        enabled = n % 4 != 3
        return self.table("nation").select(
            F.concat(F.lit("repo-"), text(n)).alias("repo_id"), F.col("n_name").alias("name"),
            F.when(local, "local").otherwise("remote").alias("kind"),
            F.when(local, F.concat(F.lit("/home/dev/"), F.col("n_name"))).alias("host_path"),
            F.when(local, F.concat(F.lit("/host-repos/"), F.col("n_name"))).alias("root_path"),
            F.when(~local, F.concat(F.lit("ssh://git/"), F.col("n_name"))).alias("remote_url"),
            F.lit("main").alias("default_branch"), enabled.alias("watch_enabled"),
            F.when(~enabled, "inactive").when(n % 7 == 0, "blocked").when(n % 2 == 0, "active").otherwise("pending")
            .alias("watch_state"),
            F.lit(None).cast("string").alias("watch_error"),
            (F.lit("2023-12-01").cast("timestamp") + F.make_dt_interval(n)).alias("created_at"),
            F.when(n % 5 == 4, F.lit("2024-01-10").cast("timestamp")).alias("archived_at"),
        )

    @cached_property
    def metrics(self) -> DataFrame:
        """One pass over the events; each gives up to four readings.

        An event is dealt out to the numbers of its scopes and every column is told from the
        number, so that a plan computes the columns and scopes it asks for and no others.
        """
        e, k, kind, v = self.events.filter(F.col("event_type") != "error"), F.col("k"), F.col("event_type"), F.col("value")
        numbers = lambda n: F.array(*[F.lit(i) for i in range(n)])
        dealt = e.withColumn("_scope", F.explode(
            F.when(kind == "purchase", numbers(4)).when(kind == "signup", numbers(3)).otherwise(numbers(2))))
        symbol, module, repo = (F.col("_scope") == i for i in range(3))
        target = F.when(k % 4 == 0, F.concat(F.lit("pkg:lib"), text(k % 3))).otherwise(pick(MODULES, k % 6))

        symbol_key = (
            F.when(kind == "click", "cyclomatic").when(kind == "view", "line_count")
            .when(kind == "purchase", "ai_risk_score").otherwise("nesting_depth"))
        symbol_value = (
            F.when(kind == "click", F.floor(v / 8) + 1).when(kind == "view", F.floor(v) + 1)
            .when(kind == "purchase", F.least(F.lit(100.0), v)).otherwise(F.floor(v / 40)))
        module_key = (
            F.when(kind == "click", "code_entropy_index").when(kind == "view", "pressure_index")
            .when(kind == "purchase", pick(S.ENTROPY_KEYS[:5], k % 5)).otherwise(pick(S.PRESSURE_KEYS[:6], k % 6)))
        repo_key = (
            F.when(kind == "purchase", pick(["pressure_boundary", "pressure_coupling", "pressure_semantic",
                                             "pressure_volatility", "dependency_entropy"], k % 5))
            .when(k % 2 == 0, "code_entropy_index").otherwise("pressure_index"))
        module_tags = F.create_map(F.lit("moduleDependencyCount"), text(k % 12), F.lit("externalDependencyCount"), text(k % 5))
        boundary_tags = F.create_map(
            F.lit("sourceModule"), F.col("module"), F.lit("targetModule"), target,
            F.lit("edgeAdded"), F.when(k % 3 == 0, "1").otherwise("0"),
            F.lit("externalTarget"), F.when(k % 4 == 0, "1").otherwise("0"))
        return dealt.select(
            "repo_id", "sha", "at",
            F.when(symbol, "symbol").when(module, "module").when(repo, "repo").otherwise("boundary").alias("scope"),
            F.when(symbol, F.col("symbol_id")).when(module, F.col("module")).when(repo, F.col("repo_id"))
            .otherwise(F.concat("module", F.lit("->"), target)).alias("subject_id"),
            F.when(symbol, symbol_key).when(module, module_key).when(repo, repo_key).otherwise("pressure_index").alias("key"),
            F.when(symbol, symbol_value.cast("double")).otherwise(F.least(F.lit(100.0), v * 0.5 + 10)).alias("value"),
            F.when(~repo, F.col("module")).alias("module"), F.when(symbol, F.col("file_path")).alias("file_path"),
            F.when(symbol, F.col("provenance")).alias("provenance"),
            F.when(module, module_tags).when(~symbol & ~repo, boundary_tags)
            .otherwise(F.create_map().cast("map<string,string>")).alias("tags"))

    @cached_property
    def alerts(self) -> DataFrame:
        e, k = self.events.filter(F.col("event_type") == "error"), F.col("k")
        kind = pick(S.ALERT_TYPES, F.col("event_id") % 9)
        status = pick(S.ALERT_STATUSES, k % 3)
        e = e.withColumn("type", kind).withColumn("status", status)
        edges = F.when(
            F.col("type") == "ARCH_VIOLATION",
            F.array(F.concat(F.lit("src/domain/f"), text(k % 3), F.lit(".ts -> src/"),
                             pick(["web", "infra"], k % 2), F.lit("/f"), text(k % 2), F.lit(".ts"))),
        )
        near = F.when(
            F.col("type") == "SEMANTIC_DUPLICATION",
            F.array(F.struct(F.concat(F.lit("n"), text(k)).alias("id"), (k / 100.0).alias("score"))),
        )
        listed = F.when(
            F.col("type") == "CONTENT_HEURISTIC",
            F.when(k % 2 == 0, F.array(F.lit("todo x2"), F.lit("placeholder x1"))))
        evidence = F.struct(
            F.when(k % 8 != 0, F.col("file_path")).alias("filePath"),
            F.when(k % 16 != 0, F.col("symbol_id")).alias("symbolId"),
            F.when(k % 4 != 0, F.col("module")).alias("module"),
            F.when(F.col("type") == "CONTENT_HEURISTIC", pick(CATEGORIES, k % 4)).alias("heuristicCategory"),
            listed.alias("heuristicDrivers"), near.alias("neighbours"), edges.alias("graphEdgesAdded"),
            F.lit(None).cast("array<string>").alias("graphEdgesRemoved"),
            F.create_map(F.lit("code_entropy_index"), F.col("value"), F.lit("previous_entropy_index"), F.lit(10.0),
                         F.lit("pressure_index"), F.col("value"), F.lit("pressure_delta_24h"), k.cast("double"))
            .alias("metrics"),
            F.lit(None).cast("string").alias("diffRef"),
        )
        done = F.col("status") != "open"
        return e.select(
            "repo_id", "sha", "at",
            F.when(F.col("value") > 80, "error").when(F.col("value") > 30, "warn").otherwise("info").alias("severity"),
            "type", F.concat("type", F.lit(" in "), "module").alias("title"), evidence.alias("evidence"),
            F.concat(F.lit("Review changes in "), "file_path", F.lit(": fake secret placeholder, tbd x"),
                     text(k % 3), F.lit(".")).alias("recommendation"),
            "status",
            F.when(done, F.col("at") + F.expr("INTERVAL 1 HOUR")).alias("acknowledged_at"),
            F.when(done, F.lit("ops")).alias("acknowledged_by"),
            F.when(F.col("status") == "resolved", F.col("at") + F.expr("INTERVAL 2 HOURS")).alias("resolved_at"),
            F.when(F.col("status") == "resolved", F.lit("ops")).alias("resolved_by"),
            F.when(done, F.col("at") + F.expr("INTERVAL 2 HOURS")).alias("status_updated_at"),
        )

    @cached_property
    def activity(self) -> DataFrame:
        k = F.col("k")
        none = F.lit(None).cast("string")
        return self.events.select(
            F.concat(F.lit("a"), text(F.col("event_id"))).alias("event_id"), "repo_id", F.col("sha").alias("commit_sha"),
            "at", "file_path", F.concat(F.lit("/host-repos/"), "repo_id", F.lit("/"), "file_path").alias("absolute_path"),
            F.when(k % 11 != 0, paths.language("file_path")).alias("language"),
            pick(["added", "modified", "deleted"], k % 3).alias("change_type"),
            pick(S.PARSER_STATUSES, k % 4).alias("parser_status"), k.alias("symbol_count"),
            F.when(F.col("event_type") == "error", 1).otherwise(0).alias("alert_count"),
            none.alias("note"), F.col("at").alias("updated_at"), "provenance",
            none.alias("telemetry_source"), none.alias("telemetry_editor"), none.alias("telemetry_session_id"),
        )

    @cached_property
    def telemetry(self) -> DataFrame:
        e, k = self.events.filter(F.col("event_type") == "signup"), F.col("k")
        shared = F.concat(F.lit("src/"), "module", F.lit("/index.ts"))
        return e.select(
            F.concat(F.lit("t"), text(F.col("event_id"))).alias("id"), "repo_id",
            F.when(k % 3 != 0, shared).otherwise("elsewhere.ts").alias("file_path"),
            F.concat(F.lit("/host-repos/"), "repo_id", F.lit("/"), shared).alias("absolute_path"), "provenance",
            F.lit("editor").alias("source"), pick(["vim", "code"], k % 2).alias("editor"),
            F.when(k % 3 != 1, F.concat(F.lit("s"), text(k % 10))).alias("session_id"),
            F.create_map().cast("map<string,string>").alias("metadata"), F.col("at").alias("observed_at"),
        )

    @cached_property
    def changes(self) -> DataFrame:
        """File changes seen by the watcher."""
        e = self.events.filter(F.col("event_type") == "view")
        shared = F.concat(F.lit("src/"), "module", F.lit("/index.ts"))
        return e.select(
            F.col("event_id").alias("change_id"), "repo_id", F.col("sha").alias("commit_sha"), "at",
            shared.alias("file_path"),
            F.concat(F.lit("/host-repos/"), "repo_id", F.lit("/"), shared).alias("absolute_path"),
            pick(["added", "modified", "deleted"], F.col("k") % 3).alias("change_type"),
        )

    @cached_property
    def snapshots(self) -> DataFrame:
        e, k, v = self.events.filter(F.col("event_type") == "purchase"), F.col("k"), F.col("value")
        d = lambda c: c.cast("double")
        signature = F.struct(
            F.struct((k % 3).cast("bigint").alias("archViolations"), (k % 12).cast("bigint").alias("moduleDependencyCount"),
                     (k % 5).cast("bigint").alias("externalDependencyCount")).alias("graph"),
            F.struct(d(k % 10 / 10.0).alias("aiEditRatio"), (k % 4).cast("bigint").alias("duplicationAlerts"),
                     k.cast("bigint").alias("symbolCount")).alias("semantic"),
            F.struct(F.least(F.lit(100.0), v).alias("entropyIndex"), d(k).alias("pressureIndex"),
                     d(k % 20).alias("duplicationEntropy"), d(k % 30).alias("architectureEntropy")).alias("health"),
            F.struct(d(k % 9).alias("avgCyclomatic"), d(k % 25).alias("maxCyclomatic")).alias("complexity"),
            F.struct((k % 6).cast("bigint").alias("churn24h"), (k % 2).cast("bigint").alias("volatilityAlerts"))
            .alias("volatility"),
        )
        whole = k % 2 == 0
        return e.select(
            "repo_id", "sha", "at", F.when(whole, "repo").otherwise("module").alias("scope"),
            F.when(whole, F.col("repo_id")).otherwise(F.col("module")).alias("subject_id"), signature.alias("signature"),
        )

    @cached_property
    def incidents(self) -> DataFrame:
        e, k, v = self.events.filter(F.col("event_type") == "error"), F.col("k"), F.col("value")
        ends = F.when(k % 4 != 0, F.col("at") + F.make_dt_interval(mins=F.floor(v * 10).cast("int")))
        whole = k % 5 == 0
        health = lambda e_, p_: F.struct(F.struct(e_.cast("double").alias("entropyIndex"),
                                                  p_.cast("double").alias("pressureIndex")).alias("health"))
        return e.select(
            "repo_id", F.concat(F.lit("i"), text(F.col("event_id"))).alias("incident_id"),
            pick(["ENTROPY_DRIFT", "ARCH_PRESSURE"], k % 2).alias("type"),
            F.when(whole, "repo").otherwise("module").alias("scope"),
            F.when(whole, F.col("repo_id")).otherwise(F.col("module")).alias("subject_id"),
            F.when(ends.isNull(), "open").otherwise("closed").alias("status"),
            F.when(v > 80, "error").otherwise("warn").alias("severity"),
            F.col("at").alias("opened_at"), F.coalesce(ends, F.col("at")).alias("updated_at"), ends.alias("closed_at"),
            F.col("sha").alias("opened_sha"),
            F.concat(F.lit("opened "), text(k)).alias("opened_alert_title"),
            F.concat(F.lit("latest "), text(k)).alias("latest_alert_title"),
            health(F.least(F.lit(100.0), v), k).alias("pre_signature"),
            health(F.least(F.lit(100.0), v), k + 1).alias("latest_signature"),
            F.when(ends.isNotNull(), health(F.least(F.lit(100.0), v / 2), k - 10)).alias("post_signature"),
            F.when(ends.isNotNull(), F.struct(
                F.lit("returned_to_baseline").alias("reason"),
                F.when(k % 3 == 0, pick(REFACTOR_TYPES, k % 3)).alias("refactorType"),
                F.when(k % 3 == 0, F.col("module")).alias("refactorTarget"),
                F.when(k % 3 == 0, F.lit(0.5)).alias("refactorConfidence"),
                F.when(k % 3 == 0, F.lit("applied")).alias("refactorStatus"))).alias("resolution"),
        )

    @cached_property
    def refactors(self) -> DataFrame:
        o = F.col("o_orderkey")
        module = pick(MODULES, o % 6)
        kind = pick(REFACTOR_TYPES, o % 3)
        status = pick(S.REFACTOR_STATUSES, F.floor(o / 6) % 4)
        edge = F.concat(module, F.lit("->"), pick(MODULES, F.floor(o / 7) % 6))
        return self.table("orders").select(
            F.concat(F.lit("repo-"), text(F.col("o_custkey") % 10)).alias("repo_id"),
            F.concat(F.lit("rfx_"), text(o)).alias("id"), F.col("o_orderdate").cast("timestamp").alias("at"),
            pick(["file", "boundary", "module"], o % 3).alias("scope"),
            F.when(o % 3 == 0, F.concat(F.lit("src/"), module, F.lit("/f0.ts"))).when(o % 3 == 1, edge).otherwise(module)
            .alias("target"),
            kind.alias("type"), F.least(F.lit(0.96), F.col("o_totalprice") / 600000.0).alias("confidence"),
            F.struct((-(o % 30)).cast("double").alias("entropyDelta"), (-(o % 40)).cast("double").alias("pressureDelta"),
                     (-(o % 5)).cast("double").alias("duplicationDelta"), (-(o % 6)).cast("double").alias("couplingDelta"))
            .alias("impact"),
            F.struct(F.array(F.concat(F.lit("src/"), module, F.lit("/f0.ts"))).alias("files"),
                     F.array(module).alias("modules"), F.array(edge).alias("edgesAdded")).alias("entities"),
            status.alias("status"),
        )

    @cached_property
    def commits(self) -> DataFrame:
        o = self.table("orders")
        return o.select(
            F.concat(F.lit("repo-"), text(F.col("o_custkey") % 10)).alias("repo_id"),
            F.concat(F.lit("o"), text(F.col("o_orderkey"))).alias("sha"),
            F.concat(F.lit("o"), text(F.col("o_orderkey") - 1)).alias("parent_sha"),
            F.concat(F.lit("dev"), text(F.col("o_custkey"))).alias("author"), F.col("o_orderpriority").alias("message"),
            F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_orderstatus").alias("provenance_hint"),
        )

    @cached_property
    def edges(self) -> DataFrame:
        """File-level dependency edges with the time they were seen."""
        e, k = self.events.filter(F.col("event_type") == "purchase"), F.col("k")
        target = F.when(k % 4 == 0, F.concat(F.lit("pkg:lib"), text(k % 3))).otherwise(pick(MODULES, k % 6))
        return e.select("repo_id", "module", "file_path", "at", F.concat("module", F.lit("->"), target).alias("edge"))

    @cached_property
    def pages(self) -> DataFrame:
        return spread(self.table("pages"))

    @cached_property
    def page_files(self) -> DataFrame:
        """Pages as files: path below the host, html as text."""
        host = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
        path = F.regexp_extract("url", "^https?://[^/?#]+/([^?#]*)", 1)
        return self.pages.select(
            "page_id", host.alias("repo_id"), F.concat(F.lit("src/"), path).alias("file_path"), F.col("html").alias("source"))

    @cached_property
    def documents(self) -> DataFrame:
        return spread(self.table("documents"))

    @cached_property
    def vectors(self) -> DataFrame:
        v = F.col("vec_id")
        return self.table("embeddings").select(
            text(v).alias("id"), F.concat(F.lit("repo-"), text(v % 3)).alias("repo_id"),
            F.concat(F.lit("m"), text(F.col("label"))).alias("module"), F.concat(F.lit("h"), text(v % 50)).alias("norm_hash"),
            pick(S.PROVENANCES, v % 5).alias("provenance"), F.col("embedding").alias("vector"), "vec_id",
        )

    @cached_property
    def python_sources(self) -> DataFrame:
        """Every document wrapped as a small Python file, text as method body."""
        d = F.col("doc_id")
        body = F.concat(F.lit("        "), F.replace(F.col("text"), F.lit("\n"), F.lit("\n        ")))
        source = F.concat(
            F.lit("from \"./base\" import Base\nclass Doc"), text(d), F.lit("(Base):\n    def run_"), text(d),
            F.lit("(self):\n"), body, F.lit("\n\ndef tail_"), text(d), F.lit("(x):\n    return run_"), text(d),
            F.lit("(x)\n"))
        return self.documents.select(
            "doc_id", F.concat(F.lit("repo-"), text(d % 10)).alias("repo_id"),
            F.concat(F.lit("src/"), "lang", F.lit("/d"), text(d), F.lit(".py")).alias("file_path"), source.alias("source"))

    @cached_property
    def script_sources(self) -> DataFrame:
        """Every document, whole, as comment lines inside a small TypeScript class and function."""
        d = F.col("doc_id")
        note = F.regexp_replace("text", "\r\n|\r|\n", "\n    // ")
        source = F.concat(
            F.lit("import { base } from \"../base\";\n\nexport class Doc"), text(d), F.lit(" {\n  run(x: number) {\n    // "),
            note, F.lit("\n    if (x > 0) { return base(x); }\n    return 0;\n  }\n}\n\nexport const tail"), text(d),
            F.lit(" = (x: number) => {\n  return run(x) ? 1 : 0;\n};\n"))
        return self.documents.select(
            "doc_id", F.concat(F.lit("repo-"), text(d % 10)).alias("repo_id"),
            F.concat(F.lit("src/"), "lang", F.lit("/d"), text(d), F.lit(".ts")).alias("file_path"), source.alias("source"))
