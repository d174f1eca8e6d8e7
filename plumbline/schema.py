"""Row types of the domain tables and of the JSON events (survey section 1)."""

from __future__ import annotations

from pyspark.sql import types as T

# fixed values: enumerations carried by the tables
SEVERITIES = ["info", "warn", "error"]
PROVENANCES = ["human", "claude", "codex", "cursor", "unknown"]
ALERT_TYPES = [
    "SEMANTIC_DUPLICATION", "INTENT_DRIFT", "COMPLEXITY_CREEP", "ARCH_VIOLATION", "ARCH_EMBED_DRIFT",
    "ARCH_PRESSURE", "ENTROPY_DRIFT", "VOLATILITY_ZONE", "CONTENT_HEURISTIC",
]
ALERT_STATUSES = ["open", "acknowledged", "resolved"]
REFACTOR_STATUSES = ["proposed", "accepted", "applied", "dismissed"]
PARSER_STATUSES = ["pending", "analyzed", "unsupported", "no_symbols"]
FULL_STATUSES = ["pending", "analyzed", "no_symbols"]
ENTROPY_KEYS = [
    "dependency_entropy", "duplication_entropy", "complexity_entropy", "change_entropy",
    "architecture_entropy", "code_entropy_index",
]
PRESSURE_KEYS = [
    "pressure_change", "pressure_coupling", "pressure_semantic", "pressure_boundary",
    "pressure_entropy", "pressure_volatility", "pressure_index",
]
ARCH_SIGNALS = ["ARCH_PRESSURE", "ARCH_VIOLATION", "ARCH_EMBED_DRIFT"]

EVIDENCE = (
    "struct<filePath:string,symbolId:string,module:string,heuristicCategory:string,"
    "heuristicDrivers:array<string>,neighbours:array<struct<id:string,score:double>>,"
    "graphEdgesAdded:array<string>,graphEdgesRemoved:array<string>,metrics:map<string,double>,diffRef:string>"
)
SYMBOL = (
    "struct<symbolId:string,kind:string,name:string,signature:string,startLine:int,endLine:int,"
    "hash:string,normHash:string,tokensHash:string,modulePath:string,provenance:string,textRef:string,"
    "bodyText:string,imports:array<string>,calls:array<string>>"
)
TABLES = {
    "repos": "repo_id string, name string, kind string, host_path string, root_path string, remote_url string, "
             "default_branch string, watch_enabled boolean, watch_state string, watch_error string, "
             "created_at timestamp, archived_at timestamp",
    "commits": "repo_id string, sha string, parent_sha string, author string, message string, ts timestamp, "
               "provenance_hint string",
    "metrics": "repo_id string, sha string, at timestamp, scope string, subject_id string, key string, "
               "value double, module string, file_path string, provenance string, tags map<string,string>",
    "alerts": f"repo_id string, sha string, at timestamp, severity string, type string, title string, "
              f"evidence {EVIDENCE}, recommendation string, status string, acknowledged_at timestamp, "
              "acknowledged_by string, resolved_at timestamp, resolved_by string, status_updated_at timestamp",
    "gates": "repo_id string, gate_id string, name string, enabled boolean, config string, created_at timestamp",
    "activity": "event_id string, repo_id string, commit_sha string, at timestamp, file_path string, "
                "absolute_path string, language string, change_type string, parser_status string, symbol_count int, "
                "alert_count int, note string, updated_at timestamp, provenance string, telemetry_source string, "
                "telemetry_editor string, telemetry_session_id string",
    "telemetry": "id string, repo_id string, file_path string, absolute_path string, provenance string, "
                 "source string, editor string, session_id string, metadata map<string,string>, "
                 "observed_at timestamp",
    "file_snapshots": "id string, repo_id string, file_path string, absolute_path string, observed_at timestamp, "
                      "content string",
    "alert_comments": "id string, repo_id string, alert_id string, kind string, author string, body string, "
                      "created_at timestamp",
    "alert_refactor_links": "id string, repo_id string, alert_id string, refactor_id string, "
                            "linked_at timestamp, linked_by string",
}
# payloads of the message bus
EVENTS = {
    "files_changed": "schemaVersion int, repoId string, commitSha string, rootPath string, changes array<struct<"
                     "path:string,absolutePath:string,changeType:string,language:string,provenance:string,"
                     "telemetrySource:string,telemetryEditor:string,telemetrySessionId:string>>",
    "commit_detected": "schemaVersion int, repoId string, commitSha string, parentSha string, author string, "
                       "message string, timestamp timestamp, provenanceHint string",
    "symbols_extracted": f"schemaVersion int, repoId string, commitSha string, rootPath string, filePath string, "
                         f"absolutePath string, language string, symbols array<{SYMBOL}>",
    "graph_updated": "schemaVersion int, repoId string, commitSha string, filePath string, moduleName string, "
                     "moduleDependencyCount int, externalDependencyCount int, graphEdgesAdded array<string>, "
                     "graphEdgesRemoved array<string>, graphEdgesCurrent array<string>, symbols array<string>",
    "metrics_written": "schemaVersion int, repoId string, commitSha string, at timestamp, metrics array<struct<"
                       "scope:string,subjectId:string,key:string,value:double,tags:map<string,string>>>",
    "alert_raised": f"schemaVersion int, repoId string, commitSha string, at timestamp, severity string, "
                    f"type string, title string, evidence {EVIDENCE}, recommendation string",
    "agent_telemetry_reported": "schemaVersion int, repoId string, filePath string, absolutePath string, "
                                "provenance string, source string, editor string, sessionId string, "
                                "metadata map<string,string>, observedAt timestamp",
    "repo_registered": "schemaVersion int, repoId string, name string, kind string, hostPath string, "
                       "rootPath string, remoteUrl string, defaultBranch string, watchEnabled boolean, "
                       "watchState string, watchError string, createdAt timestamp",
    "repo_updated": "schemaVersion int, repoId string, name string, kind string, hostPath string, rootPath string, "
                    "remoteUrl string, defaultBranch string, watchEnabled boolean, watchState string, "
                    "watchError string, updatedAt timestamp",
    "repo_deleted": "schemaVersion int, repoId string, deletedAt timestamp",
    "embeddings_upserted": "schemaVersion int, repoId string, commitSha string, upserts array<struct<id:string,"
                           "payload:map<string,string>>>",
    "refactor_refresh_requested": "schemaVersion int, repoId string, reason string, trigger string, "
                                  "requestedAt timestamp",
    "refactor_suggestions_updated": "schemaVersion int, repoId string, count int, updatedAt timestamp",
}


def struct_type(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)
