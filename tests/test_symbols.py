"""Symbol location, content alerts and the text-tree reader."""

import time

from plumbline.functions.locate import python_spans, script_spans
from plumbline.plans import graph, symbols
from plumbline.sources.text_tree import read_tree

PY = '''class Adapter(Base):
    def fetch(self, customer_id):
        # generated-by: claude
        password = "123456"

        return {"id": 1}

async def skipped():
    pass

@decorated
def top():
    return fetch(1)
'''
TS = '''import { a } from "node:fs";
import { view } from "../web/view";

export class Service {
  private items = [{ id: 1 }];

  total(userId: string): number {
    if (!userId) { return 0; }
    return this.items.length; // } not a brace
  }

  async load<T>(key: T) {
    const text = "a } b";
    return text;
  }
}

export default function (x: number) { return x; }
const double = (n: number) => n * 2;
export const wrap = memo((props: { a: string }) => {
  return helper(props.a);
});
const table = { run: function () { return 1; }, stop: () => 2 };
function helper(v: string) { return v; }
'''


def test_python_spans():
    found = [(k, n, a, b) for k, n, a, b, _, _ in python_spans(PY)]
    assert found == [("class", "Adapter", 1, 7), ("function", "fetch", 2, 7), ("function", "top", 12, 14)]
    assert python_spans("x = 1\n") == []


def test_script_spans():
    found = script_spans(TS, "service.ts")
    named = [(k, n) for k, n, *_ in found]
    assert named == [("class", "Service"), ("method", "total"), ("method", "load"), ("function", "service"), ("function", "double"),
                     ("function", "wrap"), ("function", "run"), ("function", "stop"), ("function", "helper")]
    body = {n: TS[s:e] for _, n, _, _, s, e in found}
    assert body["total"].startswith("total(userId") and body["total"].endswith("}") and "not a brace" in body["total"]
    assert body["load"].count("return text") == 1 and body["double"] == "(n: number) => n * 2" and body["stop"] == "() => 2"
    assert body["wrap"].startswith("(props") and body["wrap"].endswith("}")


def test_extract_and_graph(spark):
    files = spark.createDataFrame([("r", "src/domain/service.ts", TS), ("r", "src/infra/adapter.py", PY), ("r", "a.css", "x")],
                                  "repo_id string, file_path string, source string")
    found = symbols.extract(files).collect()
    by_name = {x["name"]: x for x in found}
    assert by_name["fetch"]["symbol_id"] == "src/infra/adapter.py:fetch:2" and by_name["fetch"]["provenance"] == "claude"
    assert by_name["Adapter"]["end_line"] == 7 and by_name["Service"]["module"] == "domain"
    imports = graph.import_edges(files)
    assert sorted(x["edge"] for x in graph.module_edges(imports).filter("file_path like '%.ts'").collect()) == ["domain->pkg:node:fs", "domain->web"]
    assert [x["target_path"] for x in graph.layer_violations(imports).collect()] == ["src/web/view"]
    calls = {(x["source_id"].split(":")[1], x["target_id"].split(":")[1]) for x in graph.call_edges(symbols.extract(files)).collect()}
    assert ("wrap", "helper") in calls and ("top", "fetch") in calls


def test_read_tree_and_content_alerts(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src" / "a.py").write_text(PY)
    (tmp_path / "node_modules" / "b.js").write_text("x")
    (tmp_path / "Dockerfile").write_text("FROM node:latest\nUSER root\n")
    (tmp_path / ".env").write_text("DEBUG=1\ndebug = true\n")
    tree = read_tree(spark, str(tmp_path), "demo")
    assert sorted((x["file_path"], x["language"]) for x in tree.collect()) == [(".env", "config"), ("Dockerfile", "dockerfile"), ("src/a.py", "python")]
    found = {x["file_path"]: (x["category"], x["severity"]) for x in symbols.content_alerts(tree).collect()}
    assert found == {"Dockerfile": ("CONTAINER_RISK", "warn"), ".env": ("DEBUG_CONFIG", "warn")}


def test_long_comments_cost_in_proportion_to_their_length():
    def seconds(lines):
        source = "export class Long {\n  run(x) { return x; }\n" + "    // so many words here\n" * lines + "}\n"
        start = time.process_time()
        assert [(k, n) for k, n, *_ in script_spans(source, "long.ts")] == [("class", "Long"), ("method", "run")]
        return time.process_time() - start

    assert min(seconds(8000) for _ in range(3)) < 16 * min(seconds(1000) for _ in range(3))  # eight times as many lines; 64 if quadratic


def test_words_before_declarations():
    source = ("x.class A {}\nexport default abstract class B {}\n$class C {}\nreclass D {}\nclass E {}\ndeclare class F {}\n"
              "export  async\nfunction g() {}\nmyfunction h() {}\nfunction i() {}\nlet j = () => 1;\noutlet k = () => 1;\n")
    found = {(k, n) for k, n, *_ in script_spans(source, "f.ts")}
    assert {n for k, n in found if k == "class"} == {"B", "E", "F"}
    assert {n for k, n in found if k == "function"} >= {"g", "i", "j"} and ("function", "k") not in found
