"""A request/response façade: newline-delimited JSON in, JSON out, around the library. Runs on the driver.

A request is {"type", "id", "arguments"}; a response {"type": "response", "request_seq", "command", "success", "body" or
"message"}.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from .operators import compare, sinks
from .patterns.language import PatternError, parse
from .sources import readers


@dataclass
class Server:
    spark: SparkSession
    graphs: dict[str, compare.CallGraph] = field(default_factory=dict)
    options: dict = field(default_factory=dict)
    running: bool = True

    def commands(self) -> dict[str, Callable[[dict], object]]:
        return {
            "options": self.set_options, "reset": self.reset, "load": self.load, "callgraph": self.call_graph, "compare": self.compare,
            "files": self.files, "diagnostics": self.diagnostics, "pattern": self.pattern, "exit": self.stop,
        }

    def set_options(self, a: dict):
        self.options |= a
        return self.options

    def reset(self, a: dict):
        self.graphs.clear()
        self.options.clear()

    def load(self, a: dict):
        self.graphs[a["name"]] = readers.call_graph(self.spark, a["path"])

    def _graph(self, name: str) -> compare.CallGraph:
        if name not in self.graphs:
            raise ValueError(f"no call graph named {name} is loaded")
        return self.graphs[name]

    def call_graph(self, a: dict):
        g = self._graph(a["name"])
        return json.loads(sinks.call_graph_json(g.files, g.functions, g.calls, g.fun2fun, g.call2fun).first()["json"])

    def compare(self, a: dict):
        return compare.compare(self._graph(a["first"]), self._graph(a["second"])).first().asDict()

    def files(self, a: dict):
        return sorted(r["path"] for r in readers.source_files(self.spark, a["root"], a.get("exclude")).select("path").collect())

    def diagnostics(self, a: dict):
        g = self._graph(a["name"])
        return sinks.diagnostics(functions=g.functions, calls=g.calls, fun2fun=g.fun2fun, call2fun=g.call2fun).first().asDict()

    def pattern(self, a: dict):
        try:
            return {"pattern": str(parse(a["text"]))}
        except PatternError as e:
            return {"column": e.column, "error": str(e)}

    def stop(self, a: dict):
        self.running = False

    def handle(self, line: str) -> str:
        request: dict = {}
        try:
            request = json.loads(line)
            body = self.commands()[request["type"]](request.get("arguments") or {})
            answer = {"success": True, "body": body}
        except Exception as e:  # a bad request must not end the server
            answer = {"success": False, "message": f"{type(e).__name__}: {e}"}
        return json.dumps({"type": "response", "request_seq": request.get("id") if isinstance(request, dict) else None, "command": request.get("type") if isinstance(request, dict) else None} | answer)

    def serve(self, lines: Iterable[str]) -> Iterator[str]:
        for line in lines:
            if line.strip():
                yield self.handle(line)
            if not self.running:
                return
