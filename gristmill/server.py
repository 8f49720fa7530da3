"""The three commands as tools for a client that speaks JSON-RPC over lines of text: python -m gristmill serve.

Each call is one run over one-row tables, under the run's deadline. What is wrong with an input or an answer is the call's result, marked as an
error; the server goes on.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators import ask, check, extract
from gristmill.runtime import DeadlineExceeded, Metrics, deadline, logger, stage
from gristmill.settings.config import Settings
from gristmill.settings.tuning import Tuning
from gristmill.sources import loaders

#: The version of the protocol, and its error codes.
PROTOCOL = "2025-06-18"
PARSE, REQUEST, METHOD, PARAMS = -32700, -32600, -32601, -32602

_TEXT = {"type": "string"}


class InputError(ValueError):
    """What a caller handed over is no input."""


def _tool(title: str, description: str, **inputs: dict) -> dict:
    schema = {"type": "object", "properties": inputs, "required": list(inputs), "additionalProperties": False}
    return {"title": title, "description": description, "inputSchema": schema, "annotations": {"readOnlyHint": True, "openWorldHint": True}}


TOOLS = {
    "score": _tool("Match Score", "How well a resume fits a posting, 0 to 100, with the three signals behind it.", job_description=_TEXT, resume=_TEXT),
    "extract": _tool("Extract requirements", "The requirements of a posting with tier, importance, alternatives and their sentences; what check takes.", job_description=_TEXT),
    "check": _tool("Check coverage", "Which lines of a resume show each requirement of extract's result, what is missing, and a Fit Score.", requirements={"type": "object"}, resume=_TEXT),
}


class Server:
    def __init__(self, spark: SparkSession, settings: Settings, tuning: Tuning, provider: ask.Provider | None = None):
        self.spark, self.settings, self.tuning = spark, settings, tuning
        self.provider = provider or ask.provider(spark, settings)
        self.metrics, self.log = Metrics(), logger(settings)

    def _text(self, what: str, text: str, id_name: str) -> DataFrame:
        rows = loaders.texts(self.spark, [("input", text)], id_name)
        if error := rows.first().error:
            raise InputError(f"{what}: {error}")
        return rows.select(id_name, "text")

    def score(self, job_description: str, resume: str) -> dict:
        jobs, people = self._text("job_description", job_description, "posting_id"), self._text("resume", resume, "resume_id")
        docs = extract.prepared(jobs).select("posting_id", F.col("text").alias("posting"))
        pair = docs.crossJoin(people.withColumnRenamed("text", "resume"))  # one row each
        return json.loads(check.match_json(check.holistic(pair, self.provider, self.tuning), self.tuning, self.settings.model).first().match)

    def extract(self, job_description: str) -> dict:
        e = extract.extract(self._text("job_description", job_description, "posting_id"), self.provider, self.tuning, self.settings)
        found = extract.result_json(e, self.settings.model, self.settings.skip_importance).first()
        if found is None:
            raise InputError("job_description: no sentences")
        return json.loads(found.result)

    def check(self, requirements: dict, resume: str) -> dict:
        people = self._text("resume", resume, "resume_id")
        results = loaders.parse_results(self.spark.createDataFrame([("input", json.dumps(requirements))], "posting_id string, raw string"))
        if error := results.first().error:
            raise InputError(f"requirements: {error}")
        reqs, groups, context = loaders.result_tables(results)
        if wrong := [r.problem for r in loaders.result_violations(reqs, groups, context).collect()]:
            raise InputError("requirements: " + "; ".join(sorted(wrong)))
        if not reqs.head(1):
            raise InputError("requirements: none to check")
        if check.evidence_units(people).isEmpty():
            raise InputError("resume: no evidence units")
        pairs = results.select("posting_id").crossJoin(people.select("resume_id"))  # one row each
        c = check.check(pairs, reqs, groups, context, people, self.provider, self.tuning, self.settings)
        return json.loads(check.coverage_json(c, self.settings.model).first().coverage)

    def call(self, name: str, arguments: dict) -> dict:
        """A tool's result, its error included."""
        work: Callable[..., dict] = {"score": self.score, "extract": self.extract, "check": self.check}[name]
        try:
            with deadline(self.spark, self.settings.deadline), stage(name, self.metrics, self.log):
                said = work(**arguments)
        except DeadlineExceeded as e:
            return {"content": [{"type": "text", "text": f"{name}: {e}"}], "isError": True}
        except Exception as e:  # a call that fails is a result, and the server goes on
            return {"content": [{"type": "text", "text": str(e)[:2000]}], "isError": True}
        return {"content": [{"type": "text", "text": json.dumps(said, ensure_ascii=False)}], "structuredContent": said, "isError": False}

    def answer(self, line: str) -> dict | None:
        """The reply to one line, None to a notification."""
        failed = lambda id, code, text: {"jsonrpc": "2.0", "id": id, "error": {"code": code, "message": text}}
        try:
            said = json.loads(line)
        except ValueError:
            return failed(None, PARSE, "not JSON")
        if not isinstance(said, dict) or not isinstance(said.get("method"), str):
            return failed(said.get("id") if isinstance(said, dict) else None, REQUEST, "no request")
        id, method, given = said.get("id"), said["method"], said.get("params") or {}
        if id is None:
            return None
        if method == "initialize":
            result = {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "gristmill", "version": "1"}, "instructions": "score says how well a resume fits; extract, then check with its result, say why."}
        elif method == "ping":
            result = {}
        elif method == "tools/list":
            result = {"tools": [{"name": n, **t} for n, t in TOOLS.items()]}
        elif method == "tools/call":
            tool, arguments = TOOLS.get(given.get("name")), given.get("arguments") or {}
            if tool is None:
                return failed(id, PARAMS, f"no tool {given.get('name')!r}; known are {', '.join(TOOLS)}")
            kinds = {"string": str, "object": dict}
            wanted = tool["inputSchema"]["properties"]
            if set(arguments) != set(wanted) or not all(isinstance(arguments[k], kinds[v["type"]]) for k, v in wanted.items()):
                return failed(id, PARAMS, f"{given['name']} takes " + ", ".join(f"{k} ({v['type']})" for k, v in wanted.items()))
            result = self.call(given["name"], arguments)
        else:
            return failed(id, METHOD, f"no method {method}")
        return {"jsonrpc": "2.0", "id": id, "result": result}

    def serve(self, lines: TextIO, out: TextIO) -> None:
        """Replies to each line until there are no more."""
        for line in lines:
            if line.strip() and (reply := self.answer(line)) is not None:
                out.write(json.dumps(reply, ensure_ascii=False) + "\n")
                out.flush()
