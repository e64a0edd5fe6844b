"""A tool server over standard input and output: one JSON-RPC 2.0 message a line, as the Model Context Protocol has it."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import TextIO

from pellucid.errors import CheckError

PROTOCOL = "2024-11-05"
#: Name, description and arguments (with those that must be there) of each tool.
TOOLS = (
    ("list_checks", "List the suites and their checks; nothing is run.", {}, []),
    ("get_results", "Read the results of a stored run.", {"run_id": {"type": "string", "default": "latest"}}, []),
    ("run_suite", "Run one suite, store the run and return its results.", {"suite": {"type": "string"}}, ["suite"]),
)


def describe() -> list[dict]:
    return [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": r, "additionalProperties": False}} for n, d, p, r in TOOLS]


class Server:
    """tools: a function for each name in TOOLS. Errors of a tool are results that say so; no stack trace leaves."""

    def __init__(self, tools: dict[str, Callable[..., dict]]):
        self.tools = tools

    def answer(self, message: dict) -> dict | None:
        """The response to a request; None to a notification."""
        known = {"initialize": self._initialize, "ping": lambda _: {}, "tools/list": lambda _: {"tools": describe()}, "tools/call": self._call}
        method, id_ = message.get("method"), message.get("id")
        if "id" not in message:
            return None
        if method not in known:
            return {"jsonrpc": "2.0", "id": id_, "error": {"code": -32601, "message": f"unknown method {method}"}}
        try:
            return {"jsonrpc": "2.0", "id": id_, "result": known[method](message.get("params") or {})}
        except (KeyError, TypeError, ValueError) as e:
            return {"jsonrpc": "2.0", "id": id_, "error": {"code": -32602, "message": str(e)}}

    def _initialize(self, params: dict) -> dict:
        return {"protocolVersion": params.get("protocolVersion", PROTOCOL), "capabilities": {"tools": {}}, "serverInfo": {"name": "pellucid", "version": "0.1.0"}}

    def _call(self, params: dict) -> dict:
        name, given = params.get("name"), params.get("arguments") or {}
        spec = next((t for t in TOOLS if t[0] == name), None)
        if spec is None or set(given) - set(spec[2]) or set(spec[3]) - set(given) or any(not isinstance(v, str) for v in given.values()):
            raise ValueError(f"no such tool, or not its arguments: {name}")
        try:
            text, failed = json.dumps(self.tools[name](**given), default=str, sort_keys=True), False
        except CheckError as e:
            text, failed = json.dumps({"code": e.code, "message": e.message}), True
        except Exception as e:  # what went wrong inside stays inside
            text, failed = json.dumps({"code": "mcp.internal_error", "message": type(e).__name__}), True
        return {"content": [{"type": "text", "text": text}], "isError": failed}

    def run(self, source: TextIO, sink: TextIO) -> None:
        """Answers line by line until the input ends."""
        for line in source:
            if not line.strip():
                continue
            try:
                message = json.loads(line)
                out = self.answer(message) if isinstance(message, dict) else {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "one object a line"}}
            except ValueError:
                out = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "no JSON"}}
            if out is not None:
                sink.write(json.dumps(out) + "\n")
                sink.flush()
