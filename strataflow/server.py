"""An agent server: the tools as JSON-RPC 2.0 messages, one a line, by the Model Context Protocol.

Run `serve(Tools(engine), sys.stdin, sys.stdout)` as the process that an agent starts. What a call does
runs under a tag of its own, so a notification that cancels it stops its jobs.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from typing import TextIO

from strataflow.tools import Tools

PROTOCOL = "2025-06-18"
#: Of each tool what it is for and its arguments, those that must be given first.
TOOLS = {
    "query": ("Rows of a program of rules and a goal.", {"program": "string", "params": "object"}, ["program"]),
    "cypher": ("Rows of a read-only Cypher query.", {"query": "string", "params": "object"}, ["query"]),
    "schema": ("Relations, predicates and modules, under a dotted prefix if one is given.", {"prefix": "string"}, []),
    "look": ("A relation's columns and a few of its rows, or a predicate's modes.", {"name": "string"}, ["name"]),
    "values": ("A column's commonest values.", {"relation": "string", "column": "string"}, ["relation", "column"]),
    "find": ("Columns of text that hold a value with this in it.", {"text": "string"}, ["text"]),
    "explain": ("How a program is run, why it is empty, and what looks wrong in it.", {"program": "string"}, ["program"]),
}
ASK = ("Rows for a question in plain language, and the program that found them.", {"question": "string"}, ["question"])


class Server:
    """ask is a host's translator, from a question to a reply that JSON can say; without it there is no such tool."""

    def __init__(self, tools: Tools, ask: Callable[[str], object] | None = None) -> None:
        self.tools, self.ask = tools, ask

    def listed(self) -> list[dict]:
        found = TOOLS | ({"ask": ASK} if self.ask else {})
        if self.tools.graph is None:
            found = {n: t for n, t in found.items() if n != "cypher"}
        return [{"name": n, "description": doc, "inputSchema": {"type": "object", "properties": {a: {"type": t} for a, t in args.items()}, "required": needed}} for n, (doc, args, needed) in found.items()]

    def called(self, name: str, arguments: dict, tag: str) -> dict:
        if name not in {t["name"] for t in self.listed()}:
            return {"content": [{"type": "text", "text": f"no tool {name}"}], "isError": True}
        with self.tools.engine.cancellable(tag):
            if name == "ask":
                try:
                    text = json.dumps(self.ask(**arguments), ensure_ascii=False, default=str)
                except (ValueError, TypeError, RuntimeError) as e:
                    text = json.dumps({"error": str(e)})
            else:
                text = self.tools.call(name, arguments)
        return {"content": [{"type": "text", "text": text}], "isError": "error" in json.loads(text)}

    def answer(self, message: object) -> dict | None:
        """The reply to a message; none to a notification."""
        if not isinstance(message, dict) or not isinstance(message.get("method"), str):
            return {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "not a request"}}
        method, params, key = message["method"], message.get("params") or {}, message.get("id")
        if method == "notifications/cancelled":
            self.tools.engine.cancel(f"call-{params.get('requestId')}")
        if "id" not in message:
            return None
        if method == "initialize":
            result: dict = {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "strataflow", "version": "1"}}
        elif method == "ping":
            result = {}
        elif method == "tools/list":
            result = {"tools": self.listed()}
        elif method == "tools/call":
            if not isinstance(params.get("name"), str) or not isinstance(params.get("arguments", {}), dict):
                return {"jsonrpc": "2.0", "id": key, "error": {"code": -32602, "message": "a call has a name and arguments"}}
            result = self.called(params["name"], params.get("arguments") or {}, f"call-{key}")
        else:
            return {"jsonrpc": "2.0", "id": key, "error": {"code": -32601, "message": f"no method {method}"}}
        return {"jsonrpc": "2.0", "id": key, "result": result}


def serve(server: Server, lines: Iterable[str], out: TextIO) -> None:
    """Answers until the lines end."""
    for line in lines:
        if not line.strip():
            continue
        try:
            reply = server.answer(json.loads(line))
        except ValueError:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
        if reply is not None:
            out.write(json.dumps(reply, ensure_ascii=False) + "\n")
            out.flush()
