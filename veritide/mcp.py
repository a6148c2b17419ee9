"""The read-only tools as a Model Context Protocol server: JSON-RPC 2.0, one message a line."""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable
from typing import TextIO

VERSION = "2024-11-05"
UNKNOWN_METHOD, BAD_PARAMETERS, UNREADABLE = -32601, -32602, -32700
KINDS = {"top_k": "integer"}


def described(name: str, tool: Callable) -> dict:
    """A tool's entry in tools/list, from its signature."""
    parameters = inspect.signature(tool).parameters
    return {
        "name": name,
        "description": name.replace("_", " "),
        "inputSchema": {
            "type": "object",
            "properties": {p: {"type": KINDS.get(p, "string")} for p in parameters},
            "required": [p for p, x in parameters.items() if x.default is inspect.Parameter.empty],
        },
    }


def answer(tools: dict[str, Callable], message: dict) -> dict | None:
    """The reply to one message; notifications have none."""
    if "id" not in message:
        return None
    method, params = message.get("method"), message.get("params") or {}
    reply = {"jsonrpc": "2.0", "id": message["id"]}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": VERSION, "capabilities": {"tools": {}}, "serverInfo": {"name": "veritide", "version": "1"}}}
    if method == "ping":
        return reply | {"result": {}}
    if method == "tools/list":
        return reply | {"result": {"tools": [described(n, t) for n, t in tools.items()]}}
    if method != "tools/call":
        return reply | {"error": {"code": UNKNOWN_METHOD, "message": f"unknown method {method}"}}
    if params.get("name") not in tools:
        return reply | {"error": {"code": BAD_PARAMETERS, "message": f"unknown tool {params.get('name')}"}}
    try:
        text, failed = json.dumps(tools[params["name"]](**params.get("arguments", {})), ensure_ascii=False, default=str), False
    except (TypeError, ValueError, RuntimeError) as e:
        text, failed = str(e), True
    return reply | {"result": {"content": [{"type": "text", "text": text}], "isError": failed}}


def serve(tools: dict[str, Callable], read: TextIO, write: TextIO) -> None:
    """Answers messages until the input ends."""
    for line in read:
        if not line.strip():
            continue
        try:
            reply = answer(tools, json.loads(line))
        except json.JSONDecodeError as e:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": UNREADABLE, "message": str(e)}}
        if reply:
            write.write(json.dumps(reply, ensure_ascii=False) + "\n")
            write.flush()
