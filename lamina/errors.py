"""Errors with the three fields that tools report."""

from __future__ import annotations

import json

INVALID_PARAMS, INTERNAL = -32602, -32603


class EngineError(Exception):
    """code, and data {tool, constraint, next_action}."""

    code = INTERNAL

    def __init__(self, tool: str, constraint: str, next_action: str = ""):
        super().__init__(f"{tool}: {constraint}")
        self.tool, self.constraint, self.next_action = tool, constraint, next_action

    def data(self) -> dict[str, str]:
        return {"tool": self.tool, "constraint": self.constraint, "next_action": self.next_action}

    def json(self) -> str:
        """{code, message, data} as tools report it."""
        return json.dumps({"code": self.code, "message": str(self), "data": self.data()}, ensure_ascii=False)


class NotFound(EngineError):
    code = INVALID_PARAMS


class Ambiguous(EngineError):
    """A hash prefix that several leaves have."""
