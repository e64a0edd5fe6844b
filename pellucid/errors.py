"""Errors with a stable code."""

from __future__ import annotations


class CheckError(Exception):
    """A check, suite or profile that cannot be carried out; the code says why."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code, self.message = code, message


class SchemaReferenceMissing(CheckError):
    def __init__(self, labels=(), types=(), properties=()):
        self.labels, self.types, self.properties = sorted(labels), sorted(types), sorted(properties)
        named = [f"{n} {x}" for n, x in (("labels", self.labels), ("relationship types", self.types), ("properties", self.properties)) if x]
        super().__init__("engine.schema_reference_missing", "unknown " + "; ".join(named))
