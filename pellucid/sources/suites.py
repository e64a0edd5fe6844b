"""Check suites in YAML: strict models, no key twice."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any, Literal

import yaml
from pydantic import BaseModel, ConfigDict, Field, ValidationError, model_validator

from pellucid.errors import CheckError

Severity = Literal["error", "warn"]


class Strict(BaseModel):
    model_config = ConfigDict(extra="forbid", strict=True, populate_by_name=True)


class Common(Strict):
    id: str = Field(min_length=1)
    severity: Severity | None = None
    tags: list[str] = []
    provenance: str | None = None
    generated: bool = False


class Conformance(Common):
    check: str
    with_: dict[str, Any] = Field(default={}, alias="with")


class Rows(Strict):
    min: int | None = Field(default=None, ge=0)
    max: int | None = Field(default=None, ge=0)
    exactly: int | None = Field(default=None, ge=0)

    @model_validator(mode="after")
    def consistent(self):
        if self.min is self.max is self.exactly is None:
            raise ValueError("rows needs min, max or exactly")
        if self.exactly is not None and not (self.min or 0) <= self.exactly <= (self.exactly if self.max is None else self.max):
            raise ValueError("exactly lies outside min and max")
        if self.min is not None and self.max is not None and self.min > self.max:
            raise ValueError("min is over max")
        return self

    def takes(self, n: int) -> bool:
        return (self.min or 0) <= n and (self.max is None or n <= self.max) and self.exactly in (None, n)

    @property
    def takes_some(self) -> bool:
        """Whether a result with rows can satisfy the bounds."""
        return self.exactly != 0 and self.max != 0


class Expect(Strict):
    rows: Rows | None = None
    columns: list[str] | None = None
    unique: bool | None = None
    contains: list[Any] | None = None
    equals: list[Any] | None = None
    empty: bool | None = None

    @model_validator(mode="after")
    def consistent(self):
        if all(v is None for v in (self.rows, self.columns, self.unique, self.contains, self.equals, self.empty)):
            raise ValueError("expect needs at least one assertion")
        if self.contains is not None and not self.contains:
            raise ValueError("contains must not be empty")
        bounds = self.rows or Rows(min=0)
        if self.empty is True and (self.contains or self.equals or not bounds.takes(0)) or self.empty is False and (self.equals == [] or not bounds.takes_some):
            raise ValueError("empty contradicts the other assertions")
        if self.equals is not None and not bounds.takes(len(self.equals)) or self.contains and not bounds.takes_some:
            raise ValueError("rows contradicts the pinned values")
        if self.contains and self.equals is not None and any(v not in self.equals for v in self.contains):
            raise ValueError("contains has a value that equals has not")
        return self


class Competency(Common):
    question: str = Field(min_length=1)
    query: str
    params: dict[str, Any] = {}
    expect: Expect

    @property
    def pattern(self) -> str:
        return "competency-regression" if self.expect.contains is not None or self.expect.equals is not None else "competency-shape"


class Drift(Common):
    metric: str
    target: dict[str, Any] = {}
    baseline: str = "latest"
    tolerance: dict[str, Any]


class Defaults(Strict):
    severity: Severity = "error"
    tags: list[str] = []


class SuiteFile(Strict):
    suite: str | None = None
    generated: bool = False
    defaults: Defaults = Defaults()
    conformance: list[Conformance] = []
    competency: list[Competency] = []
    drift: list[Drift] = []


@dataclass(frozen=True)
class LoadedCheck:
    """A check with the suite's defaults applied."""

    spec: Conformance | Competency | Drift
    suite_id: str
    severity: str
    tags: tuple[str, ...]
    generated: bool

    @property
    def id(self) -> str:
        return self.spec.id

    @property
    def pattern(self) -> str:
        return {Conformance: "conformance", Drift: "drift"}.get(type(self.spec)) or self.spec.pattern

    @property
    def name(self) -> str:
        s = self.spec
        return s.question if isinstance(s, Competency) else s.check if isinstance(s, Conformance) else s.metric


@dataclass(frozen=True)
class Suite:
    id: str
    sha: str
    checks: list[LoadedCheck] = field(default_factory=list)


class _Loader(yaml.SafeLoader):
    """Rejects a key that a mapping already has, at any depth."""


def _mapping(loader, node, deep=False):
    seen = {}
    for k, v in node.value:
        key = loader.construct_object(k, deep=True)
        if key in seen:
            raise CheckError("run.suite_invalid", f"the key {key!r} stands twice (line {k.start_mark.line + 1})")
        seen[key] = loader.construct_object(v, deep=True)
    return seen


_Loader.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, _mapping)


def load_suite(text: str, name: str = "suite") -> Suite:
    """Parses and validates one suite; the file's stem stands in where it names no suite."""
    try:
        raw = yaml.load(text, _Loader)  # noqa: S506 - a SafeLoader
        found = SuiteFile.model_validate(raw or {})
    except (yaml.YAMLError, ValidationError) as e:
        raise CheckError("run.suite_invalid", str(e)) from None
    suite_id = found.suite or name
    checks = []
    for spec in (*found.conformance, *found.competency, *found.drift):
        tags = tuple(dict.fromkeys((*found.defaults.tags, *spec.tags)))
        checks.append(LoadedCheck(spec, suite_id, spec.severity or found.defaults.severity, tags, found.generated or spec.generated))
    ids = [c.id for c in checks]
    if twice := sorted({i for i in ids if ids.count(i) > 1}):
        raise CheckError("run.suite_invalid", f"check ids stand twice: {', '.join(twice)}")
    from pellucid.operators import CHECKS

    for c in checks:
        if isinstance(c.spec, Conformance):
            if c.spec.check not in CHECKS:
                raise CheckError("run.suite_invalid", f"unknown check {c.spec.check}")
            CHECKS[c.spec.check].validate(c.spec.with_)
    return Suite(suite_id, hashlib.sha256(text.encode()).hexdigest(), checks)


def load_suites(path: str | Path, tag: str | None = None, suite: str | None = None) -> list[Suite]:
    """All *.yml and *.yaml files under a folder (or one file), by path; filters by suite id and by tag:<name>."""
    path = Path(path)
    files = [path] if path.is_file() else sorted(p for p in path.rglob("*") if p.suffix in (".yml", ".yaml"))
    if not files:
        raise CheckError("run.checks_missing", f"no suites at {path}")
    found = [load_suite(p.read_text(), p.stem) for p in files]
    if tag is not None:
        found = [Suite(s.id, s.sha, [c for c in s.checks if tag in c.tags]) for s in found]
    return [s for s in found if suite is None or s.id == suite]


def load_what_can_be(path: str | Path, suite: str | None = None) -> tuple[list[Suite], list[str]]:
    """All suites under a folder that load, and for each file that does not why; a folder without files is an error."""
    found, broken = [], []
    path = Path(path)
    files = [path] if path.is_file() else sorted(p for p in path.rglob("*") if p.suffix in (".yml", ".yaml"))
    if not files:
        raise CheckError("run.checks_missing", f"no suites at {path}")
    for p in files:
        try:
            found.append(load_suite(p.read_text(), p.stem))
        except (CheckError, OSError, UnicodeDecodeError) as e:
            broken.append(f"{p} could not be loaded ({str(e).splitlines()[0]})")
    return [s for s in found if suite is None or s.id == suite], broken


def parse_selector(text: str) -> str:
    """tag:<name> to the name."""
    m = re.fullmatch(r"tag:(\S.*)", text)
    if not m:
        raise CheckError("run.invalid_selector", f"{text!r} is not tag:<name>")
    return m[1].strip()
