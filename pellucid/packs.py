"""Pack manifests: YAML that declares checks, patterns and parameter tokens for what the engine can run.

    pack: mine
    version: "1"
    checks:
      named: {runs: completeness, needs: [read], samples: false, elements: node}
    patterns:
      names: {badge: {keys: [badge, badge_number]}}
      values: {badge: {format: "B[0-9]{6}", check: luhn}}
    tokens:
      $first-active-supplier: {runs: first_active, with: {label: Supplier}}

A manifest holds no code. What it names must be there at run time and be what it says (its capabilities, whether it
samples, the kind of its elements, the digits that are checked, the payload of a token), or the pack does not load.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from importlib import resources
from pathlib import Path
from typing import Any, Literal

import yaml
from pydantic import BaseModel, ConfigDict, Field, ValidationError

from pellucid.errors import CheckError
from pellucid.graph import PropertyGraph
from pellucid.operators import CHECKS, RUNTIMES, register
from pellucid.operators import competency as comp
from pellucid.plans import pii


class _Strict(BaseModel):
    model_config = ConfigDict(extra="forbid", strict=True)


class CheckEntry(_Strict):
    runs: str = Field(min_length=1)
    needs: list[str] = ["read"]
    samples: bool = False
    elements: Literal["node", "rel"] = "node"


class NamePattern(_Strict):
    keys: list[str] = Field(min_length=1)


class ValuePattern(_Strict):
    format: str = Field(min_length=1)
    check: str | None = None


class Patterns(_Strict):
    names: dict[str, NamePattern] = {}
    values: dict[str, ValuePattern] = {}


class TokenEntry(_Strict):
    runs: str = Field(min_length=1)
    with_: dict[str, Any] = Field(default={}, alias="with")


class Manifest(_Strict):
    pack: str = Field(pattern=r"^[a-z][a-z0-9_-]*$")
    version: str = Field(min_length=1)
    checks: dict[str, CheckEntry] = {}
    patterns: Patterns = Patterns()
    tokens: dict[str, TokenEntry] = {}


class FirstActive(_Strict):
    label: str = Field(min_length=1)


@dataclass(frozen=True)
class TokenRuntime:
    """How a token's value is found, and the model that its payload must fit."""

    payload: type[BaseModel]
    find: Callable[[PropertyGraph, BaseModel], Any]


def _first_active(graph: PropertyGraph, payload: FirstActive) -> str | None:
    row = comp.first_active(graph, payload.label).first()
    return None if row is None else row["id"]


#: What tokens of manifests may run, by name.
TOKEN_RUNTIMES: dict[str, TokenRuntime] = {"first_active": TokenRuntime(FirstActive, _first_active)}
#: Packs that come with the engine.
BUILTIN = ("core", "pii")


@dataclass
class Pack:
    """A manifest that has been loaded: what it added."""

    name: str
    version: str
    checks: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    values: list[str] = field(default_factory=list)
    tokens: list[str] = field(default_factory=list)


PACKS: dict[str, Pack] = {}


def read_manifest(text: str) -> Manifest:
    """A manifest from YAML; keys that stand twice, unknown keys and values of another kind are errors (packs.manifest_invalid)."""
    try:
        return Manifest.model_validate(yaml.load(text, Loader=_Once))
    except (ValidationError, yaml.YAMLError) as e:
        raise CheckError("packs.manifest_invalid", re.sub(r"\s+", " ", str(e))[:300]) from None


class _Once(yaml.SafeLoader):
    def construct_mapping(self, node, deep=False):
        keys = [self.construct_object(k, deep=True) for k, _ in node.value]
        if len(set(map(repr, keys))) < len(keys):
            raise yaml.constructor.ConstructorError(None, None, "a key stands twice", node.start_mark)
        return super().construct_mapping(node, deep)


def _mismatch(what: str) -> CheckError:
    return CheckError("packs.runtime_mismatch", what)


def verify(m: Manifest) -> None:
    """Raises packs.runtime_mismatch for the first entry that the engine cannot run as it is declared, or that is there already."""
    for name, entry in m.checks.items():
        own = RUNTIMES.get(entry.runs)
        if own is None:
            raise _mismatch(f"{name} runs {entry.runs}, which is not there")
        for says, is_, what in ((set(entry.needs), set(own.requires), "needs"), (entry.samples, own.sampled, "samples"), (entry.elements, own.elements, "elements")):
            if says != is_:
                raise _mismatch(f"{name}: {what} is {says}, {entry.runs} has {is_}")
        if name in CHECKS:
            raise _mismatch(f"the check {name} is there already")
    for kind, known in ((m.patterns.names, pii.NAME_PATTERNS), (m.patterns.values, pii.VALUE_PATTERNS)):
        if taken := sorted(set(kind) & set(known)):
            raise _mismatch(f"patterns are there already: {', '.join(taken)}")
    for name, pattern in m.patterns.values.items():
        if pattern.check is not None and pattern.check not in pii.CHECK_DIGITS:
            raise _mismatch(f"{name} checks {pattern.check}, which is not there")
        try:
            re.compile(pattern.format)
        except re.error as e:
            raise CheckError("packs.manifest_invalid", f"{name}: {e}") from None
    for name, pattern in m.patterns.names.items():
        if len({k.lower() for k in pattern.keys}) < len(pattern.keys):
            raise CheckError("packs.manifest_invalid", f"{name}: a key stands twice")
    for token, entry in m.tokens.items():
        if entry.runs not in TOKEN_RUNTIMES:
            raise _mismatch(f"{token} runs {entry.runs}, which is not there")
        if not token.startswith("$") or token in comp.TOKENS:
            raise _mismatch(f"the token {token} is no $name or is there already")
        try:
            TOKEN_RUNTIMES[entry.runs].payload.model_validate(entry.with_)
        except ValidationError as e:
            raise _mismatch(f"{token}: {re.sub(r'\s+', ' ', str(e))[:200]}") from None


def load_pack(source: str | Path) -> Pack:
    """Loads a manifest (a path, or its text) as a whole or not at all; a pack of that name must not be there."""
    m = read_manifest(source.read_text() if isinstance(source, Path) else source)
    if m.pack in PACKS:
        raise _mismatch(f"the pack {m.pack} is there already")
    verify(m)
    pack = PACKS[m.pack] = Pack(m.pack, m.version, list(m.checks), list(m.patterns.names), list(m.patterns.values), list(m.tokens))
    for name, entry in m.checks.items():
        own = RUNTIMES[entry.runs]
        register(name, own.plan, pack=own.pack, requires=own.requires, sampled=own.sampled, elements=own.elements, runs=own.runs)
    pii.NAME_PATTERNS.update({k: tuple(x.lower() for x in v.keys) for k, v in m.patterns.names.items()})
    pii.VALUE_PATTERNS.update({k: (v.format, v.check) for k, v in m.patterns.values.items()})
    for token, entry in m.tokens.items():
        runtime = TOKEN_RUNTIMES[entry.runs]
        payload = runtime.payload.model_validate(entry.with_)
        comp.register_token(token, lambda graph, runtime=runtime, payload=payload: runtime.find(graph, payload))
    return pack


def load_builtin() -> None:
    """The engine's own packs, from their manifests; once."""
    for name in BUILTIN:
        if name not in PACKS:
            load_pack(resources.files("pellucid").joinpath(f"manifests/{name}.yml").read_text())


def unload_pack(name: str) -> None:
    """Takes everything that a pack added away again."""
    pack = PACKS.pop(name)
    for held, keys in ((CHECKS, pack.checks), (pii.NAME_PATTERNS, pack.names), (pii.VALUE_PATTERNS, pack.values), (comp.TOKENS, pack.tokens)):
        for k in keys:
            held.pop(k, None)


def load_packs(folder: str | Path) -> list[Pack]:
    """All manifests of a folder in the order of their names; the first that does not load stops it."""
    return [load_pack(p) for p in sorted([*Path(folder).glob("*.yml"), *Path(folder).glob("*.yaml")])]


def listing(packs: Iterable[Pack] | None = None) -> list[dict]:
    return [{"pack": p.name, "version": p.version, "checks": p.checks, "patterns": sorted({*p.names, *p.values}), "tokens": p.tokens} for p in (PACKS.values() if packs is None else packs)]


load_builtin()
