"""Registry of conformance checks; further checks register with a plan function."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass

from pellucid.errors import CheckError
from pellucid.plans import conformance as c
from pellucid.plans import pii as p


@dataclass(frozen=True)
class Check:
    """A check's plan function, the capabilities that it needs and whether it samples."""

    name: str
    plan: Callable
    pack: str = "core"
    requires: tuple[str, ...] = ("read",)
    sampled: bool = False
    elements: str = "node"
    #: The engine's own check that it runs; packs give it other names.
    runs: str = ""

    def validate(self, given: dict) -> None:
        known = inspect.signature(self.plan).parameters
        own = {k for k in known if k not in ("graph", "seed", "exhaustive_limit", "key")}
        if unknown := set(given) - own:
            raise CheckError("run.suite_invalid", f"{self.name} does not take {', '.join(sorted(unknown))}")
        if missing := {k for k in own if known[k].default is inspect.Parameter.empty} - set(given):
            raise CheckError("run.suite_invalid", f"{self.name} needs {', '.join(sorted(missing))}")


#: Checks by the name that suites use, as packs declare them, and what packs may declare: the engine's own plans.
CHECKS: dict[str, Check] = {}
RUNTIMES: dict[str, Check] = {}


def register(name: str, plan: Callable, **more) -> None:
    """Adds a check; a name that is taken is an error."""
    if name in CHECKS:
        raise CheckError("packs.runtime_mismatch", f"the check {name} is there already")
    CHECKS[name] = Check(name, plan, **{"runs": name} | more)


for _f in (c.completeness, c.cardinality, c.no_orphans, c.property_type, c.property_format, c.value_in_set, c.uniqueness, c.label_cooccurrence, c.temporal_sanity):
    RUNTIMES[_f.__name__] = Check(_f.__name__, _f, runs=_f.__name__)
RUNTIMES["rel_direction"] = Check("rel_direction", c.rel_direction, elements="rel", runs="rel_direction")
RUNTIMES["dangling_rels"] = Check("dangling_rels", c.dangling_rels, requires=("read", "store_consistency"), elements="rel", runs="dangling_rels")
RUNTIMES["hub_outlier"] = Check("hub_outlier", c.hub_outlier, sampled=True, runs="hub_outlier")
for _f in (p.pii_name_match, p.pii_value_match):
    RUNTIMES[_f.__name__] = Check(_f.__name__, _f, pack="pii", sampled=True, runs=_f.__name__)

import pellucid.packs  # noqa: E402, F401 - the built-in packs declare the checks above
