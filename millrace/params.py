"""References in properties: ${name}, ${context.name}, ${ENV:NAME}, ${SECRET:name}, and $$ for a dollar.

Only the properties of nodes are read, and once: a value put in is not searched for references.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from .model import Node, Pipeline, PipelineError

BUILT_INS = ("workspace", "date")
MASK = "********"


class ParameterError(PipelineError):
    pass


@dataclass
class Resolver:
    """Where values come from: explicit ones first, then the active context, the defaults of the
    document, and the built-in names workspace and date."""

    explicit: Mapping[str, str] = field(default_factory=dict)
    contexts: Mapping[str, Mapping[str, str]] = field(default_factory=dict)
    active: str | None = None
    workspace: str = "."
    secrets: Callable[[str], str | None] | None = None
    environment: Mapping[str, str] = field(default_factory=lambda: os.environ)
    today: str = field(default_factory=lambda: datetime.now(UTC).date().isoformat())

    def lookup(self, name: str, declared: Mapping[str, Mapping[str, Any]]) -> str | None:
        if name in self.explicit:
            return str(self.explicit[name])
        if self.active and name in self.contexts.get(self.active, {}):
            return str(self.contexts[self.active][name])
        default = (declared.get(name) or {}).get("default")
        if default is not None:
            return default if isinstance(default, str) else json.dumps(default)
        return {"workspace": self.workspace, "date": self.today}.get(name)


@dataclass
class Resolved:
    pipeline: Pipeline
    used: dict[str, str]
    warnings: list[str]
    secrets: set[str]

    def mask(self, text: str) -> str:
        """text with every secret value blotted out."""
        for value in sorted(filter(None, self.secrets), key=len, reverse=True):
            text = text.replace(value, MASK)
        return text


def load_contexts(workspace: str | Path) -> tuple[dict[str, dict[str, str]], str | None]:
    """The contexts of a workspace and the one that is active, from .etl/contexts.json if it exists."""
    path = Path(workspace, ".etl", "contexts.json")
    if not path.exists():
        return {}, None
    data = json.loads(path.read_text(encoding="utf-8"))
    contexts = data.get("contexts", {})
    return {k: {n: str(v) for n, v in (x.get("variables", x) if isinstance(x, dict) else {}).items()} for k, x in contexts.items()}, data.get("active")


_TYPES: dict[str, Callable[[str], bool]] = {
    "integer": lambda v: re.fullmatch(r"[+-]?\d+", v) is not None,
    "number": lambda v: re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", v) is not None,
    "boolean": lambda v: v in ("true", "false"),
    "date": lambda v: re.fullmatch(r"\d{4}-\d+-\d+([T ].*)?", v) is not None,
}
_TYPES |= {"int": _TYPES["integer"], "float": _TYPES["number"], "bool": _TYPES["boolean"]}


def _contract(doc: Pipeline, resolver: Resolver, warnings: list[str]) -> None:
    for name, spec in doc.parameters.items():
        if name in BUILT_INS:
            warnings.append(f"parameter '{name}' hides the built-in of that name")
        value = resolver.lookup(name, doc.parameters)
        if value is None:
            if spec.get("required"):
                raise ParameterError(f"parameter '{name}' is required")
            continue
        if spec.get("required") and not value.strip():
            raise ParameterError(f"parameter '{name}' is required and must not be empty")
        test = _TYPES.get(spec.get("type") or "")
        if test and not test(value.strip()):
            raise ParameterError(f"parameter '{name}' is declared as {spec['type']}, which '{value}' is not")
    warnings += [f"'{name}' is given but not declared" for name in resolver.explicit if name not in doc.parameters]


def resolve(doc: Pipeline, resolver: Resolver | None = None) -> Resolved:
    """The document with all references replaced; a reference to nothing names its node and property."""
    resolver = resolver or Resolver()
    out = Resolved(doc, {}, [], set())
    _contract(doc, resolver, out.warnings)

    def one(reference: str, at: str) -> str:
        name = reference.strip()
        if not name:
            raise ParameterError(f"{at}: a reference is empty")
        if name.startswith("SECRET:"):
            name = name[7:].strip()
            value = resolver.secrets(name) if resolver.secrets else None
            if value is None:
                raise ParameterError(f"{at}: there is no secret '{name}'" if resolver.secrets else f"{at}: there is no secret store for '{name}'")
            out.secrets.add(value)
            return value
        if name.startswith("ENV:"):
            name = name[4:].strip()
            if name not in resolver.environment:
                raise ParameterError(f"{at}: the environment has no '{name}'")
            return resolver.environment[name]
        if "." in name:
            context, variable = name.split(".", 1)
            if context not in resolver.contexts:
                raise ParameterError(f"{at}: there is no context '{context}'")
            if variable not in resolver.contexts[context]:
                raise ParameterError(f"{at}: context '{context}' has no '{variable}'")
            return str(resolver.contexts[context][variable])
        value = resolver.lookup(name, doc.parameters)
        if value is None:
            raise ParameterError(f"{at}: nothing provides '{name}'")
        return value

    def text(value: str, at: str) -> str:
        def swap(m: re.Match[str]) -> str:
            if m[0] == "$$":
                return "$"
            if m[1] is None:
                raise ParameterError(f"{at}: '{value}' has a '${{' that is never closed")
            got = one(m[1], at)
            out.used[m[1]] = MASK if got in out.secrets else got
            return got

        return re.sub(r"\$\$|\$\{(?:([^}]*)\})?", swap, value)

    def walk(value: Any, node: Node, name: str) -> Any:
        if isinstance(value, str):
            return text(value, f"node '{node.id}', property '{name}'")
        if isinstance(value, list):
            return [walk(x, node, name) for x in value]
        if isinstance(value, dict):
            return {k: walk(x, node, k) for k, x in value.items()}
        return value

    changed = Pipeline.of(doc.to_dict())
    for node in changed.nodes:
        node.properties = {k: walk(v, node, k) for k, v in node.properties.items()}
    out.pipeline = changed
    return out
