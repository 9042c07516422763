"""The components a node can run: their ports, their properties, and the function that builds them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import TYPE_CHECKING, Any

from .model import PipelineError

if TYPE_CHECKING:
    from pyspark.sql import DataFrame, SparkSession

NAMESPACES = {"src": "source", "xf": "transform", "snk": "sink", "qa": "quality", "ctl": "control", "code": "transform"}
REJECTED = "rejected"


class InvalidProperty(PipelineError):
    def __init__(self, node: str, name: str, reason: str):
        super().__init__(f"node '{node}', property '{name}': {reason}")
        self.node, self.property, self.reason = node, name, reason


@dataclass(frozen=True)
class Prop:
    """A property: text, path, sql, code, bool, integer, number, strings, map or enum."""

    kind: str = "text"
    required: bool = False
    default: Any = None
    options: tuple[str, ...] = ()
    doc: str = ""
    secret: bool = False

    def check(self, node: str, name: str, value: Any) -> Any:
        ok = {
            "bool": lambda v: isinstance(v, bool),
            "integer": lambda v: isinstance(v, int) and not isinstance(v, bool),
            "number": lambda v: isinstance(v, int | float | str) and not isinstance(v, bool),
            "strings": lambda v: isinstance(v, list) and all(isinstance(x, str) for x in v),
            "map": lambda v: isinstance(v, dict) and all(isinstance(x, str) for x in v.values()),
        }.get(self.kind, lambda v: isinstance(v, str))
        if isinstance(value, str) and self.kind in ("bool", "integer"):  # what a ${...} reference leaves behind
            value = {"true": True, "false": False}.get(value.strip(), value) if self.kind == "bool" else int(value) if value.strip().lstrip("-").isdigit() else value
        if not ok(value):
            raise InvalidProperty(node, name, f"must be {'a list of texts' if self.kind == 'strings' else 'a map of texts' if self.kind == 'map' else 'a ' + self.kind}")
        if self.kind == "enum" and value not in self.options:
            raise InvalidProperty(node, name, f"{value!r} is no option; there are {', '.join(self.options)}")
        if self.required and self.kind in ("text", "path", "sql", "code") and not value.strip():
            raise InvalidProperty(node, name, "must not be blank")
        if self.required and self.kind in ("strings", "map") and not value:
            raise InvalidProperty(node, name, "must not be empty")
        return value


def need(kind: str = "text", doc: str = "", **more: Any) -> Prop:
    return Prop(kind, True, None, doc=doc, **more)


def opt(kind: str = "text", default: Any = None, doc: str = "", **more: Any) -> Prop:
    return Prop(kind, False, default, doc=doc, **more)


def one_of(*options: str, default: str | None = None, required: bool = False, doc: str = "") -> Prop:
    return Prop("enum", required, default, options, doc)


@dataclass
class Step:
    """What a component's function is given: its node's values and its inputs."""

    id: str
    component: str
    props: dict[str, Any]
    spark: SparkSession
    inputs: list[DataFrame] = field(default_factory=list)
    by_port: dict[str, DataFrame] = field(default_factory=dict)
    context: Any = None
    relations: dict[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, name: str) -> Any:
        return self.props.get(name)

    @property
    def df(self) -> DataFrame:
        return self.inputs[0]

    def bad(self, name: str, reason: str) -> InvalidProperty:
        return InvalidProperty(self.id, name, reason)


@dataclass(frozen=True)
class Component:
    id: str
    build: Callable[[Step], Any]
    props: dict[str, Prop]
    inputs: tuple[str, ...]
    outputs: tuple[str, ...]
    many: bool = False
    doc: str = ""
    check: Callable[[str, dict[str, Any]], None] | None = None
    packages: tuple[str, ...] = ()
    deferred: bool = False

    @property
    def kind(self) -> str:
        return NAMESPACES[self.id.partition(".")[0]]

    def values(self, node: str, given: dict[str, Any], warnings: list[str]) -> dict[str, Any]:
        """Given values with defaults; null counts as missing, unknown names are kept with a warning."""
        out = dict(given)
        for name in given.keys() - self.props.keys():
            warnings.append(f"node '{node}': {self.id} has no property '{name}'")
        for name, prop in self.props.items():
            value = given.get(name)
            if value is None:
                if prop.required:
                    raise InvalidProperty(node, name, "is required")
                out[name] = list(prop.default) if isinstance(prop.default, tuple) else prop.default
            else:
                out[name] = prop.check(node, name, value)
        if self.check:
            self.check(node, out)
        return out


COMPONENTS: dict[str, Component] = {}


def component(
    name: str, props: dict[str, Prop] | None = None, *, inputs: tuple[str, ...] | None = None, outputs: tuple[str, ...] | None = None, many: bool = False,
    check: Callable[[str, dict[str, Any]], None] | None = None, packages: tuple[str, ...] = (), deferred: bool = False,
):
    """Registers a function as a component. It returns a DataFrame, a dict of output port to
    DataFrame, or for a sink a function that delivers."""
    kind = NAMESPACES[name.partition(".")[0]]
    inputs = inputs if inputs is not None else () if kind == "source" else ("in",)
    outputs = outputs if outputs is not None else () if kind == "sink" else ("main",)

    def wrap(build: Callable[[Step], Any]):
        if name in COMPONENTS:
            raise ValueError(f"{name} is registered twice")
        COMPONENTS[name] = Component(name, build, props or {}, inputs, outputs, many, (build.__doc__ or "").strip(), check, packages, deferred)
        return build

    return wrap


def load() -> dict[str, Component]:
    """All components; importing their modules registers them."""
    from . import operators, sources  # noqa: F401

    return COMPONENTS


def manifest() -> list[dict[str, Any]]:
    """Every component with its ports and properties, as plain data."""
    return [
        {
            "id": c.id, "kind": c.kind, "doc": c.doc.split("\n\n")[0], "inputs": list(c.inputs), "outputs": list(c.outputs), "packages": list(c.packages),
            "properties": {n: {"kind": p.kind, "required": p.required, "default": p.default, "options": list(p.options), "doc": p.doc} for n, p in c.props.items()},
        }
        for c in sorted(load().values(), key=lambda c: c.id)
    ]


def json_schema() -> dict[str, Any]:
    """A JSON Schema of pipeline documents: stricter than the reader, which keeps unknown keys."""
    reference = {"type": "string", "pattern": r"\$\{[^}]*\}"}
    types: dict[str, dict[str, Any]] = {
        "bool": {"anyOf": [{"type": "boolean"}, reference]},
        "integer": {"anyOf": [{"type": "integer"}, reference]},
        "number": {"type": ["number", "string"]},
        "strings": {"type": "array", "items": {"type": "string"}},
        "map": {"type": "object", "additionalProperties": {"type": "string"}},
    }

    def of(p: Prop) -> dict[str, Any]:
        return {"anyOf": [{"enum": list(p.options)}, reference]} if p.kind == "enum" else types.get(p.kind, {"type": "string"})

    nodes = [
        {
            "if": {"properties": {"componentId": {"const": c.id}}},
            "then": {"properties": {"properties": {"type": "object", "properties": {n: of(p) for n, p in c.props.items()}, "required": [n for n, p in c.props.items() if p.required], "additionalProperties": False}}},
        }
        for c in sorted(load().values(), key=lambda c: c.id)
    ]
    data = {"type": "object", "required": ["label", "componentId"], "properties": {"componentId": {"enum": sorted(COMPONENTS)}, "label": {"type": "string"}}, "allOf": nodes}
    node = {"type": "object", "required": ["id", "position", "data"], "properties": {"id": {"type": "string", "minLength": 1}, "data": data}}
    edge = {"type": "object", "required": ["id", "source", "target"], "properties": {k: {"type": "string"} for k in ("id", "source", "target", "sourceHandle", "targetHandle")}}
    return {
        "$schema": "https://json-schema.org/draft/2020-12/schema", "type": "object", "required": ["nodes"],
        "properties": {"formatVersion": {"const": 1}, "name": {"type": "string"}, "nodes": {"type": "array", "items": node}, "edges": {"type": "array", "items": edge}, "parameters": {"type": "object"}},
    }
