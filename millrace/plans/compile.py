"""Checks a document and puts its nodes in order. Nothing here needs Spark."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from ..model import Edge, Node, Pipeline, PipelineError
from ..registry import NAMESPACES, REJECTED, Component, load

RESERVED = f"__{REJECTED}"
MATERIALIZE = ("auto", "view", "memory", "disk")


@dataclass
class Stage:
    node: Node
    component: Component
    props: dict[str, Any]
    #: (input port, node id, output port), in the order of the component's ports.
    inputs: list[tuple[str, str, str]] = field(default_factory=list)
    materialize: str = "auto"

    @property
    def id(self) -> str:
        return self.node.id


@dataclass
class Plan:
    stages: list[Stage]
    warnings: list[str]
    name: str | None = None

    def uses(self, node: str, port: str) -> int:
        """How many inputs read an output."""
        return sum((source, out) == (node, port) for s in self.stages for _, source, out in s.inputs)


def _ports(edge: Edge, nodes: dict[str, Node], known: dict[str, Component]) -> tuple[str | None, str]:
    source = known[nodes[edge.source].component]
    out = edge.source_handle or (source.outputs[0] if source.outputs else "")
    if out not in source.outputs:
        raise PipelineError(f"edge '{edge.id}': node '{edge.source}' has no output '{out}'")
    return edge.target_handle, out


def compile_pipeline(doc: Pipeline) -> Plan:
    """The plan of a document, or a PipelineError that names what is wrong with it."""
    known, warnings = load(), []
    if not doc.nodes:
        raise PipelineError("the pipeline has no nodes")
    nodes: dict[str, Node] = {}
    for node in doc.nodes:
        if node.id in nodes:
            raise PipelineError(f"two nodes are called '{node.id}'")
        if node.id.endswith(RESERVED):
            raise PipelineError(f"node '{node.id}': names that end in {RESERVED} are taken")
        if not node.component:
            raise PipelineError(f"node '{node.id}' has no component")
        if node.component.partition(".")[0] not in NAMESPACES:
            raise PipelineError(f"node '{node.id}': '{node.component}' is in no known namespace")
        if node.component not in known:
            raise PipelineError(f"node '{node.id}': there is no component '{node.component}'")
        nodes[node.id] = node
    names = dict.fromkeys(nodes)
    for node in doc.nodes:
        if node.alias:
            if node.alias in names:
                raise PipelineError(f"node '{node.id}': the alias '{node.alias}' is taken")
            names[node.alias] = None
    for e in doc.edges:
        for end in (e.source, e.target):
            if end not in nodes:
                raise PipelineError(f"edge '{e.id}' has an end '{end}' that is no node")
        if e.source == e.target:
            raise PipelineError(f"edge '{e.id}' joins '{e.source}' to itself")

    order = _order(doc, nodes)
    dropped = _dropped(doc, order, warnings)
    stages = []
    for node_id in order:
        node, component = nodes[node_id], known[nodes[node_id].component]
        edges = [e for e in doc.edges if e.target == node_id]
        inputs = _inputs(node, component, edges, nodes, known)
        props = component.values(node_id, node.properties, warnings)
        if node_id in dropped:
            continue
        how = node.materialize or "auto"
        if how not in MATERIALIZE:
            warnings.append(f"node '{node_id}': materialize '{how}' is not known, auto is used")
            how = "auto"
        if node.incremental and component.kind != "source":
            raise PipelineError(f"node '{node_id}': only sources can be incremental")
        if node.policy.memory_limit_mb:
            warnings.append(f"node '{node_id}': memoryLimitMb has no effect, executors share their memory")
        stages.append(Stage(node, component, props, inputs, how))
    if not stages:
        warnings.append("every node is disabled")
    return Plan(stages, warnings, doc.name)


def _mentions(node: Node, names: list[str]) -> list[str]:
    text = str(node.properties.get("query") or "")
    return [n for n in names if re.search(rf"(?<!\w){re.escape(n)}(?!\w)", text)]


def _order(doc: Pipeline, nodes: dict[str, Node]) -> list[str]:
    """Nodes after what they read, in the document's order where that leaves a choice.

    A query reads the nodes it names as well as those it is wired to.
    """
    owner = {n.id: n.id for n in doc.nodes} | {n.alias: n.id for n in doc.nodes if n.alias}
    needs: dict[str, set[str]] = {n.id: set() for n in doc.nodes}
    for e in doc.edges:
        needs[e.target].add(e.source)
    wired = {k: set(v) for k, v in needs.items()}
    for n in doc.nodes:
        if n.component == "xf.sql":
            needs[n.id] |= {owner[x] for x in _mentions(n, list(owner)) if owner[x] != n.id and n.id not in wired[owner[x]]}
    order: list[str] = []
    while len(order) < len(nodes):
        ready = next((n.id for n in doc.nodes if n.id not in order and needs[n.id] <= set(order)), None)
        if ready is None:
            raise PipelineError(f"the nodes {', '.join(n.id for n in doc.nodes if n.id not in order)} wait for each other")
        order.append(ready)
    return order


def _dropped(doc: Pipeline, order: list[str], warnings: list[str]) -> set[str]:
    """Disabled nodes and everything that depends on one."""
    out: set[str] = {n.id for n in doc.nodes if n.disabled}
    warnings += [f"node '{x}' is disabled" for x in order if x in out]
    for x in order:
        if x not in out and (lost := [e.source for e in doc.edges if e.target == x and e.source in out]):
            out.add(x)
            warnings.append(f"node '{x}' is left out: it needs '{lost[0]}'")
    return out


def _inputs(node: Node, component: Component, edges: list[Edge], nodes: dict[str, Node], known: dict[str, Component]) -> list[tuple[str, str, str]]:
    if not component.inputs:
        if edges:
            raise PipelineError(f"node '{node.id}': {component.id} takes no input")
        return []
    named, free = {}, []
    for e in edges:
        port, out = _ports(e, nodes, known)
        if port in component.inputs and not component.many:
            if port in named:
                raise PipelineError(f"node '{node.id}': input '{port}' has two edges")
            named[port] = (port, e.source, out)
        else:
            free.append((e.source, out))
    if component.many:
        if not free and component.id != "xf.sql":
            raise PipelineError(f"node '{node.id}': {component.id} needs an input")
        if component.id in ("xf.union", "xf.intersect", "xf.except") and len(free) < 2:
            raise PipelineError(f"node '{node.id}': {component.id} needs two inputs")
        first = {"left": 0, "right": 1}
        ranked = sorted(range(len(edges)), key=lambda i: (first.get(edges[i].target_handle or "", 2 if any(e.target_handle in first for e in edges) else 0), i))
        return [(f"in{n}", *free[i]) for n, i in enumerate(ranked)]
    missing = [p for p in component.inputs if p not in named]
    if len(free) != len(missing):
        raise PipelineError(f"node '{node.id}': {component.id} takes {len(component.inputs)} input{'s' * (len(component.inputs) > 1)}, not {len(edges)}")
    named |= {p: (p, *x) for p, x in zip(missing, free, strict=True)}
    return [named[p] for p in component.inputs]


def preview_plan(plan: Plan, node: str) -> Plan:
    """The part of a plan that a node needs, without sinks."""
    by_id = {s.id: s for s in plan.stages}
    if node not in by_id:
        raise PipelineError(f"there is no node '{node}' to preview")
    wanted, todo = set(), [node]
    owner = {s.id: s.id for s in plan.stages} | {s.node.alias: s.id for s in plan.stages if s.node.alias}
    while todo:
        x = todo.pop()
        if x not in wanted:
            wanted.add(x)
            todo += [source for _, source, _ in by_id[x].inputs]
            todo += [owner[n] for n in _mentions(by_id[x].node, list(owner)) if owner[n] != x] if by_id[x].component.id == "xf.sql" else []
    return Plan([s for s in plan.stages if s.id in wanted and s.component.kind != "sink"], plan.warnings, plan.name)
