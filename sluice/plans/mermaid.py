"""Flowchart texts as blueprints, and back.

Edges carry their ports as a label, `source_port->target_port`, with a backslash before a backslash or an arrow in a name.
Comment lines `%% <word>: …` hold what a flowchart can't: inputs, outputs, modes, kinds and policies of nodes. The other
layout has each node as a subgraph of port boxes, named `<node>_in_<port>`, `<node>_core` and `<node>_out_<port>`.
A sidecar (JSON, or YAML if a reader for it is installed) takes precedence over comments.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from .graph import Edge, Graph, GraphError

WORD = "sluice"
BOX = re.compile(r'([\w.-]+)\s*(?:\["?(.*?)"?\]|\("?(.*?)"?\)|\{"?(.*?)"?\})?')
EDGE = re.compile(r"^(\S+?(?:\[.*?\]|\(.*?\))?)\s*--+>\s*(?:\|(.*?)\|\s*)?(\S+.*)$")
COMMENT = re.compile(r"^%%\s*\w+:\s*(.*)$")


class UnknownOperator(GraphError):
    """A kind that no registry entry makes."""


@dataclass
class Blueprint:
    nodes: dict[str, dict[str, str]] = field(default_factory=dict)
    edges: list[Edge] = field(default_factory=list)
    inputs: dict[str, tuple[str, str]] = field(default_factory=dict)
    outputs: dict[str, tuple[str, str]] = field(default_factory=dict)
    mode: str = "concurrent"
    shards: tuple[int, int] | None = None
    units: list[str] = field(default_factory=list)
    feedback: list[str] = field(default_factory=list)


def escaped(port: str) -> str:
    return port.replace("\\", "\\\\").replace("->", "\\->")


def unescaped(port: str) -> str:
    return re.sub(r"\\(\\|->)", r"\1", port)


def label(source_port: str, target_port: str) -> str:
    return f"{escaped(source_port)}->{escaped(target_port)}"


def parse_label(text: str) -> tuple[str, str] | None:
    m = re.match(r"((?:\\.|(?!->).)*)->(.*)$", text, re.S)
    return (unescaped(m[1]), unescaped(m[2])) if m else None


def _comment(bp: Blueprint, text: str) -> None:
    if m := re.match(r"input (\S+) -> (\S+)\.(\S+)$", text):
        bp.inputs[m[1]] = (m[2], m[3])
    elif m := re.match(r"output (\S+) <- (\S+)\.(\S+)$", text):
        bp.outputs[m[1]] = (m[2], m[3])
    elif m := re.match(r"execution_mode=(\w+)", text):
        bp.mode = m[1]
    elif m := re.match(r"shard_config=(\d+)/(\d+)", text):
        bp.shards = int(m[1]), int(m[2])
    elif m := re.match(r"node (\S+) (.*)$", text):
        bp.nodes.setdefault(m[1], {}).update(x.split("=", 1) for x in m[2].split() if "=" in x)
    elif m := re.match(r"(subgraph_unit|feedback) (\S+)", text):
        (bp.units if m[1] == "subgraph_unit" else bp.feedback).append(m[2])


def parse(text: str) -> Blueprint:
    bp, boxes, links, groups, inside = Blueprint(), {}, [], [], None
    for line in map(str.strip, text.splitlines()):
        if m := COMMENT.match(line):
            _comment(bp, m[1].strip())
        elif not line or line.startswith("%%") or re.match(r"(flowchart|graph|direction|style|classDef|class)\b", line):
            continue
        elif m := re.match(r'subgraph\s+([\w.-]+)\s*(?:\["?(.*?)"?\])?', line):
            inside = m[1]
            groups.append((m[1], m[2] or m[1]))
        elif line == "end":
            inside = None
        elif m := EDGE.match(line):
            ends = [BOX.match(x) for x in (m[1], m[3])]
            for x in ends:
                boxes.setdefault(x[1], next((y for y in x.groups()[1:] if y), x[1]))
            links.append((ends[0][1], (m[2] or "").strip().strip("`\"'"), ends[1][1]))
        elif m := BOX.match(line):
            boxes.setdefault(m[1], next((y for y in m.groups()[1:] if y), m[1]))
    if any(f"{g}_core" in boxes for g, _ in groups):
        _port_boxes(bp, boxes, links, groups)
        return bp
    for name in boxes:
        bp.nodes.setdefault(name, {})
    for a, ports, b in links:
        bp.edges.append(_edge(a, parse_label(ports) or ("out", "in"), b))
    bp.units += [g for g, _ in groups if g not in bp.units]
    return bp


def _edge(a: str, ports: tuple[str, str], b: str) -> Edge:
    return Edge(a, ports[0], b, ports[1])


def _port_boxes(bp: Blueprint, boxes: dict, links: list, groups: list) -> None:
    place = {}
    for node, title in groups:
        bp.nodes.setdefault(node, {}).setdefault("kind", title)
        for box, text in boxes.items():
            for way in ("in", "out"):
                if box.startswith(f"{node}_{way}_") and not any(len(g) > len(node) and box.startswith(f"{g}_{way}_") for g, _ in groups):
                    place[box] = (node, text)
    for a, _, b in links:
        if a in place and b in place:
            bp.edges.append(_edge(place[a][0], (place[a][1], place[b][1]), place[b][0]))
        elif a in place and not b.endswith("_core"):
            bp.outputs.setdefault(boxes[b], place[a])
        elif b in place and not a.endswith("_core"):
            bp.inputs.setdefault(boxes[a], place[b])


def load(path: str | Path) -> Blueprint:
    """A file, with its sidecar `<name>.json` or `<name>.yaml` beside it, if there is one."""
    path = Path(path)
    bp = parse(path.read_text())
    for side in (path.with_suffix(".json"), path.with_suffix(".yaml")):
        if side.exists():
            if side.suffix == ".yaml":
                import yaml

                found = yaml.safe_load(side.read_text())
            else:
                found = json.loads(side.read_text())
            bp.inputs |= {x["external_name"]: (x["node_id"], x["port_name"]) for x in found.get("inputs", [])}
            bp.outputs |= {x["external_name"]: (x["node_id"], x["port_name"]) for x in found.get("outputs", [])}
            bp.mode = found.get("execution_mode", bp.mode)
            for name, more in found.get("nodes", {}).items():
                bp.nodes.setdefault(name, {}).update(more)
    return bp


def blueprint(graph: Graph) -> Blueprint:
    return Blueprint({n.name: {"kind": n.kind, "supervision_policy": n.supervision} for n in graph.nodes.values()}, list(graph.edges), dict(graph.exposed_inputs), dict(graph.exposed_outputs), feedback=[e.target for e in graph.feedback_edges()])


def export(bp: Blueprint | Graph) -> str:
    bp = blueprint(bp) if isinstance(bp, Graph) else bp
    say = lambda x: f"%% {WORD}: {x}"
    out = [say("begin"), *[say(f"input {k} -> {n}.{p}") for k, (n, p) in bp.inputs.items()], *[say(f"output {k} <- {n}.{p}") for k, (n, p) in bp.outputs.items()]]
    if bp.mode != "concurrent":
        out.append(say(f"execution_mode={bp.mode}"))
    if bp.shards:
        out.append(say(f"shard_config={bp.shards[0]}/{bp.shards[1]}"))
    out += [say(f"node {n} " + " ".join(f"{k}={v}" for k, v in more.items() if v)) for n, more in bp.nodes.items() if any(more.values())]
    out += [say(f"subgraph_unit {x}") for x in bp.units] + [say(f"feedback {x}") for x in bp.feedback] + [say("end"), "flowchart TD"]
    out += [f'  {n}["{n}"]' for n in bp.nodes]
    return "\n".join([*out, *[f'  {e.source} -->|"{label(e.source_port, e.target_port)}"| {e.target}' for e in bp.edges]]) + "\n"


def build(bp: Blueprint, registry: dict[str, Callable]) -> Graph:
    """kind -> node function; ports are those that edges and bindings name. A kind that isn't there fails when its node runs."""

    def missing(name: str, kind: str) -> Callable:
        def f(**_):
            raise UnknownOperator(f"{name}: no operator {kind or '(no kind)'}")

        return f

    graph = Graph("blueprint")
    for name, more in bp.nodes.items():
        ins = [e.target_port for e in bp.edges if e.target == name] + [p for n, p in bp.inputs.values() if n == name]
        outs = [e.source_port for e in bp.edges if e.source == name] + [p for n, p in bp.outputs.values() if n == name]
        kind = more.get("kind", "")
        graph.add(name, registry.get(kind) or missing(name, kind), list(dict.fromkeys(ins)), list(dict.fromkeys(outs)), kind, more.get("supervision_policy", "stop"))
    for e in bp.edges:
        graph.connect(e.source, e.target, e.source_port, e.target_port)
    for k, (n, p) in bp.inputs.items():
        graph.expose_input(k, n, p)
    for k, (n, p) in bp.outputs.items():
        graph.expose_output(k, n, p)
    return graph
