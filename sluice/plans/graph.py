"""Pipelines as graphs: nodes are functions from DataFrames to DataFrames, edges join their ports.

Building composes lazy plans, so the optimiser sees through all nodes at once; nothing runs before an action. Names are
checked as edges are added. A port may feed many edges (the plan is shared); two edges into one input port are an error
unless the node takes a union there. Cycles run in rounds on the driver.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..operators.control import retry
from ..operators.order import merged
from ..operators.working import saved


class GraphError(ValueError):
    """A name that isn't there, a port used twice, or a graph that can't run."""


@dataclass
class Node:
    """f takes input ports by name and gives a DataFrame (port `out`) or a dict of them."""

    name: str
    f: Callable
    inputs: tuple[str, ...]
    outputs: tuple[str, ...]
    kind: str = ""
    supervision: str = "stop"


@dataclass(frozen=True)
class Edge:
    source: str
    source_port: str
    target: str
    target_port: str


@dataclass
class Graph:
    name: str
    nodes: dict[str, Node] = field(default_factory=dict)
    edges: list[Edge] = field(default_factory=list)
    exposed_inputs: dict[str, tuple[str, str]] = field(default_factory=dict)
    exposed_outputs: dict[str, tuple[str, str]] = field(default_factory=dict)

    def add(self, name: str, f: Callable, inputs: list[str] | None = None, outputs: list[str] | None = None, kind: str = "", supervision: str = "stop") -> Graph:
        """Input ports are f's parameters unless given."""
        if name in self.nodes:
            raise GraphError(f"node {name} is there already")
        ports = [p.name for p in inspect.signature(f).parameters.values() if p.default is p.empty] if inputs is None else inputs
        self.nodes[name] = Node(name, f, tuple(ports), tuple(outputs or ["out"]), kind or getattr(f, "__name__", ""), supervision)
        return self

    def remove(self, name: str) -> Graph:
        if any(name in (e.source, e.target) for e in self.edges):
            raise GraphError(f"node {name} has edges")
        del self.nodes[self._node(name).name]
        return self

    def _node(self, name: str) -> Node:
        if name not in self.nodes:
            raise GraphError(f"no node {name}")
        return self.nodes[name]

    def connect(self, source: str, target: str, source_port: str = "out", target_port: str | None = None) -> Graph:
        a, b = self._node(source), self._node(target)
        target_port = target_port or (b.inputs[0] if b.inputs else "")
        if source_port not in a.outputs:
            raise GraphError(f"no output port {source}.{source_port}")
        if target_port not in b.inputs:
            raise GraphError(f"no input port {target}.{target_port}")
        if any((e.target, e.target_port) == (target, target_port) for e in self.edges):
            raise GraphError(f"{target}.{target_port} has an edge; merge them first")
        self.edges.append(Edge(source, source_port, target, target_port))
        return self

    def disconnect(self, edge: Edge) -> Graph:
        self.edges.remove(edge)
        return self

    def expose_input(self, name: str, node: str, port: str) -> Graph:
        if port not in self._node(node).inputs:
            raise GraphError(f"no input port {node}.{port}")
        self.exposed_inputs[name] = (node, port)
        return self

    def expose_output(self, name: str, node: str, port: str = "out") -> Graph:
        if port not in self._node(node).outputs:
            raise GraphError(f"no output port {node}.{port}")
        self.exposed_outputs[name] = (node, port)
        return self

    def feedback_edges(self) -> list[Edge]:
        """Edges that close a cycle, going depth first in the order of addition."""
        state: dict[str, int] = {}
        back: list[Edge] = []

        def visit(name: str) -> None:
            state[name] = 1
            for e in self.edges:
                if e.source == name:
                    if state.get(e.target) == 1:
                        back.append(e)
                    elif e.target not in state:
                        visit(e.target)
            state[name] = 2

        for name in self.nodes:
            if name not in state:
                visit(name)
        return back

    def has_cycles(self) -> bool:
        return bool(self.feedback_edges())

    def order(self, without: list[Edge] | None = None) -> list[str]:
        """Nodes so that edges point forwards."""
        edges = [e for e in self.edges if e not in (without or [])]
        waiting = {n: {e.source for e in edges if e.target == n} for n in self.nodes}
        out: list[str] = []
        while waiting:
            ready = [n for n, before in waiting.items() if before <= set(out)]
            if not ready:
                raise GraphError("the graph has a cycle; run it in rounds")
            out += ready
            for n in ready:
                del waiting[n]
        return out

    def _run(self, inputs: dict[str, DataFrame], fed: dict[tuple[str, str], DataFrame], skip: list[Edge]) -> dict[tuple[str, str], DataFrame]:
        bound = dict(fed)
        for name, df in inputs.items():
            if name not in self.exposed_inputs:
                raise GraphError(f"no input {name}")
            bound[self.exposed_inputs[name]] = df
        made: dict[tuple[str, str], DataFrame] = {}
        for name in self.order(skip):
            node, args = self.nodes[name], {}
            for port in node.inputs:
                edge = next((e for e in self.edges if (e.target, e.target_port) == (name, port) and e not in skip), None)
                if edge:
                    args[port] = made[edge.source, edge.source_port]
                elif (name, port) in bound:
                    args[port] = bound[name, port]
                else:
                    raise GraphError(f"nothing is connected to {name}.{port}")
            out = retry(lambda node=node, args=args: node.f(**args), 3 if node.supervision == "restart" else 0)
            for port, df in (out if isinstance(out, dict) else {"out": out}).items():
                made[name, port] = df
        return made

    def run(self, **inputs: DataFrame) -> dict[str, DataFrame]:
        """Lazy plans of the exposed outputs."""
        made = self._run(inputs, {}, [])
        return {k: made[v] for k, v in self.exposed_outputs.items()}

    def run_rounds(self, max_rounds: int, **inputs: DataFrame) -> dict[str, DataFrame]:
        """With cycles: each round's feedback, written, enters the next one; outer input enters the first one only. Outputs of all rounds together."""
        back, fed, out = self.feedback_edges(), {}, {k: [] for k in self.exposed_outputs}
        first = inputs
        empty = {self.exposed_inputs[k]: df.limit(0) for k, df in inputs.items()}
        for i in range(max_rounds):
            if not i:
                seed = next(iter(inputs.values())).limit(0)
                fed = {(e.target, e.target_port): seed for e in back}
            made = self._run(first, fed, back)
            for k, v in self.exposed_outputs.items():
                out[k].append(saved(made[v]))
            fed = empty | {(e.target, e.target_port): saved(made[e.source, e.source_port]) for e in back}
            first = {}
            if back and all(df.isEmpty() for k, df in fed.items() if k not in empty):
                break
        return {k: merged(v) for k, v in out.items()}

    def as_node(self) -> Callable:
        """The graph as a node of another: ports are its exposed names."""
        return lambda **inputs: self.run(**inputs)


def downstream(graph: Graph, source: str) -> list[str]:
    """The node and all that it feeds, in order."""
    found = {source}
    for name in graph.order(graph.feedback_edges()):
        if any(e.target == name and e.source in found for e in graph.edges):
            found.add(name)
    return [n for n in graph.order(graph.feedback_edges()) if n in found]


def plan_recompute(graph: Graph, source: str, times: tuple[int, int], frontiers: dict[str, int]) -> list[str]:
    """Nodes to run again after times [a, b] of `source` changed; sinks whose frontier is past b are done."""
    sinks = {n for n in graph.nodes if not any(e.source == n for e in graph.edges)}
    return [n for n in downstream(graph, source) if not (n in sinks and frontiers.get(n, -1) > times[1])]


def in_range(df: DataFrame, time: str, times: tuple[int, int]) -> DataFrame:
    """Both ends included; the filter reaches the files."""
    return df.filter((df[time] >= times[0]) & (df[time] <= times[1]))


def recompute(df: DataFrame, time: str, times: tuple[int, int], f: Callable[[DataFrame], DataFrame], path: str, partition_by: list[str]) -> None:
    """f over the range alone, in place of the partitions that it gives."""
    f(in_range(df, time, times)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)
