"""The tables of a graph, and the parameters of a view on it."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame

from .functions.globs import normalize_glob, parse_globs, serialize_globs

NODES = "graph_id string, idx long, id string, label string, type_id int, type string, meta variant, declared boolean"
EDGES = "graph_id string, eidx long, src long, dst long, type_id int, type string"
TYPES = "graph_id string, type_id int, name string"
MISSING = "missing"
#: More nodes than this hide the edges by default.
MANY_NODES = 1000


class SchemaError(ValueError):
    """The input document is not a graph."""


@dataclass(frozen=True)
class GraphTables:
    """nodes, edges and their type dictionaries; many graphs by graph_id."""

    nodes: DataFrame
    edges: DataFrame
    node_types: DataFrame
    edge_types: DataFrame


def _ints(text: str | None) -> frozenset[int]:
    return frozenset(int(x) for x in (text or "").split(",") if re.fullmatch(r"\s*\d+\s*", x))


def _ids(text: str | None) -> tuple[str, ...]:
    return tuple(dict.fromkeys(x for x in (text or "").split(",") if x))


def _number(text: str | None, default: float) -> float:
    found = re.match(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", text or "")
    return float(found[0]) if found else default


def _shown(x: float) -> str:
    return str(int(x)) if x == int(x) else repr(x)


#: Numeric parameters: their defaults.
_FLOATS = {"repulsion": 6.0, "nodeDistance": 18.0, "clusterDistance": 180.0, "clustering": 1.0}
_FLAGS = {"cyclesOnly": False, "edges": True, "arrows": True, "hulls": False}
_ID_SETS = ("collapsed", "hiddenNodes", "rootNodes")
_INT_SETS = ("hiddenEdgeTypes", "hiddenNodeTypes")
_GLOBS = ("includeGlobs", "excludeGlobs")


@dataclass(frozen=True)
class GraphView:
    """All view parameters; every change gives a new view."""

    hiddenEdgeTypes: frozenset[int] = frozenset()
    hiddenNodeTypes: frozenset[int] = frozenset()
    collapsed: tuple[str, ...] = ()
    hiddenNodes: tuple[str, ...] = ()
    rootNodes: tuple[str, ...] = ()
    includeGlobs: tuple[str, ...] = ()
    excludeGlobs: tuple[str, ...] = ()
    cyclesOnly: bool = False
    selected: str | None = None
    clustering: float = 1.0
    cluster: str | None = None
    segments: int | None = None
    repulsion: float = 6.0
    nodeDistance: float = 18.0
    clusterDistance: float = 180.0
    edges: bool = True
    arrows: bool = True
    hulls: bool = False

    @classmethod
    def from_dict(cls, params: dict[str, str | None]) -> GraphView:
        """The view of string parameters; what is absent or no value is the default."""
        v: dict = {k: _ints(params.get(k)) for k in _INT_SETS} | {k: _ids(params.get(k)) for k in _ID_SETS}
        v |= {k: tuple(parse_globs(params.get(k))) for k in _GLOBS}
        v |= {k: _number(params.get(k), d) for k, d in _FLOATS.items()}
        v |= {k: d if params.get(k) is None else params[k] in ("1", "true") for k, d in _FLAGS.items()}
        n = _number(params.get("segments"), 0)
        return cls(**v, selected=params.get("selected") or None, cluster=params.get("cluster") or None, segments=int(n) if n >= 1 else None)

    def to_dict(self) -> dict[str, str]:
        """String parameters of what differs from the default."""
        out = {k: ",".join(map(str, sorted(getattr(self, k)))) for k in _INT_SETS} | {k: ",".join(getattr(self, k)) for k in _ID_SETS}
        out |= {k: serialize_globs(getattr(self, k)) or "" for k in _GLOBS}
        out |= {k: "" if getattr(self, k) == d else _shown(getattr(self, k)) for k, d in _FLOATS.items()}
        out |= {k: "" if getattr(self, k) == d else str(int(getattr(self, k))) for k, d in _FLAGS.items()}
        out |= {"selected": self.selected or "", "cluster": self.cluster or "", "segments": str(self.segments or "")}
        return {k: v for k, v in out.items() if v}

    def toggled(self, name: str, value: int | str) -> GraphView:
        """The symmetric difference of a set parameter with one value."""
        now = getattr(self, name)
        if isinstance(now, frozenset):
            return replace(self, **{name: now ^ {value}})
        return replace(self, **{name: tuple(x for x in now if x != value) if value in now else (*now, value)})

    def cleared(self, name: str) -> GraphView:
        return replace(self, **{name: type(getattr(self, name))()})

    def select(self, node_id: str | None) -> GraphView:
        return replace(self, selected=node_id)

    def add_glob(self, name: str, raw: str) -> GraphView:
        """With one more pattern; invalid or known ones change nothing."""
        glob = normalize_glob(raw)
        now = getattr(self, name)
        return self if glob is None or glob in now else replace(self, **{name: (*now, glob)})

    def remove_glob(self, name: str, glob: str) -> GraphView:
        return replace(self, **{name: tuple(g for g in getattr(self, name) if g != glob)})

    def opened(self, n_nodes: int) -> GraphView:
        """The view of a graph just opened: what names parts of the old graph
        is reset, and many nodes hide the edges."""
        scoped = {*_INT_SETS, *_ID_SETS, "selected", "cyclesOnly"}
        kept = {f.name: getattr(self, f.name) for f in fields(self) if f.name not in scoped}
        return replace(GraphView(**kept), edges=n_nodes <= MANY_NODES)
