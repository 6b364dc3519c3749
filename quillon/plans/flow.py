"""An immutable builder of dataflows: named steps, their inputs, and one run as a DataFrame plan.

    flow = Flow().add("split", sentences).add("encode", encode).add("merge", merge, after=("split", "encode"))
    flow.run(docs)

A step is a function of DataFrames. A step with a method `fit` is an estimator: `train` gives the flow with what it fitted in its
place, and an untrained one doesn't run. A flow may have further sources, which `run` takes by name. `index` writes the result of a
flow, `query` runs one with what is written as its source `index`.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

Step = Callable[..., DataFrame]
SOURCE = "source"

#: What configurations may name; filled by `register`.
REGISTRY: dict[str, Callable[..., Step]] = {}


def register(name: str) -> Callable[[Callable[..., Step]], Callable[..., Step]]:
    """Makes a factory of steps known to configurations."""

    def keep(factory: Callable[..., Step]) -> Callable[..., Step]:
        REGISTRY[name] = factory
        return factory

    return keep


@dataclass(frozen=True)
class Node:
    after: tuple[str, ...]
    step: Step = field(compare=False)
    kind: str = field(default="step", compare=False)
    #: What a configuration named, to export it again.
    use: str | None = field(default=None, compare=False)
    options: tuple[tuple[str, object], ...] = field(default=(), compare=False)


@dataclass(frozen=True)
class Flow:
    """Equal to another with the same names and edges."""

    nodes: tuple[tuple[str, Node], ...] = ()
    last: str = SOURCE
    sources: tuple[str, ...] = (SOURCE,)

    def _names(self) -> dict[str, Node]:
        return dict(self.nodes)

    def source(self, name: str) -> Flow:
        """A further source, which steps may follow and `run` takes by name."""
        if not name.isidentifier() or name in self._names() or name in self.sources:
            raise ValueError(f"{name!r} can't be the name of a source")
        return replace(self, sources=(*self.sources, name))

    def add(self, name: str, step: Step, after: str | tuple[str, ...] | None = None, kind: str = "step", use: str | None = None, options: dict | None = None) -> Flow:
        """A further step; without `after` it follows the one added or changed last."""
        names = self._names()
        if not name.isidentifier() or name in self.sources:
            raise ValueError(f"{name!r} can't be a name")
        if name in names:
            raise ValueError(f"{name} is there already")
        after = (self.last,) if after is None else (after,) if isinstance(after, str) else tuple(after)
        self._check(name, after, names)
        return replace(self, nodes=(*self.nodes, (name, Node(after, step, kind, use, tuple(sorted((options or {}).items()))))), last=name)

    def add_preprocessor(self, name: str, step: Step, after: str | tuple[str, ...] | None = None) -> Flow:
        return self.add(name, step, after, "preprocessor")

    def add_encoder(self, name: str, step: Step, after: str | tuple[str, ...] | None = None) -> Flow:
        return self.add(name, step, after, "encoder")

    def add_indexer(self, name: str, step: Step, after: str | tuple[str, ...] | None = None) -> Flow:
        return self.add(name, step, after, "indexer")

    def add_router(self, name: str, step: Step, after: str | tuple[str, ...] | None = None) -> Flow:
        return self.add(name, step, after, "router")

    def use(self, name: str, registered: str, after: str | tuple[str, ...] | None = None, **options: object) -> Flow:
        """A step that is registered, with its options."""
        if registered not in REGISTRY:
            raise ValueError(f"nothing is registered as {registered!r}")
        return self.add(name, REGISTRY[registered](**options), after, use=registered, options=options)

    def _check(self, name: str, after: tuple[str, ...], names: dict[str, Node]) -> None:
        for a in after:
            if a == name:
                raise ValueError(f"{name} can't follow itself")
            if a not in self.sources and a not in names:
                raise ValueError(f"no step {a}")

    def set(self, name: str, step: Step | None = None, after: str | tuple[str, ...] | None = None) -> Flow:
        """Another function or other inputs for a step."""
        names = self._names()
        if name not in names:
            raise ValueError(f"no step {name}")
        old = names[name]
        after = old.after if after is None else (after,) if isinstance(after, str) else tuple(after)
        self._check(name, after, names)
        names[name] = replace(old, after=after) if step is None else Node(after, step, old.kind)
        made = replace(self, nodes=tuple(names.items()), last=name)
        made.order()
        return made

    def remove(self, name: str) -> Flow:
        """Without a step; what followed it follows its inputs."""
        names = self._names()
        if name not in names:
            raise ValueError(f"no step {name}")
        gone = names.pop(name)
        for k, node in names.items():
            if name in node.after:
                names[k] = replace(node, after=tuple(dict.fromkeys(x for a in node.after for x in (gone.after if a == name else (a,)))))
        return replace(self, nodes=tuple(names.items()), last=gone.after[0] if self.last == name else self.last)

    def ending_at(self, name: str) -> Flow:
        if name not in self._names():
            raise ValueError(f"no step {name}")
        return replace(self, last=name)

    def order(self) -> list[str]:
        """Names so that each comes after its inputs; a cycle is an error."""
        names, done, out = self._names(), set(self.sources), []
        while len(out) < len(names):
            ready = [k for k, n in names.items() if k not in done and all(a in done for a in n.after)]
            if not ready:
                raise ValueError("the steps form a cycle")
            out += ready
            done.update(ready)
        return out

    def run(self, source: DataFrame, **others: DataFrame) -> DataFrame:
        """The plan of the last step over its sources. A step that several others follow is one plan that Spark can reuse."""
        return self._made(source, others, train=False)[0]

    def train(self, source: DataFrame, **others: DataFrame) -> Flow:
        """The flow with each estimator fitted to what comes in to it. Fitted steps and plain ones stay as they are."""
        return self._made(source, others, train=True)[1]

    def index(self, path: str, source: DataFrame, **others: DataFrame) -> None:
        """Adds the result to the table at `path`."""
        self.run(source, **others).write.mode("append").parquet(path)

    def query(self, path: str, source: DataFrame, **others: DataFrame) -> DataFrame:
        """The result over a source, with the table at `path` as the source `index`."""
        return self.run(source, index=source.sparkSession.read.parquet(path), **others)

    def _made(self, source: DataFrame, others: dict[str, DataFrame], train: bool) -> tuple[DataFrame, Flow]:
        if not self.nodes:
            raise ValueError("a flow needs a step")
        if missing := [x for x in self.sources[1:] if x not in others]:
            raise ValueError(f"no source {', '.join(missing)}")
        made = {SOURCE: source} | others
        names = self._names()
        for k in self.order():
            step, inputs = names[k].step, [made[a] for a in names[k].after]
            if hasattr(step, "fit"):
                if not train:
                    raise ValueError(f"{k} has to be trained")
                step = step.fit(*inputs)
                names[k] = replace(names[k], step=step)
            made[k] = step(*inputs)
        return made[self.last], replace(self, nodes=tuple(names.items()))

    def mermaid(self) -> str:
        return "\n".join(["graph LR", *(f"{a}-->{k}" for k, n in self.nodes for a in n.after)])

    def edges(self) -> str:
        """The names and inputs as JSON."""
        return json.dumps({k: list(n.after) for k, n in self.nodes}, sort_keys=True)

    def to_config(self) -> list[dict]:
        """What `from_config` makes this flow from; every step must be a registered one."""
        if plain := [k for k, n in self.nodes if n.use is None]:
            raise ValueError(f"not registered: {', '.join(plain)}")
        steps = [{"name": k, "use": n.use, "with": dict(n.options), "after": list(n.after)} for k, n in self.nodes]
        return [*({"source": x} for x in self.sources[1:]), *steps]

    def to_yaml(self) -> str:
        import yaml

        return yaml.safe_dump(self.to_config(), sort_keys=False)

    def to_code(self) -> str:
        """Python that makes this flow from registered steps."""
        lines = ["Flow()", *(f".source({x!r})" for x in self.sources[1:])]
        for entry in self.to_config()[len(self.sources) - 1 :]:
            options = "".join(f", {k}={v!r}" for k, v in entry["with"].items())
            lines.append(f".use({entry['name']!r}, {entry['use']!r}, after={tuple(entry['after'])!r}{options})")
        return "(" + "\n    ".join(lines) + ")"

    @classmethod
    def from_config(cls, config: list[dict]) -> Flow:
        """From entries {name, use, with, after} and {source}; `use` is a registered factory, and nothing else is looked up or evaluated."""
        flow = cls()
        for entry in config:
            if "source" in entry:
                flow = flow.source(entry["source"])
                continue
            after = entry.get("after")
            flow = flow.use(entry["name"], entry["use"], tuple(after) if isinstance(after, list) else after, **entry.get("with", {}))
        return flow

    @classmethod
    def from_yaml(cls, text: str) -> Flow:
        import yaml

        return cls.from_config(yaml.safe_load(text))


def _open(kind: str) -> Step:
    def step(*_: DataFrame) -> DataFrame:
        raise NotImplementedError(f"give this {kind} a step with set()")

    return step


def index_flow() -> Flow:
    """Preparation, encoding, the table of vectors beside that of documents, and their join; the steps are to be given with `set`."""
    flow = Flow().add_preprocessor("prep", _open("preprocessor")).add_encoder("enc", _open("encoder")).add_indexer("vec_idx", _open("indexer"))
    return flow.add_indexer("doc_idx", _open("indexer"), after="prep").add_router("sync", _open("router"), after=("vec_idx", "doc_idx"))


def query_flow() -> Flow:
    """Preparation, encoding, search, scores by document, the documents; the steps are to be given with `set`."""
    flow = Flow().add_preprocessor("prep", _open("preprocessor")).add_encoder("enc", _open("encoder")).add_indexer("vec_idx", _open("indexer"))
    return flow.add_router("scorer", _open("router")).add_indexer("doc_idx", _open("indexer"))
