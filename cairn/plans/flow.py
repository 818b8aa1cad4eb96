"""Flows of named steps: each step takes DataFrames at its inputs and gives DataFrames at its outputs.

A flow only composes plans. What nothing asks for is never run; an output that several steps read can be stored once, so
that what made it doesn't run again for each. Inputs may be optional: a step then gets None for what isn't connected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..errors import ExistsError, MissingError, PortError


@dataclass
class Step:
    """A step: ``run(inputs, params)`` gives a DataFrame (for one output) or a dict of them by output name.

    params are the declared ones with their defaults; a flow's settings override them, what is given here overrides both."""

    name: str
    run: Callable[..., DataFrame | dict[str, DataFrame]]
    inputs: tuple[str, ...] = ()
    outputs: tuple[str, ...] = ("out",)
    optional: tuple[str, ...] = ()
    params: Mapping[str, object] = field(default_factory=dict)
    given: Mapping[str, object] = field(default_factory=dict)

    def param(self, name: str, settings: Mapping[str, object]) -> object:
        if name not in self.params:
            raise MissingError(f"{self.name} has no parameter {name!r}")
        return self.given[name] if name in self.given else settings.get(name, self.params[name])


class Flow:
    def __init__(self, settings: Mapping[str, Mapping[str, object]] | None = None, store: Callable[[DataFrame], DataFrame] | None = None):
        """settings: by step, parameters that override defaults. store: how an output that several steps read is kept."""
        self.settings, self.store = settings or {}, store
        self.steps: dict[str, Step] = {}
        self.wires: dict[tuple[str, str], tuple[str, str]] = {}

    def add(self, *steps: Step) -> Flow:
        for s in steps:
            if self.steps.setdefault(s.name, s) is not s:
                raise ExistsError(f"two steps are named {s.name!r}")
        return self

    def connect(self, source: Step, target: Step, ports: Iterable[tuple[str, str]] | None = None) -> Flow:
        """Wires outputs to inputs; without ports, the only output to the only input. Adds the steps if they aren't there."""
        for s in (source, target):
            if s.name not in self.steps:
                self.add(s)
        if ports is None:
            if len(source.outputs) != 1 or len(target.inputs) != 1:
                raise PortError(f"{source.name} to {target.name}: ports are needed")
            ports = [(source.outputs[0], target.inputs[0])]
        for out, into in ports:
            if out not in source.outputs or into not in target.inputs:
                raise PortError(f"no ports {source.name}.{out} and {target.name}.{into}")
            if self.wires.setdefault((target.name, into), (source.name, out)) != (source.name, out):
                raise PortError(f"{target.name}.{into} is taken")
        return self

    def order(self) -> list[str]:
        """Steps after those that they read, in the order in which they were added. Raises for circles and lacking inputs."""
        for s in self.steps.values():
            if lacking := [i for i in s.inputs if i not in s.optional and (s.name, i) not in self.wires]:
                raise PortError(f"{s.name} lacks {', '.join(lacking)}")
        done: list[str] = []
        while len(done) < len(self.steps):
            ready = [n for n in self.steps if n not in done and all(src in done for (to, _), (src, _) in self.wires.items() if to == n)]
            if not ready:
                raise PortError(f"steps read each other in a circle: {sorted(set(self.steps) - set(done))}")
            done.append(ready[0])
        return done

    def run(self) -> dict[str, dict[str, DataFrame]]:
        """The outputs of all steps, by step and port; lazy but for what is stored."""
        readers: dict[tuple[str, str], int] = {}
        for at in self.wires.values():
            readers[at] = readers.get(at, 0) + 1
        made: dict[str, dict[str, DataFrame]] = {}
        for name in self.order():
            step = self.steps[name]
            inputs = {i: made[w[0]][w[1]] if (w := self.wires.get((name, i))) else None for i in step.inputs}
            params = {p: step.param(p, self.settings.get(name, {})) for p in step.params}
            got = step.run(**inputs, **params)
            got = got if isinstance(got, dict) else {step.outputs[0]: got}
            if lacking := set(step.outputs) - set(got):
                raise PortError(f"{name} gave no {', '.join(sorted(lacking))}")
            made[name] = {o: self.store(df) if self.store and readers.get((name, o), 0) > 1 else df for o, df in got.items()}
        return made
