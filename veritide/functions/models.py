"""Models that workers load for themselves: a handle travels with the plan, the model is made once in each Python worker."""

from __future__ import annotations

import importlib
import inspect
import os
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark import TaskContext

#: What this process has loaded, by handle.
_loaded: dict[str, object] = {}


def device_here() -> str:
    """The device of the task that asks: a GPU that Spark assigned to it, else the CPU."""
    task = TaskContext.get()
    gpus = task.resources().get("gpu") if task else None
    return f"cuda:{gpus.addresses[0]}" if gpus and gpus.addresses else "cpu"


class Lazy:
    """Stands for a model that factory makes, in whichever process first asks for it.

    factory is a callable or "module:function"; if it takes device, it gets the one given, or by default the
    task's. settings are its other arguments. What is pickled into a plan is the factory, never the model.
    """

    def __init__(self, factory: Callable[..., object] | str, device: str | None = None, dimension: int | None = None, **settings: object):
        self.factory, self.device, self.settings = factory, device, settings
        self.key = uuid.uuid4().hex
        self._dimension = dimension

    def load(self) -> object:
        """The process's own model."""
        key = f"{os.getpid()}-{self.key}"  # a forked worker must not take its parent's
        if key not in _loaded:
            factory = self.factory
            if isinstance(factory, str):
                module, _, name = factory.partition(":")
                factory = getattr(importlib.import_module(module), name)
            takes = inspect.signature(factory).parameters
            device = {"device": self.device or device_here()} if "device" in takes else {}
            _loaded[key] = factory(**self.settings, **device)
        return _loaded[key]

    @property
    def dimension(self) -> int:
        """Of an embedder: as given, else as the model says, which loads it here."""
        return self._dimension if self._dimension is not None else self.load().dimension

    def embed(self, texts: list[str]):
        return self.load().embed(texts)

    def score(self, pairs: list[tuple[str, str]]):
        return self.load().score(pairs)

    def count_tokens(self, texts: list[str]) -> list[int]:
        return self.load().count_tokens(texts)


class Labelled:
    """An entailment scorer over a model that gives its classes in an order of its own.

    labels names the class of each place, as a sequence or from place to name, in any case; without it the model's id2label is
    asked. Other classes may stand between; one of the three missing is an error, seen before anything is scored.
    """

    NAMES = ("entailment", "neutral", "contradiction")

    def __init__(self, model, labels: Sequence[str] | Mapping[int, str] | None = None):
        labels = labels if labels is not None else getattr(model, "id2label", None) or ()
        places = labels.items() if isinstance(labels, Mapping) else enumerate(labels)
        known = {str(name).lower(): int(place) for place, name in places}
        if lacking := [n for n in self.NAMES if n not in known]:
            raise ValueError(f"the entailment model's labels lack {', '.join(lacking)}")
        self.model, self.order = model, [known[n] for n in self.NAMES]

    def score(self, pairs: list[tuple[str, str]]) -> list[tuple[float, float, float]]:
        out = []
        for row in self.model.score(pairs):
            values = [float(x) for x in row]
            if len(values) <= max(self.order):
                raise ValueError(f"the entailment model gave {len(values)} scores for its labels")
            out.append(tuple(values[i] for i in self.order))
        return out
