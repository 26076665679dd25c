"""Named objects, a catalog of operations and a log that can be replayed."""

from __future__ import annotations

import difflib
import inspect
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Operation:
    """A function on DataFrames under a key, with its group and a line of help."""

    key: str
    function: Callable[..., DataFrame]
    group: str = ""
    help: str = ""

    @property
    def settings(self) -> tuple[str, ...]:
        return tuple(inspect.signature(self.function).parameters)


class Catalog:
    """Operations by key; a key is not overwritten silently."""

    def __init__(self) -> None:
        self.operations: dict[str, Operation] = {}

    def register(self, key: str, function: Callable[..., DataFrame], group: str = "", replace: bool = False) -> None:
        if key in self.operations and not replace:
            raise KeyError(f"operation {key!r} is already registered")
        self.operations[key] = Operation(key, function, group, (inspect.getdoc(function) or "").split("\n")[0])

    def find(self, key: str) -> Operation:
        if key not in self.operations:
            near = difflib.get_close_matches(key, self.operations)
            raise KeyError(f"no operation {key!r}" + (f"; did you mean {', '.join(near)}?" if near else ""))
        return self.operations[key]


def default_catalog() -> Catalog:
    """The operations of this package."""
    from scanweave import model
    from scanweave.operators import combine, curves, fitting, imaging, pumpprobe, reductions, scans, scattering

    catalog = Catalog()
    groups = {
        "Extract": (reductions, model), "Pump-probe": (pumpprobe,), "Multi-scan": (scans,), "Process": (curves,),
        "Combine": (combine,), "Imaging": (imaging,), "Scattering": (scattering,), "Fit": (fitting,),
    }
    for group, modules in groups.items():
        for module in modules:
            for name, function in inspect.getmembers(module, inspect.isfunction):
                if function.__module__ == module.__name__ and not name.startswith("_") and name not in catalog.operations:
                    catalog.register(name, function, group)
    return catalog


@dataclass
class Workspace:
    """Objects by name; ``run`` applies an operation, keeps its result as an object and a view, and logs the step."""

    spark: SparkSession
    catalog: Catalog = field(default_factory=default_catalog)
    objects: dict[str, DataFrame] = field(default_factory=dict)
    log: list[dict] = field(default_factory=list)

    def add(self, name: str, df: DataFrame) -> DataFrame:
        self.objects[name] = df
        df.createOrReplaceTempView(name)
        return df

    def run(self, operation: str, *inputs: str, name: str, **settings: object) -> DataFrame:
        op = self.catalog.find(operation)
        unknown = set(settings) - set(op.settings)
        if unknown:
            raise TypeError(f"{operation} has no setting {', '.join(sorted(unknown))}")
        out = self.add(name, op.function(*[self.objects[i] for i in inputs], **settings))
        self.log.append({"operation": operation, "inputs": list(inputs), "name": name, "settings": settings})
        return out

    def script(self) -> str:
        """The log as JSON lines, which ``replay`` runs again."""
        return "\n".join(json.dumps(step, default=list) for step in self.log)

    def replay(self, script: str) -> None:
        for line in filter(None, script.split("\n")):
            step = json.loads(line)
            settings = {k: tuple(v) if isinstance(v, list) else v for k, v in step["settings"].items()}
            self.run(step["operation"], *step["inputs"], name=step["name"], **settings)
