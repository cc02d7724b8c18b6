"""Site-specific steps by name: how a job becomes addresses, a document rows, a file's bytes tags, and a match tags."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Step = Callable[[DataFrame], DataFrame]
KINDS = ("fan_out", "parse", "on_file", "on_match", "on_start")


class Registry:
    """Steps are functions from tables to tables, so what they do is planned with everything around them."""

    def __init__(self):
        self._steps: dict[tuple[str, str], Step] = {}
        self._calls: dict[tuple[str, int, tuple[type, ...]], Callable] = {}

    def offer(self, name: str, version: int, kinds: tuple[type, ...], call: Callable) -> None:
        """A function that other steps call by name; the version and the kinds of its arguments belong to the name."""
        if (name, version, kinds) in self._calls:
            raise ValueError(f"{name} {version} is there already")
        self._calls[name, version, kinds] = call

    def call(self, name: str, version: int, *values):
        """What the function of that name, version and kinds of arguments gives; there is no other that would do."""
        found = self._calls.get((name, version, tuple(type(v) for v in values)))
        if found is None:
            raise LookupError(f"nothing offers {name} {version} for {[type(v).__name__ for v in values]}")
        return found(*values)

    def start(self, rows: DataFrame) -> dict[str, DataFrame]:
        """What each step that runs at the start makes of ``rows``, by its name."""
        return {n: self._steps["on_start", n](rows) for n in self.names("on_start")}

    def add(self, kind: str, name: str, step: Step) -> None:
        if kind not in KINDS:
            raise ValueError(f"no such kind: {kind}")
        if (kind, name) in self._steps:
            raise ValueError(f"{kind} {name} is there already")
        self._steps[kind, name] = step

    def names(self, kind: str) -> list[str]:
        return sorted(n for k, n in self._steps if k == kind)

    def run(self, kind: str, rows: DataFrame, by: str) -> DataFrame:
        """All steps of a kind, each over the rows whose column ``by`` names it; results are put together."""
        out = None
        for name in self.names(kind):
            part = self._steps[kind, name](rows.filter(F.col(by) == name)).withColumn(by, F.lit(name))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        if out is None:
            raise ValueError(f"nothing does {kind}")
        return out

    def run_all(self, kind: str, rows: DataFrame) -> DataFrame:
        """All steps of a kind, each over all rows, with the step's name in ``step``; the rows are read once if they are kept."""
        parts = [self._steps[kind, n](rows).withColumn("step", F.lit(n)) for n in self.names(kind)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out
