"""A workspace: named DataFrames with undo, redo, exclusion, previews, and a script of what was done."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from . import tables

#: Fixed value: how many steps back are held.
DEPTH = 10


@dataclass(frozen=True)
class State:
    active: DataFrame
    excluded: DataFrame | None = None
    derived: dict = field(default_factory=dict)
    filters: dict = field(default_factory=dict)


class Workspace:
    """DataFrames are immutable plans, so a step back is a reference and copies nothing."""

    def __init__(self, base: DataFrame):
        self.base, self.state = base, State(base)
        self.back: list[State] = []
        self.ahead: list[State] = []
        self.log: list[str] = []
        self.preview: dict[str, DataFrame] = {}

    def _set(self, state: State, call: str) -> None:
        self.back = [*self.back, self.state][-DEPTH:]
        self.ahead, self.state = [], state
        runs = sum(x.split("#")[0].strip() == call for x in self.log)
        self.log.append(call if not runs else f"{call}  # run {runs + 1}")

    def apply(self, step, call: str) -> None:
        """A step from DataFrame to DataFrame on the active rows."""
        self._set(replace(self.state, active=step(self.state.active)), call)

    def derive(self, name: str, df: DataFrame, call: str) -> None:
        self._set(replace(self.state, derived=self.state.derived | {name: df}), call)

    def exclude(self, keys: DataFrame, reason: str, key: str = "report_id") -> None:
        active, excluded = tables.exclude(self.state.active, self.state.excluded, keys, reason, key)
        self._set(replace(self.state, active=active, excluded=excluded), f"exclude({reason!r})")

    def restore(self, keys: DataFrame, key: str = "report_id") -> None:
        if self.state.excluded is None:
            return
        active, excluded = tables.restore(self.state.active, self.state.excluded, keys, key)
        self._set(replace(self.state, active=active, excluded=excluded), "restore()")

    def undo(self) -> bool:
        if not self.back:
            return False
        self.ahead.append(self.state)
        self.state = self.back.pop()
        return True

    def redo(self) -> bool:
        if not self.ahead:
            return False
        self.back.append(self.state)
        self.state = self.ahead.pop()
        return True

    def start_over(self) -> None:
        self._set(State(self.base), "start_over()")

    def show(self, name: str, df: DataFrame) -> None:
        self.preview[name] = df

    def accept(self, name: str) -> None:
        self.derive(name, self.preview.pop(name), f"accept({name!r})")

    def discard(self, name: str) -> None:
        self.preview.pop(name, None)

    def script(self) -> str:
        return "\n".join(self.log)

    def snapshot(self, path: str, filters: dict | None = None) -> None:
        """The active and excluded rows as Parquet, filters and script as JSON beside them."""
        facts = json.dumps({"filters": filters or self.state.filters, "script": self.log, "excluded": self.state.excluded is not None})
        self.state.active.write.mode("overwrite").parquet(f"{path}/active")
        if self.state.excluded is not None:
            self.state.excluded.write.mode("overwrite").parquet(f"{path}/excluded")
        self.base.sparkSession.createDataFrame([(facts,)], "facts string").coalesce(1).write.mode("overwrite").text(f"{path}/facts")
        self.state = replace(self.state, filters=filters or self.state.filters)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Workspace:
        """A snapshot as a new workspace: its rows and filters are there, steps back are not."""
        facts = json.loads(spark.read.text(f"{path}/facts").first()[0])
        out = cls(spark.read.parquet(f"{path}/active"))
        excluded = spark.read.parquet(f"{path}/excluded") if facts["excluded"] else None
        out.state = State(out.base, excluded, {}, facts["filters"])
        return out
