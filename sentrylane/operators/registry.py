"""Extension points: analysers that produce findings, listeners that see responses."""

import logging
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame

from sentrylane import schemas

log = logging.getLogger(__name__)

Analyzer = Callable[[DataFrame], DataFrame]
Listener = Callable[[DataFrame, int], None]


class AnalyzerRegistry:
    """Named analysers, each a function from an input table to findings."""

    def __init__(self):
        self._analyzers: dict[str, Analyzer] = {}
        self._paused: set[str] = set()

    def register(self, name: str, analyzer: Analyzer) -> None:
        self._analyzers[name] = analyzer

    def unregister(self, name: str) -> None:
        self._analyzers.pop(name, None)
        self._paused.discard(name)

    def pause(self, name: str) -> None:
        self._paused.add(name)

    def resume(self, name: str) -> None:
        self._paused.discard(name)

    @property
    def active(self) -> list[str]:
        return [n for n in self._analyzers if n not in self._paused]

    def analyze(self, table: DataFrame) -> DataFrame:
        """Bag union of what the active analysers find; a wrong schema is an error."""
        columns = schemas.FINDINGS.fieldNames()
        parts = [
            schemas.assert_columns(self._analyzers[n](table), schemas.FINDINGS, n).select(*columns)
            for n in self.active
        ]
        if not parts:
            return table.sparkSession.createDataFrame([], schemas.FINDINGS)
        return reduce(DataFrame.unionByName, parts)


class ResponseListeners:
    """Callbacks over each batch of executed actions."""

    def __init__(self):
        self._listeners: list[Listener] = []

    def add(self, listener: Listener) -> None:
        self._listeners.append(listener)

    def notify(self, actions: DataFrame, batch_id: int) -> None:
        """Call every listener; one that fails is logged and the others still run."""
        for listener in self._listeners:
            try:
                listener(actions, batch_id)
            except Exception:
                log.exception("response listener failed on batch %s", batch_id)
