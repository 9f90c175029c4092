"""Extension points: translators of single records, and fetchers of whole sources."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from enum import Enum
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from hexafact.operators.compile import FACT_SCHEMA
from hexafact.operators.substrate import Substrate


class InputMode(Enum):
    """How a translator is given its input."""

    QUERY = "query"
    FILE = "file"
    IDENTIFIER = "identifier"


class PluginError(Exception):
    """A translator that failed, or does not keep to the contract."""


class NotFound(PluginError):
    pass


class SourceUnavailable(PluginError):
    pass


class InvalidInput(PluginError):
    pass


@dataclass(frozen=True)
class Candidate:
    """A record that a translator offers."""

    external_id: str
    title: str
    creator: str = ""
    year: str = ""
    media_type: str = ""
    secondary: str = ""
    thumbnail_url: str | None = None
    raw: dict[str, Any] = field(default_factory=dict)


class Translator(ABC):
    """Finds candidates and translates one into a nested record."""

    name: str = ""
    version: str = ""
    modes: tuple[InputMode, ...] = ()

    @abstractmethod
    def search(self, text: str, mode: InputMode) -> Iterable[Candidate]: ...

    @abstractmethod
    def translate(self, candidate: Candidate) -> dict: ...

    def validate(self) -> None:
        """Raise PluginError if the translator lacks what the contract asks for."""
        missing = [k for k in ("name", "version", "modes") if not getattr(self, k)]
        if missing:
            raise PluginError(f"{type(self).__name__} has no {', '.join(missing)}")


class Fetcher(ABC):
    """Fetches source items and makes facts of each. Items that fail raise, or are counted with ``skip_errors``."""

    lens_id: str = ""

    @abstractmethod
    def fetch(self) -> Iterable[Any]: ...

    @abstractmethod
    def translate(self, item: Any) -> Iterable[tuple[str, str, str, str | None]]:
        """(entity id, dimension, key, value) of each fact."""

    def before(self) -> None:
        """Called before fetching."""

    def after(self, substrate: Substrate) -> None:
        """Called with the result."""

    def facts(self, skip_errors: bool = False) -> Iterator[tuple]:
        self.skipped = 0
        for item in self.fetch():
            try:
                found = list(self.translate(item))
            except Exception:
                if not skip_errors:
                    raise
                self.skipped += 1
                continue
            for entity, dimension, key, value in found:
                if value not in ("", None, "nan", "undefined", "null"):
                    d, k, v = dimension.lower(), key.lower(), str(value)
                    yield entity, d, k, v, f"{d.upper()}|{k}|{v}", self.lens_id

    def run(self, spark: SparkSession, skip_errors: bool = False) -> Substrate:
        self.before()
        out = Substrate(self.frame(spark, skip_errors), self.lens_id)
        self.after(out)
        return out

    def frame(self, spark: SparkSession, skip_errors: bool = False) -> DataFrame:
        return spark.createDataFrame(list(self.facts(skip_errors)), FACT_SCHEMA)
