"""Registry of named queries: a Spark plan and, where one exists, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depotlens.sources.views import Domain
from depotlens.sources.views_sql import with_views


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Domain], DataFrame]
    sql: str | None
    rounded: tuple[str, ...]
    digits: int

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        df = self.build(Domain(spark, folder))
        # The last bits of a sum depend on row order.  Rounding hides them, except where a value
        # lies exactly between two roundings; the small shift moves that boundary off round numbers.
        return df.withColumns({
            c: F.round(F.col(c).cast("double") + self.shift, self.digits) for c in self.rounded
        })

    @property
    def shift(self) -> float:
        return float(f"3.7e-{self.digits + 2}")

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        text = self.sql.strip()
        if self.rounded:
            cells = ", ".join(f"round({c}::DOUBLE + {self.shift}::DOUBLE, {self.digits}) + 0.0::DOUBLE AS {c}" for c in self.rounded)
            text = f"SELECT * REPLACE ({cells}) FROM ({text})"
        return with_views(text, STEPS)


QUERIES: dict[str, Query] = {}
# Named SQL steps shared by several oracles.
STEPS: dict[str, str] = {}


def query(name: str, sql: str | None = None, rounded: str = "", digits: int = 6):
    """Register ``build(domain)`` under ``name``."""

    def add(build):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, build, sql, tuple(rounded.split()), digits)
        return build

    return add
