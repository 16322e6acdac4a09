"""Lookups over published tables: the small surface a server or a notebook calls."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.search import facet_filter, hybrid_search, nearest, scored_search
from .operators.sequences import first_pattern


@dataclass
class Bundle:
    """Named result tables. A lookup says whether a cell may be generalised from, and how many cells are withheld."""

    tables: dict[str, DataFrame]
    least: int = 20
    routes: list[tuple[str, str]] = field(default_factory=list)

    def vocabulary(self, table: str, column: str) -> list[str]:
        """Values of a dimension column (small by definition of a result table)."""
        return [r[0] for r in self.tables[table].select(column).distinct().orderBy(column).collect()]

    def rows(self, table: str, **where: object) -> DataFrame:
        """Rows that match every given column; an unknown column is an error, not an empty answer."""
        df = self.tables[table]
        for col, value in where.items():
            if col not in df.columns:
                raise KeyError(f"{table} has no column {col}; it has {', '.join(df.columns)}")
            df = df.filter(F.col(col).eqNullSafe(F.lit(value)))
        return self.with_contract(df)

    def with_contract(self, df: DataFrame) -> DataFrame:
        """Adds ``contract``: withheld or not, and whether the count is large enough to generalise."""
        if "n" not in df.columns:
            return df
        return df.withColumn("contract", F.struct(F.col("n").isNull().alias("suppressed"), F.coalesce(F.col("n") >= self.least, F.lit(False)).alias("may_generalise")))

    def either(self, table: str, columns: list[str], value: object) -> DataFrame:
        cond = F.lit(False)
        for c in columns:
            cond = cond | F.col(c).eqNullSafe(F.lit(value))
        return self.with_contract(self.tables[table].filter(cond))

    def withheld(self) -> dict[str, int]:
        return {name: df.filter(F.col("n").isNull()).count() for name, df in self.tables.items() if "n" in df.columns}

    def route(self, question: str) -> str:
        """Name of the first route whose pattern the question matches."""
        df = next(iter(self.tables.values())).sparkSession.createDataFrame([(question,)], "q string")
        return df.select(first_pattern(F.lower("q"), self.routes, "none").alias("r")).first()["r"]


__all__ = ["Bundle", "facet_filter", "hybrid_search", "nearest", "scored_search"]
