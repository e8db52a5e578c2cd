"""Entity tables, the catalog of attributes, and the point in both times at which a query reads."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class EntityTable:
    """A relation whose rows are entities: `eid` identifies a row, `attributes` name its columns (arrays hold several values).

    eid None: the row itself is the entity, and only its attributes can be asked for. A column
    that is null is absent; `nils`, if given, is an array column with the names of attributes
    that are present with the value nil.
    """

    name: str
    df: DataFrame
    eid: str | None
    attributes: dict[str, str]
    nils: str | None = None

    def column(self, attribute: str) -> str:
        if attribute == "_id":
            if self.eid is None:
                raise ValueError(f"rows of {self.name} have no id")
            return self.eid
        return self.attributes[attribute]

    def has(self, attribute: str) -> bool:
        return self.eid is not None if attribute == "_id" else attribute in self.attributes

    def kind(self, attribute: str) -> T.DataType:
        return self.df.schema[self.column(attribute)].dataType

    def present(self, attribute: str) -> Column:
        here = F.col(self.column(attribute)).isNotNull()
        if self.nils is None or attribute == "_id":
            return here
        return here | F.coalesce(F.array_contains(self.nils, attribute), F.lit(False))


def entity_table(name: str, df: DataFrame, eid: str | None = None, prefix: str = "", nils: str | None = None) -> EntityTable:
    """All columns of df as attributes, `prefix` before their names."""
    return EntityTable(name, df, eid, {f"{prefix}{c}": c for c in df.columns if c not in (eid, nils)} | ({f"{prefix}{eid}": eid} if eid and prefix + eid != "_id" else {}), nils)


@dataclass(frozen=True)
class Basis:
    valid_time: datetime | None = None
    tx_time: datetime | None = None
    tx_id: int | None = None


@dataclass
class Catalog:
    """Entity tables, and a stored full-text index of their values (tidemark.operators.text.TextIndex), if there is one."""

    tables: dict[str, EntityTable] = field(default_factory=dict)
    text: Any = None

    def add(self, table: EntityTable) -> Catalog:
        self.tables[table.name] = table
        return self

    def holding(self, attributes: set[str]) -> list[EntityTable]:
        """Tables that have all the attributes."""
        return [t for t in self.tables.values() if all(t.has(a) for a in attributes)]
