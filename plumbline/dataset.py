"""The data model: long sparse counts beside a table of observations.

Zeros are implicit in `counts`, so every mean or variance divides by cell counts taken
from `cells`. A unit may occur in both arms, so the sample key is (unit, group, ...).
`case_id` keys a whole corpus of audits; a single dataset carries one constant value.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def case_key(name: str, anchor: str) -> Column:
    """A constant case id that stays data.

    A literal key would be folded away and turn every per-case join into an unkeyed one, so
    the key borrows an empty piece of a row's own column.
    """
    return F.concat(F.lit(name), F.substring(F.coalesce(F.col(anchor).cast("string"), F.lit("")), 1, 0))

COUNTS = T.StructType(
    [
        T.StructField("cell_id", T.StringType()),
        T.StructField("gene", T.StringType()),
        T.StructField("layer", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)
FEATURES = T.StructType(
    [
        T.StructField("gene", T.StringType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("mt", T.BooleanType()),
    ]
)
STORED = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("column", T.StringType()),
        T.StructField("group", T.StringType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("gene", T.StringType()),
        T.StructField("num", T.DoubleType()),
        T.StructField("str", T.StringType()),
    ]
)
EMBEDDING = T.StructType(
    [T.StructField("cell_id", T.StringType()), T.StructField("vec", T.ArrayType(T.DoubleType()))]
)


@dataclass
class Dataset:
    """One audited dataset; every member is a DataFrame Spark reads lazily."""

    cells: DataFrame
    counts: DataFrame | None = None
    features: DataFrame | None = None
    embedding: DataFrame | None = None
    stored: DataFrame | None = None
    roles: dict[str, str] = field(default_factory=dict)
    located: dict = field(default_factory=dict, repr=False)  # the raw-count layer, once found
    clustered: dict | None = field(default=None, repr=False)  # given by an audit: the embedding and sweeps that several checks read, once made


@dataclass(frozen=True)
class Design:
    """Resolved roles plus the knobs of one check. Checks read roles, never column names."""

    unit: str | None = None
    grouping: str | None = None
    derived: str | None = None
    nuisance: tuple[str, ...] = ()
    covariates: tuple[str, ...] = ()
    knobs: dict = field(default_factory=dict)

    def knob(self, key: str, default=None):
        value = self.knobs.get(key)
        return default if value is None else value


@dataclass(frozen=True)
class Claim:
    kind: str = "unknown"
    genes: tuple[str, ...] = ()
    group: str | None = None
    id: str = "claim"
    text: str = ""
