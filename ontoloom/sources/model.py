"""The typed concept graph: its tables and their schemas."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONCEPT = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("context", T.LongType()), T.StructField("processed", T.LongType())])
TERM = T.StructType([T.StructField("concept_id", T.LongType()), T.StructField("term", T.StringType()), T.StructField("lang", T.StringType())])
EDGE = T.StructType([T.StructField("id", T.LongType()), T.StructField("subject", T.LongType()), T.StructField("code", T.StringType()), T.StructField("target", T.LongType()), T.StructField("context", T.LongType()), T.StructField("strength", T.LongType()), T.StructField("status", T.StringType())])
RULE = T.StructType([T.StructField("code", T.StringType()), T.StructField("name", T.StringType()), T.StructField("mutual", T.BooleanType())])
ANCHOR = T.StructType([T.StructField("code", T.StringType()), T.StructField("side", T.StringType()), T.StructField("anchor", T.LongType())])
CONTEXT = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])

GENUS, COEXTENSION = "14", "30"
#: Codes whose assertions pass to narrower concepts (fixed values).
INHERITED = ("15", "20", "21", "22", "23", "24", "25", "26", "27")


@dataclass
class Graph:
    """Tables of one concept graph. A context selects edges, never concepts."""

    spark: SparkSession
    concept: DataFrame
    term: DataFrame
    edge: DataFrame
    rule: DataFrame
    anchor: DataFrame
    context: DataFrame
    kept: dict = field(default_factory=dict)

    def scope(self, context: int, positive: bool = True) -> DataFrame:
        """Accepted edges of one context; positive: without explicit negatives (strength 0)."""
        e = self.edge.filter((F.col("status") == "ok") & (F.col("context") == context))
        return e.filter(is_positive()) if positive else e

    def code(self, context: int, code: str, positive: bool = True) -> DataFrame:
        return self.scope(context, positive).filter(F.col("code") == code)


def is_positive(strength: str = "strength"):
    """No strength, or one above 0; 0 states that the relation does not hold."""
    return F.col(strength).isNull() | (F.col(strength) > 0)
