"""Data-quality jobs for keys Spark does not enforce (Q1–Q3)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pk_violations(df: DataFrame, key: list[str]) -> DataFrame:
    """Q1: key values held by more than one row, and keys with a NULL, even of one row."""
    null_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key])
    return df.groupBy(*key).agg(F.count("*").alias("n_rows")).where((F.col("n_rows") > 1) | null_key)


def pk_summary(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Q1 for several tables: table_name, n_rows, n_keys, n_dup_keys, n_null_keys."""
    parts = []
    for name, (df, key) in tables.items():
        null_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key])
        per_key = df.groupBy(*key).agg(F.count("*").alias("_n"),
                                       F.max(null_key.cast("int")).alias("_null"))
        parts.append(per_key.agg(
            F.lit(name).alias("table_name"),
            F.sum("_n").cast("long").alias("n_rows"),
            F.count("*").alias("n_keys"),
            F.count_if(F.col("_n") > 1).alias("n_dup_keys"),
            F.count_if(F.col("_null") == 1).alias("n_null_keys")))
    return reduce(DataFrame.unionByName, parts)


def fk_orphans(fact: DataFrame, fk: str, dim: DataFrame, pk: str) -> DataFrame:
    """Q2: fact rows whose key has no row in the dimension (left anti join).
    NULL foreign keys are orphans too."""
    d = dim.select(F.col(pk).alias("_pk")).distinct()
    return fact.join(d, fact[fk] == d["_pk"], "left_anti")


def fk_summary(checks: dict[str, tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    """Q2 for several relations: relation, n_rows, n_orphans.

    The fact is first reduced to one count per key (combined map-side), so the
    join sees distinct keys, not rows: a key holding a third of the fact costs
    one row here, not a third of a join partition.
    """
    parts = []
    for name, (fact, fk, dim, pk) in checks.items():
        per_key = fact.groupBy(F.col(fk).alias("_fk")).agg(F.count("*").alias("_n"))
        d = dim.select(F.col(pk).alias("_pk"), F.lit(1).alias("_hit")).distinct()
        j = per_key.join(d, per_key["_fk"] == d["_pk"], "left")
        parts.append(j.agg(F.lit(name).alias("relation"),
                           F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("n_rows"),
                           F.coalesce(F.sum(F.when(F.col("_hit").isNull(), F.col("_n"))),
                                      F.lit(0)).cast("long").alias("n_orphans")))
    return reduce(DataFrame.unionByName, parts)


def count_audit(tables: dict[str, tuple[DataFrame, str]],
                expected: dict[str, int] | None = None,
                lost: dict[str, int] | None = None) -> DataFrame:
    """Q3: table_name, n_rows, first_value, last_value (timestamp_ntz), expected_rows, matches.
    With ``lost`` (cells per table that held text but no value) also n_lost; a table
    that lost any does not match."""
    expected = expected or {}
    parts = []
    for name, (df, tcol) in tables.items():
        exp = expected.get(name)
        part = (df.agg(
            F.lit(name).alias("table_name"), F.count("*").alias("n_rows"),
            F.min(tcol).cast("timestamp_ntz").alias("first_value"),
            F.max(tcol).cast("timestamp_ntz").alias("last_value"))
            .withColumn("expected_rows", F.lit(exp).cast("long"))
            .withColumn("matches", F.when(F.col("expected_rows").isNotNull(),
                                          F.col("n_rows") == F.col("expected_rows"))))
        if lost is not None:
            n = lost.get(name, 0)
            part = part.withColumn("n_lost", F.lit(n).cast("long"))
            if n:
                part = part.withColumn("matches", F.lit(False))
        parts.append(part)
    return reduce(DataFrame.unionByName, parts)
