"""Integrity rules as queries: domains, checks, uniqueness, references, deletes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def rules(table: str) -> dict[str, str]:
    """All row rules of a table: its checks, and one domain rule per enumerated column."""
    found = dict(schemas.CHECKS.get(table, {}))
    for column, values in schemas.DOMAINS.get(table, {}).items():
        found[f"{column}_domain"] = f"{column} IN ({', '.join(repr(v) for v in values)})"
    return found


def check_violations(table: str, df: DataFrame, key: str) -> DataFrame:
    """(row_key, rule) for each rule a row breaks; NULL passes."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(sql), F.lit(True)), name) for name, sql in sorted(rules(table).items())]))
    return df.select(F.col(key).alias("row_key"), F.explode(broken).alias("rule"))


def unique_violations(table: str, df: DataFrame) -> DataFrame:
    """(rule, key, n) for keys that occur more than once; a NULL part never collides."""
    out = []
    for name, key, where in schemas.UNIQUE[table]:
        rows = (df.where(where) if where else df).dropna(subset=list(key))
        # Grouped by the columns: a joined text would merge keys that hold the separator.
        n = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        out.append(n.select(F.lit(name).alias("rule"), F.concat_ws("|", *[F.col(c).cast("string") for c in key]).alias("key"), "n"))
    return reduce(DataFrame.unionByName, out)


def foreign_key_violations(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows of child whose reference has no parent; a NULL reference is none."""
    keys = parent.select(F.col(key).alias("parent_key")).distinct()
    return child.where(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("parent_key"), "left_anti")


def restricted(parents: DataFrame, key: str, child: DataFrame, column: str) -> DataFrame:
    """The parents that a child refers to, which therefore may not be deleted."""
    return parents.join(child.select(F.col(column).alias("child_key")), F.col(key) == F.col("child_key"), "left_semi")


def cascade(tables: dict[str, DataFrame], root: str, doomed: DataFrame) -> dict[str, DataFrame]:
    """tables after deleting the keys of doomed from root, along all cascading references."""
    left, gone, todo = dict(tables), {root: doomed}, [root]
    while todo:
        parent = todo.pop(0)
        for child, column, owner, key, rule in schemas.FOREIGN_KEYS:
            if owner != parent or rule != "cascade" or child not in tables:
                continue
            dead = gone[parent].select(F.col(key).alias("dead_key")).distinct()
            lost = tables[child].join(dead, F.col(column) == F.col("dead_key"), "left_semi")
            gone[child] = gone[child].unionByName(lost) if child in gone else lost
            left[child] = left[child].join(dead, F.col(column) == F.col("dead_key"), "left_anti")
            todo.append(child)
    first = tables[root].columns[0]
    left[root] = tables[root].join(doomed.select(F.col(first).alias("dead_key")).distinct(), F.col(first) == F.col("dead_key"), "left_anti")
    return left


def schema_drift(table: str, df: DataFrame) -> list[str]:
    """How a frame's columns differ from the declared ones."""
    want, got = ({f.name: f.dataType.simpleString() for f in s} for s in (schemas.TABLES[table], df.schema))
    return sorted([f"missing {c}" for c in want.keys() - got.keys()] + [f"unknown {c}" for c in got.keys() - want.keys()] + [f"{c} is {got[c]}, not {want[c]}" for c in want.keys() & got.keys() if want[c] != got[c]])


def with_defaults(table: str, df: DataFrame) -> DataFrame:
    """df with the declared defaults where a column is absent or NULL."""
    for column, sql in schemas.DEFAULTS.get(table, {}).items():
        df = df.withColumn(column, F.coalesce(F.col(column), F.expr(sql)) if column in df.columns else F.expr(sql))
    return df


def drift_table(spark: SparkSession, frames: dict[str, DataFrame]) -> DataFrame:
    """(tbl, drift) for each difference of a frame from its declared schema."""
    rows = [(name, x) for name, df in sorted(frames.items()) for x in schema_drift(name, df)]
    return spark.createDataFrame(rows, "tbl string, drift string")


def vocabularies(spark: SparkSession) -> DataFrame:
    """(tbl, column, value) of every closed vocabulary."""
    rows = [(t, c, v) for t, columns in schemas.DOMAINS.items() for c, values in columns.items() for v in values]
    return spark.createDataFrame(rows, "tbl string, column string, value string")
