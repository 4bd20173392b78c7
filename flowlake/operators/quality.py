"""Integrity checks over tables: each returns violation rows."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def schema_validate(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """One row for each row and rule that is not true: key and rule."""
    broken = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())), lambda x: x.isNotNull())
    return df.select(F.col(key).cast("string").alias("key"), F.explode(broken).alias("rule"))


def table_hash(df: DataFrame) -> DataFrame:
    """rows and an order-free content hash of a table: the sum of 64-bit row hashes, exact in decimals, then SHA-256."""
    row = F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(df.columns))).cast("decimal(20,0)")
    out = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(row), F.lit(0)).cast("string").alias("sum"))
    return out.select("rows", F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("|", "rows", "sum"), 256)).alias("content_hash"))


def verify_bundle(tables: dict[str, DataFrame], manifest: DataFrame) -> DataFrame:
    """table and finding: manifest(table, rows, content_hash) against the tables at hand."""
    out = None
    for name, df in sorted(tables.items()):
        rows = table_hash(df).withColumn("table", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    have = out.select("table", F.col("rows").alias("have_rows"), F.col("content_hash").alias("have_hash"))
    both = manifest.join(have, "table", "full_outer")
    finding = F.when(F.col("rows").isNull(), "MANIFEST_MISSING").when(F.col("have_rows").isNull(), "FILE_MISSING")
    finding = finding.when(F.col("rows") != F.col("have_rows"), "COUNTS_MISMATCH").when(F.col("content_hash") != F.col("have_hash"), "CONTENT_HASH_MISMATCH")
    return both.select("table", finding.alias("finding")).where("finding is not null")


def status_from_http(code):
    return F.when(code == 403, "forbidden").when(code == 404, "not_found").when(code.isNull(), "unsupported").otherwise("partially_resolved")


def fidelity_compare(left: DataFrame, right: DataFrame, construct: str) -> DataFrame:
    """Counts by construct in two exports, where they differ."""
    a, b = (d.groupBy(construct).agg(F.count("*").alias(n)) for d, n in ((left, "left_n"), (right, "right_n")))
    both = a.join(b, construct, "full_outer").fillna(0, ["left_n", "right_n"])
    return both.where("left_n <> right_n")


def permission_audit(policy: DataFrame) -> DataFrame:
    """policy(id, domain, entity, action): violations by kind; a policy can have several."""
    kinds = F.array(
        F.when(~F.col("action").isin("view", "search"), F.lit("mutation")), F.when(F.col("domain") == "conversation", F.lit("caller-data")),
        F.when(F.rlike("entity", F.lit("(?i)secret|credential|token")), F.lit("secret")), F.when(F.rlike("action", F.lit("(?i)execute|run")), F.lit("execution")),
    )
    return policy.select("id", F.explode(F.array_compact(kinds)).alias("violation")).distinct()


def missing_permissions(calls: DataFrame, matrix: DataFrame) -> DataFrame:
    """operation and permission of denied calls whose permission is known and not blank."""
    denied = calls.where("status = 403").select("operation").distinct()
    return denied.join(matrix, "operation").where(F.length(F.trim("permission")) > 0).select("operation", "permission")


def stability_gate(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row: PASS, FAIL or INCONCLUSIVE for two reads (id, digest) of the same assets."""
    both = first.select("id", F.col("digest").alias("d1")).join(second.select("id", F.col("digest").alias("d2")), "id")
    out = both.agg(F.count("*").alias("assets"), F.count_if(F.col("d1") != F.col("d2")).alias("unstable"))
    return out.withColumn("verdict", F.when(F.col("assets") == 0, "INCONCLUSIVE").when(F.col("unstable") > 0, "FAIL").otherwise("PASS"))


MAX_CANARIES = 100_000  # patterns of one automaton, which every task builds


def canary_scan(tables: dict[str, tuple[DataFrame, str]], canaries: list[tuple[str, str]]) -> DataFrame:
    """table, column, key and canary of every planted text found in any text column, or inside a nested column, of the tables.

    tables has a name, its rows and their key; canaries an id and a text. All texts are looked for at once: each task builds one
    automaton of them (their number is bounded) and walks every value once, whatever their number. An empty text is no canary."""
    import ahocorasick  # noqa: F401  fails here rather than in a task

    if len(canaries) > MAX_CANARIES:
        raise ValueError(f"more than {MAX_CANARIES} canaries")
    planted: dict[str, list[str]] = {}
    for name, text in canaries:
        if text:
            planted.setdefault(text, []).append(name)

    def finder(columns: list[str]):
        def find(batches):
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for text, names in planted.items():
                automaton.add_word(text, names)
            automaton.make_automaton()
            for batch in batches:
                out = []
                for column, cells in zip(columns, batch.columns[2:]):
                    for at, cell in enumerate(cells):
                        if cell.is_valid:
                            out += [(at, column, name) for name in sorted({n for _, names in automaton.iter(cell.as_py()) for n in names})]
                at = pa.array([x[0] for x in out], pa.int32())
                yield pa.record_batch([batch.column(0).take(at), pa.array([x[1] for x in out], pa.string()), batch.column(1).take(at), pa.array([x[2] for x in out], pa.string())], names=["table", "column", "key", "canary"])

        return find

    parts = []
    for name, (rows, key) in tables.items():
        texts = [f.name for f in rows.schema if isinstance(f.dataType, T.StringType)]
        nested = [f.name for f in rows.schema if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
        cells = [F.col(f"`{c}`") for c in texts] + [F.to_json(f"`{c}`") for c in nested]
        if cells and planted:
            own = rows.select(F.lit(name).alias("of"), F.col(f"`{key}`").cast("string").alias("at"), *(c.alias(f"c{i}") for i, c in enumerate(cells)))
            parts.append(own.mapInArrow(finder(texts + nested), "table string, column string, key string, canary string"))
    if not parts:
        return next(iter(tables.values()))[0].sparkSession.createDataFrame([], "table string, column string, key string, canary string")
    return reduce(DataFrame.unionByName, parts)
