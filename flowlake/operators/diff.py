"""Semantic diff of two versions of keyed rows, and classification of the changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Review categories from the lightest to the strictest, and the review that each asks for.
REVIEW = {
    "cosmetic": "light-review", "documentation-only": "automated-plus-spot-check", "behavioral": "human-review-required",
    "dependency": "engineer-review-required", "security-sensitive": "security-lead-review", "coverage-regression": "blocked",
}
AUTH_RELATED = "(?i)auth|credential|oauth|secret|token"


def auth_related(dependency_type):
    """Whether a dependency's type names a credential boundary."""
    return F.coalesce(F.rlike(dependency_type, F.lit(AUTH_RELATED)), F.lit(False))


def review_category(category, field, aspect, secure, dependency_type, direction):
    """The review category of a change by its kind and, for some kinds, the field or aspect changed, the secure mark, the type of
    dependency or the direction. A kind that is not known asks for a human's judgment."""
    pick = lambda hit, yes, no: F.when(F.coalesce(hit, F.lit(False)), yes).otherwise(no)
    return (
        F.when(category == "flow-metadata-changed", pick(field == "secure", "security-sensitive", "cosmetic"))
        .when(category == "menu-choice-changed", pick(aspect == "label", "cosmetic", "behavioral"))
        .when(category == "action-changed", pick(aspect == "relabeled", "cosmetic", "behavioral"))
        .when(category == "variable-changed", pick(secure, "security-sensitive", "behavioral"))
        .when(category.isin("prompt-reference-changed", "published-version-only-changed"), "documentation-only")
        .when(category == "dependency-changed", pick(auth_related(dependency_type), "security-sensitive", "dependency"))
        .when(category == "coverage-changed", pick(direction == "regressed", "coverage-regression", "documentation-only"))
        .otherwise("behavioral")
    )


def match(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """One row a key: structs b and a (null where the side lacks it) and op added, removed or matched."""
    side = lambda df, name: df.select(*key, F.struct(*(c for c in df.columns if c not in key)).alias(name))
    both = side(before, "b").join(side(after, "a"), key, "full_outer")
    return both.withColumn("op", F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").otherwise("matched"))


def compare(before: DataFrame, after: DataFrame, key: list[str], fields: list[str], sets: list[str] = ()) -> DataFrame:
    """key, structs b and a, op (added, removed, changed, same) and the names of the changed fields; sets compare as multisets."""

    def differs(f: str):
        b, a = F.col(f"b.{f}"), F.col(f"a.{f}")
        return ~(F.array_sort(b).eqNullSafe(F.array_sort(a)) if f in sets else b.eqNullSafe(a))

    names = [*fields, *(s for s in sets if s not in fields)]
    changed = F.array_compact(F.array(*(F.when(differs(f), F.lit(f)) for f in names)))
    rows = match(before, after, key).withColumn("fields", F.when(F.col("op") == "matched", changed).otherwise(F.array().cast("array<string>")))
    return rows.withColumn("op", F.when(F.col("op") != "matched", F.col("op")).when(F.size("fields") > 0, "changed").otherwise("same"))


def diff(before: DataFrame, after: DataFrame, key: list[str], fields: list[str], sets: list[str] = ()) -> DataFrame:
    """key, op and changed fields, as ``compare`` finds them."""
    return compare(before, after, key, fields, sets).select(*key, "op", "fields")


def pair_slots(removed: DataFrame, added: DataFrame, slot: list[str]) -> DataFrame:
    """Removed and added rows of a slot, paired where the slot has exactly one of each."""
    once = Window.partitionBy(*slot)
    alone = lambda df, name: df.withColumn("k", F.count("*").over(once)).where("k = 1").select(*slot, F.struct(*(c for c in df.columns if c not in slot)).alias(name))
    return alone(removed, "removed").join(alone(added, "added"), slot)


def positional_only(diffs: DataFrame, hashes: DataFrame) -> DataFrame:
    """flow_id and whether only the order changed: hashes differ (hash_before, hash_after) and no row does."""
    some = diffs.where("op <> 'same'").select("flow_id").distinct().withColumn("some", F.lit(True))
    moved = ~F.col("hash_before").eqNullSafe(F.col("hash_after"))
    return hashes.join(some, "flow_id", "left").select("flow_id", moved.alias("hash_changed"), (moved & F.col("some").isNull()).alias("positional_only"))


def classify(changes: DataFrame, flows: DataFrame) -> DataFrame:
    """Per flow a count of every review category, the strictest review, and whether a regression of coverage blocks approval;
    a flow without changes counts as documentation-only. changes(flow_id, category, field, aspect, secure, dependency_type, direction)."""
    own = review_category(*(F.col(c) for c in ("category", "field", "aspect", "secure", "dependency_type", "direction")))
    names = {c: c.replace("-", "_") for c in REVIEW}
    rows = changes.select("flow_id", own.alias("review"))
    counts = rows.groupBy("flow_id").agg(*(F.count_if(F.col("review") == c).alias(n) for c, n in names.items()))
    out = flows.select("flow_id").join(counts, "flow_id", "left").fillna(0, list(names.values()))
    none = sum(F.col(n) for n in names.values()) == 0
    out = out.withColumn("documentation_only", F.when(none, F.lit(1).cast("long")).otherwise(F.col("documentation_only")))
    strictest = F.coalesce(*(F.when(F.col(n) > 0, F.lit(REVIEW[c])) for c, n in reversed(names.items())))
    return out.withColumn("highest_review", strictest).withColumn("blocks_approval", F.col("coverage_regression") > 0)


def untrusted_text(column, most: int = 500):
    """Tenant text cut to a bound with an ellipsis; empty text is null."""
    return F.when(F.length(column) == 0, None).when(F.length(column) > most, F.concat(F.left(column, F.lit(most)), F.lit("…"))).otherwise(column)


def draft_drift(draft: DataFrame, fields: list[str]) -> DataFrame:
    """flow_id and drift of draft(flow_id, b, a, semantic): structs of the published and the draft version and whether the
    diff between them has semantic changes (null: not known)."""
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f"b.{f}").eqNullSafe(F.col(f"a.{f}"))
    drift = F.when(F.col("a").isNull() | F.col("b").isNull(), "not-observable").when(same, "no-drift").when(F.col("semantic").isNull(), "draft-present-unknown")
    return draft.select("flow_id", drift.when(F.col("semantic"), "draft-present-semantic-change").otherwise("draft-present-no-semantic-change").alias("drift"))


def changed_settings_keys(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """key and setting of every top-level settings key (a map column) whose value differs between the two sides."""
    b, a = (df.select(*key, F.explode("settings").alias("setting", v)) for df, v in ((before, "old"), (after, "new")))
    both = b.join(a, [*key, "setting"], "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    kind = F.when(F.col("setting") == "expression", "condition-expression-changed").otherwise("action-changed")
    matched = before.select(*key).join(after.select(*key), key, "left_semi")
    return both.join(matched, key, "left_semi").select(*key, "setting", kind.alias("category"))


def diff_members(before: DataFrame, after: DataFrame, key: list[str], member: str) -> DataFrame:
    """Members (prompts, languages) added to or removed from the keys that both sides have."""
    both = before.select(*key).distinct().join(after.select(*key).distinct(), key, "left_semi")
    side = lambda df, flag: df.select(*key, member).distinct().withColumn(flag, F.lit(True))
    rows = side(before, "was").join(side(after, "is"), [*key, member], "full_outer").where("was is null or is is null")
    return rows.join(both, key, "left_semi").select(*key, member, F.when(F.col("was").isNull(), "added").otherwise("removed").alias("op"))
