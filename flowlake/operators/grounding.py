"""Evidence packs and grounding of written claims.

claim(flow_id, section_id, claim_idx, text, kind, evidence_id, quote); evidence(flow_id, evidence_id, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.functions.text import forbidden_pattern, quotations

# Sections that may be narrated, and the budgets.
SECTIONS = ["overview", "journeys", "decisions", "dependencies", "risks", "operations", "unknowns"]
MAX_TEXT, MAX_QUOTE, SECTION_CLAIMS, SECTION_CHARS, DRAFT_CLAIMS, DRAFT_CHARS = 500, 120, 40, 8000, 200, 40000
MAX_UNKNOWNS = 50
CLAIM_KINDS, SUBJECT_KINDS = ["fact", "derived", "inference", "unknown"], ["variable", "node", "edge", "dependency", "flow", "general"]


def validate_claims(claim: DataFrame, evidence: DataFrame) -> DataFrame:
    """The claims with their first failure, or null: a quotation must stand in some evidence of the flow, whichever the claim cites."""
    known = evidence.select("flow_id", "evidence_id", F.lit(True).alias("known")).distinct()
    quoted = claim.where("quote is not null").select(F.col("flow_id").alias("of"), "claim_idx", "quote")
    texts = evidence.select("flow_id", F.col("text").alias("corpus"))
    found = quoted.join(texts, (F.col("of") == F.col("flow_id")) & F.contains("corpus", F.col("quote")), "left_semi")
    found = found.select(F.col("of").alias("flow_id"), "claim_idx", "quote").distinct().withColumn("found", F.lit(True))
    rows = claim.join(known, ["flow_id", "evidence_id"], "left").join(found, ["flow_id", "claim_idx", "quote"], "left")
    cited = F.col("evidence_id").isNotNull()
    failure = (
        F.when(F.col("text").isNull() | (F.length(F.trim("text")) == 0), "malformed").when(F.length("text") > MAX_TEXT, "too-large")
        .when(forbidden_pattern(F.col("text")).isNotNull(), "forbidden-pattern").when(F.length("quote") > MAX_QUOTE, "quotation-too-long")
        .when(F.col("quote").isNotNull() & F.col("found").isNull(), "quotation-not-in-corpus").when(cited & F.col("known").isNull(), "unknown-evidence")
        .when(~cited & (F.col("kind") != "unknown"), "no-evidence").when(F.col("kind") == "inference", "inference-not-allowed")
    )
    return rows.withColumn("failure", failure).drop("known", "found")


def section_gate(claim: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims of allowed sections; one rejection row for each other section."""
    ok = F.coalesce(F.col("section_id").isin(SECTIONS), F.lit(False))
    return claim.where(ok), claim.where(~ok).select("flow_id", "section_id").distinct().withColumn("failure", F.lit("section-not-allowed"))


def greedy_budget(rows: DataFrame, key: list[str], order: str, length: str, most: int, chars: int) -> DataFrame:
    """rows with ``kept``: in order, an item that would pass the count or the characters is skipped, and later
    smaller ones may still fit. A group is one section or draft, small by its own nature."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("i"), F.col(length).cast("long").alias("n"))))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("count"), F.array().cast("array<bigint>").alias("kept"))

    def step(acc, x):
        fits = (acc["count"] < most) & (acc["used"] + x["n"] <= chars)
        return F.struct(
            F.when(fits, acc["used"] + x["n"]).otherwise(acc["used"]).alias("used"), F.when(fits, acc["count"] + 1).otherwise(acc["count"]).alias("count"),
            F.when(fits, F.array_append(acc["kept"], x["i"].cast("long"))).otherwise(acc["kept"]).alias("kept"),
        )

    kept = rows.groupBy(*key).agg(F.aggregate(items, start, step)["kept"].alias("kept")).select(*key, F.explode("kept").alias("_i"))
    kept = kept.withColumn("kept", F.lit(True))
    on = [*key]
    return rows.join(kept.withColumnRenamed("_i", order), [*on, order], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def grounding_report(validated: DataFrame) -> DataFrame:
    return validated.groupBy(F.coalesce("failure", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("claims"))


def cap_with_record(rows: DataFrame, key: list[str], order: list[str], most: int) -> tuple[DataFrame, DataFrame]:
    """The first rows of each key, and a record of what was left out where something was."""
    from pyspark.sql import Window

    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    omitted = ranked.groupBy(*key).agg(F.max("_r").alias("n")).where(F.col("n") > most)
    return ranked.where(F.col("_r") <= most).drop("_r"), omitted.select(*key, (F.col("n") - most).cast("long").alias("omitted"))


def subject_index(rows: DataFrame) -> DataFrame:
    """What each piece of evidence is about, once: flow_id, evidence_id, kind, id."""
    return rows.select("flow_id", "evidence_id", "kind", "id").distinct()


def subject_supported(claim: DataFrame, index: DataFrame) -> DataFrame:
    """claim(flow_id, claim_idx, evidence_ids, subject_kind, subject_id) with ``supported``: whether any cited evidence is about the
    declared subject. A claim without evidence has no support."""
    cited = claim.select("flow_id", "claim_idx", F.explode("evidence_ids").alias("evidence_id"), F.col("subject_kind").alias("kind"), F.col("subject_id").alias("id"))
    good = cited.join(index, ["flow_id", "evidence_id", "kind", "id"], "left_semi").select("flow_id", "claim_idx").distinct().withColumn("supported", F.lit(True))
    return claim.join(good, ["flow_id", "claim_idx"], "left").withColumn("supported", F.coalesce("supported", F.lit(False)))


def validate_unknowns(unknown: DataFrame, most: int = MAX_UNKNOWNS, chars: int = MAX_TEXT) -> DataFrame:
    """unknown(flow_id, idx, text) with its failure or null: once ``most`` are accepted, all later ones of the draft are too many."""
    from pyspark.sql import Window

    own = F.when(F.col("text").isNull(), "malformed").when(F.length("text") > chars, "too-large").when(forbidden_pattern(F.col("text")).isNotNull(), "forbidden-pattern")
    before = F.count_if(F.col("failure").isNull()).over(Window.partitionBy("flow_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1))
    rows = unknown.withColumn("failure", own)
    return rows.withColumn("accepted", before).withColumn("failure", F.when(F.col("accepted") >= most, "draft-too-large").otherwise(F.col("failure"))).drop("accepted")


def claim_failures(claim: DataFrame, evidence: DataFrame, corpus: DataFrame, index: DataFrame, allow_inference: bool = False) -> DataFrame:
    """claim(flow_id, section, claim_idx, text, kind, evidence_ids, subject_kind, subject_id) with its first failure, or null.

    section is a section's place in its draft, claim_idx a claim's place in it. evidence(flow_id, evidence_id) is what may be cited,
    corpus(flow_id, text) every text of the pack and index what each piece of evidence is about. Quotations are taken from the text
    itself, and the first bad one decides; each must stand within one text of the pack. A fact and what is derived need evidence
    about their subject, unless it is a general one or none. Only quotations and ids travel to the pack's rows, each once a flow."""
    key = ["flow_id", "section", "claim_idx"]
    quoted = claim.select(*key, F.posexplode(quotations(F.col("text"))).alias("pos", "quote"))
    told = quoted.select(F.col("flow_id").alias("of"), "quote").distinct()
    found = told.join(corpus.select("flow_id", F.col("text").alias("part")), (F.col("of") == F.col("flow_id")) & F.contains("part", F.col("quote")), "left_semi")
    found = found.select(F.col("of").alias("flow_id"), "quote", F.lit(True).alias("found"))
    bad = F.when(F.length("quote") > MAX_QUOTE, "quotation-too-long").when(F.col("found").isNull(), "quotation-not-in-corpus")
    bad = quoted.join(found, ["flow_id", "quote"], "left").withColumn("bad", bad).where("bad is not null").groupBy(*key).agg(F.min_by("bad", "pos").alias("bad_quote"))
    ids = claim.select(*key, F.explode(F.array_distinct("evidence_ids")).alias("evidence_id"))
    strange = ids.join(evidence.select("flow_id", "evidence_id").distinct(), ["flow_id", "evidence_id"], "left_anti").select(*key, F.lit(True).alias("strange")).distinct()
    about = claim.select(*key, F.col("subject_kind").alias("kind"), F.col("subject_id").alias("id"), F.explode("evidence_ids").alias("evidence_id"))
    backed = about.join(index, ["flow_id", "evidence_id", "kind", "id"], "left_semi").select(*key, F.lit(True).alias("backed")).distinct()
    rows = claim.join(bad, key, "left").join(strange, key, "left").join(backed, key, "left")
    well_formed = F.col("text").isNotNull() & F.col("kind").isin(CLAIM_KINDS) & ~F.exists("evidence_ids", lambda i: i.isNull()) & (F.col("subject_kind").isNull() | F.col("subject_kind").isin(SUBJECT_KINDS))
    needs_subject = F.col("kind").isin("fact", "derived") & (F.col("subject_kind") != "general")
    failure = (
        F.when(~F.coalesce(well_formed, F.lit(False)), "malformed").when(F.length("text") > MAX_TEXT, "too-large")
        .when(forbidden_pattern(F.col("text")).isNotNull(), "forbidden-pattern").when(F.col("bad_quote").isNotNull(), F.col("bad_quote"))
        .when(F.col("strange"), "unknown-evidence").when((F.col("kind") != "unknown") & (F.size("evidence_ids") == 0), "no-evidence")
        .when((F.col("kind") == "inference") & F.lit(not allow_inference), "inference-not-allowed").when(needs_subject & F.col("backed").isNull(), "unsupported-subject")
    )
    return rows.withColumn("failure", failure).drop("bad_quote", "strange", "backed")


def _judged(items, most: int, chars: int, full: str):
    """items (i, n, failure) in order, with the budget's failure where one of them passes it; what doesn't fit is skipped, and later smaller
    ones may still fit. Once the count is reached, every later item has that failure, whatever its own."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("count"), F.array().cast("array<struct<i:bigint,n:bigint,failure:string>>").alias("out"))

    def step(acc, x):
        failure = F.when(acc["count"] >= most, full).when(x["failure"].isNotNull(), x["failure"]).when(acc["used"] + x["n"] > chars, full)
        item = F.struct(x["i"].alias("i"), x["n"].alias("n"), failure.alias("failure"))
        return F.struct((acc["used"] + F.when(failure.isNull(), x["n"]).otherwise(0)).alias("used"), (acc["count"] + F.when(failure.isNull(), 1).otherwise(0)).alias("count"), F.array_append(acc["out"], item).alias("out"))

    return F.aggregate(items, start, step)["out"]


def validate_draft(claim: DataFrame, evidence: DataFrame, corpus: DataFrame, index: DataFrame, section_claims: int = SECTION_CLAIMS, section_chars: int = SECTION_CHARS, draft_claims: int = DRAFT_CLAIMS, draft_chars: int = DRAFT_CHARS) -> DataFrame:
    """flow_id, section, section_id, claim_idx, failure and reported_idx of every claim, and one row without claim for each section that
    may not be narrated: as claim_failures, then the section's budget, then the draft's over what its sections accepted, in
    order. reported_idx is the claim's place, for the draft's budget that among the section's accepted claims. A draft is folded in one
    row: it is what a narrator wrote about one flow."""
    ok = F.coalesce(F.col("section_id").isin(SECTIONS), F.lit(False))
    shut = claim.where(~ok).select("flow_id", "section", "section_id", F.lit(None).cast("bigint").alias("claim_idx"), F.lit("section-not-allowed").alias("failure"), F.lit(None).cast("bigint").alias("reported_idx")).distinct()
    own = claim_failures(claim.where(ok), evidence, corpus, index, False)
    item = F.struct(F.col("claim_idx").cast("bigint").alias("i"), F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n"), "failure")
    folded = own.groupBy("flow_id", "section", "section_id").agg(_judged(F.array_sort(F.collect_list(item)), section_claims, section_chars, "section-too-large").alias("items"))
    kept = F.filter("items", lambda x: x["failure"].isNull())
    folded = folded.select("flow_id", "section", "section_id", F.filter("items", lambda x: x["failure"].isNotNull()).alias("lost"), kept.alias("kept"))
    lost = folded.select("flow_id", "section", "section_id", F.inline("lost")).select("flow_id", "section", "section_id", F.col("i").alias("claim_idx"), "failure", F.col("i").alias("reported_idx"))
    # the draft's order: sections, then their accepted claims; i is the place in that order
    parts = folded.groupBy("flow_id").agg(F.array_sort(F.collect_list(F.struct("section", "section_id", "kept"))).alias("parts"))
    flat = F.flatten(F.transform("parts", lambda p: F.transform(p["kept"], lambda x, j: F.struct(p["section"].alias("section"), p["section_id"].alias("section_id"), x["i"].alias("claim_idx"), j.cast("bigint").alias("place"), x["n"].alias("n")))))
    draft = parts.select("flow_id", flat.alias("flat"))
    items = F.transform("flat", lambda x, j: F.struct(j.cast("bigint").alias("i"), x["n"].alias("n"), F.lit(None).cast("string").alias("failure")))
    last = draft.select("flow_id", F.inline(F.arrays_zip("flat", _judged(items, draft_claims, draft_chars, "draft-too-large").alias("judged"))))
    last = last.select("flow_id", "flat.section", "flat.section_id", "flat.claim_idx", "judged.failure", F.when(F.col("judged.failure").isNotNull(), F.col("flat.place")).otherwise(F.col("flat.claim_idx")).alias("reported_idx"))
    return lost.unionByName(last).unionByName(shut)
