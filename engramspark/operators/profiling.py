"""Profiles of spaces: signals, labels and drift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import DEFAULT, EVIDENCE_QUALITY, EVIDENCE_RANK, Config


def signals(revisions: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """One row per space: counts, rates, evidence histogram, published share and median age. Churn counts all revisions, stability and evidence the live ones."""
    live = ~F.col("deprecated")
    n_live = F.count_if(live)
    share = lambda x: F.when(n_live > 0, x / n_live).otherwise(F.lit(0.0))
    return revisions.groupBy("space").agg(
        F.countDistinct("item_id").alias("items"),
        F.count("*").alias("revisions"),
        n_live.alias("live"),
        F.count_if(F.col("age_days") <= config.profile_days).alias("recent"),
        *(F.count_if(live & (F.col("evidence_level") == e)).alias(f"n_{e}") for e in EVIDENCE_RANK),
        F.count_if(F.col("deprecated")).alias("deprecated"),
        share(F.count_if(live & F.col("published"))).alias("published_share"),
        F.median(F.when(live, F.col("age_days"))).alias("median_age"),
    )


def scores(profile: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Adds churn, evidence and stability, of which labels compare the rounded values, and the label."""
    a, b, c = config.churn_weights
    per_item = F.when(F.col("items") > 0, F.col("revisions") / F.col("items")).otherwise(F.lit(0.0))
    rate = F.col("recent") / F.lit(float(config.profile_days))
    depth = F.col("depth") if "depth" in profile.columns else F.lit(0.0)
    churn = a * F.least(F.lit(1.0), per_item / 5) + b * F.least(F.lit(1.0), rate / 3) + c * F.least(F.lit(1.0), depth / 5)
    total = sum((F.col(f"n_{e}") * F.lit(w) for e, w in EVIDENCE_QUALITY.items()), F.lit(0.0))
    evidence = F.when(F.col("live") > 0, total / F.col("live")).otherwise(F.lit(0.0))
    stability = 0.6 * F.col("published_share") + 0.4 * F.least(F.lit(1.0), F.coalesce("median_age", F.lit(0.0)) / 30)
    out = profile.withColumns({"churn": F.round(churn, 4), "evidence": F.round(evidence, 4), "stability": F.round(stability, 4)})
    graded = sum((F.col(f"n_{e}") for e in EVIDENCE_RANK), F.lit(0))
    canonical = (F.col("stability") >= 0.6) & (F.col("churn") <= 0.4) & ((graded == 0) | (F.col("evidence") >= 0.3))
    return out.withColumn("label", F.when(canonical, "canonical").when((F.col("churn") >= 0.6) & (F.col("stability") <= 0.4), "correspondence").otherwise("working"))


def drift(now: DataFrame, before: DataFrame, pins: DataFrame) -> DataFrame:
    """Spaces whose label changed, or disagrees with their pin: space, label, previous, pinned."""
    rows = now.select("space", "label").join(before.select("space", F.col("label").alias("previous")), "space", "left").join(pins.select("space", F.col("label").alias("pinned")), "space", "left")
    valid = F.when(F.col("pinned").isin("canonical", "working", "correspondence"), F.col("pinned"))
    return rows.withColumn("pinned", valid).where((F.col("pinned") != F.col("label")) | (F.col("previous") != F.col("label")))
