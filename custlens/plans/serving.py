"""Scorers and serving tables of a folder of tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from custlens.functions.columns import round_even
from custlens.functions.ranking import exact_quantiles
from custlens.functions.stages import input_version, new_path, stage, written
from custlens.operators import anomaly, bundle, segments, serving
from custlens.operators.features import rfm_features
from custlens.operators.scoring import MODEL_VERSION, SCORING_SCHEMA, score_batch
from custlens.operators.splits import Scaler, fit_scaler
from custlens.plans import tables, training

SEEDED_AT = datetime(2001, 8, 2)
RESCORED_AT = datetime(2001, 8, 9)

# A fixed churn rule instead of a fitted model, so that SQL can check what follows.
RULE_WEIGHTS = {"recency_days": 1.0 / 100.0, "frequency": -1.0 / 5.0}
RULE_VALUE_SHARE = 0.45


def rule_margin() -> Column:
    return F.col("recency_days") / 100.0 - F.col("frequency") / 5.0


def rule_probability() -> Column:
    return 1.0 / (1.0 + F.exp(-rule_margin()))


def rule_clv() -> Column:
    return RULE_VALUE_SHARE * F.greatest(F.col("total_spend"), F.lit(0.0))


def rule_cluster() -> Column:
    tier = F.when(F.col("engagement_score") <= 40, 0).when(F.col("engagement_score") <= 70, 1).otherwise(2)
    return (tier + F.when(F.col("recency_days") > 90, 3).otherwise(0)).cast("int")


@dataclass
class RuleScorer:
    """Churn rule, tier-by-recency segments and mean squared deviation as anomaly."""

    scaler: Scaler
    personas: DataFrame
    p95: float
    p99: float
    means: dict[str, float]

    def __call__(self, df: DataFrame) -> DataFrame:
        named = segments.with_segment_names(df.withColumn("cluster_id", rule_cluster()), self.personas)
        factors = F.array(*[
            F.struct(
                F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"),
                (F.lit(w) * (F.col(c).cast("double") - F.lit(self.means[c]))).alias("attribution"),
            )
            for c, w in RULE_WEIGHTS.items()
        ])
        return named.withColumns({
            "probability": rule_probability(), "clv": rule_clv(), "anomaly_error": anomaly.mean_square(self.scaler),
            "anomaly_limit": F.lit(self.p95), "factors": factors,
            "segment_name": F.coalesce("segment_name", F.concat(F.lit("Cluster "), F.col("cluster_id").cast("string"))),
        })


def rule_scorer(spark: SparkSession, folder: str) -> RuleScorer:
    key = (spark.sparkContext.applicationId, folder, input_version(spark, folder))
    if key not in _rule_scorers:
        _rule_scorers[key] = _fit_rule_scorer(spark, folder)
    return _rule_scorers[key]


def _fit_rule_scorer(spark: SparkSession, folder: str) -> RuleScorer:
    f = tables.features(spark, folder)
    scaler = fit_scaler(f, list(anomaly.FEATURES))
    errors = f.select(anomaly.mean_square(scaler).alias("e"))
    cuts = exact_quantiles(errors, "e", {"p95": 0.95, "p99": 0.99}).select(
        round_even("p95", 4).alias("p95"), round_even("p99", 4).alias("p99")
    ).first()
    means = f.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in RULE_WEIGHTS]).first().asDict()
    return RuleScorer(scaler, rule_profile(spark, folder), cuts.p95, cuts.p99, means)


def rule_segmented(spark: SparkSession, folder: str) -> DataFrame:
    f = tables.features(spark, folder).withColumn("cluster_id", rule_cluster())
    return segments.with_segment_names(f, rule_profile(spark, folder))


def rule_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Personas of the rule clusters (at most six rows)."""
    f = tables.features(spark, folder).withColumn("cluster_id", rule_cluster())
    return stage(spark, folder, "rule_profile", lambda: segments.label_personas(segments.segment_profile(f)))


def seeded(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The four serving tables after a full load with the rule scorer."""
    f = tables.features(spark, folder)
    scorer = rule_scorer(spark, folder)
    scored = scorer(f.drop("segment_name"))
    return {
        "customers": serving.customers_table(f, tables.cleaned(spark, folder)),
        "customer_segments": serving.segments_table(rule_segmented(spark, folder), SEEDED_AT),
        "predictions": serving.predictions_table(scored, MODEL_VERSION, SEEDED_AT),
        "anomaly_reports": serving.anomalies_table(scored, F.lit(scorer.p95), F.lit(scorer.p99), SEEDED_AT),
    }


def partial_records(spark: SparkSession, folder: str) -> DataFrame:
    """Scoring input with few fields: the RFM of every customer up to the last date."""
    rfm = rfm_features(tables.cleaned(spark, folder))
    given = {"recency_days", "frequency", "total_spend", "total_items", "unique_products_count"}
    return rfm.select("customer_id", *[
        (F.coalesce(F.col(f.name).cast("double"), F.lit(0.0)) if f.name in given else F.lit(None).cast("double")).alias(f.name)
        for f in SCORING_SCHEMA.fields if f.name != "customer_id"
    ])


def rescored(spark: SparkSession, folder: str) -> DataFrame:
    """A later scoring run over the partial records with the rule scorer."""
    return score_batch(partial_records(spark, folder), rule_scorer(spark, folder), MODEL_VERSION, RESCORED_AT)[0]


def histories(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The serving tables after the later run was added."""
    old, new = seeded(spark, folder), rescored(spark, folder)
    new = stage(spark, folder, "rescored", lambda: new)
    p99 = F.lit(rule_scorer(spark, folder).p99)
    return {
        "customers": serving.upsert_customers(old["customers"], new),
        "customer_segments": serving.upsert_segments(old["customer_segments"], new),
        "predictions": serving.append_predictions(old["predictions"], new),
        "anomaly_reports": serving.append_anomalies(old["anomaly_reports"], new, p99),
    }


def cohort(spark: SparkSession, folder: str) -> DataFrame:
    """The cohort view over the histories, written once for the reports on it."""
    def build() -> DataFrame:
        h = histories(spark, folder)
        return serving.cohort_view(rule_segmented(spark, folder), h["predictions"], h["anomaly_reports"])

    return stage(spark, folder, "cohort_view", build)


# Fitted models


TREE_MODELS = ("churn_tree", "churn_rf", "churn_gbt", "churn_gbt_weighted")


def segmented(spark: SparkSession, folder: str):
    """K-means segments of the cohort: (customers, profile, model, scaler)."""
    key = (spark.sparkContext.applicationId, folder, input_version(spark, folder))
    if key not in _segmented:
        _segmented[key] = segments.segment_customers(tables.features(spark, folder))
    return _segmented[key]


def spending_profile(spark: SparkSession, folder: str) -> tuple[anomaly.SpendingProfile, float, float]:
    """Linear autoencoder of the cohort and its 95 % and 99 % error."""
    key = (spark.sparkContext.applicationId, folder, input_version(spark, folder))
    if key not in _profiles:
        f = tables.features(spark, folder)
        profile = anomaly.SpendingProfile.fit(f)
        errors = written(profile.with_error(f, "e").select("e"), "errors")
        cuts = anomaly.anomaly_thresholds(errors, "e").first()
        _profiles[key] = (profile, cuts.threshold_p95, cuts.threshold_p99)
    return _profiles[key]


_rule_scorers: dict[tuple, RuleScorer] = {}
_segmented: dict[tuple, tuple] = {}
_profiles: dict[tuple, tuple] = {}


def tree_model(spark: SparkSession, folder: str) -> str:
    """The tree model in production."""
    return training.PRODUCTION_CHURN


def fitted_bundle(
    spark: SparkSession, folder: str, churn: str = training.PRODUCTION_CHURN, clv: str = training.PRODUCTION_CLV,
) -> bundle.FittedBundle:
    """All fits that scoring needs, for a tree model and a value model by name."""
    trees, value = training.fitted(spark, folder, churn), training.fitted(spark, folder, clv)
    _, personas, kmeans, seg_scaler = segmented(spark, folder)
    profile, p95, p99 = spending_profile(spark, folder)
    return bundle.FittedBundle(
        training.columns(spark, folder), trees.model, value.model,
        training.scaler(spark, folder, "clv_next_90d") if value.spec.scaled else None, value.spec.log_target,
        kmeans, seg_scaler, personas, profile, p95, p99, trees.path, {"churn": churn, "clv": clv})


def rule_bundle(spark: SparkSession, folder: str) -> bundle.RuleBundle:
    """The rule scorer as a bundle."""
    r = rule_scorer(spark, folder)
    return bundle.RuleBundle({c: 1.0 / w for c, w in RULE_WEIGHTS.items()}, r.means, RULE_VALUE_SHARE, r.scaler, r.personas, r.p95, r.p99)


def stored_bundle(spark: SparkSession, folder: str, kind: str) -> str:
    """The folder of bundles of an input, with the one of ``kind`` ("rules" or "fitted") fitted and stored at its first use."""
    key = (spark.sparkContext.applicationId, folder, input_version(spark, folder), kind)
    if key not in _bundles:
        path = new_path(spark, f"bundles_{kind}")
        made = rule_bundle(spark, folder) if kind == "rules" else fitted_bundle(spark, folder)
        made.save(spark, path, MODEL_VERSION)
        _bundles[key] = path
    return _bundles[key]


_bundles: dict[tuple, str] = {}


def fitted_scorer(spark: SparkSession, folder: str, churn: str, clv: str) -> Callable[[DataFrame], DataFrame]:
    """Scores with models fitted in this application."""
    return fitted_bundle(spark, folder, churn, clv).scorer(spark)
