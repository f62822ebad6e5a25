"""Customer segments: fits, quality measures, profiles and personas."""

from __future__ import annotations

import math

from pyspark.ml.clustering import GaussianMixture, KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import Column, DataFrame, Window, functions as F

from custlens.functions.columns import exact_mean, round_even
from custlens.functions.stages import written
from custlens.operators.splits import SEED, Scaler, fit_scaler, fitting_rows, in_parallel, scaled_vectors

FEATURES = (
    "recency_days", "frequency", "total_spend", "avg_basket_size", "velocity_acceleration",
    "return_line_rate", "engagement_score",
)


def fit_kmeans(vectors: DataFrame, k: int, restarts: int = 15, seed: int = SEED) -> KMeansModel:
    """The fit with the lowest cost over several seeds."""
    with fitting_rows(vectors) as rows:
        def fit(i: int) -> KMeansModel:
            return KMeans(k=k, seed=seed + i, featuresCol="x", predictionCol="cluster_id").fit(rows)

        fits = in_parallel(fit, range(restarts))
        return min(fits, key=lambda m: m.summary.trainingCost)


def squared_silhouette(clustered: DataFrame, label: str = "cluster_id", features: str = "x") -> float:
    """Mean silhouette by squared Euclidean distance, linear in the rows.

    Not the pairwise Euclidean one, which needs all pairs of customers.
    """
    return ClusteringEvaluator(featuresCol=features, predictionCol=label).evaluate(clustered)


def davies_bouldin(df: DataFrame, columns: list[Column], label: str) -> DataFrame:
    """One row: mean over clusters of the worst (si + sj) / dij.

    The centroids (one per cluster) are gathered in an array and compared there.
    """
    x = F.array(*columns)
    points = df.select(F.col(label).alias("c"), x.alias("x"))
    width = len(columns)
    centers = points.groupBy("c").agg(F.array(*[F.avg(F.col("x")[i]) for i in range(width)]).alias("center"))

    def distance(a: Column, b: Column) -> Column:
        return F.sqrt(F.aggregate(
            F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v
        ))

    # One row per cluster on the broadcast side.
    spread = (
        points.join(F.broadcast(centers), "c")
        .groupBy("c").agg(F.avg(distance(F.col("x"), F.col("center"))).alias("s"), F.any_value("center").alias("center"))
    )
    together = spread.agg(F.collect_list(F.struct("c", "s", "center")).alias("all"))
    worst = F.transform("all", lambda a: F.array_max(F.transform(
        F.filter("all", lambda b: b["c"] != a["c"]),
        lambda b: (a["s"] + b["s"]) / distance(a["center"], b["center"]),
    )))
    mean = F.aggregate(worst, F.lit(0.0), lambda s, v: s + v) / F.size("all")
    return together.select(mean.alias("davies_bouldin"))


def evaluate_cluster_range(vectors: DataFrame, ks: range = range(2, 8), restarts: int = 10) -> list[dict]:
    """Cost, squared silhouette and Davies-Bouldin index per k."""
    from pyspark.ml.functions import vector_to_array

    size = len(vectors.first()["x"])
    columns = [vector_to_array("x")[i] for i in range(size)]
    out = []
    for k in ks:
        model = fit_kmeans(vectors, k, restarts)
        clustered = model.transform(vectors)
        db = davies_bouldin(clustered, columns, "cluster_id").first()[0]
        out.append({
            "k": k,
            "inertia": round(model.summary.trainingCost, 2),
            "silhouette_sq": round(squared_silhouette(clustered), 4),
            "davies_bouldin": round(db, 4),
        })
    return out


def fit_gmm(vectors: DataFrame, k: int, seed: int = SEED):
    """Full-covariance mixture and its BIC."""
    with fitting_rows(vectors) as rows:
        model = GaussianMixture(k=k, seed=seed, featuresCol="x", predictionCol="gmm_cluster_id", maxIter=100).fit(rows)
        n, d = rows.count(), len(rows.first()["x"])
    free = (k - 1) + k * d + k * d * (d + 1) // 2
    return model, -2.0 * model.summary.logLikelihood + free * math.log(n)


def segment_profile(df: DataFrame, label: str = "cluster_id") -> DataFrame:
    """Size, share and rounded means per cluster."""
    means = {
        "recency_days": "recency_days", "frequency": "frequency", "total_spend": "total_spend",
        "avg_basket_size": "avg_basket_size", "engagement_score": "engagement_score",
        "churn": "churn_rate", "clv_next_90d": "forward_clv",
    }
    counts = df.groupBy(label).agg(
        F.count("customer_id").alias("customer_count"),
        *[
            (round_even(exact_mean(c), 2) if c in df.columns else F.count(F.lit(1)).cast("double")).alias(name)
            for c, name in means.items()
        ],
    )
    total = F.sum("customer_count").over(Window.partitionBy())  # one row per cluster
    return counts.withColumn("share_of_cohort", round_even(F.col("customer_count") / total, 4))


# Recommended strategy per persona.
STRATEGIES = {
    "VIP Champions": "High spend, frequent, and highly active. Recommend VIP loyalty perks, early product access, and dedicated account manager.",
    "Loyal Regulars": "Consistent, steady purchasing cadence with moderate spend. Recommend cross-selling campaigns and replenishment reminders.",
    "High-Value Inactive": "Historically high spenders who made bulk orders but became inactive. Urgent intervention required: win-back discounts and executive outreach.",
    "At-Risk / Lapsed": "Low frequency, low spend buyers with high churn risk. Recommend automated promotional email drips and price-incentive promos.",
}
DEFAULT_STRATEGY = "Targeted engagement campaigns."


def persona(recency: Column, orders: Column, spend: Column) -> Column:
    return (
        F.when((spend >= 50000) | (orders >= 50), "VIP Champions")
        .when((orders >= 1) & (spend >= 8000) & (recency >= 200), "High-Value Inactive")
        .when((recency <= 90) & (orders >= 5), "Loyal Regulars")
        .otherwise("At-Risk / Lapsed")
    )


def label_personas(profile: DataFrame, label: str = "cluster_id") -> DataFrame:
    """Adds a unique ``segment_name`` and its strategy to a cluster profile."""
    named = profile.withColumn("_name", persona(F.col("recency_days"), F.col("frequency"), F.col("total_spend")))
    repeat = F.row_number().over(Window.partitionBy("_name").orderBy(label)) > 1  # few clusters
    suffixed = F.concat(F.col("_name"), F.lit(" (Cohort "), F.col(label).cast("string"), F.lit(")"))
    texts = F.create_map(*[F.lit(t) for pair in STRATEGIES.items() for t in pair])
    return (
        named.withColumn("segment_name", F.when(repeat, suffixed).otherwise(F.col("_name")))
        .withColumn(
            "recommended_strategy",
            F.coalesce(F.try_element_at(texts, F.col("segment_name")), F.lit(DEFAULT_STRATEGY)),
        )
        .drop("_name")
    )


def with_segment_names(df: DataFrame, personas: DataFrame, label: str = "cluster_id") -> DataFrame:
    return df.join(F.broadcast(personas.select(label, "segment_name")), label, "left")  # one row per cluster


def segment_customers(
    df: DataFrame, columns: tuple[str, ...] = FEATURES, k: int = 4, restarts: int = 15
) -> tuple[DataFrame, DataFrame, KMeansModel, Scaler]:
    """K-means segments with personas: (customers, profile, model, scaler)."""
    scaler = fit_scaler(df, [c for c in columns if c in df.columns])
    vectors = written(scaled_vectors(df, scaler), "segment_vectors")
    model = fit_kmeans(vectors.select("x"), k, restarts)
    clustered = model.transform(vectors).drop("x")
    profile = label_personas(segment_profile(clustered))
    return with_segment_names(clustered, profile), profile, model, scaler
