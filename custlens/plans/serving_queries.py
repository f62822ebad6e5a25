"""Queries on scoring, serving tables and reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from custlens.functions.columns import round_even
from custlens.functions.stages import input_version, new_path
from custlens.operators import bundle, scoring, serving
from custlens.plans import serving as plan, tables
from custlens.sources.uploads import read_scoring_csv
from custlens.streaming.scoring import read_scored, start_scoring
from custlens.streaming.store import ServingStore


def impute_features(s, d):
    records, _ = scoring.check_records(plan.partial_records(s, d))
    out = scoring.impute(records)
    return out.select("customer_id", *[round_even(c, 6).alias(c) for c in out.columns if c != "customer_id"])


def reject_rows(s, d):
    """Range checks on records some of which leave the allowed ranges."""
    pace = tables.features(s, d).select("customer_id", F.col("velocity_acceleration").alias("pace"))
    records = plan.partial_records(s, d).join(pace, "customer_id", "left").withColumns({
        "recency_days": F.when(F.col("frequency") != 3, F.col("recency_days") - 30.0),
        "return_line_rate": F.col("pace") / 2.0,
    }).drop("pace")
    _, bad = scoring.check_records(records)
    return bad.select("customer_id", F.array_join("reject_reasons", "; ").alias("reasons"))


def risk_tier(s, d):
    p = plan.rule_probability()
    return tables.features(s, d).select(
        "customer_id", scoring.risk_tier(p).alias("risk_tier"), (p >= 0.50).alias("is_churn")
    )


def batch_summary(s, d):
    return scoring.batch_summary(plan.rescored(s, d))


def batch_export(s, d):
    return scoring.export_rows(plan.rescored(s, d))


def serving_customers(s, d):
    return plan.seeded(s, d)["customers"]


def serving_segments(s, d):
    return plan.seeded(s, d)["customer_segments"]


def serving_predictions(s, d):
    return plan.seeded(s, d)["predictions"]


def serving_anomalies(s, d):
    return plan.seeded(s, d)["anomaly_reports"]


def upsert_customers(s, d):
    return plan.histories(s, d)["customers"]


def upsert_segments(s, d):
    return plan.histories(s, d)["customer_segments"]


def append_predictions(s, d):
    return plan.histories(s, d)["predictions"]


def append_anomalies(s, d):
    return plan.histories(s, d)["anomaly_reports"]


def customer_360(s, d):
    h = plan.histories(s, d)
    full = serving.customer_360(
        h["customers"], h["customer_segments"], h["predictions"], h["anomaly_reports"], tables.features(s, d)
    )
    return full.select(
        "customer_id", "country", "first_order_date", "last_order_date", "is_uk",
        "segment.segment_name", F.col("latest_prediction.churn_probability").alias("latest_probability"),
        F.col("latest_prediction.scored_at").alias("latest_scored_at"),
        F.col("historical_predictions_count").alias("predictions"),
        F.col("latest_anomaly.reconstruction_error").alias("latest_error"), "latest_anomaly.is_anomaly_95",
        "rfm_metrics.recency_days", "rfm_metrics.frequency", "rfm_metrics.total_spend", "rfm_metrics.return_rate",
    )


def prediction_history(s, d):
    return serving.prediction_history(plan.histories(s, d)["predictions"]).select(
        "customer_id", "scored_at", "churn_probability", "risk_tier"
    )


def customer_page(s, d):
    h = plan.histories(s, d)
    page = serving.customer_page(
        h["customers"], h["customer_segments"], h["predictions"], tables.features(s, d), limit=200, offset=100
    )
    return page.select(
        "customer_id", "country", "segment_name", "churn_probability", "risk_tier", "scored_at",
        "historical_predictions_count", "recency_days", "total_spend",
    )


_VIEW = (
    "customer_id", "segment_name", "primary_country", "recency_days", "frequency", "total_spend", "churn_probability",
    "predicted_clv", "risk_tier", "reconstruction_error", "is_anomaly_95",
)


def cohort_view(s, d):
    h = plan.histories(s, d)
    return serving.cohort_view(plan.rule_segmented(s, d), h["predictions"], h["anomaly_reports"]).select(*_VIEW)


def cohort_view_unscored(s, d):
    """The view before any scoring: all stand-in values."""
    h = plan.seeded(s, d)
    return serving.cohort_view(
        plan.rule_segmented(s, d), h["predictions"].filter(F.lit(False)), h["anomaly_reports"].filter(F.lit(False))
    ).select(*_VIEW)


def kpis(s, d):
    row = serving.kpis(plan.cohort(s, d))
    return row.withColumns({"churn_percent": round_even("churn_percent", 6), "mean_clv": round_even("mean_clv", 4)})


def tier_counts(s, d):
    return serving.tier_counts(plan.cohort(s, d))


def segment_filter(s, d):
    return serving.segment_filter(plan.cohort(s, d)).select("customer_id", "segment_name", "total_spend")


def fixed_sample(s, d):
    return serving.fixed_sample(plan.cohort(s, d), 500).select("customer_id", "recency_days", "total_spend")


def segment_summary(s, d):
    out = serving.segment_summary(plan.cohort(s, d))
    return out.select("segment_name", "customers", *[round_even(c, 4).alias(c) for c in out.columns[2:]])


def leaderboard(s, d):
    return serving.leaderboard(serving.at_risk(plan.cohort(s, d)))


def leaderboard_total(s, d):
    return serving.leaderboard_total(serving.at_risk(plan.cohort(s, d)))


def batch_score(s, d):
    """Partial records scored with the models in production, fitted once, stored, and loaded from their folder."""
    scorer = bundle.load(s, plan.stored_bundle(s, d, "fitted")).scorer(s)
    scored, _ = scoring.score_batch(plan.partial_records(s, d), scorer, scoring.MODEL_VERSION, plan.RESCORED_AT)
    return scored.withColumn("top_risk_factors", F.to_json("top_risk_factors"))


def bundle_score(s, d):
    """Partial records scored with the rule bundle, from its folder alone."""
    scorer = bundle.load(s, plan.stored_bundle(s, d, "rules")).scorer(s)
    scored, _ = scoring.score_batch(plan.partial_records(s, d), scorer, scoring.MODEL_VERSION, plan.RESCORED_AT)
    return scoring.export_rows(scored)


def upload_folder(s, d) -> str:
    """CSV files as customers send them: four or five columns in different orders, and one with further customers' rows.

    Odd customers come with the columns turned round, every 50th one's recency is no number, every 70th one's frequency
    is out of range, and every 90th one comes a second time.
    """
    folder = new_path(s, "uploads")
    rows = plan.partial_records(s, d).select("customer_id", "recency_days", "frequency", "total_spend").withColumns({
        "recency_days": F.when(F.col("customer_id") % 50 == 0, float("nan")).otherwise(F.col("recency_days")),
        "frequency": F.when(F.col("customer_id") % 70 == 0, -1.0).otherwise(F.col("frequency")),
    })
    odd = F.col("customer_id") % 2 == 1
    parts = {
        "even": rows.filter(~odd),
        "odd": rows.filter(odd).select("total_spend", F.lit("web").alias("channel"), "frequency", "customer_id", "recency_days"),
        "again": rows.filter(F.col("customer_id") % 90 == 0).select("frequency", "total_spend", "recency_days", "customer_id"),
    }
    for part in parts.values():
        part.write.mode("append").option("header", True).csv(f"{folder}/in")
    return folder


def upload_rows(s, d):
    """What a folder of uploads holds, by header: accepted records and reasons of the rejected ones."""
    records, _ = read_scoring_csv(s, f"{upload_folder(s, d)}/in", scoring.SCORING_SCHEMA)
    good, bad = scoring.check_records(records)
    columns = ["customer_id", "recency_days", "frequency", "total_spend", "avg_order_value"]
    return good.select(*columns, F.lit("").alias("reasons")).unionByName(
        bad.select(*columns, F.array_join("reject_reasons", "; ").alias("reasons")))


def stream_score(s, d):
    """The uploads scored by the stream with the rule scorer."""
    folder = upload_folder(s, d)
    query = start_scoring(
        s, f"{folder}/in", f"{folder}/out", plan.rule_scorer(s, d), scoring.MODEL_VERSION, once=True,
        clock=lambda: plan.RESCORED_AT,
    )
    query.awaitTermination()
    return scoring.export_rows(read_scored(s, f"{folder}/out"))


STREAMED_AT = (datetime(2001, 8, 9), datetime(2001, 8, 16))
_stores: dict[tuple, str] = {}


def streamed_store(s, d) -> ServingStore:
    """The serving tables after a full load and two runs of the stream.

    The first run gets two thirds of the customers. The second one gets every other customer again, longer ago and with twice
    the spend, and some that are not known yet. The first batch is then offered once more, as after a failure.
    """
    key = (s.sparkContext.applicationId, d, input_version(s, d))
    if key not in _stores:
        folder = new_path(s, "streamed")
        store, scorer = ServingStore(s, f"{folder}/store"), plan.rule_scorer(s, d)
        store.create(plan.seeded(s, d), scorer.p99)
        rows = plan.partial_records(s, d).select("customer_id", "recency_days", "frequency", "total_spend")
        again = rows.withColumns({"recency_days": F.col("recency_days") + 60.0, "total_spend": F.col("total_spend") * 2.0})
        new = again.filter("customer_id % 50 = 0").withColumn("customer_id", F.col("customer_id") + 1_000_000)
        uploads = (rows.filter("customer_id % 3 <> 0"), again.filter("customer_id % 2 = 0").unionByName(new))
        for part, at in zip(uploads, STREAMED_AT):
            part.write.mode("append").option("header", True).csv(f"{folder}/in")
            start_scoring(
                s, f"{folder}/in", f"{folder}/out", scorer, scoring.MODEL_VERSION, once=True, clock=lambda at=at: at, store=store,
            ).awaitTermination()
        store.apply(0, store.spark.read.parquet(store.pending()[0]))
        store.compact()
        _stores[key] = store.folder
    return ServingStore(s, _stores[key])


def stream_customers(s, d):
    return streamed_store(s, d).tables()["customers"]


def stream_segments(s, d):
    return streamed_store(s, d).tables()["customer_segments"]


def stream_predictions(s, d):
    return streamed_store(s, d).tables()["predictions"]


def stream_anomalies(s, d):
    return streamed_store(s, d).tables()["anomaly_reports"]


QUERIES = {
    f.__name__: f
    for f in (
        impute_features, reject_rows, risk_tier, batch_summary, batch_export, serving_customers, serving_segments,
        serving_predictions, serving_anomalies, upsert_customers, upsert_segments, append_predictions,
        append_anomalies, customer_360, prediction_history, customer_page, cohort_view, cohort_view_unscored, kpis, tier_counts,
        segment_filter, fixed_sample, segment_summary, leaderboard, leaderboard_total, upload_rows, stream_score, batch_score,
        bundle_score, stream_customers, stream_segments, stream_predictions, stream_anomalies,
    )
}
