"""Queries on splits, metrics, model fits, sequences, anomalies, segments and explanations."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from custlens.functions.columns import round_even
from custlens.functions.stages import new_path, stage, written
from custlens.operators import anomaly, explain, linear, models, runlog, segments, sequences, splits, surrogate
from custlens.operators.metrics import classifier_metrics, exact_auc, regressor_metrics
from custlens.operators.neighbours import distance_vote, nearest_neighbours
from custlens.operators.orders import order_events
from custlens.operators.trees import load_ensemble, with_tree_factors
from custlens.plans import serving as serving_plan, tables, training
from custlens.plans.serving import RULE_WEIGHTS, rule_clv, rule_cluster, rule_margin, rule_probability


def split_assign(s, d):
    return splits.assign_splits(tables.features(s, d)).select("customer_id", "churn", "split")


def split_assign_clv(s, d):
    return splits.assign_splits(tables.features(s, d), "clv_next_90d").select("customer_id", "split")


def scaled_features(s, d):
    rows = splits.assign_splits(tables.features(s, d))
    names = splits.model_inputs(rows)
    scaler = splits.fit_scaler(rows.filter("split = 'train'"), names)
    return rows.select("customer_id", "split", *[round_even(scaler.scaled(c), 6).alias(c) for c in names])


def scaled_cohort(s, d):
    f = tables.features(s, d)
    scaler = splits.fit_scaler(f, list(anomaly.FEATURES))
    return f.select("customer_id", *[round_even(scaler.scaled(c), 6).alias(c) for c in scaler.columns])


def class_weights(s, d):
    return splits.class_weights(tables.features(s, d)).withColumn("weight", round_even("weight", 6))


def _rule_scored(s, d):
    return tables.features(s, d).withColumn("probability", rule_probability()).withColumn("prediction", rule_clv())


def classification_metrics(s, d):
    return classifier_metrics(_rule_scored(s, d))


def exact_auc_query(s, d):
    # The margin orders as the probability does, without the exponential.
    f = tables.features(s, d).withColumn("margin", rule_margin())
    return exact_auc(f, "churn", "margin").select(round_even("roc_auc", 9).alias("roc_auc"))


def regression_metrics(s, d):
    return regressor_metrics(_rule_scored(s, d))


def regression_metrics_log(s, d):
    f = tables.features(s, d).withColumn("prediction", F.log1p(rule_clv()))
    return regressor_metrics(f, is_log=True)


RUN_AT = (datetime(2001, 8, 2), datetime(2001, 8, 9))
CHURN_RULES = {
    "recency_rule": lambda: F.col("recency_days") / 100.0 - 0.5, "order_rule": lambda: 1.0 - F.col("frequency") / 5.0,
    "both_rule": rule_margin,
}
CLV_RULES = {"half_spend": 0.5, "third_spend": 0.3, "rule_spend": 0.45}


def rule_log(s, d) -> str:
    """A run log of rules: a first version measured on the validation rows, and a second one on the test rows."""
    def build():
        folder = new_path(s, "rule_log")
        for version, (part, at) in enumerate(zip(("val", "test"), RUN_AT), 1):
            for target, rules in (("churn", CHURN_RULES), ("clv_next_90d", CLV_RULES)):
                rows = training.splits(s, d, target).filter(F.col("split") == part)
                for name, rule in rules.items():
                    if target == "churn":
                        measured = classifier_metrics(rows.withColumn("probability", 1.0 / (1.0 + F.exp(-rule()))), "churn")
                    else:
                        prediction = F.lit(rule) * F.greatest(F.col("total_spend"), F.lit(0.0))
                        measured = regressor_metrics(rows.withColumn("prediction", prediction))
                    runlog.append(runlog.run_rows(
                        measured.withColumn("model", F.lit(name)), target, version, at, f"models/v{version}", f'{{"rule": "{name}"}}',
                        len(training.columns(s, d))), folder)
        return runlog.read(s, folder)

    return stage(s, d, "rule_log", build)


def model_pick(s, d):
    """Best churn and value model of a run log."""
    return runlog.active(rule_log(s, d)).select("model", "target", F.col("test_value").alias("quality"))


def model_registry(s, d):
    """Version, time, place, parameters and quality of the last run of every model, and which are active."""
    return runlog.registry(rule_log(s, d))


def knn_vote(s, d):
    queries, train = training.knn_inputs(s, d)
    votes = distance_vote(nearest_neighbours(queries, train))
    return votes.select(F.col("qid").alias("customer_id"), round_even("probability", 6).alias("probability"))


def ridge_gram(s, d):
    rows = splits.assign_splits(tables.features(s, d), "clv_next_90d").filter("split = 'train'")
    names = splits.model_inputs(rows)
    scaler = splits.fit_scaler(rows, names)
    scaled = scaler.apply(rows).withColumn("clv_millions", F.col("clv_next_90d") / 1e6)
    return linear.gram_sums(scaled, names, "clv_millions").withColumn("value", round_even("value", 6))


def ridge_weights(s, d):
    """Coefficients of the closed-form ridge on the training rows."""
    rows = splits.assign_splits(tables.features(s, d), "clv_next_90d").filter("split = 'train'")
    names = splits.model_inputs(rows)
    model = linear.fit_ridge(splits.fit_scaler(rows, names).apply(rows), names, "clv_next_90d")
    pairs = [("intercept", model.intercept), *model.weights.items()]
    return s.createDataFrame(pairs, "feature string, weight double")


def purchase_sequences(s, d):
    steps = sequences.sequence_steps(sequences.purchase_sequences(order_events(tables.observed(s, d))))
    return steps.select("customer_id", "position", *[round_even(c, 6).alias(c) for c in sequences.STEP])


def sequence_model(s, d):
    """Metrics of a churn network on the flattened sequences (24 inputs)."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    seq = sequences.purchase_sequences(order_events(tables.observed(s, d)))
    rows = training.splits(s, d, "churn").join(seq, "customer_id").select(
        "customer_id", "split", F.col("churn").cast("double").alias("label"), array_to_vector(F.flatten("sequence")).alias("features")
    )
    rows = written(rows, "sequence_rows")
    width = sequences.LENGTH * len(sequences.STEP)
    with splits.fitting_rows(rows.filter("split = 'train'")) as train:
        model = MultilayerPerceptronClassifier(layers=[width, 64, 32, 2], maxIter=60, seed=splits.SEED).fit(train)
    scored = model.transform(rows.filter("split = 'test'")).withColumn("probability", vector_to_array("probability")[1])
    return classifier_metrics(scored, "label")


def anomaly_scores(s, d):
    profile, p95, p99 = serving_plan.spending_profile(s, d)
    f = profile.with_error(tables.features(s, d), "e").select(
        "customer_id", round_even("e", 6).alias("reconstruction_error")
    )
    return anomaly.anomaly_flags(f, "reconstruction_error", p95, p99)


def _deviation(s, d):
    f = tables.features(s, d)
    scaler = splits.fit_scaler(f, list(anomaly.FEATURES))
    return f.select("customer_id", round_even(anomaly.mean_square(scaler), 6).alias("error"))


def anomaly_thresholds(s, d):
    return anomaly.anomaly_thresholds(_deviation(s, d), "error")


def kmeans_sweep(s, d):
    f = tables.features(s, d)
    vectors = splits.scaled_vectors(f, splits.fit_scaler(f, list(segments.FEATURES))).select("x")
    vectors = written(vectors, "sweep_vectors")
    rows = segments.evaluate_cluster_range(vectors)
    return s.createDataFrame(rows, "k int, inertia double, silhouette_sq double, davies_bouldin double")


def kmeans_segments(s, d):
    return serving_plan.segmented(s, d)[0].select("customer_id", "cluster_id", "segment_name")


def kmeans_profile(s, d):
    return serving_plan.segmented(s, d)[1]


def gmm_segments(s, d):
    f = tables.features(s, d)
    vectors = splits.scaled_vectors(f, splits.fit_scaler(f, list(segments.FEATURES)))
    model, bic = segments.fit_gmm(vectors, 4)
    return model.transform(vectors).select("customer_id", "gmm_cluster_id", F.lit(bic).alias("bic"))


def _labelled(s, d):
    f = tables.features(s, d)
    scaler = splits.fit_scaler(f, list(segments.FEATURES))
    return f.withColumn("cluster_id", rule_cluster()), scaler


def silhouette_fixed(s, d):
    f, scaler = _labelled(s, d)
    value = segments.squared_silhouette(splits.scaled_vectors(f, scaler).withColumn("cluster_id", F.col("cluster_id").cast("double")))
    return s.createDataFrame([(value,)], "v double").select(round_even("v", 6).alias("silhouette_sq"))


def davies_bouldin_fixed(s, d):
    f, scaler = _labelled(s, d)
    out = segments.davies_bouldin(f, [scaler.scaled(c) for c in scaler.columns], "cluster_id")
    return out.select(round_even("davies_bouldin", 6).alias("davies_bouldin"))


def segment_profile(s, d):
    return segments.segment_profile(tables.features(s, d).withColumn("cluster_id", rule_cluster()))


def persona_rules(s, d):
    f = tables.features(s, d).withColumn("cluster_id", rule_cluster())
    named = segments.label_personas(segments.segment_profile(f))
    return named.select("cluster_id", "segment_name", "recommended_strategy")


def _factors(s, d):
    return linear.linear_attributions(tables.features(s, d), RULE_WEIGHTS)


def linear_attribution(s, d):
    return _factors(s, d).select("customer_id", F.inline("factors")).select(
        "customer_id", "feature", "value", round_even("attribution", 6).alias("attribution")
    )


def global_importance(s, d):
    return explain.global_importance(_factors(s, d)).withColumn("importance", round_even("importance", 6))


def top_factors(s, d):
    top = _factors(s, d).select("customer_id", F.posexplode(explain.top_factors(F.col("factors"))).alias("place", "f"))
    return top.select("customer_id", (F.col("place") + 1).alias("place"), "f.feature", "f.value", "f.attribution", "f.direction")


def representatives(s, d):
    f = tables.features(s, d).select("customer_id", round_even(rule_probability(), 9).alias("churn_probability"))
    return explain.representatives(f)


def tree_attribution(s, d):
    """Attributions of the production tree model for the whole cohort."""
    name = serving_plan.tree_model(s, d)
    f = training.fitted(s, d, name)
    ensemble = load_ensemble(s, f.model, f.path)
    out = with_tree_factors(tables.features(s, d), ensemble, training.columns(s, d))
    return out.select("customer_id", "margin", "base", F.inline("factors"))


def tree_importance(s, d):
    """Mean absolute attribution of the production tree model."""
    name = serving_plan.tree_model(s, d)
    f = training.fitted(s, d, name)
    out = with_tree_factors(
        tables.features(s, d), load_ensemble(s, f.model, f.path), training.columns(s, d)
    )
    return explain.global_importance(out)


def local_surrogate(s, d):
    """Local rules of the production tree model for every customer."""
    name = serving_plan.tree_model(s, d)
    rows, names = training.splits(s, d, "churn"), training.columns(s, d)
    # The bins need no model, and the fit leaves cores idle between its many short stages.
    f, bins = splits.in_parallel(lambda make: make(), [
        lambda: training.fitted(s, d, name), lambda: surrogate.fit_bins(rows.filter("split = 'train'"), names)])
    ensemble = load_ensemble(s, f.model, f.path)
    out = surrogate.local_surrogates(rows, bins, ensemble.probability)
    return out.select("customer_id", "churn_probability", "surrogate_score", F.inline("factors"))


def narrative(s, d):
    rows = linear.linear_attributions(
        tables.features(s, d), RULE_WEIGHTS, keep={"probability": rule_probability()})
    text = explain.narrative(F.col("customer_id"), F.col("probability"), explain.top_factors(F.col("factors")))
    return rows.select("customer_id", text.alias("narrative"))


def playbook(s, d):
    text = explain.playbook(
        F.col("customer_id"), rule_probability(), F.col("recency_days"), F.col("frequency").cast("double"),
        F.col("total_spend"), rule_clv(),
    )
    return tables.features(s, d).select("customer_id", text.alias("playbook"))


# ---- what must hold for fitted models, per customer, so that SQL can state it over the cohort ----


def tree_additivity(s, d):
    """Whether a customer's attributions and the base add up to the model's margin."""
    f = training.fitted(s, d, serving_plan.tree_model(s, d))
    out = with_tree_factors(tables.features(s, d), load_ensemble(s, f.model, f.path), training.columns(s, d))
    total = F.aggregate("factors", F.lit(0.0), lambda x, y: x + y["attribution"]) + F.col("base")
    return out.select("customer_id", (F.abs(total - F.col("margin")) < 1e-6).alias("adds_up"))


def kmeans_membership(s, d):
    """How many clusters and names a customer has, and whether its name is that of its cluster."""
    rows, profile = serving_plan.segmented(s, d)[:2]
    named = rows.join(F.broadcast(profile.select("cluster_id", F.col("segment_name").alias("own"))), "cluster_id", "left")
    return named.groupBy("customer_id").agg(
        F.count_distinct("cluster_id").alias("clusters"), F.count_distinct("segment_name").alias("names"),
        F.bool_and(F.col("segment_name") == F.col("own")).alias("name_of_cluster"))


def anomaly_consistency(s, d):
    """Whether errors are not negative, and flags agree with the cuts and with each other."""
    _, p95, p99 = serving_plan.spending_profile(s, d)
    rows = anomaly_scores(s, d)
    e, cut95, cut99 = F.col("reconstruction_error"), F.lit(p95), F.lit(p99)
    return rows.select(
        "customer_id", (e >= 0).alias("not_negative"), ((e >= cut95) == F.col("is_anomaly_95")).alias("flag_95"),
        ((e >= cut99) == F.col("is_anomaly_99")).alias("flag_99"), (~F.col("is_anomaly_99") | F.col("is_anomaly_95")).alias("nested"))


def prediction_totals(s, d):
    """Rows with a probability from 0 to 1 by model, split and class; they add up to the split's classes."""
    parts = [
        training.predictions(s, d, name).groupBy(F.lit(name).alias("model"), "split", F.col("label").cast("int").alias("churn")).agg(
            F.count_if(F.col("probability").between(0.0, 1.0)).alias("n"))
        for name in ("churn_lr", "churn_tree", "churn_rf")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


QUERIES = {
    f.__name__: f
    for f in (
        split_assign, split_assign_clv, scaled_features, scaled_cohort, class_weights,
        knn_vote, ridge_gram, ridge_weights, purchase_sequences, anomaly_thresholds, silhouette_fixed,
        davies_bouldin_fixed, segment_profile, persona_rules, linear_attribution, global_importance, top_factors,
        representatives, narrative, playbook, anomaly_scores, sequence_model, kmeans_sweep, kmeans_segments,
        kmeans_profile, gmm_segments,
    )
}
QUERIES["classifier_metrics"] = classification_metrics
QUERIES["exact_auc"] = exact_auc_query
QUERIES["regressor_metrics"] = regression_metrics
QUERIES["regressor_metrics_log"] = regression_metrics_log


def _evaluation(name):
    return lambda s, d: training.evaluation(s, d, name)


for _name in (*models.CHURN_MODELS, "churn_knn", *models.CLV_MODELS):
    QUERIES[_name] = _evaluation(_name)
QUERIES.update({
    f.__name__: f
    for f in (model_pick, model_registry, tree_attribution, tree_importance, local_surrogate, tree_additivity, kmeans_membership,
              anomaly_consistency, prediction_totals)
})
