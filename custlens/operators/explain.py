"""Factor arrays, importance and texts. A factor is {feature, value, attribution}."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from custlens.functions.columns import round_even, round_exact

KEEP_FACTORS = 8
API_FACTORS = 5


def global_importance(df: DataFrame) -> DataFrame:
    """Mean absolute attribution per feature, largest first."""
    return (
        df.select(F.inline("factors")).groupBy("feature")
        .agg(F.avg(F.abs("attribution")).alias("importance"))
        .orderBy(F.desc("importance"), "feature")
    )


def top_factors(factors: Column, keep: int = KEEP_FACTORS) -> Column:
    """The factors with the largest absolute attribution, rounded, with a direction text."""
    ranked = F.array_sort(F.transform(factors, lambda f: F.struct(
        (-F.abs(f["attribution"])).alias("rank"), f["feature"].alias("feature"),
        f["value"].alias("value"), f["attribution"].alias("attribution"),
    )))
    return F.transform(F.slice(ranked, 1, keep), lambda f: F.struct(
        f["feature"].alias("feature"),
        round_exact(f["value"], 2).alias("value"),
        round_exact(f["attribution"], 4).alias("attribution"),
        F.when(f["attribution"] > 0, "Increases Risk").otherwise("Decreases Risk (Protective)").alias("direction"),
    ))


def representatives(df: DataFrame, probability: str = "churn_probability", key: str = "customer_id") -> DataFrame:
    """The customers with the lowest, the most undecided and the highest probability; ties by key."""
    p = F.col(probability)
    picks = {
        "low_risk": F.struct(p, F.col(key)),
        "borderline": F.struct(F.abs(p - 0.5), F.col(key)),
        "high_risk": F.struct(-p, F.col(key)),
    }
    row = df.agg(*[F.min_by(F.struct(F.col(key), p.alias("p")), order).alias(name) for name, order in picks.items()])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("profile"), F.col(f"{n}.{key}").alias(key), F.col(f"{n}.p").alias(probability))
        for n in picks
    ])))


def _fixed(x: Column, digits: int) -> Column:
    """Text with ``digits`` decimals; the rounding is done before the formatting."""
    rounded = round_exact(x, digits)
    return F.format_string(f"%.{digits}f", rounded)


def _grouped(x: Column) -> Column:
    return F.format_string("%,.2f", round_exact(x, 2))


def _percent(x: Column) -> Column:
    return F.concat(_fixed(x * 100.0, 1), F.lit("%"))


def _plain(x: Column) -> Column:
    """A value of at most two decimals the short way: 3.0, 0.25, 1234.5."""
    return F.regexp_replace(x.cast("decimal(38,2)").cast("string"), r"(\.\d)0$", "$1")


# Feature names in prose.
FRIENDLY_NAMES = {
    "recency_days": "days since last purchase",
    "frequency": "total lifetime order count",
    "total_spend": "total historical net spend",
    "avg_basket_size": "average order basket size",
    "velocity_acceleration": "recent purchasing pace relative to historical rate",
    "recent_orders_last_90d": "orders placed in the last 90 days",
    "recent_orders_ratio": "percentage of lifetime orders in the last 90 days",
    "inter_purchase_mean": "average days between orders",
    "inter_purchase_std": "consistency of purchase intervals",
    "return_line_rate": "percentage of transactions returned",
    "return_spend_ratio": "ratio of refund value to gross purchases",
    "discount_sensitivity": "share of purchases bought on promotional discount",
    "engagement_score": "overall customer health score",
}


def _friendly(name: Column) -> Column:
    words = F.create_map(*[F.lit(t) for pair in FRIENDLY_NAMES.items() for t in pair])
    return F.coalesce(F.try_element_at(words, name), F.replace(name, F.lit("_"), F.lit(" ")))


def _other(f: Column) -> Column:
    return F.concat(_friendly(f["feature"]), F.lit(" ("), _plain(f["value"]), F.lit(")"))


def _risk_phrase(f: Column) -> Column:
    name, value = f["feature"], f["value"]
    return (
        F.when(name.contains("recency"), F.concat(_fixed(value, 0), F.lit(" days of inactivity")))
        .when(
            name.contains("velocity"),
            F.when(value < 0.5, "a significant deceleration in recent ordering pace")
            .otherwise("irregular purchasing velocity"),
        )
        .when(name.contains("return"), F.concat(F.lit("an elevated return rate of "), _percent(value)))
        .when(name.contains("recent_orders"), F.concat(F.lit("only "), _fixed(value, 0), F.lit(" orders in the last 90 days")))
        .otherwise(_other(f))
    )


def _protective_phrase(f: Column) -> Column:
    name, value = f["feature"], f["value"]
    return (
        F.when(name.contains("spend"), F.concat(F.lit("strong lifetime spend of £"), _grouped(value)))
        .when(name.contains("frequency"), F.concat(F.lit("a history of "), _fixed(value, 0), F.lit(" completed orders")))
        .when(
            name.contains("engagement"),
            F.concat(F.lit("a resilient customer health score of "), _fixed(value, 0), F.lit("/100")),
        )
        .otherwise(_other(f))
    )


def narrative(key: Column, probability: Column, factors: Column) -> Column:
    """Plain-language briefing from a probability and its top factors."""
    def phrases(keep, phrase):
        return F.concat_ws(" and ", F.transform(F.slice(F.filter(factors, keep), 1, 2), phrase))

    drivers = phrases(lambda f: f["attribution"] > 0, _risk_phrase)
    shields = phrases(lambda f: f["attribution"] < 0, _protective_phrase)
    high, medium = probability >= 0.75, probability >= 0.45
    tier = F.when(high, "High Churn Risk").when(medium, "Borderline / Moderate Risk").otherwise("Healthy / Low Risk")
    advice = (
        F.when(high, "Immediate proactive retention outreach is recommended.")
        .when(medium, "Proactive monitoring and targeted re-engagement campaigns are advised.")
        .otherwise("Customer is in good standing; focus on loyalty rewards and cross-sell.")
    )
    return F.concat_ws(
        " ",
        F.concat(
            F.lit("Customer #"), key.cast("string"), F.lit(" is evaluated as **"), tier,
            F.lit("** with a predicted churn probability of **"), _percent(probability), F.lit("**."),
        ),
        F.when(drivers != "", F.concat(F.lit("The primary factors driving this risk are **"), drivers, F.lit("**."))),
        F.when(shields != "", F.concat(F.lit("Conversely, the customer's risk is mitigated by **"), shields, F.lit("**."))),
        advice,
    )


def playbook(
    key: Column, probability: Column, recency: Column, orders: Column, spend: Column, clv: Column
) -> Column:
    """Retention playbook text by risk tier."""
    p, who = _percent(probability), key.cast("string")
    days, count = _fixed(recency, 0), _fixed(orders, 0)
    high = F.concat(
        F.lit("🚨 **High Churn Risk ("), p, F.lit("):** Customer #"), who, F.lit(" has been inactive for "), days,
        F.lit(" days with order velocity decaying significantly compared to their historical pace ("), count,
        F.lit(" total orders). **Prescribed Action:** Deploy an immediate win-back incentive (e.g., 15% promotional discount"
              " on previously purchased categories) before day 90 to prevent a permanent loss of £"), _grouped(clv),
        F.lit(" in forward value."),
    )
    medium = F.concat(
        F.lit("⚠️ **Moderate Churn Risk ("), p, F.lit("):** Customer #"), who, F.lit(" represents a steady regular buyer ("),
        count, F.lit(" lifetime orders, £"), _grouped(spend),
        F.lit(" spend) showing slight elongation between purchase cycles ("), days,
        F.lit(" days recency). **Prescribed Action:** Schedule a personalized replenishment reminder or loyalty tier upgrade"
              " to re-engage active browsing."),
    )
    low = F.concat(
        F.lit("🌟 **High Engagement & Low Risk ("), p, F.lit("):** Customer #"), who,
        F.lit(" is an active, high-value account ("), count, F.lit(" orders, £"), _grouped(spend),
        F.lit(" spend) with strong recent activity ("), days,
        F.lit(" days recency). **Prescribed Action:** Include in VIP exclusive early-access product drops and cross-sell"
              " premium complementary catalogue items."),
    )
    return F.when(probability >= 0.70, high).when(probability >= 0.40, medium).otherwise(low)
