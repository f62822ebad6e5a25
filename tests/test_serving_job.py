"""The serving job: a stored bundle, tables in a store and in the catalog, and a stream that goes on with them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from custlens import jobs
from custlens.functions.stages import new_path
from custlens.operators import serving
from custlens.plans import serving as plan, tables
from custlens.sources import sinks
from custlens.streaming.store import TABLES, ServingStore


def test_serving_job(spark, folder):
    cleaned, features, out = (new_path(spark, n) for n in ("cleaned", "features", "serving"))
    database = f"serving_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{new_path(spark, 'db')}'")
    sinks.write_cleaned(tables.cleaned(spark, folder), cleaned)
    jobs.features_job(spark, cleaned, features)
    store = jobs.serving_job(spark, cleaned, features, plan.stored_bundle(spark, folder, "rules"), out, plan.SEEDED_AT, database=database)
    want = plan.seeded(spark, folder)
    for name in TABLES:
        for got in (store.tables()[name], spark.table(f"{database}.{name}")):
            assert got.select(*want[name].columns).exceptAll(want[name]).count() == 0 and got.count() == want[name].count()
    # a stream's batch on top, read by another store object
    scored = plan.rescored(spark, folder)
    assert ServingStore(spark, out).apply(0, scored)
    assert store.tables()["predictions"].count() == want["predictions"].count() + scored.count()
    newest = serving.latest(store.tables()["predictions"], "scored_at")
    assert newest.filter(F.col("scored_at") == F.lit(plan.RESCORED_AT)).count() == scored.select("customer_id").distinct().count()
