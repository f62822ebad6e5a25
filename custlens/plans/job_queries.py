"""Queries that go through files: what the jobs write is read again and returned."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from custlens import jobs
from custlens.functions.columns import days_before
from custlens.functions.stages import new_path, written
from custlens.operators import scoring
from custlens.operators.clean import CLEANED_COLUMNS
from custlens.operators.orders import latest_date
from custlens.plans import serving as plan, tables
from custlens.sources import sinks
from custlens.sources.headers import read_by_header
from custlens.sources.invoices import RAW_COLUMNS, load_raw


def sheets(s, d) -> list[str]:
    """The raw lines as two sheets of eight columns, one of them with the columns turned round."""
    folder = new_path(s, "sheets")
    raw = written(tables.raw(s, d), "raw_lines")  # both sheets read it
    wide = raw.select(*[F.col(mine).cast("string").alias(theirs) for theirs, mine in RAW_COLUMNS.items()])
    late = F.year("InvoiceDate") >= 1996
    wide.filter(~late).write.option("header", True).option("escape", '"').csv(f"{folder}/early")
    wide.filter(late).select(*reversed(wide.columns)).write.option("header", True).option("escape", '"').csv(f"{folder}/late")
    return [f"{folder}/early", f"{folder}/late"]


def ingest_sheets(s, d):
    """All sheets as typed lines, through the cache table."""
    cache = f"{new_path(s, 'sheet_cache')}"
    load_raw(s, sheets(s, d), "csv", cache)
    return load_raw(s, [], "csv", cache)  # from the cache


def cleaned_roundtrip(s, d):
    """The cleaned table of the job on sheets, read up to the cutoff."""
    out = new_path(s, "cleaned_by_month")
    jobs.clean_job(s, sheets(s, d), out, "csv", report=new_path(s, "clean_report"))
    # The job's own lines have the last date; the test tables need not be cleaned once more for it.
    cutoff = days_before(latest_date(sinks.read_cleaned(s, out)), tables.WINDOW_DAYS)
    return sinks.read_cleaned(s, out, cutoff).select(*CLEANED_COLUMNS)


def features_roundtrip(s, d):
    """The feature table of the job on a cleaned table."""
    cleaned, out = new_path(s, "cleaned_by_month"), new_path(s, "features_out")
    sinks.write_cleaned(tables.cleaned(s, d), cleaned)
    return jobs.features_job(s, cleaned, out)


def serving_roundtrip(s, d):
    """The serving tables of the job, read back from the catalog and joined."""
    cleaned, features, out = new_path(s, "cleaned_by_month"), new_path(s, "features_out"), new_path(s, "serving")
    database = f"serving_{uuid.uuid4().hex}"
    s.sql(f"CREATE DATABASE {database} LOCATION '{new_path(s, 'serving_tables')}'")
    sinks.write_cleaned(tables.cleaned(s, d), cleaned)
    jobs.features_job(s, cleaned, features)
    jobs.serving_job(s, cleaned, features, plan.stored_bundle(s, d, "rules"), out, plan.SEEDED_AT, database=database)
    read = lambda name, *columns: sinks.read_serving(s, f"{database}.{name}", ["customer_id", *columns])
    joined = read("customers", "country", "is_uk").join(read("customer_segments", "segment_name", "updated_at"), "customer_id")
    joined = joined.join(read("predictions", "churn_probability", "predicted_clv", "risk_tier", "model_version"), "customer_id")
    return joined.join(read("anomaly_reports", "reconstruction_error", "is_anomaly_95", "is_anomaly_99"), "customer_id")


def export_roundtrip(s, d):
    """The CSV export of a scoring run, read by its header."""
    out = new_path(s, "export_csv")
    scored = plan.rescored(s, d)
    jobs.export_job(scored, out)
    kinds = dict(zip(scoring.EXPORT_COLUMNS, [f.dataType for f in scoring.export_rows(scored).schema.fields]))
    return read_by_header(s, [out], kinds.__getitem__)


QUERIES = {f.__name__: f for f in (ingest_sheets, cleaned_roundtrip, features_roundtrip, serving_roundtrip, export_roundtrip)}
