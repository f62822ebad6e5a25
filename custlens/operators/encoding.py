"""Categories as numbers: out-of-fold target encoding, and hot codes of the frequent levels.

The encoding of a training row leaves out its own fold, so no row sees its own label: it is the category's total less that of
the fold. Rows outside training get the whole total. Both are smoothed towards the overall share.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from custlens.functions.joins import lookup_join
from custlens.operators import bundle
from custlens.operators.folds import FOLDS

SMOOTHING = 20.0
MOST_LEVELS = 20


@dataclass
class TargetEncoding:
    """Counts and label sums of each category, whole and by fold, and of all training rows."""

    column: str
    table: DataFrame  # category, n, total, fold_n, fold_total (one number per fold)
    n: list[int]  # rows of each fold
    total: list[float]  # label sums of each fold
    smoothing: float = SMOOTHING

    KIND = "target_encoding"

    @classmethod
    def fit(cls, train: DataFrame, column: str, label: str = "churn", folds: int = FOLDS, smoothing: float = SMOOTHING) -> "TargetEncoding":
        """``train`` holds ``fold``. Rows merge by category and fold before the shuffle; a missing category is one of its own."""
        y = F.col(label).cast("double")
        by_fold = train.groupBy(F.col(column).cast("string").alias("category"), "fold").agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("total"))
        of = lambda c, k: F.coalesce(F.sum(F.when(F.col("fold") == k, F.col(c))), F.lit(0).cast("double" if c == "total" else "bigint"))
        table = by_fold.groupBy("category").agg(
            F.sum("n").alias("n"), F.sum("total").alias("total"),
            F.array(*[of("n", k) for k in range(folds)]).alias("fold_n"), F.array(*[of("total", k) for k in range(folds)]).alias("fold_total"))
        sums = by_fold.groupBy("fold").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()  # one row per fold
        n, total = [0] * folds, [0.0] * folds
        for r in sums:
            n[r["fold"]], total[r["fold"]] = r["n"], r["total"]
        return cls(column, table, n, total, smoothing)

    def apply(self, rows: DataFrame, output: str, key: str = "customer_id") -> DataFrame:
        """Adds the encoding as ``output``. Where ``fold`` is there and not null, it is left out; an unknown category gets the share."""
        category = F.coalesce(F.concat(F.lit("="), F.col(self.column).cast("string")), F.lit(""))
        lookup = self.table.withColumn("_category", F.coalesce(F.concat(F.lit("="), "category"), F.lit(""))).drop("category")
        lookup = lookup.withColumnsRenamed({c: f"_{c}" for c in ("total", "fold_n", "fold_total")}).withColumnRenamed("n", "_rows")
        lookup = lookup.withColumn("_n", F.col("_rows"))
        joined = lookup_join(rows.withColumn("_category", category), lookup, ["_category"], "_rows", spread_by=[key])
        fold = F.col("fold") if "fold" in rows.columns else F.lit(None).cast("int")
        zero = F.lit(0.0)

        def without(whole: Column, parts: Column) -> Column:
            own = F.when(fold.isNotNull(), F.get(parts, fold)).otherwise(zero)
            return F.coalesce(whole, zero) - F.coalesce(own.cast("double"), zero)

        literal = lambda values: F.array(*[F.lit(float(v)) for v in values])
        all_n = without(F.lit(float(sum(self.n))), literal(self.n))
        share = without(F.lit(float(sum(self.total))), literal(self.total)) / F.when(all_n > 0, all_n)
        n, total = without(F.col("_n").cast("double"), F.col("_fold_n")), without(F.col("_total"), F.col("_fold_total"))
        value = (total + F.lit(self.smoothing) * share) / (n + F.lit(self.smoothing))
        return joined.withColumn(output, value).select(*rows.columns, output)

    def save(self, spark: SparkSession, bundles: str, version: str) -> str:
        return bundle.store(spark, bundles, version, self.KIND, {
            "column": self.column, "n": self.n, "total": self.total, "smoothing": self.smoothing,
        }, lambda folder: self.table.write.mode("overwrite").parquet(f"{folder}/categories"))

    @classmethod
    def load(cls, spark: SparkSession, folder: str, m: dict) -> "TargetEncoding":
        return cls(m["column"], spark.read.parquet(f"{folder}/categories"), m["n"], m["total"], m["smoothing"])


@dataclass
class HotCodes:
    """The most frequent levels of a column, by number and then by name; all others are one."""

    column: str
    levels: list[str]

    KIND = "hot_codes"

    @classmethod
    def fit(cls, train: DataFrame, column: str, most: int = MOST_LEVELS) -> "HotCodes":
        counts = train.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("level")).agg(F.count(F.lit(1)).alias("n"))
        top = counts.orderBy(F.desc("n"), "level").limit(most).collect()  # at most ``most`` rows
        return cls(column, [r["level"] for r in top])

    def columns(self) -> dict[str, Column]:
        x = F.col(self.column).cast("string")
        hot = {f"{self.column}_is_{level}": F.coalesce(x == level, F.lit(False)).cast("int") for level in self.levels}
        return hot | {f"{self.column}_is_other": (~F.coalesce(x.isin(self.levels), F.lit(False))).cast("int")}

    def apply(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns(self.columns())

    def save(self, spark: SparkSession, bundles: str, version: str) -> str:
        return bundle.store(spark, bundles, version, self.KIND, {"column": self.column, "levels": self.levels}, lambda folder: None)

    @classmethod
    def load(cls, spark: SparkSession, folder: str, m: dict) -> "HotCodes":
        return cls(m["column"], m["levels"])


bundle.KINDS |= {kind.KIND: kind for kind in (TargetEncoding, HotCodes)}
