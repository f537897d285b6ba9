"""One object for a person who only wants results: import genotypes, score, read results, export."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pgsloom.operators import finalize, match, report, results, score
from pgsloom.sources import consumer, tables
from pgsloom.sources.store import ResultStore


def open_dna(spark: SparkSession, root: str, individual_id: str) -> DataFrame:
    """Merged genotypes of a person if there are any, else the measured ones; an error if there are none."""
    for name in ("unified", "genotyped"):
        try:
            return spark.read.parquet(f"{root}/{name}/individual_id={individual_id}").withColumn("individual_id", F.lit(individual_id))
        except AnalysisException:
            continue
    raise FileNotFoundError(f"no genotypes of {individual_id} in {root}")


class Engine:
    """Packs, catalog, genotypes and results below one folder, all of it Parquet.

    All people and traits that are asked for are scored in one plan; there is no loop over either. Results are merged by
    key into what is stored: those of other people stay, and a call that finds nothing new changes nothing.
    """

    #: What names a row of each table of results.
    KEYS = {"pgs_results": ["individual_id", "trait_id", "pgs_id"], "trait_results": ["individual_id", "trait_id"]}

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def store(self, name: str) -> ResultStore:
        """A table of results, in parts by trait; ``calculated_at`` says when a row last changed."""
        return ResultStore(self.spark, f"{self.root}/{name}", self.KEYS[name], "trait_id", "calculated_at")

    def _read(self, name: str) -> DataFrame:
        return self.store(name).read() if name in self.KEYS else self.spark.read.parquet(f"{self.root}/{name}")

    def _write(self, rows: DataFrame, name: str, by: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(f"{self.root}/{name}")

    def import_dna(self, path: str, individual_id: str) -> DataFrame:
        """Read a vendor's file of any known kind and store its measured calls."""
        kind = consumer.vendor(self.spark, path)
        if kind == "vcf":
            rows = consumer.read_vcf(self.spark, path).withColumn("g", F.split(F.col("value"), "[/|]"))
            allele = lambda i: F.when(F.get("g", F.lit(i)) == "1", F.col("alt")).when(F.get("g", F.lit(i)) == "0", F.col("ref"))
            calls = rows.select(F.lit("").alias("rsid"), F.col("chr").cast("string").alias("chromosome"), F.col("pos").alias("position"), allele(0).alias("allele1"), allele(1).alias("allele2")).dropna()
        else:
            calls = consumer.read_json(self.spark, path) if path.endswith(".json") else consumer.read_text(self.spark, path)
        stored = consumer.unified(calls, individual_id)
        self._write(stored, "genotyped", "individual_id")
        return stored

    def genotypes(self, people: list[str] | None = None) -> DataFrame:
        """Numeric genotypes of people, or of all: merged calls, and measured ones of those who have no merged calls."""

        def of(name: str) -> DataFrame | None:
            try:
                rows = self._read(name)
            except AnalysisException:
                return None
            rows = rows.withColumn("individual_id", F.col("individual_id").cast("string"))
            return rows if people is None else rows.filter(F.col("individual_id").isin(people))

        merged, measured = of("unified"), of("genotyped")
        if merged is None and measured is None:
            raise FileNotFoundError(f"no genotypes in {self.root}")
        parts = [match.load_dna(x) for x in (merged, measured) if x is not None]
        if len(parts) == 2:
            parts[1] = parts[1].join(merged.select("individual_id").distinct(), "individual_id", "left_anti")
            return parts[0].unionByName(parts[1], allowMissingColumns=True)
        return parts[0]

    def calculate(self, people: list[str] | None = None, traits: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        """Results of scores and of traits, merged into what is stored; ``None`` means all that there are."""
        dna = self.genotypes(people)
        chosen = self._read("trait_pgs")
        if traits is not None:
            chosen = chosen.filter(F.col("trait_id").isin(traits))
        pack = self._read("pack").join(chosen.select("pgs_id").distinct(), "pgs_id", "left_semi")
        done = finalize.pgs_results(score.pgs_aggregate(match.variant_match(pack, dna)), score.pgs_totals(pack), self._read("pgs_scores"), finalize.best_r2(self._read("pgs_performance")), chosen, dna)
        self.store("pgs_results").merge(done)
        # from what is stored: the scores of this call's people and traits, all others stay as they are
        now = self._read("pgs_results").join(chosen.select("trait_id").distinct(), "trait_id", "left_semi").join(dna.select("individual_id").distinct(), "individual_id", "left_semi")
        self.store("trait_results").merge(finalize.trait_results(now, self._read("traits")))
        return self._read("pgs_results"), self._read("trait_results")

    def forget(self, people: list[str]) -> None:
        """Delete the results of people."""
        gone = self.spark.createDataFrame([(p,) for p in people], "individual_id string")
        for name in self.KEYS:
            self.store(name).delete(gone)

    def pending(self) -> DataFrame:
        """What is still to be calculated."""
        store = self.store("trait_results")
        done = store.read().select(*store.keys) if store.exists() else self.spark.createDataFrame([], "individual_id string, trait_id string")
        return results.skip_existing(self._read("genotyped"), self._read("traits"), done)

    def traits(self) -> DataFrame:
        return self._read("traits")

    def scores(self) -> DataFrame:
        """The registered scores of each trait with their norms."""
        return self._read("trait_pgs").join(self._read("pgs_scores"), "pgs_id", "left")

    def categories(self) -> DataFrame:
        return report.category_list(self.traits())

    def dashboard(self, individual_id: str, **choice: str) -> DataFrame:
        """Traits that fit the choice, with a person's results where there are any."""
        store = self.store("trait_results")
        own = store.read() if store.exists() else self.spark.createDataFrame([], "individual_id string, trait_id string, overall_percentile double")
        return report.dashboard(self.traits(), own.filter(F.col("individual_id") == individual_id), **choice)

    def top_variants(self, individual_id: str, trait_id: str, k: int = 20) -> DataFrame:
        """The largest contributions of the best scores of a trait."""
        own = self._read("pgs_results").filter((F.col("individual_id") == individual_id) & (F.col("trait_id") == trait_id))
        pack = self._read("pack").join(finalize.top_pgs(own).select("pgs_id"), "pgs_id", "left_semi")
        return score.top_variants(match.variant_match(pack, open_dna(self.spark, self.root, individual_id)), k)

    def summary(self) -> DataFrame:
        return report.results_summary(self._read("trait_results"), self.traits(), self._read("pgs_results"))

    def export(self, path: str) -> int:
        """Write all trait results elsewhere and return how many there are."""
        self._read("trait_results").write.mode("overwrite").parquet(path)
        return tables.validate(self.spark, path)
