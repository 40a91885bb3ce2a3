"""The queries over a user's own tables: the same verbs on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom import lexicon
from lexloom.plans import dialect, registry, tables
from lexloom.sources import files


class Engine:
    """Runs any named query on tables that are given as DataFrames; the lexicon's tables can be replaced too, and so can
    those of the ledger, proposals, verdicts, amendments, provenance and imports (``tables.GIVEN`` after the plans are read).

    ``documents`` needs doc_id and text; queries that read lang, source or n_chars need those as well.
    """

    def __init__(self, spark: SparkSession, documents: DataFrame | None = None, **given: DataFrame) -> None:
        unknown = set(given) - set(lexicon.TABLES) - tables.GIVEN - {"benchmark", "labels", "pages", "conversations", "events"}
        if unknown:
            raise files.ContractError(f"unknown tables: {', '.join(sorted(unknown))}")
        self.spark, self.dialect = spark, dialect.Spark(spark, "", tables.SPARK)
        self.dialect.frames.update(given)
        if documents is not None:
            self.dialect.frames["documents"] = documents

    def table(self, name: str) -> DataFrame:
        """A table of the plan, such as events, tokens, seg_lang or canonical."""
        if name not in self.dialect.frames and name not in tables.SPARK:
            raise files.ContractError(f"no table {name}")
        return self.dialect.frame(name)

    def run(self, name: str) -> DataFrame:
        return self.spark.sql(registry.QUERIES[name](self.dialect))

    def normalize(self) -> DataFrame:
        """One record for each segment: what was found, the language, the canonical text, tokens and status."""
        event = F.struct("s", "e", "key", "mode", "concept_id", "lang", "owners")
        found = self.table("events").groupBy("doc_id", "seg_no").agg(F.array_sort(F.collect_list(event)).alias("match_events"))
        out = self.table("segments").withColumn("end", (F.col("seg_start") + F.length("line")).cast("long")).withColumnRenamed("seg_start", "start")
        for part in (found, self.table("seg_lang").select("doc_id", "seg_no", "language"), self.table("canonical"), self.run("p_tokens"), self.run("p_text_expanded"), self.run("p_status")):
            out = out.join(part, ["doc_id", "seg_no"], "left")
        review = F.coalesce(F.col("status") == "review", F.lit(False))
        return out.withColumn("original", F.col("line")).withColumn("canonical_text", F.coalesce("canonical_text", "line")).withColumn("needs_review", review).drop("line")

    def index(self, path: str) -> None:
        """Records as JSON lines and one line of text for each segment, in order of documents."""
        files.write_jsonl(self.normalize(), f"{path}/index", ["doc_id", "seg_no"])
        self.run("s_rg_index").orderBy("doc_id", "seg_no").select("entry").write.text(f"{path}/rg")

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """item_id, doc_id, rank: the first documents by fielded BM25 for queries (item_id, text)."""
        self.dialect.frames["benchmark"] = queries
        return self.dialect.frame("fielded").where(F.col("rank") <= k).select("item_id", "doc_id", "rank", "score")

    def export(self, what: str, path: str) -> None:
        """skos, synonyms or manifest as lines of text."""
        name = {"skos": "s_skos", "synonyms": "s_synonyms", "manifest": "s_manifest"}[what]
        table = self.run(name)
        table.select(F.concat_ws("\t", *table.columns).alias("value")).orderBy("value").coalesce(1).write.text(path)

    def violations(self) -> DataFrame:
        """Broken rules of the lexicon, none if it is sound."""
        return self.run("i_registry").where("n > 0")
