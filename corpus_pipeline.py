"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the shared folder and
reads it again as the next stage's docs. All but the last return the columns of documents, whatever else these are called.

Stages decide by row: rows that share a doc_id, or have none, are documents of their own. They are told apart by a number of
the row, in the order of doc_id; rows without one come last, and rows that share one are ordered by their text's hash. So of
equal rows one is the first, and the stages that keep the first keep one. An empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braggframe.llm import lines, ngram_join, packing, quality
from braggframe.llm.common import WORD, collected, small, stored
from braggframe.llm.queries import CAPACITY, END_ID, references, vocabulary


class _Rows:
    """A stage's rows under private names, numbered, and the way back to the columns of docs."""

    def __init__(self, docs: DataFrame):
        self.columns = docs.columns
        self.names = [f"_c{i}" for i in range(len(docs.columns))]
        private = docs.toDF(*self.names)
        at = {c: F.col(n) for c, n in zip(self.columns, self.names, strict=True)}
        self.text, self.n_chars = self.names[self.columns.index("text")], self.names[self.columns.index("n_chars")]
        rows, ids = private.agg(F.count("*"), F.count_distinct(at["doc_id"])).first()
        if rows == ids:
            self.df = private.withColumn("_row", at["doc_id"].cast("long"))
        else:  # range-sorted and numbered once and for all: the numbers are stored
            order = [at["doc_id"].asc_nulls_last(), F.xxhash64(at["text"]).asc()]
            self.df = stored(private.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id()), "pipeline-rows")

    def texts(self) -> DataFrame:
        return self.df.select(F.col("_row").alias("doc_id"), F.col(self.text).alias("text"))

    def back(self, df: DataFrame) -> DataFrame:
        return df.select(*self.names).toDF(*self.columns)

    def only(self, rows: DataFrame) -> DataFrame:
        """The rows numbered in rows (_row)."""
        return self.back(self.df.join(small(stored(rows, "pipeline-kept"), 16), "_row", "left_semi"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the base rules and the divergence rules keep.

    A null, empty or wordless text fails the base rules and goes, as does any of fewer than 50 words. Each of several equal rows
    is judged, all alike. A very long text is judged whole.
    """
    rows = _Rows(docs)
    return rows.only(quality.judged(rows.texts(), ["doc_id"], references=references(spark, sf_dir)).where("kept").select(F.col("doc_id").alias("_row")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without their repeated lines; n_chars follows the text of those that lose one.

    A row that loses a line and is left without a word goes; one that has no word to begin with (null, empty) stays as it is.
    Of equal rows the first alone keeps its lines, so the others go. Very long texts are read line by line in one task each.
    """
    rows = _Rows(docs)
    kind = rows.df.schema[rows.n_chars].dataType
    private = rows.df.withColumnsRenamed({rows.text: "text", "_row": "doc_id"})
    kept = lines.deduped_lines(private).where((F.col("n_dropped") == 0) | F.col("text").rlike(WORD))
    length = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col(rows.n_chars)).cast(kind)
    return rows.back(kept.withColumn(rows.n_chars, length).withColumnRenamed("text", rows.text))


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, the first, of each group that links of shingle Jaccard 0.75 or more connect.

    Null, empty and wordless texts link with nothing and stay. Equal rows link, whatever their doc_id. A very long text is
    shingled whole.
    """
    rows = _Rows(docs)
    groups = ngram_join.ngram_groups(rows.texts())
    return rows.only(groups.where("doc_id = component_id").select(F.col("doc_id").alias("_row")))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the rows' token ids, packed into sequences of at most 1024: the columns of packing.best_fit.

    A null or empty text is the end id alone; equal rows are packed each; a long text is cut into full pieces but its first.
    """
    return packing.best_fit(docs, vocabulary("byte_bpe_50k.json"), CAPACITY, END_ID)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("ngram_join", ngram_join_stage), ("best_fit_packing", best_fit_packing)]

#: Token ids of a byte-level BPE can't be had in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        collected(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
