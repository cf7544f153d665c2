"""The corpus pipeline: language ID, line dedup, near-dedup, mixing and packing of documents.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; run() writes each result as Parquet in the shared
folder and reads it back as the next stage's docs. Every stage but the last returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofact.llm.columns import aside
from chronofact.llm.language import held_out, predict, train
from chronofact.llm.line_dedup import run_dedup
from chronofact.llm.mixing import mix
from chronofact.llm.near_dedup import near_dedup
from chronofact.llm.packing import pack
from chronofact.session import ROW, discard, keyed, materialize, passing, table

#: A text of which less is known (``language.known_share``) is in no learned language. See the README for what lies on each side.
LEAST_KNOWN = 0.7


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; those without a letter, or whose n-grams are not those of the learned languages, go.

    Null and empty texts have no letter. Repeated rows and null ids stay as often as they come (null ids are not learned
    from); columns of any other name are kept as they are; an empty table, or one without a labelled row, gives none.
    """
    known = docs.where("doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).select("text", "lang")
    held, back = aside(docs, "doc_id", "text")
    return back(predict(held, train(known), with_known=True).where((F.col("lang_pred") != "und") & (F.col("lang_known") >= LEAST_KNOWN)))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of runs of two lines or more; a document of which nothing remains goes.

    Rows equal in id and text are one document here and all stay, for near_stage; null ids come first; null and empty
    texts stay; columns of any other name are kept, n_chars being counted anew; an empty table gives none.
    """
    held, back = aside(docs, "doc_id", "text", "n_chars")
    cut = run_dedup(held).where((F.col("removed_lines") == 0) | (F.trim("text") != ""))
    return back(cut.withColumns({"n_chars": F.length("text").cast("long")} if "n_chars" in docs.columns else {}))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group, the one of smallest id, null ids last; of equal ids any one row.

    Repeated rows are copies, so one stays; null and empty texts are no copies of anything and all stay; columns of any
    other name are kept; an empty table gives none.
    """
    held, back = aside(docs, "doc_id", "text")
    rows = keyed(held)
    found = near_dedup(rows, id_col=ROW).select(F.col(ROW).alias("_row"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    named = rows.select(F.col(ROW).alias("_own"), "doc_id").join(found, F.col("_own") == F.col("_row"))
    stay = named.groupBy("component_id").agg(F.min(order).alias("first")).select(F.col("first._row").alias("_row"))
    return back(rows.join(stay, F.col(ROW) == F.col("_row"), "left_semi"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    Every row is counted by itself, whatever its id; texts without words weigh nothing and may come or not; columns of
    any other name are kept; an empty table gives none.
    """
    return mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: a row for each piece, with its ids.

    Every row is packed by itself, whatever its id; null and empty texts are one closing id; other columns are left out;
    an empty table gives none.
    """
    return pack(docs)


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL cannot express the classifier and the tokenizer; tests hold the pipeline against plain Python on a fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's own tables go when its result is written, and that when the next one's is."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = docs
        with passing(spark) as keep:
            docs = keep(materialize(stage(spark, before, sf_dir), name))
        discard(before)
    return docs
