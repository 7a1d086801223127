"""The corpus pipeline: toxicity, near-duplicates, repeated substrings, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the columns of documents; the last one
returns the packed pieces. Each result is written to the shared folder and read back as the next stage's input.

All stages: null and empty texts are documents like any other (toxicity keeps them, near-duplicates hold them for copies
of each other, so one stays); texts of any length are read whole; a null id is an id like any other; rows are judged
one by one, whatever ids they share; an empty table gives an empty one; further columns, whatever their names, are carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import mixing, packing, simhash, substrings, toxicity
from lodestone.llm._common import Workspace, packed, table

#: What the near-duplicate stage works on: shingles of five words, linked at a similarity of 4/5 or more.
NEAR_WORDS, NEAR_SIMILARITY = 5, (4, 5)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted label is 1 go; repeated ids share one prediction per row."""
    labels = table(spark, sf_dir, "labels")
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels.filter(~toxicity.held_out(F.col("doc_id")))))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates (SimHash candidates, verified by their shingles) one row stays, that of the smallest id; a null id comes last, and of rows that share the id the first in the scan stays."""
    ws = Workspace(spark, "near")
    rows = ws.keep("numbered", docs.select(packed(docs).alias("doc"), F.monotonically_increasing_id().alias("row")))
    found = simhash.similar(rows.select("row", "doc.text"), row_col="row", width=NEAR_WORDS, similarity=NEAR_SIMILARITY).join(rows.select("row", "doc.doc_id"), "row")
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("gone"), "doc_id", "row")).alias("first")).select("first.row")
    gone = ws.keep("gone", found.select("row").join(first, "row", "left_anti"))
    return rows.join(simhash.sent_if_few(gone), "row", "left_anti").select("doc.*")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go; a character that loses some of its bytes goes as a whole. Documents left empty stay, as empty texts."""
    return substrings.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weighted by the square root of their size; a document appears as often as it is drawn."""
    return mixing.mix(docs).select(*(F.col(f"`{c}`") for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return packing.pack_documents(docs, P.path("byte_bpe_50k.json"), ranks=P.path("byte_bpe_50k.tiktoken"), pattern=P.PATTERN)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", one_of_each_group), ("repeated_substrings", cut_repeats), ("mixing", mix_sources), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws, docs = Workspace(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = ws.keep(name, stage(spark, docs, sf_dir))
    return ws.keep(STAGES[-1][0], STAGES[-1][1](spark, docs, sf_dir))
