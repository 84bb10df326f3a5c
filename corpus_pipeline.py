"""A corpus made ready for training: documents go through five operators of heronry.llm, each on all that the one before kept.

Each stage takes (spark, docs, sf_dir), docs with the columns of documents, and returns a DataFrame with them; the last adds `ids`.
Rows with a null id or text are never rejected: what can't be judged stays. Further columns go along untouched, whatever their names. An
empty table goes through all stages empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heronry.llm import decontaminate, lines, pieces, queries, shared, similar, toxicity


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic, by a field fitted and calibrated on those of the labelled documents that docs holds.

    Null and empty texts stay; a repeated row is judged as its like. Of equally good thresholds the least is taken. Without labels all stay.
    """
    return toxicity.clean(docs, queries.table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of two lines and more that stand before; a document of nothing else goes.

    Before is by id, nulls last, then by a hash of the text, then by place. A repeated row, id and text alike, keeps what its like keeps. Null
    and empty texts, and texts of one line, stay as they are.
    """
    return lines.deduped(docs, passages=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least id, of each group that similar pairs connect.

    Null ids and texts, and texts without a word, stay. Of a repeated row one stays, of texts that share the least id the one of least hash.
    """
    return similar.deduped(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found. Null and empty texts stay, ids are not looked at, a repeated row is judged as its like."""
    return decontaminate.clean(docs, queries.table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their pieces, and the text that these give again. A null text stays null, an empty one has no piece, a repeated row comes again."""
    return pieces.recoded(docs, queries.pieces_path())


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("sentencepiece", encode_pieces),
]

#: A field that is fitted can't be put in SQL; tests/llm holds the pipeline against a version stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = shared.written(docs, name)
    return docs
