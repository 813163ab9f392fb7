"""A corpus pipeline over `documents`: toxicity, line dedup, near-dedup, decontamination, packing.

Each stage works on all that the one before kept and is written as Parquet.  The first four return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voidscan.llm.frames import tables
from voidscan.plans.stage import release, settled

#: Pieces that the last stage cuts depend on the order of a task's rows, and a network judges the first: SQL can't express the rows.
ORACLE_SQL = None


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the other columns as one: none of them clashes with what an operator adds."""
    from pyspark.sql import functions as F

    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", *([F.struct(*rest).alias("__rest")] if rest else []))


def _unpacked(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again, in their order."""
    from pyspark.sql import functions as F

    return found.select(*[F.col(c) if c in ("doc_id", "text") else F.col("__rest").getField(c).alias(c) for c in docs.columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, trained on the labelled ones outside fold 0, doesn't reject.

    Null, empty and wordless texts stay, repeated rows are judged each, and an empty table stays empty.  Columns beside doc_id and text pass
    through unread, whatever their names.
    """
    from voidscan.llm.language import fold_of
    from voidscan.llm.toxicity import fit, score

    model = fit(docs, tables(spark, sf_dir, "labels").where(fold_of("doc_id", 5) != 0))
    return _unpacked(score(_packed(docs), model).where("toxic = 0"), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the long lines that another of at least five keeps; n_chars follows the text.

    A null text becomes the empty text of no lines; rows of one id are one document for the counts, and each is returned; every row stays.
    """
    from pyspark.sql import functions as F

    from voidscan.llm import line_dedup as op

    out = _unpacked(op.line_dedup(_packed(docs)), docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies by five-word shingles: that of the smallest id.

    Documents without words are no copies and stay; rows of one id that are copies of each other stay both, a null id too.
    """
    from voidscan.llm import near_dedup as op

    return _unpacked(op.near_dedup(_packed(docs), k=5, percent=80).where("kept"), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none; each row is judged alone; an empty benchmark keeps all.
    """
    from voidscan.llm.decontaminate import decontaminate

    return _unpacked(decontaminate(_packed(docs), tables(spark, sf_dir, "benchmark")), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence of at most 2048 tokens, with its ids.

    A null or empty text is the one id that ends a document; rows of one id are documents of their own.
    """
    from public_tokenizers import path

    from voidscan.llm.packing import pack

    return pack(docs, path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage returns is written in the shared folder and read by the next.

    The tables that a stage wrote on its way, and its input, are deleted when its result stands.
    """
    docs = tables(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, settled(spark, lambda: stage(spark, docs, sf_dir))  # noqa: B023
        if name != STAGES[0][0]:
            release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
