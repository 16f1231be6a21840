"""The corpus pipeline: each stage reads, as a Parquet table, what the one before kept.

Nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns of any
name are as each stage's operator defines them: documents without a letter go at the first
stage; of documents alike the smallest doc_id stays, and of equal rows one; documents are read
whole, and those of a null source are mixed as a source of their own. Columns other than text
and n_chars pass as they are, and an empty table gives an empty table.
"""

from __future__ import annotations

from quillon.llm import decontamination, language_id, mixing, near_duplicates as near, secret_scan
from quillon.llm.common import scratch, table
from quillon.storage import fresh_path, remove


def language(spark, docs, sf_dir):
    """Documents that language identification rejects go."""
    return language_id.recognised(docs)


def near_duplicates(spark, docs, sf_dir):
    """One document of each group stays: those that op4_simhash links, or of five-word similarity 0.8 or more."""
    return near.deduplicated(docs)


def benchmark(spark, docs, sf_dir):
    """Documents contaminated by a benchmark item go."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark, docs, sf_dir):
    """All documents stay; secret values are replaced in their texts."""
    return secret_scan.scan(docs, redact=True)


def mixture(spark, docs, sf_dir):
    """Each document as often as the mix of sources takes it."""
    return mixing.mix(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("secrets", secrets),
    ("mixture", mixture),
]

#: A classifier, fingerprints and a lexer are beyond SQL; the tests hold the rows against
#: a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows that all stages leave of documents.

    A stage's folder goes when the next one has been written, its checkpoints when it has been
    itself, and all of them if a stage fails; the last folder, which the result is read from,
    when the process ends.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        try:
            with scratch():
                stage(spark, docs, sf_dir).write.parquet(path)
        except BaseException:
            remove(path)
            raise
        finally:
            if before:
                remove(before)
        docs, before = spark.read.parquet(path), path
    return docs
