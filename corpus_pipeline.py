"""A corpus from raw documents to token files, stage by stage.

Each stage gets what the stage before kept.  Toxic documents go, one document
of each class of near-copies stays, contaminated documents go, the sources are
mixed to their target weights, and the mix is written as token ids.  The
result has one row for each document of the mix, read back from the files; a
document that the mix has twice has two rows.

Defined results: a null text counts as an empty one in every stage; rows
without a doc_id take part like others; an empty table stays empty, as do all
stages behind one that keeps nothing; further columns go along unchanged,
whatever their names are, up to the last stage.  The stages' docstrings say
what happens to rows that repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import decontaminate, mixing, simhash, tokens, toxicity
from cairn.llm.common import aside, release, table, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the operator's threshold.

    Rows that repeat are judged one by one, equal texts alike; an empty text
    has the score of the model's bias.
    """
    model = toxicity.trained_on(spark, docs, table(spark, sf_dir, "labels"))
    own, restored = aside(docs, "score")
    scored = toxicity.scored(own, model)
    return restored(scored.where(scored["score"] < toxicity.THRESHOLD))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of linked SimHash fingerprints: of the smallest doc_id.

    Of rows of that doc_id, or of none, the one with the least fingerprint,
    text digest and other columns stays.  Empty texts are one class.
    """
    return simhash.deduplicate(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words fewer than one in twenty lies in a benchmark window.

    Rows that repeat are judged one by one; a text without words stays.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed_by_source(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as weighted fair queueing takes them: not at all, once or twice.

    Rows of one doc_id, source and text are taken as often as all of them,
    each time with the least other columns.  A null source is one of its own.
    """
    return mixing.mixed(docs)


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str, output: str | None = None) -> DataFrame:
    """What the token files say of each document; the files stay if ``output`` names a new folder for them.

    Rows that repeat are written as often as they come; an empty text is the
    end id alone.
    """
    return tokens.read_shards(tokens.write_shards(docs, tokens.vocabulary(), output=output))


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_copies),
    ("decontamination", without_benchmark),
    ("mixing", mixed_by_source),
    ("tokens", as_tokens),
]

#: Learned scores, hashes and merges have no SQL form; tests/llm/test_llm_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, output: str | None = None) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next; token files stay in ``output``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir, output)
