"""From raw documents to token files: score, drop near duplicates, drop benchmark leaks, mix, encode.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
kept; ``run`` writes every stage's rows to the shared folder and reads them
again, so a lost executor never reaches back past one stage.

In all stages null and blank texts are empty, texts of any length are taken
whole, an empty table stays empty, and other columns, whatever their names,
are carried along and never looked at.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm.common import load, shared_dir, stored
from tallyforge.llm.decontaminate import without_leaks
from tallyforge.llm.mixing import mixed_rows
from tallyforge.llm.near_dedup import without_near_duplicates
from tallyforge.llm.quality import without_rejected
from tallyforge.llm.tokens import read_tokens, write_tokens

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: Text encoded at once and runs of letters kept in a worker: less than ``write_tokens`` takes, as executors come here with their heaps full.
TOKEN_CHUNK, TOKEN_MEMO = 512 << 10, 50_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score under 0.3) go.

    Empty texts and rows without an id are scored like any other; repeated
    rows get one score; null labels are left out. Without two training rows in
    either class every row has the share of label 1 as its score, 0.5 without any.
    """
    return without_rejected(docs, load(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8 or more) the smallest id stays.

    Texts without words are linked with nothing and stay, as do rows without
    an id. Rows repeated with one id are one document, of which the row with
    the least text stays.
    """
    return without_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go.

    Texts without words hold none; repeated rows go or stay together; items
    without words are left out, and an empty benchmark leaves every row.
    """
    return without_leaks(docs, load(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document comes as often as the mix takes it.

    A null source is one of its own; a source without words gives nothing.
    Ties in size go by id, nulls last, then by text; rows repeated with one id,
    source and text share their copies evenly.
    """
    return mixed_rows(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the shared folder, read back: doc_id, start, n_tokens, token_ids.

    Ascending by id, nulls last, rows of one id by a hash of their text; an
    empty text is the end id alone. Other columns are not written.
    """
    path = f"{shared_dir(spark)}/pipeline-tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, public_tokenizers.path(TOKENIZER), END_ID, chunk=TOKEN_CHUNK, memo=TOKEN_MEMO)
    return read_tokens(spark, path)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mixing", mixture), ("token_ids", token_files)]

#: No SQL: the classifier's factors and the tokenizer are out of its reach. Tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``: the rows of ``token_files``. No documents give no rows."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
