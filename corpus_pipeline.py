"""The training-data pipeline over ``documents``: quality, near-duplicates, repeats, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents, further ones as they came, whatever their names. An empty table gives an
empty one at every stage; repeated rows and rows without a doc_id are rows like others unless a
stage says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from treeloom.llm.common import Staged, stage, staging, table

#: What stages have staged: whose it is, and the files that its documents were read from.
_EARLIER: list[tuple[str, frozenset[str], Staged]] = []


def _freeing(step: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Releases what the stage before it staged, whose rows have been written and are read again by now.

    Nothing goes while ``docs`` still reads from any of it, as when stages are chained without
    writing, nor what the same stage made, or another from the same documents: such results may be
    wanted yet.
    """

    @wraps(step)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = frozenset(docs.inputFiles())
        chained = any(x.path.split(":", 1)[-1].strip("/") in f for _, _, x in _EARLIER for f in read)
        over = lambda name, files, _: read and not chained and name != step.__name__ and files != read
        kept = []
        for x in _EARLIER:
            if over(*x):
                x[2].release()
            else:
                kept.append(x)
        with staging() as held:
            out = step(spark, docs, sf_dir)
        _EARLIER[:] = [*kept, *((step.__name__, read, x) for x in held)]
        return out

    return run


@_freeing
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts, and all of under 50 words, fail the base rules."""
    from treeloom.llm.quality import keep_good

    return keep_good(docs)


@_freeing
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of least doc_id, of each group of texts whose five-word shingles are similar by 0.8 or more.

    Texts without words are one group; of rows alike in doc_id and text one stays; rows without a doc_id all stay.
    """
    from treeloom.llm.simhash import keep_first

    return keep_first(docs)


@_freeing
def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that earlier ones hold; n_chars is counted again.

    Null texts stay null, and a text of which nothing is left stays as an empty one. Rows without a doc_id are left whole.
    """
    from treeloom.llm.suffix import remove_repeats

    return remove_repeats(docs)


@_freeing
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none, one or two times. Null and empty texts are taken no time."""
    from treeloom.llm.mixing import mixed_rows

    return mixed_rows(docs)


@_freeing
def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each row of the mix; null and empty texts have no tokens."""
    import public_tokenizers

    from treeloom.llm.pieces import encode_documents, load_model

    return encode_documents(docs, load_model(public_tokenizers.path("piece_bpe_32k.model")), digest=True)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("mixture", mixture), ("encoding", encoding)]

#: Passages, the cube's draws and pieces can't be expressed in SQL; the tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, step in STAGES[:-1]:
        made = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            before.release()
        docs, before = made.df, made
    return STAGES[-1][1](spark, docs, sf_dir)
