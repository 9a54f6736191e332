"""From documents to token ids: stages that each call one operator of ``veilframe.llm``.

No stage relies on ids being unique.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veilframe.llm import common
from veilframe.llm.byte_bpe import encode
from veilframe.llm.decontaminate import without_contaminated
from veilframe.llm.language import UNKNOWN, held_out, identify
from veilframe.llm.near_duplicates import one_of_each
from veilframe.llm.secrets import without_secrets

SHINGLE, PERCENT = 5, 80


def _columns(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns]


def _plain(docs: DataFrame) -> DataFrame:
    """The columns under names that clash with nothing, and the text."""
    return docs.select(*[c.alias(f"c{i}__") for i, c in enumerate(_columns(docs))], F.col("text").cast("string").alias("text"))


def _named_again(docs: DataFrame, but: tuple[str, ...] = ()) -> list[Column]:
    return [F.col(f"c{i}__").alias(c) for i, c in enumerate(docs.columns) if c not in but]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is learned from the table itself; others, and those without a letter, go."""
    plain = _plain(docs)
    found = identify(plain, docs.where(~held_out("doc_id", 5, 0)).select("doc_id", "text", "lang"), tuple(plain.columns[:-1]), spread=True)
    return found.where((F.col("lang_pred") != UNKNOWN) & F.col("fits")).select(*_named_again(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return one_of_each(docs, PERCENT, SHINGLE)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with a benchmark item."""
    return without_contaminated(docs, common.read(spark, sf_dir, "benchmark", "item_id", "text"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a secret."""
    return without_secrets(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text; columns of these names are replaced."""
    # the text goes to the tasks once and comes back decoded; a hash tells whether it is the same
    at = docs.columns.index("text")
    plain = _plain(docs).drop(f"c{at}__").withColumns({"hash__": F.xxhash64(F.coalesce("text", F.lit(""))), "null__": F.col("text").isNull()})
    coded = encode(plain, keep=tuple(c for c in plain.columns if c != "text"))
    text = F.col("decoded").cast("string")
    coded = coded.withColumns({f"c{at}__": F.when(~F.col("null__"), text), "intact": F.xxhash64(text) == F.col("hash__")})
    return coded.select(*_named_again(docs, ("ids", "n_tokens", "intact")), "ids",
                        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "intact")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("byte_bpe", byte_bpe)]
ORACLE_SQL = None         # languages and tokens have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.stage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
