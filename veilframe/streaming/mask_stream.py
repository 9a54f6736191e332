"""Scan and mask text as it arrives.

Treatments that look at one row (masks, suppression, salted hashes, stateless
fakes, dates, addresses) run on a stream as they do on a table.  Bands and merged
categories need figures over a whole table: decide them on a batch first and pass
the treatments in.  Numbered replacement goes batch by batch through a book of
pseudonyms, which later tables and streams can go on with.
"""

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from veilframe.functions.text import named
from veilframe.operators.book import PseudonymBook
from veilframe.operators.corpus import corpus_findings, mask_text
from veilframe.operators.treat import HASH_LENGTH, needs_numbers
from veilframe.plans.anonymize import Treatment, apply_treatments, as_text, numbered_columns
from veilframe.plans.profiles import PROFILES


def masked_stream(stream: DataFrame, text: str, strength: str = "medium") -> DataFrame:
    return mask_text(stream, text, strength)


def findings_stream(stream: DataFrame, key: str, text: str) -> DataFrame:
    return corpus_findings(stream, key, text)


def treated_stream(stream: DataFrame, treatments: list[Treatment], profile: str, salt: str, row_key: str) -> DataFrame:
    """Apply treatments decided on an earlier batch to the rows of a stream."""
    chosen = PROFILES[profile]
    for t in treatments:
        if t.method == "Replacement" and needs_numbers(t.entity, chosen.format_preserving):
            raise ValueError(f"{t.column}: numbered replacement needs a book of pseudonyms; use write_treated")
    treated = apply_treatments(stream, treatments, chosen, salt, row_key)
    return treated.select(named(row_key), *[named(t.column) for t in treatments])


def write_treated(stream: DataFrame, treatments: list[Treatment], profile: str, salt: str, row_key: str, book: PseudonymBook,
                  path: str, checkpoint: str, name: str = "stream", hash_length: int = HASH_LENGTH) -> DataStreamWriter:
    """Writer that treats each batch of a stream, numbered replacements through ``book``, and stops when all is taken.

    A batch makes one entry in the book, named after the stream and the batch, and one
    folder of the result; both are made once however often a batch is tried.
    """
    chosen = PROFILES[profile]
    numbered = numbered_columns(treatments, chosen)
    shown = [named(row_key), *[named(t.column) for t in treatments]]

    def treat(batch: DataFrame, number: int) -> None:
        rows = as_text(batch, treatments, row_key)
        if numbered:
            book.extend(rows, row_key, numbered, f"{name}-{number:012d}")
        apply_treatments(rows, treatments, chosen, salt, row_key, hash_length=hash_length, book=book).select(*shown) \
            .write.mode("overwrite").parquet(f"{path}/batch={number}")
    return stream.writeStream.foreachBatch(treat).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def write_available(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Writer that takes what has arrived, writes Parquet exactly once, and stops."""
    return (stream.writeStream.format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True))
