"""Exact deduplication against a persistent index of text digests, in DataFrame expressions only.

The index is a Parquet table, bucketed and sorted by digest.  New texts are grouped
by digest first, so copies never meet; the groups are then joined to the index by a
sort-merge anti-join, for which only the groups are shuffled, and what the index does
not hold yet is appended.  A digest may get a second entry when a longer original
arrives later; the best entry of a digest stands.  Adding the same rows again changes
nothing, so a run that was lost halfway is simply repeated.

Two texts are equal when they are identical without white space; the digest is the
SHA-256 of what is left.
"""

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veilframe import session
from veilframe.llm import common

SPACE = r"[\x20\x09-\x0D]+"
LAST = (1 << 63) - 1                    # stands for a null id, which comes after all others
ARRIVALS = 2                            # the query feeds the index in so many steps


class DigestIndex:
    """An index in the folder ``path``; one that exists there is opened, with the buckets that it has.

    New indexes get ``buckets`` buckets, by default as many as the session shuffles
    into: while the two agree, an anti-join leaves the index where it is.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/buckets-*")
        held = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
        if held is not None and len(held):
            buckets = int(held[0].getPath().getName().removeprefix("buckets-"))
        self.spark, self.path, self.buckets = spark, path, buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.table = f"digest_index_{hashlib.sha256(path.encode()).hexdigest()[:24]}"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.table} (digest binary, chars bigint, doc bigint) USING parquet CLUSTERED BY (digest) SORTED BY (digest) "
                  f"INTO {self.buckets} BUCKETS LOCATION {self._quoted(f'{path}/buckets-{self.buckets}')}")

    @staticmethod
    def _quoted(text: str) -> str:
        return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def entries(self) -> DataFrame:
        return self.spark.table(self.table)

    def unknown(self, groups: DataFrame) -> DataFrame:
        """Those of (digest, chars, doc), one row for each digest, that no entry equals or beats."""
        held = self.entries().withColumnsRenamed({"digest": "held", "chars": "held_chars", "doc": "held_doc"})
        as_good = (F.col("held_chars") > F.col("chars")) | ((F.col("held_chars") == F.col("chars")) & (F.col("held_doc") <= F.col("doc")))
        return groups.join(held.hint("merge"), (F.col("digest") == F.col("held")) & as_good, "left_anti")

    def add(self, groups: DataFrame) -> None:
        """Append what is unknown; each bucket's rows are in one task, which sorts them by digest."""
        self.unknown(groups.select("digest", "chars", "doc")).write.insertInto(self.table)

    def standing(self) -> DataFrame:
        """The entry that stands for each digest; read bucket by bucket, without a shuffle."""
        best = self.entries().groupBy("digest").agg(F.min(F.struct((-F.col("chars")).alias("less"), "doc")).alias("best"))
        return best.select("digest", (-F.col("best.less")).alias("chars"), F.col("best.doc").alias("doc"))

    def close(self) -> None:
        """Forget the table's name in this session; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.regexp_replace(text, SPACE, ""), 256))


def _groups(rows: DataFrame) -> DataFrame:
    """One row for each digest: how many rows have it, and the best of them."""
    found = rows.groupBy("digest").agg(F.count("*").alias("size"), F.min(F.struct((-F.col("chars")).alias("less"), "doc", "uid")).alias("best"))
    return found.select("digest", "size", (-F.col("best.less")).alias("chars"), F.col("best.doc").alias("doc"), F.col("best.uid").alias("uid"))


def deduplicate(docs: DataFrame, index: DigestIndex, arrivals: int = 1) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row; the index then holds its texts.

    Of equal texts the row with the most code points stays, then the one with the
    smallest ``doc_id`` (an integer; null comes last and gives a null ``keep_id``),
    rows that are alike in both by an arbitrary choice.  Entries that the index had
    before take part in this choice, ``group_size`` counts the rows of ``docs``.
    Null texts are empty, texts of white space equal them.  Texts of any length are
    read whole; other columns of ``docs`` are not used.  The rows can be fed in
    several ``arrivals``, which gives the same result.
    """
    kind = dict(docs.dtypes)["doc_id"]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = common.with_row_id(docs.select("doc_id", "text")).select(
        "uid", "doc_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("doc"), F.char_length(text).cast("bigint").alias("chars"), _digest(text).alias("digest"))
    rows = common.stage(rows, "digests")
    groups = common.stage(_groups(rows), "digest-groups")
    for i in range(arrivals):
        index.add(groups if arrivals == 1 else _groups(rows.where(F.pmod(F.xxhash64("uid"), F.lit(arrivals)) == i)))
    standing = index.standing().withColumnsRenamed({"chars": "keep_chars", "doc": "keep_doc"})
    own = (F.col("chars") == F.col("keep_chars")) & (F.col("doc") == F.col("keep_doc"))
    answers = groups.join(standing.hint("merge"), "digest").select("digest", F.col("size").alias("group_size"), "keep_doc", F.when(own, F.col("uid")).alias("keep_uid"))
    out = common.join_spread(rows.select("uid", "doc_id", "digest"), common.stage(answers, "digest-answers"), "digest", "group_size")
    return out.select("doc_id", F.when(F.col("keep_doc") != LAST, F.col("keep_doc")).cast(kind).alias("keep_id"), "group_size",
                      F.col("uid").eqNullSafe(F.col("keep_uid")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts among all documents, through an index that starts empty and takes them in two arrivals."""
    index = DigestIndex(spark, common.new_path(spark, "digest-index"))
    out = deduplicate(common.read(spark, sf_dir, "documents", "doc_id", "text"), index, ARRIVALS)
    index.close()
    return out


OP13_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
n as (select doc_id, length(t) as n, sha256(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as text_sha256 from d),
g as (select text_sha256, count(*) as group_size, first(doc_id order by n desc, doc_id) as keep_id from n group by text_sha256)
select doc_id, keep_id, cast(group_size as bigint) as group_size, doc_id = keep_id as kept, text_sha256 from n join g using (text_sha256)
"""
