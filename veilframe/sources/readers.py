"""Delimited text as all-string tables."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veilframe import fixed_values as V
from veilframe.session import stage

UTF8, ARABIC_CODE_PAGE = "UTF-8", "windows-1256"
# the upper half of the code page; read as Latin-1, byte b arrives as character b
_LATIN = bytes(range(128, 256)).decode("latin-1")
_ARABIC = bytes(range(128, 256)).decode("cp1256")


def from_code_page(c: Column) -> Column:
    """Text read as Latin-1 that was written in the Arabic code page."""
    return F.translate(c, _LATIN, _ARABIC)


def to_code_page(c: Column) -> Column:
    """Text that, written as Latin-1, is in the Arabic code page."""
    return F.translate(c, _ARABIC, _LATIN)


def _read(spark: SparkSession, path, encoding: str, missing_words: bool, multi_line: bool) -> DataFrame:
    arabic = encoding == ARABIC_CODE_PAGE
    df = (spark.read.option("header", True).option("encoding", "ISO-8859-1" if arabic else encoding)
          .option("escape", '"').option("multiLine", multi_line)
          .option("enforceSchema", False).option("mode", "FAILFAST").csv(path))
    cells = {c: F.col(f"`{c}`") for c in df.columns}
    if arabic:
        table = str.maketrans(_LATIN, _ARABIC)
        cells = {c.translate(table): from_code_page(cell) for c, cell in cells.items()}
    if missing_words:
        cells = {c: F.when(~cell.isin(V.MISSING_WORDS), cell) for c, cell in cells.items()}
    return df.select(*[cell.alias(c) for c, cell in cells.items()])


def read_csv(spark: SparkSession, path, encoding: str = UTF8, missing_words: bool = True,
             multi_line: bool | None = None) -> DataFrame:
    """Header gives the names, every column is text, so leading zeros and long numbers stay.

    Empty cells and the usual words for a missing value become null.  Quoted cells
    may hold line ends: files with a line that opens a quote without closing it are
    read whole, all others are split, which one pass over the lines tells;
    ``multi_line`` says it for all files and saves the pass.  Files whose headers
    differ are brought together by name, and lack nothing but null in columns that
    are not theirs.  A row with more or fewer cells than its header fails the read.
    """
    if multi_line is not None:
        return _read(spark, path, encoding, missing_words, multi_line)
    return _read_groups(spark, path, audit_files(spark, path).withColumn("encoding", F.lit(encoding)), missing_words)


def _read_groups(spark: SparkSession, path, audit: DataFrame, missing_words: bool = True) -> DataFrame:
    """Files of one encoding, header and way of reading are one read; paths are named only where there is more than one."""
    audit = stage(audit, "csv-audit")
    groups = audit.groupBy("encoding", "header", "quoted").agg(F.min("path").alias("first")).orderBy("first").collect()
    if len(groups) < 2:
        return _read(spark, path, groups[0]["encoding"] if groups else UTF8, missing_words, bool(groups and groups[0]["quoted"]))
    result = None
    for g in groups:
        own = audit.where((F.col("encoding") == g["encoding"]) & (F.col("header") == g["header"]) & (F.col("quoted") == g["quoted"]))
        part = _read(spark, [r["path"] for r in own.select("path").orderBy("path").toLocalIterator()], g["encoding"], missing_words, g["quoted"])
        result = part if result is None else result.unionByName(part, allowMissingColumns=True)
    return result


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table as it lies."""
    return spark.read.parquet(path)


def audit_files(spark: SparkSession, path) -> DataFrame:
    """(path, bytes, is_utf8, quoted, header) of every file with a line in it.

    ``quoted`` tells whether a quoted cell may go on in the next line, ``header`` is a
    hash of the first line.  Lines are looked at where they are read, so a large file
    is split like any other, and counted in buffers of fixed width; line ends are the
    same byte in all encodings.
    """
    value, place = F.col("value"), F.col("_metadata.file_block_start")
    quotes = F.octet_length(value) - F.octet_length(F.replace(value, F.lit('"'), F.lit("")))
    first = F.xxhash64(F.regexp_replace(value, "^\ufeff|\r$", ""))
    # the rows of a file's first block are numbered in one task: the least number and its hash, side by side
    numbered = F.when(place == 0, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).cast("decimal(38,0)") * F.lit(str(1 << 64)).cast("decimal(20,0)")
                      + (first.cast("decimal(38,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")))
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"),
                                         F.call_function("is_valid_utf8", value).alias("is_utf8"), (quotes % 2 == 1).alias("odd"), numbered.cast("decimal(38,0)").alias("numbered"))
    files = lines.groupBy("path").agg(F.max("size").alias("bytes"), F.bool_and("is_utf8").alias("is_utf8"), F.bool_or("odd").alias("quoted"), F.min("numbered").alias("numbered"))
    return files.select("path", "bytes", "is_utf8", "quoted", (F.col("numbered") % F.lit(str(1 << 64)).cast("decimal(20,0)")).cast("decimal(20,0)").alias("header"))


def audit_encodings(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, encoding) of every file in a folder: UTF-8 where the bytes are, else the Arabic code page."""
    return _with_encoding(audit_files(spark, folder)).select("path", "bytes", "encoding")


def _with_encoding(audit: DataFrame) -> DataFrame:
    return audit.withColumn("encoding", F.when(F.col("is_utf8"), UTF8).otherwise(ARABIC_CODE_PAGE))


def read_csv_folder(spark: SparkSession, folder: str, missing_words: bool = True) -> DataFrame:
    """All files of a folder, each in the encoding its bytes call for, brought together by the names in their headers."""
    return _read_groups(spark, folder, _with_encoding(audit_files(spark, folder)), missing_words)
