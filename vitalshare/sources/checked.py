"""CSV lines of any charset, each kept or rejected with a reason; none is lost or mended.

A file's charset is named by a folder above it (``charset=windows-1252/a.csv``), as partition
folders name a year; files below no such folder have the first of the charsets allowed. All files
are one scan: bytes are read as the 256 characters of ISO-8859-1, which loses nothing, and decoded
by column expressions, so any single-byte charset works whatever Spark's own readers accept.

A line is rejected because of its

    columns     it has more or fewer fields than the file's columns
    charset     its file names a charset that is not allowed
    bytes       some field holds bytes its charset does not have

Blank lines are no lines. A line ends at its line break, also within quotes. Empty fields are
NULL, as in the other readers. An empty folder gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalshare.sources.readers import text_schema

BYTES = "ISO-8859-1"
FILE, CHARSET, REASON, LINE = "_file", "_charset", "_reason", "_line"


def _upper_half(charset: str) -> list[str | None]:
    """What bytes 128 to 255 of a single-byte charset stand for; None where it has nothing."""
    whole = bytes(range(256)).decode(charset, "replace")
    if len(whole) != 256 or whole[:128] != bytes(range(128)).decode("ascii"):
        raise ValueError(f"{charset} is neither UTF-8 nor a single-byte extension of ASCII")
    return [None if x == "�" else x for x in whole[128:]]


def _is_utf8(charset: str) -> bool:
    return charset.lower().replace("-", "").replace("_", "") == "utf8"


def _as_utf8(column: Column) -> Column:
    return F.encode(column, BYTES).cast("string")


def _sound(column: Column, charset: str) -> Column:
    """Does the charset have all bytes of the field? NULL fields are sound."""
    if _is_utf8(charset):
        return F.coalesce(F.is_valid_utf8(_as_utf8(column)), F.lit(True))
    missing = [f"\\x{i:02x}" for i, x in enumerate(_upper_half(charset), 128) if x is None]
    if not missing:
        return F.lit(True)
    return F.coalesce(~column.rlike(f"[{''.join(missing)}]"), F.lit(True))


def _decoded(column: Column, charset: str) -> Column:
    if _is_utf8(charset):
        return _as_utf8(column)
    pairs = [(chr(i), x) for i, x in enumerate(_upper_half(charset), 128) if x is not None]
    return F.translate(column, "".join(x for x, _ in pairs), "".join(x for _, x in pairs))


def _by_charset(charsets: tuple[str, ...], each) -> Column:
    """The expression of the line's charset; NULL for one that is not allowed."""
    named = F.lower(F.col(CHARSET))
    return reduce(lambda out, x: out.when(named == x.lower(), each(x)), charsets[1:],
                  F.when(named == charsets[0].lower(), each(charsets[0])))


def read_checked(
    spark: SparkSession, path, names, charsets=("UTF-8",), sep: str = ",", header: bool = True
) -> DataFrame:
    """All lines of the files below ``path``: the columns ``names`` as text, the file, its charset,
    the reason if the line is rejected (then its columns are NULL) and the rejected line, a
    character a byte."""
    names, charsets = list(names), tuple(charsets)
    clash = {FILE, CHARSET, REASON, LINE} & set(names)
    if clash or len(set(names)) != len(names):
        raise ValueError(f"column names {names} repeat or clash with {FILE, CHARSET, REASON, LINE}")
    raw = (
        spark.read.schema(text_schema(*names, LINE))
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", LINE)
        # a line's fields are counted only where all of them are parsed
        .option("columnPruning", False)
        .option("recursiveFileLookup", True)
        .csv(path, sep=sep, header=header, encoding=BYTES)
    )
    fields = [F.col(f"`{x}`") for x in names]
    folder = F.regexp_extract("_metadata.file_path", "/charset=([^/]+)/", 1)
    rows = raw.select(
        *fields, LINE, F.col("_metadata.file_path").alias(FILE),
        F.when(folder == "", charsets[0]).otherwise(folder).alias(CHARSET),
    )
    sound = _by_charset(charsets, lambda x: reduce(Column.__and__, [_sound(f, x) for f in fields]))
    reason = (
        F.when(F.col(LINE).isNotNull(), "columns").when(sound.isNull(), "charset").when(~sound, "bytes")
    )
    rows = rows.withColumn(REASON, reason)
    good = F.col(REASON).isNull()
    joined = F.concat_ws(sep, *[F.coalesce(f, F.lit("")) for f in fields])
    return rows.select(
        *[F.when(good, _by_charset(charsets, lambda x, f=f: _decoded(f, x))).alias(n)
          for f, n in zip(fields, names)],
        FILE, CHARSET, REASON,
        F.when(~good, F.coalesce(LINE, joined)).alias(LINE),
    )


def kept(lines: DataFrame) -> DataFrame:
    return lines.where(F.col(REASON).isNull()).drop(FILE, CHARSET, REASON, LINE)


def rejected(lines: DataFrame) -> DataFrame:
    return lines.where(F.col(REASON).isNotNull()).select(FILE, CHARSET, REASON, LINE)
