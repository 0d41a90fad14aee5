"""Wordlists as DataFrames: one row per word, and the long table of morphemes that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns that hold space-separated sounds, and those that hold space-separated ids.
SOUND_COLUMNS, ID_COLUMNS, NUMBER_COLUMNS = ("tokens", "alignment", "structure", "morphemes", "segments", "patterns"), ("cogids", "crossids"), ("id", "cogid", "crossid")


def _typed(df: DataFrame) -> DataFrame:
    """Lower-case names; arrays and numbers by column name. Arrays stay as they are; blank cells become null."""
    out = []
    for field in df.schema.fields:
        name, cell = field.name.lower(), F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            cell = F.when(F.trim(cell) == "", None).otherwise(F.trim(cell))
            if name in SOUND_COLUMNS:
                cell = F.split(cell, r"\s+")
            elif name in ID_COLUMNS:
                cell = F.split(cell, r"\s+").cast("array<long>")
            elif name in NUMBER_COLUMNS:
                cell = cell.cast("long")
        elif name in NUMBER_COLUMNS:
            cell = cell.cast("long")
        out.append(cell.alias(name))
    return df.select(*out)


def read_wordlist(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated file with a header (any case) and no quoting; lines starting with # are skipped."""
    return _typed(spark.read.csv(path, sep="\t", header=True, quote="", comment="#"))


def wordlist_from_rows(spark: SparkSession, rows: dict[int, list]) -> DataFrame:
    """From {0: column names, id: cells}; cells may be strings, numbers or lists."""
    names = [str(c).lower() for c in rows[0]]
    fields = [T.StructField("id", T.LongType(), False)]
    for i, name in enumerate(names):
        cells = [r[i] for k, r in rows.items() if k]
        kind = T.StringType()
        if any(isinstance(c, (list, tuple)) for c in cells):
            kind = T.ArrayType(T.LongType() if name in ID_COLUMNS else T.StringType())
        elif all(isinstance(c, int) for c in cells):
            kind = T.LongType()
        fields.append(T.StructField(name, kind))
    data = [(k, *[list(c) if isinstance(c, tuple) else c for c in r]) for k, r in rows.items() if k]
    return _typed(spark.createDataFrame(data, T.StructType(fields)))


def load_wordlist(spark: SparkSession, source: str | dict[int, list] | DataFrame) -> DataFrame:
    """A wordlist from the path of a file, from rows, or as it is if it is a DataFrame; anything else is an error."""
    if isinstance(source, DataFrame):
        return source
    if isinstance(source, str):
        return read_wordlist(spark, source)
    if isinstance(source, dict):
        return wordlist_from_rows(spark, source)
    raise ValueError("a wordlist is a path, a dict of rows or a DataFrame")


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated with a header; arrays are joined by spaces."""
    cells = [F.array_join(F.col(f.name).cast("array<string>"), " ").alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in df.schema.fields]
    df.select(*cells).write.csv(path, sep="\t", header=True, quote="", escape="", emptyValue="", mode="overwrite")


def split_morphemes(sounds: Column, marks: tuple[str, ...] = ("+", "_")) -> Column:
    """Arrays of sounds between morpheme marks."""
    blank = F.expr("cast(array(array()) as array<array<string>>)")

    def step(parts: Column, sound: Column) -> Column:
        here = F.concat(F.element_at(parts, -1), F.array(sound))
        kept = F.slice(parts, 1, F.size(parts) - 1)
        return F.when(sound.isin(*marks), F.concat(parts, blank)).otherwise(F.concat(kept, F.array(here)))

    return F.aggregate(sounds, blank, step)


def morphemes(words: DataFrame, ref: str = "cogid", columns: tuple[str, ...] = ("tokens", "alignment", "structure")) -> DataFrame:
    """(id, m_idx, doculect, concept, cogid and the sound columns there are), one row per morpheme.

    A plain wordlist (ref is a number) has one morpheme a word. In a fuzzy one (ref is an array) sounds are parted at
    the morpheme marks; of a cogid that a word has twice, only the first morpheme counts.
    """
    there = [c for c in columns if c in words.columns]
    kept = [c for c in ("doculect", "concept") if c in words.columns]
    if not isinstance(words.schema[ref].dataType, T.ArrayType):
        return words.select("id", F.lit(0).alias("m_idx"), *kept, F.col(ref).cast("long").alias("cogid"), *there)
    parts = F.arrays_zip(F.col(ref).alias("cogid"), *[split_morphemes(F.col(c)).alias(c) for c in there])
    rows = words.select("id", *kept, F.posexplode(parts).alias("m_idx", "part")).where(F.col("part.cogid").isNotNull())
    rows = rows.withColumn("cogid", F.col("part.cogid"))
    first = rows.groupBy("id", "cogid").agg(F.min("m_idx").alias("m_idx"))
    return rows.join(first, ["id", "cogid", "m_idx"]).select("id", "m_idx", *kept, F.col("cogid").cast("long").alias("cogid"), *[F.col(f"part.{c}").alias(c) for c in there])


def doculects(words: DataFrame, column: str = "doculect") -> list[str]:
    """The doculects in alphabetical order: the order of the entries of every pattern.

    A wordlist has tens or hundreds of them; the list must fit one row of a table.
    """
    return [r[0] for r in words.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).collect()]
