"""Small helpers that the operators share."""
from __future__ import annotations

import re
import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: a word is a run of bytes other than ASCII white space (bytes.split() agrees)
WORD_GAP = r"[\x20\x09-\x0D]+"


_WORD = re.compile("[^ \t-\r]+")
_SEPARATORS = "\x1c\x1d\x1e\x1f"  # white space for str.split, signs for a tokenizer


def split_words(text: str) -> list[str]:
    """Cut at white space, Unicode's included: no piece of a word-wise tokenizer holds any."""
    return _WORD.findall(text) if any(c in text for c in _SEPARATORS) else text.split()


def byte_symbols() -> dict[int, str]:
    """The letter of each byte in a byte-level vocabulary: printable bytes stand
    for themselves, the others for the characters from U+0100 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that the driver and all executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives the
    loss of executors, and computes the rows once for several readers."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered_rows(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a number ``name`` for each row, written once. Numbers given
    while a table is read follow its splits, which depend on the cores then
    alive; a later scan after the loss of an executor could number otherwise."""
    return stored(df.withColumn(name, F.monotonically_increasing_id()), "numbered-rows", "zstd")


def mounted(path: str) -> str:
    """The file-system path of a shared folder that every machine mounts.

    Operators that memory-map files need such a folder; a store that only
    Spark can read is an error here, not a silent local copy.
    """
    if path.startswith("file:"):
        return unquote(re.sub(r"^file:/+", "/", path))
    if re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*:", path):
        raise ValueError(f"memory-mapped files need a mounted shared folder, not {path.split(':')[0]}:")
    return path


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer if ``df`` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def own_columns(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns]


def id_bucket(col: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod`` (a null id counts as '')."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def numbered(df: DataFrame, group: list[str], number: str, order: list[str], cells: int = 64) -> DataFrame:
    """Gapless numbers from 0 in each group, although one group may hold most
    rows: rows are numbered inside (group, cell), a cell being a hash of the
    ``order`` columns, and the cells' offsets come from their counts.
    """
    cell = F.pmod(F.xxhash64(*order), F.lit(cells)).cast("int")
    rows = df.withColumn("__cell", cell)
    by = ", ".join(f"`{g}`" for g in group)
    counts = rows.groupBy(*group, "__cell").agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.withColumn("__first", F.expr(
        f"sum(__n) over (partition by {by} order by __cell) - __n")).drop("__n")
    rank = F.expr(f"row_number() over (partition by {by}, __cell order by {', '.join(f'`{o}`' for o in order)}) - 1")
    keys = [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in group] + [F.col("a.__cell") == F.col("b.__cell")]
    on = keys[0]
    for k in keys[1:]:
        on = on & k
    out = rows.withColumn("__rank", rank).alias("a").join(offsets.alias("b"), on)
    return out.select(*[F.col(f"a.{c}") for c in df.columns],
                      (F.col("b.__first") + F.col("a.__rank")).cast("long").alias(number))
