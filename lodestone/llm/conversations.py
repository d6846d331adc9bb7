"""What the operators on conversations share: turns under fixed names, repeatable order, positions in blocks.

The columns of a table of turns are conv_id and turn (longs or null), role and text (strings or null); others are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import released, small_batches

#: Turn numbers of a block: rows of a long conversation are numbered block by block, the blocks by their sizes.
BLOCK_BITS = 10
BLOCK = 1 << BLOCK_BITS
#: Stands for the block of null turns, which come first.
NULL_BLOCK = -(1 << 63)


def turns(table: DataFrame, columns: tuple[str, str, str, str] = ("conv_id", "turn", "role", "text"), null: str = "") -> DataFrame:
    """conv_id, turn, role, text; a null role or text becomes ``null``."""
    small_batches(table.sparkSession)
    conv, turn, role, text = columns
    return table.select(F.col(conv).cast("bigint").alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), F.coalesce(F.col(role), F.lit(null)).alias("role"), F.coalesce(F.col(text), F.lit(null)).alias("text"))


def digest() -> Column:
    """SHA-256 of role and text together; the role's length keeps them apart. Rows of one turn stand in its order."""
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))


def fold(column: Column, n: int) -> Column:
    """The unsigned crc32 of a value as text, modulo ``n``."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(n))


def word_count(text: str = "text") -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def blocked(rows: DataFrame) -> DataFrame:
    """Adds column block: that of the turn's number."""
    return rows.withColumn("block", F.coalesce(F.shiftright("turn", BLOCK_BITS), F.lit(NULL_BLOCK)))


def offsets(rows: DataFrame) -> DataFrame:
    """For every (conv_id, block) of blocked ``rows``: before, the rows of earlier blocks, and total, those of all.

    Counts are summed before the shuffle; a window sees one row for each block, not for each turn.
    """
    sizes = rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("size"))
    each = Window.partitionBy("conv_id")
    before = F.sum("size").over(each.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    return sizes.select("conv_id", "block", F.coalesce(before, F.lit(0)).alias("before"), F.sum("size").over(each).alias("total"))


def by_group(run: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str, names: list[str], rows: int = 8192) -> Callable:
    """A function of Arrow batches that passes their rows, one after another, through a generator: a row at a time in memory."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    fields = to_arrow_schema(_parse_datatype_string(schema))

    def batched(batches):
        got, size = [], 0
        for row in run(x for b in batches for x in zip(*(b.column(n).to_pylist() for n in names), strict=True)):
            got.append(row)
            size += sum(len(x) for x in row if isinstance(x, (str, bytes)))
            if len(got) >= rows or size >= 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got, strict=True), fields, strict=True)], schema=fields)
                got, size = [], 0
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got, strict=True), fields, strict=True)], schema=fields)

    return released(batched)
