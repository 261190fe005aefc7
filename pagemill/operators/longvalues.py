"""Values stored out of their row, as chunks with offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: what a checksum starts from.
CHECKSUM_SEED = 0x89ABCDEF


def split(df: DataFrame, key: str, value: str, size: int) -> DataFrame:
    """(key, chunk_no, chunk_offset, chunk) of every value, in chunks of `size` characters or bytes."""
    n = F.ceil(F.length(value) / size).cast("int")
    at = F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")))
    return df.select(key, value, at.alias("chunk_no")).select(key, "chunk_no", (F.col("chunk_no") * size).alias("chunk_offset"), F.substring(value, F.col("chunk_no") * size + 1, F.lit(size)).alias("chunk"))


def expected_span(key: str, offset: str, size: str) -> Column:
    """The bytes a chunk stands for: up to the next chunk's offset, or to the value's size."""
    return F.coalesce(F.lead(offset).over(Window.partitionBy(key).orderBy(offset)), F.col(size)) - F.col(offset)


def assemble(chunks: DataFrame, key: str = "key", offset: str = "chunk_offset", chunk: str = "chunk") -> DataFrame:
    """(key, value) with the chunks of each key joined in order of offset; text or binary as the chunks are."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(offset, chunk))), lambda x: x[chunk])
    if chunks.schema[chunk].dataType.typeName() == "binary":
        value = F.unhex(F.array_join(F.transform(ordered, F.hex), ""))
    else:
        value = F.array_join(ordered, "")
    return chunks.groupBy(key).agg(value.alias("value"))


def xor_checksum(words: Column) -> Column:
    """An aggregate: 32-bit words folded by exclusive or into the seed."""
    return F.bit_xor(words).bitwiseXOR(F.lit(CHECKSUM_SEED))
