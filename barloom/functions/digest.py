"""Digests of long ordered lists, exact and in constant memory."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

PACK = 4096


def ordered_digests(df: DataFrame, by: list[str], order: Column, text: Column, sep: str, opening: str = "", closing: str = "") -> DataFrame:
    """Per group: digest, the SHA-256 (hex) of opening, the texts in ascending `order` with `sep` between them, and closing; and n, their number.

    Rows are dealt by range of (group, order) and sorted where they lie, however unevenly they are spread over groups. Each sorted part
    is packed into rows of PACK texts, and a group's packs, in order, stream through its hash. So the sort is shared by all tasks, nothing is
    collected into one row, and the one task that a sequential hash needs holds a pack at a time. An empty table gives no rows.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(*by, order.alias("_order"), text.alias("_text")).repartitionByRange(width, *by, "_order").sortWithinPartitions(*by, "_order")
    rows = rows.select(*by, F.spark_partition_id().alias("_part"), "_text")
    keys = [df.schema[c] for c in by]
    packed = StructType([*keys, StructField("_part", IntegerType()), StructField("_at", LongType()), StructField("_n", LongType()), StructField("_text", StringType())])
    hashed = StructType([*keys, StructField("digest", StringType()), StructField("n", LongType())])
    pack_schema, hash_schema = to_arrow_schema(packed), to_arrow_schema(hashed)
    k = len(by)

    def batch(out: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, part, at = None, [], 0, 0
        for b in batches:
            for *now, part_now, value in zip(*[c.to_pylist() for c in b.columns]):
                if held and (now != key or len(held) == PACK):
                    yield batch([(*key, part, at, len(held), sep.join(held))], pack_schema)
                    held, at = [], at + 1
                key, part = now, part_now
                held.append(value)
        if held:
            yield batch([(*key, part, at, len(held), sep.join(held))], pack_schema)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h, n = None, None, 0
        for b in batches:
            for *now, _part, _at, count, value in zip(*[c.to_pylist() for c in b.columns]):
                if h is not None and now != key:
                    h.update(closing.encode())
                    yield batch([(*key, h.hexdigest(), n)], hash_schema)
                    h = None
                if h is None:
                    key, h, n = now, hashlib.sha256(opening.encode()), 0
                else:
                    h.update(sep.encode())
                h.update(value.encode())
                n += count
        if h is not None:
            h.update(closing.encode())
            yield batch([(*key, h.hexdigest(), n)], hash_schema)

    packs = rows.mapInArrow(pack, packed)
    packs = packs.repartition(width, *by) if k else packs.repartition(1)
    return packs.sortWithinPartitions(*by, "_part", "_at").mapInArrow(digest, hashed)
