"""Epoch key-value store as a Spark data source, one partition per epoch.

The store is reached through a client object, so any key-value service can sit behind it:
``bitmap(epoch)`` returns packed bits or null, ``block(epoch, id)`` the bytes or null, and
``latest()`` the highest epoch. ``client`` names a factory as ``module:function``.
"""

from __future__ import annotations

import importlib

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def as_bytes(value) -> bytes:
    """Bytes of the forms a store may hand out."""
    if value is None:
        return b""
    if isinstance(value, (bytes, bytearray, memoryview)):
        return bytes(value)
    if isinstance(value, list):
        return bytes(int(x) for x in value)
    inner = getattr(value, "value", None)
    if inner is None:
        raise TypeError(f"unsupported binary value {type(value).__name__}")
    return as_bytes(inner)


def epoch_number(raw) -> int:
    """Big-endian counter, -1 when absent."""
    data = as_bytes(raw)
    return int.from_bytes(data, "big") if data else -1


class EpochPartition(InputPartition):
    def __init__(self, epoch: int):
        super().__init__(epoch)
        self.epoch = epoch


class EpochReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def _client(self):
        module, _, name = self.options["client"].partition(":")
        return getattr(importlib.import_module(module), name)(self.options)

    def partitions(self):
        end = int(self.options.get("end", "0")) or self._client().latest()
        return [EpochPartition(e) for e in range(int(self.options.get("start", "1")), end + 1)]

    def read(self, partition):
        client = self._client()
        packed = as_bytes(client.bitmap(partition.epoch))
        for block_id in np.flatnonzero(np.unpackbits(np.frombuffer(packed, np.uint8))):
            value = client.block(partition.epoch, int(block_id))
            # A flagged block without an item keeps its bit and a null value.
            yield (int(block_id), None if value is None else as_bytes(value), partition.epoch)


class EpochStore(DataSource):
    @classmethod
    def name(cls):
        return "epochstore"

    def schema(self):
        return "id bigint, block binary, epoch int"

    def reader(self, schema):
        return EpochReader(self.options)


def read_store(spark, client: str, start: int = 1, end: int = 0, **options):
    """Mutations of a store, including flagged blocks whose item is missing (null block)."""
    spark.dataSource.register(EpochStore)
    return (
        spark.read.format("epochstore").option("client", client).option("start", start)
        .option("end", end).options(**options).load()
    )
