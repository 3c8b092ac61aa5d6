"""Bit filters of bounded size: which rows may be wanted, told in place, so that other rows' texts are never shuffled."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.text import lean

#: Least and most bits of a filter.
BITS = (1 << 20, 1 << 26)


@dataclass
class BitFilter:
    """A row that is wanted passes always, another seldom; where a filter of the greatest size fills up, more of them pass."""

    size: int
    table: Broadcast

    def slot(self, *key: Column | str) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(self.size))

    def passing(self, rows: DataFrame, *key: Column | str, negate: bool = False) -> DataFrame:
        """The rows whose key may be wanted, or, negated, those whose key is not."""
        table, fields = self.table, rows.schema

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.column(batch.num_columns - 1).to_numpy().astype(np.uint64)
                keep = ((table.value[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)
                yield batch.select(range(batch.num_columns - 1)).filter(pa.array(~keep if negate else keep))

        return rows.select("*", self.slot(*key).alias("_slot_of_filter")).mapInArrow(lean(run), fields)


def bit_filter(wanted: DataFrame, *key: Column | str) -> BitFilter:
    """The filter of the keys of all rows wanted; only its words come to the driver."""
    size = min(max(BITS[0], 1 << int(16 * wanted.count()).bit_length()), BITS[1])
    slots = wanted.select(F.pmod(F.xxhash64(*key), F.lit(size)).alias("s"))
    words = slots.groupBy(F.shiftright("s", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(s % 64 as int)))").alias("b")).toArrow()
    bits = np.zeros(size // 64, np.uint64)
    bits[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return BitFilter(size, wanted.sparkSession.sparkContext.broadcast(bits))
