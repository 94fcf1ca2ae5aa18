"""Pairs of vectors at or above a cosine within equality blocks, exactly.

Every pair of a block is compared as a matrix product in single precision with some slack, and
what may pass is computed again in double precision. A block with more than ``PART`` vectors is
cut into parts that meet pairwise, so no task holds more than two parts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART = 16_384
ROWS = 512
SLACK = 1e-4


def _compare(least: float, block: list[str], rest: list[str], names: list[str], k: int | None = None):
    def compare(table: pa.Table) -> pa.Table:
        # rows delivered twice have the same part, so they are all here
        _, once = np.unique(table.column("id").to_numpy(), return_index=True)
        table = table.take(pa.array(once))
        x = table.column("embedding").combine_chunks().flatten().to_numpy().reshape(len(table), -1).astype(np.float64)
        norms = np.sqrt(np.einsum("ij,ij->i", x, x))
        unit = (x / norms[:, None]).astype(np.float32)
        asks, stored = (np.nonzero(table.column(c).to_numpy(zero_copy_only=False))[0] for c in ("_asks", "_stored"))
        held = unit[stored].T
        left, right = [], []
        for start in range(0, len(asks), ROWS):
            some = asks[start : start + ROWS]
            sims = unit[some] @ held
            floor = np.float32(least - SLACK)
            if k is not None and sims.shape[1] > k + 1:  # one more, as a record may meet itself
                floor = np.maximum(floor, -np.partition(-sims, k, axis=1)[:, k : k + 1] - np.float32(SLACK))
            row, col = np.nonzero(sims >= floor)
            a, b = some[row], stored[col]
            left.append(a[a != b])
            right.append(b[a != b])
        a, b = (np.concatenate(z) if z else np.empty(0, np.int64) for z in (left, right))
        sim = np.empty(len(a))
        for start in range(0, len(a), 65_536):
            i, j = a[start : start + 65_536], b[start : start + 65_536]
            sim[start : start + 65_536] = np.einsum("ij,ij->i", x[i], x[j]) / (norms[i] * norms[j])
        sim = np.round(sim, 12)
        good = sim >= least
        a, b = pa.array(a[good]), pa.array(b[good])
        columns = [table.column(c).take(a) for c in block] + [table.column(c).take(a) for c in rest] + [table.column(c).take(b) for c in rest] + [pa.array(sim[good])]
        return pa.table(columns, names=names)

    return compare


def near_top(records: DataFrame, block: list[str], k: int, asks: str = "true", part: int = PART) -> DataFrame:
    """``*block, a_<column>, b_<column>, sim, pos``: the k records of its block that are most similar to each record that asks.

    Every part gives the k nearest of its own and those that are as near within the slack; ties go by id.
    """
    found = near_pairs(records, block, -2.0, asks, part, k)
    order = Window.partitionBy("a_id").orderBy(F.desc("sim"), "b_id")
    return found.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= k)


def near_pairs(records: DataFrame, block: list[str], least: float, asks: str = "true", part: int = PART, k: int | None = None) -> DataFrame:
    """``*block, a_<column>, b_<column>, sim``: for each record that satisfies ``asks`` all others of its block that are near.

    ``records`` has ``id``, ``embedding`` (usable, of one length in a block), the block's columns and whatever
    else is to come along. A pair of two records that both ask comes in both directions. Records with a null in
    a block column meet nothing.
    """
    rest = [c for c in records.columns if c not in (*block, "embedding")]
    rows = records.dropna(subset=block).withColumn("_asks", F.coalesce(F.expr(asks), F.lit(False)))
    # rows delivered twice count twice here, which only makes parts smaller; at most one row for every ``part`` vectors
    sizes = rows.groupBy(*block).agg(F.ceil(F.count("*") / part).cast("int").alias("_parts"), F.greatest(F.lit(1), F.ceil(F.count_if("_asks") / part)).cast("int").alias("_from_parts")).where("_parts > 1")
    placed = rows.join(F.broadcast(sizes), block, "left").fillna(1, ["_parts", "_from_parts"])
    placed = placed.withColumn("_part", F.expr("CAST(pmod(xxhash64(id), _parts) AS INT)")).withColumn("_from", F.expr("CAST(pmod(xxhash64(id), _from_parts) AS INT)"))
    # stored in one part for each part of those that ask, and compared with every part where it asks itself
    visits = placed.withColumn("_at", F.explode(F.expr("""array_union(transform(sequence(0, _from_parts - 1), f -> struct(f AS f, _part AS p)),
        CASE WHEN _asks THEN transform(sequence(0, _parts - 1), p -> struct(_from AS f, p AS p)) ELSE array() END)""")))
    visits = visits.select(*block, *rest, "embedding", F.expr("_asks AND _at.f = _from").alias("_asks"), F.expr("_at.p = _part").alias("_stored"), F.col("_at.f").alias("_f"), F.col("_at.p").alias("_p"))
    fields = [T.StructField(c, records.schema[c].dataType) for c in block]
    fields += [T.StructField(f"{side}_{c}", records.schema[c].dataType) for side in "ab" for c in rest]
    schema = T.StructType([*fields, T.StructField("sim", T.DoubleType())])
    return visits.groupBy(*block, "_f", "_p").applyInArrow(_compare(least, block, rest, schema.names, k), schema)
