"""Filling containers of fixed capacity with texts, by reciprocal size classes.

An item of size s belongs to class k = capacity // s: k items of the class fit into one container. Items are spread by
hash over slots of bounded size, and each slot is packed by itself, so the work has no shared state and no group grows
with the data. By the method as named (``leftovers=False``) every class is packed by itself, on its own worker, each of
its containers closed when it holds its k items. That leaves up to half of a container of the first class unused, so by
default a slot's classes are filled one after the other, from the largest items to the smallest, and an item first takes
the tightest space that an earlier class has left over; ``p9_fill`` has the shares of both.

A text is cut only if it alone exceeds the capacity: into full containers and one item for the rest. Texts without
tokens (NULL, empty) take no space and go into the first container of their slot, so every text comes out.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOT_ITEMS = 20_000  # container numbers within a slot take 24 bits, slots 22 and classes 17 of an id


def pack_class(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item of one class: capacity // size items to a container, whatever space that leaves."""
    if not len(sizes) or sizes.max() == 0:
        return np.zeros(len(sizes), np.int64)
    order = np.argsort(-sizes, kind="stable")
    into = np.empty(len(sizes), np.int64)
    into[order] = np.arange(len(sizes)) // (capacity // int(sizes.max()))
    return into


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item; sizes in 0..capacity, in an order that decides ties."""
    into = np.zeros(len(sizes), np.int64)
    order = np.argsort(-sizes, kind="stable")
    room: list[tuple[int, int]] = []  # (space left, container), of closed containers
    opened = 0
    k = count = space = current = 0
    for i in order.tolist():
        size = int(sizes[i])
        if size == 0:
            break  # zeros are last and stay in container 0
        if capacity // size != k:  # the next class
            if count:
                insort(room, (space, current))
            k, count = capacity // size, 0
        at = bisect_left(room, (size, -1))
        if at < len(room):
            left, number = room.pop(at)
            into[i] = number
            if left > size:
                insort(room, (left - size, number))
            continue
        if count == 0:
            current, space, opened = opened, capacity, opened + 1
        into[i] = current
        space -= size
        count += 1
        if count == k:
            if space:
                insort(room, (space, current))
            count = 0
    return into


def fill(items: DataFrame, containers: list[tuple[str, int]], key: str = "doc_id", size: str = "n_tokens", slots: int | None = None, leftovers: bool = True) -> DataFrame:
    """(container_type, container_id, key, piece, first_token, n_tokens) for every item and container type.

    containers  (type, capacity) of a table of fixed size
    leftovers   whether items may take the space that earlier classes of their slot left; else classes are independent
    """
    if slots is None:
        slots = max(1, -(-items.count() // SLOT_ITEMS))
    kind = items.schema[key].dataType.simpleString()
    types = F.explode(F.array(*[F.struct(F.lit(t).alias("container_type"), F.lit(c).cast("long").alias("capacity")) for t, c in containers]))
    each = items.select(F.col(key).alias("_key"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_size"), types.alias("_c")).select("_key", "_size", "_c.*")
    pieces = each.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.expr("(_size - 1) div capacity")))).alias("piece"))
    pieces = pieces.select("container_type", "capacity", "_key", "piece", (F.col("piece") * F.col("capacity")).alias("first_token"), F.least("capacity", F.col("_size") - F.col("piece") * F.col("capacity")).alias("n_tokens"), F.pmod(F.xxhash64("_key", "piece"), F.lit(slots)).cast("int").alias("_slot"))
    # containers of a class are told apart by the class, which is at most the capacity
    pieces = pieces.withColumn("_class", F.when(F.col("n_tokens") == 0, 0).otherwise(F.expr("capacity div greatest(n_tokens, 1)")) if not leftovers else F.lit(0).cast("long"))

    def one_slot(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_key", "piece"], kind="stable")
        number = (pack if leftovers else pack_class)(pdf["n_tokens"].to_numpy(), int(pdf["capacity"].iloc[0]))
        pdf["container_id"] = (pdf["_class"].to_numpy().astype(np.int64) << 46) + (pdf["_slot"].to_numpy().astype(np.int64) << 24) + number
        return pdf[["container_type", "container_id", "_key", "piece", "first_token", "n_tokens"]]

    placed = pieces.groupBy("container_type", "_class", "_slot").applyInPandas(one_slot, f"container_type string, container_id long, _key {kind}, piece long, first_token long, n_tokens long")
    return placed.withColumnRenamed("_key", key)
