"""Placement by a permutation-filled lookup table, in DataFrame functions only.

Each shard has a preference order over the slots of a prime-sized table: a start and a step worked out
from its name. The shards take turns claiming their first slot still free until the table is full, so
every shard owns nearly as many slots as any other, and adding or removing one moves few slots. The
table is a constant of two bytes a slot (128 KB for 65,537 slots, whatever the corpus); a key's slot is
its hash modulo the table's size, and the shard is read from the constant in constant time.

Defined results: a null key is placed like the key "" and a key's place depends on nothing else.
Repeated keys go to the same shard; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import spare

SLOTS = 65537
SHARDS = tuple(f"shard-{i:04d}" for i in range(64))


def _number(name: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:15], 16)


def lookup_table(names: Sequence[str] = SHARDS, slots: int = SLOTS) -> list[int]:
    """The shard that owns each slot; slots must be prime and not fewer than the shards (fewer than 65,536)."""
    if not 0 < len(names) <= min(slots, 65535) or any(slots % i == 0 for i in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime number not below the number of shards")
    next_slot = [_number(n, "start") % slots for n in names]
    step = [_number(n, "step") % (slots - 1) + 1 if slots > 1 else 1 for n in names]
    owner = [-1] * slots
    free = slots
    while free:
        for shard in range(len(names)):
            at = next_slot[shard]
            while owner[at] >= 0:
                at = (at + step[shard]) % slots
            owner[at], next_slot[shard] = shard, (at + step[shard]) % slots
            free -= 1
            if not free:
                break
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % slots


def shard_of(slot: Column, table: Sequence[int]) -> Column:
    packed = F.lit(bytearray(b"".join(x.to_bytes(2, "big") for x in table)))
    pair = F.substr(packed, (slot * 2 + 1).cast("int"), F.lit(2))
    return F.conv(F.hex(pair), 16, 10).cast("long")


def place(df: DataFrame, key: str = "doc_id", names: Sequence[str] = SHARDS, slots: int = SLOTS, slot_name: str = "slot", shard_name: str = "shard") -> DataFrame:
    """df with each row's slot and shard number; columns of those names are replaced. Narrow: no shuffle, no join."""
    df = df.withColumn(slot_name, slot_of(F.col(key), slots))
    return df.withColumn(shard_name, shard_of(F.col(slot_name), lookup_table(names, slots)))


def write_shards(df: DataFrame, path: str, key: str = "doc_id", names: Sequence[str] = SHARDS, slots: int = SLOTS, split: int = 8) -> None:
    """Writes one folder a shard, shard=N (shard_=N where df has a column shard). A shard is split over several writers by slot, so none holds it whole."""
    slot, shard = spare(df.columns, "slot"), spare(df.columns, "shard")
    placed = place(df, key, names, slots, slot, shard)
    placed.repartition(F.col(shard), F.col(slot) % split).drop(slot).write.partitionBy(shard).parquet(path)
