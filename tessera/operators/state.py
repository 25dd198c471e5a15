"""Digests of a training state held as a table of named arrays, and the gates of a hand-off and of an interval."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tessera.operators.verify import ZERO, blake, combined, link

#: The parts of a parameter in the order digests take them in, and how each is announced.
PARTS = {"weight": b"weight\0", "optim_step": b"optim_step\0", "exp_avg": b"optim_exp_avg\0", "exp_avg_sq": b"optim_exp_avg_sq\0", "max_exp_avg_sq": b"optim_max_exp_avg_sq\0", "grad": b"grad\0"}
#: Columns of a state: a part's bytes may come in chunks numbered from 0, the first of which names type and shape.
STATE = "shard int, name string, part string, chunk int, kind string, shape array<bigint>, data binary, step bigint"


def state_digests(state: DataFrame, head: bytes = b"", tail: bytes = b"", grads: bool = False) -> DataFrame:
    """(shard, digest): a digest of each shard's arrays (columns ``STATE``) in order of their names, between ``head`` and ``tail``.

    A shard is one running digest and so one task, which holds a chunk at a time. With
    ``grads`` a parameter without a gradient says so. Parts that repeat, are unknown, or come
    without their parameter's weight are an error. Shards without rows have no digest.
    """
    order = list(PARTS)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = name = last = h = None

        def ended() -> None:
            if h is not None and grads and last[0] != len(order) - 1:
                h.update(b"grad_none\0")

        for rows in batches:
            done = []
            for shard, own, part, chunk, kind, shape, data, step, place in rows.itertuples(index=False):
                if shard != at or own != name:
                    ended()
                    if shard != at:
                        if h is not None:
                            h.update(tail)
                            done.append((at, h.hexdigest()))
                        at, h = shard, hashlib.blake2b(head, digest_size=32)
                    name, last = own, (-1, 0)
                    h.update(own.encode() + b"\0")
                    if part != "weight":
                        raise ValueError(f"{own}: no weight before {part}")
                if (place, chunk) not in ((last[0], last[1] + 1), (place if place > last[0] else None, 0)):
                    raise ValueError(f"{own}: {part}, chunk {chunk} is repeated or out of place")
                last = (place, chunk)
                if part == "grad" and not grads:
                    continue
                if part == "optim_step":
                    h.update(PARTS[part] + int(step).to_bytes(8, "little", signed=True))
                    continue
                if chunk == 0:
                    h.update(PARTS[part] + kind.encode() + b"\0" + str(tuple(int(n) for n in shape)).encode() + b"\0")
                h.update(data)
            yield pd.DataFrame(done, columns=["shard", "digest"])
        if h is not None:
            ended()
            h.update(tail)
            yield pd.DataFrame([(at, h.hexdigest())], columns=["shard", "digest"])

    known = F.array_position(F.array(*[F.lit(p) for p in order]), F.col("part")) - 1
    place = F.when(known >= 0, known).otherwise(F.raise_error(F.concat(F.lit("unknown part: "), F.coalesce("part", F.lit("null")))).cast("bigint"))
    zero = F.lit(0)
    rows = state.select("shard", "name", "part", F.coalesce("chunk", zero).alias("chunk"), "kind", "shape", "data", F.coalesce("step", zero.cast("bigint")).alias("step"), place.cast("int").alias("place"))
    return rows.repartition("shard").sortWithinPartitions("shard", "name", "place", "chunk").mapInPandas(fold, "shard int, digest string")


def full_hash(state: DataFrame, before: str | None = None, param_groups: list | None = None, batch: bytes | None = None, grads: bool = False, label: bytes = b"state_hash.v2\n") -> DataFrame:
    """(shard, digest) of a whole state in one shard, whatever ranks hold it, after ``before``. ``label`` opens it."""
    prev = bytes.fromhex(before)[:32].ljust(32, b"\0") if before else ZERO
    if batch is not None and len(batch) != 32:
        raise ValueError("a batch digest has 32 bytes")
    tail = b"" if param_groups is None else b"param_groups\0" + json.dumps(param_groups, sort_keys=True).encode()
    tail += b"" if batch is None else b"batch_digest\0" + batch
    return state_digests(state.withColumn("shard", F.lit(0)), label + b"prev\0" + prev + b"params\0", tail, grads)


def over_ranks(shards: Sequence[bytes], ranks: int) -> bytes:
    """The digest over all ranks in their order, rank r holding shard r modulo their number; wrapped once even for one."""
    if not shards or ranks < 1 or any(len(d) != 32 for d in shards):
        raise ValueError("a digest of 32 bytes for each shard and at least one rank are needed")
    return blake(*[shards[r % len(shards)] for r in range(ranks)])


def verify_handoff(state: DataFrame, expect: str | None, before: str | None, shards: int, ranks: int, *, param_groups: list | None = None, chains: Mapping[int, bytes] | None = None, attested: str | None = None, grads: bool = False, label: bytes = b"state_hash.v3\n") -> dict:
    """Whether a state handed over is the one a trusted log names: {"match", "expected", "reconstructed"}.

    ``expect`` has to come from outside the hand-off: none, or nothing but the hand-off's own
    statement ``attested``, proves nothing and is refused, as are missing shards and ranks.
    """
    if expect is None:
        raise ValueError("the hash to be reached must come from a trusted log" + (", not from the hand-off itself" if attested else ""))
    if not re.fullmatch("[0-9a-fA-F]{64}", expect):
        raise ValueError("the expected hash is not 64 hexadecimal digits")
    if attested is not None and attested.lower() != expect.lower():
        raise ValueError("the hand-off names another hash than the log")
    told = {r["shard"]: bytes.fromhex(r["digest"]) for r in state_digests(state, grads=grads).limit(shards + 1).collect()}
    if set(told) != set(range(shards)):
        raise ValueError(f"digests of shards {sorted(told)} for {shards} shards")
    batch = None
    if chains is not None:
        if missing := sorted(set(range(ranks)) - set(chains)):
            raise ValueError(f"no batch digest of ranks {missing}")
        batch = combined([chains[r] for r in range(ranks)])
    got = link(before, over_ranks([told[s] for s in range(shards)], ranks), param_groups, batch, label).hex()
    return {"match": got == expect.lower(), "expected": expect.lower(), "reconstructed": got}


def interval_verdict(stated: DataFrame, replayed: DataFrame, first: int, last: int, step: str = "step", value: str = "state_hash") -> DataFrame:
    """(steps, agreed, missing, first_divergence, passed) of steps ``first`` to ``last`` - 1: a replay against the log.

    A step that only one side has is missing and diverges; an interval that compares no step
    does not pass. An empty or reversed interval is an error.
    """
    if last <= first:
        raise ValueError(f"no steps from {first} to {last}")
    inside = F.col(step).between(first, last - 1)
    a = stated.where(inside).select(step, F.col(value).alias("_a"), F.lit(True).alias("_in_a"))
    b = replayed.where(inside).select(step, F.col(value).alias("_b"), F.lit(True).alias("_in_b"))
    both = F.coalesce(F.col("_in_a") & F.col("_in_b"), F.lit(False))
    same = both & F.coalesce(F.col("_a") == F.col("_b"), F.lit(False))
    told = a.join(b, step, "full_outer").agg(F.count("*").alias("steps"), F.count_if(same).alias("agreed"), F.count_if(~both).alias("missing"), F.min(F.when(~same, F.col(step))).alias("first_divergence"))
    return told.withColumn("passed", (F.col("steps") > 0) & (F.col("steps") == F.col("agreed")))
