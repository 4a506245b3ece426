"""Exact top-k inner products by a bit-sliced index.

A shard keeps, for every attribute, one bitmap per bit of its quantised value.
The quantised part of an inner product is then a sum of shifted bitmaps, and the
sum itself comes out bit-sliced. The k-th highest sum is read off from the most
significant slice downward; what quantising cut off is bounded, so every row
that could still belong to the answer lies within a known distance of it, and
only these boundary rows are scored on whole values.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import best, searched, usable

_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def bitmaps(flags: np.ndarray) -> np.ndarray:
    """Flags along the last axis as 64-bit words."""
    packed = np.packbits(flags, axis=-1, bitorder="little")
    packed = np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, -packed.shape[-1] % 8)])
    return np.ascontiguousarray(packed).view("<u8")


def add(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """The sum of two bit-sliced numbers, lowest slice first."""
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    out, carry = [], None
    for i, x in enumerate(a):
        both = None
        if i < len(b):
            both, x = x & b[i], x ^ b[i]
        if carry is not None:
            passed, x = x & carry, x ^ carry
            carry = passed if both is None else both | passed
        else:
            carry = both
        out.append(x)
    return out if carry is None else [*out, carry]


class BitSlicedShard:
    """The index of a shard: rows by 64-bit words, attributes by slices."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, slices: int) -> None:
        self.ids, self.values = ids, values
        top = int(np.abs(values).max(initial=0))
        bits = top.bit_length() + 1
        self.cut = max(0, bits - slices)
        self.width = bits - self.cut
        lifted = (values >> self.cut) + (1 << (self.width - 1))
        self.slices = np.stack([bitmaps(((lifted >> b) & 1).astype(bool).T) for b in range(self.width)])  # bit, dim, word
        self.rows = bitmaps(np.ones(len(ids), bool))

    def sums(self, queries: np.ndarray) -> list[np.ndarray]:
        """Bit-sliced sums over attributes of |q| times the value, complemented where q is negative."""
        size, negative = np.abs(queries), queries < 0
        flip = np.where(negative.T, _ONES, np.uint64(0))[:, :, None]  # dim, query, 1
        terms = [s[:, None, :] ^ flip for s in self.slices]
        total: list[np.ndarray] = []
        for bit in range(int(size.max(initial=0)).bit_length()):
            mask = np.where(((size >> bit) & 1).astype(bool).T, _ONES, np.uint64(0))[:, :, None]
            number = [t & mask for t in terms]
            while len(number[0]) > 1:
                n = len(number[0])
                half = add([x[: n // 2] for x in number], [x[n // 2: n // 2 * 2] for x in number])
                if n % 2:
                    rest = [x[-1:] for x in number]
                    rest += [np.zeros_like(rest[0])] * (len(half) - len(rest))
                    half = [np.concatenate([x, y]) for x, y in zip(half, rest, strict=True)]
                number = half
            part = [x[0] for x in number]
            total = total[:bit] + add(total[bit:], part) if total[bit:] else total + [np.zeros_like(part[0])] * (bit - len(total)) + part
        return total

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[np.ndarray]:
        """Query ids, row ids and scores of the k best rows of each query; none has the query's id."""
        sums = self.sums(queries) or [np.zeros((len(queries), len(self.rows)), np.uint64)]
        valid = np.repeat(self.rows[None], len(queries), axis=0)
        order = np.argsort(self.ids, kind="stable")
        first, last = (np.searchsorted(self.ids[order], query_ids, side) for side in ("left", "right"))
        for n in np.flatnonzero(first < last):
            own = np.zeros(len(self.ids), bool)
            own[order[first[n]: last[n]]] = True
            valid[n] &= ~bitmaps(own)
        left, above, kth = valid, np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)
        for level in range(len(sums) - 1, -1, -1):
            ones = left & sums[level]
            count = above + np.bitwise_count(ones).sum(axis=1, dtype=np.int64)
            enough = count >= k
            kth += enough.astype(np.int64) << level
            above = np.where(enough, above, count)
            left = np.where(enough[:, None], ones, left & ~sums[level])
        # rows below the k-th sum by less than what quantising can hide
        slack = ((1 << self.cut) - 1) * np.abs(queries).sum(axis=1)
        least = np.maximum(0, kth - (slack >> self.cut))
        least[np.bitwise_count(valid).sum(axis=1) <= k] = 0
        over, equal = np.zeros_like(valid), valid
        for level in range(len(sums) - 1, -1, -1):
            bit = np.where((least >> level) & 1, _ONES, np.uint64(0))[:, None]
            over |= equal & sums[level] & ~bit
            equal = equal & ~(sums[level] ^ bit)
        beyond = (least >> len(sums)) > 0
        near = np.where(beyond[:, None], np.uint64(0), over | equal)
        out = []
        for n in range(len(queries)):
            rows = np.flatnonzero(np.unpackbits(near[n].view(np.uint8), bitorder="little"))
            score = self.values[rows] @ queries[n]
            order = np.lexsort((self.ids[rows], -score))[:k]
            out.append((np.full(len(order), query_ids[n]), self.ids[rows[order]], score[order]))
        return [np.concatenate(x) for x in zip(*out, strict=True)]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, slices: int = 6, per_shard: int = 8192,
          per_block: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest integer inner products of each query.

    Components become floor(scale * x). ``is_query`` is a condition on ``id``;
    a query never finds its own id. Ties go to the smaller id; vectors that hold
    null or non-finite components take no part; vectors of another length than a
    query's aren't its candidates. ``slices`` (bits kept of a component),
    ``per_shard`` and ``per_block`` change speed and memory only. Rows repeated
    with one id are one candidate each; query rows repeated with one id are ranked
    together, so a candidate is listed once for each of them. A component so
    large that a sum might not fit 64 bits is refused with an error.
    """
    def quantised(x: Column) -> Column:
        large = F.abs(F.lit(scale) * x) >= F.floor(F.lit(math.sqrt(2.0**63)) / F.sqrt("dim"))
        return F.when(large, F.raise_error(F.lit("a component is too large for inner products of 64 bits"))).otherwise(F.floor(F.lit(scale) * x)).cast("long")

    rows = usable(vectors, id_col, vector_col).withColumn("vec", F.transform("vec", quantised))
    return best(searched(rows, is_query, k, per_shard, per_block, lambda ids, values: BitSlicedShard(ids, values, slices), "long"), k)
