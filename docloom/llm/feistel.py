"""Keyed permutations of [0, n): an alternating modular Feistel network with cycle walking.

The domain a*b >= n is split into (l, r) with l < a, r < b; even rounds add F(r) to l mod a, odd
rounds add F(l) to r mod b. F is a keyed polynomial modulo the prime 2**31-1, so every step is plain
64-bit integer arithmetic, the same in Spark, DuckDB and Python. Factors are chosen so that only
``gap`` = a*b-n values lie outside [0, n); a walk can meet each of them at most once, so gap+1
applications always suffice.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from math import isqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = (1 << 31) - 1
ROUNDS = 8
#: Factors searched for the domain with the smallest gap.
SEARCH = 4096


@dataclass(frozen=True)
class Feistel:
    n: int
    a: int
    b: int
    keys: tuple[tuple[int, int, int], ...]

    @property
    def walks(self) -> int:
        return self.a * self.b - self.n + 1

    # -- plain Python: where does row x go, and which row is at y
    def _f(self, v: int, k: tuple[int, int, int]) -> int:
        t = (v + k[0]) % PRIME
        t = t * t % PRIME * ((v + k[1]) % PRIME) % PRIME
        t = (t * t + k[2]) % PRIME
        return t * ((t + k[0]) % PRIME) % PRIME

    def once(self, x: int) -> int:
        left, right = divmod(x, self.b)
        for i, k in enumerate(self.keys):
            if i % 2 == 0:
                left = (left + self._f(right, k)) % self.a
            else:
                right = (right + self._f(left, k)) % self.b
        return left * self.b + right

    def back_once(self, x: int) -> int:
        left, right = divmod(x, self.b)
        for i, k in reversed([*enumerate(self.keys)]):
            if i % 2 == 0:
                left = (left - self._f(right, k)) % self.a
            else:
                right = (right - self._f(left, k)) % self.b
        return left * self.b + right

    def permute(self, x: int) -> int:
        y = self.once(x)
        while y >= self.n:
            y = self.once(y)
        return y

    def invert(self, y: int) -> int:
        x = self.back_once(y)
        while x >= self.n:
            x = self.back_once(x)
        return x

    # -- Spark columns
    def _round(self, pair: Column, k: Column) -> Column:
        def f(v: Column) -> Column:
            t = (v + k["k0"]) % PRIME
            t = t * t % PRIME * ((v + k["k1"]) % PRIME) % PRIME
            return (t * t + k["k2"]) % PRIME

        def last(t: Column) -> Column:
            return t * ((t + k["k0"]) % PRIME) % PRIME

        def mixed(v: Column) -> Column:
            # one binding of the inner value, so that it is computed once
            return F.element_at(F.transform(F.array(f(v)), last), 1)

        left, right = pair["l"], pair["r"]
        return F.struct(
            F.when(k["even"], (left + mixed(right)) % self.a).otherwise(left).alias("l"),
            F.when(k["even"], right).otherwise((right + mixed(left)) % self.b).alias("r"),
        )

    def _once_col(self, x: Column) -> Column:
        keys = F.array(*[F.struct(F.lit(k[0]).cast("long").alias("k0"), F.lit(k[1]).cast("long").alias("k1"), F.lit(k[2]).cast("long").alias("k2"), F.lit(i % 2 == 0).alias("even")) for i, k in enumerate(self.keys)])
        b = F.lit(self.b).cast("long")
        start = F.struct(F.floor(x / b).cast("long").alias("l"), (x % b).alias("r")) if self.a * self.b < 1 << 52 else F.struct(((x - x % b) / b).cast("long").alias("l"), (x % b).alias("r"))
        return F.aggregate(keys, start, self._round, lambda p: p["l"] * b + p["r"])

    def column(self, x: Column) -> Column:
        """The place of ``x`` (a BIGINT in [0, n)); null stays null."""
        n = F.lit(self.n).cast("long")
        if self.walks == 1:
            return self._once_col(x)
        steps = F.sequence(F.lit(2), F.lit(self.walks))
        return F.aggregate(steps, self._once_col(x), lambda y, _: F.when(y < n, y).otherwise(self._once_col(y)))


def feistel(n: int, key: str) -> Feistel:
    """The permutation of [0, n) under ``key``."""
    n = max(n, 1)
    root = max(isqrt(n), 1)
    a = min(range(root, min(root + SEARCH, n) + 1), key=lambda c: (-(-n // c) * c - n, c))
    digests = [hashlib.sha256(f"{key}/{i}".encode()).digest() for i in range(ROUNDS)]
    keys = tuple(tuple(int.from_bytes(d[8 * j : 8 * j + 8], "big") % PRIME for j in range(3)) for d in digests)
    return Feistel(n, a, -(-n // a), keys)
