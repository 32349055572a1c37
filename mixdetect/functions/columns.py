"""Column-expression building blocks.

Everything here returns a ``pyspark.sql.Column`` built from built-in
functions only, so the expressions stay inside whole-stage codegen.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

LN_2PI = math.log(2.0 * math.pi)

# Fixed values of the portable row hash (used wherever a SQL oracle has to
# reproduce a random choice).  Two primes just below 2^31, both 2 mod 3, so that
# cubing permutes the residues; products of two residues stay below 2^62.
HASH_PRIMES = (2147483579, 2147483549)
HASH_ID_MULT = (1103515245, 1664525)
HASH_STEP_MULT = (214013, 22695477)
HASH_ADD = (12345, 1013904223)
#: Hashes are in [0, HASH_RANGE), about 2^62.
HASH_RANGE = HASH_PRIMES[0] * HASH_PRIMES[1]

# Independent random streams drawn from one seed.
STREAM_SELECT = 0  # minibatch membership
STREAM_SLOT = 1  # slot picked per row and step
STREAM_FOLD = 2  # order of shuffled folds
STREAM_KMEANS = 3  # candidate rows of the k-means start
STREAM_FIRST = 4  # first selected step of a row (geometric draw)

UNIFORM_BITS = 53


def add_all(cols: Sequence[Column]) -> Column:
    if not cols:
        return F.lit(0.0)
    return reduce(lambda a, b: a + b, cols)


def rounded(c: Column, digits: int) -> Column:
    """Round and fold -0.0 into 0.0 (so values hash equally across engines)."""
    return F.round(c, digits) + F.lit(0.0)


def stream_salt(seed: int, stream: int) -> int:
    """A number of its own for each seed and stream (there are fewer than 8 streams)."""
    return 8 * int(seed) + int(stream)


def _residue_hash(row_id: Column, step: Column, salt: int, half: int) -> Column:
    """Two rounds of multiply, add and cube modulo one prime."""
    p = HASH_PRIMES[half]

    def cube(x: Column) -> Column:
        return ((x * x) % p * x) % p

    start = (((row_id % p + p) % p) * HASH_ID_MULT[half] + (step % p) * HASH_STEP_MULT[half] + (salt % p + p) % p) % p
    return cube((cube(start) * HASH_STEP_MULT[half] + HASH_ADD[half]) % p)


def modular_hash(row_id: Column, step: Column | int, seed: int, stream: int) -> Column:
    """Portable integer hash in [0, HASH_RANGE): same value in any SQL engine with 64-bit integers.

    Different ids below HASH_RANGE differ modulo at least one of the primes, and
    both rounds permute the residues, so they never collide.
    """
    step_c = (step if isinstance(step, Column) else F.lit(int(step))).cast("long")
    salt = stream_salt(seed, stream)
    high, low = (_residue_hash(row_id.cast("long"), step_c, salt, half) for half in range(2))
    return high * HASH_PRIMES[1] + low


def _mod(x: np.ndarray, p: np.uint64) -> np.ndarray:
    return x - (x // p) * p  # NumPy divides by one number much faster than it takes remainders


def residue_starts(ids: np.ndarray, half: int) -> np.ndarray:
    """What :func:`residue_hashes` needs of each id, whatever the step."""
    p = HASH_PRIMES[half]
    return _mod((ids % p).astype(np.uint64) * np.uint64(HASH_ID_MULT[half]), np.uint64(p))


def residue_hashes(starts: np.ndarray, step: int, salt: int, half: int) -> np.ndarray:
    """``_residue_hash`` of a batch of ids.

    The column form repeats its argument in every product: some hundred divisions
    a hash where the compiler does not share them, as in a filter.
    """
    p, q = np.uint64(HASH_PRIMES[half]), HASH_PRIMES[half]

    def cube(x: np.ndarray) -> np.ndarray:
        return _mod(_mod(x * x, p) * x, p)

    x = cube(_mod(starts + np.uint64((step * HASH_STEP_MULT[half] + salt) % q), p))
    return cube(_mod(x * np.uint64(HASH_STEP_MULT[half]) + np.uint64(HASH_ADD[half]), p))


def modular_below(starts: tuple[np.ndarray, np.ndarray], step: int, seed: int, stream: int, cutoff: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the ids whose modular hash is below ``cutoff``; the high half settles nearly all of them."""
    salt = stream_salt(seed, stream)
    high = residue_hashes(starts[0], step, salt, 0)
    at = np.flatnonzero(high <= np.uint64(cutoff // HASH_PRIMES[1]))
    h = high[at] * np.uint64(HASH_PRIMES[1]) + residue_hashes(starts[1][at], step, salt, 1)
    below = h < np.uint64(cutoff)
    return at[below], h[below]


def modular_uniform(row_id: Column, step: int, seed: int, stream: int) -> Column:
    """The modular hash as a uniform in (0, 1), in Arrow batches; null without an id."""
    salt = stream_salt(seed, stream)

    @F.arrow_udf("double")
    def uniforms(ids: pa.Array) -> pa.Array:
        values = ids.fill_null(0).to_numpy(zero_copy_only=False)
        high, low = (residue_hashes(residue_starts(values, half), step, salt, half) for half in range(2))
        h = high * np.uint64(HASH_PRIMES[1]) + low
        return pa.array((h.astype(float) + 0.5) / float(HASH_RANGE), mask=ids.is_null().to_numpy(zero_copy_only=False))

    return uniforms(row_id.cast("long"))


def xx_hash(row_id: Column, step: Column | int, seed: int, stream: int) -> Column:
    """Production hash in [0, HASH_RANGE): xxhash64 of (id, step, salt)."""
    return F.pmod(full_hash(row_id, step, seed, stream), F.lit(HASH_RANGE).cast("long"))


def row_hash(kind: str, row_id: Column, step: Column | int, seed: int, stream: int) -> Column:
    if kind == "modular":
        return modular_hash(row_id, step, seed, stream)
    if kind == "xxhash":
        return xx_hash(row_id, step, seed, stream)
    raise ValueError(f"unknown hash kind {kind!r}")


def selection_cutoff(fraction: float) -> int:
    """Rows with hash < cutoff are kept; fraction 1 keeps every row."""
    f = min(1.0, max(0.0, float(fraction)))
    return int(math.floor(f * float(HASH_RANGE))) if f < 1.0 else HASH_RANGE


def uniform(row_id: Column, step: Column | int, seed: int, stream: int) -> Column:
    """Seeded uniform in (0, 1) with 53 bits of resolution, from xxhash64 of (id, step, salt)."""
    step_c = step if isinstance(step, Column) else F.lit(int(step))
    h = F.xxhash64(row_id.cast("long"), step_c.cast("long"), F.lit(stream_salt(seed, stream)).cast("long"))
    scale = float(1 << UNIFORM_BITS)
    return (F.pmod(h, F.lit(1 << UNIFORM_BITS).cast("long")).cast("double") + F.lit(0.5)) / F.lit(scale)


def full_hash(row_id: Column, step: Column | int, seed: int, stream: int) -> Column:
    """The whole 64-bit xxhash64 of (id, step, salt): a random order with no
    ties between distinct ids, however many rows there are."""
    step_c = step if isinstance(step, Column) else F.lit(int(step))
    return F.xxhash64(row_id.cast("long"), step_c.cast("long"), F.lit(stream_salt(seed, stream)).cast("long"))
