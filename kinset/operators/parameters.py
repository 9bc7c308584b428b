"""Parameters of the similarity protocols and exact numbers, in plain Python on the driver.

Nothing here touches data: a handful of integers decide slots, buckets, moduli and depths.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction

#: Least ring dimension by security level (fixed values).
MIN_RING = {"toy": 1024, "std128": 8192, "std192": 16384, "std256": 32768}


def next_power_of_two(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, math.isqrt(n) + 1))


def plaintext_modulus(above: int, step: int) -> int:
    """The least prime over `above` that is 1 modulo step."""
    p = 1 + step * max(1, -(-above // step))
    if p <= above:
        p += step
    while not is_prime(p):
        p += step
    return p


@dataclass(frozen=True)
class PolynomialShape:
    """How a polynomial is evaluated in baby and giant steps."""

    step: int
    chunks: int
    depth: int


def polynomial_shape(degree: int) -> PolynomialShape:
    """Step ceil(sqrt(degree + 1)); powers by squaring and one more; Horner over the chunks."""
    step = math.isqrt(degree) + 1
    chunks = degree // step + 1
    powers = step.bit_length() - 1 + (step.bit_count() - 1)
    return PolynomialShape(step, chunks, 1 + powers + chunks - 1)


@dataclass(frozen=True)
class Parameters:
    """Slots, buckets, sketch depth and threshold, with what follows from them."""

    k: int = 128
    m: int = 64
    seed: int = 42
    bottom_depth: int = 5
    tau: int | None = None
    security: str = "std128"
    sqrt: bool = False

    def __post_init__(self) -> None:
        if self.k < 1:
            raise ValueError("k must be positive")
        if self.m < (4 if self.sqrt else 2):
            raise ValueError("m is too small")
        if self.sqrt and (self.m & (self.m - 1) or self.m.bit_length() % 2 == 0):
            raise ValueError("m must be a power of four")
        if self.bottom_depth < 1:
            raise ValueError("bottom_depth must be positive")
        if self.tau is not None and not 1 <= self.tau <= self.k:
            raise ValueError("tau must lie in 1..k")
        if self.security not in MIN_RING:
            raise ValueError(f"unknown security level {self.security}")

    @property
    def feature_dim(self) -> int:
        return self.k * (2 * math.isqrt(self.m) if self.sqrt else self.m)

    @property
    def ring_dim(self) -> int:
        return max(next_power_of_two(self.feature_dim), MIN_RING[self.security])

    @property
    def plaintext_mod(self) -> int:
        return plaintext_modulus(self.k, 2 * self.ring_dim)

    @property
    def depth(self) -> int:
        if self.sqrt:
            return 3
        return 1 if self.tau is None else polynomial_shape(self.k).depth


def sanitizer_bits(statistical: int, queries: int, ring_dim: int, noise: int, margin: int) -> dict[str, int]:
    """Bits of flooding noise for a statistical target over all queries and coefficients."""
    if statistical not in (40, 64, 128):
        raise ValueError("the statistical target is 40, 64 or 128 bits")
    if not 1 <= queries <= 1 << 63:
        raise ValueError("queries must lie in 1..2**63")
    if ring_dim < 1 or ring_dim & (ring_dim - 1):
        raise ValueError("the ring dimension must be a power of two")
    query = statistical + (queries - 1).bit_length()
    coefficient = query + (ring_dim - 1).bit_length()
    return {"query": query, "coefficient": coefficient, "flood": noise + coefficient + margin}


def exact_jaccard(text: str) -> Fraction:
    """An unsigned decimal in 0..1 with at most 18 digits behind the point, exactly."""
    whole, point, rest = text.partition(".")
    if not whole.isascii() or not whole.isdigit() or (point and not (rest.isascii() and rest.isdigit())) or len(rest) > 18:
        raise ValueError(f"not an exact unsigned decimal: {text!r}")
    value = Fraction(int(whole + rest), 10 ** len(rest))
    if value > 1:
        raise ValueError(f"not in 0..1: {text!r}")
    return value


def threshold_polynomial(k: int, tau: int, p: int) -> list[int]:
    """Coefficients modulo p of the polynomial that is 1 at tau..k and 0 at 0..tau-1.

    The nodes' product is divided by each node's factor in turn; weights of equally spaced
    nodes are factorials.
    """
    whole = [1]
    for x in range(k + 1):
        whole = [(b - x * a) % p for a, b in zip([*whole, 0], [0, *whole])]
    out = [0] * (k + 1)
    for x in range(tau, k + 1):
        weight = pow(math.factorial(x) * math.factorial(k - x) * (-1) ** (k - x), -1, p)
        quotient, carry = [0] * (k + 1), 0
        for i in range(k, -1, -1):
            carry = (whole[i + 1] + x * carry) % p
            quotient[i] = carry
        out = [(a + weight * q) % p for a, q in zip(out, quotient)]
    return out


def horner(coefficients: list[int], x: int, p: int) -> int:
    value = 0
    for c in reversed(coefficients):
        value = (value * x + c) % p
    return value
