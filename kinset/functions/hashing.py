"""Domain-separated SHA-256 hashes as column expressions.

Every hash is SHA-256 over a domain text, an optional zero byte and fixed-width or
length-prefixed fields; its first eight bytes, big-endian, are an unsigned 64-bit rank.
Ranks are carried in two forms: 16 hexadecimal digits (text order is unsigned order) and
BIGINT with the top bit flipped (signed order is unsigned order), which hash aggregates
take.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinset.functions.expressions import let

MINHASH = "kinset-minhash-v1"
FEATURE = "kinset-feature-v1"
NEGATIVE_PAIR = "kinset-negative-v1"
DOCUMENT = "kinset-document-v1"
PAIR = "kinset-pair-v1"
COPY = "kinset-copy-v1"
TRIAL = "kinset-trial-v1"
SPLIT = "kinset-split-v1"

_FLIP = -(1 << 63)


def text_bytes(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def be64(n: Column) -> Column:
    """Eight bytes, big-endian, of a BIGINT's two's complement."""
    return F.unhex(F.lpad(F.hex(n.cast("bigint")), 16, "0"))


def be32(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("bigint")), 8, "0"))


def prefixed(text: Column) -> Column:
    """A field with its length in bytes before it (32 bits)."""
    raw = text_bytes(text)
    return F.concat(be32(F.octet_length(raw)), raw)


def digest(domain: str, *fields: Column, zero: bool = False) -> Column:
    """All 64 digits of SHA-256 over the domain, a zero byte if asked for, and the fields."""
    head = domain.encode() + (b"\0" if zero else b"")
    return F.sha2(F.concat(F.lit(head), *fields), 256)


def rank_hex(domain: str, *fields: Column, zero: bool = False) -> Column:
    return F.substr(digest(domain, *fields, zero=zero), F.lit(1), F.lit(16))


def hex_to_signed(rank: Column) -> Column:
    """The two's complement BIGINT of 16 digits."""
    return F.conv(rank, 16, -10).cast("bigint")


def hex_to_ordered(rank: Column) -> Column:
    """BIGINT in unsigned order."""
    return hex_to_signed(rank).bitwiseXOR(F.lit(_FLIP))


def ordered_to_hex(n: Column) -> Column:
    return F.lower(F.lpad(F.hex(n.bitwiseXOR(F.lit(_FLIP))), 16, "0"))


def hex_mod(rank: Column, m: int) -> Column:
    """The unsigned rank modulo m, as BIGINT."""
    if m & (m - 1) == 0:
        return hex_to_signed(rank).bitwiseAND(F.lit(m - 1))
    return (F.conv(rank, 16, 10).cast("decimal(20,0)") % F.lit(m)).cast("bigint")


def ordered_mod(n: Column, m: int) -> Column:
    """The unsigned value of an ordered BIGINT modulo m."""
    signed = n.bitwiseXOR(F.lit(_FLIP))
    if m & (m - 1) == 0:
        return signed.bitwiseAND(F.lit(m - 1))
    wide = F.when(signed < 0, signed.cast("decimal(20,0)") + _big(1 << 64)).otherwise(signed.cast("decimal(20,0)"))
    return (wide % F.lit(m)).cast("bigint")


def minhash_rank(element: Column, coord: Column, seed: int = 42, domain: str = MINHASH, hash_range: int | None = None) -> Column:
    """The rank of an element at a coordinate, as 16 digits; modulo hash_range where one is set."""
    rank = rank_hex(domain, F.lit(seed.to_bytes(8, "big")), be32(coord), be64(element))
    if hash_range is None:
        return rank
    return F.lower(F.lpad(F.hex(hex_mod(rank, hash_range)), 16, "0"))


def share_bound(n: Column, read: int) -> Column:
    """Text below which, on average, read of n digests lie; above all of them where n is no more."""
    return F.when(n > read, F.lower(F.lpad(F.hex(F.floor(F.lit(read << 32) / n)), 8, "0"))).otherwise("g")


def feature_hash(feature: Column, domain: str = FEATURE) -> Column:
    return rank_hex(domain, text_bytes(feature), zero=True)


def pair_parts(domain: str, a: Column, b: Column, seed: int = 7, zero: bool = False) -> tuple[Column, Column]:
    """What each side brings to the digest of a pair, so that a product makes it once a row."""
    return F.concat(F.lit(domain.encode() + (b"\0" if zero else b"") + seed.to_bytes(8, "big")), prefixed(a)), prefixed(b)


def negative_rank(a: Column, b: Column, seed: int = 7, domain: str = NEGATIVE_PAIR) -> Column:
    """The whole digest by which sampled non-matches are chosen."""
    return digest(domain, F.lit(seed.to_bytes(8, "big")), prefixed(a), prefixed(b))


def document_rank(path: Column, seed: int = 7, domain: str = DOCUMENT) -> Column:
    return digest(domain, F.lit(seed.to_bytes(8, "big")), text_bytes(path))


def pair_rank(a: Column, b: Column, seed: int = 7, domain: str = PAIR) -> Column:
    return digest(domain, F.lit(seed.to_bytes(8, "big")), prefixed(a), prefixed(b), zero=True)


def pair_id(kind: str, a: Column, b: Column, prefix: str = "pair:") -> Column:
    """prefix and SHA-256 of the kind and both ids, the lesser first, parted by zero bytes."""
    body = F.concat(F.lit(kind.encode() + b"\0"), text_bytes(F.least(a, b)), F.lit(b"\0"), text_bytes(F.greatest(a, b)))
    return F.concat(F.lit(prefix), F.sha2(body, 256))


def hex_record_id(raw_id: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.lower(F.hex(text_bytes(raw_id))))


def digest_record_id(path: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.sha2(text_bytes(path), 256))


def copy_fingerprint(*fields: Column, domain: str = COPY) -> Column:
    return digest(domain, *map(prefixed, fields), zero=True)


def trial_seed(pair: Column, trial: Column, root: int = 20260729, domain: str = TRIAL) -> Column:
    return rank_hex(domain, F.lit(root.to_bytes(8, "big")), prefixed(pair), be64(trial), zero=True)


def split_rank(pair: Column, domain: str = SPLIT) -> Column:
    return digest(domain, text_bytes(pair), zero=True)


def indexed_seed(root: int, index32: Column, trial: Column, domain: str = TRIAL) -> Column:
    """Seed of a trial of a grid point."""
    return rank_hex(domain, F.lit(root.to_bytes(8, "big")), be32(index32), be64(trial), zero=True)


def kind_seed(root: int, kind: int, index: Column | None, domain: str = TRIAL) -> Column:
    """Seed of a trial of a kind (one byte) at an index (32 bits); without index, of the kind."""
    fields = [F.lit(root.to_bytes(8, "big")), F.lit(bytes([kind]))]
    return rank_hex(domain, *fields, *([] if index is None else [be32(index)]), zero=True)


def hash_seed(root: int, index: Column | None = None, domain: str = TRIAL) -> Column:
    """Seed of the hashes of a run, or of one of its indexes (32 bits) where one is given."""
    return rank_hex(domain, F.lit(root.to_bytes(8, "big")), *([] if index is None else [be32(index)]), zero=True)


def run_seed(root: int, manifest_sha256: Column, k: Column, m: Column, profile: Column, method: Column | None = None, domain: str = TRIAL) -> Column:
    """Seed of a timing run over a dataset (64 digits), or with method of an encoding run."""
    fields = [F.lit(root.to_bytes(8, "big")), F.unhex(manifest_sha256), be32(k), be32(m), prefixed(profile)]
    return rank_hex(domain, *fields, *([] if method is None else [prefixed(method)]), zero=True)


def json_digest(value: object) -> str:
    """SHA-256 of canonical JSON: sorted keys, no blanks, UTF-8 as it is."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def item_encoding(element: Column, tag: int = 1, index: Column | None = None) -> Column:
    """Set-intersection items: a tag byte, the element, and the coordinate where given."""
    return F.concat(F.lit(bytes([tag])), be64(element), *([] if index is None else [be32(index)]))


def _big(n: int) -> Column:
    """A DECIMAL literal; plain literals end at 63 bits."""
    return F.lit(str(n)).cast("decimal(20,0)")


def _wrap(n: Column) -> Column:
    """A non-negative DECIMAL modulo 2**64."""
    return n % _big(1 << 64)


def _folded(z: Column, by: int) -> Column:
    return let(z, lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, by)))


def _by(times: Callable[[Column, int], Column], factor: int) -> Callable[[Column], Column]:
    return lambda x: times(x, factor)


def mixed_seed(root: int, trial: Column) -> Column:
    """A splitmix step of root + (trial + 1) * golden, modulo 2**64, as 16 digits.

    Products modulo 2**64 are put together from 32-bit halves in DECIMAL, as BIGINT
    overflow is an error in ANSI mode.
    """

    def unsigned(x: Column) -> Column:
        wide = x.cast("decimal(20,0)")
        return F.when(x < 0, wide + _big(1 << 64)).otherwise(wide)

    def signed(x: Column) -> Column:
        return F.when(x >= _big(1 << 63), x - _big(1 << 64)).otherwise(x).cast("bigint")

    def times(x: Column, c: int) -> Column:
        low, high = x.bitwiseAND(F.lit(0xFFFFFFFF)).cast("decimal(20,0)"), F.shiftrightunsigned(x, 32).cast("decimal(20,0)")
        upper = (high * F.lit(c & 0xFFFFFFFF).cast("decimal(10,0)") + low * F.lit(c >> 32).cast("decimal(10,0)")) % F.lit(1 << 32).cast("decimal(10,0)")
        return signed(_wrap(low * F.lit(c & 0xFFFFFFFF).cast("decimal(10,0)") + upper * F.lit(1 << 32).cast("decimal(10,0)")).cast("decimal(20,0)"))

    golden = 0x9E3779B97F4A7C15
    z = let(times(trial.cast("bigint") + 1, golden), lambda x: signed(_wrap(unsigned(x) + _big(root)).cast("decimal(20,0)")))
    for by, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = let(_folded(z, by), _by(times, factor))
    return let(z, lambda x: F.lower(F.lpad(F.hex(x.bitwiseXOR(F.shiftrightunsigned(x, 31))), 16, "0")))
