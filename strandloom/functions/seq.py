"""Column expressions over DNA strings. Base codes are A=0, C=1, T=2, G=3."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACTG"  # fixed value: position in this string is the 2-bit code


def revcomp(s: Column) -> Column:
    """Reverse complement of an upper-case ACGTN string."""
    return F.reverse(F.translate(s, "ACGT", "TGCA"))


def canonical(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement."""
    return F.least(kmer, revcomp(kmer))


def kmers(seq: Column, k: int) -> Column:
    """Array of the k-mers of seq in order; empty where seq is shorter than k."""
    return F.when(
        F.length(seq) >= k,
        F.transform(F.sequence(F.lit(1), F.length(seq) - (k - 1)), lambda i: F.substring(seq, i, F.lit(k))),
    ).otherwise(F.array().cast("array<string>"))


def extend_right(kmer: Column, base: Column) -> Column:
    return F.concat(F.substring(kmer, F.lit(2), F.length(kmer)), base)


def extend_left(kmer: Column, base: Column) -> Column:
    return F.concat(base, F.substring(kmer, F.lit(1), F.length(kmer) - 1))


def pack(kmer: Column) -> Column:
    """k-mer (k <= 31) as a non-negative BIGINT, first base in the high bits. A longer one raises: it stays a string."""
    return F.when(F.length(kmer) > 31, F.raise_error(F.lit("k-mers of over 31 bases can't be packed"))).otherwise(_packed(kmer))


def _packed(kmer: Column) -> Column:
    return F.conv(F.translate(kmer, BASES, "0123"), 4, 10).cast("bigint")


def unpack(code: Column, k: int) -> Column:
    """The k-mer of a packed BIGINT."""
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", BASES)


#: Bases of the low limb of a k-mer that is two longs.
LIMB = 32


def _limb(bases: Column) -> Column:
    return F.conv(F.translate(bases, BASES, "0123"), 4, -10).cast("bigint")


def limbs(kmer: Column, k: int) -> tuple[Column, Column]:
    """(hi, lo) of a k-mer of up to 63 bases: its last 32 bases in lo, whose highest bit may be set, and what is before them in hi."""
    if k > 63:
        raise ValueError("k-mers of over 63 bases stay strings")
    if k <= LIMB:
        return F.lit(0).cast("bigint"), _limb(kmer)
    return _limb(F.left(kmer, F.lit(k - LIMB))), _limb(F.right(kmer, F.lit(LIMB)))


def unpack_limbs(hi: Column, lo: Column, k: int) -> Column:
    """The k-mer of two limbs."""
    digits = lambda x, n: F.lpad(F.conv(F.hex(x), 16, 4), n, "0")
    return F.translate(digits(lo, k) if k <= LIMB else F.concat(digits(hi, k - LIMB), digits(lo, LIMB)), "0123", BASES)


def _mask(n: int) -> Column:
    """The low n bases of a limb."""
    return F.lit((1 << (2 * n)) - 1 if n < LIMB else -1).cast("bigint")


def extend_limbs_right(hi: Column, lo: Column, code: Column, k: int) -> tuple[Column, Column]:
    """The k-mer without its first base and with one more."""
    low = F.shiftleft(lo, 2).bitwiseOR(code.cast("bigint"))
    if k <= LIMB:
        return hi, low.bitwiseAND(_mask(k))
    return F.shiftleft(hi, 2).bitwiseOR(F.shiftrightunsigned(lo, 62)).bitwiseAND(_mask(k - LIMB)), low


def extend_limbs_left(hi: Column, lo: Column, code: Column, k: int) -> tuple[Column, Column]:
    """The k-mer without its last base and with one more in front."""
    code = code.cast("bigint")
    if k <= LIMB:
        return hi, F.shiftrightunsigned(lo, 2).bitwiseOR(F.shiftleft(code, 2 * (k - 1)))
    return F.shiftrightunsigned(hi, 2).bitwiseOR(F.shiftleft(code, 2 * (k - LIMB - 1))), F.shiftrightunsigned(lo, 2).bitwiseOR(F.shiftleft(hi, 62))


def _reversed_limb(x: Column) -> Column:
    """Its 32 bases in the other order, each as its complement: swaps of neighbours, pairs, fours, ..."""
    for bits in (2, 4, 8, 16):
        low = sum(((1 << bits) - 1) << at for at in range(0, 64, 2 * bits))
        mask = F.lit(low - (1 << 64) if low >> 63 else low).cast("bigint")
        x = F.shiftrightunsigned(x, bits).bitwiseAND(mask).bitwiseOR(F.shiftleft(x.bitwiseAND(mask), bits))
    x = F.shiftrightunsigned(x, 32).bitwiseOR(F.shiftleft(x, 32))
    return x.bitwiseXOR(F.lit(0xAAAAAAAAAAAAAAAA - (1 << 64)).cast("bigint"))


def revcomp_limbs(hi: Column, lo: Column, k: int) -> tuple[Column, Column]:
    """Reverse complement, by bits alone."""
    if k <= LIMB:
        return hi, F.shiftrightunsigned(_reversed_limb(lo), 64 - 2 * k) if k < LIMB else _reversed_limb(lo)
    # reversed, lo comes first; the empty upper bases of hi come last
    first, second, spare = _reversed_limb(lo), _reversed_limb(hi), 2 * (64 - k)
    return F.shiftrightunsigned(first, spare), F.shiftleft(first, 64 - spare).bitwiseOR(F.shiftrightunsigned(second, spare))


def pack_bases(seq: Column) -> Column:
    """Any ACGT string as bytes of four bases, first base in the high bits, the last byte filled up with A."""
    digits = F.translate(seq, BASES, "0123")
    full = F.rpad(digits, ((F.length(seq) + 3) / 4).cast("int") * 4, F.lit("0"))
    code = lambda i: F.lpad(F.conv(F.substring(full, i * 4 - 3, F.lit(4)), 4, 16), 2, "0")
    return F.unhex(F.when(F.length(seq) == 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest((F.length(full) / 4).cast("int"), F.lit(1))), code), "")))


def unpack_bases(data: Column, n: Column) -> Column:
    """The n bases of pack_bases."""
    hexes = F.hex(data)
    four = lambda i: F.lpad(F.conv(F.substring(hexes, i * 2 - 1, F.lit(2)), 16, 4), 4, "0")
    digits = F.when(n == 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length(data), F.lit(1))), four), ""))
    return F.translate(F.substring(digits, F.lit(1), n), "0123", BASES)


def base_code(base: Column) -> Column:
    return F.translate(base, BASES, "0123").cast("int")


def normalise(s: Column) -> Column:
    """Upper case, U to T, white space removed, every other letter or sign N."""
    up = F.translate(s, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return F.regexp_replace(F.translate(F.regexp_replace(up, r"\s+", ""), "U", "T"), "[^ACGTN]", "N")


def sanitise_id(header: Column) -> Column:
    """File-safe record name: first word of the header, other characters as underscores."""
    return F.regexp_replace(F.substring_index(header, " ", 1), "[^a-zA-Z0-9_.-]", "_")


def format_int(x: Column) -> Column:
    """Thousands separators."""
    return F.format_number(x, 0)
