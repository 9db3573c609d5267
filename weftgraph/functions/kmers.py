"""Column functions on k-mers.

A k-mer is either a string of A, C, G, T or a number of two bits a base, first base highest. Base codes are C=0, A=1, T=2,
G=3, so the complement of a code is 3 minus it, and the canonical form is the greater of a k-mer and its reverse complement.
Numbers are non-negative BIGINTs up to k = 31; at k = 32 they use the sign bit and compare through `unsigned`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bases in order of their codes, and codes of bases.
BASES, CODES = "CATG", "0123"
MASKS = (0x3333333333333333, 0x0F0F0F0F0F0F0F0F, 0x00FF00FF00FF00FF, 0x0000FFFF0000FFFF, 0x00000000FFFFFFFF)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _bits(x: int) -> Column:
    return F.lit(_signed(x)).cast("bigint")


def _right(c: Column, n: int) -> Column:
    return F.shiftrightunsigned(c, n) if n < 64 else F.lit(0).cast("bigint")


def _left(c: Column, n: int) -> Column:
    return F.shiftleft(c, n) if n < 64 else F.lit(0).cast("bigint")


def mask(k: int) -> int:
    return (1 << (2 * k)) - 1


# strings


def code(s: Column) -> Column:
    """Digits 0-3 in place of bases; strings of one length order as their k-mers do."""
    return F.translate(s, BASES, CODES)


def base_to_int(s: Column) -> Column:
    """Code of a base; 4 for anything else."""
    return F.when(s.isin(*BASES), code(s).cast("int")).otherwise(4)


def int_to_base(i: Column) -> Column:
    return F.substring(F.lit(BASES), i + 1, F.lit(1)) if isinstance(i, Column) else F.lit(BASES[i])


def complement(s: Column) -> Column:
    return F.translate(s, "ACGT", "TGCA")


def reverse_complement(s: Column) -> Column:
    return F.reverse(complement(s))


def canonical(s: Column) -> Column:
    r = reverse_complement(s)
    return F.when(code(s) >= code(r), s).otherwise(r)


def is_canonical(s: Column) -> Column:
    """The k-mer isn't less than its reverse complement."""
    return code(s) >= code(reverse_complement(s))


def prefix(s: Column, n: Column | int) -> Column:
    return F.substring(s, F.lit(1), n if isinstance(n, Column) else F.lit(n))


def suffix(s: Column, n: Column | int) -> Column:
    return F.right(s, n if isinstance(n, Column) else F.lit(n))


def shift_in_right(a: Column, b: Column) -> Column:
    """a moved left to take b at its end; keeps the length of a."""
    return F.right(F.concat(a, b), F.length(a))


def shift_in_left(a: Column, b: Column) -> Column:
    """a put before b; keeps the length of b."""
    return F.left(F.concat(a, b), F.length(b))


def period(s: Column) -> Column:
    """The least p with s[i] = s[i + p] wherever both are."""
    n = F.length(s)
    return F.array_min(F.filter(F.sequence(F.lit(1), n), lambda p: F.left(s, n - p) == F.right(s, n - p)))


def is_self_reverse_complement(s: Column) -> Column:
    return s == reverse_complement(s)


def is_constant(s: Column) -> Column:
    return s == F.repeat(F.left(s, F.lit(1)), F.length(s))


def can_have_duplex_edges(s: Column) -> Column:
    return is_self_reverse_complement(s) | is_constant(s)


# numbers


def pack(s: Column) -> Column:
    return F.conv(code(s), 4, -10).cast("bigint")


def unpack(v: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(v.cast("string"), 10, 4), k, "0"), CODES, BASES)


def unsigned(v: Column) -> Column:
    """Orders 64-bit numbers as unsigned ones."""
    return v.bitwiseXOR(_bits(1 << 63))


def packed_reverse_complement(v: Column, k: int) -> Column:
    """Swaps ever larger groups of bases, complements, and moves the k-mer down."""
    for m, shift in zip(MASKS, (2, 4, 8, 16, 32), strict=True):
        v = _right(v, shift).bitwiseAND(_bits(m)).bitwiseOR(_left(v.bitwiseAND(_bits(m)), shift))
    return _right(F.bitwise_not(v), 64 - 2 * k)


def word_reverse_complement(v: Column, bits: int) -> Column:
    """Reverse complement of all bases of a 32- or 64-bit word."""
    return packed_reverse_complement(v, bits // 2)


def wide_reverse_complement(high: Column, low: Column) -> tuple[Column, Column]:
    """The same for a 128-bit word, as (high, low)."""
    return packed_reverse_complement(low, 32), packed_reverse_complement(high, 32)


def packed_canonical(v: Column, k: int) -> Column:
    r = packed_reverse_complement(v, k)
    return F.greatest(v, r) if k < 32 else F.when(unsigned(v) >= unsigned(r), v).otherwise(r)


def packed_prefix(v: Column, k: int, n: int) -> Column:
    return _right(v, 2 * (k - n))


def packed_suffix(v: Column, n: int) -> Column:
    return v.bitwiseAND(_bits(mask(n)))


def left_extension(node: Column, base: int, k: int) -> Column:
    """The k-mer of a base before a (k-1)-mer."""
    return node.bitwiseOR(_bits(base << (2 * (k - 1))))


def right_extension(node: Column, base: int) -> Column:
    """The k-mer of a base after a (k-1)-mer."""
    return _left(node, 2).bitwiseOR(_bits(base))


# edges against nodes: a node is a canonical (k-1)-mer, an edge a canonical k-mer


def _touches(node: Column, edge: Column, k: int) -> tuple[Column, Column]:
    first, last, back = packed_prefix(edge, k, k - 1), packed_suffix(edge, k - 1), packed_reverse_complement(node, k - 1)
    return (last == node) | (first == back), (first == node) | (last == back)


def side(node: Column, edge: Column, k: int) -> Column:
    """L, R or D (duplex, both sides) for an edge at a node, null if it isn't there."""
    left, right = _touches(node, edge, k)
    return F.when(left & right, "D").when(left, "L").when(right, "R")


def left_node(edge: Column, k: int) -> Column:
    return packed_canonical(packed_prefix(edge, k, k - 1), k - 1)


def right_node(edge: Column, k: int) -> Column:
    return packed_canonical(packed_suffix(edge, k - 1), k - 1)


def is_loop(edge: Column, k: int) -> Column:
    return left_node(edge, k) == right_node(edge, k)


def packed_can_have_duplex_edges(node: Column, k: int) -> Column:
    """node has k - 1 bases."""
    n = k - 1
    unit = sum(1 << (2 * i) for i in range(n))
    return (node == packed_reverse_complement(node, n)) | node.isin(*[unit * b for b in range(4)])
