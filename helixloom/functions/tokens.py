"""Column functions on signed tokens (``H3+``) and on cycles of them (array<string>). All are built from Spark's array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def segment_of(token: Column) -> Column:
    return F.regexp_replace(token, "[+-]$", "")


def strand_of(token: Column) -> Column:
    return F.right(token, F.lit(1))


def flip(token: Column) -> Column:
    return F.concat(segment_of(token), F.translate(strand_of(token), "+-", "-+"))


def parse_cycle(text: Column) -> Column:
    """Split on , or ; and drop the closing token where it repeats the first."""
    t = F.filter(F.split(text, "[,;]"), lambda x: x != "")
    closed = (F.size(t) > 1) & (F.element_at(t, -1) == F.element_at(t, 1))
    return F.when(closed, F.slice(t, 1, F.size(t) - 1)).otherwise(t)


def rotate(tokens: Column, k: Column) -> Column:
    """The cycle from its k-th token (from 0) on."""
    return F.concat(F.slice(tokens, k + 1, F.size(tokens) - k), F.slice(tokens, F.lit(1), k))


def canonical_start(tokens: Column) -> Column:
    """Turn last tokens to the front until the first is a host segment and the last is not a host segment of a smaller number; cycles
    without host segments stay."""
    n = F.size(tokens)
    host = lambda t: F.substring(t, 1, 1) == "H"
    no = lambda t: F.regexp_extract(t, r"(\d+)", 1).try_cast("int")

    def stops(k):
        first, last = F.get(tokens, k), F.get(tokens, (k + n - 1) % n)
        return host(first) & ~(host(last) & (no(last) < no(first)))

    tried = F.transform(F.sequence(F.lit(0), n - 1), lambda k: (n - k) % n)
    good = F.filter(tried, stops)
    return F.when((n > 0) & (F.size(good) > 0), rotate(tokens, F.get(good, 0))).otherwise(tokens)


def reanchor(tokens: Column, seg: Column) -> Column:
    """Turn the cycle so that the first token of seg (either strand) comes first; unchanged where there is none."""
    at = F.array_position(F.transform(tokens, segment_of), seg).cast("int")
    return F.when(at > 1, rotate(tokens, at - 1)).otherwise(tokens)


def reverse_complement(tokens: Column) -> Column:
    return F.transform(F.reverse(tokens), flip)


def same_or_rc(a: Column, b: Column) -> Column:
    """1 the same, -1 the reverse complement, 0 neither."""
    return F.when(a == b, 1).when(a == reverse_complement(b), -1).otherwise(0)


def pair_key(a: Column, b: Column) -> Column:
    """``H1+,H3+``: two neighbouring tokens, as they stand or read from the other strand, whichever is smaller."""
    return F.least(F.concat_ws(",", a, b), F.concat_ws(",", flip(b), flip(a)))


def least_rotation(tokens: Column) -> Column:
    """The smallest rotation of a cycle (of one token or more; null tokens come first). Two candidates for its start run a common length
    on; at the first difference the worse one jumps past it. At most three steps a token, in memory linear in the cycle."""
    n = F.size(tokens)
    at = lambda x: F.get(tokens, x % n)
    less = lambda a, b: F.coalesce(a < b, a.isNull() & b.isNotNull())

    def step(s, _):
        i, j, k = s["i"], s["j"], s["k"]
        a, b = at(i + k), at(j + k)
        on_i = F.when(less(b, a), i + k + 1).otherwise(i)
        on_j = F.when(less(a, b), j + k + 1).otherwise(j)
        apart = F.struct(on_i.alias("i"), F.when(on_i == on_j, on_j + 1).otherwise(on_j).alias("j"), F.lit(0).alias("k"))
        further = F.struct(i.alias("i"), j.alias("j"), (k + 1).alias("k"))
        return F.when((i >= n) | (j >= n) | (k >= n), s).when(a.eqNullSafe(b), further).otherwise(apart)

    begin = F.struct(F.lit(0).alias("i"), F.lit(1).alias("j"), F.lit(0).alias("k"))
    found = F.aggregate(F.sequence(F.lit(1), 3 * n), begin, step, lambda s: F.least(s["i"], s["j"]))
    return rotate(tokens, found)


def equivalence_key(tokens: Column) -> Column:
    """The smallest of all rotations of the cycle and of its reverse complement."""
    both = F.transform(F.array(tokens, reverse_complement(tokens)), least_rotation)  # bound once each by the lambda
    return F.when(F.size(tokens) > 0, F.array_min(both)).otherwise(tokens)


def walk_signature(walk: Column) -> Column:
    return F.md5(F.concat(F.array_join(walk, ";"), F.lit(";")).cast("binary"))


def composition_signature(walk: Column) -> Column:
    return F.md5(F.regexp_replace(F.array_join(F.array_sort(walk), ";"), "[+-]", "").cast("binary"))


def usage(counts: Column) -> Column:
    """Sorted ``id:count`` list of an array of struct(id, n), or N/A."""
    text = F.array_join(F.array_sort(F.transform(counts, lambda c: F.concat_ws(":", c["id"].cast("string"), c["n"].cast("string")))), ",")
    return F.when(F.size(counts) > 0, text).otherwise("N/A")
