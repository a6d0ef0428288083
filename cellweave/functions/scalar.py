"""Scalar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def num(x: float) -> Column:
    return F.lit(float(x))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, num(lo)), num(hi))


def ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    """a / b as double; ``empty`` where b is 0 or either is null."""
    r = F.try_divide(a.cast("double"), b.cast("double"))
    return r if empty is None else F.coalesce(r, num(empty))


def complexity(genes: Column, counts: Column) -> Column:
    """log10(genes) / log10(counts); 0 where it isn't finite, so for counts of 1 and for empty cells."""
    ok = (genes > 0) & (counts > 0) & (counts != 1)
    return F.when(ok, F.log10(genes.cast("double")) / F.log10(counts.cast("double"))).otherwise(num(0))


def log_normal(value: Column, total: Column, target: float = 1e4) -> Column:
    """log1p(value * target / total), 0 for an empty total."""
    return F.when(total > 0, F.log1p(value * num(target) / total)).otherwise(num(0))


def per_million(value: Column, total: Column) -> Column:
    return value / F.greatest(total, num(1)) * num(1e6)


def bin_of(x: Column, lo: Column, hi: Column, n: int) -> Column:
    """1-based bin of n equal bins on [lo, hi], the last closed on the right."""
    width = hi - lo
    return F.when(width > 0, F.least(F.floor((x - lo) / width * n).cast("int") + 1, F.lit(n))).otherwise(F.lit(1))


def truncated(x: Column) -> Column:
    return x.cast("int")


def rounded(x: Column) -> Column:
    """To the nearest integer, halves to even."""
    return F.bround(x, 0).cast("int")


def steps(x: Column, cuts: list[tuple[float, object]], last: object) -> Column:
    """The value of the first cut that x lies below."""
    out = None
    for limit, value in cuts:
        out = F.when(x < limit, F.lit(value)) if out is None else out.when(x < limit, F.lit(value))
    return out.otherwise(F.lit(last))


def auto_resolution(cells: Column) -> Column:
    """Clustering resolution for a number of cells."""
    return steps(cells, [(5_000, 0.8), (50_000, 0.5), (500_000, 0.3)], 0.2)


def stars(p: Column) -> Column:
    """Significance marks of a p value."""
    return steps(p, [(0.001, "***"), (0.01, "**"), (0.05, "*")], "ns")


def human_size(size: Column) -> Column:
    out = None
    for k, unit in enumerate(("B", "KB", "MB", "GB")):
        text = F.format_string(f"%.1f {unit}", size / num(1024.0**k))
        out = F.when(size < 1024 ** (k + 1), text) if out is None else out.when(size < 1024 ** (k + 1), text)
    return out.otherwise(F.format_string("%.1f TB", size / num(1024.0**4)))


def canonical_id(text: Column) -> Column:
    """The number in ``7``, ``cell_7``, ``roi__cell_7`` and ``7.0``; null for anything else."""
    digits = F.regexp_extract(text, r"^(?:.*__)?(?:cell_)?(\d+)(?:\.0+)?$", 1)
    return F.when(digits != "", digits.cast("long"))


def trailing_number(text: Column) -> Column:
    digits = F.regexp_extract(text, r"(\d+)$", 1)
    return F.when(digits != "", digits.cast("long"))


def lookup(key: Column, mapping: dict, default) -> Column:
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(default))


def barcode(n: Column, length: int = 16) -> Column:
    """Sixteen bases for a number: its base-4 digits, then the suffix -1; distinct for distinct numbers."""
    digits = F.lpad(F.conv(n.cast("string"), 10, 4), length, "0")
    return F.concat(F.translate(digits, "0123", "ACGT"), F.lit("-1"))


def quality_label(rate: Column, good: float = 0.03, marginal: float = 0.01) -> Column:
    return F.when(rate.isNull(), F.lit("unknown")).when(rate >= good, F.lit("good")).when(rate >= marginal, F.lit("marginal")).otherwise(F.lit("poor"))
