"""What the quality flags of a record mean for publishing and review."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import REVIEW_ONLY_FLAGS, WITHHOLDING_FLAGS
from .text import col


def flag_array(names: list[str]) -> Column:
    return F.array(*[F.lit(n) for n in names])


def is_servable(flags: Column | str) -> Column:
    return ~F.arrays_overlap(col(flags), flag_array(WITHHOLDING_FLAGS))


def needs_review(flags: Column | str) -> Column:
    return F.arrays_overlap(col(flags), flag_array(WITHHOLDING_FLAGS + REVIEW_ONLY_FLAGS))


def withholding_flags(flags: Column | str) -> Column:
    return F.filter(col(flags), lambda f: f.isin(*WITHHOLDING_FLAGS))


def withholding_reason(flags: Column | str) -> Column:
    """The flags that withheld the record, in their order; never an advisory one."""
    kept = withholding_flags(flags)
    return F.when(F.size(kept) > 0, F.array_join(kept, ",")).otherwise("withheld")
