from gaugework.functions.numbering import numbered
from gaugework.functions.ordering import asc, desc, ordered, top_k
from gaugework.functions.quantiles import exact_percentiles, value_counts
from gaugework.functions.rounding import round_to
from gaugework.functions.time import (
    add_months,
    as_datetime,
    day_start,
    month_start,
    ntz,
    period_start,
    preset,
    seconds_between,
    trunc_to,
    utc_instant,
    utc_wall_clock,
)

__all__ = [
    "add_months",
    "as_datetime",
    "asc",
    "day_start",
    "desc",
    "exact_percentiles",
    "month_start",
    "ntz",
    "numbered",
    "ordered",
    "period_start",
    "preset",
    "round_to",
    "seconds_between",
    "top_k",
    "trunc_to",
    "utc_instant",
    "utc_wall_clock",
    "value_counts",
]
