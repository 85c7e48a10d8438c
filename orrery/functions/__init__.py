"""Column helpers with the engine's semantics, where they differ from Spark's defaults."""

from orrery.functions.aggregates import (  # noqa: F401
    avg, count, count_distinct, max_, min_, stddev_pop, stddev_samp, sum_, var_pop, var_samp,
)
from orrery.functions.scalar import (  # noqa: F401
    add_days, cast_format, concat_ws, date_trunc, days_between, decimal_divide, divide, extract, initcap, left, length, like,
    lpad, modulo, octet_length, position, right, rpad, safe_cast, shift_left, shift_right, substring, ticks_between, trim, wrapping,
)
