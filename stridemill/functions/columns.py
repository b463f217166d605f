"""Derived measures as plain Spark column expressions.

Every function takes column names (or columns) and returns a ``Column`` built from
JVM-side functions, so whole rows stay inside generated code.  Results do not depend
on the ANSI setting: bad input gives NULL instead of an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# Text the derived columns must carry.
RUN = "Run"
MORNING, AFTERNOON, EVENING = "manhã", "tarde", "noite"
HIGH, MODERATE, LIGHT = "alta", "moderada", "leve"
LONG, MEDIUM, SHORT = "longa", "média", "curta"
ISO_UTC = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def as_column(value: ColumnOrName) -> Column:
    return F.col(value) if isinstance(value, str) else value


def iso_date(text: ColumnOrName, pattern: str = ISO_UTC) -> Column:
    """Calendar date of an ISO-8601 text; NULL when it does not parse."""
    return F.to_date(F.try_to_timestamp(as_column(text), F.lit(pattern)))


def kilometres(metres: ColumnOrName, decimals: int = 2) -> Column:
    return F.round(as_column(metres) / F.lit(1000.0), decimals)


def km_per_hour(metres_per_second: ColumnOrName, decimals: int = 2) -> Column:
    return F.round(as_column(metres_per_second) * F.lit(3.6), decimals)


def minutes_per_km(seconds: ColumnOrName, metres: ColumnOrName, decimals: int) -> Column:
    """Pace; NULL for a zero distance."""
    minutes = as_column(seconds) / F.lit(60.0)
    return F.round(F.try_divide(minutes, as_column(metres) / F.lit(1000.0)), decimals)


def run_pace(seconds: ColumnOrName, metres: ColumnOrName, kind: ColumnOrName = "type",
             decimals: int = 2, only_for_run: bool = True, non_run_value: float | None = None) -> Column:
    """Pace of runs, ``non_run_value`` elsewhere; or of every positive distance."""
    pace = minutes_per_km(seconds, metres, decimals)
    if not only_for_run:
        return F.when(as_column(metres) > 0, pace)
    return F.when(as_column(kind) == RUN, pace).otherwise(F.lit(non_run_value).cast("double"))


def moving_pace(seconds: ColumnOrName, metres: ColumnOrName, decimals: int = 3,
                without_distance: float | None = 0.0) -> Column:
    """Pace of any activity; ``without_distance`` where there is no positive distance."""
    pace = minutes_per_km(seconds, metres, decimals)
    return F.when(as_column(metres) > 0, pace).otherwise(F.lit(without_distance).cast("double"))


def two_digits(number: Column) -> Column:
    """Whole number as text with at least two characters, like ``%02d``."""
    digits = number.cast("string")
    return F.when(number.between(0, 9), F.concat(F.lit("0"), digits)).otherwise(digits)


def hours_minutes_seconds(seconds: ColumnOrName) -> Column:
    """``HH:MM:SS`` of a duration; hours run past 24 and NULL stays NULL."""
    whole = as_column(seconds).cast("long")
    past_hour = whole % 3600
    hours = ((whole - past_hour) / 3600).cast("long")
    minutes = ((past_hour - past_hour % 60) / 60).cast("long")
    return F.concat(two_digits(hours), F.lit(":"), two_digits(minutes), F.lit(":"), two_digits(whole % 60))


def pace_clock(pace: ColumnOrName, carry: bool = True) -> Column:
    """``M:SS`` of a pace in decimal minutes.

    Seconds are rounded; 60 of them make a further minute.  ``carry=False`` leaves the
    60 standing, as the batch rebuild does.
    """
    value = as_column(pace)
    minutes = F.floor(value)
    seconds = F.round((value - minutes) * F.lit(60.0), 0).cast("int")
    if carry:
        minutes, seconds = minutes + F.when(seconds >= 60, 1).otherwise(0), seconds % 60
    return F.concat(minutes.cast("string"), F.lit(":"), two_digits(seconds))


def weekday(day: ColumnOrName, pattern: str = "E") -> Column:
    return F.date_format(as_column(day), pattern)


def local_timestamp(text: ColumnOrName, wall_time: bool = False) -> Column:
    """Timestamp of a local start text.

    An offset in the text shifts the value to the session zone; ``wall_time=True`` drops
    the offset first and keeps the clock reading the athlete saw.
    """
    value = as_column(text)
    if wall_time:
        value = F.regexp_replace(value.cast("string"), r"(Z|[+-]\d{2}:?\d{2})$", "")
    return F.try_to_timestamp(value)


def day_period(moment: Column) -> Column:
    hour = F.hour(moment)
    return F.when(hour < 12, MORNING).when(hour < 18, AFTERNOON).otherwise(EVENING)


def calorie_class(calories: ColumnOrName, null_is_light: bool = False) -> Column:
    """Effort class; NULL calories give NULL, or the light class in the SQL report's reading."""
    value = as_column(calories)
    graded = F.when(value >= 600, HIGH).when(value >= 300, MODERATE)
    return graded.otherwise(LIGHT) if null_is_light else graded.when(value < 300, LIGHT)


def duration_class(clock: ColumnOrName) -> Column:
    """Duration class of an ``HH:MM:SS`` text; a day and more is long, NULL is short."""
    parts = F.split(as_column(clock), ":")
    minutes = (F.try_element_at(parts, F.lit(1)).try_cast("long") * 60
               + F.try_element_at(parts, F.lit(2)).try_cast("long"))
    return F.when(minutes >= 60, LONG).when(minutes >= 30, MEDIUM).otherwise(SHORT)


def all_reasons(rules: dict[str, str]) -> Column:
    """Names of every rule a row breaks, in rule order; NULL when it breaks none."""
    hits = F.array_compact(F.array(*[F.when(F.expr(test), F.lit(name)) for name, test in rules.items()]))
    return F.when(F.size(hits) > 0, hits)


def epoch_seconds(value: ColumnOrName, is_text: bool = False) -> Column:
    moment = F.try_to_timestamp(as_column(value), F.lit("yyyy-MM-dd HH:mm:ss")) if is_text else as_column(value)
    return F.unix_timestamp(moment)
