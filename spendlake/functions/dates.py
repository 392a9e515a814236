"""Mail dates, canonical days and relative periods.

"Today" is always passed in, so that a run can be repeated.
"""

import datetime

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The header form that needs no lenient parsing.
_MAIL_DATE = (
    r"^(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun), )?"
    r"(\d{1,2} (?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) [1-9]\d{3})"
    r" (?:[01]\d|2[0-3]):[0-5]\d(?::[0-5]\d)?"
    r"(?: (?:[+-](?:[01]\d|2[0-3])[0-5]\d|GMT|UTC))?\z"
)
# The names of the months.
_MONTHS = (
    "january february march april may june july august september october november december"
).split()


def strict_mail_day(text: Column) -> Column:
    """ISO day of a well-formed mail date, as the sender wrote it; else NULL."""
    day = F.try_to_date(F.nullif(F.regexp_extract(text, _MAIL_DATE, 1), F.lit("")), "d MMM yyyy")
    return F.date_format(day, "yyyy-MM-dd")


def mail_day(text: Column, today: datetime.date) -> Column:
    """ISO day of any mail date; NULL where it is missing or makes no sense.

    Well-formed dates are read by Spark expressions. The rest go to a lenient
    parser, which takes parts that are missing from ``today``.
    """
    fast = strict_mail_day(text)
    rest = F.when(fast.isNull() & (text != ""), text)
    return F.coalesce(fast, _lenient_day(today)(rest))


def _lenient_day(today: datetime.date):
    default = datetime.datetime.combine(today, datetime.time())

    def one(text):
        import warnings

        from dateutil import parser

        if text is None:
            return None
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                return parser.parse(text, default=default).strftime("%Y-%m-%d")
        except Exception:
            return None

    @F.pandas_udf("string")
    def lenient(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return lenient


def canonical_day(text: Column) -> Column:
    """The day of ``YYYY-MM-DD`` text; NULL for any other text.

    For canonical text, order as text is order by day, so a bound on this
    column may stand beside the bound on the text.

    A cast takes other forms too; of ten characters, those without a dash at both
    places, and with a blank or a "T" at the end.
    """
    at = lambda i: F.substring(text, i, 1)
    plain = (F.length(text) == 10) & (at(5) == "-") & (at(8) == "-") & at(10).between("0", "9")
    return F.when(plain, text.try_cast("date"))


def after_lookback(day: Column, today: datetime.date, days: int = 90) -> Column:
    """Dated after ``today - days``; the boundary day itself is out."""
    return day > F.lit(today - datetime.timedelta(days=days))


def period_bounds(period: Column, today: Column) -> tuple[Column, Column]:
    """First and last ISO day of a relative period.

    ``last month`` is the previous calendar month, a month's name its most
    recent occurrence, and no period the 30 days up to today. Anything else
    has no bounds.
    """
    word = F.lower(F.trim(period))
    months = F.array(*[F.lit(m) for m in _MONTHS])
    number = F.array_position(months, word).cast("int")
    year = F.year(today) - F.when(number > F.month(today), 1).otherwise(0)
    named = F.make_date(year, F.when(number > 0, number), F.lit(1))
    previous = F.trunc(F.add_months(today, -1), "MM")
    none = F.coalesce(word, F.lit("")) == ""
    start = (
        F.when(none, F.date_sub(today, 30)).when(word == "last month", previous).otherwise(named)
    )
    end = (
        F.when(none, today)
        .when(word == "last month", F.last_day(previous))
        .otherwise(F.last_day(named))
    )
    return F.date_format(start, "yyyy-MM-dd"), F.date_format(end, "yyyy-MM-dd")
