"""A small grammar of free-form dates, day first, as column expressions.

A text is cut into a time of day and the words and numbers that are left. Words
are names of months (English, in full or short), names of weekdays and filling
words; every other word makes the text no date. Which of the numbers is the
day, the month and the year follows from their sizes and from where a month's
name stands.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of blanks, with the two no-break spaces that exports hold (fixed values).
BLANKS = "[\\s\u00a0\u202f]+"
#: English names of months and weekdays (fixed values); each is known by its first three letters too, September by four.
MONTH_NAMES = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
#: Words that say nothing about a date (fixed values).
FILLING = ("at", "on", "and", "ad", "of")
#: A time of day after the start, a blank or a T: hours and minutes, seconds, their fraction, am or pm; hours with am or pm alone; hours with an h.
CLOCK = r"(?:^|[ ,]|(?<=\d)t)(?:\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d{1,9})?)?(?: ?[ap]m)?|\d{1,2} ?[ap]m|\d{1,2}h(?:\d{2}m?)?)(?=$|[ ,;])"
#: The same taken apart: hour, minute, second, fraction, half of the day.
HANDS = r"(\d{1,2})[:h]?(\d{2})?:?(\d{2})?[.,]?(\d{1,9})? ?(?:([ap])m)?"


def given(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _months() -> Column:
    named = {name: i for i, name in enumerate(MONTH_NAMES, 1)} | {name[:3]: i for i, name in enumerate(MONTH_NAMES, 1)} | {"sept": 9}
    return F.create_map(*[F.lit(x) for pair in named.items() for x in pair])


def _resolve(p: Column, this_year: Column) -> Column:
    """(year, month, day) from three parts, each with its number, its digits and whether it was a month's name."""
    a, b, c = (F.get(p, i) for i in range(3))
    # the two numbers besides a month's name
    x, y = F.when(a["named"], b).otherwise(a), F.when(a["named"] | b["named"], c).otherwise(b)
    named = F.when(a["named"], a["n"]).when(b["named"], b["n"]).when(c["named"], c["n"])
    leads = F.when(c["named"], y["n"] <= 31).otherwise(x["n"] > 31)
    leads = leads | (x["digits"] > 2)
    year_first = (a["n"] > 31) | (a["digits"] > 2)
    day_second = c["n"] <= 12
    day_leads = (a["n"] > 12) | (b["n"] <= 12)

    def pick(of_named: Column, first: Column, second: Column, third: Column, fourth: Column) -> Column:
        plain = F.when(year_first, F.when(day_second, first).otherwise(second)).otherwise(F.when(day_leads, third).otherwise(fourth))
        return F.when(named.isNotNull(), of_named).otherwise(plain)

    year = pick(F.when(leads, x).otherwise(y), a, a, c, c)
    month = pick(F.struct(named.alias("n"), F.lit(0).alias("digits"), F.lit(True).alias("named")), c, b, b, a)
    day = pick(F.when(leads, y).otherwise(x), b, c, a, b)

    def full(s: Column) -> Column:
        near = s["y"]["n"] + F.floor(this_year / 100).cast("int") * 100
        near = F.when(near >= this_year + 50, near - 100).when(near < this_year - 50, near + 100).otherwise(near)
        return F.struct(F.when(s["y"]["digits"] > 2, s["y"]["n"]).otherwise(near).alias("y"), s["m"].alias("m"), s["d"].alias("d"))

    return given(F.struct(year.alias("y"), month["n"].alias("m"), day["n"].alias("d")), full)


def parse_free_date(value: Column, this_year: Column | None = None) -> Column:
    """A timestamp from a free-form date, else null; never throws.

    Read: ``18 June 2018``, ``June 18, 2018``, ``Mon 18th of Jun 2018 at 3:07
    pm``, ``18-Jun-18``, ``18.6.2018 7h05``, ``2018/06/18``, ``20180618``,
    ``201806181030`` and what lies between. Of three numbers the first is the
    day unless only the second can be; after a year in front comes the day too
    where the last can be a month. Years of two digits are those within 50
    years of ``this_year`` (by default the current one). A text that lacks day,
    month or year, holds any other word or sign, or names no date of the
    calendar is null, as are null and empty texts.
    """
    this_year = F.year(F.current_date()) if this_year is None else this_year
    text = F.trim(F.regexp_replace(F.lower(value), BLANKS, " "))
    text = F.regexp_replace(text, r"^(\d{8})(\d{2})(\d{2})$", "$1 $2:$3")
    text = F.regexp_replace(text, r"^(\d{8})(\d{2})(\d{2})(\d{2})$", "$1 $2:$3:$4")
    cut = given(text, lambda t: F.struct(F.regexp_replace(t, CLOCK, " ").alias("rest"), F.regexp_extract(t, CLOCK, 0).alias("clock")))

    def part(w: Column) -> Column:
        month = F.try_element_at(_months(), w)
        n = F.coalesce(month, F.when(w.rlike(r"^\d{1,4}$"), w).try_cast("int"))
        return F.struct(n.alias("n"), F.length(w).alias("digits"), month.isNotNull().alias("named"))

    def date(rest: Column) -> Column:
        bare = F.regexp_replace(rest, r"(\d)(?:st|nd|rd|th)(?!\p{L})", "$1")
        bare = F.regexp_replace(bare, r"^(\D*)(\d{4})(\d{2})(\d{2})(\D*)$", "$1 $2 $3 $4 $5")
        words = F.filter(F.regexp_extract_all(bare, F.lit(r"\d+|\p{L}+"), 0), lambda w: ~w.isin(*WEEKDAYS, *[d[:3] for d in WEEKDAYS], *FILLING))
        whole = ~rest.rlike(r"[^\p{L}\d .,;/'-]")
        return given(F.transform(words, part), lambda p: F.when(whole & (F.size(p) == 3) & ~F.exists(p, lambda w: w["n"].isNull()), _resolve(p, this_year)))

    def hand(clock: Column, group: int) -> Column:
        return F.regexp_extract(clock, HANDS, group)

    def hour(clock: Column) -> Column:
        """0 without a time of day; null for an hour that the half of a day has not."""
        h = F.coalesce(hand(clock, 1).try_cast("int"), F.lit(0))
        return given(F.struct(h.alias("h"), hand(clock, 5).alias("half")), lambda s: F.when(s["half"] == "", s["h"]).when((s["h"] >= 1) & (s["h"] <= 12), s["h"] % 12 + F.when(s["half"] == "p", 12).otherwise(0)))

    def spelt(s: Column) -> Column:
        rest = [F.coalesce(hand(s["clock"], g).try_cast("int"), F.lit(0)) for g in (2, 3)]
        fraction = F.rpad(F.substring(hand(s["clock"], 4), 1, 6), 6, "0")
        stamp = given(
            F.struct(date(s["rest"]).alias("d"), hour(s["clock"]).alias("h")),
            lambda x: F.when(x["d"].isNotNull() & x["h"].isNotNull(), F.format_string("%04d-%02d-%02d %02d:%02d:%02d.%s", x["d"]["y"], x["d"]["m"], x["d"]["d"], x["h"], *rest, fraction)),
        )
        return F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS"))

    return given(cut, spelt)
