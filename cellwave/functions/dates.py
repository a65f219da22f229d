"""Column functions for the spellings of dates in traffic exports. None of them throws, in ANSI mode either."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellwave.functions.freedates import BLANKS, parse_free_date

#: French month names, January first (fixed values).
MONTHS = ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre")
ACCENTED, PLAIN = "éèêëàâäîïôöûüùç", "eeeeaaaiioouuuc"


def month_number(name: Column, accents: bool = False) -> Column:
    """Number of a French month, in any case; with ``accents`` only if they are spelt. Null for other words."""
    word = F.lower(name)
    if not accents:
        word = F.translate(word, ACCENTED, PLAIN)
    names = [m if accents else m.translate(str.maketrans(ACCENTED, PLAIN)) for m in MONTHS]
    table = F.create_map(*[F.lit(x) for i, m in enumerate(names, 1) for x in (m, i)])
    return F.try_element_at(table, word)


def _token(tokens: Column, at: int) -> Column:
    return F.try_element_at(tokens, F.lit(at))


def _whole(c: Column) -> Column:
    return F.when(c.rlike(r"^[+-]?\d{1,9}$"), c).try_cast("int")


def french_date_to_iso(value: Column) -> Column:
    """``lundi 18 juin 2018`` to ``2018-06-18``; a text of under four words or with no such date stays as it is.

    Day, month and year are the last three words. The day's range is not
    checked, accents and case do not matter.
    """
    tokens = F.split(F.trim(F.regexp_replace(value, BLANKS, " ")), " ")
    day, month, year = _whole(_token(tokens, -3)), month_number(_token(tokens, -2)), _whole(_token(tokens, -1))
    iso = F.format_string("%04d-%02d-%02d", year, month, day)
    good = (F.size(tokens) >= 4) & day.isNotNull() & month.isNotNull() & year.isNotNull()
    return F.when(good, iso).otherwise(value)


#: Day-first formats tried after the French one.
DAY_FIRST = ("dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "d/M/yyyy H:m", "dd/MM/yyyy", "d/M/yyyy", "dd-MM-yyyy", "d-M-yyyy", "dd.MM.yyyy")


def parse_french_date(value: Column) -> Column:
    """A timestamp from ``weekday d month yyyy`` with the month's accents spelt, else from a listed day-first or an ISO form, else by ``parse_free_date``, else null."""
    text = F.trim(F.regexp_replace(value, BLANKS, " "))
    tokens = F.split(text, " ")
    month = month_number(_token(tokens, 3), accents=True)
    spelt = F.format_string("%s/%02d/%s", F.lpad(_token(tokens, 2), 2, "0"), month, _token(tokens, 4))
    short = F.length(_token(tokens, 2)) <= 2
    french = F.when((F.size(tokens) == 4) & month.isNotNull() & short, F.try_to_timestamp(spelt, F.lit("dd/MM/yyyy")))
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text).try_cast("timestamp")
    return F.coalesce(french, *[F.try_to_timestamp(text, F.lit(f)) for f in DAY_FIRST], iso, parse_free_date(text))


#: Forms of a slash date: month first where that is a date.
SLASHED = ("M/d/yyyy HH:mm:ss", "M/d/yyyy HH:mm", "M/d/yyyy", "d/M/yyyy HH:mm:ss", "d/M/yyyy HH:mm", "d/M/yyyy")


def normalize_timestamp(value: Column) -> Column:
    """An ISO text: French dates by ``french_date_to_iso`` where there is a letter, other known forms as date and time, the rest unchanged."""
    text = F.trim(value)
    iso = F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), text).try_cast("timestamp")
    compact = F.when(text.rlike(r"^\d{8}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd")))
    stamp = F.coalesce(iso, *[F.try_to_timestamp(text, F.lit(f)) for f in SLASHED], compact)
    whole = F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(stamp, "SSSSSS")
    written = F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))
    return F.when(text.rlike(r"\p{L}"), french_date_to_iso(text)).otherwise(F.coalesce(written, text))


def parse_slot_timestamp(value: Column, form: str = "dd/MM/yyyy HH:mm") -> Column:
    """The slot stamp of an export, day first always; null where it is none."""
    return F.try_to_timestamp(value, F.lit(form))
