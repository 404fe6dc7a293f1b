"""Dates written as text, in whatever forms a column has.

A value is brought to one spelling (no weekday, zone, commas or repeated blanks; month names as three letters) and its shape is taken: digits
and names collapsed, separators kept. A histogram of the date-like shapes, a handful a column, decides which patterns its
parser gets, and whether the day or the month stands first where both are numbers.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How months, weekdays and zones are written.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
LONGER = "uary|ruary|ch|il|e|y|ust|tember|t|ober|ember"
WEEKDAY = r"(?i)^(mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+"
ZONE = r"(?i)(?<=\d:\d\d|\d:\d\d\.\d{1,9}|T\d{6}|[AP]M)\s*(Z|UTC|GMT|[+-]\d\d:?\d\d)$"

#: What every text ends with that ``ZONE`` matches.
ZONE_END = r"(?i)(Z|UTC|GMT|[+-]\d\d:?\d\d)$"

MONTH = "(?i)\\b(" + "|".join(MONTHS) + f")(?:{LONGER})?\\b\\.?"
#: Shapes of dates: Y year, 9 a number of one or two digits, D eight digits, b month name; then of times: t six digits, f fraction, p AM/PM.
DATE = r"(Y[-/.]9[-/.]9|9[-/.]9[-/.][Y9]|D|Y[-/.]9|b 9 Y|9[- ]b[- ][Y9]|b[- ]Y|Y[- ]b[- ]9)"
TIME = r"((?: |T)(?:9:9(?::9f?)?(?: ?p)?|9 ?p)|Tt)?"
SHAPE = f"^{DATE}{TIME}$"


def spelling(c: Column) -> Column:
    """One spelling for the ways to write a date."""
    t = F.regexp_replace(F.trim(c), WEEKDAY, "")
    # The cheap test first: most texts end without a zone.
    t = _bound(t, lambda t: F.when(t.rlike(ZONE_END), F.regexp_replace(t, ZONE, "")).otherwise(t))
    t = F.regexp_replace(t, r"[,\s]+", " ")
    t = F.regexp_replace(t, r"(?i)(?=[snrt])(?<=\d)(st|nd|rd|th)\b", "")
    t = F.regexp_replace(t, r"(?i)(?<=\d) ?([ap])\.?m\.?$", " $1m")
    t = F.regexp_replace(t, MONTH, "$1")
    return F.regexp_replace(t, r"(:\d\d\.\d{6})\d+", "$1")


def shape(spelled: Column) -> Column:
    """The shape of a spelled date: two shapes are equal if one pattern reads both."""
    t = F.regexp_replace(spelled, "(?i)(?<![a-z])(?=[a-z])(" + "|".join(MONTHS) + ")(?![a-z])", "b")
    for form, letter in ((r"(?i)\b[AP]M$", "p"), (r"(:\d\d)\.\d{1,6}", "$1f"), (r"T\d{6}$", "Tt"), (r"\d{8}", "D"), (r"\d{4}", "Y"), (r"\d{1,2}", "9")):
        t = F.regexp_replace(t, form, letter)
    return t


def patterns(form: str, day_first: bool, month_first: bool) -> list[str]:
    """Patterns for a shape, the likelier first; two where the day and the month are numbers and both orders occur."""
    date, time = re.fullmatch(SHAPE, form).groups()
    seps = re.findall(r"[-/. ]", date)
    fields = re.findall(r"[Y9Db]", date)
    if date == "D":
        orders = [["yyyyMMdd"]]
    elif "b" in fields:
        orders = [[{"Y": "yyyy", "b": "MMM", "9": "d"}[x] if x != "9" or i != 2 or "Y" in fields else "yy" for i, x in enumerate(fields)]]
    elif fields[0] == "Y":
        orders = [["yyyy", "M", "d"][: len(fields)]]
    else:
        year = "yyyy" if fields[2] == "Y" else "yy"
        days, months = ["d", "M", year], ["M", "d", year]
        orders = [days] if day_first and not month_first else [months] if month_first and not day_first else [months, days]
    clock = ""
    if time:
        lead = "'T'" if time[0] == "T" else " "
        body = time[1:]
        if body == "t":
            clock = lead + "HHmmss"
        else:
            hour = "h" if body.endswith("p") else "H"
            clock = lead + hour + {0: "", 1: ":m", 2: ":m:s"}[body.count(":")] + ("[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]" if "f" in body else "")
            clock += (" a" if " p" in body else "a") if body.endswith("p") else ""
    return ["".join(x for pair in zip(o, [*seps, ""]) for x in pair) + clock for o in orders]


def forms(df: DataFrame, columns: dict[str, Column]) -> dict[str, list[tuple[str, list[str]]]]:
    """For each column the shapes that occur, with their patterns: one job, and as many rows as there are shapes."""
    if not columns:
        return {}
    each = []
    spelled = df.select(*[spelling(c).alias(f"t{i}") for i, c in enumerate(columns.values())])  # taken once a value
    for i in range(len(columns)):
        t = F.col(f"t{i}")
        first, second = (F.try_element_at(F.split(t, "[-/. ]"), F.lit(k)).try_cast("int") for k in (1, 2))
        each.append(F.struct(F.lit(i).alias("i"), shape(t).alias("shape"), first.alias("first"), second.alias("second")))
    seen = (spelled.select(F.inline(F.array(*each))).where(F.col("shape").rlike(SHAPE)).groupBy("i", "shape")
            .agg(F.max("first").alias("first"), F.max("second").alias("second")).collect())
    out: dict[str, list[tuple[str, list[str]]]] = {}
    for i, c in enumerate(columns):
        mine = sorted((r for r in seen if r.i == i), key=lambda r: r["shape"])
        # A number over twelve in any shape with the same separator tells the order in all of them.
        big: dict[str, list[bool]] = {}
        for r in mine:
            if r["shape"][0] == "9" and "b" not in r["shape"]:
                at = big.setdefault(r["shape"][1], [False, False])
                at[0] |= (r["first"] or 0) > 12
                at[1] |= (r["second"] or 0) > 12
        out[c] = []
        for r in mine:
            days, months = big.get(r["shape"][1:2], [False, False])
            if not days and not months:  # undecided: points mean day first, other signs month first
                days, months = r["shape"][1:2] == ".", r["shape"][1:2] != "."
            out[c].append((r["shape"], patterns(r["shape"], days, months)))
    return out


def parse(c: Column, found: list[tuple[str, list[str]]]) -> Column:
    """Clock time of a text date by the column's forms; an offset in the text is dropped, not applied."""
    if not found:
        return F.lit(None).cast("timestamp_ntz")
    def by_shape(t: Column, of: Column) -> Column:
        read = [(s, F.coalesce(*[F.try_to_timestamp(t, F.lit(p)) for p in ps])) for s, ps in found]
        return reduce(lambda cond, sp: cond.when(of == sp[0], sp[1]), read[1:], F.when(of == read[0][0], read[0][1]))

    # Both are taken once a value, however many forms there are.
    value = _bound(spelling(c), lambda t: _bound(shape(t), lambda of: by_shape(t, of)))
    return value.cast("timestamp_ntz")


def _bound(c: Column, use) -> Column:
    """``use(c)`` with ``c`` evaluated once."""
    return F.get(F.transform(F.array(c), use), F.lit(0))
