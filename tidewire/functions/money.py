"""Pay written in free text, as column expressions."""

from __future__ import annotations

import re
import string

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.text import clean_text, let

# Words of a range, words before a unit, units and what they are called.
TO = ("-", "–", "to")
EACH = ("/", "per", "an", "a")
UNITS = {"hour": "hour", "hr": "hour", "year": "year", "yr": "year", "annum": "annum", "month": "month", "week": "week", "day": "day"}

NUMBER = r"[0-9][0-9,]*(?:\.[0-9]+)?"
def _money(number: Column) -> Column:
    """A number as "$1,234.50"; null for what is none."""
    return F.concat(F.lit("$"), F.format_number(number.try_cast("double"), 2))


def first_pay(text: str | None) -> str | None:
    """The first amount in a text, with the end of its range and its unit if they follow, as it is written but for white space; None without one."""
    single = " ".join((text or "").split())
    words = [(m[0].lower(), m.start(), m.end()) for m in re.finditer(rf"{NUMBER}|[^\W\d_]+|[^\w\s]", single)]
    number = lambda k: k < len(words) and words[k][0][0] in string.digits
    for k, (word, start, _) in enumerate(words):
        if word != "$" or not number(k + 1):
            continue
        last = k + 1
        if last + 1 < len(words) and words[last + 1][0] in TO:
            other = last + 2 + (last + 2 < len(words) and words[last + 2][0] == "$")
            last = other if number(other) else last
        end = words[last][2]
        if last + 2 < len(words) and words[last + 1][0] in EACH:
            each, at, _ = words[last + 2]
            unit = max((u for u in UNITS if each.startswith(u)), key=len, default="")
            end = at + len(unit) if unit else end
        return single[start:end]
    return None


def find_pay(text: Column) -> Column:
    """`first_pay` as a column: only texts with a currency sign leave the JVM."""

    @F.pandas_udf("string")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(first_pay)

    return F.when(text.contains("$"), found(F.when(text.contains("$"), text)))


def tidy_pay(value: Column) -> Column:
    """An amount with currency, thousands and cents, the unit behind "per". Without an amount the unit goes, and words all in capitals are written as a sentence."""
    words = F.split(F.regexp_replace(clean_text(value), r"/ ?(?=\w+$)", " / "), " +")
    names = F.create_map(*(F.lit(x) for kv in UNITS.items() for x in kv))

    def told(w: Column) -> Column:
        unit = F.when(F.size(w) > 1, names[F.lower(F.try_element_at(w, F.lit(-1)))])
        rest = F.when(unit.isNull(), w).otherwise(F.slice(w, 1, F.size(w) - 1))
        each = F.when(unit.isNotNull() & (F.size(rest) > 1) & F.lower(F.try_element_at(rest, F.lit(-1))).isin(*EACH), F.slice(rest, 1, F.size(rest) - 1)).otherwise(rest)
        text = F.trim(F.array_join(each, " "), F.lit(" ,-"))
        return let(text, lambda t: F.when(t.rlike(r"\d"), F.concat(_priced(t), F.coalesce(F.concat(F.lit(" per "), unit), F.lit("")))).otherwise(_sentence(t)))

    return F.nullif(let(words, told), F.lit(""))


def _priced(text: Column) -> Column:
    """A text with its numbers written as money, unless it names the currency already."""
    between, numbers = F.split(text, NUMBER, -1), F.transform(F.regexp_extract_all(text, F.lit(f"({NUMBER})")), lambda n: _money(F.replace(n, F.lit(","))))
    return F.when(text.contains("$"), text).otherwise(F.array_join(F.zip_with(between, numbers, lambda b, n: F.concat(b, F.coalesce(n, F.lit("")))), ""))


def _sentence(text: Column) -> Column:
    shouted = text.contains(" ") & (text == F.upper(text)) & (text != F.lower(text))
    return F.when(shouted, F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 30)))).otherwise(text)


#: Codes of pay intervals.
INTERVALS = {"PA": "per year", "PH": "per hour", "PM": "per month", "BW": "every two weeks", "PW": "per week", "PD": "per day"}


def pay_range(low: Column, high: Column, interval: Column) -> Column:
    """"$1,000.00 to $2,000.00 per year" from two numbers and an interval's code; null without an amount."""
    amount = lambda x: F.when(x.try_cast("double") != 0, _money(x))
    amounts = F.array_distinct(F.array_compact(F.array(amount(low), amount(high))))
    words = F.create_map(*(F.lit(x) for kv in INTERVALS.items() for x in kv))
    return F.when(F.size(amounts) > 0, F.concat_ws(" ", F.array_join(amounts, " to "), words[interval]))
