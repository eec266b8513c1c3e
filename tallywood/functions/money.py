"""Money, dates, keys and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_money(raw: Column, thousands: str = ",", decimal: str = ".") -> Column:
    """A signed amount as DECIMAL(18,4), null where the text is none.

    Currency signs go first, so that a minus or parentheses behind one count; a
    minus on either end is a sign, one inside is an error.
    """
    import re

    # Each step takes the one before it once: a text is read by four patterns, wherever the amount is used.
    kept = F.regexp_replace(F.translate(raw, "−", "-"), r"[^0-9\-()" + re.escape(thousands + decimal) + "]", "")
    signed = F.regexp_replace(F.regexp_replace(kept, r"^\((.*)\)$", "-$1"), r"^(?:-+(.*?)-*|(.*?)-+)$", "-$1$2")
    plain = F.replace(signed, F.lit(thousands), F.lit("")) if thousands else signed
    plain = F.replace(plain, F.lit(decimal), F.lit(".")) if decimal not in ("", ".") else plain
    return F.regexp_extract(plain, r"^-?(?:\d+\.?\d*|\.\d+)$", 0).try_cast("decimal(18,4)")


_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def parse_date(raw: Column) -> Column:
    """ISO, "Jan 5, 2025" or dd.mm.yyyy; null otherwise."""
    s = F.trim(raw)
    # A text is turned into ISO, which casts without a formatter; what has none of the shapes casts to null.
    italian, english = r"^(\d{2})\.(\d{2})\.(\d{4})$", r"^([A-Za-z]{3,9}) (\d{1,2}), (\d{4})$"
    months = F.create_map(*[F.lit(x) for i, m in enumerate(_MONTHS, 1) for name in sorted({m, m[:3]}) for x in (name, f"{i:02}")])
    iso = F.when(F.length(s) == 10, F.when(F.substring(s, 5, 1) == "-", F.regexp_extract(s, r"^\d{4}-\d{2}-\d{2}$", 0)).when(F.substring(s, 3, 1) == ".", F.regexp_replace(F.regexp_extract(s, italian, 0), italian, "$3-$2-$1")))
    named = F.concat(F.regexp_extract(s, english, 3), F.lit("-"), F.try_element_at(months, F.lower(F.substring_index(s, " ", 1))), F.lit("-"), F.lpad(F.regexp_extract(s, english, 2), 2, "0"))
    return F.coalesce(iso, named).try_cast("date")


def parse_day_first(raw: Column) -> Column:
    """dd/mm/yyyy, dd.mm.yyyy or dd-mm-yyyy."""
    s = F.regexp_replace(F.trim(raw), r"[.\-]", "/")
    day = F.regexp_extract(s, r"^\d{1,2}/\d{1,2}/\d{4}", 0)
    return F.when(day != "", F.regexp_replace(day, r"^(\d+)/(\d+)/(\d+)$", "$3-$2-$1").try_cast("date")).otherwise(parse_date(raw))


def natural_key(account: Column, value_date: Column, amount: Column, occurrence: Column) -> Column:
    """SHA-256 of account, day, amount at two places and occurrence: the same for all formats of one statement."""
    return F.sha2(F.concat_ws("|", account, F.date_format(value_date, "yyyy-MM-dd"), amount.cast("decimal(18,2)").cast("string"), occurrence.cast("string")), 256)


def pair_id(a: Column, b: Column) -> Column:
    """16 hex digits for two keys, whichever comes first."""
    return F.substring(F.sha2(F.concat_ws("|", F.least(a, b), F.greatest(a, b)), 256), 1, 16)


def find_iban(text: Column) -> Column:
    """The first Italian IBAN in a text, spaces in it or not."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)\bIT\d{2}(?:\s*[A-Z0-9]){23}"), F.lit(0))
    compact = F.transform(found, lambda x: F.upper(F.regexp_replace(x, r"\s+", "")))
    return F.try_element_at(F.filter(compact, lambda x: x.rlike(r"^IT\d{2}[A-Z]\d{10}[A-Z0-9]{12}$")), F.lit(1))


def abi(iban: Column) -> Column:
    """The bank code of an Italian IBAN."""
    return F.when(iban.rlike(r"^IT\d{2}[A-Z]\d{5}"), F.substring(iban, 6, 5))


def account_id(label: Column, currency: Column, prefix: str) -> Column:
    """'Joint Account (EUR)' -> prefix_joint_eur."""
    from .text import normalize_desc

    slug = F.regexp_replace(F.trim(F.regexp_replace(normalize_desc(F.regexp_replace(label, r"\([A-Z]{3}\)", "")), "account", "")), " ", "_")
    return F.concat(F.lit(f"{prefix}_"), F.when(slug == "", "eur").otherwise(slug), F.lit("_"), F.lower(currency))


def quantize_ledger(x: Column) -> Column:
    """Two places, halves away from zero."""
    return F.round(x, 2)


def quantize_even(x: Column) -> Column:
    """Two places, halves to even."""
    return F.bround(x, 2)


def median_exact(values: Column) -> Column:
    """The median of an array of decimals, as a decimal: the mean of the middle two where there are two."""
    s, n = F.sort_array(values), F.size(values)
    low = F.try_element_at(s, ((n + 1) / 2).cast("int"))
    high = F.try_element_at(s, (n / 2).cast("int") + 1)
    return F.when(n % 2 == 1, low).otherwise((low + high) / 2)


def delta(now: Column, before: Column, points: bool = False) -> Column:
    """Change to one place: percent of the absolute previous value, or points; null without one."""
    change = (now - before) if points else (now - before) / F.abs(before) * 100
    return F.when(before.isNotNull() & (F.lit(points) | (before != 0)), F.round(change, 1))
