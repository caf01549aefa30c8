"""Column functions for registry text: names, numbers, addresses, animal types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldhub import constants as K


def snake_names(names: list[str]) -> list[str]:
    return [n.strip().lower().replace(" ", "_") for n in names]


def first_present(columns: list[str], candidates: list[str]) -> str | None:
    """First candidate that the frame has; decided on the schema, so no data is read."""
    return next((c for c in candidates if c in columns), None)


def animal_count_columns(columns: list[str]) -> list[str]:
    """Columns that look like per-animal counts."""
    lowered = {c: c.lower() for c in columns}
    return [
        c
        for c, low in lowered.items()
        if any(word in low for word in K.ANIMAL_KEYWORDS)
        and not any(word in low for word in K.NON_ANIMAL_KEYWORDS)
    ]


def to_number(text: Column) -> Column:
    """Text to double; unreadable text and the word "nan" are null."""
    value = text.try_cast("double")
    return F.when(~F.isnan(value), value)


def to_count(text: Column) -> Column:
    """Text to a whole number; unreadable or missing text counts as 0."""
    return F.coalesce(to_number(text).try_cast("bigint"), F.lit(0).cast("bigint"))


def trimmed(col: Column | None, default: str) -> Column:
    return F.lit(default) if col is None else F.trim(col)


def city_of(city_state_zip: Column) -> Column:
    return F.trim(F.split_part(city_state_zip, F.lit(","), F.lit(1)))


def zip_of(city_state_zip: Column) -> Column:
    digits = F.regexp_extract(city_state_zip, r"(\d{5})", 1)
    return F.when(digits != "", digits)


def zip5(zip_code: Column) -> Column:
    return F.substring(F.trim(zip_code), 1, 5)


def canonical_animal(raw: Column, extra: dict[str, str] | None = None) -> Column:
    """Alias lookup as one literal map; unknown names pass through in lower case.

    The default aliases leave registry names such as ``chickens_not_laying_hens``
    unmapped; pass ``extra`` to extend the table.
    """
    table = {**K.ANIMAL_ALIASES, **(extra or {})}
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    name = F.lower(F.trim(raw))
    known = F.try_element_at(F.create_map(*pairs), name)
    return F.when(raw.isNull() | (raw == ""), F.lit("unknown")).otherwise(F.coalesce(known, name))


def argmax_label(columns: dict[str, Column], best: Column) -> Column:
    """Name of the first column that reaches ``best``; 'unknown' when best is 0."""
    first = F.coalesce(*[F.when(c == best, F.lit(name)) for name, c in columns.items()])
    return F.when(best == 0, F.lit("unknown")).otherwise(first)


def return_url(text: Column) -> Column:
    """The returnURL value of an XML or JSON response, null when there is none."""
    xml = F.regexp_extract(text, r"<returnURL>(.*?)</returnURL>", 1)
    js = F.regexp_extract(text, r'"returnURL"\s*:\s*"(.*?)"', 1)
    return F.trim(F.coalesce(F.nullif(xml, F.lit("")), F.nullif(js, F.lit(""))))


def tagged_text(text: Column, tag: str) -> Column:
    """Text of the first ``<tag>…</tag>``, trimmed; null when absent or empty."""
    found = F.regexp_extract(text, rf"<{tag}>(.*?)</{tag}>", 1)
    return F.trim(F.nullif(found, F.lit("")))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def class_label(class_id: Column) -> Column:
    names = F.array(*[F.lit(n) for n in K.DETECTION_CLASSES])
    return F.coalesce(F.get(names, class_id), F.concat(F.lit("class_"), class_id.cast("string")))


def grouped(number: Column, digits: int = 0) -> Column:
    """Number with thousands commas, rounded half to even on its exact value."""
    return F.format_number(number, digits)


def fixed(number: Column, digits: int) -> Column:
    """The same without commas (``format_string`` would round halves up)."""
    return F.replace(grouped(number, digits), F.lit(","), F.lit(""))


def usable_address(address: Column) -> Column:
    text = F.lower(F.trim(address))
    return F.coalesce(~text.isin("", "nan", "unknown"), F.lit(False))
