"""One official list row as one text: composing, parsing, schemes and short order names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The parts of a row's text.
SEPARATOR = " · "
SCHEMES = {"ISI": "Scheme-I ISI mark", "CRS": "Scheme-II CRS"}
ROW = r"^Product: ([\s\S]*?) · ([\s\S]*?)(?: — ([\s\S]*?))? · (Scheme-I ISI mark|Scheme-II CRS)(?: · ([\s\S]*))?$"
QUALITY_ORDER = r"(?i)(?:^|\d+\.\s*)([A-Z][\w&,/' -]{2,70}?)\s*\(\s*Quality Control\s*\)\s*(?:\(?Amendment\)?\s*)?Order,?\s*(\d{4})"
REGISTRATION_ORDER = r"(?i)Compulsory Registration\)?\s*Order,?\s*(\d{4})"


def scheme_of(title: Column) -> Column:
    """CRS before ISI, as the one's name holds the other's; null for neither."""
    return F.when(title.rlike(r"(?i)Scheme[- ]II\b|Compulsory Registration"), "CRS").when(title.rlike(r"(?i)Scheme[- ]I\b|ISI Mark"), "ISI")


def format_row(product: Column, numbers: Column, title: Column, scheme: Column, order: Column) -> Column:
    """The row's text: product, numbers with a title that differs from the product, scheme, order or status."""
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    named = (F.coalesce(title, F.lit("")) != "") & (F.trim(title) != F.trim(product))
    head = F.when(named, F.concat(numbers, F.lit(" — "), title)).otherwise(numbers)
    shown = F.when(F.coalesce(product, F.lit("")) != "", product).otherwise(title)
    mark = F.when(order.rlike("(?i)^de-?notified"), F.concat(F.lit("Status: "), order)).otherwise(F.concat(F.lit("Order: "), order))
    name = F.element_at(F.create_map(*[F.lit(x) for kv in SCHEMES.items() for x in kv]), scheme)
    parts = F.array(F.concat(F.lit("Product: "), shown), head, name, F.when(F.coalesce(order, F.lit("")) != "", mark))
    return F.array_join(F.transform(parts, flat), SEPARATOR)


def parse_row(text: Column) -> Column:
    """product, numbers, title, scheme, order, denotified of a row's text; null if it is none."""
    part = lambda i: F.regexp_extract(F.trim(text), ROW, i)
    order = part(5)
    return F.when(
        F.trim(text).rlike(ROW),
        F.struct(
            part(1).alias("product"), part(2).alias("numbers"), part(3).alias("title"),
            F.when(part(4) == SCHEMES["CRS"], "CRS").otherwise("ISI").alias("scheme"),
            F.regexp_replace(order, "^(Order|Status): ", "").alias("order"),
            (order.startswith("Status:") & order.rlike("(?i)de-?notified")).alias("denotified"),
        ),
    )


def order_short(order: Column) -> Column:
    """A short name of an order: "X QCO YYYY" or "CRS Order YYYY"; null if neither form is recognised."""
    name = F.trim(F.regexp_replace(F.regexp_extract(order, QUALITY_ORDER, 1), r"^\d+\.\s*", ""), F.lit(" ,.-"))
    quality = F.concat(name, F.lit(" QCO "), F.regexp_extract(order, QUALITY_ORDER, 2))
    registered = F.concat(F.lit("CRS Order "), F.regexp_extract(order, REGISTRATION_ORDER, 1))
    return F.when(order.rlike(QUALITY_ORDER), quality).when(order.rlike(REGISTRATION_ORDER), registered)
