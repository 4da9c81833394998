"""Field transforms (D2-D8) and the type -> field-settings table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.scalars import js_trim, strict_number, url_origin

# Field type -> (attribute, transform); other types read trimmed text.
TYPE_SETTINGS = {
    "number": (None, "number"),
    "integer": (None, "number"),
    "boolean": (None, "boolean"),
    "url": ("href", "url"),
    "link": ("href", "url"),
    "image": ("src", None),
    "date": (None, "trim"),
    "datetime": (None, "trim"),
}
DEFAULT_SETTINGS = (None, "trim")


def truthy(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def root_relative(c: Column, page_url: Column) -> Column:
    """``/path`` gets the page origin, ``//host`` the page scheme; the rest stays."""
    scheme = F.regexp_extract(page_url, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    return F.when(c.startswith("//"), F.concat(scheme, c)).when(c.startswith("/"), F.concat(url_origin(page_url), c)).otherwise(c)


def apply_transform(c: Column, transform: str | Callable[[Column], Column] | None, page_url: Column | None = None) -> Column:
    """Transform truthy values only. Number and boolean give typed columns."""
    if transform is None:
        return c
    if callable(transform):
        return F.when(truthy(c), transform(c)).otherwise(c)
    if transform == "number":
        return F.when(truthy(c), strict_number(c))
    if transform == "boolean":
        return F.when(truthy(c), F.lit(True))
    page_url = page_url if page_url is not None else F.lit(None).cast("string")
    done = {
        "trim": js_trim(c),
        "lowercase": F.lower(c),
        "uppercase": F.upper(c),
        "url": F.coalesce(root_relative(c, page_url), c),
    }
    if transform not in done:
        return c
    return F.when(truthy(c), done[transform]).otherwise(c)


def transformed_by(name: Column, value: Column, page_url: Column) -> list[Column]:
    """``value``, ``num`` and ``flag`` of a transform that is named on the row; unknown names change nothing."""
    texts = value
    for known in ("trim", "lowercase", "uppercase", "url"):
        texts = F.when(name == known, apply_transform(value, known, page_url)).otherwise(texts)
    typed = [F.when(name == known, apply_transform(value, known)) for known in ("number", "boolean")]
    return [texts.alias("value"), typed[0].alias("num"), typed[1].alias("flag")]


def type_setting(field_type: Column, which: int) -> Column:
    """Attribute (0) or transform (1) for a declared field type."""
    table = {k: v[which] for k, v in TYPE_SETTINGS.items() if v[which]}
    default = DEFAULT_SETTINGS[which]
    keep = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    known = field_type.isin(*TYPE_SETTINGS)
    hit = F.try_element_at(keep, field_type)
    return F.when(known, hit).otherwise(F.lit(default).cast("string"))
