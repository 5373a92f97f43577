"""Record ids and cross-source fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from ..templates import Template
from .core import rx


def record_uid(source: Column, item: Column, url: Column | None = None, body: Column | None = None) -> Column:
    """sha1 of source and item id, link or whole record: the first that is not empty."""
    keys = [F.nullif(c.cast("string"), F.lit("")) for c in (item, url, body) if c is not None]
    return F.sha1(F.concat(source, F.lit("\x00"), F.coalesce(*keys)))


def _key_text(name: str, kind: str, value: Column) -> Column:
    """A dedup value as text: dates by day, links without scheme, 'www' and closing slash, names without punctuation and
    legal form, numbers with one decimal."""
    if kind in ("number", "money", "area", "distance", "weight"):
        return F.bround(value.cast("double"), 1).cast("decimal(38,1)").cast("string")
    text = value.cast("string")
    if kind == "datetime":
        text = F.substring(text, 1, 10)
    elif kind == "url":
        low = F.lower(text)
        host = F.regexp_replace(F.regexp_extract(low, "^[^/?#]*//([^/?#]*)", 1), r"^www\d*\.", "")
        path = F.regexp_replace(F.regexp_extract(low, "^[^/?#]*//[^/?#]*([^?#]*)", 1), "/+$", "")
        query = F.regexp_extract(low, r"^[^?#]*(\?[^#]+)", 1)
        text = F.concat(host, path, query)
    elif name in ("name", "company", "title"):
        text = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), rx(r"[^\w\s]", ""), " "), r"\s+", " "))
        if name != "title":
            text = F.trim(F.regexp_replace(text, rx(K.LEGAL_SUFFIX, ""), ""))
    return F.nullif(F.trim(F.lower(text)), F.lit(""))


def fingerprint(template: Template, columns: dict[str, Column] | None = None) -> Column:
    """20 hex digits over the first dedup set whose values are all present; NULL when none is complete."""
    at = columns or {name: F.col(name) for keys in template.dedup for name in keys}
    made = []
    for keys in template.dedup:
        values = [_key_text(k, template.fields[k].type, at[k]) for k in keys]
        # concat is NULL as soon as one value is
        joined = F.concat(F.lit("/".join(keys) + ":"), *[v for i, x in enumerate(values)
                                                         for v in ([F.lit("|")] if i else []) + [x]])
        made.append(F.substring(F.sha1(joined), 1, 20))
    return F.coalesce(*made) if made else F.lit(None).cast("string")
