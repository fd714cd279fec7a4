"""Path and checksum spellings as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


@pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def plain_path(raw: Column) -> Column:
    """A locator as a plain relative path: ``a/b c.md``, NFC, case kept.

    Trims white space, decodes percent escapes (a lone ``%`` stays), turns back-slashes into slashes,
    drops empty and ``.`` segments, resolves ``..`` (leading ones vanish). Null stays null. Only locators
    with characters beyond ASCII reach the Arrow function for NFC; the rest stays in generated code.
    """
    s = F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")
    protected = F.regexp_replace(F.regexp_replace(s, r"%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
    decoded = F.try_url_decode(protected)
    s = F.when(s.contains("%") & decoded.isNotNull() & ~decoded.contains("�"), decoded).otherwise(s)
    s = F.regexp_replace(F.regexp_replace(s, r"[\\/]+", "/"), r"^/|/$", "")
    dotted = s.rlike(r"(^|/)\.{1,2}(/|$)")
    walked = F.aggregate(
        F.split(s, "/"),
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x.isin("", "."), acc)
        .when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.array_append(acc, x)),
    )
    # more than half of all locators need none of this
    odd = raw.rlike(r"[\\%]|//|(^|/)\.{1,2}(/|$)|^[\s/]|[\s/]$|[^\x00-\x7F]") | (raw == "")
    s = F.when(~odd, raw).when(dotted, F.array_join(walked, "/")).otherwise(s)
    wide = s.rlike(r"[^\x00-\x7F]")
    return F.coalesce(_nfc(F.when(wide, s)), s)


def plain_checksum(raw: Column) -> Column:
    """The lower-case hex digits of a checksum without algorithm prefix; empty becomes null."""
    s = F.substring_index(F.translate(F.lower(raw), "-= \t\r\n", "::"), ":", -1)
    return F.when(F.length(s) > 0, s)
