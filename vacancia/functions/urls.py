"""Identity of application URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(url: Column) -> Column:
    """Scheme and host in lower case, no fragment, no utm_ parameters, others sorted (blank ones dropped), no slash at the end; NULL without a host."""
    part = lambda p: F.try_parse_url(F.trim(url), F.lit(p))
    pairs = F.filter(F.split(F.coalesce(part("QUERY"), F.lit("")), "&"), lambda x: x.rlike("=.") & ~F.lower(x).startswith("utm_"))
    query = F.array_join(F.array_sort(pairs), "&")
    path = F.regexp_replace(F.coalesce(part("PATH"), F.lit("")), "/+$", "")
    out = F.concat(F.lower(part("PROTOCOL")), F.lit("://"), F.lower(part("AUTHORITY")), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(F.length(part("AUTHORITY")) > 0, out)
