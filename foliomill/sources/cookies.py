"""Cookie jars in the Netscape format, and the cookies that go with a URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.functions.url import bare_pattern, domain_suffixes, host, is_expired, path, scheme

HEADERS = ("# HTTP Cookie File", "# Netscape HTTP Cookie File")


def parse_cookies(lines: DataFrame) -> DataFrame:
    """(domain, include_subdomains, path, https_only, expires, name, value) of jar lines (line_no, line).

    Comments and lines without seven fields are left out; an expiry that isn't
    a number is null.  A jar whose first line isn't a header gives no rows;
    ``is_jar`` tells such a file from an empty one.
    """
    ok = lines.where((F.col("line_no") == 1) & F.trim("line").isin(*HEADERS)).select(F.lit(True).alias("ok")).limit(1)
    f = F.split("line", "\t")
    rows = lines.where(~F.col("line").startswith("#")).where(F.size(f) == 7).join(F.broadcast(ok)).select("line_no", f.alias("f"))
    return rows.select(
        "line_no",
        F.lower(F.col("f")[0]).alias("domain"),
        (F.col("f")[1] == "TRUE").alias("include_subdomains"),
        F.col("f")[2].alias("path"),
        (F.col("f")[3] == "TRUE").alias("https_only"),
        F.col("f")[4].try_cast("long").alias("expires"),
        F.col("f")[5].alias("name"),
        F.col("f")[6].alias("value"),
    )


def is_jar(lines: DataFrame) -> DataFrame:
    first = F.max(F.when(F.col("line_no") == 1, F.trim("line").isin(*HEADERS)))
    return lines.agg(F.coalesce(first, F.count("*") == 0).alias("is_jar"))


def matches(url: Column, domain: Column, include_subdomains: Column, prefix: Column, https_only: Column) -> Column:
    """Whether a cookie goes with a URL: scheme, host and the beginning of the path."""
    h, s = host(url), scheme(url)
    bare = F.regexp_replace(F.lower(domain), r"^\.", "")
    same = F.when(domain.startswith(".") & include_subdomains, (h == bare) | F.endswith(h, F.concat(F.lit("."), bare))).otherwise(h == F.lower(domain))
    p = F.when(path(url) == "", "/").otherwise(path(url))
    return s.isin("http", "https") & ~(https_only & (s == "http")) & same & p.startswith(prefix)


def cookies_for(urls: DataFrame, cookies: DataFrame, now: Column) -> DataFrame:
    """The live cookies of each URL.

    A join on the ends of the host: a URL meets the cookies of its host and of
    the domains above it, not all of them.
    """
    live = cookies.where(~is_expired(F.col("expires"), now)).withColumnRenamed("path", "prefix").withColumn("_end", bare_pattern(F.col("domain")))
    ends = urls.withColumn("_end", F.explode(domain_suffixes(host(F.col("url")))))
    fits = matches(F.col("url"), F.col("domain"), F.col("include_subdomains"), F.col("prefix"), F.col("https_only"))
    return ends.join(live, "_end").where(fits).drop("_end")
