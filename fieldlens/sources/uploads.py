"""What may be read: hosts, file names and switches of a job's parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_allowed_url(url: Column, hosts: list[str]) -> Column:
    """An https URL whose host is one of hosts or ends in one of those that start with a dot."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    fits = [host.endswith(h.lower()) if h.startswith(".") else host == h.lower() for h in hosts]
    any_host = fits[0] if fits else F.lit(False)
    for f in fits[1:]:
        any_host = any_host | f
    return F.coalesce((F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))) == "https") & any_host, F.lit(False))


def safe_name(name: Column) -> Column:
    """A file name of letters, digits, dot, dash and underscore."""
    return F.regexp_replace(F.regexp_replace(F.trim(name), r"[^0-9A-Za-z._-]+", "_"), r"^[._]+", "")


def should_retry(kind: Column, group: Column, failed: Column, red_points: Column) -> Column:
    """A quality or throughput map that passed in spite of red points is read again from its enlarged copy."""
    return (kind == "degradation") & F.lower(F.coalesce(group, F.lit(""))).isin("quality", "throughput") & ~failed & (F.coalesce(red_points, F.lit(0)) > 0)


def should_retry_error(kind: Column, group: Column, message: Column) -> Column:
    """A map that failed for want of measurement points is read again too."""
    few = F.lower(F.coalesce(message, F.lit(""))).contains("does not contain enough colored measurement points")
    return (kind == "degradation") & F.lower(F.coalesce(group, F.lit(""))).isin("coverage", "quality", "throughput") & few


def is_larger(width: Column, height: Column, new_width: Column, new_height: Column) -> Column:
    """An enlarged copy is worth reading if it has half as many pixels more."""
    return new_width * new_height > 1.5 * width * height


def preparation(mode: Column, has_images: Column) -> Column:
    """How images are prepared: as asked where that is a known way, else in memory where an image library is there."""
    m = F.lower(F.trim(F.coalesce(mode, F.lit(""))))
    return F.when(m.isin("direct", "external"), m).when(has_images, "direct").otherwise("external")
