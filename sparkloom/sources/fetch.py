"""Pages from snapshots or a pluggable fetcher, with ordered fallbacks."""

from __future__ import annotations

import functools
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom import scratch
from sparkloom.functions import rules as R

RESCUE_YEARS = (2026, 2013)
#: Urls of a host that a task takes at most, about.
HOST_ROWS = 10_000
#: (url, mode, archive date or None) -> (html, label of the source); raises where there is none.
Fetcher = Callable[[str, str, str | None], tuple[str, str]]


def from_snapshots(urls: DataFrame, snapshots: DataFrame, url: str = "url") -> DataFrame:
    """urls joined to their best usable snapshot. snapshots: (url, html, source, priority); the lowest priority wins.

    Urls without a usable snapshot stay, with html and source null.
    """
    usable = snapshots.where(R.usable_page(F.col("html")))
    best = usable.groupBy("url").agg(F.min_by(F.struct("html", "source"), F.col("priority")).alias("b")).select(F.col("url").alias(url), "b.html", "b.source")
    return urls.join(best, url, "left")


def by_host(urls: DataFrame, url: str = "url", rows: int = HOST_ROWS) -> DataFrame:
    """urls dealt out by host, with host, parts (how many the host has) and nth (the row's place in its part).

    A host's urls make a part of up to about `rows` each, and a part stays in one task, in the order of url. Tasks take
    their hosts' urls in turns.
    """
    hosts = urls.withColumn("host", F.coalesce(R.authority(F.col(url)), F.lit("")))
    sizes = hosts.groupBy("host").agg(F.ceil(F.count("*") / rows).cast("int").alias("parts"))
    dealt = hosts.join(sizes, "host").withColumn("part", F.pmod(F.xxhash64(url), F.col("parts")).cast("int"))
    nth = F.row_number().over(W.partitionBy("host", "part").orderBy(url))
    return dealt.withColumn("nth", nth).repartition("host", "part").sortWithinPartitions("nth", "host", "part")


def fetched(urls: DataFrame, load: Callable[[], Fetcher], per_second: float = 2.0, tries: int = 3, longest: float = 10.0) -> DataFrame:
    """(url, html, source, error) of rows (url, fetch_mode, archive_date), fetched in the workers.

    The rate is one of each host: all urls of a host are in one task, which waits between them as long as the rate asks
    and meanwhile goes on with other hosts; a large host's urls are in several, which share its rate. Failed fetches
    are tried again with growing pauses, which count for the host as well.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fetch, free = load(), {}  # when a host may be asked again
        for frame in frames:
            out = []
            for url, mode, date, host, part, parts in zip(*(frame[c] for c in ("url", "fetch_mode", "archive_date", "host", "part", "parts"))):
                pause, error = (parts / per_second if per_second else 0.0), None
                for attempt in range(tries):
                    time.sleep(max(0.0, free.get((host, part), 0.0) - time.monotonic()))
                    free[host, part] = time.monotonic() + pause
                    try:
                        html, source = fetch(url, mode, date if isinstance(date, str) else None)
                        out.append((url, html, source, None))
                        error = None
                        break
                    except Exception as e:  # any failure of a page is that page's result
                        error = str(e)
                        if attempt + 1 < tries and per_second:
                            free[host, part] = max(free[host, part], time.monotonic() + min(longest, 2.0**attempt))
                if error is not None:
                    out.append((url, None, None, error))
            yield pd.DataFrame(out, columns=["url", "html", "source", "error"])

    asked = by_host(urls.select("url", "fetch_mode", "archive_date"))
    return asked.select("url", "fetch_mode", "archive_date", "host", "part", "parts").mapInPandas(run, "url string, html string, source string, error string")


#: The archive date of the second try and the sites that get one.
SECOND_DATE, SECOND_SITES = "20140101", ("cdc.gov",)


def archive_tries(urls: DataFrame, url: str = "url") -> DataFrame:
    """Rows (url, fetch_mode, archive_date) with their tries in order (try_no): of archived pages as asked for, then, for
    sites that need it, at a fixed earlier date."""
    second = F.array(*(F.lit(x) for x in SECOND_SITES))
    host = R.authority(F.col(url))
    again = (F.col("fetch_mode") == "wayback") & F.exists(second, lambda x: host.contains(x))
    dates = F.when(again, F.array(F.col("archive_date"), F.lit(SECOND_DATE))).otherwise(F.array("archive_date"))
    return urls.select(*[c for c in urls.columns if c != "archive_date"], F.posexplode(dates).alias("try_no", "archive_date"))


def first_usable(tried: DataFrame, url: str = "url") -> DataFrame:
    """(url, html, source) of each url's first try with a usable page; html and source are null without one.

    The second try may hold a page that redirects to a first topic, as long as it hasn't moved.
    """
    usable = R.usable_page(F.col("html")) | (F.col("try_no") > 0) & F.col("html").isNotNull() & (F.col("html") != "") & ~F.col("html").contains("This Page Has Moved")
    best = F.min(F.when(usable, F.struct("try_no", "html", "source"))).alias("b")
    label = F.when((F.col("b.try_no") > 0) & F.col("b.source").isNotNull(), F.concat(F.col("b.source"), F.lit(f" ({SECOND_DATE[:4]})"))).otherwise(F.col("b.source"))
    return tried.groupBy(url).agg(best).select(url, "b.html", label.alias("source"))


def rescue_candidates(urls: DataFrame, url: str = "url", years: tuple[int, int] = RESCUE_YEARS) -> DataFrame:
    """Each url with every year's snapshot date, the latest first: (..., year, archive_date)."""
    first, last = years
    return urls.withColumn("year", F.explode(F.sequence(F.lit(first), F.lit(last), F.lit(-1)))).withColumn("archive_date", F.concat(F.col("year").cast("string"), F.lit("0101")))


def rescued(tried: DataFrame, url: str = "url", made: str = "n_chunks") -> DataFrame:
    """Of tried candidates (url, year, n_chunks, ...) each url's latest that made something."""
    good = tried.where(F.col(made) > 0)
    return good.groupBy(url).agg(F.max_by(F.struct(*[c for c in tried.columns if c != url]), "year").alias("b")).select(url, "b.*")


def rescue(urls: DataFrame, attempt: Callable[[DataFrame], DataFrame], url: str = "url", years: tuple[int, int] = RESCUE_YEARS, made: str = "n_chunks") -> tuple[DataFrame, DataFrame]:
    """(rescued, asked): each url's latest snapshot that makes something, found in waves, and all that was asked for.

    `attempt` takes candidates (..., year, archive_date) and gives them with what came of them, `made` among it. A wave
    asks for one year, the latest first, of the urls that no wave before has rescued; it is written before the next
    begins, so nothing is asked for twice. A url that succeeds in the third year is asked for three times.
    """
    first, last = years
    left, waves = urls, []
    for year in range(first, last - 1, -1):
        wave = left.withColumns({"year": F.lit(year), "archive_date": F.lit(f"{year}0101")})
        tried = scratch.written(attempt(wave), "wave")
        if tried.isEmpty():
            break
        waves.append(tried)
        left = scratch.written(left.join(tried.where(F.col(made) > 0).select(url), url, "left_anti").select(*urls.columns), "frontier")
    if not waves:
        nothing = attempt(urls.limit(0).withColumns({"year": F.lit(first), "archive_date": F.lit("")}))
        return nothing, nothing
    asked = functools.reduce(DataFrame.unionByName, waves)
    return asked.where(F.col(made) > 0), asked
