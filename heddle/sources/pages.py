"""Registry pages over HTTP as a Spark data source, and pages landed as files.

The reader keeps the retrying out of the plan: each page is tried five times with doubling
pauses on time-outs and server errors; other errors end the read.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

SCHEMA = "page_no int, next_cursor string, position int, raw_json string"
TRIES, TIMEOUT, PAUSE = 5, 15.0, 2.0


def fetch(url: str, opener: Callable | None = None, pause: float = PAUSE) -> dict:
    """One page as JSON, with retries."""
    from urllib.error import HTTPError, URLError
    from urllib.request import urlopen

    opener = opener or (lambda u: urlopen(u, timeout=TIMEOUT).read())  # noqa: S310
    for k in range(TRIES):
        try:
            return json.loads(opener(url))
        except HTTPError as e:
            if e.code < 500 or k == TRIES - 1:
                raise
        except (URLError, TimeoutError, ConnectionError):
            if k == TRIES - 1:
                raise
        time.sleep(pause * 2**k)
    raise AssertionError("unreachable")


def walk(base_url: str, limit: int, opener: Callable | None = None, pause: float = PAUSE) -> Iterator[tuple[int, str | None, int,
    str | None]]:
    """(page, next cursor, position, entry) of all pages, by the cursor each page gives.

    The last page is the one without a cursor; a page without entries is one row without one.
    """
    from urllib.parse import urlencode

    cursor, page = None, 0
    while True:
        args = {"limit": limit, "version": "latest", **({"cursor": cursor} if cursor else {})}
        data = fetch(f"{base_url.rstrip('/')}/v0/servers?{urlencode(args)}", opener, pause)
        page += 1
        cursor = (data.get("metadata") or {}).get("nextCursor") or None
        entries = data.get("servers") or []
        for i, entry in enumerate(entries):
            yield page, cursor, i, json.dumps(entry)
        if not entries:
            yield page, cursor, 0, None
        if not cursor:
            return


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.url, self.limit = options.get("url"), int(options.get("limit", "100"))

    def read(self, partition):
        yield from walk(self.url, self.limit)


class RegistryPages(DataSource):
    """``spark.read.format("registry_pages").option("url", ...).load()``: one sequential reader,
    as each page's cursor is known only from the page before."""

    @classmethod
    def name(cls):
        return "registry_pages"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def landed_pages(spark: SparkSession, path: str) -> DataFrame:
    """(entry_id, raw_json) of page files: JSON objects whose ``servers`` is a list."""
    files = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("p"), F.col("_metadata.file_path").alias("file"))
    each = files.select("file", F.posexplode(F.try_variant_get("p", "$.servers", "array<variant>")).alias("pos", "x"))
    return each.select(F.xxhash64("file", "pos").alias("entry_id"), F.to_json("x").alias("raw_json"))
