"""Review feeds: files of JSON pages, or a live feed as a Python data source."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from voxmill.operators.ingest import dedupe_last_wins, pages_for, parse_feed, sample_seeded, with_position


class NotFound(LookupError):
    """No such app, or it has no reviews."""


class Upstream(RuntimeError):
    """The feed could not be read."""


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row per page file: path, payload."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("payload"))


def reviews_from_pages(pages: DataFrame, order: str = "path") -> DataFrame:
    """Deduplicated reviews of pages, arrival order in ord."""
    rows = parse_feed(pages)
    placed = with_position(rows.withColumn("_at", F.struct(order, "pos")), "_at").drop("_at", "pos", order)
    return dedupe_last_wins(placed)


def collect(pages: DataFrame, limit: int, seed: int = 42, order: str = "path") -> DataFrame:
    """At most `limit` reviews: all as they came, or a seeded sample. Pages with an error are passed over unless all failed."""
    pages_for(limit)
    good = pages.filter(F.col("error").isNull()) if "error" in pages.columns else pages
    if "error" in pages.columns and good.isEmpty() and not pages.isEmpty():
        raise Upstream(pages.select("error").first()[0])
    found = reviews_from_pages(good.drop("error"), order)
    return found if found.limit(limit + 1).count() <= limit else sample_seeded(found, limit, seed)


def union_of_orders(*parts: DataFrame) -> DataFrame:
    """The pages of several sort orders, in the order given, as one pool."""
    out = None
    for k, p in enumerate(parts):
        p = p.withColumn("path", F.concat(F.lit(f"{k:03d}/"), "path"))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def search_apps(apps: DataFrame, term: str, limit: int = 10) -> DataFrame:
    """Apps whose name contains the term, without case, shortest names first."""
    if not term.strip():
        raise NotFound("a search term is needed")
    return apps.filter(F.contains(F.lower("name"), F.lit(term.strip().lower()))).orderBy(F.length("name"), "app_id").limit(limit)


def lookup_app(apps: DataFrame, app_id: int) -> dict:
    row = apps.filter(F.col("app_id") == app_id).first()
    if row is None:
        raise NotFound(f"no app {app_id}")
    return row.asDict()


def app_info(raw: DataFrame) -> DataFrame:
    """The six app fields under our names."""
    names = {"trackId": "app_id", "trackName": "name", "sellerName": "developer", "averageUserRating": "store_rating", "userRatingCount": "store_rating_count", "trackViewUrl": "url"}
    types = {"app_id": "long", "store_rating": "double", "store_rating_count": "long"}
    return raw.select(*(F.col(a).cast(types.get(b, "string")).alias(b) for a, b in names.items()))


class _Page(InputPartition):
    def __init__(self, page: int):
        super().__init__(page)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, fetch: Callable[[str], str]):
        self.options, self.fetch = options, fetch

    def partitions(self):
        return [_Page(p) for p in range(1, pages_for(int(self.options.get("limit", 100))) + 1)]

    def read(self, partition):
        url = self.options["url"].format(page=partition.value)
        try:
            yield (f"{partition.value:03d}", json.dumps(get_json(url, self.fetch), ensure_ascii=False), None)
        except Exception as e:  # a page that fails is a row, and other pages go on
            yield (f"{partition.value:03d}", None, str(e) if isinstance(e, Upstream) else f"{type(e).__name__}: {e}")


def get_json(url: str, fetch: Callable[[str], str] | None = None) -> dict:
    """The JSON object at a URL; every failure is an Upstream: a status, no connection, or an answer of another kind."""
    from http.client import HTTPException
    from urllib.error import HTTPError

    try:
        found = json.loads((fetch or _http)(url))
    except HTTPError as e:
        raise Upstream(f"status {e.code} from {url}") from e
    except (OSError, HTTPException) as e:
        raise Upstream(f"no answer from {url}: {e}") from e
    except ValueError as e:
        raise Upstream(f"no JSON from {url}") from e
    if not isinstance(found, dict):
        raise Upstream(f"no JSON object from {url}")
    return found


def _http(url: str) -> str:
    from urllib.request import urlopen

    with urlopen(url, timeout=30) as r:
        return r.read().decode("utf-8")


class ReviewFeed(DataSource):
    """format("review_feed"): one partition per page; options url (with {page}) and limit. Columns path, payload, error."""

    fetch: Callable[[str], str] = staticmethod(_http)

    @classmethod
    def name(cls) -> str:
        return "review_feed"

    def schema(self) -> str:
        return "path string, payload string, error string"

    def reader(self, schema):
        return _Reader(dict(self.options), type(self).fetch)
