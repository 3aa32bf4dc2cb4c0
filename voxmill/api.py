"""The service's operations as functions: search, collect, metrics, insights, reviews and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxmill.operators import metrics as M
from voxmill.operators.sentiment import prepare
from voxmill.plans import insights as I  # noqa: E741
from voxmill.plans import report
from voxmill.sources import feed
from voxmill.sources.feed import NotFound
from voxmill.sources.store import Store, download, export_rows

SORTS, FORMATS = ("mostrecent", "mosthelpful"), ("json", "csv")


class Service:
    def __init__(self, spark: SparkSession, store: str, apps: DataFrame | None = None):
        self.spark, self.store, self.apps = spark, Store(spark, store), apps

    def collect(self, app_id: int, country: str, pages: DataFrame, limit: int = 100, seed: int = 42, sort: str = "mostrecent") -> DataFrame:
        """Read pages, dedupe, sample, score and save; an earlier batch of the key is replaced."""
        if len(country) != 2 or not country.isalpha():
            raise ValueError("country must be two letters")
        if sort not in SORTS:
            raise ValueError(f"sort must be one of {SORTS}")
        reviews = feed.collect(pages, limit, seed)
        if reviews.isEmpty():
            raise NotFound(f"no reviews for app {app_id} in {country}")
        self.store.save(app_id, country.lower(), prepare(reviews))
        return self.batch(app_id, country)

    def batch(self, app_id: int, country: str = "us") -> DataFrame:
        got = self.store.get(app_id, country.lower())
        if got is None:
            raise NotFound(f"no batch for app {app_id} in {country}")
        return got

    def metrics(self, app_id: int, country: str = "us") -> dict:
        rows = self.batch(app_id, country)
        return M.rating_metrics(rows).first().asDict() | M.text_metrics(rows).first().asDict()

    def insights(self, app_id: int, country: str = "us", keyword_provider=None, theme_provider=None) -> dict:
        return I.upgrade(I.build(self.batch(app_id, country)), keyword_provider, theme_provider)

    def reviews(self, app_id: int, country: str = "us") -> DataFrame:
        return export_rows(self.batch(app_id, country))

    def download(self, app_id: int, country: str = "us") -> dict:
        """The batch as one JSON document: app, collected_at, reviews."""
        app = feed.lookup_app(self.apps, app_id) if self.apps is not None else {"app_id": app_id}
        return download(self.batch(app_id, country), app)

    def report(self, app_id: int, country: str = "us", kind: str = "html") -> str:
        app = feed.lookup_app(self.apps, app_id) if self.apps is not None else {"app_id": app_id}
        return {"html": report.html, "md": report.markdown}[kind](app, self.insights(app_id, country))
