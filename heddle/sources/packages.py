"""Package registries' documents as the metadata table that some rules ask.

A row of the result is a package: ecosystem, package, unpublished, repository, project_urls,
home_page, scripts, created_at. Documents that are no JSON objects give a row without any
value, which no rule fires on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MAP = "map<string,string>"


def _get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("v", path, kind)


def npm_metadata(documents: DataFrame, package: str = "package", document: str = "document") -> DataFrame:
    """Of npm's documents: the latest version's repository and scripts, else the package's
    repository; when it was created, and whether only a note of its removal is left."""
    rows = documents.select(F.col(f"`{package}`").alias("package"),
        F.try_parse_json(F.col(f"`{document}`")).alias("v")).where("package IS NOT NULL")
    versions = _get("$.versions", "map<string,variant>")
    latest = F.try_element_at(versions, _get("$['dist-tags'].latest"))
    text = lambda c: F.nullif(F.when(F.schema_of_variant(c).startswith("OBJECT"),
        F.to_json(c)).otherwise(F.try_variant_get(c, "$", "string")), F.lit(""))
    repository = F.coalesce(text(F.try_variant_get(latest, "$.repository", "variant")), text(_get("$.repository", "variant")))
    return rows.select(
        F.lit("npm").alias("ecosystem"), "package", F.coalesce(_get("$.time.unpublished", "variant").isNotNull(),
            F.lit(False)).alias("unpublished"),
        F.nullif(repository, F.lit("{}")).alias("repository"), F.lit(None).cast(_MAP).alias("project_urls"),
            F.lit(None).cast("string").alias("home_page"),
        F.try_variant_get(latest, "$.scripts", _MAP).alias("scripts"), _get("$.time.created").alias("created_at"),
    )


def pypi_metadata(documents: DataFrame, package: str = "package", document: str = "document") -> DataFrame:
    """Of PyPI's documents: links, home page and the earliest upload of any release."""
    rows = documents.select(F.col(f"`{package}`").alias("package"),
        F.try_parse_json(F.col(f"`{document}`")).alias("v")).where("package IS NOT NULL")
    uploads = F.transform(F.flatten(F.map_values(_get("$.releases", "map<string,array<variant>>"))),
        lambda f: F.try_variant_get(f, "$.upload_time_iso_8601", "string"))
    return rows.select(
        F.lit("pypi").alias("ecosystem"), "package", F.lit(False).alias("unpublished"), F.lit(None).cast("string").alias("repository"),
        _get("$.info.project_urls", _MAP).alias("project_urls"), _get("$.info.home_page").alias("home_page"),
            F.lit(None).cast(_MAP).alias("scripts"),
        F.array_min(F.filter(uploads, lambda u: F.coalesce(u, F.lit("")) != "")).alias("created_at"),
    )
