"""Point lookups over published tables, each a DataFrame of at most one row."""

from __future__ import annotations

import re
from urllib.parse import quote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.operators.publish import badge_svg


def by_slug(published: DataFrame, slug: str) -> DataFrame:
    """A server by its materialised slug; a filter that reaches the scan."""
    return published.where(F.col("slug") == slug).limit(1)


def by_name(published: DataFrame, name: str) -> DataFrame:
    return published.where(F.col("name") == name).limit(1)


def badge(published: DataFrame, slug: str) -> DataFrame:
    return by_slug(published, slug).select(badge_svg(F.col("score")).alias("svg"))


def feedback_url(site: str, rule_id: str, server: str, detail: str) -> str:
    """Link to a prefilled report form; spaces are %20, slashes stay."""
    return f"{site}/issues/new?title={quote(f'[{rule_id}] {server}')}&body={quote(detail)}"


def check(index: DataFrame, findings: DataFrame, name: str) -> DataFrame:
    """A server's page with its findings, by name."""
    from heddle.registry_run import server_detail

    return server_detail(index, findings, F.col("name") == name)


def detail(index: DataFrame, findings: DataFrame, slug: str) -> DataFrame:
    """A server's page with its findings, by slug."""
    from heddle.registry_run import server_detail

    return server_detail(index, findings, F.col("slug") == slug)


def verification_link(name: str, details: list[str]) -> str | None:
    """Where to check a server by hand: the forge account its name stands for, else the npm
    package that a finding's detail names, else nothing."""
    head = name.split("/", 1)
    if head[0].startswith("io.github.") and len(head) == 2:
        return f"https://github.com/{head[0][len('io.github.'):]}/{head[1]}"
    package = next((m[1] for d in details for m in [re.search(r'npm package "([^"]+)"', d or "")] if m), None)
    return package and f"https://www.npmjs.com/package/{package}"
