"""Configured pipelines: named steps, variables, inherited defaults."""

from __future__ import annotations

import re
from base64 import b64encode
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from pathlib import Path
from string import Template

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import html, urls
from corpusloom.operators import fields, filters, recrawl

Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class CrawlConfig:
    seed_url: str
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    depth: int = -1
    max_pages: int = -1
    render_js: bool = False
    respect_robots_txt: bool = True
    obey_sitemaps: bool = True
    user_agent: str = "*"
    rate_limit: dict = field(default_factory=lambda: {"requestsPerSecond": 1, "burst": 1})

    def to_json(self) -> str:
        import json

        return json.dumps(asdict(self), indent=2)


def interpolated(text: str, variables: dict[str, str], folder: str | None = None) -> str:
    """``$name`` and ``${name}`` replaced, unknown ones kept; ``#parse("file")`` replaced by that file of ``folder``."""

    def included(m: re.Match) -> str:
        return interpolated((Path(folder or ".") / m[1]).read_text(), variables, folder)

    text = re.sub(r'#parse\("([^"]+)"\)', included, text)
    return Template(text).safe_substitute(variables)


def read_variables(text: str) -> dict[str, str]:
    """``key = value`` lines; # begins a comment."""
    pairs = (line.partition("=") for line in text.splitlines() if line.strip() and not line.lstrip().startswith("#"))
    return {k.strip(): v.strip() for k, _, v in pairs}


def inherited(defaults: dict, crawler: dict) -> dict:
    """A crawler's settings over the defaults, dictionaries merged key by key."""
    out = dict(defaults)
    for k, v in crawler.items():
        out[k] = inherited(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def search_source(settings: dict[str, str], base: str, index: str) -> tuple[str, dict[str, str]]:
    """Path and headers of a search source: SEARCH_BASE and SEARCH_INDEX of ``settings`` or the defaults given; an Authorization only if user and password are both set."""
    path = f"{settings.get('SEARCH_BASE') or base}/{settings.get('SEARCH_INDEX') or index}"
    user, password = settings.get("SEARCH_USER"), settings.get("SEARCH_PASSWORD")
    return path, {"Authorization": "Basic " + b64encode(f"{user}:{password}".encode()).decode()} if user and password else {}


class Registry:
    """Steps by name, short or with a dotted prefix."""

    def __init__(self):
        self.makers: dict[str, Callable[..., Step]] = {}

    def add(self, name: str) -> Callable[[Callable[..., Step]], Callable[..., Step]]:
        def keep(maker: Callable[..., Step]) -> Callable[..., Step]:
            self.makers[name] = maker
            return maker

        return keep

    def make(self, name: str, **settings) -> Step:
        maker = self.makers.get(name) or self.makers.get(name.rpartition(".")[2])
        if maker is None:
            raise LookupError(f"no step named {name}")
        return maker(**settings)

    def pipeline(self, steps: list[dict]) -> Step:
        """``steps``: dictionaries with class and the settings of each, applied in order."""
        made = [self.make(s["class"], **{k: v for k, v in s.items() if k != "class"}) for s in steps]

        def run(df: DataFrame) -> DataFrame:
            for m in made:
                df = df.transform(m)
            return df

        return run


def ship(spark: SparkSession, *files: str) -> None:
    """Modules with steps of one's own, for the executors."""
    for f in files:
        spark.sparkContext.addPyFile(f)


STEPS = Registry()


@STEPS.add("GenericURLNormalizer")
def _normalizer(rules: list[str], replacements: list[tuple[str, str]] = (), column: str = "url") -> Step:
    chain = [*rules, *(urls.replacing(*r) for r in replacements)]
    return lambda df: df.withColumn(column, urls.normalize(F.col(column), chain))


@STEPS.add("ExtensionReferenceFilter")
def _extensions(extensions: str, on_match: str = "include", column: str = "url") -> Step:
    return lambda df: df.where(filters.accepted([filters.Filter(filters.has_extension(F.col(column), extensions), on_match)]))


@STEPS.add("ReferenceFilter")
def _reference(pattern: str, method: str = "regex", on_match: str = "include", column: str = "url") -> Step:
    return lambda df: df.where(filters.accepted([filters.Filter(filters.matches(F.col(column), pattern, method), on_match)]))


@STEPS.add("SegmentCountURLFilter")
def _segments(count: int, duplicate: bool = False, separator: str = "/", on_match: str = "include", column: str = "url") -> Step:
    return lambda df: df.where(filters.accepted([filters.Filter(filters.segment_count(F.col(column), count, duplicate, separator), on_match)]))


@STEPS.add("ConstantTagger")
def _constant(**values: str) -> Step:
    return lambda df: fields.add_constant(df, **values)


@STEPS.add("KeepOnlyTagger")
def _keep(fields_: str) -> Step:
    return lambda df: fields.keep_only(df, fields_)


@STEPS.add("DeleteTagger")
def _delete(pattern: str) -> Step:
    return lambda df: fields.delete_matching(df, pattern)


@STEPS.add("RobotsMetaFilter")
def _robots(column: str = "html") -> Step:
    return lambda df: df.where(filters.indexable(F.col(column)))


@STEPS.add("CanonicalFilter")
def _canonical(ignore: bool = False, url: str = "url", column: str = "html") -> Step:
    return lambda df: df.where(filters.is_canonical(F.col(url), F.col(column), ignore=ignore))


@STEPS.add("TextExtractor")
def _text(column: str = "html") -> Step:
    return lambda df: df.withColumns({"title": html.title(F.col(column)), "content": html.plain_text(F.col(column))})


@STEPS.add("ChecksumDedup")
def _dedup(column: str = "content", order: str = "url") -> Step:
    return lambda df: recrawl.without_duplicates(df, recrawl.content_checksum(F.col(column)), order)


#: The order of a document's steps: directives first, cheap ones before those that read the whole page, duplicates last.
IMPORT_STEPS = [{"class": "RobotsMetaFilter"}, {"class": "CanonicalFilter"}, {"class": "TextExtractor"}, {"class": "ChecksumDedup"}]


def import_pages(pages: DataFrame, steps: list[dict] | None = None, before: list[Step] = (), after: list[Step] = ()) -> DataFrame:
    """Pages (url, html) through the steps, with one's own before and after."""
    for s in before:
        pages = pages.transform(s)
    pages = pages.transform(STEPS.pipeline(IMPORT_STEPS if steps is None else steps))
    for s in after:
        pages = pages.transform(s)
    return pages
