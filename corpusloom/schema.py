"""Schemas of the tables that the library reads and makes."""

from __future__ import annotations

from pyspark.sql import types as T

STR, INT, LONG, DOUBLE = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


METADATA = struct(depth=STR, contentType=STR, sitemap=struct(changefreq=STR, priority=STR))
RAW_HIT = struct(_id=STR, _source=T.MapType(STR, STR))
CLEAN_DOC = struct(_id=STR, url=STR, title=STR, description=STR, content=STR, metadata=METADATA)
SEARCH_HIT = struct(_id=STR, _score=DOUBLE, _source=struct(title=STR, description=STR, url=STR, content=STR, metadata=struct(depth=STR, contentType=STR)))
PAGE_ROW = struct(id=STR, path=STR, title=STR, type=STR, size=LONG)
CRAWL_REQUEST = struct(target_url=STR)
CRAWL_JOB = struct(run_id=STR, target_url=STR, status=STR, progress=INT, results=T.ArrayType(PAGE_ROW), started_at=DOUBLE, error_message=STR)
RUN_SUMMARY = struct(url=STR, runId=STR, pages=INT, status=STR)
LOG_LINE = struct(time=STR, level=STR, status=INT, method=STR, path=STR, bytes=LONG)
CRAWL_DOC_INFO = struct(
    reference=STR, depth=INT, etag=STR, originalReference=STR, redirectTarget=STR, redirectTrail=T.ArrayType(STR), referencedUrls=T.ArrayType(STR), referrerReference=STR, referrerLinkMetadata=STR,
    sitemapChangeFreq=STR, sitemapLastMod=T.TimestampType(), sitemapPriority=T.FloatType(), urlRoot=STR,
)
DOC_METADATA = T.MapType(STR, T.ArrayType(STR))
LINK = struct(src=STR, dst=STR, tag=STR, attr=STR, text=STR)
ROBOTS_RULE = struct(host=STR, agent=STR, kind=STR, pattern=STR, crawl_delay=T.FloatType())
ROBOTS_META = struct(noindex=T.BooleanType(), nofollow=T.BooleanType())
SITEMAP_ENTRY = struct(loc=STR, lastmod=T.TimestampType(), changefreq=STR, priority=T.FloatType())
HTML_FILE = struct(path=STR, html=STR)

# States of a job, of a crawled document, page types and the change frequencies of sitemaps with their seconds.
JOB_STATES = ("pending", "running", "complete", "failed")
READABLE_JOB_STATES = ("complete", "running")
CRAWL_STATES = ("NEW", "MODIFIED", "UNMODIFIED", "ERROR", "REJECTED", "BAD_STATUS", "DELETED", "NOT_FOUND", "REDIRECT", "TOO_DEEP")
PAGE_TYPES = ("html", "pdf", "doc")
CHANGE_SECONDS = {"ALWAYS": 0, "HOURLY": 3600, "DAILY": 86400, "WEEKLY": 604800, "MONTHLY": 2592000, "YEARLY": 31536000, "NEVER": None}
