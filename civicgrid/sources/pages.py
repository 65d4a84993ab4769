"""A page cache in files that lookups and index scans read little of.

Pages lie in the order of their hash, in small row groups with Bloom filters and
page indexes for it: a lookup opens the row group that may hold its hash and no
other, and a scan of the index reads no column with text.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a row group; a lookup reads one.
GROUP_BYTES = 4 << 20


def hash_of(url: str) -> str:
    return hashlib.sha256(url.encode()).hexdigest()[:16]


def write_pages(pages: DataFrame, folder: str, files: int, expected: int, group_bytes: int = GROUP_BYTES) -> None:
    """Write ``pages`` (url_hash and more) in the order of their hash to about ``files`` files; ``expected`` rows in a file size its Bloom filter."""
    ordered = pages.repartitionByRange(files, "url_hash").sortWithinPartitions("url_hash")
    options = {"parquet.bloom.filter.enabled#url_hash": "true", "parquet.bloom.filter.expected.ndv#url_hash": str(expected), "parquet.block.size": str(group_bytes), "parquet.page.row.count.limit": "2000"}
    ordered.write.options(**options).parquet(folder)


def page_by_url(spark: SparkSession, folder: str, url: str) -> DataFrame:
    """The page of an address; its hash is a literal, which the scan compares with its statistics."""
    return pages_by_urls(spark, folder, [url])


def pages_by_urls(spark: SparkSession, folder: str, urls: list[str]) -> DataFrame:
    """The pages of a few addresses."""
    hashes = sorted({hash_of(u) for u in urls})
    return spark.read.parquet(folder).filter(F.col("url_hash").isin(hashes) & F.col("url").isin(list(urls)))
