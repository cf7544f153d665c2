"""Where recordings and documents come from: locators, what claims them, and which addresses are refused."""

from __future__ import annotations

import ipaddress
import re
from dataclasses import dataclass
from urllib.parse import urljoin, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Schemes that are read, the longest address.
SCHEMES, LONGEST = ("http", "https"), 8192


class SourceError(ValueError):
    """A locator that nothing can read, or that must not be read."""


def blocked_address(address: str) -> bool:
    """Loopback, private, link-local, multicast, reserved and unspecified addresses, also inside IPv6."""
    ip = ipaddress.ip_address(address)
    mapped = getattr(ip, "ipv4_mapped", None)
    ip = mapped or ip
    return any((ip.is_loopback, ip.is_private, ip.is_link_local, ip.is_multicast, ip.is_reserved, ip.is_unspecified))


def validate_url(url: str, resolve=None) -> str:
    """The address itself, or SourceError: length, control characters, scheme, credentials and host are checked.

    ``resolve`` gives a host's addresses; every one must be public. Without it only literal addresses are checked.
    """
    if len(url) > LONGEST or re.search(r"[\x00-\x20\x7f]", url):
        raise SourceError("address too long or with control characters")
    parts = urlsplit(url)
    if parts.scheme.lower() not in SCHEMES or not parts.hostname:
        raise SourceError("not an http(s) address")
    if parts.username or parts.password:
        raise SourceError("credentials in the address")
    host = parts.hostname
    try:
        found = [str(ipaddress.ip_address(host))]
    except ValueError:
        if host == "localhost" or host.endswith(".localhost"):
            raise SourceError("local host") from None
        found = resolve(host) if resolve else []
    if any(map(blocked_address, found)):
        raise SourceError("address is not public")
    return url


def resolve_redirect(url: str, location: str, resolve=None) -> str:
    """The checked target of a redirect."""
    return validate_url(urljoin(url, location), resolve)


@dataclass(frozen=True)
class LocalFiles:
    """Paths of any store that Spark reads."""

    name: str = "files"

    def claims(self, locator: str) -> bool:
        return not re.match(r"(?i)https?://", locator)

    def read(self, spark: SparkSession, locator: str) -> DataFrame:
        """(path, modified, size, content_hash) of the files under a path; hashed by Spark, not gathered."""
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(locator)
        return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), F.sha2("content", 256).alias("content_hash"))


@dataclass(frozen=True)
class DirectUrl:
    """A checked http(s) address; fetching is the caller's, through ``fetch(url) -> bytes``."""

    fetch: object = None
    name: str = "url"

    def claims(self, locator: str) -> bool:
        return bool(re.match(r"(?i)https?://", locator))

    def read(self, spark: SparkSession, locator: str) -> DataFrame:
        validate_url(locator)
        if self.fetch is None:
            raise SourceError("no fetcher is configured")
        return spark.createDataFrame([(locator, bytearray(self.fetch(locator)))], "path string, content binary")


def adapter_for(locator: str, adapters=(LocalFiles(), DirectUrl())):
    """The first adapter that claims the locator."""
    for a in adapters:
        if a.claims(locator):
            return a
    raise SourceError(f"nothing reads {locator!r}")


def stale(files: DataFrame, hours: float) -> DataFrame:
    """Files (path, modified) older than ``hours``, to be swept."""
    return files.where(F.col("modified") < F.current_timestamp() - F.make_dt_interval(hours=F.lit(int(hours)), mins=F.lit(int(hours % 1 * 60))))
