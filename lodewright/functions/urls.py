"""Parts of URLs by regular expressions, which never raise, as parse_url() does on a bad URL."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import col

_SCHEME = r"[A-Za-z][A-Za-z0-9+.-]*"
IMAGES = ("jpg", "png", "jpeg")

#: Common public suffixes, for use where no full list is given; * and ! as in the public suffix list.
SUFFIXES = (
    "com org net edu gov mil int info biz name pro aero coop museum jobs mobi travel tel asia cat post xxx app dev page blog shop online site "
    "xyz top club live news tech store cloud io co ai me tv cc ws fm ly gg de fr es it nl be ch at dk se no fi pl cz sk hu ro bg gr pt ie lu "
    "li ru ua by kz us ca mx br ar cl pe ve uk jp cn kr in id my sg th vn ph tw hk au nz za ng ke eg ma tr il ir sa ae pk lk ee lv lt si hr rs "
    "co.uk org.uk ac.uk gov.uk me.uk ltd.uk plc.uk net.uk sch.uk co.jp ac.jp or.jp ne.jp go.jp com.au net.au org.au edu.au gov.au co.nz org.nz "
    "ac.nz govt.nz com.br org.br gov.br com.cn org.cn gov.cn edu.cn co.in org.in ac.in gov.in co.kr or.kr go.kr com.mx com.ar com.tr com.tw "
    "com.hk com.sg co.za org.za com.ua *.ck !www.ck"
).split()


def cleaned(url: str | Column) -> Column:
    """Without leading control characters and spaces, and without tabs and line ends."""
    return F.regexp_replace(col(url), r"^[\x00-\x20]+|[\t\r\n]", "")


def scheme(url: str | Column) -> Column:
    """Lower-case scheme, empty where there is none."""
    return F.lower(F.regexp_extract(cleaned(url), f"^({_SCHEME}):", 1))


def netloc(url: str | Column) -> Column:
    """What stands between // and the path: user, host and port as written; empty where there is none."""
    return F.regexp_extract(cleaned(url), f"^(?:{_SCHEME}:)?//([^/?#]*)", 1)


def path(url: str | Column) -> Column:
    return F.regexp_extract(cleaned(url), f"^(?:{_SCHEME}:)?(?://[^/?#]*)?([^?#]*)", 1)


def extension(url: str | Column) -> Column:
    """Extension of the last path segment without its ;parameters; a name that begins with its only dot has none."""
    last = F.regexp_extract(path(url), r"([^/;]*)(?:;[^/]*)?$", 1)
    return F.regexp_extract(last, r"^\.*[^.](?s:.*)\.([^.]*)$", 1)


def image_extension(url: str | Column) -> Column:
    """jpg, png or jpeg in any case, as written; ``other`` for everything else."""
    e = extension(url)
    return F.when(F.lower(e).isin(*IMAGES), e).otherwise("other")


def host(location: str | Column) -> Column:
    """Lower-case host of a netloc: no user, port or final dot."""
    return F.regexp_replace(F.lower(F.regexp_replace(F.regexp_replace(col(location), r"^.*@", ""), r":\d*$", "")), r"\.$", "")


def public_suffixes(hosts: DataFrame, name: str = "host", rules: Iterable[str] | None = None) -> DataFrame:
    """(host, suffix) of each distinct host that has one: the longest rule that matches, exceptions first.

    Each host is looked up by its own endings, at most one for each label, in an equi-join with the rules.
    """
    spark = hosts.sparkSession
    rows = [(r.lstrip("!").removeprefix("*."), "exception" if r[0] == "!" else "wildcard" if r.startswith("*.") else "normal") for r in (rules or SUFFIXES)]
    table = spark.createDataFrame(rows, "rule string, kind string").distinct()
    labels = F.split(F.col(name), r"\.")
    ends = hosts.select(name).distinct().withColumn("_l", labels).select(name, F.posexplode(F.transform(F.sequence(F.lit(1), F.size("_l")), lambda i: F.array_join(F.slice("_l", i, F.size("_l")), "."))).alias("_at", "_end"), F.size("_l").alias("_n"))
    # a rule *.x matches the ending one label longer than x; an exception's suffix is one label shorter than itself
    hit = ends.join(F.broadcast(table), F.col("_end") == F.col("rule"))
    start = F.when(F.col("kind") == "wildcard", F.col("_at") - 1).when(F.col("kind") == "exception", F.col("_at") + 1).otherwise(F.col("_at"))
    # a wildcard can't begin before the host does
    hit = hit.withColumn("_start", start).where("_start >= 0")
    best = hit.groupBy(name).agg(F.min(F.struct((F.col("kind") != "exception").alias("rank"), F.col("_start").alias("start"))).alias("b"))
    suffix = F.array_join(F.slice(labels, F.col("b.start") + 1, F.size(labels)), ".")
    return best.select(name, suffix.alias("suffix")).where("suffix != ''")
