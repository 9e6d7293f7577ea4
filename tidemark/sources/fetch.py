"""Collecting items for jobs behind a protocol. The engine brings a fetcher that replays files; remote ones plug in."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable
from pathlib import Path
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.frame import COLLECT_POSTS, COMMENTS_PER_POST, COMMENTS_PER_RUN, POSTS_PER_BLOCK, PROBE_POSTS
from tidemark.sources.json_lists import read_json_lists
from tidemark.sources.tables import exists, read_text, write_text


class Fetcher(Protocol):
    def fetch(self, job: dict) -> Iterable[dict]:
        """The items of one job: posts and comments, as the raw files have them."""


class ReplayFetcher:
    """Gives the items of files named as jobs are, from any filesystem that Spark reads."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def fetch(self, job: dict) -> Iterable[dict]:
        return json.loads(read_text(self.spark, f"{self.folder}/{job['file']}"))


def read_or_fetch(spark: SparkSession, path: str, fetcher: Fetcher, job: dict, force: bool = False) -> DataFrame:
    """The cached items of a job; fetched and written first where there are none, or when forced. The question whether
    they are there and the writing go to one filesystem."""
    if force or not exists(spark, path):
        write_text(spark, path, json.dumps(list(fetcher.fetch(job)), ensure_ascii=False, indent=2), overwrite=force)
    return read_json_lists(spark, path)


_SETTING = re.compile(r"""^[ \t]*(?!\#)([^=\s][^=\n]*?)[ \t]*=[ \t]*(?:"([^"\n]*)"|'([^'\n]*)'|([^\n]*?))[ \t]*$""", re.M)


def settings_of(text: str) -> dict[str, str]:
    """The settings of a text with one name=value a line; of a name given twice the first counts."""
    out: dict[str, str] = {}
    for found in _SETTING.finditer(text):
        out.setdefault(found[1], next(v for v in found.groups()[1:] if v is not None))
    return out


def load_env(path: str = ".env") -> None:
    """Settings of a file become environment variables, save those that are set. No file is no settings."""
    file = Path(path)
    wanted = settings_of(file.read_text(encoding="utf-8")) if file.is_file() else {}
    os.environ.update({name: value for name, value in wanted.items() if name not in os.environ})


# The keys of a request, and those that never change.
_STEADY = {"searchPosts": True, "searchComments": False, "searchCommunities": False, "searchSort": "new", "includeNSFW": False}
_PROXY = {"useApifyProxy": True, "apifyProxyGroups": ["RESIDENTIAL"]}


def _query(extra: dict[str, Column]) -> Column:
    """The request of a job as JSON. It names its days, so that a job asks for the same days whenever it is sent."""
    fields = {
        "searchTerms": F.array("term"),
        "withinCommunity": F.concat(F.lit("r/"), F.col("subreddit")),
        **{k: F.lit(v) for k, v in _STEADY.items()},
        "postedAfter": F.col("start"),
        "postedBefore": F.col("end"),
        "proxy": _proxy(),
    } | extra
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def _proxy() -> Column:
    groups = F.array(*[F.lit(g) for g in _PROXY["apifyProxyGroups"]])
    return F.struct(F.lit(_PROXY["useApifyProxy"]).alias("useApifyProxy"), groups.alias("apifyProxyGroups"))


def _caps(crawl: bool, posts: Column, per_post: int, per_run: int) -> dict[str, Column]:
    return {"crawlCommentsPerPost": F.lit(crawl), "maxPostsCount": posts, "maxCommentsPerPost": F.lit(per_post), "maxCommentsCount": F.lit(per_run)}


def probe_request() -> Column:
    """Posts alone: their comment counts are what the probe is for."""
    return _query(_caps(False, F.lit(PROBE_POSTS), 0, 0))


def collect_request() -> Column:
    """Posts with their threads; a blocked job gets the small budget of one block."""
    return _query(_caps(True, F.when(F.col("blocked"), POSTS_PER_BLOCK).otherwise(COLLECT_POSTS), COMMENTS_PER_POST, COMMENTS_PER_RUN))


def direct_request() -> Column:
    """A batch of post addresses with caps of its own size."""
    n = F.size("urls")
    fields = {"startUrls": F.transform("urls", lambda u: F.struct(u.alias("url"))), "crawlCommentsPerPost": F.lit(True), "maxPostsCount": n, "maxCommentsPerPost": F.lit(COMMENTS_PER_POST), "maxCommentsCount": n * COMMENTS_PER_POST}
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def arm_request(posts: int) -> Column:
    """A phrase-test arm: the term goes out verbatim, quotation marks and all."""
    return _query(_caps(False, F.lit(posts), 0, 0))
