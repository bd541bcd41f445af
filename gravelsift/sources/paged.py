"""Paged comments of videos: top-level comments page by page, with the replies that come along and further reply pages.

A page is an object {"items": [comment, ...], "next": token or null}; a comment is {id, text, author, published_at}, a
top-level one also has total_replies and replies (the first few, as comments). The rules, as fixed values: at most 50
pages a video, at most 10 pages of replies a comment, reply pages only where a comment has more replies than came along;
each comment id once a video, where it is met first; a page of which no comment or reply is new is the last one.

`PagedComments` is a data source that fetches pages as it reads, a partition for each video; `threads` gives the same rows from pages
that have landed already.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAGES, REPLY_PAGES = 50, 10
ROW = "video_id string, comment_id string, parent_id string, text string, author string, published_at string"
COMMENT = "id string, text string, author string, published_at string"
PAGE = f"struct<items:array<struct<{COMMENT.replace(' string', ':string')},total_replies:long,replies:array<struct<{COMMENT.replace(' string', ':string')}>>>>>"
#: fetch(video_id, parent_id or None, token or None) -> a page
Fetch = Callable[[str, str | None, str | None], dict]


def fetched(video: str, fetch: Fetch, most: int) -> Iterator[tuple]:
    """The rows of one video, page by page."""
    seen: set[str] = set()

    def new(comment: dict, parent: str | None) -> bool:
        if comment["id"] in seen:
            return False
        seen.add(comment["id"])
        rows.append((video, comment["id"], parent, comment.get("text"), comment.get("author"), comment.get("published_at")))
        return True

    token, page = None, 0
    while page < most and (page == 0 or token is not None):
        rows: list[tuple] = []
        got = fetch(video, None, token)
        fresh = 0
        for top in got["items"]:
            near = top.get("replies") or []
            fresh += new(top, None) + sum(new(r, top["id"]) for r in near)
            if (top.get("total_replies") or 0) > len(near):
                more, reply_page = None, 0
                while reply_page < REPLY_PAGES and (reply_page == 0 or more is not None):
                    replies = fetch(video, top["id"], more)
                    for r in replies["items"]:
                        new(r, top["id"])
                    more, reply_page = replies.get("next"), reply_page + 1
        yield from rows
        token, page = got.get("next"), page + 1
        if not fresh:
            return


class Video(InputPartition):
    def __init__(self, video: str):
        super().__init__(video)
        self.video = video


class PagedComments(DataSource):
    """spark.read.format("paged_comments").options(fetch="package.module:function", videos='["id", ...]', max_pages=5).load()

    The function runs in the tasks, a task for each video; repeated videos are read once.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_comments"

    def schema(self) -> str:
        return ROW

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(dict(self.options))


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.module, _, self.function = options["fetch"].partition(":")
        self.videos = list(dict.fromkeys(json.loads(options["videos"])))
        self.most = min(int(options.get("max_pages", PAGES)), PAGES)

    def partitions(self) -> list[Video]:
        return [Video(v) for v in self.videos]

    def read(self, partition: Video) -> Iterator[tuple]:
        return fetched(partition.video, getattr(import_module(self.module), self.function), self.most)


def read_comments(spark: SparkSession, fetch: str, videos: list[str], max_pages: int = PAGES) -> DataFrame:
    """ROW of the videos' comments, as a fetch function ("package.module:function") gives their pages."""
    spark.dataSource.register(PagedComments)
    return spark.read.format("paged_comments").options(fetch=fetch, videos=json.dumps(videos), max_pages=max_pages).load()


def threads(pages: DataFrame, reply_pages: DataFrame, max_pages: int = PAGES) -> DataFrame:
    """ROW of landed pages (video_id, page from 1, body JSON) and reply pages (video_id, parent_id, page from 1, body JSON).

    A page's items may be landed in parts, a row for each (part: a number that orders them), so that no row need hold a long page.
    Where a comment is met first is a minimum by video and id, and a page's new ones are a count by video and page: no
    window, so a video of a third of all comments is spread by its ids. A missing page ends nothing. Pages beyond the caps,
    and those after the first page that adds nothing, don't count.
    """
    most = min(max_pages, PAGES)
    part = F.col("part").cast("long") if "part" in pages.columns else F.lit(0).cast("long")
    read = pages.where(F.col("page") <= most).select("video_id", "page", part.alias("part"), F.from_json("body", PAGE)["items"].alias("items"))
    tops = read.select("video_id", "page", "part", F.posexplode("items").alias("pos", "c"))
    tops = tops.select("video_id", "page", F.struct("part", "pos").alias("item"), "c")
    row = lambda c, parent: [F.col(f"{c}.id").alias("comment_id"), parent.alias("parent_id"), *(F.col(f"{c}.{x}").alias(x) for x in ("text", "author", "published_at"))]
    at = lambda kind, page, pos: F.struct("page", "item", F.lit(kind).alias("kind"), page.alias("reply_page"), pos.alias("pos")).alias("at")
    zero = F.lit(0)
    first = tops.select("video_id", at(0, zero, zero), *row("c", F.lit(None).cast("string")))
    near = tops.select("video_id", "page", "item", F.col("c.id").alias("parent"), F.posexplode("c.replies").alias("pos", "r"))
    near = near.select("video_id", at(1, zero, F.col("pos")), *row("r", F.col("parent")))
    wanting = tops.where("coalesce(c.total_replies, 0) > coalesce(size(c.replies), 0)").select("video_id", "page", "item", F.col("c.id").alias("parent_id"))
    replies = reply_pages.where(F.col("page") <= REPLY_PAGES).select("video_id", "parent_id", F.col("page").alias("reply_page"), F.from_json("body", PAGE)["items"].alias("items"))
    more = wanting.join(replies, ["video_id", "parent_id"]).select("video_id", "page", "item", "parent_id", "reply_page", F.posexplode("items").alias("pos", "r"))
    more = more.select("video_id", at(2, F.col("reply_page"), F.col("pos")), *row("r", F.col("parent_id")))
    every = first.unionByName(near).unionByName(more).where("comment_id is not null")
    met = every.groupBy("video_id", "comment_id").agg(F.min_by(F.struct("at", "parent_id", "text", "author", "published_at"), "at").alias("x")).select("video_id", "comment_id", "x.*")
    new = met.where("at.kind < 2").groupBy("video_id", F.col("at.page").alias("page")).agg(F.lit(1).alias("new"))
    last = read.select("video_id", "page").distinct().join(new, ["video_id", "page"], "left_anti").groupBy("video_id").agg(F.min("page").alias("last"))
    kept = met.join(last, "video_id", "left").where("last is null or at.page <= last")
    return kept.select("video_id", "comment_id", "parent_id", "text", "author", "published_at")
