"""Mail as Spark sources: listings in batch and as a stream with offsets, and bodies fetched on executors.

A listing comes in pages, the oldest mail first, so that new mail makes the last page longer or comes on later ones. The
client is any object with list_page(token, include_unauthenticated) -> (items, next token) and fetch(message_id) -> item,
named by the option client as module:factory or module:factory:argument, so executors build their own; nothing else
talks to a network.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from quillstone.functions.exprs import body_of

LISTING = "message_id string, thread_id string, received_at string, sender string, recipients array<string>, subject string"
PAGE_SIZE = 100
#: Messages that one task fetches.
FETCH_CHUNK = 200


class AuthRequiredError(RuntimeError):
    """The mail account wants a new login."""


def make_client(name: str):
    module, factory, *argument = name.split(":", 2)
    return getattr(importlib.import_module(module), factory)(*argument)


def _row(item: dict) -> tuple:
    return tuple(item.get(c.split()[0]) for c in LISTING.split(", "))


class MailListing(DataSource):
    """spark.read or spark.readStream, .format("mail_listing").option("client", "module:factory").load()"""

    @classmethod
    def name(cls) -> str:
        return "mail_listing"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


class _Options:
    def __init__(self, options: dict):
        self.options = dict(options)

    def page(self, client, token: str | None) -> tuple[list[dict], str | None]:
        return client.list_page(token, self.options.get("unauthenticated", "true") == "true")


class _Reader(_Options, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return [InputPartition(None)]  # page tokens chain, so a listing is read in order

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        client, token = make_client(self.options["client"]), None
        while True:
            items, token = self.page(client, token)
            yield from map(_row, items)
            if not token:
                return


@dataclass
class _Page(InputPartition):
    """Items first to last of the page of a token; no last: all of it."""

    token: str | None
    first: int
    last: int | None


class _StreamReader(_Options, DataSourceStreamReader):
    """An offset is a page's token, and how many of its items were read. The driver follows the tokens and keeps one; tasks read a page
    each. A batch has all that came since the last one; a query that is started anew follows the tokens from the beginning."""

    def initialOffset(self) -> dict:
        return {"token": None, "read": 0}

    def _walk(self, start: dict, end: dict | None = None) -> Iterator[tuple[str | None, int, str | None]]:
        """(token, items on the page, next token) of the pages from start on, up to that of end."""
        client, token = make_client(self.options["client"]), start["token"]
        while True:
            items, after = self.page(client, token)
            yield token, len(items), after
            if not after or end is not None and token == end["token"]:
                return
            token = after

    def latestOffset(self) -> dict:
        at = getattr(self, "_at", None) or self.initialOffset()
        for token, n, _ in self._walk(at):
            at = {"token": token, "read": n}
        return at

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for token, n, _ in self._walk(start, end):
            first = start["read"] if token == start["token"] else 0
            last = end["read"] if token == end["token"] else n
            if last > first:
                out.append(_Page(token, first, last))
            if token == end["token"]:
                break
        return out

    def read(self, partition: _Page) -> Iterator[tuple]:
        items, _ = self.page(make_client(self.options["client"]), partition.token)
        yield from map(_row, items[partition.first : partition.last])

    def commit(self, end: dict) -> None:
        self._at = end


def fetched(listed: DataFrame, client: str) -> DataFrame:
    """Listed rows with text and html of each message, fetched by tasks of at most about FETCH_CHUNK messages; error names the type of
    what a fetch raised, and its row stays. Put the anti-join against known messages before this. A lost login fails the whole."""
    schema = StructType([*listed.schema.fields, *[StructField(c, StringType()) for c in ("text", "html", "error")]])

    def one(of, message_id: str) -> tuple:
        try:
            item = of.fetch(message_id)
            return item.get("text"), item.get("html"), None
        except AuthRequiredError:
            raise
        except Exception as e:  # whatever a client raises becomes a row that a later run tries again
            return None, None, type(e).__name__

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = None
        for b in batches:
            of = of or make_client(client)
            made = [one(of, m) for m in b["message_id"]]
            yield b.assign(**{c: [m[i] for m in made] for i, c in enumerate(("text", "html", "error"))})

    tasks = max(1, -(-listed.count() // FETCH_CHUNK))
    return listed.repartition(tasks, "message_id").mapInPandas(run, schema)


def with_authentication(listing: DataFrame, authenticated: DataFrame) -> DataFrame:
    """Listing rows with sender_authenticated, by whether the listing that leaves unauthenticated mail out has them too."""
    known = authenticated.select("message_id", F.lit("AUTHENTICATED").alias("sender_authenticated")).distinct()
    return listing.join(known, "message_id", "left").withColumn("sender_authenticated",
        F.coalesce("sender_authenticated", F.lit("UNAUTHENTICATED")))


def as_messages(fetched: DataFrame) -> DataFrame:
    """Fetched messages (text, html, recipients array) in the form they are stored."""
    body = body_of(F.col("text"), F.col("html"))
    return fetched.withColumn("__b", body).withColumns({
        "body_raw": F.col("__b.body"), "body_format": F.col("__b.format"),
        "recipients": F.coalesce(F.array_join("recipients", ", "), F.lit("")), "size_bytes": F.octet_length(F.col("__b.body")),
        "feedback_parse_status": F.lit("UNPARSED")}).drop("__b", "text", "html")
