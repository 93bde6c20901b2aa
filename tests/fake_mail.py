"""Mail clients: one with two pages, whose unauthenticated message is left out on demand, and an inbox in a JSON file."""

import json
from pathlib import Path


class Client:
    def list_page(self, token, include_unauthenticated):
        first = [{"message_id": "m1", "thread_id": "t", "received_at": "2026-01-01", "sender": "a@x.org",
            "recipients": ["b@x.org", "c@x.org"], "subject": "s"}]
        second = [{"message_id": "m2", "sender": "e@x.org"}] if include_unauthenticated else []
        return (first, "next") if token is None else (second, None)


class Inbox:
    """A file of items, oldest first, in pages of three. Items with bad raise when they are fetched, and each fetch is noted."""

    def __init__(self, path):
        self.path = Path(path)

    def items(self):
        return json.loads(self.path.read_text())

    def list_page(self, token, include_unauthenticated):
        items = [x for x in self.items() if include_unauthenticated or not x.get("spoofed")]
        at = int(token or 0)
        return items[at : at + 3], str(at + 3) if len(items) > at + 3 else None

    def fetch(self, message_id):
        with self.path.with_suffix(".fetched").open("a") as f:
            f.write(message_id + "\n")
        item = next(x for x in self.items() if x["message_id"] == message_id)
        if item.get("bad"):
            raise TimeoutError("secret detail")
        return {"text": f"body of {message_id}"}


def make():
    return Client()


def inbox(path):
    return Inbox(path)
