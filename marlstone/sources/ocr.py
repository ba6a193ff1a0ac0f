"""Pages read by a text recognition service: many at once, tried again one by one, at a bounded rate."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Reads one file's bytes and gives {"blocks": [{"type", "text", "page", "confidence"}]}.
Engine = Callable[[bytes], dict]
SCHEMA = "path string, seq int, type string, text string, page int, confidence double, tries int, error string"


class Unreadable(Exception):
    """The service won't read a file however often it is asked."""


def service(endpoint: str, key: str = "", seconds: float = 300) -> Engine:
    """A service that takes a file as the part `file` of a form, with a bearer key, and answers with JSON. Answers 400 to 499, but for
    408 and 429, are final."""

    def read(content: bytes) -> dict:
        mark = uuid.uuid4().hex
        head = f'--{mark}\r\nContent-Disposition: form-data; name="file"; filename="page"\r\nContent-Type: application/octet-stream\r\n\r\n'
        body = head.encode() + content + f"\r\n--{mark}--\r\n".encode()
        asked = urllib.request.Request(endpoint, body, {"Content-Type": f"multipart/form-data; boundary={mark}", "Authorization": f"Bearer {key}"})
        try:
            with urllib.request.urlopen(asked, timeout=seconds) as answer:
                return json.load(answer)
        except urllib.error.HTTPError as e:
            if 400 <= e.code < 500 and e.code not in (408, 429):
                raise Unreadable(f"answer {e.code}") from e
            raise

    return read


def fixed(content: bytes) -> dict:
    """Stands in for a service: the same three blocks for every file."""
    kinds = [("heading", "Summary of findings"), ("paragraph", "The record was examined and nothing else was found. " * 8), ("table", "item | value\nheight | 170")]
    return {"blocks": [{"type": t, "text": x, "page": 1 + (t == "table")} for t, x in kinds]}


def recognised(files: DataFrame, engine: Engine, retries: int = 2, wait: float = 1.0, per_second: float | None = None) -> DataFrame:
    """Blocks of files (path, content), with the defaults of stored ones: type other, page 1, confidence 1.

    A file is tried again after wait, 2 * wait, ... seconds, by itself; one that can't be read, or whose answer has no blocks to read,
    is one row with its error, and the others go on. per_second bounds each task's calls, so the service's rate is that times the
    tasks that run at once; repartition files to choose how many. A null content is an error without a call.
    """

    def one(content: bytes | None, last: list[float]) -> tuple[list[dict], int, str | None]:
        if content is None:
            return [], 0, "no content"
        for tried in range(1, retries + 2):
            if per_second:
                time.sleep(max(0.0, last[0] + 1 / per_second - time.monotonic()))
                last[0] = time.monotonic()
            try:
                return list(engine(bytes(content))["blocks"]), tried, None
            except Unreadable as e:
                return [], tried, str(e)
            except Exception as e:  # noqa: BLE001
                error = f"{type(e).__name__}: {e}"[:200]
                if tried <= retries:
                    time.sleep(wait * 2 ** (tried - 1))
        return [], retries + 1, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = [0.0]
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                found, tries, error = one(content, last)
                rows += [(path, i, b.get("type") or "other", b.get("text"), b.get("page") or 1, 1.0 if b.get("confidence") is None else float(b["confidence"]), tries, None) for i, b in enumerate(found)]
                if error:
                    rows.append((path, None, None, None, None, None, tries, error))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
            yield out.astype({"seq": "Int32", "page": "Int32", "tries": "Int32"})

    return files.select("path", "content").mapInPandas(run, SCHEMA)
