"""What needs a network, behind small interfaces that tests replace.

Nothing here is called by a query. A fetcher is any callable (method, url, headers, params, body) -> (status, bytes).
"""

from __future__ import annotations

import json
import threading
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from typing import Any

Fetch = Callable[[str, str, dict, dict, bytes | None], tuple[int, bytes]]
TRIES, RETRIED = 3, frozenset({429, 500, 502, 503, 504})


def urllib_fetch(method: str, url: str, headers: dict, params: dict, body: bytes | None) -> tuple[int, bytes]:
    target = url + ("?" + urllib.parse.urlencode(params) if params else "")
    request = urllib.request.Request(target, data=body, headers=headers, method=method)
    try:
        with urllib.request.urlopen(request, timeout=60) as answer:
            return answer.status, answer.read()
    except urllib.error.HTTPError as error:
        return error.code, error.read()


class Pace:
    """At least so many seconds between two calls, for all threads of a process."""

    def __init__(self, seconds: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.seconds, self._clock, self._sleep = seconds, clock, sleep
        self._lock, self._next = threading.Lock(), float("-inf")

    def wait(self) -> None:
        with self._lock:
            now = self._clock()
            if now < self._next:
                self._sleep(self._next - now)
                now = self._next
            self._next = now + self.seconds


class Client:
    """Requests with three tries, each pause twice the last, on errors that may pass."""

    def __init__(self, fetch: Fetch = urllib_fetch, pace: Pace | None = None, headers: dict | None = None, sleep: Callable[[float], None] = time.sleep) -> None:
        self._fetch, self._pace, self._headers, self._sleep = fetch, pace or Pace(0), headers or {}, sleep

    def content(self, url: str, params: dict | None = None, method: str = "GET", body: bytes | None = None) -> bytes:
        for attempt in range(TRIES):
            self._pace.wait()
            try:
                status, data = self._fetch(method, url, self._headers, params or {}, body)
            except OSError:
                status, data = 503, b""
            if status < 400:
                return data
            if status not in RETRIED:
                break
            if attempt + 1 < TRIES:
                self._sleep(2.0**attempt)
        raise ConnectionError(f"{url}: status {status}")

    def json(self, url: str, params: dict | None = None) -> Any:
        return json.loads(self.content(url, params))

    def paged(self, url: str, field: str, params: dict | None = None, size: int = 25) -> Iterator[dict]:
        """The records of a field over all pages, by offset."""
        offset = 0
        while True:
            records = self.json(url, {**(params or {}), "offset": offset, "limit": size}).get(field) or []
            yield from records
            if len(records) < size:
                return
            offset += size


def product_rows(answer: dict) -> list[dict]:
    """name, description, url of a shop's search answer."""
    rows = answer.get("search_results") or answer.get("results") or []
    return [{"name": r.get("title") or r.get("name") or "", "description": r.get("description") or "", "url": r.get("link") or r.get("url")} for r in rows]
