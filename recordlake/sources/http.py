"""Driver-side fetch of one asset, with retries; for small control files, not for data."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable

# Answers that are worth another try.
RETRYABLE = {408, 429, 500, 502, 503, 504}


def wait_before(attempt: int, retry_after: str | None, most: float = 30.0) -> float:
    """Seconds before the next try: the server's wish, else a power of two, at most `most`."""
    if retry_after and retry_after.strip().isdigit():
        return min(most, float(retry_after))
    return min(most, float(2**attempt))


def fetch(url: str, attempts: int = 6, timeout: float = 120.0, opener: Callable = urllib.request.urlopen, sleep: Callable = time.sleep) -> bytes:
    for k in range(attempts):
        try:
            with opener(url, timeout=timeout) as r:
                return r.read()
        except urllib.error.HTTPError as e:
            if e.code not in RETRYABLE or k == attempts - 1:
                raise
            sleep(wait_before(k, e.headers.get("Retry-After") if e.headers else None))
        except (urllib.error.URLError, TimeoutError):
            if k == attempts - 1:
                raise
            sleep(wait_before(k, None))
    raise RuntimeError("unreachable")


def first_good(urls: list[str], get: Callable[[str], bytes] = fetch) -> bytes:
    """The first candidate that can be fetched; the last error if none can."""
    last: Exception | None = None
    for u in dict.fromkeys(u for u in urls if u):
        try:
            return get(u)
        except OSError as e:
            last = e
    raise last or ValueError("no candidate URL")
