"""Calls of an outside model: pace, retries, and what comes back as JSON. Models themselves are the caller's."""

from __future__ import annotations

import json
import re
import time
from collections import deque
from collections.abc import Callable

#: Seconds a pace looks back; seconds that a server's own delay is lengthened by; seconds before a lost line is tried again.
SPAN, MARGIN, OFFLINE = 60.0, 2.0, 20.0


def throttled(call: Callable, per_minute: int, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """call, at most per_minute times in any minute; 0 sets no pace."""
    made: deque[float] = deque()

    def paced(*args: object, **kwargs: object) -> object:
        while per_minute > 0:
            now = clock()
            while made and now - made[0] >= SPAN:
                made.popleft()
            if len(made) < per_minute:
                break
            sleep(SPAN - (now - made[0]))
        made.append(clock())
        return call(*args, **kwargs)

    return paced


def retry_delay(message: str) -> float | None:
    """The seconds after which a server says it can be asked again, or None."""
    m = re.search(r"(?:retry(?:Delay)?\D{0,12}|in\s+)(\d+(?:\.\d+)?)\s*s", message or "", re.I)
    return float(m.group(1)) if m else None


def retried(call: Callable, attempts: int, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """call, tried again after an error: a ValueError (no JSON) after 1, 2, 4... seconds, a ConnectionError after OFFLINE
    seconds, any other after the delay its message names and MARGIN, else as a ValueError. The last error is raised."""
    def patient(*args: object, **kwargs: object) -> object:
        for k in range(attempts):
            try:
                return call(*args, **kwargs)
            except Exception as e:
                if k == attempts - 1:
                    raise
                asked = None if isinstance(e, ValueError) else retry_delay(str(e))
                sleep(OFFLINE if isinstance(e, ConnectionError) else 2.0**k if asked is None else asked + MARGIN)
        raise ValueError("no attempt allowed")

    return patient


def fenced_json(text: str) -> list[dict]:
    """The objects of a model's answer, with or without a code fence around it; a single one is a list of one."""
    body = re.sub(r"^\s*```[a-z]*\s*|\s*```\s*$", "", text or "", flags=re.I)
    got = json.loads(body)
    return [got] if isinstance(got, dict) else got
