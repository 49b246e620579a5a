"""A client for chat services that stream their answers, and calls kept in flight from inside a task.

A task runs an event loop: up to `in_flight` calls are out at a time, endpoints take turns, answers come back
in the order of the rows.  A call that fails in a way that another try may mend is made again after a wait
that doubles; the service's state, not the kind of the error alone, decides.
"""

from __future__ import annotations

import asyncio
import json
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from http.client import HTTPConnection, HTTPException, HTTPSConnection
from typing import Any
from urllib.parse import urlsplit

from ..functions.text import first_json

#: States of a service after which another try may help, besides all from 500 on.
RETRIED = (408, 409, 425, 429)
Client = Callable[[str], dict | None]


class ServiceError(Exception):
    def __init__(self, status: int, body: str = "") -> None:
        super().__init__(f"status {status}: {body[:400]}")
        self.status = status


def streamed_text(lines: Iterable[bytes]) -> str:
    """The text of a streamed answer: JSON lines, 'data:' before them or not, each with a piece; other lines are passed over."""
    parts = []
    for raw in lines:
        line = raw.decode("utf-8", errors="ignore").strip().removeprefix("data:").strip()
        if not line.startswith("{"):
            continue
        try:
            piece = json.loads(line)
            parts.append(_piece(piece))
        except (ValueError, AttributeError):
            continue
    return "".join(parts)


def _piece(answer: dict) -> str:
    return (answer.get("message") or {}).get("content") or answer.get("response") or ""


@dataclass(frozen=True)
class ChatClient:
    """One endpoint: a prompt goes out, the JSON object in the answer's text comes back (an error where there is none).

    timeout: seconds without a byte; options: the service's own.
    """

    url: str
    model: str
    timeout: float = 300
    connect_timeout: float = 10
    stream: bool = True
    keep_alive: str | None = "15m"
    options: dict[str, Any] = field(default_factory=dict)

    def __call__(self, prompt: str) -> dict:
        found = first_json(self.text(prompt))
        answer = json.loads(found) if found else None
        if not isinstance(answer, dict) or not answer:
            raise ValueError("no JSON object in the answer")
        return answer

    def text(self, prompt: str) -> str:
        at = urlsplit(self.url.rstrip("/") + "/api/chat")
        body = {"model": self.model, "messages": [{"role": "user", "content": prompt}], "stream": self.stream, "options": self.options}
        if self.keep_alive is not None:
            body["keep_alive"] = self.keep_alive
        kind = HTTPSConnection if at.scheme == "https" else HTTPConnection
        connection = kind(at.hostname, at.port, timeout=self.connect_timeout)
        try:
            connection.connect()
            connection.sock.settimeout(self.timeout)
            connection.request("POST", at.path, json.dumps(body), {"Content-Type": "application/json"})
            answer = connection.getresponse()
            if answer.status >= 400:
                raise ServiceError(answer.status, answer.read(400).decode("utf-8", errors="replace"))
            return streamed_text(answer) if self.stream else _piece(json.loads(answer.read()))
        except HTTPException as e:
            raise ConnectionError(str(e) or type(e).__name__) from e
        finally:
            connection.close()


def may_mend(error: Exception) -> bool:
    """Whether another try may help: by the state, if the error has one; else it does, as for lost connections, timeouts and answers without JSON."""
    status = getattr(error, "status", None)
    return status is None or status in RETRIED or status >= 500


@dataclass
class Answer:
    answer: dict | None
    error: str | None
    tries: int
    seconds: float  # of the last try


async def ask(run: Callable[[str], Any], prompt: str, tries: int, wait: float, timeout: float | None, pause: Callable[[float], Any] = asyncio.sleep) -> Answer:
    """The answer, or the last error, of a call that runs beside others; waits 1, 2, 4, ... times `wait` seconds between tries."""
    error, start = "", 0.0
    for k in range(tries):
        start = time.perf_counter()
        try:
            answer = await asyncio.wait_for(run(prompt), timeout)
            if not isinstance(answer, dict):
                raise ValueError("the answer is no object")
            return Answer(answer, None, k + 1, time.perf_counter() - start)
        except Exception as e:  # noqa: BLE001  a client's failures are its own kinds
            error = f"{type(e).__name__}: {e}"
            if not may_mend(e) or k + 1 == tries:
                return Answer(None, error, k + 1, time.perf_counter() - start)
            await pause(wait * 2**k)
    return Answer(None, error, 0, 0.0)


def asked(prompts: Iterable[tuple[Any, str]], clients: list[Client], *, in_flight: int = 8, tries: int = 3, wait: float = 0.75, timeout: float | None = None) -> Iterator[tuple[Any, Answer]]:
    """(key, answer) of each (key, prompt), in order, while up to `in_flight` calls are out.

    The k-th prompt goes to client k modulo their number.  Some prompts are read ahead, so that a slow
    answer doesn't stop those behind it, but not more than four times `in_flight`.
    """
    loop = asyncio.new_event_loop()
    pool = ThreadPoolExecutor(max_workers=in_flight)
    gate = asyncio.Semaphore(in_flight)

    async def one(prompt: str, client: Client) -> Answer:
        async with gate:
            return await ask(lambda p: loop.run_in_executor(pool, client, p), prompt, tries, wait, timeout)

    out: deque = deque()
    try:
        for k, (key, prompt) in enumerate(prompts):
            out.append((key, loop.create_task(one(prompt, clients[k % len(clients)]))))
            if len(out) >= 4 * in_flight:
                first, task = out.popleft()
                yield first, loop.run_until_complete(task)
        while out:
            first, task = out.popleft()
            yield first, loop.run_until_complete(task)
    finally:
        if out:
            for _, task in out:
                task.cancel()
            loop.run_until_complete(asyncio.wait([t for _, t in out]))
        pool.shutdown(wait=False, cancel_futures=True)
        loop.close()
