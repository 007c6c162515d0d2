"""What back ends of translation need around a service: pace, patience, requests, settings, clocks.

No service is reached from here: a client is given a ``send`` function, so that tests give it one of their own.
"""

from __future__ import annotations

import os
import random
import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

#: Set to end every wait and every loop of attempts.
STOP = threading.Event()
#: (address, request) -> (status, headers, body)
Send = Callable[[str, dict], tuple[int, dict, Any]]

# Attempts, delays and budgets of the back ends.
BUSY, ATTEMPTS, FIRST_DELAY, LONGEST_DELAY, JITTER = 429, 8, 10.0, 300.0, 2.0
TEMPERATURES, LEAST_TOKENS, MOST_TOKENS = (0.0, 0.1, 0.2), 512, 4096
NO_ENDPOINT = (404, 405, 501)
PRESETS = {
    "fast": {"beam_size": 2, "patience": 0.7, "repetition_penalty": 1.02, "no_repeat_ngram_size": 4, "max_batch_size": 32},
    "balanced": {"beam_size": 4, "patience": 1.0, "repetition_penalty": 1.02, "no_repeat_ngram_size": 4, "max_batch_size": 16},
    "quality": {"beam_size": 6, "patience": 1.0, "repetition_penalty": 1.02, "no_repeat_ngram_size": 4, "max_batch_size": 16},
    "max": {"beam_size": 8, "patience": 1.2, "repetition_penalty": 1.05, "no_repeat_ngram_size": 4, "max_batch_size": 16},
}


def wait(seconds: float, sleep: Callable[[float], None] | None = None) -> None:
    """Sleeps unless, or until, STOP is set."""
    if sleep is not None:
        sleep(seconds)
    else:
        STOP.wait(max(0.0, seconds))


@contextmanager
def timed(stages: dict[str, float], name: str, clock: Callable[[], float] = time.perf_counter) -> Iterator[None]:
    """Adds the seconds of a block of work to ``stages[name]``, whether it ends well or not."""
    began = clock()
    try:
        yield
    finally:
        stages[name] = stages.get(name, 0.0) + clock() - began


class RateLimiter:
    """At most so many calls a second from all threads of a worker (X12): each call takes the next free moment."""

    def __init__(self, per_second: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] | None = None):
        self.interval, self.clock, self.sleep = 1.0 / per_second, clock, sleep
        self.free, self.lock = clock(), threading.Lock()

    def acquire(self) -> float:
        """Waits for its turn; the seconds it waited."""
        with self.lock:
            now = self.clock()
            turn = max(now, self.free)
            self.free = turn + self.interval
        if turn > now:
            wait(turn - now, self.sleep)
        return turn - now


class WebTranslator:
    """A service that is asked by one request a text (X02). Told to wait, it does, longer each time, up to ATTEMPTS times."""

    name = "web"

    def __init__(self, send: Send, address: str = "", per_second: float = 0.5, sleep: Callable[[float], None] | None = None, jitter: Callable[[], float] | None = None):
        self.send, self.address, self.sleep = send, address, sleep
        self.jitter = jitter or (lambda: random.uniform(0, JITTER))
        self.limiter = RateLimiter(per_second, sleep=sleep)

    def one(self, text: str, lang: str) -> str | None:
        self.limiter.acquire()
        for attempt in range(ATTEMPTS):
            try:
                status, headers, body = self.send(self.address, {"text": text, "target": lang})
            except OSError:
                return None
            if status == 200:
                parts = [p for p in body if p] if isinstance(body, list) else [body]
                return " ".join(map(str, parts)).strip() or None
            if status != BUSY or attempt + 1 == ATTEMPTS or STOP.is_set():
                return None
            told = str(headers.get("Retry-After", ""))
            wait(float(told) if told.isdigit() else min(FIRST_DELAY * 2**attempt, LONGEST_DELAY) + self.jitter(), self.sleep)
        return None

    def translate(self, texts: list[str], lang: str) -> list[str | None]:
        return [self.one(t, lang) for t in texts]

    def generate(self, prompt: str) -> str | None:
        """Such a service writes nothing of its own."""
        return None


def token_budget(text: str) -> int:
    """Tokens an answer may have: half the text's characters and LEAST_TOKENS, within bounds."""
    return max(LEAST_TOKENS, min(MOST_TOKENS, len(text) // 2 + LEAST_TOKENS))


def chat_prompt(instruction: str, text: str, before: str = "", after: str = "") -> str:
    """Instruction, context and text between the markers that answers are stripped of."""
    around = lambda c: ["[CTX]", c, "[/CTX]", ""] if c else []
    return "\n".join([instruction, "", *around(before), "[SRC]", text, "[/SRC]", "", *around(after), "[OUT]"])


class ChatTranslator:
    """A language model behind an interface of chats, or of completions where that one is missing.

    An answer that ``accept(text, answer, lang)`` turns down is asked for again, a little warmer, after a pause. After three
    failures in a row it counts as ill.
    """

    name = "chat"

    def __init__(
        self, send: Send, model: str = "", instruction: str = "", per_second: float = 1.0, attempts: int = 3, accept: Callable[[str, str, str], bool] | None = None,
        sleep: Callable[[float], None] | None = None,
    ):
        self.send, self.model, self.instruction, self.attempts, self.sleep = send, model, instruction, attempts, sleep
        self.accept = accept or (lambda text, answer, lang: bool(answer.strip()))
        self.limiter, self.failures = RateLimiter(per_second, sleep=sleep), 0

    @property
    def healthy(self) -> bool:
        return self.failures < 3

    def complete(self, prompt: str, temperature: float, tokens: int) -> str | None:
        self.limiter.acquire()
        settings = {"model": self.model, "temperature": temperature, "top_p": 0.9, "max_tokens": tokens, "stream": False}
        said = [{"role": "system", "content": self.instruction}, {"role": "user", "content": prompt}]
        for address, what in (("chat/completions", {"messages": said}), ("completions", {"prompt": prompt})):
            try:
                status, _, body = self.send(address, settings | what)
            except OSError:
                break
            if status == 200:
                self.failures = 0
                first = (body.get("choices") or [{}])[0]
                answer = (first.get("message") or {}).get("content") or first.get("text") or body.get("content")
                return str(answer).strip() if answer else None
            if status not in NO_ENDPOINT:
                break
        self.failures += 1
        return None

    def translate_in_context(self, texts: list[str], lang: str, before: list[str], after: list[str]) -> list[str | None]:
        out: list[str | None] = []
        for text, b, a in zip(texts, before, after):
            good = None
            for attempt in range(self.attempts):
                if STOP.is_set() or not self.healthy:
                    break
                answer = self.complete(chat_prompt(self.instruction, text, b, a), TEMPERATURES[attempt % len(TEMPERATURES)], token_budget(text))
                if answer is not None and self.accept(text, answer, lang):
                    good = answer
                    break
                if attempt + 1 < self.attempts:
                    wait(min(1.5 * 2**attempt, 8.0), self.sleep)
            out.append(good)
        return out

    def translate(self, texts: list[str], lang: str) -> list[str | None]:
        return self.translate_in_context(texts, lang, [""] * len(texts), [""] * len(texts))

    def generate(self, prompt: str) -> str | None:
        return self.complete(prompt, 0.2, 1024)


def model_settings(quality: str | None = None, env: dict[str, str] | None = None) -> dict[str, float]:
    """Numbers of a preset for a local model, overridden by variables NMT_... that are numbers (X04); unknown presets are ``balanced``."""
    found = dict(PRESETS.get((quality or "quality").strip().lower(), PRESETS["balanced"]))
    env = dict(os.environ) if env is None else env
    for key in found:
        raw = env.get("NMT_" + {"no_repeat_ngram_size": "NO_REPEAT_NGRAM"}.get(key, key.upper()), "")
        try:
            found[key] = type(found[key])(raw) if raw else found[key]
        except ValueError:
            continue
    return found
