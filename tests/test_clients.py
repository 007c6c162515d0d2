"""Pace, patience and requests of back ends with stub services; settings of local models."""

import pytest

from folio.operators import clients


def test_rate_limiter_spaces_calls():
    now, slept = [100.0], []

    def sleep(s):
        slept.append(round(s, 3))
        now[0] += s

    limiter = clients.RateLimiter(2.0, clock=lambda: now[0], sleep=sleep)
    assert [round(limiter.acquire(), 3) for _ in range(3)] == [0.0, 0.5, 0.5] and slept == [0.5, 0.5]
    now[0] += 10
    assert limiter.acquire() == 0.0


def test_web_translator_waits_and_gives_up():
    said, slept = [(429, {}, None), (429, {"Retry-After": "7"}, None), (200, {}, ["good ", None, "day"])], []
    web = clients.WebTranslator(lambda address, request: said.pop(0), per_second=1e9, sleep=slept.append, jitter=lambda: 0.5)
    assert web.translate(["guten Tag"], "en") == ["good  day"] and slept[:2] == [10.5, 7.0] and web.generate("x") is None
    slept.clear()
    web = clients.WebTranslator(lambda address, request: (429, {}, None), per_second=1e9, sleep=slept.append, jitter=lambda: 0.0)
    assert web.one("x", "en") is None and [s for s in slept if s >= 1] == [10, 20, 40, 80, 160, 300, 300]
    assert clients.WebTranslator(lambda address, request: (500, {}, None), per_second=1e9).one("x", "en") is None

    def broken(address, request):
        raise OSError

    assert clients.WebTranslator(broken, per_second=1e9).one("x", "en") is None


def test_chat_translator_builds_requests_and_falls_back():
    seen = []

    def send(address, request):
        seen.append((address, request))
        if address == "chat/completions":
            return 404, {}, None
        return 200, {}, {"choices": [{"text": " ответ " if len(seen) > 2 else " "}]}

    chat = clients.ChatTranslator(send, "m", "Translate.", per_second=1e9, sleep=lambda s: None, accept=lambda t, a, lang: "ответ" in a)
    assert chat.translate_in_context(["text"], "ru", ["before"], ["after"]) == ["ответ"]
    assert [a for a, _ in seen] == ["chat/completions", "completions"] * 2 and seen[0][1]["temperature"] == 0.0 and seen[2][1]["temperature"] == 0.1
    assert seen[0][1]["messages"][1]["content"] == "Translate.\n\n[CTX]\nbefore\n[/CTX]\n\n[SRC]\ntext\n[/SRC]\n\n[CTX]\nafter\n[/CTX]\n\n[OUT]"
    ill = clients.ChatTranslator(lambda address, request: (500, {}, None), per_second=1e9, sleep=lambda s: None)
    assert ill.translate(["x"], "ru") == [None] and not ill.healthy and ill.generate("x") is None
    assert [clients.token_budget("x" * n) for n in (0, 1000, 99999)] == [512, 1012, 4096]


def test_settings_and_timer():
    assert clients.model_settings("FAST", {})["beam_size"] == 2 and clients.model_settings("none", {})["beam_size"] == 4
    own = clients.model_settings(None, {"NMT_BEAM_SIZE": "3", "NMT_PATIENCE": "x", "NMT_NO_REPEAT_NGRAM": "5"})
    assert own["beam_size"] == 3 and own["patience"] == 1.0 and own["no_repeat_ngram_size"] == 5
    stages, ticks = {}, iter([1.0, 3.0, 5.0, 6.0])
    with clients.timed(stages, "a", lambda: next(ticks)):
        pass
    with pytest.raises(KeyError), clients.timed(stages, "a", lambda: next(ticks)):
        raise KeyError
    assert stages == {"a": 3.0}
    clients.STOP.set()
    try:
        clients.wait(60)
        assert clients.ChatTranslator(lambda a, r: (200, {}, {"content": "x"}), per_second=1e9).translate(["t"], "ru") == [None]
    finally:
        clients.STOP.clear()
