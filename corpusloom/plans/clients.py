"""Clients of model services for `ml.label_posts`: plain HTTP, retries with growing pauses."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable

AGAIN = {408, 429, 500, 502, 503, 504}

Send = Callable[[str, dict, dict, float], dict]


def post(url: str, payload: dict, headers: dict, timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.loads(answer.read())


class HttpClient:
    """Answers of a chat endpoint. Busy and broken services are tried again after 1, 2, 3 ... times `pause` seconds."""

    def __init__(self, url: str, model: str, key: str = "", timeout: float = 120, retries: int = 3, pause: float = 2.0, temperature: float = 0.0, send: Send = post):
        self.url, self.model, self.timeout, self.retries, self.pause, self.temperature, self.send = url.rstrip("/"), model, timeout, retries, pause, temperature, send
        self.headers = {"Authorization": f"Bearer {key}"} if key else {}

    def call(self, path: str, payload: dict) -> dict:
        for attempt in range(1, self.retries + 1):
            try:
                return self.send(self.url + path, payload, self.headers, self.timeout)
            except urllib.error.HTTPError as problem:
                if problem.code not in AGAIN or attempt == self.retries:
                    raise
            except (urllib.error.URLError, TimeoutError):
                if attempt == self.retries:
                    raise
            time.sleep(self.pause * attempt)
        raise ValueError("retries must be positive")

    def __call__(self, prompt: str) -> str:
        message = [{"role": "user", "content": prompt}]
        out = self.call("/v1/chat/completions", {"model": self.model, "messages": message, "temperature": self.temperature})
        return out["choices"][0]["message"]["content"] or ""


class LocalClient(HttpClient):
    """A local model server with a chat endpoint; servers without one are asked through their older generate endpoint."""

    def __call__(self, prompt: str) -> str:
        options = {"model": self.model, "stream": False, "options": {"temperature": self.temperature}}
        try:
            return self.call("/api/chat", {**options, "messages": [{"role": "user", "content": prompt}]})["message"]["content"] or ""
        except urllib.error.HTTPError as problem:
            if problem.code != 404:
                raise
        return self.call("/api/generate", {**options, "prompt": prompt})["response"] or ""


def client(settings: dict, **more) -> HttpClient:
    """A client by the setting `provider`: local or any service with the common chat interface."""
    kind = {"local": LocalClient, "http": HttpClient}[settings.get("provider", "local")]
    return kind(settings["url"], settings["model"], settings.get("api_key", ""), **more)
