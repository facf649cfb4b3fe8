"""Language-model backends behind one neutral history; the scripted one works offline."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable


class Transient(RuntimeError):
    """The same request may work later."""


class Unavailable(Transient):
    """This model won't answer now; another may."""


class Scripted:
    """Gives prepared replies {text, tool_calls} in order; exceptions among them are raised."""

    def __init__(self, replies: list):
        self.replies, self.seen = list(replies), []

    def complete(self, model: str, system: str, messages: list[dict], tools: list[dict]) -> dict:
        self.seen.append((model, list(messages)))
        reply = self.replies.pop(0)
        if isinstance(reply, Exception):
            raise reply
        return {"text": reply.get("text", ""), "tool_calls": reply.get("tool_calls", [])}


def arguments(raw) -> dict:
    """Tool arguments as a dict; malformed ones are empty."""
    try:
        found = json.loads(raw) if isinstance(raw, str) else raw
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


class Http:
    """A chat-completions endpoint; ``post`` can be replaced for tests."""

    def __init__(self, url: str, key: str = "", post: Callable[[str, dict, dict], dict] | None = None):
        self.url, self.key, self.post = url, key, post or self._post

    def _post(self, url: str, headers: dict, body: dict) -> dict:
        request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
        try:
            with urllib.request.urlopen(request, timeout=120) as r:
                return json.load(r)
        except urllib.error.HTTPError as e:
            kind = Unavailable if e.code == 404 else Transient if e.code in (408, 429) or e.code >= 500 else RuntimeError
            raise kind(f"{e.code} {e.reason}") from e
        except urllib.error.URLError as e:
            raise Transient(str(e.reason)) from e

    def complete(self, model: str, system: str, messages: list[dict], tools: list[dict]) -> dict:
        history = [{"role": "system", "content": system}]
        for m in messages:
            if m["role"] == "tool":
                history.append({"role": "tool", "tool_call_id": m["id"], "content": m["content"]})
            elif m.get("tool_calls"):
                calls = [{"id": c["id"], "type": "function", "function": {"name": c["name"], "arguments": json.dumps(c["args"])}} for c in m["tool_calls"]]
                history.append({"role": "assistant", "content": m.get("text") or None, "tool_calls": calls})
            else:
                history.append({"role": m["role"], "content": m.get("text", "")})
        body = {"model": model, "messages": history, "tools": [{"type": "function", "function": t} for t in tools]}
        reply = self.post(self.url, {"Authorization": f"Bearer {self.key}"} if self.key else {}, body)["choices"][0]["message"]
        calls = [{"id": c["id"], "name": c["function"]["name"], "args": arguments(c["function"]["arguments"])} for c in reply.get("tool_calls") or []]
        return {"text": reply.get("content") or "", "tool_calls": calls}


class HttpParts(Http):
    """An address that takes turns of parts, with functions as parts of their own (the generateContent format)."""

    def complete(self, model: str, system: str, messages: list[dict], tools: list[dict]) -> dict:
        turns: list[dict] = []
        for m in messages:
            if m["role"] == "tool":
                role, parts = "user", [{"functionResponse": {"name": m["name"], "response": {"result": m["content"]}}}]
            else:
                role = "user" if m["role"] == "user" else "model"
                parts = [{"text": m.get("text") or ""}] if m.get("text") or not m.get("tool_calls") else []
                parts += [{"functionCall": {"name": c["name"], "args": c["args"]}} for c in m.get("tool_calls") or []]
            if turns and turns[-1]["role"] == role == "user" and m["role"] == "tool":  # results of one turn go together
                turns[-1]["parts"] += parts
            else:
                turns.append({"role": role, "parts": parts})
        # this format has no empty parameter lists
        listed = [{k: v for k, v in t.items() if k != "parameters" or v["properties"]} for t in tools]
        body = {"systemInstruction": {"parts": [{"text": system}]}, "contents": turns, "tools": [{"functionDeclarations": listed}]}
        reply = self.post(self.url.format(model=model), {"x-goog-api-key": self.key} if self.key else {}, body)
        parts = ((reply.get("candidates") or [{}])[0].get("content") or {}).get("parts") or []
        calls = [{"id": f"call_{i}", "name": p["functionCall"]["name"], "args": arguments(p["functionCall"].get("args") or {})} for i, p in enumerate(parts) if "functionCall" in p]
        return {"text": "".join(p.get("text", "") for p in parts) or ("" if calls else "The model gave no answer."), "tool_calls": calls}


def make_backend(kind: str, **options):
    if kind == "scripted":
        return Scripted(options["replies"])
    if kind in ("http", "parts"):
        return (Http if kind == "http" else HttpParts)(options["url"], options.get("key", ""), options.get("post"))
    raise ValueError(f"unknown backend {kind}")
