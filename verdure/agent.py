"""A tool-calling loop over a chain of models."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from verdure.backends import Transient, Unavailable
from verdure.config import QUALITY, STAGES
from verdure.tools import tool_list

STEPS, RETRIES, REPLY = 25, 2, 20_000


class Agent:
    """``models``: names for the backend, or (backend, name) pairs where others take over."""

    def __init__(self, backend, tools: Callable[[str, dict], object], models: list[str], log: Callable[[str], None] = print, sleep: Callable[[float], None] = time.sleep):
        self.backend, self.tools, self.models, self.log, self.sleep = backend, tools, list(models), log, sleep
        self.messages: list[dict] = []
        self.active = 0

    def system(self) -> str:
        listed = lambda names: "; ".join(f"{k} {v}" for k, v in names.items())
        return f"You run crop stage products with the given tools. Plan before you run, and report results as the tools give them. Stages: {listed(STAGES)}. Quality: {listed(QUALITY)}."

    def _complete(self) -> dict:
        """Every request starts at the first model; a busy one is tried again after 2 and 4 seconds, then the next takes the rest of the request."""
        problem: Exception | None = None
        for i, choice in enumerate(self.models):
            if i < self.active:
                continue
            self.active = i
            backend, model = choice if isinstance(choice, tuple) else (self.backend, choice)
            for n in range(RETRIES + 1):
                try:
                    return backend.complete(model, self.system(), self.messages, tool_list())
                except Unavailable as e:
                    problem = e
                    self.log(f"{model}: {e}")
                    break
                except Transient as e:
                    problem = e
                    self.log(f"{model}: {e}")
                    if n < RETRIES:
                        self.sleep(2.0 ** (n + 1))
        raise problem or RuntimeError("no models")

    def run(self, request: str) -> str:
        self.messages.append({"role": "user", "text": request})
        self.active = 0
        for _ in range(STEPS):
            reply = self._complete()
            self.messages.append({"role": "assistant", **reply})
            if not reply["tool_calls"]:
                return reply["text"]
            for call in reply["tool_calls"]:
                self.log(f"{call['name']} {call['args']}")
                text = json.dumps(self.tools(call["name"], call["args"]), default=str)
                self.messages.append({"role": "tool", "id": call["id"], "name": call["name"], "content": text if len(text) <= REPLY else text[:REPLY] + " ... (cut)"})
        return "Stopped after too many steps."

    def reset(self) -> None:
        self.messages.clear()

    def chat(self, ask: Callable[[str], str] = input) -> None:
        while (line := ask("> ").strip()) not in ("", "exit", "quit"):
            print(self.run(line))
