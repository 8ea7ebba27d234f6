"""The bounded question loop on the driver: decide, search, observe, answer.

The search is one batch plan per step; what it returns to the driver is a page of hits, never a table.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

MAX_STEPS = 5


@dataclass
class State:
    question: str
    iteration: int = 0
    history: list[dict] = field(default_factory=list)
    context: str = ""
    converged: bool = False
    final_answer: str = ""


def parse_action(text: str) -> tuple[str, str]:
    """(search | tool_call | answer, parameter) out of noisy text; anything else is an answer."""
    bare = re.sub(r"<think>.*?</think>", "", text, flags=re.S).strip()
    if m := re.search(r"\{.*\}", bare, re.S):
        try:
            found = json.loads(m[0])
        except ValueError:
            found = None
        if isinstance(found, dict) and found.get("action") in ("search", "tool_call", "answer"):
            return found["action"], str(found.get("param", ""))
    if m := re.match(r"(?i)(search|tool_call|answer)\s*[:：]\s*(.*)", bare, re.S):
        return m[1].lower(), m[2].strip()
    return "answer", bare


def history_context(history: list[dict], most: int = 3) -> str:
    return "\n".join(f"{h['action']}: {h['param']} -> {h['n']} hits" for h in history[-most:])


def format_hits(hits: list[dict], longest: int = 500) -> str:
    return "\n\n".join(f"[{i}] {h.get('title') or 'Untitled'} ({h.get('source')})\n{(h.get('content_preview') or '')[:longest]}" for i, h in enumerate(hits, 1))


def ask(question: str, decide: Callable[[State], str], search: Callable[[str], list[dict]], answer: Callable[[str, str], str], tools: dict[str, Callable[[str], str]] | None = None, steps: int = MAX_STEPS, budget: int = 4000) -> State:
    """Run the loop until it answers or the steps are used up; then answer from what was found."""
    state = State(question)
    while not state.converged and state.iteration < steps:
        state.iteration += 1
        action, param = parse_action(decide(state))
        if action == "search":
            hits = search(param or question)
            state.history.append({"question": question, "action": action, "param": param, "n": len(hits)})
            state.context = (state.context + "\n\n" + format_hits(hits)).strip()[:budget]
        elif action == "tool_call":
            name, _, arg = param.partition(" ")
            result = tools[name](arg) if tools and name in tools else f"no tool named {name}"
            state.history.append({"question": question, "action": action, "param": param, "n": 1})
            state.context = (state.context + "\n\n" + result).strip()[:budget]
        else:
            state.converged, state.final_answer = True, param
    if not state.final_answer:
        state.final_answer = answer(question, state.context)
    return state
