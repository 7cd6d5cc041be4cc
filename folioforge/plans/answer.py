"""The answer loop with a pluggable model, as events; offline a scripted model stands in."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

from folioforge.operators.citations import CitationStream, Mode, Source
from folioforge.plans import prompts


@dataclass
class Turn:
    """What a model says in one cycle: text tokens, or searches it asks for."""

    tokens: list[str] = field(default_factory=list)
    searches: list[str] = field(default_factory=list)
    finish: str = "stop"
    usage: int | None = None


class Model(Protocol):
    def turn(self, messages: list[dict], tools: str) -> Turn: ...


@dataclass
class Scripted:
    """Gives its turns in order."""

    turns: list[Turn]
    seen: list[tuple[list[dict], str]] = field(default_factory=list)

    def turn(self, messages: list[dict], tools: str) -> Turn:
        self.seen.append((list(messages), tools))
        return self.turns[len(self.seen) - 1]


def answer(question: str, model: Model, search: Callable[[str, int], list[dict]], max_cycles: int = 3, force_search: bool = True, mode: Mode = Mode.HYPERLINK, history: list[dict] | None = None, prompt: str | None = None) -> Iterator[dict]:
    """Events of type started, queries, documents, delta, citation, usage, done and error.

    search(query, first number) gives rows with number, document_id, link and content. The first cycle must search if forced, the
    last one has no tools. What goes wrong becomes an event.
    """
    yield {"type": "started", "question": question}
    messages = [{"role": "system", "content": prompts.system_prompt(prompt)}, *(history or []), {"role": "user", "content": question}]
    stream = CitationStream({}, mode)
    used: int | None = None
    try:
        for cycle in range(max_cycles):
            tools = "none" if cycle == max_cycles - 1 else "required" if cycle == 0 and force_search else "auto"
            note = prompts.reminder(cite=cycle > 0, last=tools == "none")
            turn = model.turn(messages + ([{"role": "user", "content": f"<reminder>{note}</reminder>"}] if note else []), tools)
            if turn.usage is not None:
                used = (used or 0) + turn.usage
            for t in turn.tokens:
                text, new = stream.push(t)
                yield from ({"type": "citation", "number": n, "document_id": d} for n, d in new)
                if text:
                    yield {"type": "delta", "text": text}
            if turn.searches and tools != "none":
                yield {"type": "queries", "queries": turn.searches}
                for q in turn.searches:
                    rows = search(q, stream.next_number())
                    stream.add_sources({r["number"]: Source(r["document_id"], r.get("link")) for r in rows})
                    yield {"type": "documents", "documents": [r["document_id"] for r in rows]}
                    messages.append({"role": "tool", "content": "\n\n".join(f"[{r['number']}] {r.get('content', '')}" for r in rows)})
                continue
            text, new = stream.finish()
            yield from ({"type": "citation", "number": n, "document_id": d} for n, d in new)
            if text:
                yield {"type": "delta", "text": text}
            if turn.finish != "stop":
                yield {"type": "error", "message": f"the answer was cut off: {turn.finish}"}
            break
        if used is not None:
            yield {"type": "usage", "tokens": used}
        yield {"type": "done", "cited": list(stream.cited)}
    except Exception as e:  # noqa: BLE001 - callers read the outcome from the events
        yield {"type": "error", "message": f"{type(e).__name__}: {e}"}


def as_sse(events: Iterator[dict]) -> Iterator[str]:
    """Events as lines of an event stream, one JSON object each."""
    return (f"data: {json.dumps(e, ensure_ascii=False)}\n\n" for e in events)


def as_json(events: Iterator[dict]) -> dict:
    """All events as one body: the text, the cited documents, the queries, the tokens used and the first error."""
    out: dict = {"answer": "", "cited": [], "queries": [], "tokens": None, "error": None}
    for e in events:
        kind = e["type"]
        if kind == "delta":
            out["answer"] += e["text"]
        elif kind == "queries":
            out["queries"] += e["queries"]
        elif kind == "usage":
            out["tokens"] = e["tokens"]
        elif kind == "done":
            out["cited"] = e["cited"]
        elif kind == "error":
            out["error"] = out["error"] or e["message"]
    return out
