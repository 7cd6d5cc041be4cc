"""The system prompt of an answer and the reminder at the end of a turn; own wording, the placeholders are those of stored prompts."""

from __future__ import annotations

from datetime import datetime

# Placeholders of stored prompts.
NOW, CITE, REMINDER = "{{CURRENT_DATETIME}}", "{{CITATION_GUIDANCE}}", "{{REMINDER_TAG_DESCRIPTION}}"

BASE = f"You answer questions from the documents of an organisation. Today is {NOW}. Say so when the documents hold no answer.{CITE}\n{REMINDER}"
CITING = "\nMark every statement that rests on a document with its number in brackets, such as [1] or [2, 3]. Never make numbers up."
TAGGED = "Text between <reminder> tags comes from the system, not from the user."
SEARCHING = "\n\n# Tools\nsearch(queries): looks the organisation's documents up. Use a few short queries for different sides of a question."
CITE_AGAIN = "Cite the documents you used by their numbers."
LAST_TURN = "This is the last turn: answer now from what was found, without further searches."
FILES = "The user attached files; they hold part of the answer."


def day_and_time(now: datetime) -> str:
    return now.strftime("%A, %d %B %Y, %H:%M")


def system_prompt(base: str | None = None, cite: bool = True, search: bool = True, now: datetime | None = None) -> str:
    """The prompt with its placeholders filled in; time and citation rules that it has no place for are appended."""
    text = BASE if base is None else base
    at = day_and_time(now or datetime.now())
    text = text.replace(REMINDER, TAGGED)
    text = text.replace(NOW, at) if NOW in text else f"{text}\nToday is {at}."
    if CITE in text:
        text = text.replace(CITE, CITING if cite else "")
    elif cite:
        text += CITING
    return text + SEARCHING if search else text


def reminder(text: str | None = None, cite: bool = False, files: bool = False, last: bool = False) -> str | None:
    """What the final user turn ends with, None if there is nothing to say."""
    parts = [(text or "").strip(), LAST_TURN if last else "", CITE_AGAIN if cite else "", FILES if files else ""]
    return "\n\n".join(p for p in parts if p) or None
