"""Edits of one page's text: strict patches, appends below a heading, single replacements. Each gives (text, None) or (None, why not)."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: The head of a hunk, lines of a patch that are no content, a heading, and a list item.
HUNK = re.compile(r"@@\s+-(\d+)(?:,\d+)?\s+\+\d+(?:,\d+)?\s+@@")
NO_CONTENT = ("---", "+++", "\\")
HEADING = re.compile(r"(#{1,6})\s+(.*?)\s*$")
LIST_ITEM = re.compile(r"\s*(?:[-*+]\s|\d+[.)]\s)")


@dataclass
class Hunk:
    """Where a hunk says that it belongs, the lines that it expects there, and those that replace them."""

    hint: int
    old: list[str] = field(default_factory=list)
    new: list[str] = field(default_factory=list)

    def place(self, lines: list[str]) -> tuple[int, str | None]:
        """The hinted place if the lines stand there, else the only place where they do."""
        n = len(self.old)
        if not n:
            return min(max(self.hint, 0), len(lines)), None
        if self.hint >= 0 and lines[self.hint : self.hint + n] == self.old:
            return self.hint, None
        found = [i for i in range(len(lines) - n + 1) if lines[i] == self.old[0] and lines[i : i + n] == self.old]
        if len(found) == 1:
            return found[0], None
        return -1, f"context matches {len(found)} places" if found else "context does not match"


def hunks(patch: str) -> list[Hunk]:
    out: list[Hunk] = []
    for line in patch.split("\n"):
        if m := HUNK.match(line):
            out.append(Hunk(int(m[1]) - 1))
        elif out and not line.startswith(NO_CONTENT) and line[:1] in ("", " ", "-", "+"):
            if line[:1] != "+":
                out[-1].old.append(line[1:])
            if line[:1] != "-":
                out[-1].new.append(line[1:])
    return [h for h in out if h.old or h.new]


def patched(text: str, patch: str) -> tuple[str | None, str | None]:
    """The text after a unified diff. Every line that a hunk keeps or removes must stand there; line numbers are hints.

    All hunks are placed in the text as it was; one that fits nowhere or, where the hint is
    wrong, in several places refuses the whole patch. Hunks that meet the same lines are applied
    from the end on.
    """
    lines, all_ = text.split("\n"), hunks(patch)
    if not all_:
        return None, "no hunks"
    placed = []
    for h in all_:
        at, why = h.place(lines)
        if why:
            return None, why
        placed.append((at, h))
    for at, h in sorted(placed, key=lambda x: -x[0]):
        lines[at : at + len(h.old)] = h.new
    return "\n".join(lines), None


def appended(text: str, section: str | None, more: str) -> tuple[str | None, str | None]:
    """The text with ``more`` at its end, or at the end of the one section of that title: before the next heading of its level or higher.

    A blank line goes before it, but between two items of a list.
    """
    more = more.strip()
    if section is None:
        body = text.rstrip()
        return (f"{body}\n\n{more}" if body else more), None
    wanted = re.sub(r"^#+\s*", "", section.strip()).lower()
    lines = text.split("\n")
    heads = [(i, len(m[1]), m[2].lower()) for i, s in enumerate(lines) if (m := HEADING.match(s))]
    own = [(i, level) for i, level, title in heads if title == wanted]
    if len(own) != 1:
        return None, f"{len(own)} sections of that title" if own else "no section of that title"
    start, level = own[0]
    end = next((i for i, depth, _ in heads if i > start and depth <= level), len(lines))
    while end > start + 1 and not lines[end - 1].strip():
        end -= 1
    joined = LIST_ITEM.match(lines[end - 1]) and LIST_ITEM.match(more)
    lines[end:end] = [more] if joined or not lines[end - 1].strip() else ["", more]
    return "\n".join(lines), None


def swapped(text: str, old: str, new: str) -> tuple[str | None, str | None]:
    """The text with the one place that reads ``old`` changed."""
    n, at = 0, text.find(old) if old else -1
    while at >= 0:  # places that overlap are places too
        n, at = n + 1, text.find(old, at + 1)
    if n != 1:
        return None, f"found {n} times" if n else "not found"
    return text.replace(old, new), None


def edited(text: str, mode: str, a: str | None, b: str | None) -> tuple[str | None, str | None]:
    """One edit of a page; its header between --- lines stays as it is."""
    from cairn.functions.markdown import front_matter

    skip = front_matter(text)[1]
    lines = text.split("\n")
    head, body = "\n".join(lines[:skip]) + "\n" * bool(skip), "\n".join(lines[skip:])
    if mode == "patch":
        out, why = patched(body, a or "")
    elif mode == "append":
        out, why = appended(body, b, a or "")
    elif mode == "swap":
        out, why = swapped(body, a or "", b or "")
    elif mode == "content":
        out, why = a or "", None
    else:
        out, why = None, f"no such edit: {mode}"
    if why:
        return None, why
    return head + out + "\n" * (not out.endswith("\n")), None


def first_change(before: str, after: str) -> int | None:
    """The first line, from 1, that differs."""
    if before == after:
        return None
    a, b = before.split("\n"), after.split("\n")
    return next((i + 1 for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)) + 1)
