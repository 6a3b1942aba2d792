"""Ledgers: dated lines under year headings, newest first, kept by insertion only."""

from __future__ import annotations

import re

from cairn.functions.text import STOP_WORDS

#: A dated line, a date that places a line, a reference that is no event, a year's heading, and any heading that ends a year.
DATED = re.compile(r"\s*[-*]\s+\*\*(\d{4}-\d{2}-\d{2})\*\*\s*\|")
PLACED = re.compile(r"\s*[-*]\s+\*\*(?:Until )?(\d{4}(?:-\d{2})?(?:-\d{2})?)(?:\*\*|\b)")
REFERENCE = re.compile(r"(?i)<!--\s*(?:[\w-]+:)?timeline-item\b[^>]*-->\s*$")
YEAR = re.compile(r"##\s+(\d{4})\s*$")
HEADING = re.compile(r"##?\s+")
LINK = re.compile(r"\[\[[^\]]*\]\]")
#: Two lines of a day that share this much of the shorter one's words are one event; shorter ones than so many words never.
SAME, LEAST = 0.8, 3
#: The head of a ledger that did not exist.
NEW = "---\ntype: timeline\ntitle: Timeline\n---\n\n# Timeline\n"


def event_line(date: str, summary: str, slug: str | None) -> str:
    return f"- **{date}** | {' '.join(summary.split())}" + (f" [[{slug}]]" if slug else "")


def words(text: str) -> frozenset[str]:
    """What a line is about: ASCII words of three or more characters, without stop words and links."""
    return frozenset(w for w in re.sub(r"[^a-z0-9\s]", " ", LINK.sub(" ", text.lower())).split() if len(w) > 2) - frozenset(STOP_WORDS)


def same_event(a: frozenset[str], b: frozenset[str]) -> bool:
    small = min(len(a), len(b))
    return small >= LEAST and len(a & b) / small >= SAME


def inserted(text: str | None, events: list[tuple[str, str, str | None]]) -> tuple[str, list[int]]:
    """The ledger with (date, summary, slug) events added in turn, and the line, from 1, on which each stands.

    An event whose line is there, or one of its day that says the same, is not added again;
    references to other records neither stop it nor move. Others go under their year, which is
    made where it lacks, before the first line of an older date; lines that are no events stay
    where they are. Each year is merged once, whatever the number of events.
    """
    text = NEW if text is None else text
    lines = text.removesuffix("\n").split("\n") if text else []
    known = {s: ("old", i) for i, s in reversed([*enumerate(lines)])}
    days: dict[str, list] = {}
    for i, s in enumerate(lines):
        if (m := DATED.match(s)) and not REFERENCE.search(s):
            days.setdefault(m[1], []).append((words(s[m.end() :]), ("old", i)))
    new, at = [], []
    for date, summary, slug in events:
        line, own = event_line(date, summary, slug), words(summary)
        place = known.get(line) or next((p for w, p in days.get(date, ()) if same_event(w, own)), None)
        if place is None:
            place = ("new", len(new))
            new.append((date, line))
            known[line] = place
            days.setdefault(date, []).append((own, place))
        at.append(place)
    if not new:
        return text, [i + 1 for _, i in at]
    by_year: dict[str, list[int]] = {}
    for k in sorted(range(len(new)), key=lambda k: new[k][0], reverse=True):  # stable: equal dates stay in turn
        by_year.setdefault(new[k][0][:4], []).append(k)
    heads = {}
    for i, s in enumerate(lines):
        if m := YEAR.match(s):
            heads.setdefault(m[1], i)
    before: dict[int, list] = {}  # what goes before a line: numbers of new events
    fresh: dict[int, list[str]] = {}  # new years before a line
    for year, own in by_year.items():
        if year not in heads:
            place = next((i for i, s in enumerate(lines) if (m := YEAR.match(s)) and m[1] < year), len(lines))
            fresh.setdefault(place, []).append(year)
            continue
        start = heads[year] + 1
        end = next((i for i in range(start, len(lines)) if HEADING.match(lines[i])), len(lines))
        while end > start and not lines[end - 1].strip():
            end -= 1
        i = start
        while i < end and not lines[i].strip():
            i += 1
        for k in own:  # newest first, so places only go down
            while i < end and not ((m := PLACED.match(lines[i])) and m[1] < new[k][0]):
                i += 1
            before.setdefault(i, []).append(k)
    out, where = [], {}

    def put(k):
        where["new", k] = len(out)
        out.append(new[k][1])

    for i in range(len(lines) + 1):
        for k in before.get(i, ()):
            put(k)
        for year in fresh.get(i, ()):
            if out and out[-1].strip():
                out.append("")
            out.append(f"## {year}")
            for k in by_year[year]:
                put(k)
            if i < len(lines):
                out.append("")
        if i < len(lines):
            where["old", i] = len(out)
            out.append(lines[i])
    return "\n".join(out) + "\n", [where[p] + 1 for p in at]
