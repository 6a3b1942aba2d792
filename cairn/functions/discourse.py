"""What each line of a Markdown page asserts, from the headings, lists, quotes and fences it stands in."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

import regex

from cairn.functions.markdown import MARKER

#: Word families of a line with their view and reason, tried in this order.
FAMILIES = (
    ("discussion", "conditional", r"(?i)\b(?:if|suppose|assuming|hypothetical|counterfactual|what if|would have)\b|(?:^|[^\p{L}])(?:если|предположим|допустим|гипотез\p{L}*|гипотетическ\p{L}*|контрфактическ\p{L}*)(?=$|[^\p{L}])"),
    ("history", "rejected", r"(?i)\b(?:rejected|cancelled|canceled|not decided|not accepted|did not choose)\b|(?:отклон\p{L}*|отмен\p{L}*|не решено|не выбрал\p{L}*|решение не принято)"),
    ("discussion", "tentative", r"(?i)\b(?:might|maybe|perhaps|possibly|probably|suspect|uncertain|tentative|would|could)\b|(?:^|[^\p{L}])(?:возможно|вероятно|может быть|подозрева\p{L}*|не уверен\p{L}*)(?=$|[^\p{L}])"),
)
#: Families of headings only, which stand between those above and those below.
HEADING_FAMILIES = (
    ("reports", "speaker", r"(?i)^(?:user|assistant|system|external|пользователь|ассистент|система)$"),
    ("discussion", "heading_scope", r"(?i)\b(?:scenario|alternatives?|discussion|hypothes[ei]s|assumptions?)\b|сценари\p{L}*|обсуждени\p{L}*|предположени\p{L}*"),
    ("reports", "heading_scope", r"(?i)\b(?:examples?|samples?|transcript|conversation|dialogue)\b|пример\p{L}*|переписк\p{L}*|диалог\p{L}*"),
    ("planning", "heading_scope", r"(?i)\b(?:plans?|proposals?|intentions?)\b|план\p{L}*|предложени\p{L}*"),
    ("questions", "heading_scope", r"(?i)\bquestions?\b|вопрос\p{L}*"),
)
#: The rest of the families.
LATER_FAMILIES = (
    ("reports", "speaker", r"(?i)^\s*(?:[-*]\s*)?(?:\*\*)?(?:user|assistant|system|external|пользователь|ассистент|система)(?:\*\*)?\s*:"),
    ("reports", "speaker", r"^\s*(?:>\s*)?(?:\*\*)?\p{Lu}[\p{L}’'-]+(?:[ \t]+\p{Lu}[\p{L}’'-]+){1,3}(?:\*\*)?:[ \t]+"),
    ("reports", "quotation", r"(?i)\b(?:said|says|reported|reports|according to|quoted|quotation)\b|(?:^|[^\p{L}])(?:сказал\p{L}*|сообщил\p{L}*|по словам|цитат\p{L}*)(?=$|[^\p{L}])"),
    ("reports", "quotation", r"^\s*[>\"“«]"),
    ("planning", "plan", r"(?i)\b(?:plan(?:s|ned|ning)? to|propos(?:e|ed|al)|intend(?:s)? to)\b|(?:планиру\p{L}*|намерева\p{L}*|предлага\p{L}*)"),
    ("planning", "plan", r"^\s*[-*]\s*\[ \]"),
    ("questions", "question", r"\?\s*$"),
)
#: Whole titles that name a category of what is below them, tried before all families.
TITLES = (
    ("reports", r"(?i)^(?:(?:assistant|user|system|external|nested|attributed)\s+)?(?:reports?|retellings?)$"),
    ("reports", r"(?i)^(?:(?:вложенный|внешний)\s+)?(?:пересказ|сообщение|сообщения)(?:\s+(?:ассистента|пользователя|системы))?$"),
    ("discussion", r"(?i)^(?:preliminary|tentative|possible|competing)\s+(?:versions?|explanations?|causes?|hypothes[ei]s)$"),
    ("discussion", r"(?i)^(?:предварительн\p{L}*|возможн\p{L}*)\s+(?:верси\p{L}*|объяснени\p{L}*|причин\p{L}*|гипотез\p{L}*)$"),
)
#: Openings of a paragraph that refer back to the one before it.
REFERS_BACK = r"(?i)(?:^|[.!?]\s*)(?:but |however,? )?(?:this|that|the above|the preceding|correction|actually|это|выше|исправление|однако)(?=$|[^\p{L}])"
#: The largest context that may decide a line, and how deep lists are read.
MOST_LINES, MOST_CHARS, MOST_DEPTH = 12, 2400, 12
#: Titles of up to so many characters are remembered by a worker, for pages repeat them.
SHORT = 200

HEADING = regex.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*)|[ \t]*)\r?$")
UNDERLINE = regex.compile(r"\s{0,3}(=+|-+)\s*$")
FENCE = regex.compile(r"\s*(`{3,}|~{3,})")
SOURCE = regex.compile(r"\s*<!--\s*source\s*-->\s*$")
BULLET = regex.compile(r"(?:[-+*]|(\d{1,9})[.)])(?= |$)")
RULE = regex.compile(r"(?:(?:- *){3,}|(?:\* *){3,}|(?:_ *){3,})$")
_compiled = lambda rows: [(*r[:-1], regex.compile(r[-1])) for r in rows]
_FIRST, _HEADING, _LATER, _TITLES = map(_compiled, (FAMILIES, HEADING_FAMILIES, LATER_FAMILIES, TITLES))
_BACK = regex.compile(REFERS_BACK)
FACTUAL = ("factual", "asserted")
#: What an ASCII line must hold, in lower case, for any family of lines to match it.
_HINT = re.compile(r"if|suppose|assuming|hypothetical|counterfactual|would|rejected|cancel|not |did not|might|maybe|perhaps|possibly|probably|suspect|uncertain|tentative|could|sa[iy]|report|according|quot|plan|propos|inten|[:>\"?\[]")
_CLOSING = regex.compile(r"\s+#+\s*$")
_COLON = regex.compile(r"[:：]\s*$")
_STRONG = regex.compile(r"^(\*{1,2}|_{1,2})(.+)\1$")
_QUOTED_HEADING = regex.compile(r" {0,3}(?:> ?)+#{1,6}(?: |$)")
_OPEN_TASK = regex.compile(r"\[ \](?:\s|$)")


def line_meaning(text: str) -> tuple[str, str]:
    """(view, reason) of a line by itself."""
    if text.isascii() and not _HINT.search(text.lower()):
        return FACTUAL
    return next(((v, r) for v, r, p in (*_FIRST, *_LATER) if p.search(text)), FACTUAL)


def heading_meaning(title: str) -> tuple[str, str]:
    """(view, reason) that a heading gives to what is below it."""
    return _short_heading(title) if len(title) <= SHORT else _heading(title)


def _heading(title: str) -> tuple[str, str]:
    title = _CLOSING.sub("", title).strip()
    bare = _COLON.sub("", _STRONG.sub(r"\2", title)).strip()
    for view, pattern in _TITLES:
        if pattern.search(bare):
            return view, "heading_scope"
    return next(((v, r) for v, r, p in (*_FIRST, *_HEADING, *_LATER) if p.search(title)), FACTUAL)


_short_heading = lru_cache(4096)(_heading)


@dataclass
class Item:
    """A list item: its first line, the column its content begins in, and what was found in it."""

    start: int
    column: int
    end: int = 0
    heading: bool = False
    bare: bool = True
    last: list[int] = field(default_factory=list)
    inner: dict[int, "Item"] = field(default_factory=dict)


def list_items(lines: list[str], first: int) -> dict[int, Item]:
    """The outermost list items that hold a heading or what looks like one, by first line; ``inner`` has those within.

    A stack of open items is kept from line to line. A line stays in an item if it is indented
    to its content, or if it goes on with a paragraph there; a fence or comment ends with its item.
    """
    every: list[tuple[Item, list[Item]]] = []
    stack: list[Item] = []
    paragraph: list[int] = []
    block = None  # an open fence (character, length) or comment, and the items it is in
    for n in range(first, len(lines)):
        text = lines[n].expandtabs(4).rstrip("\r")
        if not text.strip():
            paragraph = []
            if stack and stack[-1].bare:
                stack.pop()
            continue
        indent = len(text) - len(text.lstrip(" "))
        depth = 0
        while depth < len(stack) and indent >= stack[depth].column:
            depth += 1
        if block and depth < block[2]:
            block = None
        lazy = depth < len(stack) and paragraph and not _begins(text.lstrip(" "))
        if not lazy:
            del stack[depth:]
        if block:
            if block[0] == "<!--":
                block = None if "-->" in text else block
            elif (m := FENCE.match(text)) and m[1][0] == block[0] and len(m[1]) >= block[1] and not text.strip().strip(block[0]):
                block = None
        elif lazy:
            paragraph.append(n)
        else:
            at, went_on = indent, bool(paragraph)
            while True:
                rest = text[at:]
                own = at - (stack[-1].column if stack else 0)
                if own >= 4 and not went_on:
                    paragraph = []
                elif RULE.match(rest) or HEADING.match(rest):
                    paragraph = []
                    if not RULE.match(rest):
                        for item in stack:
                            item.heading = True
                elif m := FENCE.match(rest):
                    paragraph, block = [], (m[1][0], len(m[1]), len(stack))
                elif rest.startswith("<!--"):
                    paragraph, block = [], None if "-->" in rest else ("<!--", 0, len(stack))
                elif own < 4 and (m := BULLET.match(rest)) and not (went_on and (not rest[m.end() :].strip() or m[1] not in (None, "1"))):
                    after = rest[m.end() :]
                    pad = len(after) - len(after.lstrip(" "))
                    item = Item(n, at + m.end() + (pad if 1 <= pad <= 4 and after.strip() else 1))
                    every.append((item, list(stack)))
                    stack.append(item)
                    paragraph, went_on = [], False
                    if after.strip():
                        at = item.column if pad <= 4 else at + m.end() + 1
                        at += len(text[at:]) - len(text[at:].lstrip(" "))
                        continue
                else:
                    paragraph = [*paragraph, n]
                break
        for item in stack:
            item.end = n + 1
            item.bare = item.bare and n == item.start and not text[item.column :].strip()
            own = text[item.column :] if n == item.start or indent >= item.column else text
            item.heading |= bool(HEADING.match(own) or _QUOTED_HEADING.match(own))
            item.last = list(paragraph) if paragraph else ([] if item.end == n + 1 else item.last)
    out: dict[int, Item] = {}
    for item, outer in every:
        if item.heading:
            held = [o for o in outer if o.heading]
            (held[-1].inner if held else out).setdefault(item.start, item)
    return out


def _begins(text: str) -> bool:
    """Whether a line begins a block of its own, and so does not go on with a paragraph."""
    m = BULLET.match(text)
    return bool(RULE.match(text) or HEADING.match(text) or FENCE.match(text) or text.startswith(("<!--", ">")) or m and text[m.end() :].strip() and m[1] in (None, "1"))


class _Reader:
    """Reads one page; entries are {line number from 0: [resolved, view, reason, context lines]}."""

    def __init__(self, lines: list[str]):
        self.lines = lines

    def entry(self, meaning, context, resolved=True):
        """A context over the bounds decides nothing: it stays unresolved, never cut."""
        frame = sorted(set(context))
        if len(frame) > MOST_LINES or sum(len(self.lines[i]) for i in frame) > MOST_CHARS:
            return [False, meaning[0], "context_limit", []]
        return [resolved, *meaning, frame]

    def read(self, start: int, text: dict[int, str], items: dict[int, Item], depth: int, inherited, source: bool) -> dict[int, list]:
        """Entries of the lines of one container, a page or a list item, given by number with the container's indent taken off."""
        out: dict[int, list] = {}
        headings: list[tuple[int, int, tuple]] = []  # level, line, meaning
        carried = None  # a line whose meaning goes on until the next heading
        block, payload, before = None, False, []
        n, stop = start, max(text, default=start - 1) + 1
        while n < stop:
            t = text[n]
            if block:
                out[n] = self.entry(("discussion", "comment" if block[0] == "<" else "example"), [block[2]])
                if block[0] == "<" and "-->" in t or block[0] != "<" and (m := FENCE.match(t)) and m[1][0] == block[0] and len(m[1]) >= block[1] and not t.strip().strip(block[0]):
                    block = None
                n += 1
                continue
            if m := FENCE.match(t):
                block = (m[1][0], len(m[1]), n)
                out[n] = self.entry(("discussion", "example"), [n])
                n += 1
                continue
            comment = "<!--" in self.lines[n]
            source |= comment and bool(SOURCE.match(self.lines[n]))
            marker = comment and bool(MARKER.match(self.lines[n]))
            if marker or payload and t.strip():
                payload, n = not payload or marker, n + 1
                continue
            if not t.strip():
                n += 1
                continue
            if t.lstrip().startswith("<!--"):
                out[n] = self.entry(("discussion", "comment"), [n])
                block = None if "-->" in t else ("<", 0, n)
                n += 1
                continue
            scope = next((m for _, _, m in reversed(headings) if m[0] != "factual"), None)
            above = [*(i for _, i, _ in headings), *([carried[0]] if carried else [])]
            if item := items.get(n):
                if depth >= MOST_DEPTH:
                    out |= {i: [False, "discussion", "context_limit", []] for i in range(n, item.end) if i in text}
                    before = []
                else:
                    outer = ("reports", "quotation") if source else scope or inherited or (carried and carried[1])
                    for i, (resolved, view, reason, frame) in self.read(n, self.inside(item), item.inner, depth + 1, outer, source).items():
                        out[i] = self.entry((view, reason), [] if view == "factual" else [*above, n, i, *frame], resolved)
                    before = item.last
                n = item.end
                continue
            under = UNDERLINE.match(text.get(n + 1, ""))
            m = HEADING.match(t)
            if m or under:
                level = len(m[1]) if m else 1 if under[1][0] == "=" else 2
                while headings and headings[-1][0] >= level:
                    headings.pop()
                headings.append((level, n, heading_meaning((m[2] or "") if m else t)))
                carried, before = None, []
                own = [n] if m else [n, n + 1]
                out |= {i: self.entry(("discussion", "heading"), [n]) for i in own}
                n += len(own)
                continue
            own = [n]
            while own[-1] + 1 < stop and self._goes_on(text[own[-1] + 1]) and own[-1] + 1 not in items:
                own.append(own[-1] + 1)
            meanings = [(i, line_meaning(text[i])) for i in own]
            by_reason = lambda r: next((x for x in meanings if x[1][1] == r), None)
            decisive = by_reason("conditional") or by_reason("rejected") or next((x for x in meanings if x[1][0] != "factual"), None)
            if decisive and decisive[1][1] in ("conditional", "speaker"):
                carried = decisive
                above = [*(i for _, i, _ in headings), carried[0]]
            meaning = ("reports", "quotation") if source else scope or inherited or (carried and carried[1]) or (decisive and decisive[1]) or FACTUAL
            context = [] if meaning[0] == "factual" else [*above, *own]
            if meaning[0] != "factual" and before and _BACK.search(text[n]):
                wider = [*before, *(i for b in before if b in out for i in out[b][3]), *context]
                out |= {i: self.entry(meaning, wider) for i in before}
            out |= {i: self.entry(meaning, context) for i in own}
            before, n = own, own[-1] + 1
        return out

    @staticmethod
    def _goes_on(text: str) -> bool:
        return bool(text.strip()) and not HEADING.match(text) and not FENCE.match(text) and not text.lstrip().startswith("<!--")

    def inside(self, item: Item) -> dict[int, str]:
        """An item's lines without its indent; an open task keeps a bullet, for it stays a task."""
        out = {}
        for n in range(item.start, item.end):
            t = self.lines[n].expandtabs(4)
            out[n] = t[item.column :] if n == item.start or len(t) - len(t.lstrip(" ")) >= item.column else t
        if _OPEN_TASK.match(out[item.start]):
            out[item.start] = "- " + out[item.start]
        return out


def scopes(text: str, first: int = 0) -> list[tuple[int, str, str, str, list[int]]]:
    """(line from 1, status, view, reason, context lines) of a page's lines from ``first`` (from 0) on.

    A heading rules what is below it up to the next of its level or higher; a list item with
    headings is a container of its own, to which outer meanings are handed down and out of which
    none comes; a conditional or a speaker rules up to the next heading; a paragraph is ruled by
    its strongest line, and one that refers back rules the one before it. Below the source fence
    all is quoted; fences and comments are examples. Blank lines, markers and their payload have
    no row.
    """
    lines = text.split("\n")
    page = {n: lines[n] for n in range(first, len(lines))}
    found = _Reader(lines).read(first, page, list_items(lines, first), 0, None, False)
    return [(n + 1, "qualified" if ok else "unresolved", view, reason, [i + 1 for i in frame]) for n, (ok, view, reason, frame) in sorted(found.items())]
