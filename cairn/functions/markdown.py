"""Markdown pages: front matter, titles, events, fences, chunks. Plain Python over one page at a time."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

#: Sizes of chunks in characters: wanted, largest, and carried over between paragraph pieces.
TARGET, LARGEST, OVERLAP = 1200, 4000, 120
#: The forms of a dated line, of a heading and of the source fence.
EVENT = re.compile(r"^\s*[-*]\s+\*\*(\d{4}(?:-\d{2}(?:-\d{2})?)?)\*\*\s*\|\s*(.+?)\s*$")
HEADING = re.compile(r"^(#{1,6})\s+(.*?)\s*#*\s*$")
TARGET_LINK = re.compile(r"\[\[([^\]|#]+)")
FENCE = re.compile(r"^\s*(```|~~~)")
SOURCE_FENCE = re.compile(r"^\s*<!--\s*source\b.*-->\s*$", re.I)
MARKER = re.compile(r"^\s*<!--\s*(?:item|memory|observation|reflection)\b.*-->\s*$", re.I)
SENTENCE_END = re.compile(r"[.!?][\"')\]]?(?=\s)")


def front_matter(text: str) -> tuple[dict, int]:
    """Fields of the header between --- lines, and the number of lines it takes. Scalars, [a, b] lists and - item lists."""
    lines = text.split("\n")
    if not lines or lines[0].strip() != "---":
        return {}, 0
    end = next((i for i, s in enumerate(lines[1:], 1) if s.strip() == "---"), None)
    if end is None:
        return {}, 0
    out: dict = {}
    key = None
    clean = lambda v: v.strip().strip("\"'")
    for s in lines[1:end]:
        if (m := re.match(r"^\s*-\s+(.*)$", s)) and key:
            if not isinstance(out.get(key), list):
                out[key] = []
            out[key].append(clean(m[1]))
        elif m := re.match(r"^([A-Za-z_][\w-]*):\s*(.*)$", s):
            key, v = m[1], m[2].strip()
            out[key] = [clean(x) for x in v[1:-1].split(",") if x.strip()] if v.startswith("[") and v.endswith("]") else clean(v)
    return out, end + 1


@dataclass
class Page:
    slug: str
    title: str
    fields: dict
    lines: list[str]
    body_line: int
    source_fence_line: int | None
    body_hash: str
    events: list[tuple[str, str, str | None, int]] = field(default_factory=list)


def parse_page(path: str, text: str) -> Page:
    """A page from its path and text. The title is the header's, else the first heading's, else the path's last part.

    Dated lines become events, one for each (date, target, lower-cased summary).
    """
    fields, skip = front_matter(text)
    lines = text.split("\n")
    body = lines[skip:]
    slug = re.sub(r"\.md$", "", path)
    first = next((m[2] for s in body if (m := HEADING.match(s)) and len(m[1]) == 1), None)
    fence = next((i for i, s in enumerate(body, skip + 1) if SOURCE_FENCE.match(s)), None)
    title = fields.get("title") or first or slug.rsplit("/", 1)[-1].replace("-", " ").strip().capitalize()
    events: dict[tuple, tuple] = {}
    for i, s in enumerate(body, skip + 1):
        if m := EVENT.match(s):
            to = TARGET_LINK.search(m[2])
            target = to[1].strip() if to else None
            events.setdefault((m[1], target, m[2].lower()), (m[1], m[2], target, i))
    return Page(slug, title, fields, lines, skip + 1, fence, hashlib.sha256("\n".join(body).encode()).hexdigest(), list(events.values()))


@dataclass
class Piece:
    trail: tuple[str, ...]
    lines: list[tuple[int, str]]

    @property
    def text(self) -> str:
        return "\n".join(s for _, s in self.lines).strip("\n")


def _by_heading(piece: Piece, level: int) -> list[Piece]:
    """Cut before every heading of at most ``level`` outside code; each part knows the headings above it."""
    out, trail, code = [Piece(piece.trail, [])], list(piece.trail), False
    for n, s in piece.lines:
        if FENCE.match(s):
            code = not code
        m = None if code else HEADING.match(s)
        if m and len(m[1]) <= level:
            trail = [*trail[: len(m[1]) - 1], m[2]]
            out.append(Piece(tuple(trail), []))
        out[-1].lines.append((n, s))
    return [p for p in out if p.lines]


def _by_marker(piece: Piece) -> list[Piece]:
    """A memory marker and the line below it stand alone."""
    out, alone = [Piece(piece.trail, [])], 0
    for n, s in piece.lines:
        if MARKER.match(s):
            out.append(Piece(piece.trail, [(n, s)]))
            alone = 1
        elif alone and not HEADING.match(s):
            out[-1].lines.append((n, s))
            out.append(Piece(piece.trail, []))
            alone = 0
        else:
            if alone:
                out.append(Piece(piece.trail, []))
                alone = 0
            out[-1].lines.append((n, s))
    return [p for p in out if p.lines]


def _by_paragraph(piece: Piece, target: int, overlap: int) -> list[Piece]:
    """Paragraphs packed up to the target; a piece begins with the last lines of the one before, up to the overlap."""
    paragraphs: list[list[tuple[int, str]]] = [[]]
    for line in piece.lines:
        paragraphs[-1].append(line)
        if not line[1].strip():
            paragraphs.append([])
    out: list[Piece] = []
    held: list[tuple[int, str]] = []
    size = lambda x: sum(len(s) + 1 for _, s in x)
    for p in (p for p in paragraphs if p):
        if held and size(held) + size(p) > target:
            out.append(Piece(piece.trail, held))
            back: list[tuple[int, str]] = []
            for line in reversed(held):
                if size(back) + len(line[1]) + 1 > overlap:
                    break
                back.insert(0, line)
            held = back if len(back) < len(held) else []
        held = held + p
    return [*out, Piece(piece.trail, held)] if held else out


def cut(text: str, largest: int) -> list[str]:
    """Pieces of at most ``largest`` characters: cut at the last sentence end of the back half, else its last space, else anywhere."""
    out = []
    while len(text) > largest:
        window = text[:largest]
        ends = [m.end() for m in SENTENCE_END.finditer(window) if m.end() >= largest // 2]
        space = window.rfind(" ", largest // 2)
        at = ends[-1] if ends else space if space > 0 else largest
        out.append(text[:at].strip())
        text = text[at:].strip()
    return [*out, text] if text else out


def chunk_page(page: Page, target: int = TARGET, largest: int = LARGEST, overlap: int = OVERLAP) -> list[tuple[int, str, str, str, int, int]]:
    """(ord, kind, heading_path, text, line_start, line_end): sections at ##, too large ones at ###, then paragraphs, then sentences.

    Memory blocks are chunks of their own. Chunks from the source fence on are sources.
    """
    whole = Piece((), [(i, s) for i, s in enumerate(page.lines, 1) if i >= page.body_line])
    out = []
    for section in _by_heading(whole, 2):
        for block in _by_marker(section):
            fine = [block] if len(block.text) <= largest else [q for p in _by_heading(block, 3) for q in ([p] if len(p.text) <= largest else _by_paragraph(p, target, overlap))]
            for p in fine:
                for text in cut(p.text, largest):
                    if text.strip():
                        start, end = p.lines[0][0], p.lines[-1][0]
                        kind = "source" if page.source_fence_line and start >= page.source_fence_line else "knowledge"
                        out.append((kind, " › ".join(h for h in p.trail if h), text, start, end))
    return [(i, *c) for i, c in enumerate(out)]


def chunk_document(text: str, largest: int = TARGET) -> list[tuple[int, int, str]]:
    """(ord, page, text): form feeds part pages, then blank lines or lines are packed, then sentences are cut."""
    out = []
    for number, page in enumerate(text.split("\f"), 1):
        held = ""
        for part in re.split(r"\n\s*\n|\n", page):
            if held and len(held) + len(part) + 1 > largest:
                out += [(number, x) for x in cut(held, largest)]
                held = ""
            held = f"{held}\n{part}" if held else part
        out += [(number, x) for x in cut(held, largest) if x.strip()]
    return [(i, n, t) for i, (n, t) in enumerate(out)]


def merge_conflict(text: str) -> bool:
    """A whole conflict block (start, middle and end marks in order) outside code fences."""
    code, stage = False, 0
    for s in text.split("\n"):
        if FENCE.match(s):
            code = not code
        elif not code:
            if s.startswith("<<<<<<< "):
                stage = 1
            elif s.startswith("=======") and stage == 1:
                stage = 2
            elif s.startswith(">>>>>>> ") and stage == 2:
                return True
    return False


def embedding_text(heading_path: str, text: str) -> str:
    return f"{heading_path}\n\n{text}" if heading_path else text
