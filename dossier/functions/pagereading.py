"""What the reading of one page does to a document's navigation state; plans and streams bring state, page and answers together."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass

from dossier.functions import ids
from dossier.functions import sections as S
from dossier.models import VisionModel

_PLACES = {"top": 0, "middle": 1, "bottom": 2}
#: A page's row: what was said, and the navigation state it was read under.
ROWS = (
    "doc_id bigint, page int, before string, active string, first_new string, changed boolean, sections array<string>, "
    "depictions map<string,string>, answer string, pending string, milestones array<string>, back_read array<int>, error string"
)
COLUMNS = [c.split()[0] for c in ROWS.split(", ")]


class Reader:
    """Navigation state of one document."""

    def __init__(self, total: int, outline: list[dict]) -> None:
        outline = [item for item in outline if isinstance(item, dict)]
        self.total, self.stack, self.pending, self.memory = total, [], "", ""
        self.sections: list[str] = []
        self.depictions: dict[str, str] = {}
        self.places: dict[str, tuple[int, int]] = {}
        self.anchors: list[list] = []
        for item in sorted(outline, key=lambda x: (self._page(x), _PLACES.get(str(x.get("position", "top")).lower(), 3))):
            self._outline(item)
        for item in outline:
            name = str(item.get("section_id") or item.get("id") or "").strip()
            if name:
                self.anchors.append([name, self._page(item)])
        self.anchors.sort(key=lambda a: a[1])
        if not self.sections:
            self.sections, self.depictions = ["General"], {"General": ""}
        self.active = self.sections[0]
        self.stack = [self.active]

    @classmethod
    def start(cls, total: int, outline: str | None) -> Reader:
        """State in front of the first page. An outline that is no JSON list counts as none, as does one of a single page."""
        try:
            entries = json.loads(outline) if outline and total > 1 else []
        except ValueError:
            entries = []
        return cls(total, entries if isinstance(entries, list) else [])

    def dump(self) -> str:
        return json.dumps({**vars(self), "places": list(self.places.items())}, ensure_ascii=False)

    @classmethod
    def load(cls, text: str) -> Reader:
        state = cls.__new__(cls)
        vars(state).update(json.loads(text))
        state.places = {code: tuple(at) for code, at in state.places}
        return state

    def _page(self, item: dict) -> int:
        try:
            return max(1, min(int(item.get("page", item.get("page_number", 1))), self.total))
        except (TypeError, ValueError):
            return 1

    def _outline(self, item: dict) -> None:
        major = str(item.get("is_major_section", "")).lower() == "true"
        raw, title = str(item.get("section_id", item.get("id", "")) or "").strip(), str(item.get("title", item.get("heading_title", "")) or "").strip()
        code, text = S.outline_entry(raw, title if major else "", str(item.get("depiction", "") or ""))
        if code == "General":
            code = S.canonical(raw or str(item.get("subsection_id", "") or "")) or "General"
        at = (self._page(item), _PLACES.get(str(item.get("position", "top")).strip().lower(), 0))
        self.places[code] = min(at, self.places.get(code, at))
        if _is_section(code, title):
            if code not in self.sections:
                self.sections.append(code)
            self.depictions[code] = self.depictions.get(code) or text

    def expected(self, page: int) -> str:
        """Chapter an anchor promises for the page, else the active one."""
        if not self.anchors:
            return self.active
        covering = [n for (n, s), nxt in zip(self.anchors, [*self.anchors[1:], [None, self.total + 1]]) if s <= page <= max(s, nxt[1] - 1)]
        return covering[0] if covering else self.anchors[-1][0]

    def enter(self, chapter: dict, page: int) -> str:
        """Take in a chapter seen on a page; all chapters of a page take effect."""
        name, title = str(chapter.get("id", "")).strip(), str(chapter.get("title", "") or "").strip()
        known = next((a for a in self.anchors if a[0].lower() == name.lower()), None)
        note = ""
        if known is None:
            self.anchors.append([name, page])
            note = f"new chapter [{name}] on page {page}"
        elif known[1] != page:
            note = f"chapter [{name}] moved from page {known[1]} to {page}"
            known[1] = page
        self.anchors.sort(key=lambda a: a[1])
        if note:
            self.stack = [name]
        code, text = S.outline_entry(name, title, str(chapter.get("depiction", "") or ""))
        if code not in self.sections:
            self.depictions[code] = text
            at = (page, _PLACES.get(str(chapter.get("position", "top")).strip().lower(), 0))
            self.places[code] = min(at, self.places.get(code, at))
            last = max((p for p, _ in self.places.values()), default=1) + 1
            order = {s: i for i, s in enumerate([*self.sections, code])}
            self.sections = sorted(order, key=lambda s: (*self.places[s], 0) if s in self.places else (last, 0, order[s]))
        elif text and text not in (held := self.depictions.get(code, "")):
            self.depictions[code] = text if not held or held in text else f"{held}\n\n{text}"
        return note

    def prompt(self, page: int) -> str:
        parts = [f"Page {page}/{self.total}.", f"<Navigation>\nexpected: {self.expected(page)}\nheadings: {' > '.join(self.stack)}\n</Navigation>"]
        if self.memory:
            parts.append(f"<Reading_Progress_Memory>\n{self.memory}\n</Reading_Progress_Memory>")
        if self.pending:
            parts.append(f"<Pending_Context>\n{self.pending}\n</Pending_Context>")
        return "\n\n".join(parts)


def _is_section(code: str, title: str) -> bool:
    low = title.lower()
    return not (
        not code or code.lower() in ids.NOT_A_SECTION or re.search(r"\([a-z0-9]+\)", code, re.I) or re.match(r"[A-Z]\.\d+$", code)
        or code.count(".") >= 2 or any(p in low for p in ids.QUESTION_TITLES) or low.strip().endswith("?")
    )


_ASKING = re.compile(r"\b(?:" + "|".join(ids.QUESTION_VERBS) + r")\b", re.I)


def _heading(item: dict) -> str:
    """Id and text of an item that is a heading by :func:`dossier.functions.ids.is_weak_heading`, else ''."""
    qid, text = (str(item.get(k, "") or "").strip() for k in ("question_id", "question_text"))
    named = len(text) < 60 and re.fullmatch(r"[A-Z][a-zA-Z0-9\s\-_/,&]+", text) and not _ASKING.search(text)
    return f"{qid} {text}" if named and re.fullmatch(r"(?:[A-Za-z0-9]+\.)+\d+", qid) else ""


def _loads(answer: str) -> dict:
    body = re.sub(r"^```(?:json)?\s*|\s*```$", "", (answer or "").strip(), flags=re.I)
    try:
        out = json.loads(body)
    except ValueError:
        return {}
    return out if isinstance(out, dict) else {}


@dataclass
class Step:
    """A page between its first answer and its row: ``back`` names the pages that the model wants to see again."""

    said: dict
    before: str
    first_new: str
    changed: bool
    notes: list
    chapter: dict | None
    back: list
    error: str | None

    def dump(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False)

    @classmethod
    def load(cls, text: str) -> Step:
        return cls(**json.loads(text))


def _call(model: VisionModel, prompt: str, images: list) -> tuple[dict, str | None]:
    try:
        return _loads(model([prompt], [images])[0]), None
    except Exception as exc:  # noqa: BLE001
        return {}, f"{type(exc).__name__}: {exc}"


def _back_pages(said: dict, page: int) -> list[int]:
    """Earlier pages asked for, each once. Anything that is no list counts as none, entries that are no numbers are passed over."""
    if not said.get("request_back_read"):
        return []
    listed, found = said.get("back_read_pages"), []
    for entry in listed if isinstance(listed, list) else []:
        try:
            wanted = int(entry)
        except (TypeError, ValueError, OverflowError):
            continue
        if 1 <= wanted < page and wanted not in found:
            found.append(wanted)
    return found or ([page - 1] if page > 1 else [])


def first_look(state: Reader, page: int, image, model: VisionModel) -> Step:
    """Asks about a page and follows the chapters found on it."""
    before = state.expected(page)
    said, error = _call(model, state.prompt(page), [image])
    raw = said.get("detected_new_chapters", said.get("detected_new_chapter")) or []
    chapters = [c for c in (raw if isinstance(raw, list) else [raw]) if isinstance(c, dict) and c.get("id")]
    notes = [n for n in (state.enter(c, page) for c in chapters) if n]
    entered = S.outline_entry(str(chapters[-1]["id"]))[0] if chapters else ""
    state.active = entered or str(said.get("active_chapter", before) or "").strip() or before
    first = str(chapters[0].get("first_question_id", "") or "").strip() if len(chapters) == 1 else ""
    return Step(said, before, first, bool(entered) and entered != before, notes, chapters[0] if chapters else None, _back_pages(said, page), error)


def back_prompt(state: Reader, page: int, step: Step, history: list[dict]) -> str:
    """Prompt of the second look. history: page, active, ids and pending of the pages asked for."""
    parts = [f"Read pages {step.back} again together with page {page} of {state.total}."]
    parts += [f"<History_Page_{h['page']}>\nchapter: {h['active']} | ids: {h['ids']}\nunfinished: {h['pending']}\n</History_Page_{h['page']}>" for h in history]
    return "\n\n".join(parts)


def second_look(state: Reader, page: int, step: Step, images: list, history: list[dict], model: VisionModel) -> None:
    """Asks again with the pages wanted (``images``: these in the order asked for, then the page itself); what is said replaces the first answer."""
    said, error = _call(model, back_prompt(state, page, step, history), images)
    step.said, step.before, step.error = {**step.said, **said}, step.before if error else state.active, error or step.error


def finish(state: Reader, page: int, step: Step) -> tuple:
    """Leaves the state for the next page and gives the page's row, from ``before`` on."""
    said = step.said
    state.pending = str(said.get("pending_context", "") or "").strip()
    heading = str(said.get("current_heading", "") or "").strip()
    if state.active and state.stack[:1] != [state.active]:
        state.stack = [state.active]
    if heading and heading not in state.stack:
        state.stack.append(heading)
    listed = said.get("extracted_questions")
    found = [q for q in listed if isinstance(q, dict)] if isinstance(listed, list) else []
    state.stack += [h for h in (_heading(q) for q in found) if h and h not in state.stack]
    state.memory = S.reading_memory(page, state.total, state.active, labels(found), step.chapter, state.pending, state.stack)
    return (step.before, state.active, step.first_new, step.changed, list(state.sections), dict(state.depictions), json.dumps(found, ensure_ascii=False), state.pending,
            step.notes, step.back, step.error)


def labels(found: list[dict]) -> list[str]:
    return [str(q.get("question_id", "")) for q in found]


def remembered(page: int, active: str, answer: str, pending: str) -> dict:
    """What a page's row tells a later look back at it."""
    return {"page": page, "active": active, "ids": labels(json.loads(answer)), "pending": pending}
