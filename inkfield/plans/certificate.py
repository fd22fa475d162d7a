"""One document's fields, in the order in which they claim blocks.

All that can be computed for many rows at once is an operator elsewhere. Claiming is sequential by
nature: which block a field gets depends on the fields before it. So a document's few dozen
blocks are read here as a whole. Fields ask for offers - the text after a label, then the free blocks near it,
best first - and take the first that reads as what they want.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from inkfield.catalogue import ANCHORS, CHECKED, ENDINGS, INLINE, MARKERS, NO_CHECK, OFFICE_ENDINGS, SPATIAL, SUBSTITUTED, UNCHECKED, UNLABELLED, WEIGHTS
from inkfield.options import Options
from inkfield.plans import words as w
from inkfield.schema import FIELDS


@dataclass(eq=False)
class Block:
    idx: int
    page: int
    text: str
    confidence: float
    x1: float
    y1: float
    x2: float
    y2: float
    parts: tuple = ()

    @property
    def height(self) -> float:
        return max(self.y2 - self.y1, 0.0)

    @property
    def scale(self) -> float:
        return max(self.height, 1.0)


def clamp(x: float) -> float:
    return min(max(x, 0.0), 1.0)


def rounded(x: float) -> float:
    return round(x * 1e4) / 1e4


def across(a: Block, b: Block) -> float:
    least = min(max(a.x2 - a.x1, 0.0), max(b.x2 - b.x1, 0.0))
    return clamp(max(0.0, min(a.x2, b.x2) - max(a.x1, b.x1)) / least) if least > 0 else 0.0


def upright(a: Block, b: Block) -> float:
    least = min(a.height, b.height)
    return clamp(max(0.0, min(a.y2, b.y2) - max(a.y1, b.y1)) / least) if least > 0 else 0.0


def geometry(label: Block, value: Block) -> float | None:
    """The better of the scores below and beside; null if the value is out of reach of both."""
    h, scores = label.scale, []
    down, aside = value.y1 - label.y2, value.x1 - label.x2
    if -0.35 * h <= down <= 3.0 * h and (o := across(label, value)) > 0.15:
        scores.append(blend(o, down, 1.5 * h, abs(value.x1 - label.x1) / (4.0 * h)))
    if -0.2 * h <= aside <= 10.0 * h and (o := upright(label, value)) > 0.35:
        off = abs((value.y1 + value.y2) - (label.y1 + label.y2)) / 2 / h
        scores.append(0.92 * blend(o, aside, 4.0 * h, off))
    return max(scores, default=None)


def blend(overlap: float, gap: float, reach: float, off: float) -> float:
    return 0.55 * overlap + 0.30 * math.exp(-max(gap, 0.0) / reach) + 0.15 * (1.0 - clamp(off))


def trust(strategy: float, alike: float, near: float, form: float, penalty: float = 1.0) -> float:
    return clamp(strategy * clamp(alike) * (0.75 + 0.25 * clamp(near)) * clamp(form) * clamp(penalty))


def weighed(parts: Iterable[tuple[str, float]]) -> float:
    rows = [(max(len(t), 1), c) for t, c in parts]
    return clamp(sum(n * c for n, c in rows) / sum(n for n, _ in rows)) if rows else 0.0


@dataclass
class Offer:
    label: w.Label
    at: Block  # the block it is taken from: the label's own for text after a label
    text: str
    near: float
    strategy: float


@dataclass
class Found:
    value: str
    confidence: float
    at: Block | None = None
    valid: bool = False
    substituted: bool = False
    raw: str | None = None
    said: str | None = None


class Document:
    def __init__(self, blocks: list[Block], options: Options):
        self.options = options
        self.blocks = sorted((b for b in blocks if b.text.strip()), key=lambda b: (b.page, b.y1, b.x1))
        self.labels: dict[int, w.Label] = {b.idx: m for b in self.blocks if (m := w.label_of(b.text))}
        self.split: set[int] = set()  # parts of labels over several lines
        self.claimed: set[int] = set()
        self.next = 1 + max((b.idx for b in self.blocks), default=-1)
        self.stacked: list[Block] = []
        for b in self.blocks:
            self.join_lines(b)
        self.runs = self.join_digits()

    # labels and numbers over several blocks

    def around(self, parts: list[Block], text: str) -> Block:
        self.next += 1
        return Block(self.next - 1, parts[0].page, text, min(p.confidence for p in parts), min(p.x1 for p in parts), min(p.y1 for p in parts), max(p.x2 for p in parts), max(p.y2 for p in parts), tuple(p.idx for p in parts))

    def under(self, above: Block) -> Block | None:
        """The topmost block right under another one in its column."""
        h = above.scale
        fit = (b for b in self.blocks if b.page == above.page and b is not above and b.idx not in self.split and -0.5 * h <= b.y1 - above.y2 <= 0.7 * h and abs(b.x1 - above.x1) <= 0.8 * h)
        return min(fit, key=lambda b: b.y1, default=None)

    def join_lines(self, first: Block) -> None:
        """Up to three lines become one label if together they are a longer alias, and nothing more."""
        if first.idx in self.split:
            return
        chain = [first]
        while len(chain) < 3 and (lower := self.under(chain[-1])):
            chain.append(lower)
        for parts in (chain[:n] for n in range(len(chain), 1, -1)):
            text = " ".join(p.text for p in parts)
            whole = w.label_of(text)
            known = max(len(self.labels[p.idx].alias) if p.idx in self.labels else 0 for p in parts)
            if whole and whole.inline is None and len(whole.alias) > known:
                made = self.around(parts, text)
                for p in parts:
                    self.split.add(p.idx)
                    self.labels.pop(p.idx, None)
                self.stacked.append(made)
                self.labels[made.idx] = whole
                return

    def join_digits(self) -> list[Block]:
        """Digit blocks side by side on a line, as one; four parts at most, on one page."""
        groups: list[list[Block]] = []
        for b in self.blocks:
            if self.is_label(b) or not w.all_digits(b.text):
                continue
            last = groups[-1][-1] if groups else None
            joins = last is not None and last.page == b.page and len(groups[-1]) < 4 and upright(last, b) > 0.5 and -0.2 * last.scale <= b.x1 - last.x2 <= 1.5 * last.scale
            groups[-1].append(b) if joins else groups.append([b])
        return [self.around(g, "".join(w.digits(b.text) for b in g)) for g in groups if len(g) > 1]

    # what is free, and what labels offer

    def is_label(self, b: Block) -> bool:
        return b.idx in self.labels or b.idx in self.split

    def free(self) -> list[Block]:
        return [b for b in self.blocks if not self.is_label(b) and b.idx not in self.claimed]

    def free_numbers(self) -> list[Block]:
        return self.free() + [r for r in self.runs if self.claimed.isdisjoint((r.idx, *r.parts))]

    def claim(self, *blocks: Block) -> None:
        for b in blocks:
            self.claimed.update((b.idx, *b.parts))

    def labelled(self, field: str) -> list[tuple[Block, w.Label]]:
        own = [(b, self.labels[b.idx]) for b in [*self.blocks, *self.stacked] if b.idx in self.labels and self.labels[b.idx].field == field]
        return sorted(own, key=lambda x: -x[1].similarity)

    def near(self, label: Block, pool: list[Block]) -> list[tuple[Block, float]]:
        scored = [(b, s) for b in pool if b is not label and b.page == label.page and (s := geometry(label, b)) is not None]
        return sorted(scored, key=lambda x: -x[1])

    def offers(self, field: str, pool: Callable[[], list[Block]]) -> Iterator[Offer]:
        for b, label in self.labelled(field):
            if label.inline is not None:
                yield Offer(label, b, label.inline, 1.0, INLINE)
            for value, score in self.near(b, pool()):
                yield Offer(label, value, value.text, score, SPATIAL)

    def judged(self, offer: Offer, value: str, form: float, penalty: float = 1.0, **more) -> Found:
        return Found(value, rounded(clamp(offer.at.confidence) * trust(offer.strategy, offer.label.similarity, offer.near, form, penalty)), offer.at, **more)

    # fields

    def numbers(self, field: str, length: int, valid: Callable[[str], bool]) -> list[Found]:
        """All numbers of a length near the field's labels: valid ones first, then by confidence."""
        found = []
        for offer in self.offers(field, self.free_numbers):
            if run := w.run_of(offer.text, length, self.options.substitute_digits):
                good = valid(run[0])
                found.append(self.judged(offer, run[0], CHECKED if good else UNCHECKED, SUBSTITUTED if run[1] else 1.0, valid=good, substituted=run[1]))
        return sorted(found, key=lambda f: (not f.valid, -f.confidence))

    def lone_number(self, length: int, valid: Callable[[str], bool]) -> Found | None:
        """A valid number without a label, if all there are say the same."""
        held = [(b, run[0]) for b in self.free_numbers() if (run := w.run_of(b.text, length)) and valid(run[0])]
        if len({v for _, v in held}) != 1:
            return None
        b, value = max(held, key=lambda x: x[0].confidence)
        return Found(value, rounded(clamp(b.confidence) * trust(UNLABELLED, 1.0, 1.0, CHECKED)), b, valid=True)

    def first(self, field: str, read: Callable[[Offer], Found | None]) -> Found | None:
        for offer in self.offers(field, self.free):
            if found := read(offer):
                if offer.strategy == SPATIAL:
                    self.claim(offer.at)
                return found
        return None

    def text_field(self, field: str, shape: Callable[[str], str]) -> Found | None:
        def read(offer: Offer) -> Found | None:
            said = offer.text if offer.strategy == INLINE else w.clean(offer.text)
            value = shape(said) if w.usable(said) else ""
            return self.judged(offer, value, NO_CHECK) if w.usable(value) else None

        return self.first(field, read)

    def date_field(self) -> Found | None:
        def read(offer: Offer) -> Found | None:
            iso = w.date_of(offer.text, self.options.today, self.options.two_digit_year_max)
            return self.judged(offer, iso, CHECKED, valid=True) if iso else None

        return self.first("IseBaslamaTarihi", read)

    def code_field(self) -> Found | None:
        def read(offer: Offer) -> Found | None:
            cell = w.clean(offer.text)
            if not (code := w.code_of(cell)):
                return None
            return self.judged(offer, code[0], 1.0 if len(code[0]) == 6 else NO_CHECK, raw=cell, said=code[1])

        return self.first("AnaFaaliyetKodu", read)

    def ends_value(self, b: Block, owner: Block) -> bool:
        """Whether a block starts something else: a number, a date, or the value of a label beside it."""
        if len(w.digits(b.text)) in (10, 11) and w.all_digits(b.text) or w.date_of(w.clean(b.text), self.options.today, self.options.two_digit_year_max):
            return True
        return any(o is not owner and o.idx in self.labels and o.page == b.page and o.x2 <= b.x1 and upright(o, b) > 0.5 for o in [*self.blocks, *self.stacked])

    def walk(self, anchor: Block, owner: Block, most: int) -> list[Block]:
        """The lines that go on under a block in its column."""
        h, at, taken = anchor.scale, anchor, []
        lower = [b for b in self.free() if b is not anchor and b.page == anchor.page and b.y1 >= anchor.y1 - 0.3 * h]
        for b in sorted(lower, key=lambda b: (b.y1, b.x1)):
            if len(taken) >= most or b.y1 - at.y2 > 1.6 * max(at.height, h) or self.ends_value(b, owner):
                break
            if across(anchor, b) > 0.15 or abs(b.x1 - anchor.x1) <= 4.0 * h:
                taken.append(b)
                at = b
        return taken

    def organisation(self) -> Found | None:
        for owner, label in self.labelled("TicaretUnvani"):
            for b, score in self.near(owner, self.free()):
                said = w.clean(b.text)
                if not w.usable(said) or len(w.digits(said)) > len(said) // 2:
                    continue
                ended = f" {w.normalize(said)}".endswith(tuple(f" {e}" for e in ENDINGS))
                parts = [b] if ended else [b, *self.walk(b, owner, 1)]
                value = " ".join(w.clean(p.text) for p in parts)
                name = f" {w.normalize(value)} "
                marked = any(f" {m} " in name and name != f" {m} " for m in MARKERS)
                self.claim(*parts)
                sure = trust(SPATIAL, label.similarity, score, 1.0 if marked else NO_CHECK)
                return Found(value, rounded(weighed((p.text, p.confidence) for p in parts) * sure), b)
        return None

    def address(self) -> Found | None:
        for owner, label in self.labelled("Adres"):
            parts, lines, anchor = [], [], owner
            if label.inline is not None:
                lines = [label.inline]
            else:
                anchor = next((b for b, _ in self.near(owner, self.free()) if w.usable(w.clean(b.text))), None)
                if anchor is None:
                    continue
                parts = [anchor]
            parts += self.walk(anchor, owner, max(0, self.options.max_address_lines - len(parts)))
            value = " ".join(x for x in [*lines, *(w.clean(p.text) for p in parts)] if x.strip())
            if not w.usable(value):
                continue
            self.claim(*parts)
            ocr = weighed([*((p.text, p.confidence) for p in parts), *((x, owner.confidence) for x in lines)])
            return Found(value, rounded(ocr * trust(SPATIAL, label.similarity, 0.9, NO_CHECK)), anchor)
        return None


def prose(value: str) -> str:
    return "" if 2 * len(w.digits(value)) > len(value) else value


def anchor_score(blocks: list[Block]) -> float:
    pages: dict[int, list[str]] = {}
    for b in blocks:
        pages.setdefault(b.page, []).append(w.normalize(b.text))
    said = [" ".join(p) for p in pages.values()]
    return clamp(sum(weight for anchor, weight in ANCHORS if any(anchor in s for s in said)))


def overall(found: dict[str, Found | None]) -> float:
    """Weighted mean of the found fields, less for what is missing. Of a pair of rival fields the missing one does not count."""
    rivals = {"vkn": "tckn", "tckn": "vkn", "ticaretUnvani": "adiSoyadi", "adiSoyadi": "ticaretUnvani"}
    counted = {f: x for f, x in WEIGHTS.items() if found[f] or not (f in rivals and found[rivals[f]])}
    have = sum(x for f, x in counted.items() if found[f])
    if not have:
        return 0.0
    quality = sum(x * found[f].confidence for f, x in counted.items() if found[f]) / have
    return rounded(quality * (0.6 + 0.4 * have / sum(counted.values())))


def read_document(rows: list[dict], n_pages: int, options: Options) -> dict:
    """The result of one document, without its id. rows: its blocks in wire order."""
    blocks = [Block(r["block_idx"], r["page"], r["text"] or "", r["confidence"], r["x1"], r["y1"], r["x2"], r["y2"]) for r in rows]
    empty = {"success": False, "document_type": "UNKNOWN", "data": None, "validation": None, "warnings": []}
    if not blocks:
        return empty | {"error": "NO_TEXT_DETECTED", "confidence": None}
    score = anchor_score(blocks)
    if score < options.min_document_score:
        return empty | {"error": "NOT_TAX_CERTIFICATE", "confidence": {"overall": 0.0, "documentType": score}, "warnings": [{"code": "UNSUPPORTED_DOCUMENT"}]}
    doc, told = Document(blocks, options), []

    def tell(code: str, field: str | None = None) -> None:
        told.append({"code": code, "field": field})

    def number(field: str, kind: str, length: int, valid: Callable[[str], bool], other: str | None) -> Found | None:
        have = [f for f in doc.numbers(kind, length, valid) if f.value != other]
        if not have and kind == "Vkn":
            lone = doc.lone_number(length, valid) if options.number_without_label else None
            tell("VKN_LABEL_NOT_FOUND" if lone else "VKN_NOT_FOUND", field)
            if lone:
                doc.claim(lone.at)
            return lone
        if not have:
            return None
        if len({f.value for f in have}) > 1:
            tell(f"MULTIPLE_{kind.upper()}_CANDIDATES", field)
        if not have[0].valid:
            tell(f"INVALID_{kind.upper()}_CHECKSUM", field)
        if have[0].substituted:
            tell("DIGIT_SUBSTITUTION_APPLIED", field)
        doc.claim(have[0].at)
        return have[0]

    if n_pages > 1:
        tell("MULTI_PAGE_DOCUMENT")
    found: dict[str, Found | None] = {}
    found["vkn"] = number("vkn", "Vkn", 10, w.tax_number_valid, None)
    found["tckn"] = number("tckn", "Tckn", 11, w.person_number_valid, found["vkn"].value if found["vkn"] else None)
    if not found["vkn"] and not found["tckn"]:
        tell("NO_IDENTITY_NUMBER_FOUND")
    found["vergiDairesi"] = doc.text_field("VergiDairesi", lambda v: w.without_ending(v, OFFICE_ENDINGS))
    found["ticaretUnvani"] = doc.organisation()
    found["adiSoyadi"] = doc.text_field("AdiSoyadi", lambda v: "" if w.digits(v) else v)
    found["iseBaslamaTarihi"] = doc.date_field()
    if not found["iseBaslamaTarihi"] and doc.labelled("IseBaslamaTarihi"):
        tell("DATE_PARSE_FAILED", "iseBaslamaTarihi")
    code = found["anaFaaliyetKodu"] = doc.code_field()
    if not code and doc.labelled("AnaFaaliyetKodu"):
        tell("ACTIVITY_CODE_PARSE_FAILED", "anaFaaliyetKodu")
    found["anaFaaliyetAciklamasi"] = Found(code.said, code.confidence) if code and code.said else doc.text_field("AnaFaaliyetAciklamasi", prose)
    found["adres"] = doc.address()
    page = weighed((b.text, b.confidence) for b in doc.blocks)
    if 0 < page < options.low_page_confidence:
        tell("LOW_OCR_CONFIDENCE")
    for f in FIELDS:
        if found[f] and found[f].confidence < options.low_field_confidence:
            tell("LOW_CONFIDENCE_ADDRESS" if f == "adres" else "LOW_CONFIDENCE_FIELD", f)
    checks = {f: {"valid": found[f].valid, "reason": None if found[f].valid else "CHECKSUM_FAILED"} if found[f] else None for f in ("vkn", "tckn")}
    return {
        "success": True,
        "document_type": "VERGI_LEVHASI",
        "error": None,
        "data": {f: found[f].value if found[f] else None for f in FIELDS} | {"anaFaaliyetKoduRaw": code.raw if code else None},
        "validation": checks | {"iseBaslamaTarihi": {"valid": True, "reason": None} if found["iseBaslamaTarihi"] else None},
        "confidence": {"overall": overall(found), "documentType": rounded(score)} | {f: found[f].confidence if found[f] else None for f in FIELDS},
        "warnings": told,
    }
