"""Pages of words to tables: header line and band, column cuts, sub-columns, rows of cells.

Words are doc, page, text, x0, x1, top, bottom; pages are doc, page, width, height. All that is decided
here is decided within one page, so pages are dealt to tasks and each goes through `Page` by itself.
Words without text or coordinates are left out; a page without a header has no rows."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from functools import cached_property
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import HEADER_VOCABULARY, META_KEY, NUMERIC_FIELDS, PAGE_END, PAGE_NUMBER, PHONE_NUMBER, STREET_WORDS, SUBTOTAL_WORDS
from ..functions.text import TORN
from ..session import ship
from .headers import fields_told
from .layout import affinity_to, kinds_of

LINE_GAP, ROW_GAP, WORD_GAP, MARGIN = 3.5, 4.5, 8.0, 3.0
SPLIT, DOUBTFUL = 0.65, 0.40
_TORN = [(re.compile(r"\b" + r"[\s.]+".join(w) + r"\b\.?", re.I), w) for w in TORN]
_APART = re.compile(r"[^\W\d_][\s.]+[^\W\d_]")
_DIGIT, _ODD, _STREET, _META, _PAGE, _PHONE = (re.compile(p) for p in (r"\d", r"[^\w%./]", STREET_WORDS, META_KEY, PAGE_NUMBER, PHONE_NUMBER))
_END = re.compile("|".join(map(re.escape, PAGE_END)))
_VOCABULARY = frozenset(HEADER_VOCABULARY)
_KNOWN: dict[str, str | None] = {}
KEPT = 100_000
"""So many texts' fields are held in a task; then it begins anew."""


def _repaired(text: str) -> str:
    if _APART.search(text):
        for p, w in _TORN:
            text = p.sub(w, text)
    return " ".join(text.split())


def learn(texts: Iterable[str]) -> None:
    """Tells the fields of many texts for field_of(): those that need scoring are scored together, which is far cheaper."""
    if len(_KNOWN) > KEPT:
        _KNOWN.clear()
    new = [t for t in dict.fromkeys(texts) if t not in _KNOWN]
    _KNOWN.update(zip(new, fields_told([_repaired(t) for t in new])))


def field_of(text: str) -> str | None:
    """The canonical field that a text names as a header."""
    if text not in _KNOWN:
        learn([text])
    return _KNOWN[text]


@dataclass(frozen=True)
class Word:
    text: str
    x0: float
    x1: float
    top: float
    bottom: float

    @cached_property
    def middle(self) -> float:
        return (self.x0 + self.x1) / 2

    def joined(self, other: Word, between: str) -> Word:
        return replace(self, text=self.text + between + other.text, x1=max(self.x1, other.x1), bottom=max(self.bottom, other.bottom))


@dataclass
class Column:
    text: str
    field: str | None
    x0: float
    x1: float
    middle: float
    status: str = "clean"
    confidence: float | None = None


Line = list[Word]


def lines_of(words: Iterable[Word], gap: float) -> list[Line]:
    """Words in lines from the top; a line takes words up to `gap` from its running mean."""
    out: list[Line] = []
    level = 0.0
    for w in sorted(words, key=lambda w: (round(w.top / gap) * gap, w.x0)):
        if out and abs(w.top - level) <= gap:
            out[-1].append(w)
            n = len(out[-1])
            level = (level * n + w.top) / (n + 1)
        else:
            out.append([w])
            level = w.top
    return [sorted(x, key=lambda w: w.x0) for x in out]


def _glue(a: Word, b: Word, gap: float) -> str | None:
    """What joins two neighbours into one header: nothing, a blank, or None where they stay apart."""
    space = b.x0 - a.x1
    near = 0 <= space <= gap
    # most neighbours stand apart, and their texts together are seen only once
    if not near and not 0 <= space <= 2.5:
        return None
    one, two = field_of(a.text), field_of(b.text)
    if one and two and one != two:
        return None
    torn, phrase = field_of(a.text + b.text), field_of(f"{a.text} {b.text}")
    if near and torn and (not one or not two or torn in (one, two)):
        return ""
    if near and phrase and (not one or not two or phrase == one):
        return " "
    if 0 <= space <= 2.5 and min(len(a.text), len(b.text)) <= 2 and (not one or not two):
        return "" if not phrase else " "
    return None


def joined_line(line: Line, gap: float = WORD_GAP) -> Line:
    """A line with the words of one header joined, from left to right."""
    out: Line = []
    for w in line:
        between = _glue(out[-1], w, gap) if out else None
        if between is None:
            out.append(w)
        else:
            out[-1] = out[-1].joined(w, between)
    return out


def _heads(line: Line) -> list[Word]:
    return [w for w in line if _ODD.sub("", w.text.strip().lower()) in _VOCABULARY or field_of(w.text)]


def _text(line: Line) -> str:
    return " ".join(w.text for w in line)


def _under(w: Word, row: Line) -> bool:
    return any(abs(x.middle - w.middle) <= 25 or x.x0 <= w.middle <= x.x1 for x in row)


def _gains(line: Line) -> tuple[int, int]:
    """What speaks for a header in a line's words and in their places; the text may speak against it, lines below for it."""
    heads, fields = len(_heads(line)), {f for w in line if (f := field_of(w.text))}
    return sum([heads * 10, len(fields) * 15, 25 * ("itemName" in fields), 30 * (len(fields) >= 5), 15 * (len(line) >= 8), 10 * (max(w.x1 for w in line) - line[0].x0 > 250)]), heads


def header_score(line: Line, below: list[Line]) -> float:
    """How much a line looks like a table's header, with up to five lines below it."""
    if not line:
        return -100.0
    text, (gains, heads) = _text(line), _gains(line)
    aligned = [sum(_under(w, row) for w in line) / len(line) for row in below[:5] if sum(bool(_DIGIT.search(w.text)) for w in row) >= 3]
    colons, streets = text.count(":"), len(_STREET.findall(text))
    losses = [colons * 15 if colons >= 2 else colons * 5, len(_META.findall(text)) * 30, 35 * bool(_PAGE.search(text)), 40 * bool(_PHONE.search(text)), streets * 15 if streets >= 2 else 0, 25 * (len(line) >= 4 and heads / len(line) < 0.4)]
    return float(gains + 30 * max(aligned, default=0.0) - sum(losses))


def best_header(lines: list[Line], height: float) -> tuple[float, int]:
    """The score and place of the line that looks most like a header, the first of equals. Lines that could not reach the best
    with all that may stand below them are not scored; most are goods."""
    most = sorted(((-_gains(x)[0] - 30, k) for k, x in enumerate(lines) if x and x[0].top <= height * 0.65))
    best = (0.0, 0)
    for n, (bound, k) in enumerate(most):
        if n and -bound < best[0]:
            break
        got = header_score(lines[k], lines[k + 1 :]), -k
        best = max(best, got) if n else got
    return best[0], -best[1]


def _meta(text: str) -> bool:
    return bool(re.search(META_KEY, text) or re.search(PAGE_NUMBER, text) or re.search(PHONE_NUMBER, text)) or text.count(":") >= 2


def _joins_above(line: Line, best: Line) -> bool:
    text = _text(line)
    return abs(best[0].top - line[0].bottom) <= 15 and bool(_heads(line)) and not _meta(text) and len(re.findall(STREET_WORDS, text)) < 2


def _joins_below(line: Line, bottom: float) -> bool:
    text = _text(line)
    numbers = sum(bool(re.fullmatch(r"\d+(\.\d+)?", w.text.strip())) for w in line)
    dated = any(re.search(r"\b\d{1,2}[/-]\d{2,4}\b", w.text) for w in line)
    cents = numbers >= 1 and any(re.fullmatch(r"\d+\.\d{2}", w.text.strip()) for w in line)
    sums = bool(re.search(SUBTOTAL_WORDS, text)) and (numbers >= 1 or bool(re.search(r"\d+\.\d+", text)))
    data = numbers >= 3 or (numbers >= 2 and dated) or sums or cents
    return abs(line[0].top - bottom) <= 15 and bool(_heads(line)) and not data and not _meta(text)


def _stacks(cluster: Line, w: Word) -> bool:
    """Whether a word stands over or under a cluster of header words and can be of the same column."""
    lo, hi = min(x.x0 for x in cluster), max(x.x1 for x in cluster)
    overlap = min(w.x1, hi) - max(w.x0, lo)
    above = abs(w.middle - sum(x.middle for x in cluster) / len(cluster)) <= 12 or (overlap > 0 and overlap >= 0.4 * min(w.x1 - w.x0, hi - lo))
    fields = [f for x in cluster if (f := field_of(x.text))]
    own = field_of(w.text)
    return above and (not fields or not own or own in fields or bool(field_of(" ".join(x.text for x in [*cluster, w]))))


@dataclass
class Band:
    columns: list[Column]
    top: float
    bottom: float
    confidence: float


def header_band(words: list[Word], height: float) -> Band | None:
    """The header of a page: its best line in the upper two thirds, with a line above and below that belong to it."""
    lines = [joined_line(x) for x in lines_of(words, LINE_GAP)]
    best, at = best_header(lines, height)
    if best <= 20:
        return None
    band = [lines[at]]
    top, bottom = min(w.top for w in band[0]), max(w.bottom for w in band[0])
    if at and _joins_above(lines[at - 1], band[0]):
        band.insert(0, lines[at - 1])
        top = min(top, min(w.top for w in lines[at - 1]))
    if at + 1 < len(lines) and _joins_below(lines[at + 1], bottom):
        band.append(lines[at + 1])
        bottom = max(bottom, max(w.bottom for w in lines[at + 1]))
    clusters: list[Line] = []
    for w in sorted((w for x in band for w in x), key=lambda w: w.x0):
        home = next((c for c in clusters if _stacks(c, w)), None)
        if home is None:
            clusters.append([w])
        else:
            home.append(w)
    columns = []
    for c in clusters:
        c.sort(key=lambda w: w.top)
        text = _text(c)
        own = field_of(text) or next((f for w in c if (f := field_of(w.text))), None)
        x0, x1 = min(w.x0 for w in c), max(w.x1 for w in c)
        columns.append(Column(text, own, x0, x1, (x0 + x1) / 2))
    return Band(sorted(columns, key=lambda c: c.middle), top, bottom, min(1.0, best / 120))


def _valleys(words: list[Word]) -> list[tuple[float, float]]:
    out, edge = [], None
    for a, b in sorted((w.x0, w.x1) for w in words):
        if edge is not None and a > edge:
            out.append((edge, a))
        edge = b if edge is None else max(edge, b)
    return out


def _cut(left: Column, right: Column, body: list[Word], lines: list[Line], rules: list[float]) -> tuple[float, float]:
    """(best place of the border between two headers, the place without evidence)."""
    numeric = left.field in NUMERIC_FIELDS and right.field in NUMERIC_FIELDS
    item = left.field == "itemName"
    if left.x1 < right.x0:
        if numeric:
            lo, hi = min(left.middle + 1, left.x1 - 1), max(right.middle - 1, right.x0 + 1)
        else:
            lo, hi = max(left.x1 - 2, left.middle + 2), min(right.x0 + 2, right.middle - 2)
        usual = max(lo, right.x0 - 4) if item else (left.x1 + right.x0) / 2
    else:
        lo, hi, usual = left.middle + 2, right.middle - 2, (left.middle + right.middle) / 2
    if lo >= hi:
        lo, hi = min(left.middle, left.x1), max(right.middle, right.x0)
        usual = (lo + hi) / 2
    usual = min(hi, max(lo, usual))
    found = [(10.0, usual)] + [(50.0, x) for x in rules if lo <= x <= hi]
    least = max(lo, right.x0 - 25) if item else lo
    near = [w for w in body if w.x1 >= least - 3 and w.x0 <= hi + 3]
    for a, b in _valleys(near) if len(near) >= 2 else []:
        if b - a >= 1 and least <= (a + b) / 2 <= hi:
            found.append(((40 if numeric else 25) + min(25.0, (b - a) * 3) - abs((a + b) / 2 - usual) * 0.1, (a + b) / 2))
    if numeric:
        gaps = []
        for row in lines:
            a = [w.x1 for w in row if abs(w.middle - left.middle) <= abs(w.middle - right.middle) and w.x0 < right.middle]
            b = [w.x0 for w in row if abs(w.middle - left.middle) > abs(w.middle - right.middle) and w.x1 > left.middle]
            if a and b and min(b) - max(a) >= 1 and lo <= (max(a) + min(b)) / 2 <= hi:
                gaps.append((max(a) + min(b)) / 2)
        if len(gaps) >= 3:
            found.append((55 + min(15.0, len(gaps)), sorted(gaps)[len(gaps) // 2]))
    top = max(s for s, _ in found)
    return next(x for s, x in found if s == top), usual


def boundaries(heads: list[Column], width: float, body: list[Word], rules: list[float] = []) -> list[Column]:
    """Columns under headers: cuts by rulings, valleys between body words and the median gap of rows, from left to
    right; words far right of the last header make a column without a name."""
    if not heads:
        return []
    first, last = heads[0], heads[-1]
    left = min([first.x0, *(w.x0 for w in body if w.middle <= first.middle + 10)]) - MARGIN
    right = max([last.x1, *(w.x1 for w in body if w.middle >= last.middle - 10)]) + MARGIN
    cuts = [max(0.0, min(10.0, left))]
    lines = lines_of(body, 3.0)
    for a, b in zip(heads, heads[1:]):
        x, usual = _cut(a, b, body, lines, rules)
        cuts.append(x if x > cuts[-1] + 4 else cuts[-1] + max(5.0, (usual - cuts[-1]) * 0.5))
    end = min(width, max(width - 10, right))
    cuts.append(end if end > cuts[-1] + 4 else cuts[-1] + 15)
    out = [replace(c, x0=a, x1=b) for c, a, b in zip(heads, cuts, cuts[1:])]
    far = [w for w in body if w.x0 > last.x1 + 5]
    if len(far) >= 3:
        x0, x1 = min(w.x0 for w in far), max(w.x1 for w in far)
        split = (last.x1 + x0) / 2
        if split > out[-1].x0 + 10:
            out[-1] = replace(out[-1], x1=split)
            out.append(Column(f"Unnamed_Col_{len(out)}", None, split, min(width, max(width - 10, x1 + MARGIN)), (x0 + x1) / 2))
    return out


def _centres(xs: list[float], k: int) -> tuple[list[float], list[list[float]]]:
    """k-means of numbers, from quantiles, ten rounds at most."""
    xs = sorted(xs)
    centres = [xs[int(len(xs) * (2 * j + 1) / (2 * k))] for j in range(k)]
    parts: list[list[float]] = []
    for _ in range(10):
        parts = [[] for _ in range(k)]
        for x in xs:
            parts[min(range(k), key=lambda j: abs(x - centres[j]))].append(x)
        moved = [sum(p) / len(p) if p else c for p, c in zip(parts, centres)]
        if all(abs(a - b) < 0.1 for a, b in zip(moved, centres)):
            break
        centres = moved
    return centres, parts


def _kind(texts: list[str]) -> tuple[bool, ...]:
    return tuple(any(re.search(p, t, re.I) for t in texts) for p in (r"\d", "%", r"(tab|cap|amp|vial|syr|\*|'s)", r"\d{1,2}[/-]\d{2,4}"))


def subcolumns(columns: list[Column], rows: list[Line]) -> list[Column]:
    """Columns of which those that hold two or three values side by side are split: by the fields that the header
    names, how far clusters of words lie apart, in how many rows they occur, and how their values differ."""
    out: list[Column] = []
    for c in columns:
        names = [x for x in re.split(r"[\s+/&]+", c.text) if x] or [c.text]
        fields = {f for x in names if (f := field_of(x))}
        several, phrase = len(fields) >= 2, c.field is not None and len(fields) <= 1 and len(names) > 1
        cells = [x for row in rows if (x := [w for w in row if c.x0 <= w.middle <= c.x1])]
        multi = sum(len(x) >= 2 for x in cells)
        candidate = c.field != "itemName" and ((several and multi >= 1) or (not phrase and multi / max(1, len(cells)) >= 0.5 and multi >= 3))
        xs = [w.middle for x in cells for w in x]
        best, centres = 0.0, []
        for k in (2, 3) if candidate and len(xs) >= 4 else ():
            if len(names) >= 2 and len(names) != k and not several:
                continue
            at, parts = _centres(xs, k)
            gap = min(b - a for a, b in zip(at, at[1:]))
            spread = max((sum((x - m) ** 2 for x in p) / len(p)) ** 0.5 if p else 999.0 for p, m in zip(parts, at))
            cover = min(sum(any(abs(w.middle - m) <= max(12.0, gap * 0.4) for w in x) for x in cells) for m in at) / max(1, len(cells))
            texts = [[w.text for x in cells for w in x if min(range(k), key=lambda j: abs(w.middle - at[j])) == n][:5] for n in range(k)]
            score = (0.4 if several else 0.15 if len(names) == k else 0.0) + (0.25 if gap >= 12 and spread <= 8 else 0.15 if gap >= 8 else 0.0) + (0.25 if cover >= 0.6 else 0.15 if cover >= 0.4 else 0.0) + (0.15 if len({_kind(t) for t in texts}) >= 2 else 0.05)
            if score > best:
                best, centres = score, at
        if best >= SPLIT and not phrase:
            edges = [c.x0, *((a + b) / 2 for a, b in zip(centres, centres[1:])), c.x1]
            for j, m in enumerate(centres):
                name = names[j] if len(names) == len(centres) else f"{c.text}_{j + 1}"
                out.append(Column(name, field_of(name), edges[j], edges[j + 1], m, "split", round(best, 2)))
        else:
            doubtful = candidate and best >= DOUBTFUL and multi >= 2
            out.append(replace(c, status="ambiguous" if doubtful else "clean", confidence=round(best, 2) if candidate else None))
    return out


def assigned(row: Line, columns: list[Column]) -> tuple[list[str], int]:
    """Cells of a line, and how many of its words could as well be in another column."""
    cells: list[Line] = [[] for _ in columns]
    doubtful = 0
    for w in row:
        kinds = kinds_of(w.text)
        scores = [affinity_to(kinds, w.x0, w.x1, c.field, c.x0, c.x1) for c in columns]
        order = sorted(range(len(columns)), key=lambda k: -scores[k])
        cells[order[0]].append(w)
        doubtful += len(order) > 1 and scores[order[0]] - scores[order[1]] < 8 and scores[order[0]] > 10 and scores[order[1]] > 10
    return [" ".join(w.text for w in sorted(c, key=lambda w: w.x0)) for c in cells], doubtful


@dataclass
class Page:
    """A page's table: columns, and cells of each line of its body."""

    columns: list[Column] = field(default_factory=list)
    rows: list[list[str]] = field(default_factory=list)
    confidence: float = 0.0
    doubtful: int = 0

    @classmethod
    def of(cls, words: list[Word], width: float, height: float, rules: list[float] = []) -> Page:
        band = header_band(words, height)
        if band is None or band.confidence < 0.4:
            return cls()
        body = [w for w in words if w.top >= band.bottom + 1]
        end = min((w.top for w in body if w.top > band.bottom + 30 and _END.search(w.text.lower())), default=height)
        body = [w for w in body if w.bottom <= end + 2]
        lines = lines_of(body, ROW_GAP)
        columns = subcolumns(boundaries(band.columns, width, body, rules), lines)
        got = [assigned(x, columns) for x in lines]
        return cls(columns, [x for x, _ in got], band.confidence, sum(n for _, n in got))


ROWS = "doc long, page int, row_no int, cells array<string>, headers array<string>, fields array<string>, confidence double, doubtful int"
RESULT = pa.schema([("doc", pa.int64()), ("page", pa.int32()), ("row_no", pa.int32()), ("cells", pa.list_(pa.string())), ("headers", pa.list_(pa.string())), ("fields", pa.list_(pa.string())), ("confidence", pa.float64()), ("doubtful", pa.int32())])
PAGES = 256
"""So many pages are read at a time."""


def page_rows(words: DataFrame, pages: DataFrame) -> DataFrame:
    """Body lines of each page as rows of cells, with the page's headers and their fields, the header's confidence
    and the number of doubtful words. What is no goods row is for the operators of rows to tell."""
    ship(words.sparkSession)
    good = words.where("trim(text) <> '' and x0 is not null and x1 is not null and top is not null")
    made = good.join(pages.select("doc", "page", "width", "height"), ["doc", "page"]).select(F.col("doc").cast("long").alias("doc"), F.col("page").cast("int").alias("page"), F.trim("text").alias("text"), *(F.col(c).cast("double").alias(c) for c in ("x0", "x1", "top", "bottom", "width", "height")))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES):
                some = batch.slice(at, PAGES)
                pages_ = some.select(["doc", "page", "width", "height"]).to_pylist()
                words_ = (Word(t, a, b, y, y if z is None else z) for t, a, b, y, z in zip(*(c.to_pylist() for c in some.column("words").flatten().flatten())))
                own = [list(islice(words_, n)) for n in pc.list_value_length(some.column("words")).to_pylist()]
                learn(w.text for x in own for w in x)
                got = [Page.of(sorted(words, key=lambda w: (w.top, w.x0, w.x1, w.text)), x["width"] or 612.0, x["height"] or 792.0) for words, x in zip(own, pages_)]
                every = [(x, p, k, cells) for x, p in zip(pages_, got) for k, cells in enumerate(p.rows)]
                heads = [([c.text for c in p.columns], [c.field for c in p.columns]) for p in got for _ in p.rows]
                values = [[x["doc"] for x, _, _, _ in every], [x["page"] for x, _, _, _ in every], [k for _, _, k, _ in every], [c for _, _, _, c in every], [n for n, _ in heads], [f for _, f in heads], [p.confidence for _, p, _, _ in every], [p.doubtful for _, p, _, _ in every]]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, RESULT)], schema=RESULT)

    whole = made.groupBy("doc", "page").agg(F.collect_list(F.struct("text", "x0", "x1", "top", "bottom")).alias("words"), F.first("width").alias("width"), F.first("height").alias("height"))
    return whole.mapInArrow(run, ROWS)
