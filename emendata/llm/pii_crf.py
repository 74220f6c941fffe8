"""Personal data by a semi-Markov conditional random field over whole spans.

Base spans come from one pattern and one check for each kind, and stay. Where items stand side by side a pattern
runs over both and its check fails; there the field decides. A text is cut to islands, runs of characters that
personal data is made of, around digits and @; an island is cut to atoms (letters, digits, single marks). A
candidate segment is a run of at most MOST_ATOMS atoms. Its features are those of the whole span: how many
digits, the lengths of their groups, marks, checksum, octets, the form of an address, the characters beside it.
Dynamic programming over the atoms chooses boundaries and kinds together; atoms outside segments cost nothing.
Atoms of base spans are closed to it.

The field is trained by conditional likelihood on islands that the base spans label: for each set of kinds the
SAMPLE islands of least hash among all distinct ones of the table (an exact bottom-k sample, so that copies count
once). Islands joined pairwise by a space, each with its own labels, show it items side by side. Islands with a match
of more digits than its kind may have are left out, as their labels are what the field is to find.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept_fields

KINDS = ("email", "ip", "card", "phone")
#: Atoms of a segment, digits of a segment, and islands learned from for each set of kinds.
MOST_ATOMS, MOST_DIGITS, SAMPLE = 24, 20, 400
#: Steps of training, their size, the weight of the ridge, and the weight of a feature that training never saw.
STEPS, RATE, RIDGE, UNSEEN = 80, 0.4, 0.0002, -5.0

# The patterns of the base spans, without what only costs time. An address's part before @ is the run
# of its characters to the left of an @.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_HOT = re.compile(r"[0-9@]")
_MORE = re.compile(r"[A-Za-z0-9._%+@()-]*")
_ISLAND = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+@()-")
_ATOM = re.compile(r"[A-Za-z]+|[0-9]+|.", re.DOTALL)
_GROUP = re.compile(r"[0-9]+")
_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if k % 2 == 0 else v * 2 - 9 * (v > 4)
    return total % 10 == 0


def base_spans(text: str) -> tuple[list[Span], list[tuple[int, int]]]:
    """Spans that pass, by kind and start, and (start, end) of matches dropped for more digits than the kind may have."""
    spans, dropped = [], []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            spans.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if not _HOT.search(text):
        return spans, dropped
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.group().split(".")):
            spans.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            spans.append((2, m.start(), m.end()))
        elif len(digits) > 19:
            dropped.append(m.span())
    for m in _PHONE.finditer(text) if "+" in text else ():
        digits = sum(len(g) for g in _GROUP.findall(m.group()))
        if 8 <= digits <= 15:
            spans.append((3, m.start(), m.end()))
        elif digits > 15:
            dropped.append(m.span())
    return spans, dropped


def islands(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the runs of island characters around a digit or @; runs that one space parts are one."""
    low = high = -1
    hit = _HOT.search(text)
    while hit:
        start, end = hit.start(), _MORE.match(text, hit.end()).end()
        while start > max(high, 0) and text[start - 1] in _ISLAND:
            start -= 1
        if low >= 0 and start == high + 1 and text[high] == " ":
            high = end
        else:
            if low >= 0:
                yield low, high
            low, high = start, end
        hit = _HOT.search(text, end)
    if low >= 0:
        yield low, high


def _beside(c: str) -> str:
    return "none" if not c else "space" if c.isspace() else "digit" if c.isdigit() else "letter" if c.isalpha() else "mark"


def _features(span: str, before: str, after: str) -> tuple[str, ...]:
    edges = (f"before {_beside(before)}", f"after {_beside(after)}")
    if "@" in span:
        return ("any", "address" if _ADDRESS.fullmatch(span) else "no address", *edges)
    groups = _GROUP.findall(span)
    digits = "".join(groups)
    marks = "".join(sorted(set(_GROUP.sub("", span))))
    octets = len(groups) == 4 and span.count(".") == 3 and len(span) == len(digits) + 3
    out = ["any", f"digits {len(digits)}", f"groups {'-'.join(str(len(g)) for g in groups) if len(groups) < 7 else 'many'}", f"marks {marks}", f"first {span[0] if span[0] in '+(' else 'digit'}", *edges]
    out.append("octets" if octets and all(int(g) <= 255 for g in groups) else "no octets")
    out.append("sum" if 13 <= len(digits) <= 19 and luhn(digits) else "no sum")
    return tuple(out)


def _atoms(island: str) -> list[tuple[int, int]]:
    return [m.span() for m in _ATOM.finditer(island)]


def candidates(island: str, atoms: list[tuple[int, int]], before: str, after: str, closed: set[int] = frozenset()) -> list[list[tuple[int, tuple[str, ...]]]]:
    """For each atom the segments that end with it: (first atom, features). None runs over a closed atom."""
    ending: list[list] = [[] for _ in atoms]
    for i, (start, _) in enumerate(atoms):
        if i in closed or not (island[start].isalnum() or island[start] in "+("):
            continue
        digits = groups = dots = ats = 0
        letters = False
        for j in range(i, min(i + MOST_ATOMS, len(atoms))):
            if j in closed:
                break
            a, b = atoms[j]
            c = island[a]
            if "0" <= c <= "9":
                digits += b - a
                groups += 1
            elif c.isalpha():
                letters = True
            elif c == "@":
                ats += 1
            dots += c == "."
            if ats > 1 or (ats or letters) and c in " ()" or not ats and not letters and digits > MOST_DIGITS:
                break
            if not c.isalnum():
                continue
            if ats or not letters and (digits >= 7 or groups == 4 and dots == 3):
                ending[j].append((i, _features(island[start:b], island[start - 1] if start else before, island[b] if b < len(island) else after)))
    return ending


def _kinds(features: tuple[str, ...]) -> range:
    return range(0, 1) if features[1].endswith("address") else range(1, 4)


class Field:
    """Weights of (kind, feature). An atom outside segments has the score 0."""

    def __init__(self, weights: dict[tuple[int, str], float] | None = None):
        self.weights = weights or {}
        self._known: dict[tuple[str, ...], list[tuple[int, float]]] = {}

    def scored(self, features: tuple[str, ...]) -> list[tuple[int, float]]:
        out = self._known.get(features)
        if out is None:
            if len(self._known) > 100_000:
                self._known.clear()
            # what was never seen in training speaks against a segment
            out = self._known[features] = [(y, sum(self.weights.get((y, f), UNSEEN) for f in features)) for y in _kinds(features)]
        return out

    def best(self, ending: list[list[tuple[int, tuple[str, ...]]]]) -> list[tuple[int, int, int]]:
        """(kind, first atom, last atom) of the segments of the likeliest segmentation; at equal scores fewer ones."""
        value, back = [0.0], [None]
        for j, segments in enumerate(ending):
            here, segment = value[j], None
            for i, features in segments:
                for y, score in self.scored(features):
                    if value[i] + score > here:
                        here, segment = value[i] + score, (y, i, j)
            value.append(here)
            back.append(segment)
        out, at = [], len(ending)
        while at:
            if (segment := back[at]) is None:
                at -= 1
            else:
                out.append(segment)
                at = segment[1]
        return out[::-1]


Example = tuple[tuple[tuple[tuple[int, tuple[str, ...]], ...], ...], tuple[tuple[int, int, int], ...]]


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top if top == -math.inf else top + math.log(sum(math.exp(v - top) for v in values))


def _expected(field: Field, ending) -> Iterator[tuple[tuple[str, ...], int, float]]:
    """(features, kind, probability) of each candidate segment over all segmentations, by forward and backward sums."""
    n = len(ending)
    into: list[list[tuple[int, float]]] = [[] for _ in range(n)]  # of each first atom: atom after the segment, score
    forward = [0.0]
    for j, segments in enumerate(ending):
        sums = [forward[j]]
        for i, features in segments:
            for _, score in field.scored(features):
                sums.append(forward[i] + score)
                into[i].append((j + 1, score))
        forward.append(_log_sum(sums) if len(sums) > 1 else sums[0])
    backward = [0.0] * (n + 1)
    for i in range(n - 1, -1, -1):
        backward[i] = _log_sum([backward[i + 1], *[backward[k] + score for k, score in into[i]]]) if into[i] else backward[i + 1]
    for j, segments in enumerate(ending):
        for i, features in segments:
            for y, score in field.scored(features):
                yield features, y, math.exp(min(0.0, forward[i] + score + backward[j + 1] - backward[0]))


def train(examples: dict[Example, float]) -> Field:
    """The field of greatest conditional likelihood of the examples, less a ridge, by steps of Adam."""
    total = sum(examples.values())
    if not total:
        return Field()
    observed: Counter = Counter()
    for (ending, gold), n in examples.items():
        for y, i, j in gold:
            for f in next(x for a, x in ending[j] if a == i):
                observed[y, f] += n / total
    keys = sorted({(y, f) for ending, _ in examples for segments in ending for _, features in segments for y in _kinds(features) for f in features})
    value, first, second = dict.fromkeys(keys, 0.0), dict.fromkeys(keys, 0.0), dict.fromkeys(keys, 0.0)
    for step in range(1, STEPS + 1):
        field, segments = Field(value), Counter()
        for (ending, _), n in examples.items():
            for features, y, p in _expected(field, ending):
                segments[features, y] += p * n / total
        expected: Counter = Counter()
        for (features, y), p in segments.items():
            for f in features:
                expected[y, f] += p
        for k in keys:
            slope = observed[k] - expected[k] - RIDGE * value[k]
            first[k] = 0.9 * first[k] + 0.1 * slope
            second[k] = 0.99 * second[k] + 0.01 * slope * slope
            value[k] += RATE * (first[k] / (1 - 0.9**step)) / (math.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
    return Field(value)


def _example(text: str, spans: list[Span]) -> Example | None:
    """The island ``text`` (with a character on either side, or a line break for none) and its labels; None if a label is no candidate."""
    island, atoms = text[1:-1], _atoms(text[1:-1])
    ending = candidates(island, atoms, text[0].strip("\n"), text[-1].strip("\n"))
    if not any(ending):
        return None
    first, last = {a: k for k, (a, _) in enumerate(atoms)}, {b: k for k, (_, b) in enumerate(atoms)}
    gold = []
    for y, start, end in sorted(spans, key=lambda s: s[1:]):
        i, j = first.get(start), last.get(end)
        if i is None or j is None or not any(a == i and y in _kinds(f) for a, f in ending[j]) or gold and gold[-1][2] >= i:
            return None
        gold.append((y, i, j))
    return tuple(tuple(e) for e in ending), tuple(gold)


def _labelled(text: str) -> Iterator[tuple[str, str]]:
    """(set of kinds, island with a character on either side) of the islands that can be learned from."""
    spans, dropped = base_spans(text)
    for low, high in islands(text):
        if any(a < high and b > low for a, b in dropped):
            continue
        inside = [(y, a - low, b - low) for y, a, b in spans if a >= low and b <= high]
        if not inside and sum(c.isdigit() for c in text[low:high]) < 7:
            continue
        around = (text[low - 1] if low else "\n") + text[low:high] + (text[high] if high < len(text) else "\n")
        if len(around) <= 400:
            yield "".join(str(k) for k in sorted({y for y, _, _ in inside})), around


def sample_islands(df: DataFrame, text: str = "text", most: int = SAMPLE) -> list[tuple[str, str]]:
    """(set of kinds, island): for each set the ``most`` distinct islands of least hash, wherever they are found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[str, dict[str, int]] = {}
        for batch in batches:
            for value in batch.column(0).to_pylist():
                for kinds, island in _labelled(value or ""):
                    of = least.setdefault(kinds, {})
                    of[island] = zlib.crc32(island.encode("utf-8", "surrogatepass"))
                    if len(of) > 4 * most:
                        least[kinds] = dict(heapq.nsmallest(most, of.items(), key=lambda x: (x[1], x[0])))
        rows = [(kinds, island, h) for kinds, of in least.items() for island, h in heapq.nsmallest(most, of.items(), key=lambda x: (x[1], x[0]))]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["kinds", "island", "h"])

    found = df.filter(F.col(text).rlike("[0-9@]")).select(text).mapInArrow(run, "kinds string, island string, h long").distinct()
    place = F.row_number().over(Window.partitionBy("kinds").orderBy("h", "island"))
    rows = found.withColumn("place", place).filter(F.col("place") <= most).collect()
    return sorted((r["kinds"], r["island"]) for r in rows)


def learn(sample: list[tuple[str, str]]) -> Field:
    """The field for a sample of labelled islands, alone and joined pairwise."""
    by_hash = sorted((island for _, island in sample), key=lambda x: (zlib.crc32(x.encode("utf-8", "surrogatepass"), 7), x))
    examples: Counter = Counter()
    for island, following in zip(by_hash, [*by_hash[1:], ""]):
        own = [(y, a - 1, b - 1) for y, a, b in base_spans(island)[0]]
        if example := _example(island, own):
            examples[example] += 1
        if following:
            shift = len(island) - 1
            theirs = [(y, a - 1 + shift, b - 1 + shift) for y, a, b in base_spans(following)[0]]
            if example := _example(island[:-1] + " " + following[1:], own + theirs):
                examples[example] += 1
    return train(dict(sorted(examples.items(), key=lambda x: (-x[1], repr(x[0])))[:400]))


def find(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """Base spans and added spans of a text, each by kind and start."""
    base, _ = base_spans(text)
    added = []
    if field.weights:
        taken = sorted((a, b) for _, a, b in base)
        at = 0
        for low, high in islands(text):
            while at < len(taken) and taken[at][1] <= low:
                at += 1
            if at < len(taken) and taken[at][0] <= low and taken[at][1] >= high:
                continue
            island = text[low:high]
            atoms = _atoms(island)
            inside = [t for t in taken[at:] if t[0] < high] if at < len(taken) and taken[at][0] < high else []
            closed = _closed(atoms, [(a - low, b - low) for a, b in inside])
            ending = candidates(island, atoms, text[low - 1] if low else "", text[high] if high < len(text) else "", closed)
            if any(ending):
                added += [(y, low + atoms[i][0], low + atoms[j][1]) for y, i, j in field.best(ending)]
    return base, sorted(added)


def _closed(atoms: list[tuple[int, int]], spans: list[tuple[int, int]]) -> set[int]:
    out, k = set(), 0
    for a, b in sorted(spans):
        while k and atoms[k - 1][1] > a:
            k -= 1
        while k < len(atoms) and atoms[k][0] < b:
            if atoms[k][1] > a:
                out.add(k)
            k += 1
    return out


def detect(df: DataFrame, field: Field | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and spans (kind, start, end, added) of every row of ``df``, by kind as in KINDS, then start.

    Places count code points; ends are exclusive. Null and empty texts have no spans. The field is learned from
    the table itself where none is given; a table without any base span teaches nothing, and nothing is added.
    Added spans overlap neither base spans nor each other. Rows that repeat are judged each; other columns are ignored.
    """
    field = learn(sample_islands(df, text)) if field is None else field
    shared = df.sparkSession.sparkContext.broadcast(field)
    wanted = df.select(*keep, F.col(text).alias("_text"))
    width = len(keep)
    names = [*wanted.columns[:width], "spans"]
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("added", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for low in range(0, len(batch), 256):
                part = batch.slice(low, 256)
                rows = []
                for value in part.column(width).to_pylist():
                    base, added = find(value or "", model)
                    marked = sorted([(y, a, b, False) for y, a, b in base] + [(y, a, b, True) for y, a, b in added])
                    rows.append([{"kind": KINDS[y], "start": a, "end": b, "added": more} for y, a, b, more in marked])
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in range(width)], pa.array(rows, pa.list_(kind))], names=names)

    return wanted.mapInArrow(run, kept_fields(wanted, width, "spans array<struct<kind:string,start:int,end:int,added:boolean>>"))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
