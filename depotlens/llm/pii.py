"""Personal data: candidate spans of wide generators, judged by boosted trees over format and context.

Base spans (fixed patterns and checks) always stay.  Generators propose many more spans, which may overlap: broken-up
addresses, numbers without a plus, other separators.  Trees learn from a bounded sample of candidates which of
them look and stand like the base spans of their kind (features leave out the very marks by which the base patterns
tell), and a threshold for each kind is calibrated to the precision wanted on all candidates that were not fitted on.  Of overlapping
proposals above it the surest stays, beside the base.

Defined cases: NULL text counts as empty and has no spans.  Offsets are code points, the end exclusive.  Kinds without base
spans add nothing.  Copies of a text count once in training.  Rows are never joined by id, so repeated and NULL ids keep their rows.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotlens.llm.boost import Forest, boosted
from depotlens.llm.text import slices, texts_of
from depotlens.session import materialise

KINDS = ("email", "ip", "card", "phone")

# Fixed patterns of the base.  A look-behind spares an address or number from being tried again at each of its digits.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Wide generators by kind.
_WIDE = {
    "email": re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63} ?(?:@|\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}) ?[A-Za-z0-9-]{1,63}){1,8}", re.I),
    "ip": re.compile(r"(?<![0-9])[0-9]{1,3}(?: ?[.,:\[\]()-]{1,3} ?[0-9]{1,3}){3}(?![0-9])"),
    "card": re.compile(r"(?<![0-9])[0-9]{4}(?:[ ._/:-]{0,2}[0-9]{2,6}){2,5}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9])(?:00 ?[0-9]{1,3}[ ./-]?)?\(?[0-9]{2,4}\)?(?:[ ./()-]{1,3}[0-9]{2,5}){1,4}(?![0-9])"),
}
# Whether a text can hold any span at all.
_ANY = r"[0-9@]|[(\[{][aA][tT][)\]}]"
_CUES = re.compile(r"mail|phone|tel|call|fax|mobile|card|visa|account|contact|address|server|host|ip", re.I)

Span = tuple[int, int, int]  # start, place of the kind, end


@dataclass(frozen=True)
class Settings:
    sample: int = 20_000  # candidates the trees are fitted on, at most
    precision: float = 0.98  # of added spans, on the candidates that were not fitted on
    least: int = 20  # base-like candidates of a kind before it may add spans


def luhn(digits: str) -> bool:
    own = [int(c) for c in reversed(digits)]
    return (sum(own[::2]) + sum(sum(divmod(2 * d, 10)) for d in own[1::2])) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost spans of each kind that pass their checks, in order."""
    found: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            found.append((start, 0, end))
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def candidates(text: str) -> list[Span]:
    """Spans of all generators; they may overlap each other and the base."""
    return sorted({(m.start(), k, m.end()) for k, kind in enumerate(KINDS) for m in _WIDE[kind].finditer(text)} | set(base_spans(text)))


FEATURES = 4 + 17


def features(text: str, span: Span) -> list[float]:
    start, kind, end = span
    own = text[start:end]
    digits = re.sub(r"[^0-9]", "", own)
    parts = re.findall(r"[0-9]+", own)
    counts = Counter(digits)
    before, after = text[max(0, start - 1):start], text[end:end + 1]
    context = text[max(0, start - 40):start]
    entropy = -sum(n / len(digits) * math.log2(n / len(digits)) for n in counts.values()) if digits else 0.0
    return [
        *(float(kind == k) for k in range(4)),
        len(own), len(digits), len(parts), max(map(len, parts), default=0), min(map(len, parts), default=0),
        sum(c.isalpha() for c in own), sum(c.isspace() for c in own), len(set(re.sub(r"[0-9A-Za-z]", "", own))), entropy,
        float(before.isalnum()), float(after.isalnum()), float(before.isspace() or not before), float(after.isspace() or not after),
        float(before in "\"'=:_/#"), float(bool(_CUES.search(context))), float(bool(digits) and luhn(digits)),
        float(kind == 1 and bool(parts) and max(int(p[-6:]) for p in parts) <= 255),
    ]


def labelled(text: str) -> list[tuple[Span, int]]:
    """Each candidate with its label: 1 for a base span or most of one of its kind, 0 for the rest."""
    base = base_spans(text)
    starts, ends = [[s for s, k, _ in base if k == kind] for kind in range(4)], [[e for _, k, e in base if k == kind] for kind in range(4)]
    out = []
    for span in candidates(text):
        own, i = starts[span[1]], bisect_right(ends[span[1]], span[0])  # spans of a kind lie apart from each other
        alike = False
        while i < len(own) and own[i] < span[2] and not alike:
            s, e = own[i], ends[span[1]][i]
            alike = min(e, span[2]) - max(s, span[0]) >= 0.7 * (e - s)
            i += 1
        out.append((span, int(alike)))
    return out


def text_key(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text)


def span_key(key: int, span: Span) -> int:
    """Hash of a text's key and a span of it: copies of a text have the same."""
    return xxhash.xxh3_64_intdigest("%d:%d:%d" % span, seed=key) >> 1


@dataclass(frozen=True)
class Model:
    forest: Forest | None
    thresholds: tuple[float, ...]

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """Proposals over their kind's threshold that meet no base span; the surest of those that overlap."""
        held = Taken(base)
        free = [c for c in candidates(text) if not held.meets(c)] if self.forest else []
        if not free:
            return []
        scores = self.forest.score(np.array([features(text, c) for c in free]))
        out: list[Span] = []
        for score, c in sorted(zip(scores, free, strict=True), key=lambda x: (-x[0], x[1])):
            if score >= self.thresholds[c[1]] and not held.meets(c):
                held.add(c)
                out.append(c)
        return sorted(out)


class Taken:
    """Places of a text that spans hold, as sorted ranges apart from each other."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, _, end in sorted(spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def meets(self, span: Span) -> bool:
        after = bisect_left(self.starts, span[2])
        return after > 0 and self.ends[after - 1] > span[0]

    def add(self, span: Span) -> None:
        at = bisect_left(self.starts, span[0])
        self.starts.insert(at, span[0])
        self.ends.insert(at, span[2])


def able(docs: DataFrame) -> DataFrame:
    return docs.select("text").filter(F.col("text").rlike(_ANY))


def sampled(docs: DataFrame, s: Settings) -> DataFrame:
    """(kind, y, place, key, x) of the candidates to fit on, three quarters of the texts giving them: of each kind and label the first by
    (place, key), the place being that among those of its text.  So no text comes again before all others have; copies of a text are one."""
    n = max(s.sample // 8, 1)

    def run(batches):
        best: dict[tuple[int, int], list] = {(k, y): [] for k in range(4) for y in range(2)}  # heaps, the last on top
        held: set[int] = set()
        for batch in batches:
            for part in slices(batch):
                for text in texts_of(part).to_pylist():
                    if (own := text_key(text)) % 4 == 0:
                        continue
                    groups: dict[tuple[int, int], list] = {}
                    for span, y in labelled(text):
                        groups.setdefault((span[1], y), []).append((span_key(own, span), span))
                    for group, found in groups.items():
                        heap = best[group]
                        for place, (key, span) in enumerate(sorted(found)[:n]):
                            if len(heap) == n and (-place, -key) <= heap[0][:2]:
                                break
                            if key not in held:
                                held.add(key)
                                row = (-place, -key, features(text, span))
                                if len(heap) < n:
                                    heapq.heappush(heap, row)
                                else:
                                    held.discard(-heapq.heapreplace(heap, row)[1])
        for (kind, y), heap in best.items():
            if heap:
                yield pa.RecordBatch.from_arrays([
                    pa.array([kind] * len(heap), pa.int32()), pa.array([y] * len(heap), pa.int32()), pa.array([-r[0] for r in heap], pa.int64()),
                    pa.array([-r[1] for r in heap], pa.int64()), pa.array([r[2] for r in heap], pa.list_(pa.float64()))], ["kind", "y", "place", "key", "x"])

    rows = able(docs).mapInArrow(run, "kind int, y int, place long, key long, x array<double>")
    once = materialise(rows.dropDuplicates(["key"]), "pii-candidates")
    return reduce(DataFrame.union, [once.filter((F.col("kind") == k) & (F.col("y") == y)).orderBy("place", "key").limit(n) for k in range(4) for y in range(2)])


BINS = 4096  # of scores, a power of two so that bins and thresholds agree


def counted(docs: DataFrame, forest: Forest, fitted: frozenset[int]) -> DataFrame:
    """(kind, y, bin, n): the candidates of all distinct texts by their score, those of the fit under bin -1."""
    shared = docs.sparkSession.sparkContext.broadcast((forest, fitted))

    def scored(rows):
        forest, fitted = shared.value
        bins = np.minimum((forest.score(np.array([r[0] for r in rows])) * BINS).astype(np.int64), BINS - 1)
        bins[[r[3] in fitted for r in rows]] = -1
        return pa.RecordBatch.from_arrays([
            pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32()), pa.array(bins.astype(np.int32)),
            pa.array([r[3] for r in rows], pa.int64())], ["kind", "y", "bin", "key"])

    def run(batches):
        rows = []
        for batch in batches:
            for part in slices(batch):
                for text in texts_of(part).to_pylist():
                    own = text_key(text)
                    for span, y in labelled(text):
                        rows.append((features(text, span), span[1], y, span_key(own, span)))
                        if len(rows) == 8192:
                            yield scored(rows)
                            rows = []
        if rows:
            yield scored(rows)

    rows = able(docs).mapInArrow(run, "kind int, y int, bin int, key long")
    return rows.dropDuplicates(["key"]).groupBy("kind", "y", "bin").agg(F.count("*").alias("n"))


def train(docs: DataFrame, s: Settings = Settings()) -> Model:
    """Fit on a bounded sample that depends on the set of distinct texts only; thresholds from all candidates that were not fitted on."""
    rows = sorted(sampled(docs, s).collect(), key=lambda r: (r.kind, r.y, r.place, r.key))  # sample bounds it
    if len({r.y for r in rows}) < 2:
        return Model(None, (2.0,) * 4)
    forest = boosted(np.array([r.x for r in rows]), np.array([float(r.y) for r in rows]))
    n = np.zeros((4, 2, BINS), np.int64)
    known = np.zeros(4, np.int64)
    for r in counted(docs, forest, frozenset(r.key for r in rows)).collect():  # at most 8 (BINS + 1)
        known[r.kind] += r.n * r.y
        if r.bin >= 0:
            n[r.kind, r.y, r.bin] += r.n
    return Model(forest, tuple(calibrated(n[k, 1], n[k, 0], s) if known[k] >= s.least else 2.0 for k in range(4)))


def calibrated(good: np.ndarray, bad: np.ndarray, s: Settings) -> float:
    """The lower end of the last bin of scores, from the highest on, to which the precision holds; 2 (none) if it never does."""
    right, every = np.cumsum(good[::-1])[::-1], np.cumsum((good + bad)[::-1])[::-1]
    holds = np.flatnonzero((every > 0) & (good + bad > 0) & (right >= s.precision * every))
    return max(float(holds[0]) / BINS, 0.5) if len(holds) else 2.0


def shown(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{start}:{end}" for start, k, end in spans)


def scan(texts: pa.Array, model: Model) -> list[tuple[list[Span], list[Span]]]:
    """Base and added spans of each text."""
    able = pc.match_substring_regex(texts, _ANY).to_pylist()
    out = []
    for text, look in zip(texts, able, strict=True):
        if look:
            own = text.as_py()
            base = base_spans(own)
            out.append((base, model.added(own, base)))
        else:
            out.append(([], []))
    return out


def detected(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every row; the counts are of base spans."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                found = scan(texts_of(part), shared.value)
                counts = [pa.array([sum(s[1] == k for s in base) for base, _ in found], pa.int64()) for k in range(4)]
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), *counts, pa.array([hashlib.sha256(shown(base).encode()).hexdigest() for base, _ in found]),
                    pa.array([shown(sorted(base + more)) for base, more in found]), pa.array([len(more) for _, more in found], pa.int64())], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def without(text: str, spans: list[Span]) -> str:
    """The text with each span, or each run of overlapping ones, replaced by its first kind in brackets."""
    out, at = [], 0
    for start, k, end in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{KINDS[k].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows with all spans replaced in ``text``, and ``n_chars``, where there is one, counted anew for changed texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, count = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                columns = list(part.columns)
                texts = part.column("text").to_pylist()
                for i, (base, more) in enumerate(scan(texts_of(part), shared.value)):
                    if base or more:
                        texts[i] = without(texts[i], base + more)
                changed = pa.array(texts, part.schema.field("text").type)
                if count is not None:
                    same = pc.fill_null(pc.equal(changed, columns[at]), True)
                    columns[count] = pc.if_else(same, columns[count], pc.utf8_length(changed).cast(columns[count].type))
                columns[at] = changed
                yield pa.RecordBatch.from_arrays(columns, part.schema.names)

    return docs.mapInArrow(run, docs.schema)
