"""License scan: patience alignment of whole texts with license templates."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame

from tickloom.llm.common import widened

_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Template:
    """``need``: how often each word occurs; ``phrases``: places of the phrases that must stand whole in a text."""

    name: str
    words: list[str]
    need: dict[str, int]
    phrases: list[tuple[int, int]]


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of (template place, text place), sorted by the first, in which the second rises too."""
    tops: list[int] = []
    last: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        at = bisect_left(tops, b)
        back[i] = last[at - 1] if at else -1
        tops[at : at + 1], last[at : at + 1] = [b], [i]
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places of template ``a`` and text ``b``, rising in both.

    Equal ends are matched first; words that occur once in both are anchors, of which the longest rising subsequence
    stays; the gaps between anchors are aligned in the same way, until a gap has neither.
    """
    out, waiting = [], [(0, len(a), 0, len(b))]
    while waiting:
        i, j, k, m = waiting.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i == j or k == m:
            continue
        in_a, in_b = Counter(a[i:j]), Counter(b[k:m])
        place = {w: at for at, w in enumerate(b[k:m], k) if in_b[w] == 1}
        anchors = rising([(at, place[w]) for at, w in enumerate(a[i:j], i) if in_a[w] == 1 and w in place])
        out += anchors
        if anchors:
            ends = [(i - 1, k - 1), *anchors, (j, m)]
            waiting += [(x[0] + 1, y[0], x[1] + 1, y[1]) for x, y in zip(ends, ends[1:], strict=False)]
    return sorted(out)


def windows(places: list[int], size: int) -> Iterator[tuple[int, int]]:
    """Stretches of 1.5 ``size`` words, every half ``size``, that hold any of ``places`` (ascending): each stretch of
    ``size`` words lies in one of them."""
    half, last = max(1, size // 2), -1
    for place in places:
        for slot in range(max(last + 1, place // half - 2), place // half + 1):
            last = slot
            yield slot * half, slot * half + size + half


def phrases_of(template: str) -> list[tuple[int, int]]:
    """(first, behind last) places, among the template's words, of its phrases in braces."""
    parts, at, out = re.split(r"([{}])", template), 0, []
    for i, part in enumerate(parts):
        n = len(words_of(part))
        if i and parts[i - 1] == "{" and n:
            out.append((at, at + n))
        at += n
    return out


def told_apart(pairs: list[tuple[int, int]], phrases: list[tuple[int, int]]) -> bool:
    """Whether every phrase is aligned whole, with no word between its words: "GNU Lesser General" is not "GNU General"."""
    place = dict(pairs)
    return all(a in place and place.get(i) == place[a] + i - a for a, b in phrases for i in range(a, b))


def trimmed(pairs: list[tuple[int, int]], fewest: int, slack: int, phrases: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """``pairs`` without end pairs that lie over ``slack`` words further off in the text than in the template, as long
    as ``fewest`` stay: such a pair is a stray word, often of the next notice. Words of ``phrases`` stay."""
    low, high = 0, len(pairs)
    fixed = {i for a, b in phrases for i in range(a, b)}
    gap = lambda x, y: (y[1] - x[1]) - (y[0] - x[0])
    while high - low > fewest and pairs[low][0] not in fixed and gap(pairs[low], pairs[low + 1]) > slack:
        low += 1
    while high - low > fewest and pairs[high - 1][0] not in fixed and gap(pairs[high - 2], pairs[high - 1]) > slack:
        high -= 1
    return pairs[low:high]


def aligned(words: list[str], t: Template, low: int, high: int, end: int, least: float) -> tuple | None:
    """(-coverage, length, first word, last word, words aligned) of ``t`` in a window of ``words``, or None.

    A window goes to the alignment only if it holds enough of the template's words, counted with repeats: less can
    never reach ``least``. One that holds half of that grows to ``end`` at most, as long as each further half a template
    brings words that it still lacks."""
    size, fewest = len(t.words), least * len(t.words)
    seen = Counter(w for w in words[low:high] if w in t.need)
    held = sum(min(n, seen[w]) for w, n in t.need.items())
    if 2 * held < fewest:
        return None
    while True:
        if held >= fewest:
            pairs = patience(t.words, words[low:high])
            if len(pairs) >= fewest and told_apart(pairs, t.phrases):
                pairs = trimmed(pairs, max(2, ceil(fewest)), max(3, size // 10), t.phrases)
                first, last = low + pairs[0][1], low + pairs[-1][1]
                return -len(pairs) / size, last - first, first, last, len(pairs)
        before, further = held, min(high + max(4, size // 2), end)
        for w in words[high:further]:
            if w in t.need:
                held += seen[w] < t.need[w]
                seen[w] += 1
        if held == before:
            return None
        high = further


def free(low: int, high: int, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What ``taken`` spans (ascending, last word included) leave of a window that they reach into."""
    at, reached = max(0, bisect_left(taken, (low,)) - 1), False
    while at < len(taken) and taken[at][0] < high:
        first, last = taken[at]
        if last >= low:
            reached = True
            if low < first:
                yield low, first
            low = last + 1
        at += 1
    if reached and low < high:
        yield low, high


def spans_of(words: list[str], t: Template, places: list[int], least: float) -> list[tuple]:
    """Every span of ``t``, none over another: the best covered first, then the shorter, then the earlier. What they
    leave of a window is aligned again, until nothing more is found."""
    found, waiting = [], {(low, min(high, len(words))) for low, high in windows(places, len(t.words))}
    taken: list[tuple[int, int]] = []
    while waiting:
        drawn, tried = set(), []
        for low, high in waiting:
            at = bisect_left(taken, (low,))
            span = aligned(words, t, low, high, taken[at][0] if at < len(taken) else len(words), least)
            tried.append((low, high if span is None else max(high, span[3] + 1)))
            if span is not None:
                drawn.add(span)
        for span in sorted(drawn):
            at = bisect_left(taken, span[2:4])
            if (at == 0 or taken[at - 1][1] < span[2]) and (at == len(taken) or span[3] < taken[at][0]):
                taken.insert(at, span[2:4])
                found.append(span)
        waiting = {part for w in tried for part in free(*w, taken)}
    return found


def scan(text: str, templates: list[Template], least: float) -> list[tuple]:
    """(name, coverage, first word, last word, words aligned) of every span of every template in ``text``, the best
    first: ties go to the longer template, then to the name, then to the earlier place. Spans of one template do not
    overlap; those of two may (a notice inside a longer text)."""
    words = words_of(text)
    held: dict[str, list[int]] = {}
    wanted = {w for t in templates for w in t.need}
    for at, w in enumerate(words):
        if w in wanted:
            held.setdefault(w, []).append(at)
    out = []
    for t in templates:
        if sum(min(n, len(held.get(w, ()))) for w, n in t.need.items()) < least * len(t.words):
            continue
        if any(w not in held for a, b in t.phrases for w in t.words[a:b]):
            continue
        places = sorted(at for w in t.need for at in held.get(w, ()))
        for share, _, first, last, n in spans_of(words, t, places, least):
            out.append(((share, -len(t.words), t.name, first), (t.name, -share, first, last, n)))
    return [span for _, span in sorted(out)]


def license_spans(df: DataFrame, templates: dict[str, str], text: str = "text", least: float = 0.8) -> DataFrame:
    """All columns but ``text``, with ``spans``: license, coverage, first_word, last_word, aligned of every span of
    every template that is covered by ``least``, repeats too, and the same five of the best of them as columns.

    ``coverage`` is the share of the template's words (letters and digits, lower-cased) that patience alignment finds
    in order; without a span ``spans`` is empty and the five are null. Null, empty and word-less texts have none.
    Phrases in braces tell a template from its like: they must stand whole in the text, whatever the coverage.
    A text is scanned whole, in windows that grow with the template and not with the text; repeated rows repeat.
    """
    kept = [c for c in df.columns if c != text]
    compiled = [Template(name, words_of(t), dict(Counter(words_of(t))), phrases_of(t)) for name, t in sorted(templates.items()) if words_of(t)]
    fields = [("license", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("aligned", pa.int64())]
    names = [n for n, _ in fields]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(t.as_py() or "", compiled, least) for t in batch.column(0)]
            best = [spans[0] if spans else (None,) * 5 for spans in found]
            columns = [pa.array(c, kind) for c, (_, kind) in zip(zip(*best, strict=True) if best else [()] * 5, fields, strict=True)]
            every = pa.array([[dict(zip(names, s, strict=True)) for s in spans] for spans in found], pa.list_(pa.struct(fields)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns, every], names=[*kept, *names, "spans"])

    five = "license string, coverage double, first_word long, last_word long, aligned long"
    schema = widened(df.select(*kept), f"{five}, spans array<struct<{five}>>")
    return df.select(text, *kept).mapInArrow(task, schema)
