"""License scan by template markup.

A template is wording with optional regions, `<<beginOptional>> ... <<endOptional>>` (a name may follow the word), and
replaceable regions, `<<var;name="...";original="...";match="...">>`. It is compiled to an automaton over words that accepts
a passage if all mandatory wording stands there, word for word. What a replaceable region takes, by its match:

    .+  .*  .{a,b}      any words; a and b count characters of the words, joined by single blanks
    one|two|            these wordings (an empty one too)
    anything else       words that, joined by single blanks, match this regular expression as a whole

Letters are compared in lower case and punctuation isn't compared, on both sides. Unknown markup raises ValueError.

All places where a passage can begin are followed at once: of several ways into a state only the one with the first begin
is kept, so a text is read once, whatever its length and whatever the length of its free regions. Of the passages of a
template the one that begins first counts, up to its last possible end; they don't overlap. Beside that, base phrases are
found wherever their words stand consecutively.

The score grows with the wording that is matched: m / (m + 4) for the largest number m of mandatory words of an accepted
template or of words of a base phrase, 0 if nothing is found.

Edge cases: null text counts as empty: no words, no places, empty labels, score 0. Repeated rows are scanned each by
itself. Input columns named like an output column are replaced. An empty table gives no rows.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cliplane.llm import tokens as tk
from cliplane.llm.common import lists, scan_text
from cliplane.llm.license_texts import BASE, TEMPLATES

_TAG = re.compile(r'<<\s*(\w+)((?:\s*;\s*\w+\s*=\s*"(?:[^"\\]|\\.)*")*)\s*>>')
_FIELD = re.compile(r'(\w+)\s*=\s*"((?:[^"\\]|\\.)*)"')
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_FREE = re.compile(r"\.(\+|\*|\{(\d*),(\d*)\})")
_PLAIN = re.compile(r"[\w\s|-]*")

FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()),
    T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()),
    T.StructField("labels", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField(
        "license_spans",
        T.ArrayType(
            T.StructType(
                [
                    T.StructField("label", T.StringType()),
                    T.StructField("start", T.IntegerType()),
                    T.StructField("end", T.IntegerType()),
                ]
            )
        ),
    ),
]


def words_of(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


class Region:
    """A replaceable region: how many characters, or which regular expression, its words must fulfil."""

    def __init__(self, match: str):
        free = _FREE.fullmatch(match)
        self.pattern = None
        if free:
            self.least = int(free[2] or 0) if free[2] is not None else int(free[1] == "+")
            self.most = int(free[3]) if free[3] else None
        else:
            self.pattern = regex.compile(match, regex.IGNORECASE)

    def fits(self, words: list[str]) -> tuple[bool, bool]:
        """(the region may end here, it may go on)."""
        text = " ".join(words)
        if self.pattern is None:
            return len(text) >= self.least, self.most is None or len(text) < self.most + 1
        found = self.pattern.fullmatch(text, partial=True)
        return bool(found and not found.partial or self.pattern.fullmatch(text)), bool(self.pattern.fullmatch(text + " ", partial=True))


class Automaton:
    """States with word moves, free moves and replaceable regions."""

    def __init__(self, template: str):
        self.word: list[dict[bytes, list[int]]] = [{}]
        self.free: list[list[int]] = [[]]
        self.region: dict[int, tuple[Region, int]] = {}
        self.mandatory = 0
        self.final = self._compile(template)
        first = self.enter(0, 0)
        if any(s in self.region for s, _ in first):
            raise ValueError("a template needs a wording before its first free region")
        self.first = first
        self.starts = frozenset(w for s, _ in first for w in self.word[s])

    def _state(self) -> int:
        self.word.append({})
        self.free.append([])
        return len(self.free) - 1

    def _walk(self, at: int, text: str) -> int:
        for w in words_of(text.encode()):
            to = self._state()
            self.word[at].setdefault(w, []).append(to)
            at = to
        return at

    def _compile(self, template: str) -> int:
        at, opened, place = 0, [], 0
        for tag in _TAG.finditer(template):
            at = self._text(at, template[place : tag.start()], opened)
            place = tag.end()
            fields = {k: re.sub(r"\\(.)", r"\1", v) if k != "match" else v for k, v in _FIELD.findall(tag[2])}
            if tag[1] == "beginOptional":
                fresh = self._state()
                self.free[at].append(fresh)
                opened.append(at)
                at = fresh
            elif tag[1] == "endOptional":
                if not opened:
                    raise ValueError("an optional region ends that was not begun")
                to = self._state()
                self.free[at].append(to)
                self.free[opened.pop()].append(to)
                at = to
            elif tag[1] == "var" and "match" in fields:
                at = self._replaceable(at, fields["match"], not opened)
            else:
                raise ValueError(f"unknown markup: {tag[0]}")
        at = self._text(at, template[place:], opened)
        if opened:
            raise ValueError("an optional region isn't closed")
        return at

    def _text(self, at: int, text: str, opened: list[int]) -> int:
        if "<<" in text or ">>" in text:
            raise ValueError(f"unknown markup: {text.strip()[:80]}")
        self.mandatory += 0 if opened else len(words_of(text.encode()))
        return self._walk(at, text)

    def _replaceable(self, at: int, match: str, counts: bool) -> int:
        end = self._state()
        if _FREE.fullmatch(match) or not _PLAIN.fullmatch(match):
            here = self._state()
            self.free[at].append(here)
            self.region[here] = (Region(match), end)
        else:
            choices = match.split("|")
            self.mandatory += min(len(words_of(c.encode())) for c in choices) if counts else 0
            for choice in choices:
                self.free[self._walk(at, choice)].append(end)
        return end

    def enter(self, state: int, at: int) -> list[tuple[int, int]]:
        """States (with the word at which a region began, else -1) that are reached from one without a word."""
        out, todo, seen = [], [state], {state}
        while todo:
            s = todo.pop()
            out.append((s, at if s in self.region else -1))
            nexts = list(self.free[s])
            if s in self.region and self.region[s][0].fits([])[0]:
                nexts.append(self.region[s][1])
            for t in nexts:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return out

    def passages(self, words: list[bytes], begins: list[int]) -> list[tuple[int, int]]:
        """(first word, end) of the accepted passages that begin at one of the given places."""
        live: dict[tuple[int, int], int] = {}
        longest: dict[int, int] = {}
        loops: dict[tuple[int, int], int] = {}  # characters so far in a region that counts them
        k, i = 0, 0
        while k < len(begins) or live:
            if not live:
                i = begins[k]
            fresh: dict[tuple[int, int], int] = {}
            grown: dict[tuple[int, int], int] = {}
            now = list(live.items())
            if k < len(begins) and begins[k] == i:
                now += [(c, i) for c in self.first]
                k += 1
            if i == len(words):
                break
            w = words[i]

            def reach(state: int, start: int, at: int, fresh=fresh) -> None:
                for c in self.enter(state, at):
                    if fresh.setdefault(c, start) > start:
                        fresh[c] = start

            for (s, since), start in now:
                for t in self.word[s].get(w, ()):
                    reach(t, start, i + 1)
                if since < 0:
                    continue
                region, end = self.region[s]
                if region.pattern is None:
                    size = loops.get((s, since), -1) + 1 + len(w.decode("utf-8", "replace"))
                    if region.most is None:
                        size = min(size, region.least)
                        since_ = since if size < region.least else 0  # past its least length a region without a most is one state
                    else:
                        since_ = since
                    done, on = size >= region.least and (region.most is None or size <= region.most), region.most is None or size < region.most
                    if on:
                        grown[s, since_] = size
                        if fresh.setdefault((s, since_), start) > start:
                            fresh[s, since_] = start
                else:
                    done, on = region.fits([x.decode("utf-8", "replace") for x in words[since : i + 1]])
                    if on and fresh.setdefault((s, since), start) > start:
                        fresh[s, since] = start
                if done:
                    reach(end, start, i + 1)
            i += 1
            live, loops = fresh, grown
            for (s, _), start in live.items():
                if s == self.final:
                    longest[start] = i
        out: list[tuple[int, int]] = []
        for start in sorted(longest):
            if not out or start >= out[-1][1]:
                out.append((start, longest[start]))
        return out

    def longest(self, words: list[bytes], start: int) -> int | None:
        """End of the longest accepted passage that begins there."""
        return next((b for _, b in self.passages(words, [start])), None)


@lru_cache(maxsize=4)
def compiled(templates: tuple[tuple[str, str], ...]) -> list[tuple[str, Automaton]]:
    return [(label, Automaton(t)) for label, t in templates]


def score_of(words: int) -> float:
    return words / (words + 4.0)


class Scanner:
    def __init__(self, templates: dict[str, str] | None = None, base: dict[str, str] | None = None):
        self.automata = compiled(tuple((TEMPLATES if templates is None else templates).items()))
        self.base: dict[bytes, list[tuple[tuple[bytes, ...], str]]] = {}
        for phrase, label in (BASE if base is None else base).items():
            p = tuple(words_of(phrase.encode()))
            self.base.setdefault(p[0], []).append((p, label))
        self.starts: dict[bytes, list[int]] = {}
        for k, (_, a) in enumerate(self.automata):
            for w in a.starts:
                self.starts.setdefault(w, []).append(k)
        #: Every passage or phrase begins with one of these words; other texts only need their words counted.
        heads = set(self.base) | set(self.starts)
        self.heads = frozenset(heads)
        any_of = b"|".join(re.escape(w) for w in sorted(heads))
        self.any = re.compile(rb"(?<![0-9a-z\x80-\xff])(?:" + any_of + rb")(?![0-9a-z\x80-\xff])")

    def scan(self, text: bytes) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str, int]]]:
        """Base places (first word, end, label) and accepted passages (first word, end, label, mandatory words)."""
        low = text.lower()
        if not self.any.search(low):
            return [], []
        words = _WORD.findall(low)
        base: list[tuple[int, int, str]] = []
        begins: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if w in self.heads:
                for p, label in self.base.get(w, ()):
                    if tuple(words[i : i + len(p)]) == p:
                        base.append((i, i + len(p), label))
                for k in self.starts.get(w, ()):
                    begins.setdefault(k, []).append(i)
        found = []
        for k, at in begins.items():
            label, automaton = self.automata[k]
            found += [(a, b, label, automaton.mandatory) for a, b in automaton.passages(words, at)]
        return base, sorted(found)

    def columns(self, text: pa.Array) -> list[pa.Array]:
        raw, off = tk.flat(text)
        _, _, first = tk.spans(raw, off, tk.WORD)
        n_words = np.diff(first)
        n = len(text)
        n_base, score = np.zeros(n, np.int64), np.zeros(n)
        low, high, base_labels, labels = [None] * n, [None] * n, [""] * n, [""] * n
        count, spans = np.zeros(n, np.int64), []
        data = raw.tobytes()
        for d, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
            base, passages = self.scan(data[a:b])
            if not base and not passages:
                continue
            n_base[d] = len(base)
            if base:
                low[d], high[d] = min(x[0] for x in base), max(x[0] for x in base)
            base_labels[d] = ",".join(sorted({x[2] for x in base}))
            labels[d] = ",".join(sorted({x[2] for x in base} | {x[2] for x in passages}))
            score[d] = score_of(max([x[1] - x[0] for x in base] + [x[3] for x in passages]))
            spans += [{"label": x[2], "start": x[0], "end": x[1]} for x in passages]
            count[d] = len(passages)
        value = pa.array(spans, pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        return [
            pa.array(n_words), pa.array(n_base), pa.array(low, pa.int64()), pa.array(high, pa.int64()),
            pa.array(base_labels, pa.string()), pa.array(labels, pa.string()), pa.array(score), lists(value, count),
        ]


def scan(
    docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, templates: dict[str, str] | None = None
) -> DataFrame:
    """docs with FIELDS: places of base phrases, labels, score, and the passages accepted by a template."""

    def make():
        return Scanner(templates).columns

    return scan_text(docs, make, FIELDS, text_col, keep)
