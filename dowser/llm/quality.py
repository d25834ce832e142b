"""Per-document text quality statistics, and an ordered rule list that tells prose from lists, tables and junk.

The statistics are computed a batch of texts at a time over arrays of code points; as SQL patterns they took about 6,700
CPU seconds a GB, which is why they are not. The rules are induced by incremental reduced-error pruning (IREP): a rule is grown
on two thirds of the labelled documents by FOIL's gain, pruned on the last third, and kept if it is right there at least
three times as often as not; what it covers is set aside and the next rule is grown. The learned thresholds become one
CASE expression.

What a running sentence is made of is learned from all texts of the corpus, in any language that it holds: spans that end in a
sentence mark on one side, short lines of texts without any such mark on the other, tell which frequent words belong to
sentences (`Usage.weight`) and which do not follow each other in them (`Usage.pair`); each time that a span stands in the corpus
counts. The labelled documents are built from the same spans, a group of them (`GROUP`) at a time, and every different span is
in one: prose in several layouts; and, as what is not prose, the short lines and stretches cut at random in the layouts of
lists, the words of whole texts shuffled, and text without language (noise.py). The rules are induced on all of them, by counts
of the statistics' cells (`cells`), which are the same wherever they are summed.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dowser.llm.noise import Noise
from dowser.session import stored

#: Labelled documents that are built at least; more are built until every span of the corpus is in one.
LABELLED, SEED = 8000, 5
#: Spans from which documents are built together, and those of a kind among them at least, if the corpus has so many.
GROUP, LEAST = 4000, 200
#: Beyond LABELLED, one document of so many is junk; the classes weigh the same.
JUNK_EVERY = 8
#: Labelled documents whose statistics the driver may hold (42 bytes each); the counts over more are made by the executors.
HERE = 300_000
#: Rules at most; with more documents there are more that are right, and they end long before.
MOST_RULES = 256
#: Sentences of a kind of script from which documents are built at least; the longest sentence, and so the longest short line.
FEWEST, LONGEST = 20, 222
#: Frequent words that the model of usage knows, and the most common words that the caller may give.
FREQUENT, MOST_WORDS = 1200, 100_000
#: Two words avoid each other if they are met together this much more seldom than by chance.
AVOIDED = 0.4


_HAN_LOW, _HAN_HIGH = 0x4E00, 0x9FFF
NAMES = ("word_count", "mean_word_length", "symbol_ratio", "punct_line_share", "common_share", "usage_weight", "avoided_share", "frequent_share", "sentence_mark_share",
         "delimiter_share", "marker_line_share", "digit_share", "mean_line_length", "lone_share", "mixed_share", "space_share", "mean_sentence_length",
         "run_share", "long_line_share", "pause_share", "distinct_share")
CHUNK = 250_000


def _set(chars: str) -> np.ndarray:
    out = np.zeros(0x10000, bool)
    out[[ord(c) for c in chars]] = True
    return out


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """The bits below of every character of the basic plane, and its lower case."""
    chars = [chr(i) if not 0xD800 <= i < 0xE000 else " " for i in range(0x10000)]
    category = [unicodedata.category(c) for c in chars]
    sets = [np.array([k[0] in "LM" for k in category]), np.array([k[0] == "N" for k in category]), np.array([c.isspace() for c in chars]),
            (np.arange(0x10000) >= _HAN_LOW) & (np.arange(0x10000) <= _HAN_HIGH), _set("'’"), _set("-*•–—·"), _set("|;\t,、"), _set(",，、"),
            _set(".!?…"), _set("。！？"), _set("'\"”’»）)"), _set("|;\t,:.!?…\n。！？，、：；"), _set("|;\t\n"), _set("|;\t\n,、 ")]
    return (sum(s.astype(np.uint16) << i for i, s in enumerate(sets)),
            np.array([ord(c.lower()) if len(c.lower()) == 1 and ord(c.lower()) < 0x10000 else i for i, c in enumerate(chars)], np.uint64))


_BITS = [np.uint16(1 << i) for i in range(14)]
_LETTER_BIT, _NUMBER, _BLANK, _HAN_BIT, _APOSTROPHE, _BULLET, _DELIMITER, _PAUSE, _MARK, _MARK_HAN, _CLOSE, _RUN_END, _LINE_END, _HAN_END = _BITS
_CLASS, _LOWER = _classes()
_POWER = 0x9E3779B97F4A7C15
_POWERS = np.array([pow(_POWER, k, 1 << 64) for k in range(32)], np.uint64)


_kept: dict[int, np.ndarray] = {}


def _powers(n: int, base: int) -> np.ndarray:
    """The first n powers at least; those for as many characters as are usual are kept."""
    got = _kept.get(base, _POWERS[:0])
    if len(got) < n:
        got = np.multiply.accumulate(np.append(np.uint64(1), np.full(max(n, CHUNK), base, np.uint64)))
        if n <= 2 * CHUNK:
            _kept[base] = got
    return got


def _hash(word: str) -> int:
    """The hash by which words are looked up; words longer than the powers don't occur in the lists."""
    return sum(ord(c) * int(_POWERS[i]) for i, c in enumerate(word)) % (1 << 64)


class Lexicon:
    """Word lists as sorted hashes, and for the script without spaces as packed characters by length."""

    def __init__(self, words: Sequence[str]):
        spaced = [w.lower() for w in words if not re.search("[一-鿿]", w) and len(w) <= len(_POWERS)]
        self.hashes = np.unique(np.array([_hash(w) for w in spaced] or [0], np.uint64))
        self.han = {n: np.unique(np.array(k, np.uint64)) for n in (1, 2, 3, 4)
                    if (k := [sum(ord(c) << (16 * i) for i, c in enumerate(w)) for w in words if len(w) == n and re.fullmatch("[一-鿿]+", w)])}

    def has(self, hashes: np.ndarray) -> np.ndarray:
        return self.hashes[np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)] == hashes

    def in_han(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Places among `at` where a word of the list begins."""
        out = np.zeros(len(at), bool)
        wide = np.append(c, np.zeros(4, np.uint64))
        for n, keys in self.han.items():
            packed = sum(wide[at + i] << np.uint64(16 * i) for i in range(n))
            out |= keys[np.minimum(np.searchsorted(keys, packed), len(keys) - 1)] == packed
        return out


@dataclass
class Usage:
    """How the corpus' frequent words are used: their hashes, ascending; for each, whether it is found in sentences
    rather than in short lines; for each two, whether they avoid each other in sentences.
    A character of a script without spaces is a word."""

    hashes: np.ndarray
    weight: np.ndarray
    pair: np.ndarray

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """The words' places among the frequent ones; -1: not among them."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    @staticmethod
    def of(counts: np.ndarray, totals: Sequence[int], seen: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> Usage:
        """counts: (hash, times in sentences, times in lines) of the frequent words, by hash; totals: of all words; seen: from the hashes,
        the (place of a word * words + place of the next) and how often it is there."""
        hashes = counts[0]
        n = len(hashes)
        rate = [(c.astype(float) + 1) / (total + 50) for c, total in zip(counts[1:], totals, strict=True)]
        key, times = seen(hashes)
        met = np.zeros(n * n)
        met[key] = times
        met = met.reshape(n, n)
        chance = met.sum(1, keepdims=True) * met.sum(0, keepdims=True) / max(1.0, met.sum())
        return Usage(hashes, np.clip(np.log(rate[0] / rate[1]), -2, 2), (met + 2 < AVOIDED * chance).astype(np.float32))

    @staticmethod
    def learn(sentences: Sequence[str], lines: Sequence[str], most: int = FREQUENT) -> Usage:
        spans = [*sentences, *lines]
        n, line = np.ones(len(spans), np.int64), np.arange(len(spans)) >= len(sentences)
        token, *times = _word_counts(spans, n, line)
        top = np.sort(np.argsort(-(times[0] + times[1]), kind="stable")[:most])
        return Usage.of((token[top], times[0][top], times[1][top]), [t.sum() for t in times], lambda hashes: _pair_counts(sentences, n[: len(sentences)], hashes))


def _span_words(spans: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, whether it follows the one before directly, place of the span) of the words of spans."""
    token, follows, start = _words(*_points("\n\n".join(spans) + "\n"))[:3]
    length = np.array([len(s) + 2 for s in spans], np.int64)
    return token, follows, np.repeat(np.arange(len(spans)), length)[start]


def _added(key: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """The different keys in order, and the sums of their counts."""
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    return key[first], *(np.add.reduceat(c[order], first) if len(first) else c for c in counts)


def _word_counts(spans: Sequence[str], n: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, times in sentences, times in lines) of the words of spans that are there n times each, by hash."""
    token, _, of = _span_words(spans)
    return _added(token, *(np.where(line == k, n, 0)[of] for k in (False, True)))


def _pair_counts(spans: Sequence[str], n: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of a frequent word * words + place of the next, times)."""
    token, follows, of = _span_words(spans)
    at = Usage(hashes, hashes, hashes).places(token)
    ok = np.flatnonzero((at[:-1] >= 0) & (at[1:] >= 0) & follows[1:])
    return _added(at[ok] * len(hashes) + at[ok + 1], n[of[ok]])


def _points(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points, and their classes. What lies beyond the basic plane counts as a symbol."""
    c = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    c = np.where(c < 0x10000, c, 0x25A0).astype(np.int64)
    return c, _CLASS[c]


def _words(c: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, follows, begin) of the words in code points of classes k, characters of a script without spaces among them; and
    (hash, begin, end) of those with spaces only."""
    blank, han = (k & _BLANK) > 0, (k & _HAN_BIT) > 0
    spaced = (k & (_LETTER_BIT | _HAN_BIT)) == _LETTER_BIT
    wordy = spaced.copy()
    wordy[1:] |= ((k[1:] & _APOSTROPHE) > 0) & spaced[:-1]
    edge = np.flatnonzero(np.diff(wordy, prepend=False, append=False))
    begin, end = edge[::2], edge[1::2]
    if len(begin):
        powers, back = (_powers(len(c), p) for p in (_POWER, pow(_POWER, -1, 1 << 64)))
        hashes = np.add.reduceat(np.where(wordy, _LOWER[c] * powers[: len(c)], np.uint64(0)), begin) * back[begin]
        hashes[end - begin > len(_POWERS)] = 0
    else:
        hashes = np.zeros(0, np.uint64)
    at_han = np.flatnonzero(han)
    start = np.concatenate([begin, at_han])
    order = np.argsort(start, kind="stable")
    start = start[order]
    stop = np.concatenate([end, at_han + 1])[order]
    token = np.concatenate([hashes, c[at_han].astype(np.uint64)])[order]
    gap = start[1:] - stop[:-1]
    follows = np.append(False, (gap == 0) | ((gap == 1) & blank[np.minimum(stop[:-1], len(c) - 1)]))
    return token, follows, start, hashes, begin, end


def statistics(texts: Sequence[str], common: Lexicon, usage: Usage) -> np.ndarray:
    """A row of NAMES for each text. Two characters of a script without spaces count as a word; lines are those that
    are not blank. All are 0 for a blank text."""
    out = np.zeros((len(texts), len(NAMES)))
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size + len(texts[upto]) < CHUNK):
            size += len(texts[upto])
            upto += 1
        out[at:upto] = _statistics([re.sub("\r\n?", "\n", t) if "\r" in t else t for t in texts[at:upto]], common, usage)
        at = upto
    return out


def _statistics(texts: Sequence[str], common: Lexicon, usage: Usage) -> np.ndarray:
    count = len(texts)
    c, k = _points("".join(t + "\n" for t in texts))
    length = np.array([len(t) + 1 for t in texts])
    owner = np.repeat(np.arange(count), length)
    n = np.maximum(length - 1, 1).astype(float)
    text_begin = np.cumsum(length) - length
    total = lambda where: np.add.reduceat(where, text_begin, dtype=np.int32).astype(float)
    is_ = lambda bits: (k & bits) > 0
    before = lambda where, first: np.append(first, where[:-1])
    after_it = lambda where, last: np.append(where[1:], last)
    letter, number, blank, han = map(is_, (_LETTER_BIT, _NUMBER, _BLANK, _HAN_BIT))
    at_han = np.flatnonzero(han)

    # words: runs of letters with apostrophes inside, runs of digits
    token, follows, start, _, begin, end = _words(c, k)
    every, which = np.unique(token, return_inverse=True)
    whose = owner[start]
    numbers = number & ~before(number, False)
    han_count = total(han)
    words = np.bincount(owner[begin], minlength=count) + total(numbers) + np.floor(han_count / 2)
    some = np.maximum(words, 1)
    common_words = np.bincount(whose[common.has(every)[which] & ((k[start] & _HAN_BIT) == 0)], minlength=count) + (np.bincount(owner[at_han[common.in_han(_LOWER[c], at_han)]], minlength=count) if len(at_han) else 0)

    known = usage.places(every)[which]
    tokens = np.maximum(np.bincount(whose, minlength=count), 1)
    here = np.flatnonzero(known >= 0)
    weight = np.bincount(whose[here], usage.weight[known[here]], count) / tokens
    both = np.flatnonzero(follows[1:] & (known[1:] >= 0) & (known[:-1] >= 0) & (whose[1:] == whose[:-1])) if len(token) > 1 else np.zeros(0, int)
    pairs = np.bincount(whose[both], usage.pair[known[both], known[both + 1]], count) / np.maximum(np.bincount(whose[both], minlength=count), 3)
    of_each = np.sort(whose * len(every) + which)
    of_each = of_each[np.append(True, of_each[1:] != of_each[:-1])[: len(of_each)]]
    distinct = np.bincount(of_each // max(1, len(every)), minlength=count) / tokens

    # lines
    newline = c == 10
    stops = np.flatnonzero(newline)
    starts = np.concatenate([[0], stops[:-1] + 1])
    solid = np.flatnonzero(~blank)
    first_i = np.searchsorted(solid, starts)
    last_i = np.searchsorted(solid, stops) - 1
    real = first_i <= last_i
    first, last = solid[first_i[real]], solid[last_i[real]]
    line_owner = owner[first]
    lines = np.maximum(np.bincount(line_owner, minlength=count), 1).astype(float)
    any_mark = is_(_MARK | _MARK_HAN)
    ends_well = any_mark[last] | (((k[last] & _CLOSE) > 0) & any_mark[last - 1] & (last > 0))
    digits = [number[np.minimum(first + i, len(c) - 1)] for i in range(3)]
    run = np.where(digits[0], 1 + (digits[1] & True) * (1 + digits[2]), 0)
    after = np.minimum(first + run, len(c) - 1)
    at_succ = lambda i: np.where(i + 1 < len(c), c[np.minimum(i + 1, len(c) - 1)], 10)
    marked = (((k[first] & _BULLET) > 0) & np.isin(at_succ(first), (32, 9))) | ((run > 0) & np.isin(c[after], (41, 46)) & np.isin(at_succ(after), (32, 9)))

    mark, beside = is_(_MARK), after_it(k, _CLASS[10])
    marks = (mark & ((beside & _MARK) == 0) & ((beside & (_BLANK | _CLOSE)) > 0) & ~before(number, False)) | is_(_MARK_HAN)
    mark_count = total(marks)
    space = c == 32
    gaps = space & after_it(space, False) & ~before(space, False)
    solid_here = ~(letter | number | blank)
    apart = solid_here & before(blank, True) & after_it(blank, True)  # a symbol between blanks
    delimiters = is_(_DELIMITER) | gaps | ((c == 58) & after_it(newline, True)) | apart
    halt = newline | apart
    sums = np.append(0, np.cumsum(han)) if len(at_han) else None

    def in_runs(stop: np.ndarray, least: int, han_stop: np.ndarray, han_least: int) -> np.ndarray:
        """The share of characters in runs without a stop, that are long or hold many characters of a script without
        spaces between its own stops."""
        inside = np.zeros(len(c), bool)
        for stop_here, enough in ((stop | halt, None), (han_stop, han_least)):
            if enough is not None:
                if sums is None:
                    break
                stop_here = stop_here | halt
            cut = np.append(np.append(-1, np.flatnonzero(stop_here)), len(c))
            size = np.diff(cut) - 1
            good = size >= least if enough is None else sums[cut[1:]] - sums[cut[:-1] + 1] >= enough
            inside |= np.repeat(good, size + 1)[: len(c)] & ~stop_here
        return total(inside) / n

    out = np.stack([
        words, np.where(words > 0, total(letter) / some, 0), total(solid_here) / n, np.bincount(line_owner, ends_well, count) / lines,
        common_words / some, weight, pairs, np.bincount(whose[here], minlength=count) / tokens, mark_count / some, total(delimiters) / some,
        np.bincount(line_owner, marked, count) / lines, total(number) / n, n / lines, np.bincount(owner[begin[end - begin == 1]], minlength=count) / some,
        total((letter & after_it(number, False)) | (number & after_it(letter, False))) / some, total(space) / n, n / np.maximum(mark_count, 1),
        in_runs(is_(_RUN_END), 40, is_(_RUN_END) | space, 9), in_runs(is_(_LINE_END), 56, is_(_HAN_END), 14), total(is_(_PAUSE)) / some, distinct], axis=1)
    out[total(~blank) == 0] = 0
    return out


#: Cells of a statistic: 256 for each power of two, from 2^-20 on; what is nearer to zero is cell 0.
_FIRST, _WIDTH = (1023 - 20) << 8, 1 << 15


def cells(x: np.ndarray) -> np.ndarray:
    """The cells of values; they rise with the values."""
    x = np.asarray(x, float)
    return (np.sign(x) * np.clip((np.abs(x).view(np.int64) >> 44) - _FIRST + 1, 0, _WIDTH - 1)).astype(np.int16)


def _bound(cell: int, upper: bool) -> float:
    """The greatest value of a cell, or the least."""
    edge = lambda k: float(np.int64((k - 1 + _FIRST) << 44).view(np.float64))
    if cell < 0:
        return -_bound(-cell, not upper)
    if cell == 0:
        return float(np.nextafter(edge(1), 0)) * (1 if upper else -1)
    return float(np.nextafter(edge(cell + 1), 0)) if upper else edge(cell)


@dataclass
class Rule:
    """A conjunction of (statistic, at most or at least, threshold). A threshold is the last or the first value of a cell."""

    tests: list[tuple[int, bool, float]] = field(default_factory=list)

    def covers(self, x: np.ndarray) -> np.ndarray:
        """x: values, or their cells."""
        return self.depth(x) == len(self.tests)

    def depth(self, x: np.ndarray) -> np.ndarray:
        """How many of the tests hold, up to the first that doesn't."""
        out, hit = np.zeros(len(x), int), np.ones(len(x), bool)
        for f, below, at in self.tests:
            at = cells(at) if x.dtype == np.int16 else at
            hit &= x[:, f] <= at if below else x[:, f] >= at
            out += hit
        return out


#: Labelled documents: (number of the block, cells, whether junk).
Block = tuple[int, np.ndarray, np.ndarray]
#: (whether to find a split, rules so far, the rule that grows, seed, turn) -> (key, junk, prose) over all blocks, by key.
Tally = Callable[[bool, Sequence[Rule], Rule, int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]


class Held:
    """Labelled documents in memory, a row for each statistic. What the rules cover is left out for good."""

    def __init__(self, blocks: Sequence[Block]):
        self.blocks = [(number, len(y)) for number, _, y in blocks]
        self.x, self.y = np.concatenate([x.T for _, x, _ in blocks], axis=1), np.concatenate([y for _, _, y in blocks])
        self.at, self.rules, self.turn, self.split = np.arange(len(self.y)), 0, None, self.y

    def tally(self, growing: bool, rules: Sequence[Rule], rule: Rule, seed: int, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """growing: by (statistic, cell), of the documents to grow on that `rule` covers so far; else by (whether to grow on,
        tests of `rule` that hold), of all that `rules` don't cover."""
        if self.turn != turn:
            self.split = np.concatenate([np.random.default_rng((seed, number, turn)).random(n) < 2 / 3 for number, n in self.blocks])
            self.turn = turn
        for known in rules[self.rules :]:
            left = ~known.covers(self.x.T)
            self.x, self.y, self.at = self.x[:, left], self.y[left], self.at[left]
        self.rules = len(rules)
        grow = self.split[self.at]
        if not growing:
            return _tallied(grow * 100 + rule.depth(self.x.T), self.y)
        on = grow & rule.covers(self.x.T)
        x, y = self.x[:, on], self.y[on]
        got = [_tallied(v.astype(np.int64), y, f * 2 * _WIDTH + _WIDTH) for f, v in enumerate(x)]
        return tuple(np.concatenate(c) for c in zip(*got, strict=True))


def _tallied(key: np.ndarray, y: np.ndarray, more: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key + more, junk, prose)."""
    least = key.min() if len(key) else 0
    n = np.bincount(key - least)
    junk = np.bincount(key[y] - least, minlength=len(n))
    some = np.flatnonzero(n)
    return some + (least + more), junk[some], n[some] - junk[some]


def _grow(tally: Tally, rules: Sequence[Rule], weight: float, seed: int, turn: int) -> Rule:
    rule = Rule()
    while len(rule.tests) < 6:
        key, junk, prose = tally(True, rules, rule, seed, turn)
        stat, cell = key // (2 * _WIDTH), key % (2 * _WIDTH) - _WIDTH
        best: tuple[float, tuple[int, bool, float] | None] = (1e-9, None)
        for f in np.unique(stat):
            here = stat == f
            v, pos, neg = cell[here], np.cumsum(junk[here] * weight), np.cumsum(prose[here])
            p, n = pos[-1], neg[-1]
            if not p or not n:
                return rule
            base = np.log2(p / (p + n))
            for below in (True, False):
                hit, miss = (pos[:-1], neg[:-1]) if below else (p - pos[:-1], n - neg[:-1])
                gain = np.where(hit > 1e-6, hit * (np.log2(np.maximum(hit, 1e-9) / np.maximum(hit + miss, 1e-9)) - base), -1)
                k = int(np.argmax(gain)) if len(gain) else 0
                if len(gain) and gain[k] > best[0]:
                    middle = min(int(cells((_bound(int(v[k]), True) + _bound(int(v[k + 1]), False)) / 2)), int(v[k + 1]) - 1)  # a threshold lies between two values
                    best = (gain[k], (int(f), below, _bound(middle, True) if below else _bound(middle + 1, False)))
        if best[1] is None:
            break
        rule.tests.append(best[1])
    return rule


def _induce(tally: Tally, seed: int = SEED, most: int = MOST_RULES, weight: float = 1.0) -> list[Rule]:
    """Rules for what is junk, in order, of blocks over which `tally` counts; a document that is junk weighs `weight`."""
    rules, misses, turn = [], 0, 0
    while len(rules) < most:
        turn += 1
        rule = _grow(tally, rules, weight, seed, turn)
        key, *n = tally(False, rules, rule, seed, turn)
        junk, prose = n[0] * weight, n[1]
        if not junk.any():
            break
        at_least = lambda k: [float(c[(key < 100) & (key >= k)].sum()) for c in (junk, prose)]
        worth = [(p - q) / (p + q) if p + q else -1.0 for p, q in map(at_least, range(len(rule.tests) + 1))]
        best = len(rule.tests)  # the last tests go that do not pay on other documents
        for k in range(len(rule.tests) - 1, 0, -1):
            if worth[k] >= worth[best]:
                best = k
        p, q = at_least(best)
        if not rule.tests or p <= 3 * q:
            misses += 1  # another split may do better
            if misses > 4:
                break
            continue
        rules.append(Rule(rule.tests[:best]))
        if not junk[key % 100 < best].any():
            break
    return rules


def induce(x: np.ndarray, y: np.ndarray, seed: int = SEED, most: int = MOST_RULES) -> list[Rule]:
    """Rules for the documents with y true, in order."""
    return _induce(Held([(0, cells(x), y)]).tally, seed, most)


def to_case(rules: Sequence[Rule], names: Sequence[str]) -> str:
    """The rule list as a CASE expression: 'junk' or 'prose'."""
    if not rules:
        return "'prose'"
    whens = [" AND ".join(f"{names[f]} {'<=' if below else '>='} {at!r}D" for f, below, at in r.tests) for r in rules]
    return "CASE " + " ".join(f"WHEN {w} THEN 'junk'" for w in whens) + " ELSE 'prose' END"


# --- labelled documents -------------------------------------------------------------------------------------------

_SENTENCE = re.compile(r"[^\W\d_][^.!?…\n|;\t。！？]{30,220}+[.!?…]|[一-鿿][^。！？\n|;\t ]{9,60}+[。！？]")
_HAN = re.compile("[一-鿿]")
_STRETCH, _LETTER = re.compile(r"[^.!?…\n|;\t。！？]{31,}+(?=[.!?…])"), re.compile(r"[^\W\d_]")
_ENDED = re.compile(r"""[.!?…。！？]['"”’»）)]*[ \t]*$""", re.M)


def _sentences(t: str, han: bool) -> Iterator[str]:
    """The matches of _SENTENCE."""
    if han:
        yield from (m.group() for m in _SENTENCE.finditer(t))
        return
    for m in _STRETCH.finditer(t):  # of the script with spaces there is one at most in a stretch without a stop
        if first := _LETTER.search(t, max(m.start(), m.end() - 221), m.end() - 30):
            yield t[first.start() : m.end() + 1]


def spans(texts: Sequence[str]) -> tuple[dict[str, list[str]], dict[str, list[str]]]:
    """(sentences, short lines) of texts, each by kind: `spaced`, and `han` for scripts without spaces. Short lines
    come from texts in which hardly a line ends in a sentence mark."""
    whole: dict[str, list[str]] = {"spaced": [], "han": []}
    short: dict[str, list[str]] = {"spaced": [], "han": []}
    for t in texts:
        t = re.sub("\r\n?", "\n", t)
        lines = [x.strip() for x in t.split("\n") if x.strip()]
        if len(lines) > 3 and len(_ENDED.findall(t)) <= 0.1 * len(lines):
            for x in lines:
                x = re.sub(r"^(?:[-*•–—·]|\d+[.)])\s+", "", x)
                if _HAN.search(x):
                    if len(x) <= 12:
                        short["han"].append(x)
                elif len(x) <= LONGEST and 1 <= len(x.split()) <= 7 and sum(ch.isalpha() or ch == " " for ch in x) > 0.85 * len(x):
                    short["spaced"].append(x)
            continue
        some_han = bool(_HAN.search(t))
        for s in _sentences(("" if some_han else " ").join(lines), some_han):
            han = some_han and len(_HAN.findall(s)) > 5
            if han or len(s.split()) >= 7:
                whole["han" if han else "spaced"].append(s)
    return whole, short


class Deck:
    """Items that are drawn in any order, each once before any comes again."""

    def __init__(self, rng: random.Random, items: Sequence[str]):
        self.rng, self.items, self.at, self.new = rng, list(items), 0, len(items)
        rng.shuffle(self.items)

    def draw(self) -> str:
        if self.at == len(self.items):
            self.rng.shuffle(self.items)
            self.at = 0
        self.at, self.new = self.at + 1, max(0, self.new - 1)
        return self.items[self.at - 1]


class Builder:
    """Labelled documents, made of sentences and short lines, each by kind and each once."""

    def __init__(self, whole: dict[str, list[str]], short: dict[str, list[str]], seed: Sequence[int] | int = SEED):
        self.rng = random.Random(str(seed))
        self.pool = {k: sorted(v) for k, v in whole.items() if v}
        if not self.pool:
            self.pool = {"spaced": ["It is not clear whether the small report shows all of the measured values or only the last table."]}
        self.sentences = {k: Deck(self.rng, v) for k, v in self.pool.items()}
        self.short = {k: Deck(self.rng, sorted(v)) for k, v in short.items() if v and k in self.pool}
        words = {k: sorted({w.strip(".,;:!?\"'()") for w in (set(" ".join(v).split()) if k == "spaced" else {s[i : i + 2] for s in v for i in range(0, len(s) - 3, 5)})} - {""}) for k, v in self.pool.items()}
        self.kind, self.only = next(iter(self.pool)), list(self.pool)
        self.noise = {k: Noise(self.rng, w, self.phrase) for k, w in words.items()}

    def documents(self, least: int) -> Iterator[tuple[bool, str]]:
        """(whether junk, text), as many of each class, and beyond `least` more prose, until every sentence and short line is in one."""
        i = 0
        while True:
            if i >= least:
                new = [[k for k in self.pool if k in decks and decks[k].new] for decks in (self.sentences, self.short)]
                if not any(new):
                    return
                self.only = new[0] or new[1]
            label = i % 2 == 1 if i < least else i % JUNK_EVERY == 1 or not new[0]
            yield label, self.document(label)
            i += 1

    def start(self) -> None:
        self.kind = "han" if "han" in self.only and (self.rng.random() < 0.22 or "spaced" not in self.only) else "spaced"

    def sentence(self) -> str:
        return self.sentences[self.kind].draw()

    def phrase(self) -> str:
        """A short line of the corpus, or a stretch of a sentence."""
        r = self.rng
        lines = self.short.get(self.kind)
        if lines and r.random() < 0.7:
            return lines.draw()
        s = r.choice(self.pool[self.kind])
        if self.kind == "han":
            part = max(re.split("[，、。？！：]", s), key=len)
            i = r.randint(0, max(0, len(part) - 6))
            return part[i : i + r.randint(2, 6)] or s[:4]
        words = r.choice([p for p in re.split("[,:;.!?–—()]", s) if p.strip()] or [s]).split()
        i = r.randint(0, max(0, len(words) - 3))
        return " ".join(words[i : i + r.randint(1, 4)])

    def name(self) -> str:
        n = self.noise[self.kind]
        return self.rng.choice((n.word, n.letters, n.code))()

    def prose(self, size: int) -> str:
        r, out = self.rng, []
        while sum(map(len, out)) < size:
            out.append(self.sentence())
        if r.random() < 0.3:  # other prose than the corpus' has words in another order now and then
            out = [self.swapped(s) for s in out]
        gap = "" if self.kind == "han" else " "
        bare = [s.rstrip(".!?…。！？") for s in out]
        how = r.random()
        if how < 0.35:
            text = "".join(s + (gap if r.random() < 0.8 else r.choice(("\n", "\n\n"))) for s in out).strip()
        elif how < 0.5:
            text = self.wrap(gap.join(out), r.randint(34, 90))
        elif how < 0.58:  # a dialogue
            names = [self.noise[self.kind].letters().title(), self.noise[self.kind].letters().title()]
            text = "\n".join(f"{names[i % 2]}: {s}" for i, s in enumerate(out))
        elif how < 0.64:  # questions and answers
            a, b = r.sample("ABCFNQRSTV", 2)
            text = "\n".join(f"{(a, b)[i % 2]}: {s}" for i, s in enumerate(out))
        elif how < 0.72:
            text = "\n".join(bare)
        elif how < 0.78:
            text = gap.join(out).lower()
        elif how < 0.82:
            text = "  ".join(gap.join(out).split(" ")) if gap else gap.join(out)
        elif how < 0.86:
            text = "\n".join(bare).lower()
        elif how < 0.93:
            text = "\n".join(out)
        else:
            text = gap.join(out).replace(".", "…")
        if r.random() < 0.15:
            text = self.phrase() + "\n" + text
        return text

    def swapped(self, sentence: str) -> str:
        """A sentence in which each two neighbours (words, or characters of a script without spaces) may have changed places."""
        r = self.rng
        words = list(sentence) if self.kind == "han" else sentence.split(" ")
        for i in range(len(words) - 2):
            if r.random() < (0.05 if self.kind == "han" else 0.12):
                words[i], words[i + 1] = words[i + 1], words[i]
        return ("" if self.kind == "han" else " ").join(words)

    def wrap(self, text: str, width: int) -> str:
        if self.kind == "han":
            return "\n".join(text[i : i + width // 2] for i in range(0, len(text), width // 2))
        lines, line = [], ""
        for w in text.split(" "):
            if len(line) + len(w) > width:
                lines.append(line)
                line = w
            else:
                line = f"{line} {w}" if line else w
        return "\n".join([*lines, line])

    def heap(self, size: int) -> str:
        """The words of several sentences in any order, as they stand or bare."""
        r, words = self.rng, []
        while sum(map(len, words)) < size:
            s = self.sentence()
            units = [s[i : i + k] for k in (r.randint(1, 6),) for i in range(0, len(s), k)] if self.kind == "han" else s.split()
            words += [r.choice((self.phrase(), *units)) for _ in units] if r.random() < 0.4 else units
        if r.random() < 0.6:
            words = [w.strip(".,;:!?…。！？，、") for w in words]
        if r.random() < 0.4:
            words = [w.lower() for w in words]
        r.shuffle(words)
        return (r.choice(("", " ")) if self.kind == "han" else " ").join(w for w in words if w)

    def listed(self, size: int) -> str:
        """Phrases in the layouts of lists and menus."""
        r, n = self.rng, max(4, size // (9 if self.kind == "han" else 24))
        end = r.choice(("", "", "", ".", ",", ";", ":"))
        items = [self.phrase() + end for _ in range(n)]
        mark = r.choice(("", "", "- ", "* ", "• ", "– ", "· ", "1. ", "1) ", "1 "))
        if r.random() < 0.35:
            return r.choice((", ", "; ", " | ", "  ", " · ", "\t", " > ", " / ", "、" if self.kind == "han" else ", ")).join(items)
        if r.random() < 0.2:
            items = [f"{x}{r.choice((' ', ': ', ' - ', chr(9)))}{r.choice((self.noise[self.kind].number, self.noise[self.kind].code, self.phrase))()}" for x in items]
        return "\n".join((mark.replace("1", str(i + 1)) if mark[:1] == "1" else mark) + x for i, x in enumerate(items))

    def table(self, size: int) -> str:
        """Rows of phrases, names and numbers."""
        r, noise, out = self.rng, self.noise[self.kind], []
        columns = [r.choice((self.phrase, self.phrase, noise.number, self.name, noise.time)) for _ in range(r.randint(2, 5))]
        sep = r.choice(("\t", "\t", ";", ",", " | ", "  "))
        while sum(map(len, out)) < size:
            out.append(sep.join(make() for make in columns))
        return "\n".join(out)

    def junk(self, size: int) -> str:
        k = self.rng.random()
        return self.listed(size) if k < 0.4 else self.table(size) if k < 0.5 else self.heap(size) if k < 0.68 else self.noise[self.kind].any(size, self.name)

    def document(self, label: bool) -> str:
        """label: junk. Some documents are mixed, with a clear majority."""
        r = self.rng
        self.start()
        size = int(60 * 2 ** (r.random() * 5))
        text = self.junk(size) if label else self.prose(size)
        if r.random() < 0.35 and size > 200:
            other = self.prose(int(len(text) * r.uniform(0.03, 0.3))) if label else self.junk(int(len(text) * r.uniform(0.03, 0.25)))
            if len(other) < 0.4 * len(text):
                text = r.choice((f"{other}\n{text}", f"{text}\n{other}"))
        return text


def labelled(texts: Sequence[str], count: int = LABELLED, seed: int = SEED) -> list[tuple[bool, str]]:
    whole, short = spans(texts)
    scripts = [k for k, v in whole.items() if len(v) >= FEWEST] or ["spaced"]
    return list(Builder(*({k: list(set(by[k])) for k in scripts} for by in (whole, short)), (seed, 0)).documents(count))


@dataclass
class Model:
    common: Lexicon
    usage: Usage
    rules: list[Rule]


def _block(number: int, rows: Sequence[tuple[bool, str]], common: Lexicon, usage: Usage) -> Block:
    return number, cells(statistics([t for _, t in rows], common, usage)), np.array([y for y, _ in rows], bool)


def _weight(junk: int, prose: int) -> float:
    return prose / junk if junk and prose else 1.0


def learn(texts: Sequence[str], common: Lexicon, count: int = LABELLED, seed: int = SEED) -> Model:
    whole, short = spans(texts)
    usage = Usage.learn([s for v in whole.values() for s in v], [s for v in short.values() for s in v])
    block = _block(0, labelled(texts, count, seed), common, usage)
    return Model(common, usage, _induce(Held([block]).tally, seed, weight=_weight(block[2].sum(), (~block[2]).sum())))


#: Kinds of spans by number: a sentence or a short line, of which kind of script.
_KINDS = [(False, "spaced"), (True, "spaced"), (False, "han"), (True, "han")]


def _mapped(df: DataFrame, schema: str, make: Callable[[pa.RecordBatch], Iterable[Sequence]]) -> DataFrame:
    """make: columns of rows from a batch."""
    target = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in make(batch):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=target)

    return df.mapInArrow(run, schema)


def corpus_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """(kind, span, n): every different sentence and short line of all rows, and how often it is there."""

    def make(batch: pa.RecordBatch) -> Iterator[Sequence]:
        for at in range(0, batch.num_rows, 2000):
            found = spans([t for t in batch.column(0).slice(at, 2000).to_pylist() if t])
            n = Counter((k, s) for k, (line, kind) in enumerate(_KINDS) for s in found[line][kind])
            if n:
                yield np.array([k for k, _ in n], np.int32), pa.array([s for _, s in n], pa.string()), np.array(list(n.values()), np.int64)

    return _mapped(df.select(text), "kind int, span string, n bigint", make).groupBy("kind", "span").agg(F.sum("n").alias("n"))


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """(spans, how often, whether short lines), a few at a time, which the arrays of their characters are small for."""
    for at in range(0, max(1, batch.num_rows), 500):
        part = batch.slice(at, 500)
        yield part.column(1).to_pylist(), part.column(2).to_numpy(), part.column(0).to_numpy() % 2 == 1


_SIGN = np.uint64(1 << 63)


def corpus_usage(found: DataFrame, most: int = FREQUENT) -> Usage:
    """Usage over all spans, as Usage.learn has it of those in memory. The driver gets the frequent words and their pairs only."""

    def words(batch: pa.RecordBatch) -> Iterator[Sequence]:
        token, *n = _added(*(np.concatenate(c) for c in zip(*(_word_counts(*x) for x in _pieces(batch)), strict=True)))
        yield pa.array((token ^ _SIGN).view(np.int64)), *n  # signed as Spark's, in the same order
        yield pa.nulls(1, pa.int64()), *(c.sum(keepdims=True) for c in n)

    counts = _mapped(found, "hash bigint, whole bigint, line bigint", words).groupBy("hash").agg(F.sum("whole").alias("whole"), F.sum("line").alias("line"))
    got = counts.orderBy(F.col("hash").isNotNull(), F.desc(F.col("whole") + F.col("line")), "hash").limit(most + 1).toArrow()
    totals = [got.column(i)[0].as_py() if got.num_rows else 0 for i in (1, 2)]
    top = got.slice(1).sort_by("hash")
    hashes = top.column(0).to_numpy().astype(np.int64).view(np.uint64) ^ _SIGN

    def seen(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def pairs(batch: pa.RecordBatch) -> Iterator[Sequence]:
            yield _added(*(np.concatenate(c) for c in zip(*(_pair_counts(*x[:2], hashes) for x in _pieces(batch)), strict=True)))

        met = _mapped(found.where("kind in (0, 2)"), "pair bigint, n bigint", pairs).groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
        return met.column(0).to_numpy(), met.column(1).to_numpy()

    return Usage.of((hashes, *(top.column(i).to_numpy() for i in (1, 2))), totals, seen)


def corpus_blocks(found: DataFrame, common: Lexicon, usage: Usage, count: int = LABELLED, seed: int = SEED, size: int = GROUP) -> DataFrame:
    """(number, junk, prose, x, y): blocks of labelled documents from groups of about `size` different spans. Every span is in a group,
    save those of a kind of script with hardly a sentence; where a kind has few, they are in several."""
    kinds = {r.kind: r for r in found.groupBy("kind").agg(F.count(F.lit(1)).alias("spans"), F.sum("n").alias("n")).collect()}
    scripts = [k for k in (0, 2) if k in kinds and kinds[k].n >= FEWEST] or [0]
    usable = [k for k in sorted(kinds) if k - k % 2 in scripts]
    groups = max(1, -(-sum(kinds[k].spans for k in usable) // size))
    copies = {k: min(groups, max(1, -(-groups * LEAST // kinds[k].spans))) for k in usable}
    shared = found.sparkSession.sparkContext.broadcast((common, usage))

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        number = key[0].as_py()
        by: tuple[dict, dict] = ({}, {})
        for kind, span in zip(table.column("kind").to_pylist(), table.column("span").to_pylist(), strict=True):
            line, script = _KINDS[kind]
            if span is not None:
                by[line].setdefault(script, []).append(span)
        _, x, y = _block(number, list(Builder(*by, (seed, number)).documents(-(-count // groups))), *shared.value)
        return pa.table({"number": pa.array([number], pa.int64()), "junk": pa.array([int(y.sum())], pa.int64()), "prose": pa.array([int((~y).sum())], pa.int64()), "x": [x.tobytes()], "y": [y.tobytes()]})

    spread = F.lit(1)
    for k, n in copies.items():
        spread = F.when(F.col("kind") == k, n).otherwise(spread)
    first = F.pmod(F.xxhash64("span"), F.lit(groups))
    dealt = found.where(F.col("kind").isin(usable)).select("kind", "span", F.explode(F.transform(F.sequence(F.lit(0), spread - 1), lambda i: F.pmod(first + i, F.lit(groups)))).alias("number"))
    if not usable:  # documents without anything of the corpus
        dealt = found.sparkSession.range(1).selectExpr("0 AS kind", "cast(null AS string) AS span", "0L AS number")
    tasks = min(groups, max(found.sparkSession.sparkContext.defaultParallelism, -(-groups // 16)))
    return dealt.repartition(tasks, "number").groupBy("number").applyInArrow(build, "number bigint, junk bigint, prose bigint, x binary, y binary")


def _read(number: int, x: bytes, y: bytes) -> Block:
    return number, np.frombuffer(x, np.int16).reshape(-1, len(NAMES)), np.frombuffer(y, bool)


def corpus_rules(blocks: DataFrame, seed: int = SEED, here: int = HERE) -> list[Rule]:
    """Rules from all blocks, whose documents the driver holds if they are `here` at most; otherwise it gets the counts only."""
    total = blocks.agg(F.sum("junk").alias("junk"), F.sum("prose").alias("prose")).first()

    blocks = blocks.select("number", "x", "y")

    def tally(*of: object) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        def count(batch: pa.RecordBatch) -> Iterator[Sequence]:
            yield Held([_read(*row) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]).tally(*of)

        got = _mapped(blocks, "key bigint, junk bigint, prose bigint", count).groupBy("key").agg(F.sum("junk").alias("junk"), F.sum("prose").alias("prose")).toArrow().sort_by("key")
        return tuple(c.to_numpy() for c in got.columns)

    if total.junk + total.prose <= here:
        tally = Held([_read(*r) for r in blocks.collect()]).tally
    return _induce(tally, seed, weight=_weight(total.junk, total.prose))


def fit_on(df: DataFrame, common_words: DataFrame, text: str = "text", count: int = LABELLED) -> Model:
    """Fitted on all rows. The spans and the labelled documents' statistics are kept in the shared folder meanwhile."""
    words = [r.word for r in common_words.where("word is not null").select(F.trim("word").alias("word")).distinct().orderBy("word").limit(MOST_WORDS + 1).collect()]
    if len(words) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} common words")
    common = Lexicon(words)
    found = stored(corpus_spans(df, text))
    usage = corpus_usage(found)
    return Model(common, usage, corpus_rules(stored(corpus_blocks(found, common, usage, count))))


def measured(df: DataFrame, model: Model, key: str, text: str) -> DataFrame:
    """(key, NAMES..., blank) of every row; null counts as blank. Nothing is shuffled."""
    shared = df.sparkSession.sparkContext.broadcast((model.common, model.usage))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                texts = [t or "" for t in part.column(1).to_pylist()]
                x = statistics(texts, *shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(np.ascontiguousarray(x[:, i])) for i in range(x.shape[1])), pa.array([not t.strip() for t in texts])],
                                                 names=[key, *NAMES, "blank"])

    schema = ", ".join([f"`{key}` {dict(df.dtypes)[key]}", *(f"{c} double" for c in NAMES), "blank boolean"])
    return df.select(key, text).mapInArrow(run, schema)


def assess(df: DataFrame, common_words: DataFrame, key: str = "doc_id", text: str = "text", count: int = LABELLED) -> DataFrame:
    """(key, statistics..., label) of every row; the label is 'prose', 'junk' or, for null and blank texts, 'blank'.
    The rules, learned from all rows, are one CASE expression. A key that comes twice has two rows."""
    model = fit_on(df, common_words, text, count)
    return measured(df, model, key, text).select(key, *NAMES, F.when(F.col("blank"), "blank").otherwise(F.expr(to_case(model.rules, NAMES))).alias("label"))
