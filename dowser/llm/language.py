"""Languages of documents and of the stretches within them.

A text is cut into segments at sentence and line ends. Each is described by its character 1- to 4-grams (hashed, as
term frequency times inverse document frequency) and classified by sparse multinomial logistic regression. The
weights are learned by follow-the-regularised-leader with an elastic-net penalty, on a bounded sample of rows with a
usable label; labels that the first fit contradicts are left out of the second. A temperature fitted on held-out
segments calibrates the confidences. One more class, `und`, stands for what is no language: codes, paths, noise.

Neighbouring segments of one language form a stretch; segments too short to tell take their neighbours' language.
"""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dowser.llm import samples
from dowser.llm.noise import Noise

BUCKETS_BITS, ORDERS = 16, 4
SAMPLE, SEGMENTS, SEED, BATCH = 3000, 1500, 3, 32
UND = "und"
CHUNK = 200_000
#: A language with fewer segments in the sample is no class. A perfect held-out set would drive the temperature to nothing.
LEAST_SEGMENTS, LEAST_TEMPERATURE = 30, 0.15

# Usual codes and names of languages by code (ISO 639); a region or script after - or _ is dropped first.
NAMES = {
    "ar": "ar ara arabic العربية", "bg": "bg bul bulgarian български", "bn": "bn ben bengali বাংলা", "ca": "ca cat catalan català", "cs": "cs ces cze czech čeština",
    "da": "da dan danish dansk", "de": "de deu ger german deutsch", "el": "el ell gre greek ελληνικά", "en": "en eng english", "es": "es spa spanish español espanol castellano",
    "et": "et est estonian eesti", "fa": "fa fas per persian farsi فارسی", "fi": "fi fin finnish suomi", "fr": "fr fra fre french français francais", "he": "he heb iw hebrew עברית",
    "hi": "hi hin hindi हिन्दी", "hr": "hr hrv croatian hrvatski", "hu": "hu hun hungarian magyar", "id": "id ind indonesian", "it": "it ita italian italiano", "ja": "ja jpn japanese 日本語",
    "ko": "ko kor korean 한국어", "lt": "lt lit lithuanian lietuvių", "lv": "lv lav latvian latviešu", "ms": "ms msa may malay melayu", "nl": "nl nld dut dutch nederlands",
    "no": "no nor nb nob nn nno norwegian norsk", "pl": "pl pol polish polski", "pt": "pt por portuguese português portugues", "ro": "ro ron rum romanian română",
    "ru": "ru rus russian русский", "sk": "sk slk slo slovak slovenčina", "sl": "sl slv slovenian slovenščina", "sr": "sr srp serbian српски", "sv": "sv swe swedish svenska",
    "sw": "sw swa swahili kiswahili", "ta": "ta tam tamil தமிழ்", "te": "te tel telugu తెలుగు", "th": "th tha thai ไทย", "tr": "tr tur turkish türkçe", "uk": "uk ukr ukrainian українська",
    "ur": "ur urd urdu اردو", "vi": "vi vie vietnamese", "zh": "zh zho chi cmn chinese 中文 汉语 漢語",
}


def named(lang: Column) -> Column:
    """The code of the language that a label names, or null."""
    base = F.element_at(F.split(F.lower(F.trim(lang)), "[-_]"), 1)
    out = F.lit(None).cast("string")
    for code, names in NAMES.items():
        out = F.when(base.isin(*names.split()), code).otherwise(out)
    return out


# --- segments and features ----------------------------------------------------------------------------------------

_HAN_LOW, _HAN_HIGH = 0x3400, 0x9FFF
_HAN = re.compile("[㐀-鿿]")


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code unit below 0x10000: whether it is a letter, and what it is lower-cased."""
    chars = [chr(i) if not 0xD800 <= i < 0xE000 else " " for i in range(0x10000)]
    letter = np.array([c.isalpha() or c in "'’" for c in chars])
    lower = np.array([ord(c.lower()) if len(c.lower()) == 1 and ord(c.lower()) < 0x10000 else i for i, c in enumerate(chars)], np.uint32)
    return letter, lower


LETTER, LOWER = _tables()
_ENDS = np.zeros(0x10000, bool)
_ENDS[[ord(c) for c in ".!?…;"]] = True
_ENDS_HAN = np.zeros(0x10000, bool)
_ENDS_HAN[[ord(c) for c in "。！？；"]] = True
_BREAKS = np.zeros(0x10000, bool)
_BREAKS[[ord(c) for c in "\n\r\t|"]] = True
_SPACE = np.zeros(0x10000, bool)
_SPACE[[ord(c) for c in " \t\r\n　\xa0"]] = True


def units(text: str) -> np.ndarray:
    """Code points, those beyond the basic plane as blanks."""
    c = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return np.where(c < 0x10000, c, 32)


def segment_ends(c: np.ndarray) -> np.ndarray:
    """True at the last character of each segment."""
    after = np.append(c[1:], 10)
    slash = (c == 47) & _SPACE[after] & _SPACE[np.append(32, c[:-1])]
    ends = _ENDS[c] & (_SPACE[after] | ((after >= _HAN_LOW) & (after <= _HAN_HIGH)))
    return _BREAKS[c] | _ENDS_HAN[c] | ends | slash


def features(c: np.ndarray, seg: np.ndarray, orders: int = ORDERS, bits: int = BUCKETS_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(segment, bucket) of every n-gram; n-grams lie within a segment and don't span two separators."""
    is_letter = LETTER[c]
    x = np.where(is_letter, LOWER[c], 32).astype(np.uint32)
    same1 = np.append(False, seg[1:] == seg[:-1])
    joint = np.append(False, is_letter[1:] | is_letter[:-1]) & same1  # not two separators in a row
    out_seg, out_bucket = [], []
    h, ok = x * np.uint32(0x9E3779B1), is_letter.copy()
    shift = np.uint32(32 - bits)
    for n in range(1, orders + 1):
        if n > 1:
            h = np.append(np.uint32(0), h[:-1]) * np.uint32(0x85EBCA6B) + x * np.uint32(0xC2B2AE35) + np.uint32(n)
            ok = np.append(False, (ok if n > 2 else np.ones(len(ok), bool))[:-1]) & joint
        mixed = h[ok]
        mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        out_seg.append(seg[ok])
        out_bucket.append((mixed >> shift).astype(np.int32))
    return np.concatenate(out_seg), np.concatenate(out_bucket)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # buckets x languages, inverse document frequencies included
    bias: np.ndarray
    temperature: float
    calibration: float = 0.0  # mean distance of confidence and accuracy over held-out segments, by tenths of confidence

    def probabilities(self, c: np.ndarray, seg: np.ndarray, count: int) -> np.ndarray:
        """One row a segment."""
        at, bucket = features(c, seg)
        score = np.zeros((count, len(self.languages)))
        n = np.maximum(np.bincount(at, minlength=count), 1)[:, None]
        for k in range(len(self.languages)):
            score[:, k] = np.bincount(at, self.weights[k][bucket], count)
        return softmax((score / n + self.bias) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


# --- learning -----------------------------------------------------------------------------------------------------


def ftrl(rows: Sequence[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, buckets: int, alpha: float = 2.0, beta: float = 1.0,
         l1: float = 0.002, l2: float = 0.02, epochs: int = 3, batch: int = BATCH, seed: int = SEED) -> np.ndarray:
    """Weights (buckets + 1) x classes by follow-the-regularised-leader (proximal); the last row is the bias. The
    gradients of `batch` rows make one step."""
    z, n = np.zeros((buckets + 1, classes)), np.zeros((buckets + 1, classes))
    rng = np.random.default_rng(seed)

    def weights(zi: np.ndarray, ni: np.ndarray, l1i: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1i, 0.0, -(zi - np.sign(zi) * l1i) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        mix = rng.permutation(len(rows))
        for first in range(0, len(mix), batch):
            part = mix[first : first + batch]
            idx = np.concatenate([*(rows[i][0] for i in part), [buckets]])
            used, at = np.unique(idx, return_inverse=True)
            l1i = np.full((len(used), 1), l1)
            l1i[-1] = 0  # the bias has the greatest index
            w = weights(z[used], n[used], l1i)
            size = [len(rows[i][0]) for i in part]
            owner, at = np.repeat(np.arange(len(part)), size), at[:-1]
            val = np.concatenate([rows[i][1] for i in part])
            score = np.stack([np.bincount(owner, val * w[at, k], len(part)) for k in range(classes)], axis=1) + w[-1]
            p = softmax(score)
            p[np.arange(len(part)), y[part]] -= 1
            g = np.stack([np.bincount(at, val * p[owner, k], len(used)) for k in range(classes)], axis=1)
            g[-1] = p.sum(0)
            sigma = (np.sqrt(n[used] + g * g) - np.sqrt(n[used])) / alpha
            z[used] += g - sigma * w
            n[used] += g * g
    l1all = np.full((buckets + 1, 1), l1)
    l1all[-1] = 0
    return weights(z, n, l1all)


def nonlanguage(paths: Sequence[str], count: int, seed: int = SEED) -> list[str]:
    """Segments without a language, by the rules of noise.py; their names are those in paths, or random letters."""
    r, out = random.Random(seed), []
    noise = Noise(r, sorted({w for p in paths if p for w in re.split(r"[/\\_.\s-]+", p) if 3 <= len(w) <= 16 and w.isalpha()}))
    while len(out) < count:
        name = r.choice((noise.word, noise.letters, noise.shuffled, noise.code))
        if r.random() < 0.2:  # names in a row
            out.append(" ".join(w.title() if r.random() < 0.5 else w for w in (name() for _ in range(r.randint(1, 8)))))
        else:
            out += [s for s in cut(noise.any(r.randint(20, 160), name)) if LETTER[units(s)].any()][:4]
    return out[:count]


def cut(text: str) -> list[str]:
    c = units(text)
    ends = np.flatnonzero(segment_ends(c)) + 1
    out, a = [], 0
    for b in [*ends.tolist(), len(c)]:
        if b > a:
            out.append(text[a:b])
        a = b
    return out


def counted(pieces: Sequence[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, shares) of each piece's n-grams."""
    out = []
    for at in range(0, len(pieces), 1000):
        part = pieces[at : at + 1000]
        c = [units(s) for s in part]
        seg, bucket = features(np.concatenate(c), np.repeat(np.arange(len(part)), [len(x) for x in c]))
        key, n = np.unique(seg << BUCKETS_BITS | bucket, return_counts=True)
        edge = np.searchsorted(key >> BUCKETS_BITS, np.arange(len(part) + 1))
        total = np.maximum(np.bincount(seg, minlength=len(part)), 1)
        out += [(key[a:b] & ((1 << BUCKETS_BITS) - 1), n[a:b] / total[i]) for i, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True))]
    return out


def fit(texts: Sequence[tuple[str, str]], paths: Sequence[str] = (), each: int = SEGMENTS, seed: int = SEED) -> Model:
    """From (language, text) rows; of each language at most `each` segments. A text's segments fall into one of two
    folds together; the first fit on each fold judges the labels of the other, and the last uses those confirmed."""
    rng = random.Random(seed)
    pool: dict[str, list[tuple[int, str]]] = {}
    for fold, (lang, text) in enumerate(texts):
        pool.setdefault(lang, []).extend((fold % 2, s) for s in cut(text))
    for lang, rows in pool.items():
        rng.shuffle(rows)
        fit_for = (r for r in rows if int(LETTER[units(r[1])].sum()) >= (6 if _HAN.search(r[1]) else 16))
        pool[lang] = list(itertools.islice(fit_for, each))
    languages = sorted(k for k, v in pool.items() if len(v) >= LEAST_SEGMENTS)
    segments = [(k, *s) for k in languages for s in pool[k]]
    languages.append(UND)
    most = max(Counter(k for k, _, _ in segments).values(), default=9)  # no class outweighs the languages
    segments += [(UND, i % 2, s) for i, s in enumerate(nonlanguage(paths, most, seed))]
    # short pieces too, so that short segments are judged by what they hold
    pieces = []
    for k, fold, s in segments:
        pieces.append((k, fold, s))
        words = s.split(" ")
        if len(words) > 6 and rng.random() < 0.5:
            i = rng.randint(0, len(words) - 4)
            pieces.append((k, fold, " ".join(words[i : i + rng.randint(3, 6)])))
    buckets = 1 << BUCKETS_BITS
    rows = counted([s for _, _, s in pieces])
    df = np.bincount(np.concatenate([i for i, _ in rows]), minlength=buckets)
    idf = np.log((1 + len(rows)) / (1 + df)) + 1
    rows = [(i, v * idf[i]) for i, v in rows]
    y = np.array([languages.index(k) for k, _, _ in pieces])
    folds = np.array([fold for _, fold, _ in pieces])
    held = np.arange(len(rows)) % 5 == 4
    agreed = np.zeros(len(rows), bool)
    for fold in (0, 1):
        train = np.flatnonzero(folds != fold)
        if len(train):
            w = ftrl([rows[i] for i in train], y[train], len(languages), buckets, epochs=1, seed=seed)
            for i in np.flatnonzero(folds == fold):
                agreed[i] = (rows[i][1] @ w[rows[i][0]] + w[-1]).argmax() == y[i]
    keep = np.flatnonzero(agreed & ~held)
    w = ftrl([rows[i] for i in keep], y[keep], len(languages), buckets, seed=seed + 1)
    logits = np.array([v @ w[i] + w[-1] for i, v in rows])
    z, t = logits[held & agreed], y[held & agreed]
    best = min((float(-np.log(softmax(z / T)[np.arange(len(t)), t] + 1e-12).mean()), T) for T in np.geomspace(0.05, 5, 41)) if len(t) else (0, 1.0)
    temperature = max(best[1], LEAST_TEMPERATURE)
    return Model(languages, np.ascontiguousarray((w[:-1] * idf[:, None]).T.astype(np.float32)), w[-1], temperature, calibration_error(softmax(z / temperature), t))


def calibration_error(p: np.ndarray, y: np.ndarray) -> float:
    if not len(y):
        return 0.0
    sure, right = p.max(1), p.argmax(1) == y
    tenth = np.minimum((sure * 10).astype(int), 9)
    return float(sum(abs(sure[tenth == k].sum() - right[tenth == k].sum()) for k in range(10)) / len(y))


def fit_on(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", path: str = "path", sample: int = SAMPLE, each: int = SEGMENTS) -> Model:
    """Fitted on the `sample` rows with a usable label that have the least hashes of their keys; texts above
    samples.MOST_CHARS are no sample."""
    rows = df.select(key, named(F.col(lang)).alias("_lang"), F.col(text).alias("_text"), F.col(path).alias("_path"))
    got = samples.sample(rows, key, ["_lang", "_text", "_path"], sample, F.col("_lang").isNotNull() & F.length("_text").between(1, samples.MOST_CHARS))
    texts, paths = list(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True)), got.column(2).to_pylist()
    return samples.fitted(df.sparkSession, "language", (texts, paths, each, SEED, BUCKETS_BITS), lambda: fit(texts, paths, each))


# --- applying -----------------------------------------------------------------------------------------------------

#: Letters (a Chinese character counts as HAN_WEIGHT) from which a segment is judged by itself, from which it may be
#: an entry of another language, from which it is a whole sentence of it, and from which the entries together count.
LEAST, ENTRY, SENTENCE, ENTRIES, HAN_WEIGHT = 10, 16, 36, 60, 3
SURE, PLAIN = 0.9, 0.7


def judge(model: Model, texts: Sequence[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts of bounded size: (first text, text of each segment, end of each segment in its text,
    letters, probabilities)."""
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size + len(texts[upto]) < CHUNK):
            size += len(texts[upto]) + 1
            upto += 1
        c = units("\n".join(texts[at:upto]) + "\n")
        length = np.array([len(t) + 1 for t in texts[at:upto]])
        last = np.cumsum(length)
        ends = segment_ends(c)
        ends[last - 1] = True
        stop = np.flatnonzero(ends) + 1
        seg = np.concatenate([[0], np.cumsum(ends)[:-1]])
        count = len(stop)
        letter = LETTER[c]
        han = (c >= _HAN_LOW) & (c <= _HAN_HIGH)
        letters = np.bincount(seg[letter], minlength=count) + (HAN_WEIGHT - 1) * np.bincount(seg[han], minlength=count)
        owner = np.searchsorted(last, stop - 1, "right")
        yield at, owner, np.minimum(stop - (last - length)[owner], length[owner] - 1), letters, model.probabilities(c, seg, count)
        at = upto


def monotonous(text: str) -> bool:
    """Whether one token makes up more than half of a text."""
    words = text.split()
    return len(words) >= 8 and len(set(words)) <= len(words) / 2 and Counter(words).most_common(1)[0][1] > len(words) / 2


def verdicts(model: Model, texts: Sequence[str]) -> dict[str, np.ndarray]:
    """Per text: the language of most of it (und: none), the confidence, and letters in other languages by entry."""
    und = model.languages.index(UND)
    out = {"language": np.full(len(texts), und), "confidence": np.zeros(len(texts)), "other": np.full(len(texts), und), "mixed": np.zeros(len(texts), bool)}
    for first, owner, _, letters, p in judge(model, texts):
        n = owner[-1] + 1
        told = letters >= LEAST
        weight = np.where(told, letters, 0.0)
        mass = np.stack([np.bincount(owner, weight * p[:, k], n) for k in range(p.shape[1])], axis=1)
        total = np.maximum(np.bincount(owner, weight, n), 1e-9)
        alone = mass.copy()
        alone[:, und] = 0
        main = alone.argmax(1)
        share_und = mass[:, und] / total
        best = p.argmax(1)
        plain = np.bincount(owner, np.where((best != und) & (p.max(1) >= PLAIN), weight, 0.0), n)  # what is plainly in some language
        none = (share_und > 0.5) | (plain < 0.5 * total) | (alone.max(1) < LEAST * 0.7) | np.fromiter(map(monotonous, texts[first : first + n]), bool, n)
        sure = (letters >= ENTRY) & (best != und) & (best != main[owner]) & (p.max(1) >= SURE) & (p[np.arange(len(p)), main[owner]] < 1 - SURE)
        big = np.zeros((n, p.shape[1]))
        np.maximum.at(big, (owner[sure], best[sure]), letters[sure])
        entries = np.zeros((n, p.shape[1]))
        np.add.at(entries, (owner[sure], best[sure]), letters[sure])
        mixed = ((big >= SENTENCE) | (entries >= ENTRIES)).any(1)
        rows = slice(first, first + n)
        out["language"][rows] = np.where(none, und, main)
        out["confidence"][rows] = np.where(none, share_und, alone[np.arange(n), main] / total)
        out["mixed"][rows] = mixed & ~none
        out["other"][rows] = entries.argmax(1)
    return out


def documents(df: DataFrame, model: Model, key: str, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """(key, keep..., language, confidence, mixed, other) of every row. Null, blank and codes: `und`, confidence 0 to 1;
    `mixed`: whole sentences or entries of another language, `other`, occur; null where not."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    columns = [key, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array(model.languages, object)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                v = verdicts(model, [t or "" for t in part.column(len(columns)).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(len(columns))), pa.array(names[v["language"]], pa.string()), pa.array(v["confidence"]), pa.array(v["mixed"]),
                     pa.array(np.where(v["mixed"], names[v["other"]], None), pa.string())], names=[*columns, "language", "confidence", "mixed", "other"])

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "language string, confidence double, mixed boolean, other string"])
    return df.select(*columns, text).mapInArrow(run, schema)


def stretches(df: DataFrame, model: Model, key: str, text: str) -> DataFrame:
    """(key, stretch, begin, end, language, confidence): the stretches of one language of every text, in order.
    Places are code points. Texts that are null or empty have none."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                kept = [i for i, t in enumerate(part.column(1).to_pylist()) if t]
                rows = []
                for first, owner, end, letters, p in judge(model, part.column(1).take(pa.array(kept, pa.int64())).to_pylist() if kept else []):
                    best = np.where(letters >= LEAST, p.argmax(1), -1)
                    for o in range(owner[-1] + 1):
                        mine = np.flatnonzero(owner == o)
                        told = mine[best[mine] >= 0]
                        if len(told):  # untold segments go with the told one before, the first with the one after
                            near = told[np.maximum(np.searchsorted(told, mine, "right") - 1, 0)]
                            lang = best[near]
                        else:
                            lang = np.full(len(mine), model.languages.index(UND))
                        edge = np.flatnonzero(np.append(np.diff(lang) != 0, True))
                        a = begin = 0
                        for number, b in enumerate(edge):
                            seg = mine[a : b + 1]
                            w = np.maximum(letters[seg], 1e-9)
                            rows.append((kept[first + o], number, begin, int(end[mine[b]]), model.languages[lang[b]], float((p[seg, lang[b]] * w).sum() / w.sum())))
                            a, begin = b + 1, int(end[mine[b]])
                if rows:
                    i, number, begin, stop, lang, conf = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(i)), pa.array(number, pa.int32()), pa.array(begin, pa.int64()), pa.array(stop, pa.int64()),
                                                      pa.array(lang, pa.string()), pa.array(conf, pa.float64())], names=[key, "stretch", "begin", "end", "language", "confidence"])

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, stretch int, begin bigint, `end` bigint, language string, confidence double")


def under_roots(files: DataFrame, settings: DataFrame, most: int = 1000, key: str = "id", path: str = "path") -> DataFrame:
    """The files under the root of one of the settings: its root_path, followed by / or \\, begins the path. A few
    roots are tested in place; more are joined with the paths' ancestors."""
    roots = [r.root_path for r in settings.where("root_path is not null").select("root_path").distinct().limit(most + 1).collect()]
    if len(roots) <= most:
        test = F.lit(False)
        for r in roots:
            test = test | F.col(path).startswith(r + "/") | F.col(path).startswith(r + "\\")
        return files.where(test)
    places = F.filter(F.sequence(F.lit(1), F.length(path)), lambda i: F.substring(F.col(path), i, F.lit(1)).isin("/", "\\"))
    up = files.where(F.length(path) > 0).select(key, F.explode(F.transform(places, lambda i: F.substring(F.col(path), F.lit(1), i - 1))).alias("root_path"))
    return files.join(up.join(settings.select("root_path").distinct(), "root_path", "left_semi").select(key).distinct(), key, "left_semi")
