"""Text that was decoded with the wrong encoding: finding it, and restoring it where possible.

A multinomial classifier over hashed byte bigrams tells which chain of encodings, if any, a cluster of non-ASCII bytes
went through. It is trained on a bounded sample of records and on the same records garbled by every chain; records that
the first fit takes for garbled are left out of the second. Clusters that a chain explains better than clean text are
inverted: the characters are encoded as they were wrongly decoded and decoded as they should have been, strictly. Whether
what decodes is the original is told by a second model, a logistic regression learned on garbled records with the chain
they went through and on clean ones with chains that happen to decode; chains that destroyed bytes cannot be inverted,
and their traces (replacement characters) count as they are.
"""

from __future__ import annotations

import codecs
import math
import random
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dowser.llm import samples

BUCKET_BITS = 15
SAMPLE, SEED = 1500, 9
#: Log-likelihood ratios: from which a chain is tried, and by which the restored characters must be likelier before
#: the second model is learned, if the right encoding is UTF-8 and if it is another, by which nearly any bytes decode.
TRY, BETTER, WEAK = 2.0, 3.0, 8.0
#: Pieces garbled by each chain to learn the second model; how much a clean example weighs against a garbled one.
JUDGED, CAUTION = 100, 4.0
CHUNK = 300_000

#: (right encoding, wrong encoding): text was encoded by the first and decoded by the second. A chain that was gone
#: through twice is undone twice.
CHAINS = [
    *(("utf-8", b) for b in ("cp1252", "latin-1", "mac_roman", "cp1251", "cp1250", "cp437", "cp850", "gbk", "big5", "shift_jis")),
    *(("gbk", b) for b in ("cp1252", "mac_roman", "cp1251", "cp437", "utf-8", "big5")),
    ("big5", "cp1252"), ("big5", "gbk"), ("shift_jis", "cp1252"),
    *(("cp1252", b) for b in ("mac_roman", "cp1251", "cp437", "cp850", "utf-8", "gbk")),
    ("mac_roman", "cp1252"), ("cp850", "cp1252"),
]
TWICE = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp437")]
_MULTI = {"utf-8", "gbk", "big5", "shift_jis"}
_ASCII = "".join(map(chr, range(128)))
_inner = re.compile(r"(?<=[\x00-\x7f])[\x00-\x7f]+(?=[\x00-\x7f])")


def _single(name: str) -> tuple[str, object]:
    """A single-byte encoding both ways; bytes that it leaves open stand for the control characters, as usual."""
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            chars.append(chr(b))
    return "".join(chars), codecs.charmap_build("".join(chars))


_SINGLE = {name: _single(name) for name in {e for c in CHAINS for e in c} - _MULTI}


def encoded(text: str, name: str, strict: bool = True) -> bytes | None:
    errors = "strict" if strict else "ignore"
    try:
        return text.encode(name, errors) if name in _MULTI else codecs.charmap_encode(text, errors, _SINGLE[name][1])[0]
    except UnicodeError:
        return None


def decoded(data: bytes, name: str, strict: bool = True) -> str | None:
    try:
        return data.decode(name, "strict" if strict else "replace") if name in _MULTI else codecs.charmap_decode(data, "strict", _SINGLE[name][0])[0]
    except UnicodeError:
        return None


def garbled(text: str, right: str, wrong: str, times: int = 1) -> str:
    for _ in range(times):
        text = decoded(encoded(text, right, False), wrong, False)
    return text


def inverted(text: str, right: str, wrong: str) -> str | None:
    """The text before the chain, or None if it can't have gone through it."""
    data = encoded(text, wrong)
    return None if data is None else decoded(data, right)


# --- features -----------------------------------------------------------------------------------------------------


_LEAD = np.zeros(256, np.int8)
_LEAD[0xC2:0xE0], _LEAD[0xE3:0xEE] = 1, 2


def _scripts(data: np.ndarray) -> np.ndarray:
    """For each of some non-ASCII bytes 1 or 2: of an alphabet, or of a script without spaces. Signs that both use
    (punctuation) go with an alphabet that is next to them."""
    kind = _LEAD[data]
    kind[:-1][(data[:-1] == 0xEF) & ((data[1:] == 0xBC) | (data[1:] == 0xBD))] = 2
    place = np.arange(len(data))
    told = np.flatnonzero(kind)
    if not len(told):
        return np.full(len(data), 2, np.int8)
    lead = np.maximum.accumulate(np.where((data & 0xC0) == 0x80, 0, place))  # the later bytes of a character go with its first
    out = kind[lead]
    sign = np.flatnonzero(out == 0)
    after = np.searchsorted(told, lead[sign])
    out[sign] = np.minimum(kind[told[np.maximum(after - 1, 0)]], kind[told[np.minimum(after, len(told) - 1)]])
    return out


def clusters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cluster of each bigram, bucket of each bigram, begin, end): runs of non-ASCII bytes of one kind of script in
    which at most one ASCII byte parts them, with one ASCII byte on either side."""
    high = data >= 0x80
    at = np.flatnonzero(high[:-1] | high[1:]) if len(data) > 1 else np.zeros(0, np.int64)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    # bigrams that meet no ASCII byte but one lie next to each other or one apart
    script = _scripts(data[high])[np.cumsum(high)[np.where(high[at], at, at + 1)] - 1]
    first = np.concatenate([[True], (np.diff(at) > 1) | (np.diff(script) != 0)])
    cluster = np.cumsum(first) - 1
    begin = at[first]
    last = at[np.concatenate([np.flatnonzero(first)[1:] - 1, [len(at) - 1]])]
    end = last + 2
    end[:-1] = np.minimum(end[:-1], begin[1:] + ((data[begin[1:]] & 0x80) == 0))  # of two scripts the second begins there
    pair = data[at].astype(np.uint32) << np.uint32(8) | data[at + 1]
    bucket = ((pair * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)
    return cluster, bucket, begin, end


@dataclass
class Classifier:
    """Log-probabilities of the buckets: row 0 for clean text, the others for the chains; and how often each two
    characters that are not both ASCII follow each other in clean text, to judge what was restored."""

    chains: list[tuple[str, str, int]]
    logp: np.ndarray
    pairs: dict[str, int]
    judge: dict[bool, np.ndarray]

    def scores(self, cluster: np.ndarray, bucket: np.ndarray, count: int) -> np.ndarray:
        return np.stack([np.bincount(cluster, row[bucket], count) for row in self.logp])


def _pairs(rows: Sequence[str]) -> dict[str, int]:
    """How often each two characters that are not both ASCII follow each other; at '', all of them."""
    c = np.frombuffer(" \n ".join(rows).encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    keep = np.flatnonzero((c[:-1] > 127) | (c[1:] > 127)) if len(c) else np.zeros(0, np.int64)
    key, n = np.unique(c[keep] << 21 | c[keep + 1], return_counts=True)
    return {"": int(n.sum())} | {chr(k >> 21) + chr(k & 0x1FFFFF): m for k, m in zip(key.tolist(), n.tolist(), strict=True)}


def fit(texts: Sequence[str]) -> Classifier:
    chains = [(a, b, 1) for a, b in CHAINS] + [(a, b, 2) for a, b in TWICE]
    size = 1 << BUCKET_BITS

    def counts(rows: Sequence[str], right: str = "", wrong: str = "", times: int = 0) -> np.ndarray:
        n = np.zeros(size)
        for i in range(0, len(rows), 2000):  # line ends are the same in all encodings, so rows go through them together
            text = "\n".join(rows[i : i + 2000])
            _, bucket, _, _ = clusters(np.frombuffer((garbled(text, right, wrong, times) if times else text).encode("utf-8", "replace"), np.uint8))
            n += np.bincount(bucket, minlength=size)
        return n

    def every(rows: Sequence[str]) -> np.ndarray:
        rows = [_inner.sub("\n", p) for p in rows]  # only the ASCII characters beside others matter
        return np.stack([counts(rows), *(counts(rows, *chain) for chain in chains)])

    def learn(n: np.ndarray, rows: Sequence[str]) -> Classifier:
        n = n.copy()
        n[1:] *= (n[0].sum() + 1) / (n[1:].sum(1, keepdims=True) + 1)  # as much text of each
        alpha = 0.02
        return Classifier(chains, np.log((n + alpha) / (n.sum(1, keepdims=True) + alpha * size)), _pairs(rows), {})

    pieces = [p for t in texts for p in re.split(r"(?<=[.!?。！？\n])", t) if p and not p.isascii() and "�" not in p]
    n = every(pieces)
    model = learn(n, pieces)
    for _ in range(2):
        bad = hits(model, pieces)
        if not bad:
            break
        n -= every([pieces[i] for i in bad])
        pieces = [p for i, p in enumerate(pieces) if i not in bad]
        model = learn(np.maximum(n, 0), pieces)
    model.judge = learn_judge(model, pieces)
    return model


def learn_judge(model: Classifier, pieces: Sequence[str], seed: int = SEED) -> dict[bool, np.ndarray]:
    """Weights of the second model, by whether the right encoding is UTF-8. Garbled examples are pieces of clean text that
    their own chain restores; clean ones are all clusters of the clean pieces that any chain explains better and decodes."""
    rng = random.Random(seed)
    rows: dict[bool, list[tuple[np.ndarray, bool]]] = {True: [], False: []}
    for chain in model.chains:
        for p in rng.sample(pieces, min(JUDGED, len(pieces))):
            for piece, left, right_, ratio in tried(model, garbled(p, *chain)):
                k = model.chains.index(chain)
                core = restored_by(model, piece, k)
                if core is not None and ratio[k] > 0 and (left + core + right_).strip() in p:
                    rows[chain[0] == "utf-8"].append((evidence(piece, core, Reading.of(model, piece, left, right_), Reading.of(model, core, left, right_), k, ratio), True))
    for at in range(0, len(pieces), 500):
        for piece, left, right_, ratio in tried(model, "\n\n".join(pieces[at : at + 500])):
            was = Reading.of(model, piece, left, right_)
            for k in np.flatnonzero(ratio > 0).tolist():
                core = restored_by(model, piece, k)
                if core is not None:
                    rows[model.chains[k][0] == "utf-8"].append((evidence(piece, core, was, Reading.of(model, core, left, right_), k, ratio), False))
    return {kind: _logistic(np.array([x for x, _ in r]), np.array([y for _, y in r])) for kind, r in rows.items() if len({y for _, y in r}) == 2}


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.01, rounds: int = 60) -> np.ndarray:
    """Weights by Newton's method; garbled examples weigh as much as clean ones together do,
    divided by CAUTION."""
    share = np.where(y, len(y) / max(1, y.sum()) / CAUTION, len(y) / max(1, (~y).sum()))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (share * (p - y)) / len(y) + l2 * w
        step = np.linalg.solve((x * (share * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x / len(y) + l2 * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def hits(model: Classifier, texts: Sequence[str]) -> dict[int, list]:
    """The garbled pieces of those texts that have any, by the texts' places; scored together, in runs of bounded size."""
    out: dict[int, list] = {}
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size < CHUNK):
            size += 2 * len(texts[upto])
            upto += 1
        raws = [t.encode("utf-8", "replace") for t in texts[at:upto]]
        joined = b"\n\n".join(raws)  # ASCII text between keeps clusters of neighbouring texts apart
        starts = np.concatenate([[0], np.cumsum([len(r) + 2 for r in raws])])
        cluster, bucket, begin, end = clusters(np.frombuffer(joined, np.uint8))
        if len(begin):
            scores = model.scores(cluster, bucket, len(begin))
            hot = np.flatnonzero((scores[1:].max(0) - scores[0]) > TRY)
            owner = np.searchsorted(starts, begin[hot] + 1, "right") - 1
            for o in np.unique(owner):
                mine = hot[owner == o]
                pieces = _explain(model, joined, begin[mine], end[mine], scores[:, mine])
                if pieces:
                    out[at + int(o)] = pieces
        at = upto
    return out


def fit_on(frames: Sequence[tuple[DataFrame, str, str]], sample: int = SAMPLE) -> Classifier:
    """Fitted on `sample` rows of each (rows, key, text): those with non-ASCII text and the least hashes of their keys.
    Texts above samples.MOST_CHARS are no sample."""
    texts: list[str] = []
    for df, key, text in frames:
        usable = F.length(text).between(1, samples.MOST_CHARS) & F.col(text).rlike(r"[^\x00-\x7F]")
        texts += samples.sample(df, key, [text], sample, usable).column(0).to_pylist()
    return samples.fitted(frames[0][0].sparkSession, "encoding", (texts, BUCKET_BITS, SEED), lambda: fit(texts))


# --- finding and restoring ----------------------------------------------------------------------------------------

#: A capital after a small letter, or a small letter after two capitals.
_ODD = re.compile(r"(?<=[a-zà-öø-ÿа-я])[A-ZÀ-ÖØ-ÞА-Я]|(?<=[A-ZÀ-ÖØ-ÞА-Я]{2})[a-zà-öø-ÿа-я]")
_ABOVE = "\x7f".__lt__
_STRANGE = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f-\ufffd]")


def restored_by(model: Classifier, piece: str, k: int) -> str | None:
    """The piece before the k-th chain; None if it does not invert strictly to something else without odd characters."""
    right, wrong, times = model.chains[k]
    core: str | None = piece
    for _ in range(times):
        core = inverted(core, right, wrong)
        if core is None:
            return None
    return None if core == piece or _STRANGE.search(core) else core


@dataclass
class Reading:
    """A piece as it stands or as restored, beside its neighbours: log-likelihood of its non-ASCII characters as clean
    text, how common their pairs are there, and how often the case changes as it hardly does."""

    likely: float
    familiar: float
    odd_case: int

    @staticmethod
    def of(model: Classifier, text: str, left: str, right_: str) -> Reading:
        t = left + text + right_
        whole, get, log = math.log(model.pairs[""] + 1), model.pairs.get, math.log
        n = [get(p, 0) for p in map(add, t, t[1:]) if not p.isascii()]
        odd = len(_ODD.findall(t)) if t.lower() != t else 0
        return Reading(sum(log(k + 0.1) for k in n) - whole * len(n), sum(log(k + 1) for k in n) / len(n) if n else 5.0, odd)


def evidence(piece: str, core: str, was: Reading, now: Reading, k: int, ratio: np.ndarray) -> np.ndarray:
    """What the second model weighs: by how much bytes and characters are likelier, in all and for each character; how
    many characters there are; how common the pairs of characters are before and after; whether cases agree."""
    n = sum(map(_ABOVE, piece))
    margin = now.likely - was.likely
    return np.array([min(margin, 60) / 10, margin / n / 5, min(ratio[k], 60) / 10, ratio[k] / n / 5, (ratio[k] - ratio.max()) / 10, math.log(n), was.familiar, now.familiar,
                     was.odd_case, now.odd_case, float(core.isascii()), len(core) / len(piece), 1.0])


def better(model: Classifier, piece: str, core: str, was: Reading, k: int, ratio: np.ndarray, left: str, right_: str) -> float:
    """Above 0: the core is the original."""
    strong = model.chains[k][0] == "utf-8"
    now = Reading.of(model, core, left, right_)
    if strong in model.judge:
        return float(evidence(piece, core, was, now, k, ratio) @ model.judge[strong])
    return now.likely - was.likely - (BETTER if strong else WEAK)


def undo(model: Classifier, piece: str, ratio: np.ndarray, left: str = " ", right_: str = " ") -> tuple[str, tuple[str, str, int]] | None:
    """The piece restored by the chain that the second model prefers, if there is one that it accepts. left, right_: the
    characters beside it; ratio: by how much each chain is likelier than clean text, chains that are not are not tried."""
    best: tuple[float, str, int] | None = None
    was = Reading.of(model, piece, left, right_)
    for k in np.flatnonzero(ratio > 0).tolist():
        core = restored_by(model, piece, k)
        if core is not None:
            worth = better(model, piece, core, was, k, ratio, left, right_)
            if worth > 0 and (best is None or worth > best[0]):
                best = (worth, core, k)
    return None if best is None else (best[1], model.chains[best[2]])


def bare(piece: str) -> tuple[str, str, str]:
    """(left, core, right): the piece without ASCII characters at its ends, and those next to it."""
    core = piece.strip(_ASCII)
    if not core:
        return " ", piece, " "
    i = piece.index(core)
    return piece[:i][-1:] or " ", core, piece[i + len(core) :][:1] or " "


def tried(model: Classifier, text: str) -> Iterator[tuple[str, str, str, np.ndarray]]:
    """(piece, left, right, ratio) of the clusters of a text that some chain explains better than clean text, with and
    without the ASCII characters beside, which may stop a multi-byte decoding."""
    raw = text.encode("utf-8", "replace")
    cluster, bucket, begin, end = clusters(np.frombuffer(raw, np.uint8))
    if not len(begin):
        return
    scores = model.scores(cluster, bucket, len(begin))
    ratio = scores[1:] - scores[0]
    for c in np.flatnonzero(ratio.max(0) > TRY).tolist():
        piece = raw[begin[c] : end[c]].decode("utf-8", "ignore")
        if "\ufffd" not in piece:
            left, core, right_ = bare(piece)
            yield core, left, right_, ratio[:, c]
            if core != piece:
                yield piece, " ", " ", ratio[:, c]


def explain(model: Classifier, text: str) -> list[tuple[int, int, str | None, tuple[str, str, int]]]:
    """(begin, end, restored or None, chain) of the garbled pieces of a text; places are bytes of its UTF-8 form."""
    raw = text.encode("utf-8", "replace")
    data = np.frombuffer(raw, np.uint8)
    cluster, bucket, begin, end = clusters(data)
    if not len(begin):
        return []
    return _explain(model, raw, begin, end, model.scores(cluster, bucket, len(begin)))


def _explain(model: Classifier, raw: bytes, begin: np.ndarray, end: np.ndarray, scores: np.ndarray) -> list:
    ratio = scores[1:] - scores[0]
    out = []
    tried = np.flatnonzero(ratio.max(0) > TRY)
    lossy = [k for k, (_, wrong, _) in enumerate(model.chains) if wrong in _MULTI]
    for c in tried.tolist():
        piece = raw[begin[c] : end[c]].decode("utf-8", "ignore")
        a, b = int(begin[c]), int(end[c])
        if "\ufffd" in piece:
            by = max(lossy, key=lambda k: ratio[k, c])
            out.append((a, b, None, model.chains[by if ratio[by, c] > 0 else int(ratio[:, c].argmax())]))
            continue
        got = undo(model, piece, ratio[:, c])
        left, core, right_ = bare(piece)
        if got is None and core != piece:  # the ASCII characters beside may stop a multi-byte decoding
            got = undo(model, core, ratio[:, c], left, right_)
            if got:
                a += len(piece[: piece.index(core)].encode())
                b = a + len(core.encode())
        if got:
            out.append((a, b, *got))
    return out


def restore(model: Classifier, text: str) -> tuple[str | None, str | None, int, bool]:
    """(restored text, chain, pieces, whole): null chain and text for clean text. A piece whose bytes are lost stays
    as it is, and `whole` is false. What was garbled twice by different chains takes two rounds."""
    found, chain, whole, now = 0, None, True, text
    seen = {text}
    while True:
        pieces = explain(model, now)
        if not pieces:
            break
        raw, out, at, moved = now.encode("utf-8", "replace"), [], 0, False
        for a, b, new, how in pieces:
            out.append(raw[at:a])
            out.append(raw[a:b] if new is None else new.encode())
            whole &= new is not None
            moved |= new is not None
            chain = chain or "+".join([f"{how[0]}>{how[1]}"] * how[2])
            at = b
        found = max(found, len(pieces))
        out.append(raw[at:])
        now = b"".join(out).decode("utf-8", "replace")
        if not moved or now in seen:  # nothing to invert, or one chain undoes another
            break
        seen.add(now)
    return (now if found else None), chain, found, whole


def find(df: DataFrame, model: Classifier, key: str, text: str, restored: bool = False) -> DataFrame:
    """(key, chain, pieces[, whole, restored]) of the rows with garbled text.

    Null, empty and pure ASCII texts have no rows and never reach Python. A key that comes twice is found twice.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = []
            for i, pieces in hits(model, texts).items():
                chain = "+".join([f"{pieces[0][3][0]}>{pieces[0][3][1]}"] * pieces[0][3][2])
                rows.append((i, chain, len(pieces), *((restore(model, texts[i])[j] for j in (3, 0)) if restored else ())))
            if rows:
                index, *rest = zip(*rows, strict=True)
                kinds = (pa.string(), pa.int32(), pa.bool_(), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index)), *(pa.array(v, k) for v, k in zip(rest, kinds, strict=False))],
                                                 names=[key, "chain", "pieces", "whole", "restored"][: 1 + len(rest)])

    kind = dict(df.dtypes)[key]
    schema = f"`{key}` {kind}, chain string, pieces int" + (", whole boolean, restored string" if restored else "")
    return df.where(F.col(text).rlike(r"[^\x00-\x7F]")).select(key, text).mapInArrow(run, schema)
