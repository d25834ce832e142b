"""Text that is no language, made by general rules: random alphabets, random record templates, repeated units.

Nothing here is modelled on particular rows. An alphabet is any set of printable characters; a template is any sequence of
fields with any separators, which covers tables, logs, key-value lines, exports, paths and dumps alike. Words come from
the caller.
"""

from __future__ import annotations

import base64
import random
import string
from collections.abc import Callable, Sequence

PRINTABLE = string.digits + string.ascii_letters + string.punctuation
_SEPARATORS = (" ", " ", "  ", "\t", ",", ", ", ";", "; ", "|", " | ", ":", ": ", " - ", "=", "/", " / ", "->", "#")
_TIMES = ("{y}-{m:02}-{d:02}", "{y}-{m:02}-{d:02} {H:02}:{M:02}:{S:02}", "{y}-{m:02}-{d:02}T{H:02}:{M:02}:{S:02}Z", "{d:02}.{m:02}.{y}", "{m}/{d}/{y}", "{H:02}:{M:02}", "{H:02}:{M:02}:{S:02}")
_WRAPS = (("[", "]"), ("(", ")"), ("<", ">"), ("{", "}"), ('"', '"'), ("'", "'"), ("#", ""), ("$", ""), ("", "%"))


class Noise:
    def __init__(self, rng: random.Random, words: Sequence[str], phrase: Callable[[], str] | None = None):
        self.r, self.words, self.phrase = rng, list(words) or ["x"], phrase

    def word(self) -> str:
        return self.r.choice(self.words)

    def letters(self) -> str:
        """A pronounceable or random run of letters."""
        r = self.r
        if r.random() < 0.5:
            return "".join(r.choice(string.ascii_lowercase) for _ in range(r.randint(2, 9)))
        return "".join(r.choice("bcdfghjklmnprstvwz") + r.choice("aeiou") + (r.choice("lnrst") if r.random() < 0.4 else "") for _ in range(r.randint(1, 4)))

    def shuffled(self) -> str:
        """A word with its letters in another order."""
        w = list(self.word())
        self.r.shuffle(w)
        return "".join(w)

    def code(self) -> str:
        r = self.r
        alphabet = r.choice((string.digits, string.hexdigits[:16], string.ascii_uppercase, string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits, string.ascii_letters + string.digits))
        return r.choice(("", "", "-", "_", ".")).join("".join(r.choice(alphabet) for _ in range(r.randint(1, 8))) for _ in range(r.randint(1, 4)))

    def number(self) -> str:
        r = self.r
        n = r.uniform(0, 10 ** r.randint(1, 7)) * (-1 if r.random() < 0.1 else 1)
        return f"{n:.{r.randint(1, 6)}f}" if r.random() < 0.5 else str(int(n))

    def time(self) -> str:
        r = self.r
        return r.choice(_TIMES).format(y=r.randint(1990, 2030), m=r.randint(1, 12), d=r.randint(1, 28), H=r.randint(0, 23), M=r.randint(0, 59), S=r.randint(0, 59))

    def path(self, name: Callable[[], str]) -> str:
        r = self.r
        sep = r.choice("//\\")
        lead = r.choice(("", sep, "." + sep, f"{r.choice(string.ascii_uppercase)}:\\", "https://", "~/"))
        return lead + sep.join(name() for _ in range(r.randint(1, 6))) + r.choice(("", f"{r.choice('._-')}{r.randint(0, 999)}")) + f".{''.join(r.choice(string.ascii_lowercase) for _ in range(r.randint(2, 4)))}"

    def field(self, name: Callable[[], str]) -> Callable[[], str]:
        """A kind of field: what it gives differs from line to line."""
        r = self.r
        some = [name() for _ in range(r.randint(1, 5))]
        make = r.choice((self.number, self.number, self.time, self.code, self.code, name, lambda: r.choice(some), lambda: self.path(name), self.phrase or name, lambda: " ".join(name() for _ in range(r.randint(1, 3)))))
        if r.random() < 0.25:
            key, link = name(), r.choice(("=", ":", ": ", '":', " = "))
            plain = make
            make = lambda: f"{key}{link}{plain()}"
        if r.random() < 0.25:
            a, b = r.choice(_WRAPS)
            inner = make
            make = lambda: f"{a}{inner()}{b}"
        return make

    def records(self, size: int, name: Callable[[], str]) -> str:
        """Lines of one template."""
        r, out, n = self.r, [], 0
        fields = [self.field(name) for _ in range(r.choice((1, 2, 2, 3, 3, 4, 5, 6, 8)))]
        seps = [r.choice(_SEPARATORS)] * len(fields) if r.random() < 0.6 else [r.choice(_SEPARATORS) for _ in fields]
        a, b = r.choice((("", ""), ("", ""), ("", ""), *_WRAPS))
        while n < size:
            line = "".join(x for f, s in zip(fields, seps, strict=True) for x in (s, f()))[len(seps[0]) :]
            out.append(a + line + b)
            n += len(out[-1]) + 1
        return r.choice(("\n", "\n", "\n", "\n", "\r\n", ",", " ")).join(out)

    def soup(self, size: int) -> str:
        """Characters of a random alphabet, with or without blanks, in lines or not."""
        r = self.r
        kind = r.random()
        if kind < 0.15:
            text = base64.b64encode(r.randbytes(size)).decode()
        elif kind < 0.3:
            group = r.choice((2, 4, 8))
            text = " ".join(r.randbytes(group).hex()[:group] for _ in range(max(1, size // (group + 1))))
        else:
            pool = r.choice((PRINTABLE, PRINTABLE, string.punctuation, string.ascii_lowercase, string.ascii_letters, string.digits + string.punctuation))
            alphabet = r.sample(pool, r.randint(2, len(pool)))
            blank = r.choice((0, 0.05, 0.1, 0.2, 0.3))
            text = "".join(" " if r.random() < blank else r.choice(alphabet) for _ in range(size))
        width = r.choice((0, 40, 64, 76, 100))
        return "\n".join(text[i : i + width] for i in range(0, len(text), width)) if width else text

    def repeated(self, size: int, name: Callable[[], str]) -> str:
        unit = self.r.choice((name, self.letters, self.code, self.number, lambda: self.r.choice(PRINTABLE)))()
        return self.r.choice((" ", " ", "\n", ", ", "")).join([unit] * max(4, size // (len(unit) + 1)))

    def any(self, size: int, name: Callable[[], str]) -> str:
        k = self.r.random()
        return self.records(size, name) if k < 0.6 else self.soup(size) if k < 0.85 else self.repeated(size, name)
