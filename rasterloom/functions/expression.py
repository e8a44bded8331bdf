"""The band-math language: parsed here, evaluated as one Column (whole-stage code, never eval)."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|([A-Za-z_]\w*)|([-+*/(),\[\]]))")


def _both(x: Column, y: Column, value: Column) -> Column:
    return F.when(x.isNotNull() & y.isNotNull(), value)


def _log(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: F.when(x > 0, f(x))


FUNCTIONS: dict[str, tuple[int, Callable[..., Column]]] = {
    "abs": (1, F.abs), "sqrt": (1, lambda x: F.when(x >= 0, F.sqrt(x))), "pow": (2, F.pow),
    "min": (2, lambda x, y: _both(x, y, F.least(x, y))), "max": (2, lambda x, y: _both(x, y, F.greatest(x, y))),
    "clamp": (3, lambda x, lo, hi: F.when(x.isNotNull() & lo.isNotNull() & hi.isNotNull(), F.least(F.greatest(x, lo), hi))),
    "log": (1, _log(F.ln)), "log2": (1, _log(F.log2)), "log10": (1, _log(F.log10)), "exp": (1, F.exp),
    "sin": (1, F.sin), "cos": (1, F.cos), "tan": (1, F.tan),
    "floor": (1, lambda x: F.floor(x).cast("double")), "ceil": (1, lambda x: F.ceil(x).cast("double")),
}


class Parser:
    """expr = term {(+|-) term}; term = sign {(*|/) sign}; sign = [-|+] sign | atom."""

    def __init__(self, text: str, variable: Callable[[str, int | None], Column]):
        if not text.strip():
            raise ValueError("empty expression")
        self.tokens: list[tuple[str, str]] = []
        at = 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"invalid token at {text[at:at + 10]!r}")
            kind = "number" if m[1] else "name" if m[2] else "sign"
            self.tokens.append((kind, m[1] or m[2] or m[3]))
            at = m.end()
        self.at, self.variable = 0, variable

    def parse(self) -> Column:
        out = self._sum()
        if self.at < len(self.tokens):
            raise ValueError(f"invalid tokens after {self.tokens[self.at][1]!r}")
        return out

    def _peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else None

    def _take(self, want: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.tokens) or want and self.tokens[self.at][1] != want:
            raise ValueError(f"invalid tokens: {want or 'an operand'} is missing")
        self.at += 1
        return self.tokens[self.at - 1]

    def _sum(self) -> Column:
        out = self._product()
        while self._peek() in ("+", "-"):
            out = out + self._product() if self._take()[1] == "+" else out - self._product()
        return out

    def _product(self) -> Column:
        out = self._signed()
        while self._peek() in ("*", "/"):
            out = out * self._signed() if self._take()[1] == "*" else F.try_divide(out, self._signed())
        return out

    def _signed(self) -> Column:
        if self._peek() in ("-", "+"):
            return -self._signed() if self._take()[1] == "-" else self._signed()
        return self._atom()

    def _atom(self) -> Column:
        kind, value = self._take()
        if kind == "number":
            return F.lit(float(value))
        if value == "(":
            out = self._sum()
            self._take(")")
            return out
        if kind != "name":
            raise ValueError(f"invalid tokens: {value!r}")
        if value in FUNCTIONS:
            n, f = FUNCTIONS[value]
            self._take("(")
            args = [self._sum()]
            while self._peek() == ",":
                self._take()
                args.append(self._sum())
            self._take(")")
            if len(args) != n:
                raise ValueError(f"{value} takes {n} arguments")
            return f(*args)
        if len(value) != 1 or value not in "abcdefgh":
            raise ValueError(f"invalid tokens: {value!r}")
        index = None
        if self._peek() == "[":
            self._take()
            kind, text = self._take()
            if kind != "number" or not text.isdigit():
                raise ValueError("a band index is a whole number")
            index = int(text)
            self._take("]")
        return self.variable(value, index)
