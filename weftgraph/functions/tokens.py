"""Keystrokes, tokens and context windows as column expressions, and the fold over keystrokes."""

from __future__ import annotations

import builtins
import keyword

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tiers, gaps in milliseconds, structural characters, stable suffixes, windows.
BUFFER_ONLY, CHARACTER, TOKEN, STATEMENT, SEMANTIC = -1, 0, 1, 2, 3
TOKEN_GAP, STATEMENT_GAP, SEMANTIC_GAP = 50, 200, 500
BUFFER_LIMIT = 1000
STRUCTURAL = frozenset(":()[]{}=,;")
STABLE_SUFFIXES = ("_id", "_name", "_list", "_map", "_set", "_dict", "_type", "_count", "_path", "_file")
MIN_WINDOW, BASE_WINDOW, MAX_WINDOW = 100, 300, 500


def builtin_names() -> list[str]:
    """Names that are never project definitions: the runtime's own built-ins, and the receivers."""
    return sorted({n for n in dir(builtins) if not n.startswith("_")} | set(keyword.kwlist) | {"self", "cls", "__import__", "__name__", "__file__", "__init__"})


def gap_tier(gap: Column) -> Column:
    """The tier of a pause alone: long ones end a meaning, shorter ones a statement or a token."""
    return F.when(gap > SEMANTIC_GAP, SEMANTIC).when(gap > STATEMENT_GAP, STATEMENT).when(gap > TOKEN_GAP, TOKEN).otherwise(BUFFER_ONLY)


def token_confidence(token: Column) -> Column:
    """How likely a token is whole, by its look."""
    stable = F.lit(False)
    for s in STABLE_SUFFIXES:
        stable = stable | F.endswith(token, F.lit(s))
    return (
        F.when(F.coalesce(token, F.lit("")) == "", 0.0)
        .when(token.isin(builtin_names()), 1.0)
        .when(stable, 0.95)
        .when(F.endswith(token, F.lit("_")), 0.3)
        .when(F.length(token) < 2, 0.2)
        .when(F.contains(token, F.lit("_")), 0.85)
        .when((F.upper(token) == token) & (F.lower(token) != token), 0.9)
        .when(F.substring(token, 2, 1_000_000).rlike("[A-Z]"), 0.85)
        .otherwise(0.6)
    )


def adaptive_window(gap: Column) -> Column:
    """100 ms for gaps of up to 100, 500 from 500 on, in between the gap itself, as both scales agree."""
    return F.least(F.lit(float(MAX_WINDOW)), F.greatest(F.lit(float(MIN_WINDOW)), gap.cast("double")))


class Keystrokes:
    """The state of one editor: tiers of keystrokes in order.

    A quote toggles the string state unless the other kind is open; brackets count outside strings,
    never below zero; a full buffer makes a token of what would only be buffered.
    """

    def __init__(self, buffer: str = "", line: str = "", quote: str = "", depth: int = 0, last: float | None = None):
        self.buffer, self.line, self.quote, self.depth, self.last = buffer, line, quote, depth, last
        self.tiers: dict[int, int] = {}

    def press(self, ch: str, ms: float) -> int:
        gap = 0.0 if self.last is None else ms - self.last
        self.last = ms
        if ch in "'\"":
            if not self.quote:
                self.quote = ch
            elif self.quote == ch:
                self.quote = ""
        closing = False
        if not self.quote:
            if ch in "([{":
                self.depth += 1
            elif ch in ")]}":
                self.depth, closing = max(0, self.depth - 1), True
        tier = self._tier(ch, gap, closing)
        self.line = "" if ch == "\n" else self.line + ch
        self.tiers[tier] = self.tiers.get(tier, 0) + 1
        self.buffer = (self.buffer + ch)[-BUFFER_LIMIT:]
        return TOKEN if len(self.buffer) >= BUFFER_LIMIT and tier == BUFFER_ONLY else tier

    def _tier(self, ch: str, gap: float, closing: bool) -> int:
        if gap > SEMANTIC_GAP:
            return SEMANTIC
        if not self.quote:
            if closing and self.depth == 0 or ch == ":":
                return STATEMENT
            if ch in STRUCTURAL:
                return TOKEN
        if ch == "\n":
            line = self.line.rstrip()
            return STATEMENT if line and line[-1] not in "\\,([{" else TOKEN
        if gap > STATEMENT_GAP:
            return STATEMENT
        return TOKEN if gap > TOKEN_GAP else BUFFER_ONLY

    def flush(self) -> str:
        out, self.buffer = self.buffer, ""
        return out

    def rate(self) -> float:
        """The share of keystrokes that were a statement or more."""
        n = sum(self.tiers.values())
        return sum(v for k, v in self.tiers.items() if k >= STATEMENT) / n if n else 0.0


class Stabiliser:
    """Context that is rebuilt once its window is over, and half as sure inside it."""

    def __init__(self, built: float | None = None, window: float = BASE_WINDOW):
        self.built, self.window, self.last = built, window, None

    def keystroke(self, ms: float) -> None:
        if self.last is not None:
            self.window = min(MAX_WINDOW, max(MIN_WINDOW, ms - self.last))
        self.last = ms

    def request(self, ms: float, confidence: float) -> tuple[bool, float]:
        """(rebuilt, confidence)."""
        inside = self.built is not None and ms - self.built < self.window
        if not inside:
            self.built = ms
        return not inside, confidence / 2 if inside else confidence

    def invalidate(self) -> None:
        self.built = None
