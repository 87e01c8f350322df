"""Weights of characters and tokens from overlaid spans (inventory Q12 and Q14)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Patterns and weights of the kinds of spans.
COMMENT = re.compile(r"(//[^\n]*|#[^\n]*|/\*.*?\*/)", re.DOTALL)
STRING = re.compile(r"(\".*?\"|'.*?')", re.DOTALL)
REMARK = re.compile(r"(TODO|FIXME|HACK|Note to self)", re.IGNORECASE)
SPACING = re.compile(r"([^ ]  +[^ ])")
INDENT = re.compile(r"^(\t+ +| +\t+)", re.MULTILINE)
BOILERPLATE, STANDARD, LONG_NAME, QUOTED, LINT, COMMENTED, REMARKED = 0.1, 1.0, 3.0, 5.0, 5.0, 10.0, 10.0
LONG_STRING, LONG_IDENTIFIER, SHORT = 15, 10, 4  # characters that a string or a name must exceed, and a standard token have at least
IDENTIFIER = re.compile(rf"\b[A-Za-z_][A-Za-z0-9_]{{{LONG_IDENTIFIER},}}\b")
LETTER, DIGIT, WORD, SPACE, SIGN = range(1, 6)  # kinds of characters: A-Z, a-z and _; digits; others of words; white space; the rest

FIELDS = {"weight": float, "remarks": int, "lints": int, "tokens": int, "boilerplate": int, "heavy": int, "token_weight": float}


def lint_places(text: str) -> list[int]:
    """Offsets of formatting errors: mixed indentation, and runs of blanks inside a line that no comment mark precedes.

    An error is named by line and column, and its offset found again from these: lines end where
    str.splitlines() says.
    """
    out, start = [], 0
    for line in text.splitlines(keepends=True):
        bare = line.splitlines()[0] if line else ""
        if (m := INDENT.match(bare)) is not None:
            out.append(start + m.start())
        mark = min((i for i in (bare.find("//"), bare.find("#")) if i >= 0), default=len(bare))
        for m in SPACING.finditer(bare):
            hidden = mark + (2 if bare.startswith("//", mark) else 1) <= m.start()
            if not hidden:
                out.append(start + m.start() + 1)
        start += len(line)
    return out


def remarkable(text: str) -> bool:
    """False if REMARK matches nowhere.  Of other letters only these four are taken for one of A-Z in another case."""
    low = text.lower()
    return any(word in low for word in ("todo", "fixme", "hack", "note to self")) or any(c in text for c in "\u0130\u0131\u017f\u212a")


def character_weights(text: str) -> tuple[np.ndarray, int, int]:
    """Weights of a text's characters, its remarks and its formatting errors.

    Later spans lie over earlier ones: comments, long strings, long names (only over what is standard),
    remarks; a formatting error raises five characters around it to its weight at least.
    """
    w = np.full(len(text), STANDARD)
    for m in COMMENT.finditer(text):
        w[m.start() : m.end()] = COMMENTED
    for m in STRING.finditer(text):
        if m.end() - m.start() > LONG_STRING:
            w[m.start() : m.end()] = QUOTED
    for m in IDENTIFIER.finditer(text):
        part = w[m.start() : m.end()]
        part[part == STANDARD] = LONG_NAME
    remarks = 0
    for m in REMARK.finditer(text) if remarkable(text) else ():
        remarks += 1
        w[m.start() : m.end()] = REMARKED
    lints = lint_places(text)
    for at in lints:
        part = w[max(0, at - 2) : at + 3]
        np.maximum(part, LINT, out=part)
    return w, remarks, len(lints)


def _kind(c: str) -> int:
    if re.match(r"[A-Za-z_]", c):
        return LETTER
    return DIGIT if re.match(r"\d", c) else WORD if re.match(r"\w", c) else SPACE if re.match(r"\s", c) else SIGN


ASCII = np.array([_kind(chr(i)) for i in range(128)], np.uint8)


def kinds(points: np.ndarray) -> np.ndarray:
    """The kind of each code point."""
    out = ASCII[np.minimum(points, 127)]
    far = np.flatnonzero(points > 127)
    if len(far):
        some, at = np.unique(points[far], return_inverse=True)
        out[far] = np.array([_kind(chr(c)) for c in some], np.uint8)[at]
    return out


def tokens(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r"""Starts and ends of the matches of [A-Za-z_]\w*|\d+|\s+|[^\w\s], and whether each is a name in ASCII.

    In a run of word characters the first letter begins a name, which takes the rest; before it digits are tokens.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kind = kinds(points)
    if not len(kind):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    word = kind <= WORD
    letters = np.cumsum(kind == LETTER)
    first = word & ~np.concatenate([[False], word[:-1]])
    before = np.maximum.accumulate(np.where(first, letters - (kind == LETTER), 0))  # letters before the run
    state = np.where(word & (letters > before), np.uint8(LETTER), np.where(kind == WORD, np.uint8(0), kind))
    cut = np.concatenate([[True], (state[1:] != state[:-1]) | (state[1:] == SIGN)])
    start = np.flatnonzero(cut)
    end = np.append(start[1:], len(kind))
    name = state[start] == LETTER
    if not text.isascii():
        name &= ~np.logical_or.reduceat(points > 127, start)
    keep = state[start] > 0
    return start[keep], end[keep], name[keep]


def token_weights(text: str, w: np.ndarray) -> np.ndarray:
    """The largest weight inside each token; a token of no more than the standard one is boilerplate unless it is a name in ASCII of SHORT characters at least."""
    start, end, name = tokens(text)
    if not len(start):
        return np.zeros(0)
    ends = np.stack([start, end], 1).reshape(-1)  # tokens and what lies between them
    most = np.maximum.reduceat(np.append(w, 0.0), ends)[::2]
    return np.where(most > STANDARD, most, np.where(name & (end - start >= SHORT), STANDARD, BOILERPLATE))


def span_weights(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key and FIELDS for each text: sums of character and token weights, counts of remarks, lints and tokens.

    heavy counts tokens above the standard weight.  A null text is empty.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            cols: dict[str, list] = {f: [] for f in FIELDS}
            for t in b.column("t").to_pylist():
                w, remarks, lints = character_weights(t)
                tw = token_weights(t, w)
                row = (float(w.sum()), remarks, lints, len(tw), int((tw == BOILERPLATE).sum()), int((tw > STANDARD).sum()), float(tw.sum()))
                for c, v in zip(cols.values(), row, strict=True):
                    c.append(v)
            arrays = [pa.array(v, pa.float64() if FIELDS[f] is float else pa.int64()) for f, v in cols.items()]
            yield pa.RecordBatch.from_arrays([b.column("key"), *arrays], names=["key", *FIELDS])

    kind = docs.schema[key].dataType.simpleString()
    d = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    fields = ", ".join(f"{f} {'double' if t is float else 'bigint'}" for f, t in FIELDS.items())
    return d.mapInArrow(run, f"key {kind}, {fields}").withColumnRenamed("key", key)
