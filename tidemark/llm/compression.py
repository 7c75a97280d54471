"""Quality rules: word and line counts, and bands of zstandard ratios."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.texts import filter_texts, per_text

SYMBOLS = b"#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Band:
    """Ratios of bytes to compressed bytes that texts below ``below`` bytes may have."""

    below: float
    low: float
    high: float


# Short texts hardly compress at all, so that both limits rise with the length.
WHOLE_BANDS = (
    Band(128, 0.0, 1.6),
    Band(256, 0.95, 2.2),
    Band(512, 1.05, 2.5),
    Band(1024, 1.15, 2.8),
    Band(4096, 1.3, 3.2),
    Band(16384, 1.4, 3.6),
    Band(float("inf"), 1.4, 4.5),
)


@dataclass(frozen=True)
class Rules:
    """Parameters of the rules; ``bands`` are in order of length, the last has no end.

    Texts longer than ``chunk_bytes`` are also compressed in chunks of that size (a rest of
    under half a chunk is left to the ratio of the whole). Texts with more than
    ``max_odd_chunks`` of their chunks outside the chunk limits are rejected.
    """

    min_words: int = 10
    max_repeat_percent: int = 20
    level: int = 3
    bands: tuple[Band, ...] = WHOLE_BANDS
    chunk_bytes: int = 4096
    chunk_low: float = 1.3
    chunk_high: float = 5.0
    max_odd_chunks: float = 0.25


FIELDS = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
    + [T.StructField("ratio", T.DoubleType()), T.StructField("odd_chunks", T.DoubleType())]
)


def repeat_words(words: Sequence[list[bytes]], window: int = WINDOW) -> np.ndarray:
    """Per text, the words that stand in a window of ``window`` words found twice or more in that text."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    out = np.zeros(len(words), dtype=np.int64)
    if sizes.max(initial=0) <= window:
        return out
    flat = np.fromiter(chain.from_iterable(words), dtype=object, count=int(sizes.sum()))
    ids = pd.factorize(flat)[0].astype(np.int64)
    doc = np.repeat(np.arange(len(words)), sizes)
    begins = np.flatnonzero(doc[: 1 - window] == doc[window - 1 :])
    # Equal windows get equal numbers, one more word in each step; the text's number comes first.
    key = doc[begins]
    for k in range(window):
        key = pd.factorize(key * (ids.max() + 1) + ids[begins + k])[0].astype(np.int64)
    again = begins[np.bincount(key)[key] > 1]
    covered = np.zeros(len(ids), dtype=bool)
    for k in range(window):
        covered[again + k] = True
    return np.bincount(doc[covered], minlength=len(words))


def base_counts(texts: Sequence[bytes]) -> list[np.ndarray]:
    """Arrays n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    words = [t.split() for t in texts]
    n_words = np.array([len(w) for w in words], dtype=np.int64)
    chars = [len(t.translate(None, b" \t\n\r\x0b\x0c").decode("utf-8", "replace")) for t in texts]
    symbols = [len(t) - len(t.translate(None, SYMBOLS)) for t in texts]
    dup = []
    for t in texts:
        lines = [line for line in t.split(b"\n") if line.strip()]
        dup.append(len(lines) - len(set(lines)))
    return [n_words, *(np.array(x, dtype=np.int64) for x in (chars, symbols, dup)), repeat_words(words)]


def ratios(text: bytes, rules: Rules, press: Callable[[bytes], bytes]) -> tuple[float, float, bool]:
    """Ratio of the whole text, share of its chunks outside the limits, and whether both are within theirs."""
    if not text:
        return 0.0, 0.0, False
    whole = len(text) / len(press(text))
    band = next(b for b in rules.bands if len(text) < b.below)
    odd, size = [], rules.chunk_bytes
    if len(text) > size:
        for at in range(0, len(text), size):
            chunk = text[at : at + size]
            if 2 * len(chunk) >= size:
                odd.append(not rules.chunk_low <= len(chunk) / len(press(chunk)) <= rules.chunk_high)
    share = sum(odd) / len(odd) if odd else 0.0
    return whole, share, band.low <= whole <= band.high and share <= rules.max_odd_chunks


def judge(rules: Rules = Rules()) -> Callable[[], Callable]:
    def start() -> Callable:
        press = zstandard.ZstdCompressor(level=rules.level).compress

        def make(texts: Sequence[bytes | None]) -> list[np.ndarray]:
            texts = [t or b"" for t in texts]
            counts = base_counts(texts)
            n_words, repeats = counts[0], counts[-1]
            failed = (n_words < rules.min_words) | (100 * repeats > rules.max_repeat_percent * n_words)
            measured = [ratios(t, rules, press) for t in texts]
            whole, share = (np.array([m[k] for m in measured], dtype=np.float64) for k in (0, 1))
            kept = ~failed & np.array([m[2] for m in measured], dtype=bool)
            return [*counts, failed, kept, whole, share]

        return make

    return start


def compression_bands(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", rules: Rules = Rules()
) -> DataFrame:
    """Counts, ratios and verdict of every text, in one pass without a shuffle.

    Null and empty texts have no words, so ``base_failed`` is true and ``kept`` false. Repeated
    rows each give a row, a null id stays null, other columns are not read, and an empty table
    gives no rows.
    """
    return per_text(docs, text, [id_column], FIELDS, judge(rules))


def keep_quality(docs: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns.

    Null and empty texts and texts of few words go. Equal rows stay or go together; null ids do not
    matter; an empty table gives no rows.
    """

    def start() -> Callable:
        make = judge(rules)()
        return lambda texts: make(texts)[6]

    return filter_texts(docs, text, start)
