"""Token counts of a byte-level BPE vocabulary, merged in ragged numpy arrays."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.texts import per_text

# Fixed value: how byte-level BPE vocabularies of this kind cut texts before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The tokenizer's white space is Unicode's; the regex module also counts U+001C to U+001F.
PATTERN = PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(
    r"\S", r"\P{White_Space}"
)
CACHED = 500_000
FAR = np.iinfo(np.int64).max

FIELDS = T.StructType(
    [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    + [T.StructField("over_limit", T.BooleanType())]
)


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable in Latin-1, else the next from U+0100 on."""
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class Merges:
    """Merge ranks as sorted arrays. ``special`` strings count as one token wherever they stand."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left, right, merged = (
            np.array(x, dtype=np.int64)
            for x in ([ids[a] for a, _ in pairs], [ids[b] for _, b in pairs], [ids[a + b] for a, b in pairs])
        )
        self.width = max(ids.values()) + 1
        key = left * self.width + right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.merged = key[order], order.astype(np.int64), merged
        self.bytes = np.array([ids[c] for c in byte_letters()], dtype=np.int64)
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], FAR)

    def count(self, pieces: Sequence[bytes]) -> np.ndarray:
        """Symbols that each non-empty piece has once no pair of its neighbours can be merged.

        All pieces take a step together: each merges its lowest-rank pair, wherever that stands in it.
        """
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        out = np.ones(len(pieces), dtype=np.int64)
        owner = np.repeat(np.arange(len(pieces)), sizes)
        symbol = self.bytes[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        rank = self._ranks(symbol, owner)
        while len(symbol):
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            lowest = np.minimum.reduceat(rank, first)
            length = np.diff(first, append=len(owner))
            out[owner[first]] = length
            live = np.repeat(lowest, length)
            hit = (rank == live) & (live < FAR)
            at = np.flatnonzero(hit)
            if len(at) == 0:
                break
            # In a run such as aaa the matches overlap: take the first, third, ... of neighbouring matches.
            run = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            nth = np.arange(len(at)) - np.repeat(run, np.diff(run, append=len(at)))
            at = at[nth % 2 == 0]
            symbol[at] = self.merged[rank[at]]
            stays = live < FAR
            stays[at + 1] = False
            moved = np.cumsum(stays) - 1
            new_at = moved[at]
            symbol, owner, rank = symbol[stays], owner[stays], rank[stays]
            near = np.unique(np.concatenate([new_at, np.maximum(new_at - 1, 0)]))
            rank[near] = self._ranks(symbol, owner, near)
        return out

    def _ranks(self, symbol: np.ndarray, owner: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Rank of each symbol (or those ``at``) with the next of the same piece."""
        at = np.arange(len(symbol)) if at is None else at
        after = np.minimum(at + 1, max(len(symbol) - 1, 0))
        same = (owner[after] == owner[at]) & (after != at)
        return np.where(same, self.rank(symbol[at], symbol[after]), FAR)


def counter(path: str, limit: int, cached: int = CACHED) -> Callable[[], Callable]:
    def start() -> Callable:
        merges = Merges(path)
        cut = regex.compile(PATTERN).findall
        special = regex.compile("|".join(map(regex.escape, merges.special))) if merges.special else None
        known: dict[str, int] = {}

        def make(texts: Sequence[bytes | None]) -> list[np.ndarray]:
            pieces, extra = [], np.zeros(len(texts), dtype=np.int64)
            for i, text in enumerate(texts):
                text = (text or b"").decode("utf-8", "replace")
                parts = special.split(text) if special else [text]
                extra[i] = len(parts) - 1
                pieces.append(cut(text) if len(parts) == 1 else list(chain.from_iterable(map(cut, parts))))
            if len(known) > cached:
                known.clear()
            new = [p for p in set(chain.from_iterable(pieces)) if p not in known]
            if new:
                known.update(zip(new, merges.count([p.encode() for p in new]).tolist(), strict=True))
            count = known.__getitem__
            tokens = extra + np.array([sum(map(count, p)) for p in pieces], dtype=np.int64)
            return [np.array([len(t or b"") for t in texts], dtype=np.int64), tokens, tokens > limit]

        return make

    return start


def token_counts(
    docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text", limit: int = 1024
) -> DataFrame:
    """UTF-8 bytes and tokens of every text by the vocabulary file ``path`` (on every executor), without a shuffle.

    Null and empty texts have 0 of both. Repeated rows each give a row, a null id stays null,
    other columns are not read, and an empty table gives no rows.
    """
    return per_text(docs, text, [id_column], FIELDS, counter(path, limit))
