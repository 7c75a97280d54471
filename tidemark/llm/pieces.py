"""SentencePiece encoding and decoding (BPE models with byte fallback) by suffix-array matching."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.texts import arrow, per_text

SPACE = "▁"
FAR = np.iinfo(np.int64).max
CACHED = 400_000
BATCH_CHARS = 1 << 19
SLOTS = 1 << 20


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, .. for each run, one run after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Pieces:
    """Vocabulary arrays. Ranks tell in which order merges come; single characters have rank -1."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        text = [model.id_to_piece(i) for i in range(size)]
        usual = [
            not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))
            for i in range(size)
        ]
        self.size = size
        self.ids = {text[i]: i for i in range(size) if usual[i]}
        self.byte = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int64)
        if any(model.id_to_piece(int(i)) != f"<0x{b:02X}>" for b, i in enumerate(self.byte)):
            raise ValueError("the model has no byte fallback")
        self.out = [b""] * size
        for piece, i in self.ids.items():
            self.out[i] = piece.replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte):
            self.out[i] = bytes([b])
        self.longest = max(map(len, self.ids))
        self.rank = np.full(size + 1, -1, dtype=np.int64)  # the last is for characters without a piece
        merged = sorted((i for p, i in self.ids.items() if len(p) > 1), key=lambda i: (-model.get_score(i), i))
        self.rank[merged] = np.arange(len(merged))
        self.left, self.right = np.full(size + 1, -1, dtype=np.int64), np.full(size + 1, -1, dtype=np.int64)
        splits = [
            (len(p), i, self.ids[p[:k]], self.ids[p[k:]])
            for p, i in self.ids.items()
            for k in range(1, len(p))
            if p[:k] in self.ids and p[k:] in self.ids
        ]
        table = np.array(splits, dtype=np.int64).reshape(-1, 4)
        key = table[:, 2] * (size + 1) + table[:, 3]
        order = np.argsort(key)
        self.keys, self.key_rank = key[order], self.rank[table[order, 1]]
        # How each piece comes about: of its splits, the one whose halves stay apart until its own merge.
        reached = np.zeros(size + 1, dtype=bool)
        reached[[i for p, i in self.ids.items() if len(p) == 1]] = True
        for length in range(2, self.longest + 1):
            part = table[table[:, 0] == length]
            part = part[reached[part[:, 2]] & reached[part[:, 3]]]
            part = part[self.apart(part[:, 2], part[:, 3], self.rank[part[:, 1]])]
            self.left[part[:, 1]], self.right[part[:, 1]] = part[:, 2], part[:, 3]
            reached[part[:, 1]] = True
        known = [(p, i) for p, i in self.ids.items() if reached[i]]
        self.known = np.array([i for _, i in known], dtype=np.int32)
        self.lengths = np.array([len(p) for p, _ in known], dtype=np.int32)
        self.letters = np.zeros((len(known), self.longest), dtype=np.int64)
        for row, (p, _) in enumerate(known):
            self.letters[row, : len(p)] = [ord(c) for c in p]
        # Where no piece has a space mark after another character, texts fall apart at these places.
        crossing = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        self.cut = re.compile(r"(?s).+" if crossing else f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self.tested, self.answer = np.full(SLOTS, -1, dtype=np.int64), np.zeros(SLOTS, dtype=bool)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * (self.size + 1) + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_rank[at], FAR)

    def apart(self, left: np.ndarray, right: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Whether no merge of rank below ``limit`` joins the two while they are made.

        Merges are undone, the latest first; at each step the two symbols at the border must not have
        had a merge that came before the one undone.
        """
        ok = np.ones(len(left), dtype=bool)
        at = np.arange(len(left))
        left, right, limit = left.copy(), right.copy(), limit.copy()
        while len(at):
            joined = self.pair_rank(left, right) < limit
            ok[at[joined]] = False
            one, two = self.rank[left], self.rank[right]
            go = ~joined & (np.maximum(one, two) >= 0)
            at, left, right, one, two = at[go], left[go], right[go], one[go], two[go]
            first = one > two
            # Of equal merges the left comes first, so that one at the border came before a right one.
            limit = np.where(first, one, two + 1)
            left, right = np.where(first, self.right[left], left), np.where(first, right, self.left[right])
        return ok

    def follow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """apart() without a limit, with the answers kept in a table of fixed size."""
        key = left.astype(np.int64) * (self.size + 1) + right
        slot = (key * 0x9E3779B1 >> 7) & (SLOTS - 1)
        new = self.tested[slot] != key
        if new.any():
            fresh = np.unique(key[new])
            a, b = fresh // (self.size + 1), fresh % (self.size + 1)
            where = (fresh * 0x9E3779B1 >> 7) & (SLOTS - 1)
            answers = self.apart(a, b, np.full(len(fresh), FAR))
            _, one = np.unique(where, return_index=True)
            self.tested[where[one]], self.answer[where[one]] = fresh[one], answers[one]
            out = self.answer[slot]
            lost = np.flatnonzero(self.tested[slot] != key)  # another new pair took the slot
            out[lost] = self.apart(left[lost], right[lost], np.full(len(lost), FAR))
            return out
        return self.answer[slot]

    def edges(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and row of every occurrence of a piece in the letters (0 stands between chunks)."""
        n, width = len(letters), self.longest
        order = np.unique(letters)
        rank = np.searchsorted(order, letters)
        step = 1
        while step < width:
            ahead = np.concatenate([rank[step:], np.full(min(step, n), -1)]) + 1
            _, rank = np.unique(rank * (n + 2) + ahead, return_inverse=True)
            step *= 2
        suffixes = np.argsort(rank, kind="stable")
        held = np.flatnonzero(np.isin(self.letters[:, 0], order))
        held = held[(np.isin(self.letters[held], order) | (self.letters[held] == 0)).all(axis=1)]
        padded = np.concatenate([letters, np.zeros(width, dtype=letters.dtype)])
        want, length = self.letters[held], self.lengths[held]
        inside = np.arange(width) < length[:, None]

        def bound(after: bool) -> np.ndarray:
            low, high = np.zeros(len(held), dtype=np.int64), np.full(len(held), n)
            while (low < high).any():
                mid = np.minimum((low + high) // 2, n - 1)
                seen = padded[suffixes[mid][:, None] + np.arange(width)]
                differ = (seen != want) & inside
                at = np.argmax(differ, axis=1)
                rows = np.arange(len(held))
                some = differ[rows, at]
                less = np.where(some, seen[rows, at] < want[rows, at], after) & (low < high)
                low, high = np.where(less, mid + 1, low), np.where(less | (low >= high), high, mid)
            return low

        first, last = bound(False), bound(True)
        places = suffixes[ragged(first, last - first)].astype(np.int32)
        return places, np.repeat(held.astype(np.int32), last - first)

    def encode(self, chunks: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks after one another, and how many each has.

        Edges are taken in the order of their ends, counted from the start of their chunk, for all chunks
        at once. BPE's result for the part up to an end is the one that ends in the piece which stays apart
        from the last piece of the part up to its start.
        """
        sizes = np.array([len(c) for c in chunks], dtype=np.int64)
        letters = np.frombuffer("\0".join(chunks).encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.int64)
        begin = np.cumsum(sizes + 1) - sizes - 1
        own = ragged(begin, sizes)  # a chunk may hold U+0000 itself
        letters = letters + 1
        gaps = np.ones(len(letters), dtype=bool)
        gaps[own] = False
        letters[gaps] = 0
        offset = np.zeros(len(letters) + 1, dtype=np.int32)
        offset[own] = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        place, row = self.edges(letters)
        token, length = self.known[row], self.lengths[row]
        del row
        single = np.zeros(len(letters), dtype=bool)
        single[place[length == 1]] = True
        bare = own[~single[own]].astype(np.int32)  # characters without a piece
        place = np.concatenate([place, bare])
        token = np.concatenate([token, np.full(len(bare), self.size, dtype=np.int32)])
        length = np.concatenate([length, np.ones(len(bare), dtype=np.int32)])
        ends = offset[place] + length
        order = np.argsort(ends, kind="stable").astype(np.int32)
        place, token, length, ends = place[order], token[order], length[order], ends[order]
        last = np.full(len(letters) + 1, -1, dtype=np.int64)
        back = np.zeros(len(letters) + 1, dtype=np.int64)
        cuts = np.flatnonzero(np.diff(ends, prepend=0, append=0))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            start, t = place[a:b], token[a:b]
            free = offset[start] == 0
            before = np.where(free, self.size, last[start])
            good = free | (before == self.size) | (t == self.size)
            some = np.flatnonzero(~good)
            good[some] = self.follow(before[some], t[some])
            end = start[good] + length[a:b][good]
            last[end], back[end] = t[good], start[good]
        # Walk back from the ends of all chunks at once.
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        at, chunk = begin + sizes, np.arange(len(chunks))
        while len(at):
            live = at > begin[chunk]
            at, chunk = at[live], chunk[live]
            steps.append((chunk, at))
            at = back[at]
        chunk = np.concatenate([s[0] for s in steps]) if steps else np.zeros(0, dtype=np.int64)
        end = np.concatenate([s[1] for s in steps]) if steps else np.zeros(0, dtype=np.int64)
        order = np.lexsort((end, chunk))
        chunk, end = chunk[order], end[order]
        ids = last[end]
        if (ids == self.size).any():
            raw = [
                self.byte[np.frombuffer(chr(letters[e - 1] - 1).encode("utf-8", "replace"), dtype=np.uint8)]
                for e in end[ids == self.size]
            ]
            many = np.ones(len(ids), dtype=np.int64)
            many[ids == self.size] = [len(r) for r in raw]
            plain = np.repeat(ids, many)
            plain[plain == self.size] = np.concatenate(raw)
            ids, chunk = plain, np.repeat(chunk, many)
        return ids, np.bincount(chunk, minlength=len(chunks))


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """Read once per Python worker."""
    made = Pieces(path)
    made.letters[made.letters > 0] += 1  # as encode() counts them
    return made


class Encoder:
    """Encodes lists of texts; chunks seen before are kept, in arrays of bounded size."""

    def __init__(self, path: str):
        self.pieces = pieces(path)
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.start, self.many = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def __call__(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts after one another, and the number of each text's."""
        if len(self.number) > CACHED:
            self.clear()
        cut = [self.pieces.cut((SPACE + t).replace(" ", SPACE)) if t else [] for t in texts]
        new = [c for c in set(chain.from_iterable(cut)) if c not in self.number]
        new.sort(key=len)  # chunks of like length take like numbers of steps
        at, held = 0, 0
        for i, c in enumerate(new):
            held += len(c) + 1
            if held > BATCH_CHARS or i == len(new) - 1:
                self.learn(new[at : i + 1])
                at, held = i + 1, 0
        ids, start, many = (self.joined(x) for x in (self.ids, self.start, self.many))
        sizes = np.array([len(c) for c in cut], dtype=np.int64)
        number = np.fromiter(map(self.number.__getitem__, chain.from_iterable(cut)), np.int64, int(sizes.sum()))
        ends = np.concatenate([[0], np.cumsum(many[number])])[np.cumsum(sizes)]
        return ids[ragged(start[number], many[number])], np.diff(ends, prepend=0)

    def learn(self, chunks: list[str]) -> None:
        ids, many = self.pieces.encode(chunks)
        base = sum(map(len, self.ids))
        self.number.update(zip(chunks, range(len(self.number), len(self.number) + len(chunks)), strict=True))
        self.ids.append(ids), self.many.append(many), self.start.append(base + np.cumsum(many) - many)

    @staticmethod
    def joined(parts: list[np.ndarray]) -> np.ndarray:
        parts[:] = [np.concatenate(parts)]
        return parts[0]


def lists(ids: np.ndarray, many: np.ndarray, null: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(many)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, ids.astype(np.int32), mask=pa.array(null))


ENCODED = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_ids", T.LongType())])


def encoder(path: str) -> Callable[[], Callable]:
    def start() -> Callable:
        encode = Encoder(path)

        def make(texts: Sequence[bytes | None]) -> list[pa.Array]:
            ids, many = encode([(t or b"").decode("utf-8", "replace") for t in texts])
            null = np.array([t is None for t in texts], dtype=bool)
            return [lists(ids, many, null), pa.array(many, mask=null)]

        return make

    return start


def encode_texts(docs: DataFrame, path: str, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """Columns ``keep``, ids and n_ids of every whole text, as the model file ``path`` encodes it; no shuffle.

    Null texts give null ids and a null n_ids, empty ones an empty list. Repeated rows each give a row,
    a null id stays null, and an empty table gives no rows.
    """
    return per_text(docs, text, list(keep), ENCODED, encoder(path))


def decoder(path: str) -> Callable[[np.ndarray, np.ndarray], list[str]]:
    """A function from the ids of lists after one another, and their lengths, to texts."""
    model = pieces(path)
    size = np.array([len(o) for o in model.out] + [0], dtype=np.int64)
    flat = np.frombuffer(b"".join(model.out), dtype=np.uint8)
    begin = np.cumsum(size) - size

    def decode(ids: np.ndarray, many: np.ndarray) -> list[str]:
        ends = np.concatenate([[0], np.cumsum(size[ids])])[np.concatenate([[0], np.cumsum(many)])]
        raw = flat[ragged(begin[ids], size[ids])].tobytes()
        # The mark put before a text is a space at first.
        parts = (raw[a:b].removeprefix(b" ") for a, b in zip(ends[:-1], ends[1:], strict=True))
        return [part.decode("utf-8", "replace") for part in parts]

    return decode


def decode_ids(encoded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns of ``encoded``, and the text ``out`` of its lists of ids.

    The mark put before the text is taken off again, bytes are joined to characters (those that make none
    become U+FFFD), and control ids stand for nothing. Null lists give null; null ids in a list count as
    control ids.
    """
    schema = T.StructType([*encoded.schema.fields, T.StructField(out, T.StringType())])
    at = encoded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = decoder(path)
        control = pieces(path).size
        for batch in batches:
            column = batch.columns[at]
            flat = column.flatten().fill_null(control).to_numpy(zero_copy_only=False).astype(np.int64)
            many = np.array([n or 0 for n in column.value_lengths().to_pylist()], dtype=np.int64)
            texts = pa.array(decode(flat, many), pa.string(), mask=column.is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=schema.names)

    return arrow(encoded, run, schema)


DECODED = T.StructType(
    [*ENCODED.fields, T.StructField("decoded", T.StringType()), T.StructField("same", T.BooleanType())]
)


def round_trip(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids of every whole text, the text decoded from them, and whether both texts are equal; no shuffle.

    Null texts give nulls, empty ones an empty list and text. Repeated rows each give a row, a null id stays
    null, other columns are not read, and an empty table gives no rows.
    """

    def start() -> Callable:
        encode, decode = Encoder(path), decoder(path)

        def make(texts: Sequence[bytes | None]) -> list[pa.Array]:
            plain = [(t or b"").decode("utf-8", "replace") for t in texts]
            ids, many = encode(plain)
            back = decode(ids, many)
            null = np.array([t is None for t in texts], dtype=bool)
            same = np.array([a == b for a, b in zip(plain, back, strict=True)], dtype=bool)
            return [
                lists(ids, many, null), pa.array(many, mask=null), pa.array(back, pa.string(), mask=null),
                pa.array(same, mask=null),
            ]

        return make

    return per_text(docs, text, [id_column], DECODED, start)
