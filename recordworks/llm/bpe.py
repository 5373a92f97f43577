"""Byte-level BPE encoding and decoding by backtracking over longest matches.

Bytes are mapped to Latin-1 characters, so that an Aho-Corasick automaton over the vocabulary finds the longest token at every place
of a piece in one pass; in a piece of up to SHORT bytes they are looked up where a token starts, which costs less than starting the automaton.  The encoder takes the longest token; when the token and the one before it would not stay apart under
the merges, it tries the next shorter prefix, and goes back a token when none is left.  A place from which no encoding goes on is
marked, so each is given up once and the work is linear.  Whether two adjacent tokens stay apart is decided by merging their
joint bytes once and is then remembered.

Defined results: null text counts as empty and has no tokens (the digests are those of the empty string).  Repeated rows are encoded
alike.  Very long pieces take linear time.  Other columns are carried; one with the name of a result column gives way to it.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .base import packed, small_batches, unpacked, whole

RESULTS = ["n_tokens", "ids_sha256", "decoded_sha256"]
PIECES = 500_000  # pieces a worker remembers
SHORT = 32


class Encoder:
    """Encodes bytes by a vocabulary of ranks (token bytes -> id, which is its merge priority)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self._sizes = {i: len(t) for t, i in ranks.items()}
        self._most: dict[bytes, int] = {}  # size of the longest token with these three bytes in front
        for token in ranks:
            if len(token) > 2:
                self._most[token[:3]] = max(len(token), self._most.get(token[:3], 0))
        self._automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, i in ranks.items():
            self._automaton.add_word(token.decode("latin-1"), i)
        self._automaton.make_automaton()
        self.apart = lru_cache(1 << 20)(self._apart)
        self._shorter: dict[int, int] = {}
        self._rims: dict[bytes, tuple] = {}

    def _merged(self, data: bytes, below: int = 1 << 60) -> list[bytes]:
        """The merges of rank under `below`, lowest first and leftmost first.  Only for the bytes of one or two tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _made(self, token: bytes) -> tuple[list[tuple[bytes, int]], list[tuple[bytes, int]], bool]:
        """The parts at the left and the right rim of a token, from the byte to the token, each with the rank at which the next one takes it
        up; and whether every part has a lower rank than what it is part of, so that merges go by time."""
        if token not in self._rims:
            if len(token) == 1:
                self._rims[token] = [(token, 1 << 60)], [(token, 1 << 60)], True
            else:
                rank = self.ranks[token]
                two = self._merged(token, rank)
                if len(two) != 2:
                    self._rims[token] = [], [], False
                else:
                    left, right = self._made(two[0]), self._made(two[1])
                    timely = left[2] and right[2] and max(self.ranks[two[0]], self.ranks[two[1]]) < rank
                    last = [(token, 1 << 60)]
                    self._rims[token] = (left[0][:-1] + [(two[0], rank)] + last, right[1][:-1] + [(two[1], rank)] + last, timely)
        return self._rims[token]

    def _apart(self, left: int, right: int) -> bool:
        """Whether no merge joins the two across their boundary.  At any time one part of each touches the boundary; the pair would merge
        if its rank came before either part is taken up inside its own token (at equal rank the left one of two merges goes first)."""
        a, b = self.tokens[left], self.tokens[right]
        x, y = self._made(a), self._made(b)
        if not (x[2] and y[2]):
            return self._merged(a + b) == [a, b]
        x, y, i, j = x[1], y[0], 0, 0
        while True:
            (p, p_end), (q, q_end) = x[i], y[j]
            rank = self.ranks.get(p + q, 1 << 60)
            if rank < p_end and rank <= q_end and rank != 1 << 60:
                return False
            if p_end == q_end == 1 << 60:
                return True
            if p_end <= q_end:
                i += 1
            else:
                j += 1

    def _prefix(self, token: int) -> int:
        """The longest token that is a proper prefix, or -1."""
        if token not in self._shorter:
            data = self.tokens[token]
            self._shorter[token] = next((self.ranks[data[:n]] for n in range(len(data) - 1, 0, -1) if data[:n] in self.ranks), -1)
        return self._shorter[token]

    def _longest(self, piece: bytes, at: int) -> int:
        """The longest token at a place."""
        get, end = self.ranks.get, min(len(piece), at + self._most.get(piece[at : at + 3], 2))
        while (token := get(piece[at:end])) is None:
            end -= 1
        return token

    def encode(self, piece: bytes) -> list[int]:
        if piece in self.ranks:
            return [self.ranks[piece]]
        n = len(piece)
        sizes, apart = self._sizes, self.apart
        longest = None
        if n > SHORT:
            longest = [0] * n
            for end, token in self._automaton.iter(piece.decode("latin-1")):  # longer tokens at a start end later
                longest[end + 1 - sizes[token]] = token
        open_at = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, last, token = 0, -1, -1 if not n else longest[0] if longest else self._longest(piece, 0)
        while at < n:
            end = at + sizes[token]
            if open_at[end] and (last < 0 or apart(last, token)):
                out.append(token)
                at, last = end, token
                if at < n:
                    token = longest[at] if longest else self._longest(piece, at)
                continue
            token = self._prefix(token)
            if token < 0:  # no token from here fits the one before: back to it, and shorten it
                open_at[at] = 0
                token = out.pop()
                at -= sizes[token]
                last = out[-1] if out else -1
        return out


class _Pieces(dict):
    """piece -> its ids in decimal, joined by spaces, and the bytes that these ids decode to.  Forgets everything when full."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self._encoder = encoder

    def __missing__(self, piece: str) -> tuple[str, bytes]:
        ids = self._encoder.encode(piece.encode("utf-8"))
        found = " ".join(map(str, ids)), b"".join([self._encoder.tokens[i] for i in ids])
        if len(piece) <= 64:
            if len(self) >= PIECES:
                self.clear()
            self[piece] = found
        return found


_CLASSES = {r"\p{L}", r"\p{N}", r"\s", r"\S"}


def plain_pattern(pattern: str) -> re.Pattern | None:
    """The same pattern for `re`, which is about twice as fast, with its classes written out as `regex` has them below U+10000; None when it has
    more than letters, numbers and spaces.  Only for texts of that plane."""
    plane = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    ranges = {}
    for name in _CLASSES - {r"\S"}:
        runs: list[list[int]] = []
        for code in map(ord, regex.findall(name, plane, flags=regex.V1)):
            if runs and runs[-1][1] == code - 1:
                runs[-1][1] = code
            else:
                runs.append([code, code])
        ranges[name] = "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in runs)
    out, inside = [], False
    for part in re.findall(r"\\p\{\w+\}|\\.|\[\^?|\]|&&|--|\|\||~~|\(\?.|.", pattern, flags=re.DOTALL):
        if part in _CLASSES and not (inside and part == r"\S"):
            body = ranges[part.lower() if part == r"\S" else part]
            out.append(body if inside else f"[^{body}]" if part == r"\S" else f"[{body}]")
        elif part[0] == "\\" or (part[0] == "[" and inside) or part in ("&&", "--", "||", "~~") or (part[:2] == "(?" and part not in ("(?!", "(?=", "(?:")):
            return None
        else:
            inside = part[0] == "[" or (inside and part != "]")
            out.append(part)
    return re.compile("".join(out))


@lru_cache(2)
def _codec(lines: bytes, pattern: str):
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines())}
    whole_range, plain = regex.compile(pattern, flags=regex.V1), plain_pattern(pattern)

    def split(text: str) -> list[str]:
        return (plain if plain and len(text.encode("utf-16-le")) == 2 * len(text) else whole_range).findall(text)

    pieces = _Pieces(Encoder(ranks))
    return pieces, pieces._encoder.tokens, split


def encode_text(text: str, pieces: _Pieces, split) -> str:
    return coded(text, pieces, split)[0]


def coded(text: str, pieces: _Pieces, split) -> tuple[str, bytes]:
    """(ids in decimal, joined by spaces; the bytes they decode to)"""
    found = [pieces[p] for p in split(text)]
    return " ".join([ids for ids, _ in found]), b"".join([data for _, data in found])


def encoded(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", carry: list[str] | None = None, with_ids: bool = False) -> DataFrame:
    """Each row with the number of its tokens, the SHA-256 of the ids (decimal, joined by spaces) and of the bytes they decode to.
    `vocabulary` is the path of a rank file, read once on the driver (a file of bounded size); `with_ids` adds the ids as text."""
    small_batches(docs.sparkSession)
    with open(vocabulary, "rb") as file:
        lines = docs.sparkSession.sparkContext.broadcast(file.read())
    rows = docs.select(packed(docs, carry).alias("row"), whole(text).alias("text"))
    results = RESULTS + ["ids"] * with_ids
    schema = T.StructType([rows.schema["row"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
                           T.StructField("decoded_sha256", T.StringType())] + [T.StructField("ids", T.StringType())] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, _, splitter = _codec(lines.value, pattern)
        for batch in batches:
            counts, digests, decoded, texts = [], [], [], []
            for value in batch.column("text"):
                ids, data = coded(value.as_py(), pieces, splitter)
                counts.append(ids.count(" ") + 1 if ids else 0)
                digests.append(hashlib.sha256(ids.encode()).hexdigest())
                decoded.append(hashlib.sha256(data).hexdigest())
                if with_ids:
                    texts.append(ids)
            columns = [batch.column("row"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(texts, pa.string())] * with_ids, names=["row", *results])

    return unpacked(rows.mapInArrow(run, schema), "row", docs.columns if carry is None else carry, results)
