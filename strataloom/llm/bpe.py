"""Encoding with a public byte-level BPE as a streaming transducer, and its inverse.

Inside a piece the encoder never looks at the merges again from the start: of every prefix it knows the last token
of its encoding (the one token that ends there and forms a valid pair with the last token of the prefix before it).
An encoding of any continuation passes through one of the last ``longest`` prefixes, so tokens on which all of
their encodings agree are stable and leave at once; memory is bounded by the merge list, not by the text.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.session import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs that may go on beyond a chunk: what continues a piece that ended at the chunk's end.
RUNS = (r"\p{L}+", r"\p{N}+", r"[^\s\p{L}\p{N}]+")
HELD = 4096
CACHE = 200_000


def merge_piece(ranks: dict[bytes, int], piece: bytes) -> list[bytes]:
    """The merge list applied from the start, lowest rank first. Only for token pairs (short) and as a check in tests."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Vocabulary:
    """Ranks, the suffixes of tokens (to stop early) and the pairs of tokens known to stay apart."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = {v: k for k, v in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.suffixes = {t[i:] for t in self.ranks for i in range(len(t))}
        self._pairs: dict[tuple[bytes, bytes], bool] = {}
        self.bound = self.lookahead()

    def lookahead(self) -> int:
        """The merge list's sufficient lookahead in bytes: a token that many bytes back is stable, as every unsettled
        token needs another merge that a later byte can still take away, and each reaches a token's length further.
        Emission does not wait for it but leaves as soon as the prefixes in reach agree; that they agree within it is
        checked, so what the encoder holds is bounded by the merge list alone."""
        merges = sum(len(t) > 1 for t in self.ranks)
        return merges * self.longest

    def apart(self, a: bytes, b: bytes) -> bool:
        """Whether the encoding of ``a + b`` is just these two tokens."""
        key = (a, b)
        got = self._pairs.get(key)
        if got is None:
            if len(self._pairs) > 4 * CACHE:
                self._pairs.clear()
            got = self._pairs[key] = merge_piece(self.ranks, a + b) == [a, b]
        return got


class Transducer:
    """Encodes one piece given in parts. ``feed`` and ``finish`` return ids as soon as they are stable."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.start()

    def start(self) -> None:
        self.window = b""  # the last bytes, at most twice the longest token
        self.base = 0  # position of window[0]
        self.last: list[bytes] = []  # last token of the prefix that ends after window[i]
        self.sent = 0  # position up to which tokens have left

    def feed(self, data: bytes) -> list[int]:
        v, out = self.v, []
        for at in range(0, len(data), 512):
            self._extend(data[at : at + 512])
            if len(self.window) > 2 * v.longest:
                out += self._stable()
        return out

    def _extend(self, data: bytes) -> None:
        ranks, suffixes, apart = self.v.ranks, self.v.suffixes, self.v.apart
        w, last = self.window + data, self.last
        for end in range(len(self.window) + 1, len(w) + 1):
            found = None
            i = end - 1
            while i >= 0:
                t = w[i:end]
                if t not in suffixes:
                    break
                if t in ranks and ((i == 0 and self.base == 0) or (i > 0 and last[i - 1] is not None and apart(last[i - 1], t))):
                    found = t
                    break
                i -= 1
            if found is None:
                raise ValueError("no encoding")  # cannot happen with all 256 bytes in the vocabulary
            last.append(found)
        self.window = w

    def _stable(self) -> list[int]:
        """Emits the tokens that the encodings of all prefixes in reach agree on, then forgets their bytes."""
        last, n = self.last, len(self.window)
        ends = set(range(max(1, n - self.v.longest + 1), n + 1))
        while len(ends) > 1:
            e = max(ends)
            ends.discard(e)
            ends.add(e - len(last[e - 1]))
        common = ends.pop()
        if n - common > self.v.bound:
            raise ValueError("unsettled beyond the sufficient lookahead")
        if common + self.base <= self.sent:
            return []
        out = self._walk(common)
        self.sent = self.base + common
        cut = max(0, common - self.v.longest)
        self.window, self.last, self.base = self.window[cut:], last[cut:], self.base + cut
        return out

    def _walk(self, end: int) -> list[int]:
        out = []
        while end + self.base > self.sent:
            t = self.last[end - 1]
            out.append(self.v.ranks[t])
            end -= len(t)
        return out[::-1]

    def finish(self) -> list[int]:
        out = self._walk(len(self.window)) if self.window else []
        self.start()
        return out


class Encoder:
    """Encodes a text given in chunks of any size: ``feed`` and ``finish`` return ids; the text need never be held whole."""

    def __init__(self, vocabulary: Vocabulary, pattern: str = PATTERN):
        import regex

        self.t = Transducer(vocabulary)
        self.cache: dict[str, tuple[int, ...]] = {}
        self.pattern = regex.compile(pattern)
        self.runs = [regex.compile(r) for r in RUNS]
        self.space = regex.compile(r"\s+")
        self.rest, self.open = "", None

    def piece(self, p: str) -> tuple[int, ...]:
        got = self.cache.get(p)
        if got is None:
            b = p.encode("utf-8")
            got = (*self.t.feed(b), *self.t.finish())
            if len(p) <= 64:
                if len(self.cache) >= CACHE:
                    self.cache.clear()
                self.cache[p] = got
        return got

    def feed(self, chunk: str) -> list[int]:
        buf, out = self.rest + chunk, []
        self.rest = ""
        if self.open is not None:
            out, buf = self._go_on(buf)
            if self.open is not None or not buf:
                return out
        n, piece = len(buf), self.piece
        for m in self.pattern.finditer(buf):
            if m.end() < n - 3:
                out += piece(m.group())
                continue
            self.rest = buf[m.start() :]
            if len(self.rest) > HELD:
                out += self._open()
            break
        return out

    def _open(self) -> list[int]:
        """A piece longer than ``HELD`` characters: its bytes go to the transducer as they come."""
        p = self.rest
        if self.space.fullmatch(p):
            self.open = self.space
            self.rest = p[-1]
            return self.t.feed(p[:-1].encode("utf-8"))
        body = p[1:] if p[0] == " " else p
        for r in self.runs:
            m = r.fullmatch(body)
            if m:
                self.open, self.rest = r, ""
                return self.t.feed(p.encode("utf-8"))
        return []

    def _go_on(self, buf: str) -> tuple[list[int], str]:
        if self.open is self.space:
            m = self.space.match(buf)
            if m.end() == len(buf):  # all white space so far; the last one may yet begin another piece
                self.rest = buf[-1]
                return self.t.feed(buf[:-1].encode("utf-8")), ""
            out = self.t.feed(buf[: m.end() - 1].encode("utf-8")) + self.t.finish()
            self.open = None
            return out, buf[m.end() - 1 :]
        m = self.open.match(buf)
        end = m.end() if m else 0
        out = self.t.feed(buf[:end].encode("utf-8")) if end else []
        if end < len(buf):
            out += self.t.finish()
            self.open = None
        return out, buf[end:]

    def finish(self) -> list[int]:
        out = []
        if self.open is not None:
            out = self.t.feed(self.rest.encode("utf-8")) + self.t.finish()
        else:
            for m in self.pattern.finditer(self.rest):
                out += self.piece(m.group())
        self.rest, self.open = "", None
        return out

    def encode(self, text: str, chunk: int = 1 << 16) -> list[int]:
        if len(text) <= chunk:  # one chunk: nothing can come after it
            out: list[int] = []
            piece = self.piece
            for p in self.pattern.findall(text):
                out += piece(p)
            return out
        out = []
        for at in range(0, len(text), chunk):
            out += self.feed(text[at : at + chunk])
        return out + self.finish()


class Decoder:
    """Ids to text, incrementally: bytes of a character that is not yet complete wait in the state machine."""

    def __init__(self, vocabulary: Vocabulary, errors: str = "strict"):
        self.v = vocabulary
        self.machine = codecs.getincrementaldecoder("utf-8")(errors)

    def feed(self, ids: Iterable[int]) -> str:
        return self.machine.decode(b"".join(self.v.tokens[i] for i in ids))

    def finish(self) -> str:
        return self.machine.decode(b"", True)

    def decode(self, ids: Iterable[int]) -> str:
        return self.feed(ids) + self.finish()


@lru_cache(4)
def encoder(path: str) -> Encoder:
    """One encoder per worker and vocabulary; its caches are bounded."""
    return Encoder(Vocabulary(path))


def encode_column(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``key, ids``: every text's token ids without special tokens, one row per input row.

    Empty and null texts give an empty list; texts that look like special tokens are ordinary text. Whole texts are
    encoded, however long. Only the two columns are read, so others cannot clash.
    """
    schema = T.StructType([df.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from pyspark.sql.pandas.types import to_arrow_schema

        out, enc = to_arrow_schema(schema), encoder(vocabulary)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                flat: list[int] = []
                ends = [0]
                for t in part.column(1).to_pylist():
                    if t:
                        flat += enc.encode(t)
                    ends.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.array(flat, np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), ids.cast(out.field(1).type)], schema=out)

    return spread(df.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("__t"))).mapInArrow(run, schema)


def count_column(df: DataFrame, keep: list[str], text: str, column: str = "tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """The kept columns and each text's number of tokens (0 for empty and null)."""
    schema = T.StructType([*(df.schema[k] for k in keep), T.StructField(column, T.LongType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from pyspark.sql.pandas.types import to_arrow_schema

        out, enc = to_arrow_schema(schema), encoder(vocabulary)
        for b in batches:
            n = [len(enc.encode(t)) if t else 0 for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(n, pa.int64())], schema=out)

    return spread(df.select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{text}`").alias("__t"))).mapInArrow(run, schema)


def decode_column(df: DataFrame, key: str, ids: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``key, text``: the texts of id lists (null and empty lists give the empty text)."""
    schema = T.StructType([df.schema[key], T.StructField("text", T.StringType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from pyspark.sql.pandas.types import to_arrow_schema

        out, v = to_arrow_schema(schema), encoder(vocabulary).t.v
        for b in batches:
            text = [Decoder(v, "replace").decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], schema=out)

    return df.select(F.col(f"`{key}`"), F.col(f"`{ids}`")).mapInArrow(run, schema)
