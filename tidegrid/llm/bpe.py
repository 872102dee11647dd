"""Byte-level BPE encoding and decoding by prefix dynamic programming.

A token sequence is the encoding of its bytes exactly if each token alone and each two neighbours encode to themselves. So every prefix of a piece
has one valid last token: the one that ends it and fits behind the last token of the prefix before it. A table of these last tokens gives the
encoding of every prefix, takes exact appends, and after an edit needs new entries only from the edit to where old and new last tokens agree again.

Texts are cut into pieces by the tokenizer's pattern; a piece that is a token is that token, any other one goes through the table. The tokens that end
at each byte come from an automaton over the vocabulary, the longest first. Each worker keeps the ids of the chunks (words with the space before them)
that it has seen lately, at most twice CHUNKS of them. Texts are taken in blocks, so a long one needs little memory. The vocabulary's path is a parameter that each task resolves: a file's path, or the name of a public tokenizer's file.

Edge cases: null and empty texts have no tokens and decode to no bytes; special tokens in texts are ordinary text; a null id is carried through;
repeated rows give one result row each; an empty table gives an empty result; columns that aren't kept are ignored, clashing names included.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: New entries of a worker's table of chunks after which those not asked for again go: twice as many are held.
CHUNKS = 400_000
#: Entries after which a worker's table of token pairs starts anew.
PAIRS = 250_000
#: Ranks are below 2 ** RANK_BITS: two of them make a key.
RANK_BITS = 24
BLOCK = 1 << 18
#: A rank above all.
NEVER = 1 << 40
#: Two white characters in a row: where there are none, every space starts a new piece.
DOUBLE = re.compile(r"\s\s")
SAFE = re.compile(r"(?<=\S) (?=\S)")


class Recent(dict):
    """A table of bounded size: of the entries before the last `size` new ones those asked for again stay. Unknown keys give None."""

    def __init__(self, size: int) -> None:
        self.size, self.old = size, {}

    def put(self, key, value):
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value

    def __missing__(self, key):
        value = self.old.get(key)
        return value if value is None else self.put(key, value)


class Vocabulary:
    """The ranks of a tokenizer and what follows from them."""

    def __init__(self, path: str, pattern: str | None = None) -> None:
        import ahocorasick
        import public_tokenizers

        where = path if os.path.isabs(path) else public_tokenizers.path(path)
        with open(where, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern or public_tokenizers.PATTERN)
        self.longest = max(map(len, self.ranks))
        size = max(self.ranks.values()) + 1
        if size > 1 << RANK_BITS:
            raise ValueError("a vocabulary of too many tokens")
        by_id: list[bytes] = [b""] * size
        for token, rank in self.ranks.items():
            by_id[rank] = token
        self.tokens = by_id
        self.lengths = np.fromiter(map(len, by_id), np.int64, size)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self.sizes = self.lengths.tolist()
        #: Finds the tokens that end at each byte, the longest first.
        self.ends = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.ends.add_word(token.decode("latin-1"), rank)
        self.ends.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.histories: dict[int, tuple[list, list, list]] = {}
        self.spaced, self.plain = Chunks(self, " "), Chunks(self, "")

    def merged(self, data: bytes) -> list[bytes]:
        """BPE by its definition: merge the neighbours of lowest rank until no two make a token."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def history(self, token: int) -> tuple[list, list, list]:
        """Of a token's merges in order: their ranks (then one above all), and the first and the last part before each (then the token)."""
        known = self.histories.get(token)
        if known is None:
            whole = self.tokens[token]
            parts = [whole[i : i + 1] for i in range(len(whole))]
            order, first, last = [], [parts[0]], [parts[-1]]
            while len(parts) > 1:
                rank, at = min((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
                if rank == NEVER:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                order.append(rank)
                first.append(parts[0])
                last.append(parts[-1])
            known = self.histories[token] = ([*order, NEVER], first, last)
        return known

    def is_whole(self, token: int) -> bool:
        """Whether a token is what its own bytes encode to."""
        return self.history(token)[1][-1] == self.tokens[token]

    def fits(self, left: int, right: int) -> bool:
        """Whether the bytes of two tokens, of which the left one is what its bytes encode to, encode to just these two: the right one is what its bytes
        encode to as well, and no merge across the border is ever the next one."""
        (a, _, ends), (b, starts, _) = self.history(left), self.history(right)
        ranks, i, j, known = self.ranks, 0, 0, self.is_whole(right)
        while known:
            across = ranks.get(ends[i] + starts[j], NEVER)
            if across < a[i] and across <= b[j] and across < NEVER:
                known = False
            elif a[i] <= b[j]:
                if a[i] == NEVER:
                    break
                i += 1
            else:
                j += 1
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[left << RANK_BITS | right] = known
        return known


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str | None = None) -> Vocabulary:
    return Vocabulary(path, pattern)


class Prefixes:
    """The unique valid last token, by its id, of every prefix of some bytes, given by its length."""

    def __init__(self, words: Vocabulary, data: bytes = b"") -> None:
        self.words, self.data, self.last = words, b"", [-1]
        self.append(data)

    def _extend(self, stop: int) -> None:
        """Append the entries of the prefixes up to `stop` bytes."""
        last, words = self.last, self.words
        pair, sizes, done = words.pairs.get, words.sizes, len(self.last) - 1
        start = max(0, done + 1 - words.longest)
        for at, token in words.ends.iter(self.data[start:stop].decode("latin-1")):
            at += start
            if at != done:
                if at < done:
                    continue
                break
            first = at + 1 - sizes[token]
            if first:
                known = pair(last[first] << RANK_BITS | token)
                if known or known is None and words.fits(last[first], token):
                    last.append(token)
                    done += 1
            elif words.is_whole(token):
                last.append(token)
                done += 1
        if done < stop:
            raise ValueError("a byte of the text is no token")

    def append(self, data: bytes) -> None:
        """Exact: the entries of the old prefixes stay."""
        self.data += data
        self._extend(len(self.data))

    def replace(self, start: int, stop: int, data: bytes) -> int:
        """Put data in place of bytes start .. stop; the number of entries that had to be computed anew."""
        tail, shift = self.last[stop + 1 :], len(data) - (stop - start)
        self.data = self.data[:start] + data + self.data[stop:]
        self.last = self.last[: start + 1]
        same, new = 0, 0
        for end in range(start + 1, len(self.data) + 1):
            if same > self.words.longest:
                break
            self._extend(end)
            token, new = self.last[end], new + 1
            old = end - shift - stop - 1
            same = same + 1 if old >= 0 and tail[old] == token else 0
        else:
            return new
        # As many equal entries as the longest token has bytes: all later ones follow from these and stay.
        self.last += tail[len(self.last) - 1 - shift - stop :]
        return new

    def ids(self) -> list[int]:
        out, last, sizes, end = [], self.last, self.words.sizes, len(self.data)
        while end:
            token = last[end]
            out.append(token)
            end -= sizes[token]
        out.reverse()
        return out

    def tokens(self) -> list[bytes]:
        return [self.words.tokens[i] for i in self.ids()]


class Chunks(Recent):
    """The ids, as int32 bytes, of each chunk of text seen; lead: what stands before the chunk."""

    def __init__(self, words: Vocabulary, lead: str) -> None:
        super().__init__(CHUNKS)
        self.words, self.lead = words, lead

    def __missing__(self, chunk: str) -> bytes:
        return self.put(chunk, self.old.get(chunk) or self._ids(chunk))

    def _ids(self, chunk: str) -> bytes:
        words, whole = self.words, self.lead + chunk
        pieces = (whole,) if chunk.isalpha() else words.pattern.findall(whole)
        if len(pieces) > 1:
            # Words with marks behind them: the pieces have mostly been seen.
            return b"".join([words.spaced[p[1:]] if p[0] == " " else words.plain[p] for p in pieces])
        data = whole.encode()
        rank = words.ranks.get(data)
        ids = Prefixes(words, data).ids() if rank is None else (rank,)
        return pack(f"{len(ids)}i", *ids)


def blocks(text: str) -> Iterator[str]:
    """A text in blocks of some BLOCK characters, cut where a single space starts a new piece; uncut where there is no such space."""
    at = 0
    while len(text) - at > 2 * BLOCK and (m := SAFE.search(text, at + BLOCK)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


class Encoder:
    def __init__(self, words: Vocabulary) -> None:
        self.words, self.spaced, self.plain = words, words.spaced, words.plain

    def __call__(self, text: str | None) -> np.ndarray:
        out = []
        for block in blocks(text or ""):
            if not block:
                continue
            if DOUBLE.search(block) or block[-1].isspace() or block[0].isspace() and block[0] != " ":
                out += map(self.plain.__getitem__, self.plain.words.pattern.findall(block))
                continue
            first, *rest = block.split(" ")
            if first:
                out.append(self.plain[first])
            out += map(self.spaced.__getitem__, rest)
        return np.frombuffer(b"".join(out), np.int32)


def decode_ids(words: Vocabulary, ids: np.ndarray) -> bytes:
    sizes = words.lengths[ids]
    return words.bytes[np.repeat(words.starts[ids] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())].tobytes()


def _fields(df: DataFrame, keep: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keep)


def encode(df: DataFrame, keep: list[str], text_col: str = "text", path: str = VOCABULARY, decoded: bool = False) -> DataFrame:
    """The kept columns and token_ids, the ids of the text's tokens; if decoded, also the bytes that decoding these ids gives."""
    source = df.select(*keep, *([] if text_col in keep else [text_col]))

    def make():
        encoder = Encoder(vocabulary(path))

        def step(batch: pa.RecordBatch) -> dict:
            ids = [encoder(t) for t in batch.column(text_col).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)])
            values = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
            out = {c: batch.column(c) for c in keep} | {"token_ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)}
            return out | {"decoded": pa.array([decode_ids(encoder.words, x) for x in ids], pa.binary())} if decoded else out

        return step

    return map_texts(source, source.columns, text_col, f"{_fields(source, keep)}, token_ids array<int>{", decoded binary" * decoded}", make)


def decode(df: DataFrame, keep: list[str], path: str = VOCABULARY) -> DataFrame:
    """The kept columns and decoded, the bytes of token_ids (null: none)."""
    source = df.select(*keep, *([] if "token_ids" in keep else ["token_ids"]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                piece = batch.slice(start, 64)
                ids = [x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.zeros(0, np.int32) for x in piece.column("token_ids")]
                columns = {c: piece.column(c) for c in keep} | {"decoded": pa.array([decode_ids(words, x) for x in ids], pa.binary())}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return source.mapInArrow(task, f"{_fields(source, keep)}, decoded binary")


def op9_byte_bpe(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    done = encode(docs, ["doc_id"], decoded=True)
    ids = F.array_join(F.col("token_ids").cast("array<string>"), ",")
    return done.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op9_byte_bpe": op9_byte_bpe}
ORACLE_SQL: dict[str, str] = {}
