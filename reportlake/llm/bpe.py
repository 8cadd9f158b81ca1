"""BPE encoding and decoding by prefix-sharing trie traversal.

A text falls into chunks at every space that a non-space follows (a byte-level pre-tokenizer never joins across
such a place), and equal chunks have equal ids. The distinct new words of a batch form a trie, walked depth
first in sorted order: each node is a prefix whose state is the last token of the prefix's encoding, found from
the states above it - the one token t ending here for which (last token before t, t) is a pair that merging
leaves apart. States of shared prefixes are thus computed once, and the current path is all that is held. The
ids of a word are read off its path. A chunk of letters with signs at its end is the letters' ids, then the signs'
(the pre-tokenizer parts them), so that both are found once. Chunks seen before come from a table of bounded bytes (KEPT_BYTES, in two halves:
when the newer is full the older is given up), which a task frees when it ends.

Equal to the tokenizers library on the same file for byte-level BPE with its usual splitting pattern, special
tokens in the text included, add_special_tokens=False. Decoding concatenates the bytes of the tokens, invalid
UTF-8 replaced. The job is narrow: no shuffle.

Defined cases: a null text is the empty text, with no ids and the digest of nothing; very long texts are encoded
whole; repeated rows each get a row, a null doc_id stays null; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import string
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import trim

#: Fixed value: the byte-level splitting pattern of this family of tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORDS = regex.compile(PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
#: Finds every place that BREAK passes over (and more: a wider notion of white space).
LOOSE = re.compile(r" (?:\s|\Z)")
BREAK = regex.compile(r" (?=\P{White_Space})")
#: Bytes that the table of chunks may take, about: text, ids and what Python adds to each. The second is for tables
#: that outlive tasks (tokens.py).
KEPT_BYTES, LONG_KEPT_BYTES, ADDED = 64 << 20, 256 << 20, 190
#: Signs that the pre-tokenizer parts from letters before them.
SIGNS = string.punctuation
#: Pairs of tokens whose fit is remembered.
PAIRS = 300_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary, by its rule."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE file: ids by bytes, bytes by id, merges, special tokens."""

    def __init__(self, text: str):
        spec = json.loads(text)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("only byte-level BPE files without a normalizer are read")
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.id = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*self.id.values(), *self.special.values()])
        self.bytes = [b""] * size
        for t, i in self.id.items():
            self.bytes[i] = t
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        self.merge = {}
        made: dict[int, list[tuple[int, int, int]]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            a, b = raw(a), raw(b)
            self.merge[self.id[a], self.id[b]] = (rank, self.id[a + b])
            made.setdefault(self.id[a + b], []).append((self.id[a], self.id[b], rank))
        # Tokens by the one merge that makes them; where a file has several, or a part that is made later than the
        # whole, pairs are checked by merging them in full.
        self.made = {t: x[0] for t, x in made.items()}
        self.regular = all(len(x) == 1 for x in made.values()) and all(
            self.made[part][2] < rank for a, b, rank in self.made.values() for part in (a, b) if part in self.made
        )
        self._edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.longest = max(map(len, self.id))
        self._alone: dict[int, bool] = {}
        self._apart: dict[int, bool] = {}

    def merged(self, data: bytes) -> list[int]:
        """Plain BPE: merge the pair of least rank, leftmost first, until none is left."""
        ids = [self.id[data[i : i + 1]] for i in range(len(data))]
        while len(ids) > 1:
            rank, at = min((self.merge.get(p, (1 << 60,))[0], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)))
            if rank == 1 << 60:
                break
            ids[at : at + 2] = [self.merge[ids[at], ids[at + 1]][1]]
        return ids

    def alone(self, t: int) -> bool:
        """Whether the bytes of a token encode to that token."""
        if (x := self._alone.get(t)) is None:
            x = self._alone[t] = self.merged(self.bytes[t]) == [t]
        return x

    def apart(self, a: int, b: int) -> bool:
        """Whether the bytes of two tokens encode to those two."""
        key = a << 32 | b
        if (x := self._apart.get(key)) is None:
            if len(self._apart) > PAIRS:
                self._apart.clear()
            if self.regular and self.alone(a) and self.alone(b):
                x = self._untouched(a, b)
            else:
                x = self.merged(self.bytes[a] + self.bytes[b]) == [a, b]
            self._apart[key] = x
        return x

    def _edge(self, t: int, side: int) -> list[tuple[int, int]]:
        """What stands at the right (1) or left (0) end of a token while it is merged: (token, rank that ends it)."""
        if (x := self._edges.get((t, side))) is None:
            x, until = [], 1 << 60
            inner = t
            while True:
                x.append((inner, until))
                if inner not in self.made:
                    break
                until, inner = self.made[inner][2], self.made[inner][side]
            x.reverse()
            self._edges[t, side] = x
        return x

    def _untouched(self, a: int, b: int) -> bool:
        """Merges run in order of rank; whether none of them ever joins what stands on both sides of the border."""
        left, right = self._edge(a, 1), self._edge(b, 0)
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = left[i], right[j]
            rank = self.merge.get((x, y), (1 << 59,))[0]
            # At equal ranks the leftmost pair goes first: one inside a comes before the border, one inside b after.
            if rank < x_until and rank <= y_until:
                return rank == 1 << 59
            if x_until < y_until:
                i += 1
            elif y_until < x_until:
                j += 1
            elif x_until == 1 << 60:
                return True
            else:
                i, j = i + 1, j + 1

    def trie(self, words: list[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """Ids of distinct words in sorted order; each trie node (shared prefix) is visited once."""
        last: list[int] = []  # by node of the current path: last token of that prefix
        begins = [0]  # and where that token starts
        previous, get, apart, longest = b"", self.id.get, self._apart.get, self.longest
        for w in sorted(words):
            n, shared = len(w), 0
            most = min(len(previous), n)
            while shared < most and previous[shared] == w[shared]:
                shared += 1
            del last[shared:], begins[shared + 1 :]
            for end in range(shared + 1, n + 1):
                # One token fits; most often it starts where the last one did, or after that.
                from_ = begins[-1]
                for start in (*range(from_, end), *range(from_ - 1, max(0, end - longest) - 1, -1)):
                    t = get(w[start:end])
                    if t is not None:
                        if start:
                            fits = apart(last[start - 1] << 32 | t)
                            if fits is None:
                                fits = self.apart(last[start - 1], t)
                        else:
                            fits = self.alone(t)
                        if fits:
                            last.append(t)
                            begins.append(start)
                            break
                else:
                    raise ValueError(f"no token ends at byte {end} of {w!r}")
            out, end = [], n
            while end:
                out.append(last[end - 1])
                end = begins[end]
            yield w, out[::-1]
            previous = w


class Chunks:
    """Ids of texts, as little-endian unsigned 32-bit bytes, by way of distinct chunks.

    learn: ids of new chunks, given those that start a text and those that a space precedes (each with its space).
    """

    def __init__(self, special: dict[str, int], learn: Callable[[list[str], list[str]], tuple[list[bytes], list[bytes]]], most: int = KEPT_BYTES):
        self.special, self.learn, self.most = special, learn, most
        self.clear()

    def clear(self) -> None:
        """Forget all chunks."""
        self.older: dict[str, bytes] = {}
        self.newer: dict[str, bytes] = {}
        self.size = 0

    def keep(self, chunk: str, ids: bytes) -> None:
        """Put a chunk into the newer half; a chunk that alone would fill it is not kept."""
        size = len(chunk) + len(ids) + ADDED
        if size > self.most // 4:
            return
        if self.size + size > self.most // 2:
            self.older, self.newer, self.size = self.newer, {}, 0
        self.newer[chunk] = ids
        self.size += size

    def split(self, text: str) -> list[str]:
        return BREAK.split(text) if LOOSE.search(text) else text.split(" ")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of a few texts."""
        parts: list[list] = []
        first: dict[str, bytes] = {"": b""}
        later: dict[str, bytes] = {}
        for text in texts:
            runs: list = [text or ""]
            for s, i in self.special.items():
                runs = [y for x in runs for y in (self._around(x, s, i) if isinstance(x, str) and s in x else [x])]
            done: list = []
            for x in runs:
                if isinstance(x, str):
                    chunks = self.split(x)
                    first[chunks[0]] = b""
                    found = list(map(self.newer.get, chunks))
                    found[0] = b""
                    missing = [(k, chunks[k]) for k, y in enumerate(found) if y is None] if None in found else []
                    later.update(dict.fromkeys([c for _, c in missing], b""))
                    done.append((chunks[0], found, missing))
                else:
                    done.append(x)
            parts.append(done)
        known = self.newer.get
        again: dict[str, bytes] = {}
        new: dict[str, None] = {}
        ends: list[tuple[str, str, str]] = []
        for chunk in later:
            if (ids := self.older.get(chunk)) is not None:
                again[chunk] = ids
                continue
            stem = chunk.rstrip(SIGNS)
            if len(stem) == len(chunk) or not stem.isalpha():
                new[chunk] = None
                continue
            tail = chunk[len(stem) :]
            ends.append((chunk, stem, tail))
            first[tail] = b""
            if stem not in later and known(stem) is None:
                if (ids := self.older.get(stem)) is not None:
                    again[stem] = ids
                else:
                    new[stem] = None
        new_first, new_later = list(first), list(new)
        ids_first, ids_later = self.learn(new_first, new_later)
        first = dict(zip(new_first, ids_first, strict=True))
        found = again | dict(zip(new_later, ids_later, strict=True))
        for chunk, stem, tail in ends:
            found[chunk] = (found[stem] if stem in found else known(stem)) + first[tail]
        for chunk, ids in found.items():
            self.keep(chunk, ids)
        later = found
        out = []
        for done in parts:
            pieces: list[bytes] = []
            for x in done:
                if isinstance(x, bytes):
                    pieces.append(x)
                    continue
                head, found, missing = x
                found[0] = first[head]
                for k, chunk in missing:
                    found[k] = later[chunk]
                pieces.append(b"".join(found))
            out.append(b"".join(pieces))
        return out

    @staticmethod
    def _around(text: str, special: str, token: int) -> list:
        out: list = []
        for k, piece in enumerate(text.split(special)):
            if k:
                out.append(packed([token]))
            if piece:
                out.append(piece)
        return out


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def trie_chunks(vocabulary: Vocabulary) -> Chunks:
    """Chunks whose words are encoded by trie traversal."""

    def learn(first: list[str], later: list[str]) -> tuple[list[bytes], list[bytes]]:
        words = [[w.encode() for w in WORDS.findall(c)] for c in first] + [[w.encode() for w in WORDS.findall(" " + c)] for c in later]
        ids = {w: packed(x) for w, x in vocabulary.trie({w for x in words for w in x})}
        found = [ids[x[0]] if len(x) == 1 else b"".join([ids[w] for w in x]) for x in words]
        return found[: len(first)], found[len(first) :]

    return Chunks(vocabulary.special, learn)


def library_chunks(text: str) -> Chunks:
    """Chunks that the tokenizers library encodes: many at once, as one text whose ids are then divided by length."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(text)
    spec = json.loads(text)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    vocab = spec["model"]["vocab"]
    length = np.zeros(1 + max([*vocab.values(), *special.values()]), np.int64)
    for t, i in vocab.items():
        length[i] = len(t)  # a letter stands for each byte

    def learn(first: list[str], later: list[str]) -> tuple[list[bytes], list[bytes]]:
        out: list[bytes] = []
        for at in range(0, len(later), 20_000):
            some = later[at : at + 20_000]
            ids = np.array(tokenizer.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.cumsum(length[ids])
            borders = np.cumsum([len(x.encode()) + 1 for x in some])
            cut = np.searchsorted(ends, borders) + 1
            if len(ids) and not (ends[cut - 1] == borders).all():
                raise ValueError("a token crosses the border of chunks")
            data, cuts = ids.tobytes(), [0, *(4 * cut).tolist()]
            out += [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        return [packed(e.ids) for e in tokenizer.encode_batch_fast(first, add_special_tokens=False)], out

    return Chunks(special, learn, LONG_KEPT_BYTES)


_HELD: dict = {}


def freeing(chunks: Chunks, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's batches; after the last the table of chunks is freed, since idle workers keep what they hold."""
    yield from batches
    chunks.clear()
    trim()


def held(kind: str, text: str):
    """The worker's encoder for a vocabulary file, built once for each Python process (one file at a time)."""
    key = kind, hashlib.sha256(text.encode()).digest()
    if key not in _HELD:
        _HELD.clear()
        if kind == "trie":
            v = Vocabulary(text)
            _HELD[key] = v, trie_chunks(v)
        else:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            _HELD[key] = None, library_chunks(text)
    return _HELD[key]


def read_vocabulary(spark: SparkSession, path: str) -> str:
    """A vocabulary file's text (a few MB), from a local path or any store that Spark reads."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).first()["content"]).decode()
    with open(path, encoding="utf-8") as f:
        return f.read()


def groups(column: pa.Array, most: int = 1 << 20) -> Iterator[list[str | None]]:
    """Texts of a column, a few at a time: groups of about so many characters, single texts of any length."""
    now: list[str | None] = []
    size = 0
    for x in column:
        t = x.as_py()
        now.append(t)
        size += len(t or "") + 1
        if size >= most:
            yield now
            now, size = [], 0
    if now:
        yield now


def decode(ids: bytes, token_bytes: list[bytes]) -> str:
    return b"".join(map(token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def encode_column(docs: DataFrame, vocabulary: str, column: str = "text") -> DataFrame:
    """doc_id and the ids of a text column (array of int)."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, chunks = held("trie", sent.value)
        for b in freeing(chunks, batches):
            at = 0
            for texts in groups(b.column(1)):
                ids = [np.frombuffer(x, "<i4") for x in chunks.encode(texts)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(ids)), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])
                at += len(ids)

    return docs.select("doc_id", column).mapInArrow(run, "doc_id long, ids array<int>")


def decode_column(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and the text of the ids (array of int)."""
    sent = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, _ = held("trie", sent.value)
        for b in batches:
            texts = [decode(np.array(x.as_py() or [], "<u4").tobytes(), v.bytes) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, exact (whether decoding gives the text back)."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, exact boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, chunks = held("trie", sent.value)
        for b in freeing(chunks, batches):
            n, ids_sha, text_sha, exact = [], [], [], []
            for texts in groups(b.column(1)):
                for text, ids in zip(texts, chunks.encode(texts), strict=True):
                    back = decode(ids, v.bytes)
                    n.append(len(ids) // 4)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    text_sha.append(hashlib.sha256(back.encode()).hexdigest())
                    exact.append(back == (text or ""))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string()), pa.array(exact, pa.bool_())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "exact"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)
