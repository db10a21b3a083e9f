"""Byte-level BPE encoding and decoding with a pair occurrence index.

The words of a batch that aren't known yet are laid out as one array of symbols.  An index maps every mergeable pair to
all its positions in that array; the ranks that occur are applied in ascending order, each to all its positions at once,
and the lists of the neighbouring pairs are updated.  Vocabulary files are a parameter and are read, never trained.

Defined results: a null text is encoded as the empty text (no ids, decodes to ""); repeated rows each give their own
row; an empty table gives an empty table; other columns of the input are kept unless they carry the name of an output.
"""

from __future__ import annotations

import heapq
import json
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.llm.common import sub_batches, tidy

#: Splits text before merging, as byte-level tokenizers of this vocabulary do (fixed value; white space as Unicode has it).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Words whose ids a worker remembers before it starts anew: bounds its memory, not its results.
REMEMBERED = 200_000
#: Characters that are encoded at once: more of them share the work of a rank.
BATCH_CHARS = 2_000_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself, others follow from 256."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairIndexBPE:
    """Encoder and decoder for a byte-level BPE vocabulary file in the JSON layout of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.pieces: list[bytes] = [b""] * size
        for piece, i in vocab.items():
            self.pieces[i] = bytes(alphabet[c] for c in piece)
        for piece, i in self.special.items():
            self.pieces[i] = piece.encode()
        self.decimal = [str(i) for i in range(size)]
        self.of_byte = np.zeros(256, np.int64)
        for c, b in alphabet.items():
            self.of_byte[b] = vocab[c]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left, right = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of = keys[order], order
        self.left, self.right = left, right
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.split = regex.compile(PRE_TOKEN).findall
        self.around = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.known: dict[str, tuple[int, ...]] = {}

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it isn't merged; negative symbols are boundaries."""
        key = np.where((a >= 0) & (b >= 0), a << 32 | b, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], -1)

    def _merge(self, words: list[str]) -> list[tuple[int, ...]]:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        flat = np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)
        ends = np.cumsum([len(r) + 1 for r in raw]) - 1
        sym = self.of_byte[flat]
        sym[ends] = -1
        n = len(sym)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[-1] = n - 1
        before[0] = n - 1  # the last symbol is a boundary, so both ends meet one

        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(pos: np.ndarray, rank: np.ndarray) -> None:
            pos, rank = pos[rank >= 0], rank[rank >= 0]
            if not len(pos):
                return
            order = np.argsort(rank, kind="stable")
            pos, rank = pos[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, p in zip(rank[np.r_[0, cuts]].tolist(), np.split(pos, cuts), strict=True):
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(p)

        enter(np.arange(n - 1), self._ranks(sym[:-1], sym[1:]))
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank)
            pos = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b, made = self.left[rank], self.right[rank], self.made[rank]
            nxt = after[pos]
            live = (sym[pos] == a) & (sym[nxt] == b)
            pos, nxt = pos[live], nxt[live]
            if a == b and len(pos) > 1:  # of overlapping pairs the leftmost goes first
                keep, taken = np.ones(len(pos), bool), -1
                for i in np.flatnonzero(np.r_[False, nxt[:-1] == pos[1:]] | np.r_[nxt[:-1] == pos[1:], False]).tolist():
                    keep[i] = pos[i] != taken
                    taken = nxt[i] if keep[i] else -1
                pos, nxt = pos[keep], nxt[keep]
            if not len(pos):
                continue
            far = after[nxt]
            sym[pos], sym[nxt] = made, -2
            after[pos] = far
            before[far] = pos
            back = before[pos]
            enter(back, self._ranks(sym[back], sym[pos]))
            enter(pos, self._ranks(sym[pos], sym[far]))
        alive = sym != -2
        where = np.cumsum(alive) - 1
        kept = sym[alive].tolist()
        out, start = [], 0
        for e in where[ends].tolist():
            out.append(tuple(kept[start:e]))
            start = e + 1
        return out

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text; strings of special tokens in a text become their ids."""
        parts: list[list[list[str] | int]] = []
        for t in texts:
            own = self.around(t) if self.around and any(s in t for s in self.special) else [t]
            parts.append([self.special[p] if k % 2 else self.split(p) for k, p in enumerate(own)])
        seen = set(chain.from_iterable(chain.from_iterable(p for p in x if not isinstance(p, int)) for x in parts))
        if len(self.known) + len(seen) > REMEMBERED:
            self.known.clear()
        if fresh := list(seen - self.known.keys()):
            self.known.update(zip(fresh, self._merge(fresh), strict=True))
        of = self.known.__getitem__
        return [list(chain.from_iterable((p,) if isinstance(p, int) else chain.from_iterable(map(of, p)) for p in x)) for x in parts]

    def decode(self, ids: list[int]) -> str:
        """Text of the ids, special tokens included; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


_loaded: dict[str, PairIndexBPE] = {}


def tokenizer(path: str) -> PairIndexBPE:
    """One tokenizer for each worker process and file."""
    if path not in _loaded:
        _loaded[path] = PairIndexBPE(path)
    return _loaded[path]


def forget() -> None:
    """Drops the words that this process remembers."""
    for t in _loaded.values():
        t.known.clear()


def forgetful(run):
    """A function over batches after whose last one the remembered words go, as the worker may idle on."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            forget()

    return tidy(wrapped)


def _kept(docs: DataFrame, keep: list[str] | None, made: set[str], text_col: str) -> list[str]:
    return [c for c in (docs.columns if keep is None else keep) if c not in made and c != text_col]


def encode(docs: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep columns (all but the text by default) and ids array<int> of each text."""
    kept = _kept(docs, keep, {"ids"}, text_col)

    def run(batches):
        bpe = tokenizer(path)
        for b in batches:
            texts = [t or "" for t in b.column(len(kept)).to_pylist()]
            for i, j in sub_batches(texts, BATCH_CHARS):
                ids = bpe.encode_batch(texts[i:j])
                yield pa.RecordBatch.from_arrays([b.column(k).slice(i, j - i) for k in range(len(kept))] + [pa.array(ids, pa.list_(pa.int32()))], names=[*kept, "ids"])

    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
    return docs.select(*kept, F.col(text_col).cast("string").alias("\0text")).mapInArrow(forgetful(run), schema)


def decode(tokens: DataFrame, path: str, ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """keep columns (all but the ids by default) and text, the decoded string of each list of ids (null: empty)."""
    kept = _kept(tokens, keep, {"text"}, ids_col)

    def run(batches):
        bpe = tokenizer(path)
        for b in batches:
            text = [bpe.decode(x or []) for x in b.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(text, pa.string())], names=[*kept, "text"])

    schema = T.StructType([tokens.schema[c] for c in kept] + [T.StructField("text", T.StringType())])
    return tokens.select(*kept, F.col(ids_col).alias("\0ids")).mapInArrow(forgetful(run), schema)


def round_trip(docs: DataFrame, path: str, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes in one pass: key, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256.

    The digests are taken where the ids are, so neither ids nor texts leave the worker.
    """
    from hashlib import sha256

    def run(batches):
        bpe = tokenizer(path)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for i, j in sub_batches(texts, BATCH_CHARS):
                counts, digests, decoded = [], [], []
                for ids in bpe.encode_batch(texts[i:j]):
                    counts.append(len(ids))
                    digests.append(sha256(",".join(map(bpe.decimal.__getitem__, ids)).encode()).hexdigest())
                    decoded.append(sha256(bpe.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(counts, pa.int64()), pa.array(digests), pa.array(decoded)], names=[key_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = T.StructType([docs.schema[key_col], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return docs.select(key_col, F.col(text_col).cast("string").alias("\0text")).mapInArrow(forgetful(run), schema)


def encoded_and_checked(docs: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep columns, n_tokens, ids and round_trips: whether the ids decode to the text (null: empty)."""
    made = {"n_tokens", "ids", "round_trips"}
    kept = _kept(docs, keep, made, text_col)

    def run(batches):
        bpe = tokenizer(path)
        for b in batches:
            texts = [t or "" for t in b.column(len(kept)).to_pylist()]
            for i, j in sub_batches(texts, BATCH_CHARS):
                ids = bpe.encode_batch(texts[i:j])
                same = [bpe.decode(x) == t for x, t in zip(ids, texts[i:j], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(k).slice(i, j - i) for k in range(len(kept))] + [pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(same)], names=[*kept, "n_tokens", "ids", "round_trips"])

    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("round_trips", T.BooleanType())])
    return docs.select(*kept, F.col(text_col).cast("string").alias("\0text")).mapInArrow(forgetful(run), schema)
