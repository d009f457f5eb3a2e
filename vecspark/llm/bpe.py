"""BPE encoding and decoding with a pair occurrence index.

The distinct pieces of a run of texts are merged together: an index maps each pair (by
its merge rank) to all its positions, a heap gives the active ranks in ascending
order, each rank's positions are merged from left to right, and the pairs that this
makes enter the lists of their ranks. A merge's result only takes part in merges of
higher rank, so this order gives each piece what merging it alone would.

The encoder follows `word_bpe_49k.json`: NFC, white space collapsed, lower case by
character; runs of letters, single digits, runs of other characters and English
contractions; bytes as printable characters; `</w>` on a piece's last symbol. The two
special strings are found in the raw text first. Pieces never span white space, so each
distinct white-space-delimited chunk of a run of texts is encoded once.

Unicode tables differ: the library's normalisation and its classes are of other versions than this Python's. Chunks with a
code point that this Python does not know, or with a mark on which both disagree (found by comparing them on all marks,
once a worker, when a text has characters from U+0300 on), take their normal form and pieces from the library; merging is
the same for all. Null texts are empty and give no tokens. Rows are independent: repeated ids and ties
keep one output row each. Texts may have any length, columns of clashing names are told apart, and an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from vecspark.llm import textkernel as K
from vecspark.llm.common import free_name, read

TOKENIZER = "word_bpe_49k.json"
#: Pieces whose ids a worker keeps.
CACHE = 100_000
#: Text bytes that are encoded together.
SLICE_BYTES = 4 << 20
#: Merge ranks below this have long position lists, merged with array operations.
FREQUENT = 3000
_WS = r"\x09-\x0d\x20\x85\xa0  -     　"
_PIECES = regex.compile(rf"\n|'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_WS}\p{{L}}\p{{N}}]+")
_SPACES = regex.compile(rf"[{_WS}]+")
#: Characters that str.split() takes for white space and the tokenizer does not.
_ODD = "\x1c\x1d\x1e\x1f"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def byte_characters() -> list[str]:
    """The printable character of each byte, as byte-level tokenizers have it."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + i)
    return [out[b] for b in range(256)]


class Encoder:
    """One tokenizer file; encode() and decode() take whole texts."""

    def __init__(self, path: str, limit: int = CACHE):
        self.path = path
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.suffix = model["end_of_word_suffix"] or ""
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self._special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.size = max(self.token) + 1
        code, rank, made = [], [], []
        for r, (a, b) in enumerate(model["merges"]):
            code.append(self.vocab[a] * self.size + self.vocab[b])
            rank.append(r)
            made.append(self.vocab[a + b])
        self.rank = dict(zip(code, rank, strict=True))
        self.pair = [divmod(c, self.size) for c in code]
        self.made = made
        order = np.argsort(np.array(code, np.int64))
        self._codes, self._ranks = np.array(code, np.int64)[order], np.array(rank, np.int64)[order]
        chars = byte_characters()
        none = -1
        self._byte = np.array([self.vocab.get(c, none) for c in chars], np.int64)
        self._last = np.array([self.vocab.get(c + self.suffix, none) for c in chars], np.int64)
        self._strings = pa.array([self.token.get(i) for i in range(self.size)], pa.string())
        self.limit = limit
        self._known: dict[str, bytes] = {}

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): the token ids of each piece; all pieces share one pair occurrence index."""
        size = np.array([len(p) for p in pieces], np.int64)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(data)
        if not n:
            return np.zeros(len(pieces) + 1, np.int64), np.zeros(0, np.uint32)
        ends = np.cumsum(size)
        stop = np.zeros(n, bool)
        stop[ends[size > 0] - 1] = True
        ids = np.where(stop, self._last[data], self._byte[data])
        after = np.where(stop, -1, np.arange(1, n + 1))
        before = np.arange(-1, n - 1)
        before[1:][stop[:-1]] = -1
        # the index: rank -> lists of left positions
        index: dict[int, list] = {}
        active: list[int] = []

        def add(left: np.ndarray, right: np.ndarray) -> None:
            """Index the pairs of symbols at these positions."""
            code = ids[left] * self.size + ids[right]
            at = np.searchsorted(self._codes, code)
            at[at == len(self._codes)] = 0
            hit = np.flatnonzero((self._codes[at] == code) & (ids[left] >= 0) & (ids[right] >= 0))
            if not len(hit):
                return
            ranks, hit = self._ranks[at[hit]], left[hit]
            order = np.argsort(ranks, kind="stable")
            ranks, hit = ranks[order], hit[order]
            cut = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for r, x, y in zip(ranks[[0, *cut]].tolist(), [0, *cut.tolist()], [*cut.tolist(), len(hit)], strict=True):
                if r in index:
                    index[r].append(hit[x:y])
                else:
                    index[r] = [hit[x:y]]
                    heapq.heappush(active, r)

        inner = np.flatnonzero(~stop)
        add(inner, inner + 1)
        # frequent ranks: all positions of a pair at once
        while active and active[0] < FREQUENT and n > 2000:
            r = heapq.heappop(active)
            (a, b), c = self.pair[r], self.made[r]
            i = np.unique(np.concatenate(index.pop(r)))
            i = i[(ids[i] == a) & (after[i] >= 0)]
            i = i[ids[after[i]] == b]
            if a == b and len(i) > 1:  # overlaps: the left one first
                keep, gone = [], -1
                for x, y in zip(i.tolist(), after[i].tolist(), strict=True):
                    if x != gone:
                        keep.append(x)
                        gone = y
                i = np.array(keep)
            if not len(i):
                continue
            j = after[i]
            k = after[j]
            ids[i], ids[j], after[i] = c, -1, k
            right = k >= 0
            before[k[right]] = i[right]
            add(i[right], k[right])
            p = before[i]
            left = p >= 0
            add(p[left], i[left])
        # the rest: position by position
        index = {r: np.concatenate(x).tolist() for r, x in index.items()}
        sym, nxt, prv = ids.tolist(), after.tolist(), before.tolist()
        rank, wide = self.rank, self.size
        while active:
            r = heapq.heappop(active)
            spots = index.pop(r)
            a, b = self.pair[r]
            c = self.made[r]
            if len(spots) > 1:
                spots.sort()
            for i in spots:
                if sym[i] != a:
                    continue
                j = nxt[i]
                if j < 0 or sym[j] != b:
                    continue
                sym[i], sym[j] = c, -1
                nxt[i] = k = nxt[j]
                if k >= 0:
                    prv[k] = i
                    s = rank.get(c * wide + sym[k])
                    if s is not None:
                        if s in index:
                            index[s].append(i)
                        else:
                            index[s] = [i]
                            heapq.heappush(active, s)
                p = prv[i]
                if p >= 0:
                    s = rank.get(sym[p] * wide + c)
                    if s is not None:
                        if s in index:
                            index[s].append(p)
                        else:
                            index[s] = [p]
                            heapq.heappush(active, s)
        left = np.array(sym, np.int64)
        kept = left >= 0
        return np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], ends])], left[kept].astype(np.uint32)

    def _parts(self, chunk: str) -> list[bytes | int]:
        """The pieces of a chunk that holds special strings (those as their ids) or characters that the library knows better."""
        out: list[bytes | int] = []
        at = 0
        for m in self._special.finditer(chunk) if self._special else ():
            out += self._pieces(chunk[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + self._pieces(chunk[at:])

    def _pieces(self, text: str) -> list[bytes]:
        if not text.isascii() and max(text) >= "\u0300" and (own := library(self.path)).knows_better(text):
            return own.pieces(text)
        return [p.encode() for p in pieces(folded(text))]

    @staticmethod
    def chunks(text: str) -> list[str]:
        if any(c in text for c in _ODD):
            return [c for c in _SPACES.split(text) if c]
        return text.split()

    def _learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of distinct pieces. The first ones that come stay in a cache of bounded size."""
        known = self._known
        new = [p for p in pieces if p not in known]
        at, ids = self.merge([p.encode() for p in new])
        if len(new) == len(pieces):
            out = at, ids
        else:
            data, at = ids.tobytes(), (at * 4).tolist()
            own = {p: data[x:y] for p, x, y in zip(new, at[:-1], at[1:], strict=True)}
            got = [known[p] if p in known else own[p] for p in pieces]
            out = offsets([len(x) // 4 for x in got]), np.frombuffer(b"".join(got), "<u4")
        for i, p in enumerate(new[: max(0, self.limit - len(known))]):
            known[p] = ids[slice(*(out[0][i : i + 2]))].tobytes() if len(new) == len(pieces) else own[p]
        return out

    def _of_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of distinct chunks; one regular expression and one merge serve all of them."""
        special = {i for i, c in enumerate(chunks) if "<|" in c}
        joined = "\n".join(chunks)
        if not joined.isascii() and max(joined) >= "\u0300" and (own := library(self.path)).knows_better(joined):
            special |= {i for i, c in enumerate(chunks) if own.knows_better(c)}
        special = sorted(special)
        plain = chunks
        if special:
            plain = chunks.copy()
            for i in special:
                plain[i] = ""
        found = pa.array(pieces(folded("\n".join(plain))), pa.string()).dictionary_encode()
        code, distinct = found.indices.to_numpy(), found.dictionary.to_pylist()
        end = distinct.index("\n") if "\n" in distinct else -1
        chunk = np.cumsum(code == end)[code != end]
        at, ids = self._learn([p for p in distinct if p != "\n"])
        code = code[code != end]
        code = code - (code > end) if end >= 0 else code
        size = np.diff(at)[code]
        flat = gathered(ids, at[code], size)
        n = np.bincount(chunk, size, len(chunks)).astype(np.int64)
        start = offsets(n)[:-1]
        for i in special:
            own = [x for p in self._parts(chunks[i]) for x in (self.merge([p])[1].tolist() if isinstance(p, bytes) else [p])]
            start[i], n[i] = len(flat), len(own)
            flat = np.concatenate([flat, np.array(own, flat.dtype)])
        return np.stack([start, n]), flat

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): the token ids of all texts, one text after the other."""
        chunks = [self.chunks(t) if t else [] for t in texts]
        at = offsets([len(c) for c in chunks])
        coded = pa.array([c for x in chunks for c in x], pa.string()).dictionary_encode()
        (start, n), flat = self._of_chunks(coded.dictionary.to_pylist())
        each = coded.indices.to_numpy()
        return offsets(n[each])[at], gathered(flat, start[each], n[each])

    def decode_all(self, at: np.ndarray, ids: np.ndarray) -> pa.Array:
        """The text of each run of ids: tokens joined by single spaces, as the file has no decoder; unknown ids are left out."""
        known = np.zeros(len(ids), bool)
        small = ids < len(self._strings)
        known[small] = self._strings.is_valid().to_numpy(zero_copy_only=False)[ids[small]]
        if not known.all():
            at, ids = np.concatenate([[0], np.cumsum(known)])[at], ids[known]
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), self._strings.take(pa.array(ids))), " ")

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all([text])[1].tolist()

    def decode(self, ids: Iterable[int]) -> str:
        ids = np.array(list(ids), np.uint32)
        return self.decode_all(np.array([0, len(ids)]), ids)[0].as_py()


class Library:
    """The tokenizers library's normal form and pieces of a text, for what Unicode tables disagree on."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._byte = {c: b for b, c in enumerate(byte_characters())}
        self.foreign = np.array([unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)])
        marks = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c))[0] == "M"]
        self.foreign[[ord(c) for c in self._disagreed(marks)]] = True

    def pieces(self, text: str) -> list[bytes]:
        found = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))
        return [bytes(self._byte[c] for c in piece) for piece, _ in found]

    def _disagreed(self, chars: list[str]) -> list[str]:
        """Those whose order or pieces differ from ours, before a mark of the lowest class and after one of the highest; by halves."""
        text = " ".join(f"a{c}\u0338 b\u0345{c}" for c in chars)
        if self.pieces(text) == [p.encode() for p in pieces(folded(text))]:
            return []
        if len(chars) == 1:
            return chars
        half = len(chars) // 2
        return self._disagreed(chars[:half]) + self._disagreed(chars[half:])

    def knows_better(self, text: str) -> bool:
        return not text.isascii() and bool(self.foreign[[ord(c) for c in set(text)]].any())


@cache
def library(path: str) -> Library:
    return Library(path)


def pieces(text: str) -> list[str]:
    """The pieces of a folded text, with its line ends."""
    return _PIECES.findall(text)


def folded(text: str) -> str:
    """NFC, then lower case by character (without the final sigma)."""
    return (text if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ")).lower()


def offsets(sizes: list[int] | np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64))])


def gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of flat that begin at start, one after the other."""
    return flat[np.repeat(start - offsets(size)[:-1], size) + np.arange(int(size.sum()))]


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a file, read once by each Python worker."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def _each(path: str, batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, list[str]]]:
    """(rows, offsets, ids, digests of the decoded texts), by runs of rows."""
    own = encoder(path)
    for batch in batches:
        for at, texts in K.slices(batch.column(column), SLICE_BYTES):
            places, ids = own.encode_all(texts.to_pylist())
            decoded = [hashlib.sha256(t.as_buffer() if t.is_valid else b"").hexdigest() for t in own.decode_all(places, ids)]
            yield batch.slice(at, len(texts)), places, ids, decoded


def encode(docs: DataFrame, path: str, text_col: str = "text", ids: str = "ids", count: str = "n_tokens", digest: str = "decoded_sha256") -> DataFrame:
    """docs with columns of token ids, their number, and the SHA-256 of the text that they decode to.

    Columns of these names are replaced. One pass does all three, so a task holds one encoder.
    """
    made = (ids, count, digest)
    names = [c for c in docs.columns if c not in made]
    own = free_name(names, "__text")
    frame = docs.select(*names, F.col(text_col).cast("string").alias(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at, tokens, decoded in _each(path, batches, len(names)):
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(tokens.view("<i4")))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists, pa.array(np.diff(at)), pa.array(decoded, pa.string())], names=[*names, *made])

    schema = StructType([*frame.drop(own).schema.fields]).add(ids, ArrayType(IntegerType())).add(count, "long").add(digest, "string")
    return frame.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at, tokens, decoded in _each(path, batches, 1):
            own = [hashlib.sha256(tokens[x:y]).hexdigest() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at)), pa.array(own, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    frame = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return frame.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"), default_tokenizer())
