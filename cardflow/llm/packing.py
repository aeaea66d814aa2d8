"""Packing documents into token sequences by lexical retrieval.

Documents are tokenised with a public byte-level vocabulary (its path is a parameter) and an end id. Every shard (documents that follow one another
in a partition, about SHARD_BYTES of text) gets a BM25 inverted index of its own. A seed document opens a window; its best scoring unused neighbours
fill it, the last one cut at its end; the rest of that one is the seed of the next window. Where no unused document shares a weighty term, the next
unused one follows. A window left open by a shard goes on in the next; the last one of a partition is cut into sequences
whose lengths are powers of two, so nothing is padded.

There is no shuffle; a task holds one shard. Numbers of sequences come from the partition and a counter. Rows must come in the same order when a
task is repeated, as they do from files; store the result of a shuffle first.

Tokens: text is cut where the vocabulary's pattern always cuts (before a space and a word, around other white space), equal pieces are encoded once.
Texts with white space beyond ASCII are encoded as a whole, as there the pattern looks across such cuts; so are texts that hold the string of a special token, which is
one id wherever it stands.

Defined results: a null or empty text is the end id alone. doc_id may be null or repeated: every row is
packed on its own."""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from cardflow.llm import arrays
from cardflow.llm.frames import table

LENGTH = 2048
END = 1
SHARD_BYTES = 8 << 20
K1, B = 1.2, 0.75
_ODD_SPACE = re.compile("[\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
_BLANK = frozenset(b" \n\t\r\x0b\x0c")


def special_tokens(ranks: str) -> dict[str, int]:
    """Those of the vocabulary's JSON form, if it lies beside the ranks."""
    path = os.path.splitext(ranks)[0] + ".json"
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


class Encoder:
    def __init__(self, ranks: str):
        with open(ranks, "rb") as lines:
            vocabulary = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bpe = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary, special_tokens=special_tokens(ranks))
        self.specials = [x.encode() for x in self.bpe.special_tokens_set]
        if any(x.split() != [x] for x in self.specials):
            raise ValueError("a special token with white space in it")
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.n_bytes[i] = len(token)

    def _pieces(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different pieces, one after the other, and their numbers. Those of a space and a word are encoded in one go, as the pattern cuts between them."""
        regular = np.array([len(x) > 1 and x[0] == 0x20 and x[1] not in _BLANK for x in raw], bool)
        row = np.flatnonzero(regular)
        some = [raw[i] for i in row]
        text = b"".join(some).decode()
        flat = np.array(self.bpe.encode_ordinary(text), np.uint32)
        ends = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)))
        upto = np.searchsorted(np.cumsum(self.n_bytes[flat]), ends) + 1 if len(flat) else np.zeros(0, np.int64)
        lengths = np.zeros(len(raw), np.int64)
        lengths[row] = np.diff(upto, prepend=0)
        others = [np.array(self.bpe.encode_ordinary(raw[i].decode()), np.uint32) for i in np.flatnonzero(~regular)]
        lengths[~regular] = [len(x) for x in others]
        out = np.empty(int(lengths.sum()), np.uint32)
        mine = np.repeat(regular, lengths)
        out[mine] = flat
        if others:
            out[~mine] = np.concatenate(others)
        return out, lengths

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All ids, with END after each text, and where each text begins; and the piece numbers of all texts, and where they begin."""
        data, offsets = arrays.utf8(texts)
        cuts = piece_cuts(data, offsets)
        first = np.searchsorted(cuts[:-1], offsets)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(np.ascontiguousarray(cuts, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = pieces.dictionary_encode()
        codes, raw = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        flat, lengths = self._pieces(raw)
        starts = np.cumsum(lengths) - lengths
        n = lengths[codes]
        ends = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(starts[codes] - ends[:-1], n)
        at += np.arange(ends[-1])
        out = flat[at]
        del at, n
        begins = ends[first]
        odd = [i for i, x in enumerate(raw) if any(t in x for t in self.specials) or not x.isascii() and _ODD_SPACE.search(x.decode())]
        if odd:
            strange = set(np.searchsorted(first, np.flatnonzero(np.isin(codes, odd)), "right") - 1)
            parts = [out[a:b] for a, b in zip(begins[:-1], begins[1:], strict=True)]
            for i in strange:
                parts[i] = np.array(self.bpe.encode(data[offsets[i] : offsets[i + 1]].tobytes().decode(), allowed_special="all"), np.uint32)
            out, begins = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return np.insert(out, begins[1:], END), begins + np.arange(len(begins)), codes, first


def piece_cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where the vocabulary's pattern always cuts, from 0 to the end."""
    if not len(data):
        return np.zeros(1, np.int64)
    blank = arrays.SPACE[data]
    opens, closes = blank.copy(), blank.copy()
    opens[1:] &= ~blank[:-1]
    closes[:-1] &= ~blank[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    opens[edges], closes[edges - 1] = blank[edges], blank[edges - 1]
    cut, ends = opens, np.zeros(len(data) + 1, bool)
    ends[offsets] = True
    p, q = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    inner = ~ends[q]  # white space at the end of a text is one piece
    cut[q[inner & (q - p > 1)] - 1] = True
    cut[q[inner & (data[q - 1] != 0x20)]] = True
    cut |= ends[:-1]
    cut[0] = True
    return np.append(np.flatnonzero(cut), len(data))


_encoders: dict[str, Encoder] = {}


def encoder(ranks: str) -> Encoder:
    if ranks not in _encoders:
        _encoders[ranks] = Encoder(ranks)
    return _encoders[ranks]


class Index:
    """A BM25 inverted index over the documents of a shard, by which unused neighbours are found."""

    def __init__(self, codes: np.ndarray, first: np.ndarray):
        n, length = len(first) - 1, np.diff(first)
        terms = int(codes.max()) + 1 if len(codes) else 1
        pairs, tf = np.unique(np.repeat(np.arange(n), length) * terms + codes, return_counts=True)
        doc, term = np.divmod(pairs, terms)
        df = np.bincount(term, minlength=terms)
        idf = np.maximum(np.log((n - df + 0.5) / (df + 0.5)), 0)
        keep = (df > 1)[term] & (idf > 0)[term]
        doc, term, tf = doc[keep], term[keep], tf[keep]
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / max(length.mean(), 1e-9)))
        self.n, self.unused = n, np.ones(n, bool)
        self.terms, self.term_at = term, np.searchsorted(doc, np.arange(n + 1))
        by_term = np.argsort(term, kind="stable")
        self.docs, self.weights = doc[by_term].astype(np.int32), weight[by_term].astype(np.float32)
        self.at = np.searchsorted(term[by_term], np.arange(terms + 1))
        self.next = 0

    def neighbours(self, seed: int) -> Iterator[int]:
        """Unused documents, best first, equal ones in order; then the others in order."""
        t = self.terms[self.term_at[seed] : self.term_at[seed + 1]]
        a, n = self.at[t], self.at[t + 1] - self.at[t]
        if n.sum():
            ends = np.cumsum(n)
            where = np.repeat(a - (ends - n), n) + np.arange(ends[-1])
            scores = np.bincount(self.docs[where], self.weights[where], self.n)
            scores[~self.unused] = 0
            for _ in range(8):  # a window rarely takes more
                best = int(scores.argmax())
                if scores[best] <= 0:
                    break
                scores[best] = 0
                yield best
            for best in np.argsort(-scores, kind="stable"):
                if scores[best] <= 0:
                    break
                yield int(best)
        while self.next < self.n:
            if self.unused[self.next]:
                yield self.next
            else:
                self.next += 1


class Packer:
    """Places pieces one after the other: documents, shard by shard, into windows."""

    def __init__(self, length: int, first_sequence: int):
        self.length, self.sequence, self.used = length, first_sequence, 0
        self.open: list[list] = []  # pieces of the open window: row, start, length, offset
        self.done: list[tuple] = []

    def _place(self, row: int, start: int, n: int) -> None:
        self.open.append((row, start, n, self.used))
        self.used += n
        if self.used == self.length:
            self.done += [(r, s, k, self.sequence, o) for r, s, k, o in self.open]
            self.sequence, self.used, self.open = self.sequence + 1, 0, []

    def add(self, base: int, lengths: np.ndarray, index: Index) -> None:
        """Packs a shard whose rows are numbered from base."""
        seed, left = -1, len(lengths)
        found: Iterator[int] = iter(())
        while left:
            row = next(found) if seed >= 0 else 0
            index.unused[row] = False
            left -= 1
            at, total = 0, int(lengths[row])
            while at < total:
                n = min(total - at, self.length - self.used)
                opened = self.used == 0
                self._place(base + row, at, n)
                at += n
                if opened and at == total and self.used:  # this document opened the window that is now filled up
                    seed, found = row, index.neighbours(row)
            if seed < 0 or not self.used:
                seed, found = row, index.neighbours(row)

    def close(self) -> None:
        """Cuts the open window at powers of two."""
        place, left, end, rest = 0, self.used, 0, []
        sizes = [1 << i for i in reversed(range(left.bit_length())) if left >> i & 1]
        for row, start, n, _ in self.open:
            while n:
                if not rest:
                    rest, place = [sizes.pop(0)], 0
                    end = rest[0]
                k = min(n, end - place)
                self.done.append((row, start, k, self.sequence, place))
                start, n, place = start + k, n - k, place + k
                if place == end:
                    rest, self.sequence = [], self.sequence + 1
        self.open, self.used = [], 0


def _pack(batches: Iterator[pa.RecordBatch], ranks: str, length: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    packer = Packer(length, (context.partitionId() if context else 0) << 33)
    bpe, base = encoder(ranks), 0
    held: dict[int, tuple] = {}  # rows with pieces in the open window: doc_id, ids

    def out() -> pa.RecordBatch:
        rows, packer.done = packer.done, []
        ids = [held[r][1][s : s + n] for r, s, n, _, _ in rows]
        columns = [pa.array([held[r][0] for r, *_ in rows], pa.int64()), pa.array([s for _, s, *_ in rows], pa.int64()), pa.array([n for _, _, n, _, _ in rows], pa.int64()),
                   pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array([len(held[r][1]) for r, *_ in rows], pa.int64()),
                   pa.array([q for *_, q, _ in rows], pa.int64()), pa.array([o for *_, o in rows], pa.int64())]
        if with_ids:
            at = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
            columns.append(pa.ListArray.from_arrays(at, pa.array(flat.astype(np.int32))))
        return pa.RecordBatch.from_arrays(columns, names=NAMES + ["ids"] * with_ids)

    for whole in batches:
        for batch in arrays.slices(whole, "text", SHARD_BYTES):
            ids, begins, codes, first = bpe.encode(batch.column("text"))
            for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                held[base + i] = (doc_id, ids[begins[i] : begins[i + 1]])
            packer.add(base, np.diff(begins), Index(codes, first))
            base += batch.num_rows
            yield out()
            held = {r: (held[r][0], held[r][1].copy()) for r, *_ in packer.open}
    packer.close()
    yield out()


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, length: int = LENGTH, ranks: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start (its document's ids before it), length, ids_crc32, doc_tokens, sequence_id, offset, and its ids if wanted."""
    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    schema = ", ".join(f"{n} long" for n in NAMES) + (", ids array<int>" if with_ids else "")
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(lambda batches: arrays.giving_back(_pack(batches, ranks, length, with_ids)), schema)


def query(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, with their ids."""
    return pack(docs)


QUERIES = {"op7_pack_sequences": (query, None)}
