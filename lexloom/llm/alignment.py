"""Alignment of two tokenisers over the same bytes: which tokens of A and B belong together, and how often they do in the whole corpus.

Per distinct chunk of text (white space and what follows it; both tokenisers start anew there):
1. every byte gets a label: nothing ends here, a token of A ends, a token of B ends, or both do;
2. a regular expression scans the labels for spans that run up to the next "both"; the labels counted in a span give its group's tokens;
3. every byte with a label is one link: the pair of tokens of A and B that cover it overlap there, and no other byte links them again.

A document's groups and links are those of its chunks one after another. Link counts of the whole corpus are gathered in parts: a task numbers the
distinct pairs of `part_links` links at a time; the parts' pairs are summed by pair (one shuffle), the highest count of each id of B is a
table of at most its vocabulary (broadcast), and the counts go back to their part, where each document's numbers are looked up. So what travels is
distinct pairs of parts and the documents' numbers, never a row for each link.

Defined cases: texts that are null, empty or not given back byte for byte by one of the tokenisers have no tokens: zeros and an empty digest; they
take no part in the counts. Repeated rows each count. Texts are whole; one text of more than `part_links` links is a part of its own. A null id
stays null. Other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, cut, release
from .sentencepiece_codec import BYTE, MARK, codec
from .wordcache import ChunkCache

#: White space, with signs that some tables count as such: a chunk ends only where something else meets a space or a line break.
_SPACE = r"[\s\u180e\u200b\ufeff]"
_CHUNK = re.compile(rf"{_SPACE}*+[^\s\u180e\u200b\ufeff]++(?:(?![ \n]){_SPACE}{_SPACE}*+[^\s\u180e\u200b\ufeff]*+)*+|{_SPACE}++")
_ENDS = re.compile(r".*[^\s\u180e\u200b\ufeff]", re.S).fullmatch

#: Labels of a byte: no token ends, one of A, one of B, both.
NONE, A_END, B_END, BOTH = b".", b"a", b"b", b"|"
LABELS = np.frombuffer(NONE + A_END + B_END + BOTH, dtype=np.uint8)
_SPAN = re.compile(rb"[^|]*\|")


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable Latin-1 stands for itself, the rest follow from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteLevel:
    """Tokeniser A: a byte-level vocabulary of the tokenizers library; strings of special tokens are plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.engine = Tokenizer.from_file(path)
        self.engine.encode_special_tokens = True
        alphabet = byte_alphabet()
        self.bytes = [b""] * self.engine.get_vocab_size(with_added_tokens=True)
        for piece, i in self.engine.get_vocab(with_added_tokens=False).items():
            self.bytes[i] = bytes(alphabet[c] for c in piece)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.engine.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """Tokeniser B: a SentencePiece model. It adds the space itself, so `encode` takes chunks of a normalised text."""

    def __init__(self, path: str):
        self.codec = codec(path)
        m = self.codec.m
        self.bytes = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() for p, k in zip(m.pieces, m.kinds, strict=True)]
        #: without a boundary that every piece respects, texts can't be cut into chunks
        self.whole = self.codec.split is None

    def unchanged(self, text: str) -> bool:
        return self.codec.normal(text).replace(MARK, " ") == " " + text

    def encode(self, texts: list[str]) -> list[list[int]]:
        marked = [x.replace(" ", MARK) for x in texts]
        return [e.ids for e in self.codec.engine.encode_batch_fast(marked, add_special_tokens=False)]


class Aligner:
    def __init__(self, path_a: str, path_b: str, most: int = 200_000, together: int = 64):
        self.together = together
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.size_a, self.size_b = (np.array([len(x) for x in own.bytes], dtype=np.int64) for own in (self.a, self.b))
        self.cache = ChunkCache(self._fill, most)
        normal = self.b.codec.m
        # a model that leaves texts as they are needs no look at each
        self.plain = not normal.char_map and not normal.strip_spaces and normal.dummy_prefix and normal.escape_spaces

    def chunks(self, text: str) -> list[str]:
        return [" " + text] if self.b.whole else _CHUNK.findall(" " + text)

    def _fill(self, texts: list[str]) -> list[tuple | None]:
        out: list[tuple | None] = []
        for at in range(0, len(texts), 20_000):
            out += self.align(texts[at : at + 20_000])
        return out

    def align(self, texts: list[str]) -> list[tuple | None]:
        """For each chunk its groups as text, its links as 64-bit pairs, and its tokens of A, of B and groups; None if bytes are lost.

        Chunks that open with white space and end without meet like those of a text, so `together` of them are encoded at once; the others, and
        those of a lot whose bytes don't come back, one by one.
        """
        out: list[tuple | None] = [None] * len(texts)
        open_ends = [k for k, x in enumerate(texts) if x[0] in " \n" and _ENDS(x)] if not self.b.whole else []
        lots = [open_ends[i : i + self.together] for i in range(0, len(open_ends), self.together)]
        alone = [[k] for k in sorted(set(range(len(texts))) - set(open_ends))]
        for some in (lots, alone):
            joined = ["".join(map(texts.__getitem__, lot)) for lot in some]
            ids_a, ids_b = self.a.encode(joined), self.b.encode(joined)
            sound, lost = [], []
            for lot, text, x, y in zip(some, joined, ids_a, ids_b, strict=True):
                raw = text.encode()
                same = b"".join(map(self.a.bytes.__getitem__, x)) == raw == b"".join(map(self.b.bytes.__getitem__, y))
                (sound if same else lost).append((lot, x, y))
            if some is lots:
                alone += [[k] for lot, _, _ in lost for k in lot]
            if sound:
                own = [k for lot, _, _ in sound for k in lot]
                found = self.label(*(np.fromiter(chain.from_iterable(x[side] for x in sound), dtype=np.int64) for side in (1, 2)), np.array([len(texts[k].encode()) for k in own]))
                for k, x in zip(own, found, strict=True):
                    out[k] = x
        return out

    def label(self, flat_a: np.ndarray, flat_b: np.ndarray, sizes: np.ndarray) -> list[tuple]:
        """Groups and links of chunks of so many bytes from the ids of A and of B over all of them."""
        end_a, end_b = np.cumsum(self.size_a[flat_a]), np.cumsum(self.size_b[flat_b])
        kind = np.zeros(int(end_a[-1]), dtype=np.uint8)
        kind[end_a - 1] |= 1
        kind[end_b - 1] |= 2
        text_a, text_b = list(map(str, flat_a.tolist())), list(map(str, flat_b.tolist()))
        groups, i, j = [], 0, 0
        # bytes where nothing ends count for no group
        for span in _SPAN.findall(LABELS[kind].tobytes().translate(None, NONE)):
            if span == BOTH:
                groups.append(f"{text_a[i]}|{text_b[j]}")
                i, j = i + 1, j + 1
            else:
                n_a, n_b = span.count(A_END) + 1, span.count(B_END) + 1
                groups.append(",".join(text_a[i : i + n_a]) + "|" + ",".join(text_b[j : j + n_b]))
                i, j = i + n_a, j + n_b
        stops = np.cumsum(sizes)
        if not (kind[stops - 1] == 3).all():
            raise AssertionError("a token crosses two chunks")
        at = np.flatnonzero(kind)
        upto_a, upto_b = np.cumsum(kind & 1, dtype=np.int64), np.cumsum(kind >> 1, dtype=np.int64)
        pairs = ((flat_a[(upto_a - (kind & 1))[at]] << 32) | flat_b[(upto_b - (kind >> 1))[at]]).tobytes()
        links, spans = np.searchsorted(at, stops) * 8, np.cumsum(kind == 3)[stops - 1]
        n_a, n_b, n = (np.diff(x, prepend=0).tolist() for x in (upto_a[stops - 1], upto_b[stops - 1], spans))
        links, spans = [0, *links.tolist()], [0, *spans.tolist()]
        return [(";".join(groups[spans[k] : spans[k + 1]]), pairs[links[k] : links[k + 1]], n_a[k], n_b[k], n[k]) for k in range(len(sizes))]

    def document(self, text: str, known: dict, parts: list[str]) -> tuple[int, int, int, str, np.ndarray]:
        """Tokens of A, of B, groups, digest and links of a text."""
        found = list(map(known.__getitem__, parts))
        if not text or None in found or not (self.plain or self.b.unchanged(text)):
            return 0, 0, 0, "", np.zeros(0, dtype=np.int64)
        groups, pairs, n_a, n_b, n = zip(*found, strict=True)
        return sum(n_a), sum(n_b), sum(n), hashlib.sha256(";".join(groups).encode()).hexdigest(), np.frombuffer(b"".join(pairs), dtype=np.int64)


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def groups(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, groups): each document's token groups, as arrays of the ids of A and of B."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b)
        kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
        for part in chunks(batches):
            cuts = [own.chunks(x) for x in part["text"]]
            known = own.cache.get(set().union(*cuts))
            out = []
            for text, parts in zip(part["text"], cuts, strict=True):
                found = [known[x] for x in parts]
                sound = text and None not in found and (own.plain or own.b.unchanged(text))
                sides = [[list(map(int, side.split(","))) for side in group.split("|")] for x in found for group in x[0].split(";")] if sound else []
                out.append([{"a": a, "b": b} for a, b in sides])
            yield pa.RecordBatch.from_arrays([pa.array(part["doc_id"], pa.int64()), pa.array(out, kind)], names=["doc_id", "groups"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, "doc_id long, groups array<struct<a: array<int>, b: array<int>>>")


_DOC = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
_LINKED = "part long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, numbers binary, times binary, number int, pair long, k long"


def linked(docs: DataFrame, path_a: str, path_b: str, part_links: int, id_col: str, text_col: str) -> DataFrame:
    """Two kinds of rows: a part's distinct pairs (number, pair, times met), and documents with the numbers of their pairs in the part."""
    names = [x.split()[0] for x in _LINKED.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "int": pa.int32()}
    types = [kinds[x.split()[1]] for x in _LINKED.split(", ")]

    def batch(n: int, **columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(names, types, strict=True)], names=names)

    def flush(part: int, rows: list[tuple], distinct: list[np.ndarray], times: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        every = np.concatenate(distinct) if distinct else np.zeros(0, dtype=np.int64)
        pairs = np.unique(every)
        number = np.searchsorted(pairs, every).astype(np.int32)
        met = np.bincount(number, weights=np.concatenate(times), minlength=len(pairs)).astype(np.int64) if len(every) else np.zeros(0, dtype=np.int64)
        for at in range(0, len(pairs), 50_000):
            n = len(pairs[at : at + 50_000])
            yield batch(n, part=[part] * n, number=np.arange(at, at + n, dtype=np.int32), pair=pairs[at : at + n], k=met[at : at + n])
        ends = np.cumsum([len(x) for x in distinct])
        own = [x.tobytes() for x in np.split(number, ends[:-1])] if distinct else []
        for at in range(0, len(rows), 1000):
            some = list(zip(*rows[at : at + 1000], strict=True))
            yield batch(len(some[0]), part=[part] * len(some[0]), **dict(zip(_DOC, some, strict=True)), numbers=own[at : at + 1000], times=[x.tobytes() for x in times[at : at + 1000]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b)
        part = TaskContext.get().partitionId() << 32
        rows, distinct, times, held = [], [], [], 0
        for some in chunks(batches):
            cuts = [own.chunks(x) for x in some["text"]]
            known = own.cache.get(set().union(*cuts))
            for doc_id, text, parts in zip(some["doc_id"], some["text"], cuts, strict=True):
                n_a, n_b, n, digest, links = own.document(text, known, parts)
                pairs, k = np.unique(links, return_counts=True)
                if rows and held + len(pairs) > part_links:
                    yield from flush(part, rows, distinct, times)
                    rows, distinct, times, held, part = [], [], [], 0, part + 1
                rows.append((doc_id, n_a, n_b, n, len(links), digest))
                distinct.append(pairs)
                times.append(k.astype(np.int32))
                held += len(pairs)
        if rows:
            yield from flush(part, rows, distinct, times)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _LINKED)


def align(docs: DataFrame, path_a: str, path_b: str, part_links: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document."""
    rows = cut(linked(docs, path_a, path_b, part_links, id_col, text_col))
    pairs = rows.where("pair IS NOT NULL").select("part", "number", "pair", "k")
    counted = cut(pairs.withColumn("count", F.sum("k").over(Window.partitionBy("pair"))).select("part", "number", F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b"), "count"))
    best = counted.groupBy("b").agg(F.max("count").alias("best"))  # at most a row for each piece of B's vocabulary
    answers = counted.join(F.broadcast(best), "b").select("part", "number", "count", (F.col("count") == F.col("best")).alias("top"))
    texts = rows.where("pair IS NULL").select("part", *_DOC, "numbers", "times")
    both = texts.unionByName(answers, allowMissingColumns=True).repartition("part").sortWithinPartitions("part", F.col("number").asc_nulls_last())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, counts, tops = None, [], []

        def column(own: pa.RecordBatch, name: str) -> pa.Array:
            return own.column(own.schema.get_field_index(name))

        for batch in batches:
            of = column(batch, "part").to_numpy()
            kind = column(batch, "number").is_null().to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((of[1:] != of[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                own = batch.slice(a, b - a)
                if of[a] != part:
                    part, counts, tops = of[a], [], []
                if not kind[a]:
                    counts.append(column(own, "count").to_numpy())
                    tops.append(column(own, "top").to_numpy(zero_copy_only=False))
                    continue
                if len(counts) != 1:
                    counts, tops = ([np.concatenate(x)] if x else [np.zeros(0, dtype=np.int64)] for x in (counts, tops))
                sums, best = [], []
                for numbers, times in zip(column(own, "numbers").to_pylist(), column(own, "times").to_pylist(), strict=True):
                    at, k = np.frombuffer(numbers, dtype=np.int32), np.frombuffer(times, dtype=np.int32).astype(np.int64)
                    sums.append(int((counts[0][at] * k).sum()) if len(at) else 0)
                    best.append(int(k[tops[0][at]].sum()) if len(at) else 0)
                made = {c: column(own, c) for c in _DOC} | {"n_best": pa.array(best, pa.int64()), "count_sum": pa.array(sums, pa.int64())}
                yield pa.RecordBatch.from_arrays([made[c] for c in out], names=out)

    out = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    done = cut(both.mapInArrow(run, ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'long'}" for c in out)))
    release(rows, counted)
    return done
