"""Token ids as Parquet list columns, in ascending doc_id order, for selective reads.

Texts are range-partitioned and sorted by doc_id, encoded in Arrow batches and written with dictionary-coded ids, bounded row
groups, small pages and page indexes, so a reader of a few documents or of the metadata alone touches only their pages.
Each file has its part number and starts counted within it; the parts' totals turn them into global starts on reading.

Every word between ASCII white space is encoded once per worker and cache (the tokenizer's pieces never cross white space;
if it folds capitals and cuts at punctuation anyway, so does the cache's key); the cache is emptied at a fixed size.

Defined results: null and empty texts have only the end id; equal doc_ids are ordered by their text; null doc_ids come
first; an empty table gives an empty result. Further columns are not written.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery.llm import blocks as B
from docquery.llm.common import id_and_text, shared_path

END_ID = 2
CACHE_TOKENS = 3_000_000
SCHEMA = "part int, doc_id long, local_start long, n_tokens long, ids array<int>"
WRITER = {
    "compression": "zstd",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.column.index.truncate.length": "64",
}


#: Boundaries between an ASCII letter and ASCII punctuation (no apostrophe), at which this split always cuts.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_KIND = np.zeros(256, np.int8)
_KIND[33:48] = _KIND[58:65] = _KIND[91:97] = _KIND[123:127] = 2
_KIND[65:91] = _KIND[97:123] = 1
_KIND[39] = 0


class Encoder:
    """Encodes whole texts, by way of a cache of their words."""

    def __init__(self, model: str, end_id: int) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_str(model), end_id
        #: A special token between words keeps each word a text of its own, in one call for many.
        self.mark = next(((t.content, i) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not t.normalized and not t.lstrip and not t.rstrip and not t.single_word), None)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        known = json.loads(model)
        steps = [x["type"] for x in (known.get("normalizer") or {}).get("normalizers", [])]
        parts = (known.get("pre_tokenizer") or {}).get("pretokenizers", [])
        #: Whether capitals are folded anyway, and words are cut at punctuation anyway: then fewer words are told apart.
        self.cuts = steps == ["NFC", "Replace", "Lowercase"] and bool(parts) and parts[0].get("pattern") == {"Regex": SPLIT} and parts[0].get("invert")
        self.clear()

    def clear(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.flat, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, and how many each has."""
        if self.mark is None:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            return np.array([x for i in ids for x in i], np.int32), np.array([len(i) for i in ids], np.int64)
        text, mark = self.mark
        flat, sizes = [], []
        for i in range(0, len(words), 4096):
            ids = np.array(self.tokenizer.encode_batch_fast([text.join(words[i : i + 4096])], add_special_tokens=False)[0].ids, np.int32)
            at = ids == mark
            flat.append(ids[~at])
            sizes.append(np.diff(np.concatenate([[-1], np.flatnonzero(at), [len(ids)]])) - 1)
        return np.concatenate([*flat, np.zeros(0, np.int32)]), np.concatenate([*sizes, np.zeros(0, np.int64)])

    def add(self, words: list[bytes]) -> None:
        flat, sizes = self.ids_of([w.decode() for w in words])
        n = len(self.slot)
        self.slot.update(zip(words, range(n, n + len(words)), strict=True))
        self.flat = np.concatenate([self.flat, flat])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])

    def slots(self, words: list[bytes]) -> np.ndarray:
        get = self.slot.get
        found = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        if len(new := np.flatnonzero(found < 0)):
            if len(self.flat) > CACHE_TOKENS:
                self.clear()
                new = np.arange(len(words))
            n = len(self.slot)
            self.add([words[i] for i in new.tolist()])
            if len(self.slot) > n:
                get = self.slot.__getitem__
                found[new] = np.fromiter((get(words[i]) for i in new.tolist()), np.int64, len(new))
        return found

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block's documents, end ids included, and where each document's begin."""
        raw = data.tobytes()
        if any(x in raw for x in self.added):
            return self.encode_apart(raw, offsets)
        if self.cuts:
            data = B.LOWER[data]
        starts, stops, first = B.spans(data, offsets, B.NOT_SPACE)
        if self.cuts and len(data) > 1:
            kind = _KIND[data]
            cut = np.flatnonzero(kind[:-1] + kind[1:] == 3) + 1
            cut = cut[kind[cut] * kind[cut - 1] == 2]  # one letter and one punctuation, of one word or of two documents
            cut = cut[~np.isin(cut, offsets, assume_unique=False)] if len(cut) else cut
            starts, stops = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([stops, cut]))
            first = np.searchsorted(starts, offsets)
        size = np.concatenate([[0], np.cumsum(stops - starts)])
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(size.astype(np.int64)), pa.py_buffer(data[B.NOT_SPACE[data]])]).dictionary_encode()
        slot = self.slots(words.dictionary.to_pylist())
        n, begin = (self.at[slot + 1] - self.at[slot]).astype(np.int32), self.at[slot].astype(np.int32)
        index = words.indices.to_numpy()
        n = n[index]
        ends = np.cumsum(n, dtype=np.int64)
        cum = np.concatenate([[0], ends])
        bounds = cum[first] + np.arange(len(offsets))  # one end id for each document before
        total = int(cum[-1])
        source = np.repeat(begin[index] - (ends - n).astype(np.int32), n)
        source += np.arange(total, dtype=np.int32)
        out = np.insert(self.flat[source], cum[first[1:]], np.int32(self.end_id))
        return out, bounds

    def encode_apart(self, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for blocks in which an added token's text occurs: such documents are encoded whole."""
        texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        whole = [any(x in t for x in self.added) for t in texts]
        rest = [b"" if w else t for t, w in zip(texts, whole, strict=True)]
        ids, bounds = self.encode(np.frombuffer(b"".join(rest), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in rest])]).astype(np.int64))
        parts = [np.array([*self.tokenizer.encode(t.decode(), add_special_tokens=False).ids, self.end_id], np.int32) if w else ids[bounds[d] : bounds[d + 1]] for d, (t, w) in enumerate(zip(texts, whole, strict=True))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


_coders: dict[tuple[int, int], Encoder] = {}


def coder_of(model: str, end_id: int) -> Encoder:
    """This worker's encoder; its cache lasts from task to task."""
    key = (hash(model), end_id)
    if key not in _coders:
        _coders.clear()
        _coders[key] = Encoder(model, end_id)
    return _coders[key]


def encoded(batches: Iterator[pa.RecordBatch], model: str, end_id: int) -> Iterator[pa.RecordBatch]:
    coder, start, part = coder_of(model, end_id), 0, TaskContext.get().partitionId()
    for batch in batches:
        for a, b, data, offsets in B.blocks(batch.column("text"), 8 << 20):
            ids, bounds = coder.encode(data, offsets)
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, part, np.int32)), batch.column("doc_id").slice(a, b - a), pa.array(start + bounds[:-1]), pa.array(np.diff(bounds)), lists], names=["part", "doc_id", "local_start", "n_tokens", "ids"])
            start += int(bounds[-1])


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID) -> None:
    """Encode docs and write them to path. The tokenizer file is read here and its text sent along, as executors may lack it."""
    model = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_text())
    ordered = id_and_text(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    out = ordered.mapInArrow(lambda it: encoded(it, model.value, end_id), SCHEMA)
    out.write.options(**WRITER).parquet(path)


def read_tokens(spark: SparkSession, path: str, columns: tuple[str, ...] = ("doc_id", "start", "n_tokens", "ids")) -> DataFrame:
    """The files' documents with global starts; without `ids` among the columns only metadata pages are read."""
    files = spark.read.schema(SCHEMA).parquet(path)
    totals = sorted((r["part"], r["n"]) for r in files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    base, rows = 0, []
    for part, n in totals:  # one row for each file
        rows.append((part, base))
        base += n
    bases = spark.createDataFrame(rows, "part int, base long")
    return files.join(F.broadcast(bases), "part").withColumn("start", F.col("base") + F.col("local_start")).select(*columns)


def checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        values, at = ids.values.to_numpy().astype("<u4"), ids.offsets.to_numpy()
        crc = [zlib.crc32(values[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_table(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Write the token files to the shared folder, read them back and sum up each document's ids."""
    spark = docs.sparkSession
    path = shared_path(spark, "tokens")
    write_tokens(docs, path, tokenizer_path, end_id)
    return read_tokens(spark, path).mapInArrow(checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")
