"""Operator 7, token-ID output: concatenated ids with Elias-Fano coded document ends.

Documents are put in ascending id order by range partitioning, tokenised in the scan, and written as shards of at
most SHARD_IDS ids (one document at least).  A shard is one row of a Parquet table, so it goes to and comes from any
store that Spark reads, and one blob in this format (little-endian):

    4 bytes "EFT1", u8 bytes per id (2 or 4), u8 low bits l, u16 zero,
    u64 documents n, u64 ids u, u64 bytes of the low part, u64 bytes of the high part, u64 select samples,
    the u ids,
    low part: the l low bits of the n document ends, packed, least significant first,
    high part: a bit string with a one at (end >> l) + i for document i,
    samples: the place in the high part of every 64th one, as u32.

The ends are select queries: select(i) finds the i-th one from its sample and adds the low bits.  No table of 64-bit
offsets is stored or built: a reader asks select() document by document.  A shard keeps its place among the ids of its
partition, and partitions' totals (one number for each partition) give the rest.

Defined cases: a null or empty text is the end id alone; strings of special tokens in a text get those tokens' ids, as
the library gives them; repeated ids follow each other, ordered by a hash of their texts; null ids come first; a very long
text makes one shard of its own; an empty table gives no shards; other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_slices, materialise, quoted, remembered, string_array, tidied

MAGIC = b"EFT1"
HEAD = struct.Struct("<4sBBHQQQQQ")
SAMPLE = 64
SHARD_IDS = 1 << 21
#: Bytes of text encoded at once; bounds a worker's memory.
SLICE = 1 << 21
#: Documents read from a shard to a batch.
READ = 4096
SHARD_SCHEMA = "part int, seq int, base long, docs long, ids long, id_list binary, blob binary"


def encode_shard(ids: np.ndarray, ends: np.ndarray) -> bytes:
    """One shard's blob; ends are the running totals of ids, one for each document, not decreasing."""
    n, u = len(ends), len(ids)
    low_bits = max(0, (u // n).bit_length() - 1) if n else 0
    width = 2 if u == 0 or int(ids.max()) < 1 << 16 else 4
    low = np.packbits(((ends[:, None].astype(np.uint64) >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes()
    ones = (ends.astype(np.int64) >> low_bits) + np.arange(n)
    bits = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
    bits[ones] = 1
    high = np.packbits(bits, bitorder="little").tobytes()
    samples = ones[::SAMPLE].astype("<u4").tobytes()
    return HEAD.pack(MAGIC, width, low_bits, 0, n, u, len(low), len(high), len(samples) // 4) + ids.astype(f"<u{width}").tobytes() + low + high + samples


class Shard:
    """Reads a blob; ids is a view, not a copy."""

    def __init__(self, blob: bytes):
        magic, width, self.low_bits, _, self.n, self.u, low, high, samples = HEAD.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = HEAD.size
        self.ids = np.frombuffer(blob, dtype=f"<u{width}", count=self.u, offset=at)
        at += width * self.u
        self._low = np.frombuffer(blob, dtype=np.uint8, count=low, offset=at)
        self._high = np.frombuffer(blob, dtype=np.uint8, count=high, offset=at + low)
        self._samples = np.frombuffer(blob, dtype="<u4", count=samples, offset=at + low + high)

    def _low_of(self, i: int) -> int:
        bit, n = i * self.low_bits, self.low_bits
        chunk = int.from_bytes(self._low[bit >> 3 : (bit + n + 7) >> 3].tobytes(), "little")
        return chunk >> (bit & 7) & ((1 << n) - 1)

    def select(self, i: int) -> int:
        """The end of document i: a walk of at most 64 ones from the nearest sample, 64 bits at a time."""
        at, left = int(self._samples[i // SAMPLE]), i % SAMPLE
        place = at & ~7
        word = int.from_bytes(self._high[at >> 3 : (at >> 3) + 8].tobytes(), "little") >> (at & 7) << (at & 7)
        while (count := word.bit_count()) <= left:
            left, place = left - count, place + 64
            word = int.from_bytes(self._high[place >> 3 : (place >> 3) + 8].tobytes(), "little")
        for _ in range(left):
            word &= word - 1
        one = place + (word & -word).bit_length() - 1
        return ((one - i) << self.low_bits) | self._low_of(i)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.select(i - 1) if i else 0 : self.select(i)]


class Encoder:
    """Encodes texts by their distinct white-space-separated words; a worker keeps the ids of words it meets again.

    Right for tokenizers whose pre-tokens never hold ASCII white space and that drop it, like the word-level BPE here.
    Words go to the library many to a text, between separators of which each is one id that no other word has.  A text
    that holds the string of a special token goes to the library whole.
    """

    #: Words kept (of KEPT_BYTES at most), and words to a text.  Beyond KEPT those go that were not met again.
    KEPT, KEPT_BYTES, TOGETHER = 400_000, 64, 500
    #: Texts of words for the library, and words whose ids are put in their places, at once.
    TEXTS, PLACED = 16, 1 << 16
    SEPARATOR = "\x01"

    def __init__(self, tokenizer_json: str, end_id: int, lower: bool = True):
        # Tasks already use all cores; threads within one only wait for each other.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.special = [str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokenizer.encode_special_tokens = True  # words come lower-cased: what looks special there was not
        self.end_id, self.lower = end_id, lower
        found = self.tokenizer.encode(self.SEPARATOR, add_special_tokens=False).ids
        self.separator_id = found[0] if len(found) == 1 else None
        self.kept_words = pa.array([], pa.large_string())
        self.kept_ids, self.kept_length, self.kept_hits = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)

    def _keep(self, words: pa.Array, ids: np.ndarray, length: np.ndarray) -> None:
        """Add new words; where there are too many, first drop what has not been met again, then the rarest."""
        short = pc.binary_length(words).to_numpy() <= self.KEPT_BYTES
        words, ids, length = words.filter(pa.array(short)), ids[np.repeat(short, length)], length[short]
        if len(self.kept_words) + len(words) > self.KEPT:
            least = 1
            while (self.kept_hits >= least).sum() > self.KEPT // 2:
                least *= 2
            stays = self.kept_hits >= least
            self.kept_words = self.kept_words.filter(pa.array(stays))
            self.kept_ids = self.kept_ids[np.repeat(stays, self.kept_length)]
            self.kept_length, self.kept_hits = self.kept_length[stays], self.kept_hits[stays] // 2
        self.kept_words = pa.concat_arrays([self.kept_words, words])
        self.kept_ids = np.concatenate([self.kept_ids, ids])
        self.kept_length = np.concatenate([self.kept_length, length])
        self.kept_hits = np.concatenate([self.kept_hits, np.zeros(len(words), dtype=np.int32)])

    def _encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after the other, and how many each has."""
        odd = pc.match_substring(words, self.SEPARATOR).to_numpy(zero_copy_only=False) | (self.separator_id is None)
        ids: list[np.ndarray] = []
        lengths = np.zeros(len(words), dtype=np.int64)
        plain = np.flatnonzero(~odd)
        listed = words.take(pa.array(plain)).to_pylist()
        texts = [f" {self.SEPARATOR} ".join(listed[i : i + self.TOGETHER]) + f" {self.SEPARATOR}" for i in range(0, len(listed), self.TOGETHER)]
        for i in range(0, len(texts), self.TEXTS):
            ids += [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts[i : i + self.TEXTS], add_special_tokens=False)]
        flat = np.concatenate(ids) if ids else np.zeros(0, dtype=np.uint32)
        cut = np.flatnonzero(flat == self.separator_id) if len(plain) else np.zeros(0, dtype=np.int64)
        lengths[plain] = np.diff(cut, prepend=-1) - 1
        flat = flat[flat != self.separator_id]
        if odd.any():
            # Rare words that hold the separator are encoded alone and put in their places.
            alone = {i: np.array(self.tokenizer.encode(words[i].as_py(), add_special_tokens=False).ids, dtype=np.uint32) for i in np.flatnonzero(odd).tolist()}
            pieces, at = [], 0
            for i in range(len(words)):
                if i in alone:
                    pieces.append(alone[i])
                    lengths[i] = len(alone[i])
                else:
                    pieces.append(flat[at : at + lengths[i]])
                    at += lengths[i]
            flat = np.concatenate(pieces)
        return flat, lengths

    def __call__(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each with its end id, and the number of ids of each text."""
        plain = string_array(text)
        special = np.zeros(len(plain), dtype=bool)
        for token in self.special:
            special |= pc.match_substring(plain, token).to_numpy(zero_copy_only=False)
        if special.any():
            return self._with_whole(plain, special)
        split = pc.ascii_split_whitespace(pc.ascii_lower(plain) if self.lower else plain)
        parent = pc.list_parent_indices(split).to_numpy()
        coded = pc.list_flatten(split).dictionary_encode()
        del split, plain
        words, code = coded.dictionary, coded.indices.to_numpy()
        found = pc.fill_null(pc.index_in(words, self.kept_words), -1).to_numpy().astype(np.int64)
        self.kept_hits[found[found >= 0]] += 1
        new = np.flatnonzero(found < 0)
        fresh = words.take(pa.array(new))
        ids, length = self._encode_words(fresh)
        found[new] = len(self.kept_words) + np.arange(len(new))
        all_ids, all_length = np.concatenate([self.kept_ids, ids]), np.concatenate([self.kept_length, length])
        start = np.cumsum(all_length) - all_length
        place = found[code] if len(code) else np.zeros(0, dtype=np.int64)
        per_word = all_length[place]
        counts = np.bincount(parent, weights=per_word, minlength=len(text)).astype(np.int64) + 1
        out = np.full(int(counts.sum()), self.end_id, dtype=np.uint32)
        # A word's ids go after all words before it and one end id for each text before its own.
        to = np.cumsum(per_word) - per_word
        for i in range(0, len(place), self.PLACED):
            some = slice(i, i + self.PLACED)
            within = to[i] + np.arange(int(per_word[some].sum()), dtype=np.int64)
            out[within + np.repeat(parent[some].astype(np.int64), per_word[some])] = all_ids[within + np.repeat(start[place[some]] - to[some], per_word[some])]
        self._keep(fresh, ids, length)
        return out, counts

    def _with_whole(self, texts: pa.Array, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As __call__, where the marked texts are encoded whole."""
        ids, counts = self(pc.if_else(pa.array(whole), "", texts))
        parts = np.split(ids, np.cumsum(counts)[:-1])
        self.tokenizer.encode_special_tokens = False
        try:
            for i in np.flatnonzero(whole).tolist():
                found = self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids
                parts[i] = np.array([*found, self.end_id], dtype=np.uint32)
        finally:
            self.tokenizer.encode_special_tokens = True
        return np.concatenate(parts), np.array([len(x) for x in parts])


def _encoder(tokenizer_json: str, end_id: int) -> Encoder:
    """One for each tokenizer and worker process."""
    return remembered(("token output", hash(tokenizer_json), end_id), lambda: Encoder(tokenizer_json, end_id))


def write_shards(docs: DataFrame, tokenizer_path: str, *, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> DataFrame:
    """The table of shards (SHARD_SCHEMA), written to the shared folder; id_list is the documents' ids as an Arrow column."""
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer = docs.sparkSession.sparkContext.broadcast(f.read())
    mark = F.xxhash64("text")
    placed = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    placed = placed.repartitionByRange(F.col("id"), mark).sortWithinPartitions("id", mark, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _encoder(tokenizer.value, end_id), TaskContext.get().partitionId()
        names: list[pa.Array] = []
        held: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        seq = base = size = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, base, size
            ids, ends = np.concatenate(held), np.cumsum(np.concatenate(counts))
            sink = pa.BufferOutputStream()
            column = pa.record_batch([pa.concat_arrays(names)], names=["id"])
            with pa.ipc.new_stream(sink, column.schema) as w:
                w.write_batch(column)
            row = [part, seq, base, len(ends), len(ids), sink.getvalue().to_pybytes(), encode_shard(ids, ends)]
            seq, base, size = seq + 1, base + len(ids), 0
            for x in (names, held, counts):
                x.clear()
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["part", "seq", "base", "docs", "ids", "id_list", "blob"])

        for batch in batches:
            for piece in bounded_slices(batch, "text", SLICE):
                ids, count = encoder(piece.column("text"))
                end, start = np.cumsum(count), 0
                while start < len(count):
                    room = shard_ids - size + (end[start - 1] if start else 0)
                    stop = int(np.searchsorted(end, room, side="right"))
                    if stop <= start:
                        if size:
                            yield flush()
                            continue
                        stop = start + 1
                    names.append(piece.column("id").slice(start, stop - start))
                    held.append(ids[end[start - 1] if start else 0 : end[stop - 1]])
                    counts.append(count[start:stop])
                    size += int(count[start:stop].sum())
                    start = stop
        if names:
            yield flush()

    return materialise(placed.mapInArrow(tidied(run, remembers=True), SHARD_SCHEMA), "token-shards")


def read_documents(shards: DataFrame, *, id_col: str = "doc_id", id_type: str = "bigint") -> DataFrame:
    """From the shards alone: each document's id, start among all ids, n_tokens and ids_crc32."""
    # One number for each partition of the writer reaches the driver.
    totals = shards.groupBy("part").agg(F.sum("ids").alias("ids")).orderBy("part").collect()
    before, total = {}, 0
    for part, ids in totals:
        before[part], total = total, total + ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                shard = Shard(row.column("blob")[0].as_py())
                names = pa.ipc.open_stream(row.column("id_list")[0].as_py()).read_all()["id"].combine_chunks()
                at = before[row.column("part")[0].as_py()] + row.column("base")[0].as_py()
                start = 0
                for first in range(0, shard.n, READ):
                    told = []
                    for i in range(first, min(first + READ, shard.n)):
                        end = shard.select(i)
                        told.append((at + start, end - start, zlib.crc32(shard.ids[start:end].astype("<u4").tobytes())))
                        start = end
                    columns = [pa.array(x, pa.int64()) for x in zip(*told, strict=True)]
                    yield pa.RecordBatch.from_arrays([names.slice(first, READ), *columns], [id_col, "start", "n_tokens", "ids_crc32"])

    return shards.select("part", "base", "id_list", "blob").mapInArrow(tidied(run), f"{quoted(id_col)} {id_type}, start long, n_tokens long, ids_crc32 long")
