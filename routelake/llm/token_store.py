"""Token ids in a binary format coded by a static range asymmetric numeral system.

Documents are ranged by id.  Each task tokenizes its range in order and cuts it into
segments.  A segment has one frequency table, shared by its blocks; a block holds whole
documents and is coded on its own, by up to ``LANES`` interleaved coders.  A block keeps
its coders' states at its start and at every ``EVERY`` steps (checkpoints from which
decoding can start as well), the CRC-32 of its ids and of those from each checkpoint to the
next.  ``read`` decodes whole blocks side by side; ``fetch`` decodes some documents from the
checkpoints before them.

The file format is Parquet: a row for each block with the columns of ``BLOCKS``, sorted by
part, segment and block; the first block of a segment carries the segment's table.  All
numbers in binary columns are little-endian.

  table       pairs of unsigned 32-bit id and frequency; frequencies sum to 2**SCALE
  doc_ids     signed 64-bit, by document; null ids are flagged in no_id
  doc_tokens  unsigned 32-bit, ids in each document with its end id
  states      unsigned 64-bit, for checkpoint 0, EVERY, 2 * EVERY, ...: lanes states each
  positions   unsigned 32-bit, for each checkpoint the words read before it
  crcs        unsigned 32-bit, for each checkpoint the CRC-32 of the ids up to the next
  words       unsigned 32-bit words of the coders, in the order they are read

Coder states lie in [2**31, 2**63) and move 32 bits at a time.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from routelake.llm.common import documents, texts
from routelake.session import scratch_dir

END = 2
SCALE = 20
LANES, EVERY = 1024, 128
#: Ids after which a block, and a segment, is closed with its last document.
BLOCK_IDS, SEGMENT_IDS = 1 << 19, 1 << 22
#: Bytes of text that a range of documents holds, about.
RANGE_BYTES = 24 << 20
BLOCKS = (
    "part int, segment int, block int, first int, n_docs int, n_ids long, lanes int, crc long, "
    "table binary, doc_ids binary, no_id binary, doc_tokens binary, states binary, positions binary, crcs binary, words binary"
)
LOW = np.uint64(1 << 31)


def quantised(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**SCALE, at least 1 for each id that occurs."""
    total = int(counts.sum())
    if not total:
        return counts.astype(np.uint64)
    freq = np.where(counts > 0, np.maximum(1, counts.astype(np.float64) / total * (1 << SCALE)), 0).astype(np.int64)
    excess = int(freq.sum()) - (1 << SCALE)
    if excess < 0:
        freq[int(freq.argmax())] -= excess
    while excess > 0:  # taken from the largest, which stay above 1
        order = np.argsort(-freq)[: max(1, min(excess, int((freq > 1).sum())))]
        cut = np.minimum(freq[order] - 1, -(-excess // len(order)))
        for at, n in zip(order, cut, strict=True):
            n = min(int(n), excess)
            freq[at] -= n
            excess -= n
    return freq.astype(np.uint64)


def encode_block(ids: np.ndarray, freq: np.ndarray, start: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
    """Lanes, states, positions, words of the ids, coded with the table."""
    n = len(ids)
    lanes = max(1, min(LANES, n // 64 or 1))
    steps = -(-n // lanes)
    state = np.full(lanes, LOW, dtype=np.uint64)
    emitted: list[np.ndarray] = [np.empty(0, dtype=np.uint32)] * steps
    kept = {}
    scale, half = np.uint64(SCALE), np.uint64(32)
    for step in range(steps - 1, -1, -1):
        own = ids[step * lanes : (step + 1) * lanes]
        x = state[: len(own)]
        f = freq[own]
        full = x >= (f << np.uint64(63 - SCALE))
        if full.any():
            emitted[step] = (x[full] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            x = np.where(full, x >> half, x)
        quotient = x // f
        state[: len(own)] = (quotient << scale) + (x - quotient * f) + start[own]
        if step % EVERY == 0:
            kept[step] = state.copy()
    sizes = np.cumsum([0, *[len(x) for x in emitted]])
    marks = sorted(kept)
    states = np.concatenate([kept[m] for m in marks]) if marks else np.empty(0, dtype=np.uint64)
    positions = np.array([sizes[m] for m in marks], dtype=np.uint32)
    words = np.concatenate(emitted) if emitted else np.empty(0, dtype=np.uint32)
    return lanes, states.astype("<u8").tobytes(), positions.astype("<u4").tobytes(), words.astype("<u4").tobytes()


@dataclass
class Table:
    """A segment's frequencies, their running starts, and the id of each slot."""

    freq: np.ndarray
    start: np.ndarray
    slots: np.ndarray

    @classmethod
    def of(cls, raw: bytes) -> Table:
        pairs = np.frombuffer(raw, dtype="<u4").reshape(-1, 2).astype(np.int64)
        top = int(pairs[:, 0].max()) + 1 if len(pairs) else 0
        freq, start = np.zeros(top, dtype=np.uint64), np.zeros(top, dtype=np.uint64)
        freq[pairs[:, 0]] = pairs[:, 1]
        start[pairs[:, 0]] = np.cumsum(pairs[:, 1]) - pairs[:, 1]
        return cls(freq, start, np.repeat(pairs[:, 0], pairs[:, 1]).astype(np.uint32))


def decode_block(table: Table, n: int, lanes: int, states: bytes, positions: bytes, words: bytes, checkpoint: int = 0, stop: int | None = None) -> np.ndarray:
    """The block's ids from a checkpoint on, up to the step ``stop`` (both 0 and None: all)."""
    steps = -(-n // lanes)
    stop = steps if stop is None else min(stop, steps)
    first = checkpoint * EVERY
    state = np.frombuffer(states, dtype="<u8")[checkpoint * lanes : (checkpoint + 1) * lanes].astype(np.uint64)
    stream = np.frombuffer(words, dtype="<u4")
    at = int(np.frombuffer(positions, dtype="<u4")[checkpoint]) if n else 0
    out = np.empty(max(0, min(n, stop * lanes) - first * lanes), dtype=np.uint32)
    mask, scale, half = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32)
    for step in range(first, stop):
        size = min(lanes, n - step * lanes)
        x = state[:size]
        slot = x & mask
        ids = table.slots[slot]
        out[(step - first) * lanes : (step - first) * lanes + size] = ids
        x = table.freq[ids] * (x >> scale) + slot - table.start[ids]
        low = x < LOW
        m = int(np.count_nonzero(low))
        if m:
            x[low] = (x[low] << half) | stream[at : at + m]
            at += m
        state[:size] = x
    return out


#: White space other than the space and the line feed (and one that older tables call so).
RARE_SPACE = [chr(c) for c in (9, 11, 12, 13, 28, 29, 30, 31)]
WIDE_SPACE = [chr(c) for c in (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def plain(text: str) -> bool:
    """Whether each space stands between two characters that are no white space, so that the
    tokenizer's own splitting starts a new piece at every space."""
    if not text or text[0].isspace() or text[-1].isspace() or "  " in text or " \n" in text or "\n " in text:
        return False
    return not any(c in text for c in (RARE_SPACE if text.isascii() else RARE_SPACE + WIDE_SPACE))


class Encoder:
    """Ids of whole texts.  Of ``plain`` texts the distinct pieces that start at a space are encoded
    once, and kept for the texts to come; all other texts, and those that name an added token, are
    encoded as they are.  So is every text where the tokenizer does not split as ``plain`` needs it."""

    #: Pieces encoded in one call, and pieces kept at most (about 30 bytes each).
    PIECES, KNOWN = 5_000, 2_000_000
    #: Letters that no tokenizer splits, and signs that it splits from them.
    LETTERS, SIGNS = "[A-Za-zÀ-ÖØ-öø-ɏ]+", ".,;:!?"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        way = self.tokenizer.pre_tokenizer
        self.splits = isinstance(way, pre_tokenizers.ByteLevel) and not way.add_prefix_space and way.use_regex and self.tokenizer.normalizer is None
        vocabulary = self.tokenizer.get_vocab()
        self.leads = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)  # ids that start with the space
        self.leads[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True
        self.signs = [x.ids for x in self.tokenizer.encode_batch_fast(list(self.SIGNS), add_special_tokens=False)]
        self.splits = self.splits and all(len(ids) == 1 for ids in self.signs)
        self.forget()

    def forget(self) -> None:
        """Start with no known piece."""
        self.known = pa.array([], pa.large_string())
        self.flat, self.begins, self.sizes = np.zeros(1, dtype=np.uint32), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int32)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, each led by a space, one after another, and how many each has."""
        ids, sizes = [], []
        for lo in range(0, len(pieces), self.PIECES):
            own = pieces[lo : lo + self.PIECES]
            found = np.array(self.whole([" " + " ".join(own)])[0], dtype=np.uint32)
            starts = np.flatnonzero(self.leads[found])  # a piece holds no other space, so one id of it starts with one
            if len(starts) != len(own) or starts[0]:
                each = self.whole([" " + piece for piece in own])
                found, starts = np.array([i for x in each for i in x], dtype=np.uint32), np.cumsum([0, *[len(x) for x in each[:-1]]])
            ids.append(found)
            sizes.append(np.diff(starts, append=len(found)).astype(np.int32))
        return np.concatenate(ids), np.concatenate(sizes)

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """Numbers of distinct pieces among the known ones; those that are new are encoded first."""
        found = pc.index_in(pieces, value_set=self.known)
        new = pieces.filter(pc.is_null(found))
        if len(self.known) + len(new) > self.KNOWN and len(self.known):
            self.forget()
            return self._places(pieces)
        place = found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(new):
            ids, sizes = self._pieces(new.to_pylist())
            place[place < 0] = len(self.known) + np.arange(len(new))
            self.begins = np.concatenate([self.begins, len(self.flat) - 1 + np.cumsum(sizes, dtype=np.int64) - sizes])
            self.flat = np.concatenate([self.flat[:-1], ids, np.zeros(1, dtype=np.uint32)])  # one more, for a sign's place
            self.sizes = np.concatenate([self.sizes, sizes])
            self.known = pa.concat_arrays([self.known, new])
        return place

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, without an end id."""
        by_piece = [self.splits and plain(text) and not any(x in text for x in self.added) for text in texts]
        out: list[np.ndarray] = [np.empty(0, dtype=np.uint32)] * len(texts)
        odd = [i for i, simple in enumerate(by_piece) if not simple and texts[i]]
        for i, ids in zip(odd, self.whole([texts[i] for i in odd]), strict=True):
            out[i] = np.array(ids, dtype=np.uint32)
        simple = [i for i, x in enumerate(by_piece) if x]
        if not simple:
            return out
        split = pc.split_pattern(pa.array([texts[i] for i in simple], pa.large_string()), " ")
        starts = split.offsets.to_numpy()
        words = split.flatten()
        heads = self.whole(words.take(pa.array(starts[:-1])).to_pylist())  # a text's first word has no space before it
        coded = words.dictionary_encode()
        codes, distinct = coded.indices.to_numpy(), coded.dictionary
        # A word of letters with one sign after it is its letters' ids and the sign's.
        signed = pc.match_substring_regex(distinct, f"^{self.LETTERS}[{self.SIGNS}]$")
        sign = pc.index_in(pc.if_else(signed, pc.utf8_slice_codeunits(distinct, -1), ""), value_set=pa.array(list(self.SIGNS), pa.large_string()))
        sign = sign.fill_null(-1).to_numpy(zero_copy_only=False)
        bare = pc.if_else(signed, pc.utf8_slice_codeunits(distinct, 0, -1), distinct).dictionary_encode()
        place = self._places(bare.dictionary)[bare.indices.to_numpy()]
        del split, words, coded, distinct, bare
        begins, sizes = self.begins[place], self.sizes[place] + (sign >= 0)
        last = np.array([ids[0] for ids in self.signs], dtype=np.uint32)[sign]
        for lo in range(0, len(simple), 256):  # the ids of some texts at a time
            bounds = starts[lo : lo + 257]
            own = codes[bounds[0] : bounds[-1]]
            size = sizes[own]
            size[bounds[:-1] - bounds[0]] = 0
            ends = np.cumsum(size, dtype=np.int64)
            ids = self.flat[np.repeat(begins[own] - (ends - size), size) + np.arange(ends[-1])]
            ending = np.flatnonzero((sign[own] >= 0) & (size > 0))
            ids[ends[ending] - 1] = last[own[ending]]
            cuts = ends[bounds[1:] - bounds[0] - 1]
            for i, head, part in zip(simple[lo : lo + 256], heads[lo : lo + 256], np.split(ids, cuts[:-1]), strict=True):
                out[i] = np.concatenate([np.array(head, dtype=np.uint32), part])
        return out


_ENCODERS: dict[str, tuple[str, Encoder]] = {}


def encoder(path: str, job: str) -> Encoder:
    """The worker's encoder for a vocabulary file, kept from task to task; each job starts with no known piece."""
    last, own = _ENCODERS.get(path) or ("", Encoder(path))
    if last != job:
        own.forget()
    _ENCODERS[path] = job, own
    return own


def segment_rows(part: int, segment: int, docs: list[tuple[int | None, np.ndarray]]) -> Iterator[tuple]:
    """The rows of a segment's blocks."""
    whole = np.concatenate([ids for _, ids in docs])
    freq = quantised(np.bincount(whole))
    start = np.cumsum(freq) - freq
    used = np.flatnonzero(freq)
    table = np.stack([used, freq[used].astype(np.int64)], axis=1).astype("<u4").tobytes()
    at = block = 0
    while at < len(docs):
        end, n = at, 0
        while end < len(docs) and (n == 0 or n < BLOCK_IDS):
            n += len(docs[end][1])
            end += 1
        own = docs[at:end]
        ids = np.concatenate([x for _, x in own])
        lanes, states, positions, words = encode_block(ids, freq, start)
        keys = np.array([0 if k is None else k for k, _ in own], dtype="<i8").tobytes()
        flags = np.array([k is None for k, _ in own], dtype=np.uint8).tobytes()
        sizes = np.array([len(x) for _, x in own], dtype="<u4").tobytes()
        plain_ids, span = ids.astype("<u4"), EVERY * lanes
        crcs = np.array([zlib.crc32(plain_ids[lo : lo + span]) for lo in range(0, len(ids), span)], dtype="<u4").tobytes()
        yield part, segment, block, at, len(own), len(ids), lanes, zlib.crc32(plain_ids), table if block == 0 else None, keys, flags, sizes, states, positions, crcs, words
        at, block = end, block + 1


def _writer(path: str, job: str):
    names = [x.split()[0] for x in BLOCKS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        coder, waiting, n, segment = encoder(path, job), [], 0, 0
        for batch in batches:
            strings, keys = texts(batch["text"]), [None if pd.isna(k) else int(k) for k in batch["doc_id"]]
            at = 0
            while at < len(strings):
                end, size = at, 0
                while end < len(strings) and size < RANGE_BYTES:
                    size += len(strings[end])
                    end += 1
                for key, ids in zip(keys[at:end], coder.encode(strings[at:end]), strict=True):
                    waiting.append((key, np.append(ids, np.array([END], dtype=ids.dtype))))
                    n += len(ids) + 1
                    if n >= SEGMENT_IDS:
                        for row in segment_rows(part, segment, waiting):
                            yield pd.DataFrame([row], columns=names)
                        waiting, n, segment = [], 0, segment + 1
                at = end
        if waiting:
            for row in segment_rows(part, segment, waiting):
                yield pd.DataFrame([row], columns=names)

    return run


def write(docs: DataFrame, path: str, vocabulary: str) -> None:
    """Write the ids of all texts (null: empty), each with its end id, in ascending order of doc_id (null first).

    Rows that repeat an id, or have none, follow each other in the order of their texts' hashes, so that
    a rerun writes the same.  An empty table writes no block.
    """
    bytes_, rows = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    ranges = max(1, -(-int(bytes_ or 0) // RANGE_BYTES))
    ties = F.xxhash64("text")
    ordered = docs.select("doc_id", "text").repartitionByRange(ranges, "doc_id", ties).sortWithinPartitions("doc_id", ties, "text")
    ordered.mapInPandas(_writer(vocabulary, uuid.uuid4().hex), BLOCKS).write.option("compression", "none").parquet(path)


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows, each with its segment's table as ``shared``."""
    stored = spark.read.schema(BLOCKS).parquet(path)
    tables = stored.where("table is not null").select("part", "segment", F.col("table").alias("shared"))
    return stored.drop("table").join(tables, ["part", "segment"])


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Decode the files: part, segment, place, doc_id, n_tokens, ids_crc32, ids (if asked for) in no order of rows.

    A block whose ids fail its checksum raises.  ``place`` numbers a segment's documents.
    """
    blocks = _blocks(spark, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, table = None, None
        for batch in batches:
            for b in batch.itertuples(index=False):
                if (b.part, b.segment) != last:
                    last, table = (b.part, b.segment), Table.of(b.shared)
                ids = decode_block(table, b.n_ids, b.lanes, b.states, b.positions, b.words).astype("<u4")
                if zlib.crc32(ids) != b.crc:
                    raise ValueError(f"checksum of part {b.part}, segment {b.segment}, block {b.block} fails")
                sizes = np.frombuffer(b.doc_tokens, dtype="<u4").astype(np.int64)
                ends = np.cumsum(sizes)
                keys = pd.array(np.frombuffer(b.doc_ids, dtype="<i8"), dtype="Int64")
                keys[np.frombuffer(b.no_id, dtype=np.uint8).astype(bool)] = pd.NA
                own = [ids[e - s : e] for s, e in zip(sizes, ends, strict=True)]
                yield pd.DataFrame({"part": b.part, "segment": b.segment, "place": b.first + np.arange(len(own), dtype=np.int32), "doc_id": keys, "n_tokens": sizes, "ids_crc32": [zlib.crc32(x) for x in own], "ids": [x.tobytes() if with_ids else None for x in own]})

    return blocks.mapInPandas(run, "part int, segment int, place int, doc_id long, n_tokens long, ids_crc32 long, ids binary")


def fetch(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id, ids (32-bit numbers as bytes) of the documents with these ids: a list that the driver can hold.

    Of each block only what lies between the checkpoint before such a document and the one
    after it is decoded; a part whose ids fail its checksum raises.
    """
    wanted = np.unique(np.array(doc_ids, dtype=np.int64))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in batch.itertuples(index=False):
                keys, sizes = np.frombuffer(b.doc_ids, dtype="<i8"), np.frombuffer(b.doc_tokens, dtype="<u4").astype(np.int64)
                ends, span, crcs = np.cumsum(sizes), EVERY * b.lanes, np.frombuffer(b.crcs, dtype="<u4")
                own = np.flatnonzero(np.isin(keys, wanted) & ~np.frombuffer(b.no_id, dtype=np.uint8).astype(bool))
                if not len(own):
                    continue
                table, parts, out = Table.of(b.shared), {}, []
                for i in own:
                    first, last = (ends[i] - sizes[i]) // span, (ends[i] - 1) // span
                    parts = {k: v for k, v in parts.items() if k >= first}
                    for k in range(first, last + 1):
                        if k not in parts:
                            parts[k] = decode_block(table, b.n_ids, b.lanes, b.states, b.positions, b.words, k, (k + 1) * EVERY).astype("<u4")
                            if zlib.crc32(parts[k]) != crcs[k]:
                                raise ValueError(f"checksum of part {b.part}, segment {b.segment}, block {b.block}, checkpoint {k} fails")
                    whole = np.concatenate([parts[k] for k in range(first, last + 1)])
                    out.append((keys[i], whole[ends[i] - sizes[i] - first * span : ends[i] - first * span].tobytes()))
                yield pd.DataFrame(out, columns=["doc_id", "ids"])

    return _blocks(spark, path).mapInPandas(run, "doc_id long, ids binary")


def offsets(stored: DataFrame) -> DataFrame:
    """For each part and segment the ids of all segments before it, from the blocks' headers alone."""
    sizes = stored.groupBy("part", "segment").agg(F.sum("n_ids").alias("own"))
    parts = sizes.groupBy("part").agg(F.sum("own").alias("all")).withColumn("parts_before", F.sum("all").over(Window.orderBy("part")) - F.col("all"))
    inside = F.sum("own").over(Window.partitionBy("part").orderBy("segment")) - F.col("own")
    return sizes.withColumn("inside", inside).join(parts, "part").select("part", "segment", (F.col("parts_before") + F.col("inside")).alias("before"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""
    decoded = read(spark, path, with_ids=False).drop("ids")
    within = F.sum("n_tokens").over(Window.partitionBy("part", "segment").orderBy("place")) - F.col("n_tokens")
    starts = offsets(spark.read.schema(BLOCKS).parquet(path))
    return decoded.withColumn("within", within).join(starts, ["part", "segment"]).select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def query(spark, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """op1: what the files hold of every row of documents."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    path = f"{scratch_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write(documents(spark, sf_dir), path, vocabulary)
    return listing(spark, path)
