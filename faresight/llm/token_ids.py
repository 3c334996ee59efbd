"""Token ids in binary shards with Elias-Fano document boundaries.

A shard file holds a run of documents in ascending id order:

    ids        all ids of its documents, end ids included, little-endian, in
               2 bytes each where the vocabulary allows, else 4
    offsets    Elias-Fano sequence: where each document starts, and the end
    doc ids    Elias-Fano sequence: ids less the shard's smallest
    footer     JSON: widths, counts, places of the sequences
    tail       length of the footer (4 bytes), ``MAGIC``

An Elias-Fano sequence of n values up to u takes about 2 + log2(u / n) bits
a value: the low bits of each packed, the high parts in unary in one bit
vector. ``EliasFano.__getitem__`` selects the i-th set bit of that vector by a
directory of 32-bit counts, one for each 512 bits, so a document's offset is
found without a table of 64-bit offsets and without reading the others.

Documents are tokenized where they are read. Words between white space are
tokenized apart, each distinct word of a task once: the tokenizer's
normalization and pre-tokens never reach across white space, so the ids are
those of the whole text (the tests compare). Where the vocabulary's split is
known to part letters, digits and marks and its normalization to lower-case
(``_SPLIT``, ``_FOLD``), words are cut there too and A-Z lower-cased first,
so that "Word," and "word" share a piece. Only ids are shuffled, by
ranges of the document id that hold equal amounts of text; a range is a
task, which appends to files that roll at ``SHARD_IDS``: the same documents
give the same files whatever the partitioning. Files are written under a name of the task attempt;
those that Spark commits get their final names, and the manifest, written
last, says which files belong to the set and how many ids stand before each.

Defined results: a null or empty text has no ids but the end id; null ids
come last; documents with the same id stand next to each other in an order
fixed by their text's hash; repeated rows are written each (rows that agree in
id and text fall into one range, whose task streams them); a very long text
is one document of any length (a shard rolls behind it); an empty table
gives a set without files. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faresight.llm.common import arrow_batches, map_arrow, materialize, scratch_path, table
from faresight.llm.interning import distinct_words
from faresight.llm.words import Words

VOCABULARY = "word_bpe_49k.json"      # of the installed public vocabularies
END_ID = 1
SHARD_IDS = 1 << 25       # ids at which a file is closed
RANGE_BYTES = 64 << 20    # text of a range of documents, at least
RANGES = 1 << 14          # at most: where the text is more, ranges are larger
MAGIC = b"EFTOKEN1"
HELD_IDS = 1 << 22        # ids of words that a task keeps
JOINED = 64               # words tokenized together
MARK = "|"                # between them
TEXT_BYTES = 4 << 20      # text encoded together
DOCS = 4096               # documents read at a time
_BLOCK = 512              # bits of each entry of a select directory

#: ASCII white space ends words; letters keep their case.
_CASED = np.arange(256, dtype=np.uint8)
_CASED[[0x20, 9, 10, 13]] = 0
_CASED[0] = 0xFF          # occurs in no UTF-8 text; stands for the zero byte

#: A pre-tokenizer that parts letters, digits and marks, but for an apostrophe
#: and what follows it; and a normalizer that lower-cases character by character.
_SPLIT = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed",
     "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
_FOLD = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
#: Kinds of bytes: 0 white space and others that stay with their neighbours
#: (controls, marks of special tokens, most characters beyond ASCII).
_LETTER, _DIGIT, _SIGN, _APOSTROPHE = 1, 2, 3, 4
_CUTS = np.zeros((5, 5), bool)            # between a byte of one kind and the next
_CUTS[1:4, 1:4] = ~np.eye(3, dtype=bool)
_CUTS[[_LETTER, _DIGIT], _APOSTROPHE] = True
_FOLDED = _CASED.copy()
_FOLDED[0x41:0x5B] += 32


class Cutter:
    """Words of texts, cut where the pre-tokenizer ``_SPLIT`` does whatever
    stands around: between letters, digits and marks of ASCII (and the letters
    of U+00C0 to U+00FF). No mark of a special token is parted from its
    neighbours, and nothing that may combine with others."""

    def __init__(self, special: list[str]):
        self.kind = np.zeros(256, np.uint8)
        for b in range(0x21, 0x7F):
            c = chr(b)
            self.kind[b] = _LETTER if c.isalpha() else _DIGIT if c.isdigit() else _APOSTROPHE if c == "'" else _SIGN
        for b in "".join(special).encode():
            if not chr(b).isalnum():
                self.kind[b] = 0

    @classmethod
    def of(cls, model: str) -> Cutter | None:
        """None if the vocabulary is of another form, or has special tokens that cuts would part."""
        m = json.loads(model)
        added = m.get("added_tokens") or []
        if m.get("pre_tokenizer") != _SPLIT or m.get("normalizer") != _FOLD or any(
                t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            return None
        out = cls([t["content"] for t in added])
        for t in added:
            own = np.frombuffer(t["content"].encode(), np.uint8)
            if len(out.cuts(own)) or out.kind[own].all():     # the latter would be lower-cased
                return None
        return out

    def kinds(self, buf: np.ndarray) -> np.ndarray:
        out = self.kind[buf]
        at = np.flatnonzero(buf[:-1] == 0xC3)
        at = at[(buf[at + 1] != 0x97) & (buf[at + 1] != 0xB7)]      # but for the signs of times and division
        out[at] = out[at + 1] = _LETTER
        return out

    def cuts(self, buf: np.ndarray) -> np.ndarray:
        self.last = kinds = self.kinds(buf)
        return np.flatnonzero(_CUTS.ravel()[kinds[:-1] * np.uint8(5) + kinds[1:]]) + 1

    def __call__(self, texts: pa.Array) -> Words:
        words = Words(texts, _CASED, self.cuts)
        cased, words.low = words.low, _FOLDED[words.low]
        whole = np.flatnonzero((self.last == 0) & (cased != 0))
        odd = np.unique(np.searchsorted(words.start, whole, "right") - 1)     # these keep their case
        size = words.end[odd] - words.start[odd]
        at = np.arange(size.sum()) + np.repeat(words.start[odd] - np.cumsum(size) + size, size)
        words.low[at] = cased[at]
        return words


class EliasFano:
    """A sequence of non-decreasing integers of 0 up to 2^64 - 1."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ranks: np.ndarray):
        self.n, self.low_bits, self.high, self.ranks = n, low_bits, high.reshape(-1, _BLOCK // 8), ranks
        self.low = np.ascontiguousarray(low)
        self._lane = np.ndarray((len(low) - 7,), "<u8", self.low, strides=(1,))

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        top = int(v[-1]) if len(v) else 0
        bits = min(56, max(0, (top // max(1, len(v))).bit_length() - 1))
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(len(v))
        blocks = int(ones[-1]) // _BLOCK + 1 if len(v) else 1
        flags = np.zeros(blocks * _BLOCK, np.uint8)
        flags[ones] = 1
        per = flags.reshape(blocks, _BLOCK).sum(1)
        low = [np.packbits(((v[a:a + 8192, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(),
                           bitorder="little") for a in range(0, len(v), 8192)] if bits else []
        return cls(len(v), bits, np.concatenate([*low, np.zeros(8, np.uint8)]), np.packbits(flags, bitorder="little"),
                   (np.cumsum(per) - per).astype("<u4"))

    def _select(self, i: np.ndarray) -> np.ndarray:
        """Position of the i-th set bit (from 0) of the high vector."""
        block = np.searchsorted(self.ranks, i, "right") - 1
        seen = np.unpackbits(self.high[block], axis=1, bitorder="little").cumsum(1, dtype=np.uint16)
        return block * _BLOCK + (seen == (i - self.ranks[block] + 1)[:, None]).argmax(1)

    def __getitem__(self, i) -> np.ndarray:
        """The values at positions ``i``."""
        i = np.atleast_1d(np.asarray(i, np.int64))
        if len(i) and not 0 <= i.min() <= i.max() < self.n:
            raise IndexError("position out of range")
        out = np.empty(len(i), np.uint64)
        for a in range(0, len(i), 4096):
            k = i[a:a + 4096]
            at = k * self.low_bits
            low = (self._lane[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)
            out[a:a + 4096] = ((self._select(k) - k).astype(np.uint64) << np.uint64(self.low_bits)) | low
        return out

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.low_bits, len(self.low), len(self.high)], "<u8")
        return head.tobytes() + self.low.tobytes() + self.high.tobytes() + self.ranks.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, bits, low, blocks = (int(x) for x in np.frombuffer(data, "<u8", 4))
        body = np.frombuffer(data, np.uint8, offset=32)
        high = low + blocks * _BLOCK // 8
        return cls(n, bits, body[:low], body[low:high], body[high:high + 4 * blocks].view("<u4"))


class Encoder:
    """Ids of whole batches; each distinct word is tokenized once while it is kept."""

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"        # a task, a core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(model)
        self.cutter = Cutter.of(model)
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else -1
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _tokenize(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, how many of each word): ``JOINED`` words at a time, a mark
        behind each. Where a word gives the mark's id too, or the vocabulary has no
        such id, ids are given out by their places."""
        ids, size = [], []
        parts = [words[a:a + JOINED] for a in range(0, len(words), JOINED)]
        got = self.tokenizer.encode_batch_fast([" ".join([f" {MARK} ".join(part), MARK]) for part in parts], add_special_tokens=False)
        for part, e in zip(parts, got):
            own = np.array(e.ids, np.uint32)
            ends = np.flatnonzero(own == self.mark)
            if len(ends) == len(part) and ends[-1] == len(own) - 1:
                ids.append(own[own != self.mark])
                size.append(np.diff(ends, prepend=-1) - 1)
            else:
                own, n = self._by_place(part)
                ids.append(own)
                size.append(n)
        return np.concatenate(ids), np.concatenate(size)

    def _by_place(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same, each id given to the word that holds its place."""
        e = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        at = np.fromiter(chain.from_iterable(e.offsets), np.int64, 2 * len(e.ids))[::2]
        return np.array(e.ids, np.uint32), np.bincount(np.searchsorted(ends, at, "right"), minlength=len(words))

    def _keep(self, words: list[bytes], ids: np.ndarray, size: np.ndarray) -> None:
        upto = self.used + np.cumsum(size)
        self.known.update(zip(words, range(len(self.size), len(self.size) + len(words))))
        self.begin = np.concatenate([self.begin, upto - size])
        self.size = np.concatenate([self.size, size])
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used:self.used + len(ids)] = ids
        self.used += len(ids)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, how many of each text)."""
        words = self.cutter(texts) if self.cutter else Words(texts, _CASED)
        names, number = distinct_words(words)
        if self.used > HELD_IDS:
            self.forget()
        word = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        at = np.flatnonzero(word < 0)
        if len(at):
            new = [names[i] for i in at.tolist()]
            word[at] = np.arange(len(self.size), len(self.size) + len(new))
            self._keep(new, *self._tokenize(b" ".join(new).replace(b"\xff", b"\0").decode().split(" ")))
        word = word[number]
        size = self.size[word]
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = self.pool[np.arange(upto[-1]) + np.repeat(self.begin[word] - upto[:-1], size)]
        return ids, np.diff(upto[words.first])


_ENCODERS: dict[str, Encoder] = {}        # of this Python worker


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def range_starts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", range_bytes: int | None = None
                 ) -> list[tuple[bool, int | None, int]]:
    """Where each range of documents after the first starts, in the order
    (null ids last, id, hash of the text): ranges of ``range_bytes`` of text, by
    exact running sums, at most ``RANGES`` of them."""
    body = F.coalesce(F.col(text), F.lit(""))
    order = [F.col("doc_id").isNull(), "doc_id", "hash"]
    sizes = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(body).alias("hash"),
                        (F.octet_length(body) + F.lit(1).cast("long")).alias("bytes"))
    placed = materialize(sizes.groupBy("doc_id", "hash").agg(F.sum("bytes").alias("bytes")).orderBy(*order)
                         .withColumn("part", F.spark_partition_id()), "token_sizes")
    before = placed.groupBy("part").agg(F.sum("bytes").alias("size"))
    before = before.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("base"))
    total = placed.agg(F.sum("bytes")).first()[0] or 0
    step = max(range_bytes or RANGE_BYTES, math.ceil(total / RANGES))
    upto = Window.partitionBy("part").orderBy(*order)
    at = (placed.join(F.broadcast(before), "part")          # one row a partition
          .withColumn("range", F.floor((F.col("base") + F.sum("bytes").over(upto) - F.col("bytes")) / step)))
    starts = at.groupBy("range").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")).alias("s"))
    return [tuple(r["s"]) for r in starts.orderBy("range").collect()][1:]


def encode(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID,
           starts: list | None = None) -> DataFrame:
    """(range, doc_id, hash, n_tokens, ids): ids of each document, the end id
    last, packed little-endian in ``id_bytes`` of the vocabulary, and the range
    of ``starts`` it falls into. The driver reads the vocabulary file (a few
    MB) and hands it to the executors."""
    with open(vocabulary, encoding="utf-8") as f:
        model = f.read()
    width = id_bytes(model, end_id)
    held, name = docs.sparkSession.sparkContext.broadcast((model, starts or [])), hashlib.sha256(model.encode()).hexdigest()

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait, size = [], 0
        for b in batches:
            if wait and size + b.nbytes > TEXT_BYTES:
                yield pa.concat_batches(wait)
                wait, size = [], 0
            wait.append(b)
            size += b.nbytes
        if wait:
            yield pa.concat_batches(wait)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (one(b) for b in gathered(batches) if b.num_rows)

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        model, starts = held.value
        if name not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[name] = Encoder(model)
        ids, size = _ENCODERS[name](b.column(2))
        all_ids = np.insert(ids, np.cumsum(size), end_id).astype(f"<u{width}")
        cuts = np.concatenate([[0], np.cumsum(size + 1)])
        packed = pa.Array.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer(cuts * width), pa.py_buffer(all_ids)])
        place = [bisect_right(starts, (k is None, k or 0, h), key=lambda s: (s[0], s[1] or 0, s[2]))
                 for k, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        return pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), b.column(0), b.column(1), pa.array(size + 1),
                                           packed.cast(pa.binary())], ["range", "doc_id", "hash", "n_tokens", "ids"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("hash"),
                       F.col(text).alias("text"))
    arrow_batches(docs.sparkSession)
    return rows.mapInArrow(run, "range int, doc_id long, hash long, n_tokens long, ids binary")


def id_bytes(model: str, end_id: int = END_ID) -> int:
    from tokenizers import Tokenizer
    return 2 if max(Tokenizer.from_str(model).get_vocab_size() - 1, end_id) < 1 << 16 else 4


class ShardWriter:
    """Appends documents to one file."""

    def __init__(self, stream, width: int):
        self.stream, self.width = stream, width
        self.keys: list[int] = []
        self.ends: list[int] = [0]

    def add(self, doc_id: int | None, ids) -> None:
        self.stream.write(ids)
        self.ends.append(self.ends[-1] + len(ids) // self.width)
        if doc_id is not None:
            self.keys.append(doc_id)                          # null ids come last

    def close(self) -> tuple[int, int, int]:
        """(documents, ids, bytes)"""
        least = self.keys[0] if self.keys else 0
        at = self.ends[-1] * self.width
        offsets = EliasFano.encode(np.array(self.ends, np.uint64)).to_bytes()
        keys = EliasFano.encode(np.array(self.keys, np.int64).astype(np.uint64) - np.array(least).astype(np.uint64)).to_bytes()
        foot = json.dumps({"width": self.width, "docs": len(self.ends) - 1, "ids": self.ends[-1], "least": least,
                           "offsets": [at, len(offsets)], "keys": [at + len(offsets), len(keys)]}).encode()
        tail = foot + len(foot).to_bytes(4, "little") + MAGIC
        self.stream.write(offsets + keys + tail)
        self.stream.close()
        return len(self.ends) - 1, self.ends[-1], at + len(offsets) + len(keys) + len(tail)


class Shard:
    """Random access to one file's documents."""

    def __init__(self, file):
        self.file, size = file, file.size()
        tail = file.read_at(12, size - 12)
        if tail[4:] != MAGIC:
            raise ValueError("not a token shard")
        n = int.from_bytes(tail[:4], "little")
        self.meta = json.loads(file.read_at(n, size - 12 - n))
        self.offsets, self.keys = (EliasFano.from_bytes(file.read_at(length, at)) for at, length in (
            self.meta["offsets"], self.meta["keys"]))

    def __len__(self) -> int:
        return self.meta["docs"]

    def doc_ids(self, i: int, j: int) -> list[int | None]:
        m = self.keys.n
        keys = self.keys[np.arange(i, min(j, m))] + np.array(self.meta["least"]).astype(np.uint64)
        return keys.astype(np.int64).tolist() + [None] * (j - max(i, min(j, m)))

    def documents(self, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of documents i to j - 1, where each starts and the last one
        ends in the shard)."""
        at = self.offsets[np.arange(i, j + 1)].astype(np.int64)
        w = self.meta["width"]
        return np.frombuffer(self.file.read_at(int(at[-1] - at[0]) * w, int(at[0]) * w), f"<u{w}"), at


def write_shards(docs: DataFrame, folder: str, vocabulary: str | None = None, doc_id: str = "doc_id", text: str = "text",
                 end_id: int = END_ID, shard_ids: int = SHARD_IDS, range_bytes: int | None = None) -> DataFrame:
    """Tokenize ``docs`` and write them below ``folder`` (a URI that all
    executors reach); returns the manifest: number, name, docs, ids, bytes,
    base (ids before the file)."""
    spark = docs.sparkSession
    vocabulary = vocabulary or vocabulary_path()
    with open(vocabulary, encoding="utf-8") as f:
        width = id_bytes(f.read(), end_id)
    starts = range_starts(docs, doc_id, text, range_bytes)
    ranged = (encode(docs, vocabulary, doc_id, text, end_id, starts).repartitionById(len(starts) + 1, F.col("range"))
              .sortWithinPartitions(F.col("doc_id").isNull(), "doc_id", "hash").select(F.col("range").cast("long"), "doc_id", "ids"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        attempt, out, seq = f"{root}/_temporary/{uuid.uuid4().hex}", None, -1

        def done() -> pa.RecordBatch:
            row = (part, seq, f"{attempt}/{seq}", *out.close())
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)],
                                              ["part", "seq", "temporary", "docs", "ids", "bytes"])

        for b in batches:
            for part, key, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if out is not None and out.ends[-1] >= shard_ids:
                    yield done()
                    out = None
                if out is None:
                    fs.create_dir(attempt, recursive=True)
                    seq += 1
                    out = ShardWriter(fs.open_output_stream(f"{attempt}/{seq}", compression=None), width)
                out.add(key, ids.as_buffer())
        if out is not None:
            yield done()

    arrow_batches(spark)
    schema = "part long, seq long, temporary string, docs long, ids long, bytes long"
    written = materialize(ranged.mapInArrow(write, schema), "token_files")
    in_order = Window.orderBy("part", "seq")                  # one row a file
    written = materialize(
        written.withColumn("number", F.row_number().over(in_order).cast("long") - 1)
        .withColumn("base", F.sum("ids").over(in_order) - F.col("ids"))
        .select("number", F.format_string("tokens-%08d.bin", "number").alias("name"), "docs", "ids", "bytes", "base", "temporary"),
        "token_manifest")

    def commit(b: pa.RecordBatch) -> pa.RecordBatch:
        fs, root = pafs.FileSystem.from_uri(folder)
        for name, temporary in zip(b.column(1).to_pylist(), b.column(6).to_pylist()):
            if fs.get_file_info(temporary).type != pafs.FileType.NotFound:      # else an earlier try moved it
                fs.move(temporary, f"{root}/{name}")
        return b

    moved = map_arrow(written, commit, written.schema)
    moved.drop("temporary").write.mode("overwrite").parquet(f"{folder}/manifest")
    fs, root = pafs.FileSystem.from_uri(folder)
    if fs.get_file_info(f"{root}/_temporary").type != pafs.FileType.NotFound:
        fs.delete_dir(f"{root}/_temporary")         # of attempts that failed
    return spark.read.parquet(f"{folder}/manifest")


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document of the manifest's
    files; ``start`` counts the ids of all documents before it, ``ids`` are
    little-endian unsigned 32-bit integers."""
    files = spark.read.parquet(f"{folder}/manifest").select("number", "name", "base")
    files = files.repartitionById(max(1, files.count()), F.col("number").cast("int"))      # a file, a task

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for name, base in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                with fs.open_input_file(f"{root}/{name}") as file:
                    shard, i = Shard(file), 0
                    while i < len(shard):
                        j = min(i + DOCS, len(shard))
                        at = shard.offsets[np.arange(i, j + 1)]
                        j = i + max(1, int(np.searchsorted(at, at[0] + np.uint64(1 << 20), "right")) - 1)   # some 4 MB
                        j = min(j, len(shard))
                        ids, at = shard.documents(i, j)
                        cuts = ((at - at[0]) * 4).astype(np.int64)
                        packed = pa.Array.from_buffers(pa.large_binary(), j - i, [
                            None, pa.py_buffer(cuts), pa.py_buffer(ids.astype("<u4"))])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(shard.doc_ids(i, j), pa.int64()), pa.array(base + at[:-1]), pa.array(np.diff(at)),
                             packed.cast(pa.binary())], ["doc_id", "start", "n_tokens", "ids"])
                        i = j

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def op13_token_ids(spark, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, f"tokens-{uuid.uuid4().hex}")
    write_shards(table(spark, sf_dir, "documents"), folder)
    return read_shards(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
