"""Token ids in Simple-8b blocks: encode texts, write them, read them back.

A block is a run of whole documents. Its ids are packed into 64-bit words: four bits
of selector, then as many ids of equal width as fit into sixty bits. An id too wide
for a shared word is escaped into a word of its own. A block row holds

``part, seq``
    its place: files ascend by ``part``, blocks within a file by ``seq``
``doc_ids, lengths``
    the documents and their numbers of ids (the end id included)
``n_ids, words``
    all ids of the block, packed, as little-endian 64-bit words

Blocks are rows of Parquet files, so any store that Spark writes to can hold them.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowgauge.runtime import scratch_path

#: Fixed values of Simple-8b: how many ids a word holds, and the bits of each, by selector.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])

#: Bits of small ids.
_BITS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)

#: A block is closed once it holds so many ids; the last document stays whole.
BLOCK_IDS = 1 << 16
#: Ids that a task remembers for pieces of text before it starts afresh.
REMEMBERED_PIECES = 1_000_000

BLOCK_SCHEMA = "part int, seq long, doc_ids array<long>, lengths array<int>, n_ids long, words binary"


def pack(ids: np.ndarray) -> bytes:
    """Ids below 2**60 as Simple-8b words. The last word may be padded with zeros."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    n = len(ids)
    if not n:
        return b""
    bits = np.zeros(n + 240, dtype=np.uint8)
    # Exact below 2**52; wider ids are escaped whatever their width.
    if ids.max() < len(_BITS):
        bits[:n] = _BITS[ids.view(np.int64)]
    else:
        bits[:n] = np.where(ids >> np.uint64(30), 60, np.frexp((ids & np.uint64((1 << 30) - 1)).astype(np.float64))[1])
    # Widest id of every run that starts at a place, by doubling.
    widest, span = {1: bits}, 1
    while span < 128:
        last = widest[span]
        wider = last.copy()
        np.maximum(last[:-span], last[span:], out=wider[:-span])
        span *= 2
        widest[span] = wider
    choice = np.full(n, 15, dtype=np.uint8)
    for selector in range(14, -1, -1):
        count, width = int(COUNTS[selector]), int(WIDTHS[selector])
        half = 1 << (count.bit_length() - 1)
        run = widest[half][:n]
        if half != count:
            run = np.maximum(run, widest[half][count - half : count - half + n])
        np.copyto(choice, np.uint8(selector), where=run <= width)
    steps = COUNTS[choice].tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += steps[at]
    begin = np.array(starts)
    selectors = choice[begin]
    words = selectors.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([ids, np.zeros(240, dtype=np.uint64)])
    for selector in np.unique(selectors):
        count, width = int(COUNTS[selector]), int(WIDTHS[selector])
        if width:
            own = np.nonzero(selectors == selector)[0]
            lanes = padded[begin[own][:, None] + np.arange(count)]
            shifts = (np.arange(count) * width).astype(np.uint64)
            words[own] |= np.bitwise_or.reduce(lanes << shifts, axis=1)
    return words.astype("<u8").tobytes()


def unpack(words: bytes, n: int) -> np.ndarray:
    """The first ``n`` ids of packed words, all words of one selector at a time."""
    words = np.frombuffer(words, dtype="<u8").astype(np.uint64)
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selectors]
    begin = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), dtype=np.uint64)
    for selector in np.unique(selectors):
        count, width = int(COUNTS[selector]), int(WIDTHS[selector])
        if width:
            own = np.nonzero(selectors == selector)[0]
            shifts = (np.arange(count) * width).astype(np.uint64)
            lanes = (words[own][:, None] >> shifts) & np.uint64((1 << width) - 1)
            out[begin[own][:, None] + np.arange(count)] = lanes
    return out[:n]


class _Known(dict):
    """Ids of pieces as bytes; a piece asked for the first time is learnt."""

    def __init__(self, learn: Callable[[str], bytes]):
        super().__init__()
        self.learn = learn

    def __missing__(self, piece: str) -> bytes:
        ids = self[piece] = self.learn(piece)
        return ids


class PieceEncoder:
    """Ids of whole texts by the tokenizers library, remembering pieces seen before.

    A byte-level pre-tokenizer never joins what stands before a single space or line end
    with what stands from it on, if neither neighbour is white space, nor a letter with the
    sentence mark after it. Texts are cut at such places, and the library encodes each
    distinct piece once. ``remembered`` bounds the memory; it does not change the ids.

    A piece is known under its own text if it begins with white space or stands first (then
    marked by a zero character), and else stands for the piece with a space before it.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED_PIECES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.remembered = remembered
        #: Pieces met of late and those met before them.
        self.known = _Known(self._learn)
        self.older: dict[str, bytes] = {}
        # Byte-level vocabularies write a printable byte as itself and the others as
        # characters from 256 on, in order.
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = iter(range(256, 512))
        self.written = {b: chr(b) if b in printable else chr(next(others)) for b in range(256)}

    @staticmethod
    def of_process(path: str) -> PieceEncoder:
        """The encoder that earlier tasks of this worker process have filled, or a new one."""
        held = sys.__dict__.setdefault("_flowgauge_encoders", {})
        if path not in held:
            held[path] = PieceEncoder(path)
        return held[path]

    @staticmethod
    def pieces(text: str) -> list[str]:
        if " ".join(text.split()) == text.replace("\n", " "):
            out = text.replace("\n", " \n").split(" ")
        else:  # white space of other kinds or in runs: cut at single spaces between other characters
            out, glue = [], False
            for i, piece in enumerate(text.split(" ")):
                if i and (glue or not piece or piece[0].isspace()):
                    out[-1] += " " + piece
                else:
                    out.append(piece)
                glue = not piece or piece[-1].isspace()
        out[0] = "\0" + out[0]
        return out

    def _word(self, text: str, before: str = "") -> bytes:
        """Ids of one pre-token of Latin letters: the library's model, without the steps around it."""
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(self.written)
        return array("I", [t.id for t in self.model.tokenize(before + text)]).tobytes()

    def _learn(self, p: str) -> bytes:
        if p in self.older:
            return self.older[p]
        mark = p[-1] if p[-1] in ".,;:!?" else ""
        word = p[p[0] in "\0\n" : len(p) - len(mark)]
        # Latin letters, so that the library surely takes them as letters too
        if not (word.isalpha() and (word.isascii() or max(word) < "\u0250")):
            raw = p[1:] if p[0] == "\0" else p if p[0] == "\n" else " " + p
            found = self.tokenizer.encode([raw], is_pretokenized=True, add_special_tokens=False).ids
            return array("I", found).tobytes()
        after = self._of(mark) if mark else b""
        if p[0] == "\0":
            return self._word(word) + after
        if p[0] == "\n":
            return self._of("\n") + self._word(word) + after
        return (self.known[word] if mark else self._word(word, self.written[32])) + after

    def _of(self, mark: str) -> bytes:
        """Ids of a mark or line end that stands alone."""
        key = "\0" + mark
        if not dict.__contains__(self.known, key):
            self.known[key] = array("I", self.tokenizer.encode(mark, add_special_tokens=False).ids).tobytes()
        return self.known[key]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > self.remembered // 2:
            self.known, self.older = _Known(self._learn), self.known
        ids = self.known.__getitem__
        return [np.frombuffer(b"".join(map(ids, self.pieces(t))), dtype=np.uint32) for t in texts]


def _encoder(path: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives the parallelism
        encoder = PieceEncoder.of_process(path)
        part, seq = TaskContext.get().partitionId(), 0
        docs: list[int | None] = []
        ids: list[np.ndarray] = []
        held = 0

        def block() -> pa.RecordBatch:
            flat = np.concatenate(ids)
            return pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int32()),
                    "seq": pa.array([seq], pa.int64()),
                    "doc_ids": pa.array([docs], pa.list_(pa.int64())),
                    "lengths": pa.array([[len(x) for x in ids]], pa.list_(pa.int32())),
                    "n_ids": pa.array([len(flat)], pa.int64()),
                    "words": pa.array([pack(flat)], pa.binary()),
                }
            )

        end = np.array([end_id], dtype=np.uint32)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, 128):
                some = [t or "" for t in texts.slice(at, 128).to_pylist()]
                for key, got in zip(keys.slice(at, 128).to_pylist(), encoder.encode(some), strict=True):
                    docs.append(key)
                    ids.append(np.concatenate([got, end]))
                    held += len(got) + 1
                    if held >= BLOCK_IDS:
                        yield block()
                        seq, held = seq + 1, 0
                        docs, ids = [], []
        if docs:
            yield block()

    return run


def write_tokens(
    docs: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text", *, end_id: int = 0
) -> None:
    """Encodes every whole text and writes blocks to ``folder`` in ascending id order.

    Texts are dealt out by ranges of ids, so file after file the ids ascend; NULL ids
    come first. Equal ids are parted by a hash of the text, so no id is tied to one task.
    NULL texts are empty and hold the end id alone. An empty table writes no block.
    """
    ordered = (
        docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("doc", "tie")
        .sortWithinPartitions("doc", "tie")
        .select("doc", "text")
    )
    blocks = ordered.mapInArrow(_encoder(tokenizer, end_id), BLOCK_SCHEMA)
    blocks.write.option("compression", "zstd").mode("overwrite").parquet(folder)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i] for name in batch.schema.names}
            ids = unpack(row["words"].as_py(), row["n_ids"].as_py()).astype("<u4")
            lengths = np.array(row["lengths"].as_py(), dtype=np.int64)
            ends = np.cumsum(lengths)
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array(np.full(len(ends), row["part"].as_py()), pa.int32()),
                    "seq": pa.array(np.full(len(ends), row["seq"].as_py()), pa.int64()),
                    "doc_id": pa.array(row["doc_ids"].as_py(), pa.int64()),
                    "inside": pa.array(ends - lengths, pa.int64()),
                    "n_tokens": pa.array(lengths, pa.int64()),
                    "ids_crc32": pa.array(
                        [zlib.crc32(ids[b - k : b].tobytes()) for b, k in zip(ends, lengths, strict=True)], pa.int64()
                    ),
                }
            )


def token_digests(blocks: DataFrame) -> DataFrame:
    """Per document of written blocks: ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` counts the ids of all documents before it: the ids of earlier files, of
    earlier blocks in its file and of earlier documents in its block. Blocks are summed
    within their file, and only one total per file is summed over all files.
    """
    sizes = blocks.select("part", "seq", "n_ids")
    within = sizes.select(
        "part", "seq", (F.sum("n_ids").over(W.partitionBy("part").orderBy("seq")) - F.col("n_ids")).alias("in_part")
    )
    totals = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    places = within.join(before, "part").select("part", "seq", (F.col("in_part") + F.col("before")).alias("base"))
    found = blocks.mapInArrow(
        _digests, "part int, seq long, doc_id long, inside long, n_tokens long, ids_crc32 long"
    )
    return found.join(places, ["part", "seq"]).select(
        "doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )


def read_documents(blocks: DataFrame) -> DataFrame:
    """``doc_id, ids`` of written blocks, the ids as an array of long without the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = unpack(batch.column("words")[i].as_py(), batch.column("n_ids")[i].as_py()).astype(np.int64)
                ends = np.cumsum(np.array(batch.column("lengths")[i].as_py(), dtype=np.int64))
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(batch.column("doc_ids")[i].as_py(), pa.int64()),
                        "ids": pa.array([x[:-1] for x in np.split(ids, ends[:-1])], pa.list_(pa.int64())),
                    }
                )

    return blocks.mapInArrow(run, "doc_id long, ids array<long>")


def tokenize(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes all documents as blocks under the shared folder and digests them from there."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    spark = docs.sparkSession
    folder = scratch_path(spark, "tokens")
    write_tokens(docs, tokenizer, folder, id_col, text_col)
    return token_digests(spark.read.schema(BLOCK_SCHEMA).parquet(folder))
