"""Token ids in files that are read document by document.

A file is a row of independent Zstandard frames in the public seekable layout: each data frame holds the ids of some
whole documents (little-endian unsigned 32-bit integers, with the content size and Zstandard's own checksum), then a
skippable frame lists the documents (id, first id in the file, number of ids, frame), and a last skippable frame is the
seek table: compressed size, size and checksum (the low 32 bits of XXH64 of the content) of each frame, and the footer.
A reader takes the table from the end of the file, decompresses only the frames it needs and checks each of them.

Files are written by tasks to temporary names and renamed when whole; a task begins another file when one holds
FILE_BYTES of ids, so files don't grow with the table. Only files that a finished task reports are in the manifest, so a
lost executor or a second attempt leaves no wrong file behind. The manifest has each file's first and last document, by
which wanted documents are looked up: only files that may hold one are opened, and only frames that do are decompressed.

Null text: as an empty one (the end id alone). Empty table: no files and no rows. Null ids: stored first. Repeated ids:
each row is stored, by id and then text. Long texts: whole, in a frame of their own (of 4 GB of ids at most, as frame
headers count in 32 bits; longer ones raise). Further columns of the input are ignored.
"""

from __future__ import annotations

import struct
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gravelsift.llm.common import BATCH_BYTES, bounded_batches, materialize, parallelism, shared_dir, whole_groups
from gravelsift.llm.tokens import word_tokenizer

#: Fixed values of the file format.
SKIPPABLE_INDEX, SKIPPABLE_SEEK_TABLE, SEEKABLE_FOOTER, CHECKSUM_FLAG = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
#: A frame is closed when it holds so many bytes of ids.
FRAME_BYTES = 1 << 18
#: A file is closed when it holds so many bytes of ids.
FILE_BYTES = 1 << 29
#: And when it holds so many documents: their index is 32 MB in memory, however short they are.
FILE_DOCS = 1_000_000
LEVEL = 3
#: What a null id is stored as.
NULL_ID = -(2**63)
INDEX = np.dtype([("doc_id", "<i8"), ("start", "<i8"), ("n", "<i8"), ("frame", "<i8")])
FIELDS = len(INDEX)


class FrameWriter:
    """Writes documents to an open binary stream; close() adds the index and the seek table."""

    def __init__(self, sink):
        self.sink, self.sizes = sink, []
        self.index = array("q")  # the numbers of INDEX, document after document
        self.held: list[bytes] = []
        self.held_bytes = self.ids = 0
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)

    def add(self, doc_id: int, data: bytes) -> None:
        if len(data) >= 1 << 32:
            raise ValueError(f"document {doc_id} has more ids than a frame can hold")
        if self.held and self.held_bytes + len(data) > FRAME_BYTES:
            self.flush()
        self.index.extend((doc_id, self.ids, len(data) // 4, len(self.sizes)))
        self.held.append(data)
        self.held_bytes += len(data)
        self.ids += len(data) // 4

    @property
    def documents(self) -> int:
        return len(self.index) // FIELDS

    def flush(self) -> None:
        if self.held:
            content = b"".join(self.held)
            frame = self.zstd.compress(content)
            self.sizes.append((len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
            self.sink.write(frame)
            self.held, self.held_bytes = [], 0

    def close(self) -> None:
        self.flush()
        listed = self.zstd.compress(np.array(self.index, dtype="<i8").tobytes())
        self.sink.write(struct.pack("<II", SKIPPABLE_INDEX, len(listed)) + listed)
        sizes = [*self.sizes, (len(listed) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)]
        body = b"".join(struct.pack("<III", *s) for s in sizes) + struct.pack("<IBI", len(sizes), CHECKSUM_FLAG, SEEKABLE_FOOTER)
        self.sink.write(struct.pack("<II", SKIPPABLE_SEEK_TABLE, len(body)) + body)


class FrameReader:
    """Reads an open, seekable binary stream."""

    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        end = source.tell()
        n, flags, magic = struct.unpack("<IBI", self._read(end - 9, 9))
        if magic != SEEKABLE_FOOTER or not flags & CHECKSUM_FLAG:
            raise ValueError("no seek table with checksums")
        self.sizes = list(struct.iter_unpack("<III", self._read(end - 9 - 12 * n, 12 * n)))
        self.places = np.concatenate([[0], np.cumsum([s[0] for s in self.sizes])]).tolist()
        packed = self._read(self.places[n - 1] + 8, self.sizes[-1][0] - 8)
        self.zstd = zstandard.ZstdDecompressor()
        self.index = np.frombuffer(self.zstd.decompress(packed), dtype=INDEX)

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def frame(self, k: int) -> bytes:
        """The content of frame k, checked."""
        packed, size, checksum = self.sizes[k]
        content = self.zstd.decompress(self._read(self.places[k], packed), max_output_size=size)
        if len(content) != size or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {k} is damaged")
        return content

    def documents(self, wanted: set[int] | None = None) -> Iterator[tuple[int, int, bytes]]:
        """(doc_id, first id in the file, ids) of the wanted documents, or of all; each frame is read once."""
        index = self.index if wanted is None else self.index[np.isin(self.index["doc_id"], list(wanted))]
        k, content, base = -1, b"", 0
        for doc_id, start, n, frame in index.tolist():
            if frame != k:
                k, content = frame, self.frame(frame)
                base = int(self.index["start"][np.searchsorted(self.index["frame"], frame)])
            yield doc_id, start, content[4 * (start - base) : 4 * (start - base + n)]


MANIFEST = "file string, part long, n_docs long, n_ids long, first_doc long, last_doc long, first_id long"


def write_token_files(
    docs: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
    files: int | None = None, file_bytes: int = FILE_BYTES, file_docs: int = FILE_DOCS,
) -> DataFrame:
    """Write the ids of all documents, in ascending order of ids, and return the manifest.

    Manifest: file, part (the files' order), n_docs, n_ids, first_doc, last_doc, first_id (ids in all files before it).
    path: a folder that the whole cluster reaches; by default one in the shared folder. files: how many tasks write.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    path = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = texts.repartitionByRange(files or parallelism(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered = ordered.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), "text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part, count = context.partitionId(), 0
        tokenizer, end = word_tokenizer(tokenizer_path), int(end_id).to_bytes(4, "little")
        store, folder = pafs.FileSystem.from_uri(path)
        name, writer, sink = "", None, None

        def finish() -> pd.DataFrame:
            writer.close()
            sink.close()
            store.move(f"{name}.tmp", name)
            return pd.DataFrame({
                "file": [name.rpartition("/")[2]], "part": [(part << 32) + count], "n_docs": [writer.documents], "n_ids": [writer.ids],
                "first_doc": [writer.index[0]], "last_doc": [writer.index[-FIELDS]],
            })

        for frame in frames:
            for k in range(0, len(frame), 1000):
                some = frame.iloc[k : k + 1000]
                for doc_id, data in zip(some.doc_id.tolist(), tokenizer.encode(some.text.tolist()), strict=True):
                    if writer is None:
                        store.create_dir(folder, recursive=True)
                        name = f"{folder}/part-{part:06d}-{count:05d}-{context.taskAttemptId()}.zst"
                        sink = store.open_output_stream(f"{name}.tmp", compression=None)
                        writer = FrameWriter(sink)
                    writer.add(doc_id, data + end)
                    if 4 * writer.ids >= file_bytes or writer.documents >= file_docs:
                        yield finish()
                        writer, count = None, count + 1
        if writer:
            yield finish()

    manifest, _ = materialize(ordered.mapInPandas(run, MANIFEST.rpartition(",")[0]), "manifest")
    rows, total = [], 0
    for r in manifest.orderBy("part").collect():  # a row for each file
        rows.append((f"{path}/{r.file}", r.part, r.n_docs, r.n_ids, r.first_doc, r.last_doc, total))
        total += r.n_ids
    return spark.createDataFrame(rows, MANIFEST)


def read_token_files(spark: SparkSession, manifest: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Per document of the manifest's files: doc_id, start (ids of all documents before it), ids (binary).

    wanted: a table of doc_id; only those documents are read, each row that is stored of them once. Ids that no file
    holds give no row.
    """
    ids = "doc_id long, start long, ids binary"

    def rows_of(file: str, first: int, some: set[int] | None) -> Iterator[pd.DataFrame]:
        store, name = pafs.FileSystem.from_uri(file)
        with store.open_input_file(name) as source:
            rows, held = [], 0
            for doc_id, start, data in FrameReader(source).documents(some):
                rows.append((None if doc_id == NULL_ID else doc_id, first + start, data))
                held += len(data)
                if held >= BATCH_BYTES:
                    yield _frame(rows)
                    rows, held = [], 0
            if rows:
                yield _frame(rows)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, first in zip(frame.file, frame.first_id.tolist(), strict=True):
                yield from rows_of(file, first, None)

    if wanted is None:
        return manifest.select("file", "first_id").repartition(parallelism(spark), "file").mapInPandas(run, ids)

    listed = manifest.select("file", "first_id", "first_doc", "last_doc").orderBy("part").toPandas()  # a row for each file
    shared = spark.sparkContext.broadcast(listed)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, last = shared.value.first_doc.to_numpy(), shared.value.last_doc.to_numpy()
        for frame in frames:
            doc_id = frame.doc_id.to_numpy()
            low, high = np.searchsorted(last, doc_id, side="left"), np.searchsorted(first, doc_id, side="right")
            n = np.maximum(high - low, 0)  # several files only for an id that reaches over their borders
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield pd.DataFrame({"file": np.repeat(low, n) + within, "doc_id": np.repeat(doc_id, n)})

    def look_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, ["file"]):
            for file, own in frame.groupby("file"):
                at = shared.value.iloc[int(file)]
                yield from rows_of(at.file, int(at.first_id), set(own.doc_id.tolist()))

    asked = wanted.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id")).distinct()
    placed = asked.mapInPandas(place, "file long, doc_id long").repartition(parallelism(spark), "file").sortWithinPartitions("file")
    return placed.mapInPandas(look_up, ids)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    doc_id, start, data = zip(*rows, strict=True)
    return pd.DataFrame({"doc_id": pd.array(doc_id, dtype="Int64"), "start": start, "ids": data})
