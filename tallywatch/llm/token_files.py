"""Token ids as Arrow files of equal-length sequences, with random access and no copy.

All documents in ascending order of ``doc_id`` make one stream of ids, each document closed by an
end id. Spark range-partitions the texts by that order; a partition is a part of the stream,
and its task encodes it and writes it as it goes. Within a part the stream is cut into sequences
of ``length`` ids, and ``sequences`` of them make a file. Only the last sequence of a part is
padded. A file is in Arrow's IPC file format, in record batches of ``batch`` sequences:

* ``ids``: fixed-size list of unsigned integers, two bytes if the vocabulary allows, else four;
* ``mask``: fixed-size list of booleans, true for an id, false for padding;
* ``begins``, ``docs``: where in the sequence documents begin, and their ``doc_id``.

The table ``files`` beside them has one row per file: its part and number in it, how many ids
it holds, and the ids and sequences before it. So a sequence's file, batch and row follow from its
number, and a reader that maps the file into memory sees ids and mask as views of it.

A task holds one record batch of a file and one batch of texts. A file is written under another
name and renamed when it is whole; a repeated task writes the same bytes, so lost executors and
second attempts do no harm. Files lie below the shared folder, which must be one that pyarrow
can open. The texts should come from a scan or a staged table, whose rows keep their places.

Defined results: a null text is empty and is only the end id; equal ``doc_id`` are ordered by a
hash of their text, null ones come first; further columns, also of clashing names, are ignored;
an empty table gives no file and no row; a document may be longer than a file.
"""

from __future__ import annotations

import json
import math
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as filesystems
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallywatch.llm.common import pick, ship_code
from tallywatch.llm.tokens import library_encoder, vocabulary_size
from tallywatch.session import stage


@dataclass(frozen=True)
class Layout:
    """``length`` ids a sequence, ``sequences`` a file, ``batch`` sequences a record batch.

    A part has about ``part_bytes`` of text, or less if a shuffle has more partitions.
    """

    length: int = 2048
    sequences: int = 4096
    batch: int = 64
    part_bytes: int = 32 << 20


def _folder(uri: str) -> tuple[filesystems.FileSystem, str]:
    """The file system of a folder, and the folder's path in it."""
    local = re.sub(r"^file:/+", "/", uri)
    if "://" in local:
        return filesystems.FileSystem.from_uri(local)
    return filesystems.LocalFileSystem(), local


def _file_name(part: int, number: int) -> str:
    return f"tokens-{part:06d}-{number:06d}.arrow"


def file_schema(layout: Layout, kind: str, doc_kind: pa.DataType) -> pa.Schema:
    ids = pa.from_numpy_dtype(np.dtype(kind))
    return pa.schema(
        [
            ("ids", pa.list_(ids, layout.length)),
            ("mask", pa.list_(pa.bool_(), layout.length)),
            ("begins", pa.list_(pa.int32())),
            ("docs", pa.list_(doc_kind)),
        ]
    )


# ---------------------------------------------------------------- writing


class _Part:
    """The files of one part: documents arrive in order and leave in record batches."""

    def __init__(self, folder: str, part: int, layout: Layout, kind: str, doc_kind: pa.DataType) -> None:
        self.system, self.path = _folder(folder)
        self.part, self.layout = part, layout
        self.schema = file_schema(layout, kind, doc_kind)
        self.ids = np.zeros(layout.batch * layout.length, kind)
        self.begins: list[list[int]] = [[] for _ in range(layout.batch)]
        self.docs: list[list] = [[] for _ in range(layout.batch)]
        self.at = 0
        self.sequences = 0  # in the open file
        self.writer = None
        #: Ids of each finished file.
        self.files: list[int] = []
        self.held = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        sequence, place = divmod(self.at, self.layout.length)
        self.begins[sequence].append(place)
        self.docs[sequence].append(doc_id)
        room = self.room()
        while len(ids):
            some = ids[: room - self.at]
            self.ids[self.at : self.at + len(some)] = some
            self.at += len(some)
            ids = ids[len(some) :]
            if self.at == room:
                self.flush()
                room = self.room()

    def room(self) -> int:
        """The ids of a full batch, which the end of the file may cut short."""
        return min(self.layout.batch, self.layout.sequences - self.sequences) * self.layout.length

    def flush(self) -> None:
        """Write the batch, and close the file if that makes it full."""
        length = self.layout.length
        rows = math.ceil(self.at / length)
        if self.writer is None:
            self.partial = f"{self.path}/.{uuid.uuid4().hex}"
            self.target = self.system.open_output_stream(self.partial)
            self.writer = pa.ipc.new_file(self.target, self.schema)
        columns = [
            pa.FixedSizeListArray.from_arrays(pa.array(self.ids[: rows * length]), type=self.schema.field(0).type),
            pa.FixedSizeListArray.from_arrays(pa.array(np.arange(rows * length) < self.at), type=self.schema.field(1).type),
            pa.array(self.begins[:rows], self.schema.field(2).type),
            pa.array(self.docs[:rows], self.schema.field(3).type),
        ]
        self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        self.ids[:] = 0
        self.begins = [[] for _ in range(self.layout.batch)]
        self.docs = [[] for _ in range(self.layout.batch)]
        self.held += self.at
        self.at = 0
        self.sequences += rows
        if self.sequences == self.layout.sequences:
            self.end_file()

    def end_file(self) -> None:
        self.writer.close()
        self.target.close()
        self.system.move(self.partial, f"{self.path}/{_file_name(self.part, len(self.files))}")
        self.files.append(self.held)
        self.writer, self.held, self.sequences = None, 0, 0

    def close(self) -> None:
        if self.at:
            self.flush()
        if self.writer is not None:
            self.end_file()


def _written(folder: str, layout: Layout, tokenizer, end_id: int, kind: str):
    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Encode the texts of a part in order and write them; a row per file."""
        encoder = library_encoder(tokenizer.value)
        end = np.array([end_id], "<u4")
        part = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if part is None:
                number = batch.column(2)[0].as_py()
                part = _Part(folder, number, layout, kind, batch.schema.field(0).type)
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.arrays(batch.column(1))):
                part.add(doc_id, np.concatenate([ids, end]).astype(kind))
        files = []
        if part is not None:
            part.close()
            files = part.files
        columns = [
            pa.array([part.part if part else 0] * len(files), pa.int32()),
            pa.array(range(len(files)), pa.int32()),
            pa.array(files, pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "number", "ids"])

    return written


def write_token_files(
    documents: DataFrame, tokenizer: str, folder: str, end_id: int, layout: Layout = Layout()
) -> None:
    """Write the ids of ``doc_id, text`` rows to ``folder``, which must be new.

    ``tokenizer`` is the path of a file of the tokenizers library; special strings in a text
    are the special tokens they name. ``layout.json`` says how the files are cut.
    """
    spark = documents.sparkSession
    ship_code(spark)
    with open(tokenizer, "rb") as file:
        blob = file.read()
    kind = "<u2" if max(vocabulary_size(blob), end_id + 1) <= 1 << 16 else "<u4"
    docs = pick(documents, "doc_id", "text")
    doc_kind = dict(docs.dtypes)["doc_id"]
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / layout.part_bytes))
    system, path = _folder(folder)
    system.create_dir(path, recursive=True)
    # The row's place lets copies of one document go to different parts.
    order = [F.col("doc_id").asc_nulls_first(), F.col("_hash").asc(), F.col("_row").asc()]
    ordered = (
        docs.select("doc_id", "text", F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_row"))
        .repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text", F.spark_partition_id().alias("part"))
    )
    shared = spark.sparkContext.broadcast(blob)
    write = _written(folder, layout, shared, end_id, kind)
    files = stage(ordered.mapInArrow(write, "part int, number int, ids bigint"), "token-files")
    earlier = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    held = F.ceil(F.col("ids") / layout.length)
    # One row per file.
    files.select(
        "part",
        "number",
        "ids",
        F.coalesce(F.sum("ids").over(earlier), F.lit(0)).cast("bigint").alias("start"),
        F.coalesce(F.sum(held).over(earlier), F.lit(0)).cast("bigint").alias("sequence"),
    ).coalesce(1).write.parquet(f"{folder}/files")
    shape = {"length": layout.length, "sequences": layout.sequences, "batch": layout.batch}
    with system.open_output_stream(f"{path}/layout.json") as out:
        out.write(json.dumps({**shape, "doc_id": doc_kind}).encode())


# ---------------------------------------------------------------- reading


class TokenFiles:
    """Random access to the sequences of a folder."""

    def __init__(self, folder: str) -> None:
        self.system, self.path = _folder(folder)
        with self.system.open_input_file(f"{self.path}/layout.json") as file:
            said = json.loads(file.read())
        self.layout = Layout(said["length"], said["sequences"], said["batch"])
        self.doc_kind = said["doc_id"]
        self._files: dict[str, np.ndarray] | None = None
        self.opened: tuple[tuple[int, int], pa.ipc.RecordBatchFileReader] | None = None

    @property
    def files(self) -> dict[str, np.ndarray]:
        """The table of files, in order."""
        if self._files is None:
            table = pq.read_table(f"{self.path}/files", filesystem=self.system)
            table = table.sort_by([("part", "ascending"), ("number", "ascending")])
            self._files = {n: table.column(n).to_numpy() for n in table.column_names}
        return self._files

    def __len__(self) -> int:
        files = self.files
        if not len(files["ids"]):
            return 0
        return int(files["sequence"][-1] + -(-files["ids"][-1] // self.layout.length))

    def reader(self, part: int, number: int) -> pa.ipc.RecordBatchFileReader:
        if self.opened is None or self.opened[0] != (part, number):
            path = f"{self.path}/{_file_name(part, number)}"
            local = isinstance(self.system, filesystems.LocalFileSystem)
            source = pa.memory_map(path) if local else self.system.open_input_file(path)
            self.opened = (part, number), pa.ipc.open_file(source)
        return self.opened[1]

    def sequence(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of sequence ``k``: views of the mapped file."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        files = self.files
        file = int(np.searchsorted(files["sequence"], k, "right")) - 1
        batch, row = divmod(k - int(files["sequence"][file]), self.layout.batch)
        batch = self.reader(int(files["part"][file]), int(files["number"][file])).get_batch(batch)
        cut = slice(row * self.layout.length, (row + 1) * self.layout.length)
        ids = batch.column(0).flatten().to_numpy(zero_copy_only=True)[cut]
        return ids, batch.column(1).flatten()[cut]

    def runs(self, part: int, number: int) -> Iterator[tuple[np.ndarray, list[int], list]]:
        """Of each record batch: its ids, where documents begin, and which."""
        reader = self.reader(part, number)
        length = self.layout.length
        for k in range(reader.num_record_batches):
            batch = reader.get_batch(k)
            ids = batch.column(0).flatten().to_numpy(zero_copy_only=True)[: batch.column(1).flatten().true_count]
            begins = [row * length + at for row, places in enumerate(batch.column(2).to_pylist()) for at in places]
            yield ids, begins, batch.column(3).flatten().to_pylist()

    def documents(self, part: int, number: int, start: int, more: int) -> Iterator[tuple]:
        """(doc_id, start, n, crc32) of the documents that begin in a file, read to their ends.

        ``start`` ids come before the file, and ``more`` files of its part after it.
        """
        last: list | None = None  # the document that is still open
        at = start
        for file in range(number, number + more + 1):
            for ids, begins, docs in self.runs(part, file):
                if last is not None:
                    end = begins[0] if begins else len(ids)
                    last[2] += end
                    last[3] = _checksum(ids[:end], last[3])
                if file != number:
                    if begins:
                        yield tuple(last)
                        return
                    continue
                bounds = [*begins, len(ids)]
                for doc_id, a, b in zip(docs, bounds, bounds[1:]):
                    if last is not None:
                        yield tuple(last)
                    last = [doc_id, at + a, b - a, _checksum(ids[a:b], 0)]
                at += len(ids)
            if last is None:
                return
        yield tuple(last)


def _checksum(ids: np.ndarray, so_far: int) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes(), so_far)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, read from the files.

    A task reads some files, and goes on into later ones for the document that a file ends with.
    """
    ship_code(spark)
    doc_kind = TokenFiles(folder).doc_kind
    files = spark.read.schema("part int, number int, ids bigint, start bigint, sequence bigint").parquet(f"{folder}/files")
    last = files.groupBy(F.col("part").alias("_part")).agg(F.max("number").alias("_last"))
    rows = files.join(last.hint("merge"), F.col("part") == F.col("_part"))
    schema = f"doc_id {doc_kind}, start bigint, n_tokens bigint, ids_crc32 bigint"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = TokenFiles(folder)
        for batch in batches:
            for part, number, start, more in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                kind = tokens.reader(part, number).schema.field("docs").type.value_type
                found: list[tuple] = []
                for row in tokens.documents(part, number, start, more):
                    found.append(row)
                    if len(found) == 10_000:
                        yield _record(found, kind)
                        found = []
                yield _record(found, kind)

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = rows.select("part", "number", "start", (F.col("_last") - F.col("number")).alias("more"))
    return wanted.repartition(tasks, "part", "number").mapInArrow(read, schema)


def _record(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    kinds = [kind, pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds)],
        names=["doc_id", "start", "n_tokens", "ids_crc32"],
    )


def default_tokenizer(name: str) -> str:
    """The place of a public tokenizer file that is installed beside Python."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
