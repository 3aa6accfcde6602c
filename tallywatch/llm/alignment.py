"""Two tokenizers over the same bytes: which tokens end together, and how often.

Byte offsets where tokens of both end cut a text into groups; the last tokens of a group are
linked. A pair of ids is weighed by the number of its links in the whole corpus, which is
counted outside memory:

1. A task encodes texts and turns a document's links into (B id, A id, document, times) records,
   radix-partitioned by the B id. A full buffer becomes a sorted run per radix, cut into blocks
   of delta-coded, zstd-compressed columns. Each run also has blocks of its pair totals. All go
   into one staged table, so a lost executor costs its running tasks and no run.
2. Blocks of totals, one radix to a task and in order of their first pair, meet in a k-way heap
   merge. Pairs leave it in B-major order with their corpus-wide counts, so the highest count of
   a B id is known when its last pair has passed.
3. Blocks of records meet the blocks of counts in the same order. Each record yields its
   share of its document, summed in the task, and Spark sums per document.

A run has each pair once among its totals, so no pair is hot in step 2. In step 3 counts are
known already: the records of a radix, however many, are dealt to as many tasks as their number
asks for, each with the counts of that radix. Tasks hold blocks that overlap, not partitions.

Defined results: a text that is null or empty, or whose tokens of either side do not spell it,
has no tokens: zeros and an empty digest. Special strings are ordinary text. Repeated rows are
documents of their own. Further columns, also of clashing names, are ignored; an empty table
gives an empty result. The tokenizers' files are parameters, read on the driver and broadcast.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import math
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from tallywatch.llm import tokens
from tallywatch.llm.common import pick, ship_code
from tallywatch.session import stage

#: How a sentencepiece file writes a space.
SPACE_MARK = "▁"


@dataclass(frozen=True)
class Spill:
    """Sizes, in records, of a task's buffer, of a block, of one merge step and of a task."""

    radices: int = 64
    buffer: int = 1_000_000
    block: int = 32_768
    step: int = 1_000_000
    task: int = 8_000_000


# ---------------------------------------------------------------- the two tokenizers


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class Side:
    """One tokenizer: ids of parts that begin with a space, and bytes of ids.

    ``cuts`` says that a text may be cut before spaces (see ``tokens``).
    """

    def __init__(self, encode, cuts: bool, table: list[bytes], after: tuple[str, str]) -> None:
        self.encode, self.cuts, self.table = encode, cuts, table
        self.length = np.array([len(b) for b in table], np.int64)
        #: What an id is written as, within a group and as the last of its side.
        self.said = [f"{i}{mark}" for mark in after for i in range(len(table))]

    def ids(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all parts in a row, and how many each part has."""
        found = [array("i", ids) for ids in self.encode(parts)]
        flat = np.frombuffer(b"".join([f.tobytes() for f in found]), np.int32)
        return flat.astype(np.int64), np.array([len(f) for f in found], np.int64)

    def spelled(self, ids: np.ndarray, counts: np.ndarray, parts: list[bytes]) -> np.ndarray:
        """Do the ids of each part spell it?"""
        size = np.array([len(p) for p in parts], np.int64)
        total = np.concatenate([[0], np.cumsum(self.length[ids])])
        ends = np.cumsum(counts)
        held = total[ends] - total[ends - counts] == size
        pieces = list(map(self.table.__getitem__, ids.tolist()))
        if held.all() and b"".join(pieces) == b"".join(parts):
            return held
        begins = (ends - counts).tolist()
        return np.array([b"".join(pieces[i:j]) == p for i, j, p in zip(begins, ends.tolist(), parts)], bool)


def _byte_level(blob: bytes) -> Side:
    def make() -> Side:
        specification = json.loads(blob)
        letters = byte_letters()
        found = {i: bytes(letters[x] for x in t) for t, i in specification["model"]["vocab"].items()}
        for t in specification.get("added_tokens") or []:
            found[t["id"]] = t["content"].encode()
        table = [found.get(i, b"") for i in range(max(found) + 1)]
        encoder = tokens.library_encoder(blob, plain_specials=True)
        cuts = getattr(encoder, "cut", None) is tokens.pieces_with_spaces
        return Side(encoder.encode, cuts, table, (",", "|"))

    return tokens._once("byte level", blob, make)


def _piece_bytes(piece: str) -> bytes:
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace(SPACE_MARK, " ").encode()


def _piece_model(blob: bytes) -> Side:
    def make() -> Side:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=blob)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        lone = model.piece_to_id(SPACE_MARK)

        def encode(parts: list[str]) -> list[list[int]]:
            # The model adds the space that each part begins with.
            found = model.encode([p[1:] for p in parts], num_threads=1)
            return [[lone] if p == " " else ids for p, ids in zip(parts, found)]

        def joins() -> bool:
            """Does a piece go on after white space, or is white space lost?"""
            if any(SPACE_MARK in p.lstrip(SPACE_MARK) or " " in p for p in pieces):
                return True
            probe = "a  b, c é "
            parts = [" " + p for p in tokens.led_pieces(probe)]
            return [i for ids in encode(parts) for i in ids] != model.encode(probe)

        return Side(encode, not joins(), [_piece_bytes(p) for p in pieces], (",", ";"))

    return tokens._once("pieces", blob, make)


#: Of a part: its tokens on both sides, its groups, its links, its groups as text.
Part = tuple[int, int, int, bytes, str]


def _aligned(left: Side, right: Side, parts: list[str]) -> list[Part | bool]:
    """What the tokens of each part make; False if they do not spell it.

    All parts are laid end to end, and both sides' tokens end where a part does. So the
    common ends are found at once for all of them.
    """
    data = [p.encode() for p in parts]
    (a, a_counts), (b, b_counts) = left.ids(parts), right.ids(parts)
    good = left.spelled(a, a_counts, data) & right.spelled(b, b_counts, data)
    if not good.all():
        a, a_counts = a[np.repeat(good, a_counts)], a_counts[good]
        b, b_counts = b[np.repeat(good, b_counts)], b_counts[good]
    a_ends, b_ends = np.cumsum(left.length[a]), np.cumsum(right.length[b])
    both = np.intersect1d(a_ends, b_ends, assume_unique=True)
    a_last, b_last = np.searchsorted(a_ends, both), np.searchsorted(b_ends, both)
    links = ((b[b_last] << 32) | a[a_last]).tobytes()
    # All tokens in order of group and side, each written with what follows it.
    a_at, b_at = a.copy(), b.copy()
    a_at[a_last] += len(left.table)
    b_at[b_last] += len(right.table)
    said = [*map(left.said.__getitem__, a_at.tolist()), *map(right.said.__getitem__, b_at.tolist())]
    group = np.concatenate([2 * np.searchsorted(both, a_ends), 2 * np.searchsorted(both, b_ends) + 1])
    said = [said[i] for i in np.argsort(group, kind="stable").tolist()]
    part_ends = np.cumsum(a_counts) - 1
    group_ends = np.searchsorted(both, a_ends[part_ends] if len(a) else part_ends, "right")
    token_ends = np.cumsum(a_counts + b_counts)
    rows = zip(
        a_counts.tolist(), b_counts.tolist(),
        [0, *group_ends.tolist()], group_ends.tolist(),
        [0, *token_ends.tolist()], token_ends.tolist(),
    )
    made = [(m, n, h - g, links[8 * g : 8 * h], "".join(said[i:j])) for m, n, g, h, i, j in rows]
    if good.all():
        return made
    rest = iter(made)
    return [next(rest) if ok else False for ok in good.tolist()]


# ---------------------------------------------------------------- blocks


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of equal length, sorted by the first: differences, compressed."""
    parts = [np.diff(c.astype(np.int64), prepend=np.int64(0)).tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def _unpacked(blob: bytes, columns: int) -> list[np.ndarray]:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.int64)
    return [np.cumsum(c) for c in data.reshape(columns, -1)]


def _summed(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct keys in order, and sums of the values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return [keys[starts], *[np.add.reduceat(v[order], starts) if len(starts) else v[:0] for v in values]]


class Merge:
    """A k-way merge: blocks arrive in order of their first key and leave as sorted slices.

    The heap holds the next key of each block that is not used up, so a step touches only
    blocks that have something below its bound.
    """

    def __init__(self) -> None:
        self.heap: list[tuple[int, int, int, list[np.ndarray]]] = []
        self.held = 0
        self.arrived = 0

    def add(self, columns: list[np.ndarray]) -> None:
        self.arrived += 1
        heapq.heappush(self.heap, (int(columns[0][0]), self.arrived, 0, columns))
        self.held += len(columns[0])

    def below(self, bound: int | None) -> list[np.ndarray] | None:
        """Everything with a key below ``bound``, by column; None if there is nothing."""
        taken: list[list[np.ndarray]] = []
        while self.heap and (bound is None or self.heap[0][0] < bound):
            _, number, at, columns = heapq.heappop(self.heap)
            end = len(columns[0]) if bound is None else int(np.searchsorted(columns[0], bound))
            taken.append([c[at:end] for c in columns])
            self.held -= end - at
            if end < len(columns[0]):
                heapq.heappush(self.heap, (int(columns[0][end]), number, end, columns))
        return [np.concatenate(c) for c in zip(*taken)] if taken else None


# ---------------------------------------------------------------- step 1


_RUN_FIELDS = "radix int, run bigint, low bigint, records bigint, blob binary"


def _encoded(a_file, b_file, spill: Spill):
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Document rows (kind 0), blocks of records (1) and of totals (2)."""
        left, right = _byte_level(a_file.value), _piece_model(b_file.value)
        cut = tokens.led_pieces if left.cuts and right.cuts else lambda text: [text]
        # Kept by the Python worker from task to task.
        recent = tokens._once("parts", a_file.value + b_file.value, tokens.Recent)
        keys, rows, times = [], [], []
        held = 0
        kind = pa.int64()

        def make(parts: list[str]) -> list[Part | bool]:
            return _aligned(left, right, [" " + p for p in parts])

        def runs() -> pa.RecordBatch:
            found = []
            key, row, n = np.concatenate(keys), np.concatenate(rows), np.concatenate(times)
            radix = (key >> 32) % spill.radices
            order = np.lexsort((row, key, radix))
            key, row, n, radix = key[order], row[order], n[order], radix[order]
            run = int(row.min())
            bounds = np.searchsorted(radix, np.arange(spill.radices + 1))
            for r, (i, j) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                for x in range(i, j, spill.block):
                    cut = slice(x, min(x + spill.block, j))
                    found.append((1, r, run, int(key[x]), cut.stop - x, _packed(key[cut], row[cut], n[cut])))
                if i < j:
                    pair, total = _summed(key[i:j], n[i:j])
                    for x in range(0, len(pair), spill.block):
                        cut = slice(x, x + spill.block)
                        part = pair[cut]
                        found.append((2, r, run, int(part[0]), len(part), _packed(part, total[cut])))
            return _rows(kind, blocks=found)

        for batch in batches:
            kind = batch.schema.field(0).type
            texts = [t or "" for t in batch.column(2).to_pylist()]
            rest = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            done = []
            for group in tokens.groups(texts):
                parts_of = [cut(t) if t else [] for t in group]
                known = recent.of(set().union(*parts_of), make)
                for text, parts, (doc, row) in zip(group, parts_of, rest):
                    met = [known[p] for p in parts]
                    if False in met:
                        # Some part is not spelled: the text as a whole decides.
                        met = make([text])
                    if not met or False in met:
                        done.append((doc, row, 0, 0, 0, 0, ""))
                        continue
                    n_a, n_b, n_groups, links, said = zip(*met)
                    digest = hashlib.sha256("".join(said)[:-1].encode()).hexdigest()
                    number = sum(n_groups)
                    done.append((doc, row, sum(n_a), sum(n_b), number, number, digest))
                    pair, n = np.unique(np.frombuffer(b"".join(links), np.int64), return_counts=True)
                    keys.append(pair)
                    rows.append(np.full(len(pair), row, np.int64))
                    times.append(n.astype(np.int64))
                    held += len(pair)
                    if held >= spill.buffer:
                        yield runs()
                        keys, rows, times, held = [], [], [], 0
            yield _rows(kind, documents=done)
        if held:
            yield runs()

    return encoded


def _rows(kind: pa.DataType, documents: list[tuple] = (), blocks: list[tuple] = ()) -> pa.RecordBatch:
    """Document rows and blocks as one batch of the staged table."""
    d, b = len(documents), len(blocks)
    doc = list(zip(*documents)) or [()] * 7
    block = list(zip(*blocks)) or [()] * 6
    kinds = [kind, *[pa.int64()] * 5, pa.string()]
    columns = [pa.array([0] * d + list(block[0]), pa.int32())]
    columns += [pa.array([*values, *[None] * b], k) for values, k in zip(doc, kinds)]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    columns += [pa.array([*[None] * d, *values], k) for values, k in zip(block[1:], kinds)]
    names = ["kind", "doc_id", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    names += ["radix", "run", "low", "records", "blob"]
    return pa.RecordBatch.from_arrays(columns, names=names)


# ---------------------------------------------------------------- step 2


def _counted(spill: Spill):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of (pair, corpus-wide count, is it the B id's highest), in B-major order."""
        merge = Merge()
        radix = None
        open_side: list[np.ndarray] = [np.zeros(0, np.int64)] * 2

        def blocks(part: list[np.ndarray] | None, final: bool) -> Iterator[tuple]:
            """Count what left the merge; the last B id waits until another one follows."""
            nonlocal open_side
            if part is not None:
                pair, n = _summed(*part)
                open_side = [np.concatenate([open_side[0], pair]), np.concatenate([open_side[1], n])]
            pair, n = open_side
            if not len(pair):
                return
            side = pair >> 32
            end = len(pair) if final else int(np.searchsorted(side, side[-1]))
            open_side = [pair[end:], n[end:]]
            pair, n, side = pair[:end], n[:end], side[:end]
            if not len(pair):
                return
            starts = np.flatnonzero(np.concatenate([[True], side[1:] != side[:-1]]))
            highest = np.repeat(np.maximum.reduceat(n, starts), np.diff([*starts, len(n)]))
            for x in range(0, len(pair), spill.block):
                cut = slice(x, x + spill.block)
                blob = _packed(pair[cut], n[cut], (n == highest)[cut])
                yield int(radix), int(pair[x]), len(pair[cut]), blob

        def record(rows: Iterator[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * 4
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            return pa.RecordBatch.from_arrays(arrays, names=["radix", "low", "records", "blob"])

        for batch in batches:
            for r, low, blob in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                if r != radix:
                    if radix is not None:
                        yield record(blocks(merge.below(None), True))
                    radix = r
                elif merge.held >= spill.step:
                    yield record(blocks(merge.below(low), False))
                merge.add(_unpacked(blob, 2))
        if radix is not None:
            yield record(blocks(merge.below(None), True))

    return counted


# ---------------------------------------------------------------- step 3


def _shares(spill: Spill):
    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per document the sums of its records of one radix, or of a part of it."""
        records = Merge()
        counts: list[list[np.ndarray]] = []
        known = 0
        group = None

        def give(bound: int | None) -> pa.RecordBatch:
            nonlocal counts, known
            part = records.below(bound)
            columns: list[np.ndarray] = [np.zeros(0, np.int64)] * 3
            if part is not None:
                pair, row, n = part
                table = [np.concatenate(c) for c in zip(*counts)]
                at = np.searchsorted(table[0], pair)
                columns = _summed(row, n * table[2][at], n * table[1][at])
            # What is left and what comes is not below the bound.
            counts = [c for c in counts if bound is not None and c[0][-1] >= bound]
            known = sum(len(c[0]) for c in counts)
            names = ["row", "n_best", "count_sum"]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        for batch in batches:
            for r, part, low, kind, blob in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                if (r, part) != group:
                    if group is not None:
                        yield give(None)
                    group = r, part
                elif records.held + known >= spill.step:
                    yield give(low)
                columns = _unpacked(blob, 3)
                if kind == 0:
                    counts.append(columns)
                    known += len(columns[0])
                else:
                    records.add(columns)
        if group is not None:
            yield give(None)

    return shares


def align_tokenizers(documents: DataFrame, a_path: str, b_path: str, spill: Spill = Spill()) -> DataFrame:
    """One row per document: how its tokens of ``a_path`` and ``b_path`` fall together.

    ``a_path`` is a byte-level file of the tokenizers library, ``b_path`` a sentencepiece model
    that adds a leading space. ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256``: tokens, groups, links, links whose pair is the most frequent of its B id,
    the sum of the pairs' counts over the links, and the digest of the groups as text.
    """
    spark = documents.sparkSession
    ship_code(spark)
    files = []
    for path in (a_path, b_path):
        with open(path, "rb") as file:
            files.append(spark.sparkContext.broadcast(file.read()))
    docs = pick(documents, "doc_id", "text")
    doc_kind = dict(docs.dtypes)["doc_id"]
    numbered = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    fields = (
        f"kind int, doc_id {doc_kind}, row bigint, n_a bigint, n_b bigint, n_groups bigint,"
        f" n_links bigint, groups_sha256 string, {_RUN_FIELDS}"
    )
    rows = stage(numbered.mapInArrow(_encoded(*files, spill), fields), "token-runs")
    runs = rows.filter("kind = 1").select("radix", "run", "low", "records", "blob")
    totals = rows.filter("kind = 2").select("radix", "low", "blob")
    counts = stage(
        totals.repartition(spill.radices, "radix")
        .sortWithinPartitions("radix", "low")
        .mapInArrow(_counted(spill), "radix int, low bigint, records bigint, blob binary"),
        "pair-counts",
    )
    # One row per radix: into how many parts its records are dealt.
    sizes = {r[0]: r[1] for r in runs.groupBy("radix").agg(F.sum("records")).collect()}
    parts = {r: math.ceil(n / spill.task) for r, n in sizes.items()}
    number = F.lit(1)
    for r, n in parts.items():
        if n > 1:
            number = F.when(F.col("radix") == r, n).otherwise(number)
    dealt = runs.select(
        "radix", F.pmod(F.xxhash64("run", "low"), number).cast("int").alias("part"), "low", F.lit(1).alias("kind"), "blob"
    )
    spread = counts.select(
        "radix", F.explode(F.sequence(F.lit(0), number - 1)).alias("part"), "low", F.lit(0).alias("kind"), "blob"
    )
    shared = (
        dealt.unionByName(spread)
        .repartition(max(spill.radices, sum(parts.values())), "radix", "part")
        .sortWithinPartitions("radix", "part", "low", "kind")
        .mapInArrow(_shares(spill), "row bigint, n_best bigint, count_sum bigint")
        .groupBy(F.col("row").alias("_row"))
        .agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    )
    none = F.lit(0).cast("bigint")
    of_document = ("doc_id", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return (
        rows.filter("kind = 0")
        .select(*of_document)
        .join(shared.hint("merge"), F.col("row") == F.col("_row"), "left")
        .select(
            "doc_id", "n_a", "n_b", "n_groups", "n_links",
            F.coalesce("n_best", none).alias("n_best"),
            F.coalesce("count_sum", none).alias("count_sum"),
            "groups_sha256",
        )
    )
