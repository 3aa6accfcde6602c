"""N-gram Jaccard join: MinHash bands find pairs, full n-gram sets verify them.

Texts of equal n-gram set form a copy class, which is joined once. Signatures of a class are
cut into bands; ``bands_for`` picks rows and bands so that a pair at the threshold shares a
band with at least the target probability. Classes meet by shuffles on the band hashes.

No pair is ever a row. A band with many classes is cut into blocks by a hash of the class,
and pairs of blocks are separate groups. A group compares its signatures and passes on
stars that tie together what agrees in enough places (``margin`` standard deviations below the
threshold; this costs one true pair in a billion). What is tied already is not compared again,
so a group of near copies costs one comparison a member; and two blocks that meet pass
on only what ties trees of one to trees of the other. Components of the stars then hold
every candidate pair, and hold few others.

Within a component each text is reduced to how it differs from one of them, R: the n-grams of R
that it lacks and those it adds, a few dozen hashes for a near copy. The n-grams that two texts
share follow exactly: ``|A and B| = |R| - |lackA| - |lackB| + |dA and dB|``, where d is all
that a text lacks or adds. Blocks of these differences meet, all pairs are compared as a matrix
product, and each text gets the number of its links plus a star of those it is tied to, from
which the classes follow. There the exact similarity alone decides; only a pair that no path of
candidate pairs ties together can be lost.

Work on a group of n different texts that all resemble each other grows with n squared,
as the number of its links does, spread over (n / block)^2 tasks; rows grow with n, as each
block's own are sent once to each other block.

Defined results: n-grams are runs of ``size`` words ``[^\\x20\\x09-\\x0D]+`` as they are
written, and all words of a shorter text are one n-gram; a null or wordless text has no
n-gram, no link and a class of its own (the class is its own ``doc_id``); repeated rows are
copies of each other; a null ``doc_id`` is the lowest; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallywatch.llm import textarrays as ta
from tallywatch.llm.common import bounded, pick, place, positional, ship_code
from tallywatch.llm.graph import connected_components
from tallywatch.session import stage


def bands_for(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """Bands and rows per band: the most rows whose bands, at most ``most`` hashes, reach ``recall``."""
    best = None
    for rows in range(1, most + 1):
        share = threshold**rows
        if share < 1e-9:
            break
        bands = 1 if share >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-share))
        if bands * rows <= most:
            best = bands, rows
    if best is None:
        raise ValueError("no bands of so few hashes reach the recall")
    return best


@dataclass(frozen=True)
class Join:
    size: int = 5
    threshold: float = 0.8
    recall: float = 0.999
    margin: float = 6.0
    #: Texts of one block, whose differences meet those of another.
    block: int = 1024
    #: Hashes of differences in one block, if the texts are that long.
    block_hashes: int = 1_000_000
    #: N-grams of the texts of a component that one task compares with R.
    task_grams: int = 4_000_000

    def signatures(self) -> int:
        """Signatures of one block."""
        return 4 * self.block

    def shape(self) -> tuple[int, int]:
        return bands_for(self.threshold, self.recall)

    def agreeing(self) -> float:
        """Places in which the signatures of a pair at the threshold agree, at the least."""
        n = math.prod(self.shape())
        deviation = math.sqrt(n * self.threshold * (1 - self.threshold))
        return n * self.threshold - self.margin * deviation


def _signature(grams: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """The lowest of each hash function over the n-grams, 32 bits each."""
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(grams), 512):
        np.minimum(
            low, (grams[i : i + 512, None] * factors + shifts).min(axis=0), out=low
        )
    return (low >> np.uint64(32)).astype(np.uint32)


def _digest(grams: np.ndarray) -> bytes:
    """128 bits of a set of n-grams, given once each."""
    return np.array([grams.sum(), ta.mixed(grams).sum()], np.uint64).tobytes()


def _band_hashes(signatures: np.ndarray) -> np.ndarray:
    """One hash per text and band, of (text, band, row) values."""
    n, bands, rows = signatures.shape
    hashes = np.zeros((n, bands), np.uint64)
    for r in range(rows):
        hashes = ta.mixed(hashes + signatures[:, :, r]) + np.uint64(r + 1)
    return ta.mixed(hashes + np.arange(bands, dtype=np.uint64))


def _prints(join: Join):
    bands, rows = join.shape()
    random = np.random.RandomState(5)
    factors = (random.randint(0, 1 << 62, bands * rows).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
    shifts = random.randint(0, 1 << 62, bands * rows).astype(np.uint64)

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The number of n-grams, a digest of their set, and its signature."""
        for batch in batches:
            data, at = ta.layout(batch.column(1))
            counts, digests, signatures = [], [], []
            for i, j in ta.row_groups(at):
                _, _, hashes, first = ta.words(data[at[i] : at[j]], at[i : j + 1] - at[i])
                grams, bounds = ta.shingles(hashes, first, join.size)
                for a, b in zip(bounds[:-1], bounds[1:]):
                    own = np.unique(grams[a:b])
                    counts.append(len(own))
                    if not len(own):
                        digests.append(None)
                        signatures.append(None)
                        continue
                    digests.append(_digest(own))
                    signatures.append(_signature(own, factors, shifts).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array(counts, pa.int32()),
                    pa.array(digests, pa.binary()),
                    pa.array(signatures, pa.binary()),
                ],
                names=["doc_id", "mark", "n", "digest", "signature"],
            )

    return prints


def _band_rows(join: Join):
    bands, rows = join.shape()

    def band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            signatures = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32)
            hashes = _band_hashes(signatures.reshape(batch.num_rows, bands, rows))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), bands))),
                    pa.array(hashes.ravel().view(np.int64)),
                ],
                names=["digest", "band"],
            )

    return band_rows


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of equal values in the first ``keys`` columns of sorted batches.

    A group holds two blocks at most, so it fits in memory.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k) for k in range(keys)]
        arrays = [c.to_numpy(zero_copy_only=False) for c in columns]
        change = np.zeros(batch.num_rows, bool)
        for a in arrays:
            change[1:] |= a[1:] != a[:-1]
        here = tuple(a[0] for a in arrays)
        cuts = [*np.flatnonzero(change).tolist(), batch.num_rows]
        if last is not None and here != last and held:
            yield pa.Table.from_batches(held)
            held = []
        begin = 0
        for cut in cuts:
            held.append(batch.slice(begin, cut - begin))
            if cut < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
            begin = cut
        last = tuple(a[-1] for a in arrays)
    if held:
        yield pa.Table.from_batches(held)


def _tied(block: np.ndarray, least: float, labels: np.ndarray, rows, others) -> list[tuple[int, int]]:
    """Tie ``others`` to ``rows`` whose signatures agree; an edge for every two trees that meet.

    ``labels`` names the tree of each. ``others`` gives the candidates of a row.
    """
    edges = []
    for i in rows:
        candidates = others(i)
        apart = candidates[labels[candidates] != labels[i]]
        if not len(apart):
            continue
        hits = apart[(block[apart] == block[i]).sum(axis=1) >= least]
        met, first = np.unique(labels[hits], return_index=True)
        if len(met):
            edges += [(i, int(hits[f])) for f in first]
            labels[np.isin(labels, met)] = labels[i]
    return edges


def _alike(join: Join):
    """Per two blocks of one band: what ties together the classes with similar signatures."""
    least = join.agreeing()
    schema = pa.schema([("u", pa.binary()), ("v", pa.binary())])

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs = [], []
        for group in _groups(batches, 3):
            n = group.num_rows
            if n < 2:
                continue
            names = group.column("digest").to_pylist()
            block = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint32)
            block = block.reshape(n, -1)
            side = group.column("side").to_numpy()
            labels = np.arange(n)
            members = [np.flatnonzero(side == s) for s in np.unique(side)]
            edges = []
            for own in members:
                edges += _tied(block, least, labels, own.tolist(), lambda i, own=own: own[own > i])
            if group.column("i")[0].as_py() != group.column("j")[0].as_py():
                # What is tied within a block is passed on where it meets itself.
                edges = []
                if len(members) == 2:
                    edges = _tied(block, least, labels, members[0].tolist(), lambda i: members[1])
            us += [names[a] for a, _ in edges]
            vs += [names[b] for _, b in edges]
            if len(us) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(us), pa.array(vs)], schema=schema)
                us, vs = [], []
        yield pa.RecordBatch.from_arrays(
            [pa.array(us, pa.binary()), pa.array(vs, pa.binary())], schema=schema
        )

    return alike


def _sets(text: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The n-grams of each text, as sorted hashes."""
    data, at = ta.layout(text)
    for i, j in ta.row_groups(at):
        _, _, hashes, first = ta.words(data[at[i] : at[j]], at[i : j + 1] - at[i])
        grams, bounds = ta.shingles(hashes, first, size)
        for a, b in zip(bounds[:-1], bounds[1:]):
            yield np.unique(grams[a:b])


def _differences(join: Join):
    """Per part of a component, R first: how each class differs from R."""
    names = ["component", "digest", "copies", "size", "lacking", "base", "difference"]

    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, base = None, None
        seen: set[bytes] = set()
        for batch in batches:
            rows = zip(*[batch.column(n).to_pylist() for n in ("component", "part", "kind", "digest", "copies")])
            out = []
            for (component, part, kind, digest, copies), own in zip(rows, _sets(batch.column("text"), join.size)):
                if (component, part) != here:
                    here, base, seen = (component, part), None, set()
                # A row may repeat another, or share its mark but not its text.
                if _digest(own) != digest:
                    continue
                if kind == 0:
                    base = own
                elif digest not in seen:
                    seen.add(digest)
                    lacking = np.setdiff1d(base, own, assume_unique=True)
                    added = np.setdiff1d(own, base, assume_unique=True)
                    difference = np.concatenate([lacking, added]).tobytes()
                    out.append((component, digest, copies, len(own), len(lacking), len(base), difference))
            columns = list(zip(*out)) or [()] * len(names)
            kinds = [pa.binary(), pa.binary(), *[pa.int64()] * 4, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return differences


def _components(linked: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """Components of the given rows of a symmetric matrix, each ascending."""
    left = np.zeros(len(linked), bool)
    left[rows] = True
    found = []
    for i in rows:
        if not left[i]:
            continue
        left[i] = False
        members, front = [np.array([i])], np.array([i])
        while len(front):
            front = np.flatnonzero(linked[front].any(axis=0) & left)
            left[front] = False
            members.append(front)
        found.append(np.sort(np.concatenate(members)))
    return found


def _shared(differences: list[np.ndarray]) -> np.ndarray:
    """How many hashes every two differences have in common."""
    n = len(differences)
    common = np.zeros((n, n), np.float32)
    owner = np.repeat(np.arange(n), [len(d) for d in differences])
    if not len(owner):
        return common
    # Only hashes that occur twice can be shared.
    _, which, times = np.unique(np.concatenate(differences), return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1  # of the hashes that stay
    twice = times[which] > 1
    owner, which = owner[twice], number[which[twice]]
    order = np.argsort(which, kind="stable")
    owner, which = owner[order], which[order]
    width = max(64, (1 << 23) // n)
    edges = np.searchsorted(which, np.arange(0, number[-1] + 1 + width, width))
    for part, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        if b > a:
            member = np.zeros((n, width), np.float32)
            member[owner[a:b], which[a:b] - part * width] = 1
            common += member @ member.T
    return common


def _verified(join: Join):
    """Per two blocks of a component: links of each text, and what ties them together."""
    schema = pa.schema(
        [("digest", pa.binary()), ("to", pa.binary()), ("sets", pa.int64()), ("docs", pa.int64())]
    )

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            n = group.num_rows
            if n < 2:
                continue
            names = group.column("digest").to_pylist()
            differences = [np.frombuffer(d, np.uint64) for d in group.column("difference").to_pylist()]
            within = group.column("i")[0].as_py() == group.column("j")[0].as_py()
            side, copies, size, lacking, base = (
                group.column(c).to_numpy() for c in ("side", "copies", "size", "lacking", "base")
            )
            common = _shared(differences) + (base[0] - lacking[:, None] - lacking[None, :])
            linked = common >= join.threshold * (size[:, None] + size[None, :] - common) - 1e-6
            np.fill_diagonal(linked, False)
            everyone = np.arange(n)
            if within:
                counted = linked
                ties = [c for c in _components(linked, everyone) if len(c) > 1]
            else:
                counted = linked & (side[:, None] != side[None, :])
                # Trees within a block are passed on where it meets itself.
                inner = linked & ~counted
                lowest = np.zeros(n, bool)
                for c in _components(inner, everyone):
                    lowest[c[0]] = True
                ties = [c[lowest[c]] for c in _components(linked, everyone)]
            n_sets = counted.sum(axis=1)
            n_docs = counted.astype(np.int64) @ copies
            has = np.flatnonzero(n_sets)
            tied = [(c[0], other) for c in ties for other in c[1:].tolist()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([names[i] for i in has] + [names[b] for _, b in tied], pa.binary()),
                    pa.array([None] * len(has) + [names[a] for a, _ in tied], pa.binary()),
                    pa.array([*n_sets[has].tolist(), *[0] * len(tied)], pa.int64()),
                    pa.array([*n_docs[has].tolist(), *[0] * len(tied)], pa.int64()),
                ],
                schema=schema,
            )

    return verified


def _paired_blocks(df: DataFrame, blocks: Column) -> DataFrame:
    """Add ``i``, ``j``, ``side``: each row once for every pair of blocks its own is in.

    The block follows from the class alone, so groups of the same classes are cut alike.
    """
    own = F.pmod(F.xxhash64("digest"), F.col("_blocks")).cast("int")
    return (
        df.withColumn("_blocks", blocks.cast("int"))
        .withColumn("side", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .withColumn("i", F.least("side", "_other"))
        .withColumn("j", F.greatest("side", "_other"))
    )


def _with_size(rows: DataFrame, name: str, size: Column) -> DataFrame:
    """``rows`` with the size of their ``component``, 1 at the least.

    Only components above 1 are joined, which are few, so that no component's rows meet in one
    task; the table of them is broadcast if it was counted to be small.
    """
    sizes = rows.groupBy(F.col("component").alias("_c")).agg(size.alias(name)).filter(F.col(name) > 1)
    large = bounded(stage(sizes, "large-components"))
    joined = rows.join(large, F.col("component") == F.col("_c"), "left").drop("_c")
    return joined.withColumn(name, F.coalesce(name, F.lit(1)))


def _lowest_row() -> Column:
    """Of a group the row of the lowest ``doc_id``, null before all others, and ``mark``."""
    return F.min(F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", "mark"))


def ngram_join(documents: DataFrame, join: Join = Join()) -> DataFrame:
    """One row per row of ``documents``: its classes and its number of links.

    ``doc_id``; ``class_id``, the lowest ``doc_id`` that it is tied to by links, directly or
    over others; ``copy_id``, the lowest of its copy class; ``n_copies`` of that class;
    ``n_grams`` of its set; ``n_links``, the documents of other sets that are similar enough;
    ``n_set_links``, the number of their sets; ``mark``, a hash of its text; ``class_key``,
    the digest that stands for its class, null without words. Ids may be null or stand for
    several texts, so classes may share a ``class_id``, but none a ``class_key``.
    """
    spark = documents.sparkSession
    ship_code(spark)
    docs = pick(documents, "doc_id", "text")
    kind = dict(docs.dtypes)["doc_id"]
    prints = stage(
        docs.select("doc_id", "text", F.xxhash64("text").alias("mark")).mapInArrow(
            _prints(join), f"doc_id {kind}, mark bigint, n int, digest binary, signature binary"
        ),
        "prints",
    )
    lowest = _lowest_row()
    classes = stage(
        prints.filter("digest is not null")
        .groupBy("digest")
        .agg(
            lowest.alias("lowest"),
            F.count(F.lit(1)).alias("copies"),
            F.first("n").alias("n"),
            F.first("signature").alias("signature"),
        )
        .select(
            "digest", F.col("lowest.doc_id").alias("copy_id"), F.col("lowest.mark").alias("copy_mark"),
            "copies", "n", "signature",
        ),
        "classes",
    )

    # Bands that at least two classes share, with the number of those.
    band_rows = classes.select("digest", "signature").mapInArrow(
        _band_rows(join), "digest binary, band bigint"
    )
    counted = band_rows.groupBy(F.col("band").alias("_band")).count().filter("count > 1")
    shared = band_rows.join(counted, F.col("band") == F.col("_band")).select("digest", "band", "count")
    met = shared.join(classes.select(F.col("digest").alias("_d"), "signature"), F.col("digest") == F.col("_d"))
    blocks = _paired_blocks(met, F.ceil(F.col("count") / join.signatures()))
    grouped = (
        blocks.select("band", "i", "j", "side", "digest", "signature")
        .repartition("band", "i", "j")
        .sortWithinPartitions("band", "i", "j", "digest")
    )
    forest = grouped.mapInArrow(_alike(join), "u binary, v binary")
    parts = connected_components(stage(forest, "alike"), "u", "v")

    # The classes of each component; its lowest one is R.
    named = stage(
        parts.join(
            classes.select(F.col("digest").alias("_d"), "copies", "copy_id", "copy_mark", "n"),
            F.col("node") == F.col("_d"),
        ).drop("_d"),
        "named",
    )
    # Of a component with many n-grams each part goes to another task, with a copy of R.
    grams = F.ceil(F.sum("n") / join.task_grams).cast("int")
    member = stage(
        _with_size(named, "parts", grams).select(
            "component", "parts", F.col("node").alias("digest"), "copies", "copy_id", "copy_mark"
        ),
        "members",
    )
    # A doc_id may be null or stand for several texts: the mark of the text goes with it.
    same = F.col("doc_id").eqNullSafe(F.col("copy_id")) & (F.col("mark") == F.col("copy_mark"))
    # Always by a shuffle: a guess from the size of files would change with the table.
    texts = docs.withColumn("mark", F.xxhash64("text")).join(member.hint("merge"), same)
    own = F.struct(F.lit(1).alias("kind"), F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int").alias("part"))
    as_base = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.lit(0).alias("kind"), p.alias("part"))
    )
    roles = F.when(F.col("digest") == F.col("component"), F.concat(as_base, F.array(own))).otherwise(F.array(own))
    # Little to read and much to compute: as many tasks as a shuffle has, none merged.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    differing = stage(
        texts.select("component", "digest", "copies", "text", F.inline(roles))
        .repartition(tasks, "component", "part")
        .sortWithinPartitions("component", "part", "kind")
        .mapInArrow(
            _differences(join),
            "component binary, digest binary, copies bigint, size bigint, lacking bigint, base bigint, difference binary",
        ),
        "differences",
    )
    # A block holds so many texts, or fewer if they differ much.
    hashes = F.ceil(F.sum(F.octet_length("difference")) / (8 * join.block_hashes))
    weight = F.greatest(F.ceil(F.count(F.lit(1)) / join.block), hashes).cast("int")
    checked = (
        _paired_blocks(_with_size(differing, "blocks", weight), F.col("blocks"))
        .select("component", "i", "j", "side", "digest", "copies", "size", "lacking", "base", "difference")
        .repartition(tasks, "component", "i", "j")
        .sortWithinPartitions("component", "i", "j", "digest")
        .mapInArrow(_verified(join), "digest binary, to binary, sets bigint, docs bigint")
    )
    links = stage(checked, "links")
    tied = connected_components(links.filter("to is not null"), "digest", "to")
    lowest_id = F.min(F.struct(F.col("copy_id").isNotNull(), "copy_id"))["copy_id"]
    named = tied.join(classes.select("digest", "copy_id"), F.col("node") == F.col("digest"))
    of_class = named.groupBy(F.col("component").alias("_c")).agg(lowest_id.alias("class_id"))
    linked = (
        links.groupBy("digest")
        .agg(F.sum("sets").alias("n_set_links"), F.sum("docs").alias("n_links"))
        .join(tied, F.col("digest") == F.col("node"))
        .join(of_class, F.col("component") == F.col("_c"))
        .select(F.col("digest").alias("_linked"), "n_set_links", "n_links", "class_id", "component")
    )
    full = stage(
        classes.join(linked, F.col("digest") == F.col("_linked"), "left").select(
            F.col("digest").alias("_digest"), "copy_id", "copies", "n_set_links", "n_links", "class_id",
            F.col("_linked").isNotNull().alias("tied"),
            F.coalesce("component", "digest").alias("class_key"),
        ),
        "class-links",
    )
    none = F.lit(0).cast("bigint")
    return (
        prints.select("doc_id", "mark", "n", "digest")
        .join(full, F.col("digest") == F.col("_digest"), "left")
        .select(
            "doc_id",
            F.when(F.col("digest").isNull(), F.col("doc_id"))
            .when(F.col("tied"), F.col("class_id"))
            .otherwise(F.col("copy_id"))
            .alias("class_id"),
            F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"),
            F.coalesce("copies", F.lit(1).cast("bigint")).alias("n_copies"),
            F.col("n").cast("bigint").alias("n_grams"),
            F.coalesce("n_links", none).alias("n_links"),
            F.coalesce("n_set_links", none).alias("n_set_links"),
            "mark",
            "class_key",
        )
    )


def one_per_class(documents: DataFrame, join: Join = Join()) -> DataFrame:
    """``documents`` with one row of each class: of the lowest ``doc_id``, once.

    Rows without n-grams all stay.
    """
    found = ngram_join(documents, join)
    kept = (
        found.filter("n_grams > 0")
        .groupBy("class_key")
        .agg(_lowest_row().alias("kept"))
        .select(F.col("kept.doc_id").alias("_doc"), F.col("kept.mark").alias("_mark"))
    )
    wordless = found.filter("n_grams = 0").select(
        F.col("doc_id").alias("_doc"), F.col("mark").alias("_mark")
    )
    columns = documents.columns
    doc, text = f"_{place(columns, 'doc_id')}", f"_{place(columns, 'text')}"
    keyed = positional(documents).withColumn("_key_mark", F.xxhash64(text))
    same = F.col(doc).eqNullSafe(F.col("_doc")) & (F.col("_key_mark") == F.col("_mark"))
    with_words = keyed.join(kept.hint("merge"), same, "left_semi").dropDuplicates([doc, "_key_mark"])
    none = keyed.join(wordless.distinct(), same, "left_semi")
    return with_words.unionByName(none).drop("_key_mark").toDF(*columns)
