"""MinHash near-dedup: SuperMinHash signatures, bands, verification, union-find.

Documents are sets of five-word shingles. SuperMinHash gives each shingle
one value a round, at places dealt by a permutation of its own, so that the
values of a signature are correlated and vary less than independent ones;
a document stops early, once no later round can lower any place. Signatures
are cut into bands; documents with an equal band are candidates. Candidates
are verified on full sets, and union-find groups the verified links.

Groups of any size are handled without their pairs. Documents with equal
sets are one class, represented by the smallest id. In a first pass each
document is compared with one partner, the smallest id of its fullest
bucket, which joins nearly all of a group of near copies. In a second pass
only what is left apart is compared: in each bucket the documents outside
its largest group against all, in blocks, on full sets by matrix products.
Pairs inside a group are never formed, no pair is a row, and every pair
across groups that shares a bucket is verified.

What a document needs to know of its class, bucket or centre is told to it
in ``PARTS`` parts of the group, so that no group is in one task, and a
centre's full set is sent once for each ``FAN`` of its members.

The bands find a pair at the threshold 0.85 with a chance of 1 - 8e-7 (24
bands of 5), at 0.8 with 1 - 7e-5; these are the only links that can be lost.

Defined cases: a document without words or text (null included) has an
empty set, is linked with nothing and stays. With one to four words, the
whole sequence is its one shingle. Rows with equal ids are one document:
that with the fewest shingles, of several the one whose set has the smallest
digest, whatever the order of the rows. A row with a null id is a document
of its own that is linked with nothing; it stays, and its component is null.
Ties go to the smallest id. Only the id and text columns are read, so other
columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, connected_components, scratch, trimmed, written
from .shingles import shingle_sets, text_batches
from .syncmers import mix

BANDS, ROWS = 24, 5
PLACES = BANDS * ROWS
#: Parts in which the rows of a group are told what the group has in common.
PARTS = 256
#: Members that are compared with one copy of their centre's set.
FAN = 256
#: Rows in a batch between Spark and Python; a row holds a text or two full sets.
BATCH = 1000
#: Documents of a bucket in a block of the second pass.
BLOCK = 512
#: Shingles of documents whose signatures are computed together.
TOGETHER = 200_000
_U25 = np.uint64(25)
_FULL = np.uint32(0xFFFFFFFF)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """SuperMinHash signatures, a row of ``PLACES`` values for each set.

    A value holds the round (7 bits) above 25 random bits. In round j each
    element lowers the place that a Fisher-Yates shuffle, seeded by the
    element, deals it j-th.
    """
    out = np.full((len(sets), PLACES), _FULL, np.uint32)
    element = np.concatenate([np.zeros(0, np.uint64), *sets])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    dealt: np.ndarray | None = None
    for j in range(PLACES):
        if not len(element):
            break
        state = mix(element + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        pick = j + (((state & np.uint64(0xFFFFFFFF)) * np.uint64(PLACES - j)) >> np.uint64(32)).astype(np.int64)
        value = ((np.uint64(j) << _U25) | (state >> np.uint64(39))).astype(np.uint32)
        if dealt is None:
            place = pick
        else:
            n = np.arange(len(element))
            place = dealt[n, pick].astype(np.int64)
            dealt[n, pick] = dealt[:, j]
        np.minimum.at(out.reshape(-1), owner * PLACES + place, value)
        # Later values are at least (j + 1) << 25: a document whose places are all lower is done.
        going = (out.max(axis=1) >> np.uint32(25)) > j
        keep = going[owner]
        element, owner = element[keep], owner[keep]
        if dealt is None:
            dealt = np.tile(np.arange(PLACES, dtype=np.uint8), (len(element), 1))
            dealt[np.arange(len(element)), pick[keep]] = 0
        else:
            dealt = dealt[keep]
    return out


def sketch(signature: np.ndarray) -> np.ndarray:
    """Eight bits of each place: what bands and estimates are made from."""
    return (mix(signature.astype(np.uint64)) & np.uint64(0xFF)).astype(np.uint8)


def band_keys(short: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each sketch."""
    parts = short.reshape(-1, BANDS, ROWS).astype(np.uint64)
    h = np.zeros(parts.shape[:2], np.uint64)
    for i in range(ROWS):
        h = h << np.uint64(8) | parts[:, :, i]
    return mix(h << np.uint64(8) | np.arange(BANDS, dtype=np.uint64))


FEATURES = "doc_id long, n_shingles long, set_a long, set_b long, sketch binary, bands array<long>"


def digests(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Two 64-bit digests of each set."""
    a = [int(mix(s).sum(dtype=np.uint64).view(np.int64)) for s in sets]
    b = [int(np.bitwise_xor.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D)), initial=np.uint64(0)).view(np.int64)) for s in sets]
    return a, b


def features(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` with set size, set digest, sketch and band keys."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_batches(batches):
            sets = shingle_sets(texts)
            at = 0
            while at < len(sets):
                n, size = at, 0
                while n < len(sets) and (n == at or size + len(sets[n]) <= TOGETHER):
                    size += len(sets[n])
                    n += 1
                part = sets[at:n]
                signed = signatures(part)
                short = sketch(signed)
                keys = band_keys(short).view(np.int64)
                a, b = digests(part)
                empty = [len(s) == 0 for s in part]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[at:n], pa.int64()),
                        pa.array([len(s) for s in part], pa.int64()),
                        pa.array(a, pa.int64()),
                        pa.array(b, pa.int64()),
                        pa.array([s.tobytes() for s in short], pa.binary()),
                        pa.array([[] if e else k.tolist() for e, k in zip(empty, keys, strict=True)], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n_shingles", "set_a", "set_b", "sketch", "bands"],
                )
                at = n

    return docs.mapInArrow(run, FEATURES)


def full_sets(docs: DataFrame) -> DataFrame:
    """``(doc_id, set_a, set_b, members)``: the sorted shingle hashes of ``docs(doc_id, text)``, with their digests."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_batches(batches):
            sets = shingle_sets(texts)
            a, b = digests(sets)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "set_a", "set_b", "members"])

    return docs.mapInArrow(run, "doc_id long, set_a long, set_b long, members binary")


def with_group(rows: DataFrame, keys: list[str], by: str, partial: list[Column], final: list[Column], kept: str = "true", how: str = "inner") -> DataFrame:
    """``rows`` with aggregates of their group by ``keys``, of the groups for which ``kept`` holds.

    The rows of a group are parted by a hash of the column ``by``; the group's
    numbers are told to its parts, at most ``PARTS`` rows, and those to their rows.
    """
    parted = rows.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(PARTS)))
    local = parted.groupBy(*keys, "_part").agg(*partial)
    groups = local.groupBy(*keys).agg(*final).where(kept)
    told = local.select(*keys, "_part").join(groups, keys)
    return parted.join(told, [*keys, "_part"], how).drop("_part")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``pairs(a, b)`` with 100 * intersection >= percent * union, on full sets.

    The members b of a centre a are dealt out in parts of about ``FAN``; each
    part gets the centre's set once, ahead of the members' own.
    """

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, x = None, np.zeros(0, np.uint64)
        for batch in batches:
            out_a, out_b = [], []
            for a, b, members in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("members"), strict=True):
                y = np.frombuffer(members.as_buffer(), np.uint64)
                if b is None:
                    centre, x = a, y.copy()
                    continue
                if a != centre:
                    raise ValueError(f"the set of {a} isn't ahead of its members")
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= percent * (len(x) + len(y) - common):
                    out_a.append(a)
                    out_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    counted = with_group(pairs, ["a"], "b", [F.count("*").alias("n")], [F.sum("n").alias("n")])
    dealt = counted.select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / FAN)).alias("part"))
    held = sets.select("doc_id", "members")
    heads = dealt.select("a", "part").distinct().join(held.withColumnRenamed("doc_id", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "members")
    others = dealt.join(held.withColumnRenamed("doc_id", "b"), "b").select("a", "part", "b", "members")
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return heads.union(others).repartition(n, "a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first()).mapInArrow(run, "a long, b long")


def union_find(links: DataFrame, keep: bool = False) -> DataFrame:
    """Components ``(node, component)`` of ``links(a, b)``.

    Union-find joins the links within each partition first, which leaves a
    link for each node there; the forests are then joined across partitions.
    """

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent[up]
                x = parent[x]
            return x

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        found = [(x, r) for x in list(parent) if (r := root(x)) != x]
        if found:
            src, dst = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    return connected_components(links.mapInArrow(run, "src long, dst long"), "near-groups", keep)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each unit (key, i, j), from batches sorted by it. Small units come together."""
    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        last = rows.slice(rows.num_rows - 1)
        same = np.ones(rows.num_rows, bool)
        for c in ("key", "i", "j"):
            same &= rows.column(c).to_numpy() == last.column(c)[0].as_py()
        n = rows.num_rows - int(same.sum())
        if n:
            yield rows.slice(0, n).combine_chunks()
        held = rows.slice(n)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _starts(rows: pa.Table) -> np.ndarray:
    """Where the units of a table begin, and its end."""
    key = np.stack([rows.column(c).to_numpy() for c in ("key", "i", "j")])
    return np.r_[0, np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, rows.num_rows]


def _by_unit(rows: DataFrame) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j")


UNIT = "key long, i long, j long, other boolean, doc_id long, component long"


def apart(members: DataFrame, groups: DataFrame, shapes: DataFrame, percent: int) -> DataFrame:
    """What is left to compare: documents by unit, ``(key, i, j, other, doc_id, component)``.

    ``members(key, band, doc_id)``, ``groups(node, component)`` for documents
    that have been joined, ``shapes(doc_id, n_shingles, sketch)``. In a bucket
    the documents outside its largest group (``other``) are compared with
    all, in units of two blocks. A document stays in a unit if it has a
    partner there of another group and of a size that allows a link, whom it
    meets in no earlier band. Rows are documents, never pairs.
    """
    placed = members.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "band", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    sizes = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    open_keys = (
        sizes.groupBy("key")
        .agg(F.max(F.struct("n", (-F.col("component")).alias("c"))).alias("top"), F.sum("n").alias("total"), F.count("*").alias("parts"))
        .where("parts > 1")
        .select("key", (-F.col("top.c")).alias("largest"), F.ceil(F.col("total") / BLOCK).alias("all_blocks"), F.ceil((F.col("total") - F.col("top.n")) / BLOCK).alias("other_blocks"))
    )
    rows = placed.join(open_keys, "key").join(shapes, "doc_id")
    mine = lambda blocks: F.pmod(F.xxhash64("doc_id"), F.col(blocks))
    carried = ("doc_id", "component", "band", "n_shingles", "sketch")
    as_any = rows.select("key", mine("all_blocks").alias("i"), F.explode(F.sequence(F.lit(0), F.col("other_blocks") - 1)).alias("j"), F.lit(False).alias("other"), *carried)
    as_other = rows.where("component <> largest").select("key", F.explode(F.sequence(F.lit(0), F.col("all_blocks") - 1)).alias("i"), mine("other_blocks").alias("j"), F.lit(True).alias("other"), *carried)

    def partnered(comps, bands, sizes, shorts, other) -> np.ndarray:
        keep = np.zeros(len(comps), bool)
        any_at = np.flatnonzero(~other)
        for x in np.flatnonzero(other):
            at = any_at[(comps[any_at] != comps[x]) & (100 * np.minimum(sizes[any_at], sizes[x]) >= percent * np.maximum(sizes[any_at], sizes[x]))]
            if len(at):
                equal = shorts[at] == shorts[x]
                first = equal.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1)
                at = at[first == bands[x]]
                keep[at] = True
                keep[x] |= len(at) > 0
        return keep

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _units(batches):
            comps, bands, sizes, other = (rows.column(c).to_numpy() for c in ("component", "band", "n_shingles", "other"))
            shorts = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(-1, PLACES)
            keep, cuts = np.zeros(rows.num_rows, bool), _starts(rows)
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                keep[s:e] = partnered(comps[s:e], bands[s:e], sizes[s:e], shorts[s:e], other[s:e])
            yield from rows.select(["key", "i", "j", "other", "doc_id", "component"]).filter(pa.array(keep)).to_batches()

    return _by_unit(as_any.union(as_other)).mapInArrow(run, UNIT)


#: Shingles that a unit's documents are compared on at a time.
COLUMNS = 4096


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of two lists, as matrix products."""
    sets = left + right
    values, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    number = np.cumsum(often > 1) - 1  # a shingle of one set alone is in no intersection
    used = often[column] > 1
    row, column = row[used], number[column[used]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    total = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, total, COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        part = np.zeros((len(sets), min(COLUMNS, total - at)), np.float32)
        part[row[a:b], column[a:b] - at] = 1
        out += part[: len(left)] @ part[len(left) :].T
    return out


def links_apart(units: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``(a, b)`` between groups among the documents of each unit, on full
    sets; in a unit only as many as join its groups."""

    def forest(a: np.ndarray, b: np.ndarray, comps: np.ndarray) -> list[int]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent[up]
                x = parent[x]
            return x

        keep = []
        for n, (x, y) in enumerate(zip(comps[a].tolist(), comps[b].tolist(), strict=True)):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
                keep.append(n)
        return keep

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _units(batches):
            ids, comps, other = (rows.column(c).to_numpy() for c in ("doc_id", "component", "other"))
            members = [np.frombuffer(m.as_buffer(), np.uint64) for m in rows.column("members").combine_chunks()]
            cuts = _starts(rows)
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                left, right = s + np.flatnonzero(other[s:e]), s + np.flatnonzero(~other[s:e])
                if not len(left) or not len(right):
                    continue
                common = common_counts([members[i] for i in left], [members[i] for i in right])
                size = lambda at: np.array([len(members[i]) for i in at], np.float64)
                union = size(left)[:, None] + size(right)[None, :] - common
                a, b = np.nonzero((100.0 * common >= percent * union) & (comps[left][:, None] != comps[right][None, :]))
                a, b = left[a], right[b]
                if len(kept := forest(a, b, comps)):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a[kept]]), pa.array(ids[b[kept]])], ["a", "b"])

    return _by_unit(units.join(sets, "doc_id").select("key", "i", "j", "other", "doc_id", "component", "members")).mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every document.

    Documents are linked if 100 * intersection >= ``percent`` * union of
    their shingle sets; ``component_id`` is the smallest id reachable.
    ``percent`` should be 80 or more, for which the bands are chosen.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with scratch(spark), arrow_rows(spark, BATCH):
        found = written(features(rows), "near-features")
        # Rows with one id are one document; the set that sorts first stands for it.
        least = F.min(F.struct("n_shingles", "set_a", "set_b", "sketch", "bands")).alias("s")
        shaped = found.where("doc_id is not null").groupBy("doc_id").agg(least, F.count("*").alias("copies")).select("doc_id", "s.*", "copies")
        equal = ["n_shingles", "set_a", "set_b"]
        low = [F.min("doc_id").alias("rep"), F.count("*").alias("n")]
        classed = with_group(shaped, equal, "doc_id", low, [F.min("rep").alias("rep"), F.sum("n").alias("n")], "n > 1 and n_shingles > 0", "left")
        classed = written(classed.withColumn("rep", F.coalesce("rep", "doc_id")).drop("n"), "near-classes")
        member = written(classed.select("doc_id", "n_shingles", "rep", "copies"), "near-members", keep=True)
        nameless = written(found.where("doc_id is null").select("doc_id", "n_shingles"), "near-nameless", keep=True)

        reps = classed.where("rep = doc_id and n_shingles > 0")
        banded = reps.select("doc_id", F.posexplode("bands").alias("band", "key"))
        low = [F.min("doc_id").alias("centre"), F.count("*").alias("n")]
        bucketed = with_group(banded, ["key"], "doc_id", low, [F.min("centre").alias("centre"), F.sum("n").alias("n")], "n > 1")
        bucketed = written(bucketed.select("key", "band", "doc_id", "centre"), "near-buckets")
        shapes = written(reps.join(bucketed.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "n_shingles", "set_a", "set_b", "sketch"), "near-shapes")
        # Merged, not broadcast: these ids grow with the documents.
        texts = rows.join(shapes.select("doc_id").hint("merge"), "doc_id", "left_semi")
        named = ["doc_id", "set_a", "set_b"]
        sets = written(full_sets(texts).dropDuplicates(named).join(shapes.select(*named).hint("merge"), named, "left_semi"), "near-sets")

        # First pass: each document with the centre that it meets in most buckets.
        partner = bucketed.where("doc_id <> centre").groupBy("doc_id", "centre").agg(F.count("*").alias("n"))
        partner = partner.groupBy("doc_id").agg(F.max(F.struct("n", (-F.col("centre")).alias("c"))).alias("top")).select((-F.col("top.c")).alias("a"), F.col("doc_id").alias("b"))
        links = written(verify(written(partner, "near-pairs"), sets, percent), "near-links")
        groups = written(union_find(links), "near-joined")

        # Second pass: what the first has left apart.
        units = written(apart(bucketed.select("key", "band", "doc_id"), groups, shapes.drop("set_a", "set_b"), percent), "near-units")
        more = written(links_apart(units, sets.select("doc_id", "members"), percent), "near-links")
        joined = union_find(links.union(more), keep=True).withColumnRenamed("node", "rep")

    grouped = member.join(joined, "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"), F.explode(F.expr("array_repeat(0, cast(copies as int))")).alias("copy"))
    kept = (F.col("doc_id") == F.col("component_id")).alias("kept")
    alone = nameless.select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return grouped.select("doc_id", "n_shingles", "component_id", kept).union(alone)


def dedup(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group, that of the smallest id; all
    columns as they are. Rows with a null id stay; of rows with one id, all or none."""
    kept = near_groups(docs, percent, id_col, text_col).where("not kept").select(F.col("doc_id").alias("_dropped_id"))
    return docs.join(kept, F.col(id_col) == F.col("_dropped_id"), "left_anti")
