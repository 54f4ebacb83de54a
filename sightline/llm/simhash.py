"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are made in one pass over the texts. Their distinct values are sorted by population
counts (of the whole and of its four quarters), cut into tiles, and compared tile against tile with
numpy exclusive-or and bit counts. A fingerprint may have further words; a pair within the radius
on the first word then counts only if it is also within a radius over all words, which makes a wide
radius as sharp as a long fingerprint. Two words that differ in r bits have population counts at most r
apart, and so have their quarters in sum; tile pairs further apart than the radius are skipped, and
so are whole pairs of tile groups, which then are not even shuffled to each other. The comparison
is exact: no bands, no candidates, no cap.

Equal fingerprints are one value before any pair is formed, and a group of tiles gives back a
forest of its links, never all pairs, so large groups of copies stay linear. The forests are joined
by distributed contraction.

``first_of_groups`` takes fingerprints of shingle sets as a filter only: all pairs within a wide
radius are given back, and a pair links if the Jaccard similarity of its shingle sets is at least
``NUM / DEN``. One candidate of each set is verified first; then all those that are still in
different groups. Pairs within a group can't change it.

Defined results: a null or blank text has fingerprint 0 (no shingle) and links like any other;
fewer words than a shingle make one shingle of them all; repeated rows keep their rows; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.common import map_arrow, ship, stored
from sightline.llm.components import components

#: Least Jaccard similarity of near copies, and the bits in which their fingerprints may differ (of the
#: first 64 and of 192; two sets at the limit differ in 15 % of the bits on average).
NUM, DEN = 4, 5
RADIUS, TOTAL = 23, 60
#: Fingerprints of a tile; tiles of a group (the unit that tasks exchange), 2 MB of fingerprints.
TILE, GROUP = 4096, 64
#: Groups into which even small tables are cut, so that all cores get pairs.
SPREAD = 16
#: Words compared at a time by one strip of a tile.
STRIP = 64
_PIECE = 1 << 16


def simhash(text: str, shingle: int = 3, seed: int = 42, extra: int = 0) -> list[int]:
    """64-bit SimHash of a text's word shingles, repeats included; then as many pairs of words of further bits as ``extra`` says."""
    import xxhash

    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return [0] * (1 + 2 * extra)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.r_[0, ends[:-1] + 1]
    width = min(shingle, len(words))
    begin, end = begins[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest, wide, set_bits = xxhash.xxh64_intdigest, xxhash.xxh3_128_digest, np.zeros(64 + 128 * extra, np.int64)
    for at in range(0, len(begin), _PIECE):
        cut = [joined[a:b] for a, b in zip(begin[at : at + _PIECE], end[at : at + _PIECE], strict=True)]
        bits = [np.array([digest(x, seed) for x in cut], "<u8").view(np.uint8).reshape(-1, 8)]
        bits += [np.frombuffer(b"".join([wide(x, seed + k) for x in cut]), np.uint8).reshape(-1, 16) for k in range(extra)]
        set_bits += np.concatenate([np.unpackbits(b, axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for b in bits])
    return np.packbits(2 * set_bits > len(begin), bitorder="little").view("<u8").tolist()


def fingerprints(docs: DataFrame, *, shingle: int = 3, extra: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, more): the first word's bits as a signed long, and all further words; one row per input row, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([simhash(t.as_py() or "", shingle, extra=extra) for t in batch.column(1)], np.uint64).reshape(-1, 1 + 2 * extra)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found[:, 0].view(np.int64)), pa.array([w.tobytes() for w in found[:, 1:]], pa.binary())], ["doc_id", "fp", "more"])

    return map_arrow(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")), run, "doc_id long, fp long, more binary")


def shingle_set(text: str, shingle: int) -> tuple[list[bytes], np.ndarray]:
    """Distinct word shingles of a text, and their sorted 64-bit hashes."""
    import xxhash

    words = text.encode("utf-8", "replace").lower().split()
    width = min(shingle, len(words))
    cut = list({b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}) if words else []
    return cut, np.unique(np.array([xxhash.xxh64_intdigest(x, 42) for x in cut], "<u8"))


def set_prints(docs: DataFrame, *, shingle: int = 5) -> DataFrame:
    """(doc_id, node, n, fp, more) of rows (doc_id, text): a 64-bit hash of the shingle set, its size, and 192 bits of its SimHash."""

    def bits(cut: list[bytes]) -> np.ndarray:
        import xxhash

        total = np.zeros(192, np.int64)
        for at in range(0, len(cut), _PIECE):
            raw = b"".join([xxhash.xxh64_digest(x, 7) + xxhash.xxh3_128_digest(x, 7) for x in cut[at : at + _PIECE]])
            total += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 24), axis=1).sum(axis=0, dtype=np.int64)
        return np.packbits(2 * total > len(cut)).view("<u8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            node, n, prints = [], [], []
            for t in batch.column(1):
                cut, hashes = shingle_set(t.as_py() or "", shingle)
                node.append(xxhash.xxh64_intdigest(hashes.tobytes()))
                n.append(len(hashes))
                prints.append(bits(cut))
            found = np.array(prints, np.uint64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(n, pa.int64()), pa.array(found[:, 0].copy().view(np.int64)), pa.array([w.tobytes() for w in found[:, 1:]], pa.binary())], ["doc_id", "node", "n", "fp", "more"])

    return map_arrow(docs, run, "doc_id long, node long, n long, fp long, more binary")


def sets_of(docs: DataFrame, *, shingle: int = 5) -> DataFrame:
    """(node, shingles) of rows (doc_id, text): the sorted hashes of each shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            raw = [shingle_set(t.as_py() or "", shingle)[1].tobytes() for t in batch.column(1)]
            node = np.array([xxhash.xxh64_intdigest(r) for r in raw], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(raw, pa.binary())], ["node", "shingles"])

    return map_arrow(docs, run, "node long, shingles binary")


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose shingle sets have a Jaccard similarity of at least ``NUM / DEN``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(c.as_py(), "<u8") for c in (a, b))
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(DEN * both >= NUM * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["u", "v"]).filter(pa.array(good, pa.bool_()))

    x, y = sets.select(F.col("node").alias("u"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("v"), F.col("shingles").alias("y"))
    return map_arrow(pairs.join(x, "u").join(y, "v").select("u", "v", "x", "y"), run, "u long, v long")


def counts_of(fp: np.ndarray) -> np.ndarray:
    """Population counts of whole and quarters: (n, 5)."""
    quarters = np.bitwise_count(np.ascontiguousarray(fp).view("<u2").reshape(-1, 4)).astype(np.int16)
    return np.column_stack([quarters.sum(axis=1), quarters])


def apart(lo_a: np.ndarray, hi_a: np.ndarray, lo_b: np.ndarray, hi_b: np.ndarray) -> np.ndarray:
    """Least number of bits by which words within these bounds can differ."""
    gap = np.maximum(0, np.maximum(lo_a - hi_b, lo_b - hi_a))
    return np.maximum(gap[..., 0], gap[..., 1:].sum(axis=-1))


class Forest:
    """Union of links in numpy: each node points to a lesser one."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while len(r) and (above := self.up[r]).tobytes() != r.tobytes():
            r = above
        self.up[x] = r
        return r

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.root(a), self.root(b)
            open_ = a != b
            a, b = a[open_], b[open_]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))


def compare(left: list[np.ndarray], right: list[np.ndarray] | None, radius: int, total: int, every: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Forest (node, root) of the links within ``left`` (right: None) or between left and right tiles; ``every``: all links.

    A tile has the words of its fingerprints and, last, their nodes in its columns.
    """
    whole = left + (right or [])
    tiles = [np.ascontiguousarray(t[:, 0]) for t in whole]
    at = np.cumsum([0, *map(len, tiles)])
    counts = [counts_of(t) for t in tiles]
    lo, hi = np.array([c.min(axis=0) for c in counts]), np.array([c.max(axis=0) for c in counts])
    forest, names, found = Forest(at[-1]), np.concatenate([t[:, -1] for t in whole]), [(np.empty(0, np.uint64),) * 2]
    for i in range(len(left)):
        partners = np.arange(i, len(left)) if right is None else np.arange(len(left), len(tiles))
        for j in partners[apart(lo[i], hi[i], lo[partners], hi[partners]) <= radius]:
            for k in range(0, len(tiles[i]), STRIP):
                strip = tiles[i][k : k + STRIP, None]
                a, b = np.nonzero(np.bitwise_count(strip ^ tiles[j][None, :]) <= radius)
                if i == j:
                    a, b = a[a + k < b], b[a + k < b]
                if whole[i].shape[1] > 2:
                    near = np.bitwise_count(whole[i][a + k, :-1] ^ whole[j][b, :-1]).sum(axis=1, dtype=np.int64) <= total
                    a, b = a[near], b[near]
                if every:
                    found.append((names[a + (at[i] + k)], names[b + at[j]]))
                else:
                    forest.link(a + (at[i] + k), b + at[j])
    if every:
        return np.concatenate([u for u, _ in found]), np.concatenate([v for _, v in found])
    nodes = np.flatnonzero(forest.up != np.arange(at[-1]))
    return names[nodes], names[forest.root(nodes)]


def tiled_links(distinct: DataFrame, radius: int, total: int = 64, every: bool = False) -> DataFrame:
    """Links (u, v) that join the nodes of all rows (fp, more, node) within ``radius`` bits of each other (and ``total`` over all words), as a forest for each pair of tile groups, or ``every`` one."""
    spark, n = distinct.sparkSession, distinct.count()
    ship(spark)
    groups = max(1, -(-n // (TILE * GROUP)), min(SPREAD, -(-n // 256)))
    fp = F.col("fp")
    quarters = [F.bit_count(F.shiftrightunsigned(fp, 16 * q).bitwiseAND(F.lit(0xFFFF))) for q in range(4)]
    ordered = distinct.select("fp", "more", "node").repartitionByRange(groups, F.bit_count(fp), *quarters, fp).sortWithinPartitions(F.bit_count(fp), *quarters, fp)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rest = TaskContext.get().partitionId(), None

        def tile(words: np.ndarray) -> pa.RecordBatch:
            counts = counts_of(words[:, 0])
            return pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([counts.min(axis=0).tolist()], pa.list_(pa.int32())), pa.array([counts.max(axis=0).tolist()], pa.list_(pa.int32())), pa.array([words.tobytes()], pa.binary())], ["grp", "lo", "hi", "words"])

        for batch in batches:
            fp, node = (batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64)[:, None] for c in (0, 2))
            more = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(len(fp), -1) if len(fp) else np.empty((0, 0), np.uint64)
            words = np.hstack([fp, more, node])
            rest = words if rest is None else np.concatenate([rest, words])
            while len(rest) >= TILE:
                yield tile(rest[:TILE])
                rest = rest[TILE:]
        if rest is not None and len(rest):
            yield tile(rest)

    width = 2 + (len(first["more"]) // 8 if (first := distinct.select("more").first()) else 0)
    tiles = stored(ordered.mapInArrow(cut, "grp int, lo array<int>, hi array<int>, words binary"), "simhash-tiles")
    # one row per group, of which there are as many as range partitions
    bounds = tiles.groupBy("grp").agg(F.array(*[F.min(F.col("lo")[i]) for i in range(5)]).alias("lo"), F.array(*[F.max(F.col("hi")[i]) for i in range(5)]).alias("hi")).orderBy("grp").collect()
    names = np.array([r["grp"] for r in bounds])
    lo, hi = (np.array([r[k] for r in bounds], np.int32).reshape(-1, 5) for k in ("lo", "hi"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                me = int(np.searchsorted(names, group))
                near = names[apart(lo[me], hi[me], lo, hi) <= radius]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(near, group), pa.int32()), pa.array(np.maximum(near, group), pa.int32()), pa.array([group] * len(near), pa.int32()), pa.array([words.as_py()] * len(near), pa.binary())], ["i", "j", "grp", "words"])

    def meet(table: pa.Table) -> pa.Table:
        groups, words = table.column("grp").to_numpy(), [np.frombuffer(w.as_py(), np.uint64).reshape(-1, width) for w in table.column("words")]
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left = [w for g, w in zip(groups, words, strict=True) if g == i]
        u, v = compare(left, None if i == j else [w for g, w in zip(groups, words, strict=True) if g == j], radius, total, every)
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    sent = tiles.select("grp", "words").mapInArrow(send, "i int, j int, grp int, words binary")
    return sent.groupBy("i", "j").applyInArrow(meet, "u long, v long")


def near_duplicates(docs: DataFrame, *, shingle: int = 5, radius: int = 16, extra: int = 1, total: int = 36, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): the 16 hex digits of the first word, and the least id reachable through links.

    The defaults take five words and 192 bits: copies with a Jaccard similarity of 0.8 differ in 15 %
    of the bits on average, unrelated texts in half. ``extra=0`` links by the first word alone.
    """
    prints = stored(fingerprints(docs, shingle=shingle, extra=extra, id_col=id_col, text_col=text_col), "simhash-prints")
    distinct = stored(prints.groupBy("fp", "more").agg(F.min("doc_id").alias("first")).withColumn("node", F.xxhash64("fp", "more") if extra else F.col("fp")), "simhash-distinct")
    linked = stored(components(tiled_links(distinct, radius, total)), "simhash-components")
    named = linked.withColumnRenamed("node", "of_node").join(distinct, F.col("of_node") == F.col("node")).select("node", "root", "first")
    least = named.groupBy(F.col("root").alias("of")).agg(F.min("first").alias("least"))
    linked_to = named.join(least, F.col("root") == F.col("of")).select(F.col("node").alias("of_node"), "least")
    named_all = distinct.join(linked_to, F.col("node") == F.col("of_node"), "left").select("fp", "more", F.coalesce("least", "first").alias("component_id"))
    return prints.join(named_all, ["fp", "more"]).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def verified_groups(docs: DataFrame, *, shingle: int = 5, radius: int = RADIUS, total: int = TOTAL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id): the least id reachable through verified links. Rows without an id have no group."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).where("doc_id IS NOT NULL")
    prints = stored(set_prints(rows, shingle=shingle), "near-prints")
    nodes = stored(prints.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.min(F.struct("fp", "more")).alias("f")).select("node", "first", "n", "f.fp", "f.more"), "near-nodes")
    pairs = tiled_links(nodes, radius, total, every=True).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    size = lambda name: nodes.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"))
    pairs = stored(pairs.join(size("u"), "u").join(size("v"), "v").where(F.least("n_u", "n_v") * DEN >= F.greatest("n_u", "n_v") * NUM).select("u", "v"), "near-candidates")
    met = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    wanted = nodes.join(met, "node", "left_semi").select(F.col("first").alias("doc_id"))
    sets = stored(sets_of(rows.join(wanted, "doc_id", "left_semi"), shingle=shingle).dropDuplicates(["node"]), "near-sets")
    links = stored(similar(pairs.groupBy("u").agg(F.min("v").alias("v")), sets), "near-links")
    known = stored(components(links), "near-components")
    root = lambda name: known.select(F.col("node").alias(name), F.col("root").alias(f"root_{name}"))
    apart_ = pairs.join(root("u"), "u", "left").join(root("v"), "v", "left").where(F.coalesce("root_u", "u") != F.coalesce("root_v", "v")).select("u", "v")
    linked = stored(components(links.union(similar(apart_, sets))), "near-components")
    of = nodes.select("node", "first").join(linked, "node", "left").select("node", "first", F.coalesce("root", "node").alias("of"))
    least = of.groupBy("of").agg(F.min("first").alias("component_id"))
    return prints.select("doc_id", "node").join(of.select("node", "of"), "node").join(least, "of").select("doc_id", "component_id")


def first_of_groups(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one row of each group of verified near duplicates, that of the least id; all columns are kept. Rows without an id stay."""
    groups = verified_groups(docs, id_col=id_col, **options).distinct()
    stays = groups.where("doc_id = component_id").select(F.col("doc_id").alias("of_"))
    copy = F.row_number().over(Window.partitionBy("id_").orderBy(F.xxhash64(*[f"c{i}" for i in range(len(docs.columns))])))
    named = docs.select([F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).withColumn("id_", F.col(f"c{docs.columns.index(id_col)}").cast("long"))
    known = named.where("id_ IS NOT NULL").withColumn("copy_", copy).where("copy_ = 1").join(stays, F.col("id_") == F.col("of_"), "left_semi").drop("copy_")
    out = known.unionByName(named.where("id_ IS NULL"))
    return out.select([F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
