"""N-gram Jaccard join: size-banded tiles, bitmap bounds, exact intersection.

A document's set is its distinct word shingles.  Two documents link when
``den * intersection >= num * union``.

Classes.  Documents with equal sets form one class; its smallest doc_id stands
for it.  Only classes are compared.

Tiles.  Sizes fall in bands.  For a band the largest difference d that a linked
pair can show is known; the hash space is cut into more than d parts, so a
linked pair agrees on at least one whole part.  A tile is (band, part, hash of
the shingles in that part).  Parts that are empty on both sides prove nothing
by themselves and are only used by sets that have too many of them for another
part to be certain; the argument holds for each pair, so no link is lost.

Compare.  Each class is compared with the smallest class it shares a tile with
(one pair a class), which settles groups of near copies.  Only tiles whose
members are still in several components are compared in full, in blocks of
bounded size, and only between components: bit counts of hashed bitmaps bound
the overlap from above, then sorted arrays are intersected.

Skew.  A batch sends one member of a tile to where the tile's members meet and
hands the rest on as they are, so a tile with a third of all documents is as
many entries as there are batches in the search for shared tiles; blocks share
out its comparison.  Texts stay where
they are but for those of classes in tiles.

A null text, or one without words, has the empty set and links with nothing;
fewer words than a shingle has make one shingle; repeated rows share a class;
rows that share a doc_id but not their text are one node under that id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spark import broadcast_if_small, components, discard, materialize, release, row_key, shuffle_width, unused
from .words import distinct_sets, mix, packed, shingle_hashes, sliced, trim, unpacked

_U = np.uint64
_BAND = _U(127)  # the bits of a tile that hold its band
BATCH = 1000
LARGE_TILE = 12
BLOCK_MEMBERS = 1024
BLOCK_SHINGLES = 4_000_000


class Bands:
    """Sizes in bands that grow by half, with the parts of each."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        self.edges = [1]
        while self.edges[-1] < 1 << 40:
            self.edges.append(max(self.edges[-1] + 1, self.edges[-1] * 3 // 2))

    def of(self, size: int) -> range:
        """The bands in which a set of this size can be the smaller or the larger of a linked pair."""
        low = -(-size * self.num // self.den)
        return range(int(np.searchsorted(self.edges, low, "right")) - 1, int(np.searchsorted(self.edges, size, "right")))

    def difference(self, band: int) -> int:
        small = self.edges[band + 1] - 1
        large = small * self.den // self.num
        return (self.den - self.num) * (small + large) // (self.den + self.num)

    def parts(self, band: int) -> int:
        d = self.difference(band)
        return d + 2 + d * 3 // 20

    def signatures(self, s: np.ndarray) -> np.ndarray:
        """The tiles of a sorted set."""
        out = []
        sums = np.empty(len(s) + 1, _U)
        sums[0] = 0
        np.cumsum(mix(s), out=sums[1:])
        for band in self.of(len(s)) if len(s) else ():
            k = self.parts(band)
            part = ((s >> _U(32)) * _U(k)) >> _U(32)
            ends = np.searchsorted(part, np.arange(k, dtype=_U), "right")
            size = np.diff(ends, prepend=0)
            total = sums[ends] - sums[ends - size]
            use = size > 0
            if k - int(np.count_nonzero(use)) >= k - self.difference(band):
                use[:] = True
            place = np.flatnonzero(use)
            out.append((mix(total[place] + mix((place + (band << 40)).astype(_U))) & ~_BAND) | _U(band))
        return np.concatenate(out) if out else np.zeros(0, _U)

    def slack(self, s: np.ndarray) -> list[tuple[int, int]]:
        """(band, n): a linked partner shares a tile of the band with this set even without any n of its tiles there."""
        out = []
        for band in self.of(len(s)) if len(s) else ():
            k = self.parts(band)
            filled = len(np.unique(((s >> _U(32)) * _U(k)) >> _U(32)))
            out.append((band, max(0, k - self.difference(band) - 1 - (k - filled))))
        return out


def digest(s: np.ndarray) -> tuple[int, int]:
    """Two 63-bit sums that name a set."""
    return int(mix(s).sum(dtype=_U) >> _U(1)), int(mix(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U) >> _U(1))


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Exact, over sorted distinct arrays."""
    both = np.sort(np.concatenate([a, b]))
    inter = int(np.count_nonzero(both[1:] == both[:-1]))
    return den * inter >= num * (len(a) + len(b) - inter)


def bitmap(s: np.ndarray) -> np.ndarray:
    """Bits at the hashed places of a set, eight a shingle or more: 256 bits at least, a power of two."""
    width = max(256, 1 << (8 * len(s) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(s & _U(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(_U)


def folded(maps: list[np.ndarray]) -> np.ndarray:
    """Bitmaps as rows of the least width: the halves of a wider one laid on each other."""
    least = min(map(len, maps))
    return np.array([np.bitwise_or.reduce(m.reshape(-1, least), axis=0) for m in maps])


def hopeful(maps: np.ndarray, size: np.ndarray, i: int, js: np.ndarray, num: int, den: int) -> np.ndarray:
    """Those of ``js`` that may link with ``i``: bits of one that the other lacks are shingles that it lacks."""
    js = js[(size[js] * num <= size[i] * den) & (size[i] * num <= size[js] * den)]
    if not len(js):
        return js
    lacks = np.bitwise_count(maps[i] & ~maps[js]).sum(1, dtype=np.int64), np.bitwise_count(maps[js] & ~maps[i]).sum(1, dtype=np.int64)
    most = np.minimum(size[i] - lacks[0], size[js] - lacks[1])
    return js[den * most >= num * (size[i] + size[js] - most)]


def links_between(sets: list[np.ndarray], comps: list[int], split: int | None, num: int, den: int) -> list[tuple[int, int]]:
    """Links that join components: positions of pairs (of the first ``split`` with the rest, or of all), at most one for each joining."""
    if not sets:
        return []
    maps = folded([bitmap(s) for s in sets])
    size = np.array([len(s) for s in sets])
    comp = np.unique(np.array(comps), return_inverse=True)[1]
    found = []
    for i in range(split if split is not None else len(sets)):
        low = split if split is not None else i + 1
        for j in hopeful(maps, size, i, low + np.flatnonzero(comp[low:] != comp[i]), num, den):
            if comp[j] != comp[i] and linked(sets[i], sets[j], num, den):
                found.append((i, int(j)))
                comp[comp == comp[j]] = comp[i]
    return found


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def _slices(batches: Iterator[pa.RecordBatch], width: int, rows: int = BATCH) -> Iterator[tuple[list, list[np.ndarray]]]:
    for part in sliced(batches, rows=rows):
        yield part.column("doc_id").to_pylist(), list(distinct_sets(*shingle_hashes(part.column("text"), width, fold=True)))


def _named_sets(docs: DataFrame, width: int, bands: Bands) -> DataFrame:
    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _slices(batches, width):
            names = [digest(s) for s in sets]
            columns = [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(list(c), pa.int64()) for c in zip(*names, strict=True))]
            slack = [[{"band": b, "slack": n} for b, n in bands.slack(s)] for s in sets]
            columns.append(pa.array(slack, pa.list_(pa.struct([("band", pa.int64()), ("slack", pa.int64())]))))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "d1", "d2", "slack"])

    return _texts(docs).mapInArrow(named, "doc_id long, n_shingles long, d1 long, d2 long, slack array<struct<band:long,slack:long>>")


def _members(member: str) -> list[Column]:
    """Aggregates that name a set of distinct ids: their number, the least and 128 bits of exclusive-ored hashes."""
    mixed = [F.bit_xor(F.xxhash64(F.lit(seed), F.col(member))).alias(name) for seed, name in ((11, "check1"), (23, "check2"))]
    return [F.count("*").alias("m"), F.min(member).alias("least"), *mixed]


MEMBERS = ("m", "least", "check1", "check2")


def _large(tiles: DataFrame) -> DataFrame:
    return tiles.groupBy("tile").agg(F.count("*").alias("m")).where(F.col("m") > LARGE_TILE).select("tile")


def _needed(tiles: DataFrame, classes: DataFrame) -> DataFrame:
    """The members of ``tiles(tile, id)`` that must be compared there.

    Linked sets share several tiles of a band, a number that the band and the
    empty parts give.  A class with fewer of its tiles large than that is sure to
    meet each of its partners in a small tile, and leaves the large ones.  So
    tiles that a common passage makes empty themselves, and no link is lost.
    """
    large = broadcast_if_small(materialize(_large(tiles), "large"))
    inside = materialize(tiles.join(large, "tile").withColumn("band", F.col("tile").bitwiseAND(F.lit(127))), "large-tiles")
    slack = classes.select("id", F.explode("slack").alias("s")).select("id", "s.band", "s.slack")
    unsure = inside.groupBy("id", "band").agg(F.count("*").alias("n")).join(slack, ["id", "band"]).where("n > slack").select("id", "band")
    kept = inside.join(unsure, ["id", "band"], "left_semi").select("tile", "id")
    out = materialize(tiles.join(large, "tile", "left_anti").select("tile", "id").unionByName(kept), "needed-tiles")
    discard(tiles, inside)
    return out


def _shared_tiles(docs: DataFrame, width: int, bands: Bands) -> DataFrame:
    """(tile, d1): the members of tiles that several classes are in."""
    buckets = 1 << max(6, (2 * shuffle_width(docs.sparkSession) - 1).bit_length())
    shift = _U(64 - buckets.bit_length() + 1)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _slices(batches, width):
            own = [bands.signatures(s) for s in sets]
            tile = np.concatenate(own)
            names, number = np.unique(np.array([digest(s)[0] for s in sets], np.int64), return_inverse=True)
            name = np.repeat(number, [len(x) for x in own]).astype(np.uint16)  # a batch has at most BATCH classes
            order = np.lexsort((name, tile))
            tile, name = tile[order], name[order]
            new_tile = np.ones(len(tile), bool)
            new_tile[1:] = tile[1:] != tile[:-1]
            once = new_tile.copy()
            once[1:] |= name[1:] != name[:-1]
            tile, name, first = tile[once], name[once], new_tile[once]
            alone = np.ones(len(tile), bool)  # the tile's only class in this batch
            alone[:-1] &= first[1:]
            alone &= first
            ends = np.searchsorted(tile >> shift, np.arange(buckets, dtype=_U), "right")
            starts = np.concatenate([[0], ends[:-1]])
            full = np.flatnonzero(ends > starts)
            rest = ~alone
            rows = [(k, packed(tile[a:b][first[a:b]]), name[a:b][first[a:b]].tobytes(), b"", b"") for k, a, b in zip(full.tolist(), starts[full], ends[full], strict=True)]
            if rest.any():  # known to be shared: to any bucket, which passes them on
                rows.append((int(tile[rest][0] >> _U(7)) % buckets, b"", b"", packed(tile[rest]), name[rest].tobytes()))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            blobs = [pa.array(list(c), pa.binary()) for c in columns[1:]]
            classes = pa.array([names.tobytes()] * len(rows), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(list(columns[0]), pa.int32()), *blobs, classes], names=["bucket", "tiles", "names", "near_tiles", "near_names", "classes"])

    def meet(group: pa.Table) -> pa.Table:
        def joined(tiles: str, names: str) -> tuple[np.ndarray, np.ndarray]:
            each = zip(*(group.column(c).to_pylist() for c in (tiles, names, "classes")), strict=True)
            parts = [(unpacked(t), np.frombuffer(c, np.int64)[np.frombuffer(n, np.uint16)]) for t, n, c in each]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

        tile, name = joined("tiles", "names")
        order = np.argsort(tile)
        tile, name = tile[order], name[order]
        start = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]])) if len(tile) else np.zeros(0, np.int64)
        several = np.zeros(len(start), bool)
        if len(start):
            several = np.minimum.reduceat(name, start) != np.maximum.reduceat(name, start)
        keep = np.repeat(several, np.diff(np.append(start, len(tile))))
        near = joined("near_tiles", "near_names")
        tile, name = np.concatenate([tile[keep], near[0]]), np.concatenate([name[keep], near[1]])
        out = pa.table({"tile": pa.array(tile.view(np.int64)), "d1": pa.array(name)})
        trim()
        return out

    dealt = _texts(docs).mapInArrow(cut, "bucket int, tiles binary, names binary, near_tiles binary, near_names binary, classes binary")
    return dealt.groupBy("bucket").applyInArrow(meet, "tile long, d1 long").distinct()


def _arrays(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, shingles, bits): sorted sets and bitmaps of the documents named in ``ids(id)``; a doc_id that repeats gives each of its rows."""
    named = ids.withColumnRenamed("id", "doc_id")
    chosen = _texts(docs).join(broadcast_if_small(named), "doc_id", "left_semi")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, sets in _slices(batches, width, 200):
            columns = [pa.array(own, pa.int64()), *(pa.array([x.tobytes() for x in c], pa.binary()) for c in (sets, map(bitmap, sets)))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "shingles", "bits"])

    return chosen.mapInArrow(made, "id long, shingles binary, bits binary")


def _tried(pairs: DataFrame, arrays: DataFrame, num: int, den: int) -> DataFrame:
    """The linked ones of ``pairs(a, b)``."""
    left = arrays.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = arrays.select(F.col("id").alias("b"), F.col("shingles").alias("y"))

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                sets = [np.frombuffer(v.as_buffer(), _U) for v in (x, y)]
                keep.append(bool(links_between(sets, [0, 1], 1, num, den)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        trim()

    return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(tried, "a long, b long").distinct()


def _within_large(members: DataFrame, arrays: DataFrame, sizes: DataFrame, num: int, den: int) -> DataFrame:
    """Links between components in tiles of any size, ``members(tile, id, comp)``.

    Bitmaps are compared first, block by block; sets are only sent of members
    that may still link with another component.
    """
    sized = members.join(sizes, "id")
    blocks = sized.groupBy("tile").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("total"))
    blocks = blocks.select("tile", F.greatest(F.ceil(F.col("m") / BLOCK_MEMBERS), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    blocks = broadcast_if_small(materialize(blocks, "blocks"))  # else a large tile's members meet in one task
    dealt = sized.join(blocks, "tile").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.select("tile", "id", "comp", "n_shingles", "block", other.alias("other"))
    dealt = dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other").join(arrays.select("id", "bits"), "id")

    def bound(group: pa.Table) -> pa.Table:
        maps = folded([np.frombuffer(x, _U) for x in group.column("bits").to_pylist()])
        size, block = (group.column(c).to_numpy() for c in ("n_shingles", "block"))
        comp = np.unique(group.column("comp").to_numpy(), return_inverse=True)[1]
        one, live, every = group.column("i")[0] == group.column("j")[0], np.zeros(len(size), bool), np.arange(len(size))
        for i in every:
            js = hopeful(maps, size, i, np.flatnonzero((comp != comp[i]) & (every > i) & (one | (block != block[i]))), num, den)
            if len(js):
                live[i] = live[js] = True
        return group.select(["tile", "i", "j", "id", "comp"]).filter(pa.array(live))

    live = dealt.groupBy("tile", "i", "j").applyInArrow(bound, "tile long, i int, j int, id long, comp long")
    release(members.sparkSession)
    live = materialize(live.select(F.xxhash64("tile", "i", "j").alias("unit"), "id", "comp"), "live")
    summed = materialize(live.groupBy("unit").agg(*_members("id")), "live-units")
    unlike = broadcast_if_small(materialize(summed.groupBy(*MEMBERS).agg(F.min("unit").alias("unit")).select("unit"), "unlike-units"))

    def compare(group: pa.Table) -> pa.Table:
        sets, ids = [np.frombuffer(x, _U) for x in group.column("shingles").to_pylist()], group.column("id").to_numpy()
        found = np.array(links_between(sets, group.column("comp").to_pylist(), None, num, den), np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(ids[found[:, 0]], pa.int64()), "b": pa.array(ids[found[:, 1]], pa.int64())})

    # Units that share members form a cluster; where that is small, each of its sets is sent once.
    live = live.join(unlike, "unit")
    stars = live.join(summed.select("unit", "least"), "unit").where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b"))
    label = components(stars)
    clustered = live.join(label, "id").join(sizes, "id")
    own = clustered.select("label", "id", "comp", "n_shingles").distinct()
    small = own.groupBy("label").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("total")).where((F.col("m") <= 2 * BLOCK_MEMBERS) & (F.col("total") <= BLOCK_SHINGLES)).select("label")
    groups = own.join(small, "label").select(F.col("label").alias("unit"), "id", "comp")
    rest = clustered.join(small, "label", "left_anti").select("unit", "id", "comp")
    return groups.union(rest).join(arrays.select("id", "shingles"), "id").groupBy("unit").applyInArrow(compare, "a long, b long").distinct()


def _within_small(members: DataFrame, arrays: DataFrame, sizes: DataFrame, num: int, den: int) -> DataFrame:
    """Links between components in tiles of at most LARGE_TILE members: the distinct pairs, by size, then bitmap, then exactly."""
    cell = lambda x, y: F.struct(x["id"].alias("a"), y["id"].alias("b"))
    later = lambda x: F.filter("g", lambda y: (y["id"] > x["id"]) & (y["comp"] != x["comp"]))
    pairs = F.flatten(F.transform("g", lambda x: F.transform(later(x), lambda y: cell(x, y))))
    pairs = members.groupBy("tile").agg(F.collect_list(F.struct("id", "comp")).alias("g")).select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct()
    size = lambda n: sizes.select(F.col("id").alias(n), F.col("n_shingles").alias(f"n{n}"))
    near = (F.col("na") * num <= F.col("nb") * den) & (F.col("nb") * num <= F.col("na") * den)
    pairs = pairs.join(size("b"), "b").join(size("a"), "a").where(near)
    bits = lambda n: arrays.select(F.col("id").alias(n), F.col("bits").alias(f"m{n}"))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y, m, n in zip(*(batch.column(c).to_pylist() for c in ("ma", "mb", "na", "nb")), strict=True):
                maps = folded([np.frombuffer(x, _U), np.frombuffer(y, _U)])
                keep.append(len(hopeful(maps, np.array([m, n]), 0, np.array([1]), num, den)) > 0)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        trim()

    live = pairs.join(bits("b"), "b").join(bits("a"), "a").select("a", "b", "na", "nb", "ma", "mb").mapInArrow(bound, "a long, b long")
    live = materialize(live.distinct(), "live-pairs")
    release(members.sparkSession)
    return _tried(live, arrays, num, den)


def _within_tiles(members: DataFrame, arrays: DataFrame, sizes: DataFrame, num: int, den: int) -> DataFrame:
    """Links between components in tiles that span several."""
    large = broadcast_if_small(materialize(_large(members), "large"))
    few = _within_small(members.join(large, "tile", "left_anti"), arrays, sizes, num, den)
    many = members.join(large, "tile", "left_semi")
    return few if many.isEmpty() else few.union(_within_large(many, arrays, sizes, num, den)).distinct()


def link_components(docs: DataFrame, width: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id): components of the documents under links, for every row of ``docs``.

    Rows without doc_id, which no component can be named after, link with nothing
    and have no component.
    """
    bands = Bands(num, den)
    every = materialize(_named_sets(docs, width, bands), "sets")
    docs, sets = docs.where("doc_id is not null"), every.where("doc_id is not null")
    of_class = [F.min("doc_id").alias("id"), F.min("n_shingles").alias("n_shingles"), F.min("slack").alias("slack")]
    classes = materialize(sets.where("n_shingles > 0").groupBy("d1", "d2").agg(*of_class), "classes")
    tiles = _shared_tiles(docs, width, bands).join(classes.select("d1", "id"), "d1").select("tile", "id")
    tiles = materialize(tiles, "tiles")
    release(docs.sparkSession)
    needed = _needed(tiles, classes)
    summed = needed.groupBy("tile").agg(*_members("id")).where("m > 1")
    unlike = summed.groupBy(*MEMBERS).agg(F.min("tile").alias("tile")).select("tile", "least")  # of tiles with the same members one
    tiles = materialize(needed.join(broadcast_if_small(materialize(unlike, "unlike")), "tile"), "unlike-tiles")
    discard(needed)
    pairs = tiles.groupBy("id").agg(F.min("least").alias("b")).where("id <> b").select(F.col("id").alias("a"), "b")
    arrays = materialize(_arrays(docs, tiles.select("id").distinct(), width), "arrays")
    links = materialize(_tried(pairs, arrays, num, den), "links")
    release(docs.sparkSession)
    label = components(links)
    placed = materialize(tiles.join(label, "id", "left").select("tile", "id", F.coalesce("label", "id").alias("comp")), "placed")
    open_tiles = placed.groupBy("tile").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("tile")
    members = materialize(placed.join(broadcast_if_small(materialize(open_tiles, "open")), "tile"), "open-tiles")
    discard(tiles, placed)
    if not members.isEmpty():
        more = materialize(_within_tiles(members, arrays, classes.select("id", "n_shingles"), num, den), "more-links")
        if not more.isEmpty():
            label = components(links.union(more))
    discard(members, arrays, links)
    own = classes.join(label, "id", "left").select("d1", "d2", F.coalesce("label", "id").alias("component_id"))
    known = sets.where("n_shingles > 0").join(own, ["d1", "d2"]).select("doc_id", "n_shingles", "component_id")
    alone = every.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return known.unionByName(alone)


def one_of_each(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of each component: that with the smallest doc_id, null ids last.

    Rows are told apart by doc_id and text together, so rows that share a doc_id,
    or have none, are only dropped where their texts are equal or linked.
    """
    row, number, comp, place, first = unused(docs, "row", "n", "comp", "place", "first")
    key, plain = row_key(docs)
    keyed = docs.withColumn(row, key)
    found = materialize(link_components(keyed.select(F.col(row).alias("doc_id"), "text"), width, num, den), "near")
    rows = found.groupBy(F.col("doc_id").alias(row)).agg(F.count("*").alias(number), F.first("component_id").alias(comp))
    if plain:  # a component is named after the row that stays
        rows = materialize(rows, "rows")
        gone = materialize(rows.where(F.col(row) != F.col(comp)).select(row), "later")
    else:
        named = keyed.select(row, F.col("doc_id").cast("long").alias(place)).distinct()
        rows = materialize(rows.join(named, row).select(row, number, comp, F.struct(F.col(place).isNull().alias("none"), F.col(place).alias("id"), F.col(row).alias("row")).alias(place)), "rows")
        least = broadcast_if_small(materialize(rows.groupBy(comp).agg(F.min(place).alias(first)), "least"))
        gone = materialize(rows.join(least, comp).where(F.col(row) != F.col(first)["row"]).select(row), "later")
    kept = keyed.join(broadcast_if_small(gone), row, "left_anti")
    kept = kept if rows.where(F.col(number) > 1).isEmpty() else kept.dropDuplicates([row])
    return kept.select(docs.columns)
