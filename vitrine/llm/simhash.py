"""SimHash near-duplicates through BK-trees over shards of the fingerprints.

Fingerprints (64 bits; a bit is set if over half of the shingle hashes set it)
are first reduced to the distinct ones. Two of them at most ``radius`` bits
apart agree in at least one of ``radius + 1`` blocks of bits, so each goes to
one shard per block; a link can't be lost between shards. A shard of at most
``tree_size`` fingerprints becomes a BK-tree (children keyed by their integer
Hamming distance to the parent), and a search follows only the edges whose
distance is within the radius of the query's own. Larger shards are split
again: their fingerprints agree in a block, so the remaining bits are cut into
blocks once more. What is still too large after the last level is cut into
tiles: each tile's bounded tree is sent to the tiles of that shard, which
search it. Within a shard only the links of a spanning forest leave the task.

Defined results: a null, empty or blank text has fingerprint zero and is
linked like any other; repeated rows share a fingerprint; ids may repeat, also
with different texts, which are linked only if their fingerprints are; a null
id takes part in no minimum, so a group of null ids only has a null component;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import stash, texts
from vitrine.llm.components import components

BITS, SEED, CHUNK = 64, 42, 1 << 15
TREE_SIZE, LEVELS = 256, 4


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned fingerprint of a whole text; long texts are summed in chunks."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    n = max(1, len(w) - shingle + 1)
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, dtype=np.int64)
    for a in range(0, n, CHUNK):
        b = min(n, a + CHUNK)
        if shingle == 3 and len(w) >= 3:
            h = [digest(b"%b %b %b" % x, SEED) for x in zip(w[a:b], w[a + 1 : b + 1], w[a + 2 : b + 2])]
        else:
            h = [digest(b" ".join(w[i : i + shingle]), SEED) for i in range(a, b)]
        bits = np.unpackbits(np.array(h, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.int32)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; ``fp`` holds the 64 bits as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "fp": fp})

    rows = texts(docs).select(F.col("doc_id").cast("long"), "text")
    return rows.mapInPandas(run, "doc_id long, fp long")


class BKTree:
    """Values by Hamming distance: ``kids[i][d]`` is the child at distance d."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.kids: list[dict[int, int]] = []

    def search(self, x: int, radius: int) -> list[int]:
        """Places of the values within the radius of ``x``."""
        found, todo = [], [0] if self.values else []
        while todo:
            i = todo.pop()
            d = (self.values[i] ^ x).bit_count()
            if d <= radius:
                found.append(i)
            kids = self.kids[i]
            if kids:
                for k in range(max(0, d - radius), d + radius + 1):
                    if k in kids:
                        todo.append(kids[k])
        return found

    def add(self, x: int) -> None:
        self.values.append(x)
        self.kids.append({})
        me = len(self.values) - 1
        i = 0
        while me:
            d = (self.values[i] ^ x).bit_count()
            if d not in self.kids[i]:
                self.kids[i][d] = me
                return
            i = self.kids[i][d]


def _forest(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the values at most ``radius`` bits apart."""
    if len(values) == 2:
        return [(0, 1)] if (values[0] ^ values[1]).bit_count() <= radius else []
    tree, root, links = BKTree(), list(range(len(values))), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, x in enumerate(values):
        for j in tree.search(x, radius):
            a, b = find(i), find(j)
            if a != b:
                root[a] = b
                links.append((i, j))
        tree.add(x)
    return links


def _cut(bits: list[int], parts: int) -> list[list[int]]:
    return [[int(b) for b in x] for x in np.array_split(bits, parts)]


def _block(fp, bits: list[int]):
    """The given bits of a fingerprint as a column of longs."""
    mask = sum(1 << b for b in bits)
    mask -= (1 << 64) if mask >> 63 else 0
    return fp.bitwiseAND(F.lit(mask).cast("long"))


def _tree_links(shards: DataFrame, radius: int) -> DataFrame:
    """Links within shards, whose rows stand together after a sort."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, ([], [])
        out: tuple[list[int], list[int]] = ([], [])

        def close() -> None:
            ids, fps = held
            for i, j in _forest(fps, radius) if len(fps) > 1 else ():
                out[0].append(ids[i])
                out[1].append(ids[j])

        for b in batches:
            fps = b["fp"].to_numpy().view(np.uint64).tolist()
            for k, n, f in zip(zip(b["level"], b["part"], b["shard"]), b["node"].tolist(), fps):
                if k != key:
                    close()
                    key, held = k, ([], [])
                held[0].append(n)
                held[1].append(f)
            yield pd.DataFrame({"u": pd.Series(out[0], dtype="int64"), "v": pd.Series(out[1], dtype="int64")})
            out = ([], [])
        close()
        yield pd.DataFrame({"u": pd.Series(out[0], dtype="int64"), "v": pd.Series(out[1], dtype="int64")})

    near = shards.repartition("level", "part", "shard").sortWithinPartitions("level", "part", "shard", "node")
    return near.mapInPandas(run, "u long, v long")


def _tile_links(shards: DataFrame, counts: DataFrame, radius: int, size: int) -> DataFrame:
    """Links of shards above the tree size: tile by tile, each tile's tree
    searched with the tiles after it (and itself) of the same shard."""
    key = ["level", "part", "shard"]
    tiled = shards.join(counts, key).select(*key, F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") * 2 / size)).alias("tile"), "node", "fp")
    tiles = tiled.groupBy(*key, "tile").agg(F.sort_array(F.collect_list(F.struct("node", "fp"))).alias("rows"))
    tree, asks = tiles.withColumnsRenamed({"rows": "tree", "tile": "t"}), tiles.withColumnsRenamed({"rows": "asks", "tile": "q"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = ([], [])
            for own, tree_rows, ask_rows in zip(b["q"] == b["t"], b["tree"], b["asks"]):
                a = [(r["node"], r["fp"] & (2**64 - 1)) for r in tree_rows]
                c = [] if own else [(r["node"], r["fp"] & (2**64 - 1)) for r in ask_rows]
                all_rows = a + c
                for i, j in _forest([x[1] for x in all_rows], radius):
                    out[0].append(all_rows[i][0])
                    out[1].append(all_rows[j][0])
            yield pd.DataFrame({"u": pd.Series(out[0], dtype="int64"), "v": pd.Series(out[1], dtype="int64")})

    return tree.join(asks, key).where("t <= q").select("q", "t", "tree", "asks").mapInPandas(run, "u long, v long")


def links(nodes: DataFrame, radius: int = 3, tree_size: int = TREE_SIZE, levels: int = LEVELS) -> DataFrame:
    """(u, v): links that connect whatever distinct fingerprints at most
    ``radius`` bits apart connect. ``nodes`` has (node, fp), fp distinct."""
    key = ["level", "part", "shard"]
    blocks = _cut(list(range(BITS)), radius + 1)
    fp = F.col("fp")
    # part: which blocks agree, as a path of block numbers; shard: their bits
    now = nodes.select("node", "fp", F.explode(F.array(*[F.struct(F.lit(str(i)).alias("part"), _block(fp, b).alias("shard")) for i, b in enumerate(blocks)])).alias("s"))
    now = now.select(F.lit(0).alias("level"), "s.part", "s.shard", "node", "fp")
    agreed = {str(i): b for i, b in enumerate(blocks)}
    found = []
    for level in range(levels):
        counts = now.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
        sized = stash(counts, "simhash-sizes")
        large = sized.where(F.col("n") > tree_size)
        found.append(now.join(large, key, "left_anti") if level or not large.isEmpty() else now)
        if large.isEmpty():
            break
        now = stash(now.join(large.select(*key), key, "left_semi"), "simhash-large")
        if level == levels - 1:
            return _settle(found, radius, _tile_links(now, large, radius, tree_size))
        deeper, choices = {}, F.lit(None)
        for path, bits in agreed.items():
            rest = [b for b in range(BITS) if b not in set(bits)]
            cuts = _cut(rest, radius + 1)
            deeper |= {f"{path}.{i}": bits + c for i, c in enumerate(cuts)}
            subs = F.array(*[F.struct(F.lit(f"{path}.{i}").alias("part"), _block(fp, bits + c).alias("shard")) for i, c in enumerate(cuts)])
            choices = F.when(F.col("part") == path, subs).otherwise(choices)
        now = now.select("node", "fp", F.explode(choices).alias("s")).select(F.lit(level + 1).alias("level"), "s.part", "s.shard", "node", "fp")
        agreed = deeper
    return _settle(found, radius, None)


def _settle(found: list[DataFrame], radius: int, more: DataFrame | None) -> DataFrame:
    out = more
    for f in found:
        e = _tree_links(f, radius)
        out = e if out is None else out.unionByName(e)
    return out


def _groups(fps: DataFrame, radius: int, tree_size: int) -> DataFrame:
    """(fp, least_id, component) of every distinct fingerprint; the component
    is its smallest fingerprint."""
    nodes = stash(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-nodes")
    joined = components(links(nodes.select(F.col("fp").alias("node"), "fp"), radius, tree_size))
    return nodes.join(joined, nodes["fp"] == joined["node"], "left").select("fp", "least_id", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, tree_size: int = TREE_SIZE) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    fps = stash(fingerprints(docs, shingle), "simhash-fp")
    placed = _groups(fps, radius, tree_size)
    groups = placed.groupBy("component").agg(F.min("least_id").alias("component_id"))
    by_fp = placed.join(groups, "component").select("fp", "component_id")
    out = fps.join(by_fp, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, radius: int = 3, tree_size: int = TREE_SIZE) -> DataFrame:
    """One row of ``docs`` per group: that of the smallest id (a null id comes
    last), then of the smallest fingerprint. Rows are told apart by id and
    fingerprint: ids found once by the id alone; the few rows whose id repeats
    or is null are fingerprinted again where they stand."""
    fps = stash(fingerprints(docs, shingle), "simhash-fp")
    best = _groups(fps, radius, tree_size).groupBy("component").agg(
        F.min(F.struct(F.col("least_id").isNull().alias("none"), F.col("least_id").alias("id"), "fp")).alias("b"))
    kept = stash(best.select(F.col("b.id").alias("_id"), F.col("b.fp").alias("_fp")), "simhash-kept")
    again = stash(fps.groupBy("doc_id").count().where((F.col("count") > 1) | F.col("doc_id").isNull()).select(F.col("doc_id").alias("_id")), "simhash-repeated")
    own = F.col("doc_id").cast("long")
    alone = kept.where(F.col("_id").isNotNull()).join(again, "_id", "left_anti").select("_id")
    first = docs.join(alone, own == F.col("_id"), "left_semi")
    if again.isEmpty():
        return first
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), own.alias("_own"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    marked = marked.where(F.col("_own").isNull()).unionByName(marked.join(again.where("_id is not null"), F.col("_own") == F.col("_id"), "left_semi"))
    print_of = F.pandas_udf(lambda texts: pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64)), "long")
    marked = marked.withColumn("_print", print_of("_text")).drop("_text").dropDuplicates(["_own", "_print"])
    chosen = marked.join(kept, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_print") == F.col("_fp")), "left_semi")
    return first.unionByName(chosen.select("_row.*"))
