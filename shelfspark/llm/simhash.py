"""Near-duplicates by SimHash fingerprints and BK-trees.

A fingerprint has one bit for each bit set in more than half of a text's shingle hashes. Equal fingerprints are one
node. Two nodes within the radius agree in at least one of ``radius + 1`` bands of bits, so nodes meet by band value. A
band with more nodes than a tree may hold is cut anew by sub-bands of the bits it leaves free (the same argument holds there); what is still too large becomes several shard
trees, each sent to all parts of its band's nodes. A BK-tree keys the children of a node by their integer distance to it, and a
search follows only edges within the radius of the query's distance. Each tree reports a spanning forest of
its links, not all pairs, and the forests are joined to components by star contraction in written tables.

Defined cases: a null text is empty; a text without words has fingerprint zero and links like any other; repeated rows stay repeated and share
their component; a component's id is its smallest doc_id, null only if all of its doc_ids are null; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from shelfspark.llm.common import fresh, pieces
from shelfspark.session import materialize

_SPACE = b" \t\n\r\x0b\x0c"
#: Nodes that one shard tree, and one part of its queries, may hold.
TREE_NODES = 4096


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a whole text; words are runs without ASCII white space, A-Z lower-cased, shingles counted as often as they occur."""
    counts, n, tail = np.zeros(64, dtype=np.int64), 0, []
    for piece in pieces((text or "").encode("utf-8", "surrogatepass").lower(), _SPACE):
        words = tail + piece.split()
        joined = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(seed)), dtype="<u8")
        if len(hashes):
            counts += _bit_counts(hashes)
            n += len(hashes)
            tail = words[-(shingle - 1):] if shingle > 1 else []
        else:
            tail = words
    if not n and tail:
        n, counts = 1, _bit_counts(np.array([xxhash.xxh64_intdigest(b" ".join(tail), seed)], dtype="<u8"))
    bits = np.packbits(2 * counts > n, bitorder="little")
    return int(bits.view("<u8")[0])


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit set, lowest bit first."""
    total = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 1 << 16):
        block = hashes[start:start + (1 << 16)].view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return total


def fingerprints(documents: DataFrame, shingle: int = 3, seed: int = 42, column: str = "fingerprint") -> DataFrame:
    """``documents`` with its fingerprints as signed 64-bit integers."""
    text = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle, seed) for t in batch.column(text)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.view(np.int64))], names=[*batch.schema.names, column])

    return documents.mapInArrow(run, StructType([*documents.schema.fields, StructField(column, LongType(), False)]))


class BKTree:
    """Metric tree over 64-bit integers under the Hamming distance."""

    def __init__(self) -> None:
        self.root: tuple[int, dict] | None = None

    def add(self, key: int) -> None:
        if self.root is None:
            self.root = (key, {})
            return
        node = self.root
        while distance := (node[0] ^ key).bit_count():
            if (child := node[1].get(distance)) is None:
                node[1][distance] = (key, {})
                return
            node = child

    def within(self, key: int, radius: int) -> Iterator[int]:
        stack = [self.root] if self.root else []
        while stack:
            at, children = stack.pop()
            distance = (at ^ key).bit_count()
            if distance <= radius:
                yield at
            if children:
                if len(children) <= 2 * radius + 1:
                    stack.extend(child for edge, child in children.items() if -radius <= edge - distance <= radius)
                else:
                    stack.extend(children[edge] for edge in range(max(1, distance - radius), distance + radius + 1) if edge in children)


def _forest(members: list[int], queries: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """Links that span the components which the searches of one tree find."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    tree = BKTree()
    for member in members:
        tree.add(member)
    for query in queries:
        for found in tree.within(query, radius):
            if found != query and (a := root(query)) != (b := root(found)):
                parent[max(a, b)] = min(a, b)
                yield query, found


def _bands(first: int, width: int, n: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of ``n`` bands over ``width`` bits from ``first``."""
    edges = [first + width * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _band_value(column: str, low: int, width: int):
    return F.shiftrightunsigned(F.col(column), low).bitwiseAND(F.lit((1 << width) - 1))


def _search_rows(nodes: DataFrame, radius: int, tree_nodes: int) -> DataFrame:
    """(group key, is_query, node): what each shard tree holds and what it is asked.

    ``nodes`` has distinct fingerprints in column ``node``.
    """
    bands = _bands(0, 64, radius + 1)
    banded = nodes.select("node", F.explode(F.array(*[
        F.struct(F.lit(k).alias("band"), _band_value("node", *band).alias("value")) for k, band in enumerate(bands)])).alias("b"))
    banded = banded.select("node", "b.*", F.lit(-1).alias("sub"), F.lit(0).cast("bigint").alias("subvalue"))
    keys = ["band", "value", "sub", "subvalue"]

    def counted(df: DataFrame) -> DataFrame:
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        return df.join(sizes, keys)

    first = counted(banded)
    plain, crowded = first.filter(F.col("n") <= tree_nodes), first.filter(F.col("n") > tree_nodes)
    again = []
    for k, (low, width) in enumerate(bands):
        left = _bands(0, 64 - width, radius + 1)
        # The bits outside the band, closed up.
        rest = F.shiftleft(F.shiftrightunsigned("node", low + width), low) if low + width < 64 else F.lit(0).cast("bigint")
        rest = rest.bitwiseOR(_band_value("node", 0, low)) if low else rest
        again.append((k, rest, left))
    subs = F.lit(None)
    for k, rest, left in again:
        entry = F.array(*[F.struct(F.lit(j).alias("s"), F.shiftrightunsigned(rest, a).bitwiseAND(F.lit((1 << w) - 1)).alias("v"))
                          for j, (a, w) in enumerate(left)])
        subs = F.when(F.col("band") == k, entry).otherwise(subs)
    finer = counted(crowded.select("node", "band", "value", F.explode(subs).alias("e"))
                    .select("node", "band", "value", F.col("e.s").alias("sub"), F.col("e.v").alias("subvalue")))
    met = plain.unionByName(finer).withColumn("shards", F.ceil(F.col("n") / tree_nodes).cast("int"))
    own = F.pmod(F.xxhash64("node"), F.col("shards")).cast("int")
    every = F.sequence(F.lit(0), F.col("shards") - 1)
    # A member lies in its own shard and goes to every part of the queries; a query lies in its own part and goes to every shard.
    rows = met.select(*keys, "node", F.explode(F.array(
        F.struct(F.lit(False).alias("asks"), every.alias("others")), F.struct(F.lit(True).alias("asks"), every.alias("others")))).alias("r"), own.alias("own"))
    rows = rows.select(*keys, "node", "own", "r.asks", F.explode("r.others").alias("other"))
    return rows.select(
        F.xxhash64(*keys).alias("spread"), *keys, F.when(F.col("asks"), F.col("other")).otherwise(F.col("own")).alias("shard"),
        F.when(F.col("asks"), F.col("own")).otherwise(F.col("other")).alias("part"), "asks", "node")


def links(nodes: DataFrame, radius: int = 2, tree_nodes: int = TREE_NODES) -> DataFrame:
    """Links (a, b) between fingerprints at ``radius`` or fewer differing bits that connect all that such links connect."""
    keys = ["spread", "band", "value", "sub", "subvalue", "shard", "part"]
    rows = _search_rows(nodes, radius, tree_nodes)
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "asks", "node")
    at = {c: rows.columns.index(c) for c in rows.columns}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(at[c]).to_pylist() for c in [*keys, "asks", "node"]), strict=True)

        out: list[tuple[int, int]] = []
        for _, group in groupby(each(), key=lambda r: r[:len(keys)]):
            members, queries = [], []
            for row in group:
                (queries if row[-2] else members).append(row[-1] & 0xFFFFFFFFFFFFFFFF)
            out.extend(_forest(members, queries, radius))
            if len(out) > 50_000:
                yield _pairs(out)
                out = []
        yield _pairs(out)

    return rows.mapInArrow(run, "a long, b long")


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b); root is the smallest node of its component.

    Star contraction: in turn each node's larger neighbours, and each node's smaller neighbours, are tied to the least
    node of its neighbourhood. Each step is a written table; it ends when a step changes nothing.
    """
    current = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    before = _checksum(current)
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("n")).agg(F.least("n", F.min("b")).alias("m"))
        large = both.filter("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        small = large.join(lower, F.col("a") == F.col("n")).select(F.explode(F.array(
            F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        current = materialize(small.select("e.a", "e.b").filter("a <> b").distinct(), "links")
        after = _checksum(current)
        if after == before:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after


def _checksum(edges: DataFrame) -> tuple:
    """Equal for equal edge sets; unequal ones agree by chance only, at 128 bits of hash."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def _placed(marked: DataFrame, radius: int, tree_nodes: int) -> DataFrame:
    """(_fp, root, component_id) of each distinct fingerprint of ``marked`` (doc_id, _fp)."""
    nodes = materialize(marked.groupBy(F.col("_fp").alias("node")).agg(F.min("doc_id").alias("first_id")), "nodes")
    roots = components(links(nodes.select("node"), radius, tree_nodes))
    linked = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    placed = nodes.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return placed.join(ids, "root").select(F.col("node").alias("_fp"), "root", "component_id")


def near_duplicates(documents: DataFrame, *, shingle: int = 3, radius: int = 2, seed: int = 42,
                    tree_nodes: int = TREE_NODES) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``documents`` (doc_id, text)."""
    marked = _marked(documents, shingle, seed)
    return marked.join(_placed(marked, radius, tree_nodes), "_fp").select(
        "doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def _marked(documents: DataFrame, shingle: int, seed: int) -> DataFrame:
    marked = fingerprints(documents.select("doc_id", "text"), shingle, seed, "_fp").select("doc_id", "_fp")
    return materialize(marked, "fingerprints")


def keep_one(documents: DataFrame, *, shingle: int = 3, radius: int = 2, seed: int = 42, tree_nodes: int = TREE_NODES) -> DataFrame:
    """One document of each component stays, whole and with its columns: the one whose doc_id is the component's id.

    Of several rows of a component with that doc_id, the first in the order of all columns stays; so does one of a component without any doc_id.
    """
    own, fp, root, component = (fresh(documents, name) for name in ("_own", "_fp", "_root", "_component"))
    marked = _marked(documents, shingle, seed)
    placed = materialize(_placed(marked, radius, tree_nodes), "placed")
    ids = marked.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("_fp").alias("_fp"))
    once = ids.filter("n = 1").join(placed, "_fp").filter("doc_id = component_id").select(F.col("doc_id").alias(own))
    kept = documents.join(once, F.col("doc_id") == F.col(own), "left_semi")
    repeated = ids.filter("n > 1").select(F.col("doc_id").alias(own))
    if marked.filter("doc_id IS NULL").isEmpty() and repeated.isEmpty():
        return kept
    # Ids that do not name one row: those rows are told apart by their fingerprints.
    unclear = documents.filter("doc_id IS NULL").unionByName(documents.join(repeated, F.col("doc_id") == F.col(own), "left_semi"))
    key = placed.select(F.col("_fp").alias(own), F.col("root").alias(root), F.col("component_id").alias(component))
    chosen = fingerprints(unclear, shingle, seed, fp).join(key, F.col(fp) == F.col(own)).filter(F.col("doc_id").eqNullSafe(F.col(component)))
    row = F.struct(*documents.columns).alias("row")
    first = chosen.select(row, F.col(root).alias("root"), F.col(component).alias("component")).groupBy("root", "component").agg(F.min("row").alias("row"))
    return kept.unionByName(first.select("row.*"))
