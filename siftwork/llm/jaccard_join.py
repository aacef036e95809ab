"""Exact Jaccard join of word-shingle sets by PartEnum signatures.

A size band is for pairs whose smaller set has a size in its range; a set signs in each band in which it may be the
smaller or the larger one. Sets of a band whose similarity reaches the threshold differ in at most k elements, k
following from the band's sizes. The domain of shingles is partitioned by hash into first-level parts, and each of
these into N2 cells. At most k // 2 first-level parts can hold two differences or more, so in the others the sets
agree on all cells but one at most: the enumerated subsets of N2 - 1 cells contain one that is equal in both sets, and
its content's hash is a shared signature.

Signatures over less than LIGHT elements are shared by chance. There are a SLACK-th more first-level parts than needed,
so m of them agree, not just one. Light signatures are left out: if one of two linked sets has less than m parts with a
light subset, one of the m agreeing parts is heavy in it, and both sign that. Sets with m such parts or more sign once
more by a partition of another seed, so two of them meet there; after TURNS turns, what is left signs all.

Sets of a band that share a signature are put in one family, so a family holds whole components of its band. Near
copies share most signatures; so sets that agree on the whole content of their first part are one node from the start,
and sign once a batch. A task pairs PARTS parts of the signatures one after the other and returns one forest of links,
so a node has a link a task at most, and never more of them than signatures.
Signatures travel packed, and equal sets travel once a task.

A family also holds sets that are not linked, and it grows faster than the corpus; so texts are not compared all with all.
A set has a sketch: a bit for each of at least SKETCH_BITS buckets a shingle, set if an odd number of its shingles fall
there. No more bits of two sketches differ than shingles of the sets, so pairs whose sketches differ more than the
threshold allows are not linked. Of the pairs that are left, a forest is verified exactly over texts, each lead's links
as a star, so a text travels about twice however large its family is. Pairs that are left between the components of what
was verified, few as sketches are sharp, make smaller families. These are verified by counting common shingles through an
inverted index, in blocks of BLOCK shingles at most; a family of more is dealt, in order of size, as pairs of blocks
whose sizes allow links. The links found in all bands give the components.

Defined results: null texts and texts without words have an empty set and are linked with nothing; texts of fewer
words than a shingle are one shingle of all words; very long texts are sets like others; a similarity just at the
threshold links; a null doc_id never is a component's id unless all in it are null;
repeated rows give a row each; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bucket, hot_join, materialize, small_batches, text_of, trim
from .components import components
from .shingles import M1, M2, mix, shingle_sets

N2, LIGHT, SLACK = 3, 1, 8
#: Signatures in a part, parts in a task, and shingles in a block, about.
PART, PARTS, BLOCK = 1_000_000, 8, 400_000
SEEN = 500_000
#: Bits of a sketch a shingle, at least, and in all, at most; shingles whose sketches are in a block, a set counting for so many at least; links of a lead that are verified together.
SKETCH_BITS, MOST_BITS = 2, 1 << 17
SKETCHED, LEAST_OF_SET, STAR = 12_000_000, 400, 256
NODE = np.uint64((1 << 48) - 1)
BAND_RATIO = 1.25
TURNS = 5


class Bands:
    """Bands of set sizes for the threshold num / den; their signatures.

    Band b is for pairs whose smaller size is from starts[b] to starts[b + 1] - 1; the larger one is up to den / num of that.
    """

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.starts = [1]

    def bands(self, size: int) -> list[int]:
        """Those in which a set of this size may be the smaller (the last) or the larger one."""
        while self.starts[-1] <= size:
            self.starts.append(max(self.starts[-1] + 1, int(self.starts[-1] * BAND_RATIO)))
        own = int(np.searchsorted(self.starts, size, "right")) - 1
        first = own
        while first and self.largest(first - 1) >= size:
            first -= 1
        return list(range(first, own + 1))

    def largest(self, band: int) -> int:
        return (self.starts[band + 1] - 1) * self.den // self.num

    def shape(self, band: int) -> tuple[int, int, int]:
        """First-level parts, cells of each, and how many of the parts agree at least."""
        k = (self.starts[band + 1] - 1 + self.largest(band)) * (self.den - self.num) // (self.den + self.num)
        if k == 0:
            return 1, 1, 1
        needed = k // 2 + 1
        parts = needed + 1 + needed // SLACK
        return parts, N2, parts - k // 2

    def _cells(self, hashes: np.ndarray, parts: int, cells: int, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the elements of a turn, their cells and their parts."""
        h = mix(hashes + np.uint64((turn + 1) * int(M2) & (1 << 64) - 1))
        part = ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        cell = ((h & np.uint64(0xFFFFFFFF)) * np.uint64(cells)) >> np.uint64(32)
        return h, cell.astype(np.int64), part.astype(np.int64)

    def nodes(self, hashes: np.ndarray, key: int) -> np.ndarray:
        """Its node in each of the set's bands. Sets that agree on the whole first part share its signatures, so they are of one family."""
        own = self.bands(len(hashes))
        nodes = band_nodes(key, own)
        for i, band in enumerate(own):
            parts, cells, _ = self.shape(band)
            h, cell, part = self._cells(hashes, parts, cells, 0)
            first = part == 0
            counts = np.bincount(cell[first], minlength=cells)
            if cells == 1 or (counts.sum() - counts >= LIGHT).all():
                nodes[i] = (mix(mix(h[first]).sum(keepdims=True) * M2 + mix(np.array([band << 32], np.uint64))) & NODE)[0]
        return nodes

    def signatures(self, hashes: np.ndarray) -> list[np.ndarray]:
        """Those of each of the set's bands."""
        out = []
        for band in self.bands(len(hashes)):
            parts, cells, agree = self.shape(band)
            signed, keys = [], np.arange(parts * cells, dtype=np.uint64) + np.uint64(band << 32)
            for turn in range(TURNS if cells > 1 else 1):
                h, cell, part = self._cells(hashes, parts, cells, turn)
                at = part * cells + cell
                sums = np.zeros(parts * cells, np.uint64)
                np.add.at(sums, at, mix(h))
                sums = sums.reshape(parts, cells)
                counts = np.bincount(at, minlength=parts * cells).reshape(parts, cells)
                if cells > 1:
                    sums = sums.sum(1, keepdims=True) - sums
                    counts = counts.sum(1, keepdims=True) - counts
                made = mix(sums.ravel() * M1 + mix(keys * np.uint64(TURNS) + np.uint64(turn)))
                light = counts < LIGHT
                few = cells == 1 or light.any(1).sum() < agree
                signed.append(made if cells == 1 or not few and turn == TURNS - 1 else made[~light.ravel()])
                if few:
                    break
            out.append(np.concatenate(signed))
        return out


def band_nodes(key: int, bands: list[int]) -> np.ndarray:
    """A set's number in each of its bands: families do not reach from one band to another."""
    return mix(np.uint64(key) ^ mix(np.array(bands, np.uint64) + M2)) & NODE


def set_keys(sets: list[np.ndarray]) -> np.ndarray:
    """128 bits of each set as two columns of 64."""
    return np.array([(mix(s).sum(), mix(s + M1).sum() + np.uint64(len(s))) for s in sets], np.uint64).reshape(len(sets), 2)


def _pack(sig: np.ndarray, node: np.ndarray) -> bytes:
    """40 bits of each signature and 48 of each node."""
    return b"".join(x.tobytes() for x in (sig.astype(np.uint32), (sig >> np.uint64(32)).astype(np.uint8), node.astype(np.uint32), (node >> np.uint64(32)).astype(np.uint16)))


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(blob) // 11
    sig = np.frombuffer(blob, np.uint32, n).astype(np.uint64) | np.frombuffer(blob, np.uint8, n, 4 * n).astype(np.uint64) << np.uint64(32)
    node = np.frombuffer(blob, np.uint32, n, 5 * n).astype(np.uint64) | np.frombuffer(blob, np.uint16, n, 9 * n).astype(np.uint64) << np.uint64(32)
    return sig, node


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each node to the least one that the given links reach."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = p
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    nodes = np.array(list(parent), np.uint64)
    return nodes, np.array([find(x) for x in nodes.tolist()], np.uint64)


def _linked(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    first = np.concatenate([[True], sig[1:] != sig[:-1]]) if len(sig) else np.zeros(0, bool)
    pivot = node[np.maximum.accumulate(np.where(first, np.arange(len(sig)), 0))] if len(sig) else node
    other = node != pivot
    return _roots(node[other], pivot[other])


def _sign(width: int, num: int, den: int, parts: int):
    """Batches of texts -> rows (part, blob): the distinct pairs of signature and node of some batches, dealt by signature."""

    def packed(sigs, nodes):
        sig, node = np.concatenate(sigs), np.concatenate(nodes)
        order = np.lexsort((node, sig))
        sig, node = sig[order], node[order]
        new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])])
        sig, node = sig[new], node[new]
        part = (((sig >> np.uint64(40)) * np.uint64(parts)) >> np.uint64(24)).astype(np.int64)
        cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        blobs = [_pack(sig[i:j], node[i:j]) for i, j in zip(cuts, np.append(cuts[1:], len(part)))]
        return pa.RecordBatch.from_arrays([pa.array(part[cuts].astype(np.int32)), pa.array(blobs, pa.binary())], ["part", "blob"])

    def run(batches):
        bands, seen = Bands(num, den), set()
        sigs, nodes, n = [], [], 0
        for b in batches:
            sets = [s for s in shingle_sets(b.column("text"), width) if len(s)]
            for s, (key, _) in zip(sets, set_keys(sets).tolist()):
                if key not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(key)
                    for some, node in zip(bands.signatures(s), bands.nodes(s, key)):
                        sigs.append(some)
                        nodes.append(np.full(len(some), node, np.uint64))
                        n += len(some)
            if n >= PART:
                yield packed(sigs, nodes)
                sigs, nodes, n = [], [], 0
                trim()
        if n:
            yield packed(sigs, nodes)
        trim()

    return run


def _pair_up(batches):
    """Rows (part, blob), sorted by part, all of a part in one task -> links (a, b): a forest over the task's parts."""
    forest: dict[int, int] = {}
    now, held, size = None, [], 0

    def find(x: int) -> int:
        while (p := forest.setdefault(x, x)) != x:
            forest[x] = forest[p]
            x = p
        return x

    def paired():
        a, b = _linked(*_joined(held))
        away = a != b
        for x, y in zip(a[away].tolist(), b[away].tolist()):
            x, y = find(x), find(y)
            if x != y:
                forest[max(x, y)] = min(x, y)

    for b in batches:
        for part, blob in zip(b.column("part").to_pylist(), b.column("blob").to_pylist()):
            if part != now and held:
                paired()
                held, size = [], 0
                trim()
            now = part
            held.append(blob)
            size += len(blob) // 11
            if size > 8 * PART:  # equal pairs of many tasks: once is enough
                pairs = np.unique(np.stack(_joined(held), 1), axis=0)
                held, size = [_pack(pairs[:, 0], pairs[:, 1])], -len(pairs)
    if held:
        paired()
    nodes = np.array(list(forest), np.uint64)
    roots = np.array([find(x) for x in nodes.tolist()], np.uint64)
    away = nodes != roots
    yield pa.RecordBatch.from_arrays([pa.array(nodes[away].astype(np.int64)), pa.array(roots[away].astype(np.int64))], ["a", "b"])
    trim()


def _joined(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    pairs = [_unpack(x) for x in blobs]
    return np.concatenate([s for s, _ in pairs]), np.concatenate([n for _, n in pairs])


def links_in_block(sets: list[np.ndarray], side: np.ndarray, num: int, den: int) -> np.ndarray:
    """The root (an index) of each set, by links of similarity num / den or more; side: sets of one side only are not compared if there are two."""
    m = len(sets)
    parent = np.arange(m)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = int(parent[x])
        return x

    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(m), sizes)
    element = np.concatenate(sets)
    order = np.argsort(element, kind="stable")
    element, posted = element[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], element[1:] != element[:-1]]))
    length = np.diff(np.append(first, len(element)))
    group = np.empty(len(element), np.int64)
    group[order] = np.repeat(np.arange(len(first)), length)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    two, left = bool((side != side[0]).any()), m
    for x in range(m - 1):
        if left == 1:
            break
        mine = group[starts[x] : starts[x + 1]]
        mine = mine[length[mine] > 1]
        if not len(mine):
            continue
        n = length[mine]
        at = np.repeat(first[mine] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        common = np.bincount(posted[at], minlength=m)
        linked = den * common >= num * (sizes[x] + sizes - common)
        linked[: x + 1] = False
        if two:
            linked &= side != side[x]
        for y in np.flatnonzero(linked).tolist():
            a, b = find(x), find(y)
            if a != b:
                parent[max(a, b)] = min(a, b)
                left -= 1
    return np.array([find(x) for x in range(m)])


def sketch(hashes: np.ndarray) -> bytes:
    """Which of a power of two buckets hold an odd number of a set's elements."""
    bits = min(MOST_BITS, max(64, 1 << (SKETCH_BITS * len(hashes) - 1).bit_length()))
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def near_in_block(sizes: np.ndarray, sketches: list[bytes], side: np.ndarray, known: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """A forest (pairs of indices) of the pairs of different known that by their sketches may have similarity num / den; side as in links_in_block()."""
    m, words = len(sketches), min(map(len, sketches)) // 8
    table = np.empty((m, words), np.uint64)
    for k, x in enumerate(sketches):
        row = np.frombuffer(x, np.uint64)
        while len(row) > words:  # half as many buckets
            row = row[: len(row) // 2] ^ row[len(row) // 2 :]
        table[k] = row
    # what differs in some words already tells most pairs apart
    some, others = np.ascontiguousarray(table[:, : -(-words // 3)]), np.ascontiguousarray(table[:, -(-words // 3) :])
    most = lambda x, ys: (sizes[x] + sizes[ys]) * (den - num) // (den + num)
    two, root, out = bool((side != side[0]).any()), np.arange(m), []
    for x in range(m - 1):
        open_ = (root[x + 1 :] != root[x]) & (known[x + 1 :] != known[x])
        if two:
            open_ &= side[x + 1 :] != side[x]
        ys = np.flatnonzero(open_) + x + 1
        if not len(ys):
            continue
        apart = np.bitwise_count((some[x + 1 :] if len(ys) == m - x - 1 else some[ys]) ^ some[x]).sum(1, dtype=np.int64)
        left = apart <= most(x, ys)
        ys, apart = ys[left], apart[left]
        apart = apart + np.bitwise_count(others[ys] ^ others[x]).sum(1, dtype=np.int64)
        left = apart <= most(x, ys)
        ys, apart = ys[left], apart[left]
        if len(ys):
            ys = ys[np.argsort(apart, kind="stable")]
            roots, first = np.unique(root[ys], return_index=True)
            out += [(x, y) for y in ys[np.sort(first)].tolist()]
            root[np.isin(root, roots)] = root[x]
    return out


def _near(num: int, den: int):
    """Rows (family, i, j, chunk, node, known, n_shingles, sketch), sorted by (family, i, j, node) -> (lead, part, node): a forest of pairs of each block that may be linked; of a lead, STAR have one part."""

    def found(rows):
        chunk, node, known, sizes, sketches = zip(*rows)
        pairs = near_in_block(np.array(sizes), list(sketches), np.array(chunk), np.array(known), num, den)
        stars: dict[int, int] = {}
        for x, y in pairs:
            stars[x] = stars.get(x, 0) + 1
            yield node[x], (stars[x] - 1) // STAR, node[y]

    def links(out):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64()))], ["lead", "part", "node"])

    def run(batches):
        now, rows = None, []
        for b in batches:
            out = []
            cols = [b.column(c).to_pylist() for c in ("family", "i", "j", "chunk", "node", "known", "n_shingles", "sketch")]
            for r in zip(*cols):
                if r[:3] != now:
                    if len(rows) > 1:
                        out += found(rows)
                    now, rows = r[:3], []
                if not rows or rows[-1][1] != r[4]:
                    rows.append(r[3:])
            if out:
                yield links(out)
        if len(rows) > 1 and (out := list(found(rows))):
            yield links(out)
        trim()

    return run


def _verify_stars(width: int, num: int, den: int):
    """Rows (lead, part, own, node, key, text), sorted by (lead, part) with the lead's own first -> (node, root): links to the lead that hold."""

    def run(batches):
        now, mine = None, None
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("lead", "part", "own", "node", "key")]
            some, out = shingle_sets(b.column("text"), width), []
            for lead, part, own, node, want, s, key in zip(*cols, some, set_keys(some)):
                if key.tobytes() != want:
                    continue  # another text under the same id
                if own:
                    now, mine = (lead, part), s
                elif now == (lead, part):
                    common = len(np.intersect1d(mine, s, assume_unique=True))
                    if den * common >= num * (len(mine) + len(s) - common):
                        out.append((node, lead))
            if out:
                yield _links(out)
        trim()

    return run


def _verify(width: int, num: int, den: int):
    """Rows (family, i, j, chunk, node, key, text), sorted by (family, i, j, node) -> (node, root): links that hold."""

    def found(rows, sets):
        keys = [r[4] for r in rows]
        order = sorted(range(len(rows)), key=keys.__getitem__)
        root = links_in_block([sets[k] for k in order], np.array([rows[k][3] for k in order]), num, den)
        return [(keys[k], keys[order[r]]) for k, r in zip(order, root.tolist()) if order[r] != k]

    def run(batches):
        now, rows, sets = None, [], []
        for b in batches:
            texts = b.column("text")
            cols = [b.column(c).to_pylist() for c in ("family", "i", "j", "chunk", "node")]
            wanted = b.column("key").to_pylist()
            some = shingle_sets(texts, width)
            out = []
            for r, s, key, want in zip(zip(*cols), some, set_keys(some), wanted):
                if key.tobytes() != want:
                    continue  # another text under the same id
                if r[:3] != now:
                    if len(rows) > 1:
                        out += found(rows, sets)
                    now, rows, sets = r[:3], [], []
                if not any(r[4] == x[4] for x in rows[-1:]):
                    rows.append(r)
                    sets.append(s)
            if out:
                yield _links(out)
        if len(rows) > 1 and (out := found(rows, sets)):
            yield _links(out)

    return run


def _links(rows) -> pa.RecordBatch:
    node, root = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(root, pa.int64())], ["node", "root"])


def _sized(width: int, num: int, den: int):
    """Batches of texts -> a row each."""

    def run(batches):
        bands, seen = Bands(num, den), {}
        for b in batches:
            sets = shingle_sets(b.column("text"), width)
            keys = set_keys(sets)
            shorts = []
            for s, key in zip(sets, keys[:, 0].tolist()):
                known = seen.get(key) if len(s) else np.zeros(0, np.int64)
                if known is None:
                    if len(seen) >= SEEN:
                        seen.clear()
                    known = seen[key] = bands.nodes(s, key).astype(np.int64)
                shorts.append(known)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    b.column("tag"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([k.tobytes() for k in keys], pa.binary()),
                    pa.array(keys[:, 0].astype(np.int64)),
                    pa.array(shorts, pa.list_(pa.int64())),
                    pa.array([sketch(s) if len(s) else None for s in sets], pa.binary()),
                ],
                ["doc_id", "tag", "n_shingles", "key", "node", "shorts", "sketch"],
            )
        seen.clear()
        trim()

    return run


def links_of(texts: DataFrame, signatures: int, width: int, num: int, den: int) -> DataFrame:
    """Links (a, b) between the nodes of texts that share a signature; signatures: about how many there are."""
    parts = max(1, -(-signatures // PART))
    tasks = -(-parts // PARTS)
    signed = texts.select("text").mapInArrow(_sign(width, num, den, parts), "part int, blob binary")
    dealt = signed.repartitionById(tasks, (F.col("part").cast("long") * tasks / parts).cast("int")).sortWithinPartitions("part")
    return dealt.mapInArrow(_pair_up, "a long, b long")


def _in_blocks(members: DataFrame, weight: Column, block: int, num: int, den: int) -> DataFrame:
    """members (written: family, node, n_shingles, ...) of families of two or more, with chunk, i and j: a row for each pair (i, j) of blocks that a set's chunk is in.

    Blocks of a family follow its sizes: sums of the weights of smaller sizes tell a set's block, of block or about.
    """
    by_size = members.groupBy("family", "n_shingles").agg(F.sum(weight).alias("_sum"), F.count(F.lit(1)).alias("_sets"))
    of_family = Window.partitionBy("family")
    before = F.coalesce(F.sum("_sum").over(of_family.orderBy("n_shingles").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by_size = by_size.withColumn("_before", before).withColumn("_last", F.sum("_sum").over(of_family)).withColumn("_of", F.sum("_sets").over(of_family)).filter("_of > 1")
    # the sets of one size are spread over the blocks that their sum reaches into
    first, spread = F.floor(F.col("_before") / block).cast("int"), F.greatest(F.lit(1), F.ceil(F.col("_sum") / block)).cast("int")
    by_size = by_size.select("family", "n_shingles", first.alias("_first"), spread.alias("_spread"), (F.col("_last") <= block).alias("_whole"))
    chunk = F.when(F.col("_whole"), 0).otherwise(F.col("_first") + F.pmod(F.hash("node"), F.col("_spread"))).alias("chunk")
    dealt = members.join(by_size, ["family", "n_shingles"]).select(*members.columns, chunk)
    ranges = dealt.groupBy("family", "chunk").agg(F.min("n_shingles").alias("_low"), F.max("n_shingles").alias("_high"))
    other = ranges.select("family", F.col("chunk").alias("other"), F.col("_low").alias("_low2"), F.col("_high").alias("_high2"))
    reach = (F.col("other") >= F.col("chunk")) & (F.col("_high") * den >= F.col("_low2") * num) & (F.col("_high2") * den >= F.col("_low") * num)
    blocks = ranges.join(other, "family").filter(reach).select("family", F.col("chunk").alias("i"), F.col("other").alias("j"))
    mine = blocks.select("family", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("chunk"))
    return dealt.join(mine, ["family", "chunk"])


def _may_link(members: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """lead, part, node: a forest of the pairs of one family, but of different known, that sketches leave; written."""
    dealt = _in_blocks(members, F.greatest("n_shingles", F.lit(LEAST_OF_SET)), SKETCHED, num, den).select("family", "i", "j", "chunk", "node", "known", "n_shingles")
    # what is made of a written table may be far larger than Spark expects of it, so none is broadcast
    rows = dealt.hint("merge").join(sets.select("node", "sketch"), "node")
    rows = rows.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "node")
    return materialize(rows.mapInArrow(_near(num, den), "lead long, part int, node long"))


def _with_texts(wanted: DataFrame, tagged: DataFrame) -> DataFrame:
    """wanted (written: rep, rep_tag, ...), each with its text instead."""
    wanted = wanted.withColumnRenamed("rep", "_rep")
    near = by_bucket(tagged, F.col("tag"), wanted, F.col("rep_tag"))
    return wanted.hint("merge").join(near, (F.col("rep_tag") == F.col("tag")) & F.col("_rep").eqNullSafe(F.col("doc_id"))).drop("_rep", "doc_id", "tag", "rep_tag")


def _verified(members: DataFrame, sets: DataFrame, tagged: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Links (node, root) that hold, and whose components are those of all that hold, of the sets (rows of sets) that share a family (members: node, n_shingles, family)."""
    of_set = sets.select("node", "key", "n_shingles", "rep", "rep_tag")
    stars = _may_link(members.withColumn("known", F.col("node")), sets, num, den)
    ends = stars.select("lead", "part", F.lit(True).alias("own"), F.col("lead").alias("node")).distinct().unionByName(stars.select("lead", "part", F.lit(False).alias("own"), "node"))
    rows = _with_texts(materialize(ends.hint("merge").join(of_set.drop("n_shingles"), "node")), tagged)
    rows = rows.repartition("lead", "part").sortWithinPartitions("lead", "part", F.desc("own"))
    links = materialize(rows.mapInArrow(_verify_stars(width, num, den), "node long, root long"))
    # what is left between components of these links: of the sets that may have a link at all
    known = components(links.select(F.col("node").alias("a"), F.col("root").alias("b"))).select("node", F.col("root").alias("known"))
    some = materialize(ends.select("node").distinct().hint("merge").join(known, "node", "left").select("node", F.coalesce("known", "node").alias("known")))
    left = _may_link(materialize(members.join(some.hint("merge"), "node")), sets, num, den)
    if left.isEmpty():
        return links
    family = components(left.select(F.col("lead").alias("a"), F.col("node").alias("b"))).select("node", F.col("root").alias("family"))
    dealt = _in_blocks(materialize(of_set.join(family.hint("merge"), "node")), F.col("n_shingles"), BLOCK, num, den)
    rows = _with_texts(materialize(dealt.select("family", "i", "j", "chunk", "node", "key", "rep", "rep_tag")), tagged)
    rows = rows.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "node")
    return materialize(links.unionByName(rows.mapInArrow(_verify(width, num, den), "node long, root long")))


def jaccard_groups(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """doc_id, tag (a hash of the text), n_shingles, component_id, group (the component's own number) for each row of docs (doc_id, text); empty sets are in no group."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    tagged = texts.select("doc_id", F.xxhash64("text").alias("tag"), "text")
    sized = materialize(tagged.mapInArrow(_sized(width, num, den), "doc_id long, tag long, n_shingles long, key binary, node long, shorts array<long>, sketch binary"))
    total, shingles = sized.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    edges = links_of(texts, 5 * shingles * (den - num) // den, width, num, den)
    family = components(edges).select(F.col("node").alias("short"), F.col("root").alias("family"))
    sets = sized.filter("n_shingles > 0").groupBy("key", "node", "n_shingles").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tag")).alias("_least"), F.first("shorts").alias("shorts"), F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("rows")
    )
    sets = materialize(sets.withColumn("rep", F.col("_least.doc_id")).withColumn("rep_tag", F.col("_least.tag")).drop("_least"))
    members = sets.select("node", "n_shingles", F.explode("shorts").alias("short")).join(family, "short", "left")
    members = materialize(members.withColumn("family", F.coalesce("family", "short")).drop("short"))
    links = _verified(members, sets, tagged, width, num, den)
    roots = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    rooted = materialize(sets.select("node", "rep").join(roots, "node"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("least"))
    named = sets.select("key", "node", "rep", "rows").join(rooted.select("node", "root").distinct().join(least, "root"), "node", "left")
    named = named.select("key", F.coalesce("least", "rep").alias("component_id"), F.coalesce("root", "node").alias("group"), "rows")
    out = ("doc_id", "tag", "n_shingles", "component_id", "group")
    some = hot_join(sized.filter("n_shingles > 0"), named, "key", "rows", total).select(*out)
    alone = sized.filter("n_shingles = 0").withColumn("component_id", F.col("doc_id")).withColumn("group", F.lit(None).cast("long"))
    return some.unionByName(alone.select(*out))


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Links of 0.9 or more between sets of three-word shingles."""
    return jaccard_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 90, 100).select("doc_id", "n_shingles", "component_id")


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS h FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT DISTINCT a, a AS b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS least FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.least, d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = d.doc_id
"""
