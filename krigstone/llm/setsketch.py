"""Near-duplicate classes from SetSketch registers.

Words are runs of anything but white space, after A-Z become a-z.  A document's set holds its
distinct shingles of five words (with fewer words, all of them as one).  Sets are compared as
sorted 64-bit hashes of shingles.

1. Register i of a sketch is floor(1 - log_b m) of the least m among exponentially spaced hash
   values of the set, clipped to 16 bits; the sketch of a union is the register-wise maximum.
2. Documents with one and the same set form a class, represented by its smallest doc_id.
3. Bands of five registers are hashed.  In each bucket of a band key, a hub is compared with all
   members: the member that shares most buckets with others, which in a group of near copies is the
   common original.  A member whose distance (one minus similarity) to its hub is at most CLOSE is
   done in the bucket, as every link it has must be to members within NEAR of the hub (step 4).
   Where other members of several components are left, their registers are compared in blocks of
   bounded size, and only pairs whose estimate allows a link go on to step 5.  Linked sets differ in size
   by a factor of 0.85 at most, so blocks hold sets of one size class, and meet those of the same class
   and of the next.  Buckets of more than CROWD of them are dealt anew before that, by rare elements: of two
   linked sets, in any order of all elements, the first 15 % and one element of either have one in common.
   In order of frequency, rarest first, pages of one template with contents of their own part there.
4. Links among the members near a hub are found from their differences to it.  Of two linked sets,
   one of them not linked to the hub, the differences share more than about half of either's elements.
   Elements that differ for one member only, or within one component only, can't count; who is left
   with too few is done, and of the others the rarest elements meet the rest.  So a large group of
   copies with edits of their own makes no pairs.
5. The joint likelihood of the registers estimates a candidate pair's similarity; pairs far (SLACK
   standard errors) from being near are taken as far; only the others' texts are sent, and they are
   decided on both whole sets.
6. Components of the confirmed links spread the smallest doc_id by joins, with pointer jumping.

With 24 bands, a pair at similarity 0.85 is missed as a candidate with probability 1e-6.

Defined results: a null, empty or blank text has an empty set, links with nothing and is its own
component; repeated rows of a doc_id are one node of the graph, with the links of all their texts,
and each returned; a null doc_id links with nothing, has a null component and is not kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions, slices, texts, unused

SHINGLE = 5
BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
BASE, SCALE = 1.001, 20.0
THRESHOLD = (85, 100)  # 100 * intersection >= 85 * union
#: Distances to a hub: up to CLOSE a member leaves the bucket, and links of members up to NEAR are found
#: from differences.  NEAR is CLOSE and the greatest distance of a link, which is a metric, together.
CLOSE, NEAR = 0.2, 0.35
SLACK = 6.0
#: Members of a bucket that are compared in one place with as many others.
BLOCK = 512
#: Members left in a bucket from which on it is dealt anew by rare elements.
CROWD = 2048
#: Blocks that meet in one group on average.
GROUP = 8
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_rng = np.random.Generator(np.random.PCG64(20240229))
_MUL_A, _MUL_B = (_rng.integers(1, 1 << 32, REGISTERS, dtype=np.uint32) | np.uint32(1) for _ in range(2))
_ADD = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)
_POWERS = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    import xxhash

    # bytes.lower changes A-Z only; bytes.split separates at \x20 and \x09-\x0D only
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 1)], np.uint64)
    n = len(words) - SHINGLE + 1
    total = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        total += each[k : k + n] * _POWERS[k]
    return np.unique(_mix(total))


def registers(elements: np.ndarray) -> np.ndarray:
    """The sketch of a set that is not empty."""
    low, high = elements.astype(np.uint32), (elements >> np.uint64(32)).astype(np.uint32)
    most = np.zeros(REGISTERS, np.uint32)
    for start in range(0, len(elements), 4096):
        a, b = low[start : start + 4096], high[start : start + 4096]
        x = a[None, :] * _MUL_A[:, None]
        x += b[None, :] * _MUL_B[:, None] + _ADD[:, None]
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x7FEB352D)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x846CA68B)
        x ^= x >> np.uint32(16)
        np.maximum(most, x.max(axis=1), out=most)
    # the greatest uniform value has the least exponential one
    least = -np.log((most.astype(np.float64) + 0.5) / 2.0**32) / SCALE
    return np.clip(np.floor(1 - np.log(least) / np.log(BASE)), 0, 65535).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sketched sets."""
    return np.maximum(a, b)


def band_keys(sketch: np.ndarray) -> list[int]:
    import xxhash

    rows = sketch.reshape(BANDS, ROWS)
    return [xxhash.xxh3_64_intdigest(rows[k].tobytes(), k) - (1 << 63) for k in range(BANDS)]


_GRID = np.linspace(0.005, 0.995, 199)


def estimate(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> tuple[float, float]:
    """Similarity of two sketched sets of known sizes, and its standard error.

    With base b near 1, the numbers of registers that are greater in one, greater in the other or
    equal are multinomial with probabilities (n_a - i)/u, (n_b - i)/u, i/u for an intersection i and
    a union u = n_a + n_b - i; the estimate is the similarity i/u of the greatest joint likelihood.
    """
    more, less = int((a > b).sum()), int((a < b).sum())
    equal = len(a) - more - less
    i = _GRID * (n_a + n_b) / (1 + _GRID)
    u = n_a + n_b - i
    log = lambda p: np.log(np.maximum(p, 1e-9))
    j = float(_GRID[np.argmax(more * log((n_a - i) / u) + less * log((n_b - i) / u) + equal * np.log(_GRID))])
    return j, float(np.sqrt(max(j * (1 - j), 0.02) / len(a)))


def linked(both: int, n_x: int, n_y: int) -> bool:
    return THRESHOLD[1] * both >= THRESHOLD[0] * (n_x + n_y - both)


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest of the set, band keys, registers (the last three null for an empty set)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("registers", pa.binary())])

    def run(batches):
        import hashlib

        for batch in slices(batches):
            n, digests, bands, sketches = [], [], [], []
            for text in batch.column(1).to_pylist():
                found = shingle_set(text)
                n.append(len(found))
                own = registers(found) if len(found) else None
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                bands.append(None if own is None else band_keys(own))
                sketches.append(None if own is None else own.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], schema=schema)

    return texts(docs).mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands array<long>, registers binary")


def _with_texts(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """pairs(a, b, ...) with text_a and text_b.  own: rep, text.

    a, which may be the hub of many pairs, comes last: its text meets the pairs where they are, in a join
    that adaptive execution splits if a is hot."""
    joined = pairs.join(own.withColumnRenamed("rep", "b").withColumnRenamed("text", "text_b"), "b")
    return joined.join(own.withColumnRenamed("rep", "a").withColumnRenamed("text", "text_a"), "a")


def _open_pairs(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Those pairs(a, b) whose registers leave it open whether the sets are within NEAR of each other."""
    each = lambda side: sketches.select(F.col("rep").alias(side), F.col("n_set").alias(f"n_{side}"), F.col("registers").alias(f"registers_{side}"))
    joined = pairs.select("a", "b").join(each("b"), "b").join(each("a"), "a")

    def run(batches):
        for batch in slices(batches):
            keep = []
            for n_a, n_b, x, y in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                j, error = estimate(np.frombuffer(x, np.uint16), np.frombuffer(y, np.uint16), n_a, n_b)
                keep.append(j + SLACK * error >= 1 - NEAR)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.select("a", "b", "n_a", "n_b", "registers_a", "registers_b").mapInArrow(run, "a long, b long")


class _Known:
    """Sets of the texts that a task has met last."""

    def __init__(self):
        self.last: dict[str, np.ndarray] = {}
        self.held = 0  # elements, at most 2**17 besides the last set

    def __call__(self, text: str) -> np.ndarray:
        if text not in self.last:
            if self.held > 1 << 17:
                self.last.clear()
                self.held = 0
            self.last[text] = shingle_set(text)
            self.held += len(self.last[text])
        return self.last[text]


def _compare(pairs: DataFrame, own: DataFrame, sketches: DataFrame) -> DataFrame:
    """a, b, linked, near (within NEAR) and close (within CLOSE) for each pair; far pairs are left out."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_()), ("near", pa.bool_()), ("close", pa.bool_())])

    def run(batches):
        known = _Known()
        for batch in slices(batches):
            out = []
            for s, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = known(s), known(t)
                both = len(np.intersect1d(x, y, assume_unique=True))
                distance = 1 - both / (len(x) + len(y) - both)
                out.append((linked(both, len(x), len(y)), distance <= NEAR, distance <= CLOSE))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([o[i] for o in out], pa.bool_()) for i in range(3))], schema=schema)

    still = _open_pairs(pairs, sketches)
    return _with_texts(still, own).select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, linked boolean, near boolean, close boolean")


def _differences(stars: DataFrame, own: DataFrame) -> DataFrame:
    """hub, rep, comp, unlinked, m (size of the symmetric difference), gain (how much larger the
    member is), size (the member's), elements of the difference; for stars(a: hub, b: rep, comp, unlinked)."""
    schema = pa.schema([("hub", pa.int64()), ("rep", pa.int64()), ("comp", pa.int64()), ("unlinked", pa.bool_()), ("m", pa.int64()), ("gain", pa.int64()), ("size", pa.int64()), ("elements", pa.list_(pa.int64()))])

    def run(batches):
        known = _Known()
        for batch in slices(batches):
            m, gain, size, lists = [], [], [], []
            for s, t in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                x, y = known(s), known(t)
                found = np.setxor1d(x, y, assume_unique=True)
                m.append(len(found))
                gain.append(len(y) - len(x))
                size.append(len(y))
                lists.append(found.view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(m, pa.int64()), pa.array(gain, pa.int64()), pa.array(size, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], schema=schema)

    return _with_texts(stars, own).select("a", "b", "comp", "unlinked", "text_a", "text_b").mapInArrow(
        run, "hub long, rep long, comp long, unlinked boolean, m long, gain long, size long, elements array<long>")


def _near_pairs(stars: DataFrame, own: DataFrame) -> DataFrame:
    """Pairs (a, b) of members of a star, of different components, that may be linked.

    Two sets of sizes p and q are linked if their difference has at most t (p + q) elements, with
    t = (100 - 85) / (100 + 85).  So with u not linked to the hub, the differences m_u and m_v to the
    hub overlap in more than (m_v - t gain_v) / 2 elements.
    """
    less, more = THRESHOLD[1] - THRESHOLD[0], THRESHOLD[1] + THRESHOLD[0]
    found = materialize(_differences(stars, own))
    each = found.select("hub", "rep", "comp", F.explode("elements").alias("e"))
    counted = materialize(each.groupBy("hub", "e").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("hub", "e", "n"))
    shared = materialize(found.select("hub", "rep", "comp", "unlinked", "m", "gain", "size", F.explode("elements").alias("e")).join(counted, ["hub", "e"]))
    need = F.floor((more * F.col("m") - less * F.col("gain")) / (2 * more)).cast("int")
    # a member's list is at most its difference
    strong = (
        shared.groupBy("hub", "rep", "comp", "m", "gain", "size").agg(F.sort_array(F.collect_list(F.struct("n", "e"))).alias("l"))
        .withColumn("more", F.size("l") - F.greatest(need, F.lit(0))).where("more > 0")
        .select("hub", "rep", "comp", "m", "size", F.explode(F.slice("l", F.lit(1), F.col("more"))).alias("x"))
        .select(F.col("hub").alias("hub_v"), F.col("x.e").alias("e_v"), F.col("rep").alias("v"), F.col("comp").alias("comp_v"), F.col("m").alias("m_v"), F.col("size").alias("size_v"))
    )
    strong = materialize(strong)
    # the sizes, and how far both are from the hub, bound the similarity as well
    apart = F.greatest(F.abs(F.col("m") - F.col("m_v")), F.abs(F.col("size") - F.col("size_v")))
    may = (F.col("rep") != F.col("v")) & (F.col("comp") != F.col("comp_v")) & (more * apart <= less * (F.col("size") + F.col("size_v")))
    met = shared.where("unlinked").select("hub", "e", "rep", "comp", "m", "size").join(strong, (F.col("hub") == F.col("hub_v")) & (F.col("e") == F.col("e_v")) & may)
    return met.select(F.least("rep", "v").alias("a"), F.greatest("rep", "v").alias("b")).distinct()


def _bins(rows: int, parts: int) -> int:
    """Groups that so many rows of blocks are dealt into."""
    return max(8 * parts, -(-rows // (GROUP * BLOCK)))


def _block_pairs(left: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs (a, b) of members left in a bucket whose registers allow a link.

    left: band, rep, comp, near (to the bucket's hub).  Pairs of one component, and those of two
    members near the hub, are settled.  A bucket is cut into blocks of about BLOCK members, each pair
    of blocks is compared in one place, and many small pairs share a group.  There are as many groups as
    keep each at about GROUP blocks, however large a bucket is.
    """
    limit = THRESHOLD[0] / THRESHOLD[1]
    # sizes of linked sets lie in one class or in two that adjoin
    kind = F.floor(F.log(F.col("n_set").cast("double")) / F.lit(-float(np.log(limit))) + F.lit(1e-9)).cast("long")
    placed = materialize(left.join(sketches.select("rep", "n_set"), "rep").withColumn("kind", kind))
    sizes = placed.groupBy("band", "kind").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK))
    above = sizes.select("band", (F.col("kind") - 1).alias("kind"), F.col("n").alias("n_above"), F.col("blocks").alias("above"))
    below = sizes.select("band", (F.col("kind") + 1).alias("kind"), F.col("blocks").alias("below"))
    sizes = sizes.join(above, ["band", "kind"], "left").join(below, ["band", "kind"], "left").fillna(0, ["n_above", "above", "below"])
    sizes = materialize(sizes)
    total = sizes.agg(F.sum(F.col("n") * (F.col("blocks") + F.col("above") + F.col("below")))).first()[0] or 0
    bins = _bins(total, partitions(left.sparkSession))
    rows = placed.join(sizes.select("band", "kind", "blocks", "above", "below"), ["band", "kind"])
    rows = rows.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    # where a block meets another: the classes and numbers of both, the lower class first
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    cell = lambda k1, b1, k2, b2: F.struct(k1.alias("k1"), b1.alias("b1"), k2.alias("k2"), b2.alias("b2"))
    k, own_block = F.col("kind"), F.col("own")
    cells = F.concat(
        F.transform(upto(F.col("blocks")), lambda o: cell(k, F.least(own_block, o), k, F.greatest(own_block, o))),
        F.transform(upto(F.col("above")), lambda o: cell(k, own_block, k + 1, o)),
        F.transform(upto(F.col("below")), lambda o: cell(k - 1, o, k, own_block)),
    )
    rows = rows.withColumn("cell", F.explode(cells)).join(sketches.select("rep", "registers"), "rep")
    first = (F.col("cell.k1") == k) & (F.col("cell.b1") == own_block)
    rows = rows.select(F.xxhash64("band", "cell").alias("key"), first.alias("first"), (F.struct(F.col("cell.k1"), F.col("cell.b1")) == F.struct(F.col("cell.k2"), F.col("cell.b2"))).alias("same"), "rep", "comp", "near", "n_set", "registers")
    rows = rows.withColumn("bin", F.pmod("key", F.lit(bins)))

    def run(table: pa.Table) -> pa.Table:
        key = table.column("key").to_numpy()
        order = np.argsort(key, kind="stable")
        key = key[order]
        rep, comp, size, lower, same, near = (table.column(c).to_numpy()[order] for c in ("rep", "comp", "n_set", "first", "same", "near"))
        sketch_ = np.frombuffer(b"".join(table.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)[order]
        cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        first, second = [], []
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            for i in range(start, end):
                if not lower[i]:
                    continue
                # within one block every pair once; else this block's members against the other's
                j = np.arange(i + 1, end) if same[i] else start + np.flatnonzero(~lower[start:end])
                j = j[(comp[j] != comp[i]) & ~(near[j] & near[i]) & (np.minimum(size[j], size[i]) >= limit * np.maximum(size[j], size[i]))]
                if len(j):
                    share = (sketch_[j] == sketch_[i]).mean(axis=1)
                    j = j[share + SLACK * np.sqrt(np.maximum(share * (1 - share), 0.02) / REGISTERS) >= limit]
                    first.append(np.full(len(j), rep[i]))
                    second.append(rep[j])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (first, second))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return rows.groupBy("bin").applyInArrow(run, "a long, b long").distinct()


def _by_rare_elements(left: DataFrame, own: DataFrame) -> DataFrame:
    """left (band, rep, comp, near) of crowded buckets, with elements of the sets in place of bands: each
    member has a row for every element of its prefix that another member's prefix has as well.

    No pair is settled by a common hub here, as a new bucket's members may come from several old ones.
    """
    members = materialize(left.groupBy("rep").agg(F.first("comp").alias("comp")))

    def run(batches):
        for batch in slices(batches):
            lists = [shingle_set(t).view(np.int64) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(lists, pa.list_(pa.int64())), batch.column(3)], ["rep", "comp", "elements", "which"])

    sets = members.join(own, "rep").select("rep", "comp", "text", F.xxhash64("text").alias("which"))
    sets = sets.mapInArrow(run, "rep long, comp long, elements array<long>, which long")
    sets = materialize(sets)
    each = sets.select("rep", "which", "comp", F.size("elements").alias("n_set"), F.explode("elements").alias("e"))
    often = materialize(each.groupBy("e").agg(F.count("*").alias("n")))
    # at most a set's elements in a list
    placed = each.join(often, "e").groupBy("rep", "which", "comp", "n_set").agg(F.sort_array(F.collect_list(F.struct("n", "e"))).alias("l"))
    more, whole = THRESHOLD
    prefix = F.col("n_set") - F.ceil(F.col("n_set") * more / whole).cast("int") + 1
    kept = placed.select("rep", "comp", F.explode(F.slice("l", F.lit(1), prefix)).alias("x")).where("x.n > 1").select(F.col("x.e").alias("band"), "rep", "comp").distinct()
    kept = materialize(kept)
    shared = kept.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("band")
    return materialize(kept.join(shared, "band").select("band", "rep", "comp", F.lit(False).alias("near")))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """rep and its component, the least rep that it reaches over edges(a, b).

    Only nodes with edges take part in the rounds.  Each round takes the least component among a
    node and its neighbours, then the component of that component, until nothing changes.
    """
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).withColumnRenamed("a", "rep"))
    while True:
        near = both.join(label.withColumnRenamed("rep", "b"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        step = materialize(label.join(near.withColumnRenamed("a", "rep"), "rep").select("rep", F.col("comp").alias("old"), F.least("comp", "near").alias("comp")))
        jump = step.select(F.col("rep").alias("comp"), F.col("comp").alias("next"))
        moved = materialize(step.join(jump, "comp").select("rep", "old", F.col("next").alias("comp")))
        label = moved.select("rep", "comp")
        if not moved.where("comp < old").limit(1).count():
            break
    return nodes.select("rep").join(label, "rep", "left").select("rep", F.coalesce("comp", "rep").alias("comp"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    sketched = materialize(sketch(docs))
    classes = materialize(
        sketched.where("digest is not null and doc_id is not null").groupBy("digest")
        .agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("registers").alias("registers"), F.first("n_shingles").alias("n_set"))
    )
    banded = classes.select("rep", F.explode("bands").alias("band"))
    sizes = materialize(banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"))
    members = materialize(banded.join(sizes, "band").select("band", "rep", "n"))
    popular = members.groupBy("rep").agg(F.sum("n").alias("popular"))
    members = materialize(members.select("band", "rep").distinct().join(popular, "rep"))
    nodes = members.select("rep").distinct()
    # the texts of members only; a doc_id has several rows here if its texts differ.  Both sides are sorted, at
    # any size: members grow with the documents, and none of their sides need fit in memory
    own = materialize(
        texts(docs).join(nodes.withColumnRenamed("rep", "doc_id").hint("merge"), "doc_id", "left_semi")
        .groupBy(F.col("doc_id").alias("rep"), F.xxhash64("text").alias("which")).agg(F.first("text").alias("text")).drop("which")
    )
    sketches = classes.select("rep", "n_set", "registers")
    comps = None
    hubs = members.groupBy("band").agg(F.max(F.struct("popular", (-F.col("rep")).alias("least"))).alias("top")).select("band", (-F.col("top.least")).alias("a"))
    met = materialize(members.select("band", F.col("rep").alias("b")).join(materialize(hubs), "band").where("a != b"))
    if met.limit(1).count():
        compared = materialize(_compare(met.select("a", "b").distinct(), own, sketches))
        comps = materialize(components(nodes, compared.where("linked")))
        # links among the members near a hub
        star = compared.where("near").join(comps.select(F.col("rep").alias("b"), "comp"), "b").join(comps.select(F.col("rep").alias("a"), F.col("comp").alias("hub_comp")), "a")
        star = materialize(star.select("a", "b", "comp", (~F.col("linked")).alias("unlinked"), (F.col("comp") != F.col("hub_comp")).alias("apart")))
        open_hubs = star.groupBy("a").agg(F.max("apart").alias("apart"), F.count("*").alias("n")).where("apart and n > 1").select("a")
        more = _near_pairs(materialize(star.join(materialize(open_hubs), "a").select("a", "b", "comp", "unlinked")), own)
        # links among the others of a bucket
        left = met.join(compared.select("a", "b", "near", "close"), ["a", "b"], "left").where("close is null or not close")
        left = left.select("band", F.col("b").alias("rep"), F.coalesce("near", F.lit(False)).alias("near")).join(comps, "rep")
        left = materialize(left)
        open_bands = left.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("band", "n")
        left = materialize(left.join(materialize(open_bands), "band"))
        crowded = left.where(F.col("n") > CROWD)
        left = left.where(F.col("n") <= CROWD).drop("n")
        if crowded.limit(1).count():
            left = materialize(left.unionByName(_by_rare_elements(crowded, own)))
        more = more.unionByName(_block_pairs(left, sketches)).distinct()
        found = materialize(_compare(materialize(more), own, sketches).where("linked"))
        if found.limit(1).count():
            comps = materialize(components(nodes, compared.where("linked").unionByName(found)))
    placed = classes.select("digest", "rep")
    if comps is not None:
        placed = placed.join(comps, "rep", "left").select("digest", F.coalesce("comp", "rep").alias("comp"))
    else:
        placed = placed.select("digest", F.col("rep").alias("comp"))
    placed = materialize(placed)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return sketched.join(placed, "digest", "left").select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is their component's, in the columns of docs.

    Rows with a null doc_id are linked with nothing and all stay.  Of rows that repeat a kept doc_id one
    stays for each set of shingles, so exact copies go and other texts under the id are not lost.
    """
    kept = materialize(near_duplicates(docs).where("kept").groupBy("doc_id").agg(F.count("*").alias("n")))
    out = docs.join(kept.where("n = 1").select("doc_id"), "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))
    again = kept.where("n > 1").select("doc_id")
    if again.limit(1).count():
        out = out.unionByName(_one_a_set(docs.join(again, "doc_id", "left_semi")).select(*docs.columns))
    return out.select(*docs.columns)


def _one_a_set(docs: DataFrame) -> DataFrame:
    """One row of docs, the least as JSON, for each doc_id and set."""
    row, digest = unused(docs, "row"), unused(docs, "digest")
    held = docs.select("doc_id", "text", F.struct(*docs.columns).alias(row))

    def run(batches):
        import hashlib

        for batch in slices(batches):
            digests = [hashlib.blake2b(shingle_set(t).tobytes(), digest_size=16).digest() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(digests, pa.binary())], ["doc_id", row, digest])

    schema = held.select("doc_id", row).withColumn(digest, F.lit(None).cast("binary")).schema
    found = held.mapInArrow(run, schema).groupBy("doc_id", digest).agg(F.min_by(F.col(row), F.to_json(row)).alias(row))
    return found.select(f"{row}.*")
