"""Near-duplicate documents by min-max hashing.

A document's set is its distinct shingles of five words, lower-cased A-Z. Under
each permutation both the smallest and the largest hash are kept, so PERMUTATIONS
hash evaluations give twice as many signature values; two values of two
permutations each make a band.

1. Equal sets are one class, held by its smallest doc_id.
2. Every class is held against the first class of its buckets (bands in common) that
   agrees best with it in eight bits of each signature value, and the link is confirmed
   on full sets rebuilt from the texts. Each text is sent once for that, and a group of
   copies of any size becomes one component, or one and some stragglers.
3. Buckets that still hold more than one component are searched whole: classes of
   different components that agree in AGREE values or more become candidates, and
   candidates that hang together become clusters. In each cluster, pairs of different
   components are confirmed on full sets. Large buckets and clusters are cut into chunks
   that are taken two by two, chunks of the largest component only with others, so
   nothing is capped and n copies with k stragglers are n + k * n / chunk rows. Where more
   classes than a chunk are outside the largest component, as in pages of one template that
   are not alike enough, nothing is taken two by two: only classes that share one of their
   rarest shingles meet, and any two at the threshold do (``prefixes``).
   A pair over the threshold misses all bands with a probability of about
   (1 - 0.85**4)**16 < 1e-5.
4. Confirmed links give the components.

Shingles are 64-bit hashes of their words' hashes; a class is the SHA-256 of its
shingles (of the words themselves where it has one shingle only, as two such sets that
differ are never linked).

Defined results: null, empty and blank texts have no set and are linked with
nothing (component_id is their doc_id); rows without doc_id take no part (no
component, kept); rows that repeat a doc_id share its component; an empty table
gives no rows; other columns are ignored by ``linked`` and carried by ``deduplicated``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components, rooted
from .packing import texts_of
from .ragged import chunks, combined, mix, slice_hashes
from .scratch import partitions, passing, settled, ship, tidy

WORDS, PERCENT = 5, 85
PERMUTATIONS, PER_BAND = 32, 2
BANDS = PERMUTATIONS // PER_BAND
AGREE = 40
CHUNK = 1_000_000
BUCKET_ROWS, CLUSTER_ROWS = 512, 256
_PLAIN = bytes(32 if 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_FACTORS = (mix(np.arange(1, 2 * PERMUTATIONS + 1, dtype=np.uint64)) | np.uint64(1)).reshape(2, PERMUTATIONS, 1)


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    out: list[np.ndarray] = []
    for a, b in chunks(texts, CHUNK):
        raw = [t.encode().translate(_PLAIN) for t in texts[a:b]]
        size = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
        values = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        word = values != 32
        edge = np.flatnonzero(np.diff(word.astype(np.int8), prepend=0, append=0))
        start, end = edge[::2], edge[1::2]
        hashes = slice_hashes(values, start, end)
        windows = combined(hashes, words)
        at = np.searchsorted(start, np.concatenate([[0], np.cumsum(size)])).tolist()
        for s, e in zip(at, at[1:], strict=False):
            if e - s >= words:
                out.append(np.unique(windows[s : e - words + 1]))
            elif e > s:
                out.append(combined(hashes[s:e], e - s))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def class_of(text: str, shingles: np.ndarray) -> bytes:
    """A digest that equal sets share."""
    if len(shingles) == 1:
        return hashlib.sha256(b" ".join(text.encode().translate(_PLAIN).split()[:WORDS])).digest()
    return hashlib.sha256(shingles.tobytes()).digest()


def min_max(shingles: np.ndarray) -> np.ndarray:
    """Smallest and largest value under each permutation: an array (PERMUTATIONS, 2)."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max)
    high = np.zeros(PERMUTATIONS, np.uint64)
    for i in range(0, len(shingles), 1 << 14):
        v = shingles[i : i + (1 << 14)] * _FACTORS[0]
        v ^= v >> np.uint64(32)
        v *= _FACTORS[1]
        np.minimum(low, v.min(1), out=low)
        np.maximum(high, v.max(1), out=high)
    return np.stack([low, high], 1)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class, sketch (a byte of each value) and bands (a long each)."""
    numbers = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    places = mix(np.arange(7, 7 + 2 * PER_BAND, dtype=np.uint64)) | np.uint64(1)

    def run(batches):
        for batch in batches:
            sizes, classes, sketches, bands = [], [], [], []
            texts = texts_of(batch)
            for text, s in zip(texts, shingle_sets(texts), strict=True):
                sizes.append(len(s))
                if not len(s):
                    classes.append(None)
                    sketches.append(None)
                    bands.append(None)
                    continue
                values = mix(min_max(s))
                classes.append(class_of(text, s))
                sketches.append(values.astype(np.uint8).tobytes())
                bands.append(mix((values.reshape(BANDS, -1) * places).sum(1) + numbers).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(sketches, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "class", "sketch", "bands"],
            )

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, n_shingles long, class binary, sketch binary, bands array<long>")


class Forest:
    """Disjoint sets of doc_ids, each known by its smallest."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while (y := up.get(x, x)) != top:
            up[x] = top
            x = y
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def alike(group: np.ndarray, side: np.ndarray, only_across: np.ndarray, joined: np.ndarray, sketches: np.ndarray, least: int = AGREE):
    """Pairs of places in one group (rows in group order), not joined yet, whose sketches agree, with their agreement."""
    left, right, score = [], [], []
    size = np.bincount(group) if len(group) else np.zeros(1, int)
    member = size[group]
    rest = np.cumsum(size)[group] - np.arange(len(group))  # rows of the group from here on
    for step in range(1, int(member.max(initial=1))):
        i = np.flatnonzero(rest > step)
        if not len(i):
            break
        i = i[(~only_across[i] | (side[i] != side[i + step])) & (joined[i] != joined[i + step])]
        for k in range(0, len(i), 1 << 16):
            p = i[k : k + (1 << 16)]
            n = (sketches[p] == sketches[p + step]).sum(1)
            hit = n >= least
            left.append(p[hit])
            right.append(p[hit] + step)
            score.append(n[hit])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right), np.concatenate(score)


def whole_groups(batches, keys: list[str], columns: list[str]):
    """Lists of columns and group numbers, cut between groups of equal keys; rows come sorted by keys."""
    kept: list[tuple] = []
    for batch in batches:
        rows = list(zip(*(batch.column(c).to_pylist() for c in keys + columns), strict=True))
        kept += rows
        n = len(keys)
        cut = len(kept)
        last = kept[-1][:n] if kept else None
        while cut and kept[cut - 1][:n] == last:
            cut -= 1
        if cut:
            yield numbered(kept[:cut], n)
            kept = kept[cut:]
    if kept:
        yield numbered(kept, len(keys))


def numbered(rows: list[tuple], n: int):
    group = np.zeros(len(rows), np.int64)
    group[1:] = np.cumsum([a[:n] != b[:n] for a, b in zip(rows, rows[1:], strict=False)])
    return group, list(zip(*rows, strict=True))


def measured(rows: DataFrame, key: str) -> DataFrame:
    """(key, large, heavy, light) of keys whose rows (key, rep, comp) are of several components: the largest one, and the rows in it and in the others."""
    top = F.max(F.struct("count", F.col("comp").alias("large")))
    sizes = rows.groupBy(key, "comp").count().groupBy(key).agg(F.count("comp").alias("comps"), F.sum("count").alias("all"), top.alias("top")).where("comps > 1")
    return sizes.select(key, "top.large", F.col("top.count").alias("heavy"), (F.col("all") - F.col("top.count")).alias("light"))


def in_chunks(rows: DataFrame, sizes: DataFrame, key: str, most: int) -> DataFrame:
    """Rows (key, rep, comp) of the keys in ``sizes``, with work items (key, lo, hi): chunks of a key's rows, of about ``most`` rows
    each, taken two by two; chunks of the key's largest component are only taken with others. ``across``: the two differ; ``side``: which one a row is of."""
    return dealt(rows.join(sizes, key).withColumn("alone", F.col("comp") == F.col("large")), key, most)


def dealt(rows: DataFrame, key: str, most: int) -> DataFrame:
    """Work items of rows (key, rep, comp, alone, heavy, light), where those that are ``alone``, heavy in number, are not taken with each other."""
    chunks = lambda c: F.greatest(F.ceil(F.col(c) / most), F.lit(1))
    draw = F.xxhash64("rep")
    rows = rows.withColumn("heavy", chunks("heavy")).withColumn("light", chunks("light"))
    rows = rows.withColumn("own", F.when(F.col("alone"), F.col("light") + F.pmod(draw, F.col("heavy"))).otherwise(F.pmod(draw, F.col("light"))))
    others = F.when(F.col("alone"), F.col("light")).otherwise(F.col("light") + F.col("heavy"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), others - 1)))
    side, across = F.col("own") <= F.col("other"), F.col("own") != F.col("other")
    return rows.select(key, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), side.alias("side"), across.alias("across"), "rep", "comp")


def prefixes(texts: DataFrame, members: DataFrame) -> DataFrame:
    """Work rows (shingle, rep, comp, alone, heavy, light) in which every two members (rep, comp) at the threshold, of different components, meet.

    Shingles are put in one order, the rarest among all members first. If x and the no smaller y share ``both`` shingles, the first one
    that they share has no more than |x| - both and |y| - both before it. At the threshold, both * 185 >= 85 * (|x| + |y|). So x has it among its
    first |x| - ceil(170 |x| / 185) + 1, which are its index rows, and y at a place that leaves enough behind it for a partner of |x|
    shingles; its rows up to such places are probes. Index rows meet each other and the probes, probes not each other. Texts of one
    template that are not alike differ in their rarest shingles, which nothing else has."""
    spark = texts.sparkSession

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                sets = shingle_sets(texts_of(part))
                size = np.fromiter(map(len, sets), np.int64, len(sets))
                columns = [np.repeat(part.column(c).to_numpy(), size) for c in ("rep", "comp")]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(np.repeat(size, size)), pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64))], ["rep", "comp", "size", "shingle"])

    rows = settled(members.join(texts, "rep").select("rep", "comp", "text").mapInArrow(tidy(run), "rep long, comp long, size long, shingle long"), "shingles")
    several = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    place = F.row_number().over(Window.partitionBy("rep").orderBy("df", "shingle")) - 1
    placed = rows.join(several, "shingle", "left").fillna(1, ["df"]).withColumn("place", place).where("df > 1")
    whole, size = 100 + PERCENT, F.col("size")
    index = F.col("place") <= size - F.ceil(2 * PERCENT * size / whole)
    partner = F.floor((size - F.col("place")) * whole / PERCENT) - size  # the largest one of no more than its own size
    placed = placed.select("shingle", "rep", "comp", "size", index.alias("index"), F.least(partner, size).alias("partner")).where(F.col("partner") * 100 >= PERCENT * size)
    placed = settled(placed, "prefixes")
    least = placed.where("index").groupBy("shingle").agg(F.min("size").alias("least"))
    met = placed.join(least, "shingle").where("index OR partner >= least").withColumn("alone", ~F.col("index"))
    sizes = met.groupBy("shingle").agg(F.count_if("alone").alias("heavy"), F.count_if("index").alias("light"), (F.min("comp") != F.max("comp")).alias("several")).where("several")
    return met.join(sizes, "shingle").select("shingle", "rep", "comp", "alone", "heavy", "light")


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets of different classes reach the threshold."""
    small, large = sorted((len(x), len(y)))
    if small < 2 or 100 * small < PERCENT * large:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= PERCENT * (small + large - both)


def edge_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in links], pa.int64()) for i in (0, 1)], ["a", "b"])


def starred(texts: DataFrame, classes: DataFrame, shared: DataFrame) -> DataFrame:
    """Links (a, b) of classes with the first class of a bucket, at most one a class."""
    spark = classes.sparkSession
    sketch = classes.select("rep", "sketch")
    pairs = shared.where("rep <> pivot").select("rep", "pivot").distinct().join(sketch, "rep").join(sketch.toDF("pivot", "pivot_sketch"), "pivot")

    def agreement(batches):
        for batch in batches:
            own, first = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sketch", "pivot_sketch"))
            n = (own == first).sum(1)
            hit = pa.array(n >= AGREE)
            found = pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("pivot"), pa.array(n.astype(np.int32))], ["rep", "pivot", "agree"])
            yield found.filter(hit)

    agreeing = pairs.mapInArrow(agreement, "rep long, pivot long, agree int")
    best = agreeing.groupBy("rep").agg(F.max(F.struct("agree", (-F.col("pivot")).alias("nearest"))).alias("best"))
    best = settled(best.select("rep", (-F.col("best.nearest")).alias("pivot")), "stars")
    sizes = best.groupBy("pivot").agg(F.ceil(F.count("rep") / CLUSTER_ROWS).alias("parts"))
    members = best.join(sizes, "pivot").select("pivot", F.pmod(F.xxhash64("rep"), F.col("parts")).alias("part"), "rep")
    heads = sizes.select("pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("pivot").alias("rep"))
    work = members.unionByName(heads).join(texts, "rep")
    keys = ["pivot", "part"]

    def run(batches):
        for group, cols in whole_groups(batches, keys, ["rep", "text"]):
            pivot, _, rep, text = cols
            sets = shingle_sets([t or "" for t in text])
            heads = {int(group[i]): i for i in range(len(rep)) if rep[i] == pivot[i]}
            yield edge_batch([(pivot[i], rep[i]) for i in range(len(rep)) if rep[i] != pivot[i] and similar(sets[i], sets[heads[int(group[i])]])])

    return work.repartition(partitions(spark), *keys).sortWithinPartitions(*keys).mapInArrow(tidy(run), "a long, b long")


def candidates(classes: DataFrame, shared: DataFrame) -> DataFrame:
    """Edges (a, b) that join classes of one bucket (bucket, rep, comp, pivot) with agreeing sketches, in different components. In a bucket
    of many small components all are joined to its first class: ``confirmed`` finds which are alike without taking them two by two."""
    spark = classes.sparkSession
    rows = shared.select("bucket", "rep", "comp")
    sizes = settled(measured(rows, "bucket"), "sizes")
    wide = shared.join(sizes.where(F.col("light") > BUCKET_ROWS).select("bucket"), "bucket").where("rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct()
    work = in_chunks(rows, sizes.where(F.col("light") <= BUCKET_ROWS), "bucket", BUCKET_ROWS).join(classes.select("rep", "sketch"), "rep")
    keys = ["bucket", "lo", "hi"]

    def run(batches):
        for group, cols in whole_groups(batches, keys, ["side", "across", "rep", "comp", "sketch"]):
            side, across, rep, comp = (np.array(c) for c in cols[3:7])
            sketches = np.frombuffer(b"".join(cols[7]), np.uint8).reshape(len(rep), -1)
            left, right, _ = alike(group, side, across, comp, sketches)
            forest = Forest()
            seen = [x for a, b in zip(rep[left].tolist(), rep[right].tolist(), strict=True) if forest.join(a, b) for x in (a, b)]
            yield edge_batch([(x, forest.root(x)) for x in seen])

    return work.repartition(partitions(spark), *keys).sortWithinPartitions(*keys).mapInArrow(tidy(run), "a long, b long").unionByName(wide)


def confirmed(texts: DataFrame, classes: DataFrame, clusters: DataFrame) -> DataFrame:
    """Links (a, b) between classes of a cluster (rep, cluster, comp) with similar sets, enough of them to join all that are linked.
    Clusters of many small components are searched by the rarest shingles of their texts (``prefixes``), others two by two."""
    sizes = settled(measured(clusters, "cluster"), "sizes")
    wide = sizes.where(F.col("light") > CLUSTER_ROWS).select("cluster")
    links = compared(texts, classes, in_chunks(clusters, sizes.where(F.col("light") <= CLUSTER_ROWS), "cluster", CLUSTER_ROWS), "cluster")
    if wide.isEmpty():
        return links
    members = clusters.join(wide, "cluster", "left_semi").select("rep", "comp")
    return links.unionByName(compared(texts, classes, dealt(prefixes(texts, members), "shingle", CLUSTER_ROWS), "shingle"))


def compared(texts: DataFrame, classes: DataFrame, work: DataFrame, key: str) -> DataFrame:
    """Links (a, b) of the work items (key, lo, hi)."""
    spark = classes.sparkSession
    work = work.join(classes.select("rep", "sketch"), "rep").join(texts, "rep")
    keys = [key, "lo", "hi"]

    def run(batches):
        for group, cols in whole_groups(batches, keys, ["side", "across", "rep", "comp", "sketch", "text"]):
            side, across, rep, comp = (np.array(c) for c in cols[3:7])
            sketches = np.frombuffer(b"".join(cols[7]), np.uint8).reshape(len(rep), -1)
            left, right, score = alike(group, side, across, comp, sketches)
            sets = shingle_sets([t or "" for t in cols[8]])
            forest, links = Forest(), []
            for k in np.argsort(-score, kind="stable").tolist():
                i, j = left[k], right[k]
                a, b = int(comp[i]), int(comp[j])
                if forest.root(a) != forest.root(b) and similar(sets[i], sets[j]):
                    forest.join(a, b)
                    links.append((int(rep[i]), int(rep[j])))
            yield edge_batch(links)

    return work.repartition(partitions(spark), *keys).sortWithinPartitions(*keys).mapInArrow(tidy(run), "a long, b long")


def with_components(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows (rep) with comp: the component found so far, or else rep itself."""
    return rows.join(found.withColumnRenamed("v", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")


def joined_classes(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(v, component) of the classes (rep, sketch, bands) that are linked with another, but for roots of
    components that nothing else was joined to."""
    rows = classes.select("rep", F.explode("bands").alias("bucket"))
    firsts = rows.groupBy("bucket").agg(F.count("rep").alias("count"), F.min("rep").alias("pivot")).where("count > 1")
    shared = settled(rows.join(firsts, "bucket").select("bucket", "rep", "pivot"), "buckets")
    members = settled(shared.select("rep").distinct(), "members")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text")
    texts = settled(texts.join(members, "rep", "left_semi"), "texts")  # those that may be compared, read twice
    # A star's links go from a class to a smaller one, at most one each: a forest already.
    stars = settled(starred(texts, classes, shared).select(F.col("b").alias("v"), F.col("a").alias("to")), "links")
    found = rooted(stars).withColumnRenamed("to", "component")
    clusters = components(candidates(classes, with_components(shared, found)))
    clusters = with_components(clusters.select(F.col("v").alias("rep"), F.col("component").alias("cluster")), found)
    ends = [found.select(F.col("v").alias(k), F.col("component").alias(f"{k}_root")) for k in "ab"]
    links = confirmed(texts, classes, clusters).join(ends[0], "a", "left").join(ends[1], "b", "left")
    merged = components(links.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")))
    lifted = found.join(merged.select(F.col("v").alias("component"), F.col("component").alias("final")), "component", "left")
    return settled(lifted.select("v", F.coalesce("final", "component").alias("component")).unionByName(merged), "components")


def linked(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    with passing(docs.sparkSession) as kept:
        signed = settled(signatures(docs), "signatures")
        known = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
        reps = known.groupBy("class").agg(F.min("doc_id").alias("rep"))
        own = known.join(reps.withColumnRenamed("rep", "doc_id"), ["class", "doc_id"], "left_semi").dropDuplicates(["class", "doc_id"])
        classes = settled(own.select("class", F.col("doc_id").alias("rep"), "sketch", "bands"), "classes")
        found = joined_classes(docs, classes)
        kept += [signed, classes, found]
    of_class = classes.select("class", "rep").join(found.withColumnRenamed("v", "rep"), "rep", "left")
    of_class = of_class.select("class", F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", "n_shingles", "class").join(of_class, "class", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each component, with all columns; of rows with one doc_id, the first by text."""
    kept = linked(docs).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("kept_id")).distinct()
    own = docs.columns
    hidden = [f"own_{i}" for i in range(len(own))]  # so that no name of docs' clashes with these
    key, text = (F.col(hidden[own.index(c)]) for c in ("doc_id", "text"))
    chosen = docs.toDF(*hidden).join(kept, key.cast("long") == F.col("kept_id"))
    place = F.row_number().over(Window.partitionBy("kept_id").orderBy(text))
    chosen = chosen.withColumn("place", place).where("place = 1").select(*(F.col(h).alias(c) for h, c in zip(hidden, own, strict=True)))
    return chosen.unionByName(docs.where("doc_id IS NULL"))
