"""Groups of near-duplicates by the similarity of their sets of shingles, on SimHash fingerprints and pivots.

Documents with equal sets are one class. Each class has a long SimHash of its set (``WORDS`` times 64
bits) and ``BANDS`` keys, each a hash of ``ROWS`` minima of the set under different hashes; classes
meet where they share a key. At a Jaccard similarity of 0.8 two classes share a key with
a probability of 0.9998, and 6.6 of the 16 keys on average; texts with little in common share none.

1. In every key's group a few classes, taken at random, are its pivots: a table holds all classes' Hamming distances to
   them. The class that is nearest to them in sum is the group's centre, and one more pivot. Classes within the
   radius of the centre are verified on the sets, so a group of n classes takes n pairs.
2. A group whose classes are not all connected after that is split. A class that has too many shingles which no other class
   of any split group has cannot be similar to one, and leaves: such are texts that have no more than a passage in common.
3. What is left of a split group is its largest part that is connected, and a minority. A minority of up to ``MINORITY`` classes is compared with
   the whole group in blocks: the pivot table discards pairs with a coordinate difference over the radius, the sets decide.
   That takes a bounded number of comparisons a class, and gives links only, no pairs.
4. Classes of groups with a larger minority meet again, by the rarest of their shingles, in an order by how many of these
   classes have them. Of two sets that are similar enough, the larger one's first n - 0.8 n + 1 shingles hold one of the smaller one's
   first n - 0.89 n + 1, its leads. So a class has fewer keys than shingles, keys without a lead are none, and what nearly all
   have is no lead of classes with some shingles that fewer have. Keys with the same classes are one. In each group its leads, or its minority if that is
   smaller, are compared with the whole group as in step 3, in as many blocks as it takes.

The radius is four standard errors above the distance expected at the similarity asked for. No group
is cut off and no pair is judged by an estimate.

Cases: null text is empty; texts of fewer than ``shingle`` words are one shingle, in the order of
their words; texts without words are one class; of several rows with one id, one stands for the document;
rows without an id are left out; extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandtally.llm.components import SALTS, connected_components, salted_join, with_group_count, with_group_min
from strandtally.llm.decontam import gram_hashes
from strandtally.llm.textscan import SPACE_WORDS, Words, give_back, mix, scan, take_turn
from strandtally.shared import materialize

WORDS = 4
BANDS, ROWS = 16, 4
PIVOTS = 8
MINORITY = 512
#: Classes of the minority and of the whole group in a block.
TILE, CHUNK = 128, 512
#: Sets below this size are too small for the estimate and are always compared themselves.
ESTIMATED = 64
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LANES = np.uint64(0x0001000100010001)
_LANE_SUM = 1 << 15  #: so many bits are added in a lane of 16 bits at most


def radius(similarity: float) -> int:
    """Bits in which sets of such a similarity differ at most, but for one pair in 30,000."""
    apart = math.acos(2 * similarity / (1 + similarity)) / math.pi
    n = 64 * WORDS
    return math.ceil(n * apart + 4 * math.sqrt(n * apart * (1 - apart)))


def shingle_set(words: Words, grams: np.ndarray, i: int, shingle: int) -> np.ndarray:
    """The sorted set of hashed shingles of the i-th text."""
    lo, hi = int(words.bounds[i]), int(words.bounds[i + 1])
    if hi - lo >= shingle:
        return np.unique(grams[lo : hi - shingle + 1])
    own = np.full(min(hi - lo, 1), np.uint64(hi - lo))
    for at in range(lo, hi):
        own = mix(own ^ words.hash[at : at + 1]) * _ODD
    return own


def set_hash(own: np.ndarray) -> int:
    return int(np.bitwise_xor.reduce(mix(own)).view(np.int64)) if len(own) else 0


def simhashes(members: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A row of 64-bit words for each set: bits that are set in over half of its members' hashes.

    ``members`` are the sets' members, set after set; none is empty.
    """
    cuts = np.concatenate([np.arange(a, a + n, _LANE_SUM) for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)])
    first = np.searchsorted(cuts, starts)
    out = np.zeros((len(starts), WORDS), np.uint64)
    for w in range(WORDS):
        h = mix(members ^ mix(np.full(1, np.uint64(w + 1)) * _ODD))
        for k in range(16):
            lanes = np.add.reduceat((h >> np.uint64(k)) & _LANES, cuts)
            for lane in range(4):
                count = np.add.reduceat((lanes >> np.uint64(16 * lane)) & np.uint64(0xFFFF), first)
                out[:, w] |= (2 * count.astype(np.int64) > sizes).astype(np.uint64) << np.uint64(16 * lane + k)
    return out


def band_keys(members: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of BANDS keys for each set."""
    salts = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    out = np.zeros((len(starts), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(starts), np.uint64(band + 1))
        for salt in salts[band * ROWS : (band + 1) * ROWS]:
            key = mix(key ^ np.minimum.reduceat((members ^ salt) * (salt | np.uint64(1)), starts)) * _ODD
        out[:, band] = key
    return out


def summaries(docs: DataFrame, doc_col: str, text_col: str, shingle: int) -> DataFrame:
    """(doc_id, same, n, fp, keys): hash and size of each text's set of shingles, its SimHash and its keys."""

    def run(batches):
        take_turn("scan")
        for batch in batches:
            for words in scan(batch.column(1), SPACE_WORDS):
                grams, _ = gram_hashes(words, shingle)
                sets = [shingle_set(words, grams, i, shingle) for i in range(words.n_texts)]
                sizes = np.array([len(x) for x in sets], np.int64)
                some = np.flatnonzero(sizes)
                fp, keys = np.zeros((len(sets), WORDS), np.uint64), [[] for _ in sets]
                if len(some):
                    members, n = np.concatenate(sets), sizes[some]
                    starts = np.cumsum(n) - n
                    fp[some] = simhashes(members, starts, n)
                    for i, own in zip(some.tolist(), band_keys(members, starts).view(np.int64).tolist(), strict=True):
                        keys[i] = own
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(words.first, words.n_texts), pa.array([set_hash(x) for x in sets]), pa.array(sizes), pa.array(fp.view(np.int64).tolist(), longs), pa.array(keys, longs)], ["doc_id", "same", "n", "fp", "keys"])
        give_back()

    rows = docs.select(F.col(doc_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[doc_col].dataType.simpleString()}, same long, n long, fp array<long>, keys array<long>")


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, same, grams): the whole set of each text, of rows (doc_id, text)."""

    def run(batches):
        for batch in batches:
            for words in scan(batch.column(1), SPACE_WORDS):
                grams, _ = gram_hashes(words, shingle)
                own = [shingle_set(words, grams, i, shingle) for i in range(words.n_texts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(words.first, words.n_texts), pa.array([set_hash(x) for x in own]), pa.array([x.view(np.int64) for x in own], pa.list_(pa.int64()))], ["doc_id", "same", "grams"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, same long, grams array<long>")


def distance(a: str, b: str) -> Column:
    """Bits in which two fingerprints (arrays of words) differ."""
    return reduce(lambda x, y: x + y, [F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(WORDS)])


def _small(a: str, b: str) -> Column:
    return F.least(f"{a}.n", f"{b}.n") < ESTIMATED


def _likely(a: str, b: str, similarity: float) -> Column:
    """Whether two sets may be that similar, by their sizes and fingerprints."""
    sizes = F.least(f"{a}.n", f"{b}.n") >= F.lit(similarity - 1e-9) * F.greatest(f"{a}.n", f"{b}.n")
    return sizes & (_small(a, b) | (distance(f"{a}.fp", f"{b}.fp") <= radius(similarity)))


def with_pivots(met: DataFrame) -> DataFrame:
    """Members (key, id, n, fp) of groups with their distances ``d`` to the group's pivots and its centre, and the centre itself.

    A coordinate is null where a small group lacks the pivot.
    """
    salted = met.withColumn("rank", F.struct(F.xxhash64("key", "id").alias("by"), "id", "n", "fp")).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    names = [f"p{i}" for i in range(PIVOTS)]
    parts = salted.groupBy("key", "salt").agg(*[F.min(F.when(F.pmod("rank.by", F.lit(PIVOTS)) == i, F.col("rank"))).alias(p) for i, p in enumerate(names)])
    group = Window.partitionBy("key")  # SALTS rows at most
    chosen = parts.select(F.col("key").alias("key2"), F.col("salt").alias("salt2"), *[F.min(p).over(group).alias(p) for p in names])
    near = salted.join(chosen, (F.col("key") == F.col("key2")) & (F.col("salt") == F.col("salt2"))).withColumn("d", F.array(*[distance("fp", f"{p}.fp") for p in names]))
    total = F.aggregate("d", F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    table = materialize(near.select("key", "id", "n", "fp", "d", F.struct(total.alias("total"), F.col("rank.by").alias("by"), "id", "n", "fp").alias("place")), "near-table")
    led = with_group_min(table, "key", "place", "centre").drop("place")
    return led.withColumn("d", F.concat("d", F.array(distance("fp", "centre.fp"))))


def pivot_pairs(led: DataFrame, similarity: float) -> DataFrame:
    """(u, v): the centre of each group with the members that may be similar to it."""
    own = led.select("centre", F.struct("id", "n", "fp").alias("own")).where("centre.id <> own.id")
    return own.where(_likely("centre", "own", similarity)).select(F.col("centre.id").alias("u"), F.col("own.id").alias("v")).distinct()


def not_connected(rows: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Rows (key, id, n, root, ...) of groups with more than one root, with their group's ``size`` and ``least`` n."""
    split = rows.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("size"), F.min("n").alias("least")).where("a <> b")
    return salted_join(rows.drop("size", "least"), split.select("key", "size", "least"), ["key"], "id", seen)


def may_link(apart: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The rows without classes that are similar to none, as too many of their shingles occur in no other class of ``apart``."""
    own = sets.join(apart.select("id").distinct(), "id").select("id", F.explode("grams").alias("gram"))
    single = own.groupBy("gram").agg(F.count("*").alias("n"), F.min("id").alias("alone")).where("n = 1")
    unique = single.groupBy("alone").agg(F.count("*").alias("unique"))
    most = F.col("n") - F.coalesce("unique", F.lit(0))
    enough = most * (1 + similarity) >= similarity * (F.col("n") + F.greatest("least", similarity * F.col("n"))) - 1e-9
    return apart.join(unique, F.col("id") == F.col("alone"), "left").where(enough).drop("unique", "alone")


def with_minority(apart: DataFrame) -> DataFrame:
    """Rows of split groups with ``minor``, whether the class is outside the group's largest connected part, and ``minority``, how many are."""
    parts = apart.groupBy("key", "root").agg(F.count("*").alias("part"), F.first("size").alias("size"))
    most = parts.groupBy("key").agg(F.max(F.struct("part", "root")).alias("main"), F.first("size").alias("all"))
    main = most.select("key", F.col("main.root").alias("main_root"), (F.col("all") - F.col("main.part")).alias("minority"))
    return salted_join(apart, main, ["key"], "id").withColumn("minor", F.col("root") != F.col("main_root")).drop("main_root")


def _block_links(similarity: float):
    """Of a block of minority classes and classes of the group, links between parts that are not connected: one from a class to a part."""
    bits = radius(similarity)

    def run(table: pa.Table) -> pa.Table:
        minor, ids, roots, n = (table[c].to_numpy() for c in ("minor", "id", "root", "n"))
        d = np.array(table["d"].to_pylist(), np.int64).reshape(len(ids), -1)
        lists = table["grams"].combine_chunks()
        grams, starts = lists.flatten().to_numpy(), lists.offsets.to_numpy().astype(np.int64)
        starts, lengths = starts[:-1] - starts[0], np.diff(starts)
        own, rest = np.flatnonzero(minor), np.flatnonzero(~minor)
        u, v = [], []
        if len(own) and len(rest):
            known, code = np.unique(grams, return_inverse=True)
            at = np.concatenate([np.arange(starts[i], starts[i] + lengths[i]) for i in rest])
            member, ends = code[at], np.cumsum(lengths[rest])
            mark = np.zeros(len(known), bool)
            for i in own:
                far = (np.abs(d[rest] - d[i]) > bits).any(axis=1) & (np.minimum(n[rest], n[i]) >= ESTIMATED)
                open_ = (roots[rest] != roots[i]) & ~far
                if not open_.any():
                    continue
                mine = code[starts[i] : starts[i] + lengths[i]]
                mark[mine] = True
                common = np.add.reduceat(mark[member].astype(np.int64), ends - lengths[rest])
                mark[mine] = False
                near = np.flatnonzero(open_ & (common * (1 + similarity) >= similarity * (n[rest] + n[i]) - 1e-9))
                near = near[np.unique(roots[rest][near], return_index=True)[1]]
                u += [ids[i]] * len(near)
                v += ids[rest[near]].tolist()
        return pa.table({"u": pa.array(u, table.schema.field("id").type), "v": pa.array(v, table.schema.field("id").type)})

    return run


def block_links(apart: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) of the minority of each group with classes of other roots; ``apart`` has (key, id, n, d, root, size, minor, minority)."""
    count = lambda of, each: F.ceil(F.col(of) / each).cast("int")
    rows = apart.select("key", "id", "n", F.transform("d", lambda x: F.coalesce(x, F.lit(-1))).alias("d"), "root", "minor", count("minority", TILE).alias("tiles"), count("size", CHUNK).alias("chunks"))
    deal = lambda over, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(over)).cast("int")
    every = lambda over: F.explode(F.sequence(F.lit(0), F.col(over) - 1))
    columns = ["key", "tile", "chunk", "id", "n", "d", "root", "minor"]
    asked = rows.where("minor").withColumn("tile", deal("tiles", 1)).withColumn("chunk", every("chunks")).select(columns)
    whole = rows.withColumn("minor", F.lit(False)).withColumn("chunk", deal("chunks", 2)).withColumn("tile", every("tiles")).select(columns)
    placed = asked.union(whole).join(sets.withColumnRenamed("id", "id2"), F.col("id") == F.col("id2")).drop("id2")
    kind = dict(apart.dtypes)["id"]
    return placed.groupBy("key", "tile", "chunk").applyInArrow(_block_links(similarity), f"u {kind}, v {kind}")


def prefix_keys(classes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(key, id, lead): each class (column id) under its rarest shingles, so that of two similar sets the smaller has one as a lead that the larger has too."""
    own = sets.join(classes, "id").select("id", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    counted = with_group_count(own, "gram", "id", "held")
    ranked = counted.groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("held", "gram"))).alias("order"))
    first = lambda share: (F.col("n") - F.ceil(F.lit(share) * F.col("n") - 1e-9) + 1).cast("int")
    rows = ranked.select("id", first(2 * similarity / (1 + similarity)).alias("leads"), F.posexplode(F.slice("order", F.lit(1), first(similarity))).alias("at", "o"))
    return rows.where("o.held > 1").select(F.col("o.gram").alias("key"), "id", (F.col("at") < F.col("leads")).alias("lead"))


def rare_groups(large: DataFrame, sets: DataFrame, known: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """Groups of classes (column id) under their rarest shingles, as ``block_links`` takes them; those that are compared with all are ``minor``."""
    keyed = materialize(prefix_keys(large, sets, similarity), "near-prefixes")
    same = [F.bit_xor(F.xxhash64("id", "lead", F.lit(i))).alias(f"s{i}") for i in range(2)]
    shared = keyed.groupBy("key").agg(F.count("*").alias("size"), F.count_if("lead").alias("leads"), *same).where("size > 1 and leads > 0")
    shared = materialize(shared.groupBy("size", "leads", "s0", "s1").agg(F.min("key").alias("key")).select("key", "leads"), "near-rare")
    met = salted_join(keyed, shared, ["key"], "id").join(known.select("id", "n"), "id").join(roots, F.col("id") == F.col("node"), "left")
    met = materialize(met.select("key", "id", "n", F.array(F.lit(0)).alias("d"), F.coalesce("root", "id").alias("root"), "lead", "leads"), "near-met")
    split = with_minority(materialize(not_connected(met), "near-open"))
    few = F.col("leads") < F.col("minority")
    return split.withColumn("minor", F.when(few, F.col("lead")).otherwise(F.col("minor"))).withColumn("minority", F.least("leads", "minority"))


def met_under(keyed: DataFrame, known: DataFrame) -> DataFrame:
    """(key, id, n, fp) of the rows (key, id) whose key several classes share; of keys with the same classes the smallest."""
    same = [F.bit_xor(F.xxhash64("id", F.lit(i))).alias(f"s{i}") for i in range(2)]
    shared = keyed.groupBy("key").agg(F.count("*").alias("size"), *same).where("size > 1")
    shared = materialize(shared.groupBy("size", "s0", "s1").agg(F.min("key").alias("key")).select("key"), "near-shared")
    return materialize(salted_join(keyed, shared, ["key"], "id").join(known.select("id", "n", "fp"), "id").select("key", "id", "n", "fp"), "near-met")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose Jaccard similarity is high enough; ``sets`` has (id, grams). One u may be in very many pairs."""
    pairs = materialize(pairs.withColumn("slot", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")), "near-likely")
    # only slots that occur get a set
    a = pairs.select(F.col("u").alias("u2"), F.col("slot").alias("slot2")).distinct().join(sets.withColumnRenamed("id", "u3"), F.col("u2") == F.col("u3")).select("u2", "slot2", F.col("grams").alias("a"))
    both = pairs.join(sets.select(F.col("id").alias("v2"), F.col("grams").alias("b")), F.col("v") == F.col("v2")).join(a, (F.col("u") == F.col("u2")) & (F.col("slot") == F.col("slot2")))
    common = F.size(F.array_intersect("a", "b"))
    return both.where(common * (1 + similarity) >= similarity * (F.size("a") + F.size("b")) - 1e-9).select("u", "v")


def _connected(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) of the components so far with more links."""
    return connected_components(links.union(roots.select("node", "root")))


def near_duplicate_groups(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) of documents whose sets of shingles link at a similarity of 0.8 or more."""
    made = materialize(summaries(docs, doc_col, text_col, shingle).where("doc_id is not null"), "near-summaries")
    versions = made.groupBy("doc_id").agg(F.min(F.struct("same", "n")).alias("class"))
    members = materialize(with_group_min(versions, "class", "doc_id", "id"), "near-members")
    heads = members.where("doc_id = id").select("id", F.col("class.same").alias("same1"), F.col("class.n").alias("n1"))
    reps = made.join(heads, (F.col("doc_id") == F.col("id")) & (F.col("same") == F.col("same1")) & (F.col("n") == F.col("n1"))).dropDuplicates(["id"])
    reps = materialize(reps.select("id", "same", "n", "fp", "keys"), "near-classes")

    met = met_under(reps.select("id", F.explode("keys").alias("key")).select("key", "id"), reps)
    # the sets of all classes that meet another, once
    asked = met.select("id").distinct().join(reps.select("id", "same"), "id").select("id", F.col("same").alias("same1"))
    texts = docs.select(F.col(doc_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(asked.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    sets = shingle_sets(texts, shingle).join(asked, (F.col("doc_id") == F.col("id")) & (F.col("same") == F.col("same1")))
    sets = materialize(sets.select("id", "grams"), "near-sets")

    led = materialize(with_pivots(met), "near-pivots")
    roots = connected_components(verified(pivot_pairs(led, similarity), sets, similarity))
    rooted = led.drop("centre").join(roots, F.col("id") == F.col("node"), "left").select("key", "id", "n", "fp", "d", F.coalesce("root", "id").alias("root"))
    # groups whose classes are all connected are done
    apart = materialize(not_connected(rooted, seen=led), "near-split")
    apart = materialize(with_minority(materialize(not_connected(may_link(apart, sets, similarity)), "near-open")), "near-apart")
    found = materialize(block_links(apart.where(F.col("minority") <= MINORITY), sets, similarity), "near-found")
    large = materialize(apart.where(F.col("minority") > MINORITY).select("id").distinct(), "near-large")
    if large.limit(1).count():
        roots = _connected(roots, found)
        found = materialize(block_links(materialize(rare_groups(large, sets, reps, roots, similarity), "near-rare-groups"), sets, similarity), "near-found")
    if found.limit(1).count():
        roots = _connected(roots, found)
    rooted = reps.select("id").join(roots, F.col("id") == F.col("node"), "left").select(F.col("id").alias("id2"), F.coalesce("root", "id").alias("component_id"))
    return members.join(materialize(rooted, "near-roots"), F.col("id") == F.col("id2")).select("doc_id", "component_id")
