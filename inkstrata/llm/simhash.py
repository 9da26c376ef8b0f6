"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A document's fingerprint has a bit set where over half of its shingles' XXH64 hashes have it set. Two fingerprints link
at RADIUS = 4 or fewer differing bits. Both are then within HALF = 2 bits of a common word, so if every fingerprint
emits all words within HALF bits, linked ones collide, and any two that collide are linked.

All 2081 words of every fingerprint would be a shuffle of about twenty times the input, so a first pass drops what can't
collide. Of two linked fingerprints, one of the three PARTS of 21 or 22 bits holds at least 2 of at most 4 differing
bits; without it they differ in at most 2. So in a first pass each distinct fingerprint emits, for each part left out,
the ball of half that rest (radius 1: 44 words of about 43 bits, 130 in all), and only those that meet another go on.

In a bucket of the first pass, in order, each fingerprint is verified against the LOOK before it. That settles every
bucket of at most LOOK + 1. A larger one goes on only if it still holds members of two components of the links so far:
its members emit the variants of the left-out part, so that at most HALF bits are flipped in all; a bucket of the full 64
bits is then a clique by construction, and a star around its smallest member carries its links. No pairs are listed, a
dense group is settled by its neighbours, and every true link lies inside a component.

Copies have one fingerprint and count once from the start. Buckets are sorted runs (windows with a bounded look-around,
or a running minimum), never collected groups. Components come from alternating large-star and small-star steps, each
written to the shared folder; hubs and large components are dealt over SALTS tasks.

Defined results: null or empty texts, and texts of white space, have fingerprint zero and link like any other. A text
of fewer than SHINGLE words is one shingle. Rows that share a doc_id each get a row. A null doc_id counts in no minimum;
a component of null ids alone has a null id. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstrata.llm._common import discard, join_bounded, join_salted, map_arrow, slices, stored, table

SHINGLE = 4
SEED = 42
RADIUS = 4
HALF = RADIUS // 2
#: [low, high) bits of the parts of which one is left out in the first pass.
PARTS = ((0, 21), (21, 42), (42, 64))
#: Members of a bucket of the first pass that each is verified against directly; larger buckets are settled by variants.
LOOK = 16


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        hashes = np.array([digest(joined, SEED)], np.uint64)
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[: len(words) - SHINGLE + 1].tolist()
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)], np.uint64)
    bits = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        bits += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        found = np.array([fingerprint(x.as_py()) for x in part.column("text")], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("hash"), pa.array(found)], ["doc_id", "hash", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, hash, fp): the hash of each row's text and its fingerprint as a signed long."""
    return map_arrow(docs.select("doc_id", F.xxhash64("text").alias("hash"), "text"), _fingerprints, "doc_id long, hash long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _drop(part: int) -> int:
    low, high = PARTS[part]
    return (1 << high) - (1 << low)


def _keep(part: int) -> int:
    return ~_drop(part) & ((1 << 64) - 1)


def _tag(part: int) -> int:
    """A mark in the left-out bits that keeps the words of one part apart from another's."""
    return (part + 1) << PARTS[part][0]


def _longs(values: list[int]) -> Column:
    return F.array(*(F.lit(_signed(x)) for x in values))


def first_pass(fps: DataFrame) -> DataFrame:
    """(key, fp): words of the first pass that two or more distinct fingerprints share."""
    keeps, flips = [], []
    for part in range(len(PARTS)):
        for flip in (0, *(1 << b for b in range(64) if _keep(part) >> b & 1)):
            keeps.append(_keep(part))
            flips.append(flip | _tag(part))
    ball = F.explode(F.arrays_zip(_longs(keeps).alias("keep"), _longs(flips).alias("flip"))).alias("v")
    rows = fps.select("fp", ball).select(F.col("fp").bitwiseAND(F.col("v.keep")).bitwiseXOR(F.col("v.flip")).alias("key"), "fp")
    run = "over (partition by key order by fp)"
    near = rows.withColumns({"before": F.expr(f"lag(fp) {run}"), "after": F.expr(f"lead(fp) {run}")})
    return near.where("before is not null or after is not null").select("key", "fp")


def neighbour_links(met: DataFrame) -> DataFrame:
    """(a, b): links a < b of members of one bucket that are at most LOOK places apart in it."""
    before = F.expr(f"collect_list(fp) over (partition by key order by fp rows between {LOOK} preceding and 1 preceding)")
    close = F.filter(F.col("before"), lambda x: F.bit_count(x.bitwiseXOR(F.col("fp"))) <= RADIUS)
    found = met.withColumn("before", before).select("fp", close.alias("close")).where(F.size("close") > 0)
    return found.select(F.explode("close").alias("a"), F.col("fp").alias("b")).distinct()


def unsettled(met: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows (key, fp) of buckets of more than LOOK + 1 members that hold members of two components."""
    named = met.join(roots, met.fp == roots.node, "left").select("key", F.coalesce("root", "fp").alias("root"))
    keys = named.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
    return met.join(keys.where((F.col("n") > LOOK + 1) & (F.col("low") != F.col("high"))).select("key"), "key", "left_semi")


def variant_links(met: DataFrame) -> DataFrame:
    """(a, b): distinct links a < b that connect all fingerprints of common buckets within RADIUS bits of each other."""
    variants = []
    for part, (low, high) in enumerate(PARTS):
        keep, tag = F.lit(_signed(_keep(part))), F.lit(_signed(_tag(part)))
        used = F.bit_count(F.col("key").bitwiseXOR(F.col("fp")).bitwiseAND(keep))
        own = met.where(F.col("key").bitwiseAND(F.lit(_signed(_drop(part)))) == tag).withColumn("used", used).where(F.col("used") <= 1)
        bits = [1 << b for b in range(low, high)]
        near, far = [0, *bits], [x | y for k, x in enumerate(bits) for y in bits[:k]]
        masks = F.when(F.col("used") == 0, _longs(near + far)).otherwise(_longs(near))
        base = F.col("key").bitwiseAND(keep).bitwiseOR(F.col("fp").bitwiseAND(F.lit(_signed(_drop(part)))))
        variants.append(own.select("fp", base.alias("base"), F.explode(masks).alias("mask")).select(F.col("base").bitwiseXOR(F.col("mask")).alias("word"), "fp"))
    words = variants[0].unionByName(variants[1]).unionByName(variants[2]).distinct()
    star = words.withColumn("a", F.expr("min(fp) over (partition by word order by fp rows between unbounded preceding and current row)"))
    return star.where("a != fp").select("a", F.col("fp").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (a, b) can reach, by alternating stars; stored."""
    state, seen = stored(edges.select("a", "b"), "edges"), None
    while True:
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == seen:
            break
        seen = mark
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = join_salted(both.where("b > a"), low, "a", F.col("b")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = join_salted(large, low, "a", F.col("b")).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        turned = small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        before, state = state, stored(turned.unionByName(low.select("a", F.col("m").alias("b"))).where("a != b").distinct(), "edges")
        discard(before)
    roots = stored(state.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root"), "roots")
    discard(state)
    return roots


def linked(fps: DataFrame) -> DataFrame:
    """(node, root) of the distinct fingerprints `fps` (fp) that link to any other; a root is its own node too."""
    met = stored(first_pass(fps), "met")
    roots = components(neighbour_links(met))
    far = stored(variant_links(stored(unsettled(met, roots), "unsettled")), "far")
    if far.limit(1).count():  # components that only variants connect are joined as wholes
        at_a, at_b = (roots.select(F.col("node").alias(f"n{x}"), F.col("root").alias(f"r{x}")) for x in "ab")
        ends = far.join(at_a, F.col("a") == F.col("na"), "left").join(at_b, F.col("b") == F.col("nb"), "left")
        ends = ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).where("a != b")
        over = components(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        higher = over.select(F.col("node").alias("root"), F.col("root").alias("top"))
        low = roots.unionByName(over.select("node", F.col("node").alias("root")))
        roots = stored(join_salted(low, higher, "root", F.col("node"), "left").select("node", F.coalesce("top", "root").alias("root")), "roots")
    discard(met)
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def by_component(each: DataFrame, best: Column) -> DataFrame:
    """(fp, root, n, best): of the distinct fingerprints of `each`, their components, rows and least `best` of all rows there."""
    distinct = stored(each.groupBy("fp").agg(F.min(best).alias("best"), F.count("*").alias("n")), "distinct")
    found = distinct.join(linked(distinct.select("fp")), F.col("fp") == F.col("node"), "left").drop("node")
    inside = found.where("root is not null")
    whole = inside.groupBy("root").agg(F.min("best").alias("best"), F.sum("n").alias("n"))
    joined = join_salted(inside.select("fp", "root"), whole, "root", F.col("fp")).select("fp", "root", "n", "best")
    return joined.unionByName(found.where("root is null").select("fp", F.col("fp").alias("root"), "n", "best"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of `docs` (doc_id, text)."""
    each = stored(fingerprints(docs), "fingerprints")
    by_fp = by_component(each, F.col("doc_id")).select("fp", F.col("best").alias("component_id"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return each.join(by_fp, "fp").select("doc_id", hexed, "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def keep(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of `docs`: that with the smallest id, of such rows that with the smallest hash of its text.

    A row's key is its id and text, so an id with texts in several components keeps a row in each of those it is first in.
    A null id comes last; a component of null ids alone keeps one row.
    """
    each = stored(fingerprints(docs), "fingerprints")
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "hash")
    several = stored(by_component(each, key).where("n > 1").select("fp", "best"), "several")
    chosen = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("hash") == F.col("best.hash"))
    within = stored(join_bounded(each, several, "fp", "inner").select("doc_id", "hash", chosen.alias("chosen")), "within")
    lost = within.where("not chosen").select(F.col("doc_id").alias("lost_id"), F.col("hash").alias("lost_hash")).distinct()
    hashed = docs.withColumn("_hash", F.xxhash64("text"))
    left = join_bounded(hashed, lost, hashed.doc_id.eqNullSafe(F.col("lost_id")) & (hashed._hash == F.col("lost_hash")), "left_anti", 2_000_000)
    repeated = within.where("chosen").groupBy("doc_id", "hash").count().where("count > 1").limit(1).count()
    return (left.dropDuplicates(["doc_id", "_hash"]) if repeated else left).drop("_hash")
