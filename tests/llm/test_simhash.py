import random

import pytest
import xxhash
from pyspark.sql import functions as F

from inkstrata.llm import simhash


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_roots(fps):
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(fps):
        for y in fps[:i]:
            if bin(x ^ y).count("1") <= 4:
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {x: find(x) for x in fps}


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "a B c", "a b c d", "É é\x0bÀ x y z  w", "w " * 300])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


@pytest.mark.parametrize("look", [1, simhash.LOOK])
def test_links_reach_every_distance(spark, monkeypatch, look):
    monkeypatch.setattr(simhash, "LOOK", look)
    rng = random.Random(5)
    fps = []
    for _ in range(40):
        base = rng.getrandbits(64)
        fps.append(base)
        for d in range(1, 8):  # any spread of the differing bits over the parts
            x = base
            for b in rng.sample(range(64), d):
                x ^= 1 << b
            fps.append(x)
    dense = rng.getrandbits(64)
    for _ in range(80):  # many within reach of each other, so that buckets are larger than any look-around
        x = dense
        for b in rng.sample(range(64), rng.randrange(1, 5)):
            x ^= 1 << b
        fps.append(x)
    low = rng.getrandbits(64)
    fps += [low ^ k ^ (k % 5 << 50) for k in range(0, 4000, 23)]  # buckets of one rest and far apart in the part left out
    chain = rng.getrandbits(64)
    for k in range(12):
        fps.append(chain ^ ((1 << (4 * k)) - 1))
    fps = sorted(set(fps))
    frame = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    met = simhash.first_pass(frame)
    near = simhash.neighbour_links(met)
    far = simhash.variant_links(simhash.unsettled(met, simhash.components(near)))
    for edges in (near, far):
        assert edges.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > 4).count() == 0
    assert far.count() > 0 or look == simhash.LOOK
    got = {r.node: r.root for r in simhash.linked(frame).collect()}
    groups, expected = {}, {}
    for x in fps:
        s = simhash._signed(x)
        groups.setdefault(got.get(s, s), set()).add(x)
    for x, r in slow_roots(fps).items():
        expected.setdefault(r, set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))
    assert set(got) == {simhash._signed(x) for g in expected.values() if len(g) > 1 for x in g}


def test_query_edge_rows(spark):
    rows = [(5, "a b c d e f"), (3, "A  b c\td e f"), (9, None), (7, ""), (None, "x y z w v"), (11, "lone text here with words of its own"), (3, "a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(-1, None), (3, 3), (3, 3), (5, 3), (7, 7), (9, 7), (11, 11)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = sorted(r.doc_id or -1 for r in simhash.keep(spark, docs, "").collect())
    assert kept == [-1, 3, 7, 11]


def test_keep_goes_by_row(spark):
    one, two, three, four = ("first text of its own words here", "quite another matter is told there", "nothing of this was said before now", "some last lines with other things")
    rows = [(None, one), (None, two), (None, two), (4, three), (9, three), (9, four), (5, "z y x w v u t s"), (5, "k l m n o p q r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fps = [slow_fingerprint(t) for t in {t for _, t in rows}]
    assert len(set(slow_roots(fps).values())) == 6  # no two texts are near
    kept = sorted(((r.doc_id or -1, r.text) for r in simhash.keep(spark, docs, "").collect()))
    assert kept == sorted([(-1, one), (-1, two), (4, three), (9, four), *rows[-2:]])


def test_keep_of_repeated_ids_and_groups(spark):
    """An id in two groups, copies under other ids, and repeated rows: every group keeps one row, no text is lost."""
    a, b, c = ("alpha words that tell of one thing only", "beta words on something else again here", "gamma lines nobody has written elsewhere yet")
    docs = spark.createDataFrame([(7, a), (9, a), (1, b), (7, b), (7, c), (7, c), (None, c), (2, None), (None, "")], "doc_id long, text string")
    assert sorted(((r.doc_id or -1, r.text or "") for r in simhash.keep(spark, docs, "").collect())) == sorted([(7, a), (1, b), (7, c), (2, "")])
