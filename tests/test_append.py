import pickle
import random

import pytest

from inkstrata.core.append import Chain, Superseded, _aligned, _pairs, Kept
from inkstrata.core.document import dump, parse

TEXTS = [
    "# T\n\npara *em*\n\n- a\n- b\n\n[x]\n\n[x]: /u\n",
    "| a | b |\n|---|---|\n| 1 | 2 |\n\n> q\n> r\n\n```\ncode\n```\nend",
    "a\r\nb\rc\n\n[^n] text\n\n[^n]: note\n    more\n\n:::d[l]\nin\n:::\n$$\nx\n$$\n",
    "one\n===\ntwo **bold",
]


def splits(data, rng):
    yield [data[i : i + 1] for i in range(len(data))]
    yield data.splitlines(keepends=True)
    for _ in range(3):
        cuts = sorted(rng.randrange(len(data) + 1) for _ in range(6))
        yield [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True)]


@pytest.mark.parametrize("text", TEXTS)
def test_laws_of_append(text):
    rng = random.Random(7)
    for chunks in splits(text.encode(), rng):
        chain, ever = Chain(), set()
        ever.update(i for i, _ in chain.identities())
        for chunk in chunks:
            before = dict(chain.identities())
            parsed = chain.append(chunk)
            assert dump(parsed.root) == dump(parse(chain.data).root)
            now = chain.identities()
            ids = [i for i, _ in now]
            assert len(set(ids)) == len(ids)
            for i, revision in now:
                assert revision <= chain.revision
                if i in before:
                    assert revision >= before[i]
                else:
                    assert i not in ever  # ids never come back
            ever.update(ids)
            if not chunk:
                assert ids == list(before)


def test_identity_is_kept():
    chain = Chain(b"# A\n\nfirst\n\n")
    before = chain.identities()
    chain.append(b"second\n")
    after = dict(chain.identities())
    assert [i for i, _ in before] == list(after)[: len(before)]
    assert after[before[0][0]] == chain.revision
    assert all(after[i] == r for i, r in before[1:])


def test_revision_moves_up_to_the_root():
    chain = Chain(b"- a\n- b")
    ids = [i for i, _ in chain.identities()]
    chain.append(b"c")
    now = dict(chain.identities())
    assert [i for i, _ in chain.identities()] == ids
    changed = [i for i in ids if now[i] == chain.revision]
    assert len(changed) == 5  # document, list, second item, its paragraph and text


def test_stale_writers_are_refused():
    chain = Chain(b"a")
    at = chain.revision
    chain.append(b"b", at)
    with pytest.raises(Superseded):
        chain.append(b"c", at)
    assert chain.data == b"ab"


def kept(names):
    return [Kept(0, 0, "Text", n.encode(), n.encode(), []) for n in names]


def test_alignment_is_a_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(9)))
        b = "".join(rng.choice("abc") for _ in range(rng.randrange(9)))
        pairs = _aligned(kept(a), kept(b))
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert len(pairs) == table[-1][-1]
        every = _pairs(kept(a), kept(b))
        assert len({i for i, _ in every}) == len(every) == len({j for _, j in every})


def test_append_operators(spark, tmp_path):
    from pyspark.sql import functions as F

    from inkstrata.streaming.append import append_batch, append_stream

    rows = [(c, s, f"part {s} of *{c}*\n\n".encode()) for c in (1, 2) for s in range(4)] + [(2, 2, b"late"), (3, 0, None)]
    chunks = spark.createDataFrame(rows, "chain_id long, seq long, chunk binary").withColumn("kind", F.lit("clash"))
    got = {r.chain_id: r for r in append_batch(chunks).collect()}
    assert (got[1].chunks, got[1].refused, got[1].whole) == (4, 0, True)
    assert got[2].refused == 1 and got[3].doc_revision == 2

    folder = str(tmp_path / "in")
    for k in range(4):
        chunks.where(F.col("seq") == k).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    run = append_stream(stream).writeStream.format("memory").queryName("grown").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    last = spark.sql("select * from grown where chain_id = 1 and seq = 3").toPandas().sort_values("ord")
    whole = Chain(b"")
    for _, s, chunk in rows[:4]:
        whole.append(chunk)
    assert list(zip(last.node_id, last.last_changed_rev, strict=True)) == whole.identities()
    assert last.kind.tolist()[:3] == ["Document", "Paragraph", "Text"]


PARTS = (
    "para a|\n|\n\n|- x\n|1. y\n|# h\n|> q\n|[a]: /u\n|[b]: /v 't'\n|    code\n|[a] [b] [c]\n|[c]: <z>\n|```\n|===\n|---\n|[^n]: t\n| [^n]|\r|\r\n|\0|<div>\n|:::d\n|:::\n|$$\n|"
    "  [b]: /w\n|     [c]: /q\n|2. z\n|\t[a]: /t\n|:x{bad=}\n|*em|*| 'title'\n|text\n"
).split("|") + ["|a|b|\n", "|-|-|\n"]


def test_any_chunks_give_the_tree_of_the_whole():
    rng = random.Random(12)
    for _ in range(600):
        chain = Chain()
        for _ in range(rng.randrange(1, 9)):
            grown = chain.append("".join(rng.choices(PARTS, k=rng.randrange(4))).encode())
            fresh = parse(chain.data)
            assert dump(grown.root) == dump(fresh.root), chain.chunks
            assert sorted(grown.diagnostics) == sorted(fresh.diagnostics), chain.chunks


def test_late_definitions_turn_only_their_units():
    chain = Chain()
    for i in range(200):
        chain.append(b"about [x%d] and *this*\n\n" % (i % 50))
    before = dict(chain.identities())
    scanned, scan = [], chain.document._scan
    chain.document._scan = lambda block, place: (scanned.append(place), scan(block, place))
    chain.append(b"[x7]: /u\n")
    assert sum(place is not None for place in scanned) <= 4 + 2
    assert dump(chain.document.root) == dump(parse(chain.data).root)
    after = dict(chain.identities())
    assert len(set(before) & set(after)) >= len(before) - 4 * 2
    turned = [i for i, r in after.items() if i in before and r == chain.revision]
    assert 4 <= len(turned) <= 1 + 4 * 4


def test_an_append_costs_its_own_length():
    def cost(n):
        chain, calls = Chain(), [0]
        for i in range(n):
            chain.append(b"Some **prose** number %d.\n\n" % i)
        scan = chain.document._scan
        chain.document._scan = lambda block, place: (calls.__setitem__(0, calls[0] + 1), scan(block, place))
        for i in range(10):
            chain.append(b"More of it %d.\n\n" % i)
        return calls[0]

    assert cost(20) == cost(400) <= 40


def test_a_restored_chain_goes_on():
    chain = Chain(b"a\n\n[b]\n\nc")
    again = pickle.loads(pickle.dumps(chain))
    for x in (chain, again):
        x.append(b" more\n\n[b]: /u\n")
    assert again.identities() == chain.identities() and dump(again.document.root) == dump(chain.document.root)


def test_words_are_taken_without_the_machine(monkeypatch):
    """Chunks of plain words cost no parse, and give the tree and the identities that a parse of each gives."""
    from inkstrata.core import append

    made = []

    class Counted(append.Machine):
        def __init__(self, options):
            made.append(1)
            super().__init__(options)

    monkeypatch.setattr(append, "Machine", Counted)
    rng, pieces = random.Random(3), [b"order", b" 12", b" 7\n\n", b"\n", b"\n\n", b"way x\n\ny", b"", b"*e*\n\n", b" "]
    for case in range(60):
        chunks = [rng.choice(pieces[:6] if case % 2 else pieces) for _ in range(40)]
        fast, slow = Chain(), Chain()
        slow.document.words = lambda chunk: None
        for k, chunk in enumerate(chunks):
            fast.append(chunk), slow.append(chunk)
            assert fast.identities() == slow.identities()
            if k % 7 == case % 7:
                assert dump(fast.document.root) == dump(slow.document.root) == dump(parse(fast.data).root)
    made.clear()
    chain = Chain()
    for k in range(100):
        chain.append(b"order"), chain.append(b" %d\n\n" % k)
    assert len(made) == 1 and dump(chain.document.root) == dump(parse(chain.data).root)


def test_chains_of_a_table_need_no_frame_each(spark):
    from inkstrata.streaming.append import append_batch, append_nodes

    chunks = spark.createDataFrame([(c, s, b"a%d\n\n" % s) for c in range(5) for s in range(4)] + [(1, 2, b"late")], "chain_id long, seq long, chunk binary")
    for found in (append_batch(chunks), append_nodes(chunks)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan
    assert {(r.chain_id, r.chunks, r.refused, r.whole) for r in append_batch(chunks).collect()} == {(c, 4, int(c == 1), True) for c in range(5)}


def test_same_is_equality_of_dumps():
    from inkstrata.core.document import same

    trees = [parse(x.encode()).root for x in [*TEXTS, "", "a", "b", "a\n", " a", "a\n\nb", "- a\n- b", "- a\n\n- b", "a *b*", "a *b* c", "> a", "> a\n> b"]]
    for a in trees:
        for b in trees:
            assert same(a, b) == (dump(a) == dump(b))
