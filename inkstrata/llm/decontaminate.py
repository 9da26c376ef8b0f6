"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations only.

1. `build_index` goes over the corpus once and stores its postings as Parquet: (term, doc_id, hash, pos), with `hash` of id
   and text, so that rows which share an id, or have none, stay apart. A benchmark whose words are few enough to broadcast
   has only their postings stored; beyond that every word's are, from the same single pass.
2. Frequencies are summed from the index. In each window of an item (WINDOW consecutive words; a shorter item is one
   window) the terms are ranked from the rarest on; a window with a word that the corpus lacks can't occur.
3. `phrase_matches` takes the list of each window's rarest term, adjusted by the term's offset in the item, and intersects
   it with the list of the second rarest at its own offset. What is left is nearly all true: its neighbourhood in the item
   (WINDOW - 1 words on either side) is intersected with the lists of all its terms, and runs of WINDOW offsets that follow
   each other are exact occurrences.
4. `proximity_matches` asks for a weaker agreement: of the NEAR_TERMS rarest terms of each block of WINDOW words of an item,
   all but NEAR_MISSING within SPAN words of a text, in any order.

Scale: texts are tokenised once and never shuffled; the index has some 4 bytes a token. Lists are joined by term where the
terms are shown to be few (rows and bytes), else by a shuffle that deals hot terms over several tasks. Candidates carry
numbers and one term, never an item's words, so an item of n words costs n. Hits are those of the row.

Defined results: null or empty texts have no words and no hits. Null item ids and items without words are no items.
Equal texts under several item ids all count. Rows that share a doc_id each get a row with their own hits. An empty
benchmark gives n_hit 0 everywhere, an empty corpus no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstrata.llm._common import is_small, join_bounded, join_salted, lower_ascii, shared_dir, stored, table

WINDOW = 13
#: Contaminated from n_hit / n_words = 1 / CONTAMINATED on.
CONTAMINATED = 20
#: Proximity: terms of a block, how many of them may be missing, and within how many words the others must stand.
NEAR_TERMS, NEAR_MISSING, SPAN = 4, 1, 2 * WINDOW
MAX_BROADCAST = 200_000
#: Rows of the corpus whose hashes (16 bytes each) are broadcast.
MAX_ROWS = 2_000_000
#: No word, as it is a separator; the term of the postings that hold lengths.
LENGTH = " "
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Array of the words of a text, in order."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item, words, n, item_ids): the distinct word sequences of a benchmark, numbered, and the ids that have each; stored."""
    split = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("words"))
    each = split.where(F.size("words") > 0).groupBy("words").agg(F.collect_set("item_id").alias("item_ids"))
    return stored(each.select(F.monotonically_increasing_id().alias("item"), "words", F.size("words").alias("n"), "item_ids"), "items")


def build_index(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Stored postings (term, doc_id, hash, pos) of `docs` (doc_id, text), and one of LENGTH per row, whose pos is its number of words.

    With `terms` (term) of few enough rows only theirs are stored.
    """
    spark, path = docs.sparkSession, shared_dir(docs.sparkSession, "postings")
    marked = F.concat(words(F.col("text")), F.array(F.lit(LENGTH)))
    postings = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("hash"), F.posexplode(marked).alias("pos", "term"))
    if terms is not None and is_small(terms, MAX_BROADCAST):
        wanted = terms.select("term").unionByName(spark.createDataFrame([(LENGTH,)], "term string"))
        postings = postings.join(F.broadcast(wanted), "term", "left_semi")
    postings.select("term", "doc_id", "hash", "pos").write.parquet(path)
    return spark.read.schema("term string, doc_id long, hash long, pos int").parquet(path)


def lists(index: DataFrame, asked: DataFrame) -> DataFrame:
    """The postings of the terms in `asked` (term, ...), with its other columns."""
    postings = index.where(F.col("term") != LENGTH)
    if is_small(asked, MAX_BROADCAST):
        return postings.join(F.broadcast(asked), "term")
    return join_salted(postings, asked, "term", F.struct("hash", "pos"))


def present(index: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of `asked` (term, doc_id, hash, pos, ...) whose posting the index has."""
    postings = index.where(F.col("term") != LENGTH).withColumnRenamed("doc_id", "_doc")
    same = F.col("_doc").eqNullSafe(F.col("doc_id"))
    if is_small(asked, MAX_BROADCAST):
        return postings.join(F.broadcast(asked), ["term", "hash", "pos"]).where(same).drop("_doc").distinct()
    postings = join_bounded(postings, asked.select("term").distinct(), "term", "left_semi", MAX_BROADCAST)
    postings = join_bounded(postings, asked.select("hash").distinct(), "hash", "left_semi", MAX_ROWS)
    return asked.join(postings, ["term", "hash", "pos"]).where(same).drop("_doc").distinct()


def frequencies(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, freq) of the given terms in the corpus, 0 for those that it lacks; stored."""
    counted = index.where(F.col("term") != LENGTH).groupBy("term").agg(F.count("*").alias("freq"))
    return stored(terms.join(counted, "term", "left").select("term", F.coalesce("freq", F.lit(0)).alias("freq")), "frequencies")


def item_terms(items: DataFrame, freq: DataFrame) -> DataFrame:
    """(item, n, off, term, freq): every word of every item; stored."""
    placed = items.select("item", "n", F.posexplode("words").alias("off", "term"))
    return stored(join_bounded(placed, freq, "term", "inner").select("item", "n", "off", "term", "freq"), "item-terms")


def rarest_pairs(terms: DataFrame) -> DataFrame:
    """(term, item, off, term2, off2): the rarest and the second rarest term of each window that can occur, once per place."""
    at = F.array_sort(F.collect_list(F.struct("off", "freq", "term")))
    starts = F.sequence(F.lit(1), F.greatest(F.col("n") - WINDOW + 1, F.lit(1)))
    ranked = F.transform(starts, lambda s: F.slice(F.array_sort(F.transform(F.slice("at", s, WINDOW), lambda x: F.struct(x.freq.alias("freq"), x.off.alias("off"), x.term.alias("term")))), 1, 2))
    windows = terms.groupBy("item", "n").agg(at.alias("at")).select("item", F.explode(ranked).alias("r"))
    first, second = F.col("r")[0], F.get("r", F.lit(1))
    return windows.where(first.freq > 0).select(first.term.alias("term"), "item", first.off.alias("off"), second.term.alias("term2"), second.off.alias("off2")).distinct()


def phrase_matches(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(item, doc_id, hash, lo, hi): word positions of exact occurrences of windows of the items' words `terms`."""
    row = ["item", "doc_id", "hash", "base"]
    pairs = stored(rarest_pairs(terms), "pairs")
    found = lists(index, pairs).select("item", "doc_id", "hash", (F.col("pos") - F.col("off")).alias("base"), "off", F.col("term2").alias("term"), "off2")
    found = stored(found, "rarest")
    both = present(index, found.where("term is not null").withColumn("pos", F.col("base") + F.col("off2")).drop("off2"))
    kept = both.select(*row, "off").unionByName(found.where("term is null").select(*row, "off"))
    around = F.explode(F.sequence(F.greatest(F.col("off") - WINDOW + 1, F.lit(0)), F.col("off") + WINDOW - 1)).alias("off")
    wanted = join_bounded(kept.select(*row, around).distinct(), terms, ["item", "off"], "inner", MAX_BROADCAST)
    wanted = stored(wanted.select(*row, "n", "off", "term", (F.col("base") + F.col("off")).alias("pos")), "wanted")
    run = F.expr("off - row_number() over (partition by item, doc_id, hash, base order by off)")
    runs = present(index, wanted).select(*row, "n", "off", run.alias("run")).groupBy(*row, "n", "run").agg(F.min("off").alias("off"), F.count("*").cast("int").alias("size"))
    low = F.col("base") + F.col("off")
    return runs.where(F.col("size") >= F.least(F.lit(WINDOW), F.col("n"))).select("item", "doc_id", "hash", low.alias("lo"), (low + F.col("size") - 1).alias("hi"))


def proximity_matches(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(item, doc_id, hash, block, pos, n_near): places where enough of the rarest terms of an item's block end within SPAN words.

    Blocks are WINDOW words from the item's start on; what is left over belongs to the last one.
    """
    last = F.greatest(F.floor(F.col("n") / WINDOW) - 1, F.lit(0))
    block = F.least(F.floor(F.col("off") / WINDOW), last).cast("int").alias("block")
    each = terms.select("item", block, "term", "freq", "off").groupBy("item", "block", "term").agg(F.min("freq").alias("freq"), F.min("off").alias("off"))
    rank = F.expr("row_number() over (partition by item, block order by freq, off) - 1").alias("rank")
    chosen = each.select("item", "block", "term", rank).where(F.col("rank") < NEAR_TERMS)
    chosen = stored(chosen.withColumn("n_terms", F.expr("count(*) over (partition by item, block)").cast("int")), "near-terms")
    within = F.expr(f"bit_or(bit) over (partition by item, block, doc_id, hash order by pos range between {SPAN - 1} preceding and current row)")
    hits = lists(index, chosen).select("item", "block", "doc_id", "hash", "pos", "n_terms", F.expr("shiftleft(1, rank)").alias("bit"))
    near = hits.select("item", "doc_id", "hash", "block", "pos", "n_terms", F.bit_count(within).alias("n_near"))
    need = F.least(F.col("n_terms"), F.lit(NEAR_TERMS - NEAR_MISSING))
    return near.where(F.col("n_near") >= need).drop("n_terms")


def contamination(docs: DataFrame, benchmark: DataFrame, near: bool = False) -> DataFrame:
    """One row per row of `docs` (doc_id, text): hash, n_words, n_hit, n_items, items_sha256, contaminated.

    With `near` also n_near_items, the number of items that have a proximity match.
    """
    items = items_of(benchmark)
    vocabulary = stored(items.select(F.explode("words").alias("term")).distinct(), "terms")
    index = build_index(docs, vocabulary)
    terms = item_terms(items, frequencies(index, vocabulary))
    hits = stored(phrase_matches(index, terms), "hits")

    # words inside any run: each run adds what lies beyond the furthest end so far
    so_far = "max(hi) over (partition by doc_id, hash order by lo, hi rows between unbounded preceding and 1 preceding)"
    spans = hits.select("doc_id", "hash", "lo", "hi").distinct().withColumn("last", F.expr(so_far))
    n_hit = F.sum(F.greatest(F.lit(0), F.col("hi") - F.greatest(F.col("lo") - 1, F.coalesce("last", F.lit(-1))))).alias("n_hit")
    item_ids = items.select("item", F.explode("item_ids").alias("item_id"))

    def ids_of(found: DataFrame) -> DataFrame:
        return join_bounded(found.select("doc_id", "hash", "item").distinct(), item_ids, "item", "inner").groupBy("doc_id", "hash")

    listed = ids_of(hits).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    out = index.where(F.col("term") == LENGTH).select("doc_id", "hash", F.col("pos").cast("long").alias("n_words"))
    found = [spans.groupBy("doc_id", "hash").agg(n_hit), listed]
    if near:
        found.append(ids_of(proximity_matches(index, terms)).agg(F.count("*").alias("n_near_items")))
    for k, more in enumerate(found):
        more = more.withColumnsRenamed({"doc_id": f"_doc{k}", "hash": f"_hash{k}"})
        out = out.join(more, (F.col("hash") == F.col(f"_hash{k}")) & F.col("doc_id").eqNullSafe(F.col(f"_doc{k}")), "left")
    n = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id", "hash", "n_words", n.alias("n_hit"), F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        ((n > 0) & (n * CONTAMINATED >= F.col("n_words"))).alias("contaminated"),
        *([F.coalesce("n_near_items", F.lit(0)).cast("long").alias("n_near_items")] if near else []),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"), near=True).drop("hash")


def keep(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of `docs` in which no window of any benchmark item occurs, however long the text is."""
    found = contamination(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")).where("n_hit > 0")
    dirty = stored(found.select(F.col("doc_id").alias("dirty_id"), F.col("hash").alias("dirty_hash")).distinct(), "contaminated")
    hashed = docs.withColumn("_hash", F.xxhash64("doc_id", "text"))
    same = (hashed._hash == dirty.dirty_hash) & hashed.doc_id.eqNullSafe(dirty.dirty_id)
    return join_bounded(hashed, dirty, same, "left_anti", 2_000_000).drop("_hash")


_SQL_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = f"""
with d as (select doc_id, {_SQL_WORDS} as w from documents),
b as (select item_id, {_SQL_WORDS} as w from benchmark where item_id is not null),
win as (
  select distinct item_id, least(len(w), {WINDOW}) as k, list_slice(w, s, s + least(len(w), {WINDOW}) - 1) as g
  from (select item_id, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) as s from b where len(w) > 0)
),
grams as (
  select doc_id, p, k, list_slice(w, p, p + k - 1) as g
  from (select doc_id, w, unnest(range(1, len(w) + 1)) as p from d), (select distinct k from win) where p + k - 1 <= len(w)
),
hits as (select doc_id, item_id, p, k from grams join win using (k, g)),
n_hit as (select doc_id, count(*) as n from (select distinct doc_id, unnest(range(p, p + k)) as i from hits) group by doc_id),
found as (
  select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items
  from (select distinct doc_id, cast(item_id as varchar) as item_id from hits) group by doc_id
),
freq as (select term, count(*) as freq from (select unnest(w) as term from d) group by term),
block_terms as (
  select item_id, block, term, min(off) as off from (
    select item_id, off, least(off // {WINDOW}, greatest(len(w) // {WINDOW} - 1, 0)) as block, w[off + 1] as term
    from (select item_id, w, unnest(range(0, len(w))) as off from b)) group by all
),
chosen as (
  select item_id, block, term, k, count(*) over (partition by item_id, block) as n_terms from (
    select item_id, block, t.term, row_number() over (partition by item_id, block order by coalesce(freq, 0), off) - 1 as k
    from block_terms t left join freq using (term)) where k < {NEAR_TERMS}
),
places as (select doc_id, p, w[p + 1] as term from (select doc_id, w, unnest(range(0, len(w))) as p from d) where w[p + 1] in (select term from chosen)),
near as (
  select doc_id, count(distinct item_id) as n_near from (
    select doc_id, item_id, n_terms, bit_count(bit_or(1 << k) over (partition by item_id, block, doc_id order by p range between {SPAN - 1} preceding and current row)) as n
    from places join chosen using (term)) where n >= least(n_terms, {NEAR_TERMS - NEAR_MISSING}) group by doc_id
)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n, 0) > 0 and {CONTAMINATED} * coalesce(n, 0) >= len(w) as contaminated,
  cast(coalesce(n_near, 0) as bigint) as n_near_items
from d left join n_hit using (doc_id) left join found using (doc_id) left join near using (doc_id)
"""
