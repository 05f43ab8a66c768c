"""Benchmark decontamination by spaced seeds: fixed masks ignore chosen word positions, so that passages with replaced
words still share a seed; every shared seed is extended to its whole aligned item and verified.

A document leaks an item if, at some fixed shift between them, a window of ``WINDOW`` item words (the whole item if
shorter) has at least ``EQUAL_PERCENT`` percent equal words. Words are lower-cased runs without ASCII white space.
The masks of an item's length reach every such window, so no leak is lost; items of one to four words have to stand
there whole. A one-word item is leaked by every document with that word: leave such items out of the benchmark.
Only DataFrame functions are used; the corpus itself is not shuffled, only its verified hits are.

Defined results: null and empty texts leak nothing and are no items; very long texts and items are compared whole;
repeated rows of an item or a document count once; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelcohort.llm import units
from voxelcohort.session import cut_lineage, scratch_path

WINDOW = 20
EQUAL_PERCENT = 80
# Word offsets that each mask compares (fixed values), by the fewest words of the items they serve. Each family meets
# every pattern of replaced words that EQUAL_PERCENT allows in the windows of its items.
FAMILIES = {
    1: ((0,),),
    2: ((0, 1),),
    3: ((0, 1, 2),),
    4: ((0, 1, 2, 3),),
    5: ((0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4)),
    10: ((0, 1, 3, 6, 7), (0, 1, 4, 5, 6), (0, 2, 3, 5, 7)),
    15: ((0, 1, 2, 3, 5, 6), (0, 1, 2, 4, 8, 9), (0, 2, 10, 11, 12, 13)),
}
# Seeds of the benchmark are broadcast up to this number (20 bytes each), and then its items too: an item's words are
# fewer than its seeds and 14. Beyond it both joins shuffle.
BROADCAST_SEEDS = 1_000_000
WHITE = " \t\n\x0b\x0c\r"


def family_of(words: int) -> int:
    """The key in ``FAMILIES`` of items of so many words."""
    return max(k for k in FAMILIES if k <= words)


def word_hashes(text: Column) -> Column:
    words = F.split(F.btrim(F.lower(text), F.lit(WHITE)), r"[\x20\x09-\x0D]+")
    return F.transform(words, lambda w: F.xxhash64(w))


def _hashed(rows: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """(key, name): the word hashes of every text that has a word."""
    return rows.filter(F.col(text).cast("string").rlike(r"[^\x20\x09-\x0D]")).select(key, word_hashes(F.col(text).cast("string")).alias(name))


def _seed_rows(hashed: DataFrame, keep: list[str], hashes: str, at: str, families: list[int], own: Column | None = None) -> DataFrame:
    """One row (keep, at, _seed) for each mask of ``families`` and position; ``own`` names the only family of a row."""
    def seeds(family: int, number: int, mask: tuple[int, ...]) -> Column:
        fits = F.size(hashes) > mask[-1]
        every = F.sequence(F.lit(0), F.greatest(F.size(hashes) - mask[-1] - 1, F.lit(0)))
        named = lambda i: F.xxhash64(F.lit(family * 10 + number), *[F.get(F.col(hashes), i + k) for k in mask])
        return F.when(fits if own is None else fits & (own == family), F.transform(every, named))

    masks = F.array(*[seeds(f, n, mask) for f in families for n, mask in enumerate(FAMILIES[f])])
    return hashed.select(*keep, F.explode(masks).alias("_m")).select(*keep, F.posexplode("_m").alias(at, "_seed"))


def leaks(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """(doc, item, doc_start, equal_words, window_words, item_words): the best alignment of each leaked pair.

    ``doc_start`` is the word of the document under the item's first word (negative if the item starts before it).
    Ties go to the smaller start.
    """
    own = F.greatest(*[F.when(F.size("_item") >= k, F.lit(k)).otherwise(0) for k in FAMILIES])
    items = cut_lineage(
        _hashed(benchmark.filter(F.col(item).isNotNull()), item, text, "_item").distinct()
        .withColumn("_n", F.monotonically_increasing_id()).withColumn("_family", own))
    families = sorted(r[0] for r in items.select("_family").distinct().collect()) or [min(FAMILIES)]
    seeds = _seed_rows(items, ["_n", "_family"], "_item", "_item_at", families, F.col("_family")).drop("_family")
    small = seeds.limit(BROADCAST_SEEDS + 1).count() <= BROADCAST_SEEDS
    corpus = _hashed(docs, doc, text, "_doc")
    start = (F.col("_at") - F.col("_item_at")).alias("_start")
    if small:
        found = _seed_rows(corpus, [doc, "_doc"], "_doc", "_at", families).join(F.broadcast(seeds), "_seed").select(doc, "_n", start, "_doc")
        met = found.join(F.broadcast(items), "_n")
    else:  # only ids and seeds are shuffled, then the hashes of documents that share one
        found = _seed_rows(corpus.select(doc, "_doc"), [doc, "_doc"], "_doc", "_at", families).select(doc, "_at", "_seed")
        met = found.join(seeds, "_seed").select(doc, "_n", start).distinct().join(items, "_n").join(corpus, doc)
    under = lambda i: F.get(F.col("_doc"), F.when(i + F.col("_start") >= 0, i + F.col("_start")))
    window = F.least(F.lit(WINDOW), F.size("_item"))
    # "1" for every item word that stands at its place in the document, "0" for the others; one row for each shift
    equal = F.array_join(F.transform(F.col("_item"), lambda w, i: F.when(w == under(i), "1").otherwise("0")), "")
    # the aggregate keeps the comparison out of the filters below, which would repeat it for every seed of a shift
    aligned = (
        met.select(doc, item, "_start", window.alias("window_words"), F.size("_item").alias("item_words"), equal.alias("_equal"))
        .groupBy(doc, item, "_start", "window_words", "item_words").agg(F.max("_equal").alias("_equal"))
    )
    ones = lambda flags: F.length(F.replace(flags, F.lit("0"), F.lit("")))
    best = F.array_max(F.transform(
        F.sequence(F.lit(1), F.col("item_words") - F.col("window_words") + 1), lambda s: ones(F.substring("_equal", s, F.col("window_words")))))
    enough = lambda n: n * 100 >= F.col("window_words") * EQUAL_PERCENT
    verified = aligned.filter(enough(ones(F.col("_equal")))).withColumn("equal_words", best).filter(enough(F.col("equal_words")))
    ranked = verified.groupBy(doc, item).agg(F.min(F.struct(
        (-F.col("equal_words")).alias("less"), F.col("_start").alias("doc_start"), "equal_words", "window_words", "item_words")).alias("best"))
    return ranked.select(doc, item, "best.doc_start", "best.equal_words", "best.window_words", "best.item_words")


def without_leaks(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that leak an item; texts are written once to the shared folder and not shuffled.

    Rows of null or empty text and rows without an id stay; repeated rows stay or go together; all columns are kept.
    """
    held = units.hold(docs, doc, text, scratch_path(docs.sparkSession, "leaks"), whole=True)
    found = cut_lineage(leaks(held.select("rid", "text"), benchmark, doc="rid").select("rid").distinct())
    return units.without(held, found, docs.columns)


_WORDS_SQL = "string_split_regex(trim(lower(text), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\\x20\\x09-\\x0D]+')"

# The rule alone, without seeds: equal words of every shift, then the best window among those that start at an equal word.
OP10_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS dr, * FROM (SELECT DISTINCT doc_id, {_WORDS_SQL} AS w FROM documents)),
b AS (SELECT row_number() OVER () AS br, * FROM (SELECT DISTINCT item_id, {_WORDS_SQL} AS w FROM benchmark WHERE item_id IS NOT NULL)),
dw AS (SELECT dr, unnest(w) AS word, generate_subscripts(w, 1) AS at_word FROM d),
bw AS (SELECT br, least({WINDOW}, len(w)) AS window_words, unnest(w) AS word, generate_subscripts(w, 1) AS at_word FROM b),
shifts AS (
  SELECT dr, br, window_words, dw.at_word - bw.at_word AS doc_start, list(bw.at_word) AS hits FROM dw JOIN bw USING (word) WHERE word <> ''
  GROUP BY ALL HAVING count(*) * 100 >= window_words * {EQUAL_PERCENT}
), scored AS (
  SELECT *, list_max(list_transform(hits, lambda s: len(list_filter(hits, lambda p: p >= s AND p < s + window_words)))) AS equal_words FROM shifts
), ranked AS (
  SELECT doc_id, item_id, doc_start, equal_words, window_words, len(b.w) AS item_words,
    row_number() OVER (PARTITION BY doc_id, item_id ORDER BY equal_words DESC, doc_start) AS rn
  FROM scored JOIN d USING (dr) JOIN b USING (br) WHERE equal_words * 100 >= window_words * {EQUAL_PERCENT}
)
SELECT doc_id, item_id, CAST(doc_start AS INT) AS doc_start, CAST(equal_words AS INT) AS equal_words, CAST(window_words AS INT) AS window_words,
  CAST(item_words AS INT) AS item_words FROM ranked WHERE rn = 1
"""
