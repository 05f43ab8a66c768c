"""Spelling variants: words of a corpus that differ by one letter, found by products of letter counts.

Words are cut into blocks by length and by how many of their letters fall into each of a few letter groups. One inserted
letter leads to the next length and raises one group; one replaced letter keeps the length and at most moves one letter
between groups. So near words lie in the same or in adjacent blocks, and each word visits the few blocks above its own.
Blocks are dealt into tiles of bounded size. A tile meets its visitors part by part: one NumPy product of letter-count
matrices gives all squared distances, and pairs at distance two (equal lengths) or one (adjacent lengths) are verified
letter by letter. More words make more letter groups, so blocks stay small; the result does not depend on their number.

Defined results: null texts and texts without words hold none; very long texts are read whole, in parts cut between words;
repeated rows count again; of near words equally often, the one first in code-point order is the form; empty tables give
empty results; other columns are ignored. Words are runs of ``A-Za-z`` and U+00C0 to U+00FF, of which only A-Z are
lower-cased.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelcohort.session import cut_lineage

LEAST_LENGTH = 5
LEAST_COUNT = 3
TILE = 2_048
TILE_BYTES = 4_194_304
# Letter groups: the fewest, and one more for every so many times more words.
FEWEST_GROUPS, FIRST_WORDS, GROUP_STEP = 3, 20_000, 8
PART_BYTES = 1_048_576
HELD_WORDS = 400_000

_LETTER = bytes([*range(65, 91), *range(97, 123), *range(0xC0, 0x100)])
_CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if b in _LETTER else 32 for b in range(256))
_KINDS = np.zeros(256, dtype=np.int64)
_KINDS[[*range(97, 123), *range(0xC0, 0x100)]] = np.arange(90)
N_KINDS = 90
# Letters in about the order of their frequency, dealt round to the groups (any order is right).
_ORDER = list(b"etaoinshrdlcumwfgypbvkjxqz") + list(range(0xC0, 0x100))


def runs(text: str):
    """Lower-cased letter runs of one text as Latin-1 bytes, in lists of about ``PART_BYTES``.

    Latin-1 holds every letter; any other character becomes "?" and, like everything else, a gap.
    """
    raw = text.encode("latin-1", "replace").translate(_CLEAN)
    start = 0
    while start < len(raw):
        end = raw.find(b" ", start + PART_BYTES)
        end = len(raw) if end < 0 else end
        yield raw[start:end].split()
        start = end


def spoil(start: int, word: bytes, every: int) -> bytes:
    """The word as one document writes it: where ``every`` divides the checksum of the document's name, whose own is
    ``start``, and the word, one letter is missing."""
    check = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
    return word if check % every else word[:check % len(word)] + word[check % len(word) + 1:]


def word_counts(docs: DataFrame, doc: str = "doc_id", text: str = "text", every: int | None = None, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of words with ``LEAST_LENGTH`` letters and more that occur ``least`` times, spoilt where ``every`` is set."""

    def counted(batches):
        total: Counter = Counter()

        def emptied():
            words = pa.array([w.decode("latin-1") for w in total], pa.string())
            out = pa.RecordBatch.from_arrays([words, pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for name, body in zip(batch.column(0), batch.column(1)):
                start, own = zlib.crc32(f"{name.as_py()}:".encode()), Counter()
                for part in runs(body.as_py() or ""):
                    own.update(part)
                for word, n in own.items():
                    kept = spoil(start, word, every) if every else word
                    if len(kept) >= LEAST_LENGTH:
                        total[kept] += n
                if len(total) > HELD_WORDS:
                    yield emptied()
        yield emptied()

    found = docs.select(F.col(doc).alias("d"), F.col(text).cast("string").alias("t")).mapInArrow(counted, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _homes(words: DataFrame, groups: int) -> DataFrame:
    """(word, n, size, block) with ``block`` the counts of letters in each group; ``size`` is their sum."""
    group_of = np.zeros(256, dtype=np.int64)
    group_of[_ORDER] = np.arange(len(_ORDER)) % groups

    def placed(batches):
        for batch in batches:
            raw = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
            size = np.array([len(w) for w in raw], dtype=np.int64)
            row = np.repeat(np.arange(len(raw)), size)
            flat = group_of[np.frombuffer(b"".join(raw), dtype=np.uint8)]
            block = np.bincount(row * groups + flat, minlength=len(raw) * groups).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(block) + 1, groups), pa.int32()), pa.array(block))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size.astype(np.int32)), lists], names=["word", "n", "size", "block"])

    return words.select("word", "n").mapInArrow(placed, "word string, n long, size int, block array<int>")


def _steps(groups: int) -> list[list[int]]:
    """From a block to itself and to the adjacent blocks above it: a letter more, or a letter moved to a later group."""
    unit = np.eye(groups, dtype=int)
    moved = [unit[j] - unit[i] for j in range(groups) for i in range(j)]
    return [[0] * groups, *[u.tolist() for u in unit], *[m.tolist() for m in moved]]


class Side:
    """Equally long words with their counts of occurrences, as bytes, letters and letter counts."""

    def __init__(self, words: list[str], n: list[int]):
        raw = [w.encode("latin-1") for w in words]
        size = len(raw[0])
        self.words, self.n = words, np.array(n, dtype=np.int64)
        self.letters = np.frombuffer(b"".join(raw), dtype=np.uint8).reshape(len(raw), size)
        self.names = self.letters.view(f"S{size}").ravel()  # Latin-1 bytes sort like code points
        row = np.repeat(np.arange(len(raw)), size)
        exact = np.float32 if size < 1_000 else np.float64  # squares must stay whole numbers
        self.counts = np.bincount(row * N_KINDS + _KINDS[self.letters.ravel()], minlength=len(raw) * N_KINDS).reshape(-1, N_KINDS).astype(exact)
        self.squares = (self.counts * self.counts).sum(axis=1)


def near_pairs(left: Side, right: Side) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) one edit apart; words of ``right`` are as long as those of ``left`` or one letter longer. Within one
    side, i < j."""
    n, m = left.letters.shape[1], right.letters.shape[1]
    # |a|^2 + |b|^2 - 2ab = wanted, in one pass over the product
    product = left.counts @ right.counts.T
    product *= 2
    product -= left.squares[:, None]
    product -= right.squares[None, :]
    at = np.flatnonzero(product.ravel() == (-2 if n == m else -1))
    i, j = np.divmod(at, len(right.words))
    if left is right:
        i, j = i[i < j], j[i < j]
    near = np.zeros(len(i), dtype=bool)
    step = max(1, TILE_BYTES // m)
    for begin in range(0, len(i), step):
        p, q = left.letters[i[begin:begin + step]], right.letters[j[begin:begin + step]]
        if n == m:
            near[begin:begin + step] = (p != q).sum(axis=1) == 1
        else:
            ahead = np.logical_and.accumulate(p == q[:, :n], axis=1).sum(axis=1)
            behind = np.logical_and.accumulate(p[:, ::-1] == q[:, :0:-1], axis=1).sum(axis=1)
            near[begin:begin + step] = ahead + behind >= n
    return i[near], j[near]


def _best(at: np.ndarray, of: np.ndarray, own: Side, other: Side) -> pa.RecordBatch:
    """(word, k, best_n, best) of each word ``own[at]``: its near words ``other[of]`` counted, the most frequent one kept."""
    order = np.lexsort((other.names[of], -other.n[of], at))
    at, of = at[order], of[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else at
    k = np.diff(np.append(first, len(at)))
    return pa.RecordBatch.from_arrays(
        [pa.array([own.words[x] for x in at[first]], pa.string()), pa.array(k.astype(np.int64)), pa.array(other.n[of[first]]), pa.array([other.words[x] for x in of[first]], pa.string())],
        names=["word", "k", "best_n", "best"])


def _compared(placed: DataFrame) -> DataFrame:
    """(word, k, best_n, best) of words with near words in one tile and a part of its visitors."""

    def compared(batches):
        tile, words, counts, own, fresh = None, [], [], None, False

        def inside(side):
            i, j = near_pairs(side, side)
            return _best(np.concatenate([i, j]), np.concatenate([j, i]), side, side)

        for batch in batches:
            names, n = batch.column("word").to_pylist(), batch.column("n").to_pylist()
            code = batch.column("tile").dictionary_encode()
            key, role, size = code.indices.to_numpy(), batch.column("role").to_numpy(), batch.column("size").to_numpy()
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (role[1:] != role[:-1]) | (size[1:] != size[:-1])) + 1).tolist(), len(names)]
            for begin, end in zip(cuts, cuts[1:]):
                if begin == end:
                    continue
                here = code.dictionary[int(key[begin])].as_py()
                if here != tile:
                    if fresh:
                        yield inside(Side(words, counts))
                    tile, words, counts, own, fresh = here, [], [], None, False
                if not role[begin]:
                    words += names[begin:end]
                    counts += n[begin:end]
                    fresh = True
                    continue
                if fresh:
                    own, fresh = Side(words, counts), False
                    yield inside(own)
                if own:
                    for part in range(begin, end, TILE):
                        some = Side(names[part:min(part + TILE, end)], n[part:min(part + TILE, end)])
                        i, j = near_pairs(some, own)
                        yield _best(i, j, some, own)
                        yield _best(j, i, own, some)
        if fresh:
            yield inside(Side(words, counts))

    dealt = placed.repartition("tile").sortWithinPartitions("tile", "role", "size")
    return dealt.mapInArrow(compared, "word string, k long, best_n long, best string")


def near_words(words: DataFrame, groups: int | None = None) -> DataFrame:
    """(word, n_near, best_n, best) of those of ``words`` (word, n) that have near words: their number and the most
    frequent of them."""
    if groups is None:
        groups = FEWEST_GROUPS + max(0, int(np.log(max(words.count(), 1) / FIRST_WORDS) / np.log(GROUP_STEP)))
    homes = cut_lineage(_homes(words, groups))
    tile = F.least(F.lit(TILE), F.greatest(F.lit(1), F.floor(TILE_BYTES / F.col("size")))).cast("int")
    blocks = cut_lineage(homes.groupBy("block").agg(F.count("*").alias("c"), F.first("size").alias("size")).select("block", F.ceil(F.col("c") / tile).cast("int").alias("tiles")))
    own = homes.join(blocks, "block").withColumn("t", F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int"))
    name = F.concat_ws("|", F.array_join(F.col("to").cast("array<string>"), ","), F.col("t").cast("string")).alias("tile")
    residents = own.withColumn("to", F.col("block")).select(name, F.lit(0).alias("role"), "size", "word", "n")
    # a word visits all tiles of the blocks above its own, and of its own block those after its own
    steps = F.array(*[F.array(*[F.lit(x) for x in step]) for step in _steps(groups)])
    away = own.select("word", "n", "size", F.col("block").alias("src"), F.col("t").alias("u"), F.explode(steps).alias("step"))
    away = away.withColumn("to", F.zip_with("src", "step", lambda x, y: x + y)).join(blocks.withColumnRenamed("block", "to"), "to")
    first = F.when(F.col("src") == F.col("to"), F.col("u") + 1).otherwise(0)
    visits = away.filter(first < F.col("tiles")).select("word", "n", "size", "to", F.explode(F.sequence(first, F.col("tiles") - 1)).alias("t"))
    visitors = visits.select(name, F.lit(1).alias("role"), "size", "word", "n")
    found = _compared(residents.unionByName(visitors))
    best = F.min(F.struct((-F.col("best_n")).alias("o"), F.col("best").alias("w"))).alias("b")
    return found.groupBy("word").agg(F.sum("k").alias("n_near"), best).select("word", "n_near", (-F.col("b.o")).alias("best_n"), F.col("b.w").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word reached from each ``word`` by its ``form``; every round doubles the steps taken."""
    state = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        further = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        state, moved = state.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "moved"
        state = cut_lineage(state)
        if state.filter(moved).isEmpty():
            return state.select("word", "root")
        state = state.select("word", "root")


def variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of ``words`` (word, n): the form is the most frequent near word, if it occurs
    at least ``ratio`` times as often; the root is where forms lead in the end."""
    words = cut_lineage(words)
    kept = F.col("best_n") >= ratio * F.col("n")
    table = cut_lineage(words.join(near_words(words), "word", "left").select(
        "word", F.when(kept, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(kept, F.col("best_n")).alias("form_n")))
    ends = roots(table.filter("form is not null"))
    return table.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


OP11_SQL = """
WITH RECURSIVE bits AS (
  SELECT b, 0 AS step, b AS v FROM range(256) t(b)
  UNION ALL SELECT b, step + 1, CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END FROM bits WHERE step < 8
), crc AS (
  SELECT list(v ORDER BY b) AS tab FROM bits WHERE step = 8
), run AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS raw FROM documents
), own AS (
  SELECT doc_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS c FROM run GROUP BY ALL
), summed AS (
  SELECT w, c, xor(list_reduce(flatten(list_transform(string_split(doc_id || ':' || w, ''), lambda x:
      CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [(192 | (unicode(x) >> 6))::BIGINT, (128 | (unicode(x) & 63))::BIGINT] END)),
    lambda acc, b: xor(acc >> 8, tab[(xor(acc, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS h FROM own, crc
), spoilt AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word, c FROM summed
), vocabulary AS (
  SELECT word, sum(c)::BIGINT AS n FROM spoilt WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3
), place AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocabulary
), cut AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM place
), pair AS (
  SELECT a.word AS a, b.word AS b FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, v.word FROM cut c JOIN vocabulary v ON c.rest = v.word
  UNION SELECT v.word, c.word FROM cut c JOIN vocabulary v ON c.rest = v.word
), near AS (
  SELECT a AS word, count(*) AS n_near, min_by(b, (-v.n, b)) AS best FROM pair JOIN vocabulary v ON v.word = b GROUP BY a
), formed AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN f.n >= 2 * v.n THEN f.word END AS form,
    CASE WHEN f.n >= 2 * v.n THEN f.n END AS form_n
  FROM vocabulary v LEFT JOIN near USING (word) LEFT JOIN vocabulary f ON f.word = near.best
), walk AS (
  SELECT word, coalesce(form, word) AS stop FROM formed
  UNION ALL SELECT walk.word, f.form FROM walk JOIN formed f ON f.word = walk.stop WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, (SELECT min_by(w.stop, (-v.n, v.word)) FROM walk w JOIN vocabulary v ON v.word = w.stop WHERE w.word = f.word) AS root,
  f.n, f.n_near, f.form_n FROM formed f
"""
