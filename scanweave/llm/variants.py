"""Spelling variants: words that differ by one letter, by an even-partition pigeonhole join.

A word of length L is indexed by its two halves. One edit leaves one half as it
is, so a word of equal length shares that half at its place, and a word longer by
one letter shares the first half at its place or the second half one place
further on. Words that share a key are candidates; one edit is verified.

Where a key has many words, the part of them that the key doesn't fix is halved
again, and so on, until so few share a key, or the edit's place is fixed, where
every pair that shares the key differs by one edit. So no group gives many more
pairs than there are links, whatever words the corpus has, and no link is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanweave.llm.common import col, dealt_join, written

#: Maximal runs of letters are words; only A to Z have a lower case here.
LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A word is taken as a variant of a near word with so many times its count.
RATIO = 10
#: Words that share a key and are all compared; beyond them the key is refined.
MOST_IN_KEY = 128


def occurrences(docs: DataFrame, least_length: int = LEAST_LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, word``: each run of at least ``least_length`` letters in lower case, one row for each time it occurs.

    A null text has none; a null or repeated id keeps its rows.
    """
    runs = F.regexp_extract_all(col(text_col).cast("string"), F.lit(f"[{LETTERS}]{{{least_length},}}"), 0)
    return docs.select(col(id_col).cast("long").alias("doc_id"), F.explode(runs).alias("word")).withColumn("word", F.translate("word", UPPER, LOWER))


def thinned(words: DataFrame, one_in: int = 31) -> DataFrame:
    """``occurrences`` with one letter left out of those words of a document whose checksum ``one_in`` divides: planted misspellings."""
    sum_ = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "word").cast("binary"))
    place = (sum_ % F.char_length("word")).cast("int")
    cut = F.concat(F.substr("word", F.lit(1), place), F.substr("word", place + 2))
    return words.withColumn("word", F.when(sum_ % one_in == 0, cut).otherwise(F.col("word")))


def counts(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n`` of the words of at least that length and count; tasks count before rows move."""
    return words.filter(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _halves(a: Column, m: Column, longer_by_one: bool) -> Column:
    """The two parts of ``m`` letters from ``a`` on that still may hold the edit once one half is fixed.

    With one letter more in the probe, a single letter is fixed before or behind the edit.
    """
    half = F.floor(m / 2).cast("int")
    first = F.struct((a + half).alias("a"), (m - half).alias("m"))
    if longer_by_one:
        first = F.when(m == 1, F.struct((a + 1).alias("a"), F.lit(0).alias("m"))).otherwise(first)
    return F.array(first, F.struct(a.alias("a"), half.alias("m")))


def _keyed(rows: DataFrame) -> DataFrame:
    """``rows`` split by one half more: their new ``a``, ``m`` and the hash ``key`` of all letters outside the open part."""
    part = F.when(F.col("inserted"), _halves(F.col("a"), F.col("m"), True)).otherwise(_halves(F.col("a"), F.col("m"), False))
    others = [c for c in rows.columns if c not in ("a", "m", "key")]
    open_ = rows.withColumn("part", F.explode(part)).select(*others, "part.a", "part.m")
    behind = F.col("a") + F.col("m") + F.col("probe").cast("int") + 1
    fixed = (F.substr("word", F.lit(1), F.col("a")), F.substr("word", behind))
    return open_.withColumn("key", F.xxhash64("inserted", "size", "a", "m", *fixed))


def _roles(words: DataFrame) -> DataFrame:
    """Each word in its three roles: indexed for words of its length, indexed for longer ones, and probing shorter ones.

    ``size`` is the length of the indexed word, whose ``m`` letters from ``a`` on may hold the edit: all of them as yet.
    """
    roles = F.array(*[F.struct(F.lit(i).alias("inserted"), F.lit(p).alias("probe")) for i, p in ((False, False), (True, False), (True, True))])
    rows = words.select("word", F.explode(roles).alias("role")).select("word", "role.*")
    size = F.char_length("word") - F.col("probe").cast("int")
    return rows.withColumn("size", size).withColumn("a", F.lit(0)).withColumn("m", size)


def _pairs(rows: DataFrame) -> DataFrame:
    """``short, long``: the pairs of words that share a key and differ by one edit."""
    index = rows.filter("NOT probe").select("key", F.col("word").alias("short"), F.col("inserted").alias("one_longer"))
    probes = rows.filter("probe OR NOT inserted").select("key", F.col("word").alias("long"), "inserted")
    met = index.join(probes, "key").filter("one_longer = inserted AND (inserted OR short < long)")
    return met.filter(F.levenshtein("short", "long", 1) == 1).select("short", "long")


def links(words: DataFrame, most: int = MOST_IN_KEY) -> DataFrame:
    """``short, long``: every pair of different words of ``words(word)`` with one letter inserted, deleted or replaced, once.

    Words must be distinct. Of equally long ones the smaller is ``short``. An empty table gives an empty result.
    """
    rows, found = _keyed(_roles(words)), []
    while True:
        rows = written(rows, "variants")
        sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.max(F.col("m") > F.when(F.col("inserted"), 0).otherwise(1)).alias("open"))
        sizes = written(sizes.filter(F.col("n") > most), "variant-keys")
        hot = sizes.filter("open").select("key", F.lit(True).alias("hot"))
        if hot.isEmpty():
            found.append(_pairs(rows))
            break
        marked = dealt_join(rows, hot, ["key"], "left", counts=sizes.select("key", "n"))
        found.append(_pairs(marked.filter("hot IS NULL").drop("hot")))
        rows = _keyed(marked.filter("hot").drop("hot"))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs.distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the last of the forms that follow from a word of ``forms(word, form)``.

    Forms have ten times the count of their word, or the ratio asked for, so chains end; each round doubles the steps taken.
    """
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = now.join(onward, "root", "left")
        if joined.filter("next IS NOT NULL").isEmpty():
            return now
        now = written(joined.select("word", F.coalesce("next", "root").alias("root")), "roots", now)


def spelling_variants(words: DataFrame, ratio: int = RATIO, most: int = MOST_IN_KEY) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of each row of ``words(word, n)``, whose words are distinct.

    ``n_near`` counts the near words. ``form`` is the near word of largest ``n`` (of equals the
    smallest in code-point order) if it has ``ratio`` times the word's ``n``, else null as is ``form_n``; ``root`` is
    the end of the chain of forms, the word itself without one. Rows with a null word
    go; other columns are not read; an empty table gives an empty result. A word has at most
    some tens of near words for each of its letters, the letters there are, so no word's links are a hot group.
    """
    if ratio <= 1:
        raise ValueError("a form must have more than its variant's count, or chains could be circles")
    own = written(words.select(col("word").cast("string").alias("word"), col("n").cast("long").alias("n")).filter("word IS NOT NULL"), "words")
    pairs = links(own, most)
    both = pairs.select(F.col("short").alias("word"), F.col("long").alias("other")).unionByName(
        pairs.select(F.col("long").alias("word"), F.col("short").alias("other"))
    )
    known = both.join(own.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = known.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best"))
    with_best = own.join(best, "word", "left")
    is_form = -F.col("best.minus") >= F.col("n") * ratio
    out = with_best.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(is_form, F.col("best.other")).alias("form"),
        F.when(is_form, -F.col("best.minus")).alias("form_n"),
    )
    out = written(out, "forms")
    rooted = out.join(_roots(out.filter("form IS NOT NULL")), "word", "left")
    return rooted.withColumn("root", F.coalesce("root", "word")).select("word", "n", "n_near", "form", "form_n", "root")


#: DuckDB SQL for the words of ``documents`` with planted misspellings: checksums by their polynomial, near words by what deletions leave.
ORACLE = r"""
WITH RECURSIVE crc_steps AS (SELECT list_transform(range(256), lambda k: list_reduce([k] || range(8),
        lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps),
runs AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
    FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS r FROM documents) WHERE length(r) >= 7),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
summed AS (SELECT run, n, xor(list_reduce([4294967295] || flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
        lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c) - 64] END)),
        lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM counted, crc_steps),
words AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % 31 = 0
        THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM summed)
    WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (SELECT word, n, p, left(word, p::INT) || substr(word, p::INT + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS p FROM words)),
near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS best_n FROM near GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * w.n THEN best_n END AS form_n,
        (SELECT min(other) FROM near WHERE near.word = w.word AND other_n = best_n AND best_n >= 10 * w.n) AS form
    FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, form AS root FROM forms WHERE form IS NOT NULL
    UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON c.root = f.word WHERE f.form IS NOT NULL),
last AS (SELECT c.word, c.root FROM chain c JOIN forms f ON c.root = f.word WHERE f.form IS NULL)
SELECT f.word, n, n_near, form, form_n, coalesce(root, f.word) AS root FROM forms f LEFT JOIN last USING (word)"""
