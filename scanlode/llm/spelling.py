"""Spelling variants: words one inserted, deleted or replaced letter apart, counted and rooted without ever making pairs.

Two words of equal length are near if they differ at one place, so they meet in the
wildcard group of that place: the letters before it and the letters after it. A group
holds at most one word for each letter that can stand there (``LETTERS``), and all that
a member needs of it is its size and its two commonest words: one of the two is
another word than the member. Two words whose lengths differ are near if taking one
letter out of the longer gives the shorter, so each word's deletions look for
themselves in the vocabulary; the shorter word gets a count and a best word of the
deletions that spell it, summed before they meet it. What the groups and the deletions
say about a word is then added up.

The vocabulary is counted over all texts (sums before the shuffle, so a word that
fills the corpus is no hot key) and written once; everything after it is as large as
the vocabulary times a word's length. A word's form is at least ``TIMES`` times as
common as the word, so forms never run in circles and a chain has at most
log(commonest)/log(TIMES) steps: the roots come from so many doublings.

Defined cases: null and empty texts hold no runs; a null doc_id is written as an empty
string in the draw of dropped letters; repeated rows count as often as they stand; a
run longer than any word of a language is a word like others; an empty table gives no
rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanlode.llm.common import materialize

#: What counts as a run of letters, the draw of runs that lose a letter, and which words are kept.
RUN, DRAW, LEAST_LENGTH, LEAST_COUNT = r"[A-Za-zÀ-ÿ]+", 199, 6, 5
#: Letters a-z and U+00C0 to U+00FF: the bound on the members of a wildcard group.
LETTERS = 26 + 64
#: Words beyond it are opened only if half of them recurs, and their groups go by digest.
LONG = 64
#: A form is at least so many times as common as the word.
TIMES = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for the letter that a wildcard group leaves open; no letter itself.
OPEN = "*"


def _lowered(run: Column) -> Column:
    """A-Z only; ASCII words, nearly all, take the quick way."""
    return F.when(F.octet_length(run) == F.char_length(run), F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))


def _without(word: Column, at: Column) -> Column:
    """``word`` without its letter number ``at`` (from 0)."""
    return F.concat(F.substr(word, F.lit(1), at), F.substr(word, at + 2))


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: the runs of all texts, some of which lose a letter by ``DRAW``."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("r"))
    # A run loses a letter at most, so shorter ones are no words in the end.
    low = runs.where(F.char_length("r") >= LEAST_LENGTH).select("d", _lowered(F.col("r")).alias("r"))
    drawn = low.select("r", F.crc32(F.concat("d", F.lit(":"), "r")).alias("h"))
    at = (F.col("h") % F.char_length("r")).cast("int")
    words = drawn.select(F.when(F.col("h") % DRAW == 0, _without(F.col("r"), at)).otherwise(F.col("r")).alias("word"))
    return words.where(F.char_length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _places(word: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.char_length(word) - 1))


def comparable(words: DataFrame) -> DataFrame:
    """Without the words over ``LONG`` letters that have no near word for certain: opened at each place they would fill pages.

    Of two near words one half is equal, the first letters or the last, as many as half the shorter one's.
    """
    long = words.where(F.char_length("word") > LONG)
    half = long.select("word", F.explode(F.array(F.char_length("word"), F.char_length("word") - 1)).alias("least")).select("word", F.floor(F.col("least") / 2).cast("int").alias("half"))
    ends = half.select("word", "half", F.explode(F.array(F.concat(F.lit("<"), F.substr("word", F.lit(1), F.col("half"))), F.concat(F.lit(">"), F.substr("word", -F.col("half"))))).alias("end"))
    keyed = ends.select("word", F.sha2(F.concat_ws(" ", "half", "end"), 256).alias("key"))
    shared = keyed.groupBy("key").agg(F.count_distinct("word").alias("n")).where("n > 1").select("key")
    return words.where(F.char_length("word") <= LONG).unionAll(long.join(keyed.join(shared, "key", "left_semi"), "word", "left_semi"))


def _best(n: str, word: str) -> Column:
    """Sorts the commonest word first, ties by code point."""
    return F.struct((-F.col(n)).alias("less"), F.col(word).alias("near"))


def replaced(words: DataFrame) -> DataFrame:
    """word, count, best: what each wildcard group says to its members."""
    place = words.select("word", "n", _places("word").alias("at"))
    opened = F.concat(F.substr("word", F.lit(1), F.col("at")), F.lit(OPEN), F.substr("word", F.col("at") + 2))
    keyed = place.select("word", "n", F.when(F.char_length("word") <= LONG, opened).otherwise(F.sha2(opened, 256)).alias("group"))
    order = Window.partitionBy("group").orderBy(F.col("n").desc(), "word")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    one = _best("n", "word")
    told = keyed.select("word", F.count("*").over(whole).alias("size"), F.first(one).over(whole).alias("top"), F.nth_value(one, 2).over(whole).alias("second"))
    return told.where("size > 1").select("word", (F.col("size") - 1).alias("count"), F.when(F.col("top.near") == F.col("word"), F.col("second")).otherwise(F.col("top")).alias("best"))


def shortened(words: DataFrame) -> DataFrame:
    """word, count, best: to the longer word the deletions that are words, to the shorter what deletions spell it."""
    place = words.select("word", "n", _places("word").alias("at"))
    # In a run of equal letters only the first is taken out: each deletion stands once.
    letter = F.substr(F.col("word"), F.col("at") + 1, F.lit(1))
    first = place.where((F.col("at") == 0) | (letter != F.substr(F.col("word"), F.col("at"), F.lit(1))))
    spelt = first.select("word", "n", _without(F.col("word"), F.col("at")).alias("short")).where(F.char_length("short") >= LEAST_LENGTH)
    known = words.select(F.col("word").alias("known"), F.col("n").alias("known_n"))
    down = spelt.join(known, F.col("short") == F.col("known")).groupBy("word").agg(F.count("*").alias("count"), F.min(_best("known_n", "known")).alias("best"))
    up = spelt.groupBy("short").agg(F.count("*").alias("count"), F.min(_best("n", "word")).alias("best"))
    return down.unionAll(up.join(known, F.col("short") == F.col("known")).select(F.col("known").alias("word"), "count", "best"))


def forms(words: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n of a vocabulary."""
    open_to = comparable(words)
    near = replaced(open_to).unionAll(shortened(open_to)).groupBy("word").agg(F.sum("count").alias("n_near"), F.min("best").alias("best"))
    common = -F.col("best.less")
    taken = F.col("best").isNotNull() & (common >= TIMES * F.col("n"))
    return words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("best.near")).alias("form"), F.when(taken, common).alias("form_n"))


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per word of the vocabulary."""
    words = materialize(vocabulary(docs), "spelling-words")
    told = materialize(forms(words), "spelling-forms")
    most = told.agg(F.max("n")).first()[0] or 1
    steps = told.where("form IS NOT NULL").select(F.col("word").alias("of"), F.col("form").alias("to"))
    # After k rounds a step stands for 2 ** k forms; a chain has log(most) / log(TIMES) at most.
    for _ in range(math.ceil(math.log2(max(1.0, math.log(most, TIMES))))):
        on = steps.select(F.col("of").alias("next_of"), F.col("to").alias("next_to"))
        steps = steps.join(on, F.col("to") == F.col("next_of"), "left").select("of", F.coalesce("next_to", "to").alias("to"))
    return told.join(steps, F.col("word") == F.col("of"), "left").select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")


#: The same by self-joins of the wildcard and deletion keys: for small tables. crc32 byte by byte, from its own polynomial.
ORACLE = r"""
WITH RECURSIVE bits AS (
  SELECT i::BIGINT AS b, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS d, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS r FROM documents)),
counted AS (SELECT d, r, count(*) AS n FROM runs WHERE length(r) >= 6 GROUP BY d, r),
hashed AS (
  SELECT r, n, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(d || ':' || r, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END))),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295::BIGINT) AS h
  FROM counted, crc),
drawn AS (SELECT CASE WHEN h % 199 = 0 THEN left(r, (h % length(r))::INT) || substr(r, (h % length(r))::INT + 2) ELSE r END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM drawn WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
places AS (SELECT word, n, i, left(word, i) AS a, substr(word, i + 2) AS z FROM (SELECT word, n, unnest(range(length(word)))::INT AS i FROM words)),
links AS (
  SELECT x.word AS w, y.word AS o, y.n AS m FROM places x JOIN places y ON x.a || '*' || x.z = y.a || '*' || y.z AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM places x JOIN words y ON x.a || x.z = y.word
  UNION SELECT y.word, x.word, x.n FROM places x JOIN words y ON x.a || x.z = y.word),
near AS (SELECT w, count(*) AS n_near, max(m) AS m, arg_min(o, (-m, encode(o))) AS o FROM links GROUP BY w),
formed AS (
  SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 5 * n THEN o END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n
  FROM words LEFT JOIN near ON word = w),
roots AS (
  SELECT word, word AS root, form AS next FROM formed
  UNION ALL SELECT r.word, f.word, f.form FROM roots r JOIN formed f ON r.next = f.word)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM formed f JOIN roots r ON r.word = f.word AND r.next IS NULL
"""
