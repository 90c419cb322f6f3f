"""Grouping of spelling variants: words one edit apart, found by bands of a bitmask of letter parities.

A word's mask has a bit for each letter, set if the letter occurs an odd number of times, and is split into three bands. One inserted or deleted letter
flips one bit, so two bands stay as they are; so do they if a letter is replaced by one of its own band. If a letter is replaced by one of
another band, two bits flip and one band stays. With a band's bits all its letters stay, in their order. So words with two equal bands (bits and
letters) and lengths at most one apart are candidates, and words of equal length with one equal band of which one has a letter more in the
lower of the other bands: joined by equality, held against the whole mask and then against the edit distance. Every pair can meet in one place only.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import common as C

#: Fixed values of the contract: a run of letters, the divisor of the hash that a code point is deleted for, least code points and occurrences of a word, ratio of a form's occurrences.
RUN, DIVISOR, LENGTH, LEAST, RATIO = re.compile("[A-Za-zÀ-ÿ]+"), 31, 7, 2, 10
#: Letters by falling frequency in European text, dealt to the bands in turn, so that words have about as many in each.
LETTERS = "eanirtoslducmpghvbfykjzwqx"
#: Distinct words that a task counts before it passes the counts on.
COUNTED = 1 << 18
_LOWER = {c: c + 32 for c in range(65, 91)}
BANDS = 3


def bit(letter: str) -> int:
    """The bit of a letter: the band is bit % BANDS. Letters after z share the bits from 26 to 62."""
    at = LETTERS.find(letter)
    return at if at >= 0 else 26 + ord(letter) % 37


_BIT: dict[str, int] = {}


def parity(word: str) -> tuple[int, list[int], list[int]]:
    """The mask of a word, and for each band a key (a hash of the band's letters in their order, which have the band's bits) and how many letters these are."""
    mask, own = 0, ["", "", ""]
    for c in word:
        b = _BIT.get(c)
        if b is None:
            b = _BIT[c] = bit(c)
        mask ^= 1 << b
        own[b % BANDS] += c
    return mask, [xxhash.xxh64_intdigest(x) - (1 << 63) for x in own], [len(x) for x in own]


def spelled(doc_id: int | None, text: str, length: int = LENGTH) -> Counter:
    """How often each word of at least `length` code points is in the text, after the deletions that the hash of identifier and run asks for."""
    out, start = Counter(), zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(RUN.findall(text.translate(_LOWER))).items():
        if len(run) >= length:
            h = zlib.crc32(run.encode(), start)
            if h % DIVISOR == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
                if len(run) < length:
                    continue
            out[run] += n
    return out


def vocabulary(docs: DataFrame, length: int = LENGTH, least: int = LEAST) -> DataFrame:
    """(word, n) of the words of all texts with at least `least` occurrences."""

    def run(batches):
        held: Counter = Counter()

        def batch_of():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for d, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                held.update(spelled(d, text or "", length))
                if len(held) > COUNTED:
                    yield batch_of()
                    held.clear()
        yield batch_of()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def near_words(words: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct words(word) that are one edit apart, each once."""
    fields = ["mask", *[f"{c}{i}" for c in "kn" for i in range(BANDS)]]

    def run(batches):
        for batch in batches:
            own = [parity(w) for w in batch.column("word").to_pylist()]
            mask = pa.array(np.array([m for m, _, _ in own], dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("word"), mask, *(pa.array([x[j][i] for x in own], pa.int64()) for j in (1, 2) for i in range(BANDS))], ["word", *fields])

    masked = words.select("word").mapInArrow(run, "word string, " + ", ".join(f"{f} long" for f in fields)).withColumn("length", F.length("word"))
    masked = C.stored(masked, "masks")
    others = [[i for i in range(BANDS) if i != j] for j in range(BANDS)]
    own = ["word", "mask", "length"]
    one = masked.select(*own, F.explode(F.array(*[F.struct(F.lit(j).alias("band"), F.col(f"k{j}").alias("key"), F.col(f"n{others[j][0]}").alias("n")) for j in range(BANDS)])).alias("z")).select(*own, "z.*")
    two = masked.select(*own, F.explode(F.array(*[F.struct(F.lit(j).alias("band"), F.col(f"k{others[j][0]}").alias("key"), F.col(f"k{others[j][1]}").alias("more")) for j in range(BANDS)])).alias("z")).select(*own, "z.*")
    renamed = lambda df: df.withColumnsRenamed({c: f"b_{c}" for c in own})
    flips = F.bit_count(F.col("mask").bitwiseXOR(F.col("b_mask")))
    edit = F.levenshtein("word", "b_word", 1) == 1
    across = one.join(renamed(one).withColumn("n", F.col("n") + 1).withColumn("length", F.col("b_length")), ["band", "key", "length", "n"]).where((flips == 2) & edit)
    shorter = (F.col("length") == F.col("b_length") + 1) | (F.col("length") == F.col("b_length")) & (F.col("word") < F.col("b_word"))
    within = two.join(renamed(two), ["band", "key", "more"]).where(shorter & (flips <= 2) & edit)
    pair = [F.col("word").alias("a"), F.col("b_word").alias("b")]
    return across.select(*pair).unionByName(within.select(*pair))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms(word, form): the last word that is reached from form to form. Each step at least doubles the steps behind; forms have no loops."""
    links = C.stored(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = C.stored(links.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        links = new.select("word", "root")
        if new.where("moved").isEmpty():
            return links


def variants(docs: DataFrame, length: int = LENGTH, least: int = LEAST, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of the texts of docs(doc_id, text).

    Words are runs of letters (A-Z in lower case), of which those whose hash with the identifier is divisible by 31 lose a code point, of at least
    `length` code points and `least` occurrences in all texts together. n_near: words one edit apart. form: the near word of the largest n, ties to
    the first in code-point order, if that n is at least `ratio` times the word's, else null. root: the last word reached from form to form, or the
    word itself. Null and empty texts have no words; a null identifier is hashed as an empty one; repeated rows count as often as they
    are; an empty table gives no rows; other columns are ignored.
    """
    C.arrow_rows(docs.sparkSession)
    words = C.stored(vocabulary(docs, length, least), "vocabulary")
    pairs = C.stored(near_words(words), "near-words")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    of = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("b_n")), "b")
    best = of.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("low"), F.col("b").alias("form"))).alias("best"))
    known = words.join(best, "word", "left").withColumn("has", F.coalesce(-F.col("best.low") >= ratio * F.col("n"), F.lit(False)))
    known = C.stored(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("has"), F.col("best.form")).alias("form"), F.when(F.col("has"), -F.col("best.low")).alias("form_n")), "near")
    last = roots(known.where("form IS NOT NULL"))
    return known.join(last, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(C.documents(spark, sf_dir))


OP13_SQL = r"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
o AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS r FROM documents),
u AS (SELECT r, count(*) AS c, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r)) AS x FROM o WHERE length(r) >= 7 GROUP BY doc_id, r),
h AS (SELECT r, c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, tab[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295) AS h FROM u, tab),
w AS (SELECT CASE WHEN h % 31 = 0 THEN substr(r, 1, CAST(h % length(r) AS BIGINT)) || substr(r, CAST(h % length(r) AS BIGINT) + 2) ELSE r END AS word, c FROM h),
v AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
g AS (SELECT word, n, unnest(range(length(word))) AS i FROM v),
p AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS k FROM g),
e AS (SELECT a.word AS a, b.word AS b, b.n AS n FROM p a JOIN p b ON a.k = b.k AND a.i = b.i AND a.word <> b.word
      UNION SELECT a.word, b.word, b.n FROM p a JOIN v b ON a.k = b.word UNION SELECT b.word, a.word, a.n FROM p a JOIN v b ON a.k = b.word),
f AS (SELECT a AS word, count(*) AS n_near, max(n) AS most, arg_min(b, (-n, b)) AS best FROM e GROUP BY a),
k AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * v.n THEN best END AS form, CASE WHEN most >= 10 * v.n THEN most END AS form_n FROM v LEFT JOIN f USING (word)),
s AS (SELECT word, word AS root, 0 AS step FROM k UNION ALL SELECT s.word, k.form, step + 1 FROM s JOIN k ON s.root = k.word WHERE k.form IS NOT NULL),
z AS (SELECT word, arg_max(root, step) AS root FROM s GROUP BY word)
SELECT word, n, n_near, form, form_n, root FROM k JOIN z USING (word)
"""
