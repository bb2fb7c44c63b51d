"""Benchmark decontamination: short test items found inside long documents by MinHash containment.

Words are runs of letters and digits of the lower-cased text; in scripts written without spaces each character is a word. Shingles are
five words (``shingle``). An item is found in a document that holds ``threshold`` (0.8) or more of its different shingles. An item
shorter than a shingle is one shingle of its own length: it is found where its words stand in a row.

Method. Containment, not similarity, is asked for, so items are partitioned by size (number of
shingles, classes of powers of two) and each class gets its own sketch length: for an item of at
most u shingles, the k = u - ceil(threshold * u) + 1 smallest hashes. A document that holds
the threshold can miss at most k - 1 of an item's shingles, so it holds a sketched one: the search
loses nothing. On the document side a hash is looked up only if it is at or below the largest
sketched value of its length (the ceiling of a document's own MinHash sketch); lengths below a shingle are looked up only if an item has them. Banding over whole-document
signatures would not do: an item of 12 shingles in a text of 20,000 words has a Jaccard
similarity of 0.0006. Candidates are then verified by exact containment of the shingles
themselves, as strings.

Execution. DataFrame functions only. The sketches are a small written table whose size Spark
knows, so it broadcasts it below the session's threshold and shuffles beyond; a candidate is one
row per document and item before anything is joined back to texts.

Defined results: texts and items that are null or without a word are never found, nor items longer than the text allows; a null
item id is a valid item; rows that share id and text are one document, rows that share the id alone
are looked at separately and the best containment counts; repeated items (same id) are one item if
their texts are equal and looked at separately otherwise; empty tables give an empty result; other
columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.tables import Tables, free_name

SHINGLE, THRESHOLD = 5, 0.8


#: Scripts that do not put spaces between words.
UNSPACED = ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar")


def word_list(text: str) -> Column:
    alone = "([" + "".join(rf"\p{{Is{x}}}" for x in UNSPACED) + "])"
    lower = F.lower(F.coalesce(F.col(text), F.lit("")))
    return F.array_remove(F.split(F.regexp_replace(lower, alone, " $1 "), r"[^\p{L}\p{N}]+"), "")


def _shingled(words: Column, shingle: int, make) -> Column:
    """``make(words)`` of each run of ``shingle`` words; none below a shingle's length.

    The word array is bound as a lambda's variable, so that it is computed once for a text and not for each shingle.
    """
    def each(w: Column) -> Column:
        n = F.size(w) - shingle
        places = F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: make([F.get(w, i + F.lit(k)) for k in range(shingle)]))
    return F.flatten(F.transform(F.array(words), each))


def _hash(words: list[Column]) -> Column:
    return F.xxhash64(*words)


def shingle_hashes(words: Column, length: int) -> Column:
    """The hash of every shingle, from one hash for each word."""
    return _shingled(F.transform(words, lambda x: F.xxhash64(x)), length, _hash)


def shingle_strings(words: Column, lengths: list[int]) -> Column:
    """The different shingles of these lengths, as strings."""
    return F.array_distinct(F.flatten(F.array(*[_shingled(words, n, lambda w: F.concat_ws(" ", *w)) for n in lengths])))


def _of_its_length(n: Column, shingle: int, make) -> Column:
    """``make(length)`` for an item of n words: a shingle's, or its own if it is shorter."""
    out = F.when(n >= shingle, make(shingle))
    for length in range(1, shingle):
        out = out.when(n == length, make(length))
    return out


def sketches(items: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """(item, length, h): the smallest hashes of each item, as many as its size class needs."""
    n = F.size("words")
    hashed = items.select("item", F.least(n, F.lit(shingle)).alias("length"), F.array_sort(F.array_distinct(_of_its_length(n, shingle, lambda k: shingle_hashes(F.col("words"), k)))).alias("h")) \
        .where(F.size("h") > 0)  # none: an item without a word
    upper = F.pow(F.lit(2.0), F.ceil(F.log2(F.size("h"))))
    most = (upper - F.ceil(upper * threshold) + 1).cast("int")
    return hashed.select("item", "length", F.explode(F.slice("h", F.lit(1), most)).alias("h"))


def contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
              shingle: int = SHINGLE, threshold: float = THRESHOLD, by_text: bool = False) -> DataFrame:
    """(id, item id, n_shared, n_shingles, containment) of every item found in a document.

    ``by_text`` adds ``text_key``, a hash of the document's text, for callers that tell rows of one id apart.
    """
    tables = Tables(docs.sparkSession, "decontam")
    asked = items.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text")).distinct() \
        .select("item_id", F.xxhash64("item_id", "text").alias("item"), word_list("text").alias("words"))
    asked = tables.write(asked, "items")
    sketch = tables.write(sketches(asked, shingle, threshold), "sketches")
    ceilings = {r["length"]: r["h"] for r in sketch.groupBy("length").agg(F.max("h").alias("h")).collect()}  # a row a length
    lengths = sorted(ceilings) or [shingle]
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))

    def low(words: Column, length: int) -> Column:
        return F.filter(shingle_hashes(words, length), lambda h: h <= F.lit(ceilings.get(length, -(1 << 63))))
    # the words are bound once for all lengths
    looked = F.flatten(F.transform(F.array(word_list("text")), lambda w: F.flatten(F.array(*[low(w, n) for n in lengths]))))
    found = texts.select("id", "text_key", F.explode(looked).alias("h")).join(sketch, "h").select("id", "text_key", "item").distinct()
    found = tables.write(found, "candidates")
    wanted = found.select(F.col("id").alias("a"), F.col("text_key").alias("b")).distinct()
    held = texts.join(wanted, F.col("id").eqNullSafe(F.col("a")) & (F.col("text_key") == F.col("b")), "left_semi").dropDuplicates(["id", "text_key"])
    strings = F.flatten(F.transform(F.array(word_list("text")), lambda w: shingle_strings(w, lengths)))
    held = held.select(F.col("id").alias("a"), F.col("text_key").alias("b"), strings.alias("held"))
    need = asked.select("item", "item_id", _of_its_length(F.size("words"), shingle, lambda k: shingle_strings(F.col("words"), [k])).alias("need"))
    pairs = found.join(held, F.col("id").eqNullSafe(F.col("a")) & (F.col("text_key") == F.col("b"))).join(need, "item") \
        .select("id", "text_key", "item_id", F.size(F.array_intersect("need", "held")).cast("long").alias("n_shared"), F.size("need").cast("long").alias("n_shingles")) \
        .withColumn("containment", F.col("n_shared") / F.col("n_shingles")).where(F.col("n_shared") >= F.col("n_shingles") * F.lit(threshold))
    key = ["id", "item_id", *(["text_key"] if by_text else [])]
    best = F.max(F.struct("containment", "n_shared", "n_shingles")).alias("best")
    return pairs.groupBy(*key).agg(best).select(F.col("id").alias(id_col), *key[1:], "best.n_shared", "best.n_shingles", "best.containment")


def remove_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs``, all columns, without the texts in which an item is found."""
    found = contained(docs, items, id_col, text_col, by_text=True, **options)
    a, b, c = (free_name(docs, x) for x in ("key_id", "key_null", "key_text"))
    keys = {a: F.coalesce(F.col(id_col).cast("long"), F.lit(0)), b: F.col(id_col).isNull(), c: F.xxhash64(text_col)}
    gone = found.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias(a), F.col(id_col).isNull().alias(b), F.col("text_key").alias(c)).distinct()
    gone = Tables(docs.sparkSession, "contaminated").write(gone, "found")
    return docs.withColumns(keys).join(gone, [a, b, c], "left_anti").select(*docs.columns)


ORACLE = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, [x FOR x IN regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])', ' \1 ', 'g'), '[^\p{L}\p{N}]+') IF x <> ''] AS w FROM documents),
b AS (SELECT row_number() OVER () AS k, item_id, [x FOR x IN regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])', ' \1 ', 'g'), '[^\p{L}\p{N}]+') IF x <> ''] AS w
      FROM (SELECT DISTINCT item_id, text FROM benchmark)),
l AS (SELECT DISTINCT least(len(w), 5) AS n FROM b WHERE len(w) > 0),
d AS (SELECT DISTINCT r, doc_id, unnest([array_to_string(w[i:i + n - 1], ' ') FOR i IN range(1, len(w) - n + 2)]) AS s FROM w, l WHERE len(w) >= n),
i AS (SELECT DISTINCT k, item_id, unnest([array_to_string(w[i:i + least(len(w), 5) - 1], ' ') FOR i IN range(1, greatest(len(w) - 3, 2))]) AS s FROM b WHERE len(w) > 0),
n AS (SELECT k, count(*) AS n_shingles FROM i GROUP BY k),
p AS (SELECT r, doc_id, k, item_id, count(*) AS n_shared, any_value(n_shingles) AS n_shingles FROM d JOIN i USING (s) JOIN n USING (k) GROUP BY r, doc_id, k, item_id HAVING count(*) >= any_value(n_shingles) * 0.8::DOUBLE),
m AS (SELECT doc_id, item_id, max({'c': n_shared / n_shingles::DOUBLE, 's': n_shared, 'n': n_shingles}) AS m FROM p GROUP BY doc_id, item_id)
SELECT doc_id, item_id, m.s::BIGINT AS n_shared, m.n::BIGINT AS n_shingles, m.c AS containment FROM m
"""
