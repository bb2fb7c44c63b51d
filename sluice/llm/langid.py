"""Language identification by prediction by partial matching (PPM) over bytes.

Model. For each language a context tree of its bytes (A-Z lower-cased), contexts of 0 to ``ORDER`` (3) bytes, with escape method C and
exclusion: in a context with total count T and D different next bytes, a byte seen n times costs
-log2(n / (T + D)) bits and an escape -log2(D / (T + D)); after an escape the next shorter context is asked, without the
bytes that the longer ones would have given. Below order 0 all bytes left are equally likely, so every text has
a finite, exact code length. Statistics are frozen after training.

Scoring. Only the (context, byte, language) that were seen are kept, sorted. The different runs of ORDER + 1 bytes of a slice are looked up
once each, in float64, and a text's code length under all languages is the sum of its runs' lengths. The prediction is the shortest code; the score is its share of the total
probability, 2**-length over all languages.

Keeping. A text is explained by its language if its code is no longer than the language's own texts lead to expect. Texts are halved by
their checksum, and each is coded by the counts of the other half's training texts, so that none is coded by what was learned from itself. Windows of
1, 2, 4 .. 4096 bytes from the middle of training texts give a median and an upper quartile of bits a byte for each length, frozen with
the counts. A text may take twice the median, or the median and ``SPREAD`` (8) times what the quartile is above it if that is more,
told by the greatest of those lengths that it has, and ``SPARE`` (64) bits in all: eight bytes of a name or number that no language
knows, so words of a learned language stay. The rates are counted in steps of 1 / ``STEPS`` (1,024) bit, so that a quantile is told by
a histogram whose size does not grow with the texts. Lengths with under ``FEWEST`` (8) training texts go by the next shorter one; a language that
has no length with as many has no limit.

Training. All texts of every language, but the held-out ones. The counts are a grouped aggregation; what reaches the driver, as Arrow
arrays, is one row for each different run of ORDER + 1 bytes or fewer of a language. Their number is bounded by the language's letters, not by its texts.

Defined results: null text or one without a letter is ``und`` with score 0; ties go to the smaller language name; documents
with a null language or null id aren't learned from; with no labelled document all are ``und``; repeated rows get equal
results; an empty table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.arrays import column_bytes, release, slices, trim
from sluice.llm.tables import free_name, small_batches

ORDER, RUNS = 3, 1 << 21
SPREAD, SPARE, FEWEST, LENGTHS, STEPS = 8, 64, 8, 13, 1024
UND = "und"


#: A-Z as a-z: a text in capitals is in the language it is in.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def lower_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    data, off = column_bytes(column)
    return LOWER[data], off


def held_out(id_col: str) -> Column:
    """The fourth of the documents that training never sees."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, length, gram, n) over (lang, text): how often each run of 1 to ORDER + 1 bytes occurs; a run is its bytes as one number.

    Texts are searched for their longest runs alone. Every shorter run begins a longest one, or stands among the last ORDER bytes of a text.
    """
    def run(batches):
        for b in batches:
            for part in slices(b, "text", 1 << 21):
                lang = part.column("lang").to_pylist()
                data, off = lower_bytes(part.column("text"))
                for name in sorted(set(lang)):
                    mine = [data[off[k]: off[k + 1]] for k, x in enumerate(lang) if x == name]
                    for length in range(1, ORDER + 2):
                        grams = np.concatenate([_grams(x if length > ORDER else x[-length:], length) for x in mine])
                        g, n = np.unique(grams.astype(np.uint32), return_counts=True)
                        yield pa.record_batch({"lang": pa.array([name] * len(g), pa.string()), "length": pa.array(np.full(len(g), length), pa.int32()), "gram": pa.array(g.astype(np.int64)), "n": pa.array(n, pa.int64())})
            trim()
        release()
    by = ["lang", "length", "gram"]
    found = labelled.select("lang", "text").mapInArrow(run, "lang string, length int, gram long, n long").groupBy(*by).agg(F.sum("n").alias("n"))
    # a run and those that it begins with
    heads = F.expr("transform(sequence(1, length), k -> struct(k AS length, shiftright(gram, 8 * (length - k)) AS gram))")
    return found.select("lang", F.explode(heads).alias("h"), "n").select("lang", "h.*", "n").groupBy(*by).agg(F.sum("n").alias("n"))


def _grams(data: np.ndarray, length: int) -> np.ndarray:
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.zeros(n, np.int64)
    for k in range(length):
        out = out << 8 | data[k: k + n]
    return out


def training(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(lang, text) of all documents with an id, a language and a text, but the held-out ones."""
    return docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col)) \
        .select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))


class Model:
    """Code lengths of all languages. ``rows``: (lang, length, gram, n), as tuples or an Arrow table."""

    def __init__(self, rows):
        if not isinstance(rows, pa.Table):
            rows = pa.table(dict(zip(("lang", "length", "gram", "n"), map(list, zip(*rows)) if rows else [[]] * 4)))
        self.langs = sorted(rows.column("lang").unique().to_pylist())
        if not self.langs:
            return
        lang = pc.index_in(rows.column("lang"), pa.array(self.langs, pa.string())).to_numpy().astype(np.int64)
        length, gram, n = (rows.column(c).to_numpy().astype(np.int64) for c in ("length", "gram", "n"))
        by = [(gram[x], lang[x], n[x]) for x in (np.flatnonzero(length == k) for k in range(1, ORDER + 2))]
        # what was seen, by order: runs (of context and byte) with their counts, contexts with their costs; each sorted, with its languages side by side
        many, self.runs, self.contexts, below = len(self.langs), [], [], None
        for order, (gram, of, n) in enumerate(by):
            key = gram * many + of
            sort = np.argsort(key)
            key, n = key[sort], n[sort].astype(np.float64)
            gram, of = key // many, key % many
            # a context's bytes stand together, but those of its languages are mixed
            at, back = np.unique((gram >> 8) * many + of, return_inverse=True)
            total, kinds = np.bincount(back, n, len(at)), np.bincount(back, minlength=len(at)).astype(np.float64)
            cost = np.zeros((4, len(at)))
            cost[0], cost[1] = np.log2(total + kinds), np.log2((total + kinds) / kinds)
            if order:  # the next shorter context without the bytes of this one, all of which it has seen too
                low_key, low_n, low_at, low_total, low_kinds = below
                less = np.bincount(back, low_n[np.searchsorted(low_key, (gram & (1 << 8 * order) - 1) * many + of)], len(at))
                up = np.searchsorted(low_at, (at // many & (1 << 8 * (order - 1)) - 1) * many + at % many)
                left, more = low_total[up] - less, low_kinds[up] - kinds
                with np.errstate(divide="ignore", invalid="ignore"):
                    cost[2] = np.where(more > 0, np.log2(left + more), 0)
                    cost[3] = np.where(more > 0, np.log2((left + more) / more), 0)
            else:
                self.rest = np.log2(np.maximum(256 - np.bincount(at % many, kinds, many), 1))
            below = key, n, at, total, kinds
            for keep, k, value in ((self.runs, key, np.log2(n)), (self.contexts, at, cost)):
                what, first = np.unique(k // many, return_index=True)
                keep.append((what, np.append(first, len(k)), (k % many).astype(np.int32), value))

    @staticmethod
    def _found(table, what: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, language, place in the table) of all that ``table`` has for the rows ``use``."""
        keys, first, lang, _ = table
        at = np.searchsorted(keys, what)
        at[at == len(keys)] = 0
        row = np.flatnonzero(use & (keys[at] == what))
        begin, size = first[at[row]], np.diff(first)[at[row]]
        place = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.repeat(row, size), lang[place], place

    def _lengths(self, gram: np.ndarray, have: np.ndarray) -> np.ndarray:
        """(runs, languages): the code length of the last byte of a run, of whose context ``have`` bytes stand in the text."""
        shape = len(gram), len(self.langs)
        cost, done, longer = np.zeros(shape), np.zeros(shape, bool), np.zeros(shape, bool)
        whole, leave = np.zeros(shape), np.zeros(shape)  # of the next context, told by the longer one
        for k in range(ORDER, -1, -1):
            low, use = gram & (1 << 8 * (k + 1)) - 1, have >= k
            row, lang, place = self._found(self.contexts[k], low >> 8, use)
            value = self.contexts[k][3][:, place]
            after = longer[row, lang]
            all_of, escape = np.where(after, whole[row, lang], value[0]), np.where(after, leave[row, lang], value[1])
            whole[row, lang] = all_of
            r, x, p = self._found(self.runs[k], low, use)
            new = ~done[r, x]
            r, x, p = r[new], x[new], p[new]
            cost[r, x] += whole[r, x] - self.runs[k][3][p]
            done[r, x] = True
            cost[row, lang] += np.where(done[row, lang], 0, escape)
            longer[row, lang] = True
            whole[row, lang], leave[row, lang] = value[2], value[3]
        return np.where(done, cost, cost + self.rest)

    def bits(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """(texts, languages): the code length of every text."""
        out, n = np.zeros((len(off) - 1, len(self.langs))), len(data)
        if not n:
            return out
        place = np.arange(n) - np.repeat(off[:-1], np.diff(off))
        have, run = np.minimum(place, ORDER), data.astype(np.int64)
        for k in range(1, ORDER + 1):
            run[k:] |= np.where(place[k:] >= k, data[:-k].astype(np.int64) << 8 * k, 0)
        run |= have << 8 * (ORDER + 1)
        text, step = np.repeat(np.arange(len(off) - 1), np.diff(off)), max(1024, RUNS // len(self.langs))
        for a in range(0, n, step):
            what, at = np.unique(run[a: a + step], return_inverse=True)
            cost = self._lengths(what & (1 << 8 * (ORDER + 1)) - 1, what >> 8 * (ORDER + 1))
            part, first = np.unique(text[a: a + step], return_index=True)
            out[part] += np.add.reduceat(cost[at], first, axis=0)
        return out


def quartiles(seen: DataFrame) -> DataFrame:
    """(lang, k, n, median, upper quartile) of a histogram (lang, k, rate, c), interpolated between neighbours as ``percentile`` does."""
    below = Window.partitionBy("lang", "k").orderBy("rate")
    seen = seen.withColumns({"upto": F.sum("c").over(below), "n": F.sum("c").over(Window.partitionBy("lang", "k"))})

    def at(share: float) -> Column:
        place = (F.col("n") - 1) * F.lit(share)
        low, high = (F.min(F.when(F.col("upto") > x, F.col("rate"))) for x in (F.floor(place), F.ceil(place)))
        return low + (high - low) * F.max(place - F.floor(place))
    return seen.groupBy("lang", "k").agg(F.max("n").alias("n"), at(0.5).alias("median"), at(0.75).alias("upper"))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    small_batches(docs.sparkSession)
    return Model(gram_counts(training(docs, id_col, text_col, lang_col)).toArrow())


def train_halves(docs: DataFrame, id_col: str, text_col: str, lang_col: str):
    """The model of all training texts, those of each half, and by language LENGTHS limits: the most bits a byte of a text of 2**k bytes or more, apart from SPARE."""
    spark = docs.sparkSession
    rows = training(docs, id_col, text_col, lang_col).withColumn("half", (F.crc32(F.col("text").cast("binary")) % 2).cast("string"))
    found = gram_counts(rows.select(F.concat("half", "lang").alias("lang"), "text")).toArrow()
    named = found.set_column(0, "lang", pc.utf8_slice_codeunits(found.column("lang"), 1))
    half = pc.utf8_slice_codeunits(found.column("lang"), 0, 1)
    whole = named.group_by(["lang", "length", "gram"]).aggregate([("n", "sum")]).rename_columns(["lang", "length", "gram", "n"])
    halves = [spark.sparkContext.broadcast(Model(named.filter(pc.equal(half, k)))) for k in "01"]

    def rates(batches):
        for b in batches:
            for part in slices(b, "text", 1 << 19):
                data, off = lower_bytes(part.column("text"))
                size, halved = np.diff(off), part.column("half").to_numpy(zero_copy_only=False)
                for k in range(2):
                    m = halves[1 - k].value
                    of = np.array([m.langs.index(x) if x in m.langs else -1 for x in part.column("lang").to_pylist()], np.int64)
                    for length in range(LENGTHS):
                        use = np.flatnonzero((of >= 0) & (halved == str(k)) & (size >= 1 << length))
                        if len(use):
                            first = off[:-1][use] + (size[use] - (1 << length)) // 2
                            bits = m.bits(data[(first[:, None] + np.arange(1 << length)).reshape(-1)], np.arange(len(use) + 1) << length)[np.arange(len(use)), of[use]]
                            yield pa.record_batch({"lang": part.column("lang").take(pa.array(use)), "k": pa.array(np.full(len(use), length), pa.int32()), "rate": pa.array(np.rint(bits / (1 << length) * STEPS).astype(np.int64))})
            trim()
        release()
    seen = rows.mapInArrow(rates, "lang string, k int, rate long").groupBy("lang", "k", "rate").agg(F.count("*").alias("c"))
    limits: dict[str, np.ndarray] = {}
    for r in quartiles(seen).where(F.col("n") >= FEWEST).orderBy("lang", "k").collect():  # LENGTHS rows a language at most
        median, upper = r["median"] / STEPS, r["upper"] / STEPS
        limits.setdefault(r["lang"], np.full(LENGTHS, np.inf))[r["k"]:] = median + max(median, SPREAD * (upper - median))
    return Model(whole), halves, limits


def explained(whole: Model, halves, limits: dict[str, np.ndarray], spark):
    """A column function: text -> whether it has a letter and a language that explains it."""
    free = set(whole.langs) - set(limits)
    full = spark.sparkContext.broadcast(whole if free else None)

    def judge(texts: pa.Array) -> pa.Array:
        out = []
        for part in slices(pa.table({"text": texts}), "text", 1 << 19):
            column = part.column("text").combine_chunks()
            data, off = column_bytes(column)
            size, raw = np.diff(off), data.tobytes()
            half = np.array([zlib.crc32(raw[a:b]) % 2 for a, b in zip(off[:-1], off[1:])], np.int64)
            raw = LOWER[data].tobytes()
            known = np.zeros(len(size), bool)

            def bits(m, use):
                return m.bits(np.frombuffer(b"".join(raw[off[k]: off[k + 1]] for k in use), np.uint8), np.concatenate(([0], np.cumsum(size[use]))))
            for k in range(2):
                m, use = halves[1 - k].value, np.flatnonzero((half == k) & (size > 0))
                if m.langs and len(use):
                    most = np.array([limits.get(x, np.full(LENGTHS, np.inf)) for x in m.langs])
                    each = bits(m, use)
                    best, n = each.argmin(1), size[use]
                    known[use] = each[np.arange(len(use)), best] <= most[best, np.minimum(np.log2(n).astype(np.int64), LENGTHS - 1)] * n + SPARE
            use = np.flatnonzero(~known & (size > 0))
            if free and len(use):  # languages too small for a limit: perhaps in one half only
                m = full.value
                known[use] = np.array([m.langs[x] in free for x in bits(m, use).argmin(1)], bool)
            wordy = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            out += (known & wordy).tolist()
        return pa.array(out, pa.bool_())
    return F.arrow_udf(_over(judge), "boolean")


def predictor(model: Model, spark):
    """A column function: text -> struct(lang string, score double, bits double); bits is the code length a byte."""
    shared = spark.sparkContext.broadcast(model)

    def score(texts: pa.Array):
        m = shared.value
        lang, share, rate = [], [], []
        for part in slices(pa.table({"text": texts}), "text", 1 << 19):
            column = part.column("text").combine_chunks()
            data, off = lower_bytes(column)
            wordy = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            if not m.langs:
                wordy &= False
                bits = np.zeros((len(wordy), 1))
            else:
                bits = m.bits(data, off)
            best = bits.argmin(1)
            low = bits[np.arange(len(best)), best]
            lang += [m.langs[k] if w else UND for k, w in zip(best, wordy)]
            share += np.where(wordy, 1 / np.exp2(np.maximum(low[:, None] - bits, -1000)).sum(1), 0).tolist()
            rate += np.where(wordy, low / np.maximum(np.diff(off), 1), 0).tolist()
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(share, pa.float64()), pa.array(rate, pa.float64())], ["lang", "score", "bits"])
    return F.arrow_udf(_over(score), "lang string, score double, bits double")


def _over(one):
    """A function of one Arrow array as one of a task's arrays, whose memory is given back at the end."""
    def every(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in batches:
            yield one(x)
            trim()
        release()
    every.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return every


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row a document: id, held_out, lang_pred, score."""
    say = predictor(train(docs, id_col, text_col, lang_col), docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), say(F.col(text_col)).alias("p"))
    return rows.select(F.col("id").alias(id_col), "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs``, all columns, without texts that have no letter or that no language explains by its code length."""
    small_batches(docs.sparkSession)
    say, p = explained(*train_halves(docs, id_col, text_col, lang_col), docs.sparkSession), free_name(docs, "identified")
    return docs.withColumn(p, say(F.col(text_col))).where(F.col(p)).select(*docs.columns)
