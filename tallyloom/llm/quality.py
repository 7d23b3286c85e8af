"""Quality classifier: an interpolated modified Kneser-Ney model of characters in words, trained on trusted text.

The events are the characters of each white-space word, its start and its end, and, before its first character, a sign if the word is the one before
it once more, so that texts of repetitions are as unlikely as they are in trusted text. An n-gram is a character with up to order - 1
characters before it in the word. Orders below the highest use continuation counts (how many different characters come before), except for
n-grams from a word's start, which nothing can precede. Three discounts per order and language come from the counts of counts.
Counts, contexts and probabilities are tables, joined by n-gram; the model's size is counted before it is used:

- up to `bound` n-grams, it is broadcast, and each worker scores a word once for all its documents;
- beyond, documents' n-grams are joined with the sharded tables, order by order, and summed by document. Both give the same.

A document's perplexity is exp(-log-probability / events). Trusted texts are dealt by a hash of the text: four in five train the model, the
others set thresholds, so no text is judged by a model that has seen it. A document is kept if its perplexity is at most its language's threshold:
the `quantile` of that language's held-out trusted documents, times `slack`: a quantile of 0.95 stays where it is if a few trusted documents are odd, and the
slack then keeps good ones beyond it. A language without trusted text on both sides uses all languages' model or
threshold (under the name ''), as does a null language. A text that is null or blank has no perplexity (null) and is not kept. Null ids and
repeated rows come out as they came in. Words longer than LONG are cut into words of that length, so one endless word costs no more than any
other text. An empty table gives an empty one; without trusted text nothing is kept.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import ready, save, small, union

ORDER = 4
LONG = 64
START, END, AGAIN = "\x02", "\x03", "\x04"
_SIGNS = str.maketrans(dict.fromkeys((START, END, AGAIN), " "))
HELD_OUT = 5
_FLUSH = 200_000


def words_of(text: str | None):
    """The words of a text, cut to LONG, with AGAIN before one that is the word before it once more."""
    last = None
    for w in (text or "").translate(_SIGNS).split():
        for part in (w,) if len(w) <= LONG else (w[i : i + LONG] for i in range(0, len(w), LONG)):
            yield AGAIN + part if part == last else part
            last = part


def grams(word: str, order: int = ORDER) -> list[str]:
    """Each character after the start, with its context."""
    w = START + word + END
    return [w[max(0, i - order + 1) : i + 1] for i in range(1, len(w))]


def gram_counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """texts(lang, text): (lang, gram, n); every text also counts for the language ''."""
    ready(texts.sparkSession)

    def run(batches):
        words: dict[tuple[str, str], int] = {}

        def flush():
            counts: dict[tuple[str, str], int] = {}
            for (lang, word), n in words.items():
                for g in grams(word, order):
                    counts[lang, g] = counts.get((lang, g), 0) + n
            words.clear()
            keys = list(counts)
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(counts.values(), pa.int64())], ["lang", "gram", "n"])

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                for w in words_of(text.as_py()):
                    words[lang, w] = words.get((lang, w), 0) + 1
                if len(words) > _FLUSH:
                    yield flush()
        yield flush()

    each = texts.select(F.col("lang").cast("string"), F.col("text").cast("string")).where("text IS NOT NULL")
    sums = each.select(F.coalesce("lang", F.lit("")), "text").mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    sums = save(sums, "grams")
    everything = sums.groupBy("gram").agg(F.sum("n").alias("n")).select(F.lit("").alias("lang"), "gram", "n")
    return sums.where("lang <> ''").unionByName(everything)


def train(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """texts(lang, text): the model (lang, gram, log_p, log_back), one row per n-gram or context; log_p is null where a context is no n-gram itself, log_back where no n-gram goes on from it."""
    raw = save(gram_counts(texts, order), "gram-counts")
    long = F.length("gram")
    begins = F.substring("gram", 1, 1) == START
    levels, above = {}, raw.where((long == order)).select("lang", "gram", F.col("n").alias("a"))
    levels[order] = above = save(above, "level")
    for k in range(order - 1, 0, -1):
        going = above.select("lang", F.expr("substring(gram, 2)").alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("a"))
        own = raw.where((long == k) & begins).select("lang", "gram", F.col("n").alias("a"))
        levels[k] = above = save(going.where(~begins).unionByName(own), "level")
    low = None
    model, backs = [], []
    for k in range(1, order + 1):
        rows = levels[k]
        many = rows.groupBy("lang").agg(*(F.sum((F.col("a") == i).cast("long")).alias(f"n{i}") for i in range(1, 5)))
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        cut = lambda i: F.greatest(F.lit(0.0), F.least(F.lit(float(i)) - 0.01, F.when((F.col("n1") > 0) & (F.col(f"n{i}") > 0), i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")).otherwise(0.5)))
        cuts = many.select("lang", cut(1).alias("d1"), cut(2).alias("d2"), cut(3).alias("d3"))
        cutting = F.when(F.col("a") == 1, F.col("d1")).when(F.col("a") == 2, F.col("d2")).otherwise(F.col("d3"))
        parts = rows.join(F.broadcast(cuts), "lang").withColumn("ctx", F.expr("substring(gram, 1, length(gram) - 1)")).withColumn("cut", cutting)
        ctx = parts.groupBy("lang", "ctx").agg(F.sum("a").alias("all"), F.sum("cut").alias("held")).withColumn("back", F.col("held") / F.col("all"))
        scored = parts.join(ctx.select("lang", "ctx", "all", "back"), ["lang", "ctx"])
        if low is None:
            signs = rows.groupBy("lang").agg((F.count("*") + 1).alias("signs"))
            p = scored.join(F.broadcast(signs), "lang").withColumn("lower", 1 / F.col("signs"))
            model.append(signs.select("lang", F.lit(START + START).alias("gram"), F.log(1 / F.col("signs")).alias("log_p")))
        else:
            p = scored.withColumn("suffix", F.expr("substring(gram, 2)")).join(low.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("lower")), ["lang", "suffix"], "left").withColumn("lower", F.coalesce("lower", F.lit(0.0)))
        low = save(p.select("lang", "gram", ((F.col("a") - F.col("cut")) / F.col("all") + F.col("back") * F.col("lower")).alias("p")), "p")
        model.append(low.select("lang", "gram", F.log("p").alias("log_p")))
        backs.append(ctx.select("lang", F.col("ctx").alias("gram"), F.log(F.greatest("back", F.lit(1e-9))).alias("log_back")))
    return save(union(model).join(union(backs), ["lang", "gram"], "full"), "kneser-ney")


class Scorer:
    """Log-probabilities of words under a model held as {lang: {gram: (log_p, log_back)}}."""

    def __init__(self, model: dict[str, dict[str, tuple[float | None, float | None]]], order: int = ORDER, kept: int = 150_000):
        self.model, self.order, self.kept, self.known = model, order, kept, {}

    def gram(self, table, g: str) -> float:
        """The n-gram's own, or the weights of contexts that stop short and a shorter n-gram's."""
        total = 0.0
        while True:
            found = table.get(g)
            if found and found[0] is not None:
                return total + found[0]
            if len(g) == 1:
                back = table.get("", (None, 0.0))[1] or 0.0
                return total + back + table[START + START][0]
            back = table.get(g[:-1])
            total += (back[1] or 0.0) if back else 0.0
            g = g[1:]

    def text(self, lang: str | None, text: str | None) -> tuple[float, int]:
        """(log-probability, events)."""
        lang = lang if lang in self.model else ""
        table, known = self.model.get(lang), self.known.setdefault(lang, {})
        if table is None:
            return 0.0, 0
        total, events = 0.0, 0
        for w in words_of(text):
            if (s := known.get(w)) is None:
                if len(known) >= self.kept:
                    known.clear()
                s = known[w] = math.fsum(self.gram(table, g) for g in grams(w, self.order))
            total += s
            events += len(w) + 1
        return total, events


def _score_by_broadcast(docs: DataFrame, model: DataFrame, order: int) -> DataFrame:
    tables: dict[str, dict] = {}
    for r in model.toLocalIterator():
        tables.setdefault(r["lang"], {})[r["gram"]] = (r["log_p"], r["log_back"])
    held = docs.sparkSession.sparkContext.broadcast(tables)
    at = (docs.columns.index("lang"), docs.columns.index("text"))
    names = [f"c{i}" for i in range(len(docs.columns))]

    def run(batches):
        scorer = Scorer(held.value, order)
        for b in batches:
            got = [scorer.text(lang, text.as_py()) for lang, text in zip(b.column(at[0]).to_pylist(), b.column(at[1]))]
            cols = [b.column(i) for i in range(len(names)) if i != at[1]]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([x[0] for x in got], pa.float64()), pa.array([x[1] for x in got], pa.int64())], [*(x for i, x in enumerate(names) if i != at[1]), "total", "events"])

    from pyspark.sql.types import DoubleType, LongType, StructField, StructType

    fields = [StructField(names[i], f.dataType) for i, f in enumerate(docs.schema.fields) if i != at[1]]
    out = docs.mapInArrow(run, StructType([*fields, StructField("total", DoubleType()), StructField("events", LongType())]))
    return out.select(*(F.col(names[i]).alias(c) for i, c in enumerate(docs.columns) if i != at[1]), "total", "events")


def _score_by_joins(docs: DataFrame, model: DataFrame, order: int) -> DataFrame:
    ready(docs.sparkSession)
    langs = model.select("lang").distinct()
    keyed = docs.withColumn("row", F.monotonically_increasing_id())
    keyed = save(keyed, "scored-docs")
    own = keyed.join(F.broadcast(langs.select(F.col("lang").alias("has"))), F.col("lang") == F.col("has"), "left").select("row", F.coalesce("has", F.lit("")).alias("lang"), "text")

    def run(batches):
        for b in batches:
            out: dict[tuple[int, str, str], int] = {}
            for row, lang, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                for w in words_of(text):
                    for g in grams(w, order):
                        out[row, lang, g] = out.get((row, lang, g), 0) + 1
            k = list(out)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in k], pa.int64()), pa.array([x[1] for x in k], pa.string()), pa.array([x[2] for x in k], pa.string()), pa.array(out.values(), pa.int64())], ["row", "lang", "gram", "n"])

    left = save(own.mapInArrow(run, "row long, lang string, gram string, n long"), "doc-grams")
    p = model.where("log_p IS NOT NULL").select("lang", "gram", "log_p")
    back = model.where("log_back IS NOT NULL").select("lang", F.col("gram").alias("ctx"), "log_back")
    sums, short = [], [left.where("gram = ''")]
    for _ in range(order):
        met = save(left.where("gram <> ''").join(p, ["lang", "gram"], "left").withColumn("ctx", F.expr("substring(gram, 1, length(gram) - 1)")), "met")
        sums.append(met.where("log_p IS NOT NULL").select("row", (F.col("n") * F.col("log_p")).alias("s"), "n"))
        shorter = met.where("log_p IS NULL").join(back, ["lang", "ctx"], "left").withColumn("b", F.coalesce("log_back", F.lit(0.0)))
        sums.append(shorter.select("row", (F.col("n") * F.col("b")).alias("s"), F.lit(0).cast("long").alias("n")))
        left = save(shorter.select("row", "lang", F.expr("substring(gram, 2)").alias("gram"), "n").groupBy("row", "lang", "gram").agg(F.sum("n").alias("n")), "left")
        short.append(left.where("gram = ''"))
    uniform = model.where(F.col("gram") == START + START).select("lang", "log_p")
    sums.append(union(short).join(F.broadcast(uniform), "lang").select("row", (F.col("n") * F.col("log_p")).alias("s"), "n"))
    total = union(sums).groupBy("row").agg(F.sum("s").alias("total"), F.sum("n").alias("events"))
    return keyed.drop("text").join(total, "row", "left").drop("row").withColumns({"total": F.coalesce("total", F.lit(0.0)), "events": F.coalesce("events", F.lit(0).cast("long"))})


def score(docs: DataFrame, model: DataFrame, order: int = ORDER, bound: int = 600_000) -> DataFrame:
    """docs with text replaced by total (log-probability) and events."""
    ready(docs.sparkSession)
    few = model.limit(bound + 1).count() <= bound
    return (_score_by_broadcast if few else _score_by_joins)(docs, model, order)


def held_out(text="text"):
    """Whether a trusted text sets thresholds instead of training; copies of a text go the same way."""
    return F.pmod(F.xxhash64(text), F.lit(HELD_OUT)) == 0


def classify(docs: DataFrame, trusted_ids: DataFrame, quantile: float = 0.95, slack: float = 1.3, order: int = ORDER, bound: int = 600_000) -> DataFrame:
    """docs(doc_id, text, lang): one row per document: doc_id, lang, n_events, perplexity, threshold, kept. trusted_ids(doc_id): whose text is trusted."""
    ids = small(save(trusted_ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct(), "trusted"), 2_000_000)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.coalesce(held_out(), F.lit(False)).alias("held"))
    model = train(docs.where("NOT held").join(ids, "doc_id", "left_semi"), order)
    scored = save(score(docs, model, order, bound).select("doc_id", "lang", "held", "total", "events"), "scored")
    rows = scored.select("doc_id", "lang", "held", F.col("events").alias("n_events"), F.when(F.col("events") > 0, F.exp(-F.col("total") / F.col("events"))).alias("perplexity"))
    good = rows.where("held AND perplexity IS NOT NULL").join(ids, "doc_id", "left_semi")
    at = F.percentile_approx("perplexity", quantile, 10_000) * slack
    # A row a language, and one for all.
    limits = save(good.where("lang IS NOT NULL").groupBy("lang").agg(at.alias("own")), "limits")
    rest = good.agg(at.alias("rest")).first()["rest"]
    out = rows.join(small(limits, 10_000), "lang", "left").withColumn("threshold", F.coalesce("own", F.lit(rest).cast("double")))
    return out.select("doc_id", "lang", "n_events", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)).alias("kept"))
