"""Benchmark decontamination by template canonicalisation.

A text becomes tokens (runs of letters and digits). In its template, numbers, names (a capital and a small letter, not at the start of a
sentence) and units are replaced by typed placeholders; the literal form is lower-cased tokens. Every window of five tokens,
in both forms, is hashed and joined with the windows of the benchmark. What matches along alignments of a document with an
item counts: a document is contaminated by an item if the matched windows cover `coverage` of the item's tokens, or an unbroken
run of `run` tokens, and if the slots are consistent: the item's value of a slot (say, one name) must stand for the same
value wherever it recurs, for `consistency` of the values.

A document may hold several copies with different values, so that is asked of each alignment alone, of each chain of neighbouring ones (a copy
with words put in; of windows met by several, the alignment with most windows counts), and of all together; one that qualifies is enough.
Literal windows that cover `coverage` qualify without slots. A literal run alone does not: names changed in the rest of a copy must agree.

A capital at the start of a sentence may be a name or not ("Anna has 5 apples. Ben has 3 apples."). Windows that hold one are hashed with it as a
word and again with it as a name. A pair that meets in the latter way is judged twice: without those windows, as if there were no such names, and with
them, where the word is a slot whose value must agree too (unless it is the same wherever it stands, which proves nothing).

Windows of the template with fewer than `literal_min` ordinary tokens say too little and are not used. An item of four tokens is a literal window of
its own length; items of fewer (`shortest`) match nothing. Null and empty texts on either side match nothing, and an empty table on either side finds nothing. Repeated documents share a row of findings by the digest of their
text and come out as often as they came in; null ids are kept. Columns besides ids and texts are ignored, or passed through by clean().

A template window without a placeholder is its literal window, so only literal windows stand for those. Items with so many placeholders that
no such window is left match in their literal form only.

Only DataFrame functions are used. The benchmark's windows are broadcast after they are counted, otherwise joined by a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import digest, save, small

SIZE = 5
UNITS = "kg g mg km m cm mm mile miles mph inch inches foot feet yard yards lb lbs pound pounds ounce ounces litre litres liter liters ml second seconds minute minutes hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents degree degrees celsius fahrenheit watt watts volt volts joule joules newton newtons".split()
#: Code points for private use stand for a number and a name in a text's template, and a third for a unit.
NUMBER, NAME, UNIT = "\ue000", "\ue001", "\ue002"
#: And one for a word that has a capital because a sentence starts there, and may be a name.
MAYBE = "\ue003"
#: Which windows of a document and an item are judged together.
ALL, LINE, CHAIN, LITERAL = range(4)
TEXT = ["t1", "t2"]
_START = r"(?<![^ ])"


def words(text: Column) -> Column:
    """A text's tokens, one space between them, with _ before one that has a capital only because a sentence starts there."""
    s = F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("_"), F.lit(" "))
    s = F.regexp_replace(s, r"[.,](?<=\p{N}[.,])(?=\p{N})", "")
    s = F.regexp_replace(s, r"(?=\p{Lu})(?<=(?:^|[.!?:\n])[^\p{L}\p{N}]{0,8})", "_")
    return F.trim(F.regexp_replace(s, r"[^\p{L}\p{M}\p{N}_]+", " "))


def literal(s: Column) -> Column:
    return F.split(F.lower(F.replace(s, F.lit("_"), F.lit(""))), " ")


def template(s: Column) -> Column:
    """The same tokens with placeholders for numbers, names and words that may be names. Units are recognised by place()."""
    s = F.regexp_replace(F.regexp_replace(s, _START + r"\p{N}[^ ]*", NUMBER), _START + r"\p{Lu}\p{Ll}[^ ]*", NAME)
    return literal(F.regexp_replace(s, _START + r"_\p{Lu}\p{Ll}[^ ]*", MAYBE))


def place(token: Column, word: Column) -> Column:
    """The placeholder that a token of a template is, whose literal form is word, or null."""
    return F.when(token.isin(NUMBER, NAME), token).when(word.isin(UNITS), UNIT).when(token == MAYBE, MAYBE)


def windows(df: DataFrame, keep: list[str], short: list[int] = []) -> DataFrame:  # noqa: B006
    """df has text: keep, lit, tpl (arrays of tokens), start, form and key: a hash for the literal window at each start (form 0), for the template
    window (1), for the template window in which words that may be names are names, or null if it has none (2), and for a literal window of each length in short (3 on).

    Nothing filters by the tokens before the explode, or they would be computed twice (so would an inner explode, for its own filter on the size). Tokens are hashed once, in arrays; windows are hashed after the explode, in generated code, from five longs each.
    """
    parts = df.select(*keep, words(F.col("text")).alias("s")).select(*keep, literal(F.col("s")).alias("lit"), template(F.col("s")).alias("tpl"))
    plain = F.zip_with("tpl", "lit", lambda t, w: F.xxhash64(F.when(t.isin(NUMBER, NAME), t).when(w.isin(UNITS), UNIT).otherwise(w)))
    wide = F.transform("tpl", lambda t: F.xxhash64(F.when(t.isin(UNITS), UNIT).when(t == MAYBE, NAME).otherwise(t)))
    parts = parts.select(*keep, "lit", "tpl", F.transform("lit", lambda t: F.xxhash64(t)).alias("hl"), plain.alias("ht"), wide.alias("hw"))
    rows = parts.select(*keep, "lit", "tpl", "hl", "ht", "hw", F.posexplode_outer("hl").alias("start", "first")).where(F.col("start") + min([SIZE, *short]) <= F.size("hl"))
    fits = lambda size, key: F.when(F.col("start") + size <= F.size("hl"), key) if short else key
    keys = [fits(SIZE, _key(0, F.col("hl"), SIZE)), fits(SIZE, _key(1, F.col("ht"), SIZE)), fits(SIZE, F.when(_differ("ht", "hw"), _key(1, F.col("hw"), SIZE))), *(fits(k, _key(1 + k, F.col("hl"), k)) for k in short)]
    return rows.select(*keep, "lit", "tpl", "start", F.posexplode(F.array(*keys)).alias("form", "key"))


def _key(kind: int, hashes: Column, size: int) -> Column:
    """The hash of the window at start; kind: 0 literal, 1 template, 1 + size of a short literal one."""
    return F.xxhash64(F.lit(kind), *(F.get(hashes, F.col("start") + i) for i in range(size)))


def _differ(a: str, b: str) -> Column:
    return reduce(Column.__or__, (F.get(a, F.col("start") + i) != F.get(b, F.col("start") + i) for i in range(SIZE)))


def _at(column: str) -> Column:
    return F.slice(column, F.col("start") + 1, SIZE)


def short_lengths(benchmark: DataFrame, shortest: int) -> list[int]:
    """The lengths of items that are shorter than a window, but not too short."""
    n = F.size(literal(words(F.col("text"))))
    # At most SIZE rows, whatever the benchmark.
    return sorted(r["n"] for r in benchmark.select(n.alias("n")).where((F.col("n") >= shortest) & (F.col("n") < SIZE)).distinct().collect())


def benchmark_windows(benchmark: DataFrame, literal_min: int, short: list[int]) -> DataFrame:
    """(key, item_id, n, at, theirs_named, values): literal windows, template windows that have a placeholder and enough other tokens, and short items whole."""
    w = windows(benchmark.select("item_id", "text"), ["item_id"], short).where("key IS NOT NULL")
    types, n = F.zip_with(_at("tpl"), _at("lit"), place), F.size("lit")
    places = F.size(F.filter(types, lambda x: x.isNotNull() & ((F.col("form") == 2) | (x != MAYBE))))
    # A short window in a longer item is no window of it.
    whole = [(F.col("form") == 3 + i) & (n == k) for i, k in enumerate(short)]
    wanted = reduce(Column.__or__, whole, (F.col("form") == 0) | (F.col("form").isin(1, 2) & (places > 0) & (places <= SIZE - literal_min)))
    w = w.where(wanted)
    return w.select("key", "item_id", F.size("lit").alias("n"), F.col("start").alias("at"), (F.col("form") == 2).alias("theirs_named"), _at("lit").alias("values"))


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.8, run: int = 13, consistency: float = 0.8, literal_min: int = 3, bound: int = 500_000, shortest: int = 4) -> DataFrame:
    """(t1, t2, item_id, n_windows, coverage, longest_run, consistency): contaminated texts by their digests."""
    short = short_lengths(benchmark, shortest)
    index = save(benchmark_windows(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text"), literal_min, short), "bench-windows")
    t1, t2 = digest(F.coalesce(F.col("text").cast("string"), F.lit("")))
    own = windows(docs.select(t1.alias("t1"), t2.alias("t2"), "text"), TEXT, short)
    known = small(index, bound)
    if known is index:
        # Windows go through a shuffle: each with its own five tokens, not with its text.
        own = own.select(*TEXT, _at("lit").alias("lit"), _at("tpl").alias("tpl"), "start", "form", "key", F.lit(0).alias("from"))
    else:
        own = own.withColumn("from", F.col("start"))
    met = own.join(known, "key")
    ours = lambda j: F.get("lit", F.col("from") + j)
    slot = lambda j: F.struct(place(F.get("tpl", F.col("from") + j), ours(j)).alias("type"), F.get("values", F.lit(j)).alias("theirs"), ours(j).alias("ours"))
    same = F.slice("lit", F.col("from") + 1, F.size("values")) == F.col("values")
    hits = met.select(*TEXT, "item_id", "n", (F.col("start") - F.col("at")).alias("line"), "at", same.alias("same"), F.filter(F.array(*map(slot, range(SIZE))), lambda x: x["type"].isNotNull() & x["theirs"].isNotNull()).alias("slots"), ((F.col("form") == 2) | F.col("theirs_named")).alias("named"))
    hits = hits.groupBy(*TEXT, "item_id", "n", "line", "at", "same", "slots").agg(F.min("named").alias("named"))
    return _judged(save(hits, "bench-hits"), coverage, run, consistency)


def _variants(hits: DataFrame) -> DataFrame:
    """hits with wide: 0 for those that need no word at the start of a sentence to be a name, without its slots, and 1 for all of a pair that has others."""
    some = F.max("named").over(Window.partitionBy(*TEXT, "item_id"))
    wide = F.when(F.col("named"), F.array(F.lit(1))).when(F.col("some"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = hits.withColumn("some", some).withColumn("wide", F.explode(wide)).drop("named", "some")
    return rows.withColumn("slots", F.when(F.col("wide") == 1, F.col("slots")).otherwise(F.filter("slots", lambda x: x["type"] != MAYBE)))


def _scoped(hits: DataFrame) -> DataFrame:
    """hits of alignments, once for each scope that they count in: (scope, part)."""
    pair, line = [*TEXT, "item_id", "wide"], [*TEXT, "item_id", "wide", "line"]
    # Alignments of a single chance window don't count, unless the item has no more.
    met = F.count("*").over(Window.partitionBy(*line))
    aligned = hits.withColumn("met", met).where(F.col("met") >= F.least(F.lit(3), F.col("n") - (SIZE - 1)))
    ordered = Window.partitionBy(*pair).orderBy("line")
    aligned = aligned.withColumn("before", F.lag("line").over(ordered)).withColumn("chain", F.sum(F.coalesce(((F.col("line") - F.col("before")) * 2 > F.col("n")).cast("long"), F.lit(0))).over(ordered))
    best = F.max(F.struct("met", -F.col("line"))).over(Window.partitionBy(*pair, "chain", "at"))
    aligned = aligned.withColumn("best", best["met"].isNotNull() & (-best["col2"] == F.col("line")))
    scope = lambda name, part: F.struct(F.lit(name).alias("scope"), F.col(part).cast("long").alias("part") if part else F.lit(0).cast("long").alias("part"))
    scopes = F.array(scope(ALL, None), scope(LINE, "line"), F.when(F.col("best"), scope(CHAIN, "chain")), F.when(F.col("same"), scope(LITERAL, None)))
    return aligned.select(*line, "n", "at", "slots", F.explode(F.filter(scopes, lambda x: x.isNotNull())).alias("s")).select(*line, "n", "at", "slots", "s.scope", "s.part")


def _judged(hits: DataFrame, coverage: float, run: int, consistency: float) -> DataFrame:
    """hits (t1, t2, item_id, n, line, at, same, slots, named): the pairs that qualify in some scope, with the figures of the one that covers most."""
    pair = [*TEXT, "item_id"]
    part = [*pair, "wide", "scope", "part"]
    scoped = save(_scoped(_variants(hits)), "bench-scoped")
    island = scoped.withColumn("g", F.col("at") - F.row_number().over(Window.partitionBy(*part, "line").orderBy("at")))
    runs = island.groupBy(*part, "line", "g", "n").agg(F.count("*").alias("k")).groupBy(*part).agg(F.max(F.least(F.col("k") + (SIZE - 1), F.col("n"))).alias("longest_run"))
    tokens = F.array_distinct(F.flatten(F.transform("starts", lambda at: F.sequence(at, F.least(at + (SIZE - 1), F.col("n") - 1)))))
    covered = scoped.groupBy(*part, "n").agg(F.collect_set("at").alias("starts")).select(*part, F.size("starts").cast("long").alias("n_windows"), (F.size(tokens) / F.col("n")).alias("coverage"))
    maybe, changed = F.col("s.type") == MAYBE, F.col("s.theirs") != F.col("s.ours")
    slots = scoped.select(*part, F.explode("slots").alias("s")).groupBy(*part, F.when(maybe, NAME).otherwise(F.col("s.type")).alias("type"), "s.theirs").agg(F.countDistinct("s.ours").alias("k"), F.max(~maybe | changed).alias("counts"))
    agree = slots.where("counts").groupBy(*part).agg(F.avg((F.col("k") == 1).cast("double")).alias("consistency"))
    found = covered.join(runs, part).join(agree, part, "left").withColumn("consistency", F.coalesce("consistency", F.lit(1.0)))
    enough = (F.col("coverage") >= coverage) | ((F.col("scope") != LITERAL) & (F.col("longest_run") >= run))
    best = found.where(enough & (F.col("consistency") >= consistency)).groupBy(*pair).agg(F.max(F.struct("coverage", "longest_run", "consistency", "n_windows")).alias("b"))
    return best.select(*pair, "b.n_windows", "b.coverage", "b.longest_run", "b.consistency")


def _with_digest(docs: DataFrame) -> DataFrame:
    t1, t2 = digest(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), t1.alias("t1"), t2.alias("t2"))


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per contaminated document and item: doc_id, item_id, n_windows, coverage, longest_run, consistency."""
    found = small(save(contaminated(docs, benchmark, **options), "contaminated"))
    return _with_digest(docs.select("doc_id", "text")).join(found, TEXT).select("row.doc_id", "item_id", "n_windows", "coverage", "longest_run", "consistency")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the contaminated ones."""
    found = small(save(contaminated(docs, benchmark, **options).select(*TEXT).distinct(), "contaminated"))
    return _with_digest(docs).join(found, TEXT, "left_anti").select("row.*")
