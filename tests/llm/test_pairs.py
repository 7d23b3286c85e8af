"""Near-duplicates and decontamination against all pairs."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import cases
from tallyloom.llm import common, components, cross_polytope, decontam, licenses, simhash


def closure(nodes, pairs):
    """Least member of each node's component."""
    label = {n: n for n in nodes}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        label[b] = a
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("seed", range(4))
def test_components(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(500, 600 + i) for i in range(50)]
    edges = spark.createDataFrame([*pairs, (None, 1), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    ends = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == closure(ends, pairs)
    label = np.arange(700)
    for at in range(0, len(pairs), 20):
        p = np.array(pairs[at : at + 20])
        components.unite(label, p[:, 0], p[:, 1])
    want = closure(range(700), pairs)
    assert label.tolist() == [want[i] for i in range(700)]


def test_components_of_nothing(spark):
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


_UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fp_of(text, words=3):
    w = (text or "").translate(_UP).replace("\x0b", " ").replace("\x0c", " ")
    w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", w) if x]
    if not w:
        return 0
    grams = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def changed(rng, text, times):
    w = text.split(" ")
    for _ in range(times):
        w[rng.randrange(len(w))] = cases.word(rng)
    return " ".join(w)


def near_rows(seed):
    rng = random.Random(seed)
    rows = cases.rows()
    for i, n in enumerate((0, 1, 1, 1, 2, 3, 1, 1, 1, 1)):
        rows.append((1000 + i, changed(rng, cases.rows()[i % 3][1] * 4, n), "en", "src0", 0))
    return rows


@pytest.mark.parametrize("segments, radius", [(2, 2), (4, 2), (1, 1), (4, 6)])
def test_simhash_against_all_pairs(spark, segments, radius):
    rows = near_rows(1)
    docs = spark.createDataFrame(rows, cases.SCHEMA).withColumn("fp", F.lit("clash"))
    got = simhash.near_duplicates(docs, radius=radius, segments=segments).collect()
    fps = [fp_of(r[1]) for r in rows]
    part = closure(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= radius])
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[part[i]] = min(least.get(part[i], r[0]), r[0])
    want = sorted(((r[0], fps[i], least.get(part[i])) for i, r in enumerate(rows)), key=repr)
    assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got), key=repr) == want


def test_simhash_of_planted_fingerprints(spark):
    """Links at every distance up to the radius, wherever the bits are."""
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(200)]
    fps = set(base)
    for x in base:
        fps |= {x ^ sum(1 << b for b in rng.sample(range(64), n)) for n in (1, 2, 3)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    got = {frozenset((r.a, r.b)) for r in simhash.links(spark.createDataFrame([(signed(x),) for x in fps], "fp long")).collect()}
    fps = sorted(fps)
    want = {frozenset((signed(x), signed(y))) for i, x in enumerate(fps) for y in fps[:i] if (x ^ y).bit_count() <= 2}
    assert got == want and len(want) >= 400


def test_probes_are_not_broadcast(spark):
    """34 probes a class outgrow the driver long before Spark's estimate of them outgrows the threshold."""
    classes = common.save(spark.createDataFrame([(x * 0x9E3779B97F4A7C,) for x in range(100)], "fp long"), "classes")
    plan = simhash.links(classes)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def shingles(text, k=5):
    w = (text or "").translate(_UP).split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_similar_documents_share_a_group_and_others_do_not(spark):
    rng = random.Random(6)
    base = [cases.prose(rng, rng.choice([60, 150, 400])) for _ in range(40)]
    texts = [*base, *(changed(rng, rng.choice(base), rng.choice([1, 1, 2, 3, 8, 40])) for _ in range(160))]
    texts += [changed(rng, base[0], 1) for _ in range(60)] + [base[1]] * 30 + [base[1].upper(), None, "", " ", "one", "One", "two words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("tie", F.xxhash64("text"))
    for block in (2000, 7):
        grp = {r.id: r.grp for r in simhash.similar_groups(docs, block=block).collect()}
        sets = [shingles(t) for t in texts]
        pairs = [(i, j, jaccard(sets[i], sets[j])) for i in range(len(texts)) for j in range(i)]
        sure = [(i, j) for i, j, s in pairs if s >= 0.85]
        assert sum(grp[i] == grp[j] for i, j in sure) >= 0.99 * len(sure)
        loose = closure(range(len(texts)), [(i, j) for i, j, s in pairs if s >= 0.5])
        assert all(loose[i] == loose[j] for i, j, _ in pairs if grp[i] == grp[j])


def test_the_similarity_decides_on_both_sides(spark):
    """Pairs of 40 to 400 words just at and just below 0.8, none similar to another pair: each is linked as its shingles say."""
    rng, texts = random.Random(8), []
    for _ in range(400):
        w = [f"w{rng.randrange(10**9)}" for _ in range(rng.randint(40, 400))]
        n = len(w) - 4
        below = rng.random() < 0.5
        # The end is cut: similarity is what remains of n.
        keep = -(-4 * n // 5) - (rng.randint(1, max(1, n // 20)) if below else 0)
        texts += [" ".join(w), " ".join(w[: keep + 4])]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("tie", F.xxhash64("text"))
    grp = {r.id: r.grp for r in simhash.similar_groups(docs).collect()}
    want = [jaccard(shingles(texts[i]), shingles(texts[i + 1])) >= 0.8 for i in range(0, len(texts), 2)]
    assert 100 < sum(want) < 300 and [grp[i] == grp[i + 1] for i in range(0, len(texts), 2)] == want


def test_meetings_are_those_of_the_balls(spark):
    """Sets around 0.8 meet by the wide SimHash fingerprints of their shingles, short ones by their remains too, whatever the tables are cut into."""
    rng, hasher = np.random.default_rng(5), simhash.WideHasher(5)
    sets = []
    for n in [*range(1, 16)] * 4 + [40, 41, 120, 300] * 15:
        s = rng.integers(0, 1 << 63, n).astype(np.uint64)
        sets += [s, s[: max(1, -(-4 * n // 5))], np.concatenate((s[n // 8 :], rng.integers(0, 1 << 63, n // 20).astype(np.uint64)))]
    sets = [np.unique(s) for s in sets]
    assert (hasher.margins(sets[-1]) == sum(np.unpackbits(simhash._mixed(x, hasher.by).view(np.uint8), bitorder="little").astype(int) * 2 - 1 for x in sets[-1])).all()
    keys = [hasher.keys(s).view(np.int64) for s in sets]
    S = simhash.SEGMENTS
    balls = [[{(s, int(simhash.ball(k[:S], c)[s])) for c in simhash._BALL} for s in range(S)] for k in keys]
    same = lambda i, j: any(a & b for a, b in zip(balls[i], balls[j])) and sum(int(x).bit_count() for x in (keys[i][S : S + 2] ^ keys[j][S : S + 2]).view(np.uint64)) <= simhash.APART
    want = {(i, j) for i in range(len(sets)) for j in range(i) if same(i, j) or set(keys[i][S + 2 :]) & set(keys[j][S + 2 :])}
    alike = {(i, j) for i in range(len(sets)) for j in range(i) if jaccard(set(sets[i]), set(sets[j])) >= 0.8}
    classes = spark.createDataFrame([(i, k.tolist()) for i, k in enumerate(keys)] + [(9999, [])], "rep long, keys array<long>").repartition(3)
    for room in (1 << 20, 50):
        by = {}
        for r in simhash.meetings(classes, len(keys), room).collect():
            by.setdefault((r.band, r.key), set()).add(r.rep)
        got = {(i, j) for m in by.values() for i in m for j in m if j < i}
        assert alike <= want <= got and 200 < len(alike) and all(len(m) > 1 for m in by.values()) and len(got) < 2 * len(want)


def test_groups_of_a_family_are_those_of_all_pairs(spark):
    """Variants of one text around 0.8, also in blocks of a few rows."""
    rng = random.Random(9)
    base = cases.prose(rng, 150)
    texts = [changed(rng, base, rng.choice([1, 2, 3, 4])) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("tie", F.xxhash64("text"))
    sets = [shingles(t) for t in texts]
    want = closure(range(80), [(i, j) for i in range(80) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8])
    for block in (2000, 3):
        grp = {r.id: r.grp for r in simhash.similar_groups(docs, block=block).collect()}
        assert all((grp[i] == grp[j]) == (want[i] == want[j]) for i in range(80) for j in range(i))


def test_one_of_each_group_stays(spark):
    rng = random.Random(7)
    a, b = cases.prose(rng, 200), cases.prose(rng, 200)
    rows = [(5, a), (3, changed(rng, a, 1)), (9, a), (None, a), (7, b), (7, b), (None, cases.prose(rng, 50)), (20, None), (21, ""), (22, "  ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("tie", "row", "times", "best_id", "grp", "id")})
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.tie) for r in got.collect()), key=repr) == sorted([(3, "tie"), (7, "tie"), (None, "tie"), (20, "tie")], key=repr)
    assert simhash.keep_one(cases.empty(spark)).count() == 0
    assert simhash.keep_one(cases.frame(spark)).columns == cases.frame(spark).columns


def vectors(seed, dim, n):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    near = base[rng.integers(0, n, 2 * n)] + rng.normal(size=(2 * n, dim)) * rng.choice([0.05, 0.2, 0.3, 0.5], (2 * n, 1))
    hot = base[0] + rng.normal(size=(150, dim)) * 0.1
    return np.concatenate((base, near, hot, base[:5], base[:5] * 3.0)).astype(np.float32)


@pytest.mark.parametrize("dim, block", [(16, 1000), (48, 40), (3, 25)])
def test_embeddings_against_all_pairs(spark, dim, block):
    x = vectors(dim, dim, 120)
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    odd = [None, [], [0.0] * dim, [float("nan")] * dim, [float("inf")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), [1.0] * (dim + 1), [v * 1e-300 for v in rows[1][1]]]
    rows += [(5000 + i, v) for i, v in enumerate(odd)] + [(5100, [2.0] * (dim + 1)), (None, rows[0][1])]
    got = cross_polytope.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rep", F.lit("clash")), block=block).collect()
    assert len(got) == len(rows)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    true = linked.sum(1)
    true[linked[0]] += 1  # the row without an id equals row 0
    true[0] += 1
    true[linked[1]] += 1  # and the tiny one row 1
    true[1] += 1
    by_id = {r.vec_id: r for r in got}
    have = np.array([by_id[i].n_links for i in range(len(x))])
    assert (have <= true).all() and have.sum() >= 0.95 * true.sum()
    want = closure(range(len(x)), [(i, j) for i, j in zip(*np.nonzero(linked))])
    assert sum(by_id[i].component_id == want[i] for i in range(len(x))) >= 0.95 * len(x)
    for i in range(6):
        assert (by_id[5000 + i].n_links, by_id[5000 + i].component_id, by_id[5000 + i].kept) == (0, 5000 + i, True)
    assert by_id[5100].component_id == 5006 and by_id[5006].n_links == 1 and by_id[None].component_id == 0


def test_links_through_a_third(spark):
    """Two vectors that only a third links, later in the order, are one component."""
    a, c = np.array([1.0, 0.0, 0.0, 0.0]), np.array([np.cos(0.8), np.sin(0.8), 0, 0])
    b = a + c
    rows = [(1, a.tolist()), (2, c.tolist()), (3, b.tolist())]
    got = cross_polytope.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), tables=32, probes=8).collect()
    assert {(r.vec_id, r.n_links, r.component_id) for r in got} == {(1, 1, 1), (2, 1, 1), (3, 2, 1)}


def test_recall_on_the_registered_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = {r.vec_id: r.n_links for r in cross_polytope.near_duplicates(df).collect()}
    rows = [(r.vec_id, r.embedding) for r in df.collect() if r.embedding and all(v is not None and np.isfinite(v) for v in r.embedding) and any(r.embedding)]
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = (x @ x.T >= 0.9).sum(1) - 1
    assert sum(got[i] for i, _ in rows) >= 0.9 * true.sum() and all(got[i] <= t for (i, _), t in zip(rows, true))


ITEM = "A farmer named Tobias sells 14 crates of apples for 3 dollars each. How many dollars does Tobias earn if he sells all 14 crates before noon today?"
OTHER = "The old lighthouse keeper counted seven grey gulls above the northern pier while his tired dog slept beside the coiled ropes and waited."
BENCH = [(1, ITEM), (2, OTHER), (3, "too short here"), (4, None), (5, "")]


def contaminated(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit(c) for c in ("t1", "key", "item_id", "lit", "start")})
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    found = decontam.report(docs, bench, **options)
    clean = decontam.clean(docs, bench, **options)
    assert clean.columns == docs.columns
    out = sorted((r.doc_id, r.item_id) for r in found.collect())
    assert sorted(r.doc_id for r in clean.collect()) == [i for i in range(len(texts)) if i not in {d for d, _ in out}]
    return out


def test_decontamination(spark):
    rng = random.Random(1)
    pad = lambda: cases.prose(rng, 80)
    again = ITEM.replace("Tobias", "Marietta").replace("14", "250").replace("3 ", "9 ").replace("dollars", "euros")
    mixed = ITEM.replace("Tobias", "Marietta", 1).replace("14", "250", 1)
    texts = [
        f"{pad()} {ITEM} {pad()}",  # a passage
        ITEM.upper(),  # by its literal windows
        f"{pad()}\n{again}\n{pad()}",  # another name, other numbers and units
        f"{pad()} {mixed} {pad()}",  # one name becomes two
        pad(),
        f"{pad()} {ITEM[:40]} {pad()}",  # too little of it
        f"{OTHER} {pad()} {ITEM}",  # two items
        None,
        "",
        "too short here",
        f"{pad()} " * 200 + OTHER,  # at the end of a long text
        ITEM.replace(".", " ...").replace(" ", "  \n"),
        f"{pad()} " + " ".join(OTHER.split()[4:19]) + f" {pad()}",  # a long run of an item
    ]
    want = [(0, 1), (1, 1), (2, 1), (6, 1), (6, 2), (10, 2), (11, 1), (12, 2)]
    assert contaminated(spark, texts) == want
    assert contaminated(spark, texts, bound=0) == want  # by a shuffle join


def test_several_copies_in_one_document(spark):
    """Each copy has its own values: a name changed in one is no contradiction to the others."""
    rng = random.Random(3)
    pad = lambda: cases.prose(rng, 40)
    other = lambda name, count: ITEM.replace("Tobias", name).replace("14", count)
    split = ITEM.replace("dollars each", "shiny dollars each")
    texts = [
        f"{pad()} {ITEM} {pad()} {other('Marietta', '250')} {pad()}",
        f"{ITEM} {other('Marietta', '250')}",
        f"{pad()} {other('Marietta', '250')} {pad()} {other('Oswin', '31')} {pad()}",
        f"{split} {other('Marietta', '250')} {pad()}",
        f"{pad()} {ITEM.replace('Tobias', 'Marietta', 1).replace('14', '250', 1)} {pad()}",
    ]
    for bound in (500_000, 0):
        assert contaminated(spark, texts, bound=bound) == [(i, 1) for i in range(4)]


def test_two_items_of_one_template_in_one_document(spark):
    twin = ITEM.replace("Tobias", "Marietta").replace("14", "250")
    docs = spark.createDataFrame([(1, f"{ITEM}\n{twin}")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, ITEM), (2, twin)], "item_id long, text string")
    assert sorted(r.item_id for r in decontam.report(docs, bench).collect()) == [1, 2]


def test_names_that_begin_sentences(spark):
    """A name at the start of a sentence is a slot like one within it, and must be consistent too."""
    item = "Anna has 5 apples. Ben has 3 apples. Cleo has 7 apples. Anna eats 5 apples. Ben eats 3 apples. Cleo eats 7 apples."
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rng = random.Random(5)
    pad = lambda: cases.prose(rng, 40)
    other = item.replace("Anna", "Dora").replace("Ben", "Emil").replace("Cleo", "Fritz").replace("5", "90").replace("3", "21").replace("7", "16")
    wrong = "Dora has 9 apples. Emil has 2 apples. Fritz has 4 apples. Gero eats 6 apples. Hilda eats 1 apples. Ines eats 8 apples."
    texts = [other, f"{pad()}\n{other}\n{pad()}", "When asked, " + other, wrong, pad(), item, f"{item}\n{wrong}", "Apples " * 30]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for bound in (500_000, 0):
        assert sorted(r.doc_id for r in decontam.report(docs, bench, bound=bound).collect()) == [0, 1, 2, 5, 6]


def test_items_of_four_tokens_are_matched_whole(spark):
    bench = spark.createDataFrame([(1, ITEM), (7, "Name every prime below"), (8, "two words"), (None, "Name the odd one")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "name every PRIME, below!"), (2, "He said: name every prime below."), (3, "name every prime"), (4, "two words"), (5, ITEM), (6, "name every odd below"), (7, "Name every prime below thirty. " * 20)], "doc_id long, text string")
    for bound in (500_000, 0):
        got = {(r.doc_id, r.item_id): (r.coverage, r.longest_run) for r in decontam.report(docs, bench, bound=bound).collect() if r.item_id is not None}
        assert got.keys() == {(1, 7), (2, 7), (7, 7), (5, 1)}
        assert got[1, 7] == (1.0, 4)
    assert sorted(r.doc_id for r in decontam.clean(docs, bench).collect()) == [3, 4, 6]


def test_decontamination_of_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, ITEM), (1, ITEM), (None, ITEM), (2, "clean")], "doc_id long, text string")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    assert [r.doc_id for r in decontam.report(docs, bench).orderBy("doc_id").collect()] == [None, 1, 1]
    assert [r.doc_id for r in decontam.clean(docs, bench).collect()] == [2]
    assert decontam.report(cases.empty(spark), bench).count() == 0
    assert decontam.clean(docs, bench.where("false")).count() == 4
    assert decontam.clean(cases.frame(spark), bench).count() == len(cases.rows())


def test_registered_passages_are_found(spark):
    """Every document that holds a whole benchmark text is found."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items if t and len(t.split()) >= 8 and t in (r.text or "")}
    got = {(r.doc_id, r.item_id) for r in decontam.report(docs, bench).collect()}
    assert want <= got and len(want) >= 5


def test_licenses(spark):
    mit = licenses.LICENSES["MIT"][0]
    british = "Copyright (c) 2020 Someone\nAll rights reserved.\n\n" + licenses.LICENSES["MIT"][1].replace("sublicense", "sub-licence").upper()
    rows = [(1, mit), (2, british), (3, mit + " and more"), (4, None), (5, ""), (6, "Copyright 2020 me"), (7, "© you"), (None, licenses.LICENSES["Zlib"][0]), (8, mit), (9, "x" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit("clash")).withColumn("license", F.lit("clash"))
    got = {(r.doc_id, r.license, r.digest is None) for r in licenses.scan(docs).collect()}
    assert got == {(1, "MIT", False), (2, "MIT", False), (3, None, False), (4, None, True), (5, None, True), (6, None, True), (7, None, True), (None, "Zlib", False), (8, "MIT", False), (9, None, False)}
    assert licenses.scan(cases.empty(spark)).count() == 0
    assert len(licenses.digests()) == sum(map(len, licenses.LICENSES.values()))


@pytest.mark.parametrize("name", list(licenses.LICENSES))
def test_every_license_in_both_forms(spark, name):
    for text in licenses.LICENSES[name]:
        df = spark.createDataFrame([(text,)], "t string").select(licenses.canonical(F.col("t")))
        assert df.first()[0] == licenses.canonical_text(text)


def test_spellings_that_follow_one_another(spark):
    df = spark.createDataFrame([("a Licence licence, sub license LICENCES per cent",)], "t string").select(licenses.canonical(F.col("t")))
    assert df.first()[0] == licenses.canonical_text("a Licence licence, sub license LICENCES per cent") == "a license license sublicense licenses percent"


def test_notices(spark):
    rows = [(1, "Some text.\n  Released under the MIT licence\nmore"), (2, "licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0."), (3, "It is not Released under the MIT License. So there."), (4, None), (5, ""), (6, "Released under the MIT License."), (7, "x licence " * 5000 + "\nReleased under CC0 1.0")]
    got = {r.doc_id: (r.license, r.notices) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (None, "MIT"), 2: (None, "Apache-2.0,CC-BY-NC-4.0"), 3: (None, None), 4: (None, None), 5: (None, None), 6: ("MIT", "MIT"), 7: (None, "CC0-1.0")}


def test_digests_are_those_of_the_published_texts(spark):
    import pathlib

    here = pathlib.Path("/usr/share/common-licenses")
    files = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "GFDL-1.3": "GFDL-1.3"}
    rows = [(k, (here / f).read_text(encoding="utf-8")) for k, f in files.items() if (here / f).exists()]
    if not rows:
        pytest.skip("no licence texts on this machine")
    rows += [("Apache-2.0", t.upper().partition("END OF TERMS AND CONDITIONS")[0]) for k, t in rows if k == "Apache-2.0"]
    docs = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(rows)], "doc_id long, truth string, text string")
    got = licenses.scan(docs).join(docs.select("doc_id", "truth"), "doc_id").collect()
    assert len(got) == len(rows) and all(r.license == r.truth for r in got)


def test_the_query_equals_its_sql(spark):
    import duckdb

    from tallyloom.llm import queries

    rows = [(i, t) for i, t in enumerate([x for texts in licenses.LICENSES.values() for x in texts] + [f"a\n{x}\nb" for texts in licenses.NOTICES.values() for x in texts] + [None, "", "licence licence", "© 2020\n\n", "Ünïcode LICENCE\n(c) x"])]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = con.sql(f"SELECT doc_id, digest, license, notices FROM ({queries.ORACLE['op8_license_scan']})").fetchall()
    assert sorted(tuple(r[c] for c in ("doc_id", "digest", "license", "notices")) for r in got) == sorted(want)
    assert sum(r.license is not None for r in got) == sum(map(len, licenses.LICENSES.values())) and sum(r.notices is not None for r in got) == sum(map(len, licenses.NOTICES.values()))
