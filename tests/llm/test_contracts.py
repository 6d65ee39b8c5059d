"""Each operator against its plain version: given tables, and rows made to be awkward."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tramorisk.llm import additive, jaccard, kernels, lattice, licences, maxent, mixing, pii, suffixes, wumanber

FOLDER = "/root/testdata/sf0.001"
LONG = " ".join(f"wort{i % 977} straße{i * 7 % 613}" for i in range(6000))
PASSAGE = " ".join(f"p{i}q" for i in range(60))
AWKWARD = [
    (1, None, "en", "s0"), (2, "", "en", "s0"), (3, "   \t\n", None, "s1"), (4, "one", "de", "s1"), (5, "one two three", "fr", None),
    (6, LONG, "de", "s0"), (7, LONG, "de", "s0"), (8, LONG + " tail", "en", "s0"), (None, "no id at all here we go", "en", "s0"),
    (9, PASSAGE, "en", "s2"), (10, f"start {PASSAGE} end", "en", "s2"), (11, f"{PASSAGE} {PASSAGE}", None, "s2"), (12, "ab" * 400, "en", "s2"),
    (13, "x" * 199, "en", "s3"), (14, "x" * 200, "en", "s3"), (15, "x" * 201, "en", "s3"), (9, PASSAGE, "en", "s2"), (16, "ONE Two three", "fr", "s9"),
    (17, "mail a@b.c, a@b.com_x@c.de or x@y@z.org. call +1 (456) 555-2186 from 1.2.3.4.5.6.7.8 or 300.1.1.1, 010.0.0.255", "en", "s3"),
    (18, "card 4111 1111 1111 1111, 4111-1111-1111-1112 and 1 2 3 4 5 6 7 8 9 0 1 2 3 " + "7 " * 3000, "en", "s3"),
    (19, " 12 émile@exämple.org 𝒳𝒴 é@ü.com a@b.co.uk. ip 1.2.3 IBAN GB82 WEST 1234 5698 7654 32 ok DE89370400440532013000", "fr", "s3"),
    (20, "The MIT-License; apache\nlicense GNU General Public License, mit license amit license mit licenses MIT LICENSE", "en", "s3"),
    (21, "12345 67890 !!! ???", "en", "s3"), (22, "İstanbul K mit license", "en", "s3"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, "doc_id long, text string, lang string, source string").withColumn("n_words", F.lit("clash")).withColumn("key", F.lit(1))


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def same(df, columns, wanted):
    assert rows(df, *columns) == sorted(wanted, key=repr)


@pytest.mark.parametrize("name", ["awkward", "given", "empty"])
def test_suffixes(request, name):
    docs = request.getfixturevalue(name)
    same(suffixes.repeated_spans(docs), ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], brute.repeated_spans(texts(docs)))


def test_cover_reaches_every_distance():
    assert {int(a - b) % suffixes.MODULUS for a in suffixes.COVER for b in suffixes.COVER} == set(range(suffixes.MODULUS))


def test_suffixes_over_several_blocks(spark, monkeypatch):
    """A crowd of near copies of one text, cut into many ranges and blocks."""
    word = np.random.default_rng(5).integers(0, 5000, (120, 90))
    docs = spark.createDataFrame([(i, " ".join(f"w{x}" for x in (word[0] if i % 3 else word[i])) + f" {i}") for i in range(120)], "doc_id long, text string")
    same(suffixes.repeated_spans(docs.repartition(9)), ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], brute.repeated_spans(texts(docs)))


@pytest.mark.parametrize("name", ["awkward", "given", "empty"])
def test_pii(request, name):
    docs = request.getfixturevalue(name)
    wanted = []
    for d, t in texts(docs):
        spans = brute.pii(t)
        wanted.append((d, *(sum(s[0] == k for s in spans) for k in pii.BASE_KINDS), brute.sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans))))
    same(pii.pii_report(docs), ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"], wanted)


def test_pii_added_kinds_and_scores(awkward):
    found = {r["doc_id"]: r["pii"] for r in pii.find_pii(awkward).collect()}
    assert [s["value"] for s in found[19] if s["kind"] == "iban"] == ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"]
    by_value = {s["value"]: s["score"] for s in found[17]}
    assert by_value["a@b.c"] > pii.DETECTORS["email"].prior - 1e-9 and all(0 <= x <= 1 for x in by_value.values())


def test_redaction(awkward):
    out = pii.redact(awkward)
    assert out.columns == awkward.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got[1] is None and got[4] == "one" and "[EMAIL]" in got[17] and "+1" not in got[17] and got[17].endswith("[IP]")


@pytest.mark.parametrize("name", ["awkward", "given", "empty"])
def test_language_model(request, name):
    docs = request.getfixturevalue(name)
    out = maxent.score_documents(docs)
    wanted = brute.language_model_base(texts(docs))
    same(out, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens"], [w[:5] for w in wanted])
    base = sorted(w[5] for w in wanted)
    assert np.allclose(sorted(r[0] for r in out.select("base_score").collect()), base, rtol=1e-9)
    assert all(math.isfinite(r[0]) and r[0] < 0 for r in out.select("score").collect())


def test_language_model_sums_to_one(spark):
    """The probabilities of all continuations of one context, unknown words included, add up to 1."""
    words = [f"w{i}" for i in range(40)]
    texts_ = [" ".join(np.random.default_rng(i).choice(words, 30)) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string")
    weights = maxent.train(docs, np.ones(maxent.CLASSES))
    bounds = np.array([0, 3])
    h, _ = maxent.tokens(np.frombuffer(b"w1 w2", np.uint8), np.array([0]), np.array([5]))
    z = maxent.class_logits(maxent.context(h, bounds)[:, 2:3], weights)[0]
    p_class = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    assert abs(p_class.sum() - 1) < 1e-5
    count = defaultdict(int)
    for t in texts_:
        g, _ = maxent.tokens(np.frombuffer(t.encode(), np.uint8), np.array([0]), np.array([len(t)]))
        for x in g.tolist():
            count[x] += 1
    in_class = defaultdict(list)
    for x, c in count.items():
        in_class[x & (maxent.CLASSES - 1)].append(c)
    total = sum(p_class[k] * (sum(c + 1 for c in in_class[k]) + 1) / (sum(in_class[k]) + len(in_class[k]) + 1) for k in range(maxent.CLASSES))
    assert abs(total - 1) < 1e-5


def test_language_model_learns_from_context(given):
    out = maxent.score_documents(given).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > out[1]


def test_language_model_context_reaches_the_word(spark):
    """After a word that fixes the next one, the score separates words of one class; without context both are equal."""
    ends = [f"{x}zz" for x in "abcdefghijkl"]
    docs = spark.createDataFrame([(i, " ".join(f"k{j} {ends[j]}" for j in np.random.default_rng(i).integers(0, 12, 40))) for i in range(400)]
                                 + [(1000 + i, f"k{j} {ends[j if i % 2 else (j + 5) % 12]}") for i, j in enumerate(np.arange(400) // 2 % 12)], "doc_id long, text string")
    held = maxent.score_documents(docs).filter("held_out AND doc_id >= 1000").groupBy((F.col("doc_id") % 2).alias("fits")).agg(F.avg("score").alias("s"))
    mean = {r["fits"]: r["s"] for r in held.collect()}
    assert mean[1] > mean[0] + 0.15


def test_language_model_grows_with_the_corpus():
    assert maxent.FEATURES == 4 and maxent.depth(1e6, 32) < maxent.depth(1e8, 32) < maxent.depth(1e11, 1024)


@pytest.mark.parametrize("name", ["awkward", "given", "empty"])
def test_decontamination(request, spark, name):
    docs = request.getfixturevalue(name)
    items = texts(spark.read.parquet(f"{FOLDER}/benchmark.parquet").withColumnRenamed("item_id", "doc_id"))
    items += [(900, "three"), (901, " ".join(PASSAGE.upper().split()[5:17])), (902, None), (903, ""), (904, "one, TWO"), (901, PASSAGE), (None, "mit license")]
    table = spark.createDataFrame(items, "item_id long, text string")
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    wanted = brute.decontaminate(texts(docs), items)
    same(wumanber.decontamination_report(docs, table), columns, wanted)
    blocks = wumanber.decontaminate(docs.select("doc_id", "text"), table, out="c", block_bytes=2000)
    same(blocks.select("doc_id", "c.n_words", "c.n_hit", F.size("c.items").cast("long").alias("n_items")), columns[:4], [w[:4] for w in wanted])
    same(wumanber.decontamination_report(docs, table.limit(0)), columns[:3], [(w[0], w[1], 0) for w in wanted])


def test_vectors(spark):
    draw = np.random.default_rng(3)
    base = draw.standard_normal((300, 16))
    near = base[:120] + 0.07 * draw.standard_normal((120, 16))
    vectors = [v.tolist() for v in [*base, *near, *base[:5], *(3.0 * base[:3])]] + [None, [0.0] * 16, [math.nan] * 16, [], [None] * 16, [1.0, 2.0]]
    ids = list(range(len(vectors)))
    table = spark.createDataFrame([(i, v, 1) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<float>, label int")
    sound = {i: np.array(np.array(v, dtype=np.float32), dtype=np.float64) for i, v in zip(ids, vectors, strict=True)
             if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    cosine = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    links = [(a, b) for a in sound for b in sound if a < b and len(sound[a]) == len(sound[b]) and cosine(sound[a], sound[b]) >= 0.95]
    degree = defaultdict(int)
    for a, b in links:
        degree[a], degree[b] = degree[a] + 1, degree[b] + 1
    label = brute.classes(ids, links)
    out = {r["vec_id"]: r for r in lattice.vector_links(table).collect()}
    assert len(out) == len(ids)
    assert all(out[i]["n_links"] <= degree[i] for i in ids)
    assert sum(r["n_links"] for r in out.values()) >= 0.98 * 2 * len(links)
    assert sum(out[i]["component_id"] == label[i] for i in ids) >= 0.98 * len(ids)
    assert all(r["kept"] == (r["component_id"] == r["vec_id"]) for r in out.values())
    assert lattice.vector_links(table.limit(0)).count() == 0


def test_lattice_points():
    x = np.random.default_rng(1).standard_normal((200, 8)) * 2
    point = lattice.e8_point(x)
    assert ((point % 2 == 0).all(axis=1) | (point % 2 == 1).all(axis=1)).all() and (point.sum(axis=1) % 4 == 0).all()
    every = point[:, None, :] + np.concatenate([np.zeros((1, 8), int), lattice.e8_roots()])
    assert (((2 * x)[:, None, :] - every) ** 2).sum(axis=2).argmin(axis=1).max() == 0


@pytest.mark.parametrize("name", ["awkward", "given", "empty"])
def test_licences(request, name):
    docs = request.getfixturevalue(name)
    out = licences.licence_report(docs)
    same(out, ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"], [(d, *brute.licences(t)) for d, t in texts(docs)])
    for r in out.collect():
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_licence_templates(spark):
    docs = spark.createDataFrame([(1, "x " * 50 + "Licensed under CC BY-NC 4.0. more"), (2, "cc is by the nc of 4 and 0"), (3, "Redistribution and use in source and binary "
                                   "forms, with or without modification, are permitted provided that the following conditions are met")], "doc_id long, text string")
    assert {r["doc_id"]: r["labels"] for r in licences.licence_report(docs).collect()} == {1: "cc-by-nc", 2: "", 3: "bsd"}


@pytest.mark.parametrize("name", ["awkward", "given", "empty"])
def test_mixing(request, name):
    docs = request.getfixturevalue(name)
    wanted = brute.mixing_targets([(r["source"], r["text"]) for r in docs.select("source", "text").collect()])
    first, again = (mixing.mix_sources(docs).collect() for _ in range(2))
    assert sorted(map(tuple, first), key=repr) == sorted(map(tuple, again), key=repr)
    assert len(first) == docs.count() and all(0 <= r["taken"] <= 2 * r["size"] for r in first)
    assert sorted({(r["source_size"], round(r["target"], 6)) for r in first}) == sorted({(s, round(t, 6)) for s, t in wanted.values()})
    by_source, longest = defaultdict(int), defaultdict(int)
    for r in first:
        by_source[r["source_size"], r["target"]] += r["taken"]
        longest[r["source_size"], r["target"]] = max(longest[r["source_size"], r["target"]], r["size"])
    for (size, target), taken in by_source.items():
        sharing = sum(1 for s, t in wanted.values() if (s, round(t, 6)) == (size, round(target, 6)))
        assert abs(taken - sharing * target) <= sharing * 2 * longest[size, target]


def test_cube_in_many_blocks(spark):
    units = spark.range(3000).select(F.col("id").alias("_row"), (F.col("id") % 2).alias("_group"), (F.col("id") % 37 + 1).alias("size"), F.lit(0.3).alias("p"))
    out = mixing.cube_sample(units, block_rows=50)
    got = out.groupBy("_group").agg(F.sum(F.col("p") * F.col("size")).alias("words"), F.sum("p").alias("rows"), F.count("*").alias("n"), F.max(F.col("p") * (1 - F.col("p"))).alias("left")).collect()
    for r in got:
        assert r["n"] == 1500 and r["left"] == 0 and abs(r["rows"] - 450) <= 2
        assert abs(r["words"] - 0.3 * 1500 * 19) < 150


def test_cube_with_one_very_long_unit(spark):
    """Groups whose words are for a tenth in one unit miss their target by a few median units only."""
    draw = np.random.default_rng(3)
    rows = [(1000 * g + i, g, int(x), 0.4) for g in range(12) for i, x in enumerate([20_000, *draw.integers(40, 900, 400)])]
    out = mixing.cube_sample(spark.createDataFrame(rows, "_row long, _group long, size long, p double"))
    got = out.groupBy("_group").agg(F.sum(F.col("p") * F.col("size")).alias("words"), F.sum("size").alias("all"), F.percentile_approx("size", 0.5).alias("median"), F.count("*").alias("n")).collect()
    assert len(got) == 12 and all(r["n"] == 401 and abs(r["words"] - 0.4 * r["all"]) <= 3 * r["median"] for r in got)


def test_mix_keeps_sources_apart(spark):
    """Null and repeated ids of equal size in two sources: every taken row has the figures of its own source."""
    docs = spark.createDataFrame([(i % 7 or None, " ".join(["w"] * (i % 3 + 1)), s) for s, n in (("a", 60), ("b", 9), (None, 30)) for i in range(n)], "doc_id long, text string, source string")
    sizes = {r["source"]: r["n"] for r in docs.groupBy("source").agg(F.sum(mixing.text_size("text")).alias("n")).collect()}
    out = mixing.mix_documents(docs).collect()
    assert out and all(r["source_size"] == sizes[r["source"]] for r in out)


@pytest.mark.parametrize("name", ["awkward", "given", "empty"])
def test_jaccard(request, name):
    docs = request.getfixturevalue(name)
    same(jaccard.similar_documents(docs), ["doc_id", "n_shingles", "component_id"], brute.similar(texts(docs)))


def test_jaccard_of_a_crowd(spark):
    """Near copies that differ more and more: links reach far, classes must be whole."""
    draw = np.random.default_rng(7)
    words = [f"w{x}" for x in draw.integers(0, 9999, 120)]
    docs = []
    for i in range(160):
        now = words if i % 4 else [f"v{x}" for x in draw.integers(0, 30, 12)]
        now = [w if draw.random() > 0.012 * (i % 5) else f"e{draw.integers(0, 400)}" for w in now]
        docs.append((i, " ".join(now)))
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    same(jaccard.similar_documents(table), ["doc_id", "n_shingles", "component_id"], brute.similar(docs))


def test_language(spark, given, awkward, empty):
    out = kernels.language_report(spark.read.parquet(FOLDER.replace("0.001", "0.01") + "/documents.parquet"))
    truth = spark.read.parquet(FOLDER.replace("0.001", "0.01") + "/documents.parquet").select("doc_id", "lang")
    right = out.join(truth, "doc_id").filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.97
    odd = {r["doc_id"]: r for r in kernels.language_report(awkward).collect()}
    assert all(odd[i]["lang_pred"] == "und" for i in (1, 2, 3, 21)) and all(0 <= r["score"] <= 1 for r in odd.values())
    assert kernels.language_report(empty).count() == 0
    assert {r["lang_pred"] for r in kernels.language_report(given.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_quality(spark, awkward, empty):
    folder = FOLDER.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    out = additive.quality_report(docs, labels).join(labels, "doc_id").filter("held_out")
    assert out.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] >= 0.93
    odd = additive.quality_report(awkward, labels).collect()
    assert len(odd) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in odd)
    assert {r["score"] for r in additive.quality_report(awkward, labels.limit(0)).collect()} == {0.5}
    assert additive.quality_report(empty, labels).count() == 0


def test_sorted_suffixes_travel_as_steps():
    import zlib

    draw = np.random.default_rng(3)
    for buckets in (32, 64):
        values = np.unique(draw.integers(0, 1 << 64, 200_000, dtype=np.uint64, endpoint=False))
        values = np.unique(np.append(values, [np.uint64(0), np.uint64((1 << 64) - 1)]))
        values = values[(values >> np.uint64(59)) != 7]  # an empty bucket
        bounds, edges = suffixes.bucket_bounds(values, buckets), suffixes.bucket_edges(buckets)
        pieces = [values[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        sent = [suffixes.packed(p, e) for p, e in zip(pieces, edges, strict=True)]
        assert all(np.array_equal(suffixes.unpacked(d, e), p) for d, e, p in zip(sent, edges, pieces, strict=True))
        assert sum(len(zlib.compress(d, 1)) for d in sent) < 0.85 * sum(len(zlib.compress(p.tobytes(), 1)) for p in pieces)


def test_repeated_rows_stay_copies_of_one_text(spark):
    text = "".join(chr(97 + i * i % 23) + str(i) for i in range(150))
    rows = [(1, "x" + text), (1, "x" + text), (2, text + "y"), (None, text), (None, text), (3, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {(r["doc_id"], r["n_removed"]) for r in suffixes.repeated_spans(docs).collect()}
    assert kept == {(1, len(text) + 1), (2, len(text)), (None, len(text)), (3, 0)}
    assert suffixes.repeated_spans(docs).count() == len(rows)
