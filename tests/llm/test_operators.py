"""Operators on small tables with nulls, empty texts, repeated rows, ties and clashing columns; queries against SQL and brute force."""

import hashlib
import math
import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import duckdb
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from sparkassay.llm import decontaminate, jaccard_join, language_id, line_dedup, lm_score, quality, queries, sentencepiece_codec, shards, shared, token_count, toxicity

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


@pytest.fixture(scope="module")
def odd(spark):
    """doc_id, text and columns whose names an operator might use itself."""
    line = "a line that is long enough to count"
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, f"one\n{line}"), (5, f"{line.upper()}  \ntwo"), (6, f"{line}\n{line}\nthree"), (6, f"{line}\n{line}\nthree"), (None, f"{line}\nfour"), (7, "word " * 30000), (8, "日本語 🎉 été"), (9, "a b c d"), (10, "a b c d")]
    return spark.createDataFrame([(d, t, "x", "y", 1, "z") for d, t in rows], "doc_id long, text string, n_tokens string, score string, row int, label string").repartition(3)


def test_all_take_odd_tables(spark, odd):
    n, empty = odd.count(), odd.limit(0)
    bench = spark.createDataFrame([(1, "a b c d"), (2, None), (None, "x"), (3, "")], "item_id long, text string")
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1)], "doc_id long, toxic int")
    for docs, want in ((odd, n), (empty, 0)):
        assert sentencepiece_codec.round_trip(docs, PATH).count() == want
        assert token_count.count_tokens(docs, PATH).count() == want
        assert jaccard_join.join(docs).count() == want
        assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == want
        assert quality.rules(docs).count() == want
        assert decontaminate.find(docs, bench).count() == want
        assert decontaminate.find(docs, bench.limit(0)).count() == want
        assert lm_score.score(docs).count() == want
        assert line_dedup.dedup(docs).count() == want
        assert language_id.predict(docs, language_id.fit(docs.withColumn("lang", F.lit(None).cast("string")))).count() == want


def test_codec_frames(spark, odd):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    ids = sentencepiece_codec.encode(odd, PATH)
    text = {r.doc_id: r.text for r in odd.collect()}
    for r in ids.collect():
        assert r.ids == sp.encode(text[r.doc_id] or "")
    for r in sentencepiece_codec.decode(ids, PATH).collect():
        assert r.text == sp.decode(sp.encode(text[r.doc_id] or ""))


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_lines(odd, broadcast):
    got = sorted((r.doc_id or -1, r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup(odd, broadcast=broadcast).collect())
    line = "a line that is long enough to count"
    by = {g[0]: g[1:] for g in got}
    assert by[4] == (2, 1, "one") and by[5] == (2, 1, "two") and by[6] == (3, 0, f"{line}\n{line}\nthree") and by[-1] == (2, 1, "four") and by[1] == (1, 0, None)


def test_line_store_is_reversible(spark, odd):
    line = "a line that is long enough to count"
    docs = spark.createDataFrame([(k, f"{line}\nown {k}") for k in range(4)], "doc_id long, text string")
    store = line_dedup.LineStore(spark, shards=3)
    assert store.counts().count() == 0 and store.apply(docs.limit(0)).count() == 0
    store.insert(docs.where("doc_id < 3"))
    before = sorted(map(tuple, store.counts().collect()))
    store.insert(docs.where("doc_id = 3"))
    assert store.apply(docs).agg(F.sum("n_dropped")).first()[0] == 3
    store.delete(docs.where("doc_id = 3"))
    assert sorted(map(tuple, store.counts().collect())) == before
    store.delete(docs.where("doc_id = 2"))
    assert store.apply(docs).agg(F.sum("n_dropped")).first()[0] == 0
    # a store that documents came to and left in any order counts as one built anew; rows without id can be deleted
    rng = random.Random(3)
    pool = [f"{line} {k}" for k in range(12)]
    more = spark.createDataFrame([(rng.choice([None, *range(10, 30)]), "\n".join(rng.choices(pool, k=rng.randint(0, 6)))) for _ in range(60)], "doc_id long, text string")
    store.insert(more)
    store.insert(odd.select("doc_id", "text"))
    store.delete(spark.createDataFrame([(None,), (12,), (17,), (99,)], "doc_id long"))
    left = docs.where("doc_id < 2").unionByName(more).unionByName(odd.select("doc_id", "text")).where("doc_id IS NOT NULL AND doc_id NOT IN (12, 17)")
    anew = line_dedup.reference_counts(line_dedup.postings(left))
    assert sorted(map(tuple, store.counts().collect())) == sorted(map(tuple, anew.collect()))
    want = line_dedup.dedup(left)
    assert Counter(map(tuple, store.apply(left).collect())) == Counter(map(tuple, want.collect()))


def test_lines_of_clashing_columns_and_hot_null_ids(spark):
    line = "a line that is long enough to count"
    rows = [(None, f"{line}\nx {k % 3}", 7, k) for k in range(40)] + [(5, line, 8, 0), (5, f"{line}\n{line} too", 9, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, `a.b` int")
    for broadcast in (0, 100):
        got = line_dedup.dedup(docs, broadcast=broadcast).collect()
        assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got) == Counter([(None, f"x {k % 3}", 2, 1) for k in range(40)] + [(5, line, 1, 0), (5, f"{line}\n{line} too", 2, 0)])
        kept = line_dedup.keep_first(docs, broadcast=broadcast)
        assert kept.columns == docs.columns and Counter(r.n_lines for r in kept.collect()) == {7: 40, 8: 1, 9: 1}


def test_lines_that_a_polynomial_hash_confuses():
    a = "a"
    while len(a) < 4096:
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    raw = f"{a}\n{b}\n{a}".encode()
    import numpy as np

    buf, offs = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
    lines = line_dedup.Lines(buf, offs, 20)
    assert lines.k1[0] != lines.k1[1] and lines.k2[0] != lines.k2[1] and lines.k1[0] == lines.k1[2]
    words = shared.Words(buf, offs)
    assert words.hash[0] != words.hash[1] and words.hash[0] == words.hash[2]
    assert quality.duplicate_lines(buf, offs).tolist() == [1]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    q = queries.queries()[name](spark, SF)
    want = c.execute(queries.oracle_sql()[name]).fetchdf()[q.columns]
    assert sorted(map(tuple, q.toPandas().values.tolist())) == sorted(map(tuple, want.values.tolist()))


def brute_components(docs, percent=80):
    sets = {}
    for k, t in docs:
        w = WORD.findall(lower(t or ""))
        sets[k] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    top = {k: k for k in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    at = defaultdict(list)
    for k, s in sets.items():
        for h in s:
            at[h].append(k)
    common = Counter((a, b) for ks in at.values() for i, a in enumerate(ks) for b in ks[i + 1 :])
    for (a, b), c in common.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            a, b = sorted((find(a), find(b)))
            top[b] = a
    return {k: (len(sets[k]), find(k)) for k in sets}


@pytest.mark.parametrize("block", [400, 1 << 20])
def test_jaccard_join(spark, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(3000)]
    doc = lambda n: [rng.choice(vocab) for _ in range(n)]
    base, passage, rows = doc(140), doc(60), []
    for _ in range(100):
        b = base[:]
        for _ in range(rng.randint(1, 7)):
            b[rng.randrange(140)] = rng.choice(vocab)
        rows.append(b)
    rows += [doc(rng.randint(2, 60)) + passage + doc(rng.randint(0, 8)) for _ in range(90)]
    rows += [d for _ in range(20) for d in [doc(rng.randint(1, 50))] * rng.randint(1, 4)] + [[], [], ["a"], ["A"], ["a", "b", "c"]]
    rng.shuffle(rows)
    table = [(k, " ".join(r)) for k, r in enumerate(rows)] + [(9999, None)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(spark.createDataFrame(table, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute_components(table)


def test_jaccard_join_of_chains_and_templates(spark):
    """Chains whose ends don't link, texts that share most of a template without linking, doc_ids with several texts."""
    rng = random.Random(8)
    table = []
    for g in range(6):
        chain = [f"c{g}x{i}" for i in range(90)]
        for k in range(25):
            chain = chain[2:] + [f"c{g}y{k}x{i}" for i in range(2)]
            table.append((1000 * g + k, chain))
        template = [f"t{g}x{i}" for i in range(80)]
        table += [(1000 * g + 100 + k, template + [f"t{g}y{k}x{i}" for i in range(rng.randint(0, 30))]) for k in range(40)]
    table += [(50000 + k, table[rng.randrange(len(table))][1][: rng.randint(3, 90)]) for k in range(80)]
    rng.shuffle(table)
    texts = [(k, " ".join(w)) for k, w in table]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(docs).collect()} == brute_components(texts)
    for percent in (50, 95):
        got = Counter(r.component_id for r in jaccard_join.join(docs, percent=percent).collect())
        assert got == Counter(c for _, c in brute_components(texts, percent).values())
    # two texts of one doc_id tie their components, and repeated rows change nothing
    both = [(1, texts[0][1]), (2, texts[0][1]), (1, "quite other words stand here"), (3, "quite other words stand here"), (3, "quite other words stand here"), (4, "quite other words stand there")]
    got = {r.doc_id: r.component_id for r in jaccard_join.join(spark.createDataFrame(both, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


def test_jaccard_join_keeps_rows_of_small_support(spark):
    """A passage of 20 shingles in 40 texts of 25, three near copies of 24 and one text of 21, which links to those of 24 by one prefix column."""
    table = []
    for g in range(4):
        passage, tail = [f"p{g}x{i}" for i in range(24)], [f"t{g}x{i}" for i in range(3)]
        rows = [passage + [f"u{g}x{k}x{i}" for i in range(5)] for k in range(40)]
        rows += [passage + tail + [f"v{g}x{k}"] for k in range(3)] + [[*passage, f"w{g}"]]
        table += [(100 * g + k, " ".join(r)) for k, r in enumerate(rows)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(spark.createDataFrame(table, "doc_id long, text string").coalesce(1)).collect()}
    assert got == brute_components(table)
    assert all(got[100 * g + 43] == (21, 100 * g + 40) for g in range(4))


def test_jaccard_join_writes_few_files(spark, monkeypatch):
    """A few texts of many tasks are one file: on a local folder each file is a process that an executor starts."""
    made, plain = {}, shared.materialize

    def counted(df, name):
        table = plain(df, name)
        made[name] = max(made.get(name, 0), len(table.inputFiles()))
        return table

    monkeypatch.setattr(shared, "materialize", counted)
    rows = [(2 * k + c, " ".join(f"w{k}x{i}" for i in range(60)) + " end" * c) for k in range(20) for c in range(2)]
    got = {r.doc_id: r.component_id for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(16)).collect()}
    assert got == {d: d - d % 2 for d, _ in rows}
    assert made["hub-pairs"] and made["pair-texts"] == 1


def test_scratch_tables_have_no_checksum_files(spark, tmp_path):
    """Scratch tables are read as they were written, without a file beside each; tables that a user writes keep theirs."""
    table = shared.materialize(spark.range(100, numPartitions=4), "plain")
    folder = os.path.dirname(table.inputFiles()[0].removeprefix("file://"))
    assert len(table.inputFiles()) == 4 and sorted(r.id for r in table.collect()) == list(range(100))
    assert not [x for x in os.listdir(folder) if x.endswith(".crc")]
    spark.range(100, numPartitions=4).write.parquet(f"file://{tmp_path}/own")
    assert len([x for x in os.listdir(tmp_path / "own") if x.endswith(".parquet.crc")]) == 4


def test_jaccard_join_posts_a_set_after_a_row_without_id(spark):
    table = []
    for g in range(0, 80, 2):
        base = [f"w{g}x{i}" for i in range(60)]
        table += [(None, base), (g, base), (g + 1, [*base[:-1], "other"])]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in table], "doc_id long, text string").coalesce(1)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join(docs).collect())
    assert got == Counter([(None, 56, None)] * 40 + [(k, 56, k - k % 2) for k in range(80)])


def brute_language_model(texts):
    """(tokens, known tokens, N, base score, score) of each (id, text)."""
    tokens = [[*WORD.findall(lower(t or "")), "\n"] for _, t in texts]
    train = [w for (k, _), w in zip(texts, tokens) if k is None or zlib.crc32(str(k).encode()) % 7 != 2]
    c, pairs, triples = (Counter(x for w in train for x in grams(["\r", *w])) for grams in (lambda w: w[1:], lambda w: zip(w, w[1:]), lambda w: zip(w, w[1:], w[2:])))
    n, v = sum(c.values()), len(c)
    unknown = (sum(x == 1 for x in c.values()) + 1) / (n + 1)
    c["\r"] = len(train)
    share = lambda x, most, lag: most * x / (x + lag)
    for w in tokens:
        s, line = 0.0, ["\r", *w]
        for k, x in enumerate(w):
            p = (1 - unknown) * c[x] / n if c[x] else unknown
            if seen := c[line[k]]:
                s2 = share(seen, lm_score.SHARE2, lm_score.LAG2)
                p = s2 * pairs[line[k], x] / seen + (1 - s2) * p
            if k and (seen := pairs[line[k - 1], line[k]]):
                s3 = share(seen, lm_score.SHARE3, lm_score.LAG3)
                p = s3 * triples[line[k - 1], line[k], x] / seen + (1 - s3) * p
            s += math.log10(p)
        yield len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), s


@pytest.mark.parametrize("block", [300, 1 << 20])
def test_language_model(spark, block, monkeypatch):
    monkeypatch.setattr(lm_score, "BLOCK", block)
    docs = shared.documents(spark, SF).select("doc_id", "text")
    more = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (3, None), (3, ""), (5, "a b d a b c"), (9, "never seen so far " * 40)], "doc_id long, text string")
    docs = shared.materialize(docs.unionByName(more), "documents")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    got = lm_score.score(docs).select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()
    want = sorted(((k if k is not None else -1), *x) for (k, _), x in zip(texts, brute_language_model(texts)))
    got = sorted(((r[0] if r[0] is not None else -1), *r[1:]) for r in got)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:4] == w[:4]
        assert g[4] == pytest.approx(w[4]) and abs(g[5] - w[5]) < 0.0005 * g[1] + 1e-6


def test_language_model_beats_its_base_on_held_out_rows(spark):
    r = lm_score.query(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert r[0] / r[2] > r[1] / r[2] + 0.3


def test_blocks_of_items_agree(spark):
    docs, bench = shared.documents(spark, SF), spark.read.parquet(f"{SF}/benchmark.parquet")
    one, many = decontaminate.find(docs, bench), decontaminate.find(docs, bench, block_bytes=2000)
    assert one.exceptAll(many).count() == 0 == many.exceptAll(one).count()
    hit = one.where("size(spans) > 0").count()
    assert hit > 0 and decontaminate.keep_clean(docs, bench).count() == docs.count() - hit


def test_blocks_of_items_keep_each_row(spark):
    words = [f"w{i}" for i in range(60)]
    items = [(k, " ".join(words[k : k + 12])) for k in range(0, 48, 4)]
    texts = [" ".join(words), " ".join(words[:30] + words[::-1][:30]), " ".join(words), " ".join(["x"] * 60)]
    table = [(1, texts[0]), (1, texts[0]), (None, texts[0]), (None, texts[1]), (None, texts[3]), (2, texts[1]), (2, texts[3]), (3, None), (3, "")]
    docs, bench = spark.createDataFrame(table, "doc_id long, text string").repartition(2), spark.createDataFrame(items, "item_id long, text string")
    one, many = (Counter((r.doc_id, r.n_words, tuple(map(tuple, r.spans)), tuple(r.item_ids)) for r in decontaminate.find(docs, bench, block_bytes=size).collect()) for size in (1 << 20, 100))
    assert one == many and sum(many.values()) == len(table)
    assert one[1, 60, ((0, 56),), tuple(range(0, 48, 4))] == 2
    clean = decontaminate.keep_clean(docs, bench, max_hit_words=40, block_bytes=100)
    assert Counter(r.doc_id for r in clean.collect()) == Counter([None, None, 2, 2, 3, 3])


def test_shards(spark):
    docs = shared.documents(spark, SF)
    store = shards.ShardStore(spark, shared.scratch_path(spark, "store"), target_bytes=50_000)
    for k in range(3):
        store.append(docs.where(f"doc_id % 3 = {k}").repartition(5))
        m = store.compact()
        assert not store.plan(m["shards"])
    rows = store.read().drop("__assay_shard")
    assert rows.exceptAll(docs).count() == 0 == docs.exceptAll(rows).count()
    assert sum(s["rows"] for s in m["shards"]) == docs.count()
    assert all(s["bytes"] >= 25_000 for s in m["shards"] if s["tier"] == 0)
    assert store.read(1).count() == docs.where("doc_id % 3 = 0").count()
    store.vacuum(2, 0)
    assert store.versions() == [m["version"] - 1, m["version"]] and store.read().count() == docs.count()
    assert store.read(m["version"] - 1).count() == sum(s["rows"] for s in store.manifest(m["version"] - 1)["shards"]) > 0
    with pytest.raises(KeyError):
        store.read(1)


def test_shard_plan_merges_once_to_the_final_tier(spark):
    store = shards.ShardStore(spark, shared.scratch_path(spark, "store"), target_bytes=64_000)
    small = [{"file": f"f{k:04}", "bytes": 100 + k % 7 * 40} for k in range(844)]
    runs = store.plan(small)
    files = [s["file"] for run in runs for s in run]
    assert len(files) == len(set(files))
    assert all(sum(s["bytes"] for s in run) < 64_000 + 64_000 for run in runs)
    assert sum(sum(s["bytes"] for s in run) >= 64_000 for run in runs) >= sum(s["bytes"] for s in small) // 128_000


def test_shards_of_two_writers(spark):
    where = shared.scratch_path(spark, "store")
    one, two = (shards.ShardStore(spark, where, target_bytes=10_000) for _ in range(2))
    rows = spark.createDataFrame([(1, None, "a"), (None, "", "b"), (1, None, "a"), (2, "t" * 200, "c")], "doc_id long, text string, `__assay_of` string")
    one.append(rows.limit(0))
    assert one.read().count() == 0 and one.compact()["version"] == 1 == one.versions()[-1]
    for _ in range(3):
        one.append(rows.coalesce(1))
    held = two.manifest()  # a second writer plans from here
    runs = two.plan(held["shards"] + two.append(rows.coalesce(1))["shards"][-1:])
    # files that are written but not yet committed outlive another writer's vacuum
    late = two._folder("arrival")
    rows.write.parquet(late)
    one.compact()
    one.vacuum(1)
    assert two._arrived(late, rows._jdf.schema().toDDL())["version"] == one.versions()[-1]
    assert Counter(map(tuple, one.read().drop("__assay_shard").collect())) == Counter({k: 5 * n for k, n in Counter(map(tuple, rows.collect())).items()})
    # a commit that replaces shards which are gone fails, and so does publishing a version twice
    with pytest.raises(shards.Conflict):
        two._commit([], [s["file"] for run in runs for s in run], held["schema"])
    assert not two._publish(one.versions()[-1], {"version": 0})
    with pytest.raises(ValueError):
        one.append(rows.drop("text"))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_codec_and_count_queries_equal_the_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = {r.doc_id: r.text or "" for r in shared.documents(spark, SF).collect()}
    encoded = {k: sp.encode(t) for k, t in texts.items()}
    got = sentencepiece_codec.query(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert {tuple(r) for r in got} == {(k, len(i), sha(",".join(map(str, i))), sha(sp.decode(i))) for k, i in encoded.items()}
    got = token_count.query(spark, SF).collect()
    assert {tuple(r) for r in got} == {(k, len(t.encode()), len(encoded[k]), len(encoded[k]) > 4096) for k, t in texts.items()}


def test_quality_repeats_equal_brute_force(spark):
    """The method's own columns, which the query leaves out, over whole texts."""
    for r in quality.rules(shared.documents(spark, SF)).join(shared.documents(spark, SF).select("doc_id", "text"), "doc_id").collect():
        w = WORD.findall(r.text or "")
        at = defaultdict(list)
        for i in range(len(w) - quality.MIN_REPEAT + 1):
            at[tuple(w[i : i + quality.MIN_REPEAT])].append(i)
        twice = {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + quality.MIN_REPEAT)}
        assert r.n_covered == len(twice)
        n = r.longest_repeat
        count = lambda k: max(Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)).values(), default=0)
        assert (n == 0 or count(n) > 1) and count(n + 1) < 2


def test_items_digest(spark):
    texts = {r.doc_id: r.text for r in shared.documents(spark, SF).collect()}
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = defaultdict(set)
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = word.findall(lower(r.text or ""))
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(r.item_id)
    sizes = {len(x) for x in windows}
    for r in decontaminate.query(spark, SF).collect():
        w = word.findall(lower(texts[r.doc_id] or ""))
        found, hit = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if items := windows.get(tuple(w[i : i + n])):
                    found |= items
                    hit |= set(range(i, i + n))
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))))


def test_toxicity_fit_repeats():
    """Not even Python's salted hashes change a fit."""
    code = "import sys; from sparkassay.llm import toxicity as t; import random; r = random.Random(1); w = [f'w{i}' for i in range(300)]; docs = [' '.join(r.choices(w, k=30) + (['nasty', 'vile'] if k % 3 == 0 else [])).encode() for k in range(300)]; import numpy as np; m = t.learn(docs, np.array([k % 3 == 0 for k in range(300)])); print(sorted(m.terms.items()), m.bias, m.coefficients.tolist())"
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    got = {subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONHASHSEED": seed, "PYTHONPATH": root}, capture_output=True, text=True, check=True).stdout for seed in ("1", "2", "3")}
    assert len(got) == 1 and "nasty" in got.pop()


def test_toxicity_of_repeated_ids(spark):
    """A doc_id that many rows share adds one text to the sample; rows are scored each by itself."""
    rows = [(k, f"word{k} plain talk about item {k}" + (" you vile idiot" if k % 2 else " thank you"), k % 2) for k in range(80)] + [(1, f"copy {k}", 1) for k in range(50)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model)
    assert got.count() == len(rows) and got.select("score").distinct().count() > 1
    assert got.agg(F.min("score") >= 0, F.max("score") <= 1).first() == (True, True)


def test_shards_query_keeps_every_row(spark):
    docs = shared.documents(spark, SF)
    got = [tuple(r) for r in shards.query(spark, SF).select("doc_id", "n_bytes", "text_sha256").collect()]
    assert Counter(got) == Counter((r.doc_id, len((r.text or "").encode()), sha(r.text or "")) for r in docs.select("doc_id", "text").collect())


def test_filters_take_odd_tables(spark, odd):
    """Null, empty, long and repeated texts, null ids, columns of clashing and repeated names."""
    wide = odd.withColumn("n_lines", F.lit(1)).withColumn("__assay_gone", F.lit(2)).withColumn("a.b", F.lit(3)).withColumn("root", F.lit(4)).withColumn("lang", F.lit("en"))
    bench = spark.createDataFrame([(1, "a b c d"), (2, None), (None, "x"), (3, "")], "item_id long, text string")
    letters = lambda rows: sum(any(c.isalpha() for c in r.text or "") for r in rows)
    for docs in (wide, wide.limit(0)):
        rows = docs.collect()
        by_text = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
        known = language_id.keep_known(docs, language_id.fit(docs), 0.3)
        assert known.columns == docs.columns and known.count() <= letters(rows)
        assert language_id.keep_known(docs, None).count() == letters(rows)
        near = jaccard_join.keep_one(docs)
        component = brute_components([(r.doc_id, r.text) for r in rows if r.doc_id is not None])
        assert near.columns == docs.columns and by_text(near) == Counter((r.doc_id, r.text) for r in rows if r.doc_id is None or component[r.doc_id][1] == r.doc_id)
        clean = decontaminate.keep_clean(docs, bench)
        assert clean.columns == docs.columns and by_text(clean) == Counter((r.doc_id, r.text) for r in rows if (r.text or "") != "a b c d")
        lines = line_dedup.keep_first(docs)
        assert lines.columns == docs.columns and lines.count() == len(rows)
        store = shards.ShardStore(spark, shared.scratch_path(spark, "store"))
        store.append(docs)
        assert store.compact() and store.read().drop("__assay_shard").columns == docs.columns and store.read().count() == len(rows)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = shared.documents(spark, sf)
    p = language_id.query(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (p.lang == p.lang_pred).mean() > 0.98
    t = toxicity.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert t[t.toxic == 1].score.mean() > t[t.toxic == 0].score.mean() + 0.2


def test_pipeline(spark):
    """Each stage on what its predecessor kept: its columns, and brute force for what it does to texts."""
    import corpus_pipeline

    docs = shared.documents(spark, SF)
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    bench = [word.findall(lower(r.text or "")) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 10]) for w in bench for i in range(max(1, len(w) - 9) if w else 0)}
    for name, stage in corpus_pipeline.STAGES:
        out = shared.materialize(stage(spark, docs, SF), name)
        before, after = [r for r in docs.collect()], [r for r in out.collect()]
        if name != "sentencepiece":
            assert out.columns == docs.columns
        if name == "language_id":
            assert 0.9 * len(before) <= len(after) and all(any(c.isalpha() for c in r.text) for r in after) and {tuple(r) for r in after} <= {tuple(r) for r in before}
        if name == "line_dedup":
            keys = lambda t: {k for line in (t or "").split("\n") if len(k := lower(line.strip(" \t\n\v\f\r"))) >= 20}
            holders = defaultdict(list)
            for r in before:
                for k in keys(r.text):
                    holders[k].append(r.doc_id)
            top = {k: max(d) for k, d in holders.items() if len(d) >= 3}
            stays = lambda r, line: top.get(lower(line.strip(" \t\n\v\f\r")), r.doc_id) == r.doc_id
            assert {r.doc_id: r.text for r in after} == {r.doc_id: "\n".join(line for line in r.text.split("\n") if stays(r, line)) for r in before}
        if name == "jaccard_join":
            component = brute_components([(r.doc_id, r.text) for r in before])
            assert {r.doc_id for r in after} == {k for k, (_, c) in component.items() if k == c}
        if name == "decontaminate":
            holds = lambda t: any(tuple(w[i : i + n]) in windows for w in [word.findall(lower(t))] for n in {len(x) for x in windows} for i in range(len(w) - n + 1))
            assert {r.doc_id for r in after} == {r.doc_id for r in before if not holds(r.text)}
        if name == "sentencepiece":
            want = {(r.doc_id, len(i), sha(",".join(map(str, i))), sha(sp.decode(i))) for r in before for i in [sp.encode(r.text)]}
            assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in after} == want
        docs = out
    whole = corpus_pipeline.run(spark, SF)
    assert Counter(map(tuple, whole.collect())) == Counter(map(tuple, docs.collect()))
