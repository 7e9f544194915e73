"""Operators on texts against brute force, and the defined results of odd inputs."""

import hashlib
import re
import sys
import unicodedata
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parents[1]))
from oracle import SMALL, compare  # noqa: E402

from echofield.llm import decontaminate, language_id, line_dedup, media_ogg, ngram_join, packing, quality_rules, queries, sharding  # noqa: E402

#: Columns whose names operators use inside or in their results.
CLASHES = "key h1 h2 d1 d2 pos gone doc node bands norm words n fp start length score predicted lang_pred shard slot size n_lines n_dropped media batch __doc"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(120_000))
ODD = [
    (1, "One line\nSame line\n", "en"),
    (2, "", "en"),
    (3, None, "de"),
    (None, "No id here, but words", None),
    (4, LONG, "en"),
    (5, "twice the same row", "fr"),
    (5, "twice the same row", "fr"),
    (6, "... !!! 123", "es"),
    (7, "퟿ \U0001f600 café 中文 <|endoftext|>", None),
    (8, "\n\n\n", "en"),
    (9, "a", "en"),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id bigint, text string, lang string")
    return df.withColumns({c: F.lit(c) for c in CLASHES.split()})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, key string")


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    compare(spark, queries.QUERIES[name], queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_runs(spark, name):
    table = "pages" if name == "op3_url_filter" else "documents"
    n = queries.QUERIES[name](spark, SMALL).count()
    assert n >= (1 if name == "op5_decontamination" else spark.read.parquet(f"{SMALL}/{table}.parquet").count())


# --- lines


def lines_by_hand(rows, min_docs):
    seen, key = defaultdict(set), lambda line: line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(line_dedup.UPPER, line_dedup.LOWER))
    for row, (_, text) in enumerate(rows):
        for line in (text or "").split("\n"):
            seen[key(line)].add(row)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not key(x) or len(seen[key(x)]) < min_docs]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches,fanout", [(1, 2), (9, 2), (6, 4)])
def test_lines(spark, small, batches, fanout):
    rows = [(r.doc_id, r.text) for r in small.collect()]
    rows += [(1000 + i, f"Shared LINE\t\nown {i}\nshared line\nÉTÉ") for i in range(9)] + [(2000, " shared line\r"), (2000, " shared line\r"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = line_dedup.drop_frequent_lines(df, 10, batches, fanout)
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()), key=str) == lines_by_hand(rows, 10)


def test_lines_by_shuffle(spark, small, monkeypatch):
    """Beyond the sizes that are broadcast, joins by shuffle give the same."""
    before = sorted(map(str, line_dedup.drop_frequent_lines(small, 3).collect()))
    for name in ("BROADCAST_KEYS", "BROADCAST_HITS"):
        monkeypatch.setattr(line_dedup, name, 0)
    assert sorted(map(str, line_dedup.drop_frequent_lines(small, 3).collect())) == before


def test_lines_odd(odd, empty):
    got = line_dedup.drop_frequent_lines(odd, 2)
    assert got.count() == len(ODD) and set(odd.columns) <= set(got.columns)
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()), key=str) == lines_by_hand([(a, b) for a, b, _ in ODD], 2)
    assert line_dedup.drop_frequent_lines(empty).count() == 0


def test_lines_of_a_long_text(spark):
    rows = [(i, "\n".join([f"line {k}" for k in range(200_000)] + ["again"] * 1000)) for i in range(2)]
    got = line_dedup.drop_frequent_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), 2).collect()
    assert [(r.n_lines, r.n_dropped, r.text) for r in got] == [(201_000, 201_000, "")] * 2


def test_settled_keys_leave_later_batches(spark):
    runs = line_dedup.LineRuns(spark, min_docs=2, fanout=2)
    for b in range(4):
        docs = spark.createDataFrame([(10 * b + i, "common\nown %d" % (10 * b + i)) for i in range(2)], "doc_id bigint, text string")
        runs.add(line_dedup.line_table(docs))
    assert runs.settled and runs.frequent().count() == 1
    assert runs.levels[0] == [] and max(r.keys.count() for level in runs.levels for r in level) == 8
    runs.forget()


def test_batches_merge_anti_join_the_runs(spark, monkeypatch):
    """In the registered query, batches merge-anti-join settled and levelled runs without an exchange or a sort."""
    plans, written = [], line_dedup.workspace.bucketed

    def watched(df, label, keys):
        plans.append(df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1])
        return written(df, label, keys)

    monkeypatch.setattr(line_dedup.workspace, "bucketed", watched)
    line_dedup.query(spark, SMALL)
    joined = [p for p in plans if "SortMergeJoin" in p]
    assert all("LeftAnti" in p and "BroadcastHashJoin" not in p for p in joined)
    assert len(joined) == 2 * (line_dedup.BATCHES - 1) + 1  # and the rest of a compaction
    # runs and batches are read in order: neither exchange nor sort
    assert not any("Exchange" in p or "Sort [" in p for p in joined)
    assert max(p.count("LeftAnti") for p in joined) >= 3  # settled keys, a compacted run and a new one


# --- shards


def test_schedule():
    sizes = [(7, "a"), (7, "b"), (6, "c"), (6, "d"), (5, "e"), (5, "f"), (4, "g"), (4, "h"), (4, "i")]
    loads = Counter()
    for (size, _), s in zip(sizes, sharding.schedule(sizes, 3)):
        loads[s] += size
    assert sorted(loads.values()) == [16, 16, 16]


def test_shards(small):
    rows = sharding.shard_documents(small, 5).collect()
    text = {r.doc_id: r.text for r in small.collect()}
    where, loads, slots = defaultdict(set), Counter(), defaultdict(list)
    for r in rows:
        assert r["size"] == len(text[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
        where[text[r.doc_id]].add(r.shard)
        loads[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in where.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(loads.values()) / min(loads.values()) < 1.1


def test_shards_odd(odd, empty):
    rows = sharding.shard_documents(odd, 3).collect()
    assert len(rows) == len(ODD) and {r["size"] for r in rows if r.doc_id == 3} == {16}
    assert len({r.shard for r in rows if r.doc_id == 5}) == 1
    assert sharding.shard_documents(empty, 3).count() == 0


def test_shards_hot_group(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    rows = sharding.shard_documents(df, 4).groupBy("shard").agg(F.max("slot").alias("m"), F.count("*").alias("n"), F.sum("size").alias("b")).collect()
    assert all(r.m == r.n - 1 for r in rows)
    *rest, hot = sorted(r.b for r in rows)
    assert hot == 1000 * (len("hot text") + 16) and rest[-1] - rest[0] < 0.01 * rest[0]  # the rest shares the other shards evenly


# --- language


def test_language_accuracy(spark):
    sf = SMALL.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = language_id.query(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_learns_nothing_from_held_out(spark, small):
    swapped = small.withColumn("lang", F.when(language_id.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    model = language_id.train(swapped.filter(~language_id.held_out()))
    assert "xx" not in model.langs


def test_language_odd(spark, small, odd, empty):
    model = language_id.train(small)
    got = {(r.doc_id, r.lang_pred) for r in language_id.identify(odd, model).collect()}
    assert {(2, "und"), (3, "und"), (6, "und"), (8, "und")} <= got and (9, "und") not in got and len(got) == len(ODD) - 1
    assert language_id.identify(empty, model).count() == 0
    nothing = language_id.train(empty)
    assert {r.lang_pred for r in language_id.identify(odd, nothing).collect()} == {"und"}


def grams_by_hand(text):
    """Counts of hashed bigrams and trigrams by plain loops: words are runs of ASCII letters and bytes from 128."""
    raw, out = text.lower().encode(), Counter()
    letters = [b if 97 <= b < 123 or b >= 128 else 0 for b in b"\0" + raw + b"\0\0"]
    for a, b, c in zip(letters, letters[1:], letters[2:]):
        for code, holds in ((a * 256 + b, a or b), ((a * 256 + b) * 256 + c + (1 << 24), b)):
            if holds:
                mixed = code * 2654435761 % (1 << 32)
                out[(mixed ^ (mixed >> 15)) >> 20] += 1
    return out


def test_language_equals_brute_force(spark, small):
    """Document frequencies, weights, cosines and the nearest centroid by plain loops."""
    learned = small.filter(~language_id.held_out())
    texts = [r.text for r in learned.filter("lang IS NOT NULL AND text IS NOT NULL").collect()]
    df = Counter(g for t in texts for g in grams_by_hand(t))
    model = language_id.train(learned)
    idf = {g: np.log((1 + len(texts)) / (1 + n)) + 1 for g, n in df.items()}
    assert all(abs(model.idf[g] - idf.get(g, np.log(1 + len(texts)) + 1)) < 1e-5 for g in range(language_id.DIMS))
    assert all(abs(np.linalg.norm(c) - 1) < 1e-4 for c in model.centres) and {lang: model.langs.count(lang) for lang in set(model.langs)} == {lang: 3 for lang in set(model.langs)}
    want = {}
    for r in small.collect():
        v = {g: (1 + np.log(n)) * model.idf[g] for g, n in grams_by_hand(r.text or "").items()}
        norm = sum(x * x for x in v.values()) ** 0.5
        cos = [sum(x * c[g] for g, x in v.items()) / norm if norm else 0.0 for c in model.centres]
        want[r.doc_id] = (model.langs[int(np.argmax(cos))], max(cos), cos) if any(ch.isalpha() for ch in r.text or "") else ("und", 0.0, [0.0])
    for r in language_id.identify(small, model).collect():
        lang, score, cos = want[r.doc_id]
        runner_up = sorted(cos)[-2:][0] if len(cos) > 1 else -1
        assert abs(r.score - score) < 1e-4 and (r.lang_pred == lang or abs(score - runner_up) < 1e-4)


def test_language_ignores_junk_rows(spark, small):
    """Letterless and repeated training rows move no centroid."""
    junk = spark.createDataFrame([(9000 + i, "123 456 !", "en") for i in range(50)] + [(9100 + i, "....", "de") for i in range(50)], "doc_id bigint, text string, lang string")
    plain = small.select("doc_id", "text", "lang")
    model = language_id.train(plain.unionByName(junk))
    assert len(model.langs) == 3 * len(set(model.langs)) and all(abs(np.linalg.norm(c) - 1) < 1e-4 for c in model.centres)


def test_grams_do_not_depend_on_slices(monkeypatch):
    raw = ("abc déf " * 500).encode()
    whole = language_id.gram_counts(raw)
    monkeypatch.setattr(language_id, "SLICE", 97)
    assert (language_id.gram_counts(raw) == whole).all()


# --- quality


def test_quality_accuracy(spark):
    sf = SMALL.replace("0.001", "0.1")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality_rules.query(spark, sf).join(labels, "doc_id").filter("held_out").collect()
    clean = [r for r in got if r.quality == 1]
    assert sum(r.predicted == r.quality for r in got) / len(got) > 0.98
    assert sum(r.predicted for r in clean) / len(clean) > 0.99


def test_quality_odd(spark, small, odd, empty):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    model = quality_rules.train(small, labels)
    got = quality_rules.score_documents(odd, model)
    assert got.count() == len(ODD) and all(0 <= r.score <= 1 for r in got.collect()) and set(odd.columns) <= set(got.columns)
    assert quality_rules.score_documents(empty, model).count() == 0
    nothing = quality_rules.train(small, labels.limit(0))
    assert {r.score for r in quality_rules.score_documents(odd, nothing).collect()} == {0.5}
    one = quality_rules.train(small, labels.withColumn("quality", F.lit(1)))
    assert {r.score > 0.9 for r in quality_rules.score_documents(odd, one).collect()} == {True}


def statistics_by_hand(text):
    text = text or ""
    w = [x for x in text.split(" ") if x]
    n, chars, kinds = len(w), len(text), len(set(w))
    upper = sum(unicodedata.category(c) == "Lu" for c in text)
    symbols = sum(unicodedata.category(c)[0] not in "LN" and c not in " \t\n\x0b\x0c\r" for c in text)
    per = lambda a, b: a / b if b else 0.0
    return {
        "log_words": np.log1p(n), "mean_word": per(chars, n), "upper_share": per(upper, chars), "symbol_share": per(symbols, chars), "symbols_per_word": per(symbols, n),
        "exclaims": per(text.count("!"), n), "stops": per(sum(c in ".!?" for c in text), n), "distinct_share": per(kinds, n), "distinct_root": per(kinds, n**0.5), "line_words": per(n, text.count("\n") + 1),
    }


def test_quality_equals_brute_force(spark, small, odd):
    """Statistics, rules and scores by plain Python."""
    model = quality_rules.train(small, spark.read.parquet(f"{SMALL}/labels.parquet"))
    assert len(model.rules) > 1 and all(len(r.tests) <= quality_rules.DEPTH for r in model.rules)
    for df in (small.select("doc_id", "text"), odd.select("doc_id", "text")):
        for r in quality_rules.score_documents(df, model).collect():
            x = statistics_by_hand(r.text)
            z = model.intercept + sum(rule.weight for rule in model.rules if all((x[name] > at) == greater for name, greater, at in rule.tests))
            assert abs(1 / (1 + np.exp(-z)) - r.score) < 1e-9


def test_quality_fit_is_bounded(spark, small):
    """Repeated doc_ids, in documents or labels, add no row to the fit."""
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    one = quality_rules.train(small, labels)
    assert quality_rules.train(small.unionByName(small).unionByName(small), labels.unionByName(labels)) == one


def test_quality_filter_reads_statistics_once(spark, small):
    """The test on the score stays above the projection of the statistics: one scan of the text for each class."""
    model = quality_rules.train(small, spark.read.parquet(f"{SMALL}/labels.parquet"))
    plan = quality_rules.keep_good(small, model)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("\\p{Lu}") == 1


def test_rules_equal_their_column(spark):
    rng = np.random.default_rng(0)
    x = rng.random((400, 2))
    y = ((x[:, 0] > 0.5) & (x[:, 1] <= 0.3)).astype(float)
    model = quality_rules.fit_rules(x, y, ["a", "b"])
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    got = df.select(((model.column() >= 0.5).cast("int") == F.col("y")).alias("ok")).filter("ok").count()
    assert got > 390 and len(model.rules) < 30


# --- decontamination


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def shingles(w):
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def matches_by_hand(docs, items):
    out = {}
    for doc_id, text in docs:
        s = shingles(words(text))
        have = set(s)
        for item_id, item in items:
            t = shingles(words(item))
            if not t or not have & set(t):
                continue
            c = Counter(t)
            best = 0
            for a in range(max(1, len(s) - len(t) + 1)):
                w = Counter(s[a : a + len(t)])
                best = max(best, sum((w & c).values()) / sum((w | c).values()))
            if best >= 0.8:
                out[doc_id, item_id] = max(out.get((doc_id, item_id), 0), best)
    return out


def test_decontamination(spark):
    base = [f"word{i}" for i in range(90)]
    items = [(1, " ".join(base[:60])), (2, "too short here"), (3, " ".join(base[40:80])), (4, None), (5, " ".join(["again", "and"] * 10))]
    edited = base[:60].copy()
    edited[20] = "changed"
    spoiled = base[:60].copy()
    for i in range(0, 60, 6):
        spoiled[i] = "x"
    docs = [
        (1, "Before it. " + " ".join(base[:60]).upper() + " and after"), (2, " ".join(edited)), (3, " ".join(spoiled)), (4, " ".join(base[3:58])), (5, "clean " * 50),
        (6, "p " * 30 + " ".join(base[:30]) + " inserted " + " ".join(base[30:60]) + " q" * 30), (None, " ".join(base[40:80])), (7, None), (8, ""), (9, " ".join(["again", "and"] * 30)), (2, " ".join(edited)), (10, LONG + " " + items[0][1]),
    ]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.matches(d, b).collect()}
    want = matches_by_hand(docs, items)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)
    assert {(1, 1), (2, 1), (6, 1), (None, 3), (9, 5), (10, 1)} <= set(got) and (3, 1) not in got and not any(k[0] == 5 for k in got)
    kept = decontaminate.drop_contaminated(d.withColumn("fp", F.lit(1)), b)
    bad = {t for i, t in docs if any(k[0] == i and i is not None or k == (None, 3) and i is None and t for k in got)}
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((i for i, t in docs if t not in bad), key=str)


def test_decontamination_blocks(spark, small, monkeypatch):
    b = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    one = {tuple(r) for r in decontaminate.matches(small, b).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_SHINGLES", 400)
    assert one and {tuple(r) for r in decontaminate.matches(small, b).collect()} == one


def test_decontamination_empty(spark, odd, empty):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.matches(odd, none).count() == 0 and decontaminate.drop_contaminated(odd, none).count() == len(ODD)
    assert decontaminate.matches(empty, spark.createDataFrame([(1, LONG[:400])], "item_id bigint, text string")).count() == 0


def signed64(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint_table(spark, values, names):
    rows = [(*[i] * len(names), 60, signed64(v & ((1 << 64) - 1)), signed64(v >> 64)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, ", ".join(f"{n} bigint" for n in names) + ", length int, fp0 bigint, fp1 bigint")


def test_index_covers_the_radius(spark):
    """Any two fingerprints within the radius meet, wherever the bits differ."""
    rng = np.random.default_rng(4)
    r = decontaminate.RADIUS
    assert sum(t + 1 for t in decontaminate.shares(r)) == r + 1 and sum(decontaminate.widths()) == decontaminate.BITS
    left = [int.from_bytes(rng.bytes(16), "little") for _ in range(60)]
    spread = [rng.choice(128, r, replace=False) for _ in range(40)] + [np.arange(r) + k for k in range(20)]
    right = [x ^ sum(1 << int(f) for f in flips) for x, flips in zip(left, spread)]
    hits = decontaminate.index_hits(fingerprint_table(spark, left, ["c1", "c2"]), fingerprint_table(spark, right, ["k1", "k2"]), r)
    assert hits.filter("c1 = k1").select("c1").distinct().count() == 60
    assert {x.distance for x in hits.filter("c1 = k1").collect()} == {r}


def test_index_prunes(spark):
    """Unrelated windows and 1,000 items of one length: far fewer rows leave the block join than there are pairs."""
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = lambda n: [(k, k, 40, [vocabulary[j] for j in rng.integers(0, 3000, 40)]) for k in range(n)]
    items = spark.createDataFrame(texts(1000), "k1 bigint, k2 bigint, length int, words array<string>")
    contents = spark.createDataFrame(texts(200), "c1 bigint, c2 bigint, length int, words array<string>")
    hits = decontaminate.index_hits(decontaminate.fingerprints(contents, decontaminate.CONTENT), decontaminate.fingerprints(items, [*decontaminate.ITEM, "length"]), decontaminate.RADIUS)
    share = hits.count() / (200 * 1000)
    print(f"rows of the block join / pairs of equal length: {share:.4f}")
    assert share < 0.05


def test_recall_at_the_threshold(spark):
    """Passages with words replaced, inserted and left out, held against every window of every document."""
    rng = np.random.default_rng(6)
    vocabulary = [f"w{i}" for i in range(4000)]
    some = lambda n: [vocabulary[j] for j in rng.integers(0, 4000, n)]
    items = [(k, some(int(rng.integers(40, 120)))) for k in range(60)]
    docs = []
    for k in range(400):
        w = list(items[k % 60][1])
        for _ in range(int(rng.integers(0, 4))):
            at, kind = int(rng.integers(0, len(w))), int(rng.integers(0, 3))
            w[at : at + (kind != 1)] = some(1) if kind < 2 else []
        docs.append((k, " ".join(some(int(rng.integers(0, 60))) + w + some(int(rng.integers(0, 60))))))
    named = [(k, " ".join(w)) for k, w in items]
    want = matches_by_hand(docs, named)
    found = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.matches(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(named, "item_id bigint, text string")).collect()}
    assert set(found) <= set(want) and all(found[k] <= want[k] + 1e-12 for k in found)
    near = [k for k, s in want.items() if s < 0.85]
    all_found, near_found = len(found) / len(want), len(set(near) & set(found)) / len(near)
    print(f"recall {all_found:.4f} of {len(want)}, {near_found:.4f} of {len(near)} between 0.8 and 0.85")
    assert all_found >= 0.98 and near_found >= 0.9


def test_only_contaminated_texts_go(spark):
    """Clean documents that share a doc_id, null too, with a contaminated one stay; repeated rows go together."""
    item = " ".join(f"word{i}" for i in range(30))
    rows = [(None, item), (None, "clean without an id"), (1, "x " + item), (1, "clean " * 9), (2, item), (2, item), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"t1": F.lit("x"), "c1": F.lit(1), "words": F.lit("w"), "__doc": F.lit(0)})
    kept = decontaminate.drop_contaminated(df, spark.createDataFrame([(1, item)], "item_id bigint, text string"))
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([rows[1], rows[3], rows[6], rows[7]], key=str)


# --- near duplicates


def classes_by_hand(rows):
    sets = {}
    for _, text in rows:
        w = tuple(words(text))
        sets[w] = {w[i : i + 5] for i in range(max(1, len(w) - 4))} if w else set()
    keys = list(sets)
    parent = {k: k for k in keys}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    near = defaultdict(set)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and both / len(sets[a] | sets[b]) >= 0.8:
                near[a].add(b)
                near[b].add(a)
                parent[root(a)] = root(b)
    ids = defaultdict(list)
    for doc_id, text in rows:
        ids[root(tuple(words(text)))].append(doc_id)
    smallest = {r: min([i for i in v if i is not None], default=None) for r, v in ids.items()}
    copies = Counter(tuple(words(t)) for _, t in rows)
    documents = {k: copies[k] - 1 + sum(copies[x] for x in near[k]) for k in keys}
    return sorted(((d, smallest[root(tuple(words(t)))], documents[tuple(words(t))], len(near[tuple(words(t))]), copies[tuple(words(t))]) for d, t in rows), key=str)


def near_copies(n, length=60):
    base = [f"word{i}" for i in range(length)]
    out = []
    for i in range(n):
        w = base.copy()
        w[i % length] = f"edit{i}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block,spread", [(256, 256), (7, 3)])
def test_ngram_join(spark, small, block, spread):
    rows = [(r.doc_id, r.text) for r in small.collect()]
    rows += [(5000 + i, t) for i, t in enumerate(near_copies(40))] + [(6000, None), (6001, ""), (6002, "?!"), (None, "lonely words without an id"), (6003, "two words"), (6004, "Two, words!"), (5000, near_copies(1)[0])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("norm", F.lit(0))
    got = ngram_join.classify(df, block=block, spread=spread).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links, r.n_texts, r.n_copies) for r in got), key=str) == classes_by_hand(rows)


def test_ngram_join_spreads_hot_keys(spark, monkeypatch):
    """Keys of more than three rows are dealt over several tasks: the same result, each row once."""
    monkeypatch.setattr(ngram_join.workspace, "HOT_ROWS", 3)
    rows = list(enumerate(near_copies(12))) + [(100 + i // 2, "one text that many documents share") for i in range(40)] + [(None, "")] * 9 + [(200, "alone")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = ngram_join.classify(df).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links, r.n_texts, r.n_copies) for r in got), key=str) == classes_by_hand(rows)
    assert sorted((r.doc_id for r in ngram_join.keep_one(df).collect()), key=str) == [0, 100, 200, None]


def test_ngram_join_odd(odd, empty):
    got = ngram_join.classify(odd).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links, r.n_texts, r.n_copies) for r in got), key=str) == classes_by_hand([(a, b) for a, b, _ in ODD])
    kept = ngram_join.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 2, 4, 5, 6, 7, 9, None]
    assert ngram_join.classify(empty).count() == 0 and ngram_join.keep_one(empty).count() == 0


def test_banding_reaches_its_recall():
    bands, rows = ngram_join.choose_bands(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= ngram_join.MAX_HASHES
    with pytest.raises(ValueError):
        ngram_join.choose_bands(0.1, 0.9999, 8)


def test_minhash_estimates_similarity():
    signer, rng = ngram_join.Signer(180, 1), np.random.default_rng(0)
    a = [f"w{i}" for i in range(400)]
    b = a[:300] + [f"v{i}" for i in range(100)]
    true = len(set(shingles(a)) & set(shingles(b))) / len(set(shingles(a)) | set(shingles(b)))
    (one, left), (two, right) = (signer.sign(" ".join(x).encode()) for x in (a, b))
    assert abs((one == two).mean() - true) < 0.12 and rng is not None
    assert abs((np.frombuffer(left, np.uint8) == np.frombuffer(right, np.uint8)).mean() - true) < 0.12


def test_keep_one_loses_nothing(spark):
    """Equal and null doc_ids on different texts, repeated rows, near copies: one of each class by hand stays."""
    near = near_copies(3)
    rows = [(1, "alpha beta one"), (1, "quite another text"), (2, "third"), (None, near[0]), (None, near[1]), (None, "alone without id"), (None, "alone without id"), (3, near[2]), (4, "Twice"), (4, "twice"), (4, "twice"), (5, "TWICE!"), (None, None), (6, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"node": F.lit(1), "__doc": F.lit(2), "t1": F.lit("x"), "stays": F.lit(False)})
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, " ".join(words(r.text))) for r in kept.collect()), key=str)
    assert got == sorted([(1, "alpha beta one"), (1, "quite another text"), (2, "third"), (None, "alone without id"), (3, near[2]), (4, "twice"), (6, "")], key=str)


def test_chained_buckets_are_verified_in_linear_work(spark):
    """10,000 dissimilar nodes, each sharing a band with the next: no group, and two rows for each shared band."""
    rng = np.random.default_rng(1)
    n = 10_000
    rows = [(i.to_bytes(16, "big"), [2 * i, 2 * i + 2, -i - 1], rng.integers(0, 256, 186, np.uint8).tobytes()) for i in range(n)]
    nodes = spark.createDataFrame(rows, "node binary, bands array<bigint>, sketch binary")
    assert ngram_join.similar_ties(nodes, 0.8).count() == 0
    similar = spark.createDataFrame([(node, bands, rows[0][2]) for node, bands, _ in rows[:50]], nodes.schema)
    assert ngram_join.candidate_groups(similar, 0.8).select("label").distinct().count() == 1


@pytest.mark.parametrize("block", [1024, 16])
def test_big_buckets_are_tied_in_blocks(spark, block):
    """Three clusters in one bucket stay three groups, however the bucket is divided."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 256, (3, 186), np.uint8)
    rows = []
    for i in range(150):
        sketch = base[i % 3].copy()
        sketch[rng.choice(186, 15, replace=False)] = rng.integers(0, 256, 15)
        rows.append((i.to_bytes(16, "big"), [7], sketch.tobytes()))
    nodes = spark.createDataFrame(rows, "node binary, bands array<bigint>, sketch binary")
    ties = ngram_join.similar_ties(nodes, 0.8, block)
    groups = defaultdict(set)
    for r in ngram_join.components(ties).collect():
        groups[bytes(r.label)].add(int.from_bytes(r.node, "big"))
    assert sorted(map(sorted, groups.values())) == [list(range(k, 150, 3)) for k in range(3)]


def test_shingles_do_not_depend_on_slices(monkeypatch):
    raw = LONG.encode()
    whole = ngram_join.Shingler().sets(raw)
    assert len(whole) == len(set(shingles(LONG.split())))
    monkeypatch.setattr(ngram_join, "SLICE", 1000)
    assert (ngram_join.Shingler().sets(raw) == whole).all()


# --- media


def test_ogg_checksum():
    def slow(data):
        crc = 0
        for byte in data:
            crc ^= byte << 24
            for _ in range(8):
                crc = (crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1
            crc &= 0xFFFFFFFF
        return crc

    for data in (b"", b"a", bytes(range(256)) * 3):
        assert media_ogg.checksum(data) == slow(data)


@pytest.mark.parametrize("size", [0, 1, 575, 576, 577, 4032, 4033, 65025, 65026, 300_000, 2_000_000])
def test_ogg_round_trip(size):
    raw = np.random.default_rng(size).integers(0, 256, size, np.uint8).tobytes()
    d = media_ogg.decode(media_ogg.encode(raw))
    assert d.payload == media_ogg.padded(raw) and d.n_bytes == size and len(d.payload) % 576 == 0 and d.payload
    assert d.packets[-1].granule == len(d.payload) and d.marks[-1][0] == len(d.payload) / 8000
    ends = np.cumsum([len(p.data) for p in d.packets])
    assert [p.granule for p in d.packets] == ends.tolist()


def test_ogg_damage():
    stored = media_ogg.encode(bytes(range(256)) * 600)
    for at in range(0, len(stored), 1997):
        bad = stored[:at] + bytes([stored[at] ^ 4]) + stored[at + 1 :]
        with pytest.raises(media_ogg.OggError):
            media_ogg.decode(bad)
    pages, at = [], 0
    for p in media_ogg.pages_of(stored):
        n = media_ogg.HEADER_SIZE + len(p.lacing) + len(p.body)
        pages.append(stored[at : at + n])
        at += n
    for i in range(len(pages)):
        with pytest.raises(media_ogg.OggError):
            media_ogg.decode(b"".join(pages[:i] + pages[i + 1 :]))
    with pytest.raises(media_ogg.OggError):
        media_ogg.decode(stored[:-1])


def test_ogg_packets_of_page_size():
    """Packets whose lacing ends exactly with a page, and empty ones."""
    w = media_ogg.OggWriter()
    sizes = [255 * 254, 0, 255 * 255, 255, 1, 255 * 600 + 3]
    for i, n in enumerate(sizes):
        w.put(7, bytes([i]) * n, i, last=i == len(sizes) - 1)
    assert [len(p.data) for p in media_ogg.packets_of(w.bytes())[7]] == sizes


def test_media_odd(odd, empty):
    rows = media_ogg.read_features(media_ogg.encode_documents(odd)).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        texts = [t for i, t, _ in ODD if i == r.doc_id]
        raw = (texts[0] or "").encode()
        assert r.n_bytes == len(raw) and r.payload_sha256 == hashlib.sha256(media_ogg.padded(raw)).hexdigest()
    assert len({tuple(r)[1:] for r in rows if r.doc_id == 5}) == 1
    assert media_ogg.read_features(media_ogg.encode_documents(empty)).count() == 0


# --- packing


def check_pieces(rows, texts):
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for doc_id, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and len(pieces) <= packing.Limits().segments
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding


def test_packing(small):
    rows = packing.pack_documents(small).collect()
    assert check_pieces(rows, [(r.doc_id, r.text) for r in small.collect()]) == 0


def test_packing_odd(spark, odd, empty):
    distinct = odd.dropDuplicates(["doc_id"])
    rows = packing.pack_documents(distinct).collect()
    assert check_pieces(rows, [(r.doc_id, r.text) for r in distinct.collect()]) == 0
    twice = packing.pack_documents(odd.filter("doc_id = 5")).collect()
    assert sum(r.length for r in twice) == 2 * twice[0].doc_tokens
    assert packing.pack_documents(empty).count() == 0


def test_encoder_equals_the_tokenizer():
    import random

    r = random.Random(7)
    alphabet = [chr(c) for c in (9, 10, 11, 12, 13, 28, 31, 133, 160, 0x1680, 0x2028, 0x3000, 0xFEFF)] + list("aZéß01²٣中'sdtrelmv  $!_-") + ["\U0001f600", "é", "<|endoftext|>"]
    e, tokenizer = packing.Encoder(packing.tokenizer_path()), Tokenizer.from_file(packing.tokenizer_path())
    for _ in range(3000):
        text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 14)))
        assert e.ids(text).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, packing.END_ID]


LONG_RUNS = [" " * 5_000_000, "\n" * 5_000_000, "a" + "\r\n" * 700_000 + "b", " \t" * 1000 + "x" + " " * 999, "z" * 1_000_000, "!" * 300_000 + " " * 2000, "one<|endoftext|>two <|endoftext|> <|endoftext|>" + "\n" * 3000]


@pytest.mark.parametrize("case", range(len(LONG_RUNS)))
def test_encoder_survives_long_runs(case):
    e, tokenizer = packing.Encoder(packing.tokenizer_path()), Tokenizer.from_file(packing.tokenizer_path())
    text = LONG_RUNS[case]
    assert e.ids(text).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, packing.END_ID]


def test_packing_long_runs(spark):
    texts = [(i, t) for i, t in enumerate(LONG_RUNS)]
    rows = packing.pack_documents(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()
    assert check_pieces(rows, texts) == 0


def test_pack_examples(spark):
    rng = np.random.default_rng(1)
    rows = [(str(i), int(a), int(min(a, b))) for i, (a, b) in enumerate(zip(rng.integers(1, 900, 300), rng.integers(0, 700, 300)))] + [("big", 3000, 10), ("none", None, None)]
    limits = packing.Limits(2048, 6, 900)
    got = packing.pack_examples(spark.createDataFrame(rows, "example_id string, tokens bigint, loss_tokens bigint").coalesce(1), limits).collect()
    need = {i: (t or 0, x or 0) for i, t, x in rows}
    assert sorted(r.example_id for r in got) == sorted(need)
    by_seq = defaultdict(list)
    for r in got:
        by_seq[r.sequence_id].append(r)
    for seq in by_seq.values():
        tokens, loss = (sum(need[r.example_id][k] for r in seq) for k in (0, 1))
        assert (tokens <= 2048 and loss <= 900 and len(seq) <= 6) or (seq[0].oversize and len(seq) == 1)
    bound = max(sum(t or 0 for _, t, _ in rows) / 2048, sum(x or 0 for _, _, x in rows) / 900, len(rows) / 6)
    assert len(by_seq) < 1.25 * bound + 2


def test_dot_product_prefers_what_fits_best():
    packer = packing.Packer(packing.Limits(10, 9, 10), pool=99)
    examples = [(6, 1), (4, 9), (4, 1), (6, 1)]
    for i, (t, x) in enumerate(examples):
        assert list(packer.put(packing.Example(i, 0, t, x))) == []
    made = [sorted(e.row for e in s) for s in packer.finish()]
    assert len(made) == 2 and sorted(sum(made, [])) == [0, 1, 2, 3]


@pytest.mark.parametrize("owners,pairs,columns", [(32, 1 << 20, 2048), (3, 50, 7), (1, 1, 1)])
def test_verification_equals_set_arithmetic(monkeypatch, owners, pairs, columns):
    monkeypatch.setattr(ngram_join, "DENSE_OWNERS", owners)
    monkeypatch.setattr(ngram_join, "PAIRS", pairs)
    monkeypatch.setattr(ngram_join, "COLUMNS", columns)
    rng = np.random.default_rng(6)
    base = np.arange(60)
    sets = [np.unique(np.where(rng.random(60) < rng.random() * 0.3, base + 1000 * (i % 5), base)).astype(np.uint64) for i in range(40)] + [np.zeros(0, np.uint64)]
    sim = np.array([[len(np.intersect1d(a, b)) / max(1, len(np.union1d(a, b))) for b in sets] for a in sets])
    every = np.arange(len(sets))
    off = ~np.eye(len(sets), dtype=bool)  # a set's similarity with itself is not asked for
    assert (ngram_join._verify(sets, every, every, 0.8) == (sim >= 0.8 - 1e-9))[off].all()
    left, right = every[::2], every[1::2]
    assert (ngram_join._verify(sets, left, right, 0.8) == (sim[np.ix_(left, right)] >= 0.8 - 1e-9)).all()
