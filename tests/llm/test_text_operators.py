import hashlib
import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm import language, mixing, quality_bayes, quality_rules, token_counts
from tests.llm.conftest import SF, is_native, odd_rows
from tools.compare import compare, oracle_connection

PATH = token_counts.vocabulary_path("word_bpe_49k.json")


# Token counts


def test_token_counts_equal_the_library(odd_docs):
    tool = Tokenizer.from_file(PATH)
    want = Counter()
    for r in odd_rows():
        n = len(tool.encode(r[1] or "", add_special_tokens=False).ids)
        want[r[0], len((r[1] or "").encode()), n, n > 2048] += 1
    got = token_counts.token_counts(odd_docs)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert Counter(map(tuple, got.collect())) == want


def test_token_counts_of_random_texts():
    rng = random.Random(1)
    tool, own = Tokenizer.from_file(PATH), token_counts.Counter(PATH)
    texts = ["".join(chr(rng.choice([rng.randrange(0x20, 0x7F), rng.randrange(0x3000), 32, 97])) for _ in range(60)) for _ in range(500)]
    texts += ["ΟΔΟΣ", "İI", "don't we'll 'S", "a" * 3000]
    texts = [t for t in texts if not any(0xD800 <= ord(c) < 0xE000 for c in t)]
    assert [own.text(t) for t in texts] == [len(e.ids) for e in tool.encode_batch(texts, add_special_tokens=False)]


def test_merging_equals_rescanning():
    rng = random.Random(4)
    for _ in range(300):
        ranks = {}
        while len(ranks) < 12:
            ranks.setdefault(tuple(rng.choice(["a", "b", "ab", "ba", "aa", "abab"]) for _ in range(2)), len(ranks))
        word = [rng.choice("ab") for _ in range(rng.randrange(1, 20))]
        parts = list(word)
        while True:
            best = min((ranks[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in ranks) if any(p in ranks for p in zip(parts, parts[1:], strict=False)) else None
            if best is None:
                break
            parts[best[1] : best[1] + 2] = ["".join(parts[best[1] : best[1] + 2])]
        assert token_counts.merged_length(word, ranks) == len(parts)


# Language ID


def test_language_held_out_accuracy(spark):
    folder = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = language.op8_language_id(spark, folder)
    rows = got.join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(odd_docs, no_docs):
    got = language.languages(odd_docs)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = got.collect()
    assert len(rows) == len(odd_rows())
    for r in rows:
        text = dict((x[0], x[1]) for x in odd_rows()[:21]).get(r.doc_id)
        if r.doc_id is not None:
            assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text or ""))
            crc = odd_docs.sparkSession.range(1).select(F.crc32(F.lit(str(r.doc_id)))).first()[0]
            assert r.held_out == (crc % 4 == 2)
    assert language.languages(no_docs).count() == 0
    unlabelled = language.languages(odd_docs.withColumn("lang", F.lit(None).cast("string")))
    assert {tuple(r)[2:] for r in unlabelled.collect()} == {("und", 0.0)}


def test_bundle_is_the_sum_of_bound_letters():
    grams, counts = language._trigrams("the cat")
    base = language._letter_vectors()[0].astype(int)
    want = sum(
        n * base[g // 4096] * _rolled(base[g // 64 % 64], 1) * _rolled(base[g % 64], 2) for g, n in zip(grams.tolist(), counts.tolist(), strict=True)
    )
    assert (language._bundle(grams, counts) == want).all()


def _rolled(vector, by):
    return [*vector[-by:], *vector[:-by]]


# Mixing


def poisson(rate, seed, doc):
    if not rate > 0:
        return 0
    total, shares = 0, math.ceil(rate / mixing.STEP)
    for nth in range(1, shares + 1):
        u = int(hashlib.md5(f"{seed}|{doc}|{nth}".encode()).hexdigest()[:13], 16) / (1 << 52)
        p = c = math.exp(-rate / shares)
        k = 0
        while not c > u and k < 5000:
            k += 1
            p *= rate / shares / k
            c += p
        total += k
    return total


@pytest.mark.parametrize("weighted", [False, True])
def test_mix_equals_inversion_row_by_row(spark, odd_docs, weighted):
    rows = odd_rows()
    n = Counter(r[3] for r in rows)
    given = {"a": 3.0, None: 1.0} if weighted else {s: m**mixing.POWER for s, m in n.items()}
    weights = spark.createDataFrame(list(given.items()), "source string, weight double") if weighted else None
    total = sum(given[s] for s in n if s in given)
    named = lambda r: r[0] if r[0] is not None else "text " + hashlib.md5((r[1] or "").encode()).hexdigest()
    want = Counter()
    for r in rows:
        rate = 2.0 * given.get(r[3], 0.0) / total * len(rows) / n[r[3]]
        for copy in range(1, poisson(rate, mixing.SEED, named(r)) + 1):
            want[r[0], r[1], copy] += 1
    got = mixing.mix(odd_docs, weights, epochs=2.0)
    assert is_native(got) or odd_docs is not None
    assert Counter((r.doc_id, r.text, r.copy_no) for r in got.collect()) == want


@pytest.mark.parametrize("doc_id,epochs", [("CAST(NULL AS BIGINT)", 1.0), ("CAST(7 AS BIGINT)", 40.0)])
def test_rows_without_id_or_with_one_id_are_dealt_apart(spark, doc_id, epochs):
    docs = spark.range(1000).selectExpr(f"{doc_id} AS doc_id", "concat('Text ', id) AS text", "'a' AS source", "id AS key", "id AS deal")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = mixing.mix(docs, epochs=epochs)
        assert got.columns == [*docs.columns, "copy_no", "shuffle_key"]
        spread = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert len(spread) > 1 and max(spread) < 0.6 * sum(spread)
        copies = {r["count"] for r in got.groupBy("text").count().collect()}
        assert len(copies) > 1 if epochs == 1.0 else len(copies) == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_labels_beyond_the_tables_of_a_task_learn_the_same(spark):
    rows = [(f"{w} {v} lantern " * 3, f"l{i % 5}") for i, (w, v) in enumerate(itertools.product(("harbour", "tide", "gull"), ("rope", "oil", "glass", "quay")))]
    docs = spark.createDataFrame(rows, "text string, lang string").coalesce(1)
    many = language.learn(docs)
    few = language.learn(docs, tables=2)
    assert many.keys() == few.keys() and all((many[k] == few[k]).all() for k in many)


def test_mix_is_native_and_empty_tables_give_nothing(spark, no_docs):
    assert is_native(mixing.op4_mixing(spark, SF))
    assert mixing.mix(no_docs).count() == 0


def test_poisson_of_large_and_odd_means(spark):
    df = spark.range(3000).select(*[mixing.poisson(F.lit(m), F.lit("s"), F.col("id").cast("string")).alias(f"m{i}") for i, m in enumerate((0.3, 4.0, 1300.0, 0.0, -1.0, float("nan")))])
    row = df.agg(*[F.avg(c).alias(c) for c in df.columns], F.variance("m2").alias("v")).first()
    assert abs(row.m0 - 0.3) < 0.05 and abs(row.m1 - 4) < 0.2 and abs(row.m2 - 1300) < 4 and abs(row.v / 1300 - 1) < 0.15
    assert (row.m3, row.m4, row.m5) == (0, 0, 0)


# Quality rules


def test_rules_equal_counting_by_hand(odd_docs):
    space = " \t\n\x0b\x0c\r"
    split = lambda t: "".join("\n" if c in space else c for c in t).split("\n")
    want = Counter()
    for r in odd_rows():
        text = r[1] or ""
        words = [w for w in split(text) if w]
        at = {}
        for i in range(len(words) - 7):
            at.setdefault(tuple(words[i : i + 8]), []).append(i)
        covered = {j for starts in at.values() if len(starts) > 1 for i in starts for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if any(c not in space for c in x)]
        failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
        want[r[0], len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed] += 1
    got = quality_rules.apply_rules(odd_docs)
    rows = got.collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == want
    assert not any(r.kept and r.base_failed for r in rows)


def test_rules_are_native_equal_sql_and_keep_good_documents(spark, no_docs):
    folder = SF.replace("0.001", "0.01")
    got = quality_rules.op5_quality_rules(spark, folder)
    assert is_native(got)
    assert compare(got, oracle_connection(folder), quality_rules._sql()) == ""
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = got.join(labels, "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    share = {r.quality: r.k for r in rows}
    assert share[1] == 1 and share[0] < 0.1
    assert quality_rules.apply_rules(no_docs).count() == 0


# Quality classifier


def test_classifier_agrees_with_labels(spark):
    folder = SF.replace("0.001", "0.01")
    got = quality_bayes.op6_quality_bayes(spark, folder)
    rows = got.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    assert sum(r.kept == (r.quality == 1) for r in rows) / len(rows) > 0.95


def test_classifier_on_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1), (4, 1), (5, None), (None, 1), (20, 0), (999, 1)], "doc_id bigint, quality int")
    none = labels.limit(0)
    args = (F.col("source"), F.concat_ws("/", "source", "lang"))
    assert quality_bayes.classify(odd_docs, labels, *args).count() == len(odd_rows())
    assert {r.score for r in quality_bayes.classify(odd_docs, none, *args).collect()} == {0.5}
    assert quality_bayes.classify(no_docs, labels, *args).count() == 0


def bayes(rows, marks):
    """Posteriors and scores of rows (doc_id, host, path, bins by feature) by plain loops over the formulas."""
    names = sorted(rows[0][3])
    up, down, good, bad = {}, {}, 0.0, 0.0
    for doc_id, _, _, bins in rows:
        for y in [sum(marks[doc_id]) / len(marks[doc_id])] if marks.get(doc_id) else []:
            good, bad = good + y, bad + 1 - y
            for f in names:
                up[f, bins[f]] = up.get((f, bins[f]), 0) + y
                down[f, bins[f]] = down.get((f, bins[f]), 0) + 1 - y
    told = []
    for doc_id, host, path, bins in rows:
        seen = [(f, bins[f]) for f in names if (f, bins[f]) in up]
        ratio = sum(math.log((up[x] + 1) / (good + 16)) - math.log((down[x] + 1) / (bad + 16)) for x in seen) * 0.5
        told.append((doc_id, host, path, ratio, 1 / (1 + math.exp(-ratio))))

    def groups(key):
        out = {}
        for r in told:
            n, p = out.get(key(r), (0, 0.0))
            out[key(r)] = (n + 1, p + r[4])
        return out

    def posterior(own, above):
        spread = sum(n * (p / n - above(k)) ** 2 for k, (n, p) in own.items())
        noise = sum(above(k) * (1 - above(k)) for k in own)
        within = sum(n * above(k) * (1 - above(k)) for k, (n, _) in own.items())
        total = sum(n for n, _ in own.values())
        strength = min(max(within / total / max((spread - noise) / total, 1e-9) - 1, 1.0), 10_000.0)
        return {k: (p + strength * above(k)) / (n + strength) for k, (n, p) in own.items()}

    hosts = groups(lambda r: r[1])
    prior = sum(p for _, p in hosts.values()) / len(told)
    of_host = posterior(hosts, lambda k: prior)
    of_path = posterior(groups(lambda r: (r[1], r[2])), lambda k: of_host[k[0]])
    out = []
    for doc_id, host, path, ratio, _ in told:
        p = min(max(of_path[host, path], 1e-6), 1 - 1e-6)
        out.append((doc_id, 1 / (1 + math.exp(-(ratio + math.log(p) - math.log(1 - p)))), of_host[host], of_path[host, path]))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def test_classifier_equals_plain_loops(spark):
    rng = random.Random(12)
    good, bad = "a plain sentence of the usual kind with some words in it", "### $$$ %%% &&& ***"
    hosts = [None, "", "h1", "h2", "h3", "="]
    rows = [(i if i % 29 else None, " ".join(rng.choice([good, good, bad, "WORDS!! 12", ""]) for _ in range(rng.randint(0, 5))), rng.choice(hosts), rng.choice([None, "", "x", "y"])) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, host string, path string")
    given = [(i, rng.randint(0, 1)) for i in range(0, 240, 3)] + [(3, 1), (6, None), (None, 1), (999, 0)]
    marks = {}
    for i, y in given:
        if i is not None and y is not None:
            marks.setdefault(i, []).append(y)
    bins = docs.select("doc_id", "host", "path", F.struct(*[c.alias(n) for n, c in quality_bayes.features(F.col("text")).items()]).alias("bins")).collect()
    want = bayes([(r.doc_id, r.host, r.path, r.bins.asDict()) for r in bins], marks)
    labels = spark.createDataFrame(given, "doc_id bigint, quality int")
    got = quality_bayes.classify(docs, labels, F.col("host"), F.col("path")).collect()
    got = sorted(((r.doc_id, r.score, r.host_posterior, r.path_posterior) for r in got), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert [r[0] for r in got] == [r[0] for r in want]
    assert all(abs(a - b) < 1e-9 for g, w in zip(got, want, strict=True) for a, b in zip(g[1:], w[1:], strict=True))


def test_sparse_paths_shrink_towards_their_host(spark):
    good, bad = "a plain sentence of the usual kind with some words in it", "### $$$ %%% &&& ***"
    rows = [(i, good if i % 10 else bad, "h1", "h1/a") for i in range(100)] + [(200, bad, "h1", "h1/b")] + [(300 + i, bad, "h2", "h2/a") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, host string, path string")
    labels = spark.createDataFrame([(r[0], int(r[1] == good)) for r in rows], "doc_id bigint, quality int")
    got = {r.doc_id: r for r in quality_bayes.classify(docs, labels, F.col("host"), F.col("path")).collect()}
    assert got[200].path_posterior > got[300].path_posterior
    assert got[1].host_posterior > 0.7 > got[300].host_posterior
    assert abs(got[200].path_posterior - got[200].host_posterior) < got[200].host_posterior - got[200].score
