import zlib
from collections import Counter

import edge
import numpy as np
import pyarrow as pa
import pytest
import reference
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logweave.llm import crossentropy, quality, rules, urls
from logweave.llm.queries import table

SF = "/root/testdata/sf0.01"


def bigram_losses(docs, chosen):
    """The two models by plain counting, each document scored without itself."""
    out = {}
    totals = {}
    for model, members in (("background", docs), ("target", [d for d in docs if d[0] in chosen])):
        words, pairs = Counter(), Counter()
        for _, t in members:
            w = ["<s>", *t.split()] if t else []
            words.update(w)
            pairs.update(zip(w, w[1:]))
        totals[model] = words, pairs, sum(words.values()) - words["<s>"]
    ratio = max(totals["target"][2], 1) / max(totals["background"][2], 1)
    for d, t in docs:
        w = ["<s>", *t.split()]
        own, own_pairs = Counter(w), Counter(zip(w, w[1:]))
        for model, part in (("target", ratio), ("background", 1.0)):
            words, pairs, total = totals[model]
            there = model == "background" or d in chosen
            unseen = crossentropy.UNSEEN * part
            loss = 0.0
            for a, b in zip(w, w[1:]):
                alone = (words[b] - own[b] * there + unseen) / (total - (len(w) - 1) * there + unseen * crossentropy.CLASSES)
                history = words[a] - own[a] * there
                share = (pairs[a, b] - own_pairs[a, b] * there) / history if history > 0 else alone
                s = crossentropy.SHARES
                loss -= np.log(s[0] * share + s[1] * alone + s[2] / crossentropy.CLASSES)
            out[d, model] = loss / max(len(w) - 1, 1)
    return out


def test_losses_are_those_of_plain_counting(spark):
    random = np.random.default_rng(2)
    docs = [(i, " ".join(random.choice(["a", "b", "c", "dd", "e"] if i % 2 else ["x", "y", "a", "z"], 30))) for i in range(40)] + [(90, "")]
    chosen = {i for i in range(0, 40, 4)}
    want = bigram_losses(docs, chosen)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    target = spark.createDataFrame([(i,) for i in chosen], "doc_id bigint")
    got = {r.doc_id: r for r in crossentropy.cross_entropy_difference(frame, target).collect()}
    for d, t in docs:
        assert got[d].n_tokens == len(t.split())
        assert got[d].target_loss == pytest.approx(want[d, "target"], rel=1e-4)
        assert got[d].background_loss == pytest.approx(want[d, "background"], rel=1e-4)
        assert got[d].difference == pytest.approx(got[d].target_loss - got[d].background_loss)
    assert np.mean([got[i].difference for i in range(2, 40, 4)]) < np.mean([got[i].difference for i in range(1, 40, 2)])


def test_no_two_words_or_bigrams_share_a_count(spark):
    """Every word stands in two documents, no bigram does: more words than ``CLASSES``, and all losses are known."""
    n, width = 300_000, 100
    assert n > crossentropy.CLASSES
    lists = np.concatenate((np.arange(n), (np.arange(n) * 7 + 3) % n)).reshape(-1, width)
    docs = [(i, " ".join(f"w{x}" for x in words)) for i, words in enumerate(lists.tolist())]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    target = spark.createDataFrame([(i,) for i in range(n // width)], "doc_id bigint")
    got = crossentropy.cross_entropy_difference(frame, target).collect()
    assert len(got) == len(docs)
    # Of the first half each word is once in all other texts and never in those of the target; of the second half once in both.
    total = np.array([2 * n - width, n - width, n])
    counted = np.array([1, 0, 1])
    unseen = crossentropy.UNSEEN * np.array([1, 0.5, 0.5])
    alone = (counted + unseen) / (total + unseen * n)
    # Words that the model has not seen before have no history: the word's own share stands in for the bigram's.
    share = np.where(counted > 0, 0, alone)
    s = crossentropy.SHARES
    want = -np.log(s[0] * share + s[1] * alone + s[2] / n)
    start = -np.log(s[1] * alone + s[2] / n)  # no word starts two texts
    want = (want * (width - 1) + start) / width
    for r in got:
        assert r.background_loss == pytest.approx(want[0], rel=1e-9)
        assert r.target_loss == pytest.approx(want[1 if r.doc_id < n // width else 2], rel=1e-9)


def test_losses_of_odd_rows(spark):
    target = spark.createDataFrame([(6,), (6,), (None,)], "doc_id bigint")
    got = crossentropy.cross_entropy_difference(edge.frame(spark), target).collect()
    assert len(got) == len(edge.rows()) and all(np.isfinite(r.difference) for r in got)
    assert all(r.difference == 0 for r in got if not r.n_tokens)
    assert crossentropy.cross_entropy_difference(edge.frame(spark), target.limit(0)).count() == len(edge.rows())
    assert crossentropy.cross_entropy_difference(edge.empty(spark), target).count() == 0


TEXTS = st.lists(st.text("aB#é \n\t.!", max_size=60), max_size=8)


@settings(max_examples=12, deadline=None)
@given(texts=TEXTS)
def test_statistics_are_those_of_plain_python(spark, texts):
    texts = [*texts, *(t * 9 for t in texts), "a b c " * 200 + "x", "a a a a", "q w e r t y q w e z"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = rules.with_statistics(frame, "doc_id", "text").withColumn("base_failed", rules.base_failed()).collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == reference.base_statistics(texts[r.doc_id])


def test_covering_finds_planted_rules():
    random = np.random.default_rng(1)
    x = random.uniform(size=(6000, 7))
    bad = (x[:, 2] > 0.8) | ((x[:, 5] > 0.7) & (x[:, 1] < 0.3))
    found = rules.learn_rules(x, bad)
    caught = np.zeros(len(x), bool)
    for rule in found:
        caught |= rules.covers(rule, x)
    assert (caught == bad).mean() > 0.95 and len(found) <= 6
    assert not rules.learn_rules(x, np.zeros(len(x), bool)) and not rules.learn_rules(x[:0], bad[:0])


def test_rules_keep_good_documents(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = rules.judge_documents(docs, labels).join(labels.dropDuplicates(["doc_id"]), "doc_id").filter("not base_failed").collect()
    good = [r.kept for r in got if r.quality == 1]
    junk = [r.kept for r in got if r.quality == 0]
    assert np.mean(good) >= 0.99 and np.mean(junk) <= 0.2


def test_rules_of_odd_rows(spark):
    got = rules.judge_documents(edge.frame(spark), edge.labels(spark)).collect()
    assert len(got) == len(edge.rows()) and all(r.kept == (not r.base_failed) and r.rule is None for r in got)
    assert rules.judge_documents(edge.empty(spark), edge.labels(spark, [(1, 0, 0), (1, 1, 0), (None, 1, 1), (2, None, 0)])).count() == 0


URLS = [
    "https://a.net/x", "http://net/", "http://a.net", "http://b.example.net/en/1", "http://example.net/en/", "https://w.example.com/de/x",
    "HTTP://W.EXAMPLE.COM/de/x?q#f", "https://org/fr/", "https://x.org/fr", "https://notexample.com/de/", "ftp://é.org/fr/ü", "no scheme", "",
    "://", "://a.net/", "http://u:p@a.net:80/", "http://bad.test/p/?utm_source=a&x=1#f", "http://www.bad.test/p?x=1", "http://bad.test/p?x=2", None, None,
]


def plain_verdict(url, listed):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fitting = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fitting, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best.verdict if best else "block" if url in listed else "allow"


@pytest.mark.parametrize("most", [1, 1 << 20])
def test_urls(spark, monkeypatch, most):
    monkeypatch.setattr(urls, "blocks_for", lambda count: min(most, 4))
    extra = [f"http://site{i}.test/{i}" for i in range(300)]
    every = URLS + extra
    pages = spark.createDataFrame(list(enumerate(every)), "page_id bigint, url string").withColumns({"block": F.lit(1), "w0": F.lit("x"), "host": F.lit(2)})
    listed = spark.createDataFrame([("http://bad.test/p?x=1",), (extra[7],), (extra[7],), (None,), ("no scheme",)], "url string")
    hit = {URLS[16], URLS[17], extra[7]}
    got = urls.judge_urls(pages, listed, urls.RULES).collect()
    assert len(got) == len(every)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == plain_verdict(every[r.page_id], hit), every[r.page_id]
    assert urls.judge_urls(pages.limit(0), listed, urls.RULES).count() == 0
    assert all(r.verdict == plain_verdict(every[r.page_id], ())[3] for r in urls.judge_urls(pages, listed.limit(0), urls.RULES).collect())


def test_bloom_filter_passes_all_members_and_few_others(spark):
    keys = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("k"))
    blocks = urls.blocks_for(1000)
    bloom = urls.blocked_bloom(keys.filter("substr(k, 2) < 1000"), "k", blocks)
    assert bloom.count() <= blocks and urls.blocks_for(10**12) == urls.MOST_BLOCKS
    joined = keys.withColumn("block", urls._block(F.col("k"), blocks)).join(bloom, "block", "left")
    hit = F.lit(True)
    for w, mask in enumerate(urls._masks(F.col("k"))):
        hit = hit & F.coalesce(F.col(f"w{w}").bitwiseAND(mask) == mask, F.lit(False))
    counts = {r[0]: r[1] for r in joined.groupBy(F.expr("substr(k, 2) < 1000")).agg(F.sum(hit.cast("int"))).collect()}
    assert counts[True] == 1000 and counts[False] < 50


def test_classifier_on_held_out_rows(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = quality.score_documents(docs, labels).collect()
    label = {r.doc_id: r.quality for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    tested = [(r.score, label[r.doc_id]) for r in rows if r.held_out and r.doc_id in label]
    good, junk = (np.array([s for s, y in tested if y == k]) for k in (1, 0))
    assert (good[:, None] > junk[None, :]).mean() > 0.97 and (good >= 0.7).mean() > 0.97


def test_classifier_on_odd_rows(spark):
    kinds = [(1, 1, 0), (5, 0, 0), (5, 1, 0), (None, 1, 0), (6, None, 0), (99, 1, 0)]
    for labels in (edge.labels(spark), edge.labels(spark, kinds)):
        rows = quality.score_documents(edge.frame(spark), labels).collect()
        assert len(rows) == len(edge.rows()) and all(0 <= r.score <= 1 for r in rows)
        assert quality.score_documents(edge.empty(spark), labels).count() == 0
    assert quality.good_documents(edge.frame(spark), edge.labels(spark, kinds), 0.0).columns == edge.frame(spark).columns


def test_temperature_and_repetition():
    net = quality.train_network(np.zeros((0, 2 * quality.SIZE + 3)), np.zeros(0))
    assert net.probabilities(np.zeros((2, 2 * quality.SIZE + 3))).tolist() == [0.5, 0.5]
    vectors, index = np.zeros((quality.BUCKETS, quality.SIZE), np.float32), quality.index_vectors()
    x = quality.pooled(pa.array(["a b c d e f g h", "a a a a a a a a", "", None]), vectors, index)
    assert x[1, -2] > x[0, -2] and x[1, -1] > x[0, -1] and not x[2:].any()


def test_an_id_is_learned_from_once(spark, monkeypatch):
    docs = [(i, " ".join(f"w{i}x{k}" for k in range(80))) for i in range(40)]
    frame = spark.createDataFrame(docs + [(0, f"{t} {k}") for k in range(50) for i, t in docs if i == 0], "doc_id bigint, text string")
    labels = edge.labels(spark, [(i, i % 2, 0) for i in range(40)])
    sizes = {}
    learn, train = rules.learn_rules, quality.train_network
    monkeypatch.setattr(rules, "learn_rules", lambda x, bad: (sizes.update(rules=len(x)), learn(x, bad))[1])
    monkeypatch.setattr(quality, "train_network", lambda x, y: (sizes.update(quality=len(x)), train(x, y))[1])
    rules.learned_rules(frame, labels)
    quality.quality_score(frame, labels)
    assert sizes == {"rules": 40, "quality": labels.filter(~quality.held_out(F.col("doc_id"))).count()}
    assert labels.filter((F.col("doc_id") == 0) & ~quality.held_out(F.col("doc_id"))).count()


def test_a_score_is_a_function_of_the_text_alone():
    def share(*texts):
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
        letters, _, bounds = quality.word_buckets(data, offsets)
        return quality._repeats(letters, bounds)[0]

    assert share("a b a ", "b c d") == share("a b a ", "c b d") == share("a b a ") == 0
    assert share("a b a b ", "a") == share("a b a b ") == 1 / 4
    vectors = np.random.default_rng(1).normal(size=(quality.BUCKETS, quality.SIZE)).astype(np.float32)
    texts = ["a b a", "b c d", "", "c b d " * 40, "a b a"]
    together = quality.pooled(pa.array(texts), vectors, quality.index_vectors())
    for order in ([4, 3, 2, 1, 0], [1, 0, 3, 2, 4]):
        again = quality.pooled(pa.array([texts[i] for i in order]), vectors, quality.index_vectors())
        assert (again == together[order]).all()
