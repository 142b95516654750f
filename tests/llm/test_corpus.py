"""The corpus operators against plain Python, on a table that holds the awkward cases: null
and empty texts, null ids, repeated rows, copies, very long texts, clashing column names."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from daybook.llm import (
    chat_format,
    common,
    decontaminate,
    language_model,
    line_dedup,
    near_dedup,
    packing,
    quality_classifier,
    quality_rules,
    sharding,
    url_filter,
)

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, label string, slot string, node string, __pk_bin string"
ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"


def _rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)] + ["Über", "éa", "Σigma", "x|y", "***"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "no id at all but words"), (4, "one"), (4, "one"), (5, "a b c"), (6, "A B  C")]
    base = text(120).split()
    for i in range(30):  # near copies: one to three words changed
        own = list(base)
        for _ in range(1 + i % 3):
            own[rng.randrange(120)] = f"new{i}"
        rows.append((100 + i, " ".join(own)))
    rows += [(200 + i, "\n".join([text(20), "Common Line ", text(15), f"common line{' ' * (i % 2)}"])) for i in range(25)]
    rows += [(300 + i, text(60) + "\n" + text(5)) for i in range(12)] + [(350 + i, rows[12][1]) for i in range(5)]
    rows += [(400, text(3) + " " + ITEM.upper().replace(" ", "; ") + " " + text(4)), (401, text(900) + " " + ITEM + "." + ITEM), (402, "tau upsilon phi"), (403, text(6000))]
    rows += [(500, "of " * 80), (501, "aa bb cc dd " * 30)]
    return [(d, t, "en", ("host" if (d or 0) % 2 else None), len(t) if t is not None else None, "x", "x", "x", "x", "x") for d, t in rows]


ROWS = _rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def bag(rows):
    return collections.Counter(tuple(r) for r in rows)


# --- 1 -----------------------------------------------------------------------------------


def _hits(text, items, window=13):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text or ""))
    hit, found = set(), set()
    for item, t in items:
        i = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t or ""))
        n = min(window, len(i))
        for k in range(len(i) - n + 1 if n else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == i[k : k + n]:
                    hit |= set(range(p, p + n))
                    found.add(item)
    return len(w), len(hit), tuple(sorted(found))


ITEMS = [(7, ITEM), (7, "tau upsilon phi"), (8, "upsilon PHI"), (9, None), (10, "  "), (None, "w1 w2")]


@pytest.mark.parametrize("segment, block", [(2_000_000, 100_000), (500, 4)])
def test_decontamination(spark, docs, segment, block):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    index = decontaminate.build_index(docs, segment_words=segment)
    got = decontaminate.summarize(index, items, window=13, block_words=block)
    known = [i for i in ITEMS if i[0] is not None]
    want = bag((r[0], *_hits(r[1], known)) for r in ROWS)
    assert bag((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in got.collect()) == want


def test_phrases_and_proximity(spark):
    docs = spark.createDataFrame([(1, "a b c x a"), (2, "c b a"), (3, "a z z z b z c"), (4, None)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    index = decontaminate.build_index(docs)
    assert [(r.doc_id, r.start, r.length) for r in decontaminate.phrase_matches(index, items).collect()] == [(1, 0, 3)]
    assert {r.doc_id for r in decontaminate.proximity_matches(index, items, slop=2).collect()} == {1, 2}


# --- 2 -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_packing(spark, docs, tokenizer):
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(tokenizer)
    rows = packing.pack(docs, tokenizer, window=512, bins=64).collect()
    pieces = []
    for r in ROWS:
        own = np.array([*ids.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        pieces += [(r[0], i, len(own[i : i + 512]), zlib.crc32(own[i : i + 512].tobytes()), len(own)) for i in range(0, len(own), 512)]
    assert bag((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == bag(pieces)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    assert sorted(by) == list(range(len(by)))


def test_packed_ids(spark, tokenizer):
    docs = spark.createDataFrame([(1, "some words here"), (2, "more " * 300)], "doc_id bigint, text string")
    packed = packing.pack(docs, tokenizer, window=128, bins=32)
    got = packing.sequences(packed, docs, tokenizer, window=128).collect()
    assert sum(len(r.ids) // 4 for r in got) == packed.agg(F.sum("length")).first()[0]


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_up_the_histogram(seed):
    rng = np.random.default_rng(seed)
    counts = rng.integers(0, 60, 33) * (rng.random(33) < 0.6)
    counts[0] = 0
    used = np.zeros(33, int)
    for combo, times in packing.plan(counts):
        assert sum(combo) <= 32
        for b in combo:
            used[b] += times
    assert (used == counts).all()


def test_nnls():
    rng = np.random.default_rng(1)
    a, x = rng.random((12, 6)), np.array([0, 1.5, 0, 2, 0, 0.5])
    assert packing.nnls(a, a @ x) == pytest.approx(x, abs=1e-5)


# --- 3, 4 --------------------------------------------------------------------------------


def _rules(text):
    w, ls = words(text), [x for x in (text or "").split("\n") if words(x)]
    seen = collections.Counter(zip(w, w[1:], w[2:]))
    inside = {i + k for i, t in enumerate(zip(w, w[1:], w[2:])) if seen[t] > 1 for k in range(3)}
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(ls) - len(set(ls)), len(inside), n < 50 or 100 * len(inside) > 50 * n


def _key(line):
    return low(line.strip(" \t\n\x0b\x0c\r"))


def _verdicts(rows, min_docs, percent, left, by_text=False):
    """(kept, text without the lines over the limits) of each row (id, text, host)."""
    docs, carry = collections.defaultdict(set), collections.defaultdict(set)
    for d, t, host in rows:
        docs[host].add((t or "") if by_text else d)
        for x in (t or "").split("\n"):
            carry[host, _key(x)].add((t or "") if by_text else d)
    out = []
    for _, t, host in rows:
        lines = (t or "").split("\n")
        over = [bool(_key(x)) and len(carry[host, _key(x)]) >= min_docs and 100 * len(carry[host, _key(x)]) >= percent * len(docs[host]) for x in lines]
        chars, gone = sum(len(_key(x)) for x in lines), sum(len(_key(x)) for x, o in zip(lines, over) if o)
        kept = not _rules(t)[-1] and not (gone and 100 * (chars - gone) < left * chars)
        out.append((kept, "\n".join(x for x, o in zip(lines, over) if not o) if any(over) else t))
    return out


@pytest.mark.parametrize("min_docs, percent, left, by_text", [(10, 1, 80, False), (10, 40, 80, False), (5, 1, 97, False), (2, 1, 80, True)])
def test_quality_rules(docs, min_docs, percent, left, by_text):
    out = quality_rules.judge(docs, min_docs, percent, left, by_text=by_text)
    text = quality_rules.without_lines(F.coalesce(F.col("text"), F.lit("")), F.col("removed"))
    hashed = docs.select("text", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("text_hash")).distinct()
    got = out.join(hashed, "text_hash").select("doc_id", *quality_rules.COUNTS, "base_failed", "kept", text.alias("left")).collect()
    plain = _verdicts([(r[0], r[1], r[3]) for r in ROWS], min_docs, percent, left, by_text)
    null_and_empty = {"": 2, None: 2}  # both have the hash of no bytes and meet twice above
    want = bag((r[0], *_rules(r[1]), k, t or "") for r, (k, t) in zip(ROWS, plain) for _ in range(null_and_empty.get(r[1], 1)))
    assert bag(got) == want


def test_repeated_lines_weigh_as_often_as_they_stand(spark):
    rows = [(i, "\n".join([*[f"own{i}x{j} " * 10 for j in range(6)], *["shared words here"] * 6]), "h") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = quality_rules.judge(docs).select("chars", "chars_removed", "kept").distinct().collect()
    assert {r.chars_removed for r in got} == {6 * len("shared words here")} and not any(r.kept for r in got)


def test_line_dedup(docs):
    key = lambda x: low(x.strip(" \t\n\x0b\x0c\r"))
    found = collections.defaultdict(set)
    for r in ROWS:
        for x in (r[1] or "").split("\n"):
            found[key(x)].add(r[0])
    gone = {k for k, d in found.items() if k and len(d) >= 10}
    want = bag((r[0], "\n".join(x for x in (r[1] or "").split("\n") if key(x) not in gone), len((r[1] or "").split("\n"))) for r in ROWS)
    out = line_dedup.dedup_lines(docs, 10)
    assert bag((r.doc_id, r.kept_text, r.n_lines) for r in out.collect()) == want
    assert out.columns[: len(docs.columns)] == docs.columns and "common line" in gone
    clash = line_dedup.dedup_lines(docs.select("doc_id", "text", F.lit("own").alias("n_lines"), F.lit(1).alias("n_lines_own")), 10)
    assert clash.columns == ["doc_id", "text", "n_lines_own_own", "n_lines_own", "kept_text", "n_lines", "n_dropped"]
    assert bag((r.doc_id, r.kept_text, r.n_lines) for r in clash.collect()) == want
    assert clash.select("n_lines_own_own").distinct().first()[0] == "own"
    copies = line_dedup.dedup_lines(docs.filter("doc_id = 4 OR doc_id >= 350 AND doc_id < 360"), 2, by_text=True)
    assert copies.filter("n_dropped > 0").count() == 0


# --- 5, 6 --------------------------------------------------------------------------------


@pytest.mark.parametrize("hot", [False, True])
def test_sharding(spark, docs, hot):
    if hot:
        docs = docs.withColumn("doc_id", F.lit(1).cast("bigint"))
    rows = sharding.shard(docs, shards=4, slots=64, parts=16).collect()
    assert bag((r["size"], r.text_crc32) for r in rows) == bag((len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in ROWS)
    for s in range(4):
        mine = sorted(r.slot for r in rows if r["shard"] == s)
        assert mine == list(range(len(mine))) and mine
    total = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(4)]
    assert max(total) - min(total) <= max(r["size"] for r in rows)


def test_rebalancing_moves_few():
    slots = {(i, 0): i % 4 for i in range(400)}
    weight = {s: 100 + (s[0] % 7) for s in slots}
    again = sharding.rebalanced(slots, weight, 4)
    total = collections.Counter()
    for s, shard in again.items():
        total[shard] += weight[s]
    assert max(total.values()) - min(total.values()) <= 0.01 * sum(total.values()) / 4
    assert sum(slots[s] != again[s] for s in slots) < 20


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def _urls():
    rng = random.Random(2)
    urls = [
        f"https://{rng.choice(['a', 'b-c'])}.example.{rng.choice(['com', 'org', 'net'])}/{rng.choice(['en', 'es', 'fr', 'de'])}/"
        f"{rng.randrange(999)}{rng.choice(['', '/', '.html', '?a=1&b=é', '#x'])}"
        for _ in range(300)
    ]
    urls += [None, "", "no scheme", "HTTP://X.ORG", "http://X.Org?q=a://b/c", "http://notexample.org/es/1", "http://example.org/es/1#x", "x://com/de/"]
    return urls + ["http://example.com/de/" + "long/" * 3000, "http://example.com/fr/1", "http://example.com/fr/1"]


def _rule(u):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
    host, path = (low(m[1]), m[2]) if m else ("", "")
    fits = [r for r in RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    return host, path, max(fits, key=lambda r: len(r[1] + r[2]), default=None)


def _lexical(u):
    """Features without statistics, and the three suffixes, in plain Python."""
    u, (host, path, _) = u or "", _rule(u)
    query = re.search(r"(?s)\?([^#]*)", u)
    times = collections.Counter(u)
    entropy = math.log2(len(u)) - sum(n * math.log2(n) for n in times.values()) / len(u) if u else 0.0
    own = [len(u), len(host), len(re.findall("/[^/]", path)), len(re.findall("[0-9]", u)) / max(len(u), 1), entropy]
    own += [len([x for x in query[1].split("&") if x]) if query else 0, len([x for x in host.split(".") if x]), host.count("-")]
    file, first = re.search(r"\.([^./]*)$", path), re.match("/([^/]*)", path)
    return own, (re.search(r"([^.]*)$", host)[1], file[1] if file else "", first[1] if first else "")


def _grown(binned, y, base, trees, depth, rate, least):
    """Margins of all labelled rows after boosting, in plain Python."""
    margin = [base] * len(y)

    def grow(rows, level):
        g = {i: y[i] - 1 / (1 + math.exp(-margin[i])) for i in rows}
        h = {i: (y[i] - g[i]) * (1 - y[i] + g[i]) for i in rows}
        total, weight = sum(g.values()), sum(h.values())
        score = lambda a, b: a * a / (b + least)
        best, where = 1e-6, None
        for f in range(len(binned[0])) if level < depth else ():
            lg = lh = 0.0
            for v in sorted({binned[i][f] for i in rows}):
                mine = [i for i in rows if binned[i][f] == v]
                lg, lh = lg + sum(g[i] for i in mine), lh + sum(h[i] for i in mine)
                gain = score(lg, lh) + score(total - lg, weight - lh) - score(total, weight)
                if gain > best + 1e-9 and min(lh, weight - lh) > 1e-9:
                    best, where = gain, (f, v)
        if where is None:
            return {i: rate * total / (weight + least) for i in rows}
        left = [i for i in rows if binned[i][where[0]] <= where[1]]
        right = [i for i in rows if binned[i][where[0]] > where[1]]
        return grow(left, level + 1) | grow(right, level + 1)

    for _ in range(trees):
        step = grow(list(range(len(y))), 0)
        margin = [m + step[i] for i, m in enumerate(margin)]
    return margin


@pytest.mark.parametrize("sent", [200_000, 0])
def test_url_filter(spark, monkeypatch, sent):
    """Rules, features, statistics, trees and scores beside plain Python."""
    monkeypatch.setattr(url_filter, "SENT_VALUES", sent)
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    urls = _urls()
    df = spark.createDataFrame([(i, u, "z", "y", "q") for i, u in enumerate(urls)], "page_id bigint, url string, host string, label string, n string")
    model = url_filter.BoostedTrees(trees=3)
    got = {r.page_id: r for r in url_filter.judge(df, RULES, model=model).collect()}
    rules, own = [_rule(u) for u in urls], [_lexical(u) for u in urls]
    labelled = [i for i, r in enumerate(rules) if r[2]]
    y = [int(rules[i][2][0] == "block") for i in labelled]
    prior = sum(y) / len(y)
    counts = [collections.Counter(own[i][1][k] for i in labelled) for k in range(3)]
    block = [collections.Counter(own[i][1][k] for i, b in zip(labelled, y) if b) for k in range(3)]
    features = [x + [(block[k][v] + prior * 10) / (counts[k][v] + 10) for k, v in enumerate(values)] for x, values in own]
    binned = [[sum(v >= c for c in model.cuts[f]) for f, v in zip(url_filter.FEATURES, row, strict=True)] for row in features]

    def leaf(node, row):
        while "value" not in node:
            node = node["left"] if row[url_filter.FEATURES.index(node["feature"])] <= node["bin"] else node["right"]
        return node["value"]

    for i, u in enumerate(urls):
        host, path, best = rules[i]
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, best[1] + best[2] if best else None)
        margin = model.base + sum(leaf(t, binned[i]) for t in model.forest)
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-9), u
        assert got[i].verdict == (best[0] if best else "block" if got[i].score >= 0.5 else "allow")
    assert model.base == pytest.approx(math.log(prior / (1 - prior))) and len(model.forest) == 3
    want = _grown([binned[i] for i in labelled], y, model.base, 3, model.depth, model.rate, model.least)
    assert [got[i].score for i in labelled] == pytest.approx([1 / (1 + math.exp(-m)) for m in want], abs=1e-6)


def test_trees_learn_urls_left_out(spark):
    """Of urls whose rule was hidden, nearly all get their rule's verdict."""
    urls = [u for u in _urls() if u] * 2
    df = spark.createDataFrame([(i, f"{u}&{i}" if "?" in u else u) for i, u in enumerate(urls)], "page_id bigint, url string")
    hidden = F.pmod(F.xxhash64("url"), F.lit(5)) == 0
    got = url_filter.judge(df, RULES, keep=~hidden).filter(hidden).filter("rule IS NOT NULL").select("url", "score").collect()
    right = [(r.score >= 0.5) == (_rule(r.url)[2][0] == "block") for r in got]
    assert len(right) > 40 and sum(right) > 0.9 * len(right)


# --- 7, 9 --------------------------------------------------------------------------------


def test_quality_classifier(spark):
    rng = random.Random(3)
    good, bad = ["the", "house", "river", "walks", "slowly"], ["BUY!!", "$$$", "click###", "WIN!!", "now%%%"]
    rows = [(i, " ".join(rng.choices(good if i % 2 else bad, k=40)), "x") for i in range(120)] + [(500, None, "x"), (501, "", "x"), (None, "the river", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    labels = [(i, i % 2, 0) for i in range(120)] * 2 + [(0, 1, 0), (None, 1, 0), (3, None, 0)]
    labels = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    held = F.pmod(quality_classifier.id_crc(), F.lit(4)) == 2
    model = quality_classifier.train(docs, labels, sample=200, buckets=4096, keep=~held)
    got = {r.doc_id: r for r in quality_classifier.score(docs, model).collect()}
    out = [i for i in range(120) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all((got[i].score > 0.5) == bool(i % 2) for i in out) and len(out) > 10
    assert 0 <= got[500].score <= 1 and got[500].score == got[501].score and got[None].score > 0.5
    assert all(r.predicted == int(r.score >= 0.7) for r in got.values())
    one_sided = quality_classifier.train(docs, labels.filter("quality = 1"), buckets=64)
    assert one_sided.weight.sum() == 0


def test_quality_scores_are_averages_under_a_softmax():
    """The score beside the mean of all words' and n-grams' vectors and the softmax over it."""
    rng = random.Random(8)
    buckets, words_ = 512, ["river", "hünd", "$$$", "a", "longer-word", "x"]
    texts = [" ".join(rng.choices(words_[: 3 + i % 4], k=30)) for i in range(40)] + [None, "", "  \n ", "never seen before"]

    def every(text):
        return [b for w in (text or "").split() for b in quality_classifier.buckets_of(w, buckets)]

    examples = []
    for i, t in enumerate(texts[:40]):
        n = collections.Counter(every(t))
        examples.append((i % 4 // 2, np.fromiter(n, np.int32, len(n)), np.fromiter(n.values(), np.float32, len(n))))
    vectors, out, bias = quality_classifier.fit_sgd(examples, buckets)
    model = quality_classifier.Model(*quality_classifier.folded(vectors, out, bias), "a test")
    for t, margin in zip(texts, model.margins(texts), strict=True):
        b = every(t)
        z = out.astype(float) @ (vectors[b].astype(float).mean(axis=0) if b else np.zeros(16)) + bias
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert 1 / (1 + math.exp(-margin)) == pytest.approx(p[1], abs=1e-5)
    assert quality_classifier.buckets_of("né", 97) == [zlib.crc32(x) % 97 for x in ["w<né>".encode(), *(b"<n\xc3\xa9>"[i : i + n] for n in (3, 4) for i in range(6 - n))]]


def test_one_text_is_learnt_for_an_id(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "other")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int")
    seen = []
    real, quality_classifier.fit_sgd = quality_classifier.fit_sgd, lambda examples, buckets: seen.extend(examples) or real(examples, buckets)
    try:
        quality_classifier.train(docs, labels, buckets=64)
    finally:
        quality_classifier.fit_sgd = real
    assert [e[0] for e in seen] == [0, 1]


@pytest.mark.parametrize("head", [200_000, 5])
def test_language_model(spark, docs, head):
    rows = language_model.score(docs, head=head, bits_per_token=400.0).collect()
    toks = lambda t: [*words(low(t or "")), None]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    count, pairs = collections.Counter(), collections.Counter()
    for r in ROWS:
        if not held(r[0]):
            count.update(toks(r[1]))
            pairs.update(zip([None, *toks(r[1])], toks(r[1])))
    n, v = sum(count.values()), len(count)
    want = {}
    for r in ROWS:
        t = toks(r[1])
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t)
        want[r[0], len(t), round(base, 6)] = (held(r[0]), sum(count[w] > 0 for w in t))
    assert len(rows) == len(ROWS)
    middle = lambda c: c if c < 2 else 1.5 * 2 ** int(math.log2(c))

    def exact(t):
        """The model's formula with counts kept whole until they are quantised."""
        before, total = None, 0.0
        for w in t:
            follows = min(1.0, middle(pairs[before, w]) / max(middle(count[before]), 1.0))
            total += math.log10(0.7 * follows + 0.3 * (middle(count[w]) + 1) / (n + v + 1))
            before = w
        return total

    scores = collections.defaultdict(list)
    for r in ROWS:
        t = toks(r[1])
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t)
        scores[r[0], len(t), round(base, 6)].append(exact(t))
    for r in rows:
        key = r.doc_id, r.n_tokens, round(r.base_score, 6)
        assert want[key] == (r.held_out, r.n_known) and r.train_tokens == n
        assert min(abs(r.score - x) for x in scores[key]) < 1e-6


def test_false_positives_of_the_production_filter():
    """At six bits a token and two different n-grams a token, the rate is the fill's power."""
    n, model = 20_000, language_model.BloomModel(None, *language_model.filter_size(20_000, 6.0)[1:], 4, 20_000, 1)
    groups, bits = language_model.filter_size(n, 6.0)
    rng = np.random.default_rng(3)
    for per_token in (0.7, 2.0):
        keys = rng.integers(0, 2**64 - 1, int(n * per_token), dtype=np.uint64)
        full = np.zeros((groups, bits), bool)
        own = language_model._group(keys, groups).astype(int)
        for at in language_model._places(keys, 1, 4, bits):
            full[own, at.astype(int)] = True
        model.blocks = np.packbits(full, axis=1, bitorder="little")
        assert (model.quantised(keys) >= 1).all()
        other = rng.integers(0, 2**64 - 1, 20_000, dtype=np.uint64)
        assert (model.quantised(other) > 0).mean() == pytest.approx(model.filled() ** 4, abs=0.02)
    assert language_model.filter_size(10**12, 6.0)[0] * language_model.filter_size(10**12, 6.0)[1] > 5.9e12


def test_filter_beyond_the_broadcast(spark, docs):
    """A filter too large to be sent is probed in blocks, as large and with the same scores."""
    key = lambda r: (str(r.doc_id), r.n_tokens, round(r.base_score, 6), round(r.score, 9))
    sent, apart = (sorted(map(key, language_model.score(docs, most_bits=most).collect())) for most in (1 << 30, 64))
    assert len(sent) == len(ROWS) and apart == sent


def test_filter_reads_quantised_counts():
    model = language_model.BloomModel(np.zeros((4, 4096), np.uint8), 4096 * 8, 3, 10, 10)
    keys = language_model.word_keys(iter([b"a", b"b", b"c"]), 3)
    groups = language_model._group(keys, 4).astype(int)
    for key, g, q in zip(keys, groups, (1, 3, 0)):
        for step in range(1, q + 1):
            for at in language_model._places(np.array([key]), step, 3, model.bits):
                model.blocks[g, int(at[0]) >> 3] |= 1 << (int(at[0]) & 7)
    assert model.quantised(keys).tolist() == [1, 3, 0]
    assert model.counts(keys).tolist() == [1.0, 6.0, 0.0]


# --- 8 -----------------------------------------------------------------------------------


def _groups(rows, size, percent):
    """A number for the group of each row of words; None for rows without words."""
    return _joined(rows, size, percent)[1]


def _components(rows, size, percent):
    sets, group = _joined(rows, size, percent)
    least = {}
    for g, (d, _) in zip(group, rows):
        if d is not None:
            least[g] = min(least.get(g, d), d)
    return bag((d, len(s), least.get(g) if s else d) for s, g, (d, _) in zip(sets, group, rows))


def _joined(rows, size, percent):
    sets = []
    for d, t in rows:
        w = words(low(t or ""))
        n = min(size, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set())
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                label[find(i)] = find(j)
    return sets, [find(i) if s else None for i, s in enumerate(sets)]


@pytest.mark.parametrize("size, small", [(4, 24), (5, 1)])
def test_near_duplicates(docs, monkeypatch, size, small):
    monkeypatch.setattr(near_dedup, "SMALL_LIST", small)
    if small == 1:  # all keys of three rows and more are hot
        monkeypatch.setattr(common, "HOT_ROWS", 2)
    got = near_dedup.near_duplicates(docs, size=size, width=4).collect()
    assert bag((r.doc_id, r.n_shingles, r.component_id) for r in got) == _components([r[:2] for r in ROWS], size, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_spread_join(spark):
    left = spark.createDataFrame([(i % 3 or None, i) for i in range(40)] + [(9, 99)], "k int, v int")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (7, "c")], "k int, w string")
    hot = common.hot_keys(left.groupBy("k").agg(F.count(F.lit(1)).alias("c")), ["k"], 4)
    for how in ("inner", "left"):
        got = common.spread_join(left, right, ["k"], hot, F.xxhash64("v"), how)
        assert bag(got.select("k", "v", "w").collect()) == bag(left.join(right, "k", how).select("k", "v", "w").collect())


def test_a_pair_at_exactly_the_threshold(spark):
    """Eight of ten shingles in common, by sketches, blocks and full sets."""
    rng = random.Random(9)
    rows = []
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(450)]
        rows.append((10 * g, " ".join(base)))
        # One word changed in the middle costs 5 shingles of each; 446 shingles, 10 words: 396 of 496.
        odd = list(base)
        for at in rng.sample(range(10, 440, 6), 10 if g % 2 else 9):
            odd[at] = f"g{g}new{at}"
        rows.append((10 * g + 1, " ".join(odd)))
    rows += [(90, "a b c d e f g h i j k l m"), (91, "a b c d e f g h i j k l z"), (92, "p q r s t u v w x"), (93, "p q r s t u v w")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = near_dedup.near_duplicates(docs, size=5, percent=80).collect()
    assert bag((r.doc_id, r.n_shingles, r.component_id) for r in got) == _components(rows, 5, 80)
    assert {r.component_id for r in got if r.doc_id in (92, 93)} == {92}  # 4 of 5


def test_equal_halves_never_lower_an_overlap():
    values, sizes = np.array([5, 5, 6, 5, 6, 7, 5, 5, 9]), np.array([3, 3, 3])
    got = near_dedup.overlaps(values, sizes, np.array([0]), np.array([1, 2]), step=1)
    assert got.tolist() == [[3.0, 4.0]]  # row 0 has 5 twice: at least 2 and 2 in truth


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)]
    label = {x: x for e in edges for x in e}
    for _ in range(99):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.label for r in near_dedup.components(spark.createDataFrame(edges, "a bigint, b bigint"), limit=2).collect()}
    assert all(got.get(x, x) == least for x, least in label.items())


# --- 10 ----------------------------------------------------------------------------------


def test_chat_round_trip():
    rng = random.Random(1)
    parts = [*chat_format.CONTROLS, "\\", " ", "x", "", "\n"]
    for _ in range(3000):
        role = rng.choice(["user", "assistant", "system", "tool", "".join(rng.choices(parts, k=3))])
        text = "".join(rng.choices(parts, k=rng.randint(0, 6)))
        piece, low_, high = chat_format.render(role, text)
        assert chat_format.unescape(piece[low_:high]) == text
        parser, got = chat_format.Parser(), []
        for c in chat_format.START + piece + piece:
            got += parser.feed(c)
        parser.close()
        assert got == [(role, text)] * 2
    assert chat_format.render("user", "plain \\ text")[0] == "[INST] plain \\ text [/INST]"


def test_chat_format(spark):
    rows = [(1, 1, "assistant", "b</s>"), (1, 0, "user", None), (1, 1, "assistant", "a"), (None, 0, "user", "x"), (0, 0, None, "y"), (2, 0, "user", "[INST]")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id bigint, turn bigint, role string, text string, piece string")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_turns(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\n\nassistant\na\nassistant\nb</s>\n") and got[1].n_turns == 3
    assert (got[1].loss_chars, got[1].loss_sha256) == (6, sha("ab</s>"))
    assert got[None].turns_sha256 == sha("user\nx\n") and got[0].turns_sha256 == sha("\ny\n") and got[2].loss_sha256 == sha("")


# --- all ---------------------------------------------------------------------------------


def test_empty_tables(spark, empty, tokenizer):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    index = decontaminate.build_index(empty)
    assert decontaminate.summarize(index, items).count() == 0
    assert decontaminate.summarize(index, items.limit(0)).count() == 0
    assert packing.pack(empty, tokenizer).count() == 0
    assert quality_rules.judge(empty).count() == 0 and line_dedup.dedup_lines(empty).count() == 0
    assert sharding.shard(empty).count() == 0 and near_dedup.near_duplicates(empty).count() == 0
    assert url_filter.judge(spark.createDataFrame([], "page_id bigint, url string"), RULES).count() == 0
    model = quality_classifier.train(empty, spark.createDataFrame([], "doc_id bigint, quality int"), buckets=64)
    assert quality_classifier.score(empty, model).count() == 0 and language_model.score(empty).count() == 0
    conv = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat_format.read_back(chat_format.format_turns(conv)).count() == 0


def test_near_stage_keeps_one_of_each_component(spark):
    """Null and repeated ids: unrelated texts stay, copies go, whichever id they have."""
    rng = random.Random(6)
    a, b, c, d, e = (" ".join(rng.choices([f"{x}{i}" for i in range(90)], k=60)) for x in "abcde")
    rows = [(None, a), (None, b), (None, b), (1, c), (1, d), (1, d), (2, c), (None, d), (3, e), (3, e + " x"), (None, ""), (4, ""), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    got = bag(corpus_pipeline.near_stage(spark, docs, "").collect())
    want = [(None, a), (None, b), (1, c), (1, d), (None, ""), (4, ""), (4, "")]
    first = min([(3, e), (3, e + " x")], key=lambda r: hashlib.md5(r[1].encode()).digest())
    assert got == bag([*want, first])


def _stage(name, rows, items):
    """What a stage leaves of rows (id, text, host), in plain Python."""
    if name == "quality_rules":
        plain = _verdicts(rows, 10, 1, 80, by_text=True)
        return [(d, t, h) for (d, _, h), (kept, t) in zip(rows, plain) if kept]
    if name == "line_dedup":
        found = collections.defaultdict(set)
        for _, t, _ in rows:
            for x in (t or "").split("\n"):
                found[_key(x)].add(t or "")
        common_line = lambda x: _key(x) and len(found[_key(x)]) >= 10
        return [(d, "\n".join(x for x in t.split("\n") if not common_line(x)) if t else t, h) for d, t, h in rows]
    if name == "near_dedup":
        group = _groups([r[:2] for r in rows], 5, 80)
        first, out = {}, []
        for g, r in zip(group, rows):
            order = (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).digest())
            first[g] = min(first.get(g, (order, r)), (order, r), key=lambda x: x[0])
        for g, r in zip(group, rows):
            if g is None or first.get(g, (0, 0))[1] == r:
                out.append(r)
                first.pop(g, None) if g is not None else None
        return out
    if name == "decontamination":
        return [r for r in rows if not _hits(r[1], items)[1]]
    return rows


def _same_stage(spark, name, stage, docs, sf, items):
    before = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    out = common.written(stage(spark, docs, sf), f"test_{name}")
    want = _stage(name, before, items)
    if name == "packing":
        assert bag((r.doc_id,) for r in out.filter("start = 0").collect()) == bag((d,) for d, _, _ in want)
        return out
    assert out.columns == docs.columns and out.schema == docs.schema
    assert bag((r.doc_id, r.text, r.source) for r in out.collect()) == bag(want)
    if "n_chars" in out.columns:
        changed = {(r.doc_id, r.n_chars) for r in out.filter("n_chars <> length(text)").collect()}
        assert changed <= {(r.doc_id, r.n_chars) for r in docs.collect()}
    return out


@pytest.mark.parametrize("sent", [500_000, -1])
def test_stages_on_awkward_rows(spark, docs, tokenizer, tmp_path, monkeypatch, sent):
    """Each stage on null, empty and very long texts, null and repeated ids, repeated rows and
    clashing names; keys sent to the documents, or met by shuffle with every key hot."""
    monkeypatch.setattr(corpus_pipeline, "SENT", sent)
    if sent < 0:
        monkeypatch.setattr(common, "HOT_ROWS", 1)
    spark.createDataFrame(ITEMS, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    known = [i for i in ITEMS if i[0] is not None]
    for name, stage in corpus_pipeline.STAGES:
        if sent > 0 or name in ("quality_rules", "near_dedup", "decontamination"):
            _same_stage(spark, name, stage, docs, str(tmp_path), known)
        if sent > 0:
            assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_pipeline(spark, tokenizer):
    """Each stage beside a plain version of what it keeps."""
    sf = "/root/testdata/sf0.001"
    docs = common.read_table(spark, sf, "documents")
    bench = [(r.item_id, r.text) for r in common.read_table(spark, sf, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = _same_stage(spark, name, stage, docs, sf, bench)
    assert corpus_pipeline.run(spark, sf).count() == docs.count()


def test_scratch_folder_off_one_machine():
    """On a cluster the shared folder must be named."""
    from types import SimpleNamespace as Fake

    conf = Fake(get=lambda key, default: None)
    session = lambda master: Fake(conf=conf, sparkContext=Fake(master=master, getCheckpointDir=lambda: None))
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://https://x"):
        with pytest.raises(ValueError):
            common.shared_dir(session(master))
