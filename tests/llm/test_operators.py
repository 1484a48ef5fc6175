"""Training-data operators against brute force, with nulls, empty texts, ties, repeats, empty tables and clashing columns."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import ann, exact_topk, line_dedup, packing, piece_codec, quality, sharding, shingle_join, transcripts, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, __key int, h string"


def docs_of(spark, texts, ids=None):
    rows = [(i, t, "en", "src", len(t or ""), 1, "x") for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, DOCS)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.5:
            words = rng.choice(texts).split(" ")
            for _ in range(rng.randint(0, max(1, len(words) // 12))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 8, 30, 80, 200]))]
        texts.append(" ".join(words))
    return texts


# 1 ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 2047, 2048, 2049, 5000])
def test_cut(n):
    parts = packing.cut(n)
    assert sum(p[1] for p in parts) == n and all(0 < p[1] <= 2048 for p in parts)
    assert all(p[1] == 2048 for p in parts[1:])


def test_plan_uses_every_piece_and_few_sequences():
    rng = np.random.default_rng(1)
    h = np.zeros(2049, dtype=np.int64)
    for x in rng.integers(1, 2049, 3000):
        h[x] += 1
    used = np.zeros_like(h)
    plan = packing.plan(h)
    for lengths, times in plan:
        assert sum(lengths) <= 2048 and times > 0
        for x in lengths:
            used[x] += times
    assert (used == h).all()
    assert sum(t for _, t in plan) <= 1.03 * -(-int((h * np.arange(2049)).sum()) // 2048)
    assert packing.plan(np.zeros(2049, dtype=np.int64)) == []


def test_nnls_is_optimal():
    rng = np.random.default_rng(2)
    a, b = rng.random((8, 5)), rng.random(8)
    x = packing.nnls(a, b)
    g = a.T @ (b - a @ x)
    assert (x >= 0).all() and (g < 1e-8).all() and np.abs(g[x > 1e-9]).max(initial=0) < 1e-8


def test_encoder_is_the_library():
    from tokenizers import Tokenizer

    model = packing.model_bytes()
    library, own = Tokenizer.from_str(model.decode()), packing.encoder(model)
    rng = random.Random(3)
    bits = ["a", " the", "\n\n", "  ", "é", "中", "😀", "<|endoftext|>", "123", "'s", "\t", "\u00a0", "\u0000", "ﬁ"]
    for t in ["", *("".join(rng.choices(bits, k=rng.randint(1, 20))) for _ in range(500))]:
        assert own(t).tolist() == library.encode(t, add_special_tokens=False).ids


def test_pack(spark):
    texts = [None, "", "a b", "a b", "word " * 5000, *corpus(4, 40)]
    out = packing.pack(docs_of(spark, texts, [None, 1, 2, 2, *range(3, 44)]), packing.model_bytes()).collect()
    encode = packing.encoder(packing.model_bytes())
    want = collections.Counter()
    for i, t in zip([None, 1, 2, 2, *range(3, 44)], texts, strict=True):
        ids = np.append(encode(t or ""), 0).astype("<u4")
        for k, (s, n) in enumerate(packing.cut(len(ids))):
            want[i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())] += 1
    assert collections.Counter(tuple(r[:5]) for r in out) == want
    by = collections.defaultdict(list)
    for r in out:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(docs_of(spark, []), packing.model_bytes()).count() == 0


# 2 ---------------------------------------------------------------------------------------------------------


def test_bloom_has_no_false_negatives_and_few_false_positives():
    keys = np.arange(5000, dtype=np.int64) * 0x9E3779B97F4A7C1
    bloom = url_filter.BlockedBloom.of(keys)
    assert bloom.might_hold(keys).all()
    assert bloom.might_hold(keys + 12345).mean() < 0.02


def judged(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]) if m else ("", "")
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_urls(spark):
    urls = [None, "", "no scheme", "http://EXAMPLE.com/en/x", "x://www.example.com/en/?q", "http://a.www.example.com/en/", "http://notexample.com/en/", "http://b.net/es/a#b", "http://net", "http://net/", "http://example.com/e", "http://É.com/", "a://b://c.com/en/", "http://" + "a." * 300 + "com/en/", "http://x.com/" + "p" * 5000, "http://example.com/en/x"]
    df = spark.createDataFrame([(i, u, "c", "d") for i, u in enumerate(urls)], "page_id long, url string, host string, __host string")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    out = url_filter.judge_urls(df, rules).select("page_id", "host", "path", "rule", "verdict").collect()
    assert {r[0]: tuple(r[1:]) for r in out} == {i: judged(u, url_filter.RULES) for i, u in enumerate(urls)} and len(out) == len(urls)
    assert url_filter.judge_urls(df.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filter.judge_urls(df, rules.limit(0)).collect()} == {"allow"}


# 3 ---------------------------------------------------------------------------------------------------------


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def component_of(sets):
    label = list(range(len(sets)))
    for a, b in itertools.combinations(range(len(sets)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = label[a], label[b]
            label = [min(x, y) if v in (x, y) else v for v in label]
    return label


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    texts = [None, "", " \t ", "One", "one", "a b c", "A B c", "a b c d e", *corpus(seed, 70), "x y " * 3000]
    sets = [shingle_set(t) for t in texts]
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in shingle_join.join_documents(docs_of(spark, texts)).collect()}
    assert out == {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, component_of(sets), strict=True))}


def test_similar_sets_share_as_many_signatures_as_counted():
    rng = np.random.default_rng(5)
    for _ in range(400):
        n = int(rng.choice([1, 2, 3, 4, 7, 12, 33, 64, 65, 200, 700]))
        a = rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64)
        d = int(rng.integers(0, n // 3 + 1))
        b = np.unique(np.concatenate([a[d // 2 :], rng.integers(0, 2**63, int(rng.integers(0, d + 1)), dtype=np.int64).astype(np.uint64)]))
        a = np.unique(a)
        both = len(np.intersect1d(a, b))
        if 100 * both < 75 * (len(a) + len(b) - both):
            continue
        x, y = dict(shingle_join.sign(a)), dict(shingle_join.sign(b))
        differ = shingle_join.most_differ(len(a), len(b))
        assert any(len(np.intersect1d(x[i], y[i])) >= max(1, len(x[i]) - differ if i >= 0 else 1) for i in set(x) & set(y))
        x, y = dict(shingle_join.choices(a)), dict(shingle_join.choices(b))
        common = set(x) & set(y)
        assert common
        for i in common:
            least = max(shingle_join.shared_at_least(len(s), i) for s in (a, b))
            assert len(x[i]) == len(y[i]) and least >= 1 and len(np.intersect1d(x[i], y[i])) >= least


@pytest.mark.parametrize("seed", [3, 4])
def test_all_links_between_classes(spark, seed):
    texts = ["", "one", "One", *corpus(seed, 60)]
    sets = [shingle_set(t) for t in texts]
    links, classes = shingle_join.similar_classes(docs_of(spark, texts))
    key = {r["doc"]: r["key"] for r in classes.collect()}
    assert set(key) == {i for i, s in enumerate(sets) if s}
    want = {tuple(sorted((key[i], key[j]))) for i, j in itertools.combinations(key, 2) if sets[i] != sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert {tuple(sorted((r["a"], r["b"]))) for r in links.collect()} == want


def test_rows_of_one_id_with_other_texts_link_their_groups(spark):
    t, u = (" ".join(f"{c}{i}" for i in range(30)) for c in "tu")
    out = shingle_join.join_documents(docs_of(spark, [t, u, u, t + " end", "lone words here", None], [9, 9, 4, 2, 7, 5])).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == [(2, 27, 2), (4, 26, 2), (5, 0, 5), (7, 1, 7), (9, 26, 2), (9, 26, 2)]


def test_components_with_null_and_repeated_ids(spark):
    t = " ".join(f"w{i}" for i in range(30))
    out = shingle_join.join_documents(docs_of(spark, [t, t, t, "other words only here now"], [None, 5, 5, 7])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in out if r["doc_id"]) == [(5, 5), (5, 5), (7, 7)]
    assert [r["component_id"] for r in out if r["doc_id"] is None] == [None]
    assert shingle_join.join_documents(docs_of(spark, [])).count() == 0


# 4 ---------------------------------------------------------------------------------------------------------


def dedup(rows):
    """Brute force over (id, text), in order of id."""
    seen, out = [], {}
    for i, t in sorted(rows):
        kept = []
        for line in (t or "").split("\n"):
            s = frozenset(re.findall(r"[^\x20\x09-\x0D]+", line.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))))
            if not s or not any(100 * len(s & o) >= 75 * len(s | o) for o in seen):
                kept.append(line)
            if s:
                seen.append(s)
        out[i] = None if t is None else "\n".join(kept)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_lines(spark, seed):
    rng = random.Random(seed)
    lines = [*corpus(seed, 120), "", " ", "É a b c", "é a b c", "The END", "the end", "a\tb  a"]
    texts = ["\n".join(rng.choices(lines, k=rng.randint(1, 6))) for _ in range(60)] + [None, "", "\n\n"]
    out = line_dedup.dedup_lines(docs_of(spark, texts))
    assert out.columns == docs_of(spark, []).columns
    got = {r["doc_id"]: r for r in out.collect()}
    assert {i: r["text"] for i, r in got.items()} == dedup(list(enumerate(texts)))
    assert all(r["n_chars"] == len(r["text"]) for r in got.values() if r["text"] is not None)


def test_lines_of_near_copies(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(40)]
    texts = []
    for _ in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(40)] = f"r{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs_of(spark, texts)).collect()}
    assert got == dedup(list(enumerate(texts)))


def test_lines_with_odd_ids(spark):
    out = line_dedup.dedup_lines(docs_of(spark, ["a b c\nd", "a b c", "a b c", "d"], [None, -4, -4, 2**50])).collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -99, r["text"]) for r in out) == [(-99, "a b c\nd"), (-4, ""), (-4, ""), (2**50, "")]
    assert line_dedup.dedup_lines(docs_of(spark, [])).count() == 0


def test_very_long_lines(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(70_000)]  # more words than the short form tells apart
    near, far = list(base), list(base)
    for i in rng.sample(range(len(base)), 9_000):
        near[i] = f"n{i}"
    for i in rng.sample(range(len(base)), 20_000):
        far[i] = f"f{i}"
    texts = [" ".join(base), " ".join(near) + "\nshort line", " ".join(far), "short line\n" * 3000]
    for bound in (line_dedup.MAX_BROADCAST_PAIRS, 0):  # pairs broadcast and shuffled
        monkeypatch.setattr(line_dedup, "MAX_BROADCAST_PAIRS", bound)
        got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs_of(spark, texts)).collect()}
        assert got == {0: texts[0], 1: "short line", 2: texts[2], 3: ""}


# 5 and 10 --------------------------------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame(rows, "id long, v array<double>, score int, rank int")


def test_top_k(spark):
    rng = np.random.default_rng(1)
    m = rng.integers(-200, 200, (700, 8))
    m[10:20] = m[0]
    rows = [(i, [float(x) for x in r], 1, 2) for i, r in enumerate(m)] + [(None, [1.0] * 8, 1, 2), (900, [1.0] * 3, 1, 2), (901, [2.0] * 3, 1, 2), (902, [float(2**40)] * 4, 1, 2), (903, [float(-(2**40))] * 4, 1, 2), (904, [], 1, 2)]
    items = vectors(spark, rows).select("id", F.col("v").cast("array<bigint>").alias("v"))
    out = collections.defaultdict(list)
    for r in exact_topk.exact_top_k(items, items.where("id % 50 = 0 or id > 899"), 5).collect():
        out[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    s = m @ m.T
    for q in range(0, 700, 50):
        want = sorted((-int(s[q, i]), i) for i in range(700) if i != q)[:5]
        assert sorted(out[q]) == [(k + 1, i, -x) for k, (x, i) in enumerate(want)]
    assert out[900] == [(1, 901, 6)] and out[904] == []
    assert exact_topk.exact_top_k(items.limit(0), items.limit(0), 5).count() == 0


def test_unsound_vectors_take_no_part(spark):
    from glyphmill.llm.vectors import sound

    df = spark.createDataFrame([([1.0, None],), (None,), ([float("nan")],), ([float("inf")],), ([1.0],)], "v array<float>")
    assert [r[0] for r in df.select(sound(F.col("v"))).collect()] == [False, False, False, False, True]


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(3000, 32))
    m[100:130] = m[5]
    items = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "id long, v array<double>")
    out = collections.defaultdict(list)
    for r in ann.nearest(items, items.where("id % 100 = 0"), 10).collect():
        out[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hit = 0
    for q in range(0, 3000, 100):
        d = np.sqrt(((m - m[q]) ** 2).sum(axis=1))
        want = sorted((d[i], i) for i in range(3000) if i != q)[:10]
        hit += len({i for _, i in want} & {v for _, v, _ in out[q]})
        assert [s for _, _, s in sorted(out[q])] == sorted(s for _, _, s in out[q])
        assert all(s == d[v] for _, v, s in out[q])
    assert hit >= 0.9 * 300
    assert ann.nearest(items.limit(0), items.limit(0), 10).count() == 0


# 6 ---------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return packing.model_bytes("piece_bpe_32k.model")


def test_codec_is_the_library(model):
    c = piece_codec.coder(model)
    rng = random.Random(4)
    bits = [" ", "  ", "   ", "\n", "\t", "a", "the", "ing", "é", "ﬁ", "中", "😀", "▁", "<s>", "<0x41>", "don't", "123", "\x00", "ß", "aaaa", "====", " " * 20]
    texts = ["", " ", "a" * 5000, "ab" * 3000, " " * 700, *("".join(rng.choices(bits, k=rng.randint(1, 14))) for _ in range(3000))]
    assert [c.encode(t) for t in texts] == c.library.encode(texts, add_eos=True)


def test_recode(spark, model):
    texts = [None, "", "Hello  world\n", "x " * 20000, "same", "same"]
    out = piece_codec.recode(docs_of(spark, texts), model).orderBy("doc_id").collect()
    sp = piece_codec.coder(model).library
    for t, r in zip(texts, out, strict=True):
        ids = sp.encode(t or "", add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())
    back = piece_codec.decode(piece_codec.encode(docs_of(spark, texts), model), model, to="back").orderBy("doc_id").collect()
    assert [r["back"] for r in back] == [t or "" for t in texts]


# 7 ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("tolerance", [0.0, 0.01])
def test_shards(spark, tolerance):
    rng = random.Random(6)
    texts = ["x" * rng.randint(0, 60) + str(i) for i in range(800)] + ["same"] * 400 + [None, "", ""]
    out = sharding.shard_by_bytes(docs_of(spark, texts), shards=8, tolerance=tolerance).collect()
    assert len(out) == len(texts) and sorted(r["doc_id"] for r in out) == list(range(len(texts)))
    by = collections.defaultdict(list)
    for r in out:
        assert r["size"] == len((r["text"] or "").encode()) + 16
        by[r["shard"]].append(r)
    total, largest = sum(r["size"] for r in out), max(r["size"] for r in out)
    assert sorted(by) == list(range(8))
    for rows in by.values():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
        assert abs(sum(r["size"] for r in rows) - total / 8) <= 2 * (largest + tolerance * total / 8)


def test_shards_of_few_rows_and_many_ranges(spark):
    assert sharding.shard_by_bytes(docs_of(spark, [])).count() == 0
    assert sharding.shard_by_bytes(docs_of(spark, ["a", "b"])).count() == 2
    out = sharding.shard_by_bytes(docs_of(spark, [str(i) for i in range(500)]), shards=4, task_bytes=300).collect()
    for s in range(4):
        own = sorted(r["slot"] for r in out if r["shard"] == s)
        assert own == list(range(len(own))) and 110 <= len(own) <= 140


# 8 ---------------------------------------------------------------------------------------------------------


def junk_corpus(n=600, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(n):
        kind = rng.random()
        w = [rng.choice(words) for _ in range(rng.randint(10, 60))]
        if kind < 0.2:
            text, q, t = " ".join(x.upper() + "!!" for x in w), 0, 0
        elif kind < 0.3:
            text, q, t = " ".join([*w[:5], "idiot", *w[5:]]), 1, 1
        else:
            text, q, t = " ".join(w) + ".", 1, 0
        rows.append((i, text, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", None]), len(text), 1, "x"))
        labels.append((i, q, t))
    return rows, labels


def test_quality_on_held_out_rows(spark):
    rows, labels = junk_corpus()
    docs = spark.createDataFrame(rows, DOCS)
    model = quality.fit(docs, spark.createDataFrame(labels[:300], "doc_id long, quality int, toxic int"))
    out = {r["doc_id"]: r["keep"] for r in quality.classify(docs, model).collect()}
    held = [(out[i], q == 1 and t == 0) for i, q, t in labels[300:]]
    assert len(out) == len(rows)
    assert sum(k == g for k, g in held) >= 0.97 * len(held)
    assert sum(k for k, g in held if g) >= 0.98 * sum(g for _, g in held)


def test_toxic_families_of_rare_words_are_found_in_every_language(spark):
    rng = random.Random(5)
    syllables = {"en": ["the", "ing", "er", "an"], "fr": ["eux", "oi", "en", "que"], "de": ["ung", "ei", "ch", "er"]}
    families = {"en": "troll", "fr": "vequ", "de": "lowei"}
    rows, labels = [], []
    for i in range(900):
        lang = rng.choice(list(syllables))
        word = lambda k, lang=lang: "".join(rng.choice(syllables[lang]) for _ in range(k))
        words, toxic = [word(rng.randint(1, 4)) for _ in range(rng.randint(30, 60))], i % 8 == 0
        if toxic:  # words that few other documents hold
            words[5:7] = [families[lang] + word(rng.randint(1, 3)) for _ in range(2)]
        rows.append((i, " ".join(words), lang, "src", 1, 1, "x"))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, DOCS)
    schema = "doc_id long, quality int, toxic int"
    out = quality.classify(docs, quality.fit(docs, spark.createDataFrame(labels[:600], schema)))
    found = quality.toxic_recall(out, spark.createDataFrame(labels[600:], schema)).collect()
    assert {r["lang"] for r in found} == set(families)
    assert all(r["rejected"] >= 0.9 * r["toxic"] for r in found)


def test_site_posteriors_by_hand(spark):
    rows, labels = junk_corpus(120)
    docs = spark.createDataFrame(rows, DOCS)
    model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    out = quality.classify(docs, model).collect()
    mean = sum(r["p_document"] for r in out) / len(out)
    for r in out:  # between what the site's other documents say and the level above
        own = [x["p_document"] for x in out if x["source"] == r["source"] and x["doc_id"] != r["doc_id"]]
        lo, hi = sorted([mean, sum(own) / len(own)])
        assert lo - 1e-6 <= r["p_host"] <= hi + 1e-6


def test_quality_is_fitted_in_a_task(spark, monkeypatch):
    """The driver gets the weights; the texts and what the fit makes of them stay in the task."""
    docs = spark.createDataFrame([(i, f"good words {i}" if i % 2 else f"bad junk {i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    want = quality.Model.fit([f"good words {i}" if i % 2 else f"bad junk {i}" for i in range(60)], np.arange(60) % 2, np.zeros(60))
    monkeypatch.setattr(quality.Model, "fit", None)
    got = quality.fit(docs, labels)
    assert len(got.parts) == len(want.parts) == 1 and np.allclose(got.parts[0][0], want.parts[0][0], atol=1e-4)


def test_quality_without_labels_keeps_all(spark):
    docs = docs_of(spark, [None, "", "a b", "a b"], [None, 1, 2, 2])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["keep"] for r in quality.classify(docs, quality.fit(docs, none)).collect()] == [True] * 4
    assert quality.classify(docs.limit(0), quality.fit(docs, none)).count() == 0


# 9 ---------------------------------------------------------------------------------------------------------


def test_viterbi_is_the_best_of_all_paths():
    rng = np.random.default_rng(3)
    hmm = transcripts.Hmm(rng.random((4, 4)), rng.random((4, transcripts.SHAPES)), rng.random(4))
    rows = [([int(rng.integers(0, 5)) for _ in range(k)], [int(rng.integers(0, transcripts.SHAPES)) for _ in range(k)]) for k in (2, 1, 3)]
    steps = hmm.steps(rows, True)
    score = lambda path: sum(s[a, b] for s, a, b in zip(steps, (0, *path), path, strict=False))
    best = max(itertools.product(range(4), repeat=6), key=score)
    assert score(transcripts.best_path(steps, 0)) == pytest.approx(score(best))
    whole = [transcripts.best_matrix(steps[:2]), transcripts.best_matrix(steps[2:])]
    a, b = transcripts.seams(whole)
    joined = transcripts.best_path(steps[:2], 0, a) + transcripts.best_path(steps[2:], a, b)
    assert score(joined) == pytest.approx(score(best))


def chats(spark):
    rows = []
    for c in range(40):
        for t in range(150 if c == 0 else 6):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", "Could you help me with this?" if t % 2 == 0 else "Here is a much longer answer that goes on, and on, and on for a while.\n- one\n- two", "z"))
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, rendered string")


def test_roles_are_recovered(spark):
    df = chats(spark).withColumn("true", F.col("role")).withColumn("role", F.when(F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3)) == 0, F.lit("???")).otherwise(F.col("role")))
    out = transcripts.parse(df).orderBy("conv_id", "turn").collect()
    assert len(out) == df.count()
    assert all(set(r["roles"]) == {r["true"]} for r in out)
    assert all(r["opens"] == 1 for r in out)
    assert out[0]["rendered"] == "<|user|>\nCould you help me with this?\n"


def test_markers_in_text_and_odd_rows(spark):
    model = transcripts.fit(chats(spark), "conv_id", "turn", "text", "role")
    rows = [(1, 0, None, "Human: hi there?\nAssistant: hello"), (None, None, None, None), (2, 1, "user", ""), (2, 1, "user", "")]
    out = transcripts.parse(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), model).collect()
    got = {r["conv_id"]: r for r in out}
    assert got[1]["roles"] == ["user", "assistant"] and got[1]["opens"] == 2
    assert got[1]["rendered"] == "<|user|>\nhi there?\n<|end|>\n<|assistant|>\nhello\n"
    assert len(out) == 4 and len(got[None]["roles"]) == 1
    assert transcripts.parse(chats(spark).limit(0), model).count() == 0


def test_clashing_names_in_classifier_and_transcripts(spark):
    docs = docs_of(spark, ["good words here", None, "other words"]).withColumns({c: F.lit(7) for c in ("hh", "pp", "hn", "hs", "pn", "ps", "__odds", "host", "path", "n", "s")})
    out = quality.classify(docs, quality.Model.fit([], np.zeros(0), np.zeros(0)))
    assert out.count() == 3 and out.select("hs", "pn", "__odds").distinct().collect() == [(7, 7, 7)]
    rows = spark.createDataFrame([(1, 0, "user", "User: hi\nAssistant: hello"), (1, 1, "assistant", "fine"), (None, None, None, None)], "conv_id long, turn long, role string, text string")
    odd = ["__c", "__g", "__t", "__s", "__b", "__e", "__q", "ec", "eg", "es", "i"]
    plain = {(r["conv_id"], r["turn"]): tuple(r["roles"]) for r in transcripts.parse(rows).collect()}
    out = transcripts.parse(rows.withColumns({c: F.lit(7) for c in odd}))
    got = out.collect()
    assert {(r["conv_id"], r["turn"]): tuple(r["roles"]) for r in got} == plain and all(r[c] == 7 for r in got for c in odd)
