"""Operators against brute force, libraries, round trips and held-out labels."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from caudal.llm import ann, bpe, components, exact_dedup, hmm, language, minhash, packing, pii, quality, token_counts
from caudal.llm.common import fold, lower_ascii, read_documents

SF = "/root/testdata/sf0.001"
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PIECES = ["a", "the", " ", "  ", "\n", "\t", " \n", "'re", "'ll", "'S", "'", "é", "ß", "漢", "\U0001f600", "12", "!", "%%%",
          "<|endoftext|>", "<|startoftext|>", "<|endo", " ", "\x1c", "The", "ing", "\r\n", "_", "A", "́", "don't", "Σ", "I'v"]


def strings(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12))) for _ in range(n)]


# --- tokens

def test_prefix_counts_are_those_of_the_library():
    library, own = Tokenizer.from_file(BYTES), token_counts.PrefixCounter(BYTES)
    for text in strings(1, 300):
        expected = [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
        assert own.prefix_counts(text).tolist() == expected
    long = "ab" * 20_000
    assert own.prefix_counts(long)[-1] == len(library.encode(long, add_special_tokens=False).ids)


def test_tokens_that_may_not_meet():
    own = token_counts.PrefixCounter(BYTES)
    rng = random.Random(2)
    tokens = sorted(own.vocabulary)
    pairs = [(a, b) for _, a, b in rng.sample(sorted(own.halves.values()), 300)]
    pairs += [(t[:i], t[i:]) for t in rng.sample(tokens, 300) for i in range(1, len(t)) if t[:i] in own.vocabulary and t[i:] in own.vocabulary]
    pairs += [(rng.choice(tokens), rng.choice(tokens)) for _ in range(2000)]
    assert own.ordered and all(own._apart(a, b) == (own._encode(a + b) == [a, b]) for a, b in pairs)


def test_longest_prefix():
    own = token_counts.PrefixCounter(BYTES)
    counts = own.prefix_counts("the theory of the thing " * 50)
    cut = token_counts.longest_prefix(counts, 10)
    assert counts[cut] <= 10 and all(counts[cut + 1 :] > 10)


def test_word_bpe_is_the_library():
    library, own = Tokenizer.from_file(WORDS), bpe.WordBpe(WORDS)
    for text in [*strings(3, 400), "abcde" * 400, "!" * 999, "thetion" * 300]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids and own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_counts_and_digests_of_whole_texts(spark):
    docs = read_documents(spark, SF)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    byte_lib, word_lib = Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)
    for r in token_counts.token_counts(docs, BYTES).collect():
        n = len(byte_lib.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_tokens"], r["over_limit"], r["n_bytes"]) == (n, n > 512, len(texts[r["doc_id"]].encode()))
    for r in bpe.digests(docs, WORDS).collect():
        ids = word_lib.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_packing_is_tight_and_gapless(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ITEMS", 30)  # several rounds
    docs = read_documents(spark, SF)
    found = packing.pack_documents(docs, BYTES).toPandas()
    library = Tokenizer.from_file(BYTES)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for doc, pieces in found.sort_values("piece").groupby("doc_id"):
        ids = np.array([*library.encode(texts[doc], add_special_tokens=False).ids, 2], "<u4")
        assert pieces["length"].sum() == len(ids) and (pieces["length"].iloc[1:] == 1024).all()
        for p in pieces.itertuples():
            assert zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32
    sizes = found.groupby("sequence_id")["length"].sum()
    assert sizes.max() <= 1024 and len(sizes) <= found["length"].sum() / 1024 * 1.05 + 1


def test_fast_encoding_is_the_library():
    library, fast = Tokenizer.from_file(BYTES), packing.fast_encoding(BYTES)
    for text in strings(5, 500):
        assert fast.encode(text, allowed_special="all") == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("run", [" ", "\n", " \t"])
def test_packing_takes_two_million_blanks(spark, docs, run):
    text = "The end" + run * (2_000_000 // len(run)) + "of it"
    ids = np.array([*Tokenizer.from_file(BYTES).encode(text, add_special_tokens=False).ids, 2], "<u4")
    found = packing.pack_documents(docs([text, "a"]), BYTES).filter("doc_id = 0").toPandas()
    assert found["length"].sum() == len(ids)
    for p in found.itertuples():
        assert zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32


@pytest.mark.parametrize("least, most", [(513, 1000), (300, 700), (1, 400)])
def test_no_group_of_bins_grows_with_the_table(spark, monkeypatch, least, most):
    monkeypatch.setattr(packing, "GROUP_ITEMS", 50)
    largest, real = [], packing.checkpointed

    def seen(df):
        out = real(df)
        largest.append(out.groupBy("_group").count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(packing, "checkpointed", seen)
    rng = random.Random(least)
    sizes = [rng.randint(least, most) for _ in range(3000)]
    items = spark.createDataFrame(list(enumerate(sizes)), "_row long, size int")
    found = packing.place(items, 1024).toPandas()
    assert sorted(found["_row"]) == list(range(3000)) and max(largest) <= 150
    found["size"] = [sizes[i] for i in found["_row"]]
    found = found.sort_values(["_sequence", "_offset"])
    own = found.groupby("_sequence")["size"]
    assert (own.cumsum() - found["size"] == found["_offset"]).all() and own.sum().max() <= 1024
    whole = len(packing.best_fit(np.array(sizes), 1024)[2])
    assert own.ngroups <= whole * 1.1 + 1


def test_joining_by_sizes_is_best_fit():
    rng = random.Random(12)
    for capacity in (10, 50, 1024) * 60:
        most = rng.choice([capacity, capacity // 2 + 1, max(2, capacity // 8)])
        sizes = np.array([rng.randint(rng.choice([1, most // 2]), most) for _ in range(rng.randint(1, 300))])
        counts, bins, taken = collections.Counter(sizes.tolist()), collections.defaultdict(list), collections.Counter()
        for size, start, end, each, first, offset in packing.joined(counts, capacity):
            taken[size] += end - start
            for k in range(end - start):
                bins[first + k // each].append((offset + k % each * size, size))
        assert taken == counts and len(bins) == len(packing.best_fit(sizes, capacity)[2])
        for own in bins.values():
            ends = [0, *(at + size for at, size in sorted(own))]
            assert [at for at, _ in sorted(own)] == ends[:-1] and ends[-1] <= capacity


# --- duplicates

def test_lower_ascii(spark):
    texts = ["ABC", "ÉABCİ", "", "ΣX"]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select(lower_ascii(F.col("t"))).collect()
    assert [r[0] for r in found] == [t.encode().lower().decode() for t in texts]


def test_exact_duplicates_with_a_third_in_one_group(spark):
    rng = random.Random(6)
    texts = ["Hot Text" if rng.random() < 0.35 else rng.choice(["a", "A", "é", "É", f"t{i}"]) for i in range(4000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    groups = collections.defaultdict(list)
    for i, t in enumerate(texts):
        groups[t.encode().lower()].append(i)
    assert {r[0] for r in exact_dedup.group_copies(docs).hot.select("_n").collect()} >= {len(groups[b"hot text"])}
    for r in exact_dedup.exact_duplicates(docs).collect():
        key = texts[r["doc_id"]].encode().lower()
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(groups[key]), len(groups[key]), r["doc_id"] == max(groups[key]))
        assert r["text_sha256"] == hashlib.sha256(key).hexdigest()
    kept = sorted(r[0] for r in exact_dedup.drop_exact_duplicates(docs).select("doc_id").collect())
    assert kept == sorted(max(g) for g in groups.values())


def brute_components(texts, size, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    parent = list(range(len(texts)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(texts)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return [root(a) for a in range(len(texts))], [len(s) for s in sets]


def edited(rng, words, share):
    return [rng.choice("abcdefgh") + str(rng.randrange(1000)) if rng.random() < share else w for w in words]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(3000)}" for _ in range(rng.randint(3, 90))] for _ in range(25)]
    texts = [" ".join(edited(rng, rng.choice(base), rng.choice([0, 0.01, 0.03, 0.06]))) for _ in range(250)]
    texts += ["", "one", "ONE", "two words", "a b c", None, texts[0].upper(), "a b c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    roots, sizes = brute_components(texts, 4, 80)
    for r in minhash.near_duplicates(docs, 4, 80).collect():
        i = r["doc_id"]
        assert (r["component_id"], r["n_shingles"], r["kept"]) == (roots[i], sizes[i], roots[i] == i)


def test_a_large_bucket_is_searched_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(9)
    base = [f"w{rng.randrange(3000)}" for _ in range(60)]
    texts = [" ".join(edited(rng, base, 0.03)) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["component_id"] for r in minhash.near_duplicates(docs, 5, 80).orderBy("doc_id").collect()] == brute_components(texts, 5, 80)[0]


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, j) for j in range(1, 50)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    parent = {n: n for e in edges for n in e}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    found = {r["_node"]: r["_root"] for r in components.connected_components(spark.createDataFrame(edges, "_a long, _b long")).collect()}
    assert found == {n: root(n) for n in parent if root(n) != n}


# --- personal data, language, quality, language model

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
ADDRESS = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def plain_patterns(text):
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in ADDRESS.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for kind, pattern, least, most in ((2, pii.CARD, 13, 19), (3, pii.PHONE, 9, 15)):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            if least <= len(digits) <= most and (kind == 3 or pii.luhn(digits)):
                out.append((kind, *m.span()))
    return out


def test_patterns_equal_plain_regular_expressions():
    rng = random.Random(7)
    parts = ["a", "@", "a.b", "@x.com", ".", "1", "12.3", "255", "256", " ", "-", "+", "+1 ", "(017)", "555-7713", "4111111111111111", "\n", "é", "٣", "%"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert pii.pattern_spans(text) == plain_patterns(text)


def test_viterbi_equals_all_paths():
    import itertools
    rng = np.random.default_rng(3)
    field = pii.Field()
    field.pairs = rng.normal(size=field.pairs.shape)
    scores = rng.normal(size=(4, 3, len(pii.LABELS)))
    for run, path in zip(scores, field.viterbi(scores)):
        def value(p):
            steps = zip((0, *p), (*p, 0))
            return sum(run[t, k] for t, k in enumerate(p)) + sum(field.pairs[a, b] for a, b in steps)
        assert tuple(path) == max(itertools.product(range(len(pii.LABELS)), repeat=3), key=value)


def test_field_learns_what_patterns_miss_and_keeps_their_spans():
    windows = [(["call", "+1", "(017)", "555-7713", "now"], [4, 4, 4])] * 20 + [(["in", "1999", "we"], [0])] * 20
    field = pii.Field().train(windows)
    text = "call +1 (017) 555-771 now, in 1999 we; ip 1.2.3.4"
    base, spans = pii.all_spans([text], field)[0]
    assert set(base) <= set(spans) and pii.redacted("a x@y.z b", [(0, 2, 7)]) == "a [EMAIL] b"


def test_language_on_held_out_documents(spark):
    docs = read_documents(spark, "/root/testdata/sf0.01")
    model = language.fit(docs.filter(fold(F.col("doc_id"), 5) != 0))
    found = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    row = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.min("score"), F.max("score")).first()
    assert row[0] > 0.97 and 0 <= row[1] and row[2] <= 1


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = read_documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    evidence = quality.fit(docs, labels.filter(~held), quality.acceptable())
    found = quality.assess(docs, evidence, F.col("source"), F.col("lang")).join(labels.filter(held), "doc_id")
    kept = {(r["quality"], r["toxic"]): r["k"] for r in found.groupBy("quality", "toxic").agg(F.avg(F.col("kept").cast("double")).alias("k")).collect()}
    assert kept[1, 0] > 0.95 and kept[0, 0] < 0.2
    same = quality.keep(docs, evidence, F.col("source"), F.col("lang")).count()
    assert same == quality.assess(docs, evidence, F.col("source"), F.col("lang")).filter("kept").count()


@pytest.mark.parametrize("part", [0, 1])
def test_toxic_documents_of_every_language_are_rejected(spark, part):
    sf = "/root/testdata/sf0.1"
    docs, labels = read_documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == part
    evidence = quality.fit(docs, labels.filter(~held), quality.acceptable())
    rows = docs.join(F.broadcast(labels.filter(held)), "doc_id")
    found = rows.join(quality.assess(rows, evidence, F.col("source"), F.col("lang")), "doc_id").filter("quality = 1")
    rates = {(r["lang"], r["toxic"]): r["k"] for r in found.groupBy("lang", "toxic").agg(F.avg(F.col("kept").cast("double")).alias("k")).collect()}
    assert len(rates) == 8
    for (_, toxic), kept in rates.items():
        assert kept <= 0.2 if toxic else kept > 0.97


def test_sparse_sites_stay_near_the_rates_above_them(spark):
    rows = [("big", "a", 3.0)] * 300 + [("big", "b", -3.0)] * 300 + [("other", "a", 2.0)] * 300 + [("tiny", "z", -3.0)]
    rate, sites = quality.site_rates(spark.createDataFrame(rows, "_host string, _path string, _logit double"))
    by = {(r["_host"], r["_path"]): r["_rate"] for r in sites.collect()}
    assert by["big", "a"] > 0.9 and by["big", "b"] < 0.1 and 0.1 < by["tiny", "z"] < rate


@pytest.mark.parametrize("known, frequent", [(1_000_000, 20_000), (300, 50)])
def test_base_scores_and_model_scores(spark, monkeypatch, known, frequent):
    monkeypatch.setattr(hmm, "KNOWN", known)
    monkeypatch.setattr(hmm, "FREQUENT", frequent)
    docs = read_documents(spark, SF)
    rows = {r["doc_id"]: r for r in hmm.score(docs, fold(F.col("doc_id"), 7) != 2).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    counts = collections.Counter(t for i, x in texts.items() if not held[i] for t in hmm.tokens(x.encode()))
    total, types = sum(counts.values()), len(counts)
    for i, x in texts.items():
        words = hmm.tokens(x.encode())
        base = sum(np.log10((counts[w] + 1) / (total + types + 1)) for w in words)
        assert rows[i]["base_score"] == pytest.approx(base) and rows[i]["train_tokens"] == total
        assert (rows[i]["n_tokens"], rows[i]["n_known"]) == (len(words), sum(counts[w] > 0 for w in words))
    unseen = [i for i in texts if held[i]]
    assert sum(rows[i]["score"] for i in unseen) > sum(rows[i]["base_score"] for i in unseen)


def test_forward_and_expected_counts_equal_all_paths():
    import itertools
    rng = np.random.default_rng(1)
    s, n = hmm.STATES, 5
    chain = hmm.Chain(rng.dirichlet(np.ones(s)), rng.dirichlet(np.ones(s), s), rng.dirichlet(np.ones(n), s).T)
    texts = [np.array(t, np.uint16) for t in ([1, 0, 4], [2, 3], [4])]
    emit, step, start = np.zeros((n, s)), np.zeros((s, s)), np.zeros(s)
    chain.expected(texts, emit, step, start)
    likelihood, want = [], np.zeros((n, s))
    for t in texts:
        total, part = 0.0, np.zeros((n, s))
        for path in itertools.product(range(s), repeat=len(t)):
            p = chain.start[path[0]] * chain.emit[t[0], path[0]]
            for k in range(1, len(t)):
                p *= chain.step[path[k - 1], path[k]] * chain.emit[t[k], path[k]]
            total += p
            for k, state in enumerate(path):
                part[t[k], state] += p
        likelihood.append(np.log10(total))
        want += part / total
    assert chain.forward(texts, False)[0] == pytest.approx(likelihood)
    assert emit == pytest.approx(want, abs=1e-5) and start.sum() == pytest.approx(3) and step.sum() == pytest.approx(3, abs=1e-5)


# --- vectors

def test_recall_against_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = table.orderBy("vec_id").collect()
    vectors, ids = np.array([r["embedding"] for r in rows], np.float64), np.array([r["vec_id"] for r in rows])
    found = ann.nearest(table, F.col("_id") % 20 == 0).toPandas()
    hits = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        score = vectors @ vectors[i]
        best = [j for j in np.lexsort((ids, -score)) if j != i][:20]
        own = found[found["query_id"] == ids[i]].sort_values("rank")
        assert list(own["rank"]) == list(range(1, 21)) and (own["score"].diff().dropna() <= 0).all()
        hits, total = hits + len({*ids[best]} & {*own["vec_id"]}), total + 20
    assert hits / total >= 0.9


@pytest.mark.parametrize("radius", [3, 9, 40, 256])
def test_probing_finds_all_codes_within_the_radius(radius):
    rng = np.random.default_rng(radius)
    codes = rng.integers(0, 1 << 16, (500, 16), np.uint16)
    codes[100:200] = codes[0]
    codes[100:200, 3] ^= rng.integers(0, 1 << 6, 100).astype(np.uint16)
    index = ann.MultiIndex(codes)
    expected = np.flatnonzero(ann.distances(codes, codes[0]) <= radius)
    assert np.sort(index.within(codes[0], radius)).tolist() == expected.tolist()


def test_many_copies_of_one_vector(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 else [float(x) for x in rng.normal(size=3)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = ann.nearest(df, F.col("_id") % 20 == 0).filter("query_id = 20").orderBy("rank").collect()
    assert [r["vec_id"] for r in found if r["score"] == pytest.approx(14.0)][:5] == [1, 2, 4, 5, 7]
