"""The corpus operators against brute force, round trips and edge cases."""

import collections
import hashlib
import itertools
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from spotfield.llm import ann, compression, fingerprint, jaccard, lm, mixing, packing, queries, tokencount, urls
from spotfield.operators import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, piece string, score string"
WORDS = "the of and to in is that it for on with as was be by this are or from at an not have which one you all were".split()


def make(spark, rows):
    """Documents with extra columns whose names clash with those of results."""
    return spark.createDataFrame([(i, t, lang, source, len(t or ""), "x", "y", "z") for i, t, lang, source in rows], DOCS)


def corpus(n=60, seed=3):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        text = " ".join(rng.choice(WORDS, int(rng.integers(1, 120))).tolist()).replace(" at ", ".\n")
        if i % 5 == 4:  # a near copy
            words = out[-1][1].split(" ")
            words[len(words) // 2] = "changed"
            text = " ".join(words)
        out.append((i, text, ("en", "de")[i % 2], f"s{i % 4}"))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    rows += [(100, None, None, None), (101, "", "en", None), (102, " \n\t ", "en", "s1"), (103, "one two", "de", "s1"), (104, "One\ttwo", "de", "s2"), (105, "word " * 30000, "en", "s0"), (106, rows[0][1], "en", "s0"), (106, rows[0][1], "en", "s0")]
    return make(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_fingerprints(spark, docs, empty):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()))
    got = collections.defaultdict(list)
    for r in fingerprint.with_next_document(docs).collect():
        got[r["doc_id"]].append(r)
    for k, (i, text) in enumerate(rows):
        cut, following = len(text) - len(text) // 4, rows[(k + 1) % len(rows)][1]
        edited = text[:cut] + following[: len(text) // 4]
        if len(got[i]) == 1:
            r = got[i][0]
            assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            assert r["fingerprint"] == str(fingerprint.of_text(text)) and r["edited_fingerprint"] == str(fingerprint.of_text(edited))
            assert r["n_chars"] == len(text) and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert fingerprint.with_next_document(empty).count() == 0
    a, b = fingerprint.of_text("x y\nz"), fingerprint.of_text("z\nx y")
    assert a == b and a - fingerprint.of_text("z") + fingerprint.of_text("z") == a


def shingle_sets(rows, n=5):
    out = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        out[i] = set() if not w else {tuple(w)} if len(w) < n else {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    return out


def test_jaccard_join_against_brute_force(spark, docs, empty):
    sets = shingle_sets([(r["doc_id"], r["text"]) for r in docs.collect()])
    name = {i: i for i in sets}
    for _ in range(len(sets)):
        for a, b in itertools.combinations(sets, 2):
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= 75 * len(sets[a] | sets[b]):
                name[a] = name[b] = min(name[a], name[b])
    got = jaccard.components(docs).collect()
    assert len(got) == docs.count()
    assert all((r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), name[r["doc_id"]]) for r in got)
    assert jaccard.components(empty).count() == 0


def test_jaccard_join_of_repeated_and_null_ids(spark):
    import corpus_pipeline

    rng = np.random.default_rng(9)
    rows = []
    for family in range(12):
        base = [f"f{family}w{i}" for i in range(40)]
        for copy in range(5):
            edited = list(base)
            for at in rng.choice(40, copy // 2 * 3, replace=False):  # 0, 0, 3, 3 or 6 words: some link, some only overlap
                edited[at] = f"e{rng.integers(10**9)}"
            rows.append((None if rng.random() < 0.4 else int(rng.integers(6)), " ".join(edited)))
    rows += [(3, rows[0][1]), (None, rows[7][1]), (None, rows[7][1]), (None, ""), (2, None), (None, "a b"), (2, "a b")]
    sets = list(shingle_sets(enumerate(t for _, t in rows)).values())
    name = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and name[a] != name[b]:
            name = [name[a] if x == name[b] else x for x in name]
    least = {g: min((i for (i, _), x in zip(rows, name, strict=True) if x == g and i is not None), default=None) for g in set(name)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.components(docs).collect())
    assert got == collections.Counter((i, len(s), least[g]) for (i, _), s, g in zip(rows, sets, name, strict=True))
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert all(k in rows for k in kept) and len(kept) == len(set(name))
    assert sorted(str(least[name[rows.index(k)]]) for k in kept) == sorted(map(str, least.values())) == sorted(str(i) for i, _ in kept)


def test_few_links_need_no_rounds_over_all_partitions(spark, docs, monkeypatch):
    """Each round is some ten shuffles; a task can hold the links."""
    told = sorted(map(tuple, jaccard.components(docs).collect()))
    assert len({c for _, _, c in told}) < len(told)
    for module in (components, jaccard):
        monkeypatch.setattr(module, "connected_components", None, raising=False)
    assert sorted(map(tuple, jaccard.components(docs).collect())) == told


def test_signatures_meet_whenever_sets_link():
    rng = np.random.default_rng(5)
    for size in (1, 3, 10, 50, 63, 64, 70, 84, 85, 127, 128, 200, 511, 512, 700):
        for _ in range(20):
            base = rng.integers(1, 1 << 62, size).astype(np.uint64)
            lose = int(rng.integers(0, size // 4 + 1))
            gain = max(0, int((size - lose) / 0.75 - size)) if rng.random() < 0.5 else 0
            other = np.unique(np.concatenate([base[lose:], rng.integers(1, 1 << 62, gain).astype(np.uint64)]))
            base = np.unique(base)
            common = len(np.intersect1d(base, other))
            if 100 * common >= 75 * (len(base) + len(other) - common):
                finer = {}
                for band, more in [*jaccard.fineness(base, 75), *jaccard.fineness(other, 75)]:
                    finer[band] = max(more, finer.get(band, 0))
                for fine in (finer, None):
                    a, b = (jaccard.signatures(x, 75, fine) for x in (base, other))
                    meets = [len(np.intersect1d(s, t)) >= max(n, m) for p, s, n in a for q, t, m in b if p == q]
                    assert any(meets)
                assert common >= jaccard.overlap(len(base), len(other), 75)


def test_jaccard_join_of_an_edited_family(spark):
    """Copies of one original with few to many edits from a small vocabulary: some link only with each other."""
    rng = np.random.default_rng(11)
    base, rows = rng.choice(WORDS, 150).tolist(), []
    for i in range(150):
        words = list(base) if i % 10 else rng.choice(WORDS, 150).tolist()
        for at in rng.integers(0, 150, int(rng.integers(0, 14))):
            words[at] = ("edited", "changed")[int(rng.integers(2))]
        if i % 10 == 9:  # a near copy of a heavily edited one
            words = rows[-1][1].split(" ")
            words[3] = "again"
        rows.append((i, " ".join(words[: int(rng.integers(120, 151))]), "en", "s"))
    sets = shingle_sets([r[:2] for r in rows])
    name = {i: i for i in sets}
    linked = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in linked:
            name[a] = name[b] = min(name[a], name[b])
    assert 10 < len(set(name.values())) < 140
    assert {r["doc_id"]: r["component_id"] for r in jaccard.components(make(spark, rows)).collect()} == name


def test_packing_round_trip(spark, docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    pieces = packing.tokenized_pieces(docs, path, 64).collect()
    by = collections.Counter(r["doc_id"] for r in docs.collect())
    for r in docs.collect():
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        mine = sorted((p["piece"], p["start"], p["length"], p["ids_crc32"]) for p in pieces if p["doc_id"] == r["doc_id"])
        want = [(k, a, len(ids[a : a + 64]), zlib.crc32(np.array(ids[a : a + 64], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 64))]
        assert mine == sorted(want * by[r["doc_id"]])
    packed = packing.pack(packing.tokenized_pieces(docs, path, 64), 64, block_rows=100).collect()
    assert len(packed) == len(pieces)
    bins = collections.defaultdict(list)
    for r in packed:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 64
    assert len(bins) <= math.ceil(sum(r["length"] for r in packed) / 64) + 12
    assert packing.pack(packing.tokenized_pieces(empty, path)).count() == 0


def test_local_search_never_worsens():
    rng = np.random.default_rng(1)
    for _ in range(20):
        lengths = rng.integers(1, 60, 200).tolist()
        first = [[i] for i in range(len(lengths))]
        better = packing.local_search(lengths, [list(b) for b in first], 100, patience=50)
        assert sorted(i for b in better for i in b) == list(range(200)) and all(sum(lengths[i] for i in b) <= 100 for b in better)
        assert len(better) < len(first)


def test_mixing_meets_targets(spark, docs, empty):
    a, b = (sorted(tuple(r) for r in mixing.mix(docs, leaf_rows=10, fan_in=2).select("doc_id", "size", "source_size", "target", "taken").collect()) for _ in range(2))
    assert a == b and len(a) == docs.count()
    assert all(t <= 2 * n for _, n, _, _, t in a)
    largest, taken, target = collections.Counter(), collections.Counter(), {}
    for r in mixing.mix(docs, leaf_rows=10, fan_in=2).collect():
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] + 1e-6 for s in target)
    assert sum(target.values()) == pytest.approx(1.5 * sum(r[1] for r in a))
    assert mixing.mix(empty).count() == 0
    copies = mixing.mix(docs).agg(F.sum("copies")).first()[0]
    assert mixing.mixed_documents(docs).count() == copies and mixing.mixed_documents(docs).columns == docs.columns


def test_language_and_quality(spark, docs, empty):
    rows = [(i, f"{w} " * 40, lang, "s") for i, (w, lang) in enumerate([("guten tag", "de"), ("good day", "en")] * 10)]
    train = make(spark, rows)
    model = compression.fit_languages(train)
    got = {r["doc_id"]: r for r in compression.language_id(docs.union(train.limit(2)), model).collect()}
    assert got[100]["lang_pred"] == got[101]["lang_pred"] == got[102]["lang_pred"] == "und"
    assert got[0]["lang_pred"] in ("de", "en") and all(0 <= r["score"] <= 1 for r in got.values())
    told = compression.language_id(train, model).where("lang_pred = lang").count()
    assert told == 20
    nothing = compression.fit_languages(empty)
    assert {r["lang_pred"] for r in compression.language_id(docs, nothing).collect()} == {"und"}
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(99, None)], "doc_id long, quality int")
    q = compression.fit_quality(train, labels)
    scored = compression.quality_scores(train, q).collect()
    assert all(r["predicted"] == r["doc_id"] % 2 for r in scored)
    assert all(0 <= r["score"] <= 1 for r in compression.quality_scores(docs, q).collect())
    assert compression.quality_scores(docs, compression.fit_quality(train, labels.limit(0))).select("score").distinct().count() == 1


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 16))
    x[50:150] = x[50]  # a hot vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [1.0]), (1080, [None] * 16)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block_rows=64, query_rows=7).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hit = 0
    for q in range(0, 400, 20):
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        best = np.lexsort((np.arange(400), -s))[:20]
        mine = sorted(by[q])
        assert [m[0] for m in mine] == list(range(1, 21)) and all(m[2] == s[m[1]] for m in mine)
        hit += len({m[1] for m in mine} & set(best.tolist()))
    assert set(by) == set(range(0, 400, 20)) and hit / 400 >= 0.9
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("most_lists", [1, 2048])
def test_nearest_neighbours_of_varied_norm(spark, most_lists):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((2000, 32))
    x *= (rng.uniform(0.1, 3, 2000) / np.linalg.norm(x, axis=1))[:, None]
    x[40] *= 1e-12  # a short query asks for the same order as a long one
    got = ann.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), most_lists=most_lists).collect()
    by = collections.defaultdict(set)
    for r in got:
        by[r["query_id"]].add(r["vec_id"])
    hit = []
    for q in range(0, 2000, 20):
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        hit.append(len(by[q] & set(np.lexsort((np.arange(2000), -s))[:20].tolist())))
    assert sum(hit) / 2000 >= (0.99 if most_lists == 1 else 0.92) and hit[2] >= 15


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_recall_on_the_given_vectors(spark, scale):
    rows = spark.read.parquet(f"/root/testdata/{scale}/embeddings.parquet")
    found = collections.defaultdict(set)
    for r in ann.nearest(rows).collect():
        found[r["query_id"]].add(r["vec_id"])
    ids, x = zip(*((r["vec_id"], r["embedding"]) for r in rows.select("vec_id", "embedding").collect()), strict=True)
    ids, x = np.array(ids), np.array(x, float)
    hits = []
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        hits.append(len(found[ids[q]] & set(ids[np.lexsort((ids, -s))[:20]].tolist())))
    assert len(found) == len(hits) and np.mean(hits) / 20 >= 0.9


def test_nearest_neighbours_of_repeated_ids_and_equal_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [1.0, 0.0]), (None, [9.0, 9.0]), (3, [-0.0, 1.0])]
    table = spark.createDataFrame([(i, v, 0.0, 0) for i, v in rows], "vec_id long, embedding array<double>, score double, rank int")
    got = sorted(tuple(r) for r in ann.nearest(table, k=2).collect())
    assert got == [(0, 1, 3, 1.0), (0, 2, 1, 0.0), (20, 1, 1, 1.0), (20, 2, 2, 1.0)]


PAGES = [
    (1, "http://a.com/x", "<link rel='canonical' href='http://b.net/q'>"),
    (2, "http://B.net/q#z", ""),
    (3, "http://c.com/", '<meta http-equiv="refresh" content="0; url=http://a.com/x">'),
    (4, None, None),
    (5, "zz", "<link rel=canonical href=/x>"),
    (6, "http://d.com/x", '<link href="http://e.example.net/en/1" rel=canonical>'),
    (7, "http://f.com/", '<link rel="canonical" href="http://d.com/x"><meta http-equiv=refresh content="1;url=//g.net/">'),
    (8, "http://x.example.com/de/1", ""),
    (9, "http://y.net", ""),
    (10, "http://h.com/p/q/r.html?a=1", '<link rel="alternate canonical"\n href="../s/./t.html?b=2#c">'),
    (11, "http://h.com/p/s/t.html?b=2", '<LINK REL=canonical HREF="http://k.net/">'),
    (12, "http://l.com/z", '<link rel="canonical" href="http://y.net">'),
    (13, "http://m.com", '<link rel="canonical" href="?v=1"><link rel="canonical" href="n/o"><link rel="stylesheet" href="http://q.net/canonical">'),
    (14, "http://m.com/n/o", '<meta http-equiv=refresh content="0;url=http://r.net/1">'),
    (15, "http://m.com?v=1", ""),
    (16, "http://s.com/a", '<link rel=canonical href="#top"><link rel=canonical href="mailto:x@y.net">'),
    (16, "http://s.com/a", '<link rel=canonical href="http://t.org/fr/..">'),
    (17, "http://t.org/fr/..", '<link rel=canonical href="http://u.net/1">'),
]


def test_urls_follow_redirects(spark):
    import duckdb

    pages = spark.createDataFrame([(*p, "x", "y") for p in PAGES], "page_id long, url string, html string, host string, rule string")
    rows = [tuple(r) for r in urls.judged_pages(pages).collect()]
    got = {r[0]: r[1:] for r in rows}
    assert len(rows) == len(PAGES)
    assert {i: (r[2], r[3]) for i, r in got.items()} == {1: (None, "block"), 2: ("net/", "block"), 3: (None, "block"), 4: (None, "allow"), 5: (None, "allow"), 6: (None, "allow"), 7: (None, "allow"), 8: ("example.com/de/", "block"), 9: (None, "allow"), 10: (None, "block"), 11: (None, "block"), 12: (None, "allow"), 13: (None, "block"), 14: (None, "block"), 15: (None, "block"), 16: (None, "allow"), 17: ("org/fr/", "allow")}
    assert got[8][:2] == ("x.example.com", "/de/1") and got[2][:2] == ("b.net", "/q") and got[4][:2] == ("", "")
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", PAGES)
    assert sorted(map(str, con.execute(queries.ORACLES["op7_url_filters"]).fetchall())) == sorted(map(str, rows))
    assert urls.judged_pages(pages.limit(0)).count() == 0


def test_lm_against_brute_force(spark, docs, empty):
    train = docs.where("doc_id < 40")
    uni, pairs, context, types = (collections.Counter() for _ in range(4))
    for r in train.collect():
        w = lm.tokens(r["text"])
        uni.update(w)
        pairs.update(zip([b"<"] + w[:-1], w, strict=True))
    for (a, _), n in pairs.items():
        context[a] += n
        types[a] += 1
    total = sum(uni.values()) + len(uni) + 1
    got = lm.scores(docs, lm.train(train), ["doc_id"]).collect()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        w = lm.tokens(text[r["doc_id"]])
        base, score = 0.0, 0.0
        for a, b in zip([b"<"] + w[:-1], w, strict=True):
            p = (uni[b] + 1) / total
            base += math.log10(p)
            score += math.log10((max(pairs[a, b] - 0.75, 0) + 0.75 * types[a] * p) / context[a] if context[a] else p)
        assert r["n_tokens"] == len(w) and r["n_known"] == sum(uni[x] > 0 for x in w)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(score, abs=2e-4 * len(w))
    assert lm.scores(docs, lm.train(empty), ["doc_id"]).where("n_known > 0").count() == 0


def test_elias_fano_round_trip():
    rng = np.random.default_rng(1)
    for n, top in ((1, 5), (1000, 100), (5000, 10**9), (300, 0)):
        v = np.sort(rng.integers(0, top + 1, n))
        e = lm.EliasFano.of(v)
        want = rng.integers(0, top + 2, 200)
        assert (e.access(np.arange(n)) == v).all()
        assert (e.successor(want, np.zeros(200, int), np.full(200, n)) == np.searchsorted(v, want)).all()


def test_token_counts_equal_the_tokenizer(spark, docs, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    tok = Tokenizer(models.Unigram(tokencount.read_pieces(path), 0, True))
    tok.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    for r in tokencount.token_counts(docs, path).collect():
        text = next(x["text"] for x in docs.collect() if x["doc_id"] == r["doc_id"])
        assert r["n_tokens"] == len(tok.encode(text or "").ids)
    count = tokencount.cached_counter(path).text
    for s in ("", " ", "  a b ", "\n", "a\n\nb", "▁▁x", "梦 \U0001f600\U0001f601 zz\t́e", "<0x0A> <s> <unk>", "a" * 500):
        assert count(s)[0] == len(tok.encode(s).ids)
    assert tokencount.token_counts(empty, path).count() == 0


def test_all_ten_are_registered():
    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]


def filled_targets(size, weights=(3.0, 1.0, 2.0), budget=1.5, cap=2.0):
    """Targets by filling: all sources share what is left by weight, those above their limit are fixed, again and again."""
    order = sorted((x for x in size if x is not None)) + [None] * (None in size)
    weight = {x: weights[i % 3] for i, x in enumerate(order)}
    fixed, rest = {}, budget * sum(size.values())
    while True:
        free = [x for x in order if x not in fixed]
        share = {x: rest * weight[x] / sum(weight[y] for y in free) for x in free}
        over = [x for x in free if share[x] > cap * size[x]]
        if not over:
            return fixed | share
        for x in over:
            fixed[x] = cap * size[x]
            rest -= fixed[x]


def words_of(text):
    return len((text or "").encode().split())


def check_mix(rows, taken, repeats=None):
    """``rows``: (id, source, text); ``taken``: words that the mix takes, by source."""
    size, largest = collections.Counter(), collections.Counter()
    for _, source, text in rows:
        size[source] += words_of(text)
        largest[source] = max(largest[source], words_of(text))
    want = filled_targets(dict(size))
    assert all(abs(taken.get(x, 0) - want[x]) <= largest[x] + 1e-6 for x in size)
    return size, want


@pytest.mark.parametrize("scale", ["small", "sf0.01"])
def test_mixing_against_brute_force(spark, docs, scale):
    table = docs if scale == "small" else spark.read.parquet(f"/root/testdata/{scale}/documents.parquet")
    rows = [(r["doc_id"], r["source"], r["text"]) for r in table.collect()]
    got, taken = mixing.mix(table, leaf_rows=100, fan_in=3).collect(), collections.Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
    size, want = check_mix(rows, taken)
    assert all(r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(want[r["source"]], rel=1e-12) for r in got)
    assert sorted((r["doc_id"], r["size"]) for r in got) == sorted((i, words_of(t)) for i, _, t in rows)
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in got)


def test_targets_of_many_sources(spark):
    rng = np.random.default_rng(4)
    sizes = {f"s{i}": int(rng.integers(0, 9)) ** 3 for i in range(500)} | {None: 100, "": 7}
    rows = [(i, "w " * n, "en", x) for i, (x, n) in enumerate(sizes.items())]
    want = filled_targets(sizes)
    got = {r["source"]: r["target"] for r in mixing.targets(mixing.sizes(make(spark, rows))).collect()}
    assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x], rel=1e-9, abs=1e-9) for x in want)


def packed_size(text, dictionary, level):
    import zstandard

    made = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    made.precompute_compress(level=level)
    return len(zstandard.ZstdCompressor(level=level, dict_data=made, write_content_size=False, write_dict_id=False).compress(text.encode()))


def language_of(text, model):
    """(language or und, accepted) by compressing anew."""
    words = compression.letters(text or "")
    if not words:
        return "und", False
    sizes = sorted((packed_size(words, d, model.level), i) for i, d in enumerate(model.dictionaries))
    return model.languages[sizes[0][1]], (sizes[1][0] - sizes[0][0]) / sizes[1][0] >= model.margins[min(len(words.encode()).bit_length(), 15)]


def good(text, model):
    raw = text or ""
    x = (packed_size(raw, model.bad, model.level) - packed_size(raw, model.good, model.level)) / len(raw.encode()) if raw else 0.0
    return 1 / (1 + math.exp(-(model.slope * x + model.offset))) >= 0.3


def test_classifiers_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    known = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}
    told = [(r["lang_pred"], known[r["doc_id"]], r["accepted"]) for r in queries.op5_language_id(spark, d).collect() if r["held_out"] and known[r["doc_id"]]]
    assert len(told) > 2000 and np.mean([a == b for a, b, _ in told]) >= 0.99 and np.mean([x for *_, x in told]) >= 0.98
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    scored = [(r["score"], label[r["doc_id"]]) for r in queries.op10_quality_classifier(spark, d).collect() if r["held_out"] and label.get(r["doc_id"]) in (0, 1)]
    x, y = (np.array([s for s, q in scored if q == want]) for want in (1, 0))
    assert len(x) > 500 and len(y) > 50 and (x[:, None] > y[None]).mean() >= 0.96 and (x >= 0.3).mean() >= 0.95


def test_margins_follow_length():
    told = [(9, 0.2 + i / 1000) for i in range(100)] + [(12, 0.5)] * 60 + [(14, 0.01)] * 3
    got = compression.margins_of(told)
    assert got[0] == got[9] == got[11] == pytest.approx(0.1, abs=0.01) and got[12] == got[15] == 0.25 and compression.margins_of([]) == (0.0,) * 16


def test_sample_takes_no_more_than_its_bound_and_ignores_double_labels(spark):
    rows = [(i, f"{'good day' if i % 2 else 'bad night'} {i} " * 9, "en", "s") for i in range(300)] + [(900, "both", "en", "s")]
    labels = spark.createDataFrame([(i, i % 2, "z") for i in range(300)] + [(900, 0, "z"), (900, 1, "z"), (901, 7, "z"), (None, 1, "z"), (5, None, "z")], "doc_id long, quality int, text string")
    ranked = compression.ranked_sample(labels.where("quality in (0, 1)").selectExpr("quality AS label", "coalesce(doc_id, -1) AS key"), {0: 151, 1: 152}, 10).collect()
    assert collections.Counter(r["label"] for r in ranked) == {0: 10, 1: 10}
    model = compression.fit_quality(make(spark, rows), labels)
    assert b"both" not in model.good + model.bad and b"night" in model.bad and b"night" not in model.good
    for r in compression.quality_scores(make(spark, rows), model).collect():
        assert r["predicted"] == good(r["text"], model)


ODD = [(1000, None, None, None), (1001, "", "en", None), (1002, " \n\t ", "de", "s1"), (1003, "one two", "de", "s1"), (None, "no id " * 40, "en", "s2"), (1004, "word " * 40000, "en", "s0"), (1005, "12 34 !? " * 50, "en", "s3")]


@pytest.fixture(scope="module")
def odd(spark):
    given = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    return make(spark, given + ODD + given[:3] + [(2000, given[5][1], "en", "s9"), (given[7][0], given[8][1], "en", "s9")])


def test_every_stage_on_odd_rows_against_brute_force(spark, odd, empty):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    same = lambda rows: collections.Counter(map(str, rows))
    stages = [f for _, f in corpus_pipeline.STAGES]
    for f in stages:
        assert f(spark, empty, d).count() == 0
    now = odd.collect()

    quality = compression.fit_quality(odd, spark.read.parquet(f"{d}/labels.parquet").where(queries.fold("doc_id", 5) != 0))
    kept = stages[0](spark, odd, d)
    want = [r for r in now if good(r["text"], quality)]
    assert kept.columns == odd.columns and same(kept.collect()) == same(want) and 0.5 * len(now) < len(want) < len(now)

    now, table = want, spark.createDataFrame(want, odd.schema)
    model = compression.fit_languages(table.where(~F.coalesce(queries.fold("doc_id", 4) == 2, F.lit(False))))
    want = [r for r in now if language_of(r["text"], model)[1]]
    assert same(stages[1](spark, table, d).collect()) == same(want) and 0.9 * len(now) < len(want) < len(now)

    now = want + [r for r in now if r not in want and not (r["text"] or "").split()]  # some without words again
    table = spark.createDataFrame(now, odd.schema)
    sets = list(shingle_sets(enumerate(r["text"] for r in now)).values())
    name = list(range(len(now)))
    for a, b in itertools.combinations(range(len(now)), 2):
        if sets[a] and name[a] != name[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            name = [name[a] if x == name[b] else x for x in name]
    got = stages[2](spark, table, d).collect()
    assert not same(got) - same(now) and len(got) == len({x for x, s in zip(name, sets, strict=True) if s}) + sum(not s for s in sets)
    for group in {x for x, s in zip(name, sets, strict=True) if s}:
        members = [r for r, x in zip(now, name, strict=True) if x == group]
        mine = [r for r in got if r in members]
        least = min((r["doc_id"] for r in members if r["doc_id"] is not None), default=None)
        assert len(mine) == 1 and mine[0]["doc_id"] == least

    now, table = got, spark.createDataFrame(got, odd.schema)
    mixed = stages[3](spark, table, d).collect()
    taken = collections.Counter()
    for r in mixed:
        taken[r["source"]] += words_of(r["text"])
    check_mix([(r["doc_id"], r["source"], r["text"]) for r in now], taken)
    assert all(n <= 2 * same(now)[r] for r, n in same(mixed).items()) and same(mixed) == same(stages[3](spark, table, d).collect())

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed = stages[4](spark, spark.createDataFrame(mixed, odd.schema), d).collect()
    want = []
    for r in mixed:
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        want += [(r["doc_id"], k, a, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    assert same([(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed]) == same(want)
    bins = collections.defaultdict(list)
    for r in packed:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        assert all(o == sum(n for p, n in b if p < o) for o, _ in b) and sum(n for _, n in b) <= 2048
    assert len(bins) <= 1 + 1.02 * sum(r["length"] for r in packed) / 2048


def test_pipeline_is_its_stages(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(docs.select(columns).collect()) == sorted(corpus_pipeline.run(spark, d).select(columns).collect())
