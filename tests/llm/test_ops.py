"""Training-data operators against brute force, round trips and held-out accuracy on small inputs."""

import hashlib
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftline.llm import ann, bpe, exact_dedup, langid, mixing, quality, simhash, suffix_dedup, token_counts, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, "one two  three\tfour five", "en", "a", 1),
    (2, "one two three four five", "en", "a", 1),
    (3, None, None, None, None),
    (4, "", "en", None, 0),
    (5, " \n ", "en", "b", 3),
    (5, "repeated id", "en", "b", 3),
    (5, "repeated id", "en", "b", 3),
    (None, "no id at all", "fr", "c", 3),
    (None, None, None, "c", 3),
    (7, "x" * 5000 + " long " * 300, "en", "a", 9),
    (8, "x" * 5000 + " long " * 300, "en", "a", 9),
    (9, "<|endoftext|> ½ 日本語 É's don't", "de", "b", 9),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def clash(odd):
    """Extra columns with names that operators use inside."""
    return odd.selectExpr("*", "doc_id as id", "text as t", "1 as k", "2 as n", "source as sid", "3 as size", "4 as fp", "5 as did", "6 as part")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 10)] + [(None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")


# ---- mixing ----
def water_fill(sizes, weights, cap=3.0):
    t, left, rest = {}, dict(sizes), float(sum(sizes.values()))
    while left:
        w = sum(weights[s] for s in left)
        over = [s for s in left if rest * weights[s] / w > cap * sizes[s]]
        if not over:
            t |= {s: rest * weights[s] / w for s in left}
            break
        for s in over:
            t[s] = cap * sizes[s]
            rest -= t[s]
            del left[s]
    return t


def test_mixing_meets_targets_and_limits(spark):
    r = np.random.default_rng(0)
    rows = [(i, " ".join(["w"] * int(r.integers(0, 60))), None, f"s{min(int(r.integers(0, 9)), 4)}", 0) for i in range(900)] + [(1000 + i, "a b", None, "t", 0) for i in range(3)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(docs).toPandas()
    src = pd.Series({r[0]: r[3] for r in rows})
    got["source"] = got["doc_id"].map(src)
    by = got.groupby("source")
    sizes = by["size"].sum().to_dict()
    weights = {s: (i % 3) + 1.0 for i, s in enumerate(sorted(sizes))}
    want = water_fill(sizes, weights)
    assert len(got) == len(rows) and (got["taken"] <= 3 * got["size"]).all()
    for s, x in by:
        assert x["target"].iloc[0] == pytest.approx(want[s]) and x["source_size"].iloc[0] == sizes[s]
        # only the last unit is landed: less than its words from the target, and at most two documents from their number
        assert abs(x["taken"].sum() - want[s]) < max(1, x["size"].max())
        assert abs(x["copies"].sum() - len(x) * (want[s] / sizes[s] if sizes[s] else 0)) <= 2
    again = mixing.mix(docs.orderBy(F.desc("doc_id"))).toPandas()
    assert got.drop(columns="source").sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))


def test_flight_keeps_both_totals():
    r = np.random.default_rng(1)
    size, p = r.integers(1, 900, 400).astype(float), r.random(400)
    q = mixing.flight(p, size, r)
    assert ((q > 0) & (q < 1)).sum() <= 2
    assert q.sum() == pytest.approx(p.sum()) and (q * size).sum() == pytest.approx((p * size).sum())


def test_landing_keeps_words_and_expectations():
    size, p = np.array([7.0, 3.0, 5.0]), np.array([0.4, 0.7, 1.0])
    got = np.array([mixing.land(p, size, np.random.default_rng(i)) for i in range(4000)])
    assert set(got.ravel().tolist()) <= {0.0, 1.0} and (got[:, 2] == 1).all()
    assert np.allclose(got.mean(axis=0), p, atol=0.03)
    assert (np.abs(got @ size - p @ size) < 7).all()


def test_mixture_repeats_rows_as_planned(odd, empty):
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0
    plan = mixing.mix(odd)
    assert plan.count() == len(ODD)
    assert mixing.mixed(odd).count() == plan.agg(F.sum("copies")).first()[0]


# ---- token counts and BPE ----
@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


TEXTS = [t or "" for _, t, *_ in ODD] + ["  a  b\t\n\n c", "='s 'RE don't", "a" * 300, " " * 70 + "x", "\x85a\x1c\x1d b", "½ ٣ ① Ⅷ²³", "😀😀", "<|endoftext|<|endoftext|>>"]


def test_bpe_is_the_librarys(reference):
    c = bpe.codec(bpe.default_path())
    for t, ids in zip(TEXTS, c.encode_batch(TEXTS)):
        want = reference.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert c.decode(ids) == reference.decode(want, skip_special_tokens=False)


def test_bpe_frames(odd, reference):
    rows = bpe.round_trip(odd).collect()
    want = sorted((repr(i), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in ODD)
    assert sorted((repr(r.doc_id), r.decoded_sha256) for r in rows) == want
    back = bpe.decode(bpe.encode(odd)).collect()
    assert sorted(r.text for r in back) == sorted(t or "" for _, t, *_ in ODD)


def test_edits_give_the_count_from_scratch():
    c, r = bpe.codec(bpe.default_path()), np.random.default_rng(2)
    for t in TEXTS + ["word " * 400 + "\n\n'll end"]:
        d = token_counts.CountedText(t, c)
        for _ in range(8):
            n = len(d.text)
            s = int(r.integers(0, n + 1))
            d.edit(s, s + int(r.choice([0, 1, 5, 300])), str(r.choice(["", " ", "x", "'s", " \n", "<|endoftext|>", "oftext|>", "ab " * 200])))
            assert d.tokens == sum(len(x) // 4 for x in c.encode_batch([d.text])) and d.tree.chars == len(d.text)


def test_counts_frame(odd, empty, reference):
    def after(t):
        for start, end, new in token_counts.standard_edits(len(t)):
            t = t[: min(start, len(t))] + new + t[min(end, len(t)) :]
        return t

    count = lambda t: len(reference.encode(t, add_special_tokens=False).ids)
    got = sorted((repr(r.doc_id), r.n_tokens, r.n_tokens_edited) for r in token_counts.count_tokens(odd).collect())
    assert got == sorted((repr(i), count(t or ""), count(after(t or ""))) for i, t, *_ in ODD)
    assert token_counts.count_tokens(empty).count() == 0


def test_bpe_of_empty_table_and_very_long_text(spark, empty, reference):
    assert bpe.round_trip(empty).count() == 0 and bpe.encode(empty).count() == 0
    long = "Every word, 12 times over - " * 60_000  # 1.6 million characters
    (r,) = bpe.encode(spark.createDataFrame([(1, long, None, None, 0)], SCHEMA)).collect()
    assert np.frombuffer(bytes(r.ids), "<u4").tolist() == reference.encode(long, add_special_tokens=False).ids


# ---- exact duplicates ----
def test_grace_spills_and_keeps_everything():
    body = [f"text {i % 700}".encode() * 20 for i in range(2000)]
    key = [int.from_bytes(hashlib.sha256(b).digest()[:8], "big") for b in body]
    rows = [(b"", k, i, 1, 1, b) for i, (k, b) in enumerate(zip(key, body))]
    got = {r[5]: (r[2], r[3]) for r in exact_dedup.grace(rows, limit=20_000)}
    want = {}
    for i, b in enumerate(body):
        want[b] = (want.get(b, (i, 0))[0], want.get(b, (i, 0))[1] + 1)
    assert got == want


def test_equal_hashes_do_not_merge_different_texts():
    got = list(exact_dedup.grace([(b"", 5, 1, 1, 1, b"a"), (b"", 5, 2, 1, 1, b"b"), (b"", 5, 3, 1, 1, b"a")], limit=1))
    assert sorted((r[5], r[3]) for r in got) == [(b"a", 2), (b"b", 1)]


def test_exact_dedup(odd, clash, empty):
    got = exact_dedup.exact_dedup(odd).collect()
    by = {(r.doc_id, r.text_sha256): r for r in got}
    assert len(got) == len(ODD)
    r = by[2, hashlib.sha256(b"one two three four five").hexdigest()]
    assert (r.keep_id, r.group_size, r.kept) == (1, 2, False)
    r = by[3, hashlib.sha256(b"").hexdigest()]
    assert (r.keep_id, r.group_size) == (3, 3)
    assert sorted(r.text_sha256 for r in got) == sorted(hashlib.sha256(exact_dedup.squeeze((t or "").encode())).hexdigest() for _, t, *_ in ODD)
    kept = exact_dedup.deduplicate(clash)
    assert kept.columns == clash.columns and kept.count() == len({exact_dedup.squeeze((t or "").encode()) for _, t, *_ in ODD})
    assert exact_dedup.exact_dedup(empty).count() == 0


#: Names of columns inside the operators, and names that need quoting.
NAMES = ["a.b", "a`b", "__row", "__k", "__j", "__i", "__n", "__id", "__sha", "__kept", "__t", "__score", "__copies", "k", "n", "id", "own", "its", "stays", "first", "copy", "copies", "nth", "score", "component", "sha", "keep_id", "n_min", "t", "size", "did", "part", "fp"]


def named(docs):
    return docs.select("*", *[F.concat(F.lit(f"{n}:"), F.coalesce("text", F.lit("-"))).alias(n) for n in NAMES])


@pytest.mark.parametrize("stage", [exact_dedup.deduplicate, simhash.one_per_group, mixing.mixed, lambda d: toxicity.keep_clean(d, d.select("doc_id", F.lit(0).alias("toxic")))], ids=["exact", "near", "mixed", "clean"])
def test_stages_keep_columns_of_any_name(odd, stage):
    key = lambda rows: sorted(map(repr, rows))
    docs = named(odd)
    got = stage(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert all(r[n] == f"{n}:{'-' if r.text is None else r.text}" for r in rows for n in NAMES)
    assert {r.text for r in rows} <= {t for _, t, *_ in ODD}
    assert key((r.doc_id, r.text) for r in rows) == key((r.doc_id, r.text) for r in stage(odd).collect())


@pytest.mark.parametrize("op", [mixing.mix, token_counts.count_tokens, simhash.near_duplicates, exact_dedup.exact_dedup, bpe.round_trip, langid.language, suffix_dedup.remove_repeats, lambda d: quality.quality(d, d.select("doc_id", F.lit(0).alias("quality"))), lambda d: toxicity.toxicity(d, d.select("doc_id", F.lit(0).alias("toxic")))])
def test_operators_ignore_other_columns(odd, op):
    assert sorted(map(repr, op(named(odd)).collect())) == sorted(map(repr, op(odd).collect()))


# ---- SimHash ----
def test_keys_bring_all_close_pairs_together():
    r = np.random.default_rng(0)
    x = r.integers(0, 2**64, 500, dtype=np.uint64)
    y = x.copy()
    for i in range(500):
        for b in r.choice(64, r.integers(0, 5), replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    a, b = (set(zip(*(v.tolist() for v in simhash.fuzzy_keys(z)))) for z in (x, y))
    assert {row for row, _ in a & b} == set(range(500))


def test_bucket_links_connect_like_all_pairs():
    r = np.random.default_rng(4)
    base = r.integers(0, 2**64, 3, dtype=np.uint64)
    fp = np.unique(np.array([b ^ np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, int(r.integers(1, 4))).astype(np.uint64)) for b in base for _ in range(30)]))
    a, b = simhash.bucket_links(np.zeros(len(fp), np.int64), fp)

    def groups(pairs):
        root = {int(v): int(v) for v in fp}

        def find(v):
            while root[v] != v:
                v = root[v]
            return v

        for p, q in pairs:
            root[find(int(p))] = find(int(q))
        parts = {}
        for v in root:
            parts.setdefault(find(v), set()).add(v)
        return sorted(map(sorted, parts.values()))

    every = [(p, q) for i, p in enumerate(fp) for q in fp[i + 1 :] if int(p ^ q).bit_count() <= 4]
    assert groups(zip(a, b)) == groups(every)


def test_near_duplicates(spark, odd, empty):
    r = np.random.default_rng(6)
    words = [f"w{i}" for i in range(3000)]
    base = [list(r.choice(words, 150)) for _ in range(40)]
    rows = [(i, " ".join(b), None, None, 0) for i, b in enumerate(base)]
    for i in range(0, 40, 2):
        b = list(base[i])
        b[int(r.integers(0, 150))] = "changed"
        rows.append((100 + i, " ".join(b), None, None, 0))
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {x.doc_id: (int(x.fingerprint, 16), x.component_id) for x in simhash.near_duplicates(docs).collect()}
    fp = {i: simhash.fingerprint(t.encode()) for i, t, *_ in rows}
    comp = {i: i for i in fp}
    for _ in fp:
        for i in fp:
            comp[i] = min([comp[i], *(comp[j] for j in fp if (fp[i] ^ fp[j]).bit_count() <= 4)])
    assert got == {i: (fp[i], comp[i]) for i in fp}
    kept = {x.doc_id for x in simhash.one_per_group(docs).collect()}
    assert kept == set(range(40))
    assert simhash.near_duplicates(odd).count() == len(ODD) and simhash.near_duplicates(empty).count() == 0
    left = simhash.one_per_group(odd)
    assert left.columns == odd.columns and simhash.one_per_group(empty).count() == 0
    assert left.count() == 6  # five words, wordless, repeated id, no id, long, mixed


def brute_kept(texts):
    """Smallest number of each component of texts whose five-word shingles have a similarity of 0.8 or more."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    root = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j in range(i):
            if 9 * len(x & sets[j]) >= 4 * (len(x) + len(sets[j])):
                root = [root[j] if r == root[i] else r for r in root]
    return {min(i for i, r in enumerate(root) if r == c) for c in set(root)}


def kept_ids(spark, texts):
    return {x.doc_id for x in simhash.one_per_group(spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], SCHEMA)).collect()}


def test_near_copies_in_long_buckets(spark):
    r = np.random.default_rng(16)
    words, texts = [f"w{i}" for i in range(200)], []
    for g in range(3):  # templated texts: one vocabulary, 60 copies with few or many edits each
        base = list(r.choice(words, 120))
        for _ in range(60):
            b = list(base)
            for at in r.integers(0, 120, int(r.integers(0, 9))):
                b[at] = words[int(r.integers(0, 200))]
            texts.append(" ".join(b))
        for _ in range(8):  # pairs that are near each other but far from their template
            b = list(base)
            for at in r.integers(0, 120, 12):
                b[at] = words[int(r.integers(0, 200))]
            texts += [" ".join(b), " ".join([*b[:-1], "end"])]
    order = r.permutation(len(texts))
    texts = [texts[i] for i in order]
    assert kept_ids(spark, texts) == brute_kept(texts)



def test_near_copies_are_decided_on_all_shingles(spark):
    texts, stay = [], set()
    for g in range(30):  # 400 shingles and 100 more: exactly 0.8; 101 more: below
        words = [f"g{g}w{i}" for i in range(504 + g % 2)]
        stay |= {2 * g} | ({2 * g + 1} if g % 2 else set())
        texts += [" ".join(words[:404]), " ".join(words)]
    assert kept_ids(spark, texts) == brute_kept(texts) == stay


def test_near_copies_with_passages_added_or_cut(spark):
    r = np.random.default_rng(17)
    new = lambda n: [f"w{i}" for i in r.integers(0, 10**6, n)]
    texts = []
    for n in (60, 150, 400, 1000):
        for share in (0.04, 0.1, 0.16, 0.19, 0.23):
            b, k, at = new(n), int(n * share), int(r.integers(1, n // 2))
            texts += [" ".join(x) for x in (b, b + new(k), b[k:], b[: n - k], b[:at] + new(k) + b[at:], b[:at] + b[at + k :])]
            far = new(n)  # pairs of their own, which no third text connects
            texts += [" ".join(far), " ".join(far[:at] + new(k) + far[at:])]
    assert kept_ids(spark, texts) == brute_kept(texts)


def test_near_copies_come_first_from_fingerprints(spark, monkeypatch):
    r, seen, real = np.random.default_rng(21), [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda distinct: seen.append(real(distinct).cache()) or seen[-1])
    texts = []
    for _ in range(12):
        b = [f"w{i}" for i in r.integers(0, 10**6, 900)]
        texts += [" ".join(b), " ".join([*b[:-1], "end"])]
    for g in range(6):  # one line repeated makes the prints alike, but few shingles are shared
        texts.append("the same line again " * 400 + " ".join(f"w{i}" for i in r.integers(0, 10**6, 40)))
    assert kept_ids(spark, texts) == brute_kept(texts)
    fp = [simhash.fingerprint(t.encode()) for t in texts]
    got = {tuple(sorted(x & (2**64 - 1) for x in p)) for d in seen for p in d.collect()}
    alike = {tuple(sorted((x, y))) for i, x in enumerate(fp) for y in fp[:i] if 0 < (x ^ y).bit_count() <= 4}
    assert got and got <= alike and {x for p in got for x in p} == {x for p in alike for x in p}
    # as pairs of rows: all that fingerprints connect, equal ones too
    rows = spark.createDataFrame([(i, x - 2**64 if x >> 63 else x) for i, x in enumerate(fp + fp[:5])], "rid long, fp long")
    root = list(range(len(fp) + 5))
    for a, b in simhash.print_pairs(rows, len(root)).collect():
        assert a < b
        root = [root[a] if x == root[b] else x for x in root]
    want = list(range(len(root)))
    for i, x in enumerate(fp + fp[:5]):
        for j, y in enumerate((fp + fp[:5])[:i]):
            if (x ^ y).bit_count() <= 4:
                want = [want[j] if v == want[i] else v for v in want]
    assert [root.index(v) for v in root] == [want.index(v) for v in want]


# ---- suffixes ----
def brute_repeats(rows, n=100):
    seen, out = set(), {}
    for i, t in sorted((i, (t or "").encode()) for i, t in rows):
        gone = bytearray(len(t))
        for p in range(len(t) - n + 1):
            if t[p : p + n] in seen:
                gone[p : p + n] = b"\1" * n
            seen.add(t[p : p + n])
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out[i] = (len(t), sum(gone), sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


def test_repeats_like_brute_force(spark, odd, empty):
    r = np.random.default_rng(8)
    text = lambda n: "".join(r.choice(list("abcdé "), n))
    shared = [text(int(r.integers(80, 400))) for _ in range(6)]
    rows = [(i, text(int(r.integers(0, 200))) + shared[int(r.integers(0, 6))] + text(int(r.integers(0, 99))) + shared[int(r.integers(0, 6))][:150] + text(3)) for i in range(60)]
    rows += [(100, "ab" * 400), (101, "ab" * 99), (102, "z" * 1000), (103, None), (104, ""), (105, text(99)), (106, "line one two three\n" * 50)]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], SCHEMA)
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.remove_repeats(docs).collect()}
    assert got == brute_repeats(rows)
    hot = suffix_dedup.remove_repeats(docs, hot_rows=1).collect()  # every shared passage through the second sort
    assert {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in hot} == got
    assert suffix_dedup.remove_repeats(odd).count() == len(ODD) and suffix_dedup.remove_repeats(empty).count() == 0


def test_multikey_quicksort_sorts():
    r = np.random.default_rng(9)
    for n in (0, 1, 50, 200_000):
        cols = [r.integers(0, 5, n).astype(np.uint64), r.integers(0, 2**63, n).astype(np.uint64) >> np.uint64(50), np.arange(n)]
        assert (suffix_dedup.multikey_quicksort(cols) == np.lexsort(cols[::-1])).all()


# ---- neighbours ----
VECTORS = "vec_id long, embedding array<double>"


def brute_neighbours(rows, k=10):
    """(query_id, rank, vec_id, score), with rows told apart by their place."""
    out = []
    for at, (q, v) in enumerate(rows):
        if q % 100 == 0:
            d = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), i) for j, (i, w) in enumerate(rows) if j != at)
            out += [(q, n + 1, i, x) for n, (x, i) in enumerate(d[:k])]
    return sorted(out)


def found_neighbours(spark, rows, **options):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(spark.createDataFrame(rows, VECTORS), **options).collect())


def same_neighbours(got, want):
    return [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12)


def test_neighbours_recall(spark):
    r = np.random.default_rng(10)
    x = r.normal(size=(6000, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    want, got = brute_neighbours(rows), found_neighbours(spark, rows)
    assert len(got) == len(want) == 600
    assert len({g[::2] for g in got} & {w[::2] for w in want}) >= 0.9 * 600
    assert same_neighbours(found_neighbours(spark, rows, margin=None), want)  # the proven bound misses nothing


def test_codes_spare_most_comparisons():
    """In reach of a query's best are few of the vectors that are no training rows."""
    r = np.random.default_rng(14)
    center = r.normal(size=(60, 32)) * 3
    x = center[r.integers(0, 60, 9000)] + r.normal(size=(9000, 32)) * 0.3
    aq = ann.AdditiveQuantizer(32, books=8, words=64).fit(x[:2000])
    y, q = x[2000:], x[:20]
    codes = aq.encode(y)
    order = np.argsort(codes[:, 0], kind="stable")
    y, codes = y[order], codes[order]
    back = aq.decode(codes).astype(float)
    s = ann.Search(aq, q, np.full(20, 1e100), 11, 1.0, None)
    for at in range(0, len(y), 500):
        p = slice(at, at + 500)
        s.add(y[p], codes[p], (back[p] ** 2).sum(1), np.sqrt(((y[p] - back[p]) ** 2).sum(1)), np.arange(len(y))[p], np.arange(len(y))[p])
    assert s.compared <= 0.25 * 20 * len(y)
    for i in range(20):
        d = np.sqrt(((y - q[i]) ** 2).sum(1))
        assert s.found[s.found["q"] == i]["at"].tolist() == np.lexsort((np.arange(len(y)), d))[:11].tolist()


def test_neighbours_of_copies_ties_and_repeated_ids(spark):
    r = np.random.default_rng(11)
    few = [r.normal(size=4).tolist() for _ in range(6)]
    rows = [(int(i), few[int(j)]) for i, j in zip(r.integers(0, 400, 900), r.integers(0, 6, 900))]
    assert same_neighbours(found_neighbours(spark, rows), brute_neighbours(rows))
    twins = [(100, [1.0, 0.0]), (100, [1.0, 0.1]), (1, [2.0, 0.0]), (2, [5.0, 0.0])]
    assert same_neighbours(found_neighbours(spark, twins), brute_neighbours(twins))
    three = [(100, [1.0, 0.0]), (2, [0.5, 0.0]), (1, [1.5, 0.0])]
    assert found_neighbours(spark, three) == [(100, 1, 1, 0.5), (100, 2, 2, 0.5)]


@pytest.mark.parametrize("size", [1e20, 1e-20, 1e-170, 1e170])
def test_neighbours_of_very_long_and_very_short_vectors(spark, size):
    r = np.random.default_rng(12)
    x = r.normal(size=(300, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = found_neighbours(spark, [(i, (np.array(v) * size).tolist()) for i, v in rows])
    assert same_neighbours([(*g[:3], g[3] / size) for g in got], brute_neighbours(rows))


def test_vectors_that_take_no_part(spark):
    rows = [(100, [1.0, 2.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [1.0, None]), (6, [1.0]), (None, [1.0, 2.0]), (7, [2.0, 2.0]), (8, [1.0, 4.0])]
    docs = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 as v", "2 as rid", "3 as qkey")
    got = [(x.query_id, x["rank"], x.vec_id, x.score) for x in ann.nearest(docs).orderBy("rank").collect()]
    assert got == [(100, 1, 7, 1.0), (100, 2, 8, 2.0)]
    assert ann.nearest(spark.createDataFrame([], VECTORS)).count() == 0
    assert ann.nearest(spark.createDataFrame([(1, [1.0]), (2, [2.0])], VECTORS)).count() == 0


# ---- classifiers ----
def crc(i, m):
    return zlib.crc32(str(i).encode()) % m


@pytest.fixture(scope="module")
def corpus(spark):
    r = np.random.default_rng(12)
    syl = {"en": "th er on an re he in ed nd".split(), "de": "sch ung ein ich der ß ge zu".split()}
    rows, lab = [], []
    for i in range(700):
        lang = "en" if i % 2 else "de"
        words = ["".join(r.choice(syl[lang], int(r.integers(1, 5)))) for _ in range(int(r.integers(20, 200)))]
        bad, junk = i % 5 == 0, i % 7 == 0
        if bad:
            for _ in range(4):
                words.insert(int(r.integers(0, len(words))), str(r.choice(["vileword", "hatefully", "grosspot"])))
        if junk:
            words = [w + "$#%" for w in words]
        rows.append((i, " ".join(words), lang, "s", 0))
        lab.append((i, int(not junk), int(bad)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(lab, "doc_id long, quality int, toxic int"), pd.DataFrame(lab, columns=["doc_id", "quality", "toxic"]).merge(pd.DataFrame([(r[0], r[2]) for r in rows], columns=["doc_id", "lang"]))


def test_held_out_accuracy(corpus):
    docs, labels, truth = corpus
    for df, column, m, k in ((toxicity.toxicity(docs, labels), "toxic", 3, 1), (quality.quality(docs, labels), "quality", 4, 2)):
        got = df.toPandas().merge(truth, on="doc_id")
        assert (got.held_out == got.doc_id.map(lambda i: crc(i, m) == k)).all() and got.score.between(0, 1).all()
        assert ((got.score >= 0.7).astype(int) == got.predicted).all()
        assert (got[got.held_out].predicted == got[got.held_out][column]).mean() > 0.93
    got = langid.language(docs).toPandas().merge(truth, on="doc_id")
    assert (got.held_out == got.doc_id.map(lambda i: crc(i, 5) == 0)).all()
    assert (got[got.held_out].lang_pred == got[got.held_out].lang).mean() > 0.98


def test_classifiers_take_odd_and_empty_input(spark, odd, empty, labels):
    for f in (toxicity.toxicity, quality.quality):
        got = f(odd, labels)
        assert got.count() == len(ODD) and f(empty, labels).count() == 0 and f(odd, labels.limit(0)).count() == len(ODD)
        assert all(0 <= r.score <= 1 for r in got.collect())
    got = langid.language(odd).collect()
    assert len(got) == len(ODD) and {r.lang_pred for r in got if r.doc_id in (3, 4)} == {"und"}
    marks = spark.createDataFrame([(20, "½ ² Ⅷ ①", "en", "a", 1), (21, "12 _ !", "en", "a", 1), (22, "é", "en", "a", 1)], SCHEMA)
    assert {r.doc_id: r.lang_pred == "und" for r in langid.language(odd.unionByName(marks)).collect() if r.doc_id in (20, 21, 22)} == {20: True, 21: True, 22: False}
    assert langid.language(empty).count() == 0
    assert toxicity.keep_clean(odd, labels.limit(0)).columns == odd.columns
