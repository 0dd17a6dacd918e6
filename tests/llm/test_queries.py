"""Every registered query on the smallest tables: against its SQL, or against a plain version of what it returns."""

import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash

from weftline.llm import bpe, langid, quality, registry, simhash, token_counts, toxicity
from weftline.llm.common import labelled_sample

from .test_ops import water_fill

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
QUERIES = registry.queries()
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


def rows(spark, name):
    return QUERIES[name](spark, SF).collect()


def raw(r):
    return (r.text or "").encode()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    want = con.sql(registry.oracle_sql()[name])
    assert sorted(map(repr, (tuple(r[c] for c in want.columns) for r in rows(spark, name)))) == sorted(map(repr, want.fetchall()))


def test_op1(spark, docs):
    got = {r.doc_id: r for r in rows(spark, "op1_mixing")}
    size = {r.doc_id: len(WORD.findall(raw(r))) for r in docs}
    source = {r.doc_id: r.source for r in docs}
    total = {}
    for i, n in size.items():
        total[source[i]] = total.get(source[i], 0) + n
    order = sorted(total, key=lambda s: (s is None, s))
    target = water_fill(total, {s: k % 3 + 1.0 for k, s in enumerate(order)})
    taken = dict.fromkeys(total, 0)
    for i, r in got.items():
        assert (r.size, r.source_size) == (size[i], total[source[i]]) and r.target == pytest.approx(target[source[i]])
        assert 0 <= r.taken <= 3 * r.size
        taken[source[i]] += r.taken
    assert len(got) == len(docs)
    for s in total:
        assert abs(taken[s] - target[s]) < max(n for i, n in size.items() if source[i] == s)


def test_op2_and_op7(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    ids = lambda t: library.encode(t, add_special_tokens=False).ids
    sha = lambda b: hashlib.sha256(b).hexdigest()
    seven = {r.doc_id: r for r in rows(spark, "op7_bpe")}
    two = {r.doc_id: r for r in rows(spark, "op2_token_counts")}
    for r in docs:
        t = r.text or ""
        want, edited = ids(t), t
        got = seven[r.doc_id]
        assert (got.n_tokens, got.ids_sha256) == (len(want), sha(np.array(want, "<u4").tobytes()))
        assert got.decoded_sha256 == sha(library.decode(want, skip_special_tokens=False).encode())
        for start, end, new in token_counts.standard_edits(len(t)):
            edited = edited[: min(start, len(edited))] + new + edited[min(end, len(edited)) :]
        assert (two[r.doc_id].n_tokens, two[r.doc_id].n_tokens_edited) == (len(want), len(ids(edited)))


def majority(text: bytes) -> int:
    """The fingerprint by its contract: bits set in over half of the XXH64 of all four-word shingles, repeats included."""
    words = WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in text))
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_fingerprints_by_contract():
    for t in (b"", b" \n", b"One two", b"a b c d", b"A b C d e", b"x y z w " * 9, "é ß\x0b日本 語 Z z".encode()):
        assert simhash.fingerprint(t) == majority(t)


def test_op3(spark, docs):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in rows(spark, "op3_simhash")}
    fp = {r.doc_id: majority(raw(r)) for r in docs}
    comp = {i: i for i in fp}
    changed = True
    while changed:
        changed = False
        for i in fp:
            low = min(comp[j] for j in fp if (fp[i] ^ fp[j]).bit_count() <= 4)
            changed |= low < comp[i]
            comp[i] = min(comp[i], low)
    assert got == {i: (f"{fp[i]:016x}", comp[i]) for i in fp}


def test_op6(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x, ids = np.stack(table.embedding).astype(float), table.vec_id.to_numpy()
    got, hit = rows(spark, "op6_ann"), 0
    asked = ids[ids % 100 == 0]
    for q in asked:
        own = int(np.flatnonzero(ids == q)[0])
        d = np.sqrt(((x - x[own]) ** 2).sum(axis=1))
        d[own] = np.inf
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 11))
        assert np.allclose([m[2] for m in mine], [d[np.flatnonzero(ids == m[1])[0]] for m in mine], rtol=1e-12)
        hit += len({m[1] for m in mine} & set(ids[np.lexsort((ids, d))[:10]].tolist()))
    assert len(got) == 10 * len(asked) and hit >= 0.9 * len(got)


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m


def test_op4(spark, docs):
    model = toxicity.train(labelled_sample(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"), "toxic", 3, 1, toxicity.PER_CLASS))
    plain, toxic = model.compressors()
    got = {r.doc_id: r for r in rows(spark, "op4_toxicity")}
    for r in docs:
        d = [len(plain(w)) - len(toxic(w)) for w in toxicity.windows((r.text or "").lower().encode())] or [0]
        x = (np.array([max(d), sum(d), sum(d) / len(d) ** 0.5, sum(v >= 3 for v in d), np.log(1 + len(d))]) - model.mean) / model.scale
        p = 1 / (1 + np.exp(-(x @ model.weights[:-1] + model.weights[-1])))
        mine = got[r.doc_id]
        assert mine.score == pytest.approx(p, abs=1e-9) and mine.predicted == int(mine.score >= 0.7) and mine.held_out == (crc(r.doc_id, 3) == 1)


def test_op8(spark, docs):
    model = langid.BackoffModel(langid.training_sample(spark.read.parquet(f"{SF}/documents.parquet")))
    got = {r.doc_id: r for r in rows(spark, "op8_langid")}
    for r in docs:
        words = langid.letters((r.text or "").lower())
        mine = got[r.doc_id]
        assert mine.held_out == (crc(r.doc_id, 5) == 0)
        if not words:
            assert (mine.lang_pred, mine.score) == ("und", 0.0)
            continue
        total = sum(np.asarray(model.word[w] if w in model.word else model.unseen(w), float) for w in words)
        assert mine.lang_pred == model.langs[int(np.argmax(total))]
        mean = total / len(words) * min(len(words), langid.EVIDENCE)
        assert mine.score == pytest.approx(1 / np.exp(mean - mean.max()).sum(), abs=1e-6)


def test_op10(spark, docs):
    model = quality.train(labelled_sample(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"), "quality", 4, 2, quality.PER_CLASS))
    got = {r.doc_id: r for r in rows(spark, "op10_quality")}
    e, w, b, v, c = (model.p[k].astype(float) for k in "ewbvc")
    for r in docs:
        t = raw(r)
        pooled = []
        for at in quality.chunk_starts(len(t)).tolist():
            chunk = t[at : at + quality.CHUNK].ljust(quality.CHUNK, b"\0")
            tops = np.stack([e[list(chunk[p : p + quality.WIDTH])].reshape(-1) for p in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE)]) @ w
            pooled.append(np.maximum(np.max(tops, axis=0) + b, 0))
        z = np.r_[np.mean(pooled, axis=0), np.max(pooled, axis=0)] @ v + c[0]
        mine = got[r.doc_id]
        assert mine.score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)
    for r in docs:
        assert got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.7) and got[r.doc_id].held_out == (crc(r.doc_id, 4) == 2)
