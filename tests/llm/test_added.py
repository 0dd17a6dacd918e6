"""Pieces with spans, whitening and importance resampling against the public library, numpy and brute force."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece

from weftline.llm import importance, pieces, whitening

from .test_ops import ODD, SCHEMA

SF = "/root/testdata/sf0.001"
public = pytest.importorskip("public_tokenizers")
MODEL = public.path("piece_bpe_32k.model")
PARTS = ["a", "b", " ", "  ", "▁", "\n", "é", "漢", "\0", "ﬁ", "①", "　", "\xa0", "1", "The", "ing", "🙂", "é", "​", "ｶﾞ", "¨", "\t", "<s>", "<0x41>", "Ａ", "�", "̀"]


def texts(n, seed=3):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 30))) for _ in range(n)]


# ---- pieces ----
@pytest.fixture(scope="module")
def mapped_models(tmp_path_factory):
    """The model with the character maps of the library's own rules, since its own rule maps nothing."""
    from sentencepiece import sentencepiece_model_pb2

    out = []
    for rule, squeeze, prefix in (("nmt_nfkc", False, True), ("nfkc", True, True), ("nmt_nfkc_cf", True, False)):
        own, normal = sentencepiece_model_pb2.ModelProto(), sentencepiece_model_pb2.ModelProto()
        with open(MODEL, "rb") as f:
            own.ParseFromString(f.read())
        normal.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
        spec = own.normalizer_spec
        spec.precompiled_charsmap, spec.remove_extra_whitespaces, spec.add_dummy_prefix = normal.normalizer_spec.precompiled_charsmap, squeeze, prefix
        path = tmp_path_factory.mktemp("models") / f"{rule}.model"
        path.write_bytes(own.SerializeToString())
        out.append(str(path))
    return out


def test_pieces_ids_spans_and_text(mapped_models):
    for path in (MODEL, *mapped_models):
        theirs, ours = sentencepiece.SentencePieceProcessor(model_file=path), pieces.codec(path)
        for t in texts(1500) + ["", " ", "x" * 5000, "ab" * 4000, " " * 100, "a" + " " * 99 + "b", "  a  b  "]:
            ids, at = ours.encode(t.encode())
            want = theirs.encode(t, return_type="proto").pieces
            assert ids.tolist() == [p.id for p in want]
            assert list(zip(at[:-1].tolist(), at[1:].tolist())) == [(p.begin, p.end) for p in want]
            assert ours.decode(ids).decode() == theirs.decode(ids.tolist())


def test_pieces_decode_any_ids():
    theirs, ours, r = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.codec(None), random.Random(1)
    for _ in range(1500):
        ids = [r.choice([r.randrange(32000), r.randrange(300), r.randrange(3, 259), 29871, 1, 0]) for _ in range(r.randint(0, 12))]
        assert ours.decode(np.array(ids, np.int64)).decode() == theirs.decode(ids)


def test_pieces_in_long_segments_and_bad_bytes():
    theirs, ours = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.codec(None)
    r = random.Random(2)
    long = "".join(r.choice("etaoinsh") for _ in range(200_000))
    assert ours.encode(long.encode())[0].tolist() == theirs.encode(long)
    assert ours.encode(b"a\xff\xe6\xbcb")[0].tolist() == theirs.encode("a���b")


def test_piece_tables(spark):
    theirs = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = spark.createDataFrame(ODD + [(10, "word " * 400_000, None, None, 0)], SCHEMA)
    clash = docs.selectExpr("*", "1 as ids", "2 as begins", "text as t")
    want = sorted(((r[0] is None, r[0] or 0), theirs.encode(r[1] or "")) for r in docs.collect())
    got = pieces.encode(clash)
    assert sorted(((r.doc_id is None, r.doc_id or 0), list(r.ids)) for r in got.collect()) == want
    back = {r.doc_id: r.text for r in pieces.decode(got).collect()}
    assert back[9] == ODD[-1][1] and back[10] == "word " * 400_000
    for r in got.where("doc_id = 9").collect():
        assert b"".join(ODD[-1][1].encode()[a:b] for a, b in zip(r.begins, r.ends)).decode() == ODD[-1][1]
    assert pieces.encode(docs.limit(0)).count() == 0 and pieces.round_trip(docs.limit(0)).count() == 0
    assert pieces.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).collect() == [(1, None)]


def test_pieces_refuse_other_models(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    own = sentencepiece_model_pb2.ModelProto()
    with open(MODEL, "rb") as f:
        own.ParseFromString(f.read())
    own.trainer_spec.model_type = 1
    (tmp_path / "m").write_bytes(own.SerializeToString())
    with pytest.raises(ValueError):
        pieces.codec(str(tmp_path / "m"))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_op11(spark):
    theirs = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in pieces.op11_pieces(spark, SF).collect()}
    assert set(got) == set(docs)
    for i, t in docs.items():
        ids = theirs.encode(t)
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(theirs.decode(ids).encode()).hexdigest()
        ends = [p.end for p in theirs.encode(t, return_type="proto").pieces]
        assert got[i].spans_sha256 == hashlib.sha256(np.array([0, *ends], "<i4").tobytes()).hexdigest()


# ---- whitening ----
@pytest.mark.parametrize("d", [1, 3, 17, 64, 200])
def test_leading_pairs(d):
    r = np.random.default_rng(d)
    q, e = np.linalg.qr(r.standard_normal((d, d)))[0], np.sort(r.uniform(0.5, 1.5, d))[::-1] * 70
    if d == 17:
        e[5:] = 0
    if d == 64:
        e[:20] = e[0]  # a pair of many equal values
    a = (q * e) @ q.T
    values, u = whitening.leading(lambda w: a @ w, d, 16)
    assert np.abs(values - e[: len(values)]).max() < 1e-11 and np.abs(a @ u - u * values).max() < 1e-10
    assert np.abs(u.T @ u - np.eye(len(values))).max() < 1e-12


def reference(x, components=16):
    """Plain eigh over the distinct rows."""
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    k = int((e[:components] > 1e-9 * e[0]).sum())
    return n, s, e, u[:, :k], (x - s / n) @ u[:, :k] / np.sqrt(e[:k])


def compare(got, ids, x):
    n, s, e, u, want = reference(x)
    k = u.shape[1]
    rows = {(r.vec_id, r.component): r for r in got}
    assert len(got) == len(rows) == len(ids) * k
    mine = np.array([[rows[i, c + 1].whitened for c in range(k)] for i in ids])
    sign = np.sign(np.sum(mine * want, axis=0))
    assert np.abs(mine * sign - want).max() < 1e-6
    for j, i in enumerate(ids):
        r = rows[i, 1]
        assert (r.n, r.deviation) == (n, sum((n * int(v) - int(t)) ** 2 for v, t in zip(x[j], s)))
    for c in range(k):
        assert rows[ids[0], c + 1].explained == pytest.approx(e[c] / e.sum(), rel=1e-9)
    assert max(r.identity_error for r in got) < 1e-9


def test_whitening_with_odd_rows(spark):
    r = np.random.default_rng(5)
    v = (r.standard_normal((80, 6)) * [9, 5, 3, 2, 1, 0.5]).astype(np.float32)
    v[:, 5] = 0.25  # a dimension without variance: no component for it
    rows = [(i, v[i % 60].tolist(), "x") for i in range(80)]  # 20 copies under ids of their own
    bad = [(100, None, "x"), (101, [1.0] * 5 + [None], "x"), (102, [1.0] * 5 + [float("nan")], "x"), (103, [float("inf")] * 6, "x"), (104, [1.0], "x"), (105, [], "x")]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, n string").repartition(5)
    x = np.floor(64 * np.array([q[1] for q in rows], np.float32).astype(float)).astype(np.int64) + 1_000_000
    compare(whitening.whiten(df).collect(), list(range(80)), x)


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    two = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0]), (None, [3.0, 2.0])], schema)).collect()
    assert sorted(abs(r.whitened) for r in two) == pytest.approx([1, 1, 1]) and all(r.explained == pytest.approx(1.0) for r in two)
    far = whitening.whiten(spark.createDataFrame([(1, [3e38]), (2, [-3e38])], schema)).collect()
    assert [r.deviation for r in far] == [None, None] and sorted(r.whitened for r in far) == pytest.approx([-1, 1])


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_op12(spark):
    table = sorted(spark.read.parquet(f"{SF}/embeddings.parquet").collect(), key=lambda r: r.vec_id)
    x = np.floor(64 * np.array([r.embedding for r in table], np.float64)).astype(np.int64) + 1_000_000
    compare(whitening.op12_whitening(spark, SF).collect(), [r.vec_id for r in table], x)


# ---- importance ----
def own_words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))


def own_runs(text):
    w = own_words(text)
    return Counter(zlib.crc32(b" ".join(w[i : i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))


def test_run_crcs(monkeypatch):
    r = random.Random(1)
    docs = ["", "  ", "Hello World foo", "".join(r.choice("abC 1é.\n") for _ in range(3000)), "x" * 70_000 + " yy " + "z" * 200, " ".join(f"w{i % 977}" for i in range(9000))]
    for size, cut in ((1 << 16, 1 << 20), (7, 11), (1, 1)):
        monkeypatch.setattr(importance, "WORDS", size)
        monkeypatch.setattr(importance, "SLICE", cut)
        got = [Counter() for _ in docs]
        for text, crc in importance.runs([t.encode() for t in docs]):
            for i, c in zip(text.tolist(), crc.tolist()):
                got[i][c] += 1
        assert got == [own_runs(t) for t in docs]


def resampled(docs, target):
    """doc_id, n_features, weight, score, rank of (doc_id, text) rows."""
    runs = [own_runs(t) for _, t in docs]
    s, t = Counter(), Counter()
    for c in runs:
        for crc, n in c.items():
            s[crc % 10000] += n
    for text in target:
        for crc, n in own_runs(text).items():
            t[crc % 10000] += n
    all_s, all_t = sum(s.values()) + 10000.0, sum(t.values()) + 10000.0
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * all_s / ((s[b] + 1.0) * all_t))) for b in s}
    out = []
    for (i, text), c in zip(docs, runs):
        weight = sum(n * gain[crc % 10000] for crc, n in c.items())
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, sum(c.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(own_words(text))])
    able = sorted((o for o in out if o[5] >= 20), key=lambda o: (-o[3], o[0] is None, o[0]))
    for n, o in enumerate(able[: 5 * len(able) // 100], 1):
        o[4] = n
    return sorted((tuple(o[:5]) for o in out), key=repr)


def test_importance_with_odd_rows(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["alpha", "Beta", "gamma", "delta-echo", "ζ"]) for _ in range(r.randint(0, 60)))) for i in range(150)]
    rows += [(x[0], x[1]) for x in ODD] + [(3, rows[3][1])] * 3 + [(200, "omega psi " * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as bucket", "2 as score", "3 as n_words").repartition(4)
    target = spark.createDataFrame([(1, "alpha beta omega"), (2, None), (3, "gamma " * 30)], "item_id long, text string")
    key = ["doc_id", "n_features", "weight", "score", "rank"]
    got = importance.resample(docs, target).select(key).collect()
    assert sorted(map(tuple, got), key=repr) == resampled(rows, ["alpha beta omega", None, "gamma " * 30])
    drawn = {g.doc_id for g in got if g.rank}
    assert {q.doc_id for q in importance.drawn(docs, target).collect()} == drawn
    alone = importance.resample(docs, target.limit(0)).select(key).collect()
    assert sorted(map(tuple, alone), key=repr) == resampled(rows, [])
    assert importance.resample(docs.limit(0), target).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_op13(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = importance.op13_importance(spark, SF).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=repr) == resampled(docs, target)


# ---- samples ----
class Counting:
    """What passes to the driver in collected rows."""

    def __init__(self, monkeypatch):
        from pyspark.sql.classic.dataframe import DataFrame

        self.size, plain = 0, DataFrame.collect

        def collect(df):
            rows = plain(df)
            self.size += sum(len(v) for r in rows for v in r if isinstance(v, (str, bytes, bytearray)))
            return rows

        monkeypatch.setattr(DataFrame, "collect", collect)


def test_samples_of_very_long_texts_are_bounded_before_they_reach_the_driver(spark, monkeypatch):
    from weftline.llm import common, langid

    big = 10 << 20
    docs = spark.range(24).selectExpr("id as doc_id", f"repeat(chr(97 + cast(id % 20 as int)), if(id % 3 = 0, {big}, 1000 + cast(id as int))) as text", "if(id % 2 = 0, 'en', 'de') as lang")
    docs = docs.unionByName(docs.where("doc_id in (4, 7)"))  # repeated rows
    labels = spark.range(24).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    went = Counting(monkeypatch)
    got = common.labelled_sample(docs, labels, "toxic", 3, 1, 1000, max_bytes=25 << 20)
    assert went.size <= 26 << 20 and sum(len(t) for t, _ in got) <= 25 << 20
    assert sum(len(t) == big for t, _ in got) == 2
    able = [i for i in range(24) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert sorted(len(t) for t, _ in got if len(t) < big) == sorted(1000 + i for i in able if i % 3)
    went.size = 0
    monkeypatch.setattr(langid, "SAMPLE_BYTES", 15 << 20)
    got = langid.training_sample(docs)
    assert went.size <= 16 << 20
    able = [i for i in range(24) if zlib.crc32(str(i).encode()) % 5 != 0]
    assert sorted(len(t) for t, _ in got if len(t) < big) == sorted(1000 + i for i in able + [i for i in (4, 7) if i in able] if i % 3)
    assert sum(len(t) == big for t, _ in got) == 1


def test_dictionary_of_too_few_samples_keeps_them_all():
    from weftline.llm import toxicity

    assert toxicity.dictionary([b"one", b"two"], 4, 8, 6) == b"onetwo"
