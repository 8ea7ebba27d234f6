"""Periodic runs, SentencePiece and importance resampling against brute force and the library."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodewell.llm import importance, periodic, sentence_pieces
from lodewell.llm.periodic import Params, find_runs

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def plain_runs(r, min_words, min_periods):
    n, out = len(r), []
    for q in range(1, n // min_periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and r[j] == r[j + q]:
                j += 1
            size = j + q - i
            if j > i and size >= max(min_words, min_periods * q) and all(any(r[k] != r[k + d] for k in range(i, i + size - d)) for d in range(1, q)):
                out.append((i, size, q))
            i = j + 1
    return sorted(out)


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_runs_equal_brute_force(letters):
    dice, seen = random.Random(letters), 0
    for _ in range(700):
        r = [dice.randrange(letters) for _ in range(dice.randint(0, 60))]
        if dice.random() < 0.5 and len(r) > 4:
            a = dice.randrange(len(r))
            p = 1 + (len(r) - a) // dice.randint(3, 8)
            r = r[:a] + [r[a + (i - a) % p] for i in range(a, len(r))]
        for words, periods in ((3, 3), (8, 3), (4, 4)):
            found = find_runs(np.array(r, np.int64), Params(words, periods))
            assert found == plain_runs(r, words, periods), r
            seen += len(found)
    assert seen > 100


def test_runs_of_hard_words():
    ones, thue = np.zeros(200_000, np.int64), np.array([bin(i).count("1") & 1 for i in range(100_000)])
    assert find_runs(ones) == [(0, 200_000, 1)]
    assert find_runs(np.tile(np.arange(500), 100)) == [(0, 50_000, 500)]
    assert find_runs(thue) == []  # no word is repeated three times over
    a, b = [0], [0, 1]
    while len(b) < 3000:
        a, b = b, b + a
    assert find_runs(np.array(b[:3000])) == plain_runs(b[:3000], 24, 3)
    with pytest.raises(ValueError):
        find_runs(ones, Params(24, 2))


def test_run_rows(spark, docs, rows, clashing, empty):
    for source in (docs, clashing):
        got = Counter(tuple(r) for r in periodic.run_digests(source).collect())
        want = Counter()
        for doc_id, text, *_ in rows:
            w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())
            n, h = len(w), zlib.crc32(str(doc_id).encode())
            if n and h % 10 == 0:
                g = h // 10
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            found = plain_runs(w, 24, 3)
            best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
            kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + size for s, size, q in found)]
            lines = "".join(f"{s},{size},{q}\n" for s, size, q in found)
            want[(doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())] += 1
        assert got == want
    assert periodic.run_digests(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b " * 50), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in periodic.periodic_runs(odd).collect()}
    assert [tuple(r) for r in got[None]["runs"]] == [(0, 100, 2)] and got[None]["collapsed"] == "a b"
    assert got[3]["runs"] == [] and got[3]["collapsed"] == ""


def variant(rule=None, user=False, no_bytes=False, **settings):
    """The model with another normaliser, or with symbols of a user."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(MODEL, "rb") as f:
        model.ParseFromString(f.read())
    if rule:
        other = pb.ModelProto()
        other.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
        model.normalizer_spec.precompiled_charsmap = other.normalizer_spec.precompiled_charsmap
    for k, v in settings.items():
        setattr(model.normalizer_spec, k, v)
    if user:
        model.pieces.add(piece="b cd", type=4)
        model.pieces.add(piece="①2", type=4)
    if no_bytes:
        model.trainer_spec.byte_fallback = False
        for p in model.pieces:
            p.type = 5 if p.type == 6 else p.type
    return model.SerializeToString()


@pytest.mark.parametrize(
    "settings",
    [{}, {"remove_extra_whitespaces": True}, {"rule": "nfkc"}, {"rule": "nmt_nfkc", "remove_extra_whitespaces": True}, {"rule": "nmt_nfkc_cf", "add_dummy_prefix": False}, {"rule": "nmt_nfkc", "no_bytes": True}, {"rule": "nfkc", "user": True}],
)
def test_pieces_and_spans_equal_the_library(settings):
    import sentencepiece

    proto = variant(**settings)
    own, library = sentence_pieces.Encoder(proto=proto), sentencepiece.SentencePieceProcessor(model_proto=proto)
    dice = random.Random(str(settings))
    letters = list("ab cd  e\t\n.,1 2") + list("é▁ﬁ①Å…😀한ｱﾞ株㍿\x00½🏴ሴ\ŕ 　​")
    texts = ["", " ", "   ", "a", " a", "a ", "▁", "  a  b  "] + ["".join(dice.choice(letters) for _ in range(dice.randint(0, 30))) for _ in range(1500)]
    for text in texts:
        ids, starts, stops = own.encode(text)
        assert ids.tolist() == library.encode(text, add_eos=True), text
        assert own.decode(ids) == library.decode(ids.tolist())
        spans = [(p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]
        assert list(zip(starts.tolist(), stops.tolist(), strict=True))[:-1] == spans, text


@pytest.mark.parametrize("size", [1, 7, 64])
def test_pieces_of_parts(size, monkeypatch):
    own = sentence_pieces.Encoder(MODEL)
    dice = random.Random(size)
    for _ in range(100):
        text = "".join(dice.choice(["word", " ", "  ", "▁", "\n", "x1", "é", "😀"]) for _ in range(60))
        monkeypatch.setattr(sentence_pieces, "PART", 1 << 18)
        whole = own.encode(text)
        monkeypatch.setattr(sentence_pieces.Encoder, "parts", lambda self, t, size=size, f=sentence_pieces.Encoder.parts: f(self, t, size))
        assert all(np.array_equal(a, b) for a, b in zip(whole, own.encode(text), strict=True))
        monkeypatch.undo()


@pytest.mark.parametrize("unit", [" ", "\n", "a", "株", "1", "a b "])
def test_pieces_of_very_long_texts(unit):
    own = sentence_pieces.Encoder(MODEL)
    text = unit * (1_000_000 // len(unit))
    ids, _, stops = own.encode(text)
    assert ids.tolist() == own.decoder.encode(text, add_eos=True) and own.decode(ids) == text and stops[-1] == len(text.encode())


def test_piece_rows(docs, rows, clashing, empty, spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for source in (docs, clashing):
        got = Counter(tuple(r)[:4] for r in sentence_pieces.encode_documents(source, MODEL, digests=True).collect())
        ids = [(doc_id, library.encode(text or "", add_eos=True)) for doc_id, text, *_ in rows]
        assert got == Counter((d, len(i), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(library.decode(i).encode()).hexdigest()) for d, i in ids)
    assert sentence_pieces.encode_documents(empty, MODEL).count() == 0
    one = sentence_pieces.encode_documents(spark.createDataFrame([(None, "é x")], "doc_id long, text string"), MODEL).first()
    assert one["decoded"] == "é x" and one["stops"][-1] == 4 and one["doc_id"] is None


def plain_sample(docs, target, longest=1, buckets=10_000):
    def grams(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        return w, [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    s, t = Counter(bucket(f) for _, x in docs for f in grams(x)[1]), Counter(bucket(f) for x in target for f in grams(x)[1])
    big_s, big_t = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in s}
    out = []
    for doc_id, text in docs:
        w, f = grams(text)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)])
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0]))
    rank = {id(r): i + 1 for i, r in enumerate(able[: len(able) * 10 // 100])}
    return Counter((*r[:4], rank.get(id(r))) for r in out)


@pytest.mark.parametrize("longest", [1, 2])
def test_sample_equals_a_plain_one(spark, longest):
    dice = random.Random(1)
    docs = [(i, None if i % 40 == 0 else " ".join(dice.choice(["The", "fox", "É", "a1", "zoo", "b-c", "X_y"]) + dice.choice(["", ",", "!"]) for _ in range(dice.randint(0, 60)))) for i in range(300)]
    target = ["the zoo zoo", None, "fox a1"]
    own = importance.Params(longest=longest)
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    goal = spark.createDataFrame([(x,) for x in target], "text string")
    assert Counter(tuple(r) for r in importance.resample(table, goal, own).collect()) == plain_sample(docs, target, longest)


def test_sample_edges(spark, docs, rows, clashing, empty):
    goal = spark.createDataFrame([("one two",)], "text string")
    ids = Counter(r[0] for r in rows)
    for source in (docs, clashing, docs.withColumn("bucket", F.lit(1))):
        assert Counter(r["doc_id"] for r in importance.resample(source, goal).collect()) == ids
    assert importance.resample(empty, goal).count() == 0
    assert importance.resample(docs, goal.where("false")).count() == len(rows)
    same = spark.createDataFrame([(None, "a " * 30)] * 20 + [(1, "b " * 30)] * 20, "doc_id long, text string")
    got = importance.resample(same, goal).collect()
    assert len(got) == 40 and sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4]


def test_matrix_is_written_in_sparse_rows(spark, docs):
    matrix = importance.count_matrix(docs)
    for r in matrix.collect():
        assert r["offsets"][0] == 0 and r["offsets"][-1] == len(r["buckets"]) == len(r["counts"]) and len(r["offsets"]) == len(r["ids"]) + 1
    assert matrix.inputFiles()
