"""The operators of the training-data subpackage: brute force, round trips and awkward rows."""

import collections
import datetime
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from genomeframe.llm import (
    digests,
    interpolation,
    licences,
    mixing,
    order_minhash,
    pieces,
    progressive,
    pseudonyms,
    token_files,
    toxicity,
)
from genomeframe.llm.queries import ORACLES, QUERIES, tokenizer
from genomeframe.llm.spans import slices
from genomeframe.session import shared_folder

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, ids string"
LONG = "word " * 30_000 + "x" * 50_000
AWKWARD = [
    (1, None, None, None, None, "a", "b"),
    (2, "", "en", "s", 0, None, None),
    (3, "one", "en", "s", 3, "a", "b"),
    (3, "one", "en", "s", 3, "a", "b"),
    (4, " \n\t ", None, "t", 4, "a", "b"),
    (5, "Ünïcode ▁ 日本 \U0001f600\x00 é́ ﬁ\r\nMIT", "de", None, 1, "a", "b"),
    (6, LONG, "en", "t", 200_000, "a", "b"),
    (7, LONG, "en", "s", 200_000, "a", "b"),
    (None, "no id here at all", "en", "s", 1, "a", "b"),
    (None, None, None, None, None, None, None),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text for r in rows}


def tokens(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), None]


def training(doc_id):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 5 != 1


# Deleted interpolation -----------------------------------------------------


def brute_counts(rows):
    """Counts of training words, and of pairs of a word and the one before it (the end before the first)."""
    single, pair = collections.Counter(), collections.Counter()
    for doc_id, text in rows:
        if training(doc_id):
            words = tokens(text)
            single.update(words)
            pair.update(zip([None, *words], words))
    return single, pair


def test_mixed_scores_against_counting(spark, texts, monkeypatch):
    """Every document's score from plain counts, under the weights that were learned."""
    learned, learn = [], interpolation.learn_weights
    monkeypatch.setattr(interpolation, "learn_weights", lambda *a: learned.append(learn(*a)) or learned[-1])
    rows = {**texts, None: "no id", 10**6: "", 10**6 + 1: "Only unknownword!"}
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r.doc_id: r.score for r in interpolation.score(docs, 20_000, 30_000).collect()}
    single, pair = brute_counts(rows.items())
    total, distinct = sum(single.values()), len(single)
    for doc_id, text in rows.items():
        want, before = 0.0, None
        for word in tokens(text):
            seen = single[before]
            w2, w1, w0 = learned[0][seen.bit_length()]
            p = w2 * (pair[before, word] / seen if seen else 0) + w1 * single[word] / total + w0 / (distinct + 1)
            want, before = want + math.log10(p), word
        assert got[doc_id] == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("chunk_bytes,bucket_bytes", [(4 << 20, 8 << 20), (3_000, 1_000)])
def test_interpolation_against_counting(spark, texts, chunk_bytes, bucket_bytes):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in interpolation.score(docs, chunk_bytes, bucket_bytes).collect()}
    counts, _ = brute_counts(texts.items())
    total, distinct = sum(counts.values()), len(counts)
    assert len(got) == len(texts)
    for doc_id, text in texts.items():
        words = tokens(text)
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in words)
        row = got[doc_id]
        assert (row.n_tokens, row.train_tokens) == (len(words), total)
        assert row.n_known == sum(counts[w] > 0 for w in words)
        assert row.held_out == (not training(doc_id))
        assert row.base_score == pytest.approx(base, rel=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_interpolation_is_one_model_for_any_chunks(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    one = {r.doc_id: r.score for r in interpolation.score(docs).collect()}
    other = {r.doc_id: r.score for r in interpolation.score(docs.repartition(5), 2_000, 900).collect()}
    assert other == pytest.approx(one, rel=1e-6)


def test_weights_fit_planted_mixture():
    rng = np.random.default_rng(5)
    n = 200_000
    import pandas as pd

    p2 = rng.choice([0.0, 0.25, 0.5], n)
    source = rng.random(n) < 0.7 * (p2 > 0)
    cell2 = np.where(p2 > 0, -4 * np.log2(np.maximum(p2, 0.1)), interpolation.CELLS - 1).astype(int)
    cell2[source] = 4
    cell = (3 * interpolation.CELLS + cell2) * interpolation.CELLS + 40
    frame = pd.DataFrame({"cell": cell, "n": 1, "log2": np.where(cell2 == 4, np.log(0.5), np.log(0.25)), "log1": np.log(2.0**-10)})
    frame = frame.groupby("cell", as_index=False).sum()
    weights = interpolation.learn_weights(frame, 1e-6)
    assert weights.sum(axis=1) == pytest.approx(np.ones(interpolation.CONTEXTS))
    assert weights[3, 0] == pytest.approx(2 / 3, abs=0.02)  # a third of the events has no bigram


# Progressive images --------------------------------------------------------


@pytest.mark.parametrize("size", [64, 128, 384, 448, 6400, 64 * 5000])
def test_payload_round_trip(size):
    payload = os.urandom(size)
    image = progressive.ProgressiveImage(progressive.encode_payload(payload, size - 5))
    assert image.payload() == (payload, size - 5)
    assert image.rgb().shape == (image.height, image.width, 3)


def _direct_samples(block, quant):
    """A block's samples by the defining sum."""
    out = np.zeros((8, 8))
    natural = np.zeros(64)
    natural[progressive.ZIGZAG] = block * quant
    f = natural.reshape(8, 8)
    c = [math.sqrt(0.5)] + [1.0] * 7
    for y in range(8):
        for x in range(8):
            out[y, x] = sum(
                c[u] * c[v] / 4 * f[v, u]
                * math.cos((2 * x + 1) * u * math.pi / 16) * math.cos((2 * y + 1) * v * math.pi / 16)
                for u in range(8) for v in range(8)
            )
    return np.clip(np.rint(out + 128), 0, 255)


class _Writer:
    """A plain scan writer with fixed 8-bit codes, for files with zeros and runs."""

    def __init__(self):
        self.bits = []

    def put(self, value, width):
        self.bits += [value >> i & 1 for i in range(width - 1, -1, -1)]

    def signed(self, value):
        size = abs(value).bit_length()
        self.put(value if value > 0 else value + (1 << size) - 1, size)

    def bytes(self):
        bits = self.bits + [1] * (-len(self.bits) % 8)
        return np.packbits(np.array(bits, dtype=np.uint8)).tobytes().replace(b"\xff", b"\xff\0")


def _plain_file(blocks, width, height, interval=0):
    """A grey progressive file: DC in two steps, AC 1-63 at Al=1 and one refinement."""
    table = lambda kind: progressive._segment(
        0xC4, bytes([kind, *[0] * 7, 255, *[0] * 8, *range(255)])
    )
    n = len(blocks)
    size = interval or n
    head = b"\xff\xd8" + progressive._segment(0xDB, bytes([0, *[3] * 64]))
    head += progressive._segment(0xC2, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([1, 1, 0x11, 0]))
    head += table(0) + table(0x10)
    if interval:
        head += progressive._segment(0xDD, interval.to_bytes(2, "big"))
    out = [head]

    def scan(first, last, high, low, write):
        out.append(progressive._scan_head([1], first, last, high, low))
        for i, a in enumerate(range(0, n, size)):
            if i:
                out.append(bytes([0xFF, 0xD0 + (i - 1) % 8]))
            w = _Writer()
            write(w, blocks[a : a + size])
            out.append(w.bytes())

    def dc(w, part):
        last = 0
        for b in part:
            d = (int(b[0]) >> 1) - last
            last += d
            w.put(abs(d).bit_length(), 8)
            w.signed(d) if d else None

    def shifted(v):
        return int(v) // 2 if v >= 0 else -(-int(v) // 2)

    def ac(w, part):
        for b in part:
            run = 0
            for v in b[1:]:
                v = shifted(v)
                if not v:
                    run += 1
                    continue
                while run > 15:
                    w.put(0xF0, 8)
                    run -= 16
                w.put(run << 4 | abs(v).bit_length(), 8)
                w.signed(v)
                run = 0
            if run:
                w.put(0, 8)

    def refine(w, part):
        for b in part:
            new = [k for k in range(1, 64) if abs(int(b[k])) == 1]
            k = 1
            for at in new:
                pending, zeros = [], 0
                while k < at:
                    if abs(int(b[k])) > 1:
                        pending.append(abs(int(b[k])) & 1)
                    else:
                        zeros += 1
                        if zeros == 16:
                            w.put(0xF0, 8)
                            # the sixteenth zero closes the run
                            for bit in pending:
                                w.put(bit, 1)
                            pending, zeros = [], 0
                    k += 1
                w.put(zeros << 4 | 1, 8)
                w.put(int(b[at] > 0), 1)
                for bit in pending:
                    w.put(bit, 1)
                k = at + 1
            if k < 64:
                w.put(0, 8)
                for j in range(k, 64):
                    if abs(int(b[j])) > 1:
                        w.put(abs(int(b[j])) & 1, 1)

    scan(0, 0, 0, 1, dc)
    scan(1, 63, 0, 1, ac)
    scan(1, 63, 1, 0, refine)

    def dc_low(w, part):
        for b in part:
            w.put(int(b[0]) & 1, 1)

    scan(0, 0, 1, 0, dc_low)
    return b"".join(out) + b"\xff\xd9"


@pytest.mark.parametrize("interval", [0, 2])
def test_decoder_on_files_with_runs(interval):
    rng = np.random.default_rng(1)
    blocks = rng.integers(-40, 40, (6, 64)) * (rng.random((6, 64)) < 0.2)
    blocks[1, 1:] = 0
    blocks[2, 40:] = 1
    image = progressive.ProgressiveImage(_plain_file(blocks, 20, 13, interval))
    assert (image.coefficients[0] == blocks).all()
    plane = image.planes()[0]
    assert plane.shape == (13, 20)
    want = _direct_samples(blocks[0], 3)
    assert np.abs(plane[:8, :8].astype(int) - want).max() <= 1


def test_damaged_files_are_refused():
    file = progressive.encode_payload(b"\1" * 128)
    for bad in (b"", file[:20], file[:-40], b"\xff\xd8\xff\xd9"):
        with pytest.raises(ValueError):
            progressive.ProgressiveImage(bad)


def test_media_query_reads_payload_back(spark, texts):
    for r in QUERIES["op2_progressive"](spark, FOLDER).collect():
        raw = texts[r.doc_id].encode()
        payload = progressive.padded(raw)
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-64:])


# Pseudonyms ----------------------------------------------------------------


def test_feistel_is_a_permutation():
    f = pseudonyms.Feistel(b"key")
    for size in (2, 3, 10, 1000):
        assert sorted(f.permute("d", size, i) for i in range(size)) == list(range(size))
        assert all(f.permute("d", size, f.permute("d", size, i), True) == i for i in range(size))


@pytest.mark.parametrize(
    "text",
    [
        "call +1 (017) 555-7713", "card 4111 1111 1111 1111 or 9807915762804490", "ip 97.51.17.173",
        "2020-02-29 31.12.1999 1/2/2003 13/02/2003 02/28/2003", "ssn 078-05-1120", "GB82 WEST 1234 5698 7654 32",
        'token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"', "mail a.99@mail3.example.com",
        "mail Some.Body@example.org",
    ],
)
def test_pseudonyms_change_and_come_back(text):
    made, count = pseudonyms.Pseudonymiser(b"k").text(text)
    assert count and made != text
    assert pseudonyms.Pseudonymiser(b"k").text("again: " + text)[0] == "again: " + made
    assert pseudonyms.Pseudonymiser(b"k", back=True).text(made)[0] == text


@pytest.mark.parametrize(
    "text",
    [
        "ES91 2100 0418 4502 0005 1332 EUR", "AT61 1904 3002 3457 3201 1234 5678", "IBAN: ES9121000418450200051332 EUR",
        "AB12 4111 1111 1111 1111", "3782 822463 10005", "3056-930902-5904", "2024/03/05", "2024.03.05",
    ],
)
def test_values_beside_others_do_not_stay(text):
    there, back = pseudonyms.Pseudonymiser(b"k"), pseudonyms.Pseudonymiser(b"k", back=True)
    made, count = there.text(text)
    assert count == 1 and made != text and back.text(made)[0] == text
    assert made.endswith(" EUR") or not text.endswith(" EUR")
    assert there.text("2024/13/05") == ("2024/13/05", 0)


def test_a_date_has_one_pseudonym_in_all_formats():
    worker = pseudonyms.Pseudonymiser(b"k")
    for day in ("2024-03-05", "2024-03-25", "1999-12-31"):
        y, m, d = day.split("-")
        made = worker.text(day)[0]
        y2, m2, d2 = made.split("-")
        assert made != day and (int(d2) > 12) == (int(d) > 12)
        written = {f"{m}/{d}/{y}": f"{m2}/{d2}/{y2}", f"{d}.{m}.{y}": f"{d2}.{m2}.{y2}", f"{y}/{m}/{d}": f"{y2}/{m2}/{d2}"}
        if int(d) > 12:
            written |= {f"{d}/{m}/{y}": f"{d2}/{m2}/{y2}", f"{m}-{d}-{y}": f"{m2}-{d2}-{y2}"}
        for text, other in written.items():
            assert worker.text(text)[0] == other


def test_dates_are_permuted():
    """All days of four years have different pseudonyms, which come back."""
    there, back = pseudonyms.Pseudonymiser(b"k"), pseudonyms.Pseudonymiser(b"k", back=True)
    days = [(datetime.date(2020, 1, 1) + datetime.timedelta(i)).isoformat() for i in range(4 * 365)]
    made = [there.text(d)[0] for d in days]
    assert len(set(made)) == len(days) and [back.text(m)[0] for m in made] == days


def test_kinds_without_a_check_can_be_switched():
    run, key = "9807915762804490", "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"
    made = {k: pseudonyms.Pseudonymiser(b"k", others=frozenset(k)) for k in ((), ("run",), ("hex",))}
    assert made[()].text(f"{run} {key}") == (f"{run} {key}", 0)
    assert made["run",].text(run)[0] != run and made["run",].text(key) == (key, 0)
    assert made["hex",].text(key)[0] != key and made["hex",].text(run) == (run, 0)
    found = made["run",].text(run)[0]
    assert pseudonyms.luhn_digit(found[:-1]) != found[-1]
    assert pseudonyms.Pseudonymiser(b"k", back=True, others=frozenset({"run"})).text(found)[0] == run


def test_checks_stay_valid_and_invalid_values_stay():
    worker = pseudonyms.Pseudonymiser(b"k")
    made = worker.text("4111111111111111")[0]
    assert pseudonyms.luhn_digit(made[:-1]) == made[-1]
    made = worker.text("GB82WEST12345698765432")[0]
    assert int("".join(str(int(c, 36)) for c in made[4:] + made[:4])) % 97 == 1
    for same in ("2021-02-29", "999.1.1.1", "000-12-1234", "version 3. 12345", "", "a1" * 5000 + "Z"):
        assert worker.text(same) == (same, 0)


# Pieces --------------------------------------------------------------------


def test_pieces_equal_the_library():
    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    library, model = sentencepiece.SentencePieceProcessor(model_file=path), pieces.piece_model(path)
    rnd = random.Random(1)
    letters = "abcdethe  \n\t▁.,1234éà日本\U0001f600\x00-_/()\"'ABCing"
    cases = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 90))) for _ in range(400)]
    for text in [*cases, "a" * 500, " " * 90, "▁" * 9, LONG[:3000], "x" * 3000]:
        found = model.encode_spans(text)
        ids = [i for i, _, _ in found]
        assert ids == library.encode(text)
        assert model.decode([1, *ids, 2]) == library.decode([1, *ids, 2])
        if found:
            assert found[0][1] == 0 and found[-1][2] == len(text.encode())
            assert all(x[2] == y[1] for x, y in zip(found, found[1:]))


def test_normaliser_follows_the_compiled_map():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    compiled = proto.ModelProto()
    compiled.ParseFromString(library.serialized_model_proto())
    model = pieces.PieceModel(tokenizer("piece_bpe_32k.model"))
    model.map = pieces.CharacterMap(compiled.normalizer_spec.precompiled_charsmap)
    model.squeeze = True
    for text in ["ＡＢ①  x ﬁ  ", " a  b ", "é é", "ガ ｶﾞ", "", "   ", "　x", "ﷺ", "x​y", "x\ty\nz"]:
        normal, source = model.normalise(text.encode())
        assert normal.decode().replace(" ", "▁") == library.normalize(text)
        assert len(source) == len(normal) + 1 and source == sorted(source)
    normal, source = model.normalise("xﬁ".encode())
    assert normal == b" xfi" and source == [0, 0, 1, 1, 4]


def test_piece_digests_are_those_of_the_library(spark, texts):
    """The query over the whole table: ids and decoded texts of the library, spans that cover the text."""
    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    library, model = sentencepiece.SentencePieceProcessor(model_file=path), pieces.piece_model(path)
    got = {r.doc_id: r for r in QUERIES["op4_pieces"](spark, FOLDER).collect()}
    assert set(got) == set(texts)
    for doc_id, text in texts.items():
        row, text = got[doc_id], text or ""
        ids = library.encode(text, add_bos=True, add_eos=True)
        spans = np.array([s[1:] for s in model.encode_spans(text)], dtype="<i8").reshape(-1, 2)
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
        assert row.spans_sha256 == hashlib.sha256(spans.tobytes()).hexdigest()
        assert row.source_bytes == len(text.encode())


def test_alignment_is_one_for_all_models(texts):
    """The alignment of a map without entries equals that of the walk."""
    model = pieces.piece_model(tokenizer("piece_bpe_32k.model"))
    raw = [(t or "").encode() for t in [*texts.values(), "", " ", "a", "é \U0001f600"]]
    for (normal, source), t in zip(model.aligned(raw), raw):
        walked = model.normalise(t)
        assert (normal, source.tolist()) == (walked[0], list(walked[1]))


# Near-duplicates -----------------------------------------------------------


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_banded_alignment_is_the_edit_distance(monkeypatch):
    rnd = random.Random(3)
    for _ in range(400):
        a = [rnd.randint(0, 4) for _ in range(rnd.randint(0, 14))]
        b = list(a) if rnd.random() < 0.5 else [rnd.randint(0, 4) for _ in range(rnd.randint(0, 14))]
        for _ in range(rnd.randint(0, 3)):
            if b:
                b[rnd.randrange(len(b))] = 9
        most, want = rnd.randint(0, 14), plain_distance(a, b)
        for few in (10, 0, 3):
            monkeypatch.setattr(order_minhash, "FEW_EDITS", few)
            got = order_minhash.edit_distance(np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64), most)
            assert got == (want if want <= most else None)


def test_sketches_know_order_and_occurrence():
    hashes = lambda t: order_minhash.word_hashes([t.encode()])[0]
    words = [f"w{i}" for i in range(60)]
    one = order_minhash.sketches(hashes(" ".join(words)))
    swapped = order_minhash.sketches(hashes(" ".join(words[30:] + words[:30])))
    near = order_minhash.sketches(hashes(" ".join(words[:30] + ["x"] + words[31:])))
    assert (one == near).sum() > (one == swapped).sum()
    twice = order_minhash.labelled_shingles(hashes(" ".join(["a"] * 10)))
    assert len(set(twice.tolist())) == 6


def _class_brute(texts):
    found = list(range(len(texts)))
    words = order_minhash.word_hashes([(t or "").encode() for t in texts])
    for i in range(len(texts)):
        for j in range(i):
            if order_minhash.similar(words[i], words[j]):
                old, new = max(found[i], found[j]), min(found[i], found[j])
                found = [new if x == old else x for x in found]
    return found


def test_classes_against_all_pairs(spark):
    rnd = random.Random(7)
    base = [[f"w{rnd.randint(0, 400)}" for _ in range(80)] for _ in range(12)]
    texts = []
    for words in base:
        texts.append(" ".join(words))
        for _ in range(6):
            other = list(words)
            for _ in range(rnd.randint(0, 4)):
                other[rnd.randrange(80)] = "edit"
            texts.append(" ".join(other))
    common = " ".join(f"p{i}" for i in range(60))
    texts += [common + " " + " ".join(f"q{k}_{i}" for i in range(60)) for k in range(25)]
    texts += ["", None, "a b", "A b", "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in order_minhash.classes(docs).collect()}
    want = _class_brute(texts)
    assert got == dict(enumerate(want))
    kept = [r.doc_id for r in order_minhash.one_of_each(docs).collect()]
    assert sorted(kept) == sorted(set(want))


def _classes(spark, monkeypatch, words, keys):
    """Classes of texts (word lists) that share just the given sketches, the rest being their own."""
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(words)], "doc_id long, text string")
    rows = [(i, [*k, *range(1000 * i + 1000, 1000 * i + 1040 - len(k))]) for i, k in enumerate(keys)]
    sketched = order_minhash._sketched(docs).drop("sketches")
    own = docs.select("doc_id", F.xxhash64("text").alias("node")).join(
        spark.createDataFrame(rows, "doc_id long, sketches array<long>"), "doc_id"
    )
    found = sketched.join(own.drop("doc_id"), "node")
    monkeypatch.setattr(order_minhash, "_sketched", lambda _: found)
    return {r.doc_id: r.class_id for r in order_minhash.classes(docs).collect()}


@pytest.mark.parametrize("block", [1_000, 7])
def test_crowded_bucket_keeps_every_link(spark, monkeypatch, block):
    monkeypatch.setattr(order_minhash, "BLOCK", block)
    pairs = [[f"w{k}_{i}" for i in range(40)] for k in range(20)]
    words = [p for k, p in enumerate(pairs)] + [p[:20] + [f"e{k}"] + p[21:] for k, p in enumerate(pairs)]
    got = _classes(spark, monkeypatch, words, [[5]] * 40)
    assert got == {i: i % 20 for i in range(40)}


def test_link_through_a_member_of_the_centres_class(spark, monkeypatch):
    # chains of edits with the smallest hash at one end: its end is like the middle only
    words, want = [], {}
    for k in range(12):
        start = [f"w{k}_{i}" for i in range(40)]
        middle = [f"e{k}_{i}" for i in range(6)] + start[6:]
        end = middle[:34] + [f"f{k}_{i}" for i in range(6)]
        words += [start, middle, end]
    keys = [[i // 3] for i in range(36)]
    assert _classes(spark, monkeypatch, words, keys) == {i: i // 3 * 3 for i in range(36)}


@pytest.mark.parametrize("n", [5, 6, 8, 10, 30, 60, 300])
def test_sketches_meet_at_the_limit(n):
    rnd, met = random.Random(n), 0
    for k in range(100):
        one = np.array([rnd.getrandbits(63) for _ in range(n)], dtype=np.uint64)
        edits = int(0.2 * n + 1e-9)
        at = rnd.sample(range(n), edits) if k % 2 else [n * (2 * i + 1) // (2 * edits) for i in range(edits)]
        other = one.copy()
        other[at] = [rnd.getrandbits(63) for _ in at]
        met += bool((order_minhash.sketches(one) == order_minhash.sketches(other)).any())
    assert met >= 97


def test_all_pairs_of_a_bucket_are_compared(spark, monkeypatch):
    # the words of all are the same, so counts tell nothing; only 0 and 29 are in the same order
    rnd = random.Random(3)
    words = [rnd.sample([f"w{i}" for i in range(40)], 40) for _ in range(29)]
    words.append([*words[0][1:], words[0][0]])
    got = _classes(spark, monkeypatch, words, [[5]] * 30)
    assert got == {i: i % 29 for i in range(30)}


def test_counts_never_rule_out_a_similar_pair():
    rnd = random.Random(11)
    for _ in range(200):
        one = [f"w{int(rnd.expovariate(0.1))}" for _ in range(rnd.randint(1, 400))]
        other = list(one)
        for _ in range(rnd.randint(0, len(one) // 4 + 1)):
            at = rnd.randrange(len(other) + 1)
            other[at : at + rnd.randint(0, 1)] = ["new"] * rnd.randint(0, 1)
        a, b = order_minhash.word_hashes([" ".join(one).encode(), " ".join(other).encode()])
        sizes = np.array([[len(a), len(b)]])
        counts = np.array([[list(order_minhash.word_counts(w)) for w in (a, b)]], dtype=np.uint8)
        if order_minhash.similar(a, b):
            assert order_minhash.may_be_similar(sizes, counts, 0.8).all()
            numbers = np.array([[1, 0], [2, 0]])
            assert order_minhash.near_in_block([a, b], numbers, [frozenset([3])] * 2, 3, 0.8)


def test_links_of_a_block_join_all_classes_that_hang_together():
    """Against all pairs, with blocks and classes, and pairs left to other buckets."""
    rnd = random.Random(12)
    for _ in range(60):
        words = []
        for _ in range(rnd.randint(2, 5)):
            base = [rnd.getrandbits(60) for _ in range(rnd.choice([3, 12, 40]))]
            for _ in range(rnd.randint(1, 6)):
                other = list(base)
                for _ in range(rnd.randint(0, len(base) // 4)):
                    other[rnd.randrange(len(other))] = rnd.getrandbits(60)
                words.append(np.array(other, dtype=np.uint64))
        n = len(words)
        numbers = np.array([[rnd.randrange(n), rnd.randrange(2)] for _ in range(n)])
        across = len(set(numbers[:, 1].tolist())) == 2
        keys = [frozenset([5, *rnd.sample([3, 7], rnd.randint(0, 2))]) for _ in range(n)]
        want, got = (list(numbers[:, 0]) for _ in range(2))
        for i in range(n):
            for j in range(i):
                here = min(keys[i] & keys[j]) == 5 and (not across or numbers[i, 1] != numbers[j, 1])
                if here and order_minhash.similar(words[i], words[j]):
                    want = [min(want[i], want[j]) if c in (want[i], want[j]) else c for c in want]
        for i, j in order_minhash.near_in_block(words, numbers, keys, 5, 0.8):
            assert order_minhash.similar(words[i], words[j])
            got = [min(got[i], got[j]) if c in (got[i], got[j]) else c for c in got]
        assert got == want


def test_blocks_are_dealt_after_the_join(spark, monkeypatch):
    """Nodes meet their words once: no row is multiplied by the blocks of its bucket before a join."""
    monkeypatch.setattr(order_minhash, "BLOCK", 3)
    words = [[f"w{k}_{i}" for i in range(40)] for k in range(8)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(words + [w[:39] for w in words])], "doc_id long, text string")
    nodes = order_minhash._sketched(docs).cache()
    keys = F.explode(F.array(F.lit(5).cast("long"), F.lit(6).cast("long")))
    left = nodes.select(keys.alias("key"), "node", F.col("node").alias("node_class"), F.lit(16).cast("long").alias("n"))
    found = order_minhash._links_in_buckets(left, nodes, 0.8, 32)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(sequence" not in plan
    links = [tuple(sorted((r.a, r.b))) for r in found.collect()]
    assert len(links) == len(set(links)) == 8 and {r.key for r in found.collect()} == {5}


def test_feigned_links_do_not_hide_others(spark, monkeypatch):
    """A link that short hashes feign is not confirmed, and its bucket is searched again with all bits."""
    search, asked = order_minhash._links_in_buckets, []

    def feigned(left, nodes, least, bits):
        asked.append(bits)
        if bits == 32:
            return search(left, nodes, least, bits)
        # one link between texts that are not alike instead of all others
        ends = left.groupBy("key").agg(F.max("node").alias("a"), F.min("node").alias("b"))
        return ends.select("a", "b", "key")

    monkeypatch.setattr(order_minhash, "_links_in_buckets", feigned)
    words = [[f"w{k}_{i}" for i in range(40)] for k in range(12)]
    words += [w[:38] + ["end", "end"] for w in words]
    got = _classes(spark, monkeypatch, words, [[5]] * 24)
    assert got == {i: i % 12 for i in range(24)} and asked == [16, 32]


def test_a_family_does_not_multiply_rows(spark, monkeypatch):
    """Twice the texts of a passage: about twice the rows of every table, none of pairs of its members."""
    def rows_of(n):
        sizes, write = {}, order_minhash.materialize

        def counted(df, name):
            made = write(df, name)
            sizes[name] = max(made.count(), sizes.get(name, 0))
            return made

        passage = " ".join(f"p{i}" for i in range(40))
        texts = [f"{passage} " + " ".join(f"q{k}_{i}" for i in range(22)) for k in range(n)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        with monkeypatch.context() as patch:
            patch.setattr(order_minhash, "materialize", counted)
            assert order_minhash.classes(docs).select("class_id").distinct().count() == n
        return sizes

    small, large = rows_of(150), rows_of(300)
    assert all(n <= 2.6 * small[name] + 50 for name, n in large.items()), (small, large)


# Mixing --------------------------------------------------------------------


def test_mix_stays_near_targets_and_caps(spark, texts):
    rows = [r.asDict() for r in QUERIES["op6_mix"](spark, FOLDER).collect()]
    assert len(rows) == len(texts)
    sources = collections.defaultdict(list)
    for r in rows:
        sources[r["source_size"], r["target"]].append(r)
        assert r["taken"] <= 3 * r["size"]
    for (size, target), members in sources.items():
        assert target <= 3 * size + 1e-6
        largest = max(m["size"] for m in members)
        assert abs(sum(m["taken"] for m in members) - target) <= largest
    assert sum(t for _, t in sources) == pytest.approx(sum(s for s, _ in sources), rel=1e-9)


def test_water_fill_by_hand(spark):
    frame = spark.createDataFrame([("a", 10, 5.0), ("b", 100, 2.0), ("c", 100, 1.0)], "source string, source_size long, weight double")
    got = {r.source: r.target for r in mixing.water_fill(frame).collect()}
    assert got == pytest.approx({"a": 30.0, "b": 120.0, "c": 60.0})


# Licences, token files, toxicity, digests ----------------------------------


def test_licence_lines(spark):
    rows = [(0, "text\nLicensed under CC BY-NC 4.0.\nmore"), (1, "Released under the MIT license"), (2, "the MIT of it"), (3, None)]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].licence for i in range(4)] == ["CC-BY-NC-4.0", "MIT", None, None]
    assert got[0].dice == 1.0 and got[2].n_matches == 0


def test_size_bounds_never_prune_a_match():
    for n in range(1, 40):
        low, high = licences.size_bounds(n, 0.8)
        for size in range(1, 80):
            if 2 * min(n, size) / (n + size) >= 0.8:
                assert low <= size <= high


def test_token_files_hold_the_library_ids(spark, awkward):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    folder = f"{shared_folder(spark)}/token-test-{os.getpid()}"
    shards = token_files.write_token_files(awkward, folder, path)
    got = token_files.read_token_files(spark, shards, folder, path).orderBy("start").collect()
    assert len(got) == len(AWKWARD)
    library = Tokenizer.from_file(path)
    order = sorted(AWKWARD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for row, (doc_id, text, *_) in zip(got, order):
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        assert (row.doc_id, row.start, row.n_tokens, row.ids) == (doc_id, start, len(ids), ids)
        start += len(ids)


def test_byte_cuts_do_not_change_ids():
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    library, encoder = Tokenizer.from_file(path), token_files.byte_level_encoder(path)
    rnd = random.Random(2)
    letters = "ab  \n\t.,!'s1é　 \u0085\x1c日-"
    cases = ["".join(rnd.choice(letters) for _ in range(40)) for _ in range(400)] + ["<|endoftext|> x", ""]
    for _, some in slices(cases):
        ids, counts = encoder.encode(some, 7)
        ends = np.cumsum(counts)
        for text, a, b in zip(some, ends - counts, ends):
            assert ids[a:b].tolist() == [*library.encode(text.decode(), add_special_tokens=False).ids, 7]


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model).join(labels, "doc_id").select("doc_id", "score", "toxic").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    toxic = np.array([r.score for r in held if r.toxic])
    clean = np.array([r.score for r in held if not r.toxic])
    assert np.mean([(clean < s).mean() for s in toxic]) > 0.93
    assert (toxic >= 0.3).mean() > 0.85 and (clean >= 0.3).mean() < 0.02


@pytest.mark.parametrize("share", [0.12, 0.5, 0.8])
def test_toxicity_with_any_share_of_toxic_rows(spark, share):
    rnd = random.Random(5)
    rows = []
    for i in range(1200):
        toxic = int(rnd.random() < share)
        words = [f"plain{chr(97 + rnd.randrange(26))}" for _ in range(30)]
        words[3] = "grubble" if toxic else words[3]
        rows.append((i, " ".join(words), toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    kept = {r.doc_id for r in toxicity.without_toxic(docs, model).collect()}
    assert model.weights and kept == {i for i, _, toxic in rows if not toxic}


def test_matching_against_a_plain_search():
    """Beginnings of words found one by one; the heaviest at a place counts, none in a phrase of exceptions."""
    rnd = random.Random(9)
    letters = ["a", "b", "c"]
    for _ in range(200):
        lexicon = {"".join(rnd.choice(letters) for _ in range(rnd.randint(1, 4))): rnd.random() + 0.1 for _ in range(6)}
        words = ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 6))) for _ in range(40)]
        spared = [" ".join(words[i : i + 2]) for i in rnd.sample(range(39), 3)]
        model = toxicity.ToxicityModel(lexicon, exceptions=tuple(spared))
        counted = []
        for i, word in enumerate(words):
            inside = any(" ".join(words[j : j + 2]) in spared for j in (i - 1, i) if 0 <= j < 39)
            found = [(w, e) for e, w in lexicon.items() if word.startswith(e)]
            if found and not inside:
                counted.append(max(found))
        total = sum(w for w, _ in counted)
        want = (math.log1p(total), math.log1p(100 * total / len(words)), math.log1p(len({e for _, e in counted})))
        assert toxicity.features(model.automaton(), " ".join(words)) == pytest.approx(want)


def test_query_scores_are_those_of_the_model(spark):
    """The query against scoring each text by itself, on the whole table."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    model = toxicity.train(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    automaton = model.automaton()
    want = {r.doc_id: toxicity.probability(model.curve, toxicity.features(automaton, r.text)) for r in docs.collect()}
    got = {r.doc_id: (r.score, r.predicted, r.held_out) for r in QUERIES["op9_toxicity"](spark, FOLDER).collect()}
    assert set(got) == set(want)
    for doc_id, (score, predicted, held_out) in got.items():
        assert score == pytest.approx(want[doc_id]) and predicted == (score >= 0.3)
        assert held_out == (zlib.crc32(str(doc_id).encode()) % 4 == 2)


def test_folding_and_exceptions():
    model = toxicity.ToxicityModel({"idiot": 5.0, "trash": 5.0}, (-4.0, 1.0, 1.0, 1.0))
    automaton = model.automaton()
    for text in ("you IDIOT", "1d10t!", "іdіоt", "ｉｄｉｏｔ", "ídiot,"):
        assert toxicity.features(automaton, text)[0] > 0, text
    for text in ("", None, "the trash can is full", "unidiotic", "patriot"):
        assert toxicity.features(automaton, text) == (0.0, 0.0, 0.0)


def test_digest_likeness(spark, texts):
    got = {r.doc_id: r for r in QUERIES["op10_digests"](spark, FOLDER).collect()}
    ids = sorted(texts)
    for at, doc_id in enumerate(ids):
        text, following = texts[doc_id], texts[ids[(at + 1) % len(ids)]]
        n = len(text) // 2
        changed = (text[: len(text) - n] + following[:n]).encode()
        row, own = got[doc_id], digests.digest(text.encode())
        assert row.n_chars == len(text) and row.fingerprint == own.hex()
        assert row.edited_sha256 == hashlib.sha256(changed).hexdigest()
        assert row.near_edited == digests.likeness(own, digests.digest(changed))
        assert row.near_next == digests.likeness(own, digests.digest(following.encode()))
    assert np.mean([r.near_edited > r.near_next for r in got.values()]) > 0.95


def test_bucket_counts_against_a_loop():
    """Each triplet of a sliding window of five bytes by itself."""
    rnd = random.Random(1)
    for size in (0, 3, 5, 6, 80):
        data = bytes(rnd.randrange(256) for _ in range(size))
        padded = data + bytes(max(0, 5 - size))
        want = [0] * digests.BUCKETS
        for at in range(4, len(padded)):
            for (a, b), (x, y, z) in zip(digests.PAIRS, digests._SALTED):
                h = int(x[padded[at]]) + 3 * int(y[padded[at - a]]) + 7 * int(z[padded[at - b]]) & 0xFFFF
                h = (h ^ h >> 7) * 0x9E3B & 0xFFFF
                want[h >> 8] += 1
        assert digests.bucket_counts(np.frombuffer(data, dtype=np.uint8)).tolist() == want
        # four codes of the quartile that a bucket's count lies in
        ordered = sorted(want)
        borders = [ordered[digests.BUCKETS * k // 4 - 1] for k in (1, 2, 3)]
        made = digests.digest(data)
        codes = [made[1 + i // 4] >> (6 - 2 * (i % 4)) & 3 for i in range(digests.BUCKETS)]
        assert codes == [sum(n > b for b in borders) for n in want]


def test_bucket_counts_do_not_depend_on_chunks(monkeypatch):
    data = np.frombuffer(os.urandom(5000), dtype=np.uint8)
    whole = digests.bucket_counts(data)
    monkeypatch.setattr(digests, "_CHUNK", 100)
    assert (digests.bucket_counts(data) == whole).all()
    assert whole.sum() == (len(data) - 4) * len(digests.PAIRS)


# Awkward and empty tables --------------------------------------------------


def _run(name, docs, spark, folder):
    path = tokenizer("byte_bpe_50k.json")
    labels = spark.createDataFrame([(3, 1), (5, 0), (None, 1)], "doc_id long, toxic int")
    if name == "token_files":
        shards = token_files.write_token_files(docs, folder, path)
        return token_files.read_token_files(spark, shards, folder, path)
    return {
        "interpolation": lambda: interpolation.score(docs),
        "progressive": lambda: progressive.media_digests(progressive.store_media(docs)),
        "tensors": lambda: progressive.decode_media(progressive.store_media(docs)),
        "pseudonyms": lambda: pseudonyms.pseudonymised(docs, b"k", count="ids", length="n_chars"),
        "pieces": lambda: pieces.encode_digests(docs, tokenizer("piece_bpe_32k.model")),
        "piece_spans": lambda: pieces.encode_documents(docs, tokenizer("piece_bpe_32k.model"), spans=True),
        "order_minhash": lambda: order_minhash.classes(docs),
        "mix_report": lambda: mixing.mix_report(docs),
        "licences": lambda: licences.scan(docs),
        "toxicity": lambda: toxicity.score(docs, toxicity.train(docs, labels)),
        "digests": lambda: digests.edit_report(docs),
        "fingerprints": lambda: digests.fingerprints(docs, name="score"),
    }[name]()


NAMES = [
    "token_files", "interpolation", "progressive", "tensors", "pseudonyms", "pieces", "piece_spans",
    "order_minhash", "mix_report", "licences", "toxicity", "digests", "fingerprints",
]


@pytest.mark.parametrize("name", NAMES)
def test_awkward_rows_keep_their_count(spark, awkward, name):
    folder = f"{shared_folder(spark)}/awkward-{name}-{os.getpid()}"
    rows = _run(name, awkward, spark, folder).collect()
    assert len(rows) == len(AWKWARD)


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables_give_no_rows(spark, nothing, name):
    folder = f"{shared_folder(spark)}/empty-{name}-{os.getpid()}"
    assert _run(name, nothing, spark, folder).collect() == []


def test_filters_on_awkward_rows(spark, awkward):
    kept = order_minhash.one_of_each(awkward)
    assert kept.columns == awkward.columns
    assert kept.count() == 6  # empty, "one", white space, unicode, long, no id
    assert mixing.mixed(awkward).columns == awkward.columns
    assert toxicity.without_toxic(awkward, toxicity.ToxicityModel()).count() == len(AWKWARD)


# Queries -------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    from check_oracles import connect, canonical

    got = QUERIES[name](spark, FOLDER).toPandas()
    assert canonical(got) == canonical(connect(FOLDER).execute(ORACLES[name]).df())


def test_pipeline_stages_against_their_parts(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "pii", "mixing", "pieces"]
    kept = stages["toxicity"](spark, docs, FOLDER)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    unique = stages["near_duplicates"](spark, kept, FOLDER)
    classes = {r.doc_id: r.class_id for r in order_minhash.classes(kept).collect()}
    assert {r.doc_id for r in unique.collect()} == {i for i in ids if classes[i] == i}
    clean = {r.doc_id: r.text for r in stages["pii"](spark, unique, FOLDER).collect()}
    worker = pseudonyms.Pseudonymiser(corpus_pipeline.PSEUDONYM_KEY)
    assert clean == {r.doc_id: worker.text(r.text)[0] for r in unique.collect()}
    mix = stages["mixing"](spark, unique, FOLDER)
    counts = collections.Counter(r.doc_id for r in mix.collect())
    want = {r.doc_id: r.repetitions for r in mixing.mix_report(unique).collect() if r.repetitions}
    assert counts == want
    final = stages["pieces"](spark, mix, FOLDER)
    assert final.count() == sum(counts.values())
