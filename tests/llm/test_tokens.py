import io
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.conftest import SF, SF_ORACLE
from tidelog.llm import packing, sentence_pieces, simple8b, token_counts, token_files
from tidelog.llm.common import Workspace, table
from tidelog.llm.wordids import WordIds

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", " ", "a", "  a  b ", "don't I'LL 123 45", "Straße İstanbul ΣΑΣ", "x\x1cz\x85q\xa0r　s", "<|endoftext|> a<|startoftext|>b", "é ́́", "日本語 テスト", "(quoted)!!! --- end...",
    "☃ snow☃", "a" * 5000, "tab\tline\nend\r\n", "한글 가", "½ Ⅷ ﬁ",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(WORDS)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def words_of(own, texts):
    ids, counts = own.encode(pa.array([None if t is None else t.encode() for t in texts], pa.binary()))
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_word_ids(tokenizer):
    own = WordIds(WORDS)
    want = [ids_of(tokenizer, t) for t in [*ODD, None]]
    assert words_of(own, [*ODD, None]) == want and words_of(own, [*ODD, None]) == want
    assert len(own.encode(pa.array([], pa.binary()))[1]) == 0


@lru_cache
def both():
    return WordIds(WORDS), Tokenizer.from_file(WORDS)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=30), min_size=1, max_size=4))
def test_word_ids_of_any_text(texts):
    own, t = both()
    assert words_of(own, texts) == [ids_of(t, x) for x in texts]


def test_words_before_signs(tokenizer):
    """Each letter below U+0250 and some beyond, upper and lower, at a word's end before a sign."""
    letters = [chr(c) for c in [*range(0x41, 0x250), 0x307, 0x338, 0x390, 0x3A3, 0x3C2, 0x416, 0x1E9E, 0x2126, 0x212A, 0x2168, 0x3042, 0xFB01, 0x10400]]
    for sign in (".", ",", "=", "...", "-<", "';"):
        texts = [f"x{c}{sign} {c}{sign} {c}a{sign}{c}{sign}" for c in letters]
        assert words_of(WordIds(WORDS), texts) == [ids_of(tokenizer, t) for t in texts]


def test_a_full_store_keeps_the_words_met_most(tokenizer):
    own = WordIds(WORDS)
    own.store.most = 40
    for i in range(12):
        texts = [f"often again w{i}x{k}. été" for k in range(12)]
        assert words_of(own, texts) == [ids_of(tokenizer, t) for t in texts]
        assert len(own.store.row) <= 40 + 13 * 3
    assert b"often" in own.store.row


def test_a_store_of_long_words_is_bounded(tokenizer):
    own = WordIds(WORDS)
    own.store.most = 40
    for i in range(8):
        texts = [f"often {'long' * 150}{i} {'日本語' * 300}{i} again"]
        assert words_of(own, texts) == [ids_of(tokenizer, t) for t in texts]
        assert len(own.store.ids) < 40 * own.store.IDS + 2000 and own.store.n_bytes < 40 * own.store.BYTES + 4000
        assert own.store.n_bytes == sum(map(len, own.store.row)) and own.store.at[-1] == len(own.store.ids)


# Simple-8b


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 1 << 17), st.integers(0, (1 << 64) - 1)), max_size=600))
def test_simple8b_round_trip(ids):
    x = np.array(ids, np.uint64)
    words, escaped = simple8b.encode_block(x)
    assert simple8b.decode_block(words, escaped, len(x)).tolist() == ids


def test_zeros_and_small_ids_are_packed_tightly():
    assert len(simple8b.encode_block(np.zeros(2400, np.uint64))[0]) == 10
    assert len(simple8b.encode_block(np.full(600, 1, np.uint64))[0]) == 10
    assert len(simple8b.encode_block(np.full(400, 40_000, np.uint64))[0]) == 134


def test_id_files(monkeypatch):
    monkeypatch.setattr(simple8b, "BLOCK_IDS", 100)
    rng = np.random.default_rng(1)
    docs = [(i if i % 5 else None, rng.integers(0, 50_000, int(rng.integers(0, 400))).astype(np.uint64)) for i in range(40)]
    out = io.BytesIO()
    out.close = lambda: None
    w = simple8b.Writer(out)
    for lo in range(0, 40, 7):
        part = docs[lo : lo + 7]
        w.add([d for d, _ in part], np.array([len(i) for _, i in part]), np.concatenate([i for _, i in part]))
    w.close()
    back = list(simple8b.Reader(out).documents())
    assert [(d, i.tolist()) for d, i in back] == [(d, i.tolist()) for d, i in docs]
    everything = np.concatenate([i for _, i in docs])
    assert simple8b.Reader(out).block(3).tolist() == everything[300:400].tolist()
    raw = out.getvalue()
    for bad in (raw[:-5], raw[:-40] + b"x" + raw[-39:]):
        with pytest.raises((ValueError, KeyError)):
            list(simple8b.Reader(io.BytesIO(bad)).documents())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.just(0), st.integers(0, 3), st.integers(0, 1 << 16), st.integers(0, (1 << 64) - 1)), min_size=1, max_size=500))
def test_words_hold_as_many_ids_as_fit(ids):
    want, at = [], 0
    while at < len(ids):
        fits = [s for s, (n, wide) in enumerate(simple8b.SELECTORS) if s and all(x.bit_length() <= wide for x in ids[at : at + n])]
        want.append(fits[0] if fits else 0)
        at += simple8b.SELECTORS[want[-1]][0]
    assert (simple8b.encode_block(np.array(ids, np.uint64))[0] >> np.uint64(60)).tolist() == want


def rows(spark):
    data = [(i, t, "x", 1) for i, t in enumerate([*ODD, None])] + [(3, "again", "x", 1), (None, "no id", "x", 1), (99, "w " * 30_000, "x", 1)]
    return spark.createDataFrame(data, "doc_id long, text string, ids string, start int").repartition(3)


def test_token_files(spark, tokenizer):
    ws = Workspace(spark, "t")
    docs = rows(spark)
    manifest = token_files.write_token_files(docs, WORDS, 1, ws)
    got = token_files.read_token_files(spark, manifest).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [None] + sorted(r.doc_id for r in docs.collect() if r.doc_id is not None)
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    assert all(len(r.ids) == r.n_tokens and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    want = sorted((r.doc_id or -1, zlib.crc32(np.array([*ids_of(tokenizer, r.text), 1], "<u4").tobytes())) for r in docs.collect())
    assert sorted((r.doc_id or -1, r.ids_crc32) for r in got) == want
    empty = token_files.write_token_files(docs.limit(0), WORDS, 1, Workspace(spark, "t"))
    assert token_files.read_token_files(spark, empty).count() == 0


def test_token_files_of_the_table(spark, tokenizer):
    got = token_files.op9_token_files(spark, SF).collect()
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    start = 0
    for r in sorted(got, key=lambda r: r.doc_id):
        ids = np.array([*ids_of(tokenizer, texts[r.doc_id]), 1], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(got) == len(texts)


# Packing


def check_pieces(pieces, documents, tokenizer, most_padding):
    """``documents``: (doc_id, text) without repeated ids."""
    sequences, own = {}, {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
        own.setdefault(p.doc_id, []).append(p)
    padding = total = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 4096
        total += at
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding <= most_padding * total
    assert set(own) == {d for d, _ in documents}
    for d, text in documents:
        ids = np.array([*ids_of(tokenizer, text), 2], "<u4")
        at = 0
        for p in sorted(own[d], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    return len(sequences)


def test_packing_the_table(spark, tokenizer):
    docs = table(spark, SF_ORACLE, "documents")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    pieces = packing.op8_packing(spark, SF_ORACLE).collect()
    n = check_pieces(pieces, texts, tokenizer, 0.001)
    whole = sum(p.doc_tokens for p in pieces if p.start == 0) / 4096
    assert n <= 1.2 * whole + 13 * docs.rdd.getNumPartitions()
    assert np.mean([p.length == p.doc_tokens for p in pieces if p.doc_tokens < 4096]) > 0.6


def test_packing_cases(spark, tokenizer, monkeypatch):
    docs = rows(spark).where("doc_id is null or doc_id <> 3")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    got = packing.pack(docs, WORDS).collect()
    check_pieces(got, texts, tokenizer, 0)
    assert all(zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32 for p in got)
    twice = packing.pack(docs.union(docs), WORDS, with_ids=False)
    assert twice.agg({"length": "sum"}).first()[0] == 2 * sum(p.length for p in got)
    assert packing.pack(docs.limit(0), WORDS).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 63), max_size=120))
def test_plans_hold_every_item_once(lengths):
    x = np.array(lengths, np.int64)
    got, sequences = np.zeros(len(x), int), {}
    for i, start, length, s, offset, _ in packing.pack_lengths(x, 64):
        got[i] += length
        sequences.setdefault(s, []).append((offset, length))
    assert (got == x).all()
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 64 or at & (at - 1) == 0


def test_least_squares_use_the_histogram_up():
    h = np.zeros(65, int)
    h[[16, 24, 40, 48]] = [30, 70, 70, 30]
    combos = packing.combinations(h, 64)
    x = packing.repeats(h, combos)
    used = np.bincount(combos.ravel(), weights=np.repeat(x, packing.DEPTH), minlength=65)
    assert abs(used[1:] - h[1:]).max() < 1e-6 and np.count_nonzero(x) <= 4


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_least_squares_by_their_conditions(seed):
    """At the least sum no combination's gain is above 0, and that of each one in use is 0."""
    h = np.random.default_rng(seed).integers(0, 9, 25)
    h[0] = 0
    combos = packing.combinations(h, 24)
    x = packing.repeats(h, combos)
    rest = h - np.bincount(combos.ravel(), weights=np.repeat(x, packing.DEPTH), minlength=25)
    rest[0] = 0
    gain = rest[combos].sum(1)
    assert (x >= 0).all() and gain.max() < 1e-6 and abs(gain[x > 0]).max() < 1e-6


def test_all_combinations_are_enumerated():
    h = np.zeros(17, int)
    h[[1, 3, 4, 5, 7, 8, 12, 16]] = [3, 1, 2, 2, 9, 4, 1, 1]
    want = {
        tuple(sorted((a, b, c, d)))
        for a in range(17) for b in range(17) for c in range(17) for d in range(17)
        if a + b + c + d == 16 and all(v == 0 or (a, b, c, d).count(v) <= h[v] for v in (a, b, c, d))
    }
    got = [tuple(r) for r in packing.combinations(h, 16).tolist()]
    assert sorted(got) == sorted(want)


def test_most_windows_are_planned():
    lengths = np.minimum(np.random.default_rng(5).lognormal(6.4, 0.9, 3000).astype(int) + 1, 4095)
    pieces = packing.pack_lengths(lengths)
    planned, every = {p[3] for p in pieces if p[5]}, {p[3] for p in pieces}
    assert len(planned) > 0.75 * len(every)
    assert sum(p[2] for p in pieces if p[5]) > 0.7 * lengths.sum()


# SentencePiece


def pieces_of(own, texts):
    ids, counts, wrong = own.encode(pa.array([None if t is None else t.encode() for t in texts], pa.binary()))
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])], wrong.tolist()


def check_codec(path, texts):
    own = sentence_pieces.Codec(path)
    got, wrong = pieces_of(own, texts)
    assert got == own.truth.encode(texts) and not any(wrong)
    assert own.decode(got) == own.truth.decode(got)
    return own


SPACES = [" " * 40, "x" + " " * 17 + "y", "▁a ▁▁ b", "<s> </s> <0x0A> <unk>", "\U0001f600 \n\n  z", " lead", "trail ", "a  b   c"]


def test_sentence_pieces_parity(spark):
    texts = [*ODD, *SPACES] + [r.text for r in table(spark, SF, "documents").collect()]
    own = check_codec(PIECES, texts)
    assert own.by_words
    whole = sentence_pieces.Codec(PIECES)
    whole.by_words, whole.tokenizer = False, sentence_pieces.rebuild(whole.model)
    assert pieces_of(whole, texts[:40]) == pieces_of(own, texts[:40])


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"], exclude_characters="\x00"), max_size=60))
def test_sentence_pieces_of_any_text(text):
    own = sentence_pieces.codec(PIECES)
    assert pieces_of(own, [text]) == ([own.truth.encode(text)], [0])


@pytest.mark.parametrize("by_words", [True, False])
def test_a_wrong_rebuilt_model_shows(by_words):
    """Ids are the rebuilt tokenizer's: without its merges they change, and are reported."""
    from tokenizers import Tokenizer, models

    own = sentence_pieces.Codec(PIECES)
    if not by_words:
        own.by_words, own.tokenizer = False, sentence_pieces.rebuild(own.model)
    vocab = {p: i for i, (p, *_) in enumerate(own.model.pieces)}
    broken = Tokenizer(models.BPE(vocab, [], unk_token="<unk>", fuse_unk=True, byte_fallback=True))
    if own.tokenizer.normalizer:
        broken.normalizer = own.tokenizer.normalizer
    own.tokenizer = broken
    got, wrong = pieces_of(own, ["the house the", "", "▁"])
    assert got[0] != own.truth.encode("the house the") and wrong[0] == (3 if by_words else 1) and wrong[1] == 0


def unigram(path, pieces, byte_fallback=True, squeeze=False):
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.trainer_spec.model_type = 1
    m.trainer_spec.byte_fallback = byte_fallback
    m.normalizer_spec.name, m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces = "identity", True, squeeze
    own = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", -20.0, 6) for b in range(256) if byte_fallback]
    for piece, score, kind in own + [(p, s, 1) for p, s in pieces]:
        m.pieces.add(piece=piece, score=score, type=kind)
    path.write_bytes(m.SerializeToString())
    return str(path)


def test_a_unigram_model_made_by_hand(tmp_path):
    pieces = [("▁", -3.0), ("a", -4.0), ("b", -4.5), ("ab", -5.0), ("▁a", -4.2), ("bab", -6.0), ("▁ab", -6.1)]
    check_codec(unigram(tmp_path / "own.model", pieces), ["ab abab", "bbab a", "", "a  b", "éa", "abba baab"])


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("fallback", [True, False])
def test_random_unigram_models(tmp_path, seed, fallback):
    """Models of random pieces and scores, with and without byte fallback, on random texts."""
    rng = np.random.default_rng(seed)
    signs = list("abcde")
    pieces = {c: 0 for c in [*signs, "▁"]} | {"".join(rng.choice(signs, rng.integers(2, 5))): 0 for _ in range(60)}
    pieces |= {"▁" + "".join(rng.choice(signs, rng.integers(1, 4))): 0 for _ in range(30)}
    scored = [(p, float(-rng.uniform(1, 4) * len(p))) for p in pieces]
    texts = [" ".join("".join(rng.choice([*signs, "f", "é"], rng.integers(1, 9))) for _ in range(rng.integers(0, 12))) for _ in range(60)]
    check_codec(unigram(tmp_path / "random.model", scored, fallback), texts)


def test_sentence_piece_columns(spark):
    docs = rows(spark)
    got = sentence_pieces.round_trip(docs, PIECES).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == docs.count() and all(r.round_trip and r.mismatches == 0 for r in got)
    truth = sentence_pieces.Codec(PIECES).truth
    for r in got:
        if r.doc_id != 3:
            assert r.n_tokens == len(truth.encode(texts[r.doc_id] or ""))
    both = sentence_pieces.decode(sentence_pieces.encode(docs, PIECES), PIECES).collect()
    assert all((r.text or "") == (texts[r.doc_id] or "") for r in both if r.doc_id != 3)
    assert sentence_pieces.round_trip(docs.limit(0), PIECES).count() == 0


# Token counts

CHANGES = "op string, seq long, doc_id long, source string, lang string, tokenizer string, n_tokens long"


def totals(rollup):
    return {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in rollup.totals().collect()}


def test_rollup_deltas(spark):
    r = token_counts.TokenRollup(spark, Workspace(spark, "t").path("rollup"))
    assert totals(r) == {}
    send = lambda name, *rows: r.commit(name, spark.createDataFrame(list(rows), CHANGES))
    assert send("1", ("insert", 1, 1, "s", "en", "t", 10), ("insert", 1, 2, "s", "de", "t", 5), ("insert", 1, 2, "s", "de", "u", 6), ("insert", 1, None, "s", "en", "t", 3))
    assert totals(r) == {("s", "en", "t"): (2, 13), ("s", "de", "t"): (1, 5), ("s", "de", "u"): (1, 6)}
    batch = [
        ("revise", 1, 1, "q", "en", "t", 7), ("delete", 1, 2, None, None, "t", None), ("delete", 1, 77, "s", "en", "t", 4), ("revise", 1, 8, None, "fr", "t", 2),
        ("insert", 1, 9, "s", "en", "t", 100), ("delete", 2, 9, "s", "en", "t", 100), ("delete", 1, None, "s", "en", "t", 3), ("odd", 1, 5, "s", "en", "t", 3), ("insert", 1, 6, "s", "en", "t", None),
    ]
    assert send("2", *batch)
    want = {("s", "en", "t"): (2, 3), ("q", "en", "t"): (1, 7), ("s", "de", "u"): (1, 6), (None, "fr", "t"): (1, 2)}
    assert totals(r) == want
    again = token_counts.TokenRollup(spark, r.root)
    assert not again.commit("2", spark.createDataFrame(batch, CHANGES)) and totals(again) == want
    assert again.commit("3", spark.createDataFrame([], CHANGES)) and totals(again) == want
    assert {(d.doc_id, d.tokenizer, d.n_tokens) for d in again.documents().collect()} == {(1, "t", 7), (2, "u", 6), (8, "t", 2), (6, "t", 0)}


def test_folded_batches(spark, monkeypatch):
    """Many batches, some folded, against a dictionary."""
    monkeypatch.setattr(token_counts, "FOLD_AFTER", 3)
    r = token_counts.TokenRollup(spark, Workspace(spark, "t").path("rollup"))
    rng, held = np.random.default_rng(2), {}
    for k in range(8):
        rows = []
        for d in rng.choice(10, 4, replace=False).tolist():
            op, n, source = ["insert", "revise", "delete"][rng.integers(3)], int(rng.integers(1, 50)), "ab"[rng.integers(2)]
            rows.append((op, 1, d, source, "en", "t", n))
            if op == "delete":
                held.pop(d, None)
            else:
                held[d] = (source, n)
        assert r.commit(str(k), spark.createDataFrame(rows, CHANGES))
    assert sum(bool(c.get("fold")) for c in r.commits()) == 2
    want = {}
    for source, n in held.values():
        docs, tokens = want.get((source, "en", "t"), (0, 0))
        want[(source, "en", "t")] = (docs + 1, tokens + n)
    assert totals(r) == want and not r.commit("3", spark.createDataFrame([("insert", 1, 99, "a", "en", "t", 5)], CHANGES))
    assert {(d.doc_id, d.n_tokens) for d in r.documents().collect()} == {(d, n) for d, (_, n) in held.items()}


def test_a_failed_batch_leaves_nothing(spark, monkeypatch):
    r = token_counts.TokenRollup(spark, Workspace(spark, "t").path("rollup"))
    rows = spark.createDataFrame([("insert", 1, 1, "s", "en", "t", 10)], CHANGES)
    publish = token_counts.TokenRollup._publish
    monkeypatch.setattr(token_counts.TokenRollup, "_publish", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        r.commit("1", rows)
    assert totals(r) == {}
    monkeypatch.setattr(token_counts.TokenRollup, "_publish", publish)
    assert r.commit("1", rows) and totals(r) == {("s", "en", "t"): (1, 10)}


def test_token_counts_by_recount(spark, tokenizer):
    rows = table(spark, SF, "documents").collect()
    first = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        first.setdefault(r.text, r.doc_id)
    want = {}
    for r in rows:
        n = len(ids_of(tokenizer, r.text)) + 1
        for version, there in (("word_bpe_49k/1", first[r.text] == r.doc_id), ("word_bpe_49k/2", True)):
            if there:
                d, t = want.get((r.source, r.lang, version), (0, 0))
                want[(r.source, r.lang, version)] = (d + 1, t + n)
    got = {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in token_counts.op4_token_counts(spark, SF).collect()}
    assert got == want


def test_counting_columns(spark, tokenizer):
    """Very long texts, other columns of the names in use, and an empty table."""
    data = [(i, t, "en", "s", -1, "v") for i, t in enumerate([*ODD, "w " * 30_000])]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_tokens int, tokenizer string")
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, WORDS).collect()}
    assert got == {d: len(ids_of(tokenizer, t)) for d, t, *_ in data}
    assert token_counts.count_tokens(docs.limit(0), WORDS).count() == 0
    r = token_counts.TokenRollup(spark, Workspace(spark, "t").path("rollup"))
    sent = spark.createDataFrame([("insert", 1, 1, "s", "en", "t", 10)], CHANGES)
    extra = sent.selectExpr("*", "7 as docs", "true as alive", "1 as batch", "'x' as last")
    assert r.commit("1", extra) and totals(r) == {("s", "en", "t"): (1, 10)}


def test_counting_cases(spark, tokenizer):
    docs = spark.createDataFrame([(1, None, None, None), (None, "a b", "en", "s")], "doc_id long, text string, lang string, source string")
    assert sorted(r.n_tokens for r in token_counts.count_tokens(docs, WORDS).collect()) == [0, 2]
