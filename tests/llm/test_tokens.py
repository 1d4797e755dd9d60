import hashlib
import json
import random
import sys
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from twinmark.llm import packing, token_scan, tokens

from .conftest import ODD


def test_encoding_equals_the_library_and_round_trips(spark, odd, files):
    encoder = tokens.rank_encoder(files[0], files[2])
    got = tokens.encode_documents(odd, files[0], files[2]).collect()
    assert len(got) == len(ODD)
    want = sorted((encoder.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in ODD)
    assert sorted((list(r.ids), bytes(r.decoded)) for r in got) == want
    for r in got:
        assert r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded).hexdigest()


@settings(max_examples=200, deadline=None)
@given(text=st.text(alphabet=st.sampled_from(list("ab1 \n\t.!'éß你   s")), max_size=60), most=st.integers(1, 12))
def test_pieces_change_nothing(text, most):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    encoder = tokens.rank_encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    cut = list(tokens.pieces(text, most))
    assert "".join(cut) == text
    assert [i for p in cut for i in encoder.encode_ordinary(p)] == encoder.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(text=st.text(max_size=80))
def test_vocabulary_encoder_equals_tokenizers(text):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path("byte_bpe_50k.json")
    fast, slow = tokens.vocabulary_encoder(path, public_tokenizers.PATTERN), tokens.vocabulary_tokenizer(path)
    assert fast.encode_ordinary(text) == slow.encode(text, add_special_tokens=False).ids


def test_decoding_of_cut_characters(files):
    encoder = tokens.rank_encoder(files[0], files[2])
    ids = encoder.encode_ordinary("你好")
    assert b"".join(tokens.decode(encoder, [i]) for i in ids) == "你好".encode()


@pytest.mark.parametrize("block_ids", [1, 3, 64, 1 << 19])
def test_token_counts(spark, odd, files, block_ids):
    encoder, small = tokens.rank_encoder(files[0], files[2]), odd.where("length(text) < 1000 or text is null")
    got = token_scan.count_document_tokens(small.repartition(3), files[0], files[2], 50256, block_ids=block_ids).collect()
    want = [(r[0], len(encoder.encode_ordinary(r[1] or ""))) for r in ODD if len(r[1] or "") < 1000]
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=repr) == sorted(want, key=repr)


def test_long_documents_cross_blocks(odd, files):
    got = token_scan.count_document_tokens(odd, files[0], files[2], 50256, block_ids=1000)
    encoder = tokens.rank_encoder(files[0], files[2])
    assert {r.doc_id: r.n_tokens for r in got.where("doc_id in (6, 7)").collect()} == {r[0]: len(encoder.encode_ordinary(r[1])) for r in ODD if r[0] in (6, 7)}


def test_raw_files(spark, tmp_path):
    np.array([5, 6, 9, 9, 7, 9, 8], "<u2").tofile(tmp_path / "a.bin")
    np.array([], "<u2").tofile(tmp_path / "b.bin")
    blocks = token_scan.read_flat(spark, str(tmp_path), block_ids=2)
    got = token_scan.count_tokens(blocks, 9).orderBy("ordinal").collect()
    assert [(r.ordinal, r.start, r.n_tokens, r.ended) for r in got] == [(0, 0, 2, True), (1, 3, 0, True), (2, 4, 1, True), (3, 6, 1, False)]


def check_packing(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing(odd, files):
    rows = packing.pack_documents(odd.repartition(3), files[1], files[2]).collect()
    check_packing(rows, 1024)
    slow = tokens.vocabulary_tokenizer(files[1])
    want = defaultdict(int)
    for doc_id, text, *_ in ODD:
        ids = np.array([*slow.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        for k, (start, length) in enumerate(packing.cut(len(ids), 1024)):
            want[doc_id, k, start, length, zlib.crc32(ids[start : start + length].tobytes())] += 1
    got = defaultdict(int)
    for r in rows:
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
    assert got == want


def test_cut():
    assert packing.cut(1024, 1024) == [(0, 1024)]
    assert packing.cut(2500, 1024) == [(0, 452), (452, 1024), (1476, 1024)]
    assert packing.cut(2048, 1024) == [(0, 1024), (1024, 1024)]


def best_fit_decreasing(sizes, capacity):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = min((g for g in gaps if g >= s), default=None)
        if fit is None:
            gaps.append(capacity - s)
        else:
            gaps[gaps.index(fit)] = fit - s
    return len(gaps)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=120))
def test_plan_places_every_piece_once(sizes):
    histogram = {s: sizes.count(s) for s in set(sizes)}
    plan, bins, ranks = packing.plan_bins(histogram, 100), defaultdict(list), defaultdict(list)
    for size, first, end, first_bin, offset in plan:
        ranks[size] += range(first, end)
        for k in range(end - first):
            bins[first_bin + k].append((offset, size))
    assert {s: sorted(r) for s, r in ranks.items()} == {s: list(range(n)) for s, n in histogram.items()}
    for own in bins.values():
        at = 0
        for offset, size in sorted(own):
            assert offset == at
            at += size
        assert at <= 100 and sum(3 * s > 100 for _, s in own) <= 2
    assert len(bins) <= best_fit_decreasing(sizes, 100) + 1


def test_many_pieces_need_no_long_plan():
    random.seed(2)
    histogram = {s: random.randint(1, 10**9) for s in range(1, 1025)}
    plan = packing.plan_bins(histogram)
    assert len(plan) < 20_000
    bins = max(p[3] + p[2] - p[1] for p in plan)
    assert bins * 1024 <= 1.05 * sum(s * n for s, n in histogram.items())


def test_empty_tables(nothing, files):
    assert tokens.encode_documents(nothing, files[0], files[2]).count() == 0
    assert token_scan.count_document_tokens(nothing, files[0], files[2], 50256).count() == 0
    assert packing.pack_documents(nothing, files[1], files[2]).count() == 0


def test_added_tokens_inside_a_text_keep_their_ids(spark, files):
    texts = ["plain words", "more plain words", "and again", "a <|endoftext|> b", "<|endoftext|>" * 3, "a <|endoftext| b", "word <|endoftext|>" * 700]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    tokenizer = pytest.importorskip("tokenizers").Tokenizer.from_file(files[1])
    assert tokenizer.encode(texts[3], add_special_tokens=False).ids == [64, 220, 50256, 275]
    want = set()
    for doc_id, text in enumerate(texts):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
        want |= {(doc_id, start, length, zlib.crc32(ids[start : start + length].tobytes())) for start, length in packing.cut(len(ids), 1024)}
    got = packing.pack_documents(docs, files[1], files[2]).collect()
    assert {(r.doc_id, r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)


def changed(files, tmp_path, change):
    with open(files[1], encoding="utf-8") as file:
        spec = json.load(file)
    change(spec)
    path = tmp_path / "changed.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    return str(path)


def swap_merges(spec):
    merges = spec["model"]["merges"]
    merges[3], merges[40] = merges[40], merges[3]


def test_the_file_proves_that_the_fast_encoder_is_right(files):
    assert tokens.same_ids(files[1], files[2])
    assert not tokens.same_ids(files[1], files[2] + " ")


@pytest.mark.parametrize("change", [swap_merges, lambda s: s["model"]["merges"].pop(), lambda s: s["pre_tokenizer"].update(add_prefix_space=True), lambda s: s["model"].update(dropout=0.1)])
def test_other_files_go_to_the_library(spark, files, tmp_path, change):
    path = changed(files, tmp_path, change)
    assert not tokens.same_ids(path, files[2])
    if change is not swap_merges:
        return
    texts = ["the other thing is there", "another text that the merges of <|endoftext|> change", None]
    library = tokens.vocabulary_tokenizer(path)
    rows = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, files[2]).collect()
    want = {(k, zlib.crc32(np.array([*(library.encode(t, add_special_tokens=False).ids if t else []), 2], "<u4").tobytes())) for k, t in enumerate(texts)}
    assert {(r.doc_id, r.ids_crc32) for r in rows} == want


def test_every_code_point_splits_alike(files):
    """Which classes a code point belongs to is the one thing that the file does not say."""
    fast, slow = tokens.vocabulary_encoder(files[1], files[2]), tokens.vocabulary_tokenizer(files[1])
    points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and (c < 0x33480 or 0xE0000 <= c < 0xE0200 or c % 4093 == 0)]
    texts = ["".join(f"a{chr(c)}1 {chr(c)}{chr(c)}b\n" for c in points[k : k + 64]) for k in range(0, len(points), 64)]
    for text, found in zip(texts, slow.encode_batch(texts, add_special_tokens=False), strict=True):
        assert fast.encode_ordinary(text) == found.ids


def test_very_long_texts_and_many_large_ones(spark, files):
    encoder = tokens.rank_encoder(files[0], files[2])
    random.seed(4)
    words = [" ".join("".join(random.choices("abcdeé你\n", k=6)) for _ in range(2000)) for _ in range(4)]
    large = [" ".join(words[(k + j) % 4] for j in range(40)) for k in range(3)]
    assert min(map(len, large)) > 2 * tokens.PIECE_CHARS
    rows = [(k, large[k % 3]) for k in range(30)] + [(99, "x" * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    ids = {text: encoder.encode_ordinary(text) for text in {t for _, t in rows}}
    got = {r.doc_id: r for r in tokens.encode_documents(docs, files[0], files[2], keep_ids=False).collect()}
    assert all(got[k].n_tokens == len(ids[t]) and got[k].ids_sha256 == hashlib.sha256(np.array(ids[t], "<u4").tobytes()).hexdigest() for k, t in rows)
    counted = {r.doc_id: r.n_tokens for r in token_scan.count_document_tokens(docs, files[0], files[2], 50256).collect()}
    assert counted == {k: len(ids[t]) for k, t in rows}
    few = docs.where("doc_id in (0, 1, 99)")
    library = tokens.vocabulary_tokenizer(files[1])
    want = set()
    for k, text in rows:
        if k in (0, 1, 99):
            own = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
            want |= {(k, start, zlib.crc32(own[start : start + length].tobytes())) for start, length in packing.cut(len(own), 1024)}
    assert {(r.doc_id, r.start, r.ids_crc32) for r in packing.pack_documents(few, files[1], files[2]).collect()} == want
