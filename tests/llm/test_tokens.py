"""Operators 4, 8 and 10 against the tokenizers library."""

import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from punctual.llm import lexicon, op4_packing, op8_token_files, op10_transducer_bpe, rans
from punctual.llm.common import fresh_path
from punctual.llm.tokens import LONG_RUN, Merger, PieceEncoder, TextEncoder

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
rng = random.Random(1)
TEXTS = ["", None, "Hello, world", "  a  b\n c ", "x<|endoftext|> y<|startoftext|>z", "nul\0 a", "a\t b\n\n\nc", "don't 're  'll",
         "á bͅ ΑΣ Σ İstanbul ß", "x" * 700 + " y", "word " * 9000, "same", "same",
         *["".join(rng.choice(" \n\t.'sabTé1½<>|_\0　日İß") for _ in range(rng.randint(0, 40))) for _ in range(400)]]
ROWS = [(i, t, "x", 0) for i, t in enumerate(TEXTS)]
SCHEMA = "doc_id long, text string, ids string, block long"  # extra columns clash with names used inside


def library(file, texts=TEXTS):
    return [e.ids for e in Tokenizer.from_file(file).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("file", [BYTE, WORD])
@pytest.mark.parametrize("encoder", [PieceEncoder, TextEncoder])
def test_ids_are_those_of_the_library(file, encoder):
    texts = [t or "" for t in TEXTS]
    assert [np.frombuffer(b, "<u2").tolist() for b in encoder(file).encode(texts)] == library(file)


@pytest.mark.parametrize("file", [BYTE, WORD])
def test_every_code_point_and_long_runs(file):
    points = [*range(0xD800), *range(0xE000, 0x20000), *range(0x20000, 0x110000, 97)]
    texts = ["\n".join(f"x{chr(c)}Y 1{chr(c)}2 .{chr(c)}. {chr(c)}" for c in points[i:i + 300]) for i in range(0, len(points), 300)]
    texts += [c * (3 * LONG_RUN) + "b" for c in "a.7 \n"] + ["ab" * LONG_RUN + "‘ " + "a ‘" * LONG_RUN]
    assert [np.frombuffer(b, "<u2").tolist() for b in TextEncoder(file).encode(texts)] == library(file, texts)


@pytest.mark.parametrize("file", [BYTE, WORD])
def test_every_token_comes_out_of_merging_its_own_bytes(file):
    """What makes merging by joined bytes the same as merging by pairs: plain pair merging reaches every token."""
    model = json.load(open(file, encoding="utf-8"))["model"]
    rank = {tuple(m): r for r, m in enumerate(model["merges"])}
    end = model["end_of_word_suffix"] or ""
    assert [model["vocab"][a + b] for a, b in model["merges"]] == sorted(model["vocab"][a + b] for a, b in model["merges"])
    for a, b in model["merges"]:
        token = a + b
        word = token.removesuffix(end)
        parts = list(word)
        if word != token:
            parts[-1] += end
        while len(parts) > 1:
            r, i = min((rank.get((x, y), len(rank)), i) for i, (x, y) in enumerate(zip(parts, parts[1:])))
            if r == len(rank):
                break
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        assert parts == [token]


def test_long_words_merge_like_short_ones():
    m = Merger(BYTE)
    for word in ("ab" * 200, "the" * 50, "aaaa" * 40):
        assert np.frombuffer(m.merge([word])[0], "<u2").tolist() == library(BYTE, [word])[0]


def test_rans_round_trip_segments_and_damage():
    ids = np.random.default_rng(0).zipf(1.3, 300_000) % 5000
    table = rans.Table(rans.Table.scaled(np.bincount(ids, minlength=1 << 16)))
    data = rans.encode_block(ids.astype(np.uint16), np.array([7]), np.array([len(ids)]), table)
    block = rans.Block(data)
    assert (block.ids(table) == ids).all() and len(block.states) > 1
    start = rans.CHECKPOINT_STEPS * rans.LANES
    assert (block.segment(1, table) == ids[start:2 * start]).all()
    assert len(data) < 2 * len(ids)
    with pytest.raises(rans.DamagedBlock):
        rans.Block(data[:-3] + b"abc")


def test_token_files(spark):
    docs = spark.createDataFrame(ROWS[::-1], SCHEMA).repartition(3)
    path = op8_token_files.write(docs, BYTE, fresh_path(spark, "test"), block_tokens=500)
    got = sorted(tuple(r) for r in op8_token_files.read(spark, path).collect())
    want, at = [], 0
    for (i, *_), ids in zip(ROWS, library(BYTE)):
        want.append((i, at, len(ids) + 1, crc(ids + [2])))
        at += len(ids) + 1
    assert got == want
    assert op8_token_files.token_files(spark.createDataFrame([], SCHEMA), BYTE).count() == 0


def test_packing(spark):
    got = op4_packing.pack(spark.createDataFrame(ROWS, SCHEMA), WORD).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for (i, *_), ids in zip(ROWS, library(WORD)):
        ids, at = ids + [2], 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), crc(ids[at:at + r.length]))
            at += r.length
        assert at == len(ids)
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096 and all(r.sequence_tokens == at for r in rows)
        assert rows[0].padded_to == (at if at & (at - 1) == 0 else 4096)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    assert op4_packing.pack(spark.createDataFrame([], SCHEMA), WORD).count() == 0


def test_shortest_pack_first_keeps_every_piece_and_pads_little():
    histogram = {n: random.Random(n).randint(1, 50) for n in range(1, 4097, 7)}
    patterns = op4_packing.shortest_pack_first(histogram, 4096)
    placed = {}
    for p in patterns:
        assert sum(p.lengths) <= 4096
        for n in p.lengths:
            placed[n] = placed.get(n, 0) + p.count
    assert placed == histogram
    assert sum(n * c for n, c in histogram.items()) > 0.97 * 4096 * sum(p.count for p in patterns)


def test_transducer_bpe(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    t = Tokenizer.from_file(WORD)
    want = [(i, len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))) for (i, *_), ids in zip(ROWS, library(WORD))]
    for words in (0, 1000):  # most words unseen, and most known
        assert sorted(tuple(r) for r in op10_transducer_bpe.encode_digests(docs, WORD, words).collect()) == want
    assert op10_transducer_bpe.encode_digests(spark.createDataFrame([], SCHEMA), WORD).count() == 0
    row = op10_transducer_bpe.encode_documents(docs.filter("doc_id = 2"), WORD).first()
    assert np.frombuffer(row.ids, "<u2").tolist() == library(WORD)[2] and row.decoded == t.decode(library(WORD)[2], skip_special_tokens=False)


def test_lexicon_is_minimal_and_exact(tmp_path):
    words = {w.encode(): w[::-1].encode() for w in ("tap", "taps", "top", "tops", "stop", "stops", "été", "a")}
    arrays = lexicon.build(words)
    lexicon.save(arrays, str(tmp_path))
    found = lexicon.Lexicon(str(tmp_path)).look_up(["tap", "taps", "ta", "tapsx", "stops", "été", "", "zz", "a"])
    assert found == [b"pat", b"spat", None, None, b"spots", "été"[::-1].encode(), None, None, b"a"]
    assert len(arrays["final"]) < 1 + sum(len(w) for w in words) - 10  # suffixes are shared
    lexicon.save(lexicon.build({}), str(tmp_path / "none"))
    assert lexicon.Lexicon(str(tmp_path / "none")).look_up(["a"]) == [None]
