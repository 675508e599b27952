import hashlib
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from caseward.llm import bpe, token_files
from caseward.sources.shared import new_path

WORD, BYTE = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def test_bpe_equals_the_library(odd, small):
    tokenizer = Tokenizer.from_file(WORD)
    for docs in (odd, small):
        rows = bpe.encode(docs, WORD, keep=("text",), decode=True).collect()
        apart = bpe.decode(bpe.encode(docs, WORD), WORD).collect()
        assert sorted(str(r["decoded"]) for r in apart) == sorted(str(r["decoded"]) for r in rows)
        assert len(rows) == docs.count()
        for r in rows:
            ids = tokenizer.encode(r["_text"] or "", add_special_tokens=False).ids
            assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["n_tokens"] == len(ids)
            assert r["decoded"] == tokenizer.decode(ids, skip_special_tokens=False)


def test_bpe_of_an_empty_table(empty):
    assert bpe.decode(bpe.encode(empty, WORD), WORD).collect() == []


def test_pair_index_with_overlaps_and_reborn_ranks():
    vocabulary = bpe.Vocabulary(WORD)
    encoder, tokenizer = bpe.Encoder(vocabulary), Tokenizer.from_file(WORD)
    words = ["a" * n for n in range(1, 30)] + ["ΣΑΣ", "é", "ẞ", "it's", "12½", "\x85x", "İ"]
    ids, counts = encoder.words(words)
    ends = np.cumsum(counts)
    for word, a, b in zip(words, ends - counts, ends, strict=True):
        assert ids[a:b].tolist() == tokenizer.encode(word, add_special_tokens=False).ids


def test_token_files_round_trip(spark, odd, small, empty):
    with open(BYTE, encoding="utf-8") as file:
        definition = file.read()
    tokenizer = Tokenizer.from_file(BYTE)
    for docs in (odd, small, empty):
        files = token_files.write_files(docs, definition, new_path(spark, "ids"))
        got = sorted((r["start"], r["doc_id"], r["n_tokens"], bytes(r["ids"])) for r in token_files.read_files(files).collect())
        texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        assert len(got) == len(texts)
        assert [g[1] for g in got] == sorted((d for d, _ in texts), key=lambda d: (d is not None, d))
        start = 0
        for at, _, n, ids in got:
            assert at == start and len(ids) == 4 * n
            start += n
        want = sorted((str(d), np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for d, t in texts)
        assert sorted((str(d), ids) for _, d, _, ids in got) == want


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    for most in (1, 2, 300, 50_000, 2**32):
        ids = rng.integers(0, most, 128 * 40).astype(np.uint32)
        ids[::50] = rng.integers(0, 2**32, len(ids[::50]))
        data, starts = token_files.pack(ids)
        assert (token_files.unpack(np.frombuffer(data, np.uint8), starts) == ids).all()
        assert zlib.crc32(ids.tobytes()) and hashlib.sha256(data)


def test_chunks_equal_the_library():
    with open(BYTE, encoding="utf-8") as file:
        encoder = token_files.Encoder(file.read())
    tokenizer = Tokenizer.from_file(BYTE)
    import random

    import pyarrow as pa

    rng = random.Random(3)
    parts = ["a", "B", "é", " ", " ", "  ", "\n", "\t", "\xa0", " ", "　", "\x85", "\x1c", "'s", "1", "!", "中", "😀", "<|endoftext|>", "Ġ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 20))) for _ in range(500)]
    ids, starts = encoder.texts(pa.array(texts))
    for n, text in enumerate(texts):
        assert ids[starts[n] : starts[n + 1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_chunk_table_that_overflows(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_files, "TABLE", 50)
    monkeypatch.setattr(token_files, "LONGEST", 3)
    with open(BYTE, encoding="utf-8") as file:
        encoder = token_files.Encoder(file.read())
    encoder.table = {}
    tokenizer = Tokenizer.from_file(BYTE)
    rng = np.random.default_rng(5)
    for _ in range(20):
        words = [("ab" * int(n % 7) + str(n))[: 1 + n % 40] for n in rng.geometric(0.01, 90)]
        texts = ["", " ".join(words[:40]), " ".join(words[40:]), "x" * 300]
        ids, starts = encoder.texts(pa.array(texts))
        for n, text in enumerate(texts):
            assert ids[starts[n] : starts[n + 1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert len(encoder.table["terms"]) <= 50 and max(encoder.table["counts"], default=0) <= 3
