"""Token counts, SentencePiece and token tables against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer

from lodefinder.llm import bpe, sstable, tokens, wfst
from lodefinder.llm.common import fresh_path, held, read_table
from tests.llm.helpers import ROWS, no_docs, odd_docs

ODD = ["", " ", "  a  b ", "▁x ▁▁ y", "\n\n\t tab", "<0x41> <s> </s>", "\x00\x01\x1c a", "ﬁ ½ ²³", "x" * 300, "    " * 40, "Σας ΟΔΟΣ", "İstanbul I'm don''t 'S", "\xa0\x85 a  \n\n b  ", "<|startoftext|>a<|endoftext|>"]


def random_texts(n=400, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices("aábcdeéß \n▁XYthe ing日<>0x1'", k=rng.randint(1, 60))) for _ in range(n)]


def test_counts_equal_the_library():
    known = tokens.lengths_of("word_bpe_49k.json")
    for x in ODD + random_texts():
        assert known.count(x) == len(known.tokenizer.encode(x, add_special_tokens=False).ids), x


def test_counts_of_every_character_equal_the_library():
    """Each character that the tiers take, in three places, and random strings of all of them; others go to the library."""
    known = tokens.WordLengths(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))
    true = lambda x: len(known.tokenizer.encode(x, add_special_tokens=False).ids)
    assert not any(tokens.NOT_WORDS.search(c) for c in tokens._WORDS) and tokens.NOT_WORDS.search("Ə") and tokens.NOT_WORDS.search("e\u0301")
    for c in tokens._WORDS:
        for x in (f"a{c}a", f"A{c}1{c} {c}{c}'s {c}"):
            assert known.count(x) == true(x), hex(ord(c))
    rng, low = random.Random(2), [chr(c) for c in range(0x250)]
    for _ in range(100_000):
        x = "".join(rng.choices(rng.choice([low, tokens._WORDS, [*low, *"’“—…абвГДЖ日本語한국か"]]), k=rng.randint(1, 12)))
        assert known.count(x) == true(x), x


def test_ids_equal_the_library():
    known = sstable.ids_of("byte_bpe_50k.json")
    for x in ODD + random_texts(seed=2):
        assert known.encode(x) == known.of_library(x), x


def test_pieces_equal_the_library():
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    machine = wfst.machine_of("piece_bpe_32k.model")
    for x in ODD + random_texts(seed=3):
        ids = np.frombuffer(machine.encode(x), dtype="<u4").tolist()
        assert ids == lib.encode(x), x
        assert machine.decode(machine.encode(x)) == lib.decode(ids), x

def own_model(path, model_type, rules="nmt_nfkc", byte_pieces=True, prefix=True, squeeze=True, seed=1, whole=False):
    """A model with pieces and scores at random, which no one trained, and the normaliser of a rule that the library knows."""
    rng, spec = random.Random(seed), sentencepiece_model_pb2.ModelProto()
    names = {"".join(rng.choices("abcé日fi1", k=rng.randint(1, 4))) for _ in range(120)} | set("▁abcé1fi")
    names |= {"▁" + x for x in list(names)[:60] if "▁" not in x} | {"▁▁"}
    if whole:
        names |= {"a▁b", "c▁"}
    for name, score, kind in [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3)]:
        spec.pieces.add(piece=name, score=score, type=kind)
    for b in range(256 * byte_pieces):
        spec.pieces.add(piece=f"<0x{b:02X}>", score=0, type=6)
    for k, name in enumerate(rng.sample(sorted(names), len(names))):
        spec.pieces.add(piece=name, score=-k if model_type == 2 else -rng.uniform(1, 12), type=1)
    spec.trainer_spec.model_type, spec.trainer_spec.byte_fallback = model_type, byte_pieces
    norm = sentencepiece_model_pb2.ModelProto()
    norm.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rules).serialized_model_proto())
    spec.normalizer_spec.CopyFrom(norm.normalizer_spec)
    spec.normalizer_spec.add_dummy_prefix, spec.normalizer_spec.remove_extra_whitespaces = prefix, squeeze
    spec.normalizer_spec.escape_whitespaces = True
    path.write_bytes(spec.SerializeToString())
    return str(path)


@pytest.mark.parametrize("model_type", [1, 2])
@pytest.mark.parametrize("rules, byte_pieces, prefix, squeeze, whole", [("nmt_nfkc", True, True, True, False), ("nfkc_cf", False, True, False, False), ("identity", False, False, True, True), ("nmt_nfkc", False, False, False, False)])
def test_other_models_equal_the_library(tmp_path, model_type, rules, byte_pieces, prefix, squeeze, whole):
    path = own_model(tmp_path / "own.model", model_type, rules, byte_pieces, prefix, squeeze, whole=whole)
    lib, machine, rng = sentencepiece.SentencePieceProcessor(model_file=path), wfst.Transducer(path), random.Random(9)
    assert machine.splits != whole
    texts = ["".join(rng.choices("aaabbccé  ▁ﬁ日①ＡＢé​ \u0001が☃ß", k=rng.randint(1, 40))) for _ in range(1500)]
    for x in ODD + random_texts(seed=7) + texts:
        ids = np.frombuffer(machine.encode(x), dtype="<u4").tolist()
        assert ids == lib.encode(x), x
        assert machine.decode(machine.encode(x)) == lib.decode(ids), x


def test_rules_of_every_character_equal_the_library(tmp_path):
    path = own_model(tmp_path / "own.model", 1, prefix=False, squeeze=False)
    machine, norm = wfst.Transducer(path).normaliser, sentencepiece.SentencePieceNormalizer(model_file=path)
    for c in [*range(1, 0xD800), *range(0xE000, 0x30000, 3)]:
        assert machine(f"a{chr(c)}b") == norm.normalize(f"a{chr(c)}b"), hex(c)


def test_own_model_in_a_query(spark, tmp_path):
    path = own_model(tmp_path / "own.model", 1)
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    got = wfst.encode(odd_docs(spark), ["text"], model=path).collect()
    assert len(got) == len(ROWS)
    assert all(list(r.ids) == lib.encode(r.text or "") and r.decoded == lib.decode(list(r.ids)) for r in got)


def test_models_that_are_not_supported_are_named(tmp_path):
    spec = sentencepiece_model_pb2.ModelProto()
    path = tmp_path / "own.model"
    own_model(path, 1)
    spec.ParseFromString(path.read_bytes())
    spec.pieces.add(piece="zz", score=0, type=4)
    path.write_bytes(spec.SerializeToString())
    with pytest.raises(ValueError, match="user-defined"):
        wfst.Transducer(str(path))


def test_a_worker_holds_one_cache():
    machine = wfst.machine_of("piece_bpe_32k.model")
    assert wfst.machine_of("piece_bpe_32k.model") is machine
    assert held(("another",), list) == [] and wfst.machine_of("piece_bpe_32k.model") is not machine


def test_count_query(spark):
    got = tokens.token_counts(odd_docs(spark)).collect()
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert len(got) == len(ROWS)
    want = {(i, len((x or "").encode()), len(lib.encode(x or "", add_special_tokens=False).ids)) for i, x in ROWS}
    assert {(r.doc_id, r.n_bytes, r.n_tokens) for r in got} == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got) and any(r.over_limit for r in got)
    empty = tokens.token_counts(no_docs(spark))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]


def test_small_caches_change_nothing(monkeypatch):
    monkeypatch.setattr(wfst, "CACHE_SIZE", 3)
    monkeypatch.setattr(sstable, "CACHE_SIZE", 3)
    machine, ids = wfst.Transducer(public_tokenizers.path("piece_bpe_32k.model")), sstable.Ids(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    for x in random_texts(50, seed=4):
        assert machine.encode(x) == wfst.machine_of("piece_bpe_32k.model").encode(x)
        assert ids.encode(x) == ids.of_library(x)


def test_piece_query(spark):
    got = wfst.encode_digest(odd_docs(spark), ["doc_id"]).collect()
    assert len(got) == len(ROWS) and all(r.round_trip for r in got)
    assert {r.n_pieces for r in got if r.doc_id in (2, 3)} == {0}
    full = wfst.encode(odd_docs(spark), ["doc_id", "text"]).collect()
    assert all(r.decoded == (r.text or "").replace("▁", " ") for r in full)
    assert wfst.encode_digest(no_docs(spark), ["doc_id"]).count() == 0


def test_token_table(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(sstable, "BLOCK_BYTES", 4096)  # several blocks a file
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text").union(odd_docs(spark).selectExpr("doc_id + 100000", "text"))
    path = fresh_path(spark, "tokens")
    sstable.write_tokens(docs, path)
    got = sorted(sstable.read_tokens(spark, path).collect(), key=lambda r: r.start)
    texts = {}
    for i, x in docs.collect():
        texts.setdefault(i, x)
    lib, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    assert [r.doc_id for r in got] == sorted((i for i, _ in docs.select("doc_id", "text").collect()), key=lambda i: (i is not None, i))
    for r in got:
        ids = [*lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, list(r.ids), r.ids_crc32) == (start, len(ids), ids, zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    found = {r.doc_id: list(r.ids) for r in sstable.lookup_tokens(spark, path, [0, 17, 100005, -5, 10**12]).collect()}
    assert found == {i: [*lib.encode(texts[i], add_special_tokens=False).ids, 0] for i in (0, 17, 100005)}
    assert sstable.lookup_tokens(spark, path, [100007]).count() == 2  # a repeated id has all its values
    assert sstable.token_table(no_docs(spark)).count() == 0


@pytest.mark.parametrize("ids", [[None, -(2**63), -1, 0, 1, 2**63 - 1]])
def test_keys_sort_as_ids(ids):
    keys = [sstable.key_of(i) for i in ids]
    assert keys == sorted(keys) and [sstable.id_of(k) for k in keys] == ids


def test_byte_pairs_equal_the_library(monkeypatch):
    known = bpe.encoder_of(bpe.RANKS, public_tokenizers.PATTERN)
    lib = tiktoken.Encoding("held", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known.ranks, special_tokens={})
    rng = random.Random(6)
    every = [f"x{chr(c)}x 1{chr(c)}1 !{chr(c)}! {chr(c)} " for c in [*range(0xD800), *range(0xE000, 0x3000), *range(0xE000, 0x10000, 3), *range(0x10000, 0x20000, 5)]]
    mixed = ["".join(rng.choices("abcé ñ’“—…ЖяΣ日本語🎉'sS\n\t\x1c\x85 123%", k=rng.randint(1, 90))) for _ in range(3000)]
    long = ["ab" * 20_000, "".join(rng.choices("abcdefgh", k=60_000)), " " * 3000 + "x"]
    texts = ODD + random_texts(seed=5) + mixed + every + long
    monkeypatch.setattr(bpe, "CACHE_SIZE", 500)
    monkeypatch.setattr(bpe, "RUN_CHARS", 20_000)
    small = bpe.Encoder(known.ranks, public_tokenizers.PATTERN)
    for x, ids in zip(texts, small.encode(texts), strict=True):
        assert ids.tolist() == lib.encode_ordinary(x), x[:80]
        assert small.decode(ids) == x.encode()


def test_byte_pairs_with_ranks_out_of_order():
    """A merged pair may have a lower rank than its parts; then the lower goes first, as in the library."""
    rng = random.Random(8)
    for _ in range(30):
        strings = {bytes(rng.choices(b"abc", k=rng.randint(2, 5))) for _ in range(25)}
        numbers = rng.sample(range(256, 2000), len(strings))
        ranks = {bytes([i]): i for i in range(256)} | dict(zip(sorted(strings), numbers, strict=True))
        lib = tiktoken.Encoding("odd", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        texts = [bytes(rng.choices(b"abc", k=rng.randint(1, 40))).decode() for _ in range(50)]
        assert [x.tolist() for x in bpe.Encoder(ranks, public_tokenizers.PATTERN).encode(texts)] == [lib.encode_ordinary(x) for x in texts]


def test_byte_pair_query(spark):
    lib = tiktoken.Encoding("held", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.encoder_of(bpe.RANKS, public_tokenizers.PATTERN).ranks, special_tokens={})
    got = bpe.encode_digest(odd_docs(spark), ["doc_id"]).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted((str(i), len(ids), sha(",".join(map(str, ids)).encode()), sha((x or "").encode())) for i, x in ROWS for ids in [lib.encode_ordinary(x or "")])
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert [bytes(r.decoded).decode() for r in bpe.encode(odd_docs(spark), ["text"]).collect()] == [x or "" for _, x in ROWS]
    assert bpe.encode_digest(no_docs(spark), ["doc_id"]).count() == 0
