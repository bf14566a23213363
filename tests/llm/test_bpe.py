import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

from hornbeam.llm.bpe import Bpe, encode_decode
from hornbeam.llm.queries import op4_bpe

from conftest import DIR

VOCAB = public_tokenizers.path("byte_bpe_50k.json")


def test_random_texts():
    rng, own, library = random.Random(5), Bpe(VOCAB), Tokenizer.from_file(VOCAB)
    alphabet = [chr(c) for c in range(0x250)] + list("  \n\t\r'’sdtlmre09²½٣中文😀́\xa0᠎\x1c\x85​") * 6 + ["<|endoftext|>", "aaaaaaaa", "    ", "'ll"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.choice([1, 3, 8, 20, 200]))) for _ in range(3000)] + ["ab" * 20_000, "x" * 5000, ""]
    for text, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text
        assert own.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False)


def test_proposals_that_fail_are_merged():
    own = Bpe(VOCAB)
    failing = [w for w in (b"eredinsting", b"thatblees", b"onhaater", b"ingedthe", b"wherewasheont") if own.proposed(w) != own.merged(w)]
    assert failing  # greedy matching alone would be wrong
    assert all(own.encode([w.decode()])[0].tolist() == own.merged(w) for w in failing)


def test_the_memory_is_bounded():
    own = Bpe(VOCAB, most=50)
    for k in range(40):
        own.encode([" ".join(f"w{k}x{j}" for j in range(20))])
    assert len(own.chunks) < 100


def test_query(spark, sample):
    library = Tokenizer.from_file(VOCAB)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = set()
    for r in sample.collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        want.add((r.doc_id, len(ids), sha(",".join(map(str, ids)).encode()), sha(library.decode(ids, skip_special_tokens=False).encode())))
    assert set(map(tuple, op4_bpe(spark, DIR).collect())) == want


def test_odd_rows(odd, docs):
    got = sorted(encode_decode(odd, VOCAB).collect(), key=repr)
    assert len(got) == odd.count() and all(r.decoded == "" and r.ids == [] for r in got if r.doc_id in (1, 2, 9))
    assert {r.doc_id: r.decoded for r in got} == {r.doc_id: r.text or "" for r in odd.collect()}
    assert encode_decode(docs([]), VOCAB).collect() == []
    assert encode_decode(odd.selectExpr("*", "1 AS ids", "2 AS decoded"), VOCAB).count() == len(got)
