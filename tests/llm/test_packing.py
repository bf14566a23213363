import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hornbeam.llm.packing import WordIds, pack, pack_documents, plan_packing, sequences, tokenised

VOCAB = public_tokenizers.path("word_bpe_49k.json")


def laid_out(plan, counts):
    """Every piece's (sequence, offset, length); checks that each length is used up."""
    out = []
    for length, segments in plan.segments.items():
        assert sum(n for _, n, _, _ in segments) == counts[length]
        out += [(first + k, offset, length) for _, n, first, offset in segments for k in range(n)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(12))
def test_plans_are_gapless_and_tight(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 4096])
    counts = {rng.randint(1, capacity): rng.randint(1, 50) for _ in range(rng.randint(1, 60))}
    plan = plan_packing(counts, capacity)
    filled: dict[int, int] = {}
    for seq, offset, length in laid_out(plan, counts):
        assert filled.get(seq, 0) == offset
        filled[seq] = offset + length
        assert filled[seq] <= capacity
    assert set(filled) == set(range(plan.sequences))
    total = sum(k * n for k, n in counts.items())
    assert plan.sequences <= 1 + 1.25 * total / capacity + sum(n for k, n in counts.items() if 2 * k > capacity)


def test_exact_complements_come_first():
    assert plan_packing({7: 1, 3: 1, 5: 2}, 10).sequences == 2
    assert plan_packing({6: 2, 3: 2, 1: 2}, 10).sequences == 2
    assert plan_packing({5: 1, 2: 2, 1: 1}, 10).sequences == 1
    assert plan_packing({4: 5}, 10).sequences == 3 and plan_packing({}, 10).sequences == 0


def expected(rows):
    tokenizer = Tokenizer.from_file(VOCAB)
    out = []
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        out += [(doc, k, s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
    return sorted(out, key=repr)


def check(got):
    filled: dict[int, int] = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert not filled or max(filled.values()) <= 4096
    return len(filled)


def test_documents(sample):
    got = pack_documents(sample, VOCAB).collect()
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], key=repr) == expected((r.doc_id, r.text) for r in sample.collect())
    assert check(got) <= 1 + -(-sum(r.length for r in got) // 4096)


def test_odd_rows(odd, docs):
    got = pack_documents(odd, VOCAB).collect()
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], key=repr) == expected((r.doc_id, r.text) for r in odd.collect())
    check(got)
    assert pack_documents(docs([]), VOCAB).collect() == []
    clash = odd.selectExpr("*", "1 AS piece", "2 AS length", "'x' AS ids")
    assert pack_documents(clash, VOCAB).count() == len(got)


def test_sequences_hold_the_ids(docs):
    table = docs([(k, "one two three " * (k * 150)) for k in range(1, 9)])
    pieces = tokenised(table, VOCAB)
    packed = pack(pieces.selectExpr("doc_id", "piece", "start", "length", "crc32(ids) AS ids_crc32"))
    whole = {r.sequence_id: bytes(r.ids) for r in sequences(pieces, packed).collect()}
    ids = {(r.doc_id, r.piece): bytes(r.ids) for r in pieces.collect()}
    for r in packed.collect():
        assert whole[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == ids[r.doc_id, r.piece]


def test_ids_are_those_of_the_library():
    rng, words, whole = random.Random(6), WordIds(VOCAB), Tokenizer.from_file(VOCAB)
    alphabet = [chr(c) for c in range(0x250)] + list("  \n\t'’sdtlm09²½٣中😀́​\x1c\x85ΣσİÅ.,!") * 8 + ["<|endoftext|>", "<|startoftext|>", "don't", "'ll", "end.,"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.choice([1, 4, 20, 100]))) for _ in range(3000)]
    for text, ids in zip(texts, words.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text
    assert hashlib.sha256(words.encode([None])[0]).hexdigest() == hashlib.sha256(b"").hexdigest()
