import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from triage.llm import packing
from triage.llm.packing import Encoder, best_two_fit, encoder, pack_documents

BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def ids_of():
    tokenizer = Tokenizer.from_file(BPE)
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def check(rows, packed, ids_of, capacity):
    want = defaultdict(int)
    for doc_id, text in rows:
        ids = np.array(ids_of(text), "<u4")
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    got, bins = defaultdict(int), defaultdict(list)
    for r in packed.collect():
        got[(r.doc_id, r.piece, r.start, r.length, r.ids_crc32)] += 1
        bins[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(k[3] * n for k, n in want.items())


def test_pieces_and_sequences(docs, ids_of):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice(["lorem", "Ipsum,", "dólar\n", "  x", "的", "don't", "\t12345"]) for _ in range(rnd.randint(0, 120)))) for i in range(300)]
    rows += [(400, None), (401, ""), (402, "a<|endoftext|>b"), (403, "word " * 3000), (404, "z" * 5000), (None, "no id"), (1, "same"), (1, "same")]
    bins, total = check(rows, pack_documents(docs(*rows), BPE, 256), ids_of, 256)
    assert bins <= -(-total // 256) * 1.02 + 1
    assert pack_documents(docs(*rows).limit(0), BPE).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_best_two_fit_packs_each_item_once(seed):
    rnd = random.Random(seed)
    lengths = [rnd.choice([rnd.randint(1, 100), rnd.randint(30, 60)]) for _ in range(rnd.randint(0, 400))]
    bins = best_two_fit(lengths, 100)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 100 for b in bins)
    assert len(bins) <= sum(lengths) / 100 * 1.1 + 2


def test_the_smallest_gives_way_to_a_tighter_pair():
    # Greedy: 60 + 30, gap 10. 30 gives way to 21 + 19, which fill the gap of 40.
    bins = best_two_fit([60, 30, 21, 19], 100)
    assert sorted(sorted([60, 30, 21, 19][i] for i in b) for b in bins) == [[19, 21, 60], [30]]


def test_added_tokens_are_one_id(ids_of):
    assert Encoder(BPE)(["a <|endoftext|> b"])[0].tolist() == ids_of("a <|endoftext|> b")[:-1] == [64, 220, 50256, 275]


def test_cut_texts_have_the_ids_of_whole_ones(ids_of):
    rnd = random.Random(11)
    parts = [" ", "  ", "\n", "\t", "\u00a0", "\u2003", "\u3000", "\x85", "'", "'s", "'ll", "a", "B", "word", "é", "ß", "Ø", "×", "÷", "е", "的", "1", "22",
             "½", "-", "...", "<|endoftext|>", "<|end", "oftext|>", "\u0301", "\u200d", "😀", "\x00", "\x1f", "ª", "º", "ÿ", "À"]
    texts = ["".join(rnd.choices(parts, [9, *[1] * (len(parts) - 1)], k=rnd.randint(0, 30))) for _ in range(4000)]
    encode = Encoder(BPE)
    for at in range(0, len(texts), 500):
        some = texts[at:at + 500]
        assert [t.tolist() for t in encode(some)] == [ids_of(t)[:-1] for t in some]


def test_texts_cut_in_any_script_have_the_ids_of_whole_ones(ids_of, monkeypatch):
    monkeypatch.setattr(packing, "KNOWN_WORDS", 40)
    rnd = random.Random(12)
    parts = ["word", "Été", "слово", "語", "λ", "x1", "don't", "|", ".", "\n", "\n\n", "\n\n\n", "  ", "\t", "\r\n", "\u00a0", "\u1680", "\u180e", "\u200b",
             "\u2003", "\u2028", "\u2060", "\u3000", "\ufeff", "\x1c", "\x85", "\u0301", "ª", "²", "<|endoftext|>", "z" * 60]
    texts = ["".join(rnd.choices([" ", *parts], [12, *[1] * len(parts)], k=rnd.randint(0, 40))) for _ in range(4000)]
    texts += ["\n".join(rnd.choices(["слово и", "word two.", "", " "], k=9)) for _ in range(500)]
    encode = Encoder(BPE)
    for at in range(0, len(texts), 100):
        some = texts[at:at + 100]
        assert [t.tolist() for t in encode(some)] == [ids_of(t)[:-1] for t in some]


def test_words_met_before_are_not_encoded_again(ids_of, monkeypatch):
    rnd, sent = random.Random(13), []
    words = ["".join(rnd.choices("abcdefgé", k=6)) for _ in range(40)] + ["".join(rnd.choices("абвгдежз", k=6)) for _ in range(40)]
    texts = ["so " + "".join(f"{w}{rnd.choice([' ', ', ', '. ', ' - ', chr(10), '.' + chr(10), chr(10) * 2])}" for w in rnd.choices(words, k=50)) + "so" for _ in range(100)]
    encode = Encoder(BPE)
    whole = encode._encode
    monkeypatch.setattr(encode, "_encode", lambda some: sent.extend(some) or whole(some))
    assert [t.tolist() for t in encode(texts)] == [ids_of(t)[:-1] for t in texts]
    # Each word behind a space, one break or two, with each ending, at most; and what comes before a text's first cut.
    assert sum(map(len, sent)) < sum(map(len, texts)) / 3
    encode(texts)
    sent.clear()
    encode(texts)
    assert sent == ["so"] * len(texts)


def test_tasks_of_a_run_share_an_encoder():
    assert encoder(BPE, "run") is encoder(BPE, "run")
    assert encoder(BPE, "run") is not encoder(BPE, "another")
