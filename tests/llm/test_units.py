"""Kernels against the libraries and against brute force."""

import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from sparkassay.llm import blobs, components, decontaminate, ef_trie, fm_index, jaccard_join, language_id, line_dedup, quality, sentencepiece_codec, shared, token_count, toxicity

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "    ", "  a  b\n\x00c▁d", "a" * 3000, "hello world   foo\n\n\nbar\t\tx", "ééé日本語テキスト🎉🎉", "▁▁x", "<0x0A> <s> </s>", "x" + " " * 100 + "y" + "▁" * 37, "aab" * 500, "thetheethe" * 400, "ab" * 1000 + "zzz" * 777]


def random_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice("ab eth\n▁▁   日🎉inou<>0x") for _ in range(rng.randint(1, 80))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def buffer(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)


def test_encode_and_decode(library):
    texts = ODD + random_texts(500)
    c = sentencepiece_codec.Codec(sentencepiece_codec.model_bytes(PATH))
    ids, offs = c.encode(texts)
    back = c.decode(ids, offs)
    for k, want in enumerate(library.encode(texts)):
        assert ids[offs[k] : offs[k + 1]].tolist() == want
        assert back[k].decode() == library.decode(want)


def test_decode_of_any_ids(library):
    rng = np.random.default_rng(2)
    c = sentencepiece_codec.Codec(sentencepiece_codec.model_bytes(PATH))
    for _ in range(300):
        ids = rng.integers(0, 400 if rng.random() < 0.7 else 32000, rng.integers(0, 12)).astype(np.int32)
        assert c.decode(ids, np.array([0, len(ids)]))[0].decode() == library.decode(ids.tolist())


@pytest.mark.parametrize("chunk, warm, lanes", [(7, 48, 4), (256, 48, 4), (16, 2, 1), (64, 0, 2)])
def test_counts(library, chunk, warm, lanes, monkeypatch):
    for name, value in (("CHUNK", chunk), ("WARM", warm), ("LANES", lanes)):
        monkeypatch.setattr(token_count, name, value)
    texts = ODD + random_texts(300, 3) + ["x" * 997 + "日" * 300, "aab" * 700, "inter" * 300, "0" * 999, "ab ba" * 400]
    got = token_count.Counter(sentencepiece_codec.model_bytes(PATH)).count([t.encode() for t in texts])
    assert got.tolist() == [len(x) for x in library.encode(texts)]


def test_words_and_blobs():
    texts = ["", "a b", " \n", "x", "é  ß\tq"]
    buf, offs = buffer(texts)
    w = shared.Words(buf, offs)
    assert [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in texts] == np.diff(w.first).tolist()
    rng = np.random.default_rng(0)
    for n in (0, 1, 1000):
        columns = [np.sort(rng.integers(-(2**62), 2**62, n)), rng.integers(-5, 5, n), rng.integers(0, 2**63, n).astype(np.uint64)]
        for a, b in zip(columns, blobs.unpack(blobs.pack(*columns))):
            assert (a.view(np.int64) == b).all()


def test_suffix_array_and_index():
    rng = np.random.default_rng(1)
    for n, top in ((1, 2), (50, 2), (400, 3), (400, 50)):
        s = rng.integers(1, top + 1, n)
        assert fm_index.suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())
        index = fm_index.FMIndex(s)
        for m in (1, 2, 3):
            patterns = rng.integers(1, top + 2, (20, m))
            lo, hi = index.search(patterns)
            for p, a, b in zip(patterns, lo, hi):
                where = [i for i in range(n - m + 1) if (s[i : i + m] == p).all()]
                assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == where


def test_longest_repeats():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 60):
        s = rng.integers(0, 3, n)
        want = [max((next((k for k in range(n) if max(i, j) + k >= n or s[i + k] != s[j + k]), n) for j in range(n) if j != i), default=0) for i in range(n)]
        assert quality.longest_repeats(s).tolist() == want


def test_quality_counts():
    texts = ["", " \n ", "a b c\na b c\n\nx", "w1 w2 w3 w4 w5 w6 w7 w8 q w1 w2 w3 w4 w5 w6 w7 w8", "For " * 40, " ".join(f"v{i}" for i in range(30)), "é# *\n\t\n \té# *"]
    got = quality.judge(*buffer(texts))
    for k, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        assert [int(x[k]) for x in got[:5]] == [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)]
        assert bool(got[5][k]) == (len(w) < 20 or 100 * len(hit) > 30 * len(w))
    assert got[6].tolist() == [False, False, False, False, False, True, False]


def test_decontamination():
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(40)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 4, 12, 20]))).encode()) for k in range(12)]
    docs = [" ".join(rng.choice(vocab) for _ in range(200)) for _ in range(10)] + ["", "Zz " + items[3][1].decode().upper() + "!"]
    shard = decontaminate.Shard(decontaminate.Phrases(items, 10))
    shard.add(*buffer(docs))
    n_words, row, first, past, item_row, item = shard.hits()
    for k, d in enumerate(docs):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", d.lower())
        hit, found = set(), set()
        for i, t in items:
            x = t.decode().split()
            n = min(10, len(x))
            for a in range(len(x) - n + 1):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == x[a : a + n]:
                        hit.update(range(j, j + n))
                        found.add(i)
        assert n_words[k] == len(w) and set(item[item_row == k].tolist()) == found
        assert {j for r, a, b in zip(row, first, past) if r == k for j in range(a, b)} == hit


def test_cuckoo_filter():
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64))
    f = line_dedup.CuckooFilter(len(keys))
    f.insert(keys)
    assert f.contains(keys).all()
    assert f.contains(rng.integers(0, 2**63, 5000).astype(np.uint64)).mean() < 0.01
    f.delete(keys[:2000])
    assert f.contains(keys[2000:]).all() and f.contains(keys[:2000]).mean() < 0.01


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 0), (1, 5), (5, 4), (1000, 3), (1000, 10**6), (3000, 2**50), (50000, 2**33)):
        values = np.sort(rng.integers(0, top + 1, n))
        store = ef_trie.Store()
        e = ef_trie.EliasFano(values, store)
        e.open(store.close())
        assert (e.at(np.arange(n)) == values).all()
        ask = np.concatenate([rng.integers(0, top + 5, 2000), values, values + 1])
        at, found = e.successor(ask)
        assert (at == np.searchsorted(values, ask)).all() and (found == np.isin(ask, values)).all()


def test_trie_is_a_memory_map():
    rng = np.random.default_rng(2)
    words = np.unique(rng.integers(0, 5000, 300))
    pairs = sorted({(int(a), int(b)) for a, b in zip(rng.integers(0, len(words), 4000), rng.integers(1, 900, 4000))})
    triples = sorted({(int(a), int(b)) for a, b in zip(rng.integers(0, len(pairs), 9000), rng.integers(1, 900, 9000))})
    column = lambda rows, k: np.array([r[k] for r in rows])
    shares = [-rng.random(len(x)) * 4 for x in (pairs, pairs, triples)]
    t = ef_trie.Trie(words, column(pairs, 0), column(pairs, 1), shares[0], shares[1], column(triples, 0), column(triples, 1), shares[2])
    assert isinstance(t.store.map, ef_trie.mmap.mmap) and (t.word(words) == np.arange(len(words))).all() and (t.word(words[:1] - 1) == -1).all()
    at, share, left = t.pair(column(pairs, 0), column(pairs, 1))
    assert (at == np.arange(len(pairs))).all()
    assert np.abs(ef_trie.restore(share) - shares[0]).max() < 1 / ef_trie.STEPS and np.abs(ef_trie.restore(left) - shares[1]).max() < 1 / ef_trie.STEPS
    ask = rng.integers(0, len(words), 3000), rng.integers(1, 900, 3000)
    number = {p: k for k, p in enumerate(pairs)}
    at, share, _ = t.pair(*ask)
    assert at.tolist() == [number.get((int(a), int(b)), -1) for a, b in zip(*ask)] and ((share == ef_trie.NONE) == (at < 0)).all()
    ask = np.concatenate([rng.integers(-1, len(pairs), 3000), column(triples, 0)]), np.concatenate([rng.integers(1, 900, 3000), column(triples, 1)])
    have = dict(zip(triples, shares[2]))
    got = ef_trie.restore(t.triple(*ask))
    assert all(abs(g - have[k]) < 1 / ef_trie.STEPS if (k := (int(a), int(b))) in have else g == -np.inf for g, a, b in zip(got, *ask))


def test_contract():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 200, 120), rng.integers(0, 200, 120)
    node, root = components.contract(a, b)
    want = {int(x): int(x) for x in np.concatenate([a, b])}
    for _ in want:
        for x, y in zip(a.tolist(), b.tolist()):
            want[x] = want[y] = min(want[x], want[y])
    assert dict(zip(node.tolist(), root.tolist())) == {x: r for x, r in want.items() if x != r}


def test_shingles():
    texts = ["", "a", "A", "a b c d", "a b c d e", "a b c d e a b c d e", "x " * 9]
    flat, to = jaccard_join.shingles(*buffer(texts))
    for k, t in enumerate(texts):
        w = t.lower().split()
        assert to[k + 1] - to[k] == (len({tuple(w[i : i + 5]) for i in range(len(w) - 4)}) if len(w) >= 5 else min(1, len(w)))
    assert flat[to[1]] == flat[to[2]] != flat[to[3]]


def test_automaton_finds_one_edit():
    m = toxicity.Automaton({"stupid": 2.0, "mean": 1.0, "réeux*": 3.0})
    words = ["stupid", "stupd", "stuupid", "st*pid", "stpd", "mean", "meen", "réeuxment", "xréeux", ""]
    buf, offs = buffer(words)
    exact, fuzzy, begun = m.run(buf, offs[:-1], offs[1:])
    assert exact.tolist() == [2, 0, 0, 0, 0, 1, 0, 0, 0, 0]
    assert fuzzy.tolist() == [0, 2, 2, 2, 0, 0, 0, 0, 0, 0]
    assert begun.tolist() == [0, 0, 0, 0, 0, 0, 0, 3, 0, 0]
    m = toxicity.Automaton({"dégoûtant": 2.0, "жирный": 1.0})
    words = ["dégoûtant", "degoûtant", "dégoutant", "degoutant", "жирный", "жирны", "жірний", "日жирный"]
    buf, offs = buffer(words)
    exact, fuzzy, _ = m.run(buf, offs[:-1], offs[1:])
    assert exact.tolist() == [2, 0, 0, 0, 1, 0, 0, 0] and fuzzy.tolist() == [0, 2, 2, 0, 0, 1, 0, 1]


def test_code_points():
    text = "aé日🎉\x00z"
    cps, before = shared.code_points(np.frombuffer(text.encode(), np.uint8))
    assert cps.tolist() == [ord(c) for c in text] and before[-1] == len(text)
    cps, before = shared.code_points(np.frombuffer(b"\xff\x80a\xe9", np.uint8))
    assert len(cps) == before[-1] == 3


def test_toxicity_learns():
    rng = random.Random(6)
    plain = [f"word{i}" for i in range(300)]
    texts, y = [], []
    for k in range(400):
        w = [rng.choice(plain) for _ in range(40)]
        if k % 4 == 0:
            for _ in range(3):
                w[rng.randrange(40)] = rng.choice(["wretch", "fiend"])
        texts.append(" ".join(w).encode())
        y.append(k % 4 == 0)
    m = toxicity.learn(texts, np.array(y))
    s = m.score(*buffer(["word1 wretch word2 fiend " + "word3 " * 20, "word1 wr3tch word9 fi3nd fiend " + "word3 " * 20, "word5 " * 30, ""]))
    assert s[0] > 0.5 and s[1] > 0.3 and s[2] < 0.2 and 0 <= s[3] < 0.3


def test_network_learns():
    rng = random.Random(7)
    make = lambda a: "".join(rng.choice(a) for _ in range(200))
    texts = [make("abcde ") for _ in range(60)] + [make("vwxyz ") for _ in range(60)]
    x, row, _ = language_id.windows(*buffer(texts))
    net = language_id.Network(["a", "v"])
    net.train(x, (row >= 60).astype(int), epochs=40)
    names, score = language_id.judge(net, *buffer([make("abcde "), make("vwxyz "), "123 !", ""]))
    assert names == ["a", "v", "und", "und"] and (score[:2] > 0.8).all() and score[2:].tolist() == [0, 0]
