"""BPE, decontamination, near-duplicates, chat formatting: brute force and edge cases."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from plumbline.llm import bpe, chat, decontaminate, neardup
from plumbline.llm.textbytes import Words, text_bytes

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, lang string"
LONG = "word " * 60_000 + "x" * 300_000


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(RANKS))


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def encode(codec, texts):
    ids, at = codec.encode(*text_bytes(pa.array(texts, pa.string())))
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]


def test_perfect_hash_is_minimal():
    keys = [f"k{i}".encode() for i in range(5000)]
    table = bpe.PerfectHash(keys, list(range(5000)))
    hashes = table.hash_keys(keys)
    lengths = np.array([len(k) for k in keys])
    assert table.n == 5000 and table.find(hashes, lengths).tolist() == list(range(5000))
    assert (table.find(table.hash_keys([b"z%d" % i for i in range(999)]), np.array([len(b"z%d" % i) for i in range(999)])) == -1).all()


def test_bpe_like_the_library(codec, reference):
    rnd = random.Random(5)
    bits = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", "　", "é", "ß", "漢字", "😀", "a", "don", "RE", "1", "½", "!", "?", "_", "<|endoftext|>", "́", "s", "l", "\x00"]
    for _ in range(400):
        texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 16))) for _ in range(4)]
        assert encode(codec, texts) == [reference.encode_ordinary(t) for t in texts]


def test_bpe_edges(spark, reference):
    rows = [(1, None, "a"), (2, "", "a"), (3, LONG, None), (3, LONG, None), (None, "It's  fine\n", "b")]
    df = spark.createDataFrame([(*r, 7, 8, "x") for r in rows], DOCS + ", IDS int, __text int, n_tokens string")
    got = sorted((r.asDict() for r in bpe.encode(df, RANKS, digests=True).collect()), key=str)
    assert set(got[0]) == {"doc_id", "lang", "__text", "ids", "n_tokens", "ids_sha256", "decoded_sha256"}
    for r in got:
        text = next(t or "" for i, t, _ in rows if i == r["doc_id"])
        ids = reference.encode_ordinary(text)
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["__text"] == 8
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert len(got) == 5 and bpe.encode(df.limit(0), RANKS).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def covered(text, items):
    words, hit, which = words_of(text), set(), set()
    for item_id, item in items:
        own = words_of(item)
        k = min(13, len(own))
        windows = {tuple(own[i:i + k]) for i in range(len(own) - k + 1)} if k else set()
        for i in range(len(words) - k + 1 if k else 0):
            if tuple(words[i:i + k]) in windows:
                hit.update(range(i, i + k))
                which.add(str(item_id))
    return len(words), len(hit), len(which), hashlib.sha256(",".join(sorted(which)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


def test_decontamination_like_brute_force(spark):
    rnd = random.Random(2)
    vocabulary = [f"w{i}" for i in range(12)] + ["Ünï", "É"]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([1, 2, 5, 12, 13, 14, 30])))) for i in range(25)]
    items += [(100, items[0][1]), (101, None), (102, " .,"), (5, items[5][1])]
    docs = []
    for i in range(120):
        parts = [rnd.choice(vocabulary) if rnd.random() < 0.9 else rnd.choice(items)[1] or "" for _ in range(rnd.randint(0, 60))]
        docs.append((i, rnd.choice([" ", ", ", "\n"]).join(parts).upper() if i % 3 else " ".join(parts)))
    docs += [(None, docs[3][1]), (7, docs[7][1]), (500, None), (501, ""), (502, LONG + " " + items[6][1])]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, uid int, n_words int")
    bench = spark.createDataFrame([(*x, 3) for x in items], "item_id long, text string, fp int")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.report(df, bench, ["doc_id"]).collect()), key=str)
    assert got == sorted(((i, *covered(t, items)) for i, t in docs), key=str)
    left = decontaminate.clean(df, bench)
    assert left.columns == df.columns
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted((i for i, t in docs if not covered(t, items)[-1]), key=str)
    assert decontaminate.report(df.limit(0), bench, ["doc_id"]).count() == 0
    assert decontaminate.report(df, bench.limit(0), ["doc_id"]).where("n_hit > 0 or contaminated").count() == 0


def test_winnowing_keeps_a_gram_of_every_window():
    rnd = np.random.default_rng(0)
    hashes = rnd.integers(0, 9, 400).astype(np.uint64)  # many ties
    at, _ = decontaminate.kept_grams(hashes, np.array([0, 150, 400]), 8, 13)
    for a, b in ((0, 150), (150, 400)):
        for i in range(a, b - 12):
            assert ((at >= i) & (at <= i + 5)).any()


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_banded_alignment():
    rnd = random.Random(1)
    for _ in range(800):
        a = [rnd.randint(0, 5) for _ in range(rnd.randint(1, 20))]
        b = list(a)
        for _ in range(rnd.randint(0, 6)):
            at = rnd.randrange(len(b) + 1)
            b[at:at + rnd.randint(0, 1)] = [rnd.randint(0, 5)] * rnd.randint(0, 1)
        if b:
            most = rnd.randint(0, 7)
            got = neardup.banded_distance(np.array(a, np.uint64), np.array(b, np.uint64), most)
            assert got == min(levenshtein(a, b), most + 1)


def brute_classes(docs):
    """Components over all pairs whose edit similarity of five-grams reaches 0.8."""
    grams = {}
    for i, (_, text) in enumerate(docs):
        w = words_of(text)
        grams[i] = [tuple(w[j:j + 5]) for j in range(len(w) - 4)] or ([tuple(w)] if w else [])
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            a, b = grams[i], grams[j]
            most = max(len(a), len(b))
            if a and b and 5 * abs(len(a) - len(b)) <= most and set(a) & set(b) and 5 * levenshtein(a, b) <= most:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(docs)):
        groups.setdefault(find(i), []).append(i)
    return groups


def near_copies(rnd):
    docs, n = [], 0
    for _ in range(12):
        base = [f"w{rnd.randint(0, 400)}" for _ in range(rnd.choice([3, 6, 40, 90]))]
        for _ in range(rnd.randint(1, 6)):
            copy = [w if rnd.random() > 0.012 else f"z{rnd.randint(0, 99)}" for w in base]
            docs.append((n, (" " if rnd.random() < 0.5 else ", ").join(copy)))
            n += 1
    repeated = " ".join(["the"] * 50)
    return docs + [(n, repeated), (n + 1, repeated + " the"), (n + 2, docs[0][1]), (n + 2, docs[0][1])]


def test_near_duplicates_like_brute_force(spark):
    docs = near_copies(random.Random(4))
    docs += [(900, None), (901, ""), (902, "..."), (902, "..."), (None, "a lone text of some words here"), (903, LONG)]
    groups = brute_classes([d if d[0] != 903 else (903, "long") for d in docs])
    expected = sorted(((docs[i][0], min(docs[j][0] for j in g) if docs[i][0] is not None else None, len(g)) for g in groups.values() for i in g), key=str)
    df = spark.createDataFrame([(*d, 1, "k") for d in docs], "doc_id long, text string, id int, tkey string")
    got = sorted(((r.doc_id, r.class_id, r.class_size) for r in neardup.assign(df).collect()), key=str)
    assert got == expected
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns
    wordless = [900, 901, 902, 902]
    firsts = [min(docs[j][0] for j in g) for g in groups.values() if docs[g[0]][0] not in wordless and docs[g[0]][0] is not None]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([*firsts, None, *wordless], key=str)
    assert neardup.assign(df.limit(0)).count() == 0 and neardup.keep_one(df.limit(0)).count() == 0


def test_short_near_duplicates_like_brute_force(spark):
    rnd = random.Random(11)
    # certain losses of sketches: 4 grams against 5, and 5 against 5 with an end word changed
    w = [f"q{i}" for i in range(9)]
    docs = [" ".join(w[:8]), " ".join(w), " ".join(f"r{x}" for x in w[1:]), " ".join(f"r{x}" for x in w), " ".join(f"s{x}" for x in w), " ".join([f"s{x}" for x in w[:8]] + ["end"]),
            " ".join(["a", *(f"t{x}" for x in w[1:])]), " ".join(["b", *(f"t{x}" for x in w[1:])])]
    for size in range(5, 36):
        for _ in range(4):
            base = [f"w{rnd.randint(0, 3000)}" for _ in range(size)]
            allowed = max(1, (size - 4) // 5)
            ends = [["x", *base[1:]], [*base[:-1], "y"], ["x", *base], [*base, "y"], base[allowed:], base[:-allowed] + ["z"] * allowed]
            docs += [" ".join(base), " ".join(rnd.choice(ends))]
    # a line that many texts hold, before and behind their own words
    line = [f"c{i}" for i in range(12)]
    for i in range(60):
        own = [f"o{rnd.randint(0, 9)}" if rnd.random() < 0.1 else f"p{i // 2}_{j}" for j in range(3 + i % 7)]
        docs.append(" ".join(own + line if i % 4 < 2 else line + own))
    docs = list(enumerate(docs))
    expected = sorted((docs[i][0], min(docs[j][0] for j in g), len(g)) for g in brute_classes(docs).values() for i in g)
    got = neardup.assign(spark.createDataFrame(docs, "doc_id long, text string").repartition(8)).collect()
    assert sorted((r.doc_id, r.class_id, r.class_size) for r in got) == expected


def test_exact_keys_of_short_texts():
    rnd = random.Random(9)
    for _ in range(3000):
        a = [rnd.randint(0, 40) for _ in range(rnd.randint(1, 29))]
        b = list(a)
        for _ in range(rnd.randint(0, 7)):
            at = rnd.randrange(len(b) + 1)
            b[at:at + rnd.randint(0, 1)] = [rnd.randint(0, 40)] * rnd.randint(0, 1)
        x, y = np.array(a, np.uint64), np.array(b, np.uint64)
        if b and neardup.similar(x, y):
            assert np.intersect1d(neardup.short_keys(x), neardup.short_keys(y)).size
    assert not neardup.short_keys(np.arange(37, dtype=np.uint64)).size


def test_order_matters_to_the_sketch():
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    moved = words[30:] + words[:30]
    changed = words[:]
    changed[rnd.randrange(60)] = "other"
    a, b, c = neardup.shingles(Words(*text_bytes(pa.array([" ".join(x) for x in (words, moved, changed)]))))
    same = lambda x, y: int((neardup.sketch(x) == neardup.sketch(y)).sum())
    assert same(a, c) > 3 * max(1, same(a, b)) and neardup.similar(a, c) and not neardup.similar(a, b)


def test_chat_round_trip(spark):
    nasty = "</s>[INST] a <|end|> \\<|role|>\\\\ <s> [/INST] <<SYS>> <</SYS>> \\"
    for text in (nasty, "", "\\", "<\\|", "a\nb", "<|" * 5):
        assert chat.unescape(chat.escape(text)) == text
        assert not re.search(r"<\||</s>|<s>|\[/?INST\]|<</?SYS>>", chat.escape(text))
    turns = [(1, 0, "user", nasty), (1, 1, "assistant", nasty), (1, 2, "user", None), (1, 3, "assistant", "fine"), (1, 4, "user", "left over"),
             (2, 0, "system", "s"), (2, 0, "system", "s"), (2, None, None, "first"), (3, 0, "assistant", ""), (None, 5, "user", LONG), (4, 1, "assistant", "b"), (4, 1, "assistant", "a")]
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, formatted string")
    rows = chat.expand(df)
    examples = rows.where("conv_id = 1 and example is not null").orderBy("example").collect()
    assert [chat.unescape(r.formatted[r.loss_start:r.loss_end]) for r in examples] == [nasty, "fine"]
    assert chat.parse(examples[1].formatted) == [("user", nasty), ("assistant", nasty), ("user", ""), ("assistant", "fine")]
    order = lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")
    got = {r.conv_id: r for r in chat.digests(rows).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for conv, r in got.items():
        own = sorted((t for t in turns if t[0] == conv), key=order)
        replies = "".join(t[3] or "" for t in own if t[2] == "assistant")
        assert r.n_turns == len(own) and r.loss_chars == len(replies)
        assert r.loss_sha256 == hashlib.sha256(replies.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own).encode()).hexdigest()
    assert chat.digests(chat.expand(df.limit(0))).count() == 0
