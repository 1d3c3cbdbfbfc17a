"""Phrases, prefix trie and rank-file BPE: cases, SQL, brute force and the library."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import connect, rows

from dagwright.llm import phrases, piece_bpe, prefix_trie

# --- Phrases ---


def brute_phrases(docs, longest, least, top, cover=(80, 100), scale=2_000_000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, count in f.items():
        found = []
        candidates = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        for p, a in candidates.items():
            cuts = [(scale * a // (count[p[:k]] + count[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            inside = any(len(q) > len(p) and cover[1] * b >= cover[0] * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in candidates.items())
            if not inside:
                found.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def mined(spark, docs, **options):
    t = spark.createDataFrame(docs, "lang string, text string").selectExpr("*", "1 as n", "'x' as phrase", "2 as words")
    return sorted(map(tuple, phrases.collocations(t, **options).collect()))


WORDS = ["a", "A", "b", "é", "#", "a.", "b,\n", "c\t", "\x0b", " ", ";"]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["en", "de", None, "und"]), st.one_of(st.none(), st.lists(st.sampled_from(WORDS), max_size=40).map(" ".join))), max_size=12))
def test_phrases_are_brute_force(spark, docs):
    assert mined(spark, docs, least=2, top=5) == brute_phrases(docs, 4, 2, 5)


def test_phrases_over_blocks(spark, monkeypatch):
    """Texts that go on over many small blocks and stretches, most of one language,
    copies, one word over and over, and a table of few bits that takes many phrases
    for frequent: the same phrases."""
    r = random.Random(2)
    docs = [("en", " ".join(r.choice("abcdefg") + r.choice(["", ".", ""]) for _ in range(700))) for _ in range(12)]
    docs += docs[:4] + [("en", "same " * 900), ("de", "x y z, x y z. " * 60), ("fr", "w" * 5000 + " q"), (None, None), ("es", "")]
    want = brute_phrases(docs, 4, 5, 40)
    assert mined(spark, docs, least=5, top=40) == want
    t = spark.createDataFrame(docs, "lang string, text string")
    for name, v in (("BLOCK", 37), ("STRETCH", 64), ("BITS", 8)):
        monkeypatch.setattr(phrases, name, v)
    # Workers import the module anew, so the small blocks are counted here.
    n, blocks = Counter(), phrases.Blocks(3)
    found = []
    for lang, text in t.collect():
        found += blocks.add(lang or "und", text or "")
    found.append(blocks.block())
    assert len(found) > 100 and sum(b.column("own")[0].as_py() for b in found) > 9000
    import numpy as np

    tables = [np.full(1 << 6, (1 << 64) - 1, np.uint64)] * 3
    for b in found:
        words, names, langs = (b.column(c)[0].as_py() for c in ("words", "names", "langs"))
        ids, hashes = np.frombuffer(b.column("ids")[0].as_py(), np.int32), np.arange(len(words), dtype=np.uint64) << np.uint64(50)
        for k in (2, 3, 4):
            for row, c in zip(*phrases.phrases_of(ids, b.column("own")[0].as_py(), hashes, k, tables), strict=True):
                n[names[langs[row[0]]], " ".join(words[i] for i in row)] += int(c)
    every = Counter()
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").lower()):
            w = piece.split()
            every.update((lang or "und", " ".join(w[i : i + k])) for k in (2, 3, 4) for i in range(len(w) - k + 1))
    assert n == every


def test_phrases_numbers_past_64_bits(spark):
    big = 10**17
    schema = "lang string, phrase string, f long"
    levels = [spark.createDataFrame([("en", "a", 3 * big), ("en", "b", 2 * big)], schema), spark.createDataFrame([("en", "a b", big)], schema)]
    assert tuple(phrases.scored(levels).first()) == ("en", "a b", big, 3 * big, 2 * big, 400_000)


def test_phrases_of_tables(spark, sf):
    want = connect(sf).execute(phrases.OP11_SQL).df()
    assert rows(phrases.op11_phrases(spark, sf).toPandas()) == rows(want) and len(want) > 20
    empty = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(empty).count() == 0 and mined(spark, [("en", "a b")]) == []


# --- Prefix trie ---


def rebuilt(conversations):
    turns = defaultdict(list)
    order = lambda r: tuple((x is not None, x or 0) for x in (r[1],)) + tuple((x is not None, x or "") for x in r[2:])
    for r in sorted((r for r in conversations if r[0] is not None), key=lambda r: (r[0], order(r))):
        turns[r[0]].append((r[2] or "", r[3] or ""))
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = turns.get(base, [])[:h] + own[h:]
    return out


def brute_trie(conversations):
    members = defaultdict(list)
    for c, turns in rebuilt(conversations).items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append((c, len(turns)))
    kids = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += kids[k] == 0
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    out = []
    for k, m in members.items():
        ends = ",".join(map(str, sorted(c for c, n in m if n == len(k))))
        out.append((min(m)[0], len(k), min(members[k[:-1]])[0] if k else None, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_bytes"]


def trie(spark, conversations):
    t = spark.createDataFrame(conversations, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as depth", "2 as node", "'k' as key", "3 as position")
    nodes, ends = prefix_trie.prefix_trie(*prefix_trie.shared_prefixes(prefix_trie.keyed(prefix_trie.numbered(t))))
    sha = {(r["conv_id"], r["depth"]): r["ends_sha256"] for r in prefix_trie.end_digests(ends).collect()}
    none = hashlib.sha256(b"").hexdigest()
    return sorted(((*(r[c] for c in COLUMNS), sha.get((r["conv_id"], r["depth"]), none)) for r in nodes.collect()), key=str)


def test_trie_is_brute_force(spark):
    r = random.Random(4)
    talk = []
    for c in [*range(-12, 40), 10**12, 10**12 + 3]:
        for k in range(r.choice([1, 2, 3, 9, 14])):
            talk.append((c, r.choice([k, k, None]) if k else 0, r.choice(["user", "user", None, ""]), r.choice(["é", "b", None, "hello there"])))
    # copies of one long conversation, one of them longer, repeated rows, rows of no conversation
    for c in (1000, 1005, 1010, 1015, 1020):
        talk += [(c, k, "user", f"t{k}") for k in range(60 + (c == 1010))]
    talk += talk[:9] + [(None, 1, "user", "x"), (None, None, None, None)]
    r.shuffle(talk)
    assert trie(spark, talk) == brute_trie(talk)


@pytest.mark.parametrize("talk", [[], [(7, None, None, None)], [(7, 1, "user", "a"), (12, 1, "user", "a"), (-3, 1, "user", "a")], [(5, k, "u", "same") for k in range(12)] + [(10, k, "u", "same") for k in range(12)], [(None, 1, "u", "a")]])
def test_trie_of_small_tables(spark, talk):
    assert trie(spark, talk) == brute_trie(talk)


def test_trie_key_tells_role_from_text(spark):
    t = spark.createDataFrame([(1, 0, "a", "bc"), (2, 0, "ab", "c"), (3, 0, "a", "bc")], "conv_id long, position long, role string, text string")
    keys = [r["key"] for r in prefix_trie.keyed(t).orderBy("conv_id").collect()]
    assert keys[0] == keys[2] != keys[1]


def test_trie_digests_go_on_over_chunks(spark, monkeypatch):
    ids = list(range(0, 40_000, 7))
    ends = spark.createDataFrame([(1, 2, i) for i in reversed(ids)] + [(5, 9, -3)], "conv_id long, depth long, member long").repartition(5)
    got = {(r["conv_id"], r["depth"]): r["ends_sha256"] for r in prefix_trie.end_digests(ends).collect()}
    assert got == {(1, 2): hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), (5, 9): hashlib.sha256(b"-3").hexdigest()}


def test_trie_of_tables(spark, sf):
    got = prefix_trie.op12_prefix_trie(spark, sf).toPandas()
    want = connect(sf).execute(prefix_trie.OP12_SQL).df()
    for d in (got, want):
        d["parent_conv_id"] = d["parent_conv_id"].astype("Int64").astype(str)
    assert rows(got) == rows(want)


# --- Rank-file BPE ---


@pytest.fixture(scope="module")
def files():
    path = str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    with open(path, "rb") as f:
        spec = f.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, spec.splitlines())}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return path, piece_bpe.PieceBpe(spec, public_tokenizers.PATTERN), lib


def digest(lib, text):
    ids = lib.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode_bytes(ids)).hexdigest()


def test_pieces_of_every_code_point(files):
    _, own, lib = files
    for start in range(0, 0x110000, 64):
        chars = [chr(c) for c in range(start, start + 64) if not 0xD800 <= c < 0xE000]
        text = "".join(f"a{c} {c}b{c}{c}1 " for c in chars)
        assert own.encode(text).tolist() == lib.encode_ordinary(text), hex(start)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abest '\n\t ü.,1й日"), st.characters(codec="utf-8")), max_size=80))
def test_pieces_are_the_librarys(files, text):
    _, own, lib = files
    assert own.encode(text).tolist() == lib.encode_ordinary(text)
    assert own.decode(own.encode(text).tolist()) == text.encode()
    assert own.digest(text) == digest(lib, text)


def test_pieces_of_long_texts(files, monkeypatch):
    _, own, lib = files
    monkeypatch.setattr(piece_bpe, "STRETCH", 50)
    monkeypatch.setattr(piece_bpe, "PIECES", 30)
    for text in ("ab" * 60_000, "word and, 12 other words\n\n" * 900, " " * 30_000, "é" * 5000 + " x"):
        assert own.encode(text).tolist() == lib.encode_ordinary(text) and own.digest(text) == digest(lib, text)


def test_pieces_of_tables(spark, sf, files):
    path, _, lib = files
    docs = [(1, None), (2, ""), (3, "the cat's 12 dogs  \n"), (3, "the cat's 12 dogs  \n"), (None, "é"), (5, "<|endoftext|> 　" + "x" * 9000)]
    t = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as n_tokens")
    got = piece_bpe.digests(t, path, public_tokenizers.PATTERN)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((d, *digest(lib, x)) for d, x in docs), key=str)
    ids = piece_bpe.encode(t, path, public_tokenizers.PATTERN)
    assert sorted((str(r["doc_id"]), r["ids"]) for r in ids.collect()) == sorted((str(d), lib.encode_ordinary(x or "")) for d, x in docs)
    back = piece_bpe.decode(ids.unionByName(spark.createDataFrame([(9, None)], "doc_id long, ids array<int>")), path, public_tokenizers.PATTERN)
    assert sorted((str(r["doc_id"]), bytes(r["bytes"])) for r in back.collect()) == sorted([(str(d), (x or "").encode()) for d, x in docs] + [("9", b"")])
    assert piece_bpe.digests(t.limit(0), path, public_tokenizers.PATTERN).count() == 0
    whole = {r["doc_id"]: tuple(r)[1:] for r in piece_bpe.op13_piece_bpe(spark, sf).collect()}
    assert whole == {d: digest(lib, x) for d, x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
