import random
import zlib

import numpy as np
import pytest

from stormcell.llm import packing, token_counts, tokens

from .samples import clash, documents, frame, prose

PATH = tokens.default_path()
ODD = ["", " a b ", "a\nb c \n d", "I'll don't ''s  \n\n x", "²³ é½ ªº \x85\x1c\x1d_-", "x" * 5000,
       " " * 50 + "a", "ɐab ǅ", "a <|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext|",
       "日本語 ①② ａ１", "a b  c", "é ​", "퟿\U0001f600 x", "a\r\n b\t c"]


@pytest.fixture(scope="module")
def library():
    tok, _ = tokens.load(PATH)
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids


def test_ids_are_the_librarys(library):
    texts = ODD + [t for _, t, *_ in documents()]
    texts += ["a" + chr(c) + "b " + chr(c) + " 1" + chr(c) + chr(c) for c in range(0x250)]
    r = random.Random(4)
    signs = [chr(c) for c in [*range(0x21), 0x7f, *range(0x80, 0xa1), 0x1680, 0x2028, 0x200b, 0x3000]]
    texts += ["".join(r.choice([*signs, "'s", "'ll", "a", "1", "_", " "]) for _ in range(r.randint(1, 8)))
              for _ in range(20_000)]
    for t in texts:
        assert np.frombuffer(tokens.encode(t, PATH), "<u4").tolist() == library(t), repr(t)[:60]
        assert sum(tokens.n_pieces(tokens.pretokens(t, PATH), PATH)) == len(library(t))


def test_a_latin_text_is_encoded_in_one_call(library):
    held = tokens._ids(PATH)
    before = dict(held)
    for text in [" ".join(f"word{i}é," for i in range(5000)), "a \n\n\t b", "\n" * tokens.WHOLE]:
        assert np.frombuffer(tokens.encode(text, PATH), "<u4").tolist() == library(text)
    assert held == before  # no look-up, and no call, for each word
    text = "a <|endoftext|> b" + "\n" * tokens.WHOLE + "c"  # longer, or with a special string: in pieces
    assert np.frombuffer(tokens.encode(text, PATH), "<u4").tolist() == library(text)


def test_parts_have_the_pretokens_of_the_text():
    texts = ODD + [t for _, t, *_ in documents()]
    texts += [" lead and trail ", "éa ª1 don't ɏ_ <|endoftext|>x a<|endoftext|> b", "x\ny z\nw", "a \x1c b"]
    for t in texts:
        first, rest = tokens.parted(t, PATH)
        assert first + [p for c in rest for p in tokens.spaced(c, PATH)] == tokens.pretokens(t, PATH), t


def test_words_need_no_pattern_and_odd_texts_are_not_kept(monkeypatch):
    text = prose(7, 2000)
    whole = tokens.pretokens(text, PATH)
    calls = []
    cut = tokens.pretokens
    monkeypatch.setattr(tokens, "pretokens", lambda t, path: calls.append(t) or cut(t, path))
    half = dict.fromkeys(whole[::2], 2)
    known = token_counts._Known(half, PATH)
    n, others = known.count(text)
    assert calls == [text.split(" ")[0]]
    assert n == sum(half.get(p, 0) for p in whole)
    assert sorted(others.elements()) == sorted(p for p in whole if p not in half)
    odd = "tab\tand  spaces\n\n" * 50
    assert known.count(odd)[1].total() == len(cut(odd, PATH))
    assert odd not in known and known.keys() <= set(text.split(" "))


@pytest.mark.parametrize("head", [200_000, 5])
def test_token_counts(spark, library, head):
    rows = documents() + [(100 + i, t, None, None, None) for i, t in enumerate(ODD)]
    got = token_counts.token_counts(clash(frame(spark, rows)), head=head).collect()
    want = [(d, len((t or "").encode()), len(library(t)), len(library(t)) > 1024)
            for d, t, *_ in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_empty_tables(spark):
    assert token_counts.token_counts(frame(spark, [])).count() == 0
    assert packing.pack(frame(spark, [])).count() == 0


@pytest.mark.parametrize("shard_rows", [250_000, 7])
def test_packing(spark, library, shard_rows):
    rows = documents() + [(200 + i, prose(i, 5 + 11 * i), None, None, None) for i in range(40)]
    got = packing.pack(clash(frame(spark, rows)), shard_rows=shard_rows).collect()
    ids = {}
    for d, t, *_ in rows:
        ids.setdefault(d, library(t) + [2])
    for r in got:
        part = ids[r.doc_id][r.start:r.start + r.length]
        assert len(part) == r.length <= 1024
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        n = len(ids[r.doc_id])
        if n <= 1024:
            assert (r.piece, r.start, r.length) == (0, 0, n)
        elif r.piece:
            assert r.length == 1024
    assert sum(r.length for r in got) == sum(len(library(t)) + 1 for _, t, *_ in rows)
    sequences = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert sequences.get(r.sequence_id, 0) == r.offset
        sequences[r.sequence_id] = r.offset + r.length
    assert max(sequences.values()) <= 1024


def test_sum_of_squares_against_a_plain_version():
    r = np.random.default_rng(5)
    lengths = r.integers(1, 40, 300)
    gaps, want = [], []
    for s in lengths.tolist():
        def total(g):
            after = [*gaps]
            after.remove(g)
            return sum(after.count(x) ** 2 for x in {y for y in [*after, g - s] if y}) if g == s else \
                sum([*after, g - s].count(x) ** 2 for x in {*after, g - s} if x)
        fits = sorted({g for g in gaps if g >= s})
        g = min(fits, key=lambda g: (total(g), g)) if fits else 40
        if fits:
            gaps.remove(g)
        if g > s:
            gaps.append(g - s)
        want.append(40 - g)
    bins, offsets = packing.sum_of_squares(lengths, 40)
    assert offsets.tolist() == want
    fill = np.bincount(bins, lengths)
    assert fill.max() <= 40


def test_packing_is_close_to_the_bound():
    lengths = np.sort(np.random.default_rng(6).integers(1, 1024, 5000))[::-1]
    bins, _ = packing.sum_of_squares(lengths, 1024)
    assert bins.max() + 1 <= 1.01 * lengths.sum() / 1024
