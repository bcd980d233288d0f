"""Token alignment against a plain version with the vocabularies' own libraries."""

import collections
import hashlib
import random

import pytest

from clauseframe.llm import alignment
from clauseframe.llm.alignment import MARK, Pair, Tokenizer

SCHEMA = "doc_id long, text string, n_a string, __key string, n_links int"


@pytest.fixture(scope="module")
def vocabularies():
    return Tokenizer.byte_level(), Tokenizer.pieces()


@pytest.fixture(scope="module")
def plain():
    import sentencepiece
    import tokenizers

    a = tokenizers.Tokenizer.from_file(alignment.BYTES_MODEL)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECES_MODEL)
    letters = {v: k for k, v in a.get_vocab().items()}
    from clauseframe.llm.alignment import byte_letters

    by_letter = byte_letters()

    def piece(i):
        s = b.id_to_piece(i)
        return bytes([int(s[1:-1], 16)]) if b.is_byte(i) else s.replace(MARK, " ").encode()

    def tokens(text):
        """Both sides' (id, bytes), or nothing."""
        if not text:
            return [], []
        x = [(i, bytes(by_letter[c] for c in letters[i])) for i in a.encode(" " + text, add_special_tokens=False).ids]
        y = [(i, piece(i)) for i in b.encode(text)]
        whole = (" " + text).encode()
        return (x, y) if b"".join(t for _, t in x) == whole == b"".join(t for _, t in y) else ([], [])

    return tokens


def spans(side):
    at, out = 0, []
    for i, t in side:
        out.append((i, at, at + len(t)))
        at += len(t)
    return out


def brute(texts, tokens):
    """Rows by place of the text, and the pairs' counts, every pair of tokens looked at."""
    rows, links = [], []
    for text in texts:
        x, y = map(spans, tokens(text))
        cuts = sorted({e for _, _, e in x} & {e for _, _, e in y})
        groups, low = [], 0
        for c in cuts:
            groups.append(",".join(str(i) for i, s, e in x if low <= s and e <= c) + "|" + ",".join(str(i) for i, s, e in y if low <= s and e <= c))
            low = c
        links.append([(i, j) for i, s, e in x for j, u, v in y if s < v and u < e])
        rows.append([len(x), len(y), len(cuts), len(links[-1]), hashlib.sha256(";".join(groups).encode()).hexdigest() if x else ""])
    n = collections.Counter(p for some in links for p in some)
    top = collections.defaultdict(int)
    for (_, j), k in n.items():
        top[j] = max(top[j], k)
    out = [(*r[:4], sum(n[p] == top[p[1]] for p in some), sum(n[p] for p in some), r[4]) for r, some in zip(rows, links, strict=True)]
    return out, {(i, j, k, k == top[j]) for (i, j), k in n.items()}


ODD = [
    None, "", " ", "a", "  two  spaces ", "\n\n  x\r\n\ty;\r", "a  b   c", "été 中文字 \U0001f600‍", f"has {MARK} the mark", "<|endoftext|> </s> <0x41> [INST]", "'s don't I'll 12,345.6!!\x1c!", "x" * 700,
    "é ﬁ Ⅷ \x00 \x7f", "   ", "a\n", "end ", "　wide　 space", "﻿bom", "a b c a b c", "a b c a b c", "é\x85\x0b\x0c z",
]


def noise(n, seed=3):
    rng = random.Random(seed)
    signs = list("abcdeéü .,;'\"\n\t\r-_()0123456789<>|") + ["  ", "the ", "中", " ", " ", "\x1c", "ing", " \n", "\U0001f44d", "'re", MARK]
    return ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


def test_words_together_give_the_libraries_ids(vocabularies, plain):
    pair = Pair(*vocabularies)
    encoder = alignment.Encoder(pair)
    texts = [x for x in ODD + noise(600) if x]
    for text, parts in zip(texts, encoder.parts(texts), strict=True):
        x, y = plain(text)
        got = [pair.ids([p[k] for p in parts])[0].tolist() for k in (0, 1)]
        assert got == [[i for i, _ in x], [i for i, _ in y]], text


@pytest.mark.parametrize("held", [alignment.HELD_PAIRS, 60, 0])
def test_against_brute_force(spark, vocabularies, plain, held, monkeypatch):
    monkeypatch.setattr(alignment, "PART_WORDS", 3)
    texts = ODD + noise(25)
    df = spark.createDataFrame([(i if i != 4 else None, x, "n", "k", 1) for i, x in enumerate(texts)], SCHEMA).repartition(3)
    made = alignment.align(df, *vocabularies, held_pairs=held)
    want, pairs = brute(texts, plain)
    got = {r.doc_id: tuple(r)[1:] for r in made.docs.collect()}
    assert got == {i if i != 4 else None: r for i, r in enumerate(want)}
    assert {tuple(r) for r in made.pairs.collect()} == pairs


def test_long_texts_and_empty_tables(spark, vocabularies, plain):
    text = " ".join(noise(1500, seed=9)).replace(MARK, "")
    df = spark.createDataFrame([(1, text, "", "", 0), (1, text, "", "", 0)], SCHEMA)
    rows = alignment.align(df, *vocabularies).docs.collect()
    x, y = plain(text)
    assert len(rows) == 2 and rows[0] == rows[1] and (rows[0].n_a, rows[0].n_b) == (len(x), len(y)) and rows[0].n_links == rows[0].n_a + rows[0].n_b - rows[0].n_groups
    none = alignment.align(df.limit(0), *vocabularies)
    assert none.docs.count() == 0 and none.pairs.count() == 0
